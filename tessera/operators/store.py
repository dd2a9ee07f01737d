"""The store: tables of files, blocks, findings, metadata and signatures as Parquet snapshots.

Each change is a new snapshot derived from the old one by joins, written beside it and then made current, so a reader
sees the old or the new table, never a part, and a lost executor costs a recomputed task. The last ``KEPT`` snapshots stay,
so a reader that holds an older one can end.
"""

from __future__ import annotations

import datetime
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "files": "path string, lang string, hash string, last_indexed timestamp, ignored boolean, size_bytes long, lines long",
    "blocks": "block_id string, file_path string, start_line int, end_line int, lang string, tokens array<string>, norm_hash string, churn long, node_type string, complexity double, updated_at timestamp",
    "findings": "finding_id string, src string, match string, scores map<string,double>, type string, confidence double, refactor_score double, status string, created_at timestamp",
    "metadata": "key string, value string, updated_at timestamp",
    "signatures": "block_id string, signature array<bigint>",
    "embeddings": "block_id string, embedding array<float>",
}
SCHEMA_VERSION = "1.0.0"
KEPT = 3


def block_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", path, start.cast("string"), end.cast("string"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """As ``upsert``; a known block's churn rises by one and its node_type stays, a new block's churn is 0."""
    known = old.select("block_id", F.col("churn").alias("__churn"), F.col("node_type").alias("__type"))
    merged = new.join(known, "block_id", "left").withColumn("churn", F.coalesce(F.col("__churn") + 1, F.lit(0)).cast("long")).withColumn("node_type", F.coalesce("__type", "node_type"))
    return upsert(old, merged, "block_id")


def delete_blocks(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """``blocks`` without those of the files ``paths`` (path)."""
    return blocks.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(*blocks.columns)


def replace_blocks(old: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    """As ``upsert_blocks``, for files that were read anew: blocks of ``paths`` that are not in ``new`` go."""
    merged = upsert_blocks(old, new)
    stale = old.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").join(new.select("block_id"), "block_id", "left_anti").select("block_id")
    return merged.join(stale, "block_id", "left_anti").select(*merged.columns)


def blocks_by_hash(blocks: DataFrame, norm_hash, lang=None) -> DataFrame:
    """Blocks of one normalised hash, of one language if that is given."""
    rows = blocks.where(F.col("norm_hash") == norm_hash)
    return rows if lang is None else rows.where(F.col("lang") == lang)


def blocks_by_file(blocks: DataFrame, path) -> DataFrame:
    """Blocks of one file from its first line to its last."""
    return blocks.where(F.col("file_path") == path).orderBy("start_line", "end_line")


def finding_by_id(findings: DataFrame, finding) -> DataFrame:
    return findings.where(F.col("finding_id") == finding)


def with_files(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks with their file's hash, size and lines; null where the file is not stored."""
    own = files.select(F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), F.col("size_bytes").alias("file_size"), F.col("lines").alias("file_lines"))
    return blocks.join(own, "file_path", "left")


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files of ``gone`` (path), their blocks, and findings and signatures of those blocks."""
    out = dict(tables)
    out["files"] = tables["files"].join(gone.select("path"), "path", "left_anti")
    lost = tables["blocks"].join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("block_id")
    out["blocks"] = tables["blocks"].join(lost, "block_id", "left_anti")
    for side in ("src", "match"):
        out["findings"] = out["findings"].join(lost.select(F.col("block_id").alias(side)), side, "left_anti")
    for name in ("signatures", "embeddings"):
        if name in out:
            out[name] = out[name].join(lost, "block_id", "left_anti")
    return out


def suppress(findings: DataFrame, finding: str) -> DataFrame:
    return findings.withColumn("status", F.when(F.col("finding_id") == finding, "suppressed").otherwise(F.col("status")))


def changed_files(current: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path, hash, ...) that are not stored or whose content hash differs."""
    known = files.select("path", F.col("hash").alias("__known"))
    return current.join(known, "path", "left").where(F.col("__known").isNull() | (F.col("__known") != F.col("hash"))).drop("__known")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def initialize(self) -> None:
        """Note the time of the first use."""
        if self.get_metadata("initialized_at") is None:
            self.set_metadata("initialized_at", datetime.datetime.now(datetime.timezone.utc).isoformat())

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.root}/{name}")
        found = sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])) if fs.exists(p) else []
        return f"{self.root}/{name}/{found[-1]}" if found else None

    def read(self, name: str) -> DataFrame:
        path = self._current(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(path) if path else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, rows: DataFrame) -> None:
        """Make ``rows`` the current snapshot; all but the last ``KEPT`` go."""
        old = self._current(name)
        number = int(old.rpartition("/v")[2].split("-")[0]) + 1 if old else 0
        rows.write.parquet(f"{self.root}/{name}/v{number:09d}-{uuid.uuid4().hex[:8]}")
        fs, p = self._fs(f"{self.root}/{name}")
        for gone in sorted(s.getPath().getName() for s in fs.listStatus(p))[:-KEPT]:
            fs.delete(self._fs(f"{self.root}/{name}/{gone}")[1], True)

    def upsert_files(self, rows: DataFrame) -> None:
        self.write("files", upsert(self.read("files"), latest(rows, "path", "last_indexed"), "path"))

    def upsert_blocks(self, rows: DataFrame) -> None:
        self.write("blocks", upsert_blocks(self.read("blocks"), latest(rows, "block_id", "updated_at")))

    def delete_blocks(self, paths: DataFrame) -> int:
        """Delete the blocks of files; how many there were."""
        old = self.read("blocks")
        n = old.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").count()
        self.write("blocks", delete_blocks(old, paths))
        return n

    def replace_blocks(self, paths: DataFrame, rows: DataFrame) -> None:
        self.write("blocks", replace_blocks(self.read("blocks"), paths, latest(rows, "block_id", "updated_at")))

    def save_vectors(self, rows: DataFrame, metric: str = "cosine") -> None:
        """The vector table (block_id, embedding) with its dimension, metric and size as metadata."""
        self.write("embeddings", rows.select("block_id", F.col("embedding").cast("array<float>").alias("embedding")))
        sizes = self.read("embeddings").agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
        for key, value in (("dimension", sizes["d"]), ("metric", metric), ("total", sizes["n"])):
            self.set_metadata(f"vectors:{key}", str(value))

    def load_vectors(self) -> DataFrame:
        """The vector table; empty, with a warning, if its rows are not those that its metadata counts."""
        rows, total = self.read("embeddings"), self.get_metadata("vectors:total")
        if total is not None and rows.count() != int(total):
            warnings.warn("the vector table does not match its metadata; it is taken as empty", stacklevel=2)
            return rows.where("false")
        return rows

    def upsert_findings(self, rows: DataFrame) -> None:
        self.write("findings", upsert(self.read("findings"), latest(rows, "finding_id", "created_at"), "finding_id"))

    def add_signatures(self, rows: DataFrame) -> None:
        self.write("signatures", upsert(self.read("signatures"), rows, "block_id"))

    def set_metadata(self, key: str, value: str) -> None:
        row = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.current_timestamp().alias("updated_at"))
        self.write("metadata", upsert(self.read("metadata"), row, "key"))

    def get_metadata(self, key: str) -> str | None:
        row = self.read("metadata").where(F.col("key") == key).first()
        return row["value"] if row else None

    def delete_files(self, gone: DataFrame) -> None:
        after = delete_files({n: self.read(n) for n in ("files", "blocks", "findings", "signatures", "embeddings")}, gone)
        # Files last: until they go, a repeated call finds the same rows to delete.
        for name in ("findings", "signatures", "embeddings", "blocks", "files"):
            after[name].write.parquet(tmp := f"{self.root}/.staged/{uuid.uuid4().hex}")
            self.write(name, self.spark.read.schema(SCHEMAS[name]).parquet(tmp))
            fs, p = self._fs(tmp)
            fs.delete(p, True)

    def suppress(self, finding: str, reason: str) -> None:
        self.write("findings", suppress(self.read("findings"), finding))
        self.set_metadata(f"suppression:{finding}", reason)

    def compact(self, name: str, partitions: int = 1) -> None:
        self.write(name, self.read(name).coalesce(partitions))

    def clear(self) -> None:
        for name in SCHEMAS:
            fs, p = self._fs(f"{self.root}/{name}")
            fs.delete(p, True)

    def size_bytes(self) -> int:
        fs, p = self._fs(self.root)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def statistics(self) -> dict:
        files, blocks, findings = self.read("files"), self.read("blocks"), self.read("findings")
        sizes = blocks.agg(F.count("*").alias("total_blocks"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avg_tokens"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total_tokens")).first().asDict()
        active = F.col("status") == "active"
        found = findings.agg(F.count_if(active).alias("active_findings"), F.count_if(F.col("status") == "suppressed").alias("suppressed_findings"), F.coalesce(F.avg(F.when(active, F.col("refactor_score"))), F.lit(0.0)).alias("avg_refactor_score")).first().asDict()
        by = lambda t, c: {r[c]: r["count"] for r in t.groupBy(c).count().collect()}  # noqa: E731  a row for each language or type
        system = {"schema_version": SCHEMA_VERSION, "initialized_at": self.get_metadata("initialized_at"), "size_mb": self.size_bytes() / 1024 / 1024, "last_updated": datetime.datetime.now(datetime.timezone.utc).isoformat()}
        return {"total_files": files.count(), "ignored_files": files.where("ignored").count(), "files_by_language": by(files, "lang"), "blocks_by_language": by(blocks, "lang"), "findings_by_type": by(findings.where(active), "type"), **system, **sizes, **found}
