"""Embeddings: cosine, threshold neighbours, exact k nearest neighbours, rerank, and upkeep of a vector table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")
#: Queries that a task holds at once; larger sets are searched block by block.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.try_divide(dot(a, b), norms))


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        q, x = (m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n) for m in (q, x))
    s = q @ x.T
    if metric == "l2":
        s = 1 / (1 + np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * s))
    return s


def _search(vectors: DataFrame, queries: DataFrame, key: str, column: str, metric: str, pick) -> DataFrame:
    """Meet all vectors with the queries, block by block, and keep of each part what ``pick`` marks: (query, match, score)."""
    check_metric(metric)
    spark = vectors.sparkSession
    kind, typed = ("string", pa.string()) if dict(vectors.dtypes)[key] == "string" else ("long", pa.int64())
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).cast(kind).alias("id"), F.col(column).cast("array<double>").alias("v"))
    asked = queries.where(F.col(column).isNotNull()).select(F.col(key).cast(kind).alias("id"), F.col(column).cast("array<double>").alias("v"))
    n_blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for i in range(n_blocks):
        table = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == i).toArrow()
        ids = table.column("id").to_numpy()
        sent = spark.sparkContext.broadcast((ids, np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))))

        def run(batches, sent=sent):
            qid, q = sent.value
            for b in batches:
                for at in range(0, b.num_rows if len(qid) else 0, 4096):
                    part = b.slice(at, 4096)
                    x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                    s, own = _scores(q, x, metric), part.column(0).to_numpy(zero_copy_only=False)
                    s[qid[:, None] == own[None]] = -np.inf
                    qs, xs = np.nonzero(pick(s))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[qs], typed), pa.array(own[xs], typed), pa.array(s[qs, xs])], ["query", "match", "score"])

        found = rows.mapInArrow(run, f"query {kind}, match {kind}, score double")
        out = found if out is None else out.union(found)
    return out


def neighbours(vectors: DataFrame, queries: DataFrame, key: str, column: str, threshold: float = 0.83) -> DataFrame:
    """(query, match, score) with a cosine of at least ``threshold``."""
    return _search(vectors, queries, key, column, "cosine", lambda s: s >= threshold)


def knn(vectors: DataFrame, queries: DataFrame, key: str, column: str, k: int = 20, metric: str = "cosine", digits: int = 6) -> DataFrame:
    """The k best of each query (query, match, score, rank). A task sends its own k best at most, ties included."""

    def pick(s: np.ndarray) -> np.ndarray:
        if s.shape[1] <= k:
            return np.isfinite(s)
        # Scores are compared as rounded, so ties of the rounded scores are kept too.
        r = np.round(s, digits)
        return (r >= -np.partition(-r, k - 1, axis=1)[:, k - 1 : k]) & np.isfinite(s)

    found = _search(vectors, queries, key, column, metric, pick).withColumn("score", F.round("score", digits))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "match"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


class Embedder:
    """The hook for a model: a name, a dimension, and ``embed``, which turns a list of token lists into vectors. The model is
    made on the executors, once a worker, by ``make()``."""

    def __init__(self, name: str, dimension: int, make):
        self.name, self.dimension, self.make = name, dimension, make


def hashed_counts(dimension: int = 256) -> Embedder:
    """An embedder without a model: counts of tokens and pairs of tokens, hashed to ``dimension`` signed places, unit length."""

    def make():
        import zlib

        def embed(token_lists):
            out = np.zeros((len(token_lists), dimension), np.float32)
            for i, toks in enumerate(token_lists):
                for x in [*toks, *(f"{a} {b}" for a, b in zip(toks, toks[1:]))]:
                    h = zlib.crc32(x.encode())
                    out[i, h % dimension] += 1.0 if h >> 31 else -1.0
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return embed

    return Embedder(f"hashed-{dimension}", dimension, make)


def embed_blocks(blocks: DataFrame, embedder: Embedder, key: str = "block_id", tokens: str = "tokens") -> DataFrame:
    """(key, embedding) of all blocks, in Arrow batches; a block without tokens has a vector without length."""
    make, dimension = embedder.make, embedder.dimension
    rows = blocks.select(key, tokens)

    def run(batches):
        embed = make()
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                found = np.asarray(embed([t or [] for t in part.column(1).to_pylist()]), np.float32)
                if found.shape != (part.num_rows, dimension):
                    raise ValueError(f"the embedder gave {found.shape}, not ({part.num_rows}, {dimension})")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), dimension).cast(pa.list_(pa.float32()))], [key, "embedding"])

    return rows.mapInArrow(run, f"{key} {dict(blocks.dtypes)[key]}, embedding array<float>")


def batch_similarity(targets: DataFrame, candidates: DataFrame, key: str = "block_id", tau: float = 0.83) -> DataFrame:
    """(query, match, score) of targets and candidates (key, embedding), equal keys left out, with a cosine of at least ``tau``."""
    return _search(candidates, targets, key, "embedding", "cosine", lambda s: s >= tau)


def rebuild(index: DataFrame, key: str) -> DataFrame:
    """The live vectors, one a key: what compaction of an index with tombstones gives."""
    return index.where(F.col(key).isNotNull()).dropDuplicates([key])


def clear(index: DataFrame) -> DataFrame:
    return index.where("false")


def rerank(pairs: DataFrame, vectors: DataFrame, key: str, column: str, tau: float = 0.83) -> DataFrame:
    """Pairs (src, match, ...) whose vectors have a cosine of at least ``tau``, with semantic_similarity. No re-sort."""
    a = vectors.select(F.col(key).alias("src"), F.col(column).alias("__a"))
    b = vectors.select(F.col(key).alias("match"), F.col(column).alias("__b"))
    return pairs.join(a, "src").join(b, "match").withColumn("semantic_similarity", cosine(F.col("__a"), F.col("__b"))).where(F.col("semantic_similarity") >= tau).drop("__a", "__b")


def add(index: DataFrame, new: DataFrame, column: str, dimension: int) -> DataFrame:
    """``index`` and ``new``; a vector of another length raises when it is read."""
    checked = F.when(F.size(column) == dimension, F.col(column)).otherwise(F.raise_error(F.lit(f"vectors must have {dimension} components")).cast(new.schema[column].dataType))
    return index.unionByName(new.withColumn(column, checked))


def remove(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key), key, "left_anti")


def update(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replace vectors of known keys; unknown keys are left out."""
    known = new.join(index.select(key), key, "left_semi")
    return remove(index, known, key).unionByName(known.select(*index.columns))


def statistics(index: DataFrame, column: str, metric: str = "cosine") -> DataFrame:
    check_metric(metric)
    return index.agg(F.count("*").alias("total_vectors"), F.max(F.size(column)).alias("dimension")).withColumn("metric", F.lit(metric))
