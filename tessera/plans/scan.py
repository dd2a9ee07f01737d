"""The scan: blocks to findings, signatures settled once and the rest one lazy plan, over a whole repository or over changes against an index."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.tokens import hash_signature, normalize
from tessera.operators import minhash, scoring, store, vectors, verify
from tessera.operators.tables import settled
from tessera.sources import blocks as B
from tessera.sources import files as S


@dataclass
class ScanResult:
    blocks: DataFrame
    normalized: DataFrame
    signatures: DataFrame
    candidates: DataFrame
    verified: DataFrame
    pairs: DataFrame
    generated: DataFrame
    findings: DataFrame

    def shared(self) -> list[DataFrame]:
        return [self.signatures, self.candidates, self.verified, self.generated]

    def persist(self) -> "ScanResult":
        """Keep what findings and counters have in common, on executors, to memory or disk; what is lost is made again."""
        for df in self.shared():
            df.persist()
        return self

    def unpersist(self) -> None:
        for df in self.shared():
            df.unpersist()

    def statistics(self) -> dict[str, int]:
        """The counters of a scan, a count of each stage; after ``persist`` no stage is computed again."""
        out = {"blocks_extracted": self.blocks.count(), "blocks_indexed": self.signatures.count()}
        out |= {"lsh_queries": out["blocks_indexed"], "candidates_generated": self.candidates.count(), "near_miss_verifications": self.verified.count()}
        out |= {"findings_generated": self.generated.count(), "findings": self.findings.count()}
        if "file_path" in self.blocks.columns:
            out["files_processed"] = self.blocks.agg(F.count_distinct("file_path")).first()[0]
        out["findings_filtered"] = out["findings_generated"] - out["findings"]
        out["semantic_comparisons"] = out["near_miss_verifications"] if "semantic_similarity" in self.pairs.columns else 0
        return out


def load_blocks(spark: SparkSession, root: str, config: Config, paths: list[str] | None = None) -> DataFrame:
    """The useful blocks of a tree, or of stated files of it."""
    files = S.read_files(spark, root, S.ignore_rules(root, config.ignore_patterns)) if paths is None else S.index_files(spark, root, paths)[0]
    rows = B.useful(B.extract_blocks(files, config.supported_languages), config.min_tokens)
    return rows.withColumn("block_id", store.block_id(F.col("file_path"), F.col("start_line"), F.col("end_line")))


def verified_candidates(candidates: DataFrame, tokens: DataFrame, key: str, **thresholds) -> DataFrame:
    """``candidates`` (src, match, ...) that can be duplicates, with the eight metrics. ``tokens``: (key, tokens). Blocks of
    equal tokens are one text, and a pair of texts is aligned once, however many blocks have them."""
    hashed = tokens.select(key, hash_signature(F.col("tokens")).alias("h"))
    named = hashed.join(hashed.groupBy("h").agg(F.min(key).alias("text")), "h").select(key, "text")
    pairs = candidates
    for side, text in (("src", "x"), ("match", "y")):
        pairs = pairs.join(named.select(F.col(key).alias(side), F.col("text").alias(text)), side)
    own = lambda text, a: tokens.select(F.col(key).alias(text), F.col("tokens").alias(a))
    texts = pairs.select("x", "y").distinct().join(own("x", "a"), "x").join(own("y", "b"), "y")
    metrics = verify.verify(texts, prune=True, **thresholds).withColumn("tokens", F.size("a")).drop("a", "b")
    return pairs.join(metrics, ["x", "y"]).drop("x", "y")


def scan_blocks(blocks: DataFrame, config: Config, index: DataFrame | None = None, embeddings: DataFrame | None = None, signatures: DataFrame | None = None) -> ScanResult:
    """``blocks``: block_id, lang, tokens. ``index``: (block_id, normalized_tokens) of earlier scans, which changed blocks
    meet; ``signatures``: those of the index as stored, so that nothing of it is hashed again (what is not stored is)."""
    normal = normalize(blocks.select("block_id", "lang", "tokens"), mappings=False)
    of = lambda rows: minhash.signatures(rows, "block_id", F.col("normalized_tokens"), config.num_hashes, config.shingle_size)
    sigs = settled(of(normal))
    shape = (config.max_candidates, config.num_bands, config.num_hashes)
    found = minhash.member_candidates(sigs, "block_id", *shape)
    every = normal.select("block_id", F.col("normalized_tokens").alias("tokens"))
    if index is not None:
        old = index.join(blocks.select("block_id"), "block_id", "left_anti").select("block_id", "normalized_tokens")
        known = of(old) if signatures is None else None
        if signatures is not None:
            stored = signatures.where(F.size("signature") == config.num_hashes).join(old.select("block_id"), "block_id", "left_semi").select("block_id", "signature")
            known = stored.union(of(old.join(stored.select("block_id"), "block_id", "left_anti")))
        found = minhash.most_alike(found.union(minhash.index_candidates(sigs, settled(known), "block_id", *shape)), config.max_candidates)
        every = every.union(old)
    verified = verified_candidates(found, every, "block_id", overlap_threshold=config.overlap_threshold, density_threshold=config.edit_density_threshold)
    pairs = verified.where("is_duplicate")
    if embeddings is not None and config.tau_semantic > 0:
        pairs = vectors.rerank(pairs, embeddings, "block_id", "embedding", config.tau_semantic)
    generated = scoring.generated(pairs)
    return ScanResult(blocks, normal, sigs, found, verified, pairs, generated, scoring.ranked(generated, config.min_refactor_score, config.max_matches_per_block))


def scan_repository(spark: SparkSession, root: str, config: Config | None = None) -> ScanResult:
    config = config or Config()
    return scan_blocks(load_blocks(spark, root, config), config)


def scan_changed(spark: SparkSession, root: str, changed: list[str], index: DataFrame, config: Config | None = None, signatures: DataFrame | None = None) -> ScanResult:
    config = config or Config()
    return scan_blocks(load_blocks(spark, root, config, changed), config, index, signatures=signatures)


def within_budget(spark: SparkSession, budget_ms: int, run):
    """(result of ``run()`` or None, milliseconds, warning). The jobs of ``run`` form a group that is cancelled at 95 % of the
    budget; over 80 % there is a warning. 0 is no budget."""
    began, late, group = time.time(), [], f"tessera-{uuid.uuid4().hex}"
    sc = spark.sparkContext

    def stop() -> None:
        late.append(True)
        sc._jsc.sc().cancelJobGroupAndFutureJobs(group)

    timer = threading.Timer(0.95 * budget_ms / 1000, stop) if budget_ms else None
    sc.setJobGroup(group, "scan", interruptOnCancel=True)
    try:
        if timer:
            timer.start()
        out = run()
    except Exception:
        if not late:
            raise
        out = None
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    took = int(1000 * (time.time() - began))
    warning = "the time budget ran out; the result is partial" if late else "over 80 % of the time budget was used" if budget_ms and took > 0.8 * budget_ms else None
    return out, took, warning
