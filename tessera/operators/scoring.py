"""Findings: refactor score, ranking and the aggregates of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def refactor_score(tokens: Column, matches: Column) -> Column:
    """tokens * (1 + ln(1 + d)) * (1 + 0.1 (d - 1) if d > 1)"""
    return tokens * (1 + F.log1p(matches)) * F.when(matches > 1, 1 + 0.1 * (matches - 1)).otherwise(1.0)


def finding_id(src: Column, match: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", src.cast("string"), match.cast("string")).cast("binary"), 256), 1, 16)


def generated(pairs: DataFrame) -> DataFrame:
    """All findings of verified pairs (src, match, tokens, the four scores[, semantic_similarity]); ``d``, the verified
    matches of the source, goes into the score."""
    semantic = F.col("semantic_similarity") if "semantic_similarity" in pairs.columns else F.lit(None).cast("double")
    rows = pairs.withColumn("d", F.count("*").over(Window.partitionBy("src")))
    rows = rows.withColumn("refactor_score", refactor_score(F.col("tokens"), F.col("d"))).withColumn("finding_id", finding_id(F.col("src"), F.col("match")))
    return rows.withColumn("type", F.when(semantic.isNotNull(), "semantic").otherwise("near_miss")).withColumn("status", F.lit("active"))


def ranked(rows: DataFrame, min_score: float = 200.0, limit: int = 5) -> DataFrame:
    """Findings of at least ``min_score``, the ``limit`` best of each source."""
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("refactor_score"), F.desc("similarity_confidence"), "match"))
    return rows.where(F.col("refactor_score") >= min_score).withColumn("r", best).where(F.col("r") <= limit).drop("r", "d")


def findings(pairs: DataFrame, min_score: float = 200.0, limit: int = 5) -> DataFrame:
    return ranked(generated(pairs), min_score, limit)


SCORES = ("overlap_score", "jaccard_score", "edit_density", "similarity_confidence", "semantic_similarity")


def stored(rows: DataFrame) -> DataFrame:
    """Findings as rows of the store: the scores that there are as a map."""
    there = [c for c in SCORES if c in rows.columns]
    scores = F.create_map(*(x for c in there for x in (F.lit(c), F.col(c).cast("double"))))
    return rows.select("finding_id", "src", "match", scores.alias("scores"), "type", F.col("similarity_confidence").alias("confidence"), "refactor_score", "status", F.current_timestamp().alias("created_at"))


def quality_band(score: Column) -> Column:
    return F.when(score >= 500, "high").when(score >= 200, "medium").otherwise("low")


def upper_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, upper_median): the middle value of each group, of an even number the upper one. Equal values are counted
    before any group is gathered, so what a task sorts are a group's different values."""
    w = Window.partitionBy(group)
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    placed = counted.withColumn("before", F.sum("n").over(w.orderBy(value)) - F.col("n")).withColumn("middle", F.floor(F.sum("n").over(w) / 2))
    return placed.where((F.col("before") <= F.col("middle")) & (F.col("middle") < F.col("before") + F.col("n"))).select(group, F.col(value).alias("upper_median"))


def summary(rows: DataFrame) -> DataFrame:
    """Counts of bands and high priority, average, least and greatest score."""
    s = F.col("refactor_score")
    return rows.agg(F.count("*").alias("total"), F.count_if(s >= 500).alias("high"), F.count_if((s >= 200) & (s < 500)).alias("medium"), F.count_if(s < 200).alias("low"), F.count_if(s >= 100).alias("high_priority"), F.coalesce(F.avg(s), F.lit(0.0)).alias("avg_score"), F.coalesce(F.min(s), F.lit(0.0)).alias("min_score"), F.coalesce(F.max(s), F.lit(0.0)).alias("max_score"))


def folder_of(path: Column) -> Column:
    """The parent folder; 'Root' without one, 'Unknown' for null."""
    return F.when(path.isNull(), "Unknown").when(~path.contains("/"), "Root").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def share(value: Column) -> Column:
    """Percentage of the total over all rows; 0 if that is 0."""
    total = F.sum(value).over(Window.partitionBy())
    return F.when(total == 0, 0.0).otherwise(F.try_divide(100.0 * value, total))


def pass_percentage(part: Column, whole: Column) -> Column:
    return F.floor(part * 100 / F.greatest(whole, F.lit(1))).cast("long")


def similarity_percent(semantic: Column, structural: Column, jaccard: Column) -> Column:
    return 100 * (0.6 * F.coalesce(semantic, F.lit(0.0)) + 0.4 * F.coalesce(structural, jaccard, F.lit(0.0)))


def in_scope(rows: DataFrame, scope: str = "all") -> DataFrame:
    if scope == "high_confidence":
        return rows.where("refactor_score >= 1000")
    return rows.where("type = 'semantic'") if scope == "semantic_only" else rows


def top_findings(rows: DataFrame, kind: str | None = None, min_score: float = 200.0, limit: int = 50) -> DataFrame:
    rows = rows.where(F.col("status") == "active").where(F.col("refactor_score") >= min_score)
    return (rows if kind is None else rows.where(F.col("type") == kind)).orderBy(F.desc("refactor_score"), "finding_id").limit(limit)


def touching(rows: DataFrame, block, status: str = "active") -> DataFrame:
    return rows.where(((F.col("src") == block) | (F.col("match") == block)) & (F.col("status") == status)).orderBy(F.desc("refactor_score"))


def resource(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(finding_id, json): a finding with its two blocks (block_id, lang, file_path, start_line, end_line) as nested JSON."""
    b = lambda p: blocks.select(*(F.col(c).alias(f"{p}_{c}") for c in ("block_id", "lang", "file_path", "start_line", "end_line")))
    joined = rows.join(b("s"), F.col("src") == F.col("s_block_id")).join(b("m"), F.col("match") == F.col("m_block_id"))
    place = lambda p: [F.col(f"{p}_file_path").alias("path"), F.col(f"{p}_start_line").alias("start"), F.col(f"{p}_end_line").alias("end")]
    cos = F.col("semantic_similarity") if "semantic_similarity" in rows.columns else F.lit(None).cast("double")
    scores = F.struct(F.col("jaccard_score").alias("jaccard"), F.col("overlap_score").alias("overlap"), cos.alias("cosine"), F.col("refactor_score").alias("R"))
    whole = F.struct(F.col("finding_id").alias("id"), F.struct(F.col("s_lang").alias("lang"), *place("s")).alias("unit"), F.array(F.struct(*place("m"), scores.alias("scores"), F.col("type"))).alias("matches"))
    return joined.select("finding_id", F.to_json(whole).alias("json"))
