"""Pairwise verification of candidates on token arrays."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _masks(a: Sequence) -> dict:
    out: dict = {}
    for i, t in enumerate(a):
        out[t] = out.get(t, 0) | (1 << i)
    return out


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence, a row of the table per machine word (Hyyro 2004)."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    masks, full = _masks(a), (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance with bit vectors of vertical differences (Myers 1999)."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    masks, full, top = _masks(a), (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for t in b:
        eq = masks.get(t, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus, minus = (down | ~((eq | minus) | up)) & full, up & (eq | minus)
    return score


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("lcs", "ed", "na", "nb", "both")]))
def alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Alignment lengths and the sizes of the token sets and their intersection."""
    rows = []
    for x, y in zip(a, b):
        u, v = set(x), set(y)
        rows.append((lcs_length(x, y), edit_distance(x, y), len(u), len(v), len(u & v)))
    return pd.DataFrame(rows, columns=["lcs", "ed", "na", "nb", "both"], dtype="int32")


def jaccard_of(na: Column, nb: Column, both: Column) -> Column:
    return F.when(na + nb == 0, 1.0).otherwise(F.try_divide(both.cast("double"), na + nb - both))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard_of(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), F.size(F.array_intersect(a, b)))


def confidence(overlap: Column, jaccard: Column, density: Column) -> Column:
    """Weighted harmonic mean of overlap (0.5), Jaccard (0.3) and 1 - density (0.2); 0 if any is not positive."""
    kept = F.greatest(F.lit(0.0), 1 - density)
    mean = 1 / (0.5 / overlap + 0.3 / jaccard + 0.2 / kept)
    return F.when((overlap <= 0) | (jaccard <= 0) | (kept <= 0), 0.0).otherwise(mean)


def is_duplicate(overlap: Column, density: Column, conf: Column, overlap_threshold: float = 0.75, density_threshold: float = 0.25) -> Column:
    return (overlap >= overlap_threshold) | ((overlap >= 0.6) & (density <= density_threshold)) | (conf >= 0.7)


def least_length_ratio(overlap_threshold: float = 0.75, min_confidence: float = 0.7) -> float:
    """No pair whose lengths have a smaller ratio can pass a rule."""
    return min(overlap_threshold, 0.6, 0.7 / (1 / min_confidence - 0.3))


def verify(pairs: DataFrame, a: str = "a", b: str = "b", overlap_threshold: float = 0.75, density_threshold: float = 0.25, prune: bool = False) -> DataFrame:
    """``pairs`` with the eight metrics. ``prune`` drops pairs that cannot be duplicates before they are aligned."""
    x, y = F.col(a), F.col(b)
    n, m = F.size(x), F.size(y)
    longest = F.greatest(n, m)
    if prune:
        pairs = pairs.where((longest == 0) | (F.least(n, m) >= least_length_ratio(overlap_threshold) * longest))
    # Equal arrays need no alignment; the function is evaluated for all rows, so theirs are kept from it.
    own = lambda c: F.when(x != y, c).otherwise(F.slice(c, 1, 0))
    types = F.size(F.array_distinct(x))
    same = F.struct(n.alias("lcs"), F.lit(0).alias("ed"), types.alias("na"), types.alias("nb"), types.alias("both"))
    rows = pairs.withColumn("__m", F.when(x == y, same).otherwise(alignment(own(x), own(y))))
    one_empty = (F.least(n, m) == 0) & (longest > 0)
    overlap = F.when(longest == 0, 1.0).otherwise(F.try_divide(F.col("__m.lcs").cast("double"), longest))
    density = F.when(longest == 0, 0.0).when(one_empty, 1.0).otherwise(F.try_divide(F.col("__m.ed").cast("double"), longest))
    sizes = [F.col(f"__m.{c}") for c in ("na", "nb", "both")]
    rows = rows.select("*", overlap.alias("overlap_score"), jaccard_of(*sizes).alias("jaccard_score"), F.col("__m.ed").alias("edit_distance"), density.alias("edit_density"), F.col("__m.lcs").alias("lcs_length"), (sizes[0] + sizes[1] - 2 * sizes[2]).alias("token_diff_count"))
    rows = rows.withColumn("similarity_confidence", confidence(F.col("overlap_score"), F.col("jaccard_score"), F.col("edit_density")))
    return rows.withColumn("is_duplicate", is_duplicate(F.col("overlap_score"), F.col("edit_density"), F.col("similarity_confidence"), overlap_threshold, density_threshold)).drop("__m")


def best_matches(verified: DataFrame, src: str = "src", match: str = "match", limit: int = 5) -> DataFrame:
    """Duplicates of each source by falling confidence, at most ``limit`` if it is positive."""
    dups = verified.where(F.col("is_duplicate") & (F.col(src) != F.col(match)))
    if limit <= 0:
        return dups
    r = F.row_number().over(Window.partitionBy(src).orderBy(F.desc("similarity_confidence"), match))
    return dups.withColumn("r", r).where(F.col("r") <= limit).drop("r")


def statistics(verified: DataFrame) -> DataFrame:
    """Counts, rate and averages, over all pairs and over duplicates."""
    dup = F.col("is_duplicate")
    names = ("overlap_score", "jaccard_score", "edit_density", "similarity_confidence")
    every = [F.avg(c).alias(f"avg_{c}") for c in names]
    own = [F.avg(F.when(dup, F.col(c))).alias(f"duplicate_avg_{c}") for c in names]
    return verified.agg(F.count("*").alias("total_pairs"), F.count_if(dup).alias("duplicate_pairs"), F.avg(dup.cast("int")).alias("duplicate_rate"), *every, *own)
