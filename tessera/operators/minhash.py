"""MinHash signatures, banding and candidate pairs.

A signature needs its own block only, so signatures are made where the block stands, without a shuffle. Blocks with equal signatures form a class
and meet other classes through its smallest id; ``member_candidates`` then gives every member the pairs it has itself.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import shingles

PRIME = (1 << 31) - 1


def coefficients(num_hashes: int = 128, seed: int = 42) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(num_hashes)]


def base_hash(shingle: Column) -> Column:
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 8), 16, 10).cast("long") % PRIME


#: Shingles that one vectorised step hashes.
STEP = 1 << 18


def signatures(blocks: DataFrame, key: str, toks: Column, num_hashes: int = 128, k: int = 5) -> DataFrame:
    """(key, signature): the least value of each hash function over the block's shingles. Shingles are made and hashed in
    the JVM; the minima are taken in Arrow batches, block by block, so nothing is shuffled."""
    hashes = F.transform(F.array(shingles(toks, k)), lambda s: F.transform(s, base_hash))[0]
    rows = blocks.select(key, hashes.alias("h"))
    fixed = np.array(coefficients(num_hashes), np.int64)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            ends = np.asarray(column.offsets).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
                h, starts = np.asarray(column.values[ends[at] : ends[to]]), ends[at:to] - ends[at]
                out = np.empty((to - at, num_hashes), np.int64)
                for i, (x, y) in enumerate(fixed):
                    out[:, i] = np.minimum.reduceat((x * h + y) % PRIME, starts)
                lists = pa.ListArray.from_arrays(np.arange(to - at + 1, dtype=np.int32) * num_hashes, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], [key, "signature"])
                at = to

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, signature array<bigint>")


def classes(sigs: DataFrame, key: str) -> DataFrame:
    """(signature, representative): blocks with equal signatures and the smallest of their keys."""
    return sigs.groupBy("signature").agg(F.min(key).alias(key))


def bands(sigs: DataFrame, key: str, num_hashes: int = 128, num_bands: int = 16) -> DataFrame:
    """(band, bucket, key)"""
    if num_hashes % num_bands:
        raise ValueError("num_hashes must be a multiple of num_bands")
    rows = num_hashes // num_bands
    exploded = sigs.select(key, "signature", F.explode(F.sequence(F.lit(0), F.lit(num_bands - 1))).alias("band"))
    return exploded.select("band", F.md5(F.array_join(F.slice("signature", F.col("band") * rows + 1, F.lit(rows)), ",").cast("binary")).alias("bucket"), key)


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.greatest(F.size(a), F.lit(1)).cast("double")


def scored(queries: DataFrame, index: DataFrame, key: str, ordered: bool = True, num_bands: int = 16, num_hashes: int = 128) -> DataFrame:
    """(src, match, similarity): all blocks that share a bucket."""
    left = bands(queries, key, num_hashes, num_bands).select("band", "bucket", F.col(key).alias("src"))
    right = bands(index, key, num_hashes, num_bands).select("band", "bucket", F.col(key).alias("match"))
    meet = left.join(right, ["band", "bucket"]).where("src > match" if ordered else "src <> match").select("src", "match").distinct()
    a = queries.select(F.col(key).alias("src"), F.col("signature").alias("x"))
    b = index.select(F.col(key).alias("match"), F.col("signature").alias("y"))
    return meet.join(a, "src").join(b, "match").select("src", "match", estimated_jaccard(F.col("x"), F.col("y")).alias("similarity"))


def most_alike(pairs: DataFrame, max_candidates: int = 50) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "match"))
    return pairs.withColumn("r", best).where(F.col("r") <= max_candidates).drop("r")


def candidates(queries: DataFrame, index: DataFrame, key: str, ordered: bool = True, max_candidates: int = 50, num_bands: int = 16, num_hashes: int = 128) -> DataFrame:
    """(src, match, similarity): blocks that share a bucket, the ``max_candidates`` most alike for each source.
    ``ordered``: only from later to earlier keys, as blocks meet an index that they join one after the other. The plain form:
    equal blocks meet in all pairs, which the two functions below avoid."""
    return most_alike(scored(queries, index, key, ordered, num_bands, num_hashes), max_candidates)


def _members(sigs: DataFrame, key: str):
    """(members (member, class, r): r numbers the members of a class by key, classes (key, signature): of the smallest keys)"""
    digest = F.md5(F.array_join("signature", ",").cast("binary"))
    named = sigs.select(key, digest.alias("digest"))
    least = named.groupBy("digest").agg(F.min(key).alias("class"))
    return named.join(least, "digest").select(F.col(key).alias("member"), "class"), classes(sigs, key)


def _first(members: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest members of each class."""
    place = F.row_number().over(Window.partitionBy("class").orderBy("member"))
    return members.withColumn("r", place).where(F.col("r") <= n).drop("r")


def index_candidates(queries: DataFrame, index: DataFrame, key: str, max_candidates: int = 50, num_bands: int = 16, num_hashes: int = 128) -> DataFrame:
    """The rows of ``candidates(queries, index, key, False)``, copies on either side included, without a join of all copies in
    a bucket: classes of equal signatures meet, then each source takes the smallest members of the classes that it met."""
    asked, asked_reps = _members(queries, key)
    held, held_reps = _members(index, key)
    meet = scored(asked_reps.withColumnRenamed(key, "k").withColumn(key, F.struct(F.lit(0).alias("side"), "k")), held_reps.withColumnRenamed(key, "k").withColumn(key, F.struct(F.lit(1).alias("side"), "k")), key, False, num_bands, num_hashes)
    meet = meet.select(F.col("src.k").alias("class"), F.col("match.k").alias("other"), "similarity")
    # One more than asked for: a source may meet itself in the index.
    near = meet.join(_first(held, max_candidates + 1).select(F.col("class").alias("other"), F.col("member").alias("match")), "other")
    pairs = asked.join(near.select("class", "match", "similarity"), "class").where("match <> member").select(F.col("member").alias("src"), "match", "similarity")
    return most_alike(pairs, max_candidates)


def member_candidates(sigs: DataFrame, key: str, max_candidates: int = 50, num_bands: int = 16, num_hashes: int = 128) -> DataFrame:
    """The rows of ``candidates(sigs, sigs, key)``, copies included, without a join of all copies in a bucket.

    Classes meet through their smallest keys. Members of a class are equally alike to any block and ties go to smaller keys,
    so no source needs more of a class than its ``max_candidates`` smallest keys; a member that has so many of its own class
    before it needs no other class.
    """
    members, reps = _members(sigs, key)
    first = _first(members, max_candidates)
    sizes = members.groupBy("class").agg(F.max("member").alias("last"))
    meet = scored(reps, reps, key, True, num_bands, num_hashes).select(F.col("src").alias("class"), F.col("match").alias("other"), "similarity")
    # A class also meets one of a larger smallest key if some of its members come after that.
    back = meet.select(F.col("other").alias("class"), F.col("class").alias("other"), "similarity").join(sizes.where("last > class"), "class").where("other < last").drop("last")
    near = meet.union(back).join(first.select(F.col("class").alias("other"), F.col("member").alias("match")), "other").select("class", "match", "similarity")
    own = members.join(first.select("class", F.col("member").alias("match")), "class").where("match < member").select(F.col("member").alias("src"), "match", F.lit(1.0).alias("similarity"))
    others = first.join(near, "class").where("match < member").select(F.col("member").alias("src"), "match", "similarity")
    return most_alike(own.union(others), max_candidates)


def index_statistics(sigs: DataFrame, key: str, num_bands: int = 16, num_hashes: int = 128, shingle_size: int = 5) -> DataFrame:
    """One row on the buckets of an index. A bucket is a row of the bands, so none is empty."""
    sizes = bands(sigs, key, num_hashes, num_bands).groupBy("band", "bucket").agg(F.count("*").alias("n"))
    found = sizes.agg(F.count("*").alias("total_buckets"), F.count_if(F.col("n") > 0).alias("non_empty_buckets"), F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("avg_bucket_size"), F.coalesce(F.max("n"), F.lit(0)).alias("max_bucket_size"))
    fixed = {"total_bands": F.lit(num_bands), "estimated_threshold": F.lit(round(estimated_threshold(num_bands, num_hashes), 3)), "signature_size": F.lit(num_hashes), "shingle_size": F.lit(shingle_size)}
    return found.crossJoin(sigs.agg(F.count("*").alias("total_blocks"))).withColumns(fixed)


def estimated_threshold(num_bands: int = 16, num_hashes: int = 128) -> float:
    """The similarity at which about half of the pairs meet: (1 / b) ** (1 / r)."""
    return (1 / num_bands) ** (num_bands / num_hashes)


def collision_probability(similarity: Column, num_bands: int = 16, rows: int = 8) -> Column:
    return 1 - F.pow(1 - F.pow(similarity, F.lit(rows)), F.lit(num_bands))


def add(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Add or update blocks, one or many: the new signature replaces one of the same key."""
    return index.join(new.select(key), key, "left_anti").unionByName(new.select(*index.columns))


update = bulk_add = add


def remove(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key), key, "left_anti")


def clear(index: DataFrame) -> DataFrame:
    return index.where("false")


def get(index: DataFrame, key: str, value) -> DataFrame:
    """The signature of one block; no row if it is not indexed."""
    return index.where(F.col(key) == value)
