"""Exact top-k search with vector-approximation files.

Every vector is quantised to a grid of 256 cells a dimension (a byte each), whose marks come from the ranges of all
components. A scan over the cells alone bounds each score from below and above; a vector is a candidate only if its upper
bound reaches the k-th largest lower bound. Exact vectors are then read in the order of their bounds, until the k-th
result is certain: no upper bound left exceeds it.

The queries are a stated set; they meet the approximations in blocks of at most ``BLOCK`` queries, so a task holds a
block, not the query set. Equal vectors are one row with the ``k + 1`` smallest ids: ties go to smaller ids, so no more
can be in a result, and a vector that a third of the rows share costs what one costs.

Cases: vectors that are null, or hold null or non-finite components, take no part; vectors meet those of their own length,
and each length has its own file; scaled components or scores beyond 64 bits raise an error; queries with fewer than k
others get all; repeated ids count as separate rows, as candidates and as queries; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Workspace

SCALE, K, EVERY = 1024, 10, 100
CELLS, BLOCK = 256, 2048
OUT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for whole finite vectors; an error where that passes 64 bits."""
    x = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    fine = x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.lit("a scaled component passes 62 bits")).cast("long"))
    return fine.select("vec_id", F.transform("x", held).alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each vector once, with its k + 1 smallest ids."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Grid:
    """Marks of the cells: equal steps over each dimension's range."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.step = low, np.maximum(1, -(-(high - low + 1) // CELLS))

    def cells(self, v: np.ndarray) -> np.ndarray:
        return np.clip((v - self.low) // self.step, 0, CELLS - 1).astype(np.uint8)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest integers of the cells."""
        low = self.low + cells * self.step
        return low.astype(np.float64), (low + self.step - 1).astype(np.float64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """The k best of ``vectors`` (vec_id, v) for each of ``queries`` (vec_id, v) but itself: (query_id, rank, vec_id, score)."""
    out = vectors.sparkSession.createDataFrame([], OUT)
    # A row for each length of a query.
    for r in queries.where(F.size("v") > 0).groupBy(F.size("v").alias("w")).count().orderBy("w").collect():
        own = lambda df, w=r["w"]: df.where(F.size("v") == w)
        found = _search(own(vectors), own(queries), r["w"], k, block)
        out = out.union(found)
    return out


def _search(vectors: DataFrame, queries: DataFrame, width: int, k: int, block: int) -> DataFrame:
    spark, ws = vectors.sparkSession, Workspace(vectors.sparkSession)
    empty = spark.createDataFrame([], OUT)
    classes = distinct_vectors(vectors, k).withColumn("class", F.xxhash64("v", F.col("ids")[0]))
    classes = ws.save(classes, "exact")

    def extremes(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), width)
                yield pa.RecordBatch.from_arrays([pa.array([x.min(0).tolist()], pa.list_(pa.int64())), pa.array([x.max(0).tolist()], pa.list_(pa.int64()))], ["low", "high"])

    by_place = [F.min(F.col("low")[d]) for d in range(width)] + [F.max(F.col("high")[d]) for d in range(width)]
    marks = list(classes.select("v").mapInArrow(extremes, "low array<long>, high array<long>").agg(*by_place).first())
    if marks[0] is None:
        return empty
    marks = np.array(marks)
    grid = Grid(marks[:width], marks[width:])
    # The greatest corner of a cell may lie a whole step beyond the range.
    reach = max(max(abs(int(lo)), abs(int(lo) + CELLS * int(st))) for lo, st in zip(grid.low, grid.step))

    def approximate(batches):
        for b in batches:
            codes = grid.cells(_matrix(b.column(1), width))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x in codes], pa.binary())], ["class", "n_ids", "cells"])

    cells = ws.save(classes.select("class", "v", F.size("ids").alias("n_ids")).mapInArrow(approximate, "class long, n_ids int, cells binary"), "cells")
    asked = ws.save(queries.select("vec_id", "v"), "queries")
    n_blocks = max(1, -(-asked.count() // block))
    parts = []
    for i in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i)
        table = own.select("vec_id", "v").toArrow()
        if table.num_rows:
            parts.append(_block(classes, cells, grid, np.asarray(table.column("vec_id")), _matrix(table.column("v").combine_chunks(), width), k, width, ws, i, reach))
    if not parts:
        return empty
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _block(classes: DataFrame, cells: DataFrame, grid: Grid, ids: np.ndarray, v: np.ndarray, k: int, width: int, ws: Workspace, number: int, reach: int) -> DataFrame:
    """The results of one block of queries."""
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast((ids, v))
    most_of_all = width * reach * max(abs(int(v.min())), abs(int(v.max())))
    if most_of_all >= 1 << 62:
        raise OverflowError("scores may pass 64 bits")
    # Doubles hold integers up to 2^53; bounds of greater scores are widened by what rounding can cost.
    slack = 0.0 if most_of_all < 1 << 53 else float(4 * (width + 4) * (most_of_all >> 52) + 1)

    def scan(batches):
        """Candidates of this part of the file: those whose upper bound reaches the k-th lower bound found here."""
        _, q = sent.value
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                own = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, width)
                low, high = grid.bounds(own.astype(np.int64))
                least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
                least, most = least - slack, most + slack
                kth = _kth(least, k)
                qs, xs = np.nonzero(most >= kth[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(np.asarray(part.column(0))[xs]), pa.array(least[qs, xs].astype(np.int64)), pa.array(most[qs, xs].astype(np.int64)), pa.array(np.asarray(part.column(1))[xs])], ["query", "class", "least", "most", "n_ids"])

    found = ws.save(cells.mapInArrow(scan, "query long, class long, least long, most long, n_ids int"), f"bounds{number}")
    # Lower bounds of all parts together. One of the k + 1 best may be the query itself, so the (k + 1)-th counts.
    w = Window.partitionBy("query").orderBy(F.desc("least"), "class")
    ahead = found.withColumn("sum", F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kth = ahead.where(F.col("sum") >= k + 1).groupBy("query").agg(F.max("least").alias("kth"))
    left = found.join(kth, "query", "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth")))
    order = Window.partitionBy("query").orderBy(F.desc("most"), "class")
    left = ws.save(left.select("query", "class", "most", F.row_number().over(order).alias("place")), f"left{number}")

    def exact(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Read exact vectors in the order of their upper bounds until no bound left exceeds the k-th score."""
        ids, q = sent.value
        best, pdf = [], pdf.sort_values("most", ascending=False)
        me, own = int(ids[keys[0]]), q[keys[0]]
        for most, v, members in zip(pdf["most"], pdf["v"], pdf["ids"]):
            if len(best) >= k and most < best[k - 1][0]:
                break
            v = np.asarray(v)
            score = int(np.dot(own, v))
            mine = list(members)
            if me in mine and np.array_equal(v, own):
                mine.remove(me)
            best = sorted(best + [(score, int(m)) for m in mine], key=lambda x: (-x[0], x[1]))[:k]
        return pd.DataFrame({"query": [keys[0]] * len(best), "query_id": [me] * len(best), "vec_id": [m for _, m in best], "score": [s for s, _ in best]})

    def read(wanted: DataFrame) -> DataFrame:
        return wanted.select("query", "class", "most").join(classes, "class").select("query", "most", "v", "ids").groupBy("query").applyInPandas(exact, "query long, query_id long, vec_id long, score long")

    # The vectors of the highest bounds are read first; of the others only those whose bound reaches the k-th score then.
    first = ws.save(read(left.where(F.col("place") <= 2 * (k + 1))), f"first{number}")
    least = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).drop("n")
    rest = left.where(F.col("place") > 2 * (k + 1)).join(least, "query", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = first.union(read(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _kth(least: np.ndarray, k: int) -> np.ndarray:
    """For each query the (k + 1)-th largest lower bound, as one may be its own; minus infinity if there are fewer."""
    if least.shape[1] <= k:
        return np.full(len(least), -np.inf)
    return -np.partition(-least, k, axis=1)[:, k]


def brute_force(rows: list[tuple[int, list[int]]], queries: list[int], k: int = K) -> list[tuple[int, int, int, int]]:
    """The definition, for tests."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    out = []
    for i, x in rows:
        if i in queries:
            scores = v @ np.array(x)
            ranked = sorted(((-s, j) for s, j in zip(scores.tolist(), ids.tolist()) if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    return sorted(out)
