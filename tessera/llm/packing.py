"""Packing: concatenate all token ids and cut them into fixed windows.

Pass one encodes and totals the tokens of each partition; prefix sums over those totals (a row for each partition, never
one for each document) give the global offset of every document. Pass two cuts at multiples of the window by arithmetic
alone, so no data moves between partitions; a sequence that spans two partitions has a boundary record in each.
Only the very last sequence is not full.

Cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur; an empty table gives
no pieces; null document ids are carried; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, binary_array, row_chunks, text_buffers
from tessera.llm.textsplit import Encoder, tables_from_task

WINDOW = 2048
END_ID = 1
#: Partition totals are sent to all tasks up to so many partitions (16 bytes each).
BROADCAST_PARTS = 1_000_000
TABLE = "part int, doc_id long, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Text bytes of one vectorised step, large enough for most pieces of a step to repeat, and pieces that a worker remembers.
STEP_BYTES, PIECES_KEPT = 1 << 21, 400_000


@lru_cache(4)
def _encoder(path: str, tables: tuple) -> Encoder:
    return Encoder(path, PIECES_KEPT, tables)


def token_table(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, before, n, ids): the ids of each text and the end id, and the tokens before it in its partition.
    ``ids``: little-endian unsigned 32-bit integers."""

    tables = tables_from_task(docs.sparkSession, path)

    def run(batches):
        enc, part, before = _encoder(path, tables), TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in row_chunks(offsets, STEP_BYTES):
                ids, n = enc.encode(batch.column(1).slice(i, j - i).to_pylist())
                ends = np.cumsum(n + 1)
                flat = np.full(int(ends[-1]), end_id, np.uint32)
                own = np.ones(len(flat), bool)
                own[ends - 1] = False
                flat[own] = ids
                cells = binary_array(flat.view(np.uint8), np.concatenate([[0], ends]) * 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part, np.int32)), batch.column(0).slice(i, j - i), pa.array(before + ends - n - 1), pa.array(n + 1), cells], ["part", "doc_id", "before", "n", "ids"])
                before += int(ends[-1])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TABLE)


def placed(table: DataFrame) -> DataFrame:
    """``table`` with ``place``, the tokens before each document in the whole corpus."""
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    sums = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    if totals.count() <= BROADCAST_PARTS:
        sums = F.broadcast(sums)
    return table.join(sums, "part").select("doc_id", "n", (F.col("base") + F.col("before")).alias("place"), "ids")


def cut(table: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""

    def run(batches):
        for batch in batches:
            docs, sizes, places = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            flat, at = text_buffers(batch.column(3))
            first, last = places // window, (places + sizes - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(sizes)), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(seq * window - places[row], 0)
            end = np.minimum((seq + 1) * window - places[row], sizes[row])
            a, b = (at[row] + 4 * start).tolist(), (at[row] + 4 * end).tolist()
            view = memoryview(np.ascontiguousarray(flat))
            crc = np.array([zlib.crc32(view[x:y]) for x, y in zip(a, b)], np.int64)
            out = [docs.take(pa.array(row)), *map(pa.array, (start, end - start, crc, sizes[row], seq, places[row] + start - seq * window))]
            if with_ids:
                out.append(pa.array([bytes(view[x:y]) for x, y in zip(a, b)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids)

    return placed(table).select("doc_id", "n", "place", "ids").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of the packed ``docs`` (doc_id, text)."""
    return cut(Workspace(docs.sparkSession).save(token_table(docs, path), "tokens"), window)


def sequences(table: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, ids, n_tokens) from a saved token table: pieces of a sequence joined in order, boundary records included.
    A sequence has at most ``window`` tokens, so no group is large."""
    pieces = cut(table, window, with_ids=True).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.select("sequence_id", joined.alias("ids")).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))
