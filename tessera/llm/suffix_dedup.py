"""Suffix-array dedup: remove every byte that lies in a long string which also starts earlier in the corpus.

Documents are dealt by ranges of their id into batches of bounded size, so batch order is document order. The index is
a logarithmic family of suffix arrays: the suffixes of a new batch are sorted, merge-scanned against all existing levels
for matches of ``length`` bytes, and levels of about equal size merge, so that n batches leave log n levels and a suffix
is moved log n times. Suffixes are ordered by a 64-bit fingerprint of their first ``length`` bytes, not alphabetically:
equal prefixes are neighbours in both orders, and nothing else is asked of the order. The suffix space is dealt into
buckets by fingerprint, and each bucket keeps its own family.

A sieve keeps the arrays small. Each window of ``length`` bytes selects the smallest of its ``gram``-byte hashes, its
anchor; equal windows select equal anchors. Only windows whose anchor occurs more than once can have a match, and a
whole run of windows of one anchor is settled at once if the same run occurs earlier. Nothing is sampled: every window
is settled, by its anchor, its run or its own suffix. A passage that a third of the corpus holds is one entry per batch
and key, not one per copy, so no bucket grows with a group of copies.

Cases: a null text is empty; texts under ``length`` bytes keep everything; equal texts: the smallest id keeps its bytes;
rows with one id are ordered by a hash of their text, and equal rows count as separate documents; a null id comes first;
an empty table gives an empty table; long texts are scanned in overlapping segments. Other columns are carried along,
those with a result's name are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BYTE_CODES, U64, Workspace, conf_partitions, mix, powers, prefix_hashes, ranges, row_chunks, span_hashes, spare, text_buffers

LENGTH, GRAM = 100, 40
POSITION_BITS = U64(22)
SEGMENT = (1 << 22) - 8
#: Bytes of keys in a bucket, which is what a task holds at once.
BUCKET_BYTES = 8 << 20
RESULT = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")]


class SuffixFamily:
    """Sorted arrays of suffix fingerprints whose sizes fall geometrically."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> np.ndarray:
        """Which suffixes of ``batch`` (distinct) match an existing level; the others join the index."""
        order = np.argsort(batch)
        array, found = batch[order], np.zeros(len(batch), bool)
        for level in self.levels:
            k = np.searchsorted(level, array)
            found |= level[np.minimum(k, len(level) - 1)] == array
        new = array[~found]
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = np.concatenate([self.levels.pop(), new])
            new.sort(kind="stable")
        if len(new):
            self.levels.append(new)
        out = np.empty(len(batch), bool)
        out[order] = found
        return out


class Scan:
    """Anchors and runs of the windows of one segment."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.length, n = length, len(data)
        sizes = np.diff(offsets)
        long = sizes >= length
        if not long.any():
            self.lo = self.hi = np.zeros(0, np.int64)
            self.key = self.run = np.zeros(0, U64)
            return
        self.prefix = prefix_hashes(BYTE_CODES[data])
        grams = mix((self.prefix[gram:] - self.prefix[:-gram]) * powers(n + 1, True)[: n - gram + 1])
        low = (grams >> POSITION_BITS << POSITION_BITS) | np.arange(len(grams), dtype=U64)
        width, span = length - gram + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        steps = np.zeros(n + 1, np.int8)
        steps[offsets[:-1][long]] += 1
        steps[(offsets[:-1] + sizes - length + 1)[long]] -= 1
        windows = np.flatnonzero(np.cumsum(steps[: len(low)], dtype=np.int8))
        anchor = (low[windows] & ((U64(1) << POSITION_BITS) - U64(1))).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]]) - 1
        self.lo, self.hi = windows[first], windows[last]
        self.key = grams[anchor[first]]
        self.run = span_hashes(self.prefix, self.lo, self.hi + length) + (anchor[first] - self.lo).astype(U64)

    def suffixes(self, runs: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows of these runs, in order."""
        at = ranges(self.lo[runs], self.hi[runs] - self.lo[runs] + 1)
        return mix((self.prefix[at + self.length] - self.prefix[at]) * powers(len(self.prefix), True)[at] + U64(self.length))


class Batch:
    """The scans of a batch; runs are numbered over all its segments."""

    def __init__(self, table: pa.Table, text: str, length: int, gram: int):
        self.data, self.offsets = text_buffers(table.column(text))
        self.scans, self.bases, self.length = [], [], length
        if len(self.data) <= SEGMENT:
            self.scans, self.bases = [Scan(self.data, self.offsets, length, gram)], [0]
        else:
            for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
                for i in range(a, max(a + 1, b - length + 1), SEGMENT - length + 1):
                    part = self.data[i : min(b, i + SEGMENT)]
                    self.scans.append(Scan(part, np.array([0, len(part)]), length, gram))
                    self.bases.append(i)
        self.key, self.run = (np.concatenate([getattr(s, k) for s in self.scans]) for k in ("key", "run"))
        self.lo, self.hi = (np.concatenate([getattr(s, k) + b for s, b in zip(self.scans, self.bases)]) for k in ("lo", "hi"))
        _, first = np.unique(self.key ^ mix(self.run), return_index=True)
        self.first = np.sort(first)
        """Runs that do not repeat an earlier run of the batch."""

    def suffixes(self, runs: np.ndarray) -> np.ndarray:
        at, out = 0, []
        for s in self.scans:
            own = runs[(runs >= at) & (runs < at + len(s.lo))] - at
            if len(own):
                out.append(s.suffixes(own))
            at += len(s.lo)
        return np.concatenate(out) if out else np.zeros(0, U64)


def _pack(columns: list[str], docs: DataFrame, limit: int) -> DataFrame:
    """(batch, n_bytes, payload): batches in document order; the payload is all columns, compressed."""

    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            nonlocal k, held, size
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "n_bytes", "payload"])
            k, held, size = k + 1, [], 0
            return out

        for batch in batches:
            _, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
            for i, j in row_chunks(offsets, limit):
                n = int(offsets[j] - offsets[i])
                if held and size + n > limit:
                    yield row()
                held.append(batch.slice(i, j - i))
                size += n
        if held:
            yield row()

    return docs.select(*columns).mapInArrow(run, "batch long, n_bytes long, payload binary")


def _unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _deal(keys: np.ndarray, buckets: int):
    """(bucket, members in order) for each bucket that has some."""
    own = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    there, first = np.unique(own[order], return_index=True)
    return list(zip(there.tolist(), np.split(order, first[1:])))


def _rows(found: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names)


KEYS = "bucket int, batch long, payload binary"
KEY_TYPES = (["bucket", "batch", "payload"], [pa.int32(), pa.int64(), pa.binary()])
UNIQUE, REPEATED, OPEN = 0, 1, 2


def _sieve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle the runs of a bucket: the anchor is unique, the run occurs earlier, or its windows stay open."""
    pdf = pdf.sort_values("batch")
    n = [len(p) // 16 for p in pdf["payload"]]
    key = np.concatenate([np.frombuffer(p, U64, k) for p, k in zip(pdf["payload"], n)])
    run = np.concatenate([np.frombuffer(p, U64, k, 8 * k) for p, k in zip(pdf["payload"], n)])
    order = np.lexsort((run, key))  # stable: earlier batches first
    k, r = key[order], run[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_run = new_key | np.concatenate([[True], r[1:] != r[:-1]])
    group = np.cumsum(new_key) - 1
    several = np.bincount(group, weights=new_run) > 1
    status = np.empty(len(k), np.uint8)
    status[order] = np.where(new_run, np.where(several[group], OPEN, UNIQUE), REPEATED)
    cuts = np.cumsum(n)[:-1]
    return pd.DataFrame({"bucket": pdf["bucket"].to_numpy(), "batch": pdf["batch"].to_numpy(), "payload": [x.tobytes() for x in np.split(status, cuts)]})


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    """Run the batches of a bucket through its family of suffix arrays, in document order."""
    family, pdf = SuffixFamily(), pdf.sort_values("batch")
    out = [np.packbits(family.add(np.frombuffer(p, U64))).tobytes() for p in pdf["payload"]]
    return pd.DataFrame({"bucket": pdf["bucket"].to_numpy(), "batch": pdf["batch"].to_numpy(), "payload": out})


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_bytes: int = 1 << 21, as_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and others) with n_bytes, n_removed, n_spans and kept, the bytes that remain; ``as_text``: as a
    string, in which a character of which a byte went is gone."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession)
    docs = docs.drop(*[c for c, _ in RESULT if c in docs.columns]).withColumn("text", F.col("text").cast("string"))
    columns, parts = docs.columns, conf_partitions(spark)
    tie = spare(columns, "tie")
    dealt = docs.withColumn(tie, F.xxhash64("text")).repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    batches = ws.save(_pack(columns, dealt, batch_bytes), "batches", large=True)
    del dealt
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-int(total * 2 / (length - gram + 2) * 16) // BUCKET_BYTES))

    def keys(rows):
        for batch in rows:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = Batch(_unpack(payload.as_buffer()), "text", length, gram)
                key, run = x.key[x.first], x.run[x.first]
                yield _rows([(k, b, key[m].tobytes() + run[m].tobytes()) for k, m in _deal(key, buckets)], *KEY_TYPES)

    spread = min(parts, buckets)
    sieved = batches.select("batch", "payload").mapInArrow(keys, KEYS).repartition(spread, "bucket").groupBy("bucket").applyInPandas(_sieve, KEYS)
    sieved = ws.save(sieved, "sieved", large=True)

    def replies(found: DataFrame) -> DataFrame:
        return found.groupBy("batch").agg(F.collect_list(F.struct("bucket", "payload")).alias("found"))

    def statuses(x: Batch, found) -> np.ndarray:
        out = np.full(len(x.key), REPEATED, np.uint8)
        got = {r["bucket"]: np.frombuffer(r["payload"], np.uint8) for r in found or []}
        for k, m in _deal(x.key[x.first], buckets):
            out[x.first[m]] = got[k]
        return out

    def opened(x: Batch, status: np.ndarray):
        """(open runs, fingerprints of their windows, first windows of each kind in the batch)"""
        runs = np.flatnonzero(status == OPEN)
        fps = x.suffixes(runs)
        return runs, fps, np.sort(np.unique(fps, return_index=True)[1])

    def windows(rows):
        for batch in rows:
            for b, payload, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                x = Batch(_unpack(payload.as_buffer()), "text", length, gram)
                _, fps, first = opened(x, statuses(x, found))
                yield _rows([(k, b, fps[first][m].tobytes()) for k, m in _deal(fps[first], buckets)], *KEY_TYPES)

    opening = batches.select("batch", "payload").join(replies(sieved), "batch", "left").mapInArrow(windows, KEYS)
    indexed = ws.save(opening.repartition(spread, "bucket").groupBy("bucket").applyInPandas(_index, KEYS), "indexed", large=True)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType() if t == "long" else T.StringType() if as_text else T.BinaryType()) for c, t in RESULT)])

    def apply(rows):
        for batch in rows:
            for payload, found, hits in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                table = _unpack(payload.as_buffer())
                x = Batch(table, "text", length, gram)
                status = statuses(x, found)
                runs, fps, first = opened(x, status)
                hit = np.ones(len(fps), bool)
                got = {r["bucket"]: np.frombuffer(r["payload"], np.uint8) for r in hits or []}
                for k, m in _deal(fps[first], buckets):
                    hit[first[m]] = np.unpackbits(got[k], count=len(m)).astype(bool)
                whole = status == REPEATED
                starts = np.concatenate([x.lo[whole], ranges(x.lo[runs], x.hi[runs] - x.lo[runs] + 1)[hit]])
                ends = np.concatenate([x.hi[whole], ranges(x.lo[runs], x.hi[runs] - x.lo[runs] + 1)[hit]]) + length
                steps = np.bincount(starts, minlength=len(x.data) + 1) - np.bincount(ends, minlength=len(x.data) + 1)
                gone = np.cumsum(steps[:-1]) > 0
                yield _result(table, x, gone)

    names = [*columns, *(c for c, _ in RESULT)]

    def _result(table: pa.Table, x: Batch, gone: np.ndarray) -> pa.RecordBatch:
        at = x.offsets
        sums = np.concatenate([[0], np.cumsum(gone)])
        begins = gone & ~np.concatenate([[False], gone[:-1]])
        begins[at[:-1][at[:-1] < len(gone)]] |= gone[at[:-1][at[:-1] < len(gone)]]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept, keep_at = x.data[~gone], at - sums[at]
        cells = [kept[a:b].tobytes() for a, b in zip(keep_at[:-1].tolist(), keep_at[1:].tolist())]
        cells = pa.array([c.decode("utf-8", "ignore") for c in cells], pa.string()) if as_text else pa.array(cells, pa.binary())
        extra = [pa.array(np.diff(at)), pa.array(np.diff(sums[at])), pa.array(np.diff(spans[at])), cells]
        flat = table.combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*flat.columns, *extra], names)

    joined = batches.select("batch", "payload").join(replies(sieved).withColumnRenamed("found", "sieved"), "batch", "left").join(replies(indexed), "batch", "left")
    return joined.select("payload", "sieved", "found").mapInArrow(apply, schema)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def kept_text(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the text that remains; n_chars, if there is one, follows."""
    out = remove_repeats(docs, as_text=True, **options).withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def brute_force(texts: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The definition, for tests: {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    seen, out = set(), {}
    for doc, raw in sorted(texts):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out
