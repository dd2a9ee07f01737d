"""N-gram Jaccard join by vertical partitioning.

All n-grams of the corpus have one global order: by the number of sets that hold them, counted exactly, then by hash. The
order is cut into fragments; a pair's overlap is counted in each fragment separately, and the sum over the fragments
decides. Texts are read twice and never shuffled; what moves are hashes of n-grams.

1. A sieve: each block of sets sends every n-gram that it holds, once, to the n-gram's range; the range counts it and sends
   back the shared ones. An overlap holds shared n-grams only, so a set whose shared ones fall short of the threshold links
   with nothing and goes. A passage that a third of the corpus holds is one entry a block there, not one a document.
2. Two sets that link share one of the first ``n - ceil(t n) + 1`` n-grams of each in the global order: the postings. Every
   set meets the hub of its posting lists with which it shares most; components of those links are contracted.
3. Every pair of sets that still lies in two components is then settled. Components meet where their members share a posting
   and no bound on sizes, places and open postings excludes a link; members of those that meet are compared block by block.

So no link between different components is lost, a group of thousands of near copies never becomes its pairs, and what a
task holds is bounded by blocks, not by groups. Equal sets are one class throughout.

Cases: null or empty texts and texts without words have no n-grams and link with nothing, each is its own component;
texts of fewer words than an n-gram have one, the whole sequence; repeated rows are linked like any equal texts; null ids
are carried and never name a component unless alone; an empty table gives an empty table; other columns are ignored.
``docs`` must give the rows of a partition in the same order when a lost task is repeated, as tables do.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_CODES, U64, Workspace, conf_partitions, mix, prefix_hashes, ranges, row_chunks, span_hashes, text_buffers, trim

WORDS, PERCENT = 5, 80
FRAGMENTS = 8
#: N-grams that a task holds of a block of the sieve, of a range, and of one side of a comparison.
BLOCK_GRAMS, RANGE_GRAMS, SIDE_GRAMS = 1 << 19, 1 << 20, 1 << 17
BLOCK_SETS = 60_000
#: Pairs of equal n-grams that one vectorised step expands.
STEP_PAIRS = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
FACTORS = mix(np.arange(101, 165, dtype=U64)) | U64(1)


# Sets of n-grams -------------------------------------------------------------------------------------------------------
def gram_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """The distinct n-gram hashes of each text, sorted."""
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, U64)] * n
    data = LOWER[data]
    solid = ~SPACES[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (edge | ~before))
    after = np.concatenate([solid[1:], [False]])
    last = np.concatenate([edge[1:], [True]])
    ends = np.flatnonzero(solid & (last | ~after)) + 1
    hashes = span_hashes(prefix_hashes(BYTE_CODES[data]), starts, ends)
    at = np.searchsorted(starts, offsets)
    m = len(hashes)
    grams = np.zeros(max(0, m - words + 1), U64)
    for j in range(words):
        grams += hashes[j : j + len(grams)] * FACTORS[j]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            short = sum(int(h) * int(f) for h, f in zip(hashes[a:b], FACTORS)) + (b - a) * 0x51ED270B
            out.append(mix(np.array([short & (2**64 - 1)], U64)))
        else:
            out.append(hashes[:0])
    return out


def set_id(grams: np.ndarray) -> int:
    """A hash of the set, as a signed 64-bit integer."""
    return int(mix(np.array([mix(grams).sum(dtype=U64) ^ U64(len(grams))], U64)).view(np.int64)[0])


def _sets(batches, words):
    """(record batch, first row, sets) in bounded steps."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in row_chunks(offsets):
            yield batch, i, gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, c) of each document: the size of its set and the set's hash."""

    def run(batches):
        for batch, i, sets in _sets(batches, words):
            columns = [batch.column(0).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "c"])

    return docs.mapInArrow(run, "doc_id long, n long, c long")


def needed(n, percent: int):
    """The least overlap with which a set of ``n`` can link."""
    return -(-n * percent // 100)


# Arrays as bytes -------------------------------------------------------------------------------------------------------
def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: planes of bytes, since the high bytes of steps and small numbers repeat."""
    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        body = pa.compress(planes, "zstd", asbytes=True) if planes else b""
        out.append(struct.pack("<2sqq", a.dtype.str[1:].encode(), len(a), len(body)) + body)
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    (k,), at, out = struct.unpack_from("<i", raw), 4, []
    for _ in range(k):
        kind, n, size = struct.unpack_from("<2sqq", raw, at)
        dtype = np.dtype(kind.decode())
        at += 18
        planes = pa.decompress(raw[at : at + size], n * dtype.itemsize, "zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += size
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; ``np.cumsum`` undoes it."""
    out = a.copy()
    out[1:] -= a[:-1]
    return out


def grouped(keys: np.ndarray):
    """(first place of each run of equal keys, length of each run)"""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


# The sieve -------------------------------------------------------------------------------------------------------------
KEYS = "range int, block long, kind int, payload binary"
LONE, SETS, REPEATED = 0, 1, 2


def range_of(grams: np.ndarray, n: int) -> np.ndarray:
    """The range of each n-gram hash: ``n`` equal parts of the hashes, in order."""
    return ((grams >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _sent(docs: DataFrame, words: int, n_ranges: int) -> DataFrame:
    """What blocks send. To each range: n-grams that one set of the block holds, with its number, and those that several
    hold, with how many. About itself: its sets, and which of them hold the n-grams of the second kind."""

    def block_rows(block: int, held: list):
        lengths = np.array([len(s) for s, _ in held])
        grams, own = np.concatenate([s for s, _ in held]), np.repeat(np.arange(len(held), dtype=np.uint16), lengths)
        order = np.argsort(grams, kind="stable")
        grams, own = grams[order], own[order]
        first, count = grouped(grams)
        lone, many = first[count == 1], first[count > 1]
        a, mine, b, times = grams[lone], own[lone], grams[many], count[count > 1].astype(np.uint32)
        rows, ra, rb = [], range_of(a, n_ranges), range_of(b, n_ranges)
        for r in np.union1d(ra, rb).tolist():
            (i, j), (k, m) = np.searchsorted(ra, [r, r + 1]), np.searchsorted(rb, [r, r + 1])
            rows.append((r, LONE, packed(steps(a[i:j]), mine[i:j], steps(b[k:m]), times[k:m])))
        home = block % n_ranges
        rows.append((home, SETS, packed(np.array([c for _, c in held], np.int64), lengths.astype(np.int64))))
        rows.append((home, REPEATED, packed(steps(b), times, own[ranges(many, times.astype(np.int64))])))
        return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([k for _, k, _ in rows], pa.int32()), pa.array([p for _, _, p in rows], pa.binary())], ["range", "block", "kind", "payload"])

    def emit(batches):
        block, held, size, seen = TaskContext.get().partitionId() << 32, [], 0, set()
        for _, _, sets in _sets(batches, words):
            for s in sets:
                if len(s) and (c := set_id(s)) not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(c)
                    held.append((s, c))
                    size += len(s)
            if size > BLOCK_GRAMS or len(held) > BLOCK_SETS // 2:
                for i in range(0, len(held), BLOCK_SETS):
                    yield block_rows(block, held[i : i + BLOCK_SETS])
                    block += 1
                held, size = [], 0
        for i in range(0, len(held), BLOCK_SETS):
            yield block_rows(block, held[i : i + BLOCK_SETS])
            block += 1

    return docs.mapInArrow(emit, KEYS)


def code_of(count: np.ndarray) -> np.ndarray:
    """A byte that grows with the number of sets: the first key of the global order."""
    return np.minimum(255, np.round(8 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A range counts its n-grams and answers each block with those that are shared."""
    own = pdf["kind"].to_numpy() == LONE
    rows = [unpacked(p) for p in pdf["payload"][own]]
    parts = [np.cumsum(x, dtype=U64) for r in rows for x in (r[0], r[2])]
    grams = np.concatenate(parts) if parts else np.zeros(0, U64)
    order = np.argsort(grams, kind="stable")
    first, count = grouped(grams[order])
    del grams
    total = np.empty(len(order), np.uint32)
    if len(first):
        times = np.concatenate([np.ones(len(r[0]), np.uint32) if k == 0 else r[3] for r in rows for k in (0, 1)])
        total[order] = np.repeat(np.add.reduceat(times[order], first), count)
    del order, first, count
    at, out = 0, []
    for r, a, b in zip(rows, parts[::2], parts[1::2]):
        ta, tb = total[at : at + len(a)], total[at + len(a) : at + len(a) + len(b)]
        at += len(a) + len(b)
        keep = ta > 1
        out.append(packed(steps(a[keep]), r[1][keep], code_of(ta[keep]), code_of(tb)))
    payload = pdf["payload"].to_numpy().copy()
    payload[own] = np.array([*out, None], object)[:-1]
    del rows, parts, total
    trim()
    return pdf.assign(payload=payload)


def _sieve(docs: DataFrame, words: int, percent: int, total: int) -> DataFrame:
    """(c, n, kept, payload): the sets that can link, a row each, with their shared n-grams in the global order."""
    spark = docs.sparkSession
    n_ranges = max(conf_partitions(spark), -(-total // RANGE_GRAMS))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        """The sets of a block that hold enough shared n-grams."""
        pdf = pdf.sort_values("range")
        kind = pdf["kind"].to_numpy()
        if (kind == SETS).sum() != 1:
            raise RuntimeError("rows of a partition changed their order between two runs of a task")
        c, n = unpacked(pdf["payload"][kind == SETS].iloc[0])
        b, times, owners = unpacked(pdf["payload"][kind == REPEATED].iloc[0])
        answers = [unpacked(p) for p in pdf["payload"][kind == LONE]]
        times = times.astype(np.int64)
        grams = np.concatenate([*(np.cumsum(x[0], dtype=U64) for x in answers), np.repeat(np.cumsum(b, dtype=U64), times)])
        own = np.concatenate([*(x[1] for x in answers), owners]).astype(np.int64)
        code = np.concatenate([*(x[2] for x in answers), np.repeat(np.concatenate([x[3] for x in answers]), times)])
        kept = np.bincount(own, minlength=len(c))
        alive = kept >= needed(n, percent)
        mask = alive[own]
        grams, own, code = grams[mask], own[mask], code[mask]
        order = np.lexsort((grams, code, own))
        grams, code = grams[order], code[order]
        del answers, own, order, mask
        ends = np.cumsum(kept * alive)
        cells = [packed(grams[e - k : e], code[e - k : e]) for e, k in zip(ends[alive].tolist(), kept[alive].tolist())]
        del grams, code
        trim()
        return pd.DataFrame({"c": c[alive], "n": n[alive], "kept": kept[alive], "payload": cells})

    counted = _sent(docs, words, n_ranges).repartition(n_ranges, "range").groupBy("range").applyInPandas(_counted, KEYS)
    blocks = counted.groupBy("block").applyInPandas(merged, "c long, n long, kept long, payload binary")
    return blocks.groupBy("c").agg(F.first("n").alias("n"), F.first("kept").alias("kept"), F.first("payload").alias("payload"))


def _cuts(sets: DataFrame) -> list[tuple[int, int]]:
    """The first (code, n-gram) of each fragment but the first: equal shares, from a count of each of the 256 codes."""

    def histogram(batches):
        out = np.zeros(256, np.int64)
        for b in batches:
            for p in b.column(0):
                out += np.bincount(unpacked(p.as_py())[1], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(out)], ["code", "n"])

    found = sets.select("payload").mapInArrow(histogram, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    mass = np.zeros(256)
    for r in found:
        mass[r["code"]] = r["n"]
    ends, out = np.cumsum(mass), []
    for k in range(1, FRAGMENTS):
        target = ends[-1] * k / FRAGMENTS
        code = min(255, int(np.searchsorted(ends, target, "right")))
        share = (target - (ends[code] - mass[code])) / mass[code] if mass[code] else 0.0
        out.append((code, min(2**64 - 1, int(share * 2.0**64))))
    return out


def fragment_of(grams: np.ndarray, code: np.ndarray, cuts) -> np.ndarray:
    out = np.zeros(len(grams), np.int32)
    for c, g in cuts:
        out += (code > c) | ((code == c) & (grams >= U64(g)))
    return out


# Postings --------------------------------------------------------------------------------------------------------------
def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(g, c, n, pos, w): a set's first n-grams in the global order, its unshared ones left out, and their places. ``w``
    is the share of them that is shared: a set with few words of its own makes a good hub."""

    def run(batches):
        for b in batches:
            cs, ns, kept = (np.asarray(b.column(k)) for k in range(3))
            first = (ns - kept).astype(np.int64)
            prefix = ns - needed(ns, percent) + 1
            take = np.maximum(prefix - first, 0)
            grams = [unpacked(p.as_py())[0][:k] for p, k in zip(b.column(3), take.tolist())]
            w = 1000 * take // prefix
            columns = [np.concatenate(grams).view(np.int64) if grams else np.zeros(0, np.int64), np.repeat(cs, take), np.repeat(ns, take), ranges(first, take), np.repeat(w, take)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["g", "c", "n", "pos", "w"])

    return sets.select("c", "n", "kept", "payload").mapInArrow(run, "g long, c long, n long, pos long, w long")


def behind(n: str, percent: int):
    """What of a set of ``n`` lies behind its postings."""
    return F.ceil(F.col(n) * percent / 100.0) - 1


def best_hub(postings: DataFrame, percent: int) -> DataFrame:
    """(a, n, b): for each set the hub with which it shares most. What this misses, the last round finds."""
    met = postings.where(F.col("hub") != F.col("c")).where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    counted = met.groupBy("c", "n", "hub").agg(F.count("*").alias("k"))
    best = counted.groupBy("c", "n").agg(F.max(F.struct("k", "hub")).alias("x"))
    return best.where(F.col("x.k") * 800 >= F.col("n") * (100 - percent)).select(F.col("c").alias("a"), "n", F.col("x.hub").alias("b"))


def bounded(postings: DataFrame) -> DataFrame:
    """Adds ``open``, the set's postings, and ``most``, the most n-grams that it can have in common with a set that shares
    this one: all that come earlier and are in common are postings too, so those that are none count as missed."""
    own = Window.partitionBy("c")
    earlier = F.row_number().over(own.orderBy("pos")) - 1
    return postings.withColumn("most", F.col("n") - F.col("pos") + earlier).withColumn("open", F.count("*").over(own))


def met_sides(open_: DataFrame) -> DataFrame:
    """(g, comp, m, o, l, h): of a component's members with a posting, the greatest bounds and the sizes."""
    return bounded(open_).groupBy("g", "comp").agg(F.max("most").alias("m"), F.max("open").alias("o"), F.min("n").alias("l"), F.max("n").alias("h"))


def meeting(sides: DataFrame, percent: int) -> DataFrame:
    """(x, y): components that may hold a link between them. Of the members that share a posting the greatest bounds count,
    so what no pair of components reaches, no pair of their members does. A link's overlap lies in the postings of both
    sets, or behind those of the one whose end first."""
    a, b = (sides.select("g", *(F.col(x).alias(x + k) for x in ("comp", "m", "o", "l", "h"))) for k in "ab")
    rest = F.greatest(behind("ha", percent), behind("hb", percent))
    least = percent * (F.col("la") + F.col("lb"))
    fits = (100 * F.col("ha") >= percent * F.col("lb")) & (100 * F.col("hb") >= percent * F.col("la"))
    reach = F.least("ma", "mb", F.least("oa", "ob") + rest) * (100 + percent) >= least
    met = a.join(b, "g").where((F.col("compa") < F.col("compb")) & fits & reach)
    counted = met.groupBy(F.col("compa").alias("x"), F.col("compb").alias("y")).agg(F.count("*").alias("k"), F.min("la").alias("la"), F.min("lb").alias("lb"), F.max("ha").alias("ha"), F.max("hb").alias("hb"))
    return counted.where((F.col("k") + rest) * (100 + percent) >= least).select("x", "y")


# Counting by fragment --------------------------------------------------------------------------------------------------
def overlaps(job: np.ndarray, side: np.ndarray, sizes: np.ndarray, grams: np.ndarray):
    """(left row, right row, n-grams in common) of all pairs of rows of one job and different sides."""
    row = np.repeat(np.arange(len(job)), sizes)
    key = mix(grams ^ mix(job.view(U64))[row])
    left, right = np.flatnonzero(side[row] == 0), np.flatnonzero(side[row] == 1)
    right = right[np.argsort(key[right], kind="stable")]
    keys = key[right]
    lo, hi = np.searchsorted(keys, key[left], "left"), np.searchsorted(keys, key[left], "right")
    hit = hi > lo
    left, lo, count = left[hit], lo[hit], (hi - lo)[hit]
    ends, pairs, sums, i = np.cumsum(count), [], [], 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP_PAIRS, "right")))
        both = np.repeat(row[left[i:j]], count[i:j]) * len(job) + row[right[ranges(lo[i:j], count[i:j])]]
        found, times = np.unique(both, return_counts=True)
        pairs.append(found)
        sums.append(times)
        i = j
    if not pairs:
        return (np.zeros(0, np.int64),) * 3
    both, times = np.concatenate(pairs), np.concatenate(sums)
    order = np.argsort(both, kind="stable")
    first, _ = grouped(both[order])
    return both[order][first] // len(job), both[order][first] % len(job), np.add.reduceat(times[order], first)


def verified(ws: Workspace, seats: DataFrame, sets: DataFrame, cuts, percent: int, name: str) -> DataFrame:
    """(a, b): for each right set b of a job (job, side, c, n) a left set a with which it links, if there is one. Each
    fragment counts what pairs have in common there; the sums over the fragments decide."""
    seats = ws.save(seats, f"{name}_seats")
    total = seats.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(conf_partitions(seats.sparkSession), -(-total // RANGE_GRAMS))

    def cut(batches):
        for b in batches:
            out = []
            for bucket, job, side, c, n, raw in zip(*(b.column(k).to_pylist() for k in range(6))):
                grams, code = unpacked(raw)
                own = fragment_of(grams, code, cuts)
                for f in np.unique(own).tolist():
                    out.append((bucket, f, job, side, c, n, grams[own == f].tobytes()))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["bucket", "fragment", "job", "side", "c", "n", "grams"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = np.frombuffer(b"".join(pdf["grams"]), U64)
        job, c, n = (pdf[x].to_numpy(np.int64) for x in ("job", "c", "n"))
        a, b, k = overlaps(job, pdf["side"].to_numpy(), pdf["grams"].map(len).to_numpy(np.int64) // 8, grams)
        return pd.DataFrame({"bucket": pdf["bucket"][:1], "payload": [packed(job[a], c[a], c[b], n[a] + n[b], k.astype(np.int64))]})

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        job, a, b, n, k = (np.concatenate(x) for x in zip(*(unpacked(p) for p in pdf["payload"])))
        order = np.lexsort((a, b, job))
        job, a, b, n, k = job[order], a[order], b[order], n[order], k[order]
        if not len(job):
            return pd.DataFrame({"a": a, "b": b})
        first = np.flatnonzero(np.concatenate([[True], (job[1:] != job[:-1]) | (b[1:] != b[:-1]) | (a[1:] != a[:-1])]))
        both = np.add.reduceat(k, first)
        linked = first[100 * both >= percent * (n[first] - both)]
        job, a, b = job[linked], a[linked], b[linked]
        new = np.concatenate([[True], (job[1:] != job[:-1]) | (b[1:] != b[:-1])])[: len(b)]
        return pd.DataFrame({"a": a[new], "b": b[new]})

    placed = seats.withColumn("bucket", F.pmod("job", F.lit(n_buckets)).cast("int")).drop("n").join(sets.select("c", "n", "payload"), "c")
    parts = placed.select("bucket", "job", "side", "c", "n", "payload").mapInArrow(cut, "bucket int, fragment int, job long, side int, c long, n long, grams binary")
    partial = parts.groupBy("bucket", "fragment").applyInPandas(count, "bucket int, payload binary")
    return ws.save(partial.groupBy("bucket").applyInPandas(decide, "a long, b long"), f"{name}_links", large=True)


def blocks(n_grams):
    """The number of blocks of a side with that many n-grams."""
    return F.greatest(F.lit(1), F.ceil(n_grams / float(SIDE_GRAMS))).cast("int")


def hub_seats(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Jobs of one hub and a block of the sets that meet it."""
    sizes = pairs.groupBy("b").agg(blocks(F.sum("n")).alias("k"))
    right = pairs.join(sizes, "b").select(F.xxhash64("b", F.pmod(F.xxhash64("a"), "k")).alias("job"), F.lit(1).alias("side"), F.col("a").alias("c"), "n")
    left = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("k") - 1).cast("array<long>")).alias("i"), "k").join(classes, F.col("b") == F.col("c"))
    return right.union(left.select(F.xxhash64("b", F.pmod("i", "k")).alias("job"), F.lit(0).alias("side"), "c", "n"))


def component_seats(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Jobs of a block of a component's members and a block of the members of all components that it meets. Of two that
    meet, the one of more members is on the left, so its members are sent once, not once for each other component."""
    size = members.groupBy("comp").agg(F.count("*").alias("s"), blocks(F.sum("n")).alias("k"))
    a, b = (size.select(F.col("comp").alias(x), F.struct("s", F.col("comp").alias("i")).alias(f"s{x}")) for x in "xy")
    met = pairs.join(a, "x").join(b, "y").select(F.greatest("sx", "sy")["i"].alias("x"), F.least("sx", "sy")["i"].alias("y"))
    other = met.join(members.select(F.col("comp").alias("y"), "c", "n"), "y").select("x", "c", "n")
    width = other.groupBy("x").agg(blocks(F.sum("n")).alias("kr")).join(size.select(F.col("comp").alias("x"), "k"), "x")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1).cast("array<long>"))
    own = lambda k: F.pmod(F.xxhash64("c"), k).cast("long")
    left = members.select(F.col("comp").alias("x"), "c", "n").join(width, "x").select("x", own("k").alias("i"), every("kr").alias("j"), F.lit(0).alias("side"), "c", "n")
    right = other.join(width, "x").select("x", every("k").alias("i"), own("kr").alias("j"), F.lit(1).alias("side"), "c", "n")
    return left.union(right).select(F.xxhash64("x", "i", "j").alias("job"), "side", "c", "n")


# Components ------------------------------------------------------------------------------------------------------------
def settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars around their smallest nodes: then both stars leave them as they are."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("x"), F.lit(0).alias("leaf")))).alias("e")).select("e.x", "e.leaf")
    return not ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.count("*").alias("n")).where("leaf > 0 and n > 1").agg(F.count("*")).first()[0]


def connected(ws: Workspace, edges: DataFrame, name: str = "stars", rounds: int = 60) -> DataFrame:
    """(c, comp) for the nodes of ``edges`` (a, b); comp is the smallest node. Alternating large and small stars."""
    edges = ws.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}_")
    for k in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Every node now sees smaller nodes only; the small star needs no more than its edges once each.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        edges = ws.save(small.where("u <> v").distinct(), f"{name}{k}")
        ws.drop(f"{name}{k - 1}" if k else f"{name}_")
        if settled(edges):
            return edges.select(F.col("u").alias("c"), F.col("v").alias("comp"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _linked(ws: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """(c, comp) of the sets that link with others."""
    cuts = _cuts(sets)
    classes = sets.select("c", "n")
    every = ws.save(_postings(sets, percent), "prefixes")
    lists = every.groupBy("g").agg(F.count("*").alias("m"), F.max(F.struct("w", "c", "n")).alias("hub")).where("m > 1")
    postings = ws.save(every.join(lists, "g").select("g", "c", "n", "pos", F.col("hub.c").alias("hub"), F.col("hub.n").alias("hub_n")), "postings")
    ws.drop("prefixes")
    pairs = ws.save(best_hub(postings, percent), "hubs")
    first = connected(ws, verified(ws, hub_seats(pairs, classes), sets, cuts, percent, "hub"), "stars")

    labelled = postings.select("g", "c", "n", "pos").join(first, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    mixed = labelled.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("g")
    open_ = ws.save(labelled.join(mixed, "g", "left_semi"), "open")
    ws.drop("postings")
    members = open_.select("comp", "c", "n").distinct()
    sides = ws.save(met_sides(open_), "sides")
    met = ws.save(meeting(sides, percent), "meeting")
    ws.drop("sides")
    links = verified(ws, component_seats(met, members), sets, cuts, percent, "last")
    named = lambda x: first.select(F.col("c").alias(x), F.col("comp").alias(f"c{x}"))
    joined = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = connected(ws, joined, "last_stars")
    over = second.select(F.col("c").alias("comp"), F.col("comp").alias("top"))
    whole = first.join(over, "comp", "left").select("c", F.coalesce("top", "comp").alias("comp"))
    return whole.union(second.join(first.select("c"), "c", "left_anti"))


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    ws = Workspace(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    nodes = ws.save(_nodes(docs, words), "nodes")
    filled, empty = nodes.where("n > 0"), nodes.where("n = 0")
    total = filled.agg(F.sum("n")).first()[0] or 0
    alone = empty.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if not total:
        return alone
    sets = ws.save(_sieve(docs, words, percent, total), "sets", large=True)
    linked = _linked(ws, sets, percent)
    classes = filled.groupBy("c").agg(F.min("doc_id").alias("doc_id")).join(linked, "c", "left").select("c", "doc_id", F.coalesce("comp", "c").alias("comp"))
    smallest = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(smallest, "comp").select("c", "component_id")
    return filled.join(named, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def brute_force(texts: list[tuple[int, str | None]], words: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """The definition, for tests: {doc_id: (n_shingles, component_id)}."""
    import re

    sets = {}
    for doc, text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}
