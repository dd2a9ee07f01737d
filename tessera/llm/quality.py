"""Quality classifier: support vectors over naive Bayes features.

Indicators of n-grams (words alone and in pairs; shapes of tokens in pairs and threes, with a mark where a token repeats
the one before) are scaled by their class log-count ratios, and a linear hinge-loss model is fitted to them by dual
coordinate descent. A logistic curve, fitted on a part of the labelled rows kept out of the descent, turns decision
values into scores.

The fit reads a bounded sample of the labelled rows, ``SAMPLE`` of them, chosen by a hash of their id; scoring reads
every whole text. Labels are the only thing learned from; lang, source and ids are never features.

Cases: null and empty texts have no features and get the score of the intercept; several labels of one id count as their
mean, rounded up; null labels are left out; without both classes every score is the share of label 1 (0.5 without labels);
repeated rows get equal scores; an empty table gives an empty table; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BYTE_CODES, U64, mix, prefix_hashes, row_chunks, span_hashes, text_buffers, trim

#: Labelled rows that the fit reads at most.
SAMPLE = 8000
FEATURE_BITS = 18
THRESHOLD = 0.3

KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct feature numbers of each text."""
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.int64)] * n
    kind = KIND[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    change = edge | np.concatenate([[True], (kind[1:] != kind[:-1]) | ((kind[1:] == 3) & (data[1:] != data[:-1]))])
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] > 0
    glued = np.concatenate([[False], solid[:-1]]) & ~edge[starts]
    starts, ends, glued = starts[solid], ends[solid], glued[solid]
    word = span_hashes(prefix_hashes(BYTE_CODES[data]), starts, ends)
    at = np.searchsorted(starts, offsets)
    m = len(word)
    if not m:
        return [np.zeros(0, np.int64)] * n
    caps = np.concatenate([[0], np.cumsum(UPPER[data])])
    size, upper = ends - starts, caps[ends] - caps[starts]
    case = np.where(upper == 0, 0, np.where(upper == size, 2, np.where(UPPER[data[starts]], 1, 3)))
    back = np.concatenate([[0], word[:-1]])
    back2 = np.concatenate([[0, 0], word[:-2]])[:m]
    again = (word == back).astype(U64) + 2 * (word == back2).astype(U64)
    what = np.where(kind[starts] == 3, data[starts].astype(U64) + U64(16), kind[starts].astype(U64) * U64(4) + case.astype(U64))
    shape = mix(what + (np.minimum(size, 12) // 4).astype(U64) * U64(1 << 10) + glued.astype(U64) * U64(1 << 14) + again * U64(1 << 16))
    shift = lambda x, k: np.concatenate([x[k:], np.zeros(k, U64)])[:m]
    grams = [
        (0, word),
        (1, mix(word + shift(word, 1) * U64(0x9E3779B97F4A7C15))),
        (1, mix(shape + shift(shape, 1) * U64(0xC2B2AE3D27D4EB4F) + U64(11))),
        (2, mix(shape + shift(shape, 1) * U64(0xC2B2AE3D27D4EB4F) + shift(shape, 2) * U64(0x165667B19E3779F9) + U64(12))),
        (0, mix(shape + U64(13))),
    ]
    low = [(k, (g >> U64(64 - FEATURE_BITS)).astype(np.int64)) for k, g in grams]
    return [np.unique(np.concatenate([g[a : max(a, b - k)] for k, g in low])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    size = 1 << FEATURE_BITS
    p, q = np.full(size, alpha), np.full(size, alpha)
    for x, label in zip(rows, y):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the intercept) of a linear hinge-loss model by dual coordinate descent."""
    size = 1 << FEATURE_BITS
    w, dual = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + w[size]) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), c[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[x] += step * v
                w[size] += step
                dual[i] = new
    return w


def curve(decision: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) of the logistic curve, by Newton's method with a small ridge."""
    a, b, t = 1.0, 0.0, (y > 0) * 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * decision + b, -30, 30)))
        g = np.array([((p - t) * decision).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
        s = p * (1 - p)
        h = np.array([[(s * decision**2).sum() + 1e-3, (s * decision).sum()], [(s * decision).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


class Model:
    """Scaled weights by feature, their squares for the norm, the intercept and the curve."""

    def __init__(self, ratio: np.ndarray, w: np.ndarray, slope: float, shift: float):
        self.ratio, self.w, self.slope, self.shift = ratio.astype(np.float32), w.astype(np.float32), slope, shift

    def decision(self, x: np.ndarray) -> float:
        r = self.ratio[x].astype(np.float64)
        norm = float(np.sqrt((r * r).sum())) or 1.0
        return float((r * self.w[x]).sum()) / norm + float(self.w[-1])

    def score(self, x: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.decision(x) + self.shift, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 4.0) -> Model:
    """Four fifths fit ratios and weights, one fifth the curve."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        share = float((labels > 0).mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << FEATURE_BITS), np.zeros((1 << FEATURE_BITS) + 1), 1.0, float(np.log(share / (1 - share))))
    kept = np.arange(len(y)) % 5 == 0
    if abs(y[kept].sum()) == kept.sum() or abs(y[~kept].sum()) == (~kept).sum():
        kept[:] = False
    own = np.flatnonzero(~kept)
    ratio = log_count_ratios([rows[i] for i in own], y[own])
    scaled = []
    for x in rows:
        r = ratio[x]
        norm = float(np.sqrt(r @ r)) or 1.0
        scaled.append(r / norm)
    weight = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y < 0).sum()))
    w = descend([rows[i] for i in own], [scaled[i] for i in own], y[own], weight[own])
    model = Model(ratio, w, 1.0, 0.0)
    held = np.flatnonzero(kept) if kept.any() else own
    model.slope, model.shift = curve(np.array([model.decision(rows[i]) for i in held]), y[held])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """Fit on labelled rows that are not held out. ``docs``: doc_id, text; ``labels``: doc_id and ``label``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.ceil(F.avg(label)).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(0))
            for i, j in row_chunks(offsets):
                rows = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes() for x in rows], pa.binary()), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i)], ["x", "y", "doc_id"])

    def fitted(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("doc_id")
        m = fit([np.frombuffer(v, np.int32) for v in rows.column("x").to_pylist()], np.array(rows.column("y").to_pylist()))
        del rows, held
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([m.ratio.tobytes()]), pa.array([m.w.tobytes()]), pa.array([m.slope], pa.float64()), pa.array([m.shift], pa.float64())], ["ratio", "w", "slope", "shift"])

    # At most ``sample`` ids: a bounded broadcast. Of rows with one id one counts, chosen before any reaches the fit, which
    # is a task of its own: the driver gets the weights, not the rows.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y", "doc_id").mapInArrow(run, "x binary, y int, doc_id long")
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).select("doc_id", "x", "y")
    got = rows.repartition(1).mapInArrow(fitted, "ratio binary, w binary, slope double, shift double").collect()
    if not got:
        return fit([], np.zeros(0))
    r = got[0]
    return Model(np.frombuffer(bytes(r["ratio"]), np.float32), np.frombuffer(bytes(r["w"]), np.float32), r["slope"], r["shift"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (double) and predicted (int)."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(b.schema.get_field_index("text")).cast(pa.string()))
            for i, j in row_chunks(offsets):
                s = np.array([sent.value.score(x) for x in features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])])
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    rows = docs.select(*keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
