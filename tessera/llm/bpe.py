"""BPE encoding and decoding over a distinct-word table.

Texts are split into the pieces on which merges work, the distinct pieces of the corpus form a table, each of them is
encoded once, and the ids go back to the pieces' positions. The table grows with the corpus, as vocabularies do, so
only its most widespread pieces, ``BROADCAST_BYTES`` of them by measured size, are sent to all tasks. A rarer piece is
encoded once where it stands (``beyond="local"``), or its ids come back by a join on the piece, a row for each document
and distinct piece (``beyond="join"``, which moves and stores much more). Decoding looks ids up in the vocabulary, whose
size is fixed.

Cases: a null or empty text has no ids and decodes to an empty text; special tokens that stand in a text get their own
id, as the tokenizers library does; repeated rows give repeated results; an empty table gives an empty table; other
columns of the input are carried along unless their names are those of the results, which replace them.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Workspace, binary_array, conf_partitions, ranges, row_chunks, spare, text_buffers
from tessera.llm.textsplit import ALPHABET, Encoder, character_tables, join_back

BROADCAST_BYTES = 32 << 20
#: Text bytes of one vectorised step.
STEP_BYTES = 1 << 20
#: Pieces that a task remembers while it removes repeats; beyond it some repeats reach the shuffle.
SEEN_BOUND = 300_000


@lru_cache(4)
def _encoder(path: str, tables: tuple) -> Encoder:
    return Encoder(path, tables=tables)


def _texts(column: pa.Array):
    """(first row, texts) of bounded chunks."""
    _, offsets = text_buffers(column)
    for i, j in row_chunks(offsets, STEP_BYTES):
        yield i, column.slice(i, j - i).to_pylist()


def word_table(docs: DataFrame, text: str, path: str) -> DataFrame:
    """(h, ids, n): a row for each distinct piece of the corpus, encoded once, and in how many tasks it stood.
    ``ids``: little-endian unsigned 32-bit."""
    tables = character_tables(path)

    def pieces(batches):
        enc, seen = _encoder(path, tables), set()
        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                hashes, starts, ends, joined, _, sid = enc.split(texts)
                distinct, firsts = np.unique(hashes, return_index=True)
                new = [(h, i) for h, i in zip(distinct.tolist(), firsts.tolist()) if h not in seen]
                if len(seen) > SEEN_BOUND:
                    seen.clear()
                seen.update(h for h, _ in new)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([h for h, _ in new], U64).view(np.int64)), pa.array([joined[starts[i] : ends[i]] for _, i in new], pa.string()), pa.array([int(sid[i]) for _, i in new], pa.int64())], ["h", "piece", "special"])

    def encode(batches):
        enc = _encoder(path, tables)
        for batch in batches:
            ids = [s.to_bytes(4, "little") if s >= 0 else enc.piece_ids(p) for p, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(3)], ["h", "ids", "n"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(pieces, "h long, piece string, special long")
    return found.groupBy("h", "piece", "special").agg(F.count("*").alias("n")).mapInArrow(encode, "h long, ids binary, n long")


class WordIndex:
    """The word table as sorted arrays; sorted on the driver once, so that workers hold no copies."""

    def __init__(self, h: np.ndarray, at: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.h, self.at, self.sizes, self.flat = h, at, sizes, flat

    @classmethod
    def sorted_arrays(cls, h: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple:
        order, at = np.argsort(h, kind="stable"), np.cumsum(sizes) - sizes
        return h[order], at[order].astype(np.uint32), sizes[order].astype(np.uint32), flat

    def encode(self, enc: Encoder, hashes, starts, ends, joined, counts, sid) -> tuple[np.ndarray, np.ndarray]:
        """Ids by position; pieces that the index lacks are encoded here, each once."""
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        distinct, firsts, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.h, distinct), max(0, len(self.h) - 1))
        known = self.h[k] == distinct if len(self.h) else np.zeros(len(distinct), bool)
        ids: list = [None] * len(distinct)
        for i, a, n in zip(np.flatnonzero(known).tolist(), self.at[k[known]].tolist(), self.sizes[k[known]].tolist()):
            ids[i] = self.flat[a : a + n].tobytes()
        rare = np.flatnonzero(~known)
        for i, x in zip(rare.tolist(), enc.lookup(distinct[rare], firsts[rare], starts, ends, joined, sid)):
            ids[i] = x
        return join_back(ids, inverse, counts)


def encode(docs: DataFrame, text: str, path: str, words: DataFrame | None = None, out: str = "ids", broadcast_bytes: int = BROADCAST_BYTES, beyond: str = "local", decoded: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: the ids of each text as little-endian unsigned 32-bit integers. ``words``: a saved table.

    ``decoded``: a column for the ids decoded again, in the same pass over the ids. ``carry``: the columns of ``docs`` to
    return, all by default."""
    spark, tables = docs.sparkSession, character_tables(path)
    if words is None:
        words = Workspace(spark).save(word_table(docs, text, path), "words")
    keep = [c for c in (docs.columns if carry is None else carry) if c not in (out, decoded)]
    used = keep if text in keep else [*keep, text]
    schema = docs.select(*keep).schema.add(out, "binary")
    # As many of the most widespread pieces as fit; the histogram has a row for each count of tasks.
    sizes = words.groupBy("n").agg(F.sum(F.length("ids") + 16).alias("size")).orderBy(F.desc("n")).collect()
    least, left = None, broadcast_bytes
    for r in sizes:
        if (left := left - r["size"]) < 0:
            break
        least = r["n"]
    if sizes and left < 0 and beyond == "join":
        found = _encode_by_join(docs.select(*used), text, path, words.drop("n"), out, schema)
        return found if decoded is None else decode(found, out, path, decoded)
    table = words.where(F.lit(False) if least is None else F.col("n") >= least).toArrow()
    flat, at = text_buffers(table.column("ids"))
    index = spark.sparkContext.broadcast(WordIndex.sorted_arrays(np.asarray(table.column("h")).astype(np.int64).view(U64), np.frombuffer(flat.tobytes(), np.uint32), np.diff(at) // 4))

    def run(batches):
        enc, own = _encoder(path, tables), WordIndex(*index.value)
        for batch in batches:
            k = batch.schema.get_field_index(text)
            for i, texts in _texts(batch.column(k).cast(pa.string())):
                hashes, starts, ends, joined, counts, sid = enc.split(texts)
                ids, n = own.encode(enc, hashes, starts, ends, joined, counts, sid)
                cells = [binary_array(ids.view(np.uint8), np.concatenate([[0], np.cumsum(n)]) * 4)]
                if decoded is not None:
                    parts = np.split(ids, np.cumsum(n)[:-1])
                    cells.append(pa.array([decode_ids(x, path).decode("utf-8", "replace") for x in parts], pa.string()))
                carried = [batch.column(c).slice(i, len(texts)) for c in keep]
                yield pa.RecordBatch.from_arrays([*carried, *cells], schema.names)

    if decoded is not None:
        schema = schema.add(decoded, "string")
    return docs.select(*used).mapInArrow(run, schema)


def _encode_by_join(docs: DataFrame, text: str, path: str, words: DataFrame, out: str, schema) -> DataFrame:
    """The same for a word table of any size: a join on (document, distinct piece), salted against frequent pieces."""
    ws, salts, tables = Workspace(docs.sparkSession), 16, character_tables(path)
    key = spare(docs.columns, "row")
    rows = ws.save(docs.withColumn(key, F.expr("uuid()")), "rows")

    def split(batches):
        enc = _encoder(path, tables)
        for batch in batches:
            for i, texts in _texts(batch.column(1)):
                hashes, _, _, _, counts, _ = enc.split(texts)
                at, cells = 0, []
                for n in counts.tolist():
                    distinct, inverse = np.unique(hashes[at : at + n], return_inverse=True)
                    cells.append((distinct.view(np.int64).tolist(), inverse.astype(np.uint32).tobytes()))
                    at += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array([c[0] for c in cells], pa.list_(pa.int64())), pa.array([c[1] for c in cells], pa.binary())], [key, "hs", "at"])

    cut = ws.save(rows.select(key, F.col(text).cast("string")).mapInArrow(split, f"`{key}` string, hs array<long>, at binary"), "cut")
    salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = cut.select(key, F.posexplode("hs").alias("k", "h")).withColumn("salt", F.pmod(F.hash(key), F.lit(salts))).join(salted, ["h", "salt"])
    found = joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("cells"))

    def put(batches):
        for batch in batches:
            cells, at = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            ids = [b"".join([c[j]["ids"] for j in np.frombuffer(a, np.uint32).tolist()]) if a else b"" for c, a in zip(cells, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [key, out])

    ids = cut.select(key, "at").join(found, key, "left").select(key, "cells", "at").mapInArrow(put, f"`{key}` string, `{out}` binary")
    return rows.join(ids, key).select(*[f.name for f in schema])


@lru_cache(4)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table, its size fixed by the tokenizer: (bytes of all pieces, offsets by id)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(ALPHABET)}
    by_id = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    cells = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(cells), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in cells])])


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    flat, at = vocabulary(path)
    ids = ids[ids < len(at) - 1].astype(np.int64)
    return flat[ranges(at[ids], at[ids + 1] - at[ids])].tobytes()


def decode(docs: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the text of the ids, invalid UTF-8 replaced as the library does. Null ids: an empty text."""
    keep = [c for c in docs.columns if c != out]

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(ids)
            texts = [decode_ids(np.frombuffer(x or b"", np.uint32), path).decode("utf-8", "replace") for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, out])

    return docs.select(*keep).mapInArrow(run, docs.select(*keep).schema.add(out, "string"))


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encoded``, which has doc_id, ids and perhaps decoded."""
    if "decoded" not in encoded.columns:
        encoded = decode(encoded.select("doc_id", "ids"), "ids", path)
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
