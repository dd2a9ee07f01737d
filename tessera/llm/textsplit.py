"""Vectorised pre-tokenisation: the pieces on which BPE merges work, found on arrays of code points.

Two patterns are known, both published with their vocabularies:
``bytes``  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
``words``  's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+ after NFC and lower-casing
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tessera.llm.common import U64, mix, prefix_hashes, ranges, span_hashes, trim

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
APOSTROPHE, BLANK = 39, 32


@lru_cache(4)
def character_tables(path: str) -> tuple[bytes, bytes, str]:
    """(first code point of each run of one class, its class, odd characters), as the tokenizer itself sees characters: its
    Unicode version is its own. Odd ones are those that Python's NFC or lower case treats in another way, alone or beside
    marks; texts that hold one go through the library's normalizer. Made once and sent to the workers."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, codes))
    pieces = tok.pre_tokenizer.pre_tokenize_str
    bounds = sorted({0, len(every), *(k for _, span in pieces(every) for k in span)})
    # A blank joins the run behind it, and the last blank of several stands alone.
    bounds = sorted({*bounds, *(k + d for k in [every.index(" ")] for d in (0, 1))})

    def kind(c: str) -> int:
        joined = lambda lead: any(span == (0, 1 + len(c)) for _, span in pieces(lead + c))
        if joined("a"):
            return LETTER
        if joined("!"):
            return OTHER
        alone = [span for _, span in pieces("a" + c + "a") if span == (1, 1 + len(c))]
        return NUMBER if alone and not c.isspace() else SPACE

    starts = np.array([codes[k] for k in bounds[:-1]], np.int32)
    kinds = np.array([kind(every[k]) for k in bounds[:-1]], np.uint8)
    odd = []
    if tok.normalizer is not None:
        for probe in ("{}", "a{}\u0323", "a\u0301{}", "{}\u0301"):
            for i in range(0, len(every), 1 << 16):
                part = every[i : i + (1 << 16)]
                text = "|".join(probe.format(c) for c in part if c != "|")
                own, theirs = _normalised(text).split("|"), tok.normalizer.normalize_str(text).split("|")
                odd += [c for c, x, y in zip((c for c in part if c != "|"), own, theirs) if x != y and not c.isspace()]
    return starts.tobytes(), kinds.tobytes(), "".join(sorted(set(odd)))


_made: dict[str, tuple[bytes, bytes, str]] = {}


def tables_from_task(spark: SparkSession, path: str) -> tuple[bytes, bytes, str]:
    """``character_tables``, made once in a task: the library and its pass over all code points take several hundred MB, and
    the driver needs the tables only."""

    def run(batches):
        for _ in batches:
            starts, kinds, odd = character_tables(path)
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([starts], pa.binary()), pa.array([kinds], pa.binary()), pa.array([odd], pa.string())], ["starts", "kinds", "odd"])

    if path not in _made:
        (row,) = spark.range(0, 1, 1, 1).mapInArrow(run, "starts binary, kinds binary, odd string").collect()
        _made[path] = bytes(row["starts"]), bytes(row["kinds"]), row["odd"]
    return _made[path]


def _normalised(text: str) -> str:
    # Lower-casing is by character: no final sigma.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def class_array(starts: bytes, kinds: bytes) -> np.ndarray:
    """The class of each code point; surrogates, which no text holds, are others."""
    first, kind = np.frombuffer(starts, np.int32), np.frombuffer(kinds, np.uint8)
    out = np.repeat(kind, np.diff(np.append(first, 0x110000)))
    out[0xD800:0xE000] = OTHER
    return out


def piece_starts(cp: np.ndarray, first: np.ndarray, kind: str, classes: np.ndarray) -> np.ndarray:
    """True where a piece starts. ``first`` marks the first character of each separate text."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    cls = classes[cp]
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 255, cls[:-1]
    prev[first] = 255
    start = cls != prev
    if kind == "words":
        start |= cls == NUMBER
    else:
        # The last blank before a word joins it; any other last white space stands alone.
        q = np.flatnonzero((prev == SPACE) & (cls != SPACE))
        start[q - 1] = True
        start[q] = cp[q - 1] != BLANK
    a = np.flatnonzero((cp == APOSTROPHE) & (prev != OTHER))
    if kind == "bytes" and len(a):
        a = a[(prev[a] != SPACE) | (cp[a - 1] != BLANK)]
    if len(a):
        last = np.append(np.flatnonzero(first)[1:], n)
        end = last[np.searchsorted(last, a, "right")]
        c1 = np.where(a + 1 < end, cp[np.minimum(a + 1, n - 1)], 0)
        c2 = np.where(a + 2 < end, cp[np.minimum(a + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        start[a[one] + 1] = False
        start[a[two] + 1] = start[a[two] + 2] = False
        after = np.concatenate([a[one] + 2, a[two] + 3])
        start[after[after < np.concatenate([end[one], end[two]])]] = True
    return start


@lru_cache(8)
def _model(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tok = Tokenizer.from_file(path)
    return tok.model, specials, "words" if spec["normalizer"] else "bytes", tok.normalizer


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable, else the next free code from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


ALPHABET = _byte_alphabet()


class Encoder:
    """Splits texts into pieces and encodes each distinct piece once; ids go back by position.

    ``bound``: distinct pieces that a worker remembers; beyond it the memory starts anew, results do not change.
    """

    def __init__(self, path: str, bound: int = 200_000, tables: tuple[bytes, bytes, str] | None = None):
        self.model, self.specials, self.kind, self.normalizer = _model(path)
        starts, kinds, odd = tables or character_tables(path)
        self.classes = class_array(starts, kinds)
        self.any_odd = re.compile("[" + "".join(map(re.escape, odd)) + "]") if odd else None
        self.any_special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.bound, self.known = bound, {}
        self.to_char = str.maketrans({b: c for b, c in enumerate(ALPHABET)})

    def normalise(self, text: str) -> str:
        if self.kind == "bytes":
            return text
        if self.any_odd is not None and not text.isascii() and self.any_odd.search(text):
            return self.normalizer.normalize_str(text)
        return _normalised(text)

    def piece_ids(self, piece: str) -> bytes:
        """ids as little-endian unsigned 32-bit: a third of an array's memory for short pieces."""
        return np.array([t.id for t in self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.to_char))], "<u4").tobytes()

    def split(self, texts: list[str]):
        """(hash of each piece, its start and end in the joined text, the joined text, pieces in each text, special id or -1)."""
        parts, owner, special = [], [], []
        for i, text in enumerate(texts):
            text = text or ""
            if self.any_special and "<|" in text and self.any_special.search(text):
                at = 0
                for m in self.any_special.finditer(text):
                    for s, sid in ((self.normalise(text[at : m.start()]), -1), (m.group(), self.specials[m.group()])):
                        if s:
                            parts.append(s), owner.append(i), special.append(sid)
                    at = m.end()
                if at < len(text):
                    parts.append(self.normalise(text[at:])), owner.append(i), special.append(-1)
            elif text:
                parts.append(self.normalise(text)), owner.append(i), special.append(-1)
        joined = "".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(cp), bool)
        offsets = np.cumsum(lengths) - lengths
        first[offsets[lengths > 0]] = True
        start = piece_starts(cp, first, self.kind, self.classes)
        mark = np.array(special, np.int64)
        for k in np.flatnonzero(mark >= 0):
            start[offsets[k] + 1 : offsets[k] + lengths[k]] = False
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(cp)) if len(starts) else starts
        part = np.searchsorted(offsets, starts, "right") - 1 if len(starts) else starts
        if self.kind == "words" and len(starts):
            keep = (self.classes[cp[starts]] != SPACE) | (mark[part] >= 0)
            starts, ends, part = starts[keep], ends[keep], part[keep]
        prefix = prefix_hashes(mix(cp.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(7)))
        hashes = span_hashes(prefix, starts, ends)
        sid = mark[part] if len(starts) else np.zeros(0, np.int64)
        hashes = np.where(sid >= 0, sid.astype(U64), hashes)
        counts = np.bincount(np.array(owner, np.int64)[part], minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)
        return hashes, starts, ends, joined, counts, sid

    def lookup(self, hashes: np.ndarray, firsts: np.ndarray, starts, ends, joined: str, sid) -> list[bytes]:
        """ids of each distinct piece."""
        if len(self.known) > self.bound:
            self.known.clear()
        out, known = [], self.known
        for h, i in zip(hashes.tolist(), firsts.tolist()):
            ids = known.get(h)
            if ids is None:
                ids = known[h] = int(sid[i]).to_bytes(4, "little") if sid[i] >= 0 else self.piece_ids(joined[starts[i] : ends[i]])
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids in each text)."""
        hashes, starts, ends, joined, counts, sid = self.split(texts)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        distinct, firsts, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return join_back(self.lookup(distinct, firsts, starts, ends, joined, sid), inverse, counts)


def join_back(ids: list[bytes], inverse: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the ids of the distinct pieces at the pieces' positions: (all ids, ids in each text)."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
    lengths = size[inverse]
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(counts)
    return flat[ranges(at[inverse], lengths)], total[ends] - total[ends - counts]
