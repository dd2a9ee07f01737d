"""Document fingerprints: one-permutation MinHash, in DataFrame functions only.

Each shingle of five words is hashed once; the hash's top bits choose one of ``BINS`` bins, and a bin keeps its smallest
hash. Empty bins are filled by optimal densification: bin b copies the first bin that is not empty among h(b, 1),
h(b, 2), ..., the same for every document. The first tries are written out; rows with few shingles go on in longer and
longer steps, and only after 2048 tries does a bin walk on from h(b, 0), which no bin does but by a rare chance, or where
one bin alone is filled and every way ends there. The low ``BITS`` bits of each bin are stored; the share of equal bins, less what chance makes equal, estimates the likeness.

Cases: null, empty and wordless texts have the empty fingerprint; two of those are alike (1), one of them and another are
not (0); fewer than five words are one shingle; equal texts have equal fingerprints; repeated ids are ordered by a hash of
their text; the document after the last is the first, so a lone document follows itself; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import conf_partitions

WORDS = 5
BIN_BITS, BITS = 8, 8
BINS, TRIES = 1 << BIN_BITS, 12
#: Ends of the further steps, each taken only if all tries before it met empty bins.
STEPS = (64, 320, 2048)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def probe(b: Column, t) -> Column:
    """h(b, t), the bin that empty bin b tries at t."""
    return F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")


def shingle_hashes(text: Column) -> Column:
    """Sorted hashes of the text's word shingles."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    many = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WORDS))))
    nothing = F.array().cast("array<bigint>")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= WORDS, F.sort_array(many(h))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(nothing))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x.bitwiseXOR(F.lit(-(1 << 63))), 64 - BIN_BITS).cast("int")


def bins(hashes: Column) -> Column:
    """The least hash of each bin, null where a bin is empty; sorted hashes come bin by bin."""

    def dense(first: Column) -> Column:
        gaps = F.transform(first, lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("bigint"), _bin(x) - F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(first, i - 1))) - 1), F.array(x)))
        return F.concat(F.flatten(gaps), F.array_repeat(F.lit(None).cast("bigint"), F.lit(BINS - 1) - _bin(F.element_at(first, -1))))

    return let(hashes, lambda s: let(F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))), dense))


def densified(cells: Column) -> Column:
    def fill(d: Column) -> Column:
        def donor(b: Column) -> Column:
            tries = [F.get(d, probe(b, t)) for t in range(TRIES)]
            first = lambda start, stop, at: F.get(F.filter(F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda t: F.get(d, at(t))), lambda x: x.isNotNull()), F.lit(0))
            more = [first(i, j, lambda t: probe(b, t)) for i, j in zip((TRIES, *STEPS), STEPS)]
            return F.coalesce(*tries, *more, first(1, BINS, lambda t: (probe(b, 0) + t) % BINS))

        return F.transform(d, lambda x, b: F.coalesce(x, donor(b)))

    return let(cells, fill)


def sketch(text: Column) -> Column:
    """The stored low bits of each bin; an empty array without shingles."""
    low = lambda d: F.transform(d, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    return let(shingle_hashes(text), lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(low(densified(bins(s)))))


def packed(cells: Column) -> Column:
    """The fingerprint as lowercase hex."""
    return F.array_join(F.transform(cells, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness, 0 to 1: equal bins, corrected for those that chance makes equal."""
    chance = 1.0 / (1 << BITS)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    both = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with next_<column>: that of the row with the next key, after the last the first.

    Keys are dealt by quantiles into ranges. The first row of a range also goes to the end of the range before it, so a
    window in each range sees every successor, and no task sees more than a range.
    """
    n = 4 * conf_partitions(docs.sparkSession)
    low = -(1 << 63)
    marks = docs.agg(F.min(F.coalesce(key, F.lit(low))).alias("first"), F.percentile_approx(F.coalesce(key, F.lit(low)), [i / n for i in range(1, n)], 10 * n).alias("marks")).first()
    bounds = sorted({marks["first"], *(marks["marks"] or [])} - {None}) or [low]
    edges, place = F.lit(bounds), F.coalesce(F.col(key), F.lit(low))
    rows = docs.withColumn("__at", F.size(F.filter(edges, lambda e: e <= place)) - 1)
    last = len(bounds) - 1
    before = F.when(F.col("__at") == 0, F.lit(last)).otherwise(F.col("__at") - 1)
    own = F.struct(F.col("__at").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("range"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("__r", F.explode(F.when(F.get(edges, F.col("__at")) == place, F.array(own, guest)).otherwise(F.array(own))))
    w = Window.partitionBy(F.col("__r.range")).orderBy(F.col("__r.guest"), F.col(key).asc_nulls_first(), F.xxhash64(*columns))
    out = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return out.where("__r.guest = 0").drop("__r", "__at")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the start of the next document."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("cells", sketch(F.col("text")))
    rows = with_next(rows, "doc_id", ["text", "cells"]).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", "n_chars", "cells", "next_cells", edited.alias("edited")).select("doc_id", "n_chars", "cells", "next_cells", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_cells"))
    return rows.select("doc_id", "n_chars", "edited_sha256", packed(F.col("cells")).alias("fingerprint"), packed(F.col("edited_cells")).alias("edited_fingerprint"), likeness(F.col("cells"), F.col("edited_cells")).alias("near_edited"), likeness(F.col("cells"), F.col("next_cells")).alias("near_next"))
