"""Operators against second, plain implementations, and odd rows: null and repeated ids, clashing names, long and deep texts."""

import hashlib
import itertools
import math
import os
import random
import struct
import time

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, fingerprints, html_extract, ngram_join, packing, quality, queries, sharding, suffix_dedup, url_filter, vafile
from tessera.llm.textsplit import Encoder

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point_in_context(name):
    """The character classes and case of the library, not of Python: all code points, fifty in a text."""
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    tok, enc = Tokenizer.from_file(P.path(name)), Encoder(P.path(name))
    for before, after in (("a", "1"), (" ", "!")):
        texts = ["".join(before + c + after for c in points[i : i + 50]) for i in range(0, len(points), 50)]
        want = [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
        for i in range(0, len(texts), 500):
            ids, counts = enc.encode(texts[i : i + 500])
            ends = np.cumsum(counts)
            assert [ids[e - k : e].tolist() for e, k in zip(ends, counts)] == want[i : i + 500]


# Fingerprints ----------------------------------------------------------------------------------------------------------
def plain_sketch(text):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chain = lambda xs: __import__("functools").reduce(lambda s, x: xxhash.xxh64_intdigest(struct.pack("<q", x), s), xs, 42)
    probe = lambda b, t: signed(xxhash.xxh64_intdigest(struct.pack("<i", t), xxhash.xxh64_intdigest(struct.pack("<i", b), 42))) % 256
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in (text or "").lower().split()]
    if not words:
        return ""
    shingles = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words]
    least = {}
    for s in shingles:
        h = signed(chain(s))
        b = ((h & (2**64 - 1)) ^ (1 << 63)) >> 56
        least[b] = min(least.get(b, h), h)
    out = []
    for b in range(256):
        tries = itertools.chain((probe(b, t) for t in range(2048)), ((probe(b, 0) + t) % 256 for t in range(1, 256)))
        at = b if b in least else next(x for x in tries if x in least)
        out.append(f"{least[at] & 255:02x}")
    return "".join(out)


def test_fingerprints_against_a_plain_version(spark):
    rng = random.Random(9)
    base = [f"word{rng.randrange(500)}" for _ in range(25_000)]
    texts = [" ".join(base[:n]) for n in (1, 3, 5, 6, 8, 20, 60, 400)] + [None, "", " \t", " ".join(base), " ".join(base[:60]), " ".join(base[3:60])]
    rows = [(None if i == 4 else i // 2, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cells string, next_text string").repartition(3)
    got = fingerprints.compare(df).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    by_size = {}
    for r in got:
        by_size.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    for t in texts:
        assert plain_sketch(t) in by_size[len(t or "")]
    pairs = spark.createDataFrame([(texts[12], texts[13])], "a string, b string").select(fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).first()[0]
    a, b = (bytes.fromhex(plain_sketch(t)) for t in texts[12:14])
    same = sum(x == y for x, y in zip(a, b)) / 256
    assert abs(pairs - max(0.0, (same - 1 / 256) / (1 - 1 / 256))) < 1e-12
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts[12:14])]
    assert abs(pairs - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.1


# HTML ------------------------------------------------------------------------------------------------------------------
def test_marginals_against_enumeration():
    rng = random.Random(4)
    pages = ["<div><p>a, b.</p><nav><ul><li><a href=x>c</a></ul></nav></div>", "<article><h1>t</h1><p>x</p></article><footer>y</footer>", "<p>a<p>b<p>c"]
    model = html_extract.Model(np.array([rng.uniform(-1, 1) for _ in range(html_extract.N_FEATURES)]), np.array([[[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)] for _ in range(4)]))
    for page in pages:
        nodes = html_extract.parse(page)
        place = {id(n): i for i, n in enumerate(nodes)}
        unary = [sum(model.w[k] * v for k, v in html_extract.describe(n, nodes[0].chars)) for n in nodes]
        mass, on = 0.0, [0.0] * len(nodes)
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            e = sum(u * y for u, y in zip(unary, labels)) + sum(model.edges[html_extract.kind(n)][labels[place[id(n.parent)]]][labels[i]] for i, n in enumerate(nodes) if n.parent is not None)
            p = math.exp(e)
            mass += p
            for i, y in enumerate(labels):
                on[i] += p * y
        assert np.allclose(model.marginals(nodes), [x / mass for x in on], atol=1e-9)


def test_html_odd_attributes():
    model = html_extract.trained()
    text = "A long sentence of the article, with commas, that a reader wants to have. " * 6
    wrap = lambda p: html_extract.extract(f"<html><body><article><p>First. {text}</p>{p}<p>Last. {text}</p></article></body></html>", model)
    assert "Middle it" in wrap(f"<p class=it's>Middle it. {text}</p>")
    assert 'b">' not in wrap(f'<p title="a"b">Middle. {text}</p>') and "Middle." in wrap(f'<p title="a"b">Middle. {text}</p>')
    assert "one word two" in wrap(f'<p>one <span class="highlight-tags">word</span> two. {text}</p>')
    assert "Middle." in wrap(f'<p class="x" class="advert">Middle. {text}</p>')
    assert "a > b" not in wrap(f'<p title="a > b">Middle. {text}</p>')


def test_html_depth_is_linear():
    taken = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_extract.extract("<div>" * n + "x" + "</section></b>" * n, html_extract.trained())
        taken.append(time.process_time() - began)
    assert taken[1] < 12 * taken[0] + 1


# Vectors ---------------------------------------------------------------------------------------------------------------
def test_vafile_repeated_queries_and_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(120)] + [(100, rng.normal(size=4).round(2).tolist()), (0, rng.normal(size=4).round(2).tolist())]
    rows += [(200 + i, rng.normal(size=3).round(2).tolist()) for i in range(30)] + [(300, [1.0]), (None, [1.0] * 4)]
    v = vafile.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    plain = [(r["vec_id"], r["v"]) for r in v.collect()]
    want = []
    for i, (qid, q) in enumerate(plain):
        if qid % 100 == 0:
            scores = sorted((-int(np.dot(q, x)), j) for k, (j, x) in enumerate(plain) if k != i and len(x) == len(q))[:10]
            want += [(qid, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    assert sorted(tuple(r) for r in vafile.search(v, v.where("vec_id % 100 = 0")).collect()) == sorted(want)


# URL filter, sharding, quality ----------------------------------------------------------------------------------------
def test_url_filter_with_clashing_names(spark):
    entries = spark.createDataFrame([("bad.example", "2024-01-10", "add", "y"), ("bad.example", "2024-01-10", "add", "x"), ("worse.example", "2024-01-10", "add", "x"), ("worse.example", "2024-01-10", "remove", "x")], "host string, at string, action string, category string").withColumn("at", F.to_date("at"))
    rows = [(1, "http://bad.example/", "mine", "mine", 7), (2, "http://worse.example/", None, None, 8), (1, "http://bad.example/", "mine", "mine", 7)]
    df = spark.createDataFrame(rows, "id int, url string, m string, moment string, salt int").withColumn("fetched", F.to_date(F.lit("2024-02-01")))
    out = url_filter.evaluate(df, entries).collect()
    assert sorted((r["id"], r["m"] or "", r["moment"] or "", r["salt"], r["category"]) for r in out if r["id"] == 1) == [(1, "mine", "mine", 7, "x")] * 2
    assert [(r["moment"], r["blocked"]) for r in out if r["id"] == 2] == [(None, False)]


def test_sharding_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("a", 4)], "key string, slot int")
    got = sharding.place(df, "key").collect()
    assert len(got) == 4 and len({r["shard"] for r in got if r["key"] == "a"}) == 1 and len({r["slot"] for r in got if not r["key"]}) == 1


def test_quality_of_odd_rows(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(30)) + "."
    poor = lambda: " ".join(rng.choice("ALPHA!! BETA!! GAMMA!!".split()) for _ in range(30))
    rows = [(i % 150, poor() if (i % 150) % 4 == 0 else good(), 5.0, 7) for i in range(600)] + [(None, good(), 5.0, 7), (None, poor(), 5.0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(150)] * 2, "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels, sample=60)).collect()
    assert len(out) == len(rows) and all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in out if r["doc_id"] is not None)
    assert sorted(r["predicted"] for r in out if r["doc_id"] is None) == [0, 1]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/../sf0.01/labels.parquet").collect()}
    out = [r for r in queries.op5_quality(spark, f"{FOLDER}/../sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(out) > 40 and sum(r["predicted"] == labels[r["doc_id"]] for r in out) >= 0.95 * len(out)


# Suffixes, n-grams, BPE, packing --------------------------------------------------------------------------------------
def test_suffix_dedup_of_odd_rows(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    texts = [(3, long), (None, long[500:900]), (3, long[:300]), (5, long[100:450] + "é" * 60 + long[2000:2300]), (5, long[100:450] + "é" * 60 + long[2000:2300]), (1, None), (9, "")]
    df = spark.createDataFrame([(i, t, "t", "p") for i, t in texts], "doc_id long, text string, __tie string, payload string").repartition(3)
    out = suffix_dedup.remove_repeats(df, batch_bytes=5000).collect()
    assert len(out) == len(texts) and {r["__tie"] for r in out} == {"t"}
    # The order of the contract: null first, then by id, equal ids in the operator's own order of their texts.
    order = {r["text"]: r for r in out}
    assert order[long[500:900]]["n_removed"] == 0
    seen, total = set(), 0
    for r in sorted(out, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], 0)):
        total += r["n_removed"]
    ranked = sorted(texts, key=lambda x: -1 if x[0] is None else x[0])
    for a in (ranked, [*ranked[:2], ranked[3], ranked[2], *ranked[4:]]):
        got = suffix_dedup.brute_force([(k, (t or "").encode()) for k, (_, t) in enumerate(a)])
        seen.add(sum(x[1] for x in got.values()))
    assert total in seen


def test_ngram_join_with_large_groups(spark):
    """2,000 different near copies, some of which link only through others; repeated and null ids."""
    rng = random.Random(12)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 9])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    drift = list(base)
    for i in range(0, 60, 2):
        drift[i] = f"d{i}"
        texts.append(" ".join(drift))
    frequent = " ".join(base[40:60])
    texts += [f"{frequent} alone{i} " + " ".join(f"z{i}q{j}" for j in range(4)) for i in range(300)]
    rows = [(i // 2 if i % 50 == 1 else None if i % 701 == 5 else i, t) for i, t in enumerate(texts)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    plain = ngram_join.brute_force([(k, t) for k, (_, t) in enumerate(rows)])
    name = {}
    for k, (i, _) in enumerate(rows):
        top = plain[k][1]
        if i is not None:
            name[top] = min(name.get(top, i), i)
    want = sorted(((i, plain[k][0], name.get(plain[k][1])) for k, (i, _) in enumerate(rows)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_packed_arrays():
    rng = np.random.default_rng(2)
    for _ in range(20):
        arrays = [np.sort(rng.integers(0, 2**63, rng.integers(0, 50)).astype(np.uint64)), rng.integers(0, 9, 7).astype(np.uint16), np.zeros(0, np.int64)]
        back = ngram_join.unpacked(ngram_join.packed(ngram_join.steps(arrays[0]), *arrays[1:]))
        assert np.array_equal(np.cumsum(back[0], dtype=np.uint64), arrays[0]) and all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(back[1:], arrays[1:]))


def test_bpe_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "one two", "x", "y", "z"), (1, "one two", "x", "y", "z")], "doc_id long, text string, ids string, decoded string, __row string")
    path = P.path("byte_bpe_50k.json")
    for beyond, limit in (("local", 1 << 20), ("join", 0)):
        out = bpe.encode(df, "text", path, decoded="decoded", beyond=beyond, broadcast_bytes=limit).collect()
        assert [r["decoded"] for r in out] == ["one two"] * 2 and {r["__row"] for r in out} == {"z"}


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "word " * 5000, "p"), (1, "a", "p"), (1, "a", "p")], "doc_id long, text string, part string")
    out = packing.pack(df, P.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in out) == 5001 + 2 + 2 and sum(r["length"] for r in out if r["doc_id"] is None) == 5001


# Registered queries ----------------------------------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    order = [[d[0] for d in result.description].index(c) for c in names]
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, extra columns, and an empty table go through all stages."""
    import corpus_pipeline as cp

    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)) + "."
    rows = [(i, sentence(), "en", "s", 1, "p") for i in range(40)] + [(500 + i, "BUY!! " * 40 + f"N{i}", "en", "s", 1, "p") for i in range(20)]
    rows += [(None, sentence(), None, None, None, "p"), (600, None, "en", "s", 0, "p"), (601, "", "en", "s", 0, "p"), rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, payload string"
    labels = spark.createDataFrame([(i, int(i < 500)) for i, *_ in rows[:60]], "doc_id long, quality int")
    for name, data in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = cp.run(spark, folder).collect()
        assert (not out) == (not data)
        if data:
            kept = {r["doc_id"] for r in out}
            assert set(range(40)) <= kept and not any(i is not None and 500 <= i < 520 for i in kept) and None in kept


def test_digest_columns(spark):
    df = spark.createDataFrame([(1, "ab" * 100)], "doc_id long, text string")
    assert suffix_dedup.digests(suffix_dedup.remove_repeats(df)).first()["kept_sha256"] == hashlib.sha256(b"ab").hexdigest()
