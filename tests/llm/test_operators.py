"""Each operator against the library, a brute-force version or held-out labels, with nulls, empty and odd rows."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, fingerprints, html_extract, ngram_join, packing, quality, sharding, suffix_dedup, url_filter, vafile

SCHEMA = "doc_id long, text string, lang string, n_chars string"
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def corpus():
    rng = random.Random(5)
    alphabet = list("aB'sStTrevmldLL 12 \n\t  !?é–́İΣσß 　中𝟙٣") + ["<|endoftext|>", "<|startoftext|>", " '"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"z{rng.randint(0, 99)}"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "a b", "A B", "a b c d e", "x" * 99, "x" * 100, "x" * 101, "ab" * 400, "long " * 9000, texts[0], texts[160]]
    return [(i, t, None, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize(("limit", "beyond"), [(1 << 26, "local"), (9000, "local"), (0, "local"), (0, "join")])
def test_bpe(docs, rows, empty, limit, beyond):
    tok = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: r for r in bpe.digests(bpe.encode(docs, "text", BYTES, broadcast_bytes=limit, beyond=beyond), BYTES).collect()}
    fused = bpe.encode(docs, "text", BYTES, broadcast_bytes=limit, beyond=beyond, decoded="decoded", carry=["doc_id"])
    assert fused.columns == ["doc_id", "ids", "decoded"]
    assert {r["doc_id"]: r for r in bpe.digests(fused, BYTES).collect()} == got
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
    assert bpe.digests(bpe.encode(empty, "text", BYTES), BYTES).count() == 0
    assert bpe.digests(bpe.encode(empty, "text", BYTES, decoded="decoded", carry=["doc_id"]), BYTES).count() == 0


def test_packing(docs, rows, empty):
    tok = Tokenizer.from_file(WORDS)
    pieces = packing.pack(docs, WORDS).collect()
    places = Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places[r["sequence_id"]] and r["length"] > 0
        places[r["sequence_id"]] += r["length"]
    assert all(n == 2048 for s, n in places.items() if s != max(places)) and sorted(places) == list(range(len(places)))
    for i, text, *_ in rows:
        ids, at = tok.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(empty, WORDS).count() == 0


def test_packed_sequences(docs):
    table = packing.token_table(docs, WORDS)
    sums = packing.sequences(table, 64).agg(F.sum("n_tokens"), F.max("n_tokens")).first()
    assert sums[0] == table.agg(F.sum("n")).first()[0] and sums[1] == 64


def test_suffix_dedup(docs, rows, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(suffix_dedup.remove_repeats(docs, batch_bytes=4000)).collect()}
    assert got == suffix_dedup.brute_force([(i, (t or "").encode()) for i, t, *_ in rows])
    assert suffix_dedup.remove_repeats(empty).count() == 0
    kept = suffix_dedup.kept_text(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_suffix_segments(spark, monkeypatch):
    rng = random.Random(2)
    a = bytes(rng.randrange(97, 123) for _ in range(9000))
    b = a[3000:7000] + b"-" + a[100:450]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    whole = suffix_dedup.Batch(suffix_dedup.pa.table({"text": [a.decode()]}), "text", 100, 40)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 20)
    plain = suffix_dedup.Batch(suffix_dedup.pa.table({"text": [a.decode()]}), "text", 100, 40)
    assert (whole.hi - whole.lo + 1).sum() == (plain.hi - plain.lo + 1).sum() == 8901
    assert set(whole.suffixes(np.arange(len(whole.lo))).tolist()) == set(plain.suffixes(np.arange(len(plain.lo))).tolist())
    assert len(b)


def test_suffix_family():
    rng, family, seen = np.random.default_rng(1), suffix_dedup.SuffixFamily(), set()
    for _ in range(40):
        batch = np.unique(rng.integers(0, 5000, 300).astype(np.uint64))
        assert family.add(batch).tolist() == [int(x) in seen for x in batch]
        seen.update(map(int, batch))
    sizes = [len(x) for x in family.levels]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 8


def test_ngram_join(docs, rows, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect()}
    assert got == ngram_join.brute_force([(i, t) for i, t, *_ in rows])
    assert ngram_join.components(empty).count() == 0


def test_ngram_join_without_ids(spark):
    """Documents 1 and 3 are linked only through a text that rows without an id have."""
    base = [f"w{i}" for i in range(200)]
    a, b = base[:185] + [f"a{i}" for i in range(15)], [f"b{i}" for i in range(15)] + base[15:]
    texts = [(1, " ".join(a)), (None, " ".join(base)), (3, " ".join(b)), (None, " ".join(base)), (None, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    assert ngram_join.brute_force([(1, texts[0][1]), (3, texts[2][1])])[3] == (196, 3)
    got = sorted((tuple(r) for r in ngram_join.components(docs).collect()), key=repr)
    assert got == sorted([(1, 196, 1), (3, 196, 1), (None, 196, 1), (None, 196, 1), (None, 0, None)], key=repr)


def test_quality(spark, empty):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(30)) + "."
    poor = lambda: " ".join(rng.choice("ALPHA!! BETA!! GAMMA!!".split()) for _ in range(30))
    rows = [(i, poor() if i % 4 == 0 else good(), None, "x") for i in range(300)] + [(900, None, None, "x"), (901, "", None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels)).withColumn("h", quality.held_out(F.col("doc_id"))).collect()
    assert len(out) == 302 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in out if r["h"] and r["doc_id"] < 300)
    assert out[0]["h"] == (zlib.crc32(str(out[0]["doc_id"]).encode()) % 5 == 0)
    none = quality.train(docs, labels.where("false"))
    assert quality.score(empty, none).count() == 0 and quality.score(docs, none).first()["score"] == 0.5


def test_vafile(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 8).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[100][1]) for i in range(60)] + [(5000, None), (5100, [float("nan")] * 8), (5200, [1.0]), (5300, [None] * 8)]
    v = vafile.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    plain = [(r["vec_id"], r["v"]) for r in v.collect() if len(r["v"]) == 8]
    for block in (2048, 2):
        got = sorted(tuple(r) for r in vafile.search(v, v.where("vec_id % 100 = 0"), block=block).collect())
        assert got == vafile.brute_force(plain, {i for i, _ in plain if i % 100 == 0})
    assert vafile.search(v.where("false"), v).count() == 0
    assert vafile.search(v.where("vec_id < 3"), v.where("vec_id = 0")).count() == 2


def test_vafile_large_components(spark):
    """Finite components count whatever their size; what passes 64 bits is an error, not a row less."""
    rng = random.Random(2)
    rows = [(0, [0.001, 0.001]), (1, [1.2e15, 1e15]), (2, [-1.2e15, 1e15]), (3, [float("inf"), 0.0])] + [(i, [rng.uniform(-1.2e15, 1.2e15) for _ in range(2)]) for i in range(4, 200)]
    v = vafile.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    plain = [(r["vec_id"], r["v"]) for r in v.collect()]
    assert {i for i, _ in plain} == set(range(200)) - {3}
    assert sorted(tuple(r) for r in vafile.search(v.where("vec_id > 0 or vec_id = 0"), v.where("vec_id = 0")).collect()) == vafile.brute_force(plain, {0})
    with pytest.raises(OverflowError):
        vafile.search(v, v.where("vec_id = 1"))
    with pytest.raises(Exception, match="62 bits"):
        vafile.integer_vectors(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_fingerprints(spark, rows, empty):
    texts = [t for _, t, *_ in rows if t is None or len(t) < 20000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.compare(docs).collect()}
    sets = lambda t: set(zip(*[re.findall(r"[^\x20\x09-\x0D]+", t.lower())[i:] for i in range(5)]))
    by_text = {}
    for i, text in enumerate(texts):
        t, following = text or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        a, b = sets(t), sets(edited)
        if len(a) > 50:
            assert abs(len(a & b) / len(a | b) - got[i]["near_edited"]) < 0.2
        assert 0 <= got[i]["near_next"] <= 1
    assert fingerprints.compare(empty).count() == 0
    alone = fingerprints.compare(docs.where("doc_id = 3")).first()
    assert alone["near_next"] == 1.0


def test_fingerprints_of_short_texts(spark):
    """Two texts of 10 shingles with 6 in common of 14: bins that are filled at random err less than rotated ones."""
    rng, rows = random.Random(3), []
    for k in range(300):
        a, b = ([f"{k}x{rng.randrange(10**9)}" for _ in range(14)] for _ in "ab")
        rows.append((k, " ".join(a), " ".join(a[:10] + b[10:])))
    df = spark.createDataFrame(rows, "k int, a string, b string").select(fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))))
    got = np.array([r[0] for r in df.collect()])
    assert abs(got.mean() - 6 / 14) < 0.02 and np.sqrt(((got - 6 / 14) ** 2).mean()) < 0.06


def test_fingerprint_plan_is_native(docs):
    plan = fingerprints.compare(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding(docs, rows, empty):
    table = sharding.lookup_table()
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    assert sum(a != b for a, b in zip(table, fewer)) < 0.15 * len(table)
    assert sharding.place(docs, "doc_id").count() == len(rows) and sharding.place(empty, "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(slots=100)


def test_url_filter(spark):
    entries = spark.createDataFrame([("bad.example", "2024-01-10", "add", "x"), ("bad.example", "2024-02-01", "remove", "x"), ("bad.example", "2024-03-01", "add", "y"), ("deep.bad.example", "2024-01-15", "add", "z"), (None, "2024-01-01", "add", "n")], "host string, at string, action string, category string").withColumn("at", F.to_date("at"))
    captures = [(1, "http://bad.example/a", "2024-01-09"), (2, "https://u@BAD.example:80/", "2024-01-10"), (3, "http://a.bad.example", "2024-02-01"), (4, "http://deep.bad.example/", "2024-02-05"), (5, "http://x.deep.bad.example/", "2024-01-20"), (6, None, "2024-01-20"), (7, "nonsense", "2024-01-20"), (8, "http://bad.example/", None), (9, "http://notbad.example/", "2024-04-01"), (2, "https://u@BAD.example:80/", "2024-01-10")]
    df = spark.createDataFrame([(i, u, d, "mine") for i, u, d in captures], "id int, url string, fetched string, category string").withColumn("fetched", F.to_date("fetched"))
    out = url_filter.evaluate(df, entries).collect()
    assert len(out) == len(captures)
    assert {r["id"]: r["category"] for r in out} == {1: None, 2: "x", 3: None, 4: "z", 5: "z", 6: None, 7: None, 8: None, 9: None}
    assert url_filter.evaluate(df.where("false"), entries).count() == 0


def test_html_on_held_out_pages():
    rng, model = random.Random(77), html_extract.trained()
    found = missed = wrong = 0
    for _ in range(200):
        page = html_extract.labelled_page(rng)
        nodes = html_extract.parse(html_extract.LABEL.sub("", page))
        labels = html_extract._labels(page)
        assert len(nodes) == len(labels)
        want, got = (Counter(html_extract.blocks(nodes, k)) for k in ([bool(x) for x in labels], [m >= 0.5 for m in model.marginals(nodes)]))
        found, missed, wrong = found + sum((want & got).values()), missed + sum((want - got).values()), wrong + sum((got - want).values())
    assert missed < 0.03 * found and wrong < 0.05 * found


def test_html_embedded_tags():
    text = "A long sentence of the article, with commas, that a reader wants to have. " * 6
    for tag in "math svg object canvas audio video iframe noscript".split():
        for close in (f"</{tag}>", ""):
            page = f"<html><body><article><p>First. {text}</p><{tag}><p>Inner. {text}</p>{close}<p>Last. {text}</p></article></body></html>"
            held = "".join(x for n in html_extract.parse(page) for x in n.parts if isinstance(x, str))
            assert all(w in held for w in ("First.", "Inner.", "Last.")), (tag, close)
            got = html_extract.extract(page, html_extract.trained())
            assert all(w in got for w in ("First.", "Inner.", "Last.")), (tag, close)
    held = "".join(x for n in html_extract.parse("<p>a</p><textarea>b<p>c</p>") for x in n.parts if isinstance(x, str))
    assert "c" in held


def test_html_cases(spark):
    page = '<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T &amp; t</h1><p>One <b>two<br>three.<p>Four\n five, six, seven.</article><footer>&copy; x</footer>'
    rows = [(1, page), (2, None), (3, ""), (4, "plain &lt; text"), (5, "<div>" * 5000), (6, "<script>x"), (7, page)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == got[7] == "T & t\n\nOne two three.\n\nFour five, six, seven." and got[4] == "plain < text"
    assert got[2] == got[3] == got[5] == got[6] == ""
    assert html.unescape("&amp") == "&"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)) + "."
    texts = [sentence() for _ in range(60)]
    shared = sentence()
    texts += [texts[3], texts[4].replace(texts[4].split()[2], "changed", 1), texts[5] + " " + shared, texts[6] + " " + shared]
    junk = [" ".join(["BUY!!"] * 40 + [f"N{i}!!"]) for i in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500 + i, t, "en", "s", len(t)) for i, t in enumerate(junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 500)) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = cp.quality_filter(spark, docs, str(tmp_path))
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert one.columns == docs.columns and sorted(kept) == list(range(64))
    two = cp.near_duplicates(spark, one, str(tmp_path))
    want = {d for d, (_, c) in ngram_join.brute_force(list(kept.items())).items() if d == c}
    assert {r["doc_id"] for r in two.collect()} == want and two.columns == docs.columns
    three = {r["doc_id"]: r for r in cp.repeated_passages(spark, two, str(tmp_path)).collect()}
    removed = suffix_dedup.brute_force([(d, kept[d].encode()) for d in want])
    assert all(len(r["text"].encode()) == removed[d][0] - removed[d][1] and r["n_chars"] == len(r["text"]) for d, r in three.items())
    out = cp.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(WORDS)
    assert sum(r["length"] for r in out) == sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in three.values())
