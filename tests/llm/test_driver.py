"""What the driver holds: no tokenizer, no training rows, no rounds or tables more than needed."""

import random

import numpy as np
import public_tokenizers as P

from tessera.llm import common, ngram_join, packing, quality, textsplit
from tessera.llm.common import Workspace


def test_tokenizer_stays_off_the_driver(spark):
    path = P.path("word_bpe_49k.json")
    textsplit.character_tables.cache_clear()
    textsplit._made.clear()
    docs = spark.createDataFrame([(1, "One text."), (2, None)], "doc_id long, text string")
    assert packing.pack(docs, path).count() == 2
    assert textsplit.character_tables.cache_info().currsize == 0
    assert textsplit.tables_from_task(spark, path) == textsplit.character_tables(path)


def test_training_rows_stay_off_the_driver(spark, monkeypatch):
    rng = random.Random(3)
    texts = [f"one{i} two{i} " + " ".join(rng.choice(["good", "bad", "fine", "Text", "12", "!!"]) for _ in range(20)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(120)], "doc_id long, quality int")
    held = {r["doc_id"] for r in docs.where(quality.held_out(docs["doc_id"])).collect()}
    monkeypatch.setattr(type(docs), "toArrow", lambda self: 1 / 0)
    got = quality.train(docs, labels)
    own = [i for i in range(120) if i not in held]
    raw = [texts[i].encode() for i in own]
    want = quality.fit(quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])), np.array([i % 3 % 2 for i in own]))
    assert (got.w == want.w).all() and (got.ratio == want.ratio).all() and (got.slope, got.shift) == (want.slope, want.shift)


def test_components_stop_when_they_are_stars(spark, monkeypatch):
    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name, large=False: saved.append(name) or save(self, df, name, large))
    find = lambda edges: {r["c"]: r["comp"] for r in ngram_join.connected(Workspace(spark), spark.createDataFrame(edges, "a long, b long"), "x").collect()}
    assert find([(9, 2), (2, 5), (2, 2), (7, 4)]) == {9: 2, 5: 2, 7: 4} and saved == ["x_", "x0"]
    assert find([(3, 3)]) == {}
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(-40, 0)] + [(rng.randrange(100, 180), rng.randrange(100, 180)) for _ in range(70)]
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert find(edges) == {x: t for x, t in top.items() if x != t}


def test_tables_of_many_partitions_are_let_go(spark, monkeypatch):
    calls, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(Workspace, "release", lambda self: calls.append(1))
    try:
        for n, want in ((str(common.MANY_PARTITIONS), 0), (str(common.MANY_PARTITIONS + 1), 1)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            Workspace(spark).save(spark.range(3), "some")
            assert len(calls) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
