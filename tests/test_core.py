"""Reference operators: hand-computed values and plain versions."""

import io
import json
import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import cli, server
from tessera.config import Config
from tessera.functions import tokens as K
from tessera.operators import minhash, report, scoring, store, vectors, verify
from tessera.plans import queries, scan
from tessera.sources import blocks, files
from tessera.streaming import events


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=90), st.lists(st.sampled_from("abcd"), max_size=90))
def test_kernels(a, b):
    lcs, ed = verify.lcs_length(a, b), verify.edit_distance(a, b)
    assert lcs == plain_lcs(a, b) and ed == plain_edit(a, b)
    assert max(len(a), len(b)) - lcs <= ed <= len(a) + len(b) - 2 * lcs


def test_shingles(spark):
    df = spark.createDataFrame([(list("abcde"),), (["a", "b"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(K.shingles(F.col("t"), 3)).collect()]
    assert got == [["a b c", "b c d", "c d e"], ["a b"], [""]]


def test_normalize_numbers_each_occurrence(spark):
    toks = "def calculate ( x , y ) : result = x + y return result".split()
    row = K.normalize(spark.createDataFrame([("b", "python", toks), ("e", "python", [])], "block_id string, lang string, tokens array<string>")).orderBy("block_id").collect()
    assert row[0]["normalized_tokens"] == "def VAR_1 ( VAR_2 , VAR_3 ) : VAR_4 = VAR_5 + VAR_6 return VAR_7".split()
    assert row[0]["token_mapping"]["x"] == "VAR_5" and row[0]["reverse_mapping"]["VAR_7"] == ["result"]
    assert row[1]["normalized_tokens"] == []


def test_roles(spark):
    want = {"True": None, "true": "BOOL", "Widget": "TYPE", "CONST": "TYPE", "MAX_N": "VAR", "__init__": "FUNC", '"s"': "STR", "007": None, "3.5e2": "NUM", "$x": None, "+": None, "my_f": "VAR"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["r"] for r in df.select("t", K.role(F.col("t"), F.lit("python")).alias("r")).collect()} == want


def test_shingling_splits_text_once(spark):
    df = spark.createDataFrame([("a b c d e f g",)], "text string").select(F.lit(1).alias("id"), "text")
    plan = minhash.signatures(df, "id", K.words(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2


def test_minhash_recall(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 900)}" for _ in range(200)]
    rows = [(0, base)] + [(i, base[:60] + [f"x{i}"] + base[61:]) for i in range(1, 6)] + [(i, [f"q{i}-{j}" for j in range(80)]) for i in range(6, 9)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    sigs = minhash.signatures(df, "id", F.col("t"))
    pairs = {(r["src"], r["match"]) for r in minhash.candidates(sigs, sigs, "id").collect()}
    assert pairs == {(a, b) for a in range(6) for b in range(a)}
    assert minhash.remove(sigs, df.where("id < 6"), "id").count() == 3 and minhash.add(sigs, sigs, "id").count() == 9
    with pytest.raises(ValueError):
        minhash.bands(sigs, "id", 65, 8)


def copies_table(spark, folder):
    """Documents with 60 copies of one text, copies of a near one between them, and a lone one."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    other = [*words[:75], "changed", *words[76:]]
    rows = [(i, " ".join(other if i % 7 == 3 else words), "src1", "en") for i in range(70)] + [(70, "alone " * 3, "src1", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{folder}/documents.parquet")
    return {i: (1 if i % 7 == 3 else 0) for i in range(70)}


def test_copies_have_their_own_candidates(spark, tmp_path):
    copies_table(spark, tmp_path)
    sigs = queries.document_signatures(spark, str(tmp_path)).cache()
    got = {tuple(r) for r in minhash.member_candidates(sigs, "doc_id").select("src", "match", "similarity").collect()}
    assert got == {tuple(r) for r in minhash.candidates(sigs, sigs, "doc_id").select("src", "match", "similarity").collect()}
    assert {r[0] for r in got} == set(range(1, 70))


def test_index_candidates_see_copies_on_both_sides(spark, tmp_path):
    copies_table(spark, tmp_path)
    sigs = queries.document_signatures(spark, str(tmp_path)).cache()
    new, held = sigs.where("doc_id % 2 = 0"), sigs.where("doc_id % 3 > 0")
    got = {tuple(r) for r in minhash.index_candidates(new, held, "doc_id", 10).select("src", "match", "similarity").collect()}
    assert got == {tuple(r) for r in minhash.candidates(new, held, "doc_id", False, 10).select("src", "match", "similarity").collect()}


def test_copies_are_verified_and_found(spark, tmp_path):
    group = copies_table(spark, tmp_path)
    rows = queries.verified_duplicates(spark, str(tmp_path)).collect()
    assert {r["src"] for r in rows} == set(range(1, 70)) and all(r["match"] < r["src"] for r in rows)
    assert all((r["similarity_confidence"] == 1.0) == (group[r["src"]] == group[r["match"]]) for r in rows)
    found = {r["src"]: r["refactor_score"] for r in queries.findings(spark, str(tmp_path)).collect()}
    d = lambda i: min(i, 50)
    assert set(found) == set(range(1, 70))
    assert all(abs(found[i] - 150 * (1 + math.log(1 + d(i))) * (1 + 0.1 * (d(i) - 1))) < 1e-5 for i in found)
    assert queries.report_summary(spark, str(tmp_path)).first()["total"] == sum(min(i, 5) for i in range(70))
    counters = queries.scan_counters(spark, str(tmp_path)).first()
    assert counters["findings_generated"] == sum(d(i) for i in range(70)) and counters["findings"] + counters["findings_filtered"] == counters["findings_generated"]


def test_scan_does_not_square_copies(spark):
    """400 equal blocks meet in 50 candidates each, not in all pairs; scan and queries take one path."""
    toks = [f"call{i}" for i in range(150)]
    df = spark.createDataFrame([(f"a{i:03d}.py:1:9", "python", toks) for i in range(400)], "block_id string, lang string, tokens array<string>")
    result = scan.scan_blocks(df, Config()).persist()
    assert result.candidates.count() == sum(min(i, 50) for i in range(400)) and result.findings.count() == sum(min(i, 5) for i in range(400))
    counters = result.statistics()
    assert counters["blocks_extracted"] == 400 and counters["findings_filtered"] == counters["findings_generated"] - counters["findings"]


def test_whole_text_verification_against_plain_tables(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.choice([0, 1, 5, 40, 90]))) for _ in range(40)] + [None, ""]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.adjacent_verification(spark, str(tmp_path)).collect()
    assert len(rows) == 41
    for r in rows:
        a, b = ((texts[r[k]] or "").split() for k in ("src", "match"))
        n = max(len(a), len(b))
        assert r["lcs_length"] == plain_lcs(a, b) and r["edit_distance"] == plain_edit(a, b)
        assert r["token_diff_count"] == len(set(a) ^ set(b))
        o, j, e = (plain_lcs(a, b) / n if n else 1.0), (len(set(a) & set(b)) / len(set(a) | set(b)) if n else 1.0), (plain_edit(a, b) / n if n else 0.0)
        c = 0.0 if min(o, j, 1 - e) <= 0 else 1 / (0.5 / o + 0.3 / j + 0.2 / (1 - e))
        assert abs(r["overlap_score"] - o) < 1e-9 and abs(r["jaccard_score"] - j) < 1e-9 and abs(r["similarity_confidence"] - c) < 1e-8
        assert r["is_duplicate"] == (o >= 0.75 or (o >= 0.6 and e <= 0.25) or c >= 0.7)


def test_verification_rules(spark):
    ten = list("abcdefghij")
    rows = [(1, 2, ten, ten[:8] + ["x", "y"]), (1, 3, [], []), (1, 4, ten, []), (1, 5, ten, list("klmnopqrst"))]
    got = {r["match"]: r for r in verify.verify(spark.createDataFrame(rows, "src long, match long, a array<string>, b array<string>")).collect()}
    assert got[2]["lcs_length"] == 8 and got[2]["edit_distance"] == 2 and got[2]["is_duplicate"] and got[2]["token_diff_count"] == 4
    assert got[3]["is_duplicate"] and got[3]["similarity_confidence"] == 1.0
    assert not got[4]["is_duplicate"] and got[4]["edit_density"] == 1.0 and not got[5]["is_duplicate"]
    assert verify.least_length_ratio() == 0.6
    stats = verify.statistics(verify.verify(spark.createDataFrame(rows, "src long, match long, a array<string>, b array<string>"))).first()
    assert stats["total_pairs"] == 4 and stats["duplicate_pairs"] == 2


def test_scores(spark):
    row = spark.range(1).select(scoring.refactor_score(F.lit(100), F.lit(1)).alias("one"), scoring.refactor_score(F.lit(100), F.lit(3)).alias("three"), scoring.similarity_percent(F.lit(1.0), F.lit(None), F.lit(0.5)).alias("p")).first()
    assert abs(row["one"] - 169.3147) < 1e-3 and abs(row["three"] - 286.3553) < 1e-3 and row["p"] == 80.0


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [0.0, 0.0]), (10, None)], "id long, v array<float>")
    got = vectors.knn(df, df.where("id = 0"), "id", "v", 2).orderBy("rank").collect()
    assert [r["match"] for r in got] == [1, 2]
    assert vectors.neighbours(df, df.where("id = 4"), "id", "v", 0.9).count() == 2
    with pytest.raises(ValueError):
        vectors.check_metric("dice")


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    new = spark.sql("SELECT 'a.py:1:3' block_id, 'a.py' file_path, 1 start_line, 3 end_line, 'python' lang, array('x') tokens, 'h' norm_hash, 0L churn, 'chunk' node_type, 0.1D complexity, timestamp'2024-01-01' updated_at")
    s.upsert_blocks(new)
    s.upsert_blocks(new.withColumn("node_type", F.lit("other")))
    row = s.read("blocks").first()
    assert row["churn"] == 1 and row["node_type"] == "chunk"
    s.set_metadata("k", "v")
    assert s.get_metadata("k") == "v" and s.get_metadata("none") is None
    s.upsert_findings(spark.sql("SELECT 'f' finding_id, 'a.py:1:3' src, 'b' match, map('x', 1D) scores, 'near_miss' type, 1D confidence, 300D refactor_score, 'active' status, timestamp'2024-01-01' created_at"))
    s.suppress("f", "seen")
    assert s.read("findings").first()["status"] == "suppressed"
    s.delete_files(spark.sql("SELECT 'a.py' path"))
    assert s.read("blocks").count() == 0 and s.read("findings").count() == 0
    s.initialize()
    stats = s.statistics()
    assert stats["total_blocks"] == 0 and stats["size_mb"] > 0 and stats["initialized_at"] and stats["schema_version"] == "1.0.0"


def test_snapshots_and_stale_blocks(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    row = lambda bid, end: spark.sql(f"SELECT '{bid}' block_id, 'a.py' file_path, 1 start_line, {end} end_line, 'python' lang, array('x') tokens, 'h' norm_hash, 0L churn, 'chunk' node_type, 0.1D complexity, timestamp'2024-01-01' updated_at")
    s.upsert_blocks(row("a.py:1:3", 3))
    held = s.read("blocks")
    batch = spark.sql("SELECT 'a.py' path, 'modified' event_type, timestamp'2024-01-01' ts, CAST(NULL AS STRING) old_path")
    events.apply_batch(s, batch, lambda paths: row("a.py:1:5", 5))
    assert [r["block_id"] for r in s.read("blocks").collect()] == ["a.py:1:5"]
    assert held.count() == 1, "a reader of the former snapshot can end"
    moved = spark.sql("SELECT 'b.py' path, 'moved' event_type, timestamp'2024-01-01' ts, 'a.py' old_path")
    events.apply_batch(s, moved, lambda paths: row("b.py:1:5", 5).withColumn("file_path", F.lit("b.py")))
    assert [r["file_path"] for r in s.read("blocks").collect()] == ["b.py"]
    assert s.delete_blocks(spark.sql("SELECT 'b.py' path")) == 1 and s.read("blocks").count() == 0
    s.save_vectors(spark.sql("SELECT 'x' block_id, array(1F, 2F) embedding"))
    assert s.load_vectors().count() == 1 and s.get_metadata("vectors:dimension") == "2"
    s.set_metadata("vectors:total", "7")
    with pytest.warns(UserWarning):
        assert s.load_vectors().count() == 0
    s.compact("embeddings")
    s.clear()
    assert s.read("metadata").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "build").mkdir()
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "build" / "b.py").write_text("y = 1\n")
    (tmp_path / "c.md").write_text("no")
    (tmp_path / ".gitignore").write_text("# c\nd*.js\n!d1.js\n")
    (tmp_path / "d1.js").write_text("let a")
    (tmp_path / "d2.js").write_text("let b")
    got = {r["path"]: r["lang"] for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "d1.js": "javascript"}


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "good.py").write_text("x = 1\n")
    (tmp_path / "latin.py").write_bytes("s = 'caf\xe9'\n".encode("latin-1"))
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "deep.js").write_text("let a")
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "t.py").write_text("x = 2\n")
    got = {r["path"]: (r["content"], r["error"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"good.py": ("x = 1\n", None), "latin.py": (None, "not UTF-8")}
    assert not any("node_modules" in p for p in files.walk(spark, str(tmp_path), files.ignore_rules()))
    rows, errors = files.index_files(spark, str(tmp_path), ["good.py", "none.py", "tests"])
    assert [r["path"] for r in rows.collect()] == ["good.py"] and errors == ["none.py: no such file", "tests: not a file"]
    assert len(files.DEFAULT_IGNORES) == 41
    memory = files.from_contents(spark, [("a.py", "x"), ("b.md", "y")]).collect()
    assert [r["lang"] for r in memory] == ["python", None]
    files.write_json(str(tmp_path / "x" / "y.json"), {"a": 1})
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(str(tmp_path / "x" / "y.json")) == {"a": 1} and files.read_json(str(tmp_path / "bad.json")) == files.read_json("/no") == {}


def test_blocks():
    body = "\n".join(f"    total = total + values[{i}]" for i in range(8))
    text = f"import os\n\ndef f(values):\n    total = 0\n{body}\n    return total\n" + "\n".join(f"v{i} = w{i} + {i}" for i in range(40)) + "\n"
    got = blocks.extract("a.py", "python", text)
    assert got[0][8] == "function_definition" and got[0][2] == 3 and all(b[8] == "chunk" for b in got[1:]) and all(len(b[6]) <= 120 for b in got[1:])
    script = "function f(a) {\n" + "\n".join(f"  let x{i} = a + {i};" for i in range(9)) + "\n  return a;\n}\nconst y = 1;\n"
    assert blocks.extract("a.js", "javascript", script)[0][8] == "function_declaration"
    assert blocks.extract("a.py", "python", "def broken(:\n") == [] and blocks.extract("a.py", "python", None) == []


def test_blocks_of_odd_code():
    inner = "\n".join(f"    let x{i} = a + {i};" for i in range(12))
    kinds = {"export function f(a) {\n%s\n}": "export_statement", "const g = function (a) {\n%s\n};": "function_expression", "const h = (a) => {\n%s\n};": "arrow_function", "class C {\n%s\n}": "class_declaration", "interface I {\n%s\n}": "interface_declaration", "type T = {\n%s\n};": "type_alias_declaration"}
    for text, kind in kinds.items():
        assert [b[8] for b in blocks.extract("a.ts", "typescript", text % inner)] == [kind]
    small = "class K {\n  m(a) {\n%s\n  }\n}" % inner
    assert blocks.extract("a.ts", "typescript", small, min_tokens=10**6) == []
    body = "\n".join(f"    total = total + values[{i}]" for i in range(12))
    broken = f"print 'x'\n\ndef f(values):\n{body}\n    return total\n"
    assert [(b[2], b[8]) for b in blocks.extract("a.py", "python", broken)] == [(3, "function_definition")]
    assert len(blocks.extract("a.js", "javascript", "{" * 1500 + "}" * 1500)) == 1
    assert blocks.extract("a.py", "python", "x = " + "-" * 100_000 + "1")
    wide = 's = "äöü"\n' + f"def f(values):\n{body}\n"
    b = blocks.extract("a.py", "python", wide)[0]
    assert wide.encode()[b[4] : b[5]].decode() == b[7].rstrip("\n")


def code(name, n=14, extra=""):
    return f"def {name}(values):\n    total = 0\n" + "\n".join(f"    total = total + values[{i}] * {i}" for i in range(n)) + f"\n{extra}    return total\n"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    tree, cache = tmp_path / "tree", str(tmp_path / "cache")
    tree.mkdir()
    for name in "abc":
        (tree / f"{name}.py").write_text(code(name))
    (tree / "latin.py").write_bytes(b"s = '\xe9'\n")
    # sessions end with the command; the tests' session stays.
    assert cli.main(["--cache-dir", cache, "-v", "index", str(tree)]) == 0
    said = capsys.readouterr().out
    assert "4 files, 3 blocks" in said and "latin.py: not UTF-8" in said
    s = store.Store(spark, cache)
    assert s.read("files").count() == 4 and s.read("signatures").count() == 3 and "tests/" in json.loads(s.get_metadata("ignore_patterns"))
    rows = {r["block_id"]: r["norm_hash"] for r in s.read("blocks").collect()}
    assert len(set(rows.values())) == 1, "equal but for names: one normalised hash"
    assert cli.main(["--cache-dir", cache, "index", str(tree)]) == 0 and "0 files, 0 blocks" in capsys.readouterr().out
    (tree / "b.py").write_text("x = 1\n" + code("b"))
    assert cli.main(["--cache-dir", cache, "index", str(tree)]) == 0 and "1 files, 1 blocks" in capsys.readouterr().out
    assert sorted(r["block_id"] for r in s.read("blocks").collect()) == ["a.py:1:17", "b.py:2:18", "c.py:1:17"]
    out = tmp_path / "out"
    assert cli.main(["--cache-dir", cache, "-v", "scan", str(tree), "--json", str(out / "r.json"), "--markdown", str(tmp_path / "r.md"), "--tau-sem", "0"]) == 0
    assert "findings_generated: 3" in capsys.readouterr().out
    whole = json.loads((out / "r.json").read_text())
    assert whole["summary"]["total"] == 3 and whole["statistics"]["blocks_extracted"] == 3 and whole["statistics"]["files_processed"] == 3
    assert "```python" in (tmp_path / "r.md").read_text() and "+def a(values):" in (tmp_path / "r.md").read_text()
    assert s.read("findings").count() == 3 and set(s.read("findings").first()["scores"]) >= {"overlap_score", "jaccard_score"}
    monkeypatch.setattr(files, "git_changes", lambda root, diff=False: ["c.py"])
    (tree / "c.py").write_text(code("c", extra="    total = total + 1\n"))
    assert cli.main(["--cache-dir", cache, "scan", str(tree), "--changed", "--json", str(out / "c.json")]) == 0
    changed = json.loads((out / "c.json").read_text())["findings"]
    assert {f["src"].split(":")[0] for f in changed} == {"c.py"} and {f["match"].split(":")[0] for f in changed} >= {"a.py", "b.py"}
    assert cli.main(["--cache-dir", cache, "status"]) == 0 and "total_files: 4" in capsys.readouterr().out
    assert cli.main(["--cache-dir", cache, "-q", "scan", str(tree), "--budget-ms", "1", "--json", str(out / "n.json")]) == 2


def test_json_rpc(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    for name in "ab":
        (tree / f"{name}.py").write_text(code(name))
    service = server.Service(spark, str(tmp_path / "cache"))
    out = io.StringIO()
    ask = lambda method, **params: list(service.answers(json.dumps({"id": 7, "method": method, "params": params})))
    assert ask("scan_repo")[0]["error"]["code"] == -32603, "nothing is indexed yet"
    assert ask("index_repo", root=str(tree))[0]["result"]["stats"]["blocks_indexed"] == 2
    found = ask("scan_repo", options={"tau_semantic": 0})[0]["result"]
    assert [(f["unit"]["path"], f["matches"][0]["path"]) for f in found] == [("b.py", "a.py")] and ask("scan_repo", scope="semantic_only")[0]["result"] == []
    told = ask("explain", finding_id=found[0]["id"])[0]["result"]
    assert [c["path"] for c in told["codeframes"]] == ["b.py", "a.py"] and "def b(values)" in told["codeframes"][0]["code"] and told["scores"]["overlap_score"] == 1.0
    assert ask("index_status")[0]["result"]["passes"] == {"0": "100%", "1": "50%", "2": "0%"} and not ask("index_status")[0]["result"]["dirty"]
    (tree / "c.py").write_text(code("c"))
    streamed = [a["result"]["type"] for a in ask("scan_changed", paths=["c.py"])]
    assert streamed == ["progress", "finding", "finding", "complete", "stream_complete"] and ask("index_status")[0]["result"]["dirty"]
    assert ask("configure", policy_json={"min_tokens": 9, "num_hashes": 1})[0]["result"] == {"ok": True} and (service.config.min_tokens, service.config.num_hashes) == (9, 128)
    assert ask("explain", finding_id="none")[0]["error"]["code"] == -32603 and ask("nothing")[0]["error"]["code"] == -32601
    assert ask("clear_index")[0]["result"] == {"ok": True} and service.store.read("blocks").count() == 0
    service.serve(["not json\n", "\n", '{"id": 1, "method": "configure", "params": {"policy_json": {}}}\n'], out)
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first["error"]["code"] == -32700 and second == {"jsonrpc": "2.0", "id": 1, "result": {"ok": True}}


def test_git_changes(tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init")
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("x = 1\n")
    run("add", ".")
    run("commit", "-m", "x")
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "n.py").write_text("x = 3\n")
    (tmp_path / "b.py").unlink()
    assert files.git_changes(str(tmp_path), diff=True) == ["a.py"]
    run("add", "n.py")
    assert sorted(files.git_changes(str(tmp_path))) == ["a.py", "n.py"] and files.git_changes("/none") == []


def test_embedder(spark):
    df = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x", "y", "z"]), ("c", ["q", "r"]), ("d", None)], "block_id string, tokens array<string>")
    v = vectors.embed_blocks(df, vectors.hashed_counts(64)).cache()
    got = {(r["query"], r["match"]) for r in vectors.batch_similarity(v, v, tau=0.99).collect()}
    assert got == {("a", "b"), ("b", "a")} and vectors.rebuild(v, "block_id").count() == 4 and vectors.clear(v).count() == 0
    with pytest.raises(Exception, match="not"):
        vectors.embed_blocks(df, vectors.Embedder("bad", 3, lambda: lambda rows: [[0.0]] * len(rows))).collect()


def test_index_upkeep(spark):
    df = spark.createDataFrame([(i, [f"w{i}{j}" for j in range(9)]) for i in range(4)], "id long, t array<string>")
    sigs = minhash.signatures(df, "id", F.col("t"))
    assert minhash.get(sigs, "id", 2).count() == 1 and minhash.get(sigs, "id", 9).count() == 0 and minhash.clear(sigs).count() == 0
    stats = minhash.index_statistics(minhash.clear(sigs), "id").first()
    assert stats["total_buckets"] == 0 and stats["avg_bucket_size"] == 0.0 and stats["signature_size"] == 128 and stats["estimated_threshold"] == 0.707


def test_events(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", p, t) for i, (s, p, t) in enumerate([(0, "a.py", "modified"), (1, "a.py", "deleted"), (5, "b.py", "created"), (6, "c.tmp", "created")])]
    df = spark.createDataFrame(rows, "event_id long, ts string, path string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    got = events.debounced(df).orderBy("session", "path").collect()
    assert [(r["session"], r["path"], r["event_type"], r["n_events"]) for r in got] == [(0, "a.py", "deleted", 2), (1, "b.py", "created", 1), (1, "c.tmp", "created", 1)]
    assert df.where(events.relevant(F.col("path"), F.col("event_type"))).count() == 3
    assert [r["accepted"] for r in events.rate_limited(df, 2, 5).orderBy("event_id").collect()] == [True, True, True, True]


def test_stream_sessions(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", "a.py", "modified") for s in (0, 1, 9)] + [("2024-01-01 00:05:00", "z.py", "created")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts string, path string, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = events.debounced_stream(spark.readStream.schema("ts timestamp, path string, event_type string").parquet(src))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n_events"] for r in spark.table("sessions").collect()) == [1, 2]


def test_report(spark, tmp_path):
    df = spark.sql("SELECT 'f' finding_id, 'a' src, 'b' match, 'near_miss' type, 600D refactor_score, 'x/a.py' file_path")
    assert "## x" in report.markdown(df, {"lsh": 1}) and '"total": 1' in report.as_json(df, {})
    c = Config(min_tokens=60)
    c.save(tmp_path / "c.json")
    assert Config.load(tmp_path / "c.json").min_tokens == 60
    with pytest.raises(TypeError):
        (tmp_path / "bad.json").write_text('{"nope": 1}')
        Config.load(tmp_path / "bad.json")


def test_reports_hold_all_findings(spark):
    rows = spark.range(10_500).selectExpr("concat('f', id) finding_id", "concat('a', id) src", "'b' match", "'near_miss' type", "600D + id refactor_score", "concat('d', id % 600, '/a.py') file_path")
    text, whole = report.markdown(rows, {}), json.loads(report.as_json(rows, {"blocks": 1}))
    assert text.count("\n- `") == 10_500 and text.count("\n## ") == 600
    assert [r["src"] for r in whole["findings"]] == [f"a{i}" for i in reversed(range(10_500))]
    assert whole["summary"]["total"] == 10_500 and whole["statistics"] == {"blocks": 1}
    assert json.loads(report.as_json(rows.where("false"), {}))["findings"] == []


def test_streams_by_root(spark, tmp_path):
    """A burst goes on with any event of its root; the rate limit counts attempts."""
    rows = [("r", f"2024-01-01 00:00:{s:02d}", p, e) for s, p, e in [(0, "a.py", "modified"), (1, "b.py", "created"), (2, "a.py", "deleted"), (9, "a.py", "created")]] + [("r", "2024-01-01 00:05:00", "z.py", "created")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "root string, ts string, path string, event_type string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("root string, ts timestamp, path string, event_type string").parquet(src)
    for name, df in (("bursts", events.burst_stream(stream)), ("limited", events.rate_limited_stream(stream, 2, 60))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    # Timeouts by the clock keep this one going, so it is stopped from here.
    q = events.batched_stream(stream, count=3).writeStream.format("memory").queryName("batches").outputMode("append").start()
    until = time.time() + 40
    while time.time() < until and spark.table("batches").count() < 3:
        time.sleep(0.5)
    q.stop()
    got = {(str(r["started"])[-8:], r["path"], r["event_type"], r["n_events"]) for r in spark.table("bursts").collect()}
    assert got == {("00:00:00", "a.py", "deleted", 2), ("00:00:00", "b.py", "created", 1), ("00:00:09", "a.py", "created", 1)}
    assert [r["accepted"] for r in spark.table("limited").orderBy("ts").collect()] == [True, True, False, False, True]
    assert {(r["path"], r["event_type"]) for r in spark.table("batches").collect()} == {("a.py", "created"), ("b.py", "created"), ("z.py", "created")}


def test_file_events_and_watcher(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "node_modules").mkdir(parents=True)
    (tree / "a.py").write_text("x = 1\n")
    (tree / "b.py").write_text("x = 1\n")
    reader = events.FileEventReader(str(tree), [])
    before = reader.initialOffset()
    (tree / "a.py").write_text("x = 22\n")
    (tree / "b.py").unlink()
    (tree / "c.py").write_text("x = 3\n")
    (tree / "node_modules" / "n.js").write_text("x")
    rows, after = reader.read(before)
    assert [(r[1], r[2]) for r in rows] == [("b.py", "deleted"), ("a.py", "modified"), ("c.py", "created")] and sorted(after["files"]) == ["a.py", "c.py"]
    assert [(r[1], r[2]) for r in reader.readBetweenOffsets(before, after)] == [("b.py", "deleted"), ("a.py", "modified"), ("c.py", "created")]

    events.register(spark)
    seen, w = [], events.Watcher()
    stream = lambda: spark.readStream.format("file_events").load(str(tree))
    take = lambda df, i: seen.extend((r["path"], r["event_type"]) for r in df.collect())
    w.start("tree", stream(), take, str(tmp_path / "mark"))
    with pytest.raises(ValueError):
        w.start("tree", stream(), take, str(tmp_path / "mark"))
    w.queries["tree"].processAllAvailable()
    (tree / "d.py").write_text("x = 4\n")
    w.queries["tree"].processAllAvailable()
    assert ("d.py", "created") in seen and w.status()["tree"]["active"]
    w.pause("tree")
    assert w.status()["tree"]["paused"] and not w.status()["tree"]["active"]
    (tree / "e.py").write_text("x = 5\n")
    w.resume()
    w.queries["tree"].processAllAvailable()
    assert ("e.py", "created") in seen
    w.stop()
    assert w.status() == {}


def test_messages_and_resources(spark):
    rows = spark.sql("SELECT 'f' finding_id, 'a' src, 'b' match, 'near_miss' type, 600D refactor_score, 0.9D jaccard_score, 0.8D overlap_score, 'active' status")
    said = list(report.messages(rows))
    assert [m["type"] for m in said] == ["progress", "finding", "complete"] and list(report.messages(rows.where("false")))[-1] == {"type": "info", "total": 0}
    blocks_ = spark.sql("SELECT 'a' block_id, 'python' lang, 'a.py' file_path, 1 start_line, 9 end_line UNION ALL SELECT 'b', 'python', 'b.py', 2, 8")
    got = json.loads(scoring.resource(rows, blocks_).first()["json"])
    assert got == {"id": "f", "unit": {"lang": "python", "path": "a.py", "start": 1, "end": 9}, "matches": [{"path": "b.py", "start": 2, "end": 8, "scores": {"jaccard": 0.9, "overlap": 0.8, "R": 600.0}, "type": "near_miss"}]}
    assert scoring.touching(rows, "b").count() == 1 and scoring.in_scope(rows, "semantic_only").count() == 0 and scoring.in_scope(rows, "none").count() == 1
    assert "+two" in report.diff_text("one", "two") and report.side_by_side("a\nbb", "c") == "a  | c\nbb |"
    assert report.size_text(1536) == "1.5 KB"
