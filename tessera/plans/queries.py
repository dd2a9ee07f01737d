"""Registered queries over the driver's tables and their DuckDB SQL. A document is a block, its source a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import tokens as K
from tessera.operators import minhash, report, scoring, store, vectors, verify
from tessera.operators.tables import settled
from tessera.plans import scan
from tessera.sources import files
from tessera.streaming import events as E

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # A single file is one partition; texts are dealt out before they are split into words.
    return rows.repartition(spark.sparkContext.defaultParallelism) if name == "documents" and rows.rdd.getNumPartitions() < 2 else rows


# Shared SQL ------------------------------------------------------------------------------------------------------------
WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')"
SHINGLES = """list_distinct(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' ')) ELSE [array_to_string(t, ' ')] END)"""
PAIRS = ",".join(f"({i},{a},{b})" for i, (a, b) in enumerate(minhash.coefficients()))


def signature_sql(source: str, key: str, name: str) -> str:
    return f"""{name}_s AS (SELECT {key} AS k, unnest({SHINGLES}) AS s FROM (SELECT {key}, {WORDS} AS t FROM {source})),
{name}_h AS (SELECT k, ('0x' || substr(md5(s), 1, 8))::BIGINT % {minhash.PRIME} AS h FROM {name}_s),
{name}_m AS (SELECT k, i, min((a * h + b) % {minhash.PRIME}) AS m FROM {name}_h, f GROUP BY k, i),
{name} AS (SELECT k, list(m ORDER BY i) AS signature FROM {name}_m GROUP BY k)"""


COEFFICIENTS = f"f(i, a, b) AS (VALUES {PAIRS})"


def bands_sql(source: str, name: str) -> str:
    return f"{name} AS (SELECT k, band, md5(array_to_string(signature[band * 8 + 1 : band * 8 + 8], ',')) AS bucket FROM {source}, range(16) r(band))"


def estimate(x: str, y: str) -> str:
    return f"len(list_filter(list_zip({x}, {y}), lambda p: p[1] = p[2])) / 128.0"


CANDIDATES = f"""WITH {COEFFICIENTS}, {signature_sql('documents', 'doc_id', 'sig')},
rep AS (SELECT k, signature FROM sig), {bands_sql('rep', 'bands')},
meet AS (SELECT DISTINCT a.k AS src, b.k AS match FROM bands a JOIN bands b ON a.band = b.band AND a.bucket = b.bucket AND a.k > b.k),
scored AS (SELECT src, match, {estimate('x.signature', 'y.signature')} AS similarity FROM meet JOIN rep x ON x.k = src JOIN rep y ON y.k = match),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, match) AS r FROM scored) WHERE r <= 50)"""


# MinHash ---------------------------------------------------------------------------------------------------------------
def document_signatures(spark, sf_dir) -> DataFrame:
    return minhash.signatures(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", K.words(F.col("text")))


def member_candidates(spark, sf_dir) -> DataFrame:
    return minhash.member_candidates(settled(document_signatures(spark, sf_dir)), "doc_id")


@query(CANDIDATES + " SELECT src, match, round(similarity, 6) AS similarity FROM cand")
def near_duplicates(spark, sf_dir):
    """Candidate pairs of all documents, copies included, later to earlier, the 50 most alike of each."""
    return member_candidates(spark, sf_dir).select("src", "match", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {COEFFICIENTS}, {signature_sql('documents', 'doc_id', 'sig')} SELECT k AS doc_id, md5(array_to_string(signature, ',')) AS digest, min(k) OVER (PARTITION BY signature) AS class_id FROM sig")
def minhash_signatures(spark, sf_dir):
    """A digest of each signature and the class it belongs to."""
    sigs = document_signatures(spark, sf_dir).withColumn("digest", F.md5(F.array_join("signature", ",").cast("binary"))).select("doc_id", "digest")
    return sigs.join(sigs.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "digest").select("doc_id", "digest", "class_id")


@query(f"WITH {COEFFICIENTS}, {signature_sql('documents', 'doc_id', 'sig')}, {bands_sql('sig', 'bands')}, n AS (SELECT band, bucket, count(*) AS n FROM bands GROUP BY ALL) SELECT count(*) AS total_buckets, count(*) AS non_empty_buckets, round(avg(n), 2) AS avg_bucket_size, max(n) AS max_bucket_size, (SELECT count(*) FROM sig) AS total_blocks, CAST(16 AS INTEGER) AS total_bands, CAST(0.707 AS DOUBLE) AS estimated_threshold, CAST(128 AS INTEGER) AS signature_size, CAST(5 AS INTEGER) AS shingle_size FROM n")
def lsh_index_statistics(spark, sf_dir):
    return minhash.index_statistics(document_signatures(spark, sf_dir), "doc_id")


@query("SELECT s, round(1 - pow(1 - pow(s, 8), 16), 9) AS p FROM (SELECT i / 20.0 AS s FROM range(21) r(i))")
def lsh_s_curve(spark, sf_dir):
    """The chance that two blocks meet, by their similarity."""
    return spark.range(21).select((F.col("id") / 20.0).alias("s")).withColumn("p", F.round(minhash.collision_probability(F.col("s")), 9))


#: The new set of an incremental search: each labelled document without its first word, under an id of its own.
EDITED = r"edited AS (SELECT -1 - doc_id AS doc_id, regexp_replace(coalesce(text, ''), '^[^ ]* ', '') AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"
INCREMENTAL = f"""WITH {COEFFICIENTS}, {EDITED}, {signature_sql('documents', 'doc_id', 'sig')}, {signature_sql('edited', 'doc_id', 'ben')}, {bands_sql('sig', 'db')}, {bands_sql('ben', 'bb')},
meet AS (SELECT DISTINCT a.k AS src, b.k AS match FROM bb a JOIN db b ON a.band = b.band AND a.bucket = b.bucket),
found AS (SELECT src, match, {estimate('x.signature', 'y.signature')} AS similarity FROM meet JOIN ben x ON x.k = src JOIN sig y ON y.k = match)"""


@query(INCREMENTAL + " SELECT src, match, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, match) AS r FROM found) WHERE r <= 50")
def incremental_candidates(spark, sf_dir):
    """Edited documents against the index of all documents, as an incremental scan meets it."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    edited = table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi").select((-1 - F.col("doc_id")).alias("doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), "^[^ ]* ", "").alias("text"))
    new = minhash.signatures(edited, "doc_id", K.words(F.col("text")))
    found = minhash.index_candidates(settled(new), settled(document_signatures(spark, sf_dir)), "doc_id")
    return found.select("src", "match", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {COEFFICIENTS}, {signature_sql('documents', 'doc_id', 'sig')}, {signature_sql('benchmark', 'item_id', 'ben')}, up AS (SELECT k, signature FROM ben UNION ALL SELECT k, signature FROM sig WHERE k NOT IN (SELECT k FROM ben)) SELECT k AS doc_id, md5(array_to_string(signature, ',')) AS digest FROM up WHERE k NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def lsh_index_upkeep(spark, sf_dir):
    """The index after benchmark items replaced the documents of the same ids and toxic documents were removed."""
    new = minhash.signatures(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id", K.words(F.col("text")))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    index = minhash.remove(minhash.update(document_signatures(spark, sf_dir), new, "doc_id"), gone, "doc_id")
    return index.select("doc_id", F.md5(F.array_join("signature", ",").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len({SHINGLES}) AS BIGINT) AS n_shingles FROM (SELECT doc_id, {WORDS} AS t FROM documents)")
def shingle_counts(spark, sf_dir):
    sizes = F.transform(F.array(K.words(F.col("text"))), lambda t: F.struct(F.size(t).cast("long").alias("n_words"), F.size(K.shingles(t)).cast("long").alias("n_shingles")))[0]
    return table(spark, sf_dir, "documents").select("doc_id", sizes.alias("s")).select("doc_id", "s.n_words", "s.n_shingles")


# Normalisation ---------------------------------------------------------------------------------------------------------
def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ROLE = f"""CASE WHEN trim(token) = '' OR token IN ({_listed(K.KEYWORDS['python'])}) OR token IN ({_listed(K.STRUCTURAL)}) THEN NULL
WHEN regexp_matches(token, '{K.STRING.replace("'", "''")}') THEN 'STR' WHEN regexp_matches(token, '{K.NUMBER}') THEN 'NUM' WHEN regexp_matches(token, '{K.BOOLEAN}') THEN 'BOOL'
WHEN regexp_matches(token, '{K.TYPE}') THEN 'TYPE' WHEN regexp_matches(token, '{K.DUNDER}') THEN 'FUNC' WHEN regexp_matches(token, '{K.IDENTIFIER}') THEN 'VAR' END"""
NORMAL = rf"""WITH tok AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{K.TOKEN}') AS l FROM documents)),
roled AS (SELECT *, {ROLE} AS role FROM tok),
norm AS (SELECT *, CASE WHEN role IS NULL THEN token WHEN role IN ('STR', 'NUM', 'BOOL') THEN role || '_LIT' ELSE role || '_' || row_number() OVER (PARTITION BY doc_id, role ORDER BY pos) END AS norm FROM roled)"""


def document_tokens(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return K.positions(rows.select("doc_id", K.tokens(F.col("text")).alias("toks"), F.lit("python").alias("code")), "doc_id", "toks", "code")


@query(NORMAL + " SELECT coalesce(role, 'kept') AS role, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM norm GROUP BY 1")
def token_roles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(K.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    roled = rows.withColumn("role", F.coalesce(K.role(F.col("token"), F.lit("python")), F.lit("kept")))
    return roled.groupBy("role").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


@query(NORMAL + " SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (norm <> token) AS n_changed, sha256(string_agg(norm, ' ' ORDER BY pos)) AS hash_signature, substr(sha256(string_agg(norm, ' ' ORDER BY pos)), 1, 16) AS short_hash, count(*) / 10.0 AS complexity FROM norm GROUP BY doc_id")
def normalized_documents(spark, sf_dir):
    rows = document_tokens(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("o"), F.count_if(F.col("norm") != F.col("token")).alias("n_changed"))
    toks = F.transform("o", lambda x: x["norm"])
    return rows.select("doc_id", F.size("o").cast("long").alias("n_tokens"), "n_changed", K.hash_signature(toks).alias("hash_signature"), K.short_hash(toks).alias("short_hash"), K.complexity(toks).alias("complexity"))


@query(NORMAL + " SELECT doc_id, token, max_by(norm, pos) AS norm, count(*) AS n FROM norm WHERE norm <> token GROUP BY doc_id, token")
def token_mapping(spark, sf_dir):
    """What each changed token of a document became last."""
    return document_tokens(spark, sf_dir).where("norm <> token").groupBy("doc_id", "token").agg(F.max_by("norm", "pos").alias("norm"), F.count("*").alias("n"))


def document_blocks(spark, sf_dir, mappings: bool = True) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("python").alias("lang"), K.tokens(F.col("text")).alias("tokens"))
    return K.normalize(rows, "doc_id", mappings=mappings)


@query(NORMAL + " SELECT doc_id, norm, md5(string_agg(token, ' ' ORDER BY pos)) AS originals_md5, count(*) AS n FROM norm WHERE norm <> token GROUP BY doc_id, norm")
def reverse_mapping(spark, sf_dir):
    """What each normalised token of a document stands for, repeats kept, in order."""
    rows = document_blocks(spark, sf_dir).select("doc_id", F.explode("reverse_mapping").alias("norm", "o"))
    return rows.select("doc_id", "norm", F.md5(F.array_join("o", " ").cast("binary")).alias("originals_md5"), F.size("o").cast("long").alias("n"))


@query(NORMAL + """, m AS (SELECT doc_id, string_agg(token || ' -> ' || norm, chr(10) ORDER BY token) AS pairs FROM (SELECT doc_id, token, max_by(norm, pos) AS norm FROM norm WHERE norm <> token GROUP BY doc_id, token) GROUP BY doc_id),
g AS (SELECT doc_id, list(norm ORDER BY pos) AS l FROM norm GROUP BY doc_id)
SELECT doc_id, md5('hash ' || substr(sha256(coalesce(array_to_string(l, ' '), '')), 1, 16) || chr(10) || coalesce(array_to_string(l[1:50], ' '), '') || CASE WHEN len(l) > 50 THEN ' ...' ELSE '' END || chr(10) || coalesce(pairs, '')) AS pretty_md5 FROM documents LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)""")
def pretty_documents(spark, sf_dir):
    """A digest of each normalised document as it is shown: short hash, first tokens, sorted mapping."""
    shown = K.pretty(F.col("normalized_tokens"), F.col("token_mapping"), F.col("hash_signature"))
    return document_blocks(spark, sf_dir).select("doc_id", F.md5(shown.cast("binary")).alias("pretty_md5"))


@query(f"SELECT h AS hash_signature, count(*) AS n_documents, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(array_to_string({WORDS}, ' ')) AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", K.hash_signature(K.words(F.col("text"))).alias("hash_signature"))
    return rows.groupBy("hash_signature").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_id")).where("n_documents > 1")


# Verification ----------------------------------------------------------------------------------------------------------
NEXT = f"""w AS (SELECT doc_id, {WORDS} AS t FROM documents), p AS (SELECT a.doc_id AS src, b.doc_id AS match, a.t AS a, b.t AS b FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)"""


def adjacent(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", K.words(F.col("text")).alias("t"))
    left = rows.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("match"), F.col("t").alias("a"))
    return left.join(rows.select(F.col("doc_id").alias("match"), F.col("t").alias("b")), "match").select("src", "match", "a", "b")


def _aligned(cell: str, first: str) -> str:
    """The last cell of the alignment table of lists sa and sb, by antidiagonals: p is the last one, q the one before."""
    each = "list_transform(range(0, len(sa) + 1), lambda i: {})"
    return f"""list_reduce(list_transform(range(1, len(sa) + len(sb) + 1), lambda d: {{'d': d, 'p': CAST([] AS INTEGER[]), 'q': CAST([] AS INTEGER[])}}),
lambda s, x: {{'d': x.d, 'p': {each.format(f'CAST({cell} AS INTEGER)')}, 'q': s.p}}, {{'d': CAST(0 AS BIGINT), 'p': {each.format(f'CAST({first} AS INTEGER)')}, 'q': {each.format('CAST(0 AS INTEGER)')}}}).p[-1]"""


LCS = _aligned("CASE WHEN i = 0 OR i >= x.d OR x.d - i > len(sb) THEN 0 ELSE greatest(s.p[i], s.p[i + 1], s.q[i] + CASE WHEN sa[i] = sb[x.d - i] THEN 1 ELSE 0 END) END", "0")
EDIT = _aligned("CASE WHEN i = 0 OR i = x.d THEN x.d WHEN i > x.d OR x.d - i > len(sb) THEN 1000000 ELSE least(s.p[i] + 1, s.p[i + 1] + 1, s.q[i] + CASE WHEN sa[i] = sb[x.d - i] THEN 0 ELSE 1 END) END", "0")
#: The metrics of pairs p (src, match, a, b and others); ``keep`` names the others.
METRICS = """al AS (SELECT *, len(a) AS n, len(b) AS m, greatest(len(a), len(b)) AS longest, CASE WHEN a = b THEN len(a) WHEN least(len(a), len(b)) = 0 THEN 0 ELSE {lcs} END AS lcs, CASE WHEN a = b THEN 0 WHEN least(len(a), len(b)) = 0 THEN greatest(len(a), len(b)) ELSE {edit} END AS ed,
  len(list_distinct(a)) AS na, len(list_distinct(b)) AS nb, len(list_intersect(a, b)) AS shared FROM (SELECT *, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS sa, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS sb FROM {pairs})),
me AS (SELECT *, CASE WHEN longest = 0 THEN 1.0 ELSE CAST(lcs AS DOUBLE) / longest END AS overlap_score, CASE WHEN na + nb = 0 THEN 1.0 ELSE CAST(shared AS DOUBLE) / (na + nb - shared) END AS jaccard_score,
  CASE WHEN longest = 0 THEN 0.0 WHEN least(n, m) = 0 THEN 1.0 ELSE CAST(ed AS DOUBLE) / longest END AS edit_density, CAST(na + nb - 2 * shared AS INTEGER) AS token_diff_count FROM al),
ver AS (SELECT *, overlap_score >= 0.75 OR (overlap_score >= 0.6 AND edit_density <= 0.25) OR similarity_confidence >= 0.7 AS is_duplicate FROM (SELECT *, CASE WHEN overlap_score <= 0 OR jaccard_score <= 0 OR greatest(0.0, 1 - edit_density) <= 0 THEN 0.0 ELSE 1 / (CAST(0.5 AS DOUBLE) / overlap_score + CAST(0.3 AS DOUBLE) / jaccard_score + CAST(0.2 AS DOUBLE) / greatest(0.0, 1 - edit_density)) END AS similarity_confidence FROM me))"""


def verified_sql(pairs: str) -> str:
    return METRICS.format(lcs=LCS, edit=EDIT, pairs=pairs)


@query(f"WITH {NEXT}, s AS (SELECT src, match, len(list_distinct(a)) AS na, len(list_distinct(b)) AS nb, len(list_intersect(a, b)) AS shared FROM p) SELECT src, match, CAST(shared AS BIGINT) AS common, CAST(na + nb - 2 * shared AS BIGINT) AS token_diff_count, round(CASE WHEN na + nb = 0 THEN 1.0 ELSE shared / CAST(na + nb - shared AS DOUBLE) END, 9) AS jaccard, round(CASE WHEN greatest(na, nb) > 0 THEN shared / CAST(greatest(na, nb) AS DOUBLE) END, 9) AS structural_similarity FROM s")
def adjacent_differences(spark, sf_dir):
    """Set metrics and the difference of each document and the next. What a pair needs is bound once."""
    def sizes(d):
        return F.struct(F.size(d["common"]).cast("long").alias("common"), F.size(d["different"]).cast("long").alias("token_diff_count"), d["structural_similarity"].alias("s"))

    rows = adjacent(spark, sf_dir).select("src", "match", F.transform(F.array(K.explain_difference(F.col("a"), F.col("b"))), sizes)[0].alias("d"))
    both = F.col("d.common") + F.col("d.token_diff_count")
    jaccard = F.when(both == 0, 1.0).otherwise(F.try_divide(F.col("d.common").cast("double"), both))
    return rows.select("src", "match", "d.common", "d.token_diff_count", F.round(jaccard, 9).alias("jaccard"), F.round("d.s", 9).alias("structural_similarity"))


SHOWN = "round(overlap_score, 9) AS overlap_score, round(jaccard_score, 9) AS jaccard_score, round(edit_density, 9) AS edit_density, round(similarity_confidence, 9) AS similarity_confidence"
SCORES = ("overlap_score", "jaccard_score", "edit_density", "similarity_confidence")


def shown(*scores: str) -> list:
    return [F.round(c, 9).alias(c) for c in scores or SCORES]


@query(f"WITH {NEXT}, {verified_sql('p')} SELECT src, match, {SHOWN}, CAST(ed AS INTEGER) AS edit_distance, CAST(lcs AS INTEGER) AS lcs_length, token_diff_count, is_duplicate FROM ver")
def adjacent_verification(spark, sf_dir):
    """All eight metrics of each document and the next, on whole texts."""
    return verify.verify(adjacent(spark, sf_dir)).select("src", "match", *shown(), "edit_distance", "lcs_length", "token_diff_count", "is_duplicate")


AVERAGES = ", ".join(f"round(avg({c}), 9) AS avg_{c}, round(avg({c}) FILTER (is_duplicate), 9) AS duplicate_avg_{c}" for c in SCORES)


@query(f"WITH {NEXT}, {verified_sql('p')} SELECT count(*) AS total_pairs, count(*) FILTER (is_duplicate) AS duplicate_pairs, round(avg(CASE WHEN is_duplicate THEN 1 ELSE 0 END), 9) AS duplicate_rate, {AVERAGES} FROM ver")
def verification_statistics(spark, sf_dir):
    rows = verify.statistics(verify.verify(adjacent(spark, sf_dir)))
    return rows.select("total_pairs", "duplicate_pairs", *(F.round(c, 9).alias(c) for c in rows.columns[2:]))


VERIFIED = CANDIDATES + f""", w AS (SELECT doc_id, source, lang, {WORDS} AS t FROM documents),
p AS (SELECT src, match, similarity, x.t AS a, y.t AS b, x.source, x.lang FROM cand JOIN w x ON x.doc_id = src JOIN w y ON y.doc_id = match WHERE greatest(len(x.t), len(y.t)) = 0 OR least(len(x.t), len(y.t)) >= 0.6 * greatest(len(x.t), len(y.t))),
{verified_sql('p')}, dup AS (SELECT * FROM ver WHERE is_duplicate)"""


def document_pairs(spark, sf_dir) -> DataFrame:
    """Candidates of all documents that pass verification."""
    rows = table(spark, sf_dir, "documents").select("doc_id", K.words(F.col("text")).alias("tokens"))
    return scan.verified_candidates(member_candidates(spark, sf_dir), rows, "doc_id").where("is_duplicate")


@query(VERIFIED + f" SELECT src, match, round(similarity, 6) AS similarity, {SHOWN}, CAST(ed AS INTEGER) AS edit_distance, CAST(lcs AS INTEGER) AS lcs_length, token_diff_count FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity_confidence DESC, match) AS r FROM dup) WHERE r <= 5")
def verified_duplicates(spark, sf_dir):
    """Candidates that pass verification, the five best of each source."""
    best = verify.best_matches(document_pairs(spark, sf_dir))
    return best.select("src", "match", F.round("similarity", 6).alias("similarity"), *shown(), "edit_distance", "lcs_length", "token_diff_count")


# Scoring and reports ---------------------------------------------------------------------------------------------------
FINDINGS = VERIFIED + """, d AS (SELECT *, len(a) AS tokens, count(*) OVER (PARTITION BY src) AS d FROM dup),
scored2 AS (SELECT *, substr(sha256(src || ':' || match), 1, 16) AS finding_id, tokens * (1 + ln(1 + d)) * (CASE WHEN d > 1 THEN 1 + 0.1 * (d - 1) ELSE 1.0 END) AS score FROM d),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, similarity_confidence DESC, match) AS r5 FROM scored2 WHERE score >= 200) WHERE r5 <= 5)"""


def generated_findings(spark, sf_dir) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), "source", "lang")
    return scoring.generated(document_pairs(spark, sf_dir).join(sources, "src"))


def document_findings(spark, sf_dir) -> DataFrame:
    return scoring.ranked(generated_findings(spark, sf_dir))


@query(FINDINGS + f" SELECT finding_id, src, match, {SHOWN}, round(score, 6) AS refactor_score, 'near_miss' AS type FROM kept")
def findings(spark, sf_dir):
    return document_findings(spark, sf_dir).select("finding_id", "src", "match", *shown(), F.round("refactor_score", 6).alias("refactor_score"), "type")


@query(FINDINGS + " SELECT (SELECT count(*) FROM scored2) AS findings_generated, (SELECT count(*) FROM scored2) - count(*) AS findings_filtered, count(*) AS findings FROM kept")
def scan_counters(spark, sf_dir):
    """Findings made, left out by score or rank, and kept."""
    made = generated_findings(spark, sf_dir)
    marked = made.join(scoring.ranked(made).select("finding_id", F.lit(1).alias("kept")), "finding_id", "left")
    return marked.agg(F.count("*").alias("findings_generated"), F.count_if(F.col("kept").isNull()).alias("findings_filtered"), F.count("kept").alias("findings"))


@query(FINDINGS + " SELECT count(*) AS total, count(*) FILTER (score >= 500) AS high, count(*) FILTER (score >= 200 AND score < 500) AS medium, count(*) FILTER (score < 200) AS low, count(*) FILTER (score >= 100) AS high_priority, round(coalesce(avg(score), 0), 6) AS avg_score, round(coalesce(min(score), 0), 6) AS min_score, round(coalesce(max(score), 0), 6) AS max_score FROM kept")
def report_summary(spark, sf_dir):
    s = scoring.summary(document_findings(spark, sf_dir))
    return s.select("total", "high", "medium", "low", "high_priority", *(F.round(c, 6).alias(c) for c in ("avg_score", "min_score", "max_score")))


@query(FINDINGS + " SELECT source AS folder, count(*) AS n_findings, round(max(score), 6) AS best_score, round(list_sort(list(similarity_confidence))[len(list(similarity_confidence)) // 2 + 1], 9) AS upper_median FROM kept GROUP BY source")
def findings_by_folder(spark, sf_dir):
    rows = document_findings(spark, sf_dir).withColumn("folder", scoring.folder_of(F.concat_ws("/", "source", F.col("src").cast("string"))))
    sums = rows.groupBy("folder").agg(F.count("*").alias("n_findings"), F.round(F.max("refactor_score"), 6).alias("best_score"))
    return sums.join(scoring.upper_medians(rows, "folder", "similarity_confidence"), "folder").select("folder", "n_findings", "best_score", F.round("upper_median", 9).alias("upper_median"))


@query(FINDINGS + " SELECT finding_id, round(score, 6) AS refactor_score FROM kept ORDER BY score DESC, finding_id LIMIT 50")
def top_findings(spark, sf_dir):
    return scoring.top_findings(document_findings(spark, sf_dir)).select("finding_id", F.round("refactor_score", 6).alias("refactor_score"))


@query(FINDINGS + " SELECT finding_id, round(score, 6) AS refactor_score FROM kept ORDER BY score DESC, finding_id LIMIT 5")
def top_five(spark, sf_dir):
    """The five findings that a report names first."""
    return scoring.top_findings(document_findings(spark, sf_dir), limit=5).select("finding_id", F.round("refactor_score", 6).alias("refactor_score"))


@query(FINDINGS + ", q AS (SELECT doc_id, quality FROM labels) SELECT finding_id, CASE WHEN quality = 0 THEN 'suppressed' ELSE 'active' END AS status, CASE WHEN score >= 500 THEN 'high' WHEN score >= 200 THEN 'medium' ELSE 'low' END AS band, score >= 1000 AS high_confidence FROM kept LEFT JOIN q ON q.doc_id = src")
def finding_status(spark, sf_dir):
    """Findings of documents labelled as poor are suppressed."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("src"), "quality")
    rows = document_findings(spark, sf_dir).join(labels, "src", "left")
    return rows.select("finding_id", F.when(F.col("quality") == 0, "suppressed").otherwise("active").alias("status"), scoring.quality_band(F.col("refactor_score")).alias("band"), (F.col("refactor_score") >= 1000).alias("high_confidence"))


@query(FINDINGS + " SELECT scope, count(*) AS n FROM (SELECT unnest(CASE WHEN score >= 1000 THEN ['all', 'high_confidence', 'unknown'] ELSE ['all', 'unknown'] END) AS scope FROM kept) GROUP BY scope")
def finding_scopes(spark, sf_dir):
    """Findings in each scope that has some; an unknown scope is all."""
    rows, out = document_findings(spark, sf_dir), None
    for name in ("all", "high_confidence", "semantic_only", "unknown"):
        own = scoring.in_scope(rows, name).groupBy(F.lit(name).alias("scope")).agg(F.count("*").alias("n"))
        out = own if out is None else out.union(own)
    return out


@query(FINDINGS + ", top AS (SELECT src FROM kept ORDER BY score DESC, finding_id LIMIT 1) SELECT finding_id, src, match FROM kept WHERE src IN (SELECT src FROM top) OR match IN (SELECT src FROM top)")
def findings_touching(spark, sf_dir):
    """The findings on either side of the block with the best finding."""
    rows = document_findings(spark, sf_dir)
    best = rows.orderBy(F.desc("refactor_score"), "finding_id").limit(1).select(F.col("src").alias("best"))
    both = rows.withColumn("side", F.explode(F.array_distinct(F.array("src", "match")))).join(best, F.col("side") == F.col("best"), "left_semi")
    return both.select("finding_id", "src", "match")


@query(FINDINGS + " SELECT finding_id, CAST(src AS VARCHAR) || ':1:' || lines_a AS source_block, CAST(match AS VARCHAR) || ':1:' || lines_b AS match_block, source AS source_folder, source_b AS match_folder FROM kept JOIN (SELECT doc_id AS src, len(string_split(coalesce(text, ''), chr(10))) AS lines_a FROM documents) USING (src) JOIN (SELECT doc_id AS match, source AS source_b, len(string_split(coalesce(text, ''), chr(10))) AS lines_b FROM documents) USING (match)")
def finding_blocks(spark, sf_dir):
    """Findings with both of their blocks, looked up by one join a side."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("folder"), store.block_id(F.col("doc_id").cast("string"), F.lit(1), lines).alias("block"))
    rows = document_findings(spark, sf_dir).select("finding_id", "src", "match")
    for side, name in (("src", "source"), ("match", "match")):
        rows = rows.join(own.select(F.col("doc_id").alias(side), F.col("block").alias(f"{name}_block"), F.col("folder").alias(f"{name}_folder")), side)
    return rows.drop("src", "match")


@query(f"SELECT lang, count(*) AS n_blocks, sum(n) AS total_tokens, round(avg(n), 6) AS avg_tokens, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT lang, len({WORDS}) AS n FROM documents) GROUP BY lang")
def blocks_by_language(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.size(K.words(F.col("text"))).alias("n"))
    sums = rows.groupBy("lang").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("total_tokens"), F.round(F.avg("n"), 6).alias("avg_tokens"))
    return sums.withColumn("share", F.round(scoring.share(F.col("n_blocks")), 6))


@query("SELECT source, count(*) AS files, count(l.doc_id) AS labelled, CAST(floor(count(l.doc_id) * 100 / greatest(count(*), 1)) AS BIGINT) AS labelled_percent, CAST(floor(count(*) FILTER (quality = 1) * 100 / greatest(count(l.doc_id), 1)) AS BIGINT) AS good_percent FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def stage_percentages(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("one"))
    rows = d.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("files"), F.count("one").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    return rows.select("source", "files", "labelled", scoring.pass_percentage(F.col("labelled"), F.col("files")).alias("labelled_percent"), scoring.pass_percentage(F.col("good"), F.col("labelled")).alias("good_percent"))


# Files and the store ---------------------------------------------------------------------------------------------------
EXT = "CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'jsx' WHEN 'de' THEN 'tsx' ELSE 'md' END"


def document_files(spark, sf_dir) -> DataFrame:
    """Documents as files: a path with a suffix by language, a content hash, sizes."""
    ext = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "fr", "jsx").when(F.col("lang") == "de", "tsx").otherwise("md")
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.sha2(text.cast("binary"), 256).alias("hash"), F.octet_length(text).cast("long").alias("size_bytes"), text.alias("text"))


FILES = f"""fl AS (SELECT doc_id, source || '/' || doc_id || '.' || {EXT} AS path, sha256(coalesce(text, '')) AS hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, coalesce(text, '') AS text FROM documents)"""


@query(f"WITH {FILES} SELECT path, CASE WHEN ends_with(path, 'py') THEN 'python' WHEN ends_with(path, 'jsx') THEN 'javascript' WHEN ends_with(path, 'tsx') THEN 'typescript' END AS language, size_bytes, CASE WHEN size_bytes < 1024 THEN printf('%.1f B', CAST(size_bytes AS DOUBLE)) WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0) ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS shown, starts_with(path, 'src1/') AS ignored FROM fl WHERE size_bytes <= 1048576")
def source_files(spark, sf_dir):
    """Language by suffix, the size filter and the ignore rules, here of one folder."""
    path = F.col("path")
    rows = document_files(spark, sf_dir).where(F.col("size_bytes") <= files.MAX_BYTES)
    return rows.select("path", files.language(path).alias("language"), "size_bytes", report.human_size(F.col("size_bytes")).alias("shown"), files.ignored(path, ["src1/", "*.tmp", "!keep.py"]).alias("ignored"))


@query(f"WITH {FILES}, known AS (SELECT path, CASE WHEN toxic = 1 THEN '' ELSE hash END AS known FROM fl JOIN labels USING (doc_id)) SELECT path, CASE WHEN known IS NULL THEN 'new' ELSE 'changed' END AS reason FROM fl LEFT JOIN known USING (path) WHERE known IS NULL OR known <> hash")
def changed_files(spark, sf_dir):
    """Files that an index of the labelled documents does not hold, or holds with another hash (the toxic ones)."""
    rows = document_files(spark, sf_dir).select("doc_id", "path", "hash")
    index = rows.join(table(spark, sf_dir, "labels"), "doc_id").select("path", F.when(F.col("toxic") == 1, "").otherwise(F.col("hash")).alias("hash"))
    return store.changed_files(rows, index).join(index.select("path", F.lit(1).alias("k")), "path", "left").select("path", F.when(F.col("k").isNull(), "new").otherwise("changed").alias("reason"))


@query("SELECT d.doc_id || ':1:' || len(string_split(coalesce(text, ''), chr(10))) AS block_id, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS churn, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS norm_hash FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def upserted_blocks(spark, sf_dir):
    """Blocks of all documents after those of the labelled ones came again."""
    d = table(spark, sf_dir, "documents")
    bid = store.block_id(F.col("doc_id").cast("string"), F.lit(1), F.size(F.split(F.coalesce("text", F.lit("")), "\n")))
    old = d.select("doc_id", bid.alias("block_id"), F.lit(0).cast("long").alias("churn"), F.lit("chunk").alias("node_type"), F.lit("old").alias("norm_hash"))
    new = old.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("norm_hash", F.lit("new"))
    return store.upsert_blocks(old.drop("doc_id"), new.drop("doc_id")).select("block_id", "churn", "norm_hash")


@query(f"WITH {FILES}, gone AS (SELECT DISTINCT path FROM fl JOIN labels USING (doc_id) WHERE toxic = 1) SELECT path, size_bytes FROM fl WHERE path NOT IN (SELECT path FROM gone)")
def deleted_files(spark, sf_dir):
    rows = document_files(spark, sf_dir)
    gone = rows.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("path")
    return rows.join(gone, "path", "left_anti").select("path", "size_bytes")


BLOCKS = f"""b AS (SELECT doc_id, doc_id || ':1:' || len(string_split(coalesce(text, ''), chr(10))) AS block_id, source AS file_path, CAST(doc_id AS INTEGER) AS start_line, lang, len({WORDS}) AS n_tokens, substr(sha256(array_to_string({WORDS}, ' ')), 1, 16) AS norm_hash FROM documents)"""


def document_table(spark, sf_dir) -> DataFrame:
    """Documents as blocks of one file for each source, in the order of their ids."""
    toks, lines = K.words(F.col("text")), F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", store.block_id(F.col("doc_id").cast("string"), F.lit(1), lines).alias("block_id"), F.col("source").alias("file_path"), F.col("doc_id").cast("int").alias("start_line"), F.col("doc_id").cast("int").alias("end_line"), "lang", F.size(toks).cast("long").alias("n_tokens"), K.short_hash(toks).alias("norm_hash"))


@query(f"WITH {BLOCKS}, h AS (SELECT norm_hash, min(lang) AS lang FROM b GROUP BY norm_hash ORDER BY count(*) DESC, norm_hash LIMIT 1) SELECT 'any' AS wanted, block_id, b.norm_hash FROM b JOIN h ON b.norm_hash = h.norm_hash UNION ALL SELECT 'one', block_id, b.norm_hash FROM b JOIN h ON b.norm_hash = h.norm_hash AND b.lang = h.lang")
def blocks_by_hash(spark, sf_dir):
    """The blocks of the commonest normalised hash, of any language and of one."""
    blocks = document_table(spark, sf_dir)
    top = blocks.groupBy("norm_hash").agg(F.count("*").alias("n"), F.min("lang").alias("lang")).orderBy(F.desc("n"), "norm_hash").first()
    every = store.blocks_by_hash(blocks, top["norm_hash"]).select(F.lit("any").alias("wanted"), "block_id", "norm_hash")
    return every.union(store.blocks_by_hash(blocks, top["norm_hash"], top["lang"]).select(F.lit("one"), "block_id", "norm_hash"))


@query(f"WITH {BLOCKS} SELECT block_id, file_path, start_line FROM b WHERE file_path = (SELECT min(file_path) FROM b) ORDER BY start_line")
def blocks_by_file(spark, sf_dir):
    """The blocks of the first file, from its first line on."""
    blocks = document_table(spark, sf_dir)
    first = blocks.agg(F.min("file_path")).first()[0]
    return store.blocks_by_file(blocks, first).select("block_id", "file_path", "start_line")


@query(f"WITH {FILES}, {BLOCKS}, f AS (SELECT * FROM fl WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT b.block_id, f.hash AS file_hash, f.size_bytes AS file_size FROM (SELECT *, file_path || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'jsx' WHEN 'de' THEN 'tsx' ELSE 'md' END AS p FROM b) b LEFT JOIN f ON f.path = b.p")
def block_files(spark, sf_dir):
    """Blocks with the hash and size of their file, null for files that are not stored (here those without a label)."""
    files_ = document_files(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("lines", F.lit(1).cast("long"))
    ext = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "fr", "jsx").when(F.col("lang") == "de", "tsx").otherwise("md")
    blocks = document_table(spark, sf_dir).withColumn("file_path", F.concat_ws("", "file_path", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext))
    return store.with_files(blocks, files_).select("block_id", "file_hash", "file_size")


@query(f"WITH {FILES} SELECT path, CASE WHEN l.doc_id IS NULL THEN hash ELSE 'new' END AS hash, CASE WHEN l.doc_id IS NULL THEN size_bytes ELSE 0 END AS size_bytes FROM fl LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'added/' || item_id, 'new', 0 FROM benchmark")
def upserted_files(spark, sf_dir):
    """All files after those of the labelled documents came with new hashes, and some new ones."""
    old = document_files(spark, sf_dir).select("doc_id", "path", "hash", "size_bytes")
    again = old.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    added = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("added/"), F.col("item_id").cast("string")).alias("path"))
    new = again.union(added).select("path", F.lit("new").alias("hash"), F.lit(0).cast("long").alias("size_bytes"))
    return store.upsert(old.drop("doc_id"), new, "path")


@query("WITH o AS (SELECT doc_id, 'active' AS status, quality AS score FROM labels), n AS (SELECT doc_id, 'new' AS status, 9 AS score FROM labels WHERE toxic = 1), u AS (SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n) SELECT doc_id || ':' AS finding_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM labels) THEN 'suppressed' ELSE status END AS status, CAST(score AS DOUBLE) AS refactor_score FROM u")
def upserted_findings(spark, sf_dir):
    """Findings of labelled documents, updated where they are toxic, one of them suppressed then."""
    labels = table(spark, sf_dir, "labels")
    row = lambda df, status, score: df.select(F.concat(F.col("doc_id").cast("string"), F.lit(":")).alias("finding_id"), F.lit(status).alias("status"), score.cast("double").alias("refactor_score"))
    first = labels.agg(F.min("doc_id")).first()[0]
    return store.suppress(store.upsert(row(labels, "active", F.col("quality")), row(labels.where("toxic = 1"), "new", F.lit(9)), "finding_id"), f"{first}:")


GONE = f"{FILES}, {BLOCKS}, gone AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND doc_id % 10 < 3), lost AS (SELECT block_id FROM b WHERE file_path IN (SELECT source FROM gone)), pair AS (SELECT x.block_id AS src, y.block_id AS match FROM b x JOIN b y ON y.doc_id = x.doc_id + 1)"


@query(f"WITH {GONE} SELECT 'files' AS name, count(*) AS n FROM (SELECT DISTINCT file_path FROM b WHERE file_path NOT IN (SELECT source FROM gone)) UNION ALL SELECT 'blocks', count(*) FROM b WHERE block_id NOT IN (SELECT block_id FROM lost) UNION ALL SELECT 'findings', count(*) FROM pair WHERE src NOT IN (SELECT block_id FROM lost) AND match NOT IN (SELECT block_id FROM lost) UNION ALL SELECT 'signatures', count(*) FROM b WHERE block_id NOT IN (SELECT block_id FROM lost)")
def deletion_cascade(spark, sf_dir):
    """What is left of each table after files (sources) were deleted with all that depends on them."""
    blocks = document_table(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where("toxic = 1 AND doc_id % 10 < 3")
    gone = blocks.join(labels.select("doc_id"), "doc_id", "left_semi").select(F.col("file_path").alias("path")).distinct()
    right = blocks.select((F.col("doc_id") - 1).alias("doc_id"), F.col("block_id").alias("match"))
    tables = {"files": blocks.select(F.col("file_path").alias("path")).distinct(), "blocks": blocks, "findings": blocks.select("doc_id", F.col("block_id").alias("src")).join(right, "doc_id"), "signatures": blocks.select("block_id")}
    out = None
    for name, left in store.delete_files(tables, gone).items():
        row = left.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


@query(f"WITH {GONE} SELECT block_id, file_path FROM b WHERE file_path NOT IN (SELECT source FROM gone)")
def deleted_blocks(spark, sf_dir):
    """The blocks that stay when those of some files are deleted."""
    blocks = document_table(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where("toxic = 1 AND doc_id % 10 < 3")
    gone = blocks.join(labels.select("doc_id"), "doc_id", "left_semi").select(F.col("file_path").alias("path")).distinct()
    return store.delete_blocks(blocks, gone).select("block_id", "file_path")


@query(f"WITH {BLOCKS} SELECT block_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS churn FROM b LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL OR file_path <> 'src1' UNION ALL SELECT 'src1:new', 0")
def replaced_blocks(spark, sf_dir):
    """Blocks after a file (src1) was read again, whose labelled blocks are there still, with others of its files: what it no
    longer has goes, what it has anew comes."""
    blocks = document_table(spark, sf_dir).select("doc_id", "block_id", "file_path", F.lit(0).cast("long").alias("churn"), F.lit("chunk").alias("node_type"))
    kept = blocks.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").drop("doc_id")
    new = kept.union(spark.range(1).select(F.lit("src1:new"), F.lit("src1"), F.lit(0).cast("long"), F.lit("chunk")))
    return store.replace_blocks(blocks.drop("doc_id"), spark.range(1).select(F.lit("src1").alias("path")), new).select("block_id", "churn")


@query(FINDINGS + ", top AS (SELECT finding_id FROM kept ORDER BY score DESC, finding_id LIMIT 1) SELECT finding_id, src, match, round(score, 6) AS refactor_score FROM kept WHERE finding_id IN (SELECT finding_id FROM top)")
def finding_by_id(spark, sf_dir):
    rows = document_findings(spark, sf_dir)
    best = scoring.top_findings(rows, limit=1).first()
    return store.finding_by_id(rows, best["finding_id"] if best else "").select("finding_id", "src", "match", F.round("refactor_score", 6).alias("refactor_score"))


@query(FINDINGS + " SELECT finding_id, lang, source AS unit_path, src AS unit_start, round(jaccard_score, 9) AS jaccard, round(overlap_score, 9) AS overlap, round(score, 6) AS r, match AS match_start, 'near_miss' AS type FROM kept")
def finding_resources(spark, sf_dir):
    """Each finding as a nested JSON document, read back from it."""
    blocks = document_table(spark, sf_dir).withColumn("block_id", F.col("doc_id"))
    rows = scoring.resource(document_findings(spark, sf_dir).drop("lang", "source"), blocks)
    at = lambda path, kind="string": F.get_json_object("json", f"$.{path}").cast(kind)
    scores = [F.round(at(f"matches[0].scores.{k}", "double"), d).alias(n) for k, d, n in (("jaccard", 9, "jaccard"), ("overlap", 9, "overlap"), ("R", 6, "r"))]
    return rows.select("finding_id", at("unit.lang").alias("lang"), at("unit.path").alias("unit_path"), at("unit.start", "long").alias("unit_start"), *scores, at("matches[0].start", "long").alias("match_start"), at("matches[0].type").alias("type"))


@query("SELECT doc_id, md5(array_to_string(list_transform(l[1:20], lambda x, i: lpad(CAST(i AS VARCHAR), 4, ' ') || ': ' || x), chr(10)) || CASE WHEN len(l) > 20 THEN chr(10) || '... (' || (len(l) - 20) || ' more lines)' ELSE '' END) AS snippet_md5, md5(array_to_string(l[1:5], chr(10))) AS frame_md5 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")
def snippets(spark, sf_dir):
    """The numbered snippet of each document and the frame around its second and third line."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(report.snippet(text).cast("binary")).alias("snippet_md5"), F.md5(report.frame(text, F.lit(2), F.lit(3)).cast("binary")).alias("frame_md5"))


# Vectors ---------------------------------------------------------------------------------------------------------------
VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
COSINE = "CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"
#: The stated queries of vector searches.
EVERY = 50


@query(f"WITH {VECTORS} SELECT q.vec_id AS query, c.vec_id AS match, round({COSINE.format(a='q.v', b='c.v')}, 6) AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND {COSINE.format(a='q.v', b='c.v')} >= 0.3")
def vector_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.neighbours(v, v.where(f"vec_id % {EVERY} = 0"), "vec_id", "embedding", 0.3).withColumn("score", F.round("score", 6))


def _knn_sql(score: str) -> str:
    return f"WITH {VECTORS}, s AS (SELECT q.vec_id AS query, c.vec_id AS match, round({score}, 6) AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, match) AS rank FROM s) SELECT query, match, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"


def _knn(spark, sf_dir, metric):
    v = table(spark, sf_dir, "embeddings")
    return vectors.knn(v, v.where(f"vec_id % {EVERY} = 0"), "vec_id", "embedding", 20, metric)


@query(_knn_sql(COSINE.format(a="q.v", b="c.v")))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


@query(_knn_sql("1 / (1 + list_dot_product(q.v, q.v) + list_dot_product(c.v, c.v) - 2 * list_dot_product(q.v, c.v))"))
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, "l2")


@query(_knn_sql("list_dot_product(q.v, c.v)"))
def knn_ip(spark, sf_dir):
    return _knn(spark, sf_dir, "ip")


@query(f"WITH {VECTORS} SELECT a.vec_id AS src, b.vec_id AS match, round({COSINE.format(a='a.v', b='b.v')}, 6) AS semantic_similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE {COSINE.format(a='a.v', b='b.v')} >= 0")
def semantic_rerank(spark, sf_dir):
    """Pairs of successive vectors with a cosine that is not negative."""
    v = table(spark, sf_dir, "embeddings")
    pairs = v.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("match"))
    return vectors.rerank(pairs, v, "vec_id", "embedding", 0.0).select("src", "match", F.round("semantic_similarity", 6).alias("semantic_similarity"))


@query("SELECT count(*) AS total_vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension, 'cosine' AS metric FROM embeddings")
def vector_statistics(spark, sf_dir):
    return vectors.statistics(table(spark, sf_dir, "embeddings"), "embedding")


@query("WITH e AS (SELECT vec_id, embedding FROM embeddings), a AS (SELECT * FROM e UNION ALL SELECT vec_id + 1000000, embedding FROM e WHERE vec_id % 7 = 0), u AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 AND vec_id < 1000000 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM a WHERE vec_id % 11 <> 0) SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM u")
def vector_upkeep(spark, sf_dir):
    """The vectors after some were added, removed and updated (unknown ids change nothing) and the table was rebuilt."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    added = vectors.add(v, v.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000), "embedding", 64)
    live = vectors.remove(added, added.where("vec_id % 11 = 0"), "vec_id")
    new = v.where("vec_id % 5 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding")).union(v.limit(1).select(F.lit(-5).cast("long"), "embedding"))
    out = vectors.rebuild(vectors.update(live, new, "vec_id"), "vec_id")
    return out.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


# Functions -------------------------------------------------------------------------------------------------------------
@query(f"WITH {FILES} SELECT path, CASE WHEN strpos(path, '/') = 0 THEN 'Root' ELSE regexp_replace(path, '/[^/]*$', '') END AS folder, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '[.]([^./]+)$', 1) AS suffix, CASE regexp_extract(path, '[.]([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'jsx' THEN 'javascript' WHEN 'tsx' THEN 'typescript' ELSE 'text' END AS highlight, substr(path, 6) AS inner_path FROM fl")
def path_parts(spark, sf_dir):
    """Folder, name, suffix, highlight name and path below a root of each file."""
    path = F.col("path")
    return document_files(spark, sf_dir).select("path", scoring.folder_of(path).alias("folder"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"), F.regexp_extract(path, "[.]([^./]+)$", 1).alias("suffix"), report.highlight(path).alias("highlight"), F.substring(path, 6, 1 << 20).alias("inner_path"))


@query("SELECT doc_id, round(100 * (0.6 * coalesce(CASE WHEN quality = 1 THEN 0.9 END, 0) + 0.4 * coalesce(CASE WHEN toxic = 1 THEN 0.25 END, 0.5)), 6) AS percent FROM labels")
def similarity_percents(spark, sf_dir):
    """The shown similarity where the semantic or the structural score is missing."""
    semantic, structural = F.when(F.col("quality") == 1, 0.9), F.when(F.col("toxic") == 1, 0.25)
    return table(spark, sf_dir, "labels").select("doc_id", F.round(scoring.similarity_percent(semantic, structural, F.lit(0.5)), 6).alias("percent"))


@query("SELECT stage, ms, round(CASE WHEN sum(ms) OVER () = 0 THEN 0 ELSE 100.0 * ms / sum(ms) OVER () END, 6) AS percent FROM (SELECT event_type AS stage, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS ms FROM events GROUP BY event_type)")
def stage_shares(spark, sf_dir):
    """The share of each stage in the whole time."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum(F.floor(F.col("value") * 1000).cast("long")).alias("ms"))
    return rows.withColumn("percent", F.round(scoring.share(F.col("ms")), 6)).orderBy("stage")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events")
def event_moments(spark, sf_dir):
    """Timestamps as ISO text, as seconds, and read back from the text."""
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    back = F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", iso.alias("iso"), F.unix_timestamp(back).alias("seconds"), F.date_format(F.timestamp_seconds(F.unix_timestamp(back)), "yyyy-MM-dd HH:mm").alias("shown"))


@query("SELECT path, max(event_id) AS last_event FROM (SELECT event_id, 'src/' || user_id AS path, ts FROM events) WHERE ts > (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY path")
def recently_modified(spark, sf_dir):
    """Files changed after a moment: two days before the last event."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("src/"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("modified"))
    moment = rows.select((F.max("modified") - F.expr("INTERVAL 2 DAYS")).alias("m")).first()["m"]
    return files.modified_since(rows, moment).groupBy("path").agg(F.max("event_id").alias("last_event"))


@query("SELECT d.doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 5000000 FROM labels WHERE toxic = 1) d WHERE d.doc_id NOT IN (SELECT doc_id FROM documents)")
def missing_files(spark, sf_dir):
    """Stated paths that are not there."""
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    labels = table(spark, sf_dir, "labels")
    wanted = labels.select(F.col("doc_id").alias("path")).union(labels.where("toxic = 1").select(F.col("doc_id") + 5_000_000))
    return files.missing(wanted, found).select(F.col("path").alias("doc_id"))


# Events ----------------------------------------------------------------------------------------------------------------
def change_events(spark, sf_dir) -> DataFrame:
    """Events as changes of the file of their user; purchases are deletions."""
    kind = F.when(F.col("event_type") == "purchase", "deleted").when(F.col("event_type") == "signup", "created").otherwise("modified")
    path = F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "error", ".py.tmp").otherwise(".py"))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", path.alias("path"), kind.alias("event_type"))


EVENTS = "e AS (SELECT event_id, ts, user_id, 'src/' || user_id || CASE WHEN event_type = 'error' THEN '.py.tmp' ELSE '.py' END AS path, CASE event_type WHEN 'purchase' THEN 'deleted' WHEN 'signup' THEN 'created' ELSE 'modified' END AS event_type FROM events)"


@query(f"WITH {EVENTS} SELECT path, event_type, count(*) AS n FROM e WHERE event_type = 'deleted' OR path LIKE '%.py' GROUP BY ALL")
def event_filter(spark, sf_dir):
    return change_events(spark, sf_dir).where(E.relevant(F.col("path"), F.col("event_type"))).groupBy("path", "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, l AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS gap FROM e), s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l) SELECT user_id, CAST(session AS BIGINT) AS session, path, max_by(event_type, (ts, event_id)) AS event_type, epoch_us(max(ts)) AS ts_us, count(*) AS n_events FROM s GROUP BY user_id, session, path")
def event_debounce(spark, sf_dir):
    """The latest event of each path in each burst of a root (user); a pause of an hour ends a burst."""
    rows = E.debounced(change_events(spark, sf_dir), 3600, "user_id")
    return rows.select("user_id", "session", "path", "event_type", F.unix_micros("ts").alias("ts_us"), "n_events")


@query(f"WITH {EVENTS} SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w <= 3 AS accepted FROM e WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)")
def event_rate_limit(spark, sf_dir):
    """At most three events of a root in a day."""
    return E.rate_limited(change_events(spark, sf_dir), 3, 86_400, "user_id").select("event_id", "in_window", "accepted")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN quality = 0 THEN 'suppressed' ELSE 'active' END AS status FROM documents JOIN labels USING (doc_id)) GROUP BY status")
def status_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id")
    return rows.groupBy(F.when(F.col("quality") == 0, "suppressed").otherwise("active").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, epoch_us(ts) AS ts_us FROM events ORDER BY ts DESC, event_id LIMIT 5")
def recent_events(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(5).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


__all__ = ["QUERIES", "ORACLES", "Window"]
