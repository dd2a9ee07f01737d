"""Tokens, shingles and their normalisation as column expressions."""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reserved words by language and structural tokens.
JAVASCRIPT = """break case catch class const continue debugger default delete do else enum export extends false finally for
function if implements import in instanceof interface let new null package private protected public return static super
switch this throw true try typeof var void while with yield async await""".split()
TYPESCRIPT = JAVASCRIPT + "type namespace declare module abstract readonly keyof infer is asserts".split()
KEYWORDS = {"python": list(keyword.kwlist), "javascript": JAVASCRIPT, "typescript": TYPESCRIPT}
STRUCTURAL = """+ - * / % ** // & | ^ ~ << >> = += -= *= /= %= &= |= ^= <<= >>= == != < > <= >= === !== && || ! ( ) [ ] { } , ; : .
-> => ? ?? ?. @ #""".split()

STRING = r"""^([fr]?"[^\n]*"|[fr]?'[^\n]*'|`[^\n]*`)$"""
NUMBER = r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$"
BOOLEAN = r"^(true|false|True|False)$"
TYPE = r"^[A-Z][a-zA-Z0-9]*$"
DUNDER = r"^__[a-zA-Z0-9_]*__$"
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
#: Code-like tokens of plain text: words, numbers and single other characters.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_ \t\r\n]"


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), 1)


def shingles(toks: Column, k: int = 5) -> Column:
    """The set of k-token shingles; fewer tokens give one shingle of them all.
    The tokens are bound once; otherwise each shingle would split the text again."""

    def windows(t: Column) -> Column:
        n = F.size(t)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.array_join(F.slice(t, i + 1, F.lit(k)), " "))
        return F.array_distinct(F.when(n >= k, many).otherwise(F.array(F.array_join(t, " "))))

    return F.transform(F.array(toks), windows)[0]


def is_keyword(token: Column, lang: Column) -> Column:
    out = F.lit(False)
    for name, listed in KEYWORDS.items():
        out = F.when(F.lower(lang) == name, token.isin(listed)).otherwise(out)
    return out


def role(token: Column, lang: Column) -> Column:
    """What a token becomes: null (kept), STR, NUM, BOOL, or the placeholder class TYPE, FUNC or VAR. The order counts."""
    keep = (F.trim(token) == "") | is_keyword(token, lang) | token.isin(STRUCTURAL)
    return (
        F.when(keep, None)
        .when(token.rlike(STRING), "STR")
        .when(token.rlike(NUMBER), "NUM")
        .when(token.rlike(BOOLEAN), "BOOL")
        .when(token.rlike(TYPE), "TYPE")
        .when(token.rlike(DUNDER), "FUNC")
        .when(token.rlike(IDENTIFIER), "VAR")
    )


def positions(blocks: DataFrame, key: str, toks: str, lang: str) -> DataFrame:
    """(key, pos, token, role, norm): every occurrence of an identifier takes the next number of its role in its block.
    Blocks are dealt by their key before they are taken apart, so no window or group below moves single tokens."""
    rows = blocks.repartition(F.col(key)).select(key, F.col(lang).alias("__lang"), F.posexplode(toks).alias("pos", "token")).withColumn("role", role(F.col("token"), F.col("__lang")))
    number = F.row_number().over(Window.partitionBy(key, "role").orderBy("pos"))
    norm = F.when(F.col("role").isNull(), F.col("token")).when(F.col("role").isin("STR", "NUM", "BOOL"), F.concat("role", F.lit("_LIT"))).otherwise(F.concat("role", F.lit("_"), number.cast("string")))
    return rows.withColumn("norm", norm).drop("__lang")


def normalize(blocks: DataFrame, key: str = "block_id", toks: str = "tokens", lang: str = "lang", mappings: bool = True) -> DataFrame:
    """``blocks`` with normalized_tokens and hash_signature, and with ``mappings`` token_mapping (last occurrence wins) and
    reverse_mapping. Each mapping is an aggregate over the block's tokens, so the work is linear in its length."""
    rows = positions(blocks, key, toks, lang)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "norm")))
    found = rows.groupBy(key).agg(F.transform(ordered, lambda x: x["norm"]).alias("normalized_tokens"))
    out = blocks.join(found, key, "left").withColumn("normalized_tokens", F.coalesce("normalized_tokens", F.array().cast("array<string>")))
    out = out.withColumn("hash_signature", hash_signature(F.col("normalized_tokens")))
    if not mappings:
        return out
    changed = rows.where(F.col("norm") != F.col("token"))
    entries = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v))))
    forward = changed.groupBy(key, "token").agg(F.max_by("norm", "pos").alias("to")).groupBy(key).agg(entries("token", "to").alias("token_mapping"))
    own = changed.groupBy(key, "norm").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("o")).select(key, "norm", F.transform("o", lambda x: x["token"]).alias("from"))
    back = own.groupBy(key).agg(entries("norm", "from").alias("reverse_mapping"))
    out = out.join(forward, key, "left").join(back, key, "left")
    return out.withColumn("token_mapping", F.coalesce("token_mapping", F.create_map().cast("map<string,string>"))).withColumn("reverse_mapping", F.coalesce("reverse_mapping", F.create_map().cast("map<string,array<string>>")))


def hash_signature(toks: Column) -> Column:
    return F.sha2(F.array_join(toks, " "), 256)


def short_hash(toks: Column) -> Column:
    return F.substring(hash_signature(toks), 1, 16)


def complexity(toks: Column) -> Column:
    return F.size(toks) / 10.0


def explain_difference(a: Column, b: Column) -> Column:
    """common, different and structural_similarity of two token arrays; no similarity when both are empty."""
    both, one = F.array_intersect(a, b), F.array_union(F.array_except(a, b), F.array_except(b, a))
    size = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.struct(both.alias("common"), one.alias("different"), F.try_divide(F.size(both).cast("double"), size).alias("structural_similarity"))


def pretty(normalized: Column, mapping: Column, signature: Column) -> Column:
    """Sorted mappings, the first 50 tokens and the short hash, as text."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(mapping)), lambda e: F.concat(e["key"], F.lit(" -> "), e["value"])), "\n")
    head = F.concat(F.array_join(F.slice(normalized, 1, 50), " "), F.when(F.size(normalized) > 50, F.lit(" ...")).otherwise(F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("hash "), F.substring(signature, 1, 16)), head, pairs)
