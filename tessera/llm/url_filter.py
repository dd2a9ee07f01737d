"""URL filters as a temporal list join.

List entries are dated: an entry adds or removes a rule for a host (which covers its subdomains) from a day on. Entries
become validity intervals, and an as-of join evaluates every capture against the rule that was active at its fetch time:
the latest entry not after it. Of several hosts with active rules the longest counts.

Only the list is sorted (a window over each host's few entries); captures meet it by equality of host with the interval
as a further condition, salted, so a host that holds a third of the captures is spread over many tasks.

Cases: a null URL or one without a host, or a null fetch time, matches nothing and is allowed; several entries of one
host and moment: a removal wins, then the smaller category; repeated captures are judged alike; empty lists or captures
give everything allowed or nothing; other columns are carried along, those with a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import spare

SALTS = 16
RESULT = ("host", "matched_host", "category", "active_since", "blocked")


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and trailing dots; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def suffixes(host: Column) -> Column:
    """The host and its parent domains of at least two labels."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule_host, category, since, until) while a rule is active, from (host, at, action 'add' or 'remove', category)."""
    clean = entries.where(F.col("host").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    moments = clean.groupBy(F.lower("host").alias("rule_host"), "at").agg(F.max(F.col("action") == "remove").alias("removed"), F.min("category").alias("category"))
    until = F.lead("at").over(Window.partitionBy("rule_host").orderBy("at"))
    return moments.withColumn("until", until).where(~F.col("removed")).select("rule_host", "category", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """``captures`` with host, matched_host, category, active_since and blocked."""
    keep = [c for c in captures.columns if c not in RESULT]
    # Inner columns that stand beside the caller's have names that no column has.
    when, met = spare([*keep, *RESULT], "moment"), spare([*keep, *RESULT], "met")
    rows = captures.select(*keep, host_of(F.col(url)).alias("host"))
    # One row for each distinct (host, moment): captures of a hot host collapse before they meet the list.
    asked = rows.select("host", F.col(at).alias("moment")).distinct()
    keys = asked.withColumn("rule_host", F.explode(suffixes(F.col("host")))).withColumn("salt", F.pmod(F.xxhash64("host", "moment"), F.lit(SALTS)))
    salted = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    active = (F.col("since") <= F.col("moment")) & (F.col("until").isNull() | (F.col("moment") < F.col("until")))
    hits = keys.join(salted, ["rule_host", "salt"]).where(active)
    # Entries of one host and moment are one row already, so no two of a host are active at once.
    best = hits.groupBy("host", "moment").agg(F.max(F.struct(F.length("rule_host").alias("n"), "rule_host", "category", "since")).alias(met)).withColumnRenamed("moment", when)
    judged = rows.withColumn(when, F.col(at)).join(best.hint("merge"), ["host", when], "left")
    found = F.col(met)
    return judged.select(*keep, "host", found["rule_host"].alias("matched_host"), found["category"].alias("category"), found["since"].alias("active_since"), found.isNotNull().alias("blocked"))
