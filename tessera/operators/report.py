"""Reports: Markdown and JSON of findings; aggregates run in Spark, rows reach the driver one partition at a time."""

from __future__ import annotations

import difflib
import json
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.operators.scoring import folder_of, summary

# Highlight names by suffix.
HIGHLIGHT = {"py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "java": "java", "c": "c", "cpp": "cpp", "cc": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "go": "go", "rs": "rust", "swift": "swift", "kt": "kotlin", "scala": "scala"}


def human_size(n: Column) -> Column:
    """1024 steps from B to TB with one decimal, halves to even."""
    out = F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**k, 1))).otherwise(out)
    return out


def size_text(n: float) -> str:
    """The same for one number."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def snippet(text: Column, limit: int = 20) -> Column:
    """Numbered lines, at most ``limit``, with a mark where some are left out."""
    lines = F.split(text, "\n")
    numbered = F.transform(F.slice(lines, 1, limit), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit(": "), x))
    rest = F.size(lines) - limit
    return F.concat(F.array_join(numbered, "\n"), F.when(rest > 0, F.concat(F.lit("\n... ("), rest.cast("string"), F.lit(" more lines)"))).otherwise(F.lit("")))


def frame(text: Column, start: Column, end: Column, context: int = 2) -> Column:
    """Lines ``start`` to ``end`` with some around them."""
    first = F.greatest(start - context, F.lit(1))
    return F.array_join(F.slice(F.split(text, "\n"), first, end + context - first + 1), "\n")


def highlight(path: Column) -> Column:
    suffix, out = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit("text")
    for ext, name in HIGHLIGHT.items():
        out = F.when(suffix == ext, name).otherwise(out)
    return out


def diff_text(a: str | None, b: str | None, before: str = "", after: str = "") -> str:
    return "\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), before, after, lineterm=""))


@F.pandas_udf(StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """For the pairs of a report."""
    return pd.Series([diff_text(x, y) for x, y in zip(a, b)])


def side_by_side(a: str, b: str, width: int | None = None) -> str:
    """Two texts line by line; the left column is as wide as its longest line, or as ``width`` if that is more."""
    x, y = a.split("\n"), b.split("\n")
    left = max([width or 0, *(len(s) for s in x)])
    return "\n".join(f"{x[i] if i < len(x) else '':<{left}} | {y[i] if i < len(y) else ''}".rstrip() for i in range(max(len(x), len(y))))


def contents(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Findings with the code of both blocks and their unified diff."""
    own = lambda side, name: blocks.select(F.col("block_id").alias(side), F.col("raw_content").alias(name))
    joined = findings.join(own("src", "src_code"), "src", "left").join(own("match", "match_code"), "match", "left")
    return joined.withColumn("diff", unified_diff("src_code", "match_code"))


def by_folder(findings: DataFrame) -> DataFrame:
    """Findings (file_path, ...) with their folder, folders by name and findings by falling score."""
    return findings.withColumn("folder", folder_of(F.col("file_path"))).orderBy("folder", F.desc("refactor_score"), "finding_id")


def markdown_lines(findings: DataFrame, stages: dict[str, int], coded: DataFrame | None = None):
    """The lines of the report, all findings one by one; ``coded``: findings with code and diff, as ``contents`` gives them."""
    s = summary(findings).first()
    total = sum(stages.values())
    yield from ("# Duplicate report", "", f"{s['total']} findings, {s['high_priority']} of high priority", "", "| band | findings |", "|-|-|", f"| high | {s['high']} |", f"| medium | {s['medium']} |", f"| low | {s['low']} |", "")
    yield from ("| stage | ms | % |", "|-|-|-|", *(f"| {k} | {v} | {100 * v / total if total else 0:.1f} |" for k, v in sorted(stages.items())), "")
    folder = None
    for r in by_folder(findings if coded is None else coded).toLocalIterator():
        if r["folder"] != folder:
            folder = r["folder"]
            yield from (f"## {folder}", "")
        yield f"- `{r['src']}` and `{r['match']}`: {r['type']}, score {r['refactor_score']:.1f}"
        if coded is not None and r["src_code"]:
            path = r["src"].rpartition(":")[0].rpartition(":")[0]
            name = HIGHLIGHT.get(path.rpartition(".")[2].lower(), "text")
            yield from ("", f"```{name}", *r["src_code"].split("\n"), "```", "", "```diff", *(r["diff"] or "").split("\n"), "```", "")


def markdown(findings: DataFrame, stages: dict[str, int]) -> str:
    return "\n".join(markdown_lines(findings, stages)) + "\n"


def json_parts(findings: DataFrame, statistics: dict):
    """The JSON report in parts, all findings one by one, the best first."""
    head = json.dumps({"metadata": {"version": 1}, "statistics": statistics, "summary": summary(findings).first().asDict()}, indent=2, default=str)
    yield head.removesuffix("\n}") + ',\n  "findings": ['
    ordered = findings.orderBy(F.desc("refactor_score"), "finding_id")
    n = 0
    for r in ordered.select(F.to_json(F.struct(*ordered.columns)).alias("row")).toLocalIterator():
        n += 1
        yield (",\n" if n > 1 else "\n") + textwrap.indent(json.dumps(json.loads(r["row"]), indent=2), "    ")
    yield ("\n  ]" if n else "]") + "\n}"


def as_json(findings: DataFrame, statistics: dict) -> str:
    return "".join(json_parts(findings, statistics))


def messages(findings: DataFrame):
    """A stream of progress, findings and completion."""
    yield {"type": "progress", "stage": "findings"}
    n = 0
    for r in findings.toLocalIterator():
        n += 1
        yield {"type": "finding", "finding": r.asDict(recursive=True)}
    yield {"type": "complete" if n else "info", "total": n}
