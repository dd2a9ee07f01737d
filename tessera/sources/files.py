"""File sources: reading trees of source files, ignore rules, language detection and change detection."""

from __future__ import annotations

import json
import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by suffix, folders never entered, patterns ignored by default.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript"}
SKIPPED_FOLDERS = [".git", ".svn", ".hg", "__pycache__", "node_modules", ".idea", ".vscode", "coverage", ".nyc_output", "build", "dist"]
DEFAULT_IGNORES = """tests/ test/ __tests__/ __pycache__/ *.pyc *.pyo *.pyd node_modules/ .npm/ npm-debug.log* vendor/ vendors/ migrations/
migrate/ *.min.js *.min.css *.bundle.js *.bundle.css .git/ .svn/ .hg/ .bzr/ build/ dist/ target/ out/ .vscode/ .idea/ *.swp *.swo .DS_Store
Thumbs.db *.log *.tmp *.temp coverage/ .coverage .nyc_output/ *.generated.* *_pb2.py *.pb.go""".split()
MAX_BYTES = 1 << 20


def language(path: Column) -> Column:
    """The language of a path by its suffix, null if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for ext, lang in LANGUAGES.items():
        out = F.when(suffix == ext, lang).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A regular expression for a gitignore pattern on a relative path with '/' separators."""
    p, folder = pattern.rstrip("/"), pattern.endswith("/")
    anchored = "/" in p
    out, i, p = "", 0, p.lstrip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignore_rules(root: str | None = None, extra: list[str] = ()) -> list[str]:
    """Default patterns, ``extra`` and those of the tree's ignore files, in order; blanks and comments are left out."""
    rules = [*DEFAULT_IGNORES, *extra]
    for name in (".gitignore", ".dupesignore"):
        if root and (f := Path(root, name)).is_file():
            rules += f.read_text(errors="replace").splitlines()
    return [r.strip() for r in rules if r.strip() and not r.strip().startswith("#")]


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a relative path ignores it; '!' takes a path back."""
    out = F.lit(False)
    for rule in rules:
        out = F.when(path.rlike(glob_regex(rule.lstrip("!"))), not rule.startswith("!")).otherwise(out)
    return out


def folder_ignored(name: str, rules: list[str]) -> bool:
    """Whether a folder of that name is not entered at all: its name is one of the fixed ones, or the last rule that
    matches the bare name ignores it. A rule for folders (``build/``) does not match a bare name; the fixed names and
    the rules on whole paths, which are applied to every file, do the rest."""
    if name in SKIPPED_FOLDERS:
        return True
    out = False
    for rule in rules:
        if re.search(glob_regex(rule.lstrip("!")), name):
            out = not rule.startswith("!")
    return out


def walk(spark: SparkSession, root: str, rules: list[str]) -> list[str]:
    """The folders of a tree that are entered, the root first. Those that are not are never listed below."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, waiting = [], [path]
    while waiting:
        folder = waiting.pop()
        out.append(folder.toString())
        waiting += [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and not folder_ignored(s.getPath().getName(), rules)]
    return out


FILE = "path string, lang string, content string, error string, hash string, size_bytes long, lines long, modified timestamp"


def _relative(root: str) -> Column:
    base = root if re.match(r"^[a-z0-9]+:/", root) else Path(root).resolve().as_posix()
    return F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(re.sub("^file:/+", "/", base).rstrip("/")) + "/", "")


def _read(rows: DataFrame) -> DataFrame:
    """Content as text. What is not UTF-8 has none and an ``error``, and stops nothing."""
    valid = F.expr("is_valid_utf8(CAST(content AS STRING))")
    text = F.when(valid, F.col("content").cast("string"))
    return rows.select("path", language(F.col("path")).alias("lang"), text.alias("content"), F.when(~valid, "not UTF-8").alias("error"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size_bytes"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("lines"), F.col("modificationTime").cast("timestamp").alias("modified"))


def read_files(spark: SparkSession, root: str, rules: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, lang, content, error, hash, size_bytes, lines, modified) of the supported files below ``root``.
    Ignored folders are not listed; names and sizes are filtered before any content is read."""
    rules = ignore_rules(root) if rules is None else rules
    rows = spark.read.format("binaryFile").load(walk(spark, root, rules)).withColumn("path", _relative(root))
    kept = rows.where((F.col("length") <= max_bytes) & language(F.col("path")).isNotNull() & ~ignored(F.col("path"), rules))
    return _read(kept)


def index_files(spark: SparkSession, root: str, paths: list[str], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, list[str]]:
    """(files as ``read_files`` gives them, errors): a stated list of relative paths. What is missing or no file is an error."""
    there = [p for p in dict.fromkeys(paths) if Path(root, p).is_file()]
    errors = [f"{p}: no such file" if not Path(root, p).exists() else f"{p}: not a file" for p in dict.fromkeys(paths) if p not in set(there)]
    if not there:
        return spark.createDataFrame([], FILE), errors
    rows = spark.read.format("binaryFile").load([str(Path(root, p)) for p in there]).withColumn("path", _relative(root))
    return _read(rows.where((F.col("length") <= max_bytes) & language(F.col("path")).isNotNull())), errors


def from_contents(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(path, lang, content) of texts in memory."""
    return spark.createDataFrame(rows, "path string, content string").select("path", language(F.col("path")).alias("lang"), "content")


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Paths that were asked for but not found."""
    return wanted.join(found.select("path"), "path", "left_anti")


def modified_since(files: DataFrame, moment) -> DataFrame:
    """Files changed after ``moment``; all if there was none."""
    return files if moment is None else files.where(F.col("modified") > F.lit(moment))


def git_changes(root: str, diff: bool = False) -> list[str]:
    """Changed existing paths by ``git status`` (or ``git diff HEAD``); empty without git."""
    command = ["git", "-C", root, *(["diff", "--name-only", "HEAD"] if diff else ["status", "--porcelain"])]
    try:
        lines = subprocess.run(command, capture_output=True, text=True, timeout=30, check=True).stdout.splitlines()
    except (OSError, subprocess.SubprocessError):
        return []
    if not diff:
        lines = [x[3:].rpartition(" -> ")[2] for x in lines if x[:2].strip()[:1] in ("M", "A", "R")]
    return [x for x in lines if Path(root, x).is_file()]


def read_json(path: str) -> dict:
    """A JSON file; {} if missing or broken."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}


def write_json(path: str, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, default=str))
