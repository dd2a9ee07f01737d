"""Command line: index, scan and status."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import tokens as K
from tessera.operators import minhash, report, scoring
from tessera.operators.store import Store, block_id, changed_files
from tessera.plans.scan import scan_changed, scan_repository, within_budget
from tessera.sources import blocks as B
from tessera.sources import files as S


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--config")
    p.add_argument("--cache-dir")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("paths", nargs="*", default=["."])
    index.add_argument("--reindex", action="store_true", help="read all files again, not only changed ones")
    scan = sub.add_parser("scan")
    scan.add_argument("path", nargs="?", default=".")
    scan.add_argument("--changed", "--only-changed", action="store_true")
    scan.add_argument("--repo", action="store_true", help="the whole repository, which is the default")
    scan.add_argument("--json")
    scan.add_argument("--markdown")
    scan.add_argument("--budget-ms", type=int, default=0, help="stop the scan's jobs at 95 %% of it; 0: no budget")
    scan.add_argument("--min-tokens", type=int)
    scan.add_argument("--tau-sem", type=float)
    scan.add_argument("--exclude", action="append", default=[])
    sub.add_parser("status")
    serve = sub.add_parser("serve", help="answer JSON-RPC requests, a line each")
    serve.add_argument("--root")
    return p


def index_tree(store: Store, root: str, config: Config, reindex: bool = False, paths: list[str] | None = None) -> dict:
    """Read new and changed files (all with ``reindex``, or a stated list) into the store: files, blocks in place of all that
    the file had before, and signatures. The effective ignore list is kept as metadata."""
    spark = store.spark
    store.initialize()
    rules = S.ignore_rules(root, config.ignore_patterns)
    found, errors = (S.read_files(spark, root, rules), []) if paths is None else S.index_files(spark, root, paths)
    files = (found if reindex else changed_files(found, store.read("files"))).persist()
    useful = B.useful(B.extract_blocks(files.where("content IS NOT NULL"), config.supported_languages), config.min_tokens)
    rows = useful.withColumn("block_id", block_id(F.col("file_path"), F.col("start_line"), F.col("end_line")))
    normal = K.normalize(rows, mappings=False)
    blocks = normal.select("block_id", "file_path", "start_line", "end_line", "lang", "tokens", "normalized_tokens", K.short_hash(F.col("normalized_tokens")).alias("norm_hash"), F.lit(0).cast("long").alias("churn"), "node_type", K.complexity(F.col("tokens")).alias("complexity"), F.current_timestamp().alias("updated_at")).persist()
    n_files, n_blocks = files.count(), blocks.count()
    errors += [f"{r['path']}: {r['error']}" for r in files.where("error IS NOT NULL").select("path", "error").toLocalIterator()]
    if n_files:
        store.replace_blocks(files.select("path"), blocks)
        store.add_signatures(minhash.signatures(blocks, "block_id", F.col("normalized_tokens"), config.num_hashes, config.shingle_size))
        # Files last: until they are noted, a repeated call reads them again.
        store.upsert_files(files.select("path", "lang", "hash", F.current_timestamp().alias("last_indexed"), F.lit(False).alias("ignored"), "size_bytes", "lines"))
    store.set_metadata("ignore_patterns", json.dumps(rules))
    store.set_metadata("last_indexed", str(spark.sql("SELECT unix_timestamp(current_timestamp())").first()[0]))
    blocks.unpersist()
    files.unpersist()
    return {"files_indexed": n_files, "blocks_indexed": n_blocks, "errors": errors}


def normalized_index(store: Store) -> DataFrame:
    return K.normalize(store.read("blocks").select("block_id", "lang", "tokens"), mappings=False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = Config.load(args.config) if args.config else Config()
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    store = Store(spark, args.cache_dir or config.cache_dir or ".tessera")
    say = (lambda *a: None) if args.quiet else print
    if args.command == "status":
        for k, v in store.statistics().items():
            say(f"{k}: {report.size_text(v * 1024 * 1024) if k == 'size_mb' else v}")
        return 0
    if args.command == "serve":
        from tessera.server import Service

        Service(spark, store.root, config, args.root).serve()
        return 0
    if args.command == "index":
        for path in args.paths:
            done = index_tree(store, path, config, args.reindex)
            say(f"{path}: {done['files_indexed']} files, {done['blocks_indexed']} blocks")
            for e in done["errors"] if args.verbose else ():
                say(e)
        return 0
    config.min_tokens = args.min_tokens if args.min_tokens is not None else config.min_tokens
    config.tau_semantic = args.tau_sem if args.tau_sem is not None else config.tau_semantic
    config.ignore_patterns = [*config.ignore_patterns, *args.exclude]

    def run():
        if args.changed and not args.repo:
            found = scan_changed(spark, args.path, S.git_changes(args.path, diff=True), normalized_index(store), config, store.read("signatures"))
        else:
            found = scan_repository(spark, args.path, config)
        found.persist()
        kept = found.findings.withColumn("file_path", F.regexp_extract("src", "^(.*):[0-9]+:[0-9]+$", 1)).persist()
        return found, kept, kept.count(), found.statistics() if args.json or args.verbose else {}

    done, took, warning = within_budget(spark, args.budget_ms, run)
    if warning:
        print(warning, file=sys.stderr)
    if done is None:
        return 2
    result, rows, n, counters = done
    stages = {"scan": took}
    if n:
        store.initialize()
        store.upsert_findings(scoring.stored(rows))
    if args.json:
        Path(args.json).parent.mkdir(parents=True, exist_ok=True)
        with open(args.json, "w") as f:
            f.writelines(report.json_parts(rows, {**counters, "scan_time_ms": took, "stage_times_ms": stages}))
    if args.markdown or not args.json:
        with open(args.markdown or "dupes.md", "w") as f:
            f.writelines(f"{line}\n" for line in report.markdown_lines(rows, stages, report.contents(rows, result.blocks)))
    for k, v in counters.items() if args.verbose else ():
        say(f"{k}: {v}")
    for r in scoring.top_findings(rows, limit=3).collect():
        say(f"{r['src']} ~ {r['match']}: {r['refactor_score']:.0f}")
    rows.unpersist()
    result.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
