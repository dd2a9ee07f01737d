"""JSON-RPC 2.0 over lines of text: the scan, the index and its queries for editors and agents.

Requests are answered one after the other, so no two of them index at once. ``scan_changed`` streams: a line for each message,
the last of type ``stream_complete``.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import cli
from tessera.config import Config
from tessera.functions import tokens as K
from tessera.operators import report, scoring, vectors
from tessera.operators import store as tables
from tessera.plans import scan
from tessera.sources import files as S

# Error codes of the protocol and the options that a client may set.
PARSE_ERROR, NO_METHOD, INTERNAL = (-32700, "Parse error"), (-32601, "Method not found"), (-32603, "Internal error")
SETTABLE = ("min_tokens", "tau_semantic", "overlap_threshold", "edit_density_threshold", "max_candidates", "min_refactor_score", "ignore_patterns")
CONTEXT = 3


class Service:
    def __init__(self, spark: SparkSession, cache: str, config: Config | None = None, root: str | None = None):
        self.spark, self.store, self.config, self.root = spark, tables.Store(spark, cache), config or Config(), root
        self.methods = {"index_repo": self.index_repo, "index_status": self.index_status, "scan_repo": self.scan_repo, "explain": self.explain, "configure": self.configure, "clear_index": self.clear_index}

    # Methods ---------------------------------------------------------------------------------------------------------
    def index_repo(self, root: str, reindex: bool = False) -> dict:
        self.root = root
        return {"started": True, "stats": cli.index_tree(self.store, root, self.config, reindex)}

    def index_status(self) -> dict:
        """Shares of blocks with a signature, of those with a verified pair, and of pairs with a semantic score; dirty if a
        file of the tree is not as it was indexed."""
        stats = self.store.statistics()
        found = self.store.read("findings")
        semantic = found.where(F.col("type") == "semantic").count()
        row = self.spark.range(1).select(*(scoring.pass_percentage(F.lit(a), F.lit(b)).alias(str(i)) for i, (a, b) in enumerate([(self.store.read("signatures").count(), stats["total_blocks"]), (found.select("src").distinct().count(), self.store.read("signatures").count()), (semantic, found.count())])))
        passes = {k: f"{v}%" for k, v in row.first().asDict().items()}
        dirty = bool(self.root) and not tables.changed_files(S.read_files(self.spark, self.root, S.ignore_rules(self.root, self.config.ignore_patterns)), self.store.read("files")).isEmpty()
        return {"passes": passes, "dirty": dirty, "errors": [], "stats": stats}

    def scan_repo(self, scope: str = "all", budget_ms: int | None = None, options: dict | None = None) -> list[dict]:
        """The findings of the whole tree as resources; they are stored as well."""
        self.configure(options or {})
        out, _, warning = scan.within_budget(self.spark, budget_ms or 0, lambda: self._kept(scan.scan_repository(self.spark, self._tree(), self.config)))
        if out is None:
            raise TimeoutError(warning)
        result, rows = out
        found = scoring.resource(scoring.in_scope(rows, scope), result.blocks)
        listed = [json.loads(r["json"]) for r in found.toLocalIterator()]
        self._release(result, rows)
        return listed

    def scan_changed(self, paths: list[str] | None = None, options: dict | None = None) -> Iterator[dict]:
        """Progress, a message for each finding of the changed files against the index, and the end."""
        self.configure(options or {})
        changed = S.git_changes(self._tree(), diff=True) if paths is None else paths
        if not changed:
            yield {"type": "info", "total": 0}
            return
        result, rows = self._kept(scan.scan_changed(self.spark, self._tree(), changed, cli.normalized_index(self.store), self.config, self.store.read("signatures")))
        yield from report.messages(rows.select("finding_id", "src", "match", "type", "refactor_score", *scoring.SCORES[:4]))
        self._release(result, rows)

    def explain(self, finding_id: str) -> dict:
        """One finding: scores, both places with lines around them, and the difference of the normalised tokens."""
        row = tables.finding_by_id(self.store.read("findings"), finding_id).first()
        if row is None:
            raise ValueError(f"no such finding: {finding_id}")
        blocks = {r["block_id"]: r for r in K.normalize(self.store.read("blocks").where(F.col("block_id").isin(row["src"], row["match"])), mappings=False).collect()}
        if not {row["src"], row["match"]} <= blocks.keys():
            raise ValueError("the finding's blocks are not indexed")
        pair = [blocks[row["src"]], blocks[row["match"]]]
        diff = report.diff_text("\n".join(pair[0]["normalized_tokens"]), "\n".join(pair[1]["normalized_tokens"]), row["src"], row["match"])
        return {"finding_id": finding_id, "normalized_diff": diff, "codeframes": [self._frame(b) for b in pair], "scores": dict(row["scores"]), "type": row["type"], "confidence": row["confidence"]}

    def configure(self, policy_json: dict) -> dict:
        """Set the options that may be set; others are passed over."""
        for key in SETTABLE:
            if key in policy_json:
                setattr(self.config, key, policy_json[key])
        return {"ok": True}

    def clear_index(self) -> dict:
        self.store.clear()
        vectors.clear(self.store.read("embeddings"))
        return {"ok": True}

    # Helpers ---------------------------------------------------------------------------------------------------------
    def _tree(self) -> str:
        if not self.root:
            raise ValueError("index a repository first")
        return self.root

    def _kept(self, result: scan.ScanResult) -> tuple[scan.ScanResult, DataFrame]:
        result.persist()
        rows = result.findings.persist()
        if not rows.isEmpty():
            self.store.initialize()
            self.store.upsert_findings(scoring.stored(rows))
        return result, rows

    @staticmethod
    def _release(result: scan.ScanResult, rows: DataFrame) -> None:
        rows.unpersist()
        result.unpersist()

    def _frame(self, block) -> dict:
        rows, errors = S.index_files(self.spark, self._tree(), [block["file_path"]])
        text = rows.select(report.frame(F.col("content"), F.lit(block["start_line"]), F.lit(block["end_line"]), CONTEXT).alias("text")).first()
        return {"path": block["file_path"], "start": block["start_line"], "end": block["end_line"], "code": text["text"] if text else None, "error": errors[0] if errors else None}

    # Protocol --------------------------------------------------------------------------------------------------------
    def answers(self, line: str) -> Iterator[dict]:
        """The answers to one line."""
        def failed(error: tuple[int, str], data=None, ident=None) -> dict:
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": error[0], "message": error[1]} | ({"data": data} if data else {})}

        try:
            request = json.loads(line)
        except ValueError as e:
            yield failed(PARSE_ERROR, str(e))
            return
        ident, method, params = request.get("id"), request.get("method"), request.get("params") or {}
        answer = lambda result: {"jsonrpc": "2.0", "id": ident, "result": result}
        try:
            if method == "scan_changed":
                for message in self.scan_changed(**params):
                    yield answer(message)
                yield answer({"type": "stream_complete"})
            elif method in self.methods:
                yield answer(self.methods[method](**params))
            else:
                yield failed((NO_METHOD[0], f"{NO_METHOD[1]}: {method}"), ident=ident)
        except Exception as e:  # any failure is an answer; the service goes on
            yield failed(INTERNAL, str(e), ident)

    def serve(self, lines: Iterable[str] = sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip():
                for a in self.answers(line):
                    print(json.dumps(a, default=str), file=out, flush=True)
