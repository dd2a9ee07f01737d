"""File-change events: filters, debouncing, rate limits and the application of batches, as batch and as stream."""

from __future__ import annotations

import datetime
import json
import os
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.files import folder_ignored, ignored, language

GAP_SECONDS, LIMIT, WINDOW_SECONDS, COUNT_TRIGGER = 2, 500, 60, 100
EVENT = "path string, event_type string, ts timestamp, old_path string"


def relevant(path: Column, event_type: Column, rules: list[str] = ()) -> Column:
    """Deletions always count; others for supported, not ignored, not hidden and not temporary names."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    fine = language(path).isNotNull() & ~name.startswith(".") & ~F.lower(name).rlike(r"[.](tmp|bak|swp)$") & ~ignored(path, list(rules))
    return (event_type == "deleted") | fine


def rate_limited(events: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, key: str | None = None) -> DataFrame:
    """Events with in_window, the attempts in the last ``seconds`` (itself included, the far bound excluded), and
    accepted. ``key`` (a watched root) limits each key by itself and deals the work."""
    micros = F.unix_micros("ts")
    w = Window.partitionBy(*([key] if key else [F.lit(1)])).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("accepted", F.col("in_window") <= limit)


def debounced(events: DataFrame, gap: int = GAP_SECONDS, key: str | None = None) -> DataFrame:
    """(session, path, event_type, ts, n_events): the latest event of each path in each burst; a burst ends with a pause
    of more than ``gap`` seconds."""
    part = [key] if key else [F.lit(1)]
    w = Window.partitionBy(*part).orderBy("ts", "event_id")
    pause = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > gap * 1_000_000
    rows = events.withColumn("session", F.sum(F.when(pause, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = rows.groupBy(*([key] if key else []), "session", "path").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"), F.count("*").alias("n_events"))
    return last.select(*([key] if key else []), "session", "path", "e.event_type", "e.ts", "n_events")


def debounced_stream(events: DataFrame, gap: int = GAP_SECONDS, lateness: str = "10 seconds") -> DataFrame:
    """Bursts of single paths on a stream: session windows that close behind the watermark. The pause that ends a burst is
    the path's own; ``burst_stream`` has the root's."""
    rows = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", f"{gap} seconds").alias("w"), "path").agg(F.max(F.struct("ts", "event_type")).alias("e"), F.count("*").alias("n_events"))
    return rows.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "path", "e.event_type", "e.ts", "n_events")


def burst_stream(events: DataFrame, gap: int = GAP_SECONDS, lateness: str = "10 seconds", root: str = "root") -> DataFrame:
    """(root, started, path, event_type, ts, n_events): as ``debounced`` on a stream. Any event of a root goes on with its
    burst, whatever its path; a burst holds one event for each path and comes out behind the watermark."""
    rows = events.withWatermark("ts", lateness)
    per_burst = rows.groupBy(F.session_window("ts", f"{gap} seconds").alias("w"), root).agg(F.collect_list(F.struct("path", "ts", "event_type")).alias("e"))
    each = per_burst.select(root, F.col("w.start").alias("started"), F.explode(F.array_distinct(F.transform("e", lambda x: x["path"]))).alias("path"), "e")
    own = each.withColumn("own", F.filter("e", lambda x: x["path"] == F.col("path")))
    last = F.array_max(F.transform("own", lambda x: F.struct(x["ts"].alias("ts"), x["event_type"].alias("event_type"))))
    return own.select(root, "started", "path", last["event_type"].alias("event_type"), last["ts"].alias("ts"), F.size("own").cast("long").alias("n_events"))


def rate_limited_stream(events: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, root: str = "root") -> DataFrame:
    """(root, path, event_type, ts, in_window, accepted): as ``rate_limited`` on a stream, by root. The state holds the moments
    of the last ``seconds``, at most ``limit + 1`` of them: more cannot change a decision, and ``in_window`` stops there."""

    def step(key, batches, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out, span = [], seconds * 1_000_000
        for path, kind, ts in zip(pdf["path"], pdf["event_type"], pdf["ts"]):
            now = pd.Timestamp(ts).value // 1000
            held = [t for t in held if t > now - span][-limit:] + [now]
            out.append((key[0], path, kind, ts, len(held), len(held) <= limit))
        state.update((held,))
        yield pd.DataFrame(out, columns=["root", "path", "event_type", "ts", "in_window", "accepted"])

    return events.groupBy(root).applyInPandasWithState(step, "root string, path string, event_type string, ts timestamp, in_window long, accepted boolean", "moments array<long>", "append", GroupStateTimeout.NoTimeout)


def batched_stream(events: DataFrame, root: str = "root", count: int = COUNT_TRIGGER, gap: int = GAP_SECONDS) -> DataFrame:
    """(root, path, event_type, ts): a root's pending paths are sent when ``count`` of them wait or ``gap`` seconds pass.
    The state holds one event for each waiting path."""

    def step(key, batches, state: GroupState):
        waiting = dict(zip(*state.get)) if state.exists and not isinstance(state.get[0], str) else {}
        for pdf in batches:
            for p, e, t in zip(pdf["path"], pdf["event_type"], pdf["ts"]):
                waiting[p] = f"{e}\x1f{pd.Timestamp(t).isoformat()}"
        if waiting and (state.hasTimedOut or len(waiting) >= count):
            state.remove()
            rows = [(key[0], p, *v.split("\x1f")) for p, v in waiting.items()]
            yield pd.DataFrame([(r, p, e, pd.Timestamp(t)) for r, p, e, t in rows], columns=["root", "path", "event_type", "ts"])
        elif waiting:
            state.update((list(waiting), list(waiting.values())))
            state.setTimeoutDuration(gap * 1000)

    return events.groupBy(root).applyInPandasWithState(step, "root string, path string, event_type string, ts timestamp", "paths array<string>, events array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def apply_batch(store, batch: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Deletions and old paths of moves go first; then created, modified and moved files are read, and what ``read`` gives
    for them replaces all their blocks, so none of a former state stays."""
    gone = batch.where("event_type = 'deleted'").select("path").union(batch.where("event_type = 'moved' AND old_path IS NOT NULL").select("old_path")).distinct()
    store.delete_files(gone)
    if read is not None:
        changed = batch.where("event_type IN ('created', 'modified', 'moved')").select("path").distinct()
        store.replace_blocks(changed, read(changed))


class FileEvents(DataSource):
    """A stream of file events of a local tree: ``spark.readStream.format("file_events").load(root)`` after ``register``.

    Each trigger lists the tree and compares it with the listing that the offset holds: new names are created, other times
    or sizes modified, missing names deleted. The first listing is the start and gives no events.
    """

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return "root string, path string, event_type string, ts timestamp, old_path string"

    def simpleStreamReader(self, schema) -> "FileEventReader":
        return FileEventReader(self.options["path"], json.loads(self.options.get("rules", "[]")))


class FileEventReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, rules: list[str]):
        self.root, self.rules = root, rules

    def listing(self) -> dict[str, str]:
        out = {}
        for folder, inner, names in os.walk(self.root):
            inner[:] = [d for d in inner if not folder_ignored(d, self.rules)]
            for name in names:
                full = os.path.join(folder, name)
                try:
                    s = os.stat(full)
                except OSError:
                    continue
                out[os.path.relpath(full, self.root).replace(os.sep, "/")] = f"{s.st_mtime_ns}:{s.st_size}"
        return out

    def initialOffset(self) -> dict:
        return {"files": self.listing()}

    @staticmethod
    def changes(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str]]:
        return [(p, "deleted") for p in sorted(old.keys() - new.keys())] + [(p, "modified" if p in old else "created") for p in sorted(new) if old.get(p) != new[p]]

    def read(self, start: dict):
        now = self.listing()
        moment = datetime.datetime.now()
        return iter([(self.root, p, e, moment, None) for p, e in self.changes(start["files"], now)]), {"files": now}

    def readBetweenOffsets(self, start: dict, end: dict):
        moment = datetime.datetime.now()
        return iter([(self.root, p, e, moment, None) for p, e in self.changes(start["files"], end["files"])])


def register(spark) -> None:
    spark.dataSource.register(FileEvents)


class Watcher:
    """Start, stop, pause, resume and status of one stream of events for each root. What a pause misses comes with the
    first batch after it: the checkpoint holds the place."""

    def __init__(self):
        self.queries: dict[str, StreamingQuery] = {}
        self.held: dict[str, tuple] = {}
        self.paused: set[str] = set()
        self.began: dict[str, float] = {}

    def start(self, root: str, events: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
        if root in self.queries and self.queries[root].isActive:
            raise ValueError(f"{root} is watched already")
        self.held[root] = (events, on_batch, checkpoint)
        self.queries[root] = events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).start()
        self.began[root] = time.time()
        self.paused.discard(root)

    def pause(self, root: str | None = None) -> None:
        for name in [root] if root else list(self.queries):
            if name not in self.paused:
                self.queries[name].stop()
                self.paused.add(name)

    def resume(self, root: str | None = None) -> None:
        for name in [root] if root else sorted(self.paused):
            if name in self.paused:
                self.start(name, *self.held[name])

    def stop(self, root: str | None = None) -> None:
        for name in [root] if root else list(self.queries):
            self.queries.pop(name).stop()
            self.held.pop(name)
            self.paused.discard(name)

    def status(self) -> dict[str, dict]:
        return {r: {"active": q.isActive, "paused": r in self.paused, "uptime_seconds": time.time() - self.began[r], "progress": q.lastProgress} for r, q in self.queries.items()}
