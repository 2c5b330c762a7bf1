"""File changes as a stream: a polling source, debounce, and upserts by micro-batch.

The built-in file source sees new files only; this one compares the folder with what it saw last and reports
updates and deletions too.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lucidgraph.operators.maintenance import latest_events
from lucidgraph.plans.project import Project

_FIELDS = "path STRING, op STRING, event_seq BIGINT, content STRING"


class FolderChanges(DataSource):
    """format("folder_changes").option("root", ...): add, change and delete events of the files below root.

    For a folder that the driver sees, as a watched working copy is. Offsets hold what was seen, so that a restart
    from a checkpoint reports each change once.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return _FIELDS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["root"], self.options.get("suffixes", ".py").split(","))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, suffixes: list[str]):
        self.root, self.suffixes = root, tuple(suffixes)

    def initialOffset(self) -> dict:
        return {"seq": 0, "files": {}}

    def _now(self) -> dict[str, int]:
        found = {}
        for folder, _, names in os.walk(self.root):
            for n in names:
                if n.endswith(self.suffixes):
                    p = os.path.join(folder, n)
                    try:
                        found[os.path.relpath(p, self.root)] = os.stat(p).st_mtime_ns
                    except OSError:
                        continue  # went meanwhile
        return found

    def _between(self, before: dict, after: dict) -> list[tuple]:
        events = [(p, "change" if p in before["files"] else "add") for p, t in sorted(after["files"].items()) if before["files"].get(p) != t]
        events += [(p, "delete") for p in sorted(before["files"]) if p not in after["files"]]
        out = []
        for i, (path, op) in enumerate(events):
            content = None
            if op != "delete":
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                        content = f.read()
                except OSError:
                    continue  # a read that fails is dropped
            out.append((path, op, before["seq"] + i, content))
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"seq": start["seq"], "files": self._now()}
        rows = self._between(start, end)
        end["seq"] += len(rows)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._between(start, end))

    def commit(self, end: dict) -> None:
        pass


def debounce(events: DataFrame, quiet_ms: int = 300) -> DataFrame:
    """The last event of each path once it has been quiet for so long (processing time)."""

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            op, seq, content = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "op": [op], "event_seq": [seq], "content": [content]})
            return
        last = state.get if state.exists else None
        for b in batches:
            row = b.loc[b["event_seq"].idxmax()]
            if last is None or row["event_seq"] > last[1]:
                last = (row["op"], int(row["event_seq"]), row["content"])
        state.update(last)
        state.setTimeoutDuration(quiet_ms)

    return events.groupBy("path").applyInPandasWithState(settle, _FIELDS, "op STRING, event_seq BIGINT, content STRING", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Watcher:
    """Keeps a project up to date by micro-batches; each batch counts once, so that a repeated one does no harm."""

    def __init__(self, project: Project, then: Callable[[Project], None] | None = None):
        self.project, self.then, self.done = project, then, -1

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done or batch.isEmpty():
            return
        last = latest_events(batch)
        changed = last.filter("op <> 'delete' and content is not null").select("path", "content")
        self.project = self.project.upsert(changed, last.filter("op = 'delete'").select("path"))
        self.done = batch_id
        if self.then:
            self.then(self.project)

    def start(self, spark: SparkSession, root: str, checkpoint: str, every: str = "1 second"):
        spark.dataSource.register(FolderChanges)
        events = spark.readStream.format("folder_changes").option("root", root).load()
        return events.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def usage_counts(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming calls by tool and window; rows later than the watermark are dropped. called_at is a timestamp."""
    timed = calls.withWatermark("called_at", late)
    return timed.groupBy(F.window("called_at", width), "tool_name").agg(F.count("*").alias("calls"), F.sum(F.when(F.col("success"), 0).otherwise(1)).alias("failures"))
