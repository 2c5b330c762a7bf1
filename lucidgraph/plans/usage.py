"""Usage records: enablement, appends, and the command-line report."""

from __future__ import annotations

import argparse
import json
import os
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import wraps

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lucidgraph.operators import analytics
from lucidgraph.sources.files import read_sessions, read_tool_calls

_OFF = ("", "0", "false", "off", "no")


def enabled(variable: str = "LUCIDGRAPH_ANALYTICS", config: str | None = None) -> bool:
    if variable in os.environ:
        return os.environ[variable].lower() not in _OFF
    if config and os.path.exists(config):
        with open(config, encoding="utf-8") as f:
            return bool(json.load(f).get("analytics", False))
    return False


class UsageLog:
    """Appends one JSON line a tool call, and the session at its end. Failing to write never fails a call."""

    def __init__(self, folder: str, project_path: str = ""):
        self.folder, self.session_id, self.project_path, self.calls = folder, str(uuid.uuid4()), project_path, 0
        self.started_at = _now()

    def _append(self, name: str, row: dict) -> None:
        try:
            os.makedirs(self.folder, exist_ok=True)
            with open(os.path.join(self.folder, name), "a", encoding="utf-8") as f:
                f.write(json.dumps(row) + "\n")
        except OSError:
            pass

    def record(self, tool: str, called_at: str, duration_ms: int, error: str | None, arguments: dict) -> None:
        self.calls += 1
        self._append("tool_calls.jsonl", {"session_id": self.session_id, "tool_name": tool, "called_at": called_at, "duration_ms": duration_ms, "success": error is None, "error_message": error, "arguments": json.dumps(arguments, default=str), "request_id": str(uuid.uuid4())})

    def close(self) -> None:
        if self.calls:
            self._append("sessions.jsonl", {"session_id": self.session_id, "started_at": self.started_at, "project_path": self.project_path})

    def tool(self, name: str) -> Callable:
        """Decorator: times each call and records whether it failed."""

        def wrap(f: Callable) -> Callable:
            @wraps(f)
            def run(*args, **kw):
                at, began, error = _now(), time.monotonic(), None
                try:
                    return f(*args, **kw)
                except Exception as e:
                    error = str(e)
                    raise
                finally:
                    self.record(name, at, round((time.monotonic() - began) * 1000), error, kw)

            return run

        return wrap


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Usage report")
    parser.add_argument("folder")
    parser.add_argument("--since")
    parser.add_argument("--session")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    calls = read_tool_calls(spark, args.folder)
    if args.session:
        analytics.session_detail(calls, args.session).show(truncate=False)
    elif args.since:
        analytics.calls_in_range(calls, F.lit(f"{args.since}T00:00:00.000Z"), F.lit("9999-12-31T23:59:59.999Z")).show(truncate=False)
    else:
        analytics.calls_per_tool(calls).show(truncate=False)
        analytics.recent_sessions(read_sessions(spark, args.folder), calls).show(truncate=False)


if __name__ == "__main__":
    main()
