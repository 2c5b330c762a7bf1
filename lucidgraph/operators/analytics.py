"""Usage analytics over sessions and tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calls_per_tool(calls: DataFrame) -> DataFrame:
    """Total, success, failure and mean duration, half up, of each tool; most used first."""
    ok = F.sum(F.when(F.col("success"), 1).otherwise(0))
    out = calls.groupBy("tool_name").agg(F.count("*").alias("total_calls"), ok.alias("success_count"), (F.count("*") - ok).alias("failure_count"), F.floor(F.avg("duration_ms") + 0.5).alias("avg_duration_ms"))
    return out.orderBy(F.desc("total_calls"), "tool_name")


def calls_in_range(calls: DataFrame, start, end) -> DataFrame:
    return calls_per_tool(calls.filter(F.col("called_at").between(start, end)))


def recent_sessions(sessions: DataFrame, calls: DataFrame, limit: int = 5) -> DataFrame:
    """The latest sessions with their number of calls, 0 where there is none."""
    top = sessions.orderBy(F.desc("started_at"), "session_id").limit(limit)
    return top.join(calls.groupBy("session_id").agg(F.count("*").alias("_n")), "session_id", "left").withColumn("tool_call_count", F.coalesce("_n", F.lit(0))).drop("_n")


def session_detail(calls: DataFrame, session_id) -> DataFrame:
    return calls.filter(F.col("session_id") == session_id).orderBy("called_at", "request_id")


def profile_report(timings: DataFrame) -> DataFrame:
    """timings: label, ms. Count, sum, least and most of each label."""
    return timings.groupBy("label").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.min("ms").alias("least"), F.max("ms").alias("most"))


def slowest(timings: DataFrame, n: int = 10) -> DataFrame:
    return timings.orderBy(F.desc("ms"), "label").limit(n)
