"""Recursive queries as fixpoints: each round joins what is new, and what is done is written out of the plan.

Rounds end when nothing is new, so cycles are harmless. Written tables go to the cluster's checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, so that lineage ends here and executors may be lost."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = folder or f"{tempfile.gettempdir()}/lucidgraph"
    path = f"{folder}/fixpoint-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(start: DataFrame, edges: DataFrame, *, max_rounds: int = 10_000) -> DataFrame:
    """start: root, node. edges: src, dst. All distinct (root, node) that edges lead to, start included."""
    seen = new = written(start.select("root", "node").distinct())
    for _ in range(max_rounds):
        step = new.join(edges, new["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        new = written(step.join(seen, ["root", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def ancestors(parents: DataFrame, *, include_self: bool = True) -> DataFrame:
    """parents: id, parent (at most one each, null at roots). id, ancestor, dist.

    By doubling: what lies within n hops, seen from where n hops lead to, lies within 2 n hops; so the rounds are as
    many as the depth has binary digits. On a cycle each node is an ancestor once, at its least distance.
    """
    jump = written(parents.filter("parent is not null").select("id", F.col("parent").alias("up")))
    out = written(parents.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("dist")))
    hops = 1
    while True:
        at = out.select(F.col("id").alias("up"), "ancestor", "dist")
        step = jump.join(at, "up").groupBy("id", "ancestor").agg((F.min("dist") + hops).alias("dist"))
        new = written(step.join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        if new.isEmpty():
            return out if include_self else out.filter("dist > 0")
        out = out.unionByName(new)
        jump = written(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up")))
        hops *= 2


def chase(pointers: DataFrame) -> DataFrame:
    """pointers: src, next (one each). src, target: the end of each chain, null where it runs into a cycle.

    Pointer jumping: each round doubles the distance, so a chain of n hops takes log2(n) rounds; a pointer that
    has not ended after as many rounds as there are doublings of the number of pointers is on a cycle.
    """
    ends = pointers.select(F.col("next").alias("src")).distinct().join(pointers.select("src"), "src", "left_anti")
    now = written(pointers.select("src", F.col("next").alias("at")).join(ends.select(F.col("src").alias("at"), F.lit(True).alias("done")), "at", "left").select("src", "at", F.coalesce("done", F.lit(False)).alias("done")))
    n, hops = now.count(), 1
    while hops <= n and not now.filter("not done").isEmpty():
        nxt = now.select(F.col("src").alias("at"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        now = written(now.join(nxt, "at", "left").select("src", F.when(F.col("done"), F.col("at")).otherwise(F.col("_at")).alias("at"), (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done")))
        hops *= 2
    return now.select("src", F.when(F.col("done"), F.col("at")).alias("target"))


def paths(root: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """root: node. Trees to a depth, or, for None, as deep as they go: path array, depth, node, cycle.

    A node that stands on its own path is a leaf marked as cycle; that is tested before the depth, so such a leaf
    may stand one level below the limit.
    """
    level = root.select(F.array("node").alias("path"), F.lit(0).alias("depth"), "node", F.lit(False).alias("cycle"))
    out, new, depth = level, level, 0
    while max_depth is None or depth <= max_depth:
        depth += 1
        step = new.filter("not cycle").join(edges, F.col("node") == F.col("src")).select("path", F.col("dst").alias("node"))
        step = step.withColumn("cycle", F.array_contains("path", F.col("node")))
        if max_depth is not None and depth > max_depth:
            step = step.filter("cycle")
        new = step.select(F.concat("path", F.array("node")).alias("path"), F.lit(depth).alias("depth"), "node", "cycle").distinct()
        if max_depth is None:
            new = written(new)
            if new.isEmpty():
                break
        out = out.unionByName(new)
    return out


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows of equal keys meet after a partial minimum, not in a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
