"""Connected components of an edge table by alternating large and small stars, without a hot partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidgraph.llm.common import attach_groups, counted, discard, staged


def _star(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """edges: u, v. Each u with each v and the least of u and its neighbours; and the table of the least."""
    least = staged(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count("*").alias("_degree")), "least")
    return attach_groups(edges, least, "u", "_degree", n), least


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b, not null. One row for each node that has a smaller one in its component: node, component.

    component is the smallest node of the component. Edges in both directions, loops and repeats do no harm, and
    without edges there are no rows. Tables of earlier rounds are deleted.
    """
    now, n = counted(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, least = _star(both, 2 * n)
        large, m = counted(large.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct(), "edges")
        discard(now, least)
        small, least = _star(large, m)
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*")
        now, n = counted(small.filter("u <> v").distinct(), "edges")
        discard(large, least)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _is_done(edges: DataFrame) -> bool:
    """Whether each u > v has one edge and no v is a u: then each component is a star around its smallest node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    uses = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return uses.filter("up > 1 or up > 0 and down > 0").limit(1).count() == 0
