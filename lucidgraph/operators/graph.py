"""Call-graph operators over nodes and edges.

nodes: node, and columns that filters need. edges: caller, callee; a pair may repeat, each is one resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidgraph.operators.recursion import closure, paths


def call_graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with n_calls and their callees in order."""
    calls = edges.groupBy(F.col("caller").alias("node")).agg(F.count("*").alias("n_calls"), F.array_sort(F.collect_set("callee")).alias("callees"))
    return nodes.join(calls, "node", "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0))).withColumn("callees", F.coalesce("callees", F.array().cast(edges.select(F.array("callee").alias("c")).schema["c"].dataType)))


def referenced(edges: DataFrame, indirect: DataFrame) -> DataFrame:
    """Distinct nodes that a call resolves to or that are reached as values. indirect: node."""
    return edges.select(F.col("callee").alias("node")).unionByName(indirect.select("node")).distinct()


def entry_points(nodes: DataFrame, used: DataFrame, *, hidden: Column | None = None) -> DataFrame:
    """Nodes that nothing refers to, without those hidden (tests, framework methods)."""
    out = nodes.join(used, "node", "left_anti")
    return out if hidden is None else out.filter(~F.coalesce(hidden, F.lit(False)))


def is_framework_method(name: Column, language: Column) -> Column:
    """Python's double-underscore methods, but for those that code calls by another name."""
    return (language == "python") & name.rlike("^__.+__$") & ~name.isin("__init__", "__call__", "__new__")


def tree_sizes(roots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """roots: node. node, tree_size: resolutions of all nodes reachable from it, each node counted once."""
    calls = edges.groupBy("caller").agg(F.count("*").alias("_n"))
    reach = closure(roots.select(F.col("node").alias("root"), "node"), edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct())
    known = reach.join(nodes.select("node"), "node", "left_semi").join(calls, F.col("node") == F.col("caller"), "left")
    return known.groupBy(F.col("root").alias("node")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("tree_size"))


def callers_index(edges: DataFrame) -> DataFrame:
    """callee, callers in order; a node doesn't call itself here."""
    return edges.filter("caller <> callee").groupBy("callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def neighbourhood(root: DataFrame, edges: DataFrame, depth: int | None, *, callers: bool = False) -> DataFrame:
    """Tree of callees, or of callers, below each root to the depth, None being no limit: path, depth, node, cycle."""
    src, dst = ("callee", "caller") if callers else ("caller", "callee")
    used = edges.filter("caller <> callee") if callers else edges
    return paths(root, used.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), depth)


def callback_edges(callbacks: DataFrame, calls: DataFrame) -> DataFrame:
    """callbacks: symbol, file, line, column of the call that gets them. A synthetic call where one starts there."""
    at = calls.select("file", "line", "column").distinct()
    return callbacks.join(at, ["file", "line", "column"], "left_semi")


def functions_as_values(reads: DataFrame, functions: DataFrame) -> DataFrame:
    """reads: symbol, location, ord. functions: symbol, location. The last read of each function, but for its own definition."""
    own = functions.select("symbol", F.col("location").alias("_own"))
    used = reads.join(own, "symbol").filter(F.col("location") != F.col("_own"))
    return used.groupBy("symbol").agg(F.max_by("location", F.struct("ord", "location")).alias("read_at"))
