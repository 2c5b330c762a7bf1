"""Bindings, exports and name lookup: precedence as minima over ordered structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidgraph.operators.recursion import chase, first_by


def scope_bindings(definitions: DataFrame) -> DataFrame:
    """defining_scope_id, name, symbol_id, ord: the last definition of a name in a scope wins."""
    return definitions.groupBy("scope", "name").agg(F.max_by("symbol", F.struct("ord", "symbol")).alias("symbol"), F.max("ord").alias("ord"))


def member_index(members: DataFrame) -> DataFrame:
    """type, name, member: a property overrides a method of its name, and the later overrides the earlier."""
    return members.groupBy("type", "name").agg(F.max_by("member", F.struct("is_property", "ord", "member")).alias("member"))


def lexical_resolve(references: DataFrame, scope_ancestors: DataFrame, bindings: DataFrame) -> DataFrame:
    """references: ref, scope, name. bindings: scope, name, symbol, layer (0 local, 1 import), null symbols don't bind.

    The nearest scope that binds the name wins; in a scope locals come before imports. Keeps unresolved with null.
    """
    wanted = references.select("scope", "name").distinct()
    reach = wanted.join(scope_ancestors.select(F.col("id").alias("scope"), F.col("ancestor").alias("_at"), "dist"), "scope")
    usable = bindings.filter("symbol is not null").select(F.col("scope").alias("_at"), "name", "symbol", "layer")
    hits = reach.join(usable, ["_at", "name"])
    best = hits.groupBy("scope", "name").agg(F.min_by("symbol", F.struct("dist", "layer", "symbol")).alias("symbol"))
    return references.join(best, ["scope", "name"], "left")


def resolve_exports(exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """exports: file, export_name, symbol, kind, is_reexport, language, line.

    The export that stands for each name, and those that lose for no rule and so are conflicts: local beats
    re-export, a variable beats a function of its name, in Python the later line wins.
    """
    ranked = first_by(
        exports,
        ["file", "export_name"],
        [F.col("is_reexport"), F.when(F.col("kind").isin("variable", "constant"), 0).otherwise(1), F.when(F.col("language") == "python", -F.col("line")).otherwise(F.col("line")), F.col("symbol")],
    )
    won = ranked.select("file", "export_name", F.col("symbol").alias("_won"), F.col("is_reexport").alias("_re"), F.col("kind").alias("_kind"))
    lost = exports.join(won, ["file", "export_name"]).filter(F.col("symbol") != F.col("_won"))
    ruled = (~F.col("_re") & F.col("is_reexport")) | (F.col("language") == "python") | (F.col("_kind").isin("variable", "constant") & (F.col("kind") == "function"))
    return ranked, lost.filter(~ruled).drop("_won", "_re", "_kind")


def export_targets(exports: DataFrame, reexports: DataFrame) -> DataFrame:
    """Ends of re-export chains. reexports: file, export_name, to_file, to_name. exports as ranked.

    file, export_name, symbol; null where the chain runs into a cycle or out of the known files.
    """
    key = lambda f, n: F.concat_ws("\u0001", f, n)
    ends = chase(reexports.select(key("file", "export_name").alias("src"), key("to_file", "to_name").alias("next")))
    local = exports.filter("not is_reexport").select(key("file", "export_name").alias("target"), "symbol")
    chained = reexports.select("file", "export_name", key("file", "export_name").alias("src")).join(ends, "src").join(local, "target", "left")
    return exports.filter("not is_reexport").select("file", "export_name", "symbol").unionByName(chained.select("file", "export_name", "symbol"))


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates: id, candidates array in order of preference. id, path: the first that exists, else null."""
    spread = candidates.select("id", F.posexplode("candidates").alias("_at", "path"))
    hit = spread.join(files.select("path").distinct(), "path", "left_semi").groupBy("id").agg(F.min_by("path", "_at").alias("path"))
    return candidates.select("id").join(hit, "id", "left")
