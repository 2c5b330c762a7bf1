"""A project: its facts, its call graph and the tools that answer questions about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph import schema
from lucidgraph.functions import paths, text
from lucidgraph.operators import graph, maintenance
from lucidgraph.operators.recursion import closure, written
from lucidgraph.plans.resolution import Resolution
from lucidgraph.sources import files as source_files
from lucidgraph.sources.storage import FactStore


class Project:
    """sources: as of read_sources. Everything else derives from it; upserts make a new project."""

    def __init__(self, sources: DataFrame, facts: dict[str, DataFrame] | None = None):
        self.sources = written(sources)
        self.facts = facts or source_files.extract_facts(self.sources)
        self._resolution: Resolution | None = None

    @classmethod
    def load(cls, spark: SparkSession, root: str, **limits) -> Project:
        return cls(source_files.read_sources(spark, root, **limits))

    @classmethod
    def load_cached(cls, spark: SparkSession, root: str, store: FactStore, **limits) -> Project:
        """As load, but facts of unchanged files come from the store, which is brought up to date."""
        sources = written(source_files.read_sources(spark, root, **limits))
        facts, state = store.restore(sources)
        project = cls(sources, facts)
        if not state.filter("state <> 'hit'").isEmpty():
            project.save(store)
        return project

    def save(self, store: FactStore, *, git_tree_hash: str | None = None) -> None:
        store.save(self.sources, self.facts, git_tree_hash=git_tree_hash)

    @property
    def resolution(self) -> Resolution:
        if self._resolution is None:
            self._resolution = Resolution(self.facts, self.sources)
        return self._resolution

    def nodes(self) -> DataFrame:
        """Callables with a body: node, name, kind, file_path, lines, is_test, language, parameters, return_type."""
        defs = self.facts["definition"].filter(F.col("kind").isin(*schema.CALLABLE_KINDS) & F.col("body_scope_id").isNotNull())
        about = self.sources.select(F.col("path").alias("file_path"), "is_test", "language")
        return defs.join(about, "file_path").select(F.col("symbol_id").alias("node"), "name", "kind", "file_path", "start_line", "end_line", "is_test", "language", "body_scope_id", "parameters", "return_type")

    def edges(self) -> DataFrame:
        """caller, callee: one row a resolution; callers without a body (modules) are null."""
        r = self.resolution
        body = self.nodes().select(F.col("node").alias("caller"), F.col("body_scope_id").alias("caller_scope_id"))
        both = r.call.select("caller_scope_id", F.col("target").alias("callee")).unionByName(r.callback.select("caller_scope_id", F.col("target").alias("callee")))
        return both.join(body, "caller_scope_id", "left").select("caller", "callee")

    def entry_points(self, include_tests: bool = False) -> DataFrame:
        """Nodes that nothing calls or reads, ranked by the size of their call tree."""
        edges = written(self.edges())
        used = graph.referenced(edges, self.resolution.indirect.select(F.col("function").alias("node")))
        hidden = graph.is_framework_method(F.col("name"), F.col("language"))
        nodes = written(self.nodes())
        roots = written(graph.entry_points(nodes, used, hidden=hidden if include_tests else hidden | F.col("is_test")))
        sizes = graph.tree_sizes(roots.select("node"), nodes, edges.filter("caller is not null"))
        return roots.join(sizes, "node").select("node", "name", "kind", "file_path", "start_line", "tree_size", text.signature(F.col("name"), F.col("parameters"), F.col("return_type"), F.col("kind")).alias("signature")).orderBy(F.desc("tree_size"), "node")

    def find(self, ref: str) -> DataFrame:
        """The first node at path:line#name."""
        said = paths.parse_symbol_ref(F.lit(ref))
        hit = self.nodes().filter(paths.paths_match(F.col("file_path"), said["path"]) & (F.col("start_line") == said["line"]) & (F.col("name") == said["name"]))
        return hit.orderBy("file_path", "start_line", "node").limit(1)

    def neighbourhood(self, ref: str, depth: int | None = 2) -> dict[str, DataFrame]:
        root, edges = self.find(ref).select("node"), written(self.edges().filter("caller is not null"))
        return {side: graph.neighbourhood(root, edges, depth, callers=side == "callers") for side in ("callers", "callees")}

    def file_dependencies(self) -> DataFrame:
        t = self.resolution.import_target
        return t.select(F.col("file_path").alias("src"), F.explode(F.array_compact(F.array("resolved_path", "submodule_path"))).alias("dst")).distinct()

    def upsert(self, changed: DataFrame, deleted: DataFrame | None = None) -> Project:
        """changed: path, content. deleted: path. Only changed files are parsed again; what derives is derived anew."""
        fresh = source_files.with_header(changed)
        gone = changed.select("path") if deleted is None else changed.select("path").unionByName(deleted.select("path")).distinct()
        gone = written(gone)
        new = source_files.extract_facts(fresh)
        facts = {k: written(maintenance.replace_files(self.facts[k], new[k], gone)) for k in schema.FACT_TABLES}
        return Project(maintenance.replace_files(self.sources, fresh, gone, key="path"), facts)

    def affected(self, changed: DataFrame) -> DataFrame:
        return maintenance.affected(changed, self.file_dependencies())

    def stats(self) -> dict[str, int]:
        return {"files": self.sources.count(), **{k: self.facts[k].count() for k in schema.FACT_TABLES}}

    def references_to(self, symbol_id: str) -> DataFrame:
        """Calls that resolve to a symbol (an extension)."""
        return self.resolution.call.filter(F.col("target") == symbol_id)

    def reachable(self, symbol_id: str) -> DataFrame:
        edges = self.edges().filter("caller is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
        root = self.nodes().filter(F.col("node") == symbol_id).select(F.col("node").alias("root"), "node")
        return closure(root, edges)


def render_entry_points(found: DataFrame, limit: int | None = None) -> str:
    """A text report of the entry points, or of the first of them and how many more there are."""
    rows = (found if limit is None else found.limit(limit)).toLocalIterator()
    lines = [f"- {r.signature} -- {r.tree_size} calls ({r.file_path}:{r.start_line}#{r.name})" for r in rows]
    return "\n".join(["Entry points by call-tree size:", *lines, *_left_out(found, len(lines), limit)])


def render_tree(tree: DataFrame, nodes: DataFrame, limit: int | None = None) -> str:
    """A text report of the tree in the order of its paths, or of its first rows and how many more there are."""
    about = nodes.select("node", F.format_string("%s (%s:%s)", "name", "file_path", "start_line").alias("_shown")).dropDuplicates(["node"])
    rows = tree if limit is None else tree.orderBy("path").limit(limit)
    rows = rows.join(about, "node", "left").orderBy("path")
    lines = ["  " * r.depth + (r["_shown"] or r.node) + (" [cycle]" if r.cycle else "") for r in rows.toLocalIterator()]
    return "\n".join([*lines, *_left_out(tree, len(lines), limit)])


def _left_out(of: DataFrame, shown: int, limit: int | None) -> list[str]:
    more = 0 if limit is None or shown < limit else of.count() - shown
    return [f"({more} more not shown)"] if more else []
