"""Every registered query of the engine with its SQL equivalent.

The test tables hold no source code, so each operator runs over views with the shape of its facts: parts are
definitions, neighbouring order lines of one brand are calls, regions to orders are a scope tree, events are a
usage log, documents and pages are files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph import schema
from lucidgraph.functions import paths, text
from lucidgraph.operators import analytics, bindings, graph, maintenance, recursion, scopes, types
from lucidgraph.sources import import_paths

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_EDGE = """a_call_edge AS (
  SELECT DISTINCT a.l_partkey AS caller, b.l_partkey AS callee FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  JOIN part p ON p.p_partkey = a.l_partkey JOIN part q ON q.p_partkey = b.l_partkey WHERE p.p_brand = q.p_brand)"""
_REACH = """reach(root, node) AS (
  SELECT p_partkey, p_partkey FROM part UNION SELECT reach.root, e.callee FROM reach JOIN a_call_edge e ON reach.node = e.caller)"""
_PARENT = _EDGE + ", a_parent AS (SELECT caller AS child, max(callee) AS parent FROM a_call_edge WHERE callee < caller GROUP BY caller)"
_CHAIN = """chain(child, ancestor, dist) AS (
  SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT chain.child, p.parent, dist + 1 FROM chain JOIN a_parent p ON p.child = chain.ancestor)"""
_TREE = """tree(id, parent, kind) AS (
  SELECT 'region:' || r_regionkey, NULL, 'region' FROM region UNION ALL
  SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'nation' FROM nation UNION ALL
  SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'customer' FROM customer UNION ALL
  SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'order' FROM orders)"""
_UP = "up(id, ancestor, dist) AS (SELECT id, id, 0 FROM tree UNION ALL SELECT up.id, t.parent, dist + 1 FROM up JOIN tree t ON t.id = up.ancestor WHERE t.parent IS NOT NULL)"
_CALLS = "calls AS (SELECT user_id::VARCHAR AS session_id, event_type AS tool_name, ts AS called_at, value AS duration_ms, event_type <> 'error' AS success, event_id AS request_id FROM events)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    brand = _t(spark, d, "part").select("p_partkey", "p_brand")
    line = line.join(brand, line["l_partkey"] == brand["p_partkey"]).drop("p_partkey").distinct()
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), "p_brand", F.col("l_partkey").alias("callee"))
    return line.join(after, ["l_orderkey", "l_linenumber", "p_brand"]).select(F.col("l_partkey").alias("caller"), "callee").distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("kind"), F.col("p_size").alias("line"))


def parents(spark: SparkSession, d: str) -> DataFrame:
    return call_edges(spark, d).filter("callee < caller").groupBy(F.col("caller").alias("child")).agg(F.max("callee").alias("parent"))


def scope_tree(spark: SparkSession, d: str) -> DataFrame:
    def level(table: str, kind: str, key: str, up: str | None, up_key: str | None) -> DataFrame:
        parent = F.concat(F.lit(f"{up}:"), F.col(up_key).cast("string")) if up else F.lit(None).cast("string")
        return _t(spark, d, table).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), parent.alias("parent"), F.lit(kind).alias("kind"))

    return (
        level("region", "region", "r_regionkey", None, None)
        .unionByName(level("nation", "nation", "n_nationkey", "region", "n_regionkey"))
        .unionByName(level("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(level("orders", "order", "o_orderkey", "customer", "o_custkey"))
    )


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_name"), F.col("ts").alias("called_at"),
        F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), F.col("event_id").alias("request_id"),
    )


# Files


@query("scan_files_header", "SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, length(string_split(text, chr(10))[-1])::INT AS end_col FROM documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.n_lines(F.col("text")).alias("n_lines"), text.last_line_length(F.col("text")).alias("end_col"))


_PATH_SQL = "source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.d.ts' WHEN 'fr' THEN '.rs' ELSE '.jsx' END"


def _paths(spark, d):
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".d.ts").when(F.col("lang") == "fr", ".rs").otherwise(".jsx")
    return _t(spark, d, "documents").select("doc_id", "text", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"))


@query(
    "detect_language",
    f"""SELECT path, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.ts') THEN 'typescript' WHEN ends_with(path, '.rs') THEN 'rust' ELSE 'javascript' END AS language,
    NOT ends_with(path, '.d.ts') AS supported FROM (SELECT {_PATH_SQL} AS path FROM documents)""",
)
def _(spark, d):
    return _paths(spark, d).select("path", paths.detect_language(F.col("path")).alias("language"), paths.is_supported_file(F.col("path")).alias("supported"))


@query("ignore_paths", f"SELECT page_id, {' OR '.join(f'contains(url, {chr(39)}{n}{chr(39)})' for n in paths.IGNORED_NAMES)} OR contains(url, '.DS_Store') AS ignored FROM pages")
def _(spark, d):
    return _t(spark, d, "pages").select("page_id", paths.should_ignore_path(F.col("url")).alias("ignored"))


_NAMED = " OR ".join(f"contains(path, '{n}')" for n in (*paths.IGNORED_NAMES, ".DS_Store"))


@query(
    "ignore_patterns",
    f"SELECT page_id, {_NAMED} OR starts_with(path, 'en/') OR path = 'de/8' OR contains(path, '/de/8') OR path = '8.html' OR contains(path, '/8.html') AS ignored FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS path FROM pages)",
)
def _(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1)
    patterns = F.array(F.lit("en/*"), F.lit("de/8"), F.lit("8.html"))
    return _t(spark, d, "pages").select("page_id", paths.should_ignore_path(path, patterns).alias("ignored"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(
    "cache_hits",
    """SELECT coalesce(n.doc_id, o.page_id) AS path, CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.page_id IS NULL THEN 'new' WHEN n.lang = o.lang THEN 'hit' ELSE 'stale' END AS state
    FROM documents n FULL JOIN (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) AS lang FROM pages) o ON n.doc_id = o.page_id""",
)
def _(spark, d):
    files = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("content_hash"))
    manifest = _t(spark, d, "pages").select(F.col("page_id").alias("path"), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]*)", 1).alias("content_hash"))
    return maintenance.cache_state(files, manifest)


@query("capture_extract", """SELECT page_id, i - 1 AS ord, c[i] AS capture FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS c FROM pages), unnest(generate_series(1, len(c))) AS s(i)""")
def _(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return _t(spark, d, "pages").select("page_id", F.posexplode(found).alias("ord", "capture"))


@query("capture_names", "SELECT event_id, split_part(k, '.', 1) AS category, split_part(k, '.', 2) AS entity FROM (SELECT event_id, event_type || '.' || user_id AS k FROM events) WHERE NOT starts_with(k, '_')")
def _(spark, d):
    name = F.concat("event_type", F.lit("."), F.col("user_id").cast("string"))
    return _t(spark, d, "events").filter(~name.startswith("_")).select("event_id", F.split(name, r"\.")[0].alias("category"), F.split(name, r"\.")[1].alias("entity"))


@query("line_positions", "SELECT doc_id, i AS line_no, length(l[i]) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) AS s(i)")
def _(spark, d):
    return text.line_table(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "line_no", F.length("line").alias("n"))


@query("source_slices", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10))[3:] AS slice FROM documents WHERE len(string_split(text, chr(10))) >= 2 AND length(string_split(text, chr(10))[1]) >= 3")
def _(spark, d):
    lines = F.split("text", "\n")
    docs = _t(spark, d, "documents").filter((F.size(lines) >= 2) & (F.length(lines[0]) >= 3))
    return docs.select("doc_id", text.source_slice(F.col("text"), F.lit(1), F.lit(3), F.lit(2), F.length(lines[1])).alias("slice"))


_TEST_PATHS = (
    ["src/tests/", "src/", "x/__tests__/", "a/benches/", "test/", "lib/test/u/", "my__tests__/v/", "contests/"],
    ["test_a", "b_test", "c.test", "d.spec", "e.e2e", "f.e2e-spec", "g.integration", "conftest", "h", "tests"],
    [".py", ".rs", ".ts", ".js", ".tsx", ".jsx"],
)


@query(
    "test_files",
    f"""WITH p AS (SELECT p_partkey, {_TEST_PATHS[0]}[p_partkey % 8 + 1] AS dir, {_TEST_PATHS[1]}[p_size % 10 + 1] AS stem, {_TEST_PATHS[2]}[p_partkey // 8 % 6 + 1] AS ext FROM part)
    SELECT p_partkey, dir || stem || ext AS path, CASE
      WHEN ext = '.py' THEN starts_with(stem, 'test_') OR ends_with(stem, '_test') OR stem = 'conftest' OR regexp_matches(dir, '/tests?/')
      WHEN ext = '.rs' THEN ends_with(stem, '_test') OR regexp_matches(dir, '/(tests|benches)/')
      ELSE regexp_matches(stem, '\\.(test|spec|e2e|integration)$') OR ends_with(stem, '.e2e-spec') AND ext IN ('.ts', '.js') OR contains(dir, '__tests__/') OR regexp_matches(dir, '/tests?/') END AS is_test FROM p""",
)
def _(spark, d):
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    dirs, stems, ends = _TEST_PATHS
    path = F.concat(pick(dirs, F.col("p_partkey") % 8), pick(stems, F.col("p_size") % 10), pick(ends, F.floor(F.col("p_partkey") / 8) % 6))
    return _t(spark, d, "part").select("p_partkey", path.alias("path")).withColumn("is_test", paths.is_test_file(F.col("path"), paths.detect_language(F.col("path"))))


@query("git_ls_files", "SELECT p_name AS path, lower(hex(p_partkey)) AS sha FROM part")
def _(spark, d):
    sha = F.lower(F.hex("p_partkey"))
    lines = _t(spark, d, "part").select(F.concat(F.lit("100644 "), sha, F.lit(" 0\t"), F.col("p_name")).alias("value"))
    return maintenance.parse_ls_files(lines)


@query("symbol_ids", "SELECT concat_ws(':', p_type, p_brand, p_size, 1, p_size + 2, 9, p_name) AS symbol_id, concat_ws(':', p_type, p_brand, p_size, 1, p_size + 2, 9) AS scope_id, concat_ws(':', 'ref', p_brand, p_size, 1, p_name) AS reference_id FROM part")
def _(spark, d):
    part = _t(spark, d, "part").select(
        F.col("p_type").alias("kind"), F.col("p_type").alias("type"), F.col("p_brand").alias("file_path"), F.col("p_name").alias("name"),
        F.col("p_size").alias("start_line"), F.lit(1).alias("start_column"), (F.col("p_size") + 2).alias("end_line"), F.lit(9).alias("end_column"),
    )
    return part.select(schema.symbol_id().alias("symbol_id"), schema.scope_id().alias("scope_id"), schema.reference_id().alias("reference_id"))


@query("type_ids", "SELECT p_partkey, 'type:union:' || list_aggregate(list_sort([p_type, p_brand, p_name]), 'string_agg', '|') AS type_id FROM part")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", schema.type_id("union", F.array("p_type", "p_brand", "p_name"), ordered=False).alias("type_id"))


# Scopes


@query(
    "containment_smallest",
    """SELECT c_custkey AS id, arg_min(s_suppkey, (w, s_suppkey)) AS span FROM customer LEFT JOIN (
      SELECT *, 500.0 + 10 * s_suppkey AS w FROM supplier) s ON c_nationkey = s_nationkey AND s_acctbal <= c_acctbal AND c_acctbal < s_acctbal + w GROUP BY c_custkey""",
)
def _(spark, d):
    points = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("at"), F.col("c_nationkey").alias("key"))
    spans = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("span"), F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + (500.0 + 10 * F.col("s_suppkey"))).alias("high"), F.col("s_nationkey").alias("key"))
    return scopes.smallest_container(points, spans, "key")


@query("scope_depth", f"WITH RECURSIVE {_TREE}, {_UP} SELECT id, max(dist)::INT AS depth FROM up GROUP BY id")
def _(spark, d):
    return scopes.scope_depths(scope_tree(spark, d))


@query("enclosing_scope", f"WITH RECURSIVE {_TREE}, {_UP} SELECT up.id, arg_min(ancestor, dist) AS enclosing FROM up JOIN tree t ON t.id = ancestor AND t.kind IN ('nation', 'customer') GROUP BY up.id")
def _(spark, d):
    tree = scope_tree(spark, d)
    return scopes.enclosing(tree, tree, ["nation", "customer"])


@query(
    "nearest_body_scope",
    """WITH near AS (SELECT s_suppkey AS id, c_custkey AS body, abs(s_acctbal - c_acctbal) AS gap,
      CASE WHEN abs(s_acctbal - c_acctbal) <= 5 THEN 0 WHEN abs(s_acctbal - c_acctbal) <= 50 THEN 1 WHEN abs(s_acctbal - c_acctbal) <= 500 THEN 2 END AS strategy
      FROM supplier JOIN customer ON s_nationkey = c_nationkey)
    SELECT id, body, strategy FROM near WHERE strategy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY strategy, gap, body) = 1""",
)
def _(spark, d):
    definitions = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("at"), F.col("s_nationkey").alias("key"))
    bodies = _t(spark, d, "customer").select(F.col("c_custkey").alias("body"), F.col("c_acctbal").alias("at"), F.col("c_nationkey").alias("key"))
    return scopes.nearest_by_strategy(definitions, bodies, "key", [5, 50, 500])


@query(
    "deepest_scope",
    """WITH held AS (SELECT c_custkey AS id, s_suppkey AS span, s_suppkey % 7 AS depth FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal <= c_acctbal AND c_acctbal <= s_acctbal + 500 + 10 * s_suppkey),
    top AS (SELECT id, min(span) AS span, count(DISTINCT span) AS n FROM held WHERE depth = (SELECT max(depth) FROM held h WHERE h.id = held.id) GROUP BY id)
    SELECT c_custkey AS id, span FROM customer LEFT JOIN top ON id = c_custkey AND n = 1""",
)
def _(spark, d):
    points = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("at"), F.col("c_nationkey").alias("key"))
    spans = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("span"), F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 500 + 10 * F.col("s_suppkey")).alias("high"), (F.col("s_suppkey") % 7).alias("depth"), F.col("s_nationkey").alias("key"))
    return scopes.deepest_container(points, spans, "key")[0]


@query("child_scope_by_name", "SELECT o_orderkey AS id, child FROM orders LEFT JOIN (SELECT p_size AS parent, p_brand AS name, arg_min(p_partkey, (p_retailprice, p_partkey)) AS child FROM part GROUP BY ALL) ON parent = o_orderkey % 50 AND name = 'Brand#' || (o_custkey % 5 + 1) || (o_custkey % 4 + 1)")
def _(spark, d):
    scopes_ = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("parent"), F.col("p_brand").alias("name"), F.col("p_retailprice").alias("ord"))
    name = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 5 + 1).cast("string"), (F.col("o_custkey") % 4 + 1).cast("string"))
    wanted = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).cast("long").alias("parent"), name.alias("name"))
    return scopes.child_by_name(wanted, scopes_).select("id", "child")


@query("root_scopes", "SELECT p_brand AS file, arg_min(p_partkey, (p_size, p_partkey)) AS root FROM part WHERE p_size > 10 GROUP BY p_brand")
def _(spark, d):
    return scopes.roots(_t(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 10, F.col("p_partkey")).alias("parent"), F.col("p_size").alias("ord")))


# Bindings and names


@query("last_wins_bindings", "SELECT p_brand AS scope, p_name AS name, max(p_partkey) AS symbol, max(p_partkey) AS ord FROM part GROUP BY ALL")
def _(spark, d):
    return bindings.scope_bindings(_t(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_name").alias("name"), F.col("p_partkey").alias("symbol"), F.col("p_partkey").alias("ord")))


@query("member_index", "SELECT p_brand AS type, p_type AS name, arg_max(p_partkey, (p_size > 25, p_partkey)) AS member FROM part GROUP BY ALL")
def _(spark, d):
    return bindings.member_index(_t(spark, d, "part").select(F.col("p_brand").alias("type"), F.col("p_type").alias("name"), F.col("p_partkey").alias("member"), (F.col("p_size") > 25).alias("is_property"), F.col("p_partkey").alias("ord")))


@query(
    "lexical_resolve",
    f"""WITH RECURSIVE {_TREE}, {_UP}, refs AS (SELECT o_orderkey AS ref, 'customer:' || o_custkey AS scope, o_orderpriority[1] AS name FROM orders),
    binds AS (SELECT 'nation:' || s_nationkey AS scope, (s_suppkey % 5 + 1)::VARCHAR AS name, 'l' || min(s_suppkey) AS symbol, 0 AS layer FROM supplier GROUP BY ALL
      UNION ALL SELECT 'nation:' || n_nationkey, (n_nationkey % 3 + 1)::VARCHAR, 'i' || n_nationkey, 1 FROM nation
      UNION ALL SELECT 'region:' || r_regionkey, (r_regionkey + 1)::VARCHAR, 'r' || r_regionkey, 0 FROM region),
    hits AS (SELECT ref, symbol, dist, layer FROM refs JOIN up ON up.id = refs.scope JOIN binds b ON b.scope = up.ancestor AND b.name = refs.name)
    SELECT refs.ref, arg_min(symbol, (dist, layer, symbol)) AS symbol FROM refs LEFT JOIN hits ON hits.ref = refs.ref GROUP BY refs.ref""",
)
def _(spark, d):
    refs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("scope"), F.substring("o_orderpriority", 1, 1).alias("name"))
    supplier = _t(spark, d, "supplier").groupBy(F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("scope"), (F.col("s_suppkey") % 5 + 1).cast("string").alias("name"))
    local = supplier.agg(F.concat(F.lit("l"), F.min("s_suppkey").cast("string")).alias("symbol")).withColumn("layer", F.lit(0))
    nation = _t(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("scope"), (F.col("n_nationkey") % 3 + 1).cast("string").alias("name"), F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("symbol"), F.lit(1).alias("layer"))
    region = _t(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("scope"), (F.col("r_regionkey") + 1).cast("string").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("symbol"), F.lit(0).alias("layer"))
    tree = scope_tree(spark, d).filter("kind <> 'order'")
    return bindings.lexical_resolve(refs, recursion.ancestors(tree), local.unionByName(nation).unionByName(region)).select("ref", "symbol")


@query(
    "import_candidates",
    """WITH files AS (SELECT DISTINCT p_brand || '/' || p_size || '.py' AS path FROM part WHERE p_retailprice > 1500 UNION SELECT DISTINCT p_brand || '/' || p_type || '/__init__.py' FROM part WHERE p_retailprice > 1700),
    c AS (SELECT p_partkey AS id, 0 AS pos, p_brand || '/' || p_size || '.py' AS path FROM part UNION ALL SELECT p_partkey, 1, p_brand || '/' || p_type || '/__init__.py' FROM part)
    SELECT p_partkey AS id, arg_min(c.path, pos) AS path FROM part LEFT JOIN (SELECT * FROM c SEMI JOIN files USING (path)) c ON c.id = p_partkey GROUP BY p_partkey""",
)
def _(spark, d):
    part = _t(spark, d, "part")
    module = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".py"))
    package = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/__init__.py"))
    files = part.filter("p_retailprice > 1500").select(module.alias("path")).unionByName(part.filter("p_retailprice > 1700").select(package.alias("path")))
    return bindings.first_existing(part.select(F.col("p_partkey").alias("id"), F.array(module, package).alias("candidates")), files)


_IMPORT_FILES = """f AS (SELECT DISTINCT 'src/' || (p_size % 5) || '/' || (p_partkey % 9) || list_value('', '.js', '.ts', '/index.js', '/index.ts', '.tsx', '.mjs')[p_partkey % 7 + 1] AS path FROM part WHERE p_partkey % 4 = 0),
    i AS (SELECT p_partkey AS id, p_size % 3 AS kind, 'src/' || (p_size % 5) || '/' || (p_partkey % 11) AS spot, list_value('', '.js', '.mjs', '.x', '.ts')[p_size % 5 + 1] AS ext, 'lib' || p_partkey AS bare FROM part)"""
_IMPORT_PICK = "pick AS (SELECT id, arg_min(path, pos) AS path FROM (SELECT id, unnest(c) AS path, generate_subscripts(c, 1) AS pos FROM c) SEMI JOIN f USING (path) GROUP BY id)"


def _imports(spark, d):
    part = _t(spark, d, "part")
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    text_ = lambda c: c.cast("string")
    folder = F.concat(F.lit("src/"), text_(F.col("p_size") % 5))
    files = part.filter("p_partkey % 4 = 0").select(F.concat(folder, F.lit("/"), text_(F.col("p_partkey") % 9), pick(("", ".js", ".ts", "/index.js", "/index.ts", ".tsx", ".mjs"), F.col("p_partkey") % 7)).alias("path")).distinct()
    name = F.concat(text_(F.col("p_partkey") % 11), pick(("", ".js", ".mjs", ".x", ".ts"), F.col("p_size") % 5))
    kind = F.col("p_size") % 3
    module = F.when(kind == 0, F.concat(F.lit("./"), name)).when(kind == 1, F.concat(F.lit("../../"), folder, F.lit("/./"), name)).otherwise(F.concat(F.lit("lib"), text_(F.col("p_partkey"))))
    file = F.when(kind == 1, F.lit("a/b/main.ts")).otherwise(F.concat(folder, F.lit("/main.js")))
    return part.select(F.col("p_partkey").alias("id"), file.alias("file"), module.alias("module")), files


@query(
    "import_javascript",
    f"""WITH {_IMPORT_FILES}, c AS (SELECT id, list_transform(['', '.js', '.jsx', '.mjs', '.cjs', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs'], lambda e: spot || ext || e) AS c FROM i WHERE kind < 2), {_IMPORT_PICK}
    SELECT id, CASE WHEN kind = 2 THEN bare ELSE coalesce(path, CASE WHEN ext IN ('.js', '.jsx', '.mjs', '.cjs') THEN spot || ext ELSE spot || ext || '.js' END) END AS path, path IS NOT NULL AS found FROM i LEFT JOIN pick USING (id)""",
)
def _(spark, d):
    return import_paths.javascript_imports(*_imports(spark, d))


@query(
    "import_typescript",
    f"""WITH {_IMPORT_FILES}, c AS (SELECT id, list_concat(list_concat(CASE WHEN ext IN ('.js', '.mjs') THEN [spot || '.ts', spot || '.tsx'] ELSE [] END,
      list_transform(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js'], lambda e: spot || ext || e)), CASE WHEN ext IN ('.js', '.mjs') THEN [spot || '/index.ts', spot || '/index.tsx'] ELSE [] END) AS c FROM i WHERE kind < 2), {_IMPORT_PICK}
    SELECT id, CASE WHEN kind = 2 THEN bare ELSE coalesce(path, CASE WHEN ext IN ('.js', '.mjs') THEN spot || '.ts' WHEN ext = '.ts' THEN spot || ext ELSE spot || ext || '.ts' END) END AS path, path IS NOT NULL AS found FROM i LEFT JOIN pick USING (id)""",
)
def _(spark, d):
    return import_paths.typescript_imports(*_imports(spark, d))


@query(
    "export_chain",
    f"""WITH RECURSIVE {_EDGE}, ptr AS (SELECT caller AS src, min(callee) AS next FROM a_call_edge GROUP BY caller),
    walk(src, cur, path) AS (SELECT src, next, [src] FROM ptr UNION ALL SELECT w.src, p.next, list_append(path, w.cur) FROM walk w JOIN ptr p ON p.src = w.cur WHERE NOT list_contains(path, w.cur))
    SELECT ptr.src, max(CASE WHEN ptr2.src IS NULL THEN w.cur END) AS target FROM ptr JOIN walk w ON w.src = ptr.src LEFT JOIN ptr ptr2 ON ptr2.src = w.cur GROUP BY ptr.src""",
)
def _(spark, d):
    pointers = call_edges(spark, d).groupBy(F.col("caller").alias("src")).agg(F.min("callee").alias("next"))
    return recursion.chase(pointers)


@query(
    "export_conflicts",
    """SELECT p_brand AS file, p_type AS export_name, p_partkey AS symbol FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size > 40, CASE WHEN p_size > 20 THEN 0 ELSE 1 END, -p_size, p_partkey) = 1""",
)
def _(spark, d):
    exports = _t(spark, d, "part").select(
        F.col("p_brand").alias("file"), F.col("p_type").alias("export_name"), F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") > 20, "variable").otherwise("function").alias("kind"),
        (F.col("p_size") > 40).alias("is_reexport"), F.lit("python").alias("language"), F.col("p_size").alias("line"),
    )
    return bindings.resolve_exports(exports)[0].select("file", "export_name", "symbol")


# Types and dispatch


@query("inheritance_chain", f"WITH RECURSIVE {_PARENT}, {_CHAIN} SELECT child AS id, ancestor, dist FROM chain")
def _(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return recursion.ancestors(part.join(parents(spark, d).withColumnRenamed("child", "id"), "id", "left"))


def _members(spark, d):
    return _t(spark, d, "part").filter("p_size <= 30").select(F.col("p_partkey").alias("type"), F.col("p_type").alias("name"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("member"))


def _typed(spark, d):
    """Superclass by a_parent, and as second parent the least callee if it differs."""
    first = parents(spark, d).select(F.col("child").alias("type"), F.lit(0).alias("ord"), "parent")
    least = call_edges(spark, d).filter("callee < caller").groupBy(F.col("caller").alias("type")).agg(F.min("callee").alias("parent")).withColumn("ord", F.lit(1))
    return first.unionByName(least.join(first.select("type", "parent"), ["type", "parent"], "left_anti"))


_TYPED = _PARENT + """, a_second AS (SELECT caller AS child, min(callee) AS parent FROM a_call_edge WHERE callee < caller GROUP BY caller HAVING min(callee) <> max(callee)),
  typed AS (SELECT child AS type, 0 AS ord, parent FROM a_parent UNION ALL SELECT child, 1, parent FROM a_second),
  members AS (SELECT p_partkey AS type, p_type AS name, 'm' || p_partkey AS member FROM part WHERE p_size <= 30)"""
_LOOKUP = """lookup AS (SELECT type, name, arg_min(member, (dist, iface, member)) AS member FROM (
    SELECT child AS type, dist, name, member, 0 AS iface FROM chain JOIN members m ON m.type = ancestor UNION ALL
    SELECT chain.child, dist, name, member, 2 FROM chain JOIN a_second s ON s.child = ancestor JOIN members m ON m.type = s.parent) GROUP BY type, name)"""
_SUBS = "subs(type, subtype) AS (SELECT parent, type FROM typed UNION SELECT subs.type, t.type FROM subs JOIN typed t ON t.parent = subs.subtype)"
_WANT = "want AS (SELECT p_partkey AS call, p_partkey AS type, p_type AS name FROM part)"


@query("member_lookup_nearest", f"WITH RECURSIVE {_TYPED}, {_CHAIN}, {_LOOKUP} SELECT type, name, member FROM lookup")
def _(spark, d):
    all_types = _t(spark, d, "part").select(F.col("p_partkey").alias("type"))
    return types.member_lookup(all_types, types.split_parents(_typed(spark, d)), _members(spark, d))


@query("transitive_subtypes", f"WITH RECURSIVE {_TYPED}, {_SUBS} SELECT type, subtype FROM subs")
def _(spark, d):
    return types.transitive_subtypes(_typed(spark, d))


def _wanted(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("call"), F.col("p_partkey").alias("type"), F.col("p_type").alias("name"))


@query("polymorphic_dispatch_interface", f"WITH RECURSIVE {_TYPED}, {_SUBS}, {_WANT} SELECT DISTINCT call, member AS target FROM want JOIN subs USING (type) JOIN members m ON m.type = subtype AND m.name = want.name")
def _(spark, d):
    return types.interface_dispatch(_wanted(spark, d), types.transitive_subtypes(_typed(spark, d)), _members(spark, d))


@query(
    "polymorphic_dispatch_class",
    f"""WITH RECURSIVE {_TYPED}, {_CHAIN}, {_LOOKUP}, {_SUBS}, {_WANT} SELECT call, member AS target FROM want JOIN lookup USING (type, name)
    UNION SELECT call, member FROM want JOIN subs USING (type) JOIN members m ON m.type = subtype AND m.name = want.name""",
)
def _(spark, d):
    typed, members = _typed(spark, d), _members(spark, d)
    lookup = types.member_lookup(_wanted(spark, d).select("type"), types.split_parents(typed), members)
    return types.class_dispatch(_wanted(spark, d), types.transitive_subtypes(typed), members, lookup)


@query(
    "ctor_in_hierarchy",
    f"""WITH RECURSIVE {_TYPED}, ctors AS (SELECT p_partkey AS type, 'c' || p_partkey AS ctor FROM part WHERE p_size > 35),
    walk(type, cls, path) AS (SELECT p_partkey, p_partkey, []::INT[] FROM part UNION ALL SELECT w.type, t.parent, list_append(path, t.ord) FROM walk w JOIN typed t ON t.type = w.cls WHERE w.cls NOT IN (SELECT type FROM ctors))
    SELECT walk.type, arg_min(ctor, (path, ctor)) AS ctor FROM walk JOIN ctors ON ctors.type = cls GROUP BY walk.type""",
)
def _(spark, d):
    ctors = _t(spark, d, "part").filter("p_size > 35").select(F.col("p_partkey").alias("type"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("ctor"))
    return types.nearest_constructor(_t(spark, d, "part").select(F.col("p_partkey").alias("type")), _typed(spark, d), ctors)


@query(
    "type_binding_precedence",
    """SELECT symbol, arg_min(type, (rank, type)) AS type FROM (
      SELECT s_suppkey AS symbol, s_name AS type, 0 AS rank FROM supplier WHERE s_acctbal > 5000 UNION ALL
      SELECT c_custkey, c_mktsegment, 1 FROM customer UNION ALL SELECT p_partkey, p_brand, 2 FROM part) GROUP BY symbol""",
)
def _(spark, d):
    a = _t(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("type"))
    b = _t(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("type"))
    c = _t(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("type"))
    return types.type_bindings(a, b, c)


@query(
    "python_ctor_rewrite",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_size > 25 THEN 'constructor_call' ELSE 'function_call' END AS kind FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) GROUP BY kind""",
)
def _(spark, d):
    classes = _t(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("symbol"))
    calls = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.lit("function_call").alias("kind"))
    from lucidgraph.plans.resolution import rewrite_constructor_calls

    return rewrite_constructor_calls(calls, classes).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "collection_dispatch",
    f"""WITH RECURSIVE {_PARENT}, held AS (SELECT o_custkey % 50 AS coll, o_orderkey % 200 AS fn FROM orders),
    reach(root, node) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT root, child FROM reach JOIN a_parent ON parent = node)
    SELECT DISTINCT root AS call, fn AS target FROM reach JOIN held ON coll = node""",
)
def _(spark, d):
    held = _t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("collection"), (F.col("o_orderkey") % 200).alias("function"), F.lit(None).cast("long").alias("spread"))
    spread = parents(spark, d).select(F.col("parent").alias("collection"), F.lit(None).cast("long").alias("function"), F.col("child").alias("spread"))
    reads = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("call"), F.col("s_suppkey").alias("collection"))
    return types.collection_targets(reads, held.unionByName(spread))


# Call graph


@query("callback_edges", "SELECT s_suppkey AS symbol FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND floor(c_acctbal / 200) = floor(s_acctbal / 200))")
def _(spark, d):
    at = lambda t, k, n, b: _t(spark, d, t).select(F.col(k).alias("symbol"), F.col(n).alias("file"), F.floor(F.col(b) / 200).alias("line"), F.lit(1).alias("column"))
    return graph.callback_edges(at("supplier", "s_suppkey", "s_nationkey", "s_acctbal"), at("customer", "c_custkey", "c_nationkey", "c_acctbal")).select("symbol")


@query("function_as_value", "SELECT l_partkey AS symbol, arg_max(l_suppkey, (l_orderkey * 10 + l_linenumber, l_suppkey)) AS read_at FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey <> p_size GROUP BY l_partkey")
def _(spark, d):
    reads = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("location"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return graph.functions_as_values(reads, _t(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_size").cast("long").alias("location")))


@query("call_graph_nodes", f"WITH {_EDGE} SELECT p_partkey AS node, count(callee) AS n_calls, coalesce(string_agg(callee::VARCHAR, ',' ORDER BY callee), '') AS callees FROM part LEFT JOIN a_call_edge ON caller = p_partkey GROUP BY p_partkey")
def _(spark, d):
    out = graph.call_graph_nodes(nodes(spark, d).select("node"), call_edges(spark, d))
    return out.withColumn("callees", F.array_join(F.col("callees").cast("array<string>"), ","))


def _indirect(spark, d):
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))


@query("referenced_symbols", f"WITH {_EDGE} SELECT callee AS node FROM a_call_edge UNION SELECT s_suppkey FROM supplier")
def _(spark, d):
    return graph.referenced(call_edges(spark, d), _indirect(spark, d))


@query("entry_points", f"WITH {_EDGE} SELECT p_partkey AS node, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM a_call_edge WHERE callee = p_partkey)")
def _(spark, d):
    return graph.entry_points(nodes(spark, d), call_edges(spark, d).select(F.col("callee").alias("node"))).select("node", "name")


@query("entry_points_filtered", f"WITH {_EDGE} SELECT p_partkey AS node FROM part WHERE NOT EXISTS (SELECT 1 FROM a_call_edge WHERE callee = p_partkey) AND NOT (p_size > 40) AND NOT (p_type IN (SELECT min(p_type) FROM part))")
def _(spark, d):
    least = nodes(spark, d).agg(F.min("kind").alias("least"))
    shown = nodes(spark, d).crossJoin(F.broadcast(least)).withColumn("name", F.when(F.col("kind") == F.col("least"), "__str__").otherwise(F.when(F.col("line") > 30, "__init__").otherwise(F.col("name"))))
    hidden = (F.col("line") > 40) | graph.is_framework_method(F.col("name"), F.lit("python"))
    return graph.entry_points(shown, call_edges(spark, d).select(F.col("callee").alias("node")), hidden=hidden).select("node")


@query(
    "tree_size_ranked",
    f"""WITH RECURSIVE {_EDGE}, {_REACH} SELECT root AS node, count(e.callee) AS tree_size FROM reach LEFT JOIN a_call_edge e ON e.caller = reach.node
    WHERE NOT EXISTS (SELECT 1 FROM a_call_edge x WHERE x.callee = root) GROUP BY root ORDER BY tree_size DESC, node""",
)
def tree_size_ranked(spark: SparkSession, d: str) -> DataFrame:
    edges = recursion.written(call_edges(spark, d))
    every = nodes(spark, d)
    roots = graph.entry_points(every, edges.select(F.col("callee").alias("node"))).select("node")
    return graph.tree_sizes(roots, every, edges).orderBy(F.desc("tree_size"), "node")


@query("callers_index", f"WITH {_EDGE} SELECT callee, string_agg(caller::VARCHAR, ',' ORDER BY caller) AS callers FROM a_call_edge WHERE caller <> callee GROUP BY callee")
def _(spark, d):
    return graph.callers_index(call_edges(spark, d)).withColumn("callers", F.array_join(F.col("callers").cast("array<string>"), ","))


_MOST_CALLING = "SELECT caller AS node FROM a_call_edge GROUP BY caller ORDER BY count(*) DESC, caller LIMIT 20"
_EVERY_NODE = "SELECT p_partkey AS node FROM part"


def _neighbour_sql(src: str, dst: str, where: str, roots: str = _MOST_CALLING) -> str:
    return f"""WITH RECURSIVE {_EDGE}, top AS ({roots}),
    walk(path, depth, node, cycle) AS (SELECT [node], 0, node, false FROM top UNION ALL
      SELECT DISTINCT list_append(path, e.{dst}), depth + 1, e.{dst}, list_contains(path, e.{dst}) FROM walk JOIN a_call_edge e ON e.{src} = walk.node
      WHERE NOT cycle AND {where} AND (depth < 2 OR depth = 2 AND list_contains(path, e.{dst})))
    SELECT array_to_string(path, '>') AS path, depth, node, cycle FROM walk"""


def _top(edges):
    return edges.groupBy(F.col("caller").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(20).select("node")


@query("neighborhood_callees_d2", _neighbour_sql("caller", "callee", "true"))
def _(spark, d):
    edges = recursion.written(call_edges(spark, d))
    return graph.neighbourhood(_top(edges), edges, 2).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("neighborhood_callers_d2", _neighbour_sql("callee", "caller", "e.caller <> e.callee"))
def _(spark, d):
    edges = recursion.written(call_edges(spark, d))
    return graph.neighbourhood(_top(edges), edges, 2, callers=True).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("neighborhood_callees_d2_every_node", _neighbour_sql("caller", "callee", "true", _EVERY_NODE))
def _(spark, d):
    edges = recursion.written(call_edges(spark, d))
    return graph.neighbourhood(nodes(spark, d).select("node"), edges, 2).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("neighborhood_callers_d2_every_node", _neighbour_sql("callee", "caller", "e.caller <> e.callee", _EVERY_NODE))
def _(spark, d):
    edges = recursion.written(call_edges(spark, d))
    return graph.neighbourhood(nodes(spark, d).select("node"), edges, 2, callers=True).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("symbol_ref_parse", "SELECT p_partkey, p_brand || ':x' AS path, p_size AS line, p_name AS name FROM part")
def _(spark, d):
    ref = schema.symbol_ref(F.concat("p_brand", F.lit(":x")), F.col("p_size"), F.col("p_name"))
    return _t(spark, d, "part").withColumn("_r", paths.parse_symbol_ref(ref)).select("p_partkey", "_r.path", "_r.line", "_r.name")


@query("path_suffix_match", "SELECT page_id, url = tail OR ends_with(url, '/' || tail) AS matches FROM (SELECT page_id, url, regexp_extract(url, '[^/]+/[0-9]+[^/]*$') AS tail FROM pages)")
def _(spark, d):
    tail = F.regexp_extract("url", "[^/]+/[0-9]+[^/]*$", 0)
    return _t(spark, d, "pages").select("page_id", paths.paths_match(F.col("url"), tail).alias("matches"))


@query(
    "signature_build",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'constructor' ELSE o_orderpriority END || '(' || coalesce(string_agg(l_returnflag || ': ' || CASE WHEN l_tax > 0.04 THEN 'any' ELSE l_linestatus END, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), '')
    || ')' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ': unknown' END AS signature FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority""",
)
def _(spark, d):
    param = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_returnflag").alias("name"), F.when(F.col("l_tax") <= 0.04, F.col("l_linestatus")).alias("type"))
    owned = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(param)).alias("parameters"))
    kind = F.when(F.col("o_orderstatus") == "F", "constructor").otherwise("function")
    return _t(spark, d, "orders").join(owned, "o_orderkey", "left").select("o_orderkey", text.signature(F.col("o_orderpriority"), F.col("parameters"), F.lit(None).cast("string"), kind).alias("signature"))


# Upkeep


@query("dependents", f"WITH {_EDGE} SELECT DISTINCT callee AS file, caller AS dependent FROM a_call_edge")
def _(spark, d):
    return maintenance.dependents(call_edges(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")))


@query(
    "affected_files",
    f"WITH RECURSIVE {_EDGE}, hit(path) AS (SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT caller FROM hit JOIN a_call_edge ON callee = path) SELECT path FROM hit",
)
def _(spark, d):
    changed = _t(spark, d, "part").filter("p_size = 50").select(F.col("p_partkey").alias("path"))
    return maintenance.affected(changed, call_edges(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")))


@query("file_upsert", "SELECT p_partkey AS file_path, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    table = _t(spark, d, "part").select(F.col("p_partkey").alias("file_path"), F.col("p_name").alias("name"))
    fresh = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("file_path"), F.col("s_name").alias("name"))
    return maintenance.replace_files(table, fresh, fresh.select(F.col("file_path").alias("path")))


@query("debounce_latest", "SELECT user_id AS path, max(event_id) AS event_seq, arg_max(event_type, event_id) AS op FROM events GROUP BY user_id")
def _(spark, d):
    return maintenance.latest_events(_t(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("event_seq"), F.col("event_type").alias("op")))


# Usage analytics

_PER_TOOL = "SELECT tool_name, count(*) AS total_calls, sum(success::INT)::BIGINT AS success_count, (count(*) - sum(success::INT))::BIGINT AS failure_count, floor(avg(duration_ms) + 0.5)::BIGINT AS avg_duration_ms FROM calls"


@query("calls_per_tool", f"WITH {_CALLS} {_PER_TOOL} GROUP BY tool_name")
def _(spark, d):
    return analytics.calls_per_tool(tool_calls(spark, d))


@query("calls_in_range", f"WITH {_CALLS} {_PER_TOOL} WHERE called_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY tool_name")
def _(spark, d):
    return analytics.calls_in_range(tool_calls(spark, d), F.to_timestamp(F.lit("2024-01-05 00:00:00")), F.to_timestamp(F.lit("2024-01-20 00:00:00")))


_SESSIONS = "sessions AS (SELECT session_id, min(called_at) AS started_at FROM calls GROUP BY session_id)"


@query("recent_sessions", f"WITH {_CALLS}, {_SESSIONS} SELECT s.session_id, s.started_at, count(c.session_id) AS tool_call_count FROM (SELECT * FROM sessions ORDER BY started_at DESC, session_id LIMIT 5) s LEFT JOIN calls c ON c.session_id = s.session_id AND c.success GROUP BY ALL")
def _(spark, d):
    calls = tool_calls(spark, d)
    sessions = calls.groupBy("session_id").agg(F.min("called_at").alias("started_at"))
    return analytics.recent_sessions(sessions, calls.filter("success"))


@query("session_detail", f"WITH {_CALLS} SELECT session_id, tool_name, called_at, duration_ms, success, request_id FROM calls WHERE session_id = (SELECT min(session_id) FROM calls)")
def _(spark, d):
    calls = tool_calls(spark, d)
    return analytics.session_detail(calls, calls.agg(F.min("session_id")).first()[0])


@query("project_stats", f"WITH {_EDGE} SELECT (SELECT count(*) FROM part) AS definitions, (SELECT count(DISTINCT p_brand) FROM part) AS files, (SELECT count(*) FROM a_call_edge) AS calls")
def _(spark, d):
    part = _t(spark, d, "part").agg(F.count("*").alias("definitions"), F.countDistinct("p_brand").alias("files"))
    return part.crossJoin(call_edges(spark, d).agg(F.count("*").alias("calls")))


@query("profile_report", "SELECT l_shipdate AS label, count(*) AS n, sum(l_quantity) AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_shipdate")
def _(spark, d):
    return analytics.profile_report(_t(spark, d, "lineitem").select(F.col("l_shipdate").alias("label"), F.col("l_quantity").alias("ms")))


@query("slowest_files", "SELECT o_orderkey AS label, o_totalprice AS ms FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    return analytics.slowest(_t(spark, d, "orders").select(F.col("o_orderkey").alias("label"), F.col("o_totalprice").alias("ms")))
