"""Operators on small tables, with cycles, ties and nulls."""

import json

from pyspark.sql import functions as F

from lucidgraph.functions import paths, text
from lucidgraph.operators import bindings, graph, maintenance, recursion, scopes, types
from lucidgraph.plans import usage
from lucidgraph.sources import files
from lucidgraph.streaming import watch


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 6)], "src int, dst int")
    assert rows(recursion.closure(spark.createDataFrame([(1, 1), (5, 5)], "root int, node int"), edges)) == [(1, 1), (1, 2), (1, 3), (5, 5), (5, 6)]
    pointers = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 7), (8, 8)], "src int, next int")
    assert dict(map(tuple, recursion.chase(pointers).collect())) == {1: None, 2: None, 3: None, 4: None, 5: 7, 6: 7, 8: None}
    tree = graph.neighbourhood(spark.createDataFrame([(1,)], "node int"), edges.withColumnsRenamed({"src": "caller", "dst": "callee"}), 2)
    assert [(r.depth, r.node, r.cycle) for r in tree.orderBy("depth").collect()] == [(0, 1, False), (1, 2, False), (2, 3, False), (3, 1, True)]


def test_names(spark):
    exports = spark.createDataFrame([("a", "f", "a1", "function", False, "python", 1), ("a", "f", "a2", "function", False, "python", 9), ("b", "f", "b1", "import", True, "python", 1), ("c", "f", "c1", "import", True, "python", 1)], "file string, export_name string, symbol string, kind string, is_reexport boolean, language string, line int")
    ranked, conflicts = bindings.resolve_exports(exports)
    again = spark.createDataFrame([("b", "f", "a", "f"), ("c", "f", "b", "f")], "file string, export_name string, to_file string, to_name string")
    assert rows(bindings.export_targets(ranked, again)) == [("a", "f", "a2"), ("b", "f", "a2"), ("c", "f", "a2")] and conflicts.count() == 0


def test_dispatch(spark):
    parents = spark.createDataFrame([("C", 0, "B"), ("B", 0, "A"), ("C", 1, "I"), ("D", 0, "I")], "type string, ord int, parent string")
    members = spark.createDataFrame([("A", "m", "A.m"), ("C", "m", "C.m"), ("I", "m", "I.m"), ("I", "k", "I.k"), ("D", "m", "D.m")], "type string, name string, member string")
    every = spark.createDataFrame([(x,) for x in "ABCDI"], "type string")
    lookup = types.member_lookup(every, types.split_parents(parents), members)
    assert {r.type: r.member for r in lookup.filter("name = 'm'").collect()} == {"A": "A.m", "B": "A.m", "C": "C.m", "D": "D.m", "I": "I.m"}
    subs = types.transitive_subtypes(parents)
    calls = spark.createDataFrame([(1, "B", "m"), (2, "I", "m")], "call int, type string, name string")
    assert rows(types.class_dispatch(calls.filter("call = 1"), subs, members, lookup)) == [(1, "A.m"), (1, "C.m")]
    assert rows(types.interface_dispatch(calls.filter("call = 2"), subs, members)) == [(2, "C.m"), (2, "D.m")]
    ctors = spark.createDataFrame([("A", "A()"), ("I", "I()")], "type string, ctor string")
    assert {r.type: r.ctor for r in types.nearest_constructor(every, parents, ctors).collect()} == {"A": "A()", "B": "A()", "C": "A()", "D": "I()", "I": "I()"}


def test_expressions(spark):
    df = spark.createDataFrame([("a/template.py",), ("src/x.d.ts",), ("src/x.tsx",), ("vendor/y.js",)], "p string")
    got = {r.p: (r.i, r.s, r.l) for r in df.select("p", paths.should_ignore_path(F.col("p"), F.array(F.lit("vendor/*"))).alias("i"), paths.is_supported_file(F.col("p")).alias("s"), paths.detect_language(F.col("p")).alias("l")).collect()}
    assert got == {"a/template.py": (True, True, "python"), "src/x.d.ts": (False, False, "typescript"), "src/x.tsx": (False, True, "typescript"), "vendor/y.js": (True, True, "javascript")}
    one = spark.range(1).select(text.source_slice(F.lit("abc\ndef\nghi"), F.lit(1), F.lit(2), F.lit(2), F.lit(2)).alias("s"), paths.parse_symbol_ref(F.lit("a:b/c.py:12#f")).alias("r"), paths.parse_symbol_ref(F.lit("bad")).alias("n")).first()
    assert one.s == "bc\nde" and tuple(one.r) == ("a:b/c.py", 12, "f") and one.n.path is None


def test_ignored_and_test_paths(spark):
    said = {"src/target/x.rs": False, "a/fixtures/x.py": True, "a/.nyc_output/x.js": True, "x/.DS_Store/y.py": True, "foobar/x.py": True, "a/b/gen/x.py": True, "gen/x.py": False, "one.py": True, "src/one.pyx": True, "src/bone.py": False, "__pycache__/x.py": False}
    df = spark.createDataFrame([(p,) for p in said], "p string").select("p", paths.should_ignore_path(F.col("p"), F.array(F.lit("foo*"), F.lit("gen/"), F.lit("one.py"))).alias("i"))
    assert {r.p: r.i for r in df.collect()} == said
    tests = {"a/benches/x.rs": True, "tests.rs": False, "x_test.rs": True, "a.e2e.ts": True, "a.e2e-spec.ts": True, "a.e2e-spec.tsx": False, "a.integration.js": True, "a.test.py": False, "test_a.py": True, "conftest.py": True, "a/conftest.ts": False, "tests/a.py": False, "x/tests/a.py": True, "__tests__/a.js": True, "x.go": False}
    df = spark.createDataFrame([(p,) for p in tests], "p string").select("p", paths.is_test_file(F.col("p"), paths.detect_language(F.col("p"))).alias("t"))
    assert {r.p: bool(r.t) for r in df.collect()} == tests


def test_ancestors_by_doubling(spark, monkeypatch):
    made = []
    monkeypatch.setattr(recursion, "written", lambda df, f=recursion.written: made.append(1) or f(df))
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (103, 100)], "id int, parent int")
    got = {(r.id, r.ancestor): r.dist for r in recursion.ancestors(chain).collect()}
    want = {(i, j): i - j for i in range(40) for j in range(i + 1)}
    want |= {(100 + i, 100 + j): (j - i) % 3 for i in range(3) for j in range(3)} | {(103, 103): 0, (103, 100): 1, (103, 101): 2, (103, 102): 3}
    assert got == want and len(made) <= 2 + 2 * 7  # two tables a round, and as many rounds as 40 has binary digits, and one


def test_scopes(spark):
    import random

    rng = random.Random(4)
    spans = [(i, a, a + rng.choice([1, 3, 20, 400]), rng.randrange(4), rng.randrange(2)) for i in range(60) for a in [rng.randrange(500)]]
    points = [(i, rng.randrange(520), rng.randrange(2)) for i in range(80)]
    s = spark.createDataFrame(spans, "span int, low int, high int, depth int, key int")
    p = spark.createDataFrame(points, "id int, at int, key int")
    small, deep, tied = {}, {}, set()
    for i, at, key in points:
        inside = [x for x in spans if x[4] == key and x[1] <= at < x[2]]
        small[i] = min(inside, key=lambda x: (x[2] - x[1], x[0]))[0] if inside else None
        inside = [x for x in spans if x[4] == key and x[1] <= at <= x[2]]
        top = [x[0] for x in inside if x[3] == max(y[3] for y in inside)]
        deep[i] = top[0] if len(top) == 1 else None
        tied |= {i} if len(top) > 1 else set()
    assert dict(map(tuple, scopes.smallest_container(p, s, "key").collect())) == small
    found, ties = scopes.deepest_container(p, s, "key")
    assert dict(map(tuple, found.collect())) == deep and {r.id for r in ties.collect()} == tied
    none = s.limit(0)
    assert {r.span for r in scopes.smallest_container(p, none, "key").collect()} == {None}


def test_bodies(spark):
    d = [(1, "f", "f", 3, 5, 3, 9), (2, "f", "g", 10, 1, 10, 4), (3, "f", "<anonymous>", 20, 4, 22, 9), (4, "f", "h", 30, 1, 30, 3), (5, "f", "k", 50, 1, 50, 3), (6, "g", "f", 3, 5, 3, 9), (7, "f", "", 60, 1, 60, 2)]
    s = [("a", "f", "function", "f", 3, 12, 5, 1), ("b", "f", "function", "f", 3, 10, 6, 1), ("c", "f", "method", "g", 14, 2, 18, 1), ("d", "f", "function", None, 20, 4, 22, 9), ("e", "f", "function", None, 19, 1, 25, 1),
         ("x", "f", "class", "f", 3, 9, 9, 1), ("i", "f", "function", None, 31, 1, 33, 1), ("j", "f", "constructor", "other", 50, 9, 53, 1), ("l", "f", "function", "named", 61, 1, 64, 1)]
    spot = "start_line int, start_column int, end_line int, end_column int"
    got, lost = scopes.match_bodies(spark.createDataFrame(d, f"id int, file string, name string, {spot}"), spark.createDataFrame(s, f"scope string, file string, type string, name string, {spot}"))
    assert {r.id: (r.scope, r.strategy) for r in got.collect()} == {1: ("b", 1), 2: ("c", 2), 3: ("d", 0), 4: ("i", 3), 7: ("l", 3)}
    assert sorted(r.id for r in lost.collect()) == [5, 6]


def test_unlimited_neighbourhood(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 2)], "caller int, callee int")
    tree = graph.neighbourhood(spark.createDataFrame([(0,)], "node int"), edges, None)
    assert [(r.depth, r.node, r.cycle) for r in tree.orderBy("depth").collect()] == [(i, i, False) for i in range(7)] + [(7, 2, True)]


def test_upkeep(spark):
    files_ = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    manifest = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, content_hash string")
    assert rows(maintenance.cache_state(files_, manifest)) == [("a", "hit"), ("b", "stale"), ("c", "new"), ("d", "deleted")]
    lines = spark.createDataFrame([("100644 abc1 0\tdir/x y.py",), ("junk",)], "value string")
    assert rows(maintenance.parse_ls_files(lines)) == [("dir/x y.py", "abc1")]


def test_usage(spark, tmp_path):
    log = usage.UsageLog(str(tmp_path))
    run = log.tool("t")(lambda x: 1 // x)
    assert run(x=1) == 1
    try:
        run(x=0)
    except ZeroDivisionError:
        pass
    log.close()
    calls = files.read_tool_calls(spark, str(tmp_path)).collect()
    assert [c.success for c in calls] == [True, False] and json.loads(calls[0].arguments) == {"x": 1}
    assert files.read_sessions(spark, str(tmp_path)).count() == 1 and files.read_sessions(spark, str(tmp_path / "none")).count() == 0


def test_folder_reader(tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    reader = watch._Reader(str(tmp_path), [".py"])
    first, at = reader.read(reader.initialOffset())
    assert [(p, op, c) for p, op, _, c in first] == [("a.py", "add", "x = 1")]
    (tmp_path / "a.py").unlink()
    (tmp_path / "b.py").write_text("y")
    (tmp_path / "c.txt").write_text("no")
    second, end = reader.read(at)
    assert [(p, op) for p, op, _, _ in second] == [("b.py", "add"), ("a.py", "delete")]
    assert [e[2] for e in reader.readBetweenOffsets(at, end)] == [1, 2]


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    pass\n")
    seen = []
    watcher = watch.Watcher.__new__(watch.Watcher)
    watcher.upsert = lambda batch, i: seen.extend((r.path, r.op) for r in batch.collect())
    query = watch.Watcher.start(watcher, spark, str(src), str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [("a.py", "add")]
