"""End to end: small Python projects to call graphs."""

import pytest

from lucidgraph.plans.project import Project, render_entry_points
from lucidgraph.sources import files

CODE = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Base:\n    def __init__(self):\n        self.setup()\n    def setup(self):\n        pass\n    def run(self):\n        return self.step()\n    def step(self):\n        return 1\n",
    "pkg/child.py": "from .base import Base as Root\nclass Child(Root):\n    def step(self):\n        return helper()\ndef helper():\n    return 2\ndef dead():\n    return dead()\n",
    "pkg/api.py": "from .child import Child\n",
    "pkg/handlers.py": "def on_a():\n    pass\ndef on_b():\n    pass\nMORE = {'b': on_b}\nALL = {'a': on_a, **MORE}\ndef dispatch(k):\n    h = ALL.get(k)\n    return h()\n",
    "app.py": "from pkg.api import Child\nfrom pkg import handlers\nimport pkg.base as b\ndef main():\n    c = Child()\n    c.run()\n    handlers.dispatch('a')\n    return list(map(lambda x: leaf(x), [1]))\ndef leaf(x):\n    return x\ndef __dunder__():\n    pass\ndef apply(f):\n    return f\ndef named():\n    pass\ndef user():\n    return apply(named)\n",
    "tests/test_app.py": "from app import main, leaf\ndef test_leaf():\n    leaf(1)\n",
    "broken.py": "def (:\n",
    "x.rs": "fn main() {}\n",
}


@pytest.fixture(scope="module")
def project(spark):
    return Project(files.with_header(spark.createDataFrame(list(CODE.items()), "path string, content string")))


def called(project):
    names = project.nodes().select("node", "name")
    e = project.edges().join(names.withColumnRenamed("node", "caller").withColumnRenamed("name", "a"), "caller").join(names.withColumnRenamed("node", "callee").withColumnRenamed("name", "b"), "callee")
    return {(r.a, r.b) for r in e.select("a", "b").collect()}


def test_calls(project):
    got = called(project)
    assert {("main", "run"), ("run", "step"), ("step", "helper"), ("main", "dispatch"), ("dispatch", "on_a"), ("dispatch", "on_b"), ("main", "<anonymous>"), ("<anonymous>", "leaf"), ("user", "apply"), ("main", "__init__"), ("__init__", "setup"), ("dead", "dead"), ("test_leaf", "leaf")} == got


def test_entry_points(project):
    rows = project.entry_points().collect()
    assert [r.name for r in rows] == ["main", "user"] and rows[0].tree_size > rows[1].tree_size
    assert "main()" in render_entry_points(project.entry_points())
    assert {r.name for r in project.entry_points(include_tests=True).collect()} == {"main", "user", "test_leaf"}


def test_neighbourhood_and_upsert(project, spark):
    near = project.neighbourhood("app.py:9#leaf", 1)
    assert near["callers"].filter("depth = 1").count() == 2 and near["callees"].filter("depth = 1").count() == 0
    changed = spark.createDataFrame([("app.py", "def main():\n    pass\n")], "path string, content string")
    assert {r.path for r in project.affected(changed).collect()} == {"app.py", "tests/test_app.py"}
    after = project.upsert(changed, spark.createDataFrame([("tests/test_app.py",)], "path string"))
    whole = Project(files.with_header(spark.createDataFrame([(p, c) for p, c in (CODE | {"app.py": "def main():\n    pass\n"}).items() if p != "tests/test_app.py"], "path string, content string")))
    assert called(after) == called(whole)
    skipped = {r.path for r in project.facts["skipped"].collect()}
    assert skipped == {"broken.py", "x.rs"}


def test_reports_are_whole(project, spark):
    from lucidgraph.plans.project import render_tree

    tree = spark.range(1500).selectExpr("array('root', printf('n%04d', 1499 - id)) AS path", "1 AS depth", "printf('n%04d', 1499 - id) AS node", "id = 0 AS cycle").repartition(7)
    nodes = spark.range(1500).selectExpr("printf('n%04d', id) AS node", "concat('f', id) AS name", "'a.py' AS file_path", "id AS start_line")
    lines = render_tree(tree, nodes).split("\n")
    assert lines == [f"  f{i} (a.py:{i})" for i in range(1499)] + ["  f1499 (a.py:1499) [cycle]"]
    assert render_tree(tree, nodes, limit=2).split("\n") == [*lines[:2], "(1498 more not shown)"]
    found = spark.range(150).selectExpr("printf('s%03d', id) AS signature", "150 - id AS tree_size", "'a.py' AS file_path", "id AS start_line", "'n' AS name").orderBy("signature")
    report = render_entry_points(found).split("\n")
    assert len(report) == 151 and report[-1].startswith("- s149 ")
    assert render_entry_points(found, limit=100).split("\n") == [*report[:101], "(50 more not shown)"]
