"""Queries against their SQL on the smallest tables, where those are there."""

import glob
import os

import pytest

from lucidgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
FEW = ["test_files", "ignore_patterns", "import_javascript", "import_typescript", "deepest_scope", "child_scope_by_name", "affected_files", "nearest_body_scope", "containment_smallest", "lexical_resolve", "export_chain", "tree_size_ranked", "polymorphic_dispatch_class", "neighborhood_callees_d2", "recent_sessions"]


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FEW)
def test_equals_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(catalogue.ORACLES[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda df: sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert [[x.removesuffix(".0") for x in r] for r in rows(got)] == [[x.removesuffix(".0") for x in r] for r in rows(want)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("side", ["callees", "callers"])
def test_neighbourhoods_of_every_node(spark, side):
    import duckdb

    name, beside = f"neighborhood_{side}_d2_every_node", {}
    for e in catalogue.call_edges(spark, SF).collect():
        a, b = (e.caller, e.callee) if side == "callees" else (e.callee, e.caller)
        if side == "callees" or a != b:
            beside.setdefault(a, set()).add(b)
    want = []

    def walk(path):
        cycle = path[-1] in path[:-1]
        if len(path) <= 3 or cycle:
            want.append((">".join(map(str, path)), len(path) - 1, path[-1], cycle))
            for n in () if cycle else beside.get(path[-1], ()):
                walk([*path, n])

    for part in catalogue.nodes(spark, SF).collect():
        walk([part.node])
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, SF).collect())) == sorted(want)
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(con.execute(catalogue.ORACLES[name]).fetchall()) == sorted(want)
