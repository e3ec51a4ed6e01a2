"""Every query of the catalogue against its DuckDB equivalent, and plan checks."""

import glob
import math

import duckdb
import pytest

from dossier import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {path.split('/')[-1][:-8]} as select * from '{path}'")
    return con


def text(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.9g}"
    return "[" + ",".join(map(text, value)) + "]" if isinstance(value, (list, tuple)) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(text(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    data = [tuple(r) for r in found.collect()]
    if name not in catalog.ORACLE:
        assert data
        return
    cursor = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, data) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["q_drop_hidden", "q_hidden_text", "q_box_changes", "q_redaction_ledger", "q_postings", "q_stopword_ratio"])
def test_plans_have_no_nested_loops_or_python(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"))
