import ast
import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
TABLES = ("nation", "customer", "part", "orders", "lineitem", "events", "documents", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    rel = duck.sql(catalogue.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = [[plain(dict(zip(rel.columns, r))[c]) for c in columns] for r in rel.fetchall()]
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == sorted(want)


def test_no_random_split_in_the_platform():
    for path in (ROOT / "tidemark").rglob("*.py"):
        calls = {n.func.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}
        assert not calls & {"randomSplit", "localCheckpoint"}, path


def test_platform_does_not_need_the_training_data_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
