"""The driver contract, and every query with SQL against DuckDB on the smallest tables."""

import glob
import importlib.util
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load():
    spec = importlib.util.spec_from_file_location("__spark_entry__", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_and_contract(spark, sf):
    e = load()
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_stands_without_the_llm_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("acequia.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "acequia.llm", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("acequia.llm.queries")
    assert {"p1_found", "p5_found"} <= set(load().queries())
    for path in glob.glob(f"{ROOT}/acequia/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path, encoding="utf-8") as f:
                assert "acequia.llm" not in f.read(), path


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def names():
    from acequia.plans.reference import ORACLE

    return sorted(ORACLE)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, sf, duck, name):
    from acequia.plans.reference import ORACLE, QUERIES

    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    rows = lambda rs: sorted(tuple(repr(r[c]) for c in sorted(cols)) for r in rs)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(cols, r)) for r in want.fetchall())
