"""Every query that has SQL against that SQL on the smallest tables."""

import datetime as dt
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def db(sf):
    return connected(sf)


def connected(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if v is None else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) or "" for i in order) for r in rows)


CORE = {n: s for m in entry._MODULES for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_as_sql(spark, sf, db, name):
    same_as_sql(spark, sf, db, name)


@pytest.mark.parametrize("name", ["p3_found", "p3_change_counts"])
def test_changes_of_more_snapshots(spark, sf, name):
    sf = sf.replace("sf0.001", "sf0.01")
    assert same_as_sql(spark, sf, connected(sf), name) > 10


def same_as_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    other = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got == table(other.columns, other.fetchall())
    return len(got)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["tab", "field", "n_values", "n_normal", "n_rewritten", "n_unreadable", "first_at", "last_at"] and df.count() == 4


def test_a_broken_subpackage_leaves_the_rest(monkeypatch):
    import importlib

    whole, load = entry.queries(), importlib.import_module
    assert len(entry.oracle_sql()) >= len(CORE)

    def broken(name, *a):
        if name == "arqueo.llm.queries":
            raise ImportError(name)
        return load(name, *a)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    assert set(entry.oracle_sql()) == set(CORE) and set(entry.queries()) <= set(whole)


def test_times_same_as_brute_force(spark, sf):
    from brute_times import norm

    from arqueo.plans import problems

    got = [tuple(r) for r in problems.all_times(spark, sf).select("raw", "norm").distinct().collect()]
    assert got and [(r, n) for r, n in got if norm(r) != n] == []


def test_nothing_outside_needs_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "arqueo"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "arqueo.llm" not in p.read_text(), p
