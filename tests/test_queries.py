"""Every registered query of the key-value engine against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    found = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in found.description]
    want = sorted((tuple(dict(zip(cols, r, strict=True))[c] for c in sorted(cols)) for r in found.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(cols) and got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bloom_probe_has_no_false_negative(spark):
    rows = entry.queries()["bloom_probe"](spark, SF).collect()
    assert all(r["might_contain"] for r in rows if not r["key"].startswith("no-"))
    assert sum(r["might_contain"] for r in rows if r["key"].startswith("no-")) <= len(rows) // 20
