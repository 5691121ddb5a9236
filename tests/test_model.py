"""Records, ranges, predicates, options, resolution and queries on small logs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import schema as S
from tidemark.operators import live as L
from tidemark.operators.predicates import Predicate as P
from tidemark.operators.predicates import literal_start
from tidemark.operators.query import QueryEngine
from tidemark.operators.ranges import KeyRange, ScanOptions

SEED = {
    "user:001": "Alice - Senior Engineer",
    "user:002": "Bob - Product Designer",
    "user:003": "Charlie - DevOps Specialist",
    "order:101": "Order #101 - Paid",
    "order:102": "Order #102 - Pending",
    "order:103": "Order #103 - Shipped",
}


@pytest.fixture(scope="module")
def engine(spark):
    rows = [S.put_row(k, v, 1000 + i, 1) for i, (k, v) in enumerate(SEED.items())]
    return QueryEngine(S.records(spark, rows).cache())


def keys(df):
    return [r["key"] for r in df.collect()]


def test_prefix_is_ordered(engine):
    assert keys(engine.stream_prefix("user:", ordered=True)) == ["user:001", "user:002", "user:003"]
    assert len(keys(engine.stream_prefix("order:"))) == 3
    assert len(keys(engine.stream_prefix(""))) == 6
    with pytest.raises(TypeError):
        engine.stream_prefix(None)


def test_predicates(engine):
    assert keys(engine.stream_filter(P.value_contains("Engineer"))) == ["user:001"]
    assert sorted(keys(engine.stream_filter(P.key_matches("order:10[12]")))) == ["order:101", "order:102"]
    assert keys(engine.stream_filter(P.key_matches("order"))) == []  # the whole key must match
    assert len(keys(engine.stream_filter(P.value_contains("")))) == 6
    both = P.key_starts_with("user:") & ~P.value_contains("Bob") | P.value_contains("Paid")
    assert sorted(keys(engine.stream_filter(both))) == ["order:101", "user:001", "user:003"]
    assert keys(engine.stream_filter(P.from_python(lambda r: r["key"].endswith("3")), ordered=True)) == ["order:103", "user:003"]
    with pytest.raises(ValueError):
        P.key_matches("a[")
    for bad in (P.key_matches, P.key_starts_with, P.value_contains, P.any().and_, P.any().or_):
        with pytest.raises(TypeError):
            bad(None)


@pytest.mark.parametrize(("regex", "start"), [("user:0*", "user:"), ("user:0[12]", "user:0"), ("a|b", ""), ("ab?c", "a"), (".*", ""), ("abc", "abc"), ("ab{2}", "a"), ("(?i)ab", "")])
def test_literal_start(regex, start):
    assert literal_start(regex) == start


def test_counts_and_map(engine):
    assert {r["prefix"]: r["n"] for r in engine.count_by_key_prefix(5).collect()} == {"user:": 3, "order": 3}
    assert len(engine.count_by_key_prefix(100).collect()) == 6
    assert engine.to_map("user:001", "user:003") == {k: SEED[k] for k in ("user:001", "user:002")}
    assert engine.count_live().first()["n"] == 6
    assert engine.count_matching(P.value_contains("Order")).first()["n"] == 3
    assert keys(engine.first_n(P.any(), 2)) == ["order:101", "order:102"]
    assert keys(engine.find_top_n(P.any(), 0)) == []
    for bad in (lambda: engine.count_by_key_prefix(0), lambda: engine.first_n(P.any(), -1)):
        with pytest.raises(ValueError):
            bad()


def test_options(engine):
    found = engine.stream(ScanOptions(KeyRange.closed("order:102", "user:001"), 2, ~P.value_contains("Pending")))
    assert keys(found) == ["order:103", "user:001"]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            ScanOptions(limit=bad)
    with pytest.raises(TypeError):
        ScanOptions(range=None)
    with pytest.raises(TypeError):
        ScanOptions(predicate=None)


@pytest.mark.parametrize(
    ("found", "want"),
    [
        (KeyRange.half_open("k20", "k40"), ["k20", "k30"]),
        (KeyRange.half_open(None, "k30"), ["k10", "k20"]),
        (KeyRange.half_open("k30", None), ["k30", "k40", "k50"]),
        (KeyRange.closed("k20", "k40"), ["k20", "k30", "k40"]),
        (KeyRange.open("k20", "k40"), ["k30"]),
        (KeyRange("k20", "k40", False, True), ["k30", "k40"]),
        (KeyRange.all(), ["k10", "k20", "k30", "k40", "k50"]),
        (KeyRange.half_open("k40", "k20"), []),
        (KeyRange.prefix("k3"), ["k30"]),
        (KeyRange.prefix("￿"), []),
    ],
)
def test_ranges(spark, found, want):
    all_ = [f"k{n}0" for n in range(1, 6)]
    rows = S.records(spark, [S.put_row(k, "", 1) for k in all_])
    bound = found.column()
    assert sorted(keys(rows if bound is None else rows.filter(bound))) == want == [k for k in all_ if found.contains(k)]
    assert not found.contains(None)
    assert not want or found.may_hold(want[0], want[-1])
    assert all(found.may_hold(a, b) for a in all_ for b in all_ if a <= b and any(a <= w <= b for w in want))


def test_range_text():
    assert str(KeyRange.half_open("a", None)) == "[a, +inf)"
    assert str(KeyRange.open("a", "b")) == "(a, b)"
    assert str(KeyRange.closed("a", "b")) == "[a, b]"


def test_records(spark):
    assert S.put_row("k", None, 5) == ("k", b"", 5, 0, 1)
    assert S.delete_row("k", 5) == ("k", b"", 5, 0, 2)
    with pytest.raises(ValueError):
        S.put_row("", "v")
    with pytest.raises(TypeError):
        S.put_row(None, "v")
    with pytest.raises(ValueError):
        S.op_name(3)
    assert S.op_code("delete") == 2
    rows = S.records(spark, [("é", b"\xff\x41", 1, 0, 1), ("b", b"xyz", 1, 0, 2)])
    got = {r["key"]: r for r in rows.select("key", S.text_or_null().alias("t"), S.estimated_size().alias("s"), S.is_tombstone().alias("d"), S.type_name().alias("n")).collect()}
    assert got["é"]["t"] == "�A" and got["é"]["s"] == 68 and got["é"]["n"] == "PUT"
    assert got["b"]["t"] is None and got["b"]["d"]


def test_normalised_checks(spark):
    df = spark.createDataFrame([("k", None, 2, "x")], "key string, value string, op int, extra string")
    row = S.normalised(df).first()
    assert (row["key"], bytes(row["value"]), row["op"]) == ("k", b"", 2)
    with pytest.raises(Exception, match="null or empty"):
        S.normalised(spark.createDataFrame([("", "v")], "key string, value string")).collect()
    with pytest.raises(Exception, match="record type"):
        S.normalised(spark.createDataFrame([("k", "v", 7)], "key string, value string, op int")).collect()


def test_merge_rules(spark):
    old = S.records(spark, [S.put_row(k, "old", 1000, 1) for k in ("key1", "key2", "key3")])
    new = S.records(spark, [S.put_row("key1", "new", 2000, 2), S.delete_row("key2", 2000, 2), S.put_row("key4", "new", 2000, 2)])
    purged = {r["key"]: bytes(r["value"]) for r in L.merge([old, new], purge=True).collect()}
    assert purged == {"key1": b"new", "key3": b"old", "key4": b"new"}
    assert {r["key"]: r["op"] for r in L.merge([new, old]).collect()}["key2"] == 2
    assert len(L.merge([old, new], purge=True, purge_before_ms=1500).collect()) == 4
    assert [r["key"] for r in L.deleted_keys(old.unionByName(new)).collect()] == ["key2"]
    with pytest.raises(ValueError):
        L.merge([])


def test_ties_go_to_the_later_commit(spark):
    log = S.records(spark, [("k", b"a", 5, 1, 1), ("k", b"b", 5, 2, 1), ("k", b"c", 4, 3, 1)])
    assert bytes(L.live(log).first()["value"]) == b"b"
    assert bytes(L.latest_value(log).first()["value"]) == b"b"
    assert bytes(L.as_of(log, 5).first()["value"]) == b"c"


def test_value_predicate_stays_above_resolution(spark):
    log = S.records(spark, [("k", b"old match", 1, 1, 1), ("k", b"new", 2, 2, 1)])
    assert QueryEngine(log).stream_filter(P.value_contains("match")).count() == 0


def test_key_predicate_reaches_the_scan(spark, tmp_path):
    S.records(spark, [S.put_row(f"k{n}", "v", n, n) for n in range(9)]).write.parquet(str(tmp_path / "log"))
    log = spark.read.schema(S.RECORD_SCHEMA).parquet(str(tmp_path / "log"))
    plan = QueryEngine(log).stream_prefix("k1")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,k1)" in plan and "WindowGroupLimit" in plan


def test_sparse_index(spark):
    rows = S.records(spark, [S.put_row(f"k{n:04d}", "v", 1) for n in range(100)])
    index = L.sparse_index(rows, 8)
    assert sorted(keys(index)) == [f"k{n:04d}" for n in range(0, 100, 8)]
    for asked, want in (("k0017", "k0016"), ("k0016", "k0016"), ("a", "k0000"), ("z", "k0096")):
        assert L.index_block(index, asked).first()["key"] == want
    with pytest.raises(ValueError):
        L.sparse_index(rows, 0)


def test_empty_log(spark):
    q = QueryEngine(S.records(spark, []))
    assert q.count_live().first()["n"] == 0 and q.stream().count() == 0 and q.to_map(None, None) == {}
    assert q.key_bounds().first()["min_key"] is None
    assert q.log.filter(F.lit(True)).count() == 0


def test_rows_are_numbered_across_ranges(spark):
    import random

    rng = random.Random(2)
    names = [f"k{rng.randrange(10**6)}" for _ in range(500)] + ["same"] * 40
    rows = [(k, rng.randrange(9)) for k in names]
    df = spark.createDataFrame(rows, "key string, size long").repartition(7)
    got = sorted(L.numbered(df, size="size").collect(), key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in got] == list(range(len(rows))) and [r["key"] for r in got] == sorted(names)
    at = 0
    for r in got:
        assert r["offset"] == at
        at += r["size"]
    blocks = sorted(L.index_blocks(df, 16).collect(), key=lambda r: r["offset"])
    assert len(blocks) == -(-len(rows) // 16) and sum(r["size"] for r in blocks) == at
    assert L.numbered(df.limit(0)).count() == 0
    ordered = sorted(s for _, s in rows)
    p = L.floor_percentiles(df, "size").first()
    assert (p["p50"], p["p95"], p["p99"]) == tuple(ordered[len(rows) * q // 100] for q in (50, 95, 99))


def test_conflicts_within_scopes(spark):
    log = spark.createDataFrame([("h", "a", 1), ("h", "a", 5), ("h", "b", 2), ("i", "a", 9)], "hour string, key string, start long")
    got = {tuple(r) for r in L.conflicts_within(log, log.withColumnRenamed("start", "version"), ["hour"]).select("hour", "key", "start").collect()}
    assert got == {("h", "a", 1)}
    asked = spark.createDataFrame([("a",), ("b",)], "key string")
    commits = spark.createDataFrame([("a", 3), ("b", 1)], "key string, version long")
    assert [r["key"] for r in L.conflicts(asked, commits, 2).collect()] == ["a"]
