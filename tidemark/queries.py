"""The registered queries of the key-value engine over logs that the provided tables give, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import sql as SQL
from tidemark import store_queries

from tidemark.functions import hashing
from tidemark.functions.schema import estimated_size, is_tombstone, padded_key, text, text_or_null, type_name
from tidemark.operators import live as L
from tidemark.operators.predicates import Predicate as P
from tidemark.operators.query import QueryEngine
from tidemark.operators.ranges import KeyRange, ScanOptions
from tidemark.sources.derived import catalog_log, events_log, with_tier

AS_OF = 1_705_000_000_000

LOG = """log AS (SELECT printf('user:%08d', user_id) AS key, concat(event_type, '|', props) AS value,
  epoch_us(ts) // 1000 AS ts_ms, CAST(event_id AS BIGINT) AS seq, CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS TINYINT) AS op FROM events),
latest AS (SELECT key, value, ts_ms, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS rn FROM log) WHERE rn = 1),
live AS (SELECT key, value, ts_ms FROM latest WHERE op = 1),
tiers AS (SELECT *, CASE WHEN seq < 3000 THEN 0 WHEN seq < 6000 THEN 1 WHEN seq < 9000 THEN 2 ELSE 3 END AS tier FROM log)"""
CATALOG = """cat AS (SELECT printf('cust:%08d', c_custkey) AS key, c_name AS value FROM customer
UNION ALL SELECT printf('supp:%08d', s_suppkey), s_name FROM supplier
UNION ALL SELECT printf('part:%08d', p_partkey), p_name FROM part
UNION ALL SELECT printf('ordr:%08d', o_orderkey), o_orderpriority FROM orders)"""


def _plain(df: DataFrame) -> DataFrame:
    return df.select("key", text().alias("value"), "ts_ms")


def _engine(spark, d) -> QueryEngine:
    return QueryEngine(events_log(spark, d))


def _scan(options: ScanOptions):
    return lambda spark, d: _plain(_engine(spark, d).stream(options))


def _filter(predicate):
    return lambda spark, d: _plain(_engine(spark, d).stream_filter(predicate()))


def _tiers(spark, d) -> DataFrame:
    return with_tier(events_log(spark, d))


def _compact_partial(spark, d):
    tiers = _tiers(spark, d)
    return L.merge([tiers.filter(F.col("tier") == t).drop("tier") for t in (1, 2)]).select("key", text_or_null().alias("value"), "ts_ms", F.col("op").cast("int").alias("op"))


def _compact_full(spark, d):
    tiers = _tiers(spark, d)
    return _plain(L.merge([tiers.filter(F.col("tier") == t).drop("tier") for t in range(4)], purge=True))


def _tier_stats(spark, d):
    return _tiers(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(is_tombstone().cast("long")).alias("tombstones"))


def _key_versions(spark, d):
    return events_log(spark, d).select("key", "ts_ms", "seq", type_name().alias("type"), estimated_size().alias("size"))


def _byte_size(spark, d):
    latest = L.latest(events_log(spark, d)).withColumn("value", F.when(is_tombstone(), F.lit(b"")).otherwise(F.col("value")))
    return latest.agg(F.count(F.lit(1)).alias("n"), F.sum(estimated_size()).alias("bytes"))


def _namespaces(spark, d):
    return QueryEngine(catalog_log(spark, d)).count_by_key_prefix(5)


def _latest_by_key(spark, d):
    return L.latest_value(events_log(spark, d)).select("key", text().alias("value"), "ts_ms", F.col("op").cast("int").alias("op"))


def _sparse(spark, d):
    return L.sparse_index(L.live(events_log(spark, d)).select("key"), 16).select("key", F.col("ordinal").cast("long").alias("ordinal"))


def _sparse_search(spark, d):
    index = L.sparse_index(L.live(events_log(spark, d)).select("key"), 16)
    return L.index_block(index, "user:00000100").withColumn("asked", F.lit("user:00000100"))


def _blocks(spark, d):
    return L.index_blocks(L.live(events_log(spark, d)).select("key", F.octet_length("value").cast("long").alias("size")), 16)


def _percentile(spark, d):
    return L.floor_percentiles(events_log(spark, d).select(F.octet_length("value").cast("long").alias("v")), "v")


def _occ(spark, d):
    """Every mutation as a transaction of its hour: those whose key was written again before the hour ended."""
    log = events_log(spark, d).select(F.floor(F.col("ts_ms") / 3_600_000).alias("hour"), "key", F.col("seq").alias("start"))
    return L.conflicts_within(log, log.withColumnRenamed("start", "version"), ["hour"])


def _overlay(spark, d):
    log = events_log(spark, d)
    own = log.filter("seq % 97 = 0").groupBy("key").agg(F.max_by(F.struct("value", "ts_ms", "seq", "op"), "seq").alias("r")).select("key", "r.*")
    return _plain(L.overlay(L.live(log.filter("seq % 97 <> 0")), own))


def _precedence(spark, d):
    return L.by_tier(_tiers(spark, d)).filter("op = 1").select("key", text().alias("value"), F.col("tier").cast("int").alias("tier"))


def _throughput(spark, d):
    e = events_log(spark, d).agg(F.count(F.lit(1)).alias("n"), (F.max("ts_ms") - F.min("ts_ms")).alias("ms"))
    return e.select("n", F.greatest(F.lit(1), "ms").cast("long").alias("ms"), F.round(F.col("n") * 1000.0 / F.greatest(F.lit(1), "ms"), 9).alias("per_second"))


def _padded(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(padded_key("user:", F.col("c_custkey")).alias("key"))


def _checksums(spark, d):
    return events_log(spark, d).select("seq", F.crc32("value").alias("crc"))


def _murmur(spark, d):
    return L.live(events_log(spark, d)).select("key", hashing.murmur3_column(F.col("key")).alias("hash"))


def _bloom(spark, d):
    log = events_log(spark, d)
    keys = log.select("key").distinct()
    held = hashing.bloom_table(keys, 1000)
    absent = keys.select(F.concat(F.lit("no-"), "key").alias("key"))
    return hashing.bloom_probe(keys.unionByName(absent), held, 1000)


def _murmur_seeds(spark, d):
    return events_log(spark, d).select("seq", *(hashing.murmur3_column(F.col("value"), seed).alias(f"h{k}") for k, seed in enumerate((hashing.SEED_1, hashing.SEED_2))))


def _bloom_words(spark, d):
    return hashing.bloom_table(events_log(spark, d).select("key").distinct(), 1000)


def _bloom_sizing(spark, d):
    """Filter sizes for the number of mutations of every key."""
    counts = events_log(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("n")

    def size(frames):
        for f in frames:
            rows = [(n, fpp, *hashing.bloom_size(n, fpp)) for n in f["n"].tolist() for fpp in (0.01, 0.001, 0.3)]
            yield pd.DataFrame(rows, columns=["n", "fpp", "bits", "k"])

    return counts.mapInPandas(size, "n long, fpp double, bits long, k int")


def _log_frames(spark, d):
    """Every mutation as its log frame and back: what decoding gives, and the frame's bytes."""
    from collections.abc import Iterator

    from tidemark.sources.logfile import decode_frames, encode_frame

    def trip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [encode_frame(k, b"" if op == 2 else bytes(v), t, op) for k, v, t, op in zip(f["key"], f["value"], f["ts_ms"], f["op"], strict=True)]
            back = list(decode_frames(b"".join(made), False))
            yield pd.DataFrame({"seq": f["seq"], "key": [b[0] for b in back], "ts_ms": [b[2] for b in back], "op": [b[3] for b in back], "frame_bytes": list(map(len, made))})

    return events_log(spark, d).mapInPandas(trip, "seq long, key string, ts_ms long, op int, frame_bytes long")


#: name -> (query, SQL after the common tables, or None)
ALL: dict = {
    "full_scan": (_scan(ScanOptions()), "SELECT * FROM live"),
    "point_get": (lambda s, d: _plain(_engine(s, d).get("user:00000010")), "SELECT * FROM live WHERE key = 'user:00000010'"),
    "point_get_deleted": (lambda s, d: _plain(_engine(s, d).get("user:00000008")), "SELECT * FROM live WHERE key = 'user:00000008'"),
    "range_half_open": (_scan(ScanOptions(KeyRange.half_open("user:00000010", "user:00000050"))), "SELECT * FROM live WHERE key >= 'user:00000010' AND key < 'user:00000050'"),
    "range_closed": (_scan(ScanOptions(KeyRange.closed("user:00000010", "user:00000050"))), "SELECT * FROM live WHERE key BETWEEN 'user:00000010' AND 'user:00000050'"),
    "range_open": (_scan(ScanOptions(KeyRange.open("user:00000010", "user:00000050"))), "SELECT * FROM live WHERE key > 'user:00000010' AND key < 'user:00000050'"),
    "range_custom": (_scan(ScanOptions(KeyRange("user:00000010", "user:00000050", False, True))), "SELECT * FROM live WHERE key > 'user:00000010' AND key <= 'user:00000050'"),
    "range_from": (_scan(ScanOptions(KeyRange.half_open("user:00000100", None))), "SELECT * FROM live WHERE key >= 'user:00000100'"),
    "prefix_scan": (_scan(ScanOptions(KeyRange.prefix("user:0000001"))), "SELECT * FROM live WHERE starts_with(key, 'user:0000001')"),
    "key_regex": (_filter(lambda: P.key_matches("user:000000[13][05]")), "SELECT * FROM live WHERE regexp_full_match(key, 'user:000000[13][05]')"),
    "value_contains": (_filter(lambda: P.value_contains("click")), "SELECT * FROM live WHERE contains(value, 'click')"),
    "bool_combo": (_filter(lambda: ~P.value_contains("view") & (P.key_starts_with("user:0000000") | P.value_contains("purchase"))), "SELECT * FROM live WHERE NOT contains(value, 'view') AND (starts_with(key, 'user:0000000') OR contains(value, 'purchase'))"),
    "python_predicate": (_filter(lambda: P.from_python(lambda r: r["ts_ms"] % 2 == 0)), "SELECT * FROM live WHERE ts_ms % 2 = 0"),
    "options_scan": (_scan(ScanOptions(KeyRange.half_open("user:00000010", "user:00000100"), 7, P.value_contains("signup"))), "SELECT * FROM live WHERE key >= 'user:00000010' AND key < 'user:00000100' AND contains(value, 'signup') ORDER BY key LIMIT 7"),
    "first_n_matching": (lambda s, d: _plain(_engine(s, d).first_n(P.value_contains("click"), 5)), "SELECT * FROM live WHERE contains(value, 'click') ORDER BY key LIMIT 5"),
    "count_live": (lambda s, d: _engine(s, d).count_live(), "SELECT count(*) AS n FROM live"),
    "count_matching": (lambda s, d: _engine(s, d).count_matching(P.value_contains("purchase")), "SELECT count(*) AS n FROM live WHERE contains(value, 'purchase')"),
    "count_by_prefix": (lambda s, d: _engine(s, d).count_by_key_prefix(12), "SELECT substr(key, 1, 12) AS prefix, count(*) AS n FROM live GROUP BY 1"),
    "namespace_counts": (_namespaces, f"WITH {CATALOG} SELECT substr(key, 1, 5) AS prefix, count(DISTINCT key) AS n FROM cat GROUP BY 1"),
    "to_pairs": (lambda s, d: _engine(s, d).to_pairs("user:00000001", "user:00000030"), "SELECT key, value FROM live WHERE key >= 'user:00000001' AND key < 'user:00000030'"),
    "latest_by_key": (_latest_by_key, "SELECT key, value, ts_ms, CAST(op AS INTEGER) AS op FROM latest"),
    "key_bounds": (lambda s, d: _engine(s, d).key_bounds(), "SELECT min(key) AS min_key, max(key) AS max_key, count(*) AS n, CAST(sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) AS BIGINT) AS tombstones FROM latest"),
    "byte_size": (_byte_size, "SELECT count(*) AS n, CAST(sum(64 + strlen(key) + CASE WHEN op = 2 THEN 0 ELSE strlen(value) END) AS BIGINT) AS bytes FROM latest"),
    "record_projection": (_key_versions, "SELECT key, ts_ms, seq, CASE op WHEN 1 THEN 'PUT' ELSE 'DELETE' END AS type, CAST(64 + strlen(key) + strlen(value) AS BIGINT) AS size FROM log"),
    "deleted_keys": (lambda s, d: L.deleted_keys(events_log(s, d)), "SELECT DISTINCT key FROM log WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.key = log.key)"),
    "as_of": (lambda s, d: _plain(L.as_of(events_log(s, d), AS_OF)), f"SELECT key, value, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS rn FROM log WHERE ts_ms < {AS_OF}) WHERE rn = 1 AND op = 1"),
    "compact_partial": (_compact_partial, "SELECT key, CASE WHEN op = 1 THEN value END AS value, ts_ms, CAST(op AS INTEGER) AS op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS rn FROM tiers WHERE tier IN (1, 2)) WHERE rn = 1"),
    "compact_full": (_compact_full, "SELECT * FROM live"),
    "tier_precedence_get": (_precedence, "SELECT key, value, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier DESC, ts_ms DESC, seq DESC) AS rn FROM tiers) WHERE rn = 1 AND op = 1"),
    "tier_stats": (_tier_stats, "SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n, count(DISTINCT key) AS n_keys, min(key) AS min_key, max(key) AS max_key, CAST(sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) AS BIGINT) AS tombstones FROM tiers GROUP BY 1"),
    "txn_overlay": (_overlay, """SELECT key, value, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS rn FROM log WHERE seq % 97 <> 0) WHERE rn = 1 AND op = 1
      AND key NOT IN (SELECT key FROM log WHERE seq % 97 = 0) UNION ALL SELECT key, value, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE seq % 97 = 0) WHERE rn = 1 AND op = 1"""),
    "occ_conflicts": (_occ, "SELECT hour, key, start FROM (SELECT ts_ms // 3600000 AS hour, key, seq AS start, max(seq) OVER (PARTITION BY ts_ms // 3600000, key) AS last FROM log) WHERE last > start"),
    "sparse_index": (_sparse, "SELECT key, i AS ordinal FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM live) WHERE i % 16 = 0"),
    "sparse_search": (_sparse_search, "SELECT coalesce(max(key) FILTER (WHERE key <= 'user:00000100'), min(key)) AS key, 'user:00000100' AS asked FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM live) WHERE i % 16 = 0"),
    "index_blocks": (_blocks, """SELECT key, CAST(o AS BIGINT) AS "offset", CAST(coalesce(lead(o) OVER (ORDER BY key), total) - o AS BIGINT) AS size FROM (SELECT key, coalesce(sum(strlen(value)) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, sum(strlen(value)) OVER () AS total, row_number() OVER (ORDER BY key) - 1 AS i FROM live) WHERE i % 16 = 0"""),
    "latency_percentile": (_percentile, "SELECT max(v) FILTER (WHERE i = (n * 50) // 100) AS p50, max(v) FILTER (WHERE i = (n * 95) // 100) AS p95, max(v) FILTER (WHERE i = (n * 99) // 100) AS p99, coalesce(round(avg(v), 6), 0.0) AS avg FROM (SELECT strlen(value) AS v, row_number() OVER (ORDER BY strlen(value)) - 1 AS i, count(*) OVER () AS n FROM log)"),
    "throughput": (_throughput, "SELECT count(*) AS n, greatest(1, max(ts_ms) - min(ts_ms)) AS ms, round(count(*) * 1000.0::DOUBLE / greatest(1, max(ts_ms) - min(ts_ms)), 9) AS per_second FROM log"),
    "padded_keys": (_padded, "SELECT printf('user:%08d', c_custkey) AS key FROM customer"),
    "checksums": (_checksums, f"SELECT seq, {SQL.crc32('value')} AS crc FROM log, {SQL.REMAINDERS}"),
    "murmur_keys": (_murmur, f"SELECT key, CAST(CASE WHEN h >= 2147483648 THEN h::BIGINT - 4294967296 ELSE h END AS INTEGER) AS hash FROM (SELECT key, {SQL.murmur3('b', 0)} AS h FROM (SELECT key, {SQL.bytes_of('key')} AS b FROM live))"),
    "murmur_seeds": (_murmur_seeds, f"SELECT seq, h0, h1 FROM (SELECT seq, {SQL.signed(SQL.murmur3('b', hashing.SEED_1))} AS h0, {SQL.signed(SQL.murmur3('b', hashing.SEED_2))} AS h1 FROM (SELECT seq, {SQL.bytes_of('value')} AS b FROM log))"),
    "bloom_words": (_bloom_words, f"WITH {LOG}, p AS (SELECT unnest({SQL.bloom_places('b', *hashing.bloom_size(1000))}) AS p FROM (SELECT {SQL.bytes_of('key')} AS b FROM (SELECT DISTINCT key FROM log))) SELECT p // 64 AS word, CAST(CASE WHEN w >= 9223372036854775808 THEN w::HUGEINT - 18446744073709551616 ELSE w END AS BIGINT) AS bits FROM (SELECT p // 64 AS p64, bit_or(1::UBIGINT << (p % 64)::INTEGER) AS w, any_value(p) AS p FROM p GROUP BY p64)"),
    "bloom_probe": (_bloom, f"WITH {LOG}, k AS (SELECT DISTINCT key FROM log), a AS (SELECT key, {SQL.bloom_places('b', *hashing.bloom_size(1000))} AS p FROM (SELECT key, {SQL.bytes_of('key')} AS b FROM (SELECT key FROM k UNION ALL SELECT 'no-' || key FROM k))), s AS (SELECT DISTINCT unnest(p) AS p FROM a WHERE NOT starts_with(key, 'no-')) SELECT a.key, bool_and(s.p IS NOT NULL) AS might_contain FROM (SELECT key, unnest(p) AS p FROM a) a LEFT JOIN s USING (p) GROUP BY a.key"),
    "bloom_sizing": (_bloom_sizing, f"SELECT n, fpp, bits, CAST(greatest(1, least(30, floor(bits::DOUBLE / greatest(n, 1) * ln(2) + 0.5))) AS INTEGER) AS k FROM (SELECT n, fpp, CAST(ceil(greatest(64, ceil(-greatest(n, 1) * ln(fpp) / (ln(2) * ln(2)))) / 64) * 64 AS BIGINT) AS bits FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM log GROUP BY key), (VALUES (0.01::DOUBLE), (0.001::DOUBLE), (0.3::DOUBLE)) f(fpp))"),
    "log_round_trip": (_log_frames, "SELECT seq, key, ts_ms, CAST(op AS INTEGER) AS op, CAST(21 + strlen(key) + CASE WHEN op = 2 THEN 0 ELSE strlen(value) END AS BIGINT) AS frame_bytes FROM log"),
}


def queries() -> dict:
    return {name: q for name, (q, _) in ALL.items()} | store_queries.queries()


def oracle_sql() -> dict[str, str]:
    own = {name: sql if sql.startswith("WITH") else f"WITH {LOG}\n{sql}" for name, (_, sql) in ALL.items() if sql}
    return own | store_queries.oracle_sql()
