"""Weighted rendezvous sharding of stable record keys.

Every row scores each shard with -ln(u) / weight, where u in (0, 1) is a hash of the row's key and the shard's id,
and goes to the shard with the least score (ties: smaller id). The key and the shard list alone decide, so one more
shard takes rows only into itself, and in expectation a share of the rows equal to its share of the weight.

Everything is DataFrame expressions, and hashes are MD5, so any engine gets the same. Nulls: a null key is a key like any other (all
null keys share one shard). Repeated rows each get a slot of their own. A key that many different rows share is one shard's, but its
rows are numbered in cells of their own hash. An empty table gives an empty result; other columns are neither read nor kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Cells of a shard within which rows are numbered on their own; shards x CELLS counts are all that is ever broadcast.
CELLS = 2048
#: Copies of one row that a single array holds when repeated rows are expanded.
CHUNK = 4096


def digest_number(text: Column, digits: int = 12) -> Column:
    """The number that the first hexadecimal digits of a text's MD5 give."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def as_text(key: Column) -> Column:
    """A key as text; a null key differs from an empty one."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def unit_hash(key: Column, shard: int) -> Column:
    """A double in (0, 1) from a key and a shard's id."""
    return (digest_number(F.concat(F.lit(f"{shard}:"), as_text(key))) + 0.5) / float(1 << 48)


def rendezvous(key: Column, shards: Mapping[int, float]) -> Column:
    """The shard (int) of a key, out of {shard id: weight}; weights are positive."""
    if not shards or any(not w > 0 for w in shards.values()):
        raise ValueError("shards need positive weights")
    scored = [F.struct((-F.log(unit_hash(key, int(s))) / F.lit(float(w))).alias("score"), F.lit(int(s)).cast("int").alias("shard")) for s, w in sorted(shards.items())]
    return F.array_min(F.array(*scored))["shard"]


def with_slots(rows: DataFrame, key: str, shards: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """rows plus shard, slot and grown_shard (null without grown).

    slot numbers a shard's rows from 0 without gaps, in the order of (cell of the row's hash, the row's columns). Equal rows
    are counted before the shuffle and expanded after it, so a row that is repeated a billion times is one row on the way.
    """
    cols = rows.columns
    cell = F.pmod(digest_number(F.concat_ws("|", *(as_text(F.col(c)) for c in cols)), 8), F.lit(CELLS)).cast("int")
    merged = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumns({"shard": rendezvous(F.col(key), shards), "_cell": cell})
    if grown:
        merged = merged.withColumn("grown_shard", rendezvous(F.col(key), grown))
    else:
        merged = merged.withColumn("grown_shard", F.lit(None).cast("int"))
    merged = materialise(merged, "shards")
    within = W.partitionBy("shard").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = merged.groupBy("shard", "_cell").agg(F.sum("_n").alias("_n")).select("shard", "_cell", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_start"))
    before = W.partitionBy("shard", "_cell").orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)
    # starts has at most len(shards) x CELLS rows, whatever the input: a bounded broadcast
    numbered = merged.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(starts), ["shard", "_cell"])
    first = numbered.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK))).alias("_chunk"))
    each = first.select("*", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("_n") - 1, F.col("_chunk") * CHUNK + CHUNK - 1))).alias("_copy"))
    return each.select(*cols, "shard", (F.col("_start") + F.col("_before") + F.col("_copy")).cast("long").alias("slot"), "grown_shard")


def document_shards(docs: DataFrame, n: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text + 8), text_crc32, law, shard of 0 .. n - 1, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = with_slots(rows, "doc_id", {s: 1.0 for s in range(n)}, {s: 1.0 for s in range(n + 1)})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The same as SQL, for 24 and 25 shards of equal weight; the checksum goes byte by byte, by a table of 256 remainders.
SHARDS_SQL = r"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
rem AS (SELECT list(c ORDER BY i) AS rem FROM bits WHERE k = 8),
d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, list_concat([4294967295::BIGINT], [('0x' || h)::BIGINT for h in regexp_extract_all(hex(encode(text)), '..')]) AS bytes FROM d),
r AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, c: xor(a >> 8, rem[1 + (xor(a, c) & 255)])), 4294967295)::BIGINT AS text_crc32 FROM b, rem),
u AS (SELECT *, [struct_pack(score := -ln((('0x' || substr(md5(s || ':' || coalesce('=' || doc_id, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE), shard := s::INTEGER) for s in range(25)] AS scored FROM r),
p AS (SELECT doc_id, size, text_crc32, list_min(scored[1:24]).shard AS shard, list_min(scored).shard AS grown_shard,
  ('0x' || substr(md5(concat_ws('|', coalesce('=' || doc_id, ''), coalesce('=' || size, ''), coalesce('=' || text_crc32, ''))), 1, 8))::BIGINT % 2048 AS cell FROM u)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard FROM p
"""
