"""Which mutation of a key counts: one rule, the latest by (ts_ms, seq), everywhere."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.schema import DELETE, PUT

def newest_first() -> list[Column]:
    return [F.desc("ts_ms"), F.desc("seq")]


def latest(log: DataFrame) -> DataFrame:
    """The latest mutation of every key, deletions included.

    Spark limits the window to its first row on both sides of the shuffle, so a hot key is cut down where it is read, and
    predicates on the key go below it. Predicates on value or op must not: they would bring older versions back.
    """
    w = W.partitionBy("key").orderBy(*newest_first())
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def live(log: DataFrame) -> DataFrame:
    """The latest version of every key that isn't deleted."""
    return latest(log).filter(F.col("op") == PUT)


def merge(tiers: list[DataFrame], purge: bool = False, purge_before_ms: int | None = None) -> DataFrame:
    """All tiers as one, the latest mutation of each key. purge drops deletions, or only those before purge_before_ms."""
    if not tiers:
        raise ValueError("nothing to merge")
    one = latest(reduce(DataFrame.unionByName, tiers))
    if not purge:
        return one
    gone = F.col("op") == DELETE
    return one.filter(~(gone if purge_before_ms is None else gone & (F.col("ts_ms") < purge_before_ms)))


def as_of(log: DataFrame, ts_ms: int) -> DataFrame:
    """The live table as mutations before a time leave it."""
    return live(log.filter(F.col("ts_ms") < ts_ms))


def by_tier(log: DataFrame, tier: str = "tier") -> DataFrame:
    """The latest mutation of every key within the newest tier that has the key."""
    w = W.partitionBy("key").orderBy(F.desc(tier), *newest_first())
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_value(log: DataFrame) -> DataFrame:
    """key and value of the latest mutation by arg-max aggregation: cheaper than a window where few columns count."""
    top = F.max_by(F.struct("value", "op", "ts_ms"), F.struct("ts_ms", "seq"))
    return log.groupBy("key").agg(top.alias("_t")).select("key", "_t.value", "_t.ts_ms", "_t.op")


def deleted_keys(log: DataFrame) -> DataFrame:
    """Keys that mutations name but the live table lacks."""
    return latest(log.select("key", "ts_ms", "seq", "op")).filter(F.col("op") == DELETE).select("key")


def overlay(snapshot: DataFrame, own: DataFrame) -> DataFrame:
    """A live snapshot as seen through a transaction's own writes."""
    return snapshot.join(own.select("key"), "key", "left_anti").unionByName(own.filter(F.col("op") == PUT).select(*snapshot.columns))


def conflicts(keys: DataFrame, commits: DataFrame, start: int) -> DataFrame:
    """Those of keys that a commit after start wrote; commits: (key, version)."""
    return conflicts_within(keys.withColumn("start", F.lit(start)), commits, []).drop("start")


def conflicts_within(transactions: DataFrame, commits: DataFrame, scope: list[str]) -> DataFrame:
    """Those of transactions (scope, key, start) whose key a commit (scope, key, version) of the same scope wrote after they started.

    Commits are reduced to the last of each key before they meet the transactions, so a hot key is one row.
    """
    last = commits.groupBy(*scope, "key").agg(F.max("version").alias("_last"))
    return transactions.join(last, [*scope, "key"]).filter(F.col("_last") > F.col("start")).drop("_last")


def numbered(rows: DataFrame, key: str = "key", size: str | None = None) -> DataFrame:
    """rows with ordinal, their number from 0 in the order of key, and with offset, the sum of size over those before.

    The order is cut into ranges, one for each task, whose bounds come from a pass over the keys; rows are numbered within their
    range, and the ranges' counts and sums say where each begins. Equal keys come in any order.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = rows.select(key).repartitionByRange(ranges, key).groupBy(F.spark_partition_id()).agg(F.min(key).alias("low"))
    bounds = sorted(r["low"].encode() for r in low.filter("low is not null").collect())  # a row a task

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series([max(bisect_right(bounds, k.encode()) - 1, 0) if k is not None else 0 for k in keys], dtype="int32")

    placed = rows.withColumn("_r", range_of(F.col(key))).withColumn("_s", F.col(size) if size else F.lit(0).cast("long"))
    own = placed.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"), F.sum("_s").alias("_t"))
    ahead = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)  # a row a task
    starts = own.select("_r", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_base"))
    within = W.partitionBy("_r").orderBy(key)
    out = placed.withColumns({"_i": F.row_number().over(within) - 1, "_b": F.coalesce(F.sum("_s").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    out = out.join(F.broadcast(starts), "_r").withColumn("ordinal", (F.col("_first") + F.col("_i")).cast("long"))
    out = out.withColumn("offset", (F.col("_base") + F.col("_b")).cast("long")) if size else out
    return out.drop("_r", "_s", "_i", "_b", "_first", "_base")


def sparse_index(rows: DataFrame, every: int = 16, file: str | None = None) -> DataFrame:
    """Each every-th key in key order, within each file where a file column is named."""
    if every <= 0:
        raise ValueError("the interval must be positive")
    if file:  # a file's keys are one task's work anyway
        found = rows.withColumn("ordinal", (F.row_number().over(W.partitionBy(file).orderBy("key")) - 1).cast("long"))
    else:
        found = numbered(rows)
    return found.filter(F.col("ordinal") % every == 0)


def index_blocks(rows: DataFrame, every: int = 16) -> DataFrame:
    """key (the first of each every keys in order), offset and size (sums of the column size before and within the block)."""
    placed = numbered(rows, size="size")
    return placed.groupBy(F.floor(F.col("ordinal") / every).alias("_b")).agg(F.min("key").alias("key"), F.min("offset").alias("offset"), F.sum("size").alias("size")).drop("_b")


def floor_percentiles(rows: DataFrame, column: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The values at the floor index n * p / 100 of the sorted column, and its average, from the counts of its different values."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.select(column, "_n", F.sum("_n").over(W.orderBy(column)).alias("_upto"), F.sum("_n").over(W.partitionBy()).alias("_all"))  # different values
    at = [F.min(F.when(F.col("_upto") > F.floor(F.col("_all") * p / 100), F.col(column))).alias(f"p{p}") for p in percents]
    return upto.agg(*at, F.coalesce(F.round(F.sum(F.col(column) * F.col("_n")) / F.sum("_n"), 6), F.lit(0.0)).alias("avg"))


def index_block(index: DataFrame, key: str) -> DataFrame:
    """The index entry at which a search for key starts: the greatest that isn't above it, else the first."""
    return index.agg(F.coalesce(F.max(F.when(F.col("key") <= key, F.col("key"))), F.min("key")).alias("key"))
