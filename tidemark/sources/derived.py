"""Mutation logs derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.schema import DELETE, PUT, padded_key


def _millis(ts: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation for each event: the user is the key, an error deletes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).cast("byte")
    return e.select(
        padded_key("user:", F.col("user_id")).alias("key"),
        F.concat("event_type", F.lit("|"), "props").cast("binary").alias("value"),
        _millis("ts").alias("ts_ms"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
    )


def with_tier(log: DataFrame) -> DataFrame:
    """The log dealt to four tiers by arrival; tier 3 is the newest."""
    s = F.col("seq")
    return log.withColumn("tier", F.when(s < 3000, 0).when(s < 6000, 1).when(s < 9000, 2).otherwise(3))


def catalog_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, parts and orders under one key space."""

    def part(table: str, prefix: str, ident: str, value: str, ts: Column) -> DataFrame:
        t = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return t.select(padded_key(prefix, F.col(ident)).alias("key"), F.col(value).cast("binary").alias("value"), ts.alias("ts_ms"), F.col(ident).cast("long").alias("seq"), F.lit(PUT).cast("byte").alias("op"))

    never = F.lit(0).cast("long")
    out = part("customer", "cust:", "c_custkey", "c_name", never)
    out = out.unionByName(part("supplier", "supp:", "s_suppkey", "s_name", never))
    out = out.unionByName(part("part", "part:", "p_partkey", "p_name", never))
    return out.unionByName(part("orders", "ordr:", "o_orderkey", "o_orderpriority", _millis("o_orderdate")))
