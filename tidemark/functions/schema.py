"""The one row type of the engine, a mutation, and expressions over its columns."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = 1, 2
_NAMES = {PUT: "PUT", DELETE: "DELETE"}

#: key and value of a mutation, its time in epoch milliseconds, its commit's number, and 1 for a write or 2 for a deletion.
RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.BinaryType(), False),
    T.StructField("ts_ms", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.ByteType(), False),
])


def op_name(code: int) -> str:
    if code not in _NAMES:
        raise ValueError(f"unknown record type {code}")
    return _NAMES[code]


def op_code(name: str) -> int:
    for code, known in _NAMES.items():
        if known == name.upper():
            return code
    raise ValueError(f"unknown record type {name!r}")


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def as_bytes(value: bytes | str | None) -> bytes:
    """A value as stored: text as UTF-8, null as empty."""
    return b"" if value is None else value.encode() if isinstance(value, str) else bytes(value)


def check_key(key: str) -> str:
    if key is None:
        raise TypeError("a key can't be null")
    if not key:
        raise ValueError("a key can't be empty")
    return key


def put_row(key: str, value: bytes | str | None, ts_ms: int | None = None, seq: int = 0) -> tuple:
    return check_key(key), as_bytes(value), now_ms() if ts_ms is None else ts_ms, seq, PUT


def delete_row(key: str, ts_ms: int | None = None, seq: int = 0) -> tuple:
    return check_key(key), b"", now_ms() if ts_ms is None else ts_ms, seq, DELETE


def records(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small DataFrame of mutations out of driver rows."""
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def normalised(df: DataFrame) -> DataFrame:
    """df with exactly the columns of RECORD_SCHEMA: text values as UTF-8, null and deleted values empty, seq 0 where missing."""
    kinds = dict(df.dtypes)
    op = F.col("op").cast("byte") if "op" in kinds else F.lit(PUT).cast("byte")
    checked = F.when(op.isin(PUT, DELETE), op).otherwise(F.raise_error(F.lit("unknown record type")).cast("byte"))
    key = F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("a key can't be null or empty")).cast("string"))
    return df.select(
        key.alias("key"),
        F.when(op == DELETE, F.lit(b"")).otherwise(F.coalesce(F.col("value").cast("binary"), F.lit(b""))).alias("value"),
        (F.col("ts_ms") if "ts_ms" in kinds else F.unix_millis(F.current_timestamp())).cast("long").alias("ts_ms"),
        (F.col("seq") if "seq" in kinds else F.lit(0)).cast("long").alias("seq"),
        checked.alias("op"),
    )


def text(value: Column | str = "value") -> Column:
    """A value as text, bad UTF-8 replaced."""
    return F.make_valid_utf8(F.col(value).cast("string") if isinstance(value, str) else value.cast("string"))


def text_or_null(value: str = "value", op: str = "op") -> Column:
    """A value as text, null for deletions."""
    return F.when(F.col(op) == PUT, text(value))


def is_tombstone(op: str = "op") -> Column:
    return F.col(op) == DELETE


def estimated_size(key: str = "key", value: str = "value") -> Column:
    """Bytes that a buffered mutation counts for: 64, the key in UTF-8, the value."""
    return (F.lit(64) + F.octet_length(key) + F.octet_length(value)).cast("long")


def type_name(op: str = "op") -> Column:
    return F.when(F.col(op) == PUT, "PUT").when(F.col(op) == DELETE, "DELETE").otherwise(F.raise_error(F.lit("unknown record type")).cast("string"))


def padded_key(prefix: str, number: Column, width: int = 8) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def utf16_order(key: str = "key") -> Column:
    """Sort key for the order by UTF-16 code units; it differs from Spark's own only beyond U+FFFF."""
    return F.encode(F.col(key), "UTF-16BE")
