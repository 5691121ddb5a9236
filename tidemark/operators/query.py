"""Range, prefix, predicate, count and map queries over a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schema import text
from tidemark.operators.live import latest, live
from tidemark.operators.predicates import Predicate
from tidemark.operators.ranges import KeyRange, ScanOptions


class QueryEngine:
    """Queries over the live table of a mutation log.

    Results are lazy DataFrames of key, value, ts_ms, seq, op. They are unordered unless ordered is asked for or a limit makes
    the order part of the result: a sort that nobody looks at would only cost.
    """

    def __init__(self, log: DataFrame):
        self.log = log

    def _ordered(self, df: DataFrame, ordered: bool) -> DataFrame:
        return df.orderBy("key") if ordered else df

    def stream(self, options: ScanOptions | None = None, ordered: bool = False) -> DataFrame:
        options = options or ScanOptions()
        bound = options.range.column()
        # the range goes below the version window, the predicate must not
        found = live(self.log if bound is None else self.log.filter(bound)).filter(options.predicate.column())
        return self._ordered(found, ordered) if options.limit is None else found.orderBy("key").limit(options.limit)

    def stream_range(self, start: str | None, end: str | None, ordered: bool = False) -> DataFrame:
        return self.stream(ScanOptions(KeyRange.half_open(start, end)), ordered)

    def stream_prefix(self, prefix: str, ordered: bool = False) -> DataFrame:
        return self.stream(ScanOptions(KeyRange.prefix(prefix)), ordered)

    def stream_filter(self, predicate: Predicate, ordered: bool = False) -> DataFrame:
        return self.stream(ScanOptions(predicate=predicate), ordered)

    def get(self, key: str) -> DataFrame:
        """The live row of a key, or none."""
        if key is None:
            raise TypeError("a key can't be null")
        return live(self.log.filter(F.col("key") == key))

    def count_live(self) -> DataFrame:
        return live(self.log.select("key", "ts_ms", "seq", "op")).agg(F.count(F.lit(1)).alias("n"))

    def count_matching(self, predicate: Predicate) -> DataFrame:
        return self.stream_filter(predicate).agg(F.count(F.lit(1)).alias("n"))

    def count_by_key_prefix(self, length: int) -> DataFrame:
        """prefix and n: live keys grouped by their first characters; shorter keys group as themselves."""
        if length <= 0:
            raise ValueError("the prefix length must be positive")
        rows = live(self.log.select("key", "ts_ms", "seq", "op"))
        return rows.groupBy(F.substring("key", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))

    def first_n(self, predicate: Predicate, n: int) -> DataFrame:
        """The first n matches in key order."""
        if n < 0:
            raise ValueError("n can't be negative")
        return self.stream_filter(predicate).orderBy("key").limit(n)

    find_top_n = first_n

    def to_pairs(self, start: str | None, end: str | None) -> DataFrame:
        """key and text of a half-open range."""
        return self.stream_range(start, end).select("key", text().alias("value"))

    def to_map(self, start: str | None, end: str | None) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.to_pairs(start, end).toLocalIterator()}

    def key_bounds(self) -> DataFrame:
        """Least and greatest key, number of keys and of deletions among the latest mutations."""
        rows = latest(self.log.select("key", "ts_ms", "seq", "op"))
        return rows.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("op") == 2).cast("long")), F.lit(0)).alias("tombstones"))
