"""Predicates over mutations: Column expressions, and Python callables where nothing else will do."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.schema import PUT, text

_LITERAL = re.compile(r"[A-Za-z0-9_:\-/@#=,;!~%& ]*")


class Predicate:
    """A test of a mutation. Combine with &, | and ~, or and_, or_ and negate."""

    def __init__(self, column: Callable[[], Column]):
        if column is None:
            raise TypeError("a predicate can't be null")
        self._column = column

    def column(self) -> Column:
        return self._column()

    def and_(self, other: Predicate) -> Predicate:
        if other is None:
            raise TypeError("a predicate can't be null")
        return Predicate(lambda: self.column() & other.column())

    def or_(self, other: Predicate) -> Predicate:
        if other is None:
            raise TypeError("a predicate can't be null")
        return Predicate(lambda: self.column() | other.column())

    def negate(self) -> Predicate:
        return Predicate(lambda: ~self.column())

    __and__, __or__, __invert__ = and_, or_, negate

    @staticmethod
    def any() -> Predicate:
        return Predicate(lambda: F.lit(True))

    @staticmethod
    def of(condition: Column | Callable[[], Column]) -> Predicate:
        return Predicate(condition if callable(condition) and not isinstance(condition, Column) else lambda: condition)

    @staticmethod
    def key_matches(regex: str) -> Predicate:
        """Keys that the whole of a Java regular expression matches; a literal start also prunes."""
        if regex is None:
            raise TypeError("a pattern can't be null")
        spark = SparkSession.getActiveSession()
        if spark is not None:
            try:
                spark._jvm.java.util.regex.Pattern.compile(regex)
            except Exception as e:
                raise ValueError(f"bad pattern {regex!r}") from e
        start = literal_start(regex)

        def column() -> Column:
            whole = F.col("key").rlike(rf"\A(?:{regex})\z")
            return F.col("key").startswith(start) & whole if start else whole

        return Predicate(column)

    @staticmethod
    def key_starts_with(prefix: str) -> Predicate:
        if prefix is None:
            raise TypeError("a prefix can't be null")
        return Predicate(lambda: F.col("key").startswith(prefix))

    @staticmethod
    def value_contains(part: str) -> Predicate:
        """Values whose text holds part; false for deletions."""
        if part is None:
            raise TypeError("a substring can't be null")
        return Predicate(lambda: (F.col("op") == PUT) & text().contains(part))

    @staticmethod
    def from_python(test: Callable[[dict], bool]) -> Predicate:
        """Any Python test of a mutation as a dict. It runs in Arrow batches and can't be pushed down."""
        if test is None:
            raise TypeError("a test can't be null")

        @F.pandas_udf("boolean")
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([bool(test(row)) for row in rows.to_dict("records")], dtype=bool)

        return Predicate(lambda: run(F.struct("key", "value", "ts_ms", "op")))


def literal_start(regex: str) -> str:
    """The characters that every match of a pattern starts with, as far as they are plain to see."""
    if "|" in regex or "(?" in regex:
        return ""
    start = _LITERAL.match(regex)[0]
    after = regex[len(start) :]
    return start[:-1] if after[:1] and after[0] in "*?{+" else start
