"""Key ranges and scan options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.predicates import Predicate


@dataclass(frozen=True)
class KeyRange:
    """Keys between two bounds, each inclusive or not; None leaves a side open. A prefix range has no upper bound to compute."""

    start: str | None = None
    end: str | None = None
    start_inclusive: bool = True
    end_inclusive: bool = False
    starts_with: str | None = None

    @classmethod
    def all(cls) -> KeyRange:
        return cls()

    @classmethod
    def half_open(cls, start: str | None, end: str | None) -> KeyRange:
        return cls(start, end)

    @classmethod
    def closed(cls, start: str | None, end: str | None) -> KeyRange:
        return cls(start, end, True, True)

    @classmethod
    def open(cls, start: str | None, end: str | None) -> KeyRange:
        return cls(start, end, False, False)

    @classmethod
    def prefix(cls, prefix: str) -> KeyRange:
        if prefix is None:
            raise TypeError("a prefix can't be null")
        return cls(prefix, starts_with=prefix) if prefix else cls()

    def contains(self, key: str | None) -> bool:
        if key is None:
            return False
        code = key.encode("utf-8", "surrogatepass")
        low = None if self.start is None else self.start.encode("utf-8", "surrogatepass")
        high = None if self.end is None else self.end.encode("utf-8", "surrogatepass")
        if self.starts_with is not None and not key.startswith(self.starts_with):
            return False
        if low is not None and (code < low or (code == low and not self.start_inclusive)):
            return False
        return high is None or code < high or (code == high and self.end_inclusive)

    def column(self, key: str = "key") -> Column | None:
        """The range as a predicate that Parquet can push down; None for all keys."""
        c, parts = F.col(key), []
        if self.starts_with is not None:
            parts.append(c.startswith(self.starts_with))
        elif self.start is not None:
            parts.append(c >= self.start if self.start_inclusive else c > self.start)
        if self.end is not None:
            parts.append(c <= self.end if self.end_inclusive else c < self.end)
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def may_hold(self, low: str | None, high: str | None) -> bool:
        """Whether keys low .. high may reach into the range; for leaving out files."""
        if low is None or high is None:
            return False
        if self.starts_with is not None:
            return low[: len(self.starts_with)] <= self.starts_with <= high[: len(self.starts_with)] or low.startswith(self.starts_with) or high.startswith(self.starts_with)
        if self.start is not None and (high < self.start or (high == self.start and not self.start_inclusive)):
            return False
        return self.end is None or low < self.end or (low == self.end and self.end_inclusive)

    def __str__(self) -> str:
        left = ("[" if self.start_inclusive else "(") + ("-inf" if self.start is None else self.start)
        right = ("+inf" if self.end is None else self.end) + ("]" if self.end_inclusive else ")")
        return f"{left}, {right}"


@dataclass(frozen=True)
class ScanOptions:
    """What to scan: a range, a predicate, and at most limit rows in key order (None: all)."""

    range: KeyRange = KeyRange()
    limit: int | None = None
    predicate: Predicate = Predicate.any()

    def __post_init__(self) -> None:
        if self.range is None or self.predicate is None:
            raise TypeError("range and predicate can't be null")
        if self.limit is not None and self.limit <= 0:
            raise ValueError("limit must be positive")
