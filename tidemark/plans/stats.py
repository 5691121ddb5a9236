"""Counters of a store."""

from __future__ import annotations

import threading

COUNTERS = ("puts", "gets", "deletes", "memtable_hits", "file_hits", "misses", "bloom_prunes", "bytes_written", "bytes_read", "compactions", "flushes")
GAUGES = ("file_count", "disk_bytes")


class Stats:
    """Eleven counters and two gauges; reset leaves the gauges."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        for name in (*COUNTERS, *GAUGES):
            setattr(self, name, 0)

    def add(self, name: str, n: int = 1) -> None:
        if name not in COUNTERS:
            raise ValueError(f"no counter {name}")
        if n > 0:
            with self._lock:
                setattr(self, name, getattr(self, name) + n)

    def count(self, *names: str) -> None:
        """One more of each counter."""
        with self._lock:
            held = self.__dict__
            for name in names:
                held[name] += 1

    def set_gauges(self, file_count: int, disk_bytes: int) -> None:
        self.file_count, self.disk_bytes = file_count, disk_bytes

    @property
    def total_operations(self) -> int:
        return self.puts + self.gets + self.deletes

    @property
    def memtable_hit_ratio(self) -> float:
        return self.memtable_hits / self.gets if self.gets else 0.0

    def reset(self) -> None:
        with self._lock:
            for name in COUNTERS:
                setattr(self, name, 0)

    def as_dict(self) -> dict[str, int]:
        return {name: getattr(self, name) for name in (*COUNTERS, *GAUGES)}

    def __str__(self) -> str:
        return ", ".join(f"{k}={v}" for k, v in self.as_dict().items()) + f", hit_ratio={self.memtable_hit_ratio:.4f}"


def percentile(latencies: list[int], p: float) -> int:
    """The value at the floor index n * p of the sorted latencies; 0 if there are none."""
    return sorted(latencies)[min(int(len(latencies) * p), len(latencies) - 1)] if latencies else 0


def throughput(operations: int, elapsed_ms: float) -> float:
    """Operations a second, over a millisecond at least."""
    return operations * 1000.0 / max(1.0, elapsed_ms)


def human_bytes(n: int, units: str = "KMGTPE") -> str:
    """Bytes in the greatest of the units that leaves one at least; the last unit takes all that is larger."""
    if n < 1024:
        return f"{n} B"
    size, unit = float(n), ""
    for unit in units:
        size /= 1024
        if size < 1024:
            break
    return f"{size:.2f} {unit}B"
