"""Options of a store."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """All options have defaults; bad values raise ValueError at once.

    data_dir: root of the store. memtable_bytes: buffered bytes that cause a commit. index_interval: every n-th key in the
    sparse index, and rows of a Parquet page, of which there are 1024 at least. bloom_fpp: false-positive rate of the files' Bloom
    filters. compaction_threshold: commits at level 0 that make a compaction due. wal_sync: sync the log on every write.
    compaction_interval_ms: pause of the background thread. max_immutable: full buffers that may wait for that thread.
    target_file_bytes: size of compacted files. keep_tombstones_ms: deletions younger than this survive a purge.
    keep_log: log segments whose mutations are in files stay for change feeds, until Store.trim_log.
    """

    data_dir: str = "./data/tidemark"
    memtable_bytes: int = 4 << 20
    index_interval: int = 16
    bloom_fpp: float = 0.01
    compaction_threshold: int = 4
    wal_sync: bool = True
    compaction_interval_ms: int = 5000
    max_immutable: int = 4
    target_file_bytes: int = 128 << 20
    keep_tombstones_ms: int | None = None
    keep_log: bool = False

    def __post_init__(self) -> None:
        for name in ("memtable_bytes", "index_interval", "compaction_interval_ms", "max_immutable", "target_file_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0.0 < self.bloom_fpp < 1.0:
            raise ValueError("bloom_fpp must lie between 0 and 1")
        if self.compaction_threshold < 2:
            raise ValueError("compaction_threshold must be 2 or more")
        if not self.data_dir:
            raise ValueError("data_dir can't be empty")

    @property
    def wal_dir(self) -> str:
        return os.path.join(self.data_dir, "wal")

    @property
    def files_dir(self) -> str:
        return os.path.join(self.data_dir, "data")
