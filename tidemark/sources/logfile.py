"""The binary log: checksummed frames of mutations, read as a Spark source and written as a Spark sink.

A frame, big-endian: crc32 u32 | time i64 | type u8 | key length i32 | key | value length i32 (-1 for a deletion) | value. The
checksum covers all that follows it. A log that ends within a frame has a torn tail, which reading may allow; a whole frame with
a wrong checksum is always an error. Frames can't be split, so a segment is read by one task; a log of many segments is read by many.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.errors import CorruptLogError, StorageError
from tidemark.functions.schema import DELETE, PUT

#: Most bytes of a key and of a value.
MAX_KEY, MAX_VALUE = 65_536, 64 << 20
_HEAD, _HEAD_SIZE = ">IqBi", 17
LOG_SCHEMA = "key string, value binary, ts_ms long, op tinyint, segment string, place long"
#: What a segment's name ends with once its mutations are in files and it stays for change feeds.
KEPT = ".kept"


def segment_name(ts_ms: int, first: int) -> str:
    """A name for a new segment: names sort by time, and say the number of the segment's first frame in the log."""
    return f"{ts_ms:020d}-{first:020d}-{uuid.uuid4().hex}.wal"


def first_frame(name: str) -> int | None:
    """The number in the log of a segment's first frame; None where its name doesn't say."""
    parts = name.split("-")
    return int(parts[1]) if len(parts) == 3 and len(parts[1]) == 20 and parts[1].isdigit() else None


def encode_frame(key: str, value: bytes, ts_ms: int, op: int) -> bytes:
    k = key.encode()
    if not 0 < len(k) <= MAX_KEY or len(value) > MAX_VALUE:
        raise ValueError("key or value is too long for a log frame, or the key is empty")
    tail = struct.pack(">i", -1) if op == DELETE else struct.pack(">i", len(value)) + value
    body = struct.pack(">qBi", ts_ms, op, len(k)) + k + tail
    return struct.pack(">I", zlib.crc32(body)) + body


def decode_frames(data: bytes, allow_torn_tail: bool = True) -> Iterator[tuple[str, bytes, int, int]]:
    """(key, value, ts_ms, op) of every frame in order."""
    at, end = 0, len(data)

    def torn(what: str) -> None:
        if not allow_torn_tail:
            raise CorruptLogError(f"log ends within {what}", at)

    while at < end:
        if end - at < _HEAD_SIZE:
            return torn("a frame's head")
        crc, ts_ms, op, n = struct.unpack_from(_HEAD, data, at)
        if not 0 < n <= MAX_KEY:
            raise CorruptLogError(f"bad key length {n}", at)
        k = at + _HEAD_SIZE
        if end - k < n + 4:
            return torn("a key")
        (m,) = struct.unpack_from(">i", data, k + n)
        if m < -1 or m > MAX_VALUE:
            raise CorruptLogError(f"bad value length {m}", at)
        stop = k + n + 4 + max(m, 0)
        if stop > end:
            return torn("a value")
        found = zlib.crc32(data[at + 4 : stop])
        if found != crc:
            raise CorruptLogError("bad frame", at, crc, found)
        if op not in (PUT, DELETE):
            raise CorruptLogError(f"unknown record type {op}", at)
        yield data[k : k + n].decode("utf-8", "replace"), data[k + n + 4 : stop], ts_ms, op
        at = stop


class LogWriter:
    """Appends frames to one local segment."""

    def __init__(self, path: str, sync: bool = True):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.path, self.sync_each, self.bytes_written = path, sync, 0
        self._file = open(path, "ab")  # noqa: SIM115

    def append(self, key: str, value: bytes, ts_ms: int, op: int) -> int:
        frame = encode_frame(key, value, ts_ms, op)
        self._file.write(frame)
        if self.sync_each:
            self.sync()
        self.bytes_written += len(frame)
        return len(frame)

    def sync(self) -> None:
        self._file.flush()
        os.fsync(self._file.fileno())

    def close(self) -> None:
        if not self._file.closed:
            self.sync()
            self._file.close()

    @property
    def closed(self) -> bool:
        return self._file.closed


class HadoopLogWriter:
    """Appends frames to one segment on any Hadoop file system; a sync makes them visible to readers where the file system can."""

    def __init__(self, fs, path, sync: bool = True):
        self.path, self.sync_each, self.bytes_written, self.closed = path, sync, 0, False
        self._file = fs.create(path, False)

    def append(self, key: str, value: bytes, ts_ms: int, op: int) -> int:
        frame = encode_frame(key, value, ts_ms, op)
        self._file.write(bytearray(frame))
        if self.sync_each:
            self.sync()
        self.bytes_written += len(frame)
        return len(frame)

    def sync(self) -> None:
        self._file.hflush()
        self._file.hsync()

    def close(self) -> None:
        if not self.closed:
            self.sync()
            self._file.close()
            self.closed = True


def read_segment(path: str, allow_torn_tail: bool = True) -> list[tuple[str, bytes, int, int]]:
    """A local segment's mutations."""
    if not os.path.exists(path):
        raise StorageError(f"no log at {path}")
    with open(path, "rb") as f:
        return list(decode_frames(f.read(), allow_torn_tail))


def read_log(spark: SparkSession, path: str, allow_torn_tail: bool = True) -> DataFrame:
    """All segments under a path of any Hadoop file system, of less than 2 GB each (a store's have about memtable_bytes). place orders a segment's mutations; segments are ordered by name."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(decode_frames(data, allow_torn_tail))
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64(), pa.int8()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())], names=["key", "value", "ts_ms", "op", "segment", "place"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    return files.select("path", "content").mapInArrow(run, LOG_SCHEMA)


def replayed(log: DataFrame) -> DataFrame:
    """A read log as mutations: within a segment and across segments, the last to arrive of a key wins its tie."""
    from pyspark.sql import Window as W

    order = W.partitionBy("key").orderBy("segment", "place")
    return log.select("key", "value", "ts_ms", F.row_number().over(order).cast("long").alias("seq"), "op")


class _Segment(InputPartition):
    """A segment, or its frames first .. last - 1."""

    def __init__(self, path: str, first: int = 0, last: int | None = None):
        self.path, self.first, self.last = path, first, last


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None, rows: int):
        self.path, self.rows = path, rows


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.torn = options["path"], options.get("allowTornTail", "true").lower() != "false"

    def partitions(self):
        if os.path.isfile(self.path):
            return [_Segment(self.path)]
        return [_Segment(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".wal")]

    def read(self, partition):
        for place, (key, value, ts_ms, op) in enumerate(read_segment(partition.path, self.torn)):
            yield key, value, ts_ms, op, os.path.basename(partition.path), place


class _Feed(DataSourceStreamReader):
    """A log as a change feed: mutations in the order of segments and frames, also of the segment that is being written.

    place counts the mutations of the whole log (of a segment, where its name doesn't say its first number). The offset names the last
    segment that was read and how many of its frames. Segments are named by their time, so new ones of a writer come later; a feed
    follows one writer. A store that is to be followed keeps its retired segments (Config.keep_log). Where mutations after the offset
    are gone, the feed fails, or goes on with what is there if failOnDataLoss is false.
    """

    def __init__(self, options):
        self.path, self.strict = options["path"], options.get("failOnDataLoss", "true").lower() != "false"

    def _names(self) -> list[str]:
        found = os.listdir(self.path) if os.path.isdir(self.path) else []
        return sorted({f.removesuffix(KEPT) for f in found if f.endswith((".wal", f".wal{KEPT}"))})

    def _read(self, name: str) -> list[tuple[str, bytes, int, int]] | None:
        """A segment's frames, whether or not it is retired meanwhile; None if it is gone."""
        for path in (os.path.join(self.path, name), os.path.join(self.path, name + KEPT)):
            try:
                return read_segment(path)
            except (StorageError, FileNotFoundError):
                continue
        return None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"segment": "", "frames": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        for name in reversed(self._names()):
            frames = self._read(name)
            if frames is not None:
                return {"segment": name, "frames": len(frames)}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Segment]:
        out, names = [], self._names()
        if start["segment"] and start["segment"] not in names:
            due, there = first_frame(start["segment"]), [n for n in names if n > start["segment"]]
            first = first_frame(there[0]) if there else None
            if due is None or first is None or first > due + start["frames"]:
                self._lost(f"what came after frame {start['frames']} of {start['segment']}")
        for name in names:
            if start["segment"] <= name <= end["segment"]:
                first = start["frames"] if name == start["segment"] else 0
                out.append(_Segment(os.path.join(self.path, name), first, end["frames"] if name == end["segment"] else None))
        return out

    def _lost(self, what: str) -> None:
        if self.strict:
            raise StorageError(f"{what} is no longer in the log; keep_log keeps a store's log for feeds")

    def read(self, partition: _Segment):
        name = os.path.basename(partition.path)
        frames = self._read(name)
        if frames is None:  # retired meanwhile
            return self._lost(name)
        base = first_frame(name) or 0
        for place, (key, value, ts_ms, op) in enumerate(frames):
            if place >= partition.first and (partition.last is None or place < partition.last):
                yield key, value, ts_ms, op, name, base + place


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        import uuid

        path, rows, out = os.path.join(self.path, f"{uuid.uuid4().hex}.wal.part"), 0, None
        for row in iterator:
            out = out or LogWriter(path, sync=False)
            out.append(row["key"], bytes(row["value"] or b""), row["ts_ms"], row["op"])
            rows += 1
        if out:
            out.close()
        return _Written(path if out else None, rows)

    def commit(self, messages):
        for k, m in enumerate(m for m in messages if m and m.path):
            os.replace(m.path, os.path.join(self.path, f"{k:06d}-{os.path.basename(m.path).removesuffix('.part')}"))

    def abort(self, messages):
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class LogDataSource(DataSource):
    """spark.read / readStream / df.write .format("mutation_log") over a folder that driver and executors share. Options: path, allowTornTail."""

    @classmethod
    def name(cls) -> str:
        return "mutation_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _Feed(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)
