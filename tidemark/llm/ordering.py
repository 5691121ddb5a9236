"""Training-order materialisation of fixed-length token sequences.

A text's tokens are its ids under a BPE vocabulary and an end mark, 16 bits each; they are cut into sequences of LENGTH tokens, the
last one padded. Sequences are numbered in the order of (bucket of the document's hash, doc_id, hashes of the text, number within the
text): a hash exchange brings buckets together, the sums of the BUCKETS buckets are broadcast (a fixed size), and within a bucket rows
are sorted. So a number depends on what is in the table alone, not on how it is stored or dealt to tasks. A keyed Feistel permutation
of the numbers, with cycle-walking down to their exact count, gives every sequence a global slot. A second exchange brings each range
of PER_SHARD slots together, and a task writes it as one shard of fixed-stride records: slot s lies in shard s // PER_SHARD at byte
(s % PER_SHARD) * stride. Shards that a destination already holds are left out before that exchange: the destination says which, in a
bit for each (1.5 MB for a hundred terabytes of tokens).

The permutation deals slots evenly whatever the input, so no key can make a shard large. Equal rows are counted where they are read.

Null texts count as empty; an empty text is one sequence that holds the end mark alone. Very long texts are many sequences. Null
ids stay null. Repeated rows are sequences of their own, in any order among themselves; an empty table gives none. Other columns are
neither read nor kept. Vocabularies of more than 65,535 ids raise ValueError.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bpe import BLOCK, default_vocabulary, held_coder, spread
from tidemark.llm.common import bounded, byte_view, release, slices, utf8
from tidemark.shared import shared_dir, written

#: Tokens of a sequence, sequences of a shard, the permutation's key.
LENGTH, PER_SHARD, KEY = 1024, 4096, 20260101
#: What fills up a last sequence; buckets of documents.
PAD, BUCKETS = 65_535, 1 << 16
STRIDE = 2 * LENGTH
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n - 1, at the given places: balanced rounds over the next even power of two, walked into range."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        return left << half | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (far := np.flatnonzero(out >= np.uint64(n))).size:
            out[far] = once(out[far])
    return out.astype(np.int64)


def end_mark(word: list[bytes]) -> int:
    """The id that ends a document: the vocabulary's own, else the next free one."""
    found = word.index(b"<|endoftext|>") if b"<|endoftext|>" in word else len(word)
    if found >= PAD or len(word) > PAD:
        raise ValueError("ids need more than 16 bits")
    return found


def token_rows(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """bucket, doc_id, k1, k2 (hashes of the text), copies, n (sequences), packed (the tokens): equal rows of a batch are one."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: a fixed size

    def run(batches):
        coder = held_coder(model.value)
        end = np.array([end_mark(coder.word)], "<u2")
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            copies: dict[tuple, int] = {}
            for key in keys:
                copies[key] = copies.get(key, 0) + 1
            first = {key: k for k, key in reversed(list(enumerate(keys)))}
            own = pa.array(sorted(first.values()), pa.int64())
            some = batch.take(own)
            buf, at = byte_view(some.column(4))
            for a, b in slices(len(some), at, BLOCK):
                ids, upto = coder.encode_rows(buf[at[a] : at[b]], at[a : b + 1] - at[a])
                packed = [zlib.compress(np.append(ids[x:y].astype("<u2"), end).tobytes(), 1) for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                many = [copies[keys[k]] for k in own[a:b].to_pylist()]
                n = np.diff(upto) // LENGTH + 1
                yield pa.RecordBatch.from_arrays([*(some.column(k).slice(a, b - a) for k in range(4)), pa.array(many, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=names)
        release()

    names = ["bucket", "doc_id", "k1", "k2", "copies", "n", "packed"]
    k1, k2 = F.xxhash64(utf8()), F.xxhash64(F.lit(1), utf8())
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), utf8().alias("data"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "k1", "k2"), F.lit(BUCKETS)).cast("int").alias("bucket"), "doc_id", "k1", "k2", "data")
    return rows.mapInArrow(run, "bucket int, doc_id long, k1 long, k2 long, copies long, n long, packed binary")


def numbered(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, packed, copies, n, first (number of the row's first sequence), total (of all sequences)."""

    def place(batches):
        """Sorted rows, equal ones as one, with the number of sequences before them in their bucket."""
        held, bucket, before, out, size = None, None, 0, [], 0

        def ended():
            nonlocal bucket, before, size
            if held[0] != bucket:
                bucket, before = held[0], 0
            out.append((bucket, held[1], before, held[4], held[5], held[6]))
            before += held[4] * held[5]
            size += len(held[6])

        def made():
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=["bucket", "doc_id", "before", "copies", "n", "packed"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[:4] == row[:4]:
                    held = (*held[:4], held[4] + row[4], *held[5:])
                    continue
                if held:
                    ended()
                held = row
            if size > BLOCK:
                yield made()
                out, size = [], 0
        if held:
            ended()
        if out:
            yield made()

    # both uses read the one exchange: Python takes all its columns, so none is pruned from either
    met = token_rows(docs, vocabulary).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "k1", "k2")
    placed = met.mapInArrow(place, "bucket int, doc_id long, before long, copies long, n long, packed binary")
    sums = placed.groupBy("bucket").agg(F.max(F.col("before") + F.col("copies") * F.col("n")).alias("size"))
    ahead = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # BUCKETS rows at most, and so is the broadcast
    starts = sums.select("bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"), F.sum("size").over(W.partitionBy()).alias("total"))
    return placed.join(F.broadcast(starts), "bucket").select("doc_id", "packed", "copies", "n", (F.col("start") + F.col("before")).alias("first"), "total")


def training_order(docs: DataFrame, key: int = KEY, vocabulary: str | None = None, per_shard: int = PER_SHARD, done: np.ndarray | None = None) -> DataFrame:
    """shard, slot, doc_id, seq_no, piece (its tokens) of every sequence; done: packed bits of the shards to leave out."""

    def run(batches):
        for batch in batches:
            copies, n, first, total = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
            held = [zlib.decompress(p) for p in batch.column(1).to_pylist()]
            # the sequences of all rows follow each other; every one but a row's last has STRIDE bytes
            row, seq = np.repeat(np.arange(len(n)), n), spread(np.zeros(len(n), np.int64), n)
            upto = np.cumsum([0, *map(len, held)])
            starts = np.append(upto[row] + seq * STRIDE, upto[-1])
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(b"".join(held))])
            place = np.cumsum(n) - n
            for r in np.flatnonzero(copies > 1).tolist():
                for a in range(int(n[r]), int(copies[r] * n[r]), 1 << 14):  # of many copies some at a time
                    more = np.arange(a, min(a + (1 << 14), int(copies[r] * n[r])))
                    yield from given(pieces, batch.column(0), np.full(len(more), r), place[r] + more % n[r], more % n[r], first[r] + more, total)
            yield from given(pieces, batch.column(0), row, np.arange(len(row)), seq, first[row] + seq, total)
        release()

    def given(pieces, ids, row, which, seq, number, total):
        for a in range(0, len(row), 4096):
            part = slice(a, a + 4096)
            slot = feistel(number[part], int(total[0]), key)
            shard, own = slot // per_shard, np.arange(a, a + len(slot))
            if done is not None:
                new = ~((done[np.minimum(shard >> 3, len(done) - 1)] >> (shard & 7) & 1).astype(bool) & (shard >> 3 < len(done)))
                slot, shard, own = slot[new], shard[new], own[new]
            cols = [pa.array(shard), pa.array(slot), ids.take(pa.array(row[own])), pa.array(seq[own], pa.int64()), pieces.take(pa.array(which[own])).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "slot", "doc_id", "seq_no", "piece"])

    return numbered(docs, vocabulary).mapInArrow(run, "shard long, slot long, doc_id long, seq_no long, piece binary")


def shards(ordered: DataFrame) -> DataFrame:
    """One row a shard: shard, first_slot, n_sequences, stride, sha256, payload, and the doc_id and seq_no of each record."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["shard", "first_slot", "n_sequences", "stride", "sha256", "payload", "doc_ids", "seq_nos"]

    def made(shard, rows):
        data = b"".join(piece.ljust(STRIDE, b"\xff") for _, _, _, piece in rows)
        row = (shard, rows[0][0], len(rows), STRIDE, hashlib.sha256(data).hexdigest(), data, [r[1] for r in rows], [r[2] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    def run(batches):
        shard, held = None, []
        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and at != shard:
                    yield made(shard, held)
                    held = []
                shard = at
                held.append(row)
        if held:
            yield made(shard, held)
        release()

    schema = "shard long, first_slot long, n_sequences long, stride long, sha256 string, payload binary, doc_ids array<long>, seq_nos array<long>"
    return ordered.repartition("shard").sortWithinPartitions("shard", "slot").mapInArrow(run, schema)


def held_shards(spark: SparkSession, path: str) -> np.ndarray | None:
    """Which shards a destination holds, a bit for each; None if there is no destination."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at) or not any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(at)):
        return None
    words = spark.read.parquet(path).select(F.floor(F.col("shard") / 32).cast("long").alias("word"), F.expr("shiftleft(1L, cast(shard % 32 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(int(found["word"].max()) + 1 if len(found) else 1, "<u4")
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def write_shards(docs: DataFrame, path: str, key: int = KEY, vocabulary: str | None = None, per_shard: int = PER_SHARD) -> None:
    """Add the shards that path lacks; a run that was cut off is taken up again by calling this once more, on the same documents."""
    made = shards(training_order(docs, key, vocabulary, per_shard, held_shards(docs.sparkSession, path)))
    made.write.mode("append").option("compression", "zstd").parquet(path)


def read_slots(spark: SparkSession, path: str, start: int, n: int, per_shard: int = PER_SHARD) -> DataFrame:
    """slot and record (binary) of the slots start .. start + n - 1, from as few shards as hold them."""
    found = spark.read.parquet(path).filter(F.col("shard").between(start // per_shard, (start + n - 1) // per_shard))
    each = found.select("payload", "stride", F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("n_sequences") - 1)).alias("slot"), "first_slot")
    record = F.expr("substring(payload, cast((slot - first_slot) * stride + 1 as int), cast(stride as int))")
    return each.filter(F.col("slot").between(start, start + n - 1)).select("slot", record.alias("record"))


def shard_records(stored: DataFrame) -> DataFrame:
    """Every record of stored shards: slot, shard, byte_offset, doc_id, seq_no, n_tokens, record_crc32."""
    names = ["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "record_crc32"]

    def run(batches):
        for batch in (x.slice(k, 1) for x in batches for k in range(len(x))):
            shard, first, n, stride, payload, docs, seqs = (c[0].as_py() for c in batch.columns)
            n_tokens = (np.frombuffer(payload, "<u2").reshape(n, -1) != PAD).sum(axis=1)
            at = np.arange(n, dtype=np.int64)
            crc = [zlib.crc32(payload[k * stride : (k + 1) * stride]) for k in range(n)]
            cols = (first + at, np.full(n, shard), at * stride, docs, seqs, n_tokens, crc)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
        release()

    rows = stored.select("shard", "first_slot", "n_sequences", "stride", "payload", "doc_ids", "seq_nos")
    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def document_order(docs: DataFrame) -> DataFrame:
    """All sequences in training order, written as shards into the shared folder, and the records as they are read back."""
    spark = docs.sparkSession
    path = written(f"{shared_dir(spark).rstrip('/')}/order-{uuid.uuid4().hex}")
    write_shards(docs, path)
    # a shard is a row of PER_SHARD records: few go to Python at once
    kinds = "shard long, first_slot long, n_sequences long, stride long, sha256 string, payload binary, doc_ids array<long>, seq_nos array<long>"
    return shard_records(spark.read.schema(kinds).parquet(path))
