"""Log files, hashes, Bloom filters, streaming and the shell."""

import io

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.errors import CorruptLogError, StorageError
from tidemark.functions import hashing as H
from tidemark.functions import schema as S
from tidemark.plans.config import Config
from tidemark.plans.store import Store
from tidemark.sources.logfile import LogDataSource, LogWriter, _Feed, decode_frames, encode_frame, read_log, read_segment, replayed
from tidemark.streaming.ingest import ingest, latest_by_key, windowed_counts

ROWS = [("user:001", b"Alice", 1000, 1), ("user:002", b"Bob", 2000, 1), ("user:001", b"", 3000, 2)]


def segment(path, rows=ROWS):
    w = LogWriter(str(path))
    for r in rows:
        w.append(*r)
    w.close()
    assert w.closed
    return str(path)


def test_replay_in_order(tmp_path):
    assert read_segment(segment(tmp_path / "a.wal")) == ROWS


def test_bit_flip_is_an_error(tmp_path):
    data = bytearray(open(segment(tmp_path / "a.wal", ROWS[:1]), "rb").read())
    data[-5] ^= 0xFF
    for torn in (True, False):
        with pytest.raises(CorruptLogError):
            list(decode_frames(bytes(data), torn))


def test_torn_tail():
    data = b"".join(encode_frame(*r) for r in ROWS[:2])
    for cut in range(1, len(encode_frame(*ROWS[1]))):
        assert list(decode_frames(data[:-cut])) == ROWS[:1]
        with pytest.raises(CorruptLogError):
            list(decode_frames(data[:-cut], False))
    assert list(decode_frames(data + bytes([1, 2, 3, 4, 5]))) == ROWS[:2]


def test_limits(tmp_path):
    for key, value in (("", b""), ("k" * 65_537, b"")):
        with pytest.raises(ValueError):
            encode_frame(key, value, 0, 1)
    with pytest.raises(StorageError):
        read_segment(str(tmp_path / "none.wal"))


def test_log_as_spark_source_and_sink(spark, tmp_path):
    segment(tmp_path / "1.wal")
    segment(tmp_path / "2.wal", [("user:003", b"Carol", 500, 1)])
    (tmp_path / "other.txt").write_text("x")
    log = read_log(spark, str(tmp_path))
    assert sorted((r["key"], bytes(r["value"]), r["ts_ms"], r["op"]) for r in log.collect()) == sorted([*ROWS, ("user:003", b"Carol", 500, 1)])
    from tidemark.operators.live import live

    assert sorted(r["key"] for r in live(replayed(log)).collect()) == ["user:002", "user:003"]
    spark.dataSource.register(LogDataSource)
    out = tmp_path / "out"
    out.mkdir()
    log.write.format("mutation_log").mode("append").save(str(out))
    back = spark.read.format("mutation_log").load(str(out))
    assert sorted((r["key"], r["ts_ms"]) for r in back.collect()) == sorted([(r[0], r[2]) for r in ROWS] + [("user:003", 500)])


def test_murmur_vectors(spark):
    for data, seed, want in (("", 0, 0), ("", 1, 0x514E28B7), ("test", 0, 0xBA6BD213), ("Hello, world!", 0, 0xC0363E43)):
        assert H.murmur3(data, seed) == want
    assert H.murmur3(None) == 0 and H.crc32(b"123456789") == 3421780262 and H.crc32(b"x123456789y", 1, 9) == 3421780262
    df = spark.createDataFrame([("test",), (None,)], "k string")
    assert [r[0] for r in df.select(H.murmur3_column(F.col("k"))).collect()] == [0xBA6BD213 - (1 << 32), 0]
    assert df.select(F.crc32(F.lit(b"123456789"))).first()[0] == 3421780262


def test_bloom():
    assert H.bloom_size(0, 5.0) == H.bloom_size(1, 0.01) == (64, 30)
    assert H.bloom_size(1000)[0] % 64 == 0 and H.bloom_size(1000)[1] == 7
    f = H.BloomFilter(2000, 0.01)
    for i in range(2000):
        f.add(f"inserted_key_{i}")
    assert all(f.might_contain(f"inserted_key_{i}") for i in range(2000))
    assert sum(f.might_contain(f"non_existent_key_{i}") for i in range(4000)) < 100
    g = H.BloomFilter.from_bytes(f.to_bytes())
    assert (g.k, g.bits) == (f.k, f.bits) and (g.words == f.words).all() and not g.might_contain(None)
    with pytest.raises(TypeError):
        f.add(None)


def test_bloom_table_is_the_same_filter(spark):
    keys = [f"item:{i}" for i in range(500)]
    f = H.BloomFilter(1000)
    for k in keys:
        f.add(k)
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string").repartition(3)
    held = H.bloom_table(df, 1000)
    assert {r["word"]: r["bits"] & (2**64 - 1) for r in held.collect()} == {i: int(w) for i, w in enumerate(f.words) if w}
    asked = spark.createDataFrame([(k,) for k in ["item:1", "nothing here", "item:499"]], "key string")
    got = {r["key"]: r["might_contain"] for r in H.bloom_probe(asked, held, 1000).collect()}
    assert got == {k: f.might_contain(k) for k in got}


def test_streaming_ingestion_once(spark, tmp_path):
    source = tmp_path / "in"
    S.records(spark, [S.put_row("a", "1", 10, 1), S.put_row("b", "2", 10, 1)]).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(S.RECORD_SCHEMA).parquet(str(source))
    with Store(spark, str(tmp_path / "db")) as store:
        for n in range(2):
            ingest(store, stream, "feed", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
            if n == 0:
                S.records(spark, [S.put_row("a", "late", 5, 2), S.delete_row("b", 20, 2)]).coalesce(1).write.mode("append").parquet(str(source))
        assert {r["key"]: bytes(r["value"]) for r in store.live().collect()} == {"a": b"1"}  # a late mutation doesn't win
        assert store.append_batch(S.records(spark, [S.put_row("c", "x", 1)]), "feed", 0) is None  # a replayed batch
        assert store.get("c") is None
    for build, mode, name in ((latest_by_key, "update", "latest"), (windowed_counts, "append", "windows")):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert {r["key"]: r["is_live"] for r in spark.table("latest").collect()} == {"a": True, "b": False}


def test_tokens():
    assert cli.tokens("put k 'a b' \"c\"d") == ["put", "k", "a b", "cd"]
    assert cli.tokens('get ""') == ["get"] and cli.tokens("get 'open end") == ["get", "open end"]
    assert cli.tokens(None) == cli.tokens("   ") == []
    assert "abcdefg..." in cli.table(["h"], [["abcdefghijklm"]], 10) and "|   |" in cli.table(["h"], [[None]])


def test_shell(spark, tmp_path):
    out = io.StringIO()
    with Store(spark, str(tmp_path / "db")) as store:
        shell = cli.Shell(store, out)

        def run(line):
            out.seek(0)
            out.truncate()
            assert shell.execute(line)
            return out.getvalue()

        assert "OK" in run("PUT user:1 Alice  Smith")
        assert '"Alice Smith"' in run("get user:1") and "(nil)" in run("get none")
        assert "usage" in run("put x") and "unknown" in run("frob") and "no open" in run("commit")
        run("put user:2 Bob")
        assert "2 rows" in run("scan") and "1 rows" in run("scan user:2 *") and "0 rows" in run("scan * * 0")
        assert "[ERROR]" in run("prefix user: -1") and "2 rows" in run("prefix user:")
        assert "transaction" in run("begin") and "open already" in run("begin")
        run("txn-put user:3 Carol")
        assert "Carol" in run("txn-get user:3") and "(nil)" in run("get user:3")
        run("txn-delete user:1")
        assert "committed" in run("commit") and "2 live" in run("count")
        run("begin")
        assert "rolled back" in run("rollback")
        run("del user:2")
        assert "flushed" in run("flush") and "compacted" in run("compact") and "puts" in run("stats") and "Command" in run("?")
        assert "ops_per_second" in run("benchmark 50 50 3") and "[ERROR]" in run("benchmark 0")
        assert shell.execute("") and not shell.execute("quit")


def test_benchmarks(spark, tmp_path):
    with Store(spark, str(tmp_path / "db")) as store:
        got = cli.benchmark(store, 40, 20, 4)
        assert got["PUT"]["operations"] == 40 and got["GET"]["p50_us"] <= got["GET"]["p99_us"] and store.stats.puts == 40
        assert store.stats.gets == 20 and store.stats.misses == 4
        assert cli.bulk_benchmark(store, 40, 20, 2)["GET"]["batches"] == 2


def test_intermediates_are_cleared(spark, tmp_path):
    from tidemark import shared

    path = f"{shared.shared_dir(spark)}/some"
    spark.range(3).write.option("path", path).saveAsTable("tidemark_some")
    shared.written(path, "tidemark_some")
    assert shared.clear(spark) >= 1 and not spark.catalog.tableExists("tidemark_some") and shared.clear(spark) == 0


def test_murmur_of_many(spark):
    import numpy as np

    keys = ["", "a", "ab", "abc", "abcd", "abcde", "日本", "Hello, world!", "x" * 1000, "test", "0123456789abcdef"]
    data = [k.encode() for k in keys]
    for seed in (0, 1, H.SEED_1):
        got = H.murmur3_array(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), seed)
        assert got.tolist() == [H.murmur3(k, seed) for k in keys]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    got = {r["key"]: r["h"] for r in df.select("key", H.murmur3_column(df["key"]).alias("h")).collect()}
    assert got == {k: H._signed(H.murmur3(k)) for k in keys} | {None: 0}


def test_wide_ids_keep_their_keys(spark, tmp_path):
    from tidemark.sources.derived import events_log

    rows = [(1, 123456789, "click", "{}"), (2, 1234567890, "click", "{}"), (3, 7, "error", "{}")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(str(tmp_path / "events.parquet"))
    assert {r["key"] for r in events_log(spark, str(tmp_path)).collect()} == {"user:123456789", "user:1234567890", "user:00000007"}


def test_feed_of_a_store_that_flushes(spark, tmp_path):
    """Mutations stay in the feed once they are in files, numbered through all segments and restarts, until the log is trimmed."""
    spark.dataSource.register(LogDataSource)
    path, config = str(tmp_path / "db"), Config(memtable_bytes=2000, wal_sync=False, compaction_threshold=1000, keep_log=True)

    def follow(name):
        feed = spark.readStream.format("mutation_log").option("path", f"{path}/wal").load()
        q = feed.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted((r["place"], r["key"]) for r in spark.read.parquet(str(tmp_path / name)).collect())

    want = [(n, f"k{n % 70:03d}") for n in range(150)]
    with Store(spark, path, config) as s:
        for n in range(60):
            s.put(want[n][1], "value")
        s._log.sync()
        assert follow("feed") == want[:60]
        for n in range(60, 120):
            s.put(want[n][1], "value")
        s._log.sync()
        assert s.stats.flushes > 3 and follow("feed") == want[:120]
    with Store(spark, path, config) as s:
        assert s.buffer_stats()["count"] == 0  # kept segments aren't replayed
        for n in range(120, 150):
            s.put(want[n][1], "value")
        s.flush()
        assert follow("feed") == want and follow("again") == want
        assert s.trim_log(100) > 0 and follow("late")[-1] == want[-1] and follow("late")[0][0] <= 100


def test_feed_says_what_is_gone(spark, tmp_path):
    path = str(tmp_path / "db")
    with Store(spark, path, Config(wal_sync=False)) as s:
        s.put("a", "1")
        s._log.sync()
        feed = _Feed({"path": f"{path}/wal"})
        at = feed.latestOffset()
        s.put("b", "2")
        s.flush()  # retires the segment, of which the feed has read a part
        s.put("c", "3")
        s._log.sync()
        with pytest.raises(StorageError):
            feed.partitions(at, feed.latestOffset())
        lax = _Feed({"path": f"{path}/wal", "failOnDataLoss": "false"})
        assert [r[0] for p in lax.partitions(at, lax.latestOffset()) for r in lax.read(p)] == ["c"]


def test_segments_of_one_millisecond_sort_as_they_were_made(spark, tmp_path, monkeypatch):
    from tidemark.plans import store as module

    monkeypatch.setattr(module, "now_ms", lambda: 5)
    s, made = Store(spark, str(tmp_path / "db"), Config(wal_sync=False)), []
    for n in range(12):
        s.put("k", str(n))
        made.append(s._log.path)
        s._set_aside()
    assert made == sorted(made)
    with Store(spark, str(tmp_path / "db")) as t:
        assert t.get_text("k") == "11"
