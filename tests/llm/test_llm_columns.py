"""Sharding, mixing, media, ordering and BPE against plain Python."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.llm.conftest import same_rows
from tidemark.llm import bpe, media, mixing, ordering, sharding


def brute_shard(doc_id, shards):
    def unit(s):
        return (int(hashlib.md5(f"{s}:{'' if doc_id is None else f'={doc_id}'}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)

    return min((-math.log(unit(s)) / w, s) for s, w in shards.items())[1]


def test_shards(docs, rows, clashing, no_docs):
    got = sharding.document_shards(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    even = {s: 1.0 for s in range(24)}
    assert all(r["shard"] == brute_shard(r["doc_id"], even) and r["grown_shard"] == brute_shard(r["doc_id"], even | {24: 1.0}) for r in got)
    assert all(r["grown_shard"] in (r["shard"], 24) and r["law"] == "key" for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert same_rows(sharding.document_shards(docs), sharding.document_shards(clashing))
    assert sharding.document_shards(no_docs).count() == 0


def test_weights_move_few_records(spark):
    ids = spark.range(6000).withColumnRenamed("id", "k")
    shards = {0: 1.0, 1: 1.0, 2: 2.0}
    got = Counter(r[0] for r in ids.select(sharding.rendezvous(ids["k"], shards)).collect())
    assert abs(got[2] / 6000 - 0.5) < 0.03 and abs(got[0] / 6000 - 0.25) < 0.03
    for bad in ({}, {0: 0.0}):
        with pytest.raises(ValueError):
            sharding.rendezvous(ids["k"], bad)


def test_many_equal_rows_get_gapless_slots(spark):
    df = spark.range(1).selectExpr("1L as doc_id", "'same' as text", "explode(sequence(1, 10000)) as i").select("doc_id", "text")
    assert sorted(r["slot"] for r in sharding.document_shards(df).collect()) == list(range(10000))


def test_rows_of_one_key_are_numbered_in_many_cells(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "cast(id as string) as text")
    got = sharding.document_shards(df).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(3000))
    order = [r["text_crc32"] for r in sorted(got, key=lambda r: r["slot"])]
    assert order != sorted(order)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full


def test_mix(docs, rows, labels, clashing, no_docs):
    got = mixing.document_mix(docs, labels).collect()
    size = lambda t: len((t or "").encode().split())  # noqa: E731  the same white space
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((r[0], size(r[1]), r[3]) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        epochs = math.floor(r["target"]) // r["source_size"] if r["source_size"] else 0
        assert epochs * r["size"] <= r["taken"] <= min(2, epochs + 1) * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(want[s]) for s in sizes)
    assert len([r for r in got if r["size"] and r["taken"] % r["size"]]) <= len(sizes)  # one cut document a source
    assert same_rows(mixing.document_mix(docs, labels), mixing.document_mix(clashing, labels))
    assert mixing.document_mix(no_docs, labels).count() == 0
    assert mixing.document_mix(no_docs.union(docs.filter("text is null")), labels).filter("taken > 0").count() == 0


def test_mixed_documents_hold_the_words_taken(docs, labels, clashing):
    total = lambda df: sum(len((r["text"] or "").encode().split()) for r in df.collect())
    mixed = mixing.mixed_documents(docs, labels)
    assert mixed.columns == docs.columns
    assert total(mixed) == sum(r["taken"] for r in mixing.document_mix(docs, labels).collect())
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())
    assert total(mixing.mixed_documents(clashing, labels)) == total(mixed)


def test_cells_keep_the_order_and_spread_every_weight(spark):
    from pyspark.sql import functions as F

    for weight in (0.125, 1.0, 2.0):
        rows = spark.range(40000).select(mixing.sampling_key(F.col("id"), F.lit(weight)).alias("v")).select("v", mixing.cell_of(F.col("v")).alias("cell"))
        got = sorted(((r["v"], r["cell"]) for r in rows.collect()), reverse=True)
        assert [c for _, c in got] == sorted(c for _, c in got)
        assert max(Counter(c for _, c in got).values()) < 0.01 * len(got)
    assert spark.range(1).select(mixing.cell_of(F.lit(1.0)).alias("c")).first()["c"] == 0


def test_better_documents_come_first(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "case when id < 2 then 'b' else 'a' end as source", "10L as size", "case when id % 2 = 0 then 4.0d else 0.5d end as weight")
    twice = mixing.mix(rows.filter("source = 'a'").union(spark.range(4000).selectExpr("id + 9000", "'b'", "10L", "1d"))).filter("source = 'b' and taken = 10")
    assert 0 < twice.count() < 4000
    keyed = rows.select("doc_id", mixing.sampling_key(rows["doc_id"], rows["weight"]).alias("v")).orderBy("v", ascending=False).limit(1000)
    assert keyed.filter("doc_id % 2 = 0").count() > 700


def test_telephony_codecs():
    assert len(set(media.A_LAW.tolist())) == 256 and media.MU_LAW[0x7F] == media.MU_LAW[0xFF] == 0
    assert media.A_LAW[0xD5] == 8 and media.A_LAW[0x55] == -8 and media.A_LAW[0xAA] == 32256 and media.MU_LAW[0x00] == -32124 and media.MU_LAW[0x80] == 32124
    codes = bytes(range(256))
    assert media.A_LAW_CODE[media.A_LAW[np.arange(256)].view(np.uint16)].tobytes() == codes
    with pytest.raises(ValueError):
        media.read_wave(b"RIFF")
    with pytest.raises(ValueError):
        media.adpcm_decode(b"ab", 256)
    with pytest.raises(ValueError):
        media.adpcm_decode(b"abcdef", 4)
    assert media.adpcm_decode(b"", 36).tolist() == []


def brute_adpcm(data, block):
    out = []
    for a in range(0, len(data), block):
        b = data[a : a + block]
        level, index = struct.unpack_from("<hB", b)
        index = min(index, 88)
        out.append(level)
        for byte in b[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = int(media._STEP[index])
                move = step >> 3
                for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                    move += part if nibble & bit else 0
                level = max(-32768, min(32767, level - move if nibble & 8 else level + move))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
                out.append(level)
    return out


def test_adpcm_blocks():
    rng = np.random.default_rng(3)
    for n in (36, 360, 36 * 5 + 4, 36 * 5 + 21):
        data = rng.integers(0, 256, n, np.uint8).tobytes()
        assert media.adpcm_decode(data, 36).tolist() == brute_adpcm(data, 36)


def test_decoded_column(spark):
    df = spark.createDataFrame([(1, b"\xd5\x55"), (2, None), (3, b"")], "id int, audio binary")
    got = {r["id"]: media.read_wave(bytes(r["pcm"])) for r in media.decode_column(df, "audio", "alaw").collect()}
    assert got[1][0].tolist() == [8, 0, -8, -8] and got[1][1] == 16000 and got[2][0].tolist() == got[3][0].tolist() == []
    mu = {r["id"]: media.read_wave(bytes(r["pcm"]))[0].tolist() for r in media.decode_column(df, "audio", "mulaw").collect()}
    assert mu[1] == [media.MU_LAW[0xD5], (int(media.MU_LAW[0xD5]) + int(media.MU_LAW[0x55])) >> 1, media.MU_LAW[0x55], media.MU_LAW[0x55]]


def test_a_bad_value_fails_no_other_row(spark):
    whole = bytes(range(36))
    df = spark.createDataFrame([(1, b"ab"), (2, whole)], "id int, audio binary")
    got = {r["id"]: r for r in media.decode_column(df, "audio", "adpcm", 36).collect()}
    assert got[1]["pcm"] is None and "head" in got[1]["pcm_error"]
    assert media.read_wave(bytes(got[2]["pcm"]))[0][0::2].tolist() == brute_adpcm(whole, 36) and got[2]["pcm_error"] is None


def test_wide_form():
    samples = np.arange(-50, 50, dtype=np.int16)
    far = media.wave(samples, 8000, wide=100)
    assert far[:4] == b"RF64" and media.read_wave(far)[0].tolist() == samples.tolist() and media.read_wave(far)[1] == 8000
    assert media.read_wave(media.wave(samples, 8000))[0].tolist() == samples.tolist()
    with pytest.raises(ValueError):
        media.read_wave(far[:-2])


def brute_a_law(code):
    code ^= 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = mantissa * 16 + 8 if exponent == 0 else (mantissa * 16 + 264) << (exponent - 1)
    return size if code & 0x80 else -size


def brute_mu_law(code):
    code = 255 - code
    size = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
    return -size if code & 0x80 else size


def brute_audio(text):
    """All columns of a document, sample by sample."""
    raw = (text or "").encode()
    payload = raw + b"\0" * (max(64, (len(raw) + 63) // 64 * 64) - len(raw))
    mu = zlib.crc32(payload) % 2 == 1
    samples = [brute_mu_law(c) if mu else brute_a_law(c) for c in payload]
    between = [(a + b) // 2 for a, b in zip(samples, samples[1:], strict=False)] + samples[-1:]
    body = struct.pack(f"<{2 * len(samples)}h", *(x for pair in zip(samples, between, strict=True) for x in pair))
    form = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(body)) + body
    crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
    block = brute_adpcm(payload, 64)
    feature = f"codec={'mulaw' if mu else 'alaw'};n={len(samples)};energy={sum(x * x for x in samples)};peak={max(map(abs, samples))};crossings={crossings};adpcm_energy={sum(x * x for x in block)};adpcm_peak={max(map(abs, block))}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature


def test_document_audio(docs, rows, clashing, no_docs, monkeypatch):
    want = Counter((r[0], *brute_audio(r[1])) for r in rows)
    got = media.document_audio(docs).collect()
    assert Counter(map(tuple, got)) == want
    assert {r["feature"].split(";")[0] for r in got} == {"codec=alaw", "codec=mulaw"}
    assert same_rows(media.document_audio(docs), media.document_audio(clashing)) and media.document_audio(no_docs).count() == 0
    kept = media.document_audio(docs, keep_media=True).collect()
    assert all(hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"] and r["media_error"] is None for r in kept)
    monkeypatch.setattr(media, "LARGEST", 1000)
    small = media.document_audio(docs, keep_media=True).collect()
    assert all((r["media"] is None) == (r["media_bytes"] > 1000) == (r["media_error"] is not None) for r in small) and Counter(tuple(r)[:8] for r in small) == want


def test_stored_codes_come_back():
    every = bytes(x for x in range(255))
    for codec in ("alaw", "mulaw"):
        assert media.load(media.store(every, codec), codec)[0] == every
    assert media.codec_of(b"\xff" * 64) == "alaw"


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 65537])
def test_feistel_permutes(n):
    got = ordering.feistel(np.arange(n), n, 5)
    assert sorted(got.tolist()) == list(range(n))
    if n > 16:
        assert got.tolist() != list(range(n)) and got.tolist() != ordering.feistel(np.arange(n), n, 6).tolist()


def brute_feistel(x, n, key):
    """The same permutation, number by number."""
    mask64 = (1 << 64) - 1

    def mix(v):
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & mask64
        v = (v ^ v >> 27) * 0x94D049BB133111EB & mask64
        return v ^ v >> 31

    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    while True:
        left, right = x >> half, x & (1 << half) - 1
        for k in range(1, ordering.ROUNDS + 1):
            left, right = right, left ^ mix(right + mix(k * 0x9E3779B97F4A7C15 + key & mask64) & mask64) & (1 << half) - 1
        x = left << half | right
        if x < n:
            return x


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_order(rows, library):
    """Slot of every sequence by sorting documents on the driver."""
    docs = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        k1, k2 = (signed(xxhash.xxh64(data, seed=seed).intdigest()) for seed in (42, xxhash.xxh64(struct.pack("<i", 1), seed=42).intdigest()))
        h = 42
        for v in (doc_id, k1, k2):
            h = h if v is None else xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
        docs.append((signed(h) % ordering.BUCKETS, doc_id is not None, doc_id or 0, k1, k2, doc_id, [*library.encode(text or "", add_special_tokens=False).ids, 50256]))
    pieces = [(doc_id, k // ordering.LENGTH, tokens[k : k + ordering.LENGTH]) for *_, doc_id, tokens in sorted(docs, key=lambda d: d[:5]) for k in range(0, len(tokens), ordering.LENGTH)]
    out = {}
    for number, (doc_id, seq, part) in enumerate(pieces):
        record = np.array(part + [ordering.PAD] * (ordering.LENGTH - len(part)), "<u2").tobytes()
        out[brute_feistel(number, len(pieces), ordering.KEY)] = (doc_id, seq, len(part), zlib.crc32(record))
    return out


def test_training_order(docs, rows, clashing, no_docs, library):
    want = brute_order(rows, library)
    for stored in (docs, docs.repartition(1), docs.repartition(7), clashing):
        got = ordering.document_order(stored).collect()
        assert sorted(r["slot"] for r in got) == list(range(len(want)))
        # copies of a row are interchangeable, and equal in all that is compared
        assert {r["slot"]: (r["doc_id"], r["seq_no"], r["n_tokens"], r["record_crc32"]) for r in got} == want
        assert all(r["shard"] == r["slot"] // ordering.PER_SHARD and r["byte_offset"] == r["slot"] % ordering.PER_SHARD * ordering.STRIDE for r in got)
    assert ordering.document_order(no_docs).count() == 0


def test_exact_multiple_of_length(spark, library):
    text = " a" * ordering.LENGTH
    assert len(library.encode(text).ids) == ordering.LENGTH
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in ordering.document_order(df).collect()) == [1, ordering.LENGTH]


def test_shards_resume(spark, docs, rows, library, tmp_path):
    path, part = str(tmp_path / "shards"), str(tmp_path / "part")
    ordering.write_shards(docs, path, per_shard=8)
    whole = {r["shard"]: r["sha256"] for r in spark.read.parquet(path).collect()}
    assert sorted(whole) == list(range(len(whole)))
    ordering.write_shards(docs, path, per_shard=8)
    assert spark.read.parquet(path).count() == len(whole)
    spark.read.parquet(path).filter("shard % 3 = 0").write.parquet(part)
    ordering.write_shards(docs.repartition(5), part, per_shard=8)  # taken up from another layout
    assert sorted((r["shard"], r["sha256"]) for r in spark.read.parquet(part).collect()) == sorted(whole.items())
    bits = ordering.held_shards(spark, part)
    left = ordering.training_order(docs, per_shard=8, done=bits)
    assert left.count() == 0
    want = brute_order(rows, library)
    got = ordering.read_slots(spark, part, 5, 9, 8).collect()
    assert {r["slot"]: zlib.crc32(bytes(r["record"])) for r in got} == {s: want[s][3] for s in range(5, 14)}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe(docs, rows, clashing, no_docs, library):
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digest_documents(docs).collect()) == want
    assert same_rows(bpe.digest_documents(docs), bpe.digest_documents(clashing)) and bpe.digest_documents(no_docs).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs.filter("doc_id >= 300")).collect()}
    assert all(ids[r[0]] == library.encode(r[1] or "", add_special_tokens=False).ids for r in rows if (r[0] or 0) >= 300)


@pytest.fixture(scope="module")
def coder():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.Fragmenter(f.read())


def encoded(coder, texts):
    data = [t.encode() for t in texts]
    ids, at = coder.encode_rows(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_cuts_never_change_ids(library, coder):
    import random

    rng = random.Random(5)
    alphabet = ["a", "b", "z", "q", "x", "J", "'", "'s", "'ll", "re", " ", "  ", "\n", "\t", "\r\n", " ", "\u3000", "\xa0", "\x85", "\x1c", "1", "23", ".", "!!", "é", "à", "×", "÷", "ß", "ª", "日", "🙂", "<|endoftext|>", "_", "&"]
    plain = ["a", "the", "ing", "Q", " ", "  ", "\n", "\t", "é", "ß", "1", "23", ".", "!!", ",", "aaaa", "x" * 20, "zq", "=" * 5, "\x0b"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(0, 40))) for _ in range(1500) for some in (alphabet, plain)]
    texts += ["y" * 700, "ab" * 5000, " " * 300, " " * 300 + "x", "\n" * 40 + "x", "the " * 4000, "", "'", "don't", "a'", "é" * 90]
    for text, ids in zip(texts, encoded(coder, texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert bpe.decode_ids(ids, coder) == library.decode(ids, skip_special_tokens=False)


def test_blocks_are_cut_within_long_texts(library, coder, monkeypatch):
    import random

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice(["th", "er", "on", "qu", "é", "日", ","]) for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (0, 700, 1, 3000)]
    monkeypatch.setattr(bpe, "BLOCK", 500)
    monkeypatch.setattr(bpe, "IDS", 300)
    for text, ids in zip(texts, encoded(coder, texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want
        assert coder.digest(np.array(ids, np.int32)) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        bpe.Fragmenter(f.read())
