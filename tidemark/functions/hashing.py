"""32-bit Murmur3 as key-value files use it, Bloom filters over it, and CRC-32."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two seeds of the Bloom filter's double hashing.
SEED_1, SEED_2 = 0x9747B28C, 0x1B873593
_M = 0xFFFFFFFF


def murmur3(data: bytes | str | None, seed: int = 0) -> int:
    """MurmurHash3 x86_32 as an unsigned number; null gives 0. Spark's own hash() differs for lengths that 4 doesn't divide."""
    if data is None:
        return 0
    if isinstance(data, str):
        data = data.encode()
    h, n = seed & _M, len(data)
    body = n & ~3
    for (k,) in struct.iter_unpack("<I", data[:body]):
        k = k * 0xCC9E2D51 & _M
        k = (k << 15 | k >> 17) * 0x1B873593 & _M
        h ^= k
        h = ((h << 13 | h >> 19) & _M) * 5 + 0xE6546B64 & _M
    if n > body:
        k = int.from_bytes(data[body:], "little") * 0xCC9E2D51 & _M
        h ^= (k << 15 | k >> 17) * 0x1B873593 & _M
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & _M
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M
    return h ^ h >> 16


def _signed(x: int) -> int:
    x &= _M
    return x - (1 << 32) if x >> 31 else x


def murmur3_array(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86_32 (uint32) of many byte strings: data and where each begins (one more). All strings advance word by word."""
    n = np.diff(offsets)
    h = np.full(len(n), seed & _M, np.uint32)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)

    def word(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint32)
        for k in range(4):
            out |= np.where(size > k, padded[np.minimum(at + k, len(padded) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
        return out

    order = np.argsort(-(n >> 2), kind="stable")  # longest first, so that those which go on are a front part
    words = (n >> 2)[order]
    for k in range(int(words[0]) if len(words) else 0):
        on = order[: int(np.searchsorted(-words, -k, "left"))]
        h[on] ^= mixed(word(offsets[on] + 4 * k, np.full(len(on), 4)))
        h[on] = (h[on] << np.uint32(13) | h[on] >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= mixed(word(offsets[:-1] + (n & ~3), n & 3))  # nothing if no bytes are left
    h ^= n.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def _bytes_of(values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values' bytes, where each begins (one more), and which are null."""
    held = [b"" if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in values]
    null = np.array([v is None for v in values], bool)
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), null


def murmur3_column(data: Column, seed: int = 0) -> Column:
    """Signed 32-bit Murmur3 of a binary or text column; 0 for null."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        buf, at, null = _bytes_of(values)
        return pd.Series(np.where(null, 0, murmur3_array(buf, at, seed).view(np.int32)).astype(np.int32))

    return run(data)


def crc32(data: bytes, start: int = 0, length: int | None = None) -> int:
    """CRC-32 of bytes or a slice of them, unsigned. On columns: pyspark's crc32."""
    return zlib.crc32(data[start:] if length is None else data[start : start + length])


def bloom_size(n: int, fpp: float = 0.01) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions (1 to 30) of a filter for n keys at a false-positive rate."""
    n = max(n, 1)
    fpp = fpp if 0.0 < fpp < 1.0 else 0.01
    bits = max(64, math.ceil(-n * math.log(fpp) / math.log(2) ** 2))
    bits = -(-bits // 64) * 64
    return bits, max(1, min(30, math.floor(bits / n * math.log(2) + 0.5)))


def bloom_places(key: bytes | str, bits: int, k: int) -> list[int]:
    """The bits of a key: |(h1 + i * h2) % bits| in 32-bit arithmetic that wraps and keeps the dividend's sign."""
    h1, h2 = murmur3(key, SEED_1), murmur3(key, SEED_2)
    return [abs(_signed(h1 + i * h2)) % bits for i in range(k)]


def bloom_matrix(values: pd.Series, bits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """bloom_places of many keys as rows of a matrix, and which keys are null."""
    buf, at, null = _bytes_of(values)
    h1, h2 = (murmur3_array(buf, at, seed) for seed in (SEED_1, SEED_2))
    both = h1[:, None] + np.arange(k, dtype=np.uint32) * h2[:, None]
    return np.abs(both.view(np.int32).astype(np.int64)) % bits, null


class BloomFilter:
    """A Bloom filter on the driver."""

    def __init__(self, expected: int, fpp: float = 0.01):
        self.bits, self.k = bloom_size(expected, fpp)
        self.words = np.zeros(self.bits // 64, np.uint64)

    def add(self, key: bytes | str) -> None:
        if key is None:
            raise TypeError("a key can't be null")
        for b in bloom_places(key, self.bits, self.k):
            self.words[b >> 6] |= np.uint64(1 << (b & 63))

    def might_contain(self, key: bytes | str | None) -> bool:
        return key is not None and all(int(self.words[b >> 6]) >> (b & 63) & 1 for b in bloom_places(key, self.bits, self.k))

    def to_bytes(self) -> bytes:
        """k, bits, number of words (big-endian int32 each), then the words (big-endian)."""
        return struct.pack(">iii", self.k, self.bits, len(self.words)) + self.words.astype(">u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        out = cls.__new__(cls)
        out.k, out.bits, n = struct.unpack_from(">iii", data)
        out.words = np.frombuffer(data, ">u8", n, 12).astype(np.uint64)
        return out


def bloom_table(keys: DataFrame, expected: int, fpp: float = 0.01, key: str = "key") -> DataFrame:
    """word and bits (long) of the non-empty words of a filter over a column of keys: built where the keys are, merged by word."""
    bits, k = bloom_size(expected, fpp)

    def run(frames):
        for frame in frames:
            found, null = bloom_matrix(frame[key], bits, k)
            places = found[~null].ravel()
            words, at = np.unique(places >> 6, return_inverse=True)
            held = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(held, at, np.uint64(1) << (places & 63).astype(np.uint64))
            yield pd.DataFrame({"word": words, "bits": held.view(np.int64)})

    return keys.select(key).mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))


def bloom_probe(keys: DataFrame, table: DataFrame, expected: int, fpp: float = 0.01, key: str = "key") -> DataFrame:
    """keys with might_contain, against a filter table of the same size: a join by word, so the filter may be of any size."""
    bits, k = bloom_size(expected, fpp)

    @F.pandas_udf("array<long>")
    def places(values: pd.Series) -> pd.Series:
        found, null = bloom_matrix(values, bits, k)
        return pd.Series([[] if gone else row for row, gone in zip(found.tolist(), null, strict=True)])

    each = keys.select(key).distinct().withColumn("place", F.explode(places(key))).withColumn("word", F.shiftright("place", 6))
    hit = each.join(table, "word", "left").select(key, (F.expr("shiftrightunsigned(bits, cast(place & 63 as int)) & 1") == 1).alias("set"))
    found = hit.groupBy(key).agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("might_contain"))
    return keys.join(found, key, "left").withColumn("might_contain", F.coalesce("might_contain", F.lit(False)))
