"""Pieces of DuckDB SQL for what it has no function of: CRC-32, 32-bit Murmur3 and Bloom filter places, over lists of bytes."""

from __future__ import annotations

from tidemark.functions.hashing import SEED_1, SEED_2

_M = 4294967295

#: A one-row table with rem, the remainders of all bytes under the checksum's polynomial.
REMAINDERS = """(WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8)
  SELECT list(c ORDER BY i) AS rem FROM bits WHERE k = 8)"""


def bytes_of(text: str, kind: str = "UBIGINT") -> str:
    """The UTF-8 bytes of a text as a list of numbers."""
    return f"[('0x' || h)::{kind} for h in regexp_extract_all(hex(encode({text})), '..')]"


def crc32(text: str) -> str:
    """CRC-32 of a text; REMAINDERS must be at hand."""
    step = "lambda a, c: xor(a >> 8, rem[1 + (xor(a, c) & 255)])"
    return f"xor(list_reduce(list_concat([{_M}::BIGINT], {bytes_of(text, 'BIGINT')}), {step}), {_M})::BIGINT"


def _rotated(x: str, by: int) -> str:
    return f"((({x} << {by}) | ({x} >> {32 - by})) & {_M})"


def _mixed(k: str) -> str:
    first = f"(({k} * 3432918353) & {_M})"
    return f"(({_rotated(first, 15)} * 461845907) & {_M})"


def murmur3(data: str, seed: int) -> str:
    """32-bit Murmur3 (unsigned) of a list of bytes."""
    word = f"({data}[4 * i + 1] + {data}[4 * i + 2] * 256 + {data}[4 * i + 3] * 65536 + {data}[4 * i + 4] * 16777216)"
    words = f"[{_mixed(word)} for i in range(len({data}) // 4)]"
    turned = _rotated("xor(h, k)", 13)
    folded = f"list_reduce(list_concat([{seed}::UBIGINT], {words}), lambda h, k: ({turned} * 5 + 3864292196) & {_M})"
    tail = " + ".join(f"coalesce({data}[len({data}) // 4 * 4 + {j + 1}], 0) * {256**j}" for j in range(3))
    h = f"xor(xor({folded}, {_mixed(f'({tail})')}), len({data})::UBIGINT)"
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        h = f"list_transform([{h}], lambda x: (xor(x, x >> {shift}) * {factor}) & {_M})[1]"
    return f"list_transform([{h}], lambda x: xor(x, x >> 16))[1]"


def signed(x: str) -> str:
    """An unsigned 32-bit number as a signed one."""
    return f"CAST(list_transform([({x})::BIGINT], lambda s: CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END)[1] AS INTEGER)"


def bloom_places(data: str, bits: int, k: int) -> str:
    """The places of a list of bytes in a Bloom filter, as a list of numbers."""
    both = f"({{h}}[1] + i * {{h}}[2]) & {_M}"
    each = f"[abs(CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END) % {bits} for s in [({both.format(h='h')})::BIGINT for i in range({k})]]"
    return f"list_transform([[({murmur3(data, SEED_1)})::BIGINT, ({murmur3(data, SEED_2)})::BIGINT]], lambda h: {each})[1]"
