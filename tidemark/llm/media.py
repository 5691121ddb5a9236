"""Media columns: telephony audio.

G.711 mu-law and A-law are expanded by 256-entry lookup tables, IMA ADPCM blocks are decoded step by step with numpy
across all blocks at once, and samples are resampled and stored as 16-bit PCM in RIFF/WAVE form (RF64 from 4 GiB on).

The documents' payloads are companded samples. One bit of a payload's checksum chooses between A-law, whose 256 levels all
differ, and mu-law, whose two zeros are told apart because UTF-8 never holds one of them (a payload that does goes by A-law). So
the stored PCM gives the payload back exactly. The payload's 64-byte units are also read as ADPCM blocks, and what that sounds
like is part of the feature; ADPCM clips and can't be undone, so it isn't what is stored.

Nulls are empty audio, never null; an empty value gives empty samples, and the stored form is then a header alone. A value that
can't be decoded has a null form and the reason in an error column, and fails no other row. A form of more than LARGEST bytes is
no value that Spark can hold: as a column it is null with the reason, while its digests are made all the same. Equal values give
equal results, ties and repeated rows are rows like others, an empty table gives an empty result, and other columns are neither
read nor kept by document_audio and kept as they are by decode_column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, byte_view, release, slices, utf8

RATE_IN, RATE_OUT = 8000, 16000
UNIT = 64
#: Bytes of text that are decoded at once; most bytes of a form that is kept as a column; from where on a form is RF64.
BLOCK, LARGEST, WIDE = 1 << 20, 1 << 30, (1 << 32) - 64


def _a_law() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _mu_law() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


A_LAW, MU_LAW = _a_law(), _mu_law()
#: A-law has 256 different levels, so its expansion can be undone exactly; mu-law has two zeros.
A_LAW_CODE, MU_LAW_CODE = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
A_LAW_CODE[A_LAW.view(np.uint16)] = np.arange(256, dtype=np.uint8)
#: Of mu-law's two zeros the code 0x7F; 0xFF stands in no UTF-8.
MU_LAW_CODE[MU_LAW.view(np.uint16)[:255]] = np.arange(255, dtype=np.uint8)
CODES = {"alaw": A_LAW_CODE, "mulaw": MU_LAW_CODE}

# Fixed values of IMA ADPCM: the step grows by a tenth from 7, and the index moves by these amounts.
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_STEP = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def adpcm_decode(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM (WAVE layout: a 4-byte head, then two samples a byte, low nibble first) to int16.

    All blocks advance together: the loop runs over the sample positions of one block, not over the samples.
    A last block that is cut short is decoded as far as it goes.
    """
    if block <= 4:
        raise ValueError("a block needs more than its head")
    n = -(-len(data) // block)
    last = len(data) - (n - 1) * block if n else 0
    if n and last < 4:
        raise ValueError("the last block has no head")
    held = np.frombuffer(data.ljust(n * block, b"\0"), np.uint8).reshape(n, block)
    level = np.ascontiguousarray(held[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.clip(held[:, 2].astype(np.int32), 0, 88)
    out = np.empty((n, 1 + 2 * (block - 4)), np.int16)
    out[:, 0] = level
    for k in range(2 * (block - 4)):
        nibble = (held[:, 4 + k // 2] >> (4 * (k % 2))) & 15
        step = _STEP[index]
        move = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
        level = np.clip(np.where(nibble & 8, level - move, level + move), -32768, 32767)
        index = np.clip(index + _INDEX[nibble], 0, 88)
        out[:, 1 + k] = level
    return out.reshape(-1)[: (n - 1) * out.shape[1] + 1 + 2 * (last - 4)] if n else np.zeros(0, np.int16)


def expand(data: bytes, codec: str, block: int = 256) -> np.ndarray:
    """Samples (int16) of 'alaw', 'mulaw' or 'adpcm' bytes."""
    if codec == "adpcm":
        return adpcm_decode(data, block)
    return {"alaw": A_LAW, "mulaw": MU_LAW}[codec][np.frombuffer(data, np.uint8)]


def double_rate(samples: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation: input samples stay as they are at the even places."""
    out = np.empty(2 * len(samples), np.int16)
    out[0::2] = samples
    wide = samples.astype(np.int32)
    if len(samples):
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = samples[-1]
    return out


def wave(samples: np.ndarray, rate: int, wide: int = WIDE) -> bytes:
    """Mono 16-bit PCM as a WAVE form; of wide bytes or more as RF64, whose sizes have 64 bits."""
    body = samples.astype("<i2").tobytes()
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16)
    if len(body) < wide:
        return struct.pack("<4sI4s", b"RIFF", 36 + len(body), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(body)) + body
    far = struct.pack("<4sIQQQI", b"ds64", 28, 72 + len(body), len(body), len(samples), 0)
    return struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + far + fmt + struct.pack("<4sI", b"data", 0xFFFFFFFF) + body


def read_wave(data: bytes) -> tuple[np.ndarray, int]:
    if len(data) < 44 or data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE form")
    at, size, rate = 12, None, 0
    while at + 8 <= len(data):
        tag, n = struct.unpack_from("<4sI", data, at)
        if tag == b"ds64" and n >= 28 and at + 36 <= len(data):
            size = struct.unpack_from("<Q", data, at + 16)[0]
        elif tag == b"fmt " and n >= 16 and at + 24 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 16):
                raise ValueError("not mono 16-bit PCM")
        elif tag == b"data":
            n = size if n == 0xFFFFFFFF and size is not None else n
            if not rate or len(data) < at + 8 + n:
                raise ValueError("not a whole WAVE form")
            return np.frombuffer(data, "<i2", n // 2, at + 8), rate
        at += 8 + n + (n & 1)
    raise ValueError("no samples in the form")


def decode_column(df: DataFrame, column: str, codec: str, block: int = 256, out: str = "pcm") -> DataFrame:
    """df plus a binary column with every value expanded, resampled to 16 kHz and stored as PCM, and out_error where that failed."""
    schema = df.withColumn(out, F.lit(b"")).withColumn(f"{out}_error", F.lit("")).schema
    for name in (out, f"{out}_error"):
        schema[name].nullable = True
    where = df.columns.index(column)

    def one(value: bytes) -> tuple[bytes | None, str | None]:
        try:
            made = wave(double_rate(expand(value, codec, block)), RATE_OUT)
            return (made, None) if len(made) <= LARGEST else (None, "the form is too large for a column")
        except ValueError as e:
            return None, str(e)

    def run(batches):
        for batch in batches:
            made = [one(v or b"") for v in batch.column(where).to_pylist()]
            cols = [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    return bounded(df).mapInArrow(run, schema)


def features(samples: np.ndarray) -> str:
    """Integer features of 16-bit samples: count, energy sum, peak, zero crossings."""
    wide = samples.astype(np.int64)
    signs = samples < 0
    return f"n={len(wide)};energy={int((wide * wide).sum())};peak={int(np.abs(wide).max(initial=0))};crossings={int((signs[1:] != signs[:-1]).sum())}"


def padded(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of UNIT."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def codec_of(payload: bytes) -> str:
    return "mulaw" if zlib.crc32(payload) & 1 and b"\xff" not in payload else "alaw"


def store(payload: bytes, codec: str) -> bytes:
    """A payload of 8-bit samples as 16 kHz PCM."""
    return wave(double_rate(expand(payload, codec)), RATE_OUT)


def load(form: bytes, codec: str) -> tuple[bytes, np.ndarray]:
    """The payload that a stored form gives back, and its 8 kHz samples: those at the even places."""
    samples = np.ascontiguousarray(read_wave(form)[0][0::2])
    return CODES[codec][samples.view(np.uint16)].tobytes(), samples


def adpcm_features(payloads: list[bytes]) -> list[str]:
    """Energy and peak of every payload's units as ADPCM blocks; the blocks of all payloads advance together."""
    n = np.array([len(p) // UNIT for p in payloads])
    wide = adpcm_decode(b"".join(payloads), UNIT).reshape(int(n.sum()), -1).astype(np.int64)
    starts = np.cumsum(n) - n
    energy, peak = np.add.reduceat((wide * wide).sum(axis=1), starts), np.maximum.reduceat(np.abs(wide).max(axis=1), starts)
    return [f"adpcm_energy={e};adpcm_peak={p}" for e, p in zip(energy.tolist(), peak.tolist(), strict=True)]


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def document_audio(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Every text's bytes, padded to a positive multiple of 64, as telephony stored in 16 kHz PCM, and what is read back.

    doc_id, n_bytes, the payload's digests, the stored form's, feature; with keep_media also the form itself (media) and why it is
    null (media_error).
    """

    def rows_of(raws: list[bytes]):
        payloads = list(map(padded, raws))
        for raw, payload, more in zip(raws, payloads, adpcm_features(payloads), strict=True):
            codec = codec_of(payload)
            form = store(payload, codec)
            back, samples = load(form, codec)
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), f"codec={codec};{features(samples)};{more}")
            yield (*row, form if len(form) <= LARGEST else None, None if len(form) <= LARGEST else "the form is too large for a column") if keep_media else row

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary(), pa.string()] if keep_media else [])]
    schema = DIGESTS + (", media binary, media_error string" if keep_media else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            buf, at = byte_view(batch.column(1))
            for a, b in slices(len(batch), at, BLOCK):
                rows = list(rows_of([buf[at[k] : at[k + 1]].tobytes() for k in range(a, b)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=names)
        release()

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data")).mapInArrow(run, schema)
