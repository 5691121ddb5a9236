"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token is a certain cut: no merge can cross it. A text is cut at such pairs
wherever the cut also leaves the pre-tokeniser's work as it is, the fragments are encoded on their own, and the ids are
joined. Two kinds of place qualify:

* between a character that isn't white space and ASCII white space: the pre-tokeniser always splits there, and nothing to
  the left of the place looks past it;
* between two ASCII letters: both sides lie in one run of letters, which the pre-tokeniser takes as it is, whole or halved.

A fragment of plain characters (PLAIN_BYTES) is split as the pre-tokeniser does by comparing neighbouring characters' kinds, and all
different pieces of a block are merged together in numpy: each round, every piece merges its pair of least rank at all its places.
A fragment that holds anything else, and a piece of more than LONGEST bytes, goes to the tokenizers library as it is. Texts are taken
in blocks of about BLOCK bytes, cut at certain boundaries, so memory is bounded by a block and a row's ids.

Only byte-level BPE vocabularies without a normaliser are taken; others raise ValueError.

Null texts count as empty. An empty text has no ids. A very long text without any cut is one fragment. Repeated rows are
encoded each; an empty table gives an empty result, and other columns are neither read nor kept.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, byte_view, release, slices, utf8

#: Longest piece that is merged here, in bytes; bytes of text that are taken at once; ids whose decimals are made at once.
LONGEST, BLOCK, IDS = 64, 1 << 20, 1 << 20
#: No merge; slots of the table of merges (a power of two), and the odd number that spreads pairs over them.
NEVER, SLOTS, SPREAD = np.int32(2**31 - 1), 1 << 19, np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(2**64 - 1)
#: The lowest 0 to 8 bytes of a number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Kinds of bytes as the pre-tokeniser tells them apart: white space, letters, digits, signs.
SPACE, LETTER, DIGIT, SIGN = 0, 1, 2, 3


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each byte, and whether it is plain: ASCII but for control characters, apostrophes (contractions) and <, >, | (special
    tokens), and the two bytes of U+00C0 to U+00FF, which are letters but for two signs that Fragmenter.kinds looks for."""
    byte = np.arange(256)
    kind = np.full(256, SIGN, np.uint8)
    kind[np.isin(byte, [9, 10, 11, 12, 13, 32])] = SPACE
    kind[((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128)] = LETTER
    kind[(byte >= 48) & (byte <= 57)] = DIGIT
    kind[(byte >= 0x80) & (byte < 0xC0) | (byte == 0xC3)] = LETTER
    plain = (byte >= 32) & (byte < 127) | (byte >= 9) & (byte <= 13) | (byte >= 0x80) & (byte < 0xC0) | (byte == 0xC3)
    plain[[ord(c) for c in "'<>|"]] = False
    return kind, plain


KIND, PLAIN_BYTES = _kinds()


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the runs that start at starts and have counts places each."""
    upto = np.cumsum(counts)
    return np.repeat(starts - (upto - counts), counts) + np.arange(int(upto[-1]) if len(upto) else 0)


class Fragmenter:
    """Cuts UTF-8 bytes at certain boundaries, and encodes and decodes with a vocabulary file."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(model)
        usual, bpe = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = spec.get("normalizer") or usual.get("type") != "ByteLevel" or usual.get("add_prefix_space") or not usual.get("use_regex", True)
        if odd or bpe.get("type", "BPE") != "BPE" or bpe.get("dropout") or bpe.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.coder = Tokenizer.from_str(model)
        self.coder.no_truncation()
        self.coder.no_padding()
        of = byte_of_char()
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        words = {i: bytes(of[c] for c in t) for t, i in bpe["vocab"].items() if i not in added} | added
        self.word = [words.get(i, b"") for i in range(max(words) + 1)]
        inside = np.zeros(65536, bool)
        for w in words.values():
            held = np.frombuffer(w, np.uint8).astype(np.int32)
            inside[held[:-1] << 8 | held[1:]] = True
        byte = np.arange(256)
        space, letter = KIND == SPACE, (KIND == LETTER) & (byte < 128)
        left, right = np.arange(65536) >> 8, np.arange(65536) & 255
        kind = (~space[left] & space[right]) | (letter[left] & letter[right])
        kind &= ~((left >= 28) & (left <= 31))  # also white space to some pre-tokenisers
        self.cut = kind & ~inside
        self._tables(bpe, of)

    def _tables(self, bpe: dict, of: dict[str, int]) -> None:
        """Ids of the bytes, the merges as an open-addressed table, and the ids' bytes and decimals as arrays."""
        ids = bpe["vocab"]
        self.byte_id = np.zeros(256, np.int32)
        for c, b in of.items():
            self.byte_id[b] = ids[c]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in bpe["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.uint64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        key = left << np.uint64(32) | right
        self.keys, self.ranks, self.made = np.full(SLOTS, EMPTY), np.full(SLOTS, NEVER, np.int32), made
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):  # of those that want a free slot the first gets it, the others look further
            free = np.flatnonzero(self.keys[at[todo]] == EMPTY)
            first = free[np.unique(at[todo[free]], return_index=True)[1]]
            self.keys[at[todo[first]]], self.ranks[at[todo[first]]] = key[todo[first]], todo[first]
            todo = np.delete(todo, first)
            at[todo] = (at[todo] + 1) % SLOTS
        byte = self.byte_id.astype(np.uint64)
        self.byte_rank = self.rank((byte[:, None] << np.uint64(32) | byte[None, :]).ravel())
        self.size = np.array([len(w) for w in self.word], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(self.word), np.uint8)
        text = [f"{i}," for i in range(len(self.word))]
        self.width = np.array([len(t) for t in text], np.int64)
        self.decimal = np.frombuffer("".join(t.ljust(8) for t in text).encode(), np.uint8).reshape(-1, 8)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key * SPREAD >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def rank(self, key: np.ndarray) -> np.ndarray:
        """Ranks of pairs (left id << 32 | right id), NEVER where they don't merge."""
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NEVER)
        far = np.flatnonzero((found != key) & (found != EMPTY))
        while len(far):
            at[far] = (at[far] + 1) % SLOTS
            found = self.keys[at[far]]
            hit = found == key[far]
            out[far[hit]] = self.ranks[at[far[hit]]]
            far = far[~hit & (found != EMPTY)]
        return out

    def cuts(self, buf: np.ndarray) -> np.ndarray:
        """Places k where bytes k - 1 and k are certainly apart."""
        if len(buf) < 2:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.cut[buf[:-1].astype(np.int32) << 8 | buf[1:]]) + 1
        wide = buf[at - 1] >= 128  # the left character may be wide white space: look at it whole
        if wide.any():
            last, mid, first = (buf[np.maximum(at - k, 0)].astype(np.int32) for k in (1, 2, 3))
            mark = first << 16 | mid << 8 | last
            blank = np.isin(mark & 0xFFFF, [0xC285, 0xC2A0]) | np.isin(mark, _WIDE_BLANKS)
            at = at[~(wide & blank)]
        return at

    def fragments(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ends of the fragments of all rows."""
        edge = np.zeros(len(buf) + 1, bool)
        edge[self.cuts(buf)] = True
        edge[offsets[1:]] = True
        edge[0] = False
        return np.flatnonzero(edge)

    def pieces(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the pieces of fragments, and whether a piece is plain; other fragments stay whole."""
        starts = np.concatenate([[0], ends[:-1]])
        plain = PLAIN_BYTES[buf]
        tail = buf == 0xC3
        after = np.append(buf[1:], np.uint8(0))
        plain &= ~tail | (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
        plain &= (buf < 0x80) | (buf >= 0xC0) | np.concatenate([[False], tail[:-1]])
        whole = np.logical_and.reduceat(plain, starts)
        kind = KIND[buf]
        first = np.zeros(len(buf) + 1, bool)
        first[starts] = True
        first[-1] = True
        space = kind == SPACE
        before, now, blank = kind[:-1], kind[1:], space[:-1]
        apart = np.where(space[1:], ~blank | ~np.append(space[2:], True) & ~first[2:], np.where(blank, buf[:-1] != 32, before != now))
        first[1:-1] |= apart & np.repeat(whole, ends - starts)[1:]
        out = np.flatnonzero(first)
        return out[1:], np.repeat(whole, ends - starts)[out[:-1]]

    def merged(self, data: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of pieces (numbered in order), merged: the ids of all pieces in order, and how many each has."""
        n, done = int(piece[-1]) + 1 if len(piece) else 0, []
        ids, rank = self.byte_id[data], np.full(len(data), NEVER)
        if len(data):
            rank[:-1] = np.where(piece[1:] == piece[:-1], self.byte_rank[data[:-1].astype(np.int32) << 8 | data[1:]], NEVER)
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            room = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            ended = least == NEVER
            if ended.any():
                out = np.repeat(ended, room)
                done.append((ids[out], piece[out]))
                ids, piece, rank, least, room = ids[~out], piece[~out], rank[~out], least[~ended], room[~ended]
            at = np.flatnonzero(rank == np.repeat(least, room))
            if not len(at):
                break
            if len(at) > 1:  # x x x: of places that overlap every other from the left
                step = np.arange(len(at))
                at = at[(step - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, step, 0))) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, piece, rank = ids[keep], piece[keep], rank[keep]
            # only pairs with what was just made have new ranks
            at -= np.arange(len(at))
            for some in (at[at + 1 < len(ids)], at[at > 0] - 1):
                pair = ids[some].astype(np.uint64) << np.uint64(32) | ids[some + 1].astype(np.uint64)
                rank[some] = np.where(piece[some] == piece[some + 1], self.rank(pair), NEVER)
            rank[-1] = NEVER
        ids, piece = np.concatenate([np.zeros(0, np.int32), *(d[0] for d in done)]), np.concatenate([np.zeros(0, np.int64), *(d[1] for d in done)])
        order = np.argsort(piece, kind="stable")
        return ids[order], np.bincount(piece, minlength=n)

    def encode_block(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's fragments, and the number of ids up to each piece's end, given the fragments' ends."""
        upto, plain = self.pieces(buf, ends)
        starts = np.concatenate([[0], upto[:-1]])
        size = upto - starts
        pool, of, count = [], np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        held = 0

        def give(rows: np.ndarray, which: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal held
            at = held + np.cumsum(counts) - counts
            of[rows], count[rows] = at[which], counts[which]
            pool.append(ids)
            held += len(ids)

        short = np.flatnonzero(plain & (size <= 16))
        if len(short):
            # a piece of 16 bytes or less as two numbers: equal pieces are equal numbers
            near = np.lib.stride_tricks.as_strided(np.concatenate([buf, np.zeros(16, np.uint8)]), (len(buf), 16), (1, 1))
            two = np.ascontiguousarray(near[starts[short]]).view("<u8")
            two[:, 0] &= MASKS[np.minimum(size[short], 8)]
            two[:, 1] &= MASKS[np.maximum(size[short] - 8, 0)]
            with np.errstate(over="ignore"):
                mark = (two[:, 0] ^ two[:, 1] * SPREAD) * SPREAD + size[short].astype(np.uint64)
            order = np.argsort(mark)
            new = np.concatenate([[True], mark[order[1:]] != mark[order[:-1]]])
            one, which = order[new], np.empty(len(order), np.int64)
            which[order] = np.cumsum(new) - 1
            far = np.flatnonzero((two[one[which]] != two).any(axis=1) | (size[short[one[which]]] != size[short]))
            if len(far):  # pieces that only share a mark
                which[far] = len(one) + np.arange(len(far))
                one = np.append(one, far)
            give(short, which, *self._merged_at(buf, starts[short[one]], size[short[one]]))
        long = np.flatnonzero(plain & (size > 16) & (size <= LONGEST))
        rest = np.flatnonzero(~plain | (size > LONGEST))
        for rows, mine in ((long, True), (rest, False)):
            if len(rows):
                kinds: dict[bytes, int] = {}
                which = np.array([kinds.setdefault(buf[a:b].tobytes(), len(kinds)) for a, b in zip(starts[rows].tolist(), upto[rows].tolist(), strict=True)])
                if mine:
                    one = np.unique(which, return_index=True)[1]
                    give(rows, which, *self._merged_at(buf, starts[rows[one]], size[rows[one]]))
                else:
                    found = [e.ids for e in self.coder.encode_batch_fast([k.decode("utf-8", "replace") for k in kinds], add_special_tokens=False)]
                    give(rows, which, np.array([i for f in found for i in f], np.int32), np.array(list(map(len, found)), np.int64))
        ids = np.concatenate(pool)[spread(of, count)] if pool else np.zeros(0, np.int32)
        return ids, np.cumsum(count)[np.searchsorted(upto, ends)]

    def _merged_at(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.merged(buf[spread(starts, size)], np.repeat(np.arange(len(size)), size))

    def encode_rows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's ids start (one more than rows)."""
        ends = self.fragments(buf, offsets)
        out, upto, at, a = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
            ids, n = self.encode_block(buf[at : ends[b - 1]], ends[a:b] - at)
            out.append(ids)
            upto.append(n + upto[-1][-1])
            at, a = int(ends[b - 1]), b
        place = np.concatenate(upto)  # number of ids up to each fragment's end
        return np.concatenate(out), place[np.searchsorted(ends, offsets, "right")]

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids, each with a comma after it."""
        held = self.decimal[ids]
        return held[np.arange(8) < self.width[ids][:, None]].tobytes()

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return self.data[spread(self.start[ids], self.size[ids])].tobytes()

    def digest(self, ids: np.ndarray) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        whole, back = hashlib.sha256(), []
        for a in range(0, len(ids), IDS):
            some = ids[a : a + IDS]
            text = self.decimals(some)
            whole.update(text if a + IDS < len(ids) else text[:-1])
            back.append(self.decoded(some))
        return len(ids), whole.hexdigest(), hashlib.sha256(b"".join(back).decode("utf-8", "replace").encode()).hexdigest()


#: UTF-8 of the three-byte white space characters.
_WIDE_BLANKS = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def held_coder(model: str) -> Fragmenter:
    """The worker's coder for a vocabulary: loaded once."""
    # functions come to a worker by value, so what is to outlive a task can't be a variable of this module
    held = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    name = hashlib.sha256(model.encode()).hexdigest()
    if name not in held:
        held[name] = Fragmenter(model)
    return held[name]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _columns(docs: DataFrame, vocabulary: str | None, work, schema: str) -> DataFrame:
    """Rows' ids through work(fragmenter, ids, where each row's start) -> columns beside doc_id."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: a fixed size

    def run(batches):
        coder = held_coder(model.value)
        for batch in batches:
            buf, at = byte_view(batch.column(1))
            for a, b in slices(len(batch), at, BLOCK):
                cols = work(coder, *coder.encode_rows(buf[at[a] : at[b]], at[a : b + 1] - at[a]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], names=names)
        release()

    names = [x.split()[0] for x in re.split(r",\s*", schema)]
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data")).mapInArrow(run, schema)


def _digests(coder: Fragmenter, ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    rows = [coder.digest(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]


def _ids(coder: Fragmenter, ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))]


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids of every text."""
    return _columns(docs, vocabulary, _ids, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text that the ids decode to."""
    return _columns(docs, vocabulary, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(ids: list[int], coder: Fragmenter) -> str:
    """The text of ids, as the vocabulary's byte-level decoder gives it."""
    return coder.decoded(np.array(ids, np.int64)).decode("utf-8", "replace")
