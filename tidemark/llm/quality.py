"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters as they are, of order ORDER, one for each language with trusted text and, where a document needs it, one
for all trusted text together, which serves the other languages. What it counts grows with the trusted text and is nowhere held whole:
the n-grams of each order are dealt to shards by the hash of their context, and a shard's row holds them packed, with their counts.

1. Texts are stored once, in blocks of one language and fold of about BLOCK characters, as a table that is bucketed by block. A block
   is a row, so nothing is shuffled for that, and what is found for a block joins it without moving it again.
2. Labels meet the blocks' ids, and the places of trusted texts the blocks. Each block's n-grams of the highest order are counted,
   and the counts of a shard are joined and summed where the shard is. The n-grams of a shard give the continuation counts of their
   suffixes, which go to the shards of the order below, and so on.
3. Each block asks every shard for its own different n-grams of each order, once for all its documents: the requests are joined with
   the shards, which answer with the discounted share of each n-gram and with what its context leaves to the shorter one.
4. The answers of a block are joined with its texts, and interpolated from the shortest order up, which gives every document's
   perplexity (per character).

No document is scored by a model that has read it: documents are dealt into two folds by id, and the trusted text of one fold makes
the models of the other. So what is trusted has no advantage, and its quantile holds for all documents. A document's perplexity is
held against the QUANTILE of its language's trusted documents, times MARGIN. The quantiles are exact to a thousandth of a
nat: perplexities are counted in bins of that width.

Nulls: a null language goes with the model of all text; a null id is scored but never trusted. Null and empty texts have no
perplexity and are rejected. Labels may repeat: a document is trusted if all its labels are good and none is toxic. Without any
trusted text in the other fold nothing is known, and every document that has text is kept. Repeated rows each give a row; an empty
table gives an empty result; other columns are neither read nor kept by classify and kept as they are by filter_documents. A very
long text is a block of its own, which takes some 40 bytes of memory a character. Within a shard n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, bucketed, materialise, release, settled
from tidemark.llm.neardup import mix

ORDER, FOLDS = 4, 2
#: Shards of each order's n-grams.
SHARDS = {1: 1, 2: 4, 3: 16, 4: 64, 5: 256}
#: The quantile of trusted perplexities that is still good; room above it.
QUANTILE, MARGIN = 0.995, 1.1
#: Characters that a task packs into blocks at once; n-grams that are merged at once; n-grams that could be, up to which they are numbered
#: by a table and not by sorting.
BLOCK, MERGED, DENSE = 8 << 20, 1 << 20, 1 << 24
POOLED = ""
#: Least discount: whatever the counts, something is left for unseen symbols.
LEAST = 0.1
_BIN = 0.001
#: Symbols before and after a text, beyond all characters.
START, END = 0x110000, 0x110001
_STEP = np.uint64(0x9E3779B97F4A7C15)


def trusted_ids(labels: DataFrame) -> DataFrame:
    each = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return each.filter("q >= 1 and t < 1").select("doc_id")


def model_key(lang: str | None, fold: int) -> int:
    """The number of a language's model for the documents of a fold."""
    return int.from_bytes(hashlib.blake2b(f"{fold}{lang or POOLED}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def fold_of() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FOLDS)).cast("int")


def document_key() -> Column:
    """What names a document: rows that are equal in it score alike."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))


# -- n-grams ---------------------------------------------------------------------------------------------------------------


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with ORDER - 1 starts before and an end after it, and where each text's symbols begin (one more)."""
    size = np.array([len(t) for t in texts], np.int64) + ORDER
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]), START, np.uint32)
    own = np.ones(len(out), bool)
    own[at[1:] - 1] = False
    for k in range(ORDER - 1):
        own[at[:-1] + k] = False
    out[own] = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    out[at[1:] - 1] = END
    return out, at


def ranks(symbols: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order from 1 on: the different n-grams, as rows of symbols in order, and which one ends at each place."""
    seen = np.flatnonzero(np.bincount(symbols))
    place = np.zeros(int(seen[-1]) + 1, np.int32)
    place[seen] = np.arange(len(seen), dtype=np.int32)
    code = place[symbols]
    rows, ids = [seen[:, None].astype(np.uint32)], [code]
    for _ in range(ORDER - 1):
        # an n-gram is the one before its last symbol, by number, and that symbol
        key = np.concatenate([ids[-1][:1], ids[-1][:-1]]).astype(np.int64) * len(seen) + code
        size = len(rows[-1]) * len(seen)
        if size <= DENSE:
            has = np.zeros(size, bool)
            has[key] = True
            found = np.flatnonzero(has)
            number = np.zeros(size, np.int32)
            number[found] = np.arange(len(found), dtype=np.int32)
            ids.append(number[key])
        else:
            found, which = np.unique(key, return_inverse=True)
            ids.append(which.astype(np.int32))
        rows.append(np.concatenate([rows[-1][found // len(seen)], seen[found % len(seen)][:, None].astype(np.uint32)], 1))
    return rows, ids


def marks(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of symbols."""
    out = np.full(len(grams), grams.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(grams.shape[1]):
            out = mix(out * _STEP + grams[:, k].astype(np.uint64) + np.uint64(1))
    return out


def shard_of(grams: np.ndarray) -> np.ndarray:
    """The shard of each n-gram: by its context, so that an n-gram and all of its context are together."""
    return (marks(grams[:, :-1]) % np.uint64(SHARDS[grams.shape[1]])).astype(np.int32)


def merge(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, with the sum of their counts, in the order of their hashes."""
    _, one, which = np.unique(marks(grams), return_index=True, return_inverse=True)
    total = np.zeros(len(one), np.int64)
    np.add.at(total, which, counts)
    return grams[one], total


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, column by column, compressed."""
    flat = np.ascontiguousarray(numbers.T).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(np.ascontiguousarray(flat.T).tobytes(), 1)


def unpack(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(columns, -1).T


def by_shard(grams: np.ndarray):
    """(shard, places of its n-grams) for the shards that have any."""
    shard = shard_of(grams)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    yield from ((int(shard[part[0]]), part) for part in np.split(order, cuts[1:])) if len(order) else ()


# -- blocks ----------------------------------------------------------------------------------------------------------------


def stored_blocks(docs: DataFrame) -> DataFrame:
    """All documents as blocks: block, lang, fold, ids, docs (keys), packed (their texts), bucketed by block."""
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["block", "lang", "fold", "ids", "docs", "packed"]

    def run(batches):
        held: dict[tuple, list] = {}
        size = 0

        def made():
            for (lang, fold), rows in held.items():
                texts = [r[2] for r in rows]
                upto = np.array([len(t) for t in texts], "<i8").tobytes()
                row = (uuid.uuid4().int >> 65, lang, fold, [r[0] for r in rows], [r[1] for r in rows], zlib.compress(upto + "".join(texts).encode("utf-8", "replace"), 6))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, lang, text, doc, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((lang, fold), []).append((doc_id, doc, text))
                size += len(text)
                if size >= BLOCK:
                    yield from made()
                    held, size = {}, 0
        yield from made()
        release()

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), document_key().alias("doc"), fold_of().alias("fold"))
    blocks = rows.mapInArrow(run, "block long, lang string, fold int, ids array<long>, docs array<long>, packed binary")
    return bucketed(blocks, "blocks", "block")


def texts_of(packed: bytes, n: int) -> list[str]:
    data = zlib.decompress(packed)
    whole, upto = data[8 * n :].decode(), np.cumsum(np.frombuffer(data, "<i8", n)).tolist()
    return [whole[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]


def trusted_places(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """block, places of its trusted documents."""
    each = blocks.select("block", F.posexplode("ids").alias("place", "doc_id")).filter("doc_id is not null")
    # the same join at every size: labels grow with the documents
    return each.join(trusted.hint("merge"), "doc_id").groupBy("block").agg(F.collect_list("place").alias("places"))  # within one block


# -- model -----------------------------------------------------------------------------------------------------------------

TABLE = "m long, shard int, grams binary, counts binary"
_NAMES = ["m", "shard", "grams", "counts"]
_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.binary())


def packed_rows(m: int, grams: np.ndarray, counts: np.ndarray):
    """Rows of TABLE: n-grams and counts of a model, by shard."""
    rows = []
    for shard, part in by_shard(grams):
        part = part[np.lexsort(grams[part].T[::-1])] if len(part) > 1 else part
        rows.append((m, shard, pack(grams[part]), pack(np.minimum(counts[part], 0xFFFFFFFF)[:, None])))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=_NAMES)


def summed(parts: DataFrame, order: int) -> DataFrame:
    """Rows of TABLE as one row for each model and shard: what different tasks counted meets where the shard is."""

    def run(batches):
        at, grams, counts, size = None, [], [], 0

        def joined():
            nonlocal grams, counts, size
            g, n = merge(np.concatenate(grams), np.concatenate(counts))
            grams, counts, size = [g], [n], 0

        for batch in batches:
            for m, shard, g, n in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if at is not None and at != (m, shard):
                    joined()
                    yield from packed_rows(at[0], grams[0], counts[0])
                    grams, counts = [], []
                at = m, shard
                grams.append(unpack(g, order))
                counts.append(unpack(n, 1)[:, 0].astype(np.int64))
                size += len(counts[-1])
                if size > MERGED:
                    joined()
        if at is not None:
            joined()
            yield from packed_rows(at[0], grams[0], counts[0])
        release()

    return parts.repartition("m", "shard").sortWithinPartitions("m", "shard").mapInArrow(run, TABLE)


def counted(blocks: DataFrame, places: DataFrame, pooled: bool) -> DataFrame:
    """The n-grams of the highest order of all trusted text, as rows of TABLE for every block."""

    def run(batches):
        for batch in batches:
            for lang, fold, ids, packed, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = texts_of(packed, len(ids))
                some = [texts[k] for k in places if texts[k]]
                if not some:
                    continue
                symbols, _ = symbols_of(some)
                rows, ids = ranks(symbols)
                counts = np.bincount(ids[-1][symbols != START], minlength=len(rows[-1]))
                grams, counts = rows[-1][counts > 0], counts[counts > 0]
                del symbols, rows, ids
                for other in range(FOLDS):  # a text makes the models of the other folds
                    for name in {lang or POOLED, POOLED if pooled else lang or POOLED} if other != fold else ():
                        yield from packed_rows(model_key(name, other), grams, counts)
        release()

    return blocks.join(places.hint("merge"), "block").select("lang", "fold", "ids", "packed", "places").mapInArrow(run, TABLE)


def continued(table: DataFrame, order: int) -> DataFrame:
    """Of a table of an order, the suffixes with the number of different symbols before them, as rows of TABLE of the order below."""

    def run(batches):
        for batch in batches:
            for m, _, grams, _ in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                suffix = unpack(grams, order)[:, 1:]
                yield from packed_rows(m, *merge(suffix, np.ones(len(suffix), np.int64)))
        release()

    return table.select("m", "shard", "grams", "counts").mapInArrow(run, TABLE)


def count_tables(blocks: DataFrame, places: DataFrame, pooled: bool) -> dict[int, DataFrame]:
    """TABLE of every order: counts at the highest, continuation counts below."""
    out = {ORDER: materialise(summed(counted(blocks, places, pooled), ORDER), f"grams{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        out[order] = materialise(summed(continued(out[order + 1], order + 1), order), f"grams{order}")
    return out


def discounts(tables: dict[int, DataFrame]) -> DataFrame:
    """m, ord, d1, d2, d3 (the discounts of n-grams that were counted once, twice, more often) and kinds (how many there are)."""

    def run(batches):
        for batch in batches:
            rows = [(m, np.bincount(np.minimum(unpack(n, 1)[:, 0], 5), minlength=6)[1:].tolist()) for m, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[1][k] for r in rows], pa.int64()) for k in range(5))], names=["m", "n1", "n2", "n3", "n4", "n5"])

    parts = None
    for order, table in tables.items():
        part = table.select("m", "counts").mapInArrow(run, "m long, n1 long, n2 long, n3 long, n4 long, n5 long").withColumn("ord", F.lit(order))
        parts = part if parts is None else parts.unionByName(part)
    of = parts.groupBy("m", "ord").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(1, 6)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int):
        raw = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0), F.least(F.greatest(raw, F.lit(LEAST)), F.lit(float(k)))).otherwise(k / 2.0).alias(f"d{k}")

    return of.select("m", "ord", *(discount(k) for k in (1, 2, 3)), sum(F.col(f"n{k}") for k in range(1, 6)).alias("kinds"))


class Shard:
    """One model's n-grams of a shard: each one's discounted share, and what each context leaves."""

    def __init__(self, order: int, grams: np.ndarray, counts: np.ndarray, discount: tuple[float, float, float], kinds: int):
        _, first, context = np.unique(marks(grams[:, :-1]), return_index=True, return_inverse=True)
        d = np.array([0.0, *discount])
        total = np.zeros(len(first))
        np.add.at(total, context, counts.astype(np.float64))
        left = np.zeros(len(first))
        np.add.at(left, context, d[np.minimum(counts, 3)])
        share = np.maximum(counts - d[np.minimum(counts, 3)], 0.0) / total[context]
        left /= total
        if order == 1:  # what is left is shared by all characters that there are, and one that isn't known
            left /= kinds + 1
        self.gram, self.share = self._sorted(marks(grams), share)
        self.context, self.left = self._sorted(marks(grams[first, :-1]), left)

    @staticmethod
    def _sorted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        return key[order], value[order].astype(np.float32)

    @staticmethod
    def _found(key: np.ndarray, value: np.ndarray, asked: np.ndarray, other: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        return np.where(key[at] == asked, value[at], np.float32(other))

    def answer(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each n-gram (0 if unseen), and what its context leaves (1 if unseen)."""
        return self._found(self.gram, self.share, marks(grams), 0.0), self._found(self.context, self.left, marks(grams[:, :-1]), 1.0)


def requests(blocks: DataFrame, known: dict[str, int], pooled: dict[int, int]) -> DataFrame:
    """m, ord, shard, block, grams: the different n-grams of each block, by shard; blocks whose language has no model ask the pooled one."""

    def run(batches):
        for batch in batches:
            for block, lang, fold, ids, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = known.get((lang, fold), pooled.get(fold))
                some = [t for t in texts_of(packed, len(ids)) if t]
                if m is None or not some:
                    continue
                rows = []
                for grams in orders(symbols_of(some)[0])[0]:
                    rows += [(m, grams.shape[1], shard, block, pack(grams[part])) for shard, part in by_shard(grams)]
                cols = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(cols)], names=["m", "ord", "shard", "block", "grams"])
        release()

    return blocks.select("block", "lang", "fold", "ids", "packed").mapInArrow(run, "m long, ord int, shard int, block long, grams binary")


def orders(symbols: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """The different n-grams of all orders from the highest down that end at a symbol, each order's places of suffixes in the next, the
    places in the text where n-grams end, and which one of the highest order each has."""
    ends = np.flatnonzero(symbols != START)
    rows, ids = ranks(symbols)
    out, suffixes, above, which = [], [], None, None
    for k in range(ORDER - 1, -1, -1):
        mine = ids[k][ends]
        one = np.full(len(rows[k]), -1, np.int64)  # a place where each ends
        one[mine] = ends
        used = one >= 0
        number = np.cumsum(used) - 1
        out.append(rows[k][used])
        if above is None:
            which = number[mine]
        else:
            suffixes.append(number[ids[k][above]])
        above = one[used]
    return out, suffixes, ends, which


def answers(asked: DataFrame, tables: dict[int, DataFrame], of: DataFrame) -> DataFrame:
    """block, ord, shard, share, left: the requests joined with the model's shards."""
    model = None
    for order, table in tables.items():
        part = table.withColumn("ord", F.lit(order))
        model = part if model is None else model.unionByName(part)
    # a row a model and shard; a row a model and order
    model = model.join(of.hint("merge"), ["m", "ord"]).select("m", "ord", "shard", F.lit(None).cast("long").alias("block"), "grams", "counts", "d1", "d2", "d3", "kinds")
    empty = {"counts": "binary", "d1": "double", "d2": "double", "d3": "double", "kinds": "long"}
    both = model.unionByName(asked.select("*", *(F.lit(None).cast(t).alias(c) for c, t in empty.items())))

    def run(batches):
        at, shard = None, None
        for batch in batches:
            rows = []
            for m, order, s, block, grams, counts, d1, d2, d3, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None:
                    at, shard = (m, order, s), Shard(order, unpack(grams, order), unpack(counts, 1)[:, 0].astype(np.int64), (d1, d2, d3), kinds)
                    continue
                mine = unpack(grams, order)
                if at == (m, order, s):
                    share, left = shard.answer(mine)
                else:  # the model has no n-gram there
                    share, left = np.zeros(len(mine), np.float32), np.ones(len(mine), np.float32)
                rows.append((block, order, s, pack(share.view("<u4")[:, None]), pack(left.view("<u4")[:, None])))
            cols = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(cols)], names=["block", "ord", "shard", "share", "left"])
        release()

    met = both.repartition("m", "ord", "shard").sortWithinPartitions("m", "ord", "shard", F.asc_nulls_first("block"))
    return met.mapInArrow(run, "block long, ord int, shard int, share binary, left binary")


def bits_of(symbols: np.ndarray, given: dict[tuple[int, int], tuple[bytes, bytes]]) -> np.ndarray:
    """Bits of every place of a block at which a symbol ends, by interpolation over the orders that the answers give; 0 for starts."""
    grams, suffixes, ends, which = orders(symbols)
    below = None
    for k in range(ORDER - 1, -1, -1):
        n = len(grams[k])
        share, left = np.zeros(n, np.float32), np.ones(n, np.float32)
        for shard, part in by_shard(grams[k]):
            a, b = given[ORDER - k, shard]
            share[part], left[part] = unpack(a, 1)[:, 0].view("<f4"), unpack(b, 1)[:, 0].view("<f4")
        below = share.astype(np.float64) + left.astype(np.float64) * (1.0 if below is None else below[suffixes[k]])
    out = np.zeros(len(symbols))
    out[ends] = -np.log2(np.maximum(below, 1e-300))[which]
    return out


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, model, n_symbols, perplexity (per character; null without text or trusted text), doc."""
    blocks = stored_blocks(docs)
    places = materialise(trusted_places(blocks, trusted), "places")
    # a row a language and fold
    made = {(r["lang"], (r["fold"] + k) % FOLDS) for r in blocks.join(places, "block", "left_semi").select("lang", "fold").distinct().collect() for k in range(1, FOLDS)}
    asked = {(r["lang"], r["fold"]) for r in blocks.select("lang", "fold").distinct().collect()}
    known = {(lang, fold): model_key(lang, fold) for lang, fold in made if lang}
    pooled = {fold: model_key(POOLED, fold) for _, fold in made}
    tables = count_tables(blocks, places, any(key not in known for key in asked))
    found = answers(requests(blocks, known, pooled), tables, discounts(tables))
    found = found.groupBy("block").agg(F.collect_list(F.struct("ord", "shard", "share", "left")).alias("given"))  # a block's own answers

    def run(batches):
        for batch in batches:
            for lang, fold, ids, keys, packed, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = texts_of(packed, len(ids))
                score = np.full(len(texts), np.nan)
                some = [k for k, t in enumerate(texts) if t]
                if given and some:
                    symbols, at = symbols_of([texts[k] for k in some])
                    bits = np.add.reduceat(bits_of(symbols, {(g["ord"], g["shard"]): (g["share"], g["left"]) for g in given}), at[:-1])
                    score[some] = np.minimum(bits / (np.diff(at) - ORDER + 1), 1000.0)
                size = pa.array([len(t) for t in texts], pa.int64())
                name = lang if (lang, fold) in known else POOLED
                cols = [pa.array(ids, pa.int64()), pa.array([lang] * len(texts), pa.string()), pa.array([name] * len(texts), pa.string()), size, pa.array(np.exp2(score), mask=np.isnan(score)), pa.array(keys, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "model", "n_symbols", "perplexity", "doc"])
        release()

    rows = blocks.join(found.hint("merge"), "block", "left").select("lang", "fold", "ids", "docs", "packed", "given")
    scored = rows.mapInArrow(run, "doc_id long, lang string, model string, n_symbols long, perplexity double, doc long")
    return scored.withColumn("perplexity", F.round("perplexity", 6))


def limits(scores: DataFrame, trusted: DataFrame) -> DataFrame:
    """model -> threshold: the quantile of trusted perplexities, and over all of them for a null model."""
    own = scores.filter("perplexity is not null").join(trusted, "doc_id", "left_semi").select("model", F.floor(F.log("perplexity") / _BIN).alias("bin")).groupBy("model", "bin").count()
    both = own.unionByName(own.groupBy("bin").agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("model"), "bin", "count"))
    w = W.partitionBy("model")  # a few thousand bins each
    placed = both.select("model", "bin", F.sum("count").over(w.orderBy("bin")).alias("upto"), F.sum("count").over(w).alias("all"))
    found = placed.filter(F.col("upto") >= F.col("all") * QUANTILE).groupBy("model").agg(F.min("bin").alias("bin"))
    return found.select("model", (F.exp((F.col("bin") + 1) * _BIN) * MARGIN).alias("threshold"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept, doc: one row for each document."""
    trusted = materialise(trusted_ids(labels), "trusted")
    scores = settled(lambda: perplexities(docs, trusted), "scores")
    at = materialise(limits(scores, trusted), "limits")
    every = [r["threshold"] for r in at.filter("model is null").collect()]  # one number
    # a row a language
    out = scores.join(at.filter("model is not null").hint("merge"), "model", "left")
    out = out.withColumn("threshold", F.round(F.coalesce("threshold", F.lit(every[0] if every else None).cast("double")), 6))
    kept = (F.col("n_symbols") > 0) & (F.col("perplexity").isNull() | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", kept.alias("kept"), "doc")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept: one row for each document."""
    return judged(docs, labels).drop("doc")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, as they are."""
    kept = judged(docs, labels).filter("kept").select("doc")
    # a row travels as one struct, so its columns may have any names
    keyed_rows = docs.select(F.struct(*docs.columns).alias("row"), document_key().alias("doc"))
    return keyed_rows.join(kept, "doc", "left_semi").select("row.*")
