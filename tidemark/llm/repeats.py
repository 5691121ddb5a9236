"""Removal of repeated byte strings by suffix arrays.

A byte goes if a WINDOW-byte string covers it that starts in more than one place. Places that hold equal strings are brought
together, and suffix arrays then tell exactly which strings are equal:

1. Equal texts become one text with a count.
2. Each window chooses its anchor: of the ANCHOR-byte strings inside it the one with the least hash, the leftmost of equals. Equal
   windows choose equal anchors at the same distance, so windows only need comparing within one anchor hash. Neighbouring windows
   with the same anchor place form one run.
3. Runs meet by anchor hash. Runs whose bytes are all equal repeat as a whole. Where an anchor has several different runs, one of each
   kind goes on; runs that stand alone are done.
4. The bytes of those runs are joined to one text for each few anchors, with a mark in place of each anchor string, and the suffix
   array of that text is built: windows that are neighbours in it and agree on all their symbols are equal.
5. An anchor of more than HOT runs (a passage that very many texts share, with different surroundings) would be one task's work. Its runs'
   windows are dealt by 128 bits of their bytes instead, counted where they are made and again where they meet.

The suffix array is built by grouping (phase 1: suffix groups in descending order; each group's members look up their previous
smaller suffix, and those move to new groups; phase 2: ranks are emitted group by group along the same pointers), in linear time
and without renaming. It works on integer symbols, so a mark is one symbol.

Texts live in a table that is bucketed by their key, so that what is found joins them without moving them again.

Nulls: a null text counts as empty; texts under WINDOW bytes keep every byte. Matches never cross texts but may overlap within one.
Very long texts are handled whole. Repeated rows count as copies of their text. An empty table gives an empty result; other columns
are neither read nor kept by document_repeats, and kept as they are by remove_repeats.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, bucketed, materialise, release, settled, utf8
from tidemark.llm.neardup import mix, powers, prefix_hash

WINDOW, ANCHOR = 200, 72
BLOCK = 1 << 20
#: Bytes that are joined for one suffix array, about; runs of an anchor above which its windows are dealt by their bytes.
JOINED, HOT = 1 << 17, 4096


def suffix_array(symbols: list[int]) -> list[int]:
    """Start places of the suffixes in ascending order. The symbols are positive; an end smaller than all is understood."""
    text = [*symbols, 0]
    n = len(text)
    kinds = {c: k for k, c in enumerate(sorted(set(text)))}
    group = [kinds[c] for c in text]  # first groups: by first symbol
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    size = list(map(len, members))  # members that haven't moved on
    above, below = [*range(1, len(members)), -1], [*range(-1, len(members) - 1)]
    at = len(members) - 1
    free = list(range(n + 1))  # free[i + 1] leads to the nearest place up to i whose group isn't handled yet; 0 stands for none
    smaller = [-1] * n
    final: list[list[int]] = []

    def rise(some: list[int], old: int) -> None:
        """Members of a group move to a new one right above it; if they are all that it has left, they are above it already."""
        if len(some) == size[old]:
            return
        size[old] -= len(some)
        new, up = len(members), above[old]
        members.append(some)
        size.append(len(some))
        above[old] = new
        above.append(up)
        below.append(old)
        if up >= 0:
            below[up] = new
        for p in some:
            group[p] = new

    while at != -1:
        own = members[at]
        if len(own) != size[at]:
            own = [i for i in own if group[i] == at]
        for i in own:
            free[i + 1] = i
        hits: dict[int, int] = {}
        for i in own:
            x = i
            while free[x] != x:
                free[x] = free[free[x]]
                x = free[x]
            if x:
                smaller[i] = x - 1
                hits[x - 1] = hits.get(x - 1, 0) + 1
        if len(hits) == 1:
            p = next(iter(hits))
            rise([p], group[p])
        elif hits:
            # pointed-at suffixes rise right above their group, those with more pointers higher
            parts: dict[tuple[int, int], list[int]] = {}
            for p, c in hits.items():
                parts.setdefault((c, group[p]), []).append(p)
            for (_, old), some in sorted(parts.items(), key=lambda x: -x[0][0]):
                rise(some, old)
        if own:
            final.append(own)
        at = below[at]
    start, upto = {}, 0
    for own in reversed(final):
        start[group[own[0]]] = upto
        upto += len(own)
    out = [-1] * n
    out[0] = n - 1
    placed = [False] * n
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = True
            j = smaller[j]
    return out[1:]


def anchored_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first window, number of windows, distance to the anchor, hash of the anchor and of the run."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(buf) - WINDOW + 1
    sizes = np.diff(offsets)
    if n <= 0 or not (sizes >= WINDOW).any():
        return none
    with np.errstate(over="ignore"):
        p = prefix_hash(buf)
        back = powers(max(1 << 16, 1 << len(buf).bit_length()))[1]
        h = mix((p[ANCHOR:] - p[:-ANCHOR]) * back[: len(buf) - ANCHOR + 1])
        # least hash, then leftmost: the place stands in the low 31 bits
        low = np.uint64((1 << 31) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        wide, span = WINDOW - ANCHOR + 1, 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        anchor = (least & low).astype(np.int64)  # of the window at each place
        windows = np.maximum(sizes - WINDOW + 1, 0)
        row = np.repeat(np.arange(len(sizes)), windows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[:-1][row]
        anchor = anchor[place]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
        count = np.diff(np.append(new, len(row)))
        first, own = place[new], anchor[new]
        content = mix((p[first + count - 1 + WINDOW] - p[first]) * back[first] + (count << 9 | (own - first)).astype(np.uint64))
        return row[new], first - offsets[:-1][row[new]], count, own - first, h[own], content


def repeated_windows(bits: list[bytes], count: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, window in the run) of the windows that equal a window of another of the runs, or another of the same.

    bits: the runs' bytes; a run's anchor string lies distance bytes from its begin.
    """
    kinds: dict[bytes, int] = {}
    text, start = [], np.zeros(len(bits), np.int64)
    at = 0
    for k, (run, d) in enumerate(zip(bits, distance.tolist(), strict=True)):
        mark = kinds.setdefault(run[d : d + ANCHOR], 258 + len(kinds))
        whole = np.frombuffer(run, np.uint8).astype(np.int32) + 2
        text += [whole[:d], np.array([mark], np.int32), whole[d + ANCHOR :], np.ones(1, np.int32)]  # 1 ends a run
        start[k] = at
        at += len(run) - ANCHOR + 2
    flat = np.concatenate(text)
    first = np.zeros(len(flat), bool)  # where windows start
    run = np.repeat(np.arange(len(bits)), count)
    place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    first[start[run] + place] = True
    order = np.array(suffix_array(flat.tolist()), np.int64)
    order = order[first[order]]
    width = WINDOW - ANCHOR + 1
    same = np.zeros(len(order) - 1, bool)
    held = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(width, np.int32)]), width)
    for a in range(0, len(same), 1 << 14):
        part = order[a : a + (1 << 14) + 1]
        same[a : a + (1 << 14)] = (held[part[1:]] == held[part[:-1]]).all(axis=1)
    hit = np.zeros(len(flat), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    found = np.flatnonzero(hit[start[run] + place])
    return run[found], place[found]


def covered(size: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of size bytes lie in a window; windows are given as runs of start places."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + count - 1 + WINDOW, size), -1)
    return np.cumsum(edge[:-1]) > 0


def text_keys() -> list[Column]:
    return [F.xxhash64(utf8()).alias("k1"), F.xxhash64(F.lit(1), utf8()).alias("k2")]


def stored_texts(docs: DataFrame) -> DataFrame:
    """Different texts with their number of copies, bucketed by key: k1, k2, packed, copies."""

    def pack(batches):
        for batch in batches:
            packed = pa.array([zlib.compress(t, 1) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed], names=["k1", "k2", "packed"])

    rows = bounded(docs).select(*text_keys(), utf8().alias("data")).mapInArrow(pack, "k1 long, k2 long, packed binary")
    texts = rows.groupBy("k1", "k2").agg(F.first("packed").alias("packed"), F.count(F.lit(1)).alias("copies"))
    return bucketed(texts, "texts", "k1", "k2", sort=True)


def _blocks(batch: pa.RecordBatch):
    """Parts of a batch with their unpacked texts and offsets, of BLOCK bytes or one text."""
    a, texts, size = 0, [], 0
    for k, packed in enumerate(batch.column(2)):
        texts.append(zlib.decompress(packed.as_py()))
        size += len(texts[-1])
        if size >= BLOCK or k == len(batch) - 1:
            yield batch.slice(a, len(texts)), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            a, texts, size = k + 1, [], 0


def _runs(batches):
    """(k1, k2, packed) -> the runs of every text; shape packs number of windows and distance to the anchor.

    Of runs that are equal within a block, all are known to repeat. One of them goes on for the block, with their number; it and the
    runs that stand alone are routed by their anchor. The others are routed anywhere, so a passage that is in every text is no hot key.
    """
    for batch in batches:
        for part, buf, at in _blocks(batch):
            row, first, count, distance, anchor, content = anchored_runs(buf, at)
            _, one, kind, many = np.unique(np.stack([anchor, content], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
            copies = many[kind.ravel()] if len(row) else np.zeros(0, np.int64)
            known = np.ones(len(row), bool)
            known[one] = False
            place = first.astype(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            with np.errstate(over="ignore"):
                route = np.where(known, mix(place ^ content), anchor)
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(own),
                    part.column(1).take(own),
                    pa.array(route.view(np.int64)),
                    pa.array(content.view(np.int64)),
                    pa.array(first << 16 | count << 8 | distance),
                    pa.array(np.where(known, 0, copies).astype(np.int64)),
                ],
                names=["k1", "k2", "route", "content", "shape", "copies"],
            )
    release()


def _bits(batches):
    """(k1, k2, packed, wanted [(anchor, shape)]) -> each wanted run with its bytes."""
    names = ["anchor", "shape", "bits", "k1", "k2"]
    for batch in batches:
        held, size = [], 0
        for a, b, packed, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = zlib.decompress(packed)
            for w in wanted:
                first, count = w["shape"] >> 16, w["shape"] >> 8 & 255
                held.append((w["anchor"], w["shape"], text[first : first + count - 1 + WINDOW], a, b))
                size += len(held[-1][2])
                if size > BLOCK:
                    yield _batch(held, names)
                    held, size = [], 0
        yield _batch(held, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary() if n == "bits" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _compare(batches):
    """Runs sorted by anchor -> (k1, k2, first, n): repeated windows."""

    def flush(rows):
        shape = np.array([r[1] for r in rows], np.int64)
        run, window = repeated_windows([r[2] for r in rows], shape >> 8 & 255, shape & 255)
        new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)])) if len(run) else np.zeros(0, np.int64)
        n, own = np.diff(np.append(new, len(run))), run[new]
        keys = [np.array([rows[k][c] for k in own.tolist()], np.int64) for c in (3, 4)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, (shape[own] >> 16) + window[new], n.astype(np.int64))], names=["k1", "k2", "first", "n"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > JOINED and row[0] != held[-1][0]:  # an anchor's runs stay together: HOT of them at most
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield flush(held)
    release()


def _windows(batches):
    """Runs -> (h1, h2, k1, k2, place) of all their windows."""
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            bits = part.column(2).to_pylist()
            if not bits:
                continue
            shape = part.column(1).to_numpy()
            buf = np.frombuffer(b"".join(bits), np.uint8)
            base = np.cumsum([0, *map(len, bits)])[:-1]
            count = shape >> 8 & 255
            run = np.repeat(np.arange(len(bits)), count)
            place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            at = base[run] + place
            with np.errstate(over="ignore"):
                cols = []
                for turned in (buf, buf ^ np.uint8(0xA5)):
                    p = prefix_hash(turned)
                    cols.append(mix((p[at + WINDOW] - p[at]) * powers(max(1 << 16, 1 << len(buf).bit_length()))[1][at]).view(np.int64))
            own = pa.array(run)
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), part.column(3).take(own), part.column(4).take(own), pa.array((shape[run] >> 16) + place)], names=["h1", "h2", "k1", "k2", "place"])


def repeated(texts: DataFrame) -> DataFrame:
    """(k1, k2, first, n): runs of repeated windows in the different texts."""
    runs = texts.select("k1", "k2", "packed").mapInArrow(_runs, "k1 long, k2 long, route long, content long, shape long, copies long")
    known = F.col("copies") == 0  # of a kind whose one stands for it elsewhere
    by, kind = W.partitionBy("route", "known"), W.partitionBy("route", "known", "content")
    met = runs.withColumn("known", known).repartition("route").select(
        "*",
        F.sum("copies").over(kind).alias("same"),
        F.row_number().over(kind.orderBy("k1", "k2", "shape")).alias("nth"),
        (F.min("content").over(by) != F.max("content").over(by)).alias("mixed"),
        (F.count(F.lit(1)).over(by) > HOT).alias("hot"),
    )
    met = materialise(met.filter("known or same > 1 or mixed"), "runs")
    whole = met.filter("known or same > 1").select("k1", "k2", F.shiftright("shape", 16).alias("first"), F.shiftright("shape", 8).bitwiseAND(255).alias("n"))
    # of one text: no more than its length / (WINDOW - ANCHOR)
    wanted = met.filter("not known and mixed and nth = 1").groupBy("hot", "k1", "k2").agg(F.collect_list(F.struct(F.col("route").alias("anchor"), "shape")).alias("wanted"))

    def bits(hot: bool) -> DataFrame:
        some = wanted.filter("hot" if hot else "not hot").drop("hot")
        return texts.join(some, ["k1", "k2"]).select("k1", "k2", "packed", "wanted").mapInArrow(_bits, "anchor long, shape long, bits binary, k1 long, k2 long")

    apart = bits(False).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "k1 long, k2 long, first long, n long")
    found = whole.unionByName(apart)
    if wanted.filter("hot").isEmpty():
        return found
    # a window that very many runs have is counted where it is made; the join splits what is skewed
    windows = materialise(bits(True).mapInArrow(_windows, "h1 long, h2 long, k1 long, k2 long, place long"), "windows")
    often = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h1", "h2")
    return found.unionByName(windows.join(often.hint("merge"), ["h1", "h2"]).select("k1", "k2", F.col("place").alias("first"), F.lit(1).cast("long").alias("n")))


def _cut(keep_text: bool):
    def run(batches):
        for batch in batches:
            rows, kept = [], []
            for packed, copies, found in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                text = zlib.decompress(packed)
                gone = np.zeros(len(text), bool)
                if copies > 1 and len(text) >= WINDOW:
                    gone[:] = True
                elif found:
                    gone = covered(len(text), np.array([f["first"] for f in found]), np.array([f["n"] for f in found]))
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), int(gone.sum()), spans))
                kept.append((zlib.compress(left, 1) if gone.any() else packed) if keep_text else hashlib.sha256(left).hexdigest().encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array(kept, pa.binary())], names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def cut_texts(docs: DataFrame, keep_text: bool) -> DataFrame:
    """k1, k2, n_bytes, n_removed, n_spans, kept (the remaining bytes, packed, or their SHA-256) of every different text."""
    return settled(lambda: _cut_texts(docs, keep_text), "cut")


def _cut_texts(docs: DataFrame, keep_text: bool) -> DataFrame:
    texts = stored_texts(docs)
    found = repeated(texts).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "n")).alias("found"))  # within one text
    return texts.join(found, ["k1", "k2"], "left").select("k1", "k2", "packed", "copies", "found").mapInArrow(_cut(keep_text), "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary")


def document_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (removed runs), kept_sha256 (of the bytes that remain)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys())
    return rows.join(cut_texts(docs, False), ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text, less those that nothing is left of; characters that lose a byte go whole.

    Texts cross the join once, packed, and only from the side of the different texts.
    """
    schema, at = docs.schema, docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def unpack(batches):
        for batch in batches:
            texts = [zlib.decompress(t).decode("utf-8", "ignore") for t in batch.column(len(schema)).to_pylist()]
            cols = list(batch.columns[: len(schema)])
            cols[at] = pa.array(texts, pa.string())
            if size is not None:
                cols[size] = pa.array(list(map(len, texts))).cast(cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    cut = cut_texts(docs, True).filter("n_removed < n_bytes or n_bytes = 0").select("k1", "k2", "kept")
    slim = docs.select(F.struct(*(F.lit("").alias(c) if c == "text" else F.col(c) for c in docs.columns)).alias("row"), *text_keys())
    kept = slim.join(cut, ["k1", "k2"])
    return kept.select("row.*", F.col("kept").alias("_kept")).mapInArrow(unpack, schema)


#: The same as SQL: all windows by their hashes. Texts are cut into overlapping parts first, since taking a part of a long text is slow.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT id, doc_id, strlen(text) AS n, hex(encode(text)) AS x, sha256(text) AS whole FROM d),
c AS (SELECT id, 1000 * k AS base, substr(x, 2000 * k + 1, 2398) AS y FROM (SELECT id, x, unnest(range(0, (n - 200) // 1000 + 1)) AS k FROM h WHERE n >= 200)),
w AS (SELECT id, base + i AS p, hash(substr(y, 2 * i + 1, 400)) AS m FROM (SELECT id, base, y, unnest(range(0, strlen(y) // 2 - 199)) AS i FROM c)),
r AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT id, p, CASE WHEN p - lag(p) OVER (PARTITION BY id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM w JOIN r USING (m)),
i AS (SELECT id, p, sum(fresh) OVER (PARTITION BY id ORDER BY p) AS span FROM s),
e AS (SELECT id, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY id, span),
g AS (SELECT id, sum(b - a) AS gone, count(*) AS spans FROM e GROUP BY id),
k AS (SELECT id, coalesce(lag(b) OVER (PARTITION BY id ORDER BY a), 0) AS u, a AS v FROM e UNION ALL SELECT id, max(b), any_value(n) FROM e JOIN h USING (id) GROUP BY id),
t AS (SELECT k.id, sha256(unhex(string_agg(substr(x, 2 * u + 1, 2 * (v - u)), '' ORDER BY u))) AS kept FROM k JOIN h USING (id) GROUP BY k.id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, coalesce(kept, whole) AS kept_sha256 FROM h LEFT JOIN g USING (id) LEFT JOIN t USING (id)
"""
