"""Near-duplicate documents by chosen-path set similarity join.

A document is its set of distinct five-word shingles. Documents with equal sets form one class, and classes go on alone, so
copies cost nothing more. Every class gets COORDINATES minwise tokens (the least hash of its set under as many hash functions); each
tree has OWN of them for itself, so trees are independent.

The join branches classes into trees. At a tree's root each class follows BRANCHES chosen coordinates: all classes with the same
minwise token at a chosen coordinate meet in a node. A node of at most LEAF classes is compared exhaustively on the minwise
tokens; a larger one branches again, along coordinates of its tree that its path's hash chooses. Branching doesn't part classes that
are alike: a large node of which a quarter (ALIKE) agree with its first class as links do is compared exhaustively where it is, and so
is one that is still large after DEPTH levels. Both are dealt out as pairs of blocks, so nothing is capped.

A pair of similarity s survives a level with chance 1 - (1 - s) ** 2, and all levels with chance 1 - q, where q = (1 - s + s q) ** 2:
0.938 for 0.8 and 0.969 for 0.85. TREES independent trees miss it with chance 6e-8 and 9e-10; the cut on minwise tokens (half must
agree, where 0.8 is expected) adds less. Measured: see the tests, which count the pairs that are found.

A node only reports which of its classes hang together. The groups this gives are then confirmed on full shingle sets:
100 * |intersection| >= percent * |union| alone makes a link: 85 percent in the query, 80 in the pipeline. A group's sets meet in
blocks of GROUP, each set in one block. In groups of several blocks, one set of each connected part of a block then meets those of the
other blocks. What is connected by now needs no more comparing: only sets outside a group's largest part meet all others, so
that no link between parts is missed. Components of links are found by alternating large-star and small-star rounds over tables
in the shared folder; once FEW links or fewer are left, the driver ends it.

Words are hashed to 64 bits, and shingles from those, so sets are compared up to 64-bit collisions; texts are looked up by 128 bits.

Nulls: a null text counts as empty; empty sets are linked with nothing. A null id takes part, but names no component unless all
ids of the component are null. Very long texts are handled whole. Repeated rows each give a row, in one component; an empty table
gives an empty result. Other columns are neither read nor kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, byte_view, materialise, release, settled, slices, utf8

WORDS = 5
#: Similarity in percent that links documents: in the query, whose SQL fixes it, and in the pipeline's stage.
PERCENT, STAGE_PERCENT = 85, 80
TREES, OWN, BRANCHES, LEAF, DEPTH = 6, 12, 2, 256, 4
COORDINATES = TREES * OWN
#: Share of a large node's classes that agree with its first one as links do, from which on it isn't branched but compared.
ALIKE = 0.25
#: Minwise tokens of COORDINATES that must agree before full sets are compared; classes of a block of a large node, and of a large group.
AGREE, BLOCK_NODES, GROUP = 36, 2048, 800
#: Links, of two numbers each, whose components the driver finds: so few cost less there than one more exchange.
FEW = 1 << 16
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_ODD = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers by room, kept while a task runs.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse, from 0 to n."""
    if n in _POWERS:
        return _POWERS[n]
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if len(_POWERS) > 4:
        _POWERS.clear()
    _POWERS[n] = out[0], out[1]
    return _POWERS[n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with (P[b] - P[a]) * inverse_power[a] a hash of bytes a .. b - 1, wherever they stand."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_room(len(buf)))[0][: len(buf)], out=out[1:])
    return out


def _room(n: int) -> int:
    return max(1 << 16, 1 << n.bit_length())


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    rows = len(offsets) - 1
    empty = np.zeros(0, np.uint64)
    if not len(buf):
        return [empty] * rows
    buf = _LOWER[buf]
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    last = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    upto = np.searchsorted(first, offsets)
    with np.errstate(over="ignore"):
        p = prefix_hash(buf)
        h = mix((p[last] - p[first]) * powers(_room(len(buf)))[1][first] + (last - first).astype(np.uint64) * np.uint64(_ODD[0]))
        n = len(h) - WORDS + 1
        s = np.zeros(max(n, 0), np.uint64)
        for k in range(WORDS if n > 0 else 0):
            s += h[k : k + n] * np.uint64(_ODD[k])
        s = mix(s)
        out = []
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            if b - a >= WORDS:
                own = np.sort(s[a : b - WORDS + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                out.append(mix((h[a:b] * np.array(_ODD[: b - a], np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(empty)
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of COORDINATES minwise tokens (uint32) of non-empty sets."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), COORDINATES), np.uint32)
    seeds = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(_BASE))
    with np.errstate(over="ignore"):
        for c in range(COORDINATES):
            out[:, c] = np.minimum.reduceat(((flat * (seeds[2 * c] | np.uint64(1)) + seeds[2 * c + 1]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, sig1, sig2 (of the set), sketch (a byte of each minwise token), roots (node keys of the trees, in order)."""
    picks = (np.arange(TREES)[:, None] * OWN + np.arange(BRANCHES)).ravel()  # the first coordinates of each tree

    def run(batches):
        for batch in batches:
            buf, at = byte_view(batch.column(2))
            for a, b in slices(len(batch), at, BLOCK):
                sets = shingle_sets(buf[at[a] : at[b]], at[a : b + 1] - at[a])
                has = np.array([len(s) > 0 for s in sets])
                sigs, tokens = np.zeros((b - a, 2), np.uint64), np.zeros((b - a, COORDINATES), np.uint32)
                if has.any():
                    full = [s for s in sets if len(s)]
                    flat, n = np.concatenate(full), np.array([len(s) for s in full])
                    starts = np.cumsum(n) - n
                    with np.errstate(over="ignore"):
                        sigs[has] = np.stack([np.add.reduceat(mix(flat + np.uint64(k)), starts) for k in _ODD[:2]], 1)
                    tokens[has] = minwise(full)
                with np.errstate(over="ignore"):
                    keys = mix(tokens[:, picks].astype(np.uint64) + (picks.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)).view(np.int64)
                rows = b - a
                roots = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(picks)), pa.array(keys.ravel()))
                small = (tokens & 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(a, rows) for k in (0, 1)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sigs[:, 0].view(np.int64)),
                        pa.array(np.ascontiguousarray(sigs[:, 1]).view(np.int64)),
                        pa.array([r.tobytes() for r in small], pa.binary()),
                        roots,
                    ],
                    names=["doc_id", "text_key", "n", "sig1", "sig2", "sketch", "roots"],
                )
        release()

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), utf8().alias("data"))
    return rows.mapInArrow(run, "doc_id long, text_key binary, n long, sig1 long, sig2 long, sketch binary, roots array<long>")


def text_key() -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(utf8()))


def stars(adjacent: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every row to the least id of its component of a symmetric adjacency matrix; rows on their own have none."""
    n = len(ids)
    label = np.arange(n)
    todo = np.ones(n, bool)
    for k in np.argsort(ids, kind="stable"):
        if not todo[k]:
            continue
        front = np.zeros(n, bool)
        front[k] = True
        seen = front.copy()
        while front.any():
            front = adjacent[front].any(axis=0) & ~seen
            seen |= front
        label[seen] = k
        todo &= ~seen
    far = np.flatnonzero(label != np.arange(n))
    return ids[far], ids[label[far]]


def _groups(batches, key_columns: int):
    """Runs of rows with equal first columns out of sorted batches, as lists of columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(key_columns)]
        change = np.zeros(len(batch), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[-1].as_py() != part.column(k)[0].as_py() for k in range(key_columns)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _link_batches(pairs):
    a, b, size = [], [], 0
    for x, y in pairs:
        a.append(x)
        b.append(y)
        size += len(x)
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b, size = [], [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _compare_nodes(batches):
    """(.., cid, sketch) in runs of nodes -> links of classes whose minwise tokens agree often enough."""

    def each():
        for node in _groups(batches, 3):
            ids = node.column("cid").to_numpy()
            if len(ids) < 2:
                continue
            held = np.frombuffer(b"".join(node.column("sketch").to_pylist()), np.uint8).reshape(len(ids), COORDINATES)
            near = np.zeros((len(ids), len(ids)), bool)
            for k in range(len(ids)):
                near[k] = (held == held[k]).sum(axis=1, dtype=np.uint8) >= AGREE
            yield stars(near, ids)

    yield from _link_batches(each())
    release()


def _branch(batches):
    """Rows of large nodes -> rows of their children, along BRANCHES coordinates of their tree that the node's key chooses.

    A coordinate that is chosen again gives the same child, which is made once.
    """
    for batch in batches:
        if not len(batch):
            continue
        key, tree = batch.column("key").to_numpy().view(np.uint64), batch.column("tree").to_numpy().astype(np.int64)
        held = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(batch), COORDINATES)
        with np.errstate(over="ignore"):
            earlier: list[np.ndarray] = []
            for k in range(BRANCHES):
                chosen = tree * OWN + (mix(key + np.uint64(_ODD[k])) % np.uint64(OWN)).astype(np.int64)
                child = mix(key * np.uint64(_ODD[2]) + chosen.astype(np.uint64) * np.uint64(_ODD[3]) + held[np.arange(len(batch)), chosen].astype(np.uint64) + np.uint64(1))
                new = pa.array(np.all([chosen != c for c in earlier], axis=0) if earlier else np.ones(len(batch), bool))
                earlier.append(chosen)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("tree"), batch.column("cid"), batch.column("sketch")], names=["key", "tree", "cid", "sketch"]).filter(new)


def _agreement(batches):
    """(key, sketch, pivot) -> key, like: how many minwise tokens a class shares with its node's first one."""
    for batch in batches:
        if len(batch):
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), COORDINATES) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((one == other).sum(axis=1).astype(np.int32))], names=["key", "like"])


def block_pairs(rows: DataFrame, key: str, block: int, size: str = "size") -> DataFrame:
    """Rows of a group, dealt to blocks, once for each pair of blocks: columns one and two name the pair within key.

    Groups up to block rows are one pair; larger ones meet block by block, so that any two rows share a pair.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = rows.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64("cid"), F.col("_n")).cast("int"))
    # a pair of equal blocks is covered by that block's other pairs, unless there are none
    other = F.when(F.col("_n") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: x != F.col("_b")))
    each = own.select("*", F.explode(other).alias("_o"))
    return each.select(key, F.least("_b", "_o").alias("one"), F.greatest("_b", "_o").alias("two"), *(c for c in rows.columns if c not in (key, size)))


def tree_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that some node finds alike."""

    def dealt(nodes: DataFrame, block: int) -> DataFrame:
        return block_pairs(nodes.select("key", "cid", "sketch", "size"), "key", block)

    roots = classes.select(F.posexplode("roots").alias("_p", "key"), "cid", "sketch")
    nodes, found = roots.select("key", F.floor(F.col("_p") / BRANCHES).cast("int").alias("tree"), "cid", "sketch"), None
    for depth in range(DEPTH):
        sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        nodes = materialise(nodes.join(sizes, "key"), f"nodes{depth}")
        small = dealt(nodes.filter(F.col("size") <= LEAF), LEAF)
        found = small if found is None else found.unionByName(small)
        large = nodes.filter(F.col("size") > LEAF)
        if large.isEmpty():
            break
        if depth == DEPTH - 1:
            found = found.unionByName(dealt(large, BLOCK_NODES))
            break
        pivots = large.groupBy("key").agg(F.min("sketch").alias("pivot"))
        like = large.join(pivots, "key").select("key", "sketch", "pivot").mapInArrow(_agreement, "key long, like int")
        alike = materialise(like.groupBy("key").agg(F.avg((F.col("like") >= AGREE).cast("int")).alias("share")).filter(F.col("share") >= ALIKE).select("key"), "alike")
        found = found.unionByName(dealt(large.join(alike, "key", "left_semi"), BLOCK_NODES))
        # stored, since the children's sizes and the children themselves are both read: else every row would be made twice
        nodes = materialise(large.join(alike, "key", "left_anti").select("key", "tree", "cid", "sketch").mapInArrow(_branch, "key long, tree int, cid long, sketch binary"), "branched")
    return found.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(_compare_nodes, "a long, b long")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while (label[x] != label[y]).any():
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> node, root: the least node of each component; only linked nodes have rows."""

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    edges, before = materialise(turned(links), "links"), None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now[0] <= FEW:
            held = edges.toArrow()
            node, root = _roots(held.column("a").to_numpy(), held.column("b").to_numpy())
            table = pa.table([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])
            return materialise(edges.sparkSession.createDataFrame(table, "node long, root long").coalesce(1), "roots")
        if now == before:
            break
        before = now
        # large star: all larger neighbours of a node go to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: all smaller neighbours, and the node, go to the least of them; the least itself stands for the node
        down = large.repartition("a").withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = down.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = materialise(turned(small), "links")
    root = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())


def _sets(batches):
    """(grp, size, cid, data) -> (grp, size, cid, hashes)."""
    for batch in batches:
        buf, at = byte_view(batch.column(3))
        for a, b in slices(len(batch), at, BLOCK):
            sets = shingle_sets(buf[at[a] : at[b]], at[a : b + 1] - at[a])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["grp", "size", "cid", "hashes"])


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets satisfy 100 * |intersection| >= percent * |union|."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # what stands in one set only meets nothing
    row, column = row[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    both = np.zeros((m, m), np.float32)
    width = max(1, (2 << 20) // max(m, 1))
    for a in range(0, int(column.max()) + 1 if len(column) else 0, width):
        part = (column >= a) & (column < a + width)
        held = np.zeros((m, width), np.float32)
        held[row[part], column[part] - a] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _confirm(percent: int):
    def run(batches):
        def each():
            for group in _groups(batches, 3):
                ids = group.column("cid").to_numpy()
                if len(ids) > 1:
                    yield stars(similar([np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()], percent), ids)

        yield from _link_batches(each())
        release()

    return run


def confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """(grp, size, cid, hashes) -> links (a, b) on full sets that connect all that links of a group connect."""

    def links(rows: DataFrame) -> DataFrame:
        met = rows.select("grp", "one", "two", "cid", "hashes").repartition("grp", "one", "two").sortWithinPartitions("grp", "one", "two")
        return met.mapInArrow(_confirm(percent), "a long, b long")

    home = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / GROUP)).cast("int")
    found = materialise(links(sets.withColumns({"one": home, "two": home})), "confirmed")
    large = sets.filter(F.col("size") > GROUP)
    if large.isEmpty():
        return found

    def labelled() -> DataFrame:
        label = components(found)
        return materialise(large.join(label, F.col("cid") == F.col("node"), "left").select("grp", "size", "cid", F.coalesce("root", "cid").alias("label")), "labels")

    # a connected part of a block is named by one of its sets, which stands for it
    first = labelled().filter("cid = label").select("grp", "cid")
    few = first.join(first.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "grp")
    some = few.join(sets.select("cid", "hashes"), "cid").select("grp", "size", "cid", "hashes")
    found = found.unionByName(materialise(links(block_pairs(some, "grp", GROUP)), "confirmed"))
    label = labelled()
    parts = label.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    most = parts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("parts"), (F.sum("n") - F.max("n")).alias("others"))
    open_ = materialise(label.join(most.filter("parts > 1"), "grp").select("grp", "size", "cid", "others", (F.col("label") == F.col("most")).alias("inside")), "open")
    if open_.isEmpty():
        return found
    held = open_.join(sets.select("cid", "hashes"), "cid")
    blocks, rest = F.ceil(F.col("size") / GROUP).cast("int"), F.ceil(F.col("others") / GROUP).cast("int")
    # what lies outside the largest part meets that part's blocks, and all else that lies outside
    each = F.sequence(F.lit(0), rest - 1)
    inside = held.filter("inside").select("grp", home.alias("one"), F.explode(each).alias("two"), "cid", "hashes")
    own = F.pmod(F.xxhash64("cid"), rest).cast("int")
    outside = held.filter("not inside").select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("one"), own.alias("two"), "cid", "hashes")
    # and the latter in pairs of blocks, which negative numbers tell from the former
    among = block_pairs(held.filter("not inside").select("grp", F.col("others").alias("size"), "cid", "hashes"), "grp", GROUP).withColumn("one", -1 - F.col("one"))
    return found.unionByName(links(inside.unionByName(outside).unionByName(among)))


def classes_of(rows: DataFrame) -> DataFrame:
    """One row a non-empty shingle set: cid, sig1, sig2, rep (its least doc_id), text_key, sketch, roots."""
    some = rows.filter("n > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key"), F.min("sketch").alias("sketch"), F.min("roots").alias("roots"))
    return materialise(some.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")


def link_components(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, root (names the component; null for empty sets): one row for each document."""
    return settled(lambda: _linked(docs, percent), "components")


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    rows = materialise(sketches(docs), "sketches")
    classes = classes_of(rows)
    near = components(tree_links(classes))
    groups = near.withColumnRenamed("root", "grp")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    need = groups.join(sizes, "grp").join(classes.select(F.col("cid").alias("node"), "text_key"), "node").select("grp", "size", F.col("node").alias("cid"), "text_key")
    texts = docs.select(text_key().alias("text_key"), utf8().alias("data")).join(need.select("text_key").distinct().hint("merge"), "text_key", "left_semi").groupBy("text_key").agg(F.first("data").alias("data"))
    sets = materialise(need.join(texts, "text_key").select("grp", "size", "cid", "data").mapInArrow(_sets, "grp long, size long, cid long, hashes binary"), "sets")
    exact = components(confirmed(sets, percent))
    member = classes.select("cid", "sig1", "sig2", "rep").join(exact, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "root").select("sig1", "sig2", "component_id", "root")
    full = rows.filter("n > 0").join(named, ["sig1", "sig2"]).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "root")
    bare = rows.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return full.unionByName(bare)


def document_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the component's own document)."""
    return link_components(docs, PERCENT).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, and all rows without words: that of the least doc_id (null last), whole."""
    first = link_components(docs, STAGE_PERCENT).filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("m"))
    keep = first.select(F.col("m.doc_id").alias("kept_id"), F.col("m.text_key").alias("kept_key"))
    # a row travels as one struct, so its columns may have any names
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), text_key().alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))
    some = keyed.join(keep, same, "left_semi").dropDuplicates(["own_id", "own_key"])
    bare = keyed.filter(~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return some.unionByName(bare).select("row.*")


#: The same as SQL: all shingles, joined.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
    ELSE [x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] || ' ' || x[i + 3] || ' ' || x[i + 4] for i in range(1, len(x) - 3)] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * c >= 85 * (an + bn - c)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS root FROM s UNION SELECT d.b, r.root FROM r JOIN d ON d.a = r.a),
m AS (SELECT a, min(root) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON a = doc_id
"""
