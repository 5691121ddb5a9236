"""Exact top-k inner-product search over norm-sorted vectors.

Candidates are range-partitioned by falling length and packed into blocks; queries are packed into blocks too, and a pair of
blocks is one piece of work. Blocks meet by an equi-join on cells of their lengths: a query block asks for the cells from the
least length that could still matter to it on up, so blocks that can't hold an answer move no vectors. Both are rotated by the right singular vectors of a bounded sample, so that the first HEAD rotated
places hold most of an inner product. Within a piece, candidates go by falling length, and a query drops

* all that follow, once its length times theirs cannot reach its k-th best score so far (Cauchy-Schwarz), and
* each one whose partial sum over the first places, plus the product of both remainders' lengths, cannot reach it.

What is left is scored exactly in 64-bit integers. A first pass over the longest SEED vectors gives every query a score to beat
from the start. Bounds carry a margin for rounding, and equal scores are never dropped, so results don't depend on the blocks.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; a vector meets only vectors
of its own number of components. Components saturate at 64 bits after scaling. Products that could leave 64 bits are summed in
integers without limit and ranked by those (up to 38 digits); the score that is returned saturates at 64 bits. Ties
go to smaller ids; repeated rows are candidates each, but a query meets no row with its own id, and a repeated query is answered
once. Empty tables give empty results; other columns are neither read nor kept.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Vectors of a block, queries of a block, vectors and queries that are scored at once.
BLOCK, QUERIES, STEP, AT_ONCE = 32_768, 4096, 1024, 1024
#: Cells of lengths in each doubling, and parts that the blocks of a cell are dealt to.
CELLS, DEALT = 16, 8
#: Longest vectors of the first pass; rows of the sample that the rotation is fitted on; rotated places of the partial sum.
SEED, SAMPLE, HEAD = 1024, 4096, 16
#: Sums below this can't leave 64 bits; the largest numbers of 64 bits and of a decimal.
SAFE, MOST, DIGITS = 1 << 62, (1 << 63) - 1, 10**38 - 1


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long, or null for a vector that takes no part."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & good, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def rotation(sample: np.ndarray) -> np.ndarray:
    """The right singular vectors of the sample's rows, strongest first."""
    return np.linalg.svd(sample.astype(np.float64), full_matrices=True)[2].T if len(sample) else np.eye(sample.shape[1])


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.float64)
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.rows[q][0], score]), np.concatenate([self.rows[q][1], ids])
        if s.dtype == object:
            first = np.array(sorted(range(len(s)), key=lambda x: (-s[x], i[x]))[: self.k], np.int64)
        else:
            first = np.lexsort((i, -s))[: self.k]
        self.rows[q] = s[first], i[first]
        if len(first) == self.k:
            self.floor[q] = max(self.floor[q], float(s[first[-1]]))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as exact integers: of 64 bits where they can't leave those, else of any size."""
    if float(np.abs(vectors.astype(np.float64)).max(initial=0.0)) * float(np.abs(query.astype(np.float64)).max(initial=0.0)) * len(query) < SAFE:
        return vectors @ query
    return vectors.astype(object) @ query.astype(object)


def search_block(qid: np.ndarray, query: np.ndarray, floor: np.ndarray, vid: np.ndarray, vector: np.ndarray, turn: np.ndarray, k: int) -> Best:
    """Each query's best among the vectors, by falling length with both prunings; floor: scores to reach at least."""
    head = min(HEAD, vector.shape[1])
    order = np.argsort(-np.linalg.norm(vector, axis=1), kind="stable")
    vid, vector = vid[order], vector[order]
    real, ask = vector.astype(np.float64), query.astype(np.float64)
    long, reach = np.linalg.norm(real, axis=1), np.linalg.norm(ask, axis=1)
    turned, asked = real @ turn, ask @ turn
    rest, left = np.linalg.norm(turned[:, head:], axis=1), np.linalg.norm(asked[:, head:], axis=1)
    best = Best(len(qid), k, floor)
    for a in range(0, len(vid), STEP):
        b = min(a + STEP, len(vid))
        slack = 1e-9 * (1 + reach * long[a])
        alive = np.flatnonzero(reach * long[a] + slack >= best.floor)
        if not len(alive):
            break
        bound = asked[alive, :head] @ turned[a:b, :head].T
        bound += left[alive, None] * rest[None, a:b]
        near = bound + slack[alive, None] >= best.floor[alive, None]
        near &= qid[alive, None] != vid[None, a:b]
        for row in np.flatnonzero(near.any(axis=1)):
            q, at = alive[row], a + np.flatnonzero(near[row])
            best.add(q, products(vector[at], query[q]), vid[at])
    return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(vec_id, values array<long>) -> query_id, rank, vec_id, score for the rows that are queries, against all others."""
    rows = vectors.filter("vec_id is not null and values is not null").select("vec_id", "values", F.size("values").alias("dim"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    # blocks of falling length; ids part equal lengths, so that equal vectors spread
    placed = rows.repartitionByRange("dim", F.desc("length"), "vec_id").sortWithinPartitions("dim", F.desc("length"), "vec_id")
    placed = placed.select("*", F.spark_partition_id().alias("part"), F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / BLOCK).cast("int").alias("block"))
    held = materialise(placed, "vectors")

    dims = [r["dim"] for r in held.select("dim").distinct().orderBy("dim").collect()]  # the different lengths of vectors: few
    found = None
    for dim in dims:
        one = held.filter(F.col("dim") == dim)
        sample = one.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("values").toPandas()["values"]
        turn = rotation(np.array(sample.tolist(), np.int64).reshape(-1, dim))
        seed = one.orderBy(F.desc("length"), "vec_id").limit(SEED + 1).select("vec_id", "values").toPandas()
        part = _one_length(one, is_query, k, dim, turn, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return held.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc(F.coalesce("wide", F.col("score").cast("decimal(38,0)"))), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _one_length(held: DataFrame, is_query: Column, k: int, dim: int, turn: np.ndarray, seed: pd.DataFrame) -> DataFrame:
    def matrix(column) -> np.ndarray:
        return np.array([np.asarray(v) for v in column], np.int64).reshape(-1, dim)

    context = held.sparkSession.sparkContext
    shared = context.broadcast((turn, seed["vec_id"].to_numpy(np.int64), matrix(seed["values"])))  # dim ** 2 and SEED rows: a fixed size

    def floors(frames):
        """Every query with the k-th best score that it has among the seed."""
        turn, vid, vector = shared.value
        for frame in frames:
            query = matrix(frame["values"])
            best = search_block(frame["vec_id"].to_numpy(np.int64), query, np.full(len(frame), -np.inf), vid, vector, turn, k)
            yield frame.assign(floor=best.floor)

    def pieces(frame: pd.DataFrame) -> pd.DataFrame:
        turn = shared.value[0]
        ask, have = frame[frame["side"] == 0], frame[frame["side"] == 1]
        vid, vector = have["vec_id"].to_numpy(np.int64), matrix(have["values"])
        out = []
        for a in range(0, len(ask) if len(have) else 0, AT_ONCE):
            some = ask.iloc[a : a + AT_ONCE]
            best = search_block(some["vec_id"].to_numpy(np.int64), matrix(some["values"]), some["floor"].to_numpy(float), vid, vector, turn, k)
            out += [(q, int(i), int(s)) for q, (scores, ids) in zip(some["vec_id"].tolist(), best.rows, strict=True) for s, i in zip(scores, ids, strict=True)]
        made = pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype=object)
        over = made["score"].map(lambda s: Decimal(max(-DIGITS, min(DIGITS, s))) if abs(s) > MOST else None)
        kept = made["score"].map(lambda s: max(-MOST, min(MOST, s)))
        return pd.DataFrame({"query_id": made["query_id"].astype("int64"), "vec_id": made["vec_id"].astype("int64"), "score": kept.astype("int64"), "wide": over.astype(object)})

    queries = held.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("values", "length")).alias("v")).select("vec_id", "v.*")
    asked = materialise(queries.select("vec_id", "values", "length").mapInPandas(floors, "vec_id long, values array<long>, length double, floor double"), "queries")
    n = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    need = asked.groupBy("qblock").agg(F.min(F.col("floor") - 1e-9 * (1 + F.abs("floor"))).alias("least"), F.max("length").alias("reach"))
    blocks = held.groupBy("part", "block").agg(F.max("length").alias("longest")).withColumn("cell", length_cell(F.col("longest")))
    blocks = blocks.withColumn("dealt", F.pmod(F.xxhash64("part", "block"), F.lit(DEALT)).cast("int"))
    edges = blocks.agg(F.min("cell").alias("low"), F.max("cell").alias("high")).first()  # two numbers
    # a query block reaches the cells from the least length whose product with its own longest could suffice
    shortest = F.when((F.col("least") <= 0) | (F.col("reach") <= 0), F.lit(edges["low"])).otherwise(length_cell(F.col("least") / F.col("reach") * (1 - 1e-9)))
    cells = F.filter(F.sequence(F.lit(edges["low"]), F.lit(edges["high"])), lambda c: c >= F.least(shortest, F.lit(edges["high"] + 1)))
    asking = need.select("qblock", "least", "reach", F.explode(cells).alias("cell")).select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("dealt"))
    reached = F.col("longest") * F.col("reach") * (1 + 1e-9) + 1e-9 >= F.col("least")
    pairs = blocks.join(asking.hint("merge"), ["cell", "dealt"]).filter(reached).select("part", "block", "qblock")
    left = asked.join(pairs.hint("merge"), "qblock").select("part", "block", "qblock", F.lit(0).alias("side"), "vec_id", "values", "floor")
    right = held.join(pairs.hint("merge"), ["part", "block"]).select("part", "block", "qblock", F.lit(1).alias("side"), "vec_id", "values", F.lit(0.0).alias("floor"))
    return left.unionByName(right).groupBy("part", "block", "qblock").applyInPandas(pieces, "query_id long, vec_id long, score long, wide decimal(38,0)")


def length_cell(length: Column) -> Column:
    """The cell of a vector's length: CELLS in each doubling, all that are nearly zero in the lowest."""
    return F.floor(F.log2(F.greatest(length, F.lit(1e-6))) * CELLS).cast("int")


def embedding_neighbours(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """Every row whose vec_id is divisible by 100, against all rows with another vec_id."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("values"))
    return top_k(rows, F.col("vec_id") % 100 == 0, k)


#: The same as SQL: every query with every other row.
TOP_K_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
