"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is u ** (1 / w), with u in (0, 1) from a hash of its id and w its quality weight: the order by falling key
(that is, by rising exponential key -ln(u) / w) is a weighted sample without replacement at every length. A source's budget
takes as many complete epochs as fit, and the rest from the front of that order; the document at the edge is taken in part.

The prefix sums need no sort of a whole source: keys fall into CELLS ranges, the sizes of (source, cell) are summed,
and only within a cell are rows put in order. The ranges are even in the logarithm of the exponential key, where every weight's
keys have the same spread: none holds more than 0.3% of a source in expectation, whatever the weights. So a source with a third of
all rows is spread over many groups.

Only DataFrame expressions. Nulls: a null source is a source of its own, last in order; a null text has size 0; a null id is
an id like any other. Rows equal in id, source, size and weight are counted before the shuffle and expanded after it.
Sources of size 0 and empty tables take nothing. Other columns are neither read nor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Ranges of the sampling key for each source: SCALE a unit of the exponential key's logarithm, which starts at LOWEST.
CELLS, SCALE, LOWEST = 4096, 128, -24
#: Source weights, repeated along the sources in code point order; the share of all sizes that is dealt; most epochs.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Copies of one row that a single array holds when repeated rows are expanded.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """u ** (1 / weight); u from the first 48 bits of an MD5, so that any engine gets the same."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    return F.pow(u, 1.0 / weight)


def cell_of(key: Column) -> Column:
    """The range of a sampling key, rising as the key falls. The density of ln(-ln(u) / w) is 1 / e at most."""
    place = F.floor((F.log(-F.log(key)) - LOWEST) * SCALE)
    return F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(CELLS - 1)), F.lit(0)).cast("int")


def quality_weight(labels: DataFrame) -> DataFrame:
    """doc_id and weight: 2 for good documents, 0.5 for bad ones, a quarter of that for toxic ones (1 where unlabelled)."""
    each = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    weight = F.when(F.col("q") >= 1, 2.0).when(F.col("q") < 1, 0.5).otherwise(1.0) * F.when(F.col("t") >= 1, 0.25).otherwise(1.0)
    return each.select("doc_id", weight.alias("weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """(_s, source, source_size) -> the same with target.

    The dealt total rises as water does: sources fill in proportion to their weights until they reach EPOCHS times their size.
    In the order of cap / weight, all before the first that doesn't fill are full, and the others share the rest.
    """
    n = len(WEIGHTS)
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1  # one row a source
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % n + 1).cast("int"))).withColumn("_cap", F.col("source_size") * EPOCHS)
    up = W.orderBy((F.col("_cap") / F.col("_w")), "_s")
    s = s.withColumns({
        "_left": F.sum("source_size").over(W.partitionBy()) * SHARE - F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_ws": F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing)),
        "_k": F.row_number().over(up),
    })
    first = F.min(F.when(F.col("_left") * F.col("_w") <= F.col("_cap") * F.col("_ws"), F.struct("_k", "_left", "_ws"))).over(W.partitionBy())
    s = s.withColumn("_f", first)
    open_ = F.col("_k") >= F.col("_f._k")
    return s.select("_s", "source", "source_size", F.when(open_, F.col("_f._left") * F.col("_w") / F.col("_f._ws")).otherwise(F.col("_cap").cast("double")).alias("target"))


def mix(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, weight, *more) -> doc_id, size, source_size, target, taken, source, *more: one row for each input row."""
    keyed = rows.select("doc_id", "source", "size", *more, sampling_key(F.col("doc_id"), F.col("weight")).alias("_v"))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null and '' differ
    units = keyed.groupBy("doc_id", "source", "size", *more, "_v").agg(F.count(F.lit(1)).alias("_n"))
    units = materialise(units.withColumns({"_s": name, "_cell": cell_of(F.col("_v")), "_words": F.col("size") * F.col("_n")}), "mix")
    cells = units.groupBy("_s", "_cell").agg(F.sum("_words").alias("_sum"), F.first("source").alias("source"))
    plan = targets(cells.groupBy("_s").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size")))
    plan = plan.withColumn("_budget", F.floor("target")).withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)))
    plan = plan.select("_s", "source_size", "target", "_epochs", (F.col("_budget") - F.col("_epochs") * F.col("source_size")).alias("_rest"))
    down = W.partitionBy("_s").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # CELLS rows a source at most
    starts = cells.select("_s", "_cell", F.coalesce(F.sum("_sum").over(down), F.lit(0)).alias("_start")).join(plan, "_s")
    inner = W.partitionBy("_s", "_cell").orderBy(F.desc("_v"), "doc_id", "size", *more).rowsBetween(W.unboundedPreceding, -1)
    placed = units.withColumn("_before", F.coalesce(F.sum("_words").over(inner), F.lit(0))).join(starts, ["_s", "_cell"])
    first = placed.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK))).alias("_chunk"))
    each = first.select("*", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("_n") - 1, F.col("_chunk") * CHUNK + CHUNK - 1))).alias("_copy"))
    left = F.col("_rest") - F.col("_start") - F.col("_before") - F.col("_copy") * F.col("size")
    taken = F.col("_epochs") * F.col("size") + F.least(F.col("size"), F.greatest(left, F.lit(0)))
    return each.select("doc_id", "size", F.col("source_size").cast("long"), "target", taken.cast("long").alias("taken"), "source", *more)


def _weighted(docs: DataFrame, labels: DataFrame, *more: Column) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), *more)
    return rows.join(quality_weight(labels), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def document_mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(_weighted(docs, labels))


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time cut after the words that are taken then.

    Equal rows are one document that is taken as often as all of them together.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    taken = mix(_weighted(docs, labels, key.alias("key")), ("key",)).groupBy("doc_id", "source", "size", "key").agg(F.sum("taken").alias("taken"))
    taken = taken.filter("taken > 0").toDF("taken_id", "taken_source", "size", "taken_key", "taken")
    # a row travels as one struct, so its columns may have any names
    one = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.col("source").alias("own_source"), key.alias("own_key")).dropDuplicates(["own_id", "own_source", "own_key"])
    same = F.col("own_id").eqNullSafe(F.col("taken_id")) & F.col("own_source").eqNullSafe(F.col("taken_source")) & (F.col("own_key") == F.col("taken_key"))
    each = one.join(taken, same).withColumns({"rest": F.col("taken") % F.col("size"), "full": F.floor(F.col("taken") / F.col("size"))})
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0))))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("copy") > F.col("full"), F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("rest"), F.lit(1)).cast("int")), "")).otherwise(F.col("row.text"))
    out = {"text": text.alias("text"), "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars")}
    return each.select(*(out.get(c, F.col("row")[c].alias(c)) for c in docs.columns))


#: The same as SQL: whole windows in place of cells.
MIX_SQL = r"""
WITH lab AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, min(quality) AS q, max(toxic) AS t FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
r AS (SELECT CAST(d.doc_id AS BIGINT) AS doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce((CASE WHEN q >= 1 THEN 2.0 WHEN q < 1 THEN 0.5 ELSE 1.0 END) * (CASE WHEN t >= 1 THEN 0.25 ELSE 1.0 END), 1.0)::DOUBLE AS w
  FROM documents d LEFT JOIN lab ON lab.doc_id = CAST(d.doc_id AS BIGINT)),
k AS (SELECT *, pow((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE, 1.0::DOUBLE / w) AS v FROM r),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
p AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS sw, 2 * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / sw, coalesce('=' || source, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS lft,
    sum(sw) OVER (ORDER BY cap::DOUBLE / sw, coalesce('=' || source, '') ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS ws,
    row_number() OVER (ORDER BY cap::DOUBLE / sw, coalesce('=' || source, '')) AS rk FROM p),
g AS (SELECT rk AS grk, lft AS glft, ws AS gws FROM f WHERE lft * sw <= cap * ws ORDER BY rk LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN rk >= grk THEN glft * sw / gws ELSE cap::DOUBLE END AS target FROM f, g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
o AS (SELECT k.doc_id, k.size, e.source_size, e.target, k.source, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
    CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.v DESC, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS BIGINT) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(rest - before, 0)) AS BIGINT) AS taken, source FROM o
"""
