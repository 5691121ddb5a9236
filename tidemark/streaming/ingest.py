"""Live ingestion and live views on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.schema import PUT
from tidemark.plans.store import Store


def ingest(store: Store, stream: DataFrame, name: str, checkpoint: str, compact: bool = True) -> DataStreamWriter:
    """A writer that commits every micro-batch of mutations as one version of a store.

    The batch's number goes into the manifest with it, so a batch that is replayed after a crash isn't committed twice. Late
    mutations need no watermark: the latest ts_ms wins whenever it arrives, as long as Config.keep_tombstones_ms covers the lateness.
    """

    def commit(rows: DataFrame, batch: int) -> None:
        if store.append_batch(rows, name, batch) is not None and compact:
            store.maybe_compact()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)


def latest_by_key(stream: DataFrame) -> DataFrame:
    """The latest mutation of every key as a streaming aggregate, for update mode: state holds one row a key."""
    top = F.max_by(F.struct("value", "ts_ms", "op"), F.struct("ts_ms", "seq"))
    return stream.groupBy("key").agg(top.alias("r")).select("key", "r.*", (F.col("r.op") == PUT).alias("is_live"))


def windowed_counts(stream: DataFrame, every: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Mutations and deletions by time window, for append mode: windows close once the watermark passes them."""
    timed = stream.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", lateness)
    n = F.count(F.lit(1)).alias("n")
    return timed.groupBy(F.window("at", every)).agg(n, F.sum((F.col("op") != PUT).cast("long")).alias("tombstones"))
