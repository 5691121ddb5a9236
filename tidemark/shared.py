"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import SparkSession

#: What this process has written between the steps of operators: paths, and tables by name (None for a path alone).
_WRITTEN: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new local folder in local mode (as in tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(path: str, table: str | None = None) -> str:
    """Note an intermediate folder (and its table), so that clear can delete it."""
    _WRITTEN[path] = table
    return path


def clear(spark: SparkSession, keep: Iterable[str] = (), since: Iterable[str] = ()) -> int:
    """Delete the intermediate folders and tables of this process, less those to keep and those that were there before; returns how many.

    Call it once the results are consumed: DataFrames that read from them can't be run any more.
    """
    n, held = 0, {*keep, *since}
    for path, table in [x for x in _WRITTEN.items() if x[0] not in held]:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
        del _WRITTEN[path]
    return n


def paths() -> list[str]:
    """The intermediate folders that are there."""
    return list(_WRITTEN)
