"""Changes between two listings of files, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, deleted or modified, by path and mtime_ns; both have a path once."""
    b, a = before.select("path", F.col("mtime_ns").alias("was")), after.select("path", F.col("mtime_ns").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified")
    return b.join(a, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("path", change.alias("change"))


def first_change(changes: DataFrame) -> DataFrame:
    """One row: the first path by kind (modified, added, deleted) and name."""
    order = F.when(F.col("change") == "modified", 0).when(F.col("change") == "added", 1).otherwise(2)
    return changes.orderBy(order, "path").limit(1)


def watch(spark: SparkSession, folder: str, on_change: Callable[[DataFrame, int], None], checkpoint: str, every: str = "3 seconds", glob: str = "*.py"):
    """A streaming query that hands new or rewritten files of ``folder`` to ``on_change``, at most once in ``every``.

    The files' state is the stream's own checkpoint, which survives lost executors.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return rows.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
