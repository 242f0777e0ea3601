"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers; once an application.

    Rows may be whole documents, so Arrow batches of the default 10,000 rows become
    ones of 2,000; any other setting of the session stays.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "2000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    out = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="codeweft-ship-")), "codeweft_lib.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, one machine (a master ``local``) gets a temporary folder; a
    cluster must name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="codeweft-")
        sc.setCheckpointDir(named)
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`settled` wrote for ``tables``, which nothing may read any more."""
    for df in tables:
        if path := df.__dict__.pop("_settled_at", None):
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
