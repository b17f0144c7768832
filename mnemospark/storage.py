"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a temporary folder of our own, if
    all tasks run in this process (on a cluster each executor would write to its own disk)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='mnemospark-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts the
    lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/mnemospark-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    _written.append((spark, folder))
    table = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    table._stored_in = folder
    return table


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    folder = table._stored_in
    _written[:] = [(s, x) for s, x in _written if x != folder]
    delete(table.sparkSession, folder)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete the intermediate tables that this process has written."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None:  # stopped: its folder goes with it
            continue
        delete(spark, path)


atexit.register(release)
