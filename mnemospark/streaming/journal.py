"""The journal drained as a stream: each file is folded in once, then never again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark.sources.journal import parsed


def drain(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Apply what is queued now and stop; a second call sees only new files."""
    done = parsed(spark.readStream.text(folder)).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()
