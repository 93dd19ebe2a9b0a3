"""Progress of a running job, and runs that arrive over time.

The reference has no unbounded streams; these two serve its progress counters
and its merge of runs under Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.record import SIZE


def observed(records: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """records that count themselves on the way: records, bytes and partitions are known once an action has run."""
    seen = Observation(name)
    return records.observe(seen, F.count("*").alias("records"), (F.count("*") * SIZE).alias("bytes"), F.approx_count_distinct("pid").alias("partitions")), seen


def stage_progress(spark: SparkSession) -> dict[int, tuple[int, int]]:
    """Finished and all tasks of each stage that runs now."""
    tracker = spark.sparkContext.statusTracker()
    found = {s: tracker.getStageInfo(s) for s in tracker.getActiveStageIds()}
    return {s: (i.numCompletedTasks, i.numTasks) for s, i in found.items() if i}


def sorted_runs(stream: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch of a stream of records (key, value) as a sorted run, run=N, once however often it is tried."""

    def write(batch: DataFrame, n: int) -> None:
        batch.select("key", "value").orderBy("key", "value").write.mode("overwrite").parquet(f"{path}/run={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
