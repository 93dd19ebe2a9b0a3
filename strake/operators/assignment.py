"""Input splitting: whole records of a sequence of files, dealt to workers in contiguous ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.record import SIZE


def record_ranges(files: DataFrame, workers: int) -> DataFrame:
    """worker_index, file_path, start_record, record_count, file_size_bytes of files (path, size_bytes).

    Files count once each and follow one another by path. Worker i gets a run of
    total / N records, one more if i < total % N. The prefix sum is over files,
    not records, so one task suffices for it.
    """
    once = files.groupBy("path").agg(F.max("size_bytes").alias("size_bytes"))
    counted = once.withColumn("n", F.floor(F.col("size_bytes") / SIZE).cast("long")).filter("n > 0")
    upto = F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, 0))
    placed = counted.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n")).withColumn("total", F.sum("n").over(W.partitionBy()))
    base, extra = F.floor(F.col("total") / workers), F.col("total") % workers

    def first(i):
        return i * base + F.least(i, extra)

    def worker(record):
        """Whose a record is, by its place in the whole input."""
        wide = extra * (base + 1)
        return F.when(record < wide, F.floor(record / (base + 1))).otherwise(extra + F.floor((record - wide) / F.greatest(base, F.lit(1)))).cast("long")

    # a file's rows are those of its own workers, so rows are files + workers at most
    each = placed.withColumn("worker_index", F.explode(F.sequence(worker(F.col("lo")), worker(F.col("hi") - 1))))
    i = F.col("worker_index")
    lo, hi = F.greatest("lo", first(i)), F.least("hi", first(i + 1))
    cut = each.withColumn("a", lo.cast("long")).withColumn("b", hi.cast("long")).filter("b > a")
    return cut.select("worker_index", F.col("path").alias("file_path"), (F.col("a") - F.col("lo")).alias("start_record"), (F.col("b") - F.col("a")).alias("record_count"), F.col("size_bytes").alias("file_size_bytes"))


def whole_ranges(files: DataFrame) -> DataFrame:
    """record_ranges for one worker that knows of no other: all of its files, whole.

    A fallback for a worker that is told no assignment. Workers that share inputs
    would each read all of them, so the job never falls back by itself.
    """
    return record_ranges(files, 1)
