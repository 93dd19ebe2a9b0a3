"""Ordering records: by key, ties by value, so that results do not depend on the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.record import SIZE
from ..sources.records import read_records, write_records
from . import boundaries as B
from . import partitioning, sampling


def range_sort(records: DataFrame, partitions: int, limits: list | None = None, rule: str = "coordinator", rate: float = sampling.RATE, seed: int = 42) -> tuple[DataFrame, list]:
    """records with pid, globally ordered: Spark partition N holds partition N in order. Also its boundaries.

    One pass samples keys, one exchange routes each record to its partition, and
    each is sorted where it lands (Spark spills what does not fit).
    """
    if limits is None:
        keys = sampling.bernoulli(records.select("key"), rate, seed)
        limits = B.boundaries(keys, partitions, rule)
    placed = partitioning.exchange(partitioning.assign(records, limits), len(limits) + 1)
    return placed.sortWithinPartitions("key", "value"), limits


def global_sort(records: DataFrame) -> DataFrame:
    """Total order by Spark's own range partitioning, where partition numbers do not matter."""
    return records.orderBy("key", "value")


def sorted_chunks(records: DataFrame) -> DataFrame:
    """Each Spark partition ordered for itself: a run for each."""
    return records.sortWithinPartitions("key", "value")


def sort_files(spark: SparkSession, paths: str | list[str], kind: str = "auto") -> DataFrame:
    """Runs of the records of some files."""
    return sorted_chunks(read_records(spark, paths, kind))


def sort_each_file(spark: SparkSession, paths: str | list[str], kind: str = "auto") -> DataFrame:
    """key, value, path, record_index: each file a run of its own, with a record's place in it, however many splits the file has.

    Splits are dealt by ranges of path, key and value, so many tasks sort one large
    file; a record's place is its rank less the records of the files before.
    """
    records = read_records(spark, paths, kind, position=True).drop("record_index")
    counts = {r.path: r.n for r in records.groupBy("path").agg(F.count("*").alias("n")).collect()}  # a row for each file
    before, upto = [], 0
    for path in sorted(counts, key=str.encode):  # as Spark orders texts
        before.append((path, upto))
        upto += counts[path]
    first = spark.createDataFrame(before, "path string, _before long")
    return ranked(records, "path", "key", "value").join(F.broadcast(first), "path").withColumn("record_index", F.col("global_rank") - F.col("_before") - 1).select("key", "value", "path", "record_index")


def merge_files(spark: SparkSession, paths: str | list[str], path: str, limits: list | None = None, kind: str = "auto", overwrite: bool = False) -> None:
    """The records of some files in order, in one file partition.0, or in one for each range of ``limits``.

    All files are read in one scan, however many they are.
    """
    ordered, _ = range_sort(read_records(spark, paths, kind), len(limits or []) + 1, limits or [])
    write_records(ordered, path, overwrite=overwrite)


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """The union of sorted runs in order; all equal keys stay."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return global_sort(out)


def merge_and_partition(runs: list[DataFrame], limits: list) -> DataFrame:
    """The union of sorted runs with pid, each partition in order in the task of its number."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return range_sort(merged, len(limits) + 1, limits)[0]


def replicated(records: DataFrame) -> DataFrame:
    """records kept on two executors, so that losing one costs no recomputation; otherwise lineage restores what is lost."""
    return records.persist(StorageLevel.MEMORY_AND_DISK_2)


def merge_iterator(records: DataFrame) -> Iterator[Row]:
    """Records in order, a partition at a time."""
    return global_sort(records).toLocalIterator(prefetchPartitions=True)


def merge_with_callback(records: DataFrame, f: Callable[[Row], None]) -> int:
    """Calls ``f`` with every record in order; how many there were."""
    n = 0
    for row in merge_iterator(records):
        f(row)
        n += 1
    return n


def comparable(records: DataFrame, *order: str) -> Column:
    """Bytes whose order is that of some columns: numbers, texts without zero characters, and binary of one length (or last)."""
    parts = []
    for name in order:
        kind, c = records.schema[name].dataType, F.col(name)
        if isinstance(kind, T.BinaryType):
            parts.append(c)
        elif isinstance(kind, T.StringType):
            parts += [c.cast("binary"), F.lit(bytearray(1))]
        else:
            # the sign bit is turned, so negative numbers come first
            parts.append(F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))
    return F.concat(*parts)


def ranked(records: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """records with global_rank from 1, by columns of numbers, texts or binary without nulls.

    Boundaries come from a sample once. From then on a record's partition follows
    from itself, so counting the partitions and sorting them may be done apart,
    and again after a failure, and still agree. Two sorts by Spark's own sampled
    ranges would not: each draws its own splitters. One exchange, no window.
    """
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = records.withColumn("_order", comparable(records, *order))
    total = records.count()
    limits = B.boundaries(keyed.select("_order").sample(False, min(1.0, 100 * n / max(1, total)), 17), n, "balanced", "_order") if n > 1 and total > n else []
    placed = keyed.withColumn("pid", partitioning.partition_of(F.col("_order"), limits)).drop("_order")
    counts = {r.pid: r.n for r in placed.groupBy("pid").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, upto = [], 0
    for p in range(len(limits) + 1):
        before.append((p, upto))
        upto += counts.get(p, 0)
    ordered = partitioning.exchange(placed, len(limits) + 1).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    joined = ordered.join(F.broadcast(spark.createDataFrame(before, "pid int, _first long")), "pid")
    return joined.withColumn("global_rank", F.col("_first") + F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33) + 1).drop("_at", "_first", "pid")


def top_k(records: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k records; an addition to the reference's operators."""
    return records.orderBy(*order).limit(k)


def merge_statistics(files: list[tuple[str, int]]) -> tuple[int, int]:
    """Records in some runs and the memory that all of them would take."""
    n = sum(size // SIZE for _, size in files)
    return n, n * SIZE
