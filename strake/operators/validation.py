"""Checks of sorted output: order inside and across partitions, counts, checksums."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.records import list_outputs, read_records


def inversions(records: DataFrame, by: str = "pid", at: str = "record_index", key: str = "key") -> DataFrame:
    """by, inversions, is_sorted: adjacent pairs of each partition that are out of order."""
    before = F.lag(key).over(W.partitionBy(by).orderBy(at))
    marked = records.withColumn("_bad", F.when(before > F.col(key), 1).otherwise(0))
    return marked.groupBy(by).agg(F.sum("_bad").alias("inversions")).withColumn("is_sorted", F.col("inversions") == 0)


def file_inversions(records: DataFrame) -> DataFrame:
    """path, records, inversions, is_sorted of files that are read with their positions.

    Neighbours are compared where they are read, a split at a time, and the ends
    of a file's splits with each other: one row a split is exchanged.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []  # path, first index, records, inversions, first key, last key
        for batch in batches:
            if not batch.num_rows:
                continue
            path, index, key = batch.column("path"), batch.column("record_index").to_numpy(), batch.column("key").cast(pa.binary())
            cuts = np.ones(len(index), bool)
            cuts[1:] = (np.diff(index) != 1) | pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
            worse = np.zeros(len(index), np.int64)
            worse[1:] = pc.greater(key[:-1], key[1:]).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(cuts)
            for a, b in zip(at, np.r_[at[1:], len(index)], strict=True):
                new = [path[int(a)].as_py(), int(index[a]), int(b - a), int(worse[a + 1 : b].sum()), key[int(a)].as_py(), key[int(b - 1)].as_py()]
                if rows and rows[-1][0] == new[0] and rows[-1][1] + rows[-1][2] == new[1]:
                    old = rows[-1]
                    rows[-1] = [old[0], old[1], old[2] + new[2], old[3] + new[3] + (old[5] > new[4]), old[4], new[5]]
                else:
                    rows.append(new)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "first", "n", "bad", "first_key", "last_key"])

    runs = records.select("path", "record_index", "key").mapInArrow(f, "path string, first long, n long, bad long, first_key binary, last_key binary")
    before = F.lag("last_key").over(W.partitionBy("path").orderBy("first"))
    joined = runs.withColumn("bad", F.col("bad") + F.when(before > F.col("first_key"), 1).otherwise(0))
    return joined.groupBy("path").agg(F.sum("n").alias("records"), F.sum("bad").alias("inversions")).withColumn("is_sorted", F.col("inversions") == 0)


def extremes(records: DataFrame, by: str = "pid", key: str = "key") -> DataFrame:
    """by, records, min_key, max_key."""
    return records.groupBy(by).agg(F.count("*").alias("records"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def global_order(records: DataFrame, by: str = "pid", key: str = "key") -> DataFrame:
    """extremes with follows: whether a partition begins at or after the end of all before it (numbers order, not names)."""
    found = extremes(records, by, key)
    high = F.max("max_key").over(W.orderBy(by).rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("follows", F.coalesce(F.col("min_key") >= high, F.lit(True)))


def checksum(records: DataFrame) -> DataFrame:
    """records, keys, checksum: a sum over all records (60 bits of each one's MD5) that does not depend on their order."""
    hashed = F.conv(F.substring(F.md5(F.concat("key", "value")), 1, 15), 16, 10).cast("decimal(38,0)")
    return records.agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"), F.coalesce(F.sum(hashed), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def parity(before: DataFrame, after: DataFrame, unique: bool = False) -> dict:
    """Whether two tables hold the same records; optionally whether all keys differ."""
    a, b = checksum(before).first(), checksum(after).first()
    same = a.records == b.records and a.checksum == b.checksum
    return {"records_before": a.records, "records_after": b.records, "same": same and (not unique or b.keys == b.records)}


def transport_checksum(records: DataFrame, by: str = "pid") -> DataFrame:
    """by, records, md5 of key and value of a partition's records in order; ``records`` is partitioned and sorted already."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column(by).to_numpy()
            both = pc.binary_join_element_wise(batch.column("key").cast(pa.binary()), batch.column("value").cast(pa.binary()), b"")
            cuts = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1], True])
            offsets = np.frombuffer(both.buffers()[1], np.int32, len(both) + 1)
            data = memoryview(both.buffers()[2])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                n, h = sums.get(int(pid[a])) or (0, md5())
                h.update(data[offsets[a] : offsets[b]])  # records lie side by side
                sums[int(pid[a])] = (n + b - a, h)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([h.hexdigest() for _, h in sums.values()], pa.string())], names=[by, "records", "md5"])

    return records.select(F.col(by).cast("int").alias(by), "key", "value").mapInArrow(f, f"{by} int, records long, md5 string")


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """key, value, pid, record_index of the files partition.N of a folder."""
    read = read_records(spark, [p for _, p in list_outputs(path)], "binary", position=True)
    return read.withColumn("pid", F.regexp_extract("path", r"partition\.(\d+)$", 1).cast("int"))


def report(spark: SparkSession, path: str, source: DataFrame | None = None) -> dict:
    """What a sorted folder is: files, records, order in and across files, and parity with its source."""
    files = list_outputs(path)
    if not files:
        return {"files": 0, "records": 0, "sorted": True, "ordered": True, "same": source is None or not source.limit(1).count()}
    found = outputs(spark, path)
    out = {"files": len(files), "records": found.count(), "sorted": file_inversions(found).filter("not is_sorted").limit(1).count() == 0, "ordered": global_order(found).filter("not follows").limit(1).count() == 0}
    if source is not None:
        out["same"] = parity(source, found.select("key", "value"))["same"]
    return out
