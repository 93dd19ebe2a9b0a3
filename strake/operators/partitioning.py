"""Records to partitions by boundaries; a key equal to a boundary goes up."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many boundaries are compared one by one inside generated code; beyond, a search in Arrow batches is faster.
FEW = 48


def partition_of(key: Column, boundaries: list) -> Column:
    """The number of boundaries that are at most the key."""
    if not boundaries:
        return F.lit(0)
    if len(boundaries) <= FEW:
        total = F.lit(0)
        for b in boundaries:
            total = total + F.when(key >= F.lit(bytearray(b) if isinstance(b, (bytes, bytearray)) else b), 1).otherwise(0)
        return total
    known = [bytes(b) if isinstance(b, (bytes, bytearray)) else b.encode() for b in boundaries]
    wide = len(known[0]) if len({len(b) for b in known}) == 1 else 0
    fixed = np.array(known, dtype=f"S{wide}") if wide else None

    @F.arrow_udf("int")
    def search(keys: pa.Array) -> pa.Array:
        _, offsets, data = keys.buffers()
        at = np.frombuffer(offsets, np.int32, len(keys) + 1 + keys.offset)[keys.offset :]
        if fixed is not None and not keys.null_count and (np.diff(at) == wide).all():
            # keys of one length lie side by side: compared as they are, zero bytes at the end count for nothing in either
            flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(f"S{wide}") if len(keys) else fixed[:0]
            return pa.array(np.searchsorted(fixed, flat, side="right").astype(np.int32))
        return pa.array([None if k is None else bisect_right(known, k) for k in keys.cast(pa.binary()).to_pylist()], pa.int32())

    return search(key)


def assign(records: DataFrame, boundaries: list, key: str = "key") -> DataFrame:
    """records with pid."""
    return records.withColumn("pid", partition_of(F.col(key), boundaries))


def exchange(records: DataFrame, partitions: int) -> DataFrame:
    """Sends records to the Spark partition that their pid names; one shuffle, no second hash."""
    return records.repartitionById(partitions, F.col("pid"))


def histogram(records: DataFrame, partitions: int) -> DataFrame:
    """pid, records of every partition, empty ones too."""
    counted = records.groupBy("pid").agg(F.count("*").alias("n"))
    every = records.sparkSession.range(partitions).select(F.col("id").cast("int").alias("pid"))
    return every.join(counted, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("records"))


def of_worker(records: DataFrame, shuffle: dict[int, int], worker: int) -> DataFrame:
    """The records whose partition a worker has."""
    return records.filter(F.col("pid").isin([p for p, w in shuffle.items() if w == worker]))
