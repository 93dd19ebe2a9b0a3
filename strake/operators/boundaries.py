"""How many partitions, where they part, and which worker has which.

Boundaries are a driver-side list of P - 1 keys: their number is bounded by the
partition count, not by the data. Samples are sorted by Spark; only the picked
rows come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1024 * 1024
TARGET_MIB = 32
LEAST_PER_WORKER, MOST_PER_WORKER = 3, 500


def dynamic_count(total_bytes: int, workers: int) -> int:
    """One partition for 32 MiB, from 3 to 500 for each worker, rounded up to a multiple of the workers; 3 each without input."""
    if not total_bytes:
        return workers * LEAST_PER_WORKER
    ideal = max(1, total_bytes // MIB // TARGET_MIB)
    held = max(workers * LEAST_PER_WORKER, min(workers * MOST_PER_WORKER, ideal))
    return -(-held // workers) * workers


def dynamic_count_column(total_bytes: Column, workers: Column) -> Column:
    """``dynamic_count`` as an expression."""
    ideal = F.greatest(F.lit(1), F.floor(F.floor(total_bytes / MIB) / TARGET_MIB))
    held = F.greatest(workers * LEAST_PER_WORKER, F.least(workers * MOST_PER_WORKER, ideal))
    return F.when(total_bytes == 0, workers * LEAST_PER_WORKER).otherwise(F.ceil(held / workers) * workers).cast("long")


def picks(n: int, partitions: int, rule: str) -> list[int]:
    """Which of n sorted samples are boundaries.

    coordinator: every floor(n / P)-th, P lowered to n if there are fewer
    samples; the last partition takes the remainder. balanced: the (n * i / P)-th;
    needs samples.
    """
    if partitions < 1:
        raise ValueError("there is at least one partition")
    if rule == "coordinator":
        partitions = max(1, n) if n < partitions else partitions
        step = n // partitions
        return [i * step for i in range(1, partitions)]
    if rule != "balanced":
        raise ValueError("a rule is coordinator or balanced")
    if not n:
        raise ValueError("boundaries need samples")
    return [n * i // partitions for i in range(1, partitions)]


def boundaries(samples: DataFrame, partitions: int, rule: str = "coordinator", key: str = "key") -> list:
    """The boundary keys of a sample, in order; equal keys stay (their partitions are empty).

    The sample is sorted once and kept for the two looks at it, as a second sort
    could be split at other keys. Only the picked rows come to the driver.
    """
    ordered = samples.select(key).orderBy(key).withColumn("_at", F.monotonically_increasing_id()).persist()
    try:
        parts = {r.p: r.n for r in ordered.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
        first, n = {}, 0
        for p in sorted(parts):
            first[p], n = n, n + parts[p]
        wanted = picks(n, partitions, rule)
        ids = {}
        for rank in set(wanted):
            p = max((q for q in first if first[q] <= rank), key=first.get)
            ids[rank] = (p << 33) + rank - first[p]
        places = samples.sparkSession.createDataFrame([(i,) for i in ids.values()], "_at long")
        rows = {r._at: r[key] for r in ordered.join(F.broadcast(places), "_at").collect()} if ids else {}
    finally:
        ordered.unpersist()
    return [rows[ids[rank]] for rank in wanted]


def decimal_range(low: str, high: str, partitions: int) -> list[bytes]:
    """Even integer ranges as keys: the decimal digits filled up with zero bytes, so ordered as text."""
    if partitions == 1:
        return []
    a, width = int(low), int((int(high) - int(low)) / partitions)
    return [str(a + width * i).encode()[:10].ljust(10, b"\0") for i in range(1, partitions)]


def shuffle_map(partitions: int, workers: list[int]) -> dict[int, int]:
    """Partition to worker: contiguous runs of floor(P / N), the rest to the last worker."""
    if not workers:
        return {}
    each = max(1, partitions // len(workers))
    return {p: workers[min(p // each, len(workers) - 1)] for p in range(partitions)}


def shuffle_map_column(pid: Column, partitions: Column, workers: Column) -> Column:
    """Position of a partition's worker, as an expression."""
    each = F.greatest(F.lit(1), F.floor(partitions / workers))
    return F.least(F.floor(pid / each), workers - 1).cast("long")


def worker_partitions(worker: int, workers: int, partitions: int) -> range:
    """Balanced contiguous runs: the first P % N workers have one more."""
    if not 0 <= worker < workers:
        raise ValueError("a worker is numbered from 0")
    each, more = divmod(partitions, workers)
    first = worker * each + min(worker, more)
    return range(first, first + each + (worker < more))


def worker_partitions_column(pid: Column, partitions: Column, workers: Column) -> Column:
    """The worker of a partition by the balanced rule, as an expression."""
    each, more = F.floor(partitions / workers), partitions % workers
    wide = more * (each + 1)
    return F.when(pid < wide, F.floor(pid / (each + 1))).otherwise(more + F.floor((pid - wide) / F.greatest(each, F.lit(1)))).cast("long")


def assigned(shuffle: dict[int, int], worker: int) -> list[int]:
    """The partitions of a worker."""
    return sorted(p for p, w in shuffle.items() if w == worker)


def strategy_count(strategy: str, workers: int, asked: int | None = None, total_bytes: int = 0) -> int:
    """Partitions by strategy: A has one for each worker; B has the number asked, or ``dynamic_count``."""
    if strategy == "A":
        return workers
    if strategy != "B":
        raise ValueError("a strategy is A or B")
    return asked or dynamic_count(total_bytes, workers)
