"""Samples of records, from which boundaries are chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.record import SIZE

RATE = 0.01


def check_rate(rate: float) -> float:
    if not 0 < rate <= 1:
        raise ValueError("a sample rate is over 0 and at most 1")
    return rate


def seed_of(name: str) -> int:
    """A worker's seed: the 31-polynomial hash of its name, as a signed 32-bit number."""
    raw = name.encode("utf-16-be")
    h = 0
    for i in range(0, len(raw), 2):
        h = (31 * h + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def bernoulli(records: DataFrame, rate: float = RATE, seed: int = 42) -> DataFrame:
    """Each record with probability ``rate``; the first record if none is met and there is one."""
    check_rate(rate)
    picked = records.sample(False, rate, seed)
    return picked if picked.limit(1).count() else records.limit(1)


def prefix(records: DataFrame, rate: float = RATE, by: str = "path", index: str = "record_index") -> DataFrame:
    """The first max(1, floor(n * rate)) records of each range."""
    check_rate(rate)
    n = records.groupBy(by).agg(F.count("*").alias("_n"))
    joined = records.join(n, by)
    return joined.filter(F.col(index) < F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(rate)))).drop("_n")


def systematic(records: DataFrame, rate: float = RATE, by: str = "path", index: str = "record_index") -> DataFrame:
    """Every 1/rate-th record of each range, the first included: unbiased on sorted input too."""
    check_rate(rate)
    step = max(1, round(1 / rate))
    return records.filter(F.col(index) % step == 0)


def reservoir(records: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k records, all sets of k equally likely; a top-k by a random number, so no task holds more than k."""
    return records.withColumn("_r", F.rand(seed)).orderBy("_r").limit(k).drop("_r")


def hashed(records: DataFrame, key: str, share: float) -> DataFrame:
    """Records whose key's MD5 falls under ``share``: the same in every engine and on every run."""
    check_rate(share)
    h = F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long")
    return records.filter(h < int(share * 2**32))


def estimated(size_bytes: int, rate: float = 0.1) -> int:
    """How many samples some bytes of input give."""
    return int(size_bytes // SIZE * rate)

