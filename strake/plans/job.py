"""The sort job: files of records in, ordered files ``partition.N`` out."""

from __future__ import annotations

import shutil
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.record import SIZE
from ..operators import boundaries as B
from ..operators import sampling, sorting, validation
from ..sources.records import list_files, list_outputs, read_records, write_records
from ..sources.shared import located
from ..streaming.progress import observed, stage_progress
from .checkpoints import FAILED, Checkpoints, Phases, State, on_error, restored

#: Samples for each partition from which on more of them place boundaries no better.
SAMPLES = 1000


@dataclass
class SortJob:
    """What to sort and how.

    sample: blocks (of each split, only these are read), bernoulli, systematic, or
    prefix (the first records of each file). seed: that of the job's id where it
    is not given. attempts: how often the exchange and the writing are tried.
    replicate: the sample is kept on two executors.
    """

    inputs: list[str]
    output: str
    workers: int = 1
    partitions: int | None = None
    strategy: str = "B"
    rule: str = "coordinator"
    sample: str = "blocks"
    rate: float = sampling.RATE
    seed: int | None = None
    kind: str = "auto"
    overwrite: bool = False
    checkpoint_dir: str | None = None
    job_id: str | None = None
    validate: bool = False
    attempts: int = 2
    replicate: bool = False
    check_space: bool = True


def required_bytes(total: int) -> int:
    """Disk that a sort of so many bytes is expected to take at most."""
    return int(total * 4.2 * 1.2)


def required_column(total: Column) -> Column:
    """``required_bytes`` as an expression."""
    return F.floor(total * F.lit(4.2) * F.lit(1.2)).cast("long")


def enough_space(path: str, total: int) -> bool:
    """Whether a local folder, or the nearest one above that exists, has room; other stores are not asked."""
    system, inner = located(path)
    if not isinstance(system, fs.LocalFileSystem):
        return True
    while inner and system.get_file_info(inner).type != fs.FileType.Directory:
        inner = inner.rpartition("/")[0]
    return shutil.disk_usage(inner or "/").free >= required_bytes(total)


def disk_usage(folders: dict[str, str]) -> dict[str, int]:
    """Bytes under each named folder, and in total."""
    used = {name: sum(n for _, n in list_files(path)) for name, path in folders.items()}
    return used | {"total": sum(used.values())}


def readable(usage: dict[str, int]) -> str:
    return "\n".join(f"{name}: {n / 1024**2:.2f} MB" for name, n in usage.items())


def sample_keys(spark: SparkSession, job: SortJob, total: int = 0, partitions: int = 1) -> DataFrame:
    """The keys from which boundaries are chosen. Blocks are read as many as the rate says, but no more than give each partition ``SAMPLES``."""
    seed = sampling.seed_of(job.job_id or "") if job.seed is None else job.seed
    sampling.check_rate(job.rate)
    if job.sample == "blocks":
        rate = min(job.rate, SAMPLES * partitions * SIZE / total) if total else job.rate
        return read_records(spark, job.inputs, job.kind, keys_only=True, sample_rate=rate, seed=seed)
    if job.sample == "bernoulli":
        return sampling.bernoulli(read_records(spark, job.inputs, job.kind, keys_only=True), job.rate, seed)
    placed = read_records(spark, job.inputs, job.kind, position=True)
    return (sampling.prefix if job.sample == "prefix" else sampling.systematic)(placed, job.rate).select("key")


class _Watch:
    """Tells a callback every second how far the running stages are."""

    def __init__(self, spark: SparkSession, say: Callable[[dict], None] | None):
        self.spark, self.say, self.done = spark, say, threading.Event()
        self.thread = threading.Thread(target=self._look, daemon=True)

    def _look(self) -> None:
        while not self.done.wait(1):
            self.say(stage_progress(self.spark))

    def __enter__(self) -> None:
        if self.say:
            self.thread.start()

    def __exit__(self, *_) -> None:
        self.done.set()
        if self.say:
            self.thread.join()


def run(spark: SparkSession, job: SortJob, say: Callable[[dict], None] | None = None) -> dict:
    """Runs a job; what it did, with the validation's report if asked. ``say`` is told of its progress.

    A finished job is not run again under its id; an unfinished one starts with
    the boundaries that it had chosen, so its partitions are the same. Phases are
    gone through in their order. An error while records are exchanged and written
    is tried again, as nothing is written before the commit; any other ends the job.
    """
    marks = Checkpoints(job.job_id or f"sort-{uuid.uuid4().hex}", job.checkpoint_dir) if job.checkpoint_dir else None
    before = marks.latest() if marks else None
    if before and before["phase"] == "COMPLETED":
        return before["state"]["notes"] | {"resumed": True}
    state, phases = State(), Phases()

    def enter(phase: str, progress: float) -> None:
        phases.enter(phase)
        if marks:
            marks.save(phase, state, progress)
            marks.keep()

    def again(work: Callable[[], None]) -> None:
        """Works, and once more after an error, as the policy of the phase says."""
        for left in range(job.attempts - 1, -1, -1):
            try:
                return work()
            except Exception:
                if not left or on_error(phases.now, 1, job.workers) != "retry":
                    raise

    try:
        enter("INITIALIZING", 0.0)
        files = list_files(job.inputs)
        total = sum(n for _, n in files)
        if job.check_space and not enough_space(job.output, total):
            raise OSError(f"{job.output} has not the {required_bytes(total)} bytes that a sort may take")
        state.inputs = [p for p, _ in files]
        enter("SAMPLING", 0.1)
        partitions = B.strategy_count(job.strategy, job.workers, job.partitions, total)
        if before and (old := restored(before)).boundaries:
            limits = [bytes.fromhex(b) for b in old.boundaries]
        else:
            keys = sample_keys(spark, job, total, partitions)
            keys = sorting.replicated(keys) if job.replicate else keys
            limits = [bytes(b) for b in B.boundaries(keys, partitions, job.rule)]
            if job.replicate:
                keys.unpersist()
        enter("WAITING_FOR_PARTITIONS", 0.3)
        state.boundaries = [b.hex() for b in limits]
        state.shuffle_map = B.shuffle_map(len(limits) + 1, list(range(job.workers)))
        enter("SORTING", 0.4)
        records = read_records(spark, job.inputs, job.kind)
        ordered, _ = sorting.range_sort(records, len(limits) + 1, limits)
        done = {"files": str(len(files)), "bytes": str(total), "partitions": str(len(limits) + 1)}
        enter("SHUFFLING", 0.5)

        def write() -> None:
            counted, seen = observed(ordered, f"sort-{uuid.uuid4().hex}")
            write_records(counted, job.output, overwrite=job.overwrite)
            done["records_written"] = str(seen.get["records"])

        with _Watch(spark, say):
            again(write)
        enter("MERGING", 0.9)
        state.outputs = [n for n, _ in list_outputs(job.output)]
        if job.validate:
            done |= {k: str(v) for k, v in validation.report(spark, job.output, records).items()}
        state.notes = done
        enter("COMPLETED", 1.0)
        return done
    except Exception:
        enter(FAILED, 0.0)
        raise
