"""Spark data source ``strake_records``: reads and writes files of records.

Reading: ``path`` is one or several folders (or files, comma-separated), walked
in full and sorted by path. ``format`` is binary, ascii, or auto, which looks at
each file's head. Binary files are split into ranges of whole records; a partial
record at the end is dropped. The first line that is no record ends a text file:
``read_records`` looks for it in all splits at once, and the splits that are then
read end there; without that look, or with ``position=true``, which adds path and
record_index, a text file is one split. ``sampleRate`` reads some blocks of each
split only.

Writing: one file ``partition.N`` for each Spark partition, empty ones included,
staged beside the target. A commit first writes down what it will move; should it
be cut short, the next writer finishes it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import record as R
from .shared import located

SPLIT_BYTES = 32 * 1024 * 1024
READ_RECORDS = 65_536
READ_BYTES = 1 << 20
#: Records that a sample reads side by side.
SAMPLE_BLOCK = 64
OUTPUT = re.compile(r"\Apartition\.(\d+)\Z")
COMMIT = re.compile(r"\A_commit-[0-9a-f]+\.json\Z")
BAD = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("bad", T.LongType(), False)])


def list_files(paths: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of all files under some folders, sorted by path, each once; missing folders have none."""
    found: dict[str, int] = {}
    for path in paths.split(",") if isinstance(paths, str) else paths:
        system, inner = located(path.strip())
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            found[path.strip()] = info.size
        elif info.type == fs.FileType.Directory:
            base = path.strip()[: len(path.strip()) - len(inner)] if path.strip().endswith(inner) else ""
            for f in system.get_file_info(fs.FileSelector(inner, recursive=True)):
                if f.type == fs.FileType.File:
                    found[base + f.path] = f.size
    return sorted(found.items())


def total_bytes(paths: str | list[str]) -> int:
    return sum(n for _, n in list_files(paths))


def detect_file(path: str) -> tuple[str, float, int]:
    """Format, printable share and bytes looked at."""
    system, inner = located(path)
    with system.open_input_stream(inner) as f:
        return R.detect_bytes(f.read(R.HEAD))


def detect_report(spark: SparkSession, paths: str | list[str]):
    """path, size_bytes, format, ascii_ratio, bytes_read of every file."""
    files = list_files(paths)
    schema = "path string, size_bytes long, format string, ascii_ratio double, bytes_read long"
    return spark.createDataFrame([(p, n, *detect_file(p)) for p, n in files], schema)


@dataclass
class Split(InputPartition):
    """Records start to start + count of a binary file; of a text file the lines that begin in so many bytes (all: -1) and before ``stop``."""

    path: str
    kind: str
    start: int
    count: int
    stop: int = -1


def kinds_of(files: list[tuple[str, int]], kind: str) -> list[str]:
    if kind != "auto":
        return [kind] * len(files)
    with ThreadPoolExecutor(32) as pool:
        return [k for k, _, _ in pool.map(detect_file, [p for p, _ in files])]


def plan_splits(paths: str | list[str], kind: str = "auto", split_bytes: int = SPLIT_BYTES, stops: dict[str, int] | None = None) -> list[Split]:
    """The splits of some files. stops: of text files, where the first bad line begins, if one does; None if that is not known."""
    files = list_files(paths)
    out = []
    step = max(1, split_bytes // R.SIZE)
    for (path, size), k in zip(files, kinds_of(files, kind), strict=True):
        if k != "ascii":
            n = size // R.SIZE
            out += [Split(path, k, i, min(step, n - i)) for i in range(0, n, step)]
        elif stops is None:
            out.append(Split(path, k, 0, -1))
        else:
            stop = stops.get(path, size)
            out += [Split(path, k, i, min(split_bytes, size - i), stop) for i in range(0, stop, split_bytes)]
    return out


def _binary(data: bytes, width: int, n: int) -> pa.Array:
    """n values of ``width`` bytes each, without copying them one by one."""
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data)])


def _parse(line: str) -> bytes | None:
    n = len(line)
    if n == R.HEX_LINE and line[2 * R.KEY] == " ":
        digits = line[: 2 * R.KEY] + line[2 * R.KEY + 1 :]
        if not re.fullmatch("[0-9A-Fa-f]+", digits):
            return None
        return bytes.fromhex(digits)
    if R.RAW_LINE[0] <= n <= R.RAW_LINE[1]:
        return line.encode("latin-1").ljust(R.SIZE, b"\0")
    return None


_DIGIT = np.full(256, 255, np.uint8)
_DIGIT[0x30:0x3A] = np.arange(10)
_DIGIT[0x41:0x47] = _DIGIT[0x61:0x67] = np.arange(10, 16)
_END = re.compile(rb"\r\n|\n|\r")


def _hex_lines(data: bytes) -> tuple[bytes, int]:
    """The records of as many hex lines, each ended by a line feed, as ``data`` begins with, and the bytes that they take."""
    n = len(data) // (R.HEX_LINE + 1)
    rows = np.frombuffer(data, np.uint8, n * (R.HEX_LINE + 1)).reshape(n, R.HEX_LINE + 1)
    good = (rows[:, -1] == 10) & (rows[:, 2 * R.KEY] == 32)
    digits = _DIGIT[np.delete(rows, [2 * R.KEY, R.HEX_LINE], axis=1)]
    good &= (digits < 16).all(axis=1)
    n = n if good.all() else int(good.argmin())
    return (digits[:n, ::2] << 4 | digits[:n, 1::2]).tobytes(), n * (R.HEX_LINE + 1)


def _text_records(f, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, records) of the lines that begin from ``start`` to ``end``; a bad line has None and is the last."""
    at = start
    if start:  # a line that began before is the split's before this
        f.seek(start - 1)
        before = f.read(2)
        if before[:1] != b"\n" and (before[:1] != b"\r" or before[1:] == b"\n"):
            at, found = start, None
            f.seek(start)
            while found is None:
                part = f.read(READ_BYTES)
                if not part:
                    return
                found = re.search(rb"[\r\n]", part)
                at += found.start() if found else len(part)
            f.seek(at)
            at += 2 if f.read(2) == b"\r\n" else 1
    f.seek(at)
    rest = b""
    while at < end:
        part = f.read(READ_BYTES)
        data = rest + part
        if not data:
            return
        done, size = _hex_lines(data[: (end - at + R.HEX_LINE) // (R.HEX_LINE + 1) * (R.HEX_LINE + 1)])
        if done:
            yield at, done
        at, data = at + size, data[size:]
        held, first, upto = [], at, 0
        for m in _END.finditer(data):
            if at >= end or m.end() == len(data) and m[0] == b"\r" and part:  # its line feed may follow
                break
            one = _parse(data[upto : m.start()].decode("latin-1"))
            if one is None:
                if held:
                    yield first, b"".join(held)
                yield at, None
                return
            held.append(one)
            at, upto = at + m.end() - upto, m.end()
        rest = data[upto:]
        if not part and at < end and rest:  # a last line without an end
            one = _parse(rest.removesuffix(b"\r").decode("latin-1"))
            if one is not None:
                held.append(one)
            elif held:
                yield first, b"".join(held)
                held = []
            if one is None:
                yield at, None
            at = end
        if held:
            yield first, b"".join(held)


def _ranges(split: Split) -> Iterator[tuple[int, bytes]]:
    """(index of the first record, bytes of whole records) of a split; a part of a text file counts from its own beginning."""
    system, inner = located(split.path)
    with system.open_input_file(inner) as f:
        if split.kind == "binary":
            f.seek(split.start * R.SIZE)
            at, left = split.start, split.count
            while left > 0:
                want = min(left, READ_RECORDS) * R.SIZE
                parts = []
                while want and (part := f.read(want)):  # a read may return less than asked
                    parts.append(part)
                    want -= len(part)
                data = b"".join(parts)
                n = len(data) // R.SIZE
                if n:
                    yield at, data[: n * R.SIZE]
                if want:
                    break
                at, left = at + n, left - n
            return
        at, end = 0, split.start + split.count if split.count >= 0 else f.size()
        for _, data in _text_records(f, split.start, min(end, split.stop) if split.stop >= 0 else end):
            if data is None:
                return
            yield at, data
            at += len(data) // R.SIZE


def _sampled(split: Split, rate: float, seed: int) -> Iterator[tuple[int, bytes]]:
    """Some blocks of a split, chosen by the seed, its path and its place: of binary files only these are read."""
    rng = np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(split.path.encode()), split.start])
    if split.kind != "binary":
        for at, data in _ranges(split):
            picked = np.flatnonzero(rng.random(len(data) // R.SIZE) < rate)
            yield at, np.frombuffer(data, np.uint8).reshape(-1, R.SIZE)[picked].tobytes()
        return
    blocks = -(-split.count // SAMPLE_BLOCK)
    wanted = min(blocks, max(1, round(split.count * rate / SAMPLE_BLOCK)))
    for b in np.sort(rng.choice(blocks, wanted, replace=False)).tolist():
        start = split.start + b * SAMPLE_BLOCK
        yield from _ranges(Split(split.path, "binary", start, min(SAMPLE_BLOCK, split.start + split.count - start)))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[Split]:
        stops = json.loads(self.options["stops"]) if "stops" in self.options else None
        splits = plan_splits(self.options["path"], self.options.get("format", "auto"), int(self.options.get("splitbytes", SPLIT_BYTES)), stops)
        if self.schema.names == BAD.names:
            splits = [s for s in splits if s.kind == "ascii"]
        return splits or [Split("", "binary", 0, 0)]

    def _bad(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, inner = located(split.path)
        with system.open_input_file(inner) as f:
            for at, data in _text_records(f, split.start, split.start + split.count):
                if data is None:
                    yield pa.RecordBatch.from_arrays([pa.array([split.path]), pa.array([at], pa.int64())], names=BAD.names)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.count:
            return
        names = self.schema.names
        if names == BAD.names:
            yield from self._bad(split)
            return
        rate = float(self.options.get("samplerate", 0))
        for at, data in _sampled(split, rate, int(self.options.get("seed", 42))) if rate else _ranges(split):
            table = np.frombuffer(data, np.uint8).reshape(-1, R.SIZE)
            n = len(table)
            made = {
                "key": lambda: _binary(table[:, : R.KEY].tobytes(), R.KEY, n),  # noqa: B023
                "value": lambda: _binary(table[:, R.KEY :].tobytes(), R.VALUE, n),  # noqa: B023
                "path": lambda: pa.array([split.path] * n, pa.string()),  # noqa: B023
                "record_index": lambda: pa.array(np.arange(at, at + n, dtype=np.int64)),  # noqa: B023
            }
            yield pa.RecordBatch.from_arrays([made[c]() for c in names], names=names)


@dataclass
class Written(WriterCommitMessage):
    staged: str
    partition: int
    records: int


def _column_bytes(column: pa.Array, width: int) -> np.ndarray:
    if column.null_count:
        raise ValueError("a record has no nulls")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :]
    if len(column) and (np.diff(offsets) != width).any():
        raise ValueError(f"a part of a record has not {width} bytes")
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return flat.reshape(-1, width)


def output_format(path: str, asked: str | None) -> str:
    """binary or ascii: as asked, else by the ending of the path."""
    return asked or ("ascii" if path.endswith((".txt", ".ascii")) else "binary")


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.kind = output_format(self.path, options.get("format"))
        self.overwrite = overwrite
        self.stage = f"{self.path}/_staging-{uuid.uuid4().hex}"
        finish(self.path)
        if not overwrite and list_outputs(self.path):
            raise ValueError(f"{self.path} has output already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        staged = f"{self.stage}/{task.partitionId()}-{task.taskAttemptId()}"
        system, inner = located(staged)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        n = 0
        with system.open_output_stream(inner) as f:
            for batch in iterator:
                key = _column_bytes(batch.column("key").cast(pa.binary()), R.KEY)
                value = _column_bytes(batch.column("value").cast(pa.binary()), R.VALUE)
                n += len(key)
                if self.kind == "binary":
                    f.write(np.hstack([key, value]).tobytes())
                else:
                    f.write("".join(f"{k.tobytes().hex()} {v.tobytes().hex()}\n" for k, v in zip(key, value, strict=True)).upper().encode())
        return Written(staged, task.partitionId(), n)

    def commit(self, messages: list[Written | None]) -> None:
        moves = {f"{m.staged.rsplit('/', 2)[1]}/{m.staged.rsplit('/', 1)[1]}": f"partition.{m.partition}" for m in messages if m is not None}
        gone = [p.rsplit("/", 1)[1] for _, p in list_outputs(self.path)] if self.overwrite else []
        system, inner = located(self.path)
        system.create_dir(inner, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{inner}/_part-{name}") as f:
            f.write(json.dumps({"moves": moves, "gone": [g for g in gone if g not in moves.values()]}).encode())
        system.move(f"{inner}/_part-{name}", f"{inner}/_commit-{name}.json")
        finish(self.path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = located(self.stage)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)


def finish(path: str) -> int:
    """Ends the commits of a folder that were cut short: what was staged takes its place, what it replaces goes. How many there were."""
    system, inner = located(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return 0
    found = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if COMMIT.match(f.base_name)]
    for commit in found:
        with system.open_input_stream(commit) as f:
            plan = json.loads(f.read())
        for staged, name in plan["moves"].items():
            if system.get_file_info(f"{inner}/{staged}").type == fs.FileType.File:  # else it was moved already
                if system.get_file_info(f"{inner}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{inner}/{name}")
                system.move(f"{inner}/{staged}", f"{inner}/{name}")
        for name in plan["gone"]:
            if system.get_file_info(f"{inner}/{name}").type == fs.FileType.File:
                system.delete_file(f"{inner}/{name}")
        for stage in {staged.split("/")[0] for staged in plan["moves"]}:
            if system.get_file_info(f"{inner}/{stage}").type == fs.FileType.Directory:
                system.delete_dir(f"{inner}/{stage}")
        system.delete_file(commit)
    return len(found)


def list_outputs(path: str) -> list[tuple[int, str]]:
    """(number, path) of the files partition.N of a folder, by number."""
    system, inner = located(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return []
    base = path.rstrip("/")
    found = [(int(m[1]), f"{base}/{f.base_name}") for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and (m := OUTPUT.match(f.base_name))]
    return sorted(found)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strake_records"

    def schema(self) -> T.StructType:
        return R.PLACED if self.options.get("position", "false").lower() == "true" else R.SCHEMA

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)


def bad_lines(spark: SparkSession, paths: str, kind: str = "auto", split_bytes: int = SPLIT_BYTES) -> dict[str, int]:
    """Where the first line that is no record begins, of the text files that have one."""
    register(spark)
    source = spark.read.format("strake_records").option("format", kind).option("splitBytes", split_bytes).option("stops", "{}")
    return {r.path: r.bad for r in source.schema(BAD).load(paths).groupBy("path").agg(F.min("bad").alias("bad")).collect()}


def read_records(spark: SparkSession, path: str | list[str], kind: str = "auto", position: bool = False, keys_only: bool = False, split_bytes: int = SPLIT_BYTES, sample_rate: float | None = None, seed: int = 42) -> DataFrame:
    """key, value (path, record_index) of all records; keys only where asked, so that values are not built.

    Text files over a split are looked through for their first bad line, in a job
    of its own. With ``sample_rate``, about that part of the records of each
    split, in blocks, one block at least; only these are read of binary files.
    """
    register(spark)
    paths = path if isinstance(path, str) else ",".join(path)
    source = spark.read.format("strake_records").option("format", kind).option("position", str(position).lower()).option("splitBytes", split_bytes)
    if not position and kind != "binary":
        files = [f for f in list_files(paths) if f[1] > split_bytes]
        if "ascii" in kinds_of(files, kind):
            source = source.option("stops", json.dumps(bad_lines(spark, paths, kind, split_bytes)))
    if sample_rate:
        source = source.option("sampleRate", sample_rate).option("seed", seed)
    if keys_only:
        source = source.schema(T.StructType([R.SCHEMA["key"]]))
    return source.load(paths)


def count_records(spark: SparkSession, path: str | list[str], kind: str = "auto") -> int:
    return read_records(spark, path, kind, keys_only=True).count()


def count_by_file(spark: SparkSession, path: str | list[str], kind: str = "auto") -> DataFrame:
    """path, records of every file with a record."""
    return read_records(spark, path, kind, position=True).groupBy("path").agg(F.count("*").alias("records"))


def write_records(df, path: str, kind: str | None = None, overwrite: bool = False) -> None:
    """One file partition.N for each partition of ``df``."""
    register(df.sparkSession)
    writer = df.select("key", "value").write.format("strake_records").mode("overwrite" if overwrite else "append")
    (writer.option("format", kind) if kind else writer).save(path)
