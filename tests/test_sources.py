"""Files of records: reading, splitting, writing."""

import os
import random

import pytest

from strake.sources import records as S


def make(n, seed=42):
    r = random.Random(seed)
    return [r.randbytes(100) for _ in range(n)]


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def load(df):
    return sorted(bytes(r.key) + bytes(r.value) for r in df.collect())


def test_binary_files_of_nested_folders(spark, tmp_path):
    a, b, c = make(5), make(100, 1), make(1000, 2)
    put(tmp_path / "x" / "b.dat", b"".join(a))
    put(tmp_path / "x" / "deep" / "er" / "a.dat", b"".join(b))
    put(tmp_path / "y" / "c.dat", b"".join(c))
    df = S.read_records(spark, [str(tmp_path / "x"), str(tmp_path / "y"), str(tmp_path / "none")], "binary")
    assert load(df) == sorted(a + b + c)
    assert S.count_records(spark, str(tmp_path)) == 1105
    assert S.total_bytes(str(tmp_path)) == 110_500


def test_a_file_under_two_folders_is_read_once(spark, tmp_path):
    put(tmp_path / "x" / "a.dat", b"".join(make(7)))
    assert S.count_records(spark, [str(tmp_path), str(tmp_path / "x")], "binary") == 7


@pytest.mark.parametrize("tail", [1, 37, 99])
def test_a_partial_record_at_the_end_is_dropped(spark, tmp_path, tail):
    data = make(20)
    put(tmp_path / "a.dat", b"".join(data) + b"x" * tail)
    assert load(S.read_records(spark, str(tmp_path), "binary")) == sorted(data)


@pytest.mark.parametrize("data", [b"", b"\1" * 50])
def test_files_without_a_record(spark, tmp_path, data):
    put(tmp_path / "a.dat", data)
    assert S.read_records(spark, str(tmp_path)).count() == 0


def test_no_files(spark, tmp_path):
    assert S.read_records(spark, str(tmp_path)).count() == 0


def test_splits_cover_each_record_once(spark, tmp_path):
    data = make(1003)
    put(tmp_path / "a.dat", b"".join(data[:1000]) + b"zz")
    put(tmp_path / "b.dat", b"".join(data[1000:]))
    splits = S.plan_splits(str(tmp_path), "binary", 25_050)
    assert [(os.path.basename(s.path), s.start, s.count) for s in splits] == [("a.dat", 0, 250), ("a.dat", 250, 250), ("a.dat", 500, 250), ("a.dat", 750, 250), ("b.dat", 0, 3)]
    df = S.read_records(spark, str(tmp_path), "binary", position=True, split_bytes=25_050)
    assert df.rdd.getNumPartitions() == 5
    rows = sorted((r.path, r.record_index, bytes(r.key) + bytes(r.value)) for r in df.collect())
    assert [x[2] for x in rows] == data and [x[1] for x in rows] == [*range(1000), 0, 1, 2]


def test_keys_only(spark, tmp_path):
    data = make(30)
    put(tmp_path / "a.dat", b"".join(data))
    df = S.read_records(spark, str(tmp_path), "binary", keys_only=True)
    assert df.columns == ["key"] and sorted(bytes(r.key) for r in df.collect()) == sorted(d[:10] for d in data)


def test_formats_are_told_apart(spark, tmp_path):
    data = make(40)
    put(tmp_path / "bin", b"".join(data))
    put(tmp_path / "hex", b"".join(f"{d[:10].hex()} {d[10:].hex()}\n".encode() for d in data))
    put(tmp_path / "crlf", b"".join(f"{d[:10].hex().upper()} {d[10:].hex().upper()}\r\n".encode() for d in data))
    assert load(S.read_records(spark, str(tmp_path))) == sorted(data * 3)
    found = {os.path.basename(r.path): (r.format, r.bytes_read) for r in S.detect_report(spark, str(tmp_path)).collect()}
    assert found == {"bin": ("binary", 1000), "hex": ("ascii", 1000), "crlf": ("ascii", 1000)}


@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
def test_raw_text(spark, tmp_path, end):
    texts = [f"{i:010d}" + "x" * (88 + i % 3) for i in range(9)]
    put(tmp_path / "t", end.join(t.encode() for t in texts) + end)
    assert load(S.read_records(spark, str(tmp_path))) == sorted(t.encode().ljust(100, b"\0") for t in texts)


def test_the_first_bad_line_ends_a_text_file(spark, tmp_path):
    good = [f"{d[:10].hex()} {d[10:].hex()}" for d in make(6)]
    put(tmp_path / "t", "\n".join([*good[:4], "TOOSHORT", *good[4:]]).encode())
    assert S.read_records(spark, str(tmp_path)).count() == 4


def test_a_printable_binary_file_is_binary_when_asked(spark, tmp_path):
    data = [(f"{i:010d}" + "y" * 88 + "\r\n").encode() for i in range(12)]
    put(tmp_path / "a", b"".join(data))
    assert load(S.read_records(spark, str(tmp_path), "binary")) == sorted(data)
    assert {bytes(r.value)[-2:] for r in S.read_records(spark, str(tmp_path)).collect()} == {b"\0\0"}


def test_write_one_file_for_each_partition(spark, tmp_path):
    data = make(200)
    df = spark.createDataFrame([(d[:10], d[10:], d[0] % 7) for d in data], "key binary, value binary, p int")
    out = str(tmp_path / "out")
    S.write_records(df.repartitionById(9, "p").sortWithinPartitions("key"), out)
    assert sorted(os.listdir(out)) == [f"partition.{i}" for i in range(9)]
    for i in range(9):
        assert (tmp_path / "out" / f"partition.{i}").read_bytes() == b"".join(sorted(d for d in data if d[0] % 7 == i))
    with pytest.raises(Exception, match="output already"):
        S.write_records(df, out)
    S.write_records(df.coalesce(1), out, overwrite=True)
    assert os.listdir(out) == ["partition.0"]


def test_write_text(spark, tmp_path):
    data = make(5)
    df = spark.createDataFrame([(d[:10], d[10:]) for d in data], "key binary, value binary").coalesce(1)
    for path, kind in ((str(tmp_path / "a.txt"), None), (str(tmp_path / "b"), "ascii")):
        S.write_records(df, path, kind)
        assert open(f"{path}/partition.0").read() == "".join(f"{d[:10].hex()} {d[10:].hex()}\n".upper() for d in data)
    assert S.output_format("x.ascii", None) == "ascii" and S.output_format("x", None) == "binary"


def test_a_bad_record_leaves_no_output(spark, tmp_path):
    df = spark.createDataFrame([(b"short", b"v" * 90)], "key binary, value binary")
    with pytest.raises(Exception, match="10 bytes"):
        S.write_records(df, str(tmp_path / "out"))
    assert S.list_outputs(str(tmp_path / "out")) == [] and not [f for f in os.listdir(tmp_path / "out")]


def test_outputs_are_listed_by_number_and_whole_name(tmp_path):
    for name in ("partition.10", "partition.9", "partition.3.tmp", "xpartition.1", "partition.1"):
        put(tmp_path / name, b"")
    assert [n for n, _ in S.list_outputs(str(tmp_path))] == [1, 9, 10]


def _texts(n, seed, mixed=True):
    """Lines of several kinds and ends, good ones only."""
    r = random.Random(seed)
    out = []
    for d in make(n, seed):
        line = f"{d[:10].hex()} {d[10:].hex()}" if r.random() < 0.7 else "r" * r.randint(98, 100)
        out.append((line.upper() if r.random() < 0.3 else line) + (r.choice(["\n", "\r\n", "\r"]) if mixed else "\n"))
    return out


@pytest.mark.parametrize("bad", [None, 0, 1, 57, 199])
@pytest.mark.parametrize("mixed", [True, False])
def test_text_files_are_read_in_splits(spark, tmp_path, bad, mixed):
    """Whatever the splits, a text file gives its lines up to the first that is no record, each once."""
    lines = _texts(200, 4, mixed)
    text = "".join(lines if bad is None else [*lines[:bad], "TOO SHORT\n", *lines[bad:], "bad\n", *lines[:3]])
    put(tmp_path / "t", (text if bad is None else text.rstrip("\r\n")).encode())
    put(tmp_path / "u", "".join(lines[:5]).encode())
    want = sorted(S._parse(x.strip("\r\n")) for x in [*lines[:bad], *lines[:5]])
    assert load(S.read_records(spark, str(tmp_path), "ascii", position=True)) == want
    for size in (64, 203, 1000, 20_011):
        df = S.read_records(spark, str(tmp_path), "ascii", split_bytes=size)
        assert load(df) == want
    if bad is None:
        assert df.rdd.getNumPartitions() > 2


def test_splits_of_text_begin_at_lines(tmp_path):
    """For every cut of a file into two, its halves hold each line once."""
    text = "".join(_texts(4, 9)).encode()
    path = put(tmp_path / "t", text)
    whole = b"".join(d for _, d in S._ranges(S.Split(path, "ascii", 0, -1)))
    for cut in range(1, len(text)):
        halves = [b"".join(d for _, d in S._ranges(S.Split(path, "ascii", a, n))) for a, n in ((0, cut), (cut, len(text) - cut))]
        assert b"".join(halves) == whole


def test_a_sample_reads_blocks(spark, tmp_path):
    data = make(20_000)
    put(tmp_path / "a.dat", b"".join(data))
    read = lambda seed: load(S.read_records(spark, str(tmp_path), "binary", split_bytes=500_000, sample_rate=0.1, seed=seed))
    found = read(1)
    assert found == read(1) != read(2) and 1500 < len(found) < 2600 and set(found) <= set(data) and len(set(found)) == len(found)
    opened = []

    class File:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            opened.append(n)
            return self.f.read(n)

    class System:
        def open_input_file(self, path):
            return File(open(path, "rb"))

    old, S.located = S.located, lambda path: (System(), path)
    try:
        list(S._sampled(S.Split(str(tmp_path / "a.dat"), "binary", 0, 20_000), 0.01, 3))
    finally:
        S.located = old
    assert sum(opened) <= 0.02 * len(data) * 100


def test_a_commit_that_was_cut_short_is_finished(spark, tmp_path, monkeypatch):
    """The driver is lost amid an overwrite: neither the old outputs nor the new are, and the next look ends it."""
    out = str(tmp_path / "out")
    old, new = make(20, 1), make(30, 2)
    frame = lambda rows, n: spark.createDataFrame([(d[:10], d[10:]) for d in rows], "key binary, value binary").repartition(n)
    S.write_records(frame(old, 3), out)
    monkeypatch.setattr(S, "finish", lambda path: 0)
    writer = S.RecordWriter({"path": out}, True)
    staged = tmp_path / "out" / writer.stage.rsplit("/", 1)[1]
    for i in range(2):
        put(staged / f"{i}-7", b"".join(new[i * 15 : (i + 1) * 15]))
    monkeypatch.setattr(writer, "_clear", lambda: None)
    writer.commit([S.Written(f"{writer.stage}/{i}-7", i, 15) for i in range(2)])
    assert [n for n, _ in S.list_outputs(out)] == [0, 1, 2]  # nothing has moved yet
    monkeypatch.undo()
    os.replace(staged / "0-7", tmp_path / "out" / "partition.0")  # one move was done
    assert S.finish(out) == 1 and S.finish(out) == 0
    assert sorted(os.listdir(out)) == ["partition.0", "partition.1"]
    assert load(S.read_records(spark, out, "binary")) == sorted(new)


def test_counts_by_file(spark, tmp_path):
    put(tmp_path / "a", b"".join(make(5)))
    put(tmp_path / "b", b"x" * 50)
    assert [(os.path.basename(r.path), r.records) for r in S.count_by_file(spark, str(tmp_path), "binary").collect()] == [("a", 5)]
