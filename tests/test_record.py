"""Records, their text forms, and the detection of formats."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strake.functions import record as R


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_serialize_round_trip(spark):
    key, value = bytes(range(10)), bytes(range(90))
    df = spark.createDataFrame([(key, value)], R.SCHEMA)
    back = df.select(R.deserialize(R.serialize(F.col("key"), F.col("value"))).alias("r")).first().r
    assert bytes(back.key) == key and bytes(back.value) == value


@pytest.mark.parametrize("size", [0, 99, 101])
def test_deserialize_takes_exactly_a_record(spark, size):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(b"x" * size,)], "r binary").select(R.deserialize(F.col("r"))).collect()


def test_valid_lengths(spark):
    rows = [(b"k" * 10, b"v" * 90), (b"k" * 9, b"v" * 90), (b"k" * 10, b"v" * 91), (None, b"v" * 90)]
    df = spark.createDataFrame(rows, "key binary, value binary")
    assert [r[0] for r in df.select(R.valid(F.col("key"), F.col("value"))).collect()] == [True, False, False, False]


def test_keys_are_ordered_as_unsigned_bytes(spark):
    keys = [b"\x7f" + b"\0" * 9, b"\x80" + b"\0" * 9, b"\xff" * 10, b"\0" * 10, b"\x7f\xff" + b"\0" * 8]
    df = spark.createDataFrame([(k,) for k in keys], "key binary")
    assert [bytes(r.key) for r in df.orderBy("key").collect()] == sorted(keys)


def test_boundary_record(spark):
    b = one(spark, R.boundary(F.col("k")), k=bytearray(b"0123456789"))
    assert bytes(b.key) == b"0123456789" and bytes(b.value) == b"\0" * 90


def line(spark, text):
    row = spark.createDataFrame([(text,)], "line string").select(R.line_kind(F.col("line")).alias("k"), R.parse_line(F.col("line")).alias("r")).first()
    return row.k, row.r and (bytes(row.r.key), bytes(row.r.value))


def test_hex_lines_of_either_case(spark):
    data = bytes(range(100))
    text = f"{data[:10].hex()} {data[10:].hex()}"
    mixed = "".join(c.upper() if i % 2 else c for i, c in enumerate(text))
    for t in (text, text.upper(), mixed):
        assert line(spark, t) == ("hex", (data[:10], data[10:]))


def test_hex_line_is_upper_case(spark):
    df = spark.createDataFrame([(b"\xab" * 10, b"\xcd" * 90)], R.SCHEMA)
    assert df.select(R.hex_line(F.col("key"), F.col("value"))).first()[0] == "AB" * 10 + " " + "CD" * 90


@pytest.mark.parametrize("size", [98, 99, 100])
def test_raw_lines_are_filled_up(spark, size):
    text = "é" + "x" * (size - 1)
    key, value = text.encode("latin-1")[:10], text.encode("latin-1")[10:]
    assert line(spark, text) == ("raw", (key, value.ljust(90, b"\0")))


@pytest.mark.parametrize("text", ["", "TOOSHORT", "x" * 97, "x" * 101, "Z" * 20 + " " + "0" * 180, "0" * 201, "0" * 20 + " " + "0" * 179 + "g"])
def test_lines_that_are_no_record(spark, text):
    assert line(spark, text) == (None, None)


@pytest.mark.parametrize(("text", "want"), [("00ff", b"\0\xff"), ("0", None), ("0g", None), ("", b""), ("aB", b"\xab")])
def test_decode_hex(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(R.decode_hex(F.col("t"))).first()[0]
    assert (got if got is None else bytes(got)) == want


@pytest.mark.parametrize(
    ("head", "want"),
    [
        (b"", "binary"),
        (b"A" * 950 + b"\xff" * 50, "ascii"),
        (b"A" * 900 + b"\xff" * 100, "binary"),
        (b"A" * 901 + b"\xff" * 99, "ascii"),
        (b" \n\r" * 300, "ascii"),
        (b"a\tb\t" * 250, "binary"),
        (bytes(range(256)) * 4, "binary"),
        (b"A" * 1000 + b"\0" * 5000, "ascii"),
    ],
)
def test_detection(spark, head, want):
    kind, share, n = R.detect_bytes(head)
    assert kind == want and n == min(len(head), 1000) and 0 <= share <= 1
    text = head[:1000].decode("latin-1")
    assert spark.createDataFrame([(text,)], "t string").select(R.detected(F.col("t"))).first()[0] == want
