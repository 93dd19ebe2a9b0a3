"""The record: a key of 10 bytes and a value of 90, in three physical forms.

Binary files hold ``key || value`` without delimiters. Hex lines hold 20 hex
digits, a space and 180 hex digits. Raw lines hold 98 to 100 ISO-8859-1
characters, the value filled up with zero bytes. Keys are ordered as unsigned
bytes, which is how Spark orders BINARY.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, VALUE = 10, 90
SIZE = KEY + VALUE
HEX_LINE = 2 * SIZE + 1
RAW_LINE = (98, 100)
#: A file whose first bytes are printable beyond this share is text.
HEAD, TEXT_SHARE = 1000, 0.9
SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
PLACED = T.StructType([*SCHEMA.fields, T.StructField("path", T.StringType(), False), T.StructField("record_index", T.LongType(), False)])

_ZERO = bytearray(1)


def serialize(key: Column, value: Column) -> Column:
    """The 100 bytes of a record."""
    return F.concat(key, value)


def deserialize(record: Column) -> Column:
    """struct(key, value) of exactly 100 bytes; anything else is an error."""
    ok = F.octet_length(record) == SIZE
    parts = F.struct(F.substring(record, 1, KEY).alias("key"), F.substring(record, KEY + 1, VALUE).alias("value"))
    return F.when(ok, parts).otherwise(F.raise_error(F.lit(f"a record has {SIZE} bytes")))


def valid(key: Column, value: Column) -> Column:
    """Whether both parts have their lengths."""
    return F.coalesce((F.octet_length(key) == KEY) & (F.octet_length(value) == VALUE), F.lit(False))


def boundary(key: Column) -> Column:
    """A record that stands for a key alone: its value is zero bytes."""
    return F.struct(key.alias("key"), F.lit(bytearray(VALUE)).alias("value"))


def hex_line(key: Column, value: Column) -> Column:
    """A record as a hex line, upper case."""
    return F.concat_ws(" ", F.hex(key), F.hex(value))


def decode_hex(text: Column) -> Column:
    """Bytes of an even number of hex digits of either case, else null."""
    return F.when(text.rlike(r"\A([0-9A-Fa-f]{2})*\z"), F.unhex(text))


def line_kind(line: Column) -> Column:
    """hex, raw, or null for a line that is no record."""
    n = F.length(line)
    hexed = (n == HEX_LINE) & (F.substring(line, 2 * KEY + 1, 1) == " ")
    good = F.substring(line, 1, 2 * KEY).rlike(r"\A[0-9A-Fa-f]*\z") & F.substring(line, 2 * KEY + 2, 2 * VALUE).rlike(r"\A[0-9A-Fa-f]*\z")
    return F.when(hexed & good, "hex").when(n.between(*RAW_LINE), "raw")


def parse_line(line: Column) -> Column:
    """struct(key, value) of a text line, null if it is no record."""
    kind = line_kind(line)
    raw = F.encode(line, "ISO-8859-1")
    hexed = F.struct(F.unhex(F.substring(line, 1, 2 * KEY)).alias("key"), F.unhex(F.substring(line, 2 * KEY + 2, 2 * VALUE)).alias("value"))
    plain = F.struct(F.substring(raw, 1, KEY).alias("key"), F.rpad(F.substring(raw, KEY + 1, VALUE), VALUE, F.lit(_ZERO)).alias("value"))
    return F.when(kind == "hex", hexed).when(kind == "raw", plain)


def head_of(text: Column) -> Column:
    """The first bytes of a text (null: none), one character a byte."""
    return F.decode(F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, HEAD), "ISO-8859-1")


def printable_share(head: Column) -> Column:
    """Share of printable bytes (0x20 to 0x7E, LF, CR; not TAB) in a head, one character a byte; null if empty."""
    n = F.length(head)
    return F.when(n > 0, F.length(F.regexp_replace(head, "[^\\x20-\\x7E\\n\\r]", "")) / n)


def detected(head: Column) -> Column:
    """ascii if over nine tenths of the head are printable, else binary; empty is binary."""
    return F.when(F.coalesce(printable_share(head), F.lit(0.0)) > TEXT_SHARE, "ascii").otherwise("binary")


def detect_bytes(head: bytes) -> tuple[str, float, int]:
    """Format, printable share and number of bytes looked at, of a file's beginning."""
    head = head[:HEAD]
    if not head:
        return "binary", 0.0, 0
    share = sum(0x20 <= b <= 0x7E or b in (10, 13) for b in head) / len(head)
    return ("ascii" if share > TEXT_SHARE else "binary"), share, len(head)
