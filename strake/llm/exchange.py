"""Blocks of documents that ask buckets of keys, and get answers.

Some operators need, for each of very many keys in a document, something that
is known only from all documents: how often the key occurs, or who has it
first. Rows for each key would be far larger than the texts. Here documents are
dealt into blocks; a block sends the distinct keys that it has of each bucket; a
bucket answers every block. A key that occurs in all documents is thus sent once
a block, not once an occurrence. Answers meet the block's documents again in a
cogroup on the block. All uses of the documents are the same exchange, which
Spark runs once.

There are two blocks and one bucket for each of n partitions. Partitions are the
session's shuffle width, but at least one for each 128 MB read, so blocks stay
small however the session is set. Up to ``DIRECT`` buckets a block sends each one
a packed row. Beyond that, rows would be as many as the square of the input's
size, so they go by relays: a block sends one row to each of some sqrt(n) groups
of buckets, a relay (a group of blocks and a group of buckets) sends each of its
buckets one row with what all its blocks ask, and answers come back in the same
way. Each of the four steps then has about n * sqrt(n) rows, and what a block and
a bucket say to each other is the same, packed with its neighbours'. Blocks and
buckets have numbers that Spark's hash deals evenly to the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import width

BLOCKS = 2
#: Up to so many buckets, blocks and buckets send each other rows of their own.
DIRECT = 1024
#: Beyond so many, keys are plain numbers: dealt evenly but for chance.
CHOSEN = 20_000
ROWS = "key long, frm long, payload binary"
#: Values of many receivers or senders in a row, and how many each has.
Column = tuple[np.ndarray, np.ndarray]


def _murmur3(keys: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of a long, by which it deals rows to partitions."""
    m = np.uint64(0xFFFFFFFF)

    def turn(x, r):
        return (x << np.uint64(r) | x >> np.uint64(32 - r)) & m

    h = np.full(len(keys), seed, np.uint64)
    wide = keys.astype(np.uint64)
    for part in (wide & m, wide >> np.uint64(32)):
        k = turn(part * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593) & m
        h = (turn(h ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
    h ^= np.uint64(8)
    h = (h ^ h >> np.uint64(16)) * np.uint64(0x85EBCA6B) & m
    h = (h ^ h >> np.uint64(13)) * np.uint64(0xC2B2AE35) & m
    return (h ^ h >> np.uint64(16)).astype(np.uint32).view(np.int32)


def even_keys(n: int, each: int = 1) -> Sequence[int]:
    """n * each numbers of which Spark's hash deals ``each`` to every one of n partitions."""
    if n * each > CHOSEN:
        return range(n * each)
    found: list[list[int]] = [[] for _ in range(n)]
    left, start = n * each, 0
    while left:
        keys = np.arange(start, start + 4 * n * each)
        for key, p in zip(keys.tolist(), (_murmur3(keys).astype(np.int64) % n).tolist(), strict=True):
            if len(found[p]) < each:
                found[p].append(key)
                left -= 1
        start += len(keys)
    return [k for ks in found for k in ks]


def in_blocks(docs: DataFrame, partitions: int | None = None, direct: int = DIRECT) -> tuple[DataFrame, Route]:
    """blk, doc_id, text dealt by block, and the way to the buckets; ids that are null are dealt by their text."""
    n = width(docs, partitions)
    keys = even_keys(n, BLOCKS)
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(len(keys)))
    blk = place if isinstance(keys, range) else F.element_at(F.lit(list(keys)), (place + 1).cast("int")).cast("long")
    rows = docs.select(blk.alias("blk"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.repartition(n, "blk"), Route(keys, even_keys(n), direct)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed payload."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True)
        parts.append(a.dtype.str.encode().ljust(8) + np.array([len(raw), len(small)], np.int64).tobytes() + small)
    return b"".join(parts)


def unpack(payload: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(payload):
        dtype = np.dtype(payload[at : at + 8].decode().strip())
        raw, small = np.frombuffer(payload, np.int64, 2, at + 8)
        at += 24
        out.append(np.frombuffer(pa.decompress(memoryview(payload)[at : at + small], int(raw), "zstd"), dtype))
        at += int(small)
    return out


def one(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    column = table.column(name)
    if column.num_chunks == 1:
        return column.chunk(0)
    if pa.types.is_string(column.type) and column.nbytes >= 1 << 31:
        column = column.cast(pa.large_string())
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def bundle(ids: np.ndarray, columns: list[Column]) -> bytes:
    """What several receivers get, or several senders say, as one payload."""
    return pack(np.asarray(ids, np.int64), *(a for data, sizes in columns for a in (sizes.astype(np.int64), data)))


def opened(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[Column]]:
    """The ids of some bundles, which bundle each is in, and their columns."""
    found = [unpack(p) for p in payloads]
    ids = np.concatenate([f[0] for f in found])
    at = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    return ids, at, [(np.concatenate([f[k + 1] for f in found]), np.concatenate([f[k] for f in found])) for k in range(1, len(found[0]), 2)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def taken(columns: list[Column], order: np.ndarray) -> list[Column]:
    """Columns whose receivers or senders are put in another order."""
    return [(data[ragged((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]) for data, sizes in columns]


def _parts(ids: np.ndarray, columns: list[Column]):
    """(id, first, last, columns) of each run of equal ids."""
    cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
    ends = [np.r_[0, np.cumsum(sizes)] for _, sizes in columns]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(ids[a]), a, b, [(data[e[a] : e[b]], sizes[a:b]) for (data, sizes), e in zip(columns, ends, strict=True)]


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"key": pa.array([r[0] for r in rows], pa.int64()), "frm": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})


class Route:
    """The way from blocks to buckets and back. Buckets are named by their place, 0 to n - 1, blocks by their number."""

    def __init__(self, blocks: Sequence[int], names: Sequence[int], direct: int = DIRECT):
        self.blocks, self.names, self.n = blocks, names, len(names)
        self.hops = self.n > direct
        self.per = math.isqrt(self.n - 1) + 1  # buckets of a group
        self.many = -(-len(blocks) // self.per)  # blocks of a group
        self.place = None if isinstance(blocks, range) else {b: i for i, b in enumerate(blocks)}

    def _group(self, blk: int) -> int:
        return (blk if self.place is None else self.place[blk]) // self.many

    def asks(self, blk: int, columns: list[Column], every: bool = False) -> pa.Table:
        """The rows that a block sends; columns hold, for each bucket in turn, what it is asked. ``every``: empty asks are sent too."""
        some = np.ones(self.n, bool) if every else sum(sizes for _, sizes in columns) > 0
        ends = [np.r_[0, np.cumsum(sizes)] for _, sizes in columns]
        step = self.per if self.hops else 1
        rows = []
        for a in range(0, self.n, step):
            b = min(a + step, self.n)
            at = a + np.flatnonzero(some[a:b])
            if not len(at):
                continue
            mine = [(data[e[a] : e[b]], sizes[at]) for (data, sizes), e in zip(columns, ends, strict=True)]
            if self.hops:
                rows.append((a // step * len(self.blocks) + self._group(blk), blk, bundle(at, mine)))
            else:
                rows.append((self.names[a], blk, bundle(np.array([blk]), mine)))
        return _table(rows)

    def _relay(self, rows: DataFrame, key_of: Callable[[int], int]) -> DataFrame:
        def f(table: pa.Table) -> pa.Table:
            via = table.column("key")[0].as_py()
            order = np.argsort(table.column("frm").to_numpy(), kind="stable")
            ids, at, columns = opened([table.column("payload")[int(i)].as_py() for i in order])
            frm = table.column("frm").to_numpy()[order][at]
            order = np.argsort(ids, kind="stable")
            frm = frm[order]
            return _table([(key_of(i), via, bundle(frm[a:b], mine)) for i, a, b, mine in _parts(ids[order], taken(columns, order))])

        return self._dealt(rows).groupBy("key").applyInArrow(f, ROWS)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by key to n tasks, where the session would deal them to fewer."""
        return rows.repartition(self.n, "key") if self.n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows

    def answer(self, asked: DataFrame, answers: Callable[[list[Column]], list[Column]]) -> DataFrame:
        """key (a block), frm, payload: the answers to each block. answers: of what one bucket is asked, by block, what it answers each."""
        place = {name: i for i, name in enumerate(self.names)} if not isinstance(self.names, range) else None
        names = self.names

        def f(table: pa.Table) -> pa.Table:
            name = table.column("key")[0].as_py()
            bucket = name if place is None else place[name]
            blk, _, columns = opened(table.column("payload").to_pylist())
            order = np.argsort(blk, kind="stable")
            blk, replies = blk[order], answers(taken(columns, order))
            if not self.hops:
                return _table([(b, bucket, bundle(np.array([bucket]), mine)) for b, _, _, mine in _parts(blk, replies)])
            group = np.array([self._group(b) for b in blk.tolist()], np.int64)
            order = np.argsort(group, kind="stable")
            return _table([(bucket // self.per * len(self.blocks) + g, bucket, bundle(blk[order][a:b], mine)) for g, a, b, mine in _parts(group[order], taken(replies, order))])

        if self.hops:
            asked = self._relay(asked, lambda i: names[i])
        replies = self._dealt(asked).groupBy("key").applyInArrow(f, ROWS)
        return self._relay(replies, lambda blk: blk) if self.hops else replies


def heard(table: pa.Table) -> list[Column] | None:
    """The answers to a block, bucket by bucket; None if there are none."""
    if not table.num_rows:
        return None
    ids, _, columns = opened(table.column("payload").to_pylist())
    return taken(columns, np.argsort(ids, kind="stable"))
