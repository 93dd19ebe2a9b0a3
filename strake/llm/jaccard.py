"""N-gram Jaccard join with Bayesian pruning of candidates (BayesLSH-Lite).

1. A document is the set of its word 5-grams, as 64-bit hashes. Documents with
   equal sets are copies and form one text; from here on texts are joined.
2. A text has 96 MinHash values of 16 bits; four make one of 24 band keys. Texts
   that share a band key are candidates (two texts at 0.8 share none with
   probability 3e-6).
3. Candidates must have sizes that can reach the threshold: the smaller set at
   least that part of the larger. Their MinHash values are compared 16 at a time. With m of n equal and a
   uniform prior the similarity is Beta(m + 1, n - m + 1); a pair is dropped as
   soon as the probability that it reaches the threshold is below the tolerance.
4. What is left joins texts into clusters. Within a cluster all pairs pass the
   same test again, and those that stay are verified by exact intersection.

A bucket or cluster with more than ``BLOCK`` texts is cut into blocks, and pairs
of blocks are dealt to different tasks, so no task holds an unbounded group.
Pairs are never rows: a task returns, for each text, how many links it found and
one linked text, enough to join the tasks' forests into classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .components import components
from .scratch import cut, width

NGRAM = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
TOLERANCE = 1e-9
STEP = 16
BLOCK = 256
#: N-grams of a text of usual length; longer texts make blocks of fewer.
HEAVY = 1000
#: Sizes of up to so many clusters over a block are broadcast (16 bytes each); more are joined.
BROADCAST_CLUSTERS = 100_000
_PLACE = K.mix64(np.arange(1, 65, dtype=np.uint64))
_XOR = K.mix64(np.arange(1000, 1000 + HASHES, dtype=np.uint64))
_ODD = K.mix64(np.arange(5000, 5000 + HASHES, dtype=np.uint64)) | np.uint64(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For 16, 32, ... compared values, the fewest equal ones with which a pair goes on."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        reach = np.cumsum([math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(n + 1)])
        out[n] = int(np.argmax(reach >= tolerance))
    return out


def shingles(buf: np.ndarray, starts: np.ndarray, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word n-gram; a text with fewer words has one of all its words."""
    low = K.LOWER[buf]
    ws, we, row = K.words(low, starts, K.TOKEN)
    h = K.span_hashes(low, ws, we)
    n = K.counts_by_row(row, len(starts))
    ends = np.cumsum(n)
    left = np.minimum(ends[row] - np.arange(len(row)), ngram) if len(row) else row
    heads = (left == ngram) | ((n[row] < ngram) & (np.arange(len(row)) == (ends - n)[row])) if len(row) else np.zeros(0, bool)
    at, size = np.flatnonzero(heads), left[heads]
    out = size.astype(np.uint64)
    for k in range(ngram):
        ok = size > k
        out[ok] += h[at[ok] + k] * (_PLACE[k] | np.uint64(1))
    return K.mix64(out), row[at]


def _sets(texts: pa.Array, ngram: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted set of shingles of each text that has any."""
    for i, j, buf, starts, _ in K.pieces(texts):
        g, row = shingles(buf, starts, ngram)
        at = np.searchsorted(row, np.arange(j - i + 1))
        for k in np.flatnonzero(np.diff(at)):
            yield i + int(k), np.unique(g[at[k] : at[k + 1]])


def set_key(own: np.ndarray) -> np.uint64:
    return np.add.reduce(K.mix64(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _signer(ngram: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, key = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            low = np.zeros((n, HASHES), np.uint64)
            group: list[tuple[int, np.ndarray]] = []

            def flush(group=group, low=low):
                if not group:
                    return
                rows = np.array([r for r, _ in group])
                g = np.concatenate([s for _, s in group])
                at = np.r_[0, np.cumsum([len(s) for _, s in group])[:-1]]
                work = np.empty_like(g)
                for k in range(HASHES):
                    np.bitwise_xor(g, _XOR[k], out=work)
                    np.multiply(work, _ODD[k], out=work)
                    low[rows, k] = np.minimum.reduceat(work, at)
                group.clear()

            held = 0
            for r, own in _sets(batch.column("text"), ngram):
                size[r], key[r] = len(own), set_key(own)
                group.append((r, own))
                held += len(own)
                if held > 1 << 17:
                    flush()
                    held = 0
            flush()
            bands = (K.mix64(low) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key.view(np.int64)), pa.array(size), flat], names=["doc_id", "k", "size", "bands"])

    return sign


def surviving(sig: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int], t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows of ``sig`` whose sizes allow a link and which the incremental comparison does not drop."""
    ok = np.minimum(size[a], size[b]) * t.denominator >= t.numerator * np.maximum(size[a], size[b])
    a, b = a[ok], b[ok]
    same = np.zeros(len(a), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        part = sig[:, n - STEP : n]
        same = same + np.count_nonzero(part[a] == part[b], axis=1)
        ok = same >= least[n]
        a, b, same = a[ok], b[ok], same[ok]
    return a, b


def _pairs(side: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a group's rows, some rows at a time: across its two blocks or within its one."""
    rows = np.arange(len(side))
    low, high = (rows[side == side.min()], rows[side == side.max()]) if cross else (rows, rows)
    step = max(1, (1 << 18) // max(1, len(high)))
    for i in range(0, len(low), step):
        a = np.repeat(low[i : i + step], len(high))
        b = np.tile(high, len(low[i : i + step]))
        if not cross:
            a, b = a[a < b], b[a < b]
        yield a, b


class Forest:
    """Union of rows; the smallest row is a tree's root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots()[a], self.roots()[b]
            ok = ra != rb
            a, b, ra, rb = a[ok], b[ok], ra[ok], rb[ok]
            if len(a):
                np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self) -> np.ndarray:
        while not np.array_equal(self.up, nxt := self.up[self.up]):
            self.up = nxt
        return self.up


def _grouped(keys: list[str], work: Callable, names: list[str]):
    """Hands each group of a sorted partition to ``work`` as one table; groups are bounded by their block size."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def run(table: pa.Table):
            columns = [np.asarray(table.column(k).to_numpy()) for k in keys]
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            return np.flatnonzero(new)

        def done(table: pa.Table, cuts: np.ndarray):
            out = work(table, cuts)
            if out is not None and out.num_rows:
                yield from out.select(names).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            cuts = run(rest)
            if len(cuts) > 1:
                yield from done(rest.slice(0, cuts[-1]).combine_chunks(), cuts[:-1])
                rest = rest.slice(cuts[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from done(rest.combine_chunks(), np.zeros(1, np.int64))

    return f


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, BANDS).view(np.uint16)


def _cluster(least: dict[int, int], t: Fraction):
    """Of each bucket (or pair of its blocks), edges that join the texts whose pairs survive."""

    def work(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        k, blk = table.column("k").to_numpy(), table.column("blk").to_numpy()
        cross = table.column("i").to_numpy() != table.column("j").to_numpy()
        sig, size = _signatures(table.column("bands")), table.column("size").to_numpy()
        ends = np.r_[cuts[1:], table.num_rows]
        out_a, out_b = [], []
        small = ends - cuts <= 8
        few_a, few_b = [], []  # pairs of the many small buckets, compared together
        for n in range(2, 9):
            at = cuts[small & (ends - cuts == n)]
            x, y = np.triu_indices(n, 1)
            few_a.append((at[:, None] + x).ravel())
            few_b.append((at[:, None] + y).ravel())
        a, b = np.concatenate(few_a), np.concatenate(few_b)
        keep = ~cross[a] | (blk[a] != blk[b])
        a, b = surviving(sig, size, a[keep], b[keep], least, t)
        out_a.append(k[a])
        out_b.append(k[b])
        for lo, hi in zip(cuts[~small], ends[~small], strict=True):
            forest = Forest(hi - lo)
            if cross[lo] and len(np.unique(blk[lo:hi])) < 2:
                continue
            for a, b in _pairs(blk[lo:hi], bool(cross[lo])):
                forest.join(*surviving(sig[lo:hi], size[lo:hi], a, b, least, t))
            roots = forest.roots()
            order = np.argsort(roots, kind="stable")
            chain = np.flatnonzero(roots[order][1:] == roots[order][:-1])
            out_a.append(k[lo:hi][order[chain]])
            out_b.append(k[lo:hi][order[chain + 1]])
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return work


def _overlaps(sets: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> Callable[[int], np.ndarray]:
    """Of a row of ``low``, its exact intersection with every row of ``high``: an inverted index of the latter."""
    flat = np.concatenate([sets[i] for i in high])
    owner = np.repeat(np.arange(len(high)), [len(sets[i]) for i in high])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    keys, at = np.unique(flat, return_index=True)
    at = np.r_[at, len(flat)]

    def of(i: int) -> np.ndarray:
        p = np.searchsorted(keys, sets[i])
        p = p[p < len(keys)]
        p = p[np.isin(keys[p], sets[i], assume_unique=True)]
        n = at[p + 1] - at[p]
        which = np.repeat(at[p] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.bincount(owner[which], minlength=len(high))

    return of


def _verify(least: dict[int, int], ngram: int, t: Fraction):
    """Of each cluster (or pair of its blocks), for every text the number of links found and a linked text."""

    def linked(shared, x, y):
        return shared * t.denominator >= t.numerator * (x + y - shared)

    def work(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        k, blk = table.column("k").to_numpy(), table.column("blk").to_numpy()
        cross = table.column("i").to_numpy() != table.column("j").to_numpy()
        sig = _signatures(table.column("bands"))
        text = pa.concat_arrays(table.column("text").chunks)
        ends = np.r_[cuts[1:], table.num_rows]
        ids = table.column("id").to_numpy()
        links, parent = np.zeros(table.num_rows, np.int64), ids.copy()
        for lo, hi in zip(cuts, ends, strict=True):
            own = dict(_sets(text[lo:hi], ngram))
            none = np.zeros(0, np.uint64)
            sets = [own.get(r, none) for r in range(hi - lo)]
            # a row that repeats an id with another text has another key: it is not this text
            real = np.array([len(s) > 0 and set_key(s).view(np.int64) == k[lo + r] for r, s in enumerate(sets)])
            seen = np.flatnonzero(real)
            _, once = np.unique(k[lo:hi][seen], return_index=True)  # repeated rows are one text
            real[np.delete(seen, once)] = False
            size = np.array([len(s) for s in sets])
            if cross[lo] and len(np.unique(blk[lo:hi])) < 2:
                continue
            forest = Forest(hi - lo)
            found = np.zeros(hi - lo, np.int64)
            index = None
            for a, b in _pairs(blk[lo:hi], bool(cross[lo])):
                ok = real[a] & real[b]
                a, b = surviving(sig[lo:hi], size, a[ok], b[ok], least, t)
                if not len(a):
                    continue
                if len(a) <= 64:
                    shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
                else:
                    if index is None:
                        index = _overlaps(sets, a, np.arange(hi - lo))
                    shared = np.empty(len(a), np.int64)
                    at = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
                    for x, y in zip(at[:-1], at[1:], strict=True):
                        shared[x:y] = index(a[x])[b[x:y]]
                ok = linked(shared, size[a], size[b])
                a, b = a[ok], b[ok]
                found += np.bincount(a, minlength=hi - lo) + np.bincount(b, minlength=hi - lo)
                forest.join(a, b)
            links[lo:hi] = found
            parent[lo:hi] = ids[lo:hi][forest.roots()]
        return pa.table({"k": k, "id": ids, "other": parent, "links": links})

    return work


def _dealt(rows: DataFrame, count: str, block: int) -> DataFrame:
    """Rows of a group as blocks and pairs of blocks: one pair (0, 0) for most, all pairs for groups over ``block``.

    A row goes to each of its group's blocks once, so blocks of very large groups
    are larger, up to sixteen times.
    """
    each = F.greatest(F.lit(block), F.least(F.lit(16 * block), F.ceil(F.col(count) / F.lit(32))))
    n = F.ceil(F.col(count) / each).cast("int")
    mine = rows.withColumn("blk", F.pmod(F.xxhash64("k", F.lit(7)), n).cast("int"))
    each = mine.withColumn("o", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", count)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, tolerance: float = TOLERANCE, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of word n-grams
    (white-space words, ASCII letters lower-cased) is at least ``threshold``; a
    text of fewer words has one n-gram of all. ``class_id`` is the smallest id
    among the documents that links and copies connect, ``n_links`` the number of
    other texts linked to this one, each counted once however many copies it
    has, ``n_copies`` the rows with this very set. A null or empty text has no
    n-gram: class of its own, no links, n_copies 1. Rows without id are
    copies of nothing and linked to nothing; their class is null. Rows that
    repeat an id and a text are copies. An empty table gives no rows.
    """
    n = width(docs, partitions)
    least, t = least_matches(threshold, tolerance), Fraction(threshold).limit_denominator(10_000)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = cut(read.mapInArrow(_signer(ngram), "doc_id long, k long, size long, bands array<long>"), "signatures")
    texts = signed.filter("size > 0 and doc_id is not null").groupBy("k").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = cut(texts, "texts")

    band = texts.select("k", F.posexplode("bands").alias("b", "v")).select("k", F.xxhash64("b", "v").alias("bucket"))
    shared = band.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    members = _dealt(band.join(shared, "bucket"), "c", block).join(texts.select("k", "size", "bands"), "k")
    order = ["bucket", "i", "j"]
    placed = members.repartition(n, *order).sortWithinPartitions(*order)
    edges = placed.select(*order, "blk", "k", "size", "bands").mapInArrow(_grouped(order, _cluster(least, t), ["a", "b"]), "a long, b long")
    clusters = cut(components(edges).withColumnsRenamed({"node": "k", "root": "cluster"}), "clusters")

    members = cut(clusters.join(texts.select("k", "id", "size", "bands"), "k"), "members")
    # a cluster counts by its texts, or by its n-grams if they are many; only those over a block need to be known,
    # and there is at most one of these for each ``block`` texts or ``block * HEAVY`` n-grams
    weight = F.greatest(F.count("*"), F.ceil(F.sum("size") / HEAVY)).cast("long")
    large = cut(members.groupBy("cluster").agg(weight.alias("c")).filter(F.col("c") > block), "large")
    sized = members.join(F.broadcast(large) if large.count() <= BROADCAST_CLUSTERS else large, "cluster", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    members = _dealt(sized, "c", block).drop("size")
    members = members.join(read.withColumnRenamed("doc_id", "id"), "id")
    order = ["cluster", "i", "j"]
    placed = members.repartition(n, *order).sortWithinPartitions(*order, "k")
    names = ["k", "id", "other", "links"]
    verified = cut(placed.select(*order, "blk", "k", "id", "bands", "text").mapInArrow(_grouped(order, _verify(least, ngram, t), names), "k long, id long, other long, links long"), "links")

    links = verified.groupBy("k").agg(F.sum("links").alias("n_links"))
    # nodes are ids here, so a class's root is its smallest id
    classes = components(verified.select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "id", "root": "class"})
    known = texts.select("k", "id", "n_copies").join(links, "k", "left").join(classes, "id", "left")
    known = cut(known.select("k", F.coalesce("class", "id").alias("class"), "n_links", "n_copies"), "known")
    own = F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("k"))
    rows = signed.select("doc_id", own.alias("k")).join(known, "k", "left")
    return rows.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, with all their columns; rows without id stay."""
    dropped = near_duplicates(docs, threshold, ngram).filter("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
