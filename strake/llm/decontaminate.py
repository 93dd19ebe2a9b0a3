"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``window`` words (one shorter window if it has
fewer). A window counts as contained only if all its words are there, so one
prefix token is necessary: its rarest word, by the words' counts over the whole
corpus. Documents are joined to windows on that token alone; a pair must then
keep the positional bound (the window may not begin before the document) and the
length bound (nor end after it), and is verified word by word.

The windows are the stated query set. They are sent to the executors in chunks
of counted size, one after the other over the same rows, so a larger benchmark
takes more passes and not more memory. Items of one text are one entry, and a
running sum of sizes cuts the chunks, so no chunk has over twice its bytes unless
one item alone has. No document is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .scratch import cut

#: Bytes of benchmark text that are sent to the executors at once (their index has some ten times as much).
CHUNK_BYTES = 8_000_000
_FILTER = 1 << 20


class Index:
    """Windows of some texts, by prefix token; items: (ids, text)."""

    def __init__(self, items: list[tuple[list, str | None]], window: int):
        buf, starts, _ = K.joined([t for _, t in items])
        low = K.LOWER[buf]
        ws, we, row = K.words(low, starts, K.ALNUM)
        self.hashes = K.span_hashes(low, ws, we)
        self.names = [[None if i is None else str(i) for i in ids] for ids, _ in items]
        self.vocabulary = np.unique(self.hashes)
        self.window = window
        n = K.counts_by_row(row, len(items))
        first = np.r_[0, np.cumsum(n)[:-1]]
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        at = first[item] + np.arange(len(item)) - np.r_[0, np.cumsum(count)[:-1]][item]
        length = size[item]
        words = np.zeros((len(at), window), np.uint64)
        for j in range(window):
            ok = length > j
            words[ok, j] = self.hashes[at[ok] + j]
        keyed = np.column_stack([words, length.astype(np.uint64)])
        unique, which = np.unique(keyed, axis=0, return_inverse=True) if len(at) else (keyed, np.zeros(0, np.int64))
        self.words, self.length = unique[:, :-1], unique[:, -1].astype(np.int64)
        order = np.lexsort((item, which.ravel()))
        self.owner_items = item[order]
        self.owner_at = np.searchsorted(which.ravel()[order], np.arange(len(unique) + 1))

    def order_by_rarity(self, counts: np.ndarray) -> Index:
        """Picks each window's prefix token, given the corpus count of each word of the vocabulary."""
        n = len(self.words)
        place = np.searchsorted(self.vocabulary, self.words) if n else np.zeros((0, self.window), np.int64)
        count = counts[np.minimum(place, max(0, len(counts) - 1))].astype(float) if n else np.zeros((0, self.window))
        count[np.arange(self.window)[None, :] >= self.length[:, None]] = np.inf
        offset = count.argmin(axis=1) if n else np.zeros(0, np.int64)
        prefix = self.words[np.arange(n), offset]
        order = np.argsort(prefix, kind="stable")
        self.keys, self.key_at = np.unique(prefix[order], return_index=True)
        self.key_at = np.r_[self.key_at, n]
        self.by_key, self.offset = order, offset
        self.filter = np.zeros(_FILTER, bool)
        self.filter[self.keys & np.uint64(_FILTER - 1)] = True
        return self

    def find(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of all occurrences; first and last bound each word's document."""
        none = np.zeros(0, np.int64)
        if not len(self.keys):
            return none, none
        maybe = np.flatnonzero(self.filter[hashes & np.uint64(_FILTER - 1)])
        key = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        real = self.keys[key] == hashes[maybe]
        maybe, key = maybe[real], key[real]
        many = self.key_at[key + 1] - self.key_at[key]
        which = np.repeat(np.arange(len(maybe)), many)
        window = self.by_key[self.key_at[key][which] + np.arange(len(which)) - np.r_[0, np.cumsum(many)[:-1]][which]] if len(which) else none
        word = maybe[which]
        start = word - self.offset[window]
        fits = (start >= first[word]) & (start + self.length[window] <= last[word])
        start, window = start[fits], window[fits]
        for j in range(self.window):
            same = (self.length[window] <= j) | (hashes[np.minimum(start + j, len(hashes) - 1)] == self.words[window, j])
            start, window = start[same], window[same]
        return start, window


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("doc").field("text")


def _counter(vocabulary):
    """Counts the benchmark's words in documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        sums = np.zeros(len(known), np.int64)
        quick = np.zeros(_FILTER, bool)
        quick[known & np.uint64(_FILTER - 1)] = True
        for batch in batches:
            for _, _, buf, starts, _ in K.pieces(batch.column("text")):
                low = K.LOWER[buf]
                ws, we, _ = K.words(low, starts, K.ALNUM)
                h = K.span_hashes(low, ws, we)
                h = h[quick[h & np.uint64(_FILTER - 1)]]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                sums += np.bincount(at[known[at] == h], minlength=len(known))
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums[found], pa.int64())], names=["word", "n"])

    return count


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _finder(index, names: list[str], drop_text: bool):
    """Adds the hits of one chunk of windows to n_words, spans and items of each row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans = batch.column("spans").to_pylist()
            items = batch.column("items").to_pylist()
            for i, j, buf, starts, _ in K.pieces(_texts(batch)):
                low = K.LOWER[buf]
                ws, we, row = K.words(low, starts, K.ALNUM)
                n = K.counts_by_row(row, j - i)
                n_words[i:j] = n
                ends = np.cumsum(n)
                start, window = ix.find(K.span_hashes(low, ws, we), (ends - n)[row], ends[row])
                if not len(start):
                    continue
                mine = row[start]
                order = np.argsort(mine, kind="stable")
                start, window, mine = start[order], window[order], mine[order]
                cuts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1], True])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    r, base = i + mine[a], (ends - n)[mine[a]]
                    lo = start[a:b] - base
                    hi = lo + ix.length[window[a:b]]
                    old = spans[r]
                    spans[r] = _merge([*zip(old[::2], old[1::2], strict=True), *zip(lo.tolist(), hi.tolist(), strict=True)])
                    own = set(items[r])
                    for w in np.unique(window[a:b]):
                        for k in ix.owner_items[ix.owner_at[w] : ix.owner_at[w + 1]]:
                            own.update(ix.names[k])
                    items[r] = sorted(own, key=lambda name: (name is None, name or ""))
            doc = batch.column("doc")
            if drop_text:
                kept = [f.name for f in doc.type if f.name != "text"]
                doc = pa.StructArray.from_arrays([doc.field(c) for c in kept], names=kept)
            yield pa.RecordBatch.from_arrays([doc, pa.array(n_words), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=names)

    return find


def _chunks(bench: DataFrame, chunk_bytes: int) -> DataFrame:
    """ids, text, part, sub: each text once with its items' ids, in chunks.

    Texts are dealt by their hash to as many parts as their bytes ask for; in a
    part, a running sum of sizes begins a new chunk whenever it passes
    ``chunk_bytes``. Only hashes and sizes go through the window.
    """
    texts = bench.filter("text is not null").groupBy("text").agg(F.collect_set(F.struct(F.col("item_id").cast("string").alias("id"))).alias("found"))
    texts = cut(texts.select(F.col("found.id").alias("ids"), "text", F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("text").alias("h")), "items")
    total = texts.agg(F.sum("bytes")).first()[0] or 0
    part = F.pmod("h", F.lit(max(1, math.ceil(total / chunk_bytes)))).alias("part")
    before = F.sum("bytes").over(W.partitionBy("part").orderBy("h").rowsBetween(W.unboundedPreceding, -1))
    placed = texts.select("h", part, "bytes").withColumn("sub", F.floor(F.coalesce(before, F.lit(0)) / F.lit(chunk_bytes)))
    return cut(texts.join(placed.select("h", "part", "sub").distinct(), "h").select("ids", "text", "part", "sub"), "chunks")


def contamination(docs: DataFrame, bench: DataFrame, window: int = 10, keep_text: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc (a struct of all columns of ``docs``, the text only if asked), n_words, spans, items for every row.

    ``spans`` holds the merged hit words as [start, end, start, end, ...], in
    words; ``items`` the ids of items with a window in the text, as strings, in
    order. A null or empty text has no words, nor has a null item; a null item id
    is a null among them, the last. Rows that repeat an id count each for itself. With an empty
    benchmark nothing is hit; empty documents give no rows.
    """
    spark = docs.sparkSession
    chunked = _chunks(bench, chunk_bytes)
    chunks = [(r.part, r.sub) for r in chunked.select("part", "sub").distinct().orderBy("part", "sub").collect()] or [None]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k, chunk in enumerate(chunks):
        index = Index([(r.ids, r.text) for r in chunked.filter((F.col("part") == chunk[0]) & (F.col("sub") == chunk[1])).select("ids", "text").collect()] if chunk else [], window)
        vocabulary = spark.sparkContext.broadcast(index.vocabulary)
        counts = np.zeros(max(1, len(index.vocabulary)), np.int64)
        if len(index.vocabulary):
            for r in docs.select("text").mapInArrow(_counter(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
                counts[r.word] = r.n
        index.order_by_rarity(counts)
        drop = k == len(chunks) - 1 and not keep_text
        schema = rows.schema
        if drop:
            schema = T.StructType([T.StructField("doc", T.StructType([f for f in schema["doc"].dataType if f.name != "text"])), *schema.fields[1:]])
        rows = rows.mapInArrow(_finder(spark.sparkContext.broadcast(index), schema.names, drop), schema)
    return rows


def clean_rows(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns."""
    return contamination(docs, bench, window, keep_text=True).filter(F.size("spans") == 0).select("doc.*")
