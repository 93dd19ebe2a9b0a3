"""Scoring texts by prediction by partial matching (PPM) over bytes.

The trie of byte contexts is trained on the training documents. A symbol is a
byte or the end of the text; a text's first contexts are filled with begin
marks. Every context of up to 5 symbols is kept, however rare it is, so the
trie grows with the corpus and is on no single machine. Contexts of up to 2
symbols are broadcast; their counts number 256**3 at most. Longer ones are dealt
to buckets by the last 3 symbols of the context, so a bucket has a context with
all that end in it or that it ends in: a block of documents asks it for the code
length of each of its distinct symbols in context, and says how often it has
them in training documents. A context of 3 symbols that has more than a bucket's
share of the training symbols is hot: it is dealt by its last 4 symbols, and
its own counts, of which there are fewer than buckets, are broadcast.

A symbol is coded by the longest known context. Escapes are estimated by method D
(each distinct symbol gives up half an occurrence), and after an escape the symbols of the
longer context are excluded from the shorter one. The excluded set at a depth is
always that of the context just left, so every code length follows from sums
over the trie.

The unigram base score needs every word's count over all training documents.
Blocks of documents ask the same buckets for them (see ``exchange``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkit as K

BEGIN, END = 0xFF, 0xFE
#: Symbols that can be coded: all bytes but the two marks (texts that hold them, which is not UTF-8, have 0xFD instead), and the end.
UNIVERSE = 255
#: For callers that want a pruned trie (``contexts`` of ``score``); by default nothing is pruned.
CONTEXTS = 1 << 17
DEPTH = 5
_MARK = np.arange(256, dtype=np.uint8)
_MARK[[BEGIN, END]] = 0xFD
_END_WORD = np.uint64(0x5EED0FE2D0000001)


def marked(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with begin marks before and an end mark after each; the places and rows of their symbols."""
    n = ends - starts
    out = np.full(int(n.sum()) + (DEPTH + 1) * len(n), BEGIN, np.uint8)
    rows = np.arange(len(n))
    new = np.cumsum(n + DEPTH + 1) - (n + 1)
    row = np.repeat(rows, n)
    at = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    out[new[row] + at] = _MARK[buf[starts[row] + at]]
    out[new + n] = END
    symbol = np.ones(len(out), bool)
    for k in range(1, DEPTH + 1):
        symbol[new - k] = False
    return out, np.flatnonzero(symbol), np.repeat(rows, n + 1)


def grams(out: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each symbol and the bytes before it, as one number."""
    wide = out.astype(np.int64)
    sums = wide.copy()
    for k in range(1, DEPTH + 1):
        sums[k:] |= wide[:-k] << (8 * k)
    return sums[place]


def _tail(gram: np.ndarray, k: int) -> np.ndarray:
    """The last k symbols of each gram."""
    return gram & ((1 << 8 * k) - 1)


def _within(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted ones, and where (0 if not)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    has = sorted_keys[at] == keys
    return has, np.where(has, at, 0)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's counts."""
    every = np.concatenate([np.zeros(0, np.int64), *keys])
    found, back = np.unique(every, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, back, np.concatenate([np.zeros(0, np.int64), *counts]))
    return found, sums


def _counter(size: int, hot: np.ndarray | None = None):
    """Counts the grams of ``size`` symbols; with ``hot``, of those whose last 3 symbols before the final one are hot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, buf, starts, ends in K.pieces(batch.column("text")):
                g = _tail(grams(*marked(buf, starts, ends)[:2]), size)
                if hot is not None:
                    g = g[_within(hot, _tail(g >> 8, 3))[0]]
                held.append(np.unique(g, return_counts=True))
                if len(held) >= 64:
                    keys, sums = _summed([keys, *(k for k, _ in held)], [sums, *(n for _, n in held)])
                    held = []
        keys, sums = _summed([keys, *(k for k, _ in held)], [sums, *(n for _, n in held)])
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(sums[i : i + 100_000])], names=["gram", "n"])

    return count


def _counted(texts: DataFrame, size: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    table = texts.select("text").mapInArrow(_counter(size, hot), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def train(texts: DataFrame, buckets: int) -> tuple:
    """What is broadcast of a table with a column text: grams of 3 symbols and their counts, hot contexts of 3, grams of 4 that have them and their counts.

    At most 256**3 and ``256 * buckets`` numbers come to the driver.
    """
    three, n = _counted(texts, 3)
    context, m = _summed([three], [n])  # a context of 3 symbols occurs as a gram of 3 does, but for texts' beginnings and ends
    hot = context[m * buckets > m.sum()]
    four, n4 = _counted(texts, 4, hot) if len(hot) else (three[:0], n[:0])
    return three, n, hot, four, n4


def _level(counts, q_above, excluded, lower):
    """Probabilities at a context after an escape from a longer one, whose symbols are excluded; lower: at the next shorter."""
    q = (counts > 0).sum(axis=-1, keepdims=True) - q_above
    twice = 2 * np.maximum(counts.sum(axis=-1, keepdims=True) - excluded, 1)
    escape = np.where(q > 0, q / twice, 1.0)
    return np.where(counts > 0, (2 * counts - 1) / twice, escape * lower)


def _escaped(longer, counts, lower):
    has = longer > 0
    return _level(counts, has.sum(axis=-1, keepdims=True), (has * counts).sum(axis=-1, keepdims=True), lower)


class _Order:
    """The counts of the grams of one length, in order, with the sums of their contexts."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, least: int = 0):
        self.gram, self.n = gram, n
        self._sum()
        if least and len(gram):  # contexts that occur less often are pruned
            kept = self.m[self.of] >= least
            self.gram, self.n = gram[kept], n[kept]
            self._sum()

    def _sum(self) -> None:
        self.context, self.of, self.q = np.unique(self.gram >> 8, return_inverse=True, return_counts=True)
        self.m = np.bincount(self.of, weights=self.n, minlength=len(self.context))

    def count(self, gram: np.ndarray) -> np.ndarray:
        has, at = _within(self.gram, gram)
        return np.where(has, self.n[at], 0) if len(self.n) else np.zeros(len(gram))

    def sums(self, gram: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """Whether the grams' contexts are known, and the contexts' values (0 if not)."""
        has, at = _within(self.context, gram >> 8)
        return [has, *(np.where(has, v[at], 0) if len(v) else np.zeros(len(gram)) for v in values)]


class Model:
    """Probabilities at contexts of 2 symbols for every symbol, from the counts of all grams of 3; and what is known of hot contexts."""

    def __init__(self, three: np.ndarray, n3: np.ndarray, hot: np.ndarray, four: np.ndarray, n4: np.ndarray):
        self.total, self.three, self.hot, self.four = int(n3.sum()), _Order(three, n3), hot, (four, n4)
        seen = np.unique(np.concatenate([three >> 16 & 255, three >> 8 & 255, three & 255]))
        a = len(seen) + 1  # the last symbol stands for all bytes that never occur
        ix = np.full(256, a - 1, np.int64)
        ix[seen] = np.arange(len(seen))
        self.index, self.size = ix, a
        c2 = np.zeros((a, a, a))
        c2[ix[three >> 16 & 255], ix[three >> 8 & 255], ix[three & 255]] = n3
        c1 = c2.sum(axis=0)
        c0 = c1.sum(axis=0)
        unseen = 1.0 / max(1, UNIVERSE - int((c0 > 0).sum()))
        f0 = _escaped(c1, c0[None, :], np.full((1, a), unseen))
        self.first = np.empty((a, a, a), np.float32)
        self.below = np.empty((a, a, a), np.float32)  # at (x, b) after the escape from it
        for x in range(a):
            self.below[x] = _escaped(c2[x], c1, f0)
            self.first[x] = _level(c2[x], 0, 0, self.below[x])

    def logs(self, gram: np.ndarray, n: np.ndarray, contexts: int | None = None) -> np.ndarray:
        """log10 of the probability of each gram's last symbol, at its longest known context.

        The grams are distinct, in order, and all that any document has with
        their last 3 symbols of context, or 4 where these are hot; n counts them
        in training documents.
        """
        at = [self.index[gram >> 8 * k & 255] for k in (2, 1, 0)]
        p, below = self.first[*at].astype(float), self.below[*at].astype(float)
        learnt, n = gram[n > 0], n[n > 0]
        least = -(-self.total // contexts) if contexts else 0
        shorter = self.three
        for k in range(3, DEPTH + 1):
            keys, sums = _summed([_tail(learnt, k + 1)], [n])
            if k == 3 and len(self.hot):
                own = ~_within(self.hot, keys >> 8)[0]
                keys, sums = _summed([keys[own], self.four[0]], [sums[own], self.four[1]])
            order = _Order(keys, sums, least)
            excluded = np.bincount(order.of, weights=shorter.count(_tail(order.gram, k)), minlength=len(order.context))
            known, m, q, out = order.sums(_tail(gram, k + 1), order.m, order.q, excluded)
            _, m_up, q_up = shorter.sums(_tail(gram, k), shorter.m, shorter.q)
            # at the next shorter context, after the escape from this one
            left = q_up - q
            twice = 2 * np.maximum(m_up - out, 1)
            c_up = shorter.count(_tail(gram, k))
            below = np.where(c_up > 0, (2 * c_up - 1) / twice, np.where(left > 0, left / twice, 1.0) * below)
            c, twice = order.count(_tail(gram, k + 1)), 2 * np.maximum(m, 1)
            p = np.where(known, np.where(c > 0, (2 * c - 1) / twice, q / twice * below), p)
            shorter = order
        return np.log10(p).astype(np.float32)


def _loaded(counts) -> Model:
    """The model of a broadcast's counts, made once in each worker process."""
    if counts.__dict__.get("_strake") is None:
        counts.__dict__["_strake"] = Model(*counts.value)
    return counts.__dict__["_strake"]


def _tokens(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = K.LOWER[buf]
    ws, we, row = K.words(low, starts, K.TOKEN)
    return K.span_hashes(low, ws, we), row


def _block_words(text: pa.Array, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a block in order, and their counts in its training documents."""
    every, learnt = [np.array([_END_WORD])], [np.full(int(trains.sum()), _END_WORD)]
    for i, j, buf, starts, _ in K.pieces(text):
        h, row = _tokens(buf, starts)
        every.append(np.unique(h))
        learnt.append(h[trains[i:j][row]])
    keys = np.unique(np.concatenate(every))
    found, n = np.unique(np.concatenate(learnt), return_counts=True)
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, found)] = n
    return keys, counts


def _sizes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """How many of the sorted hashes each bucket has; buckets are equal ranges."""
    step = 2**64 // buckets
    return np.diff(np.r_[np.searchsorted(keys, np.array([i * step for i in range(buckets)], np.uint64)), len(keys)])


def _block_grams(text: pa.Array, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a block in order, and their counts in its training documents."""
    keys, counts = [], []
    for i, j, buf, starts, ends in K.pieces(text):
        out, place, row = marked(buf, starts, ends)
        found, n = np.unique(grams(out, place) << 1 | trains[i:j][row], return_counts=True)
        keys.append(found >> 1)
        counts.append(np.where(found & 1, n, 0))
    return _summed(keys, counts)


def _places(text: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct grams of a block in order; for each piece its distinct ones and which of them each symbol is."""
    found = []
    for _, _, buf, starts, ends in K.pieces(text):
        own, back = np.unique(grams(*marked(buf, starts, ends)[:2]), return_inverse=True)
        found.append((own, back.astype(np.int32)))
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(own for own, _ in found)])), found


def _deal(gram: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams' places by bucket, in order within each, and how many each bucket has."""
    three = _tail(gram >> 8, 3)
    by = np.where(_within(hot, three)[0], _tail(gram >> 8, 4) | 1 << 40, three)
    bucket = (K.mix64(by.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.bincount(bucket, minlength=buckets)


def score(docs: DataFrame, training, partitions: int | None = None, contexts: int | None = None, direct: int = X.DIRECT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``training``: a condition on doc_id; documents that meet it teach both
    models, all are scored. Words have ASCII letters lower-cased; each text has
    one end token more. A null or empty text is the end token alone. Words are
    told apart by 64-bit hashes. Rows that repeat an id count each for itself; a
    null id does not meet a condition that is null for it. Without training
    documents every symbol is equally likely and train_tokens is 0. With
    ``contexts``, contexts of 3 symbols and more that precede less than one in so
    many of the training symbols are pruned; by default none is.
    """
    spark = docs.sparkSession
    trains = F.coalesce(training, F.lit(False))
    blocks, route = X.in_blocks(docs, partitions, direct)
    n = route.n
    learnt = train(docs.filter(trains).select(F.coalesce("text", F.lit("")).alias("text")), n)
    hot, counts = learnt[2], spark.sparkContext.broadcast(learnt)
    blocks = blocks.withColumn("trains", trains)

    def asks(table: pa.Table) -> pa.Table:
        text, trained = X.one(table, "text"), table.column("trains").to_numpy()
        keys, own = _block_words(text, trained)
        words = _sizes(keys, n)
        gram, m = _block_grams(text, trained)
        order, sizes = _deal(gram, hot, n)
        # a bucket that is asked nothing says how many words it has all the same
        return route.asks(table.column("blk")[0].as_py(), [(keys, words), (own, words), (gram[order], sizes), (m[order], sizes)], every=True)

    def answers(columns: list[X.Column]) -> list[X.Column]:
        (keys, words), (own, _), (grams, sizes), (counted, _) = columns
        found, back = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, back, own)
        whole = np.tile(np.array([sums.sum(), (sums > 0).sum()], np.int64), len(words))
        gram, m = _summed([grams], [counted])
        logs = _loaded(counts).logs(gram, m, contexts)
        return [(sums[back], words), (whole, np.full(len(words), 2)), (logs[np.searchsorted(gram, grams)], sizes)]

    replies = route.answer(blocks.groupBy("blk").applyInArrow(asks, X.ROWS), answers)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        text, trained = X.one(left, "text"), left.column("trains").to_numpy()
        keys, _ = _block_words(text, trained)
        (known, _), (whole, _), (dealt_logs, _) = X.heard(right)
        total, distinct = whole.reshape(-1, 2).sum(axis=0).tolist()
        rows = len(trained)
        n_tokens, n_known, base, ppm = np.ones(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
        logs = np.log10(known + 0.5)
        gram, places = _places(text)
        order, _ = _deal(gram, hot, n)
        logs_of = np.empty(len(gram))
        logs_of[order] = dealt_logs
        end = int(np.searchsorted(keys, _END_WORD))
        for (i, j, buf, starts, ends), (own, back) in zip(K.pieces(text), places, strict=True):
            h, row = _tokens(buf, starts)
            at = np.searchsorted(keys, h)
            n_tokens[i:j] += np.bincount(row, minlength=j - i)
            n_known[i:j] = np.bincount(row, weights=known[at] > 0, minlength=j - i) + (known[end] > 0)
            base[i:j] = np.bincount(row, weights=logs[at], minlength=j - i) + logs[end]
            row = np.repeat(np.arange(j - i), ends - starts + 1)
            ppm[i:j] = np.bincount(row, weights=logs_of[np.searchsorted(gram, own)][back], minlength=j - i)
        base -= n_tokens * np.log10(total + 0.5 * (distinct + 1))
        return pa.table({"doc_id": left.column("doc_id"), "held_out": pa.array(~trained), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(rows, total), "base_score": base, "score": ppm})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("blk").cogroup(replies.groupBy("key")).applyInArrow(finish, schema)
