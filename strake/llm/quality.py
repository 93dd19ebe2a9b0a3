"""Quality classifier by co-training two views of a document.

The text view sees the text: shares of character classes, of pairs of classes,
of repeated words, and the lengths of words and lines. The metadata view sees
language, source and length as stated. Both are written once, some 380 bytes a
document, and read from then on. Each view is a logistic regression, fitted on a
bounded sample of labelled rows (``sample``, spread by a hash of the id). Over some
rounds both score every unlabelled document; each view labels those of all that it
is surest of (``exchange`` of each label, and only beyond ``sure``; of equally sure
ones the smallest ids), and the other learns them. A third of the labelled sample
takes no part; on it each view's logit is scaled to a probability, and the two
calibrated logits are combined by a last regression. All documents are then scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import cut

SAMPLE = 6000
ROUNDS = 4
EXCHANGE = 150
SURE = 0.95
HASHED = 64
_CLASS = np.full(256, 11, np.int64)  # other symbols
for _k, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".", b",;:", b"!?", b"|", b"\"'()[]{}<>", b"-_/\\+=")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 12
_CLASSES = 13
TEXT_FEATURES = _CLASSES**2 + _CLASSES + 6


def text_features(column: pa.Array) -> np.ndarray:
    """The text view: a row of numbers for each text."""
    out = np.zeros((len(column), TEXT_FEATURES), np.float32)
    for i, j, buf, starts, ends in K.pieces(column, 1 << 19):
        n = j - i
        row = np.repeat(np.arange(n), ends - starts)
        size = np.maximum(ends - starts, 1)[:, None]
        c = _CLASS[buf]
        out[i:j, : _CLASSES] = np.bincount(row * _CLASSES + c, minlength=n * _CLASSES).reshape(n, -1) / size
        if len(buf) > 1:
            same = row[1:] == row[:-1]
            pair = c[:-1][same] * _CLASSES + c[1:][same]
            m = _CLASSES**2
            out[i:j, _CLASSES : _CLASSES + m] = np.sqrt(np.bincount(row[1:][same] * m + pair, minlength=n * m).reshape(n, -1) / size)
        low = K.LOWER[buf]
        ws, we, own = K.words(low, starts, K.TOKEN)
        words = np.maximum(np.bincount(own, minlength=n), 1)
        at = _CLASSES + _CLASSES**2
        out[i:j, at] = np.log1p(words) / 10
        out[i:j, at + 1] = np.bincount(own, weights=we - ws, minlength=n) / words / 10
        if len(ws):
            h = K.span_hashes(low, ws, we)
            twice = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
            out[i:j, at + 2] = np.bincount(own[1:][twice], minlength=n) / words
            key = K.mix64(h ^ own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, first = np.unique(key, return_index=True)
            out[i:j, at + 3] = np.bincount(own[first], minlength=n) / words
        lines = np.bincount(row[buf == 10], minlength=n) + 1
        out[i:j, at + 4] = np.log1p(lines) / 5
        out[i:j, at + 5] = np.log1p(words / lines) / 5
    return out


def meta_codes(lang: list, source: list, n_chars: list) -> np.ndarray:
    """The metadata view in three places a row: hashes of language and source, and a bin of the stated length; nulls have their own."""
    out = np.zeros((len(lang), 3), np.uint8)
    if not len(lang):
        return out
    for k, names in enumerate((lang, source)):
        buf, a, b = K.joined(["\0none" if x is None else str(x) for x in names])
        out[:, k] = K.span_hashes(buf, a, b) % np.uint64(HASHED)
    size = np.array([-1 if x is None else max(0, x) for x in n_chars], float)
    out[:, 2] = np.where(size < 0, HASHED - 1, np.minimum(3 * np.log1p(np.maximum(size, 0)), HASHED - 2))
    return out


def meta_features(codes: np.ndarray) -> np.ndarray:
    """The metadata view: a one for each place."""
    out = np.zeros((len(codes), 3 * HASHED), np.float32)
    for k in range(3):
        out[np.arange(len(codes)), k * HASHED + codes[:, k]] = 1
    return out


def packed(text: np.ndarray, codes: np.ndarray) -> list[bytes]:
    """Both views of each row as bytes; the text view with half precision."""
    return [t.tobytes() + c.tobytes() for t, c in zip(text.astype(np.float16), codes, strict=True)]


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * TEXT_FEATURES + 3)
    return np.ascontiguousarray(raw[:, : 2 * TEXT_FEATURES]).view(np.float16).astype(np.float32), meta_features(raw[:, 2 * TEXT_FEATURES :])


class Logistic:
    """Logistic regression on standardised features, by Newton steps with a ridge."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        x = x.astype(float)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        x = np.column_stack([(x - self.mean) / self.sd, np.ones(len(x))])
        weight = np.ones(len(x)) if weight is None else weight
        self.w = np.zeros(x.shape[1])
        penalty = np.r_[np.full(x.shape[1] - 1, self.ridge), 1e-6]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            s = weight * np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.sd) @ self.w[:-1] + self.w[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


class Model:
    """Both views, their calibration, and the regression that combines them."""

    def __init__(self, text: Logistic, meta: Logistic, calibration: list[Logistic], combined: Logistic):
        self.text, self.meta, self.calibration, self.combined = text, meta, calibration, combined

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability by the text, by the metadata, and by both."""
        views = [c.logit(m.logit(x)[:, None]) for c, m, x in zip(self.calibration, (self.text, self.meta), (text, meta), strict=True)]
        own = [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in views]
        return own[0], own[1], self.combined.probability(np.column_stack(views))


def surest(ids: np.ndarray, p: list[np.ndarray], exchange: int, sure: float) -> list[tuple[int, int, np.ndarray]]:
    """(view, label, rows): the rows that each view is surest of, for each label; a row is taken once."""
    out, taken = [], set()
    for k, own in enumerate(p):
        for value, score in ((1, own), (0, 1 - own)):
            best = np.lexsort((ids, -score))[:exchange]
            new = [i for i in best[score[best] >= sure].tolist() if ids[i] not in taken]
            taken.update(ids[new].tolist())
            out.append((k, value, np.array(new, np.int64)))
    return out


class Rows:
    """Unlabelled rows in memory."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.views, self.left = (text, meta), np.arange(len(text))

    def take(self, models: list[Logistic], exchange: int, sure: float) -> list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]:
        """(view, label, both views of the rows that it is surest of); they are gone then."""
        text, meta = (x[self.left] for x in self.views)
        found = surest(self.left, [m.probability(x) for m, x in zip(models, (text, meta), strict=True)], exchange, sure)
        out = [(k, value, (text[rows], meta[rows])) for k, value, rows in found]
        self.left = np.delete(self.left, np.concatenate([rows for _, _, rows in found]))
        return out


class Documents:
    """Unlabelled documents of a table (doc_id, x), all of which are scored in every round.

    A task returns its surest rows, some sqrt(tasks) tasks the surest of these,
    and the driver picks among theirs: ids and probabilities, four times
    ``exchange`` a task. Then the features of the chosen come to it.
    """

    def __init__(self, table: DataFrame):
        self.table, self.taken = table, set()

    def take(self, models: list[Logistic], exchange: int, sure: float) -> list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]:
        spark = self.table.sparkSession
        sent = spark.sparkContext.broadcast((models, np.array(sorted(self.taken), np.int64)))
        names = ["doc_id", "p0", "p1"]

        def few(ids: np.ndarray, p: list[np.ndarray]) -> pa.RecordBatch:
            order = np.lexsort((p[1], p[0], ids))
            ids, p = ids[order], [own[order] for own in p]
            _, once = np.unique(ids, return_index=True)  # rows that repeat an id count once
            ids, p = ids[once], [own[once] for own in p]
            # a view's surest may be taken by the other: each has all of its own
            kept = np.unique(np.concatenate([np.lexsort((ids, -score))[: 4 * exchange] for own in p for score in (own, 1 - own)]))
            kept = kept[np.max([np.maximum(own, 1 - own)[kept] for own in p], axis=0) >= sure]
            return pa.RecordBatch.from_arrays([pa.array(ids[kept]), *(pa.array(own[kept]) for own in p)], names=names)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, gone = sent.value
            ids, p = np.zeros(0, np.int64), [np.zeros(0), np.zeros(0)]
            for batch in batches:
                own = batch.column("doc_id").to_numpy()
                some = ~np.isin(own, gone)
                found = [m.probability(x) for m, x in zip(views, unpacked(batch.column("x")), strict=True)]
                best = few(np.concatenate([ids, own[some]]), [np.concatenate([a, b[some]]) for a, b in zip(p, found, strict=True)])
                ids, p = best.column("doc_id").to_numpy(), [best.column(c).to_numpy() for c in names[1:]]
            yield few(ids, p)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("p0", pa.float64()), ("p1", pa.float64())]))
            yield few(rows.column("doc_id").to_numpy(), [rows.column(c).to_numpy() for c in names[1:]])

        kind = "doc_id long, p0 double, p1 double"
        tasks = max(1, math.isqrt(self.table.rdd.getNumPartitions()))
        best = self.table.mapInArrow(score, kind).repartition(tasks, "doc_id").mapInArrow(meet, kind).toArrow()
        ids = best.column("doc_id").to_numpy()
        found = surest(ids, [best.column(c).to_numpy() for c in names[1:]], exchange, sure)
        chosen = np.concatenate([ids[rows] for _, _, rows in found]).tolist()
        if not chosen:
            return []
        self.taken.update(chosen)
        table = self.table.filter(F.col("doc_id").isin(chosen)).groupBy("doc_id").agg(F.min("x").alias("x")).toArrow()
        at = {i: n for n, i in enumerate(table.column("doc_id").to_pylist())}
        text, meta = unpacked(table.column("x").combine_chunks())
        place = [np.array([at[i] for i in ids[rows].tolist()], np.int64) for _, _, rows in found]
        return [(k, value, (text[n], meta[n])) for (k, value, _), n in zip(found, place, strict=True)]


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool=None, rounds: int = ROUNDS, exchange: int = EXCHANGE, sure: float = SURE) -> Model | None:
    """A model from labelled rows (0 or 1) and unlabelled ones (those labelled -1, or ``pool``); None unless both labels are there."""
    known = np.flatnonzero(label >= 0)
    held, fit = known[::3], np.setdiff1d(known, known[::3])
    if len(set(label[held])) < 2 or len(set(label[fit])) < 2:
        return None
    views = (text, meta)
    pool = pool or Rows(text[label < 0], meta[label < 0])
    taught: list[list[tuple[np.ndarray, np.ndarray]]] = [[(x[fit], label[fit].astype(float))] for x in views]  # rows and labels, for each view

    def fitted() -> list[Logistic]:
        out = []
        for rows in taught:
            # a guessed label weighs half of a true one
            weight = np.concatenate([np.full(len(y), 0.5 if n else 1.0) for n, (_, y) in enumerate(rows)])
            out.append(Logistic().fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]), weight))
        return out

    models = fitted()
    for _ in range(rounds):
        found = pool.take(models, exchange, sure)
        if not any(len(both[0]) for _, _, both in found):
            break
        for k, value, both in found:
            taught[1 - k].append((both[1 - k], np.full(len(both[0]), float(value))))
        models = fitted()
    y = label[held].astype(float)
    calibration = [Logistic(0.01).fit(m.logit(x[held])[:, None], y) for m, x in zip(models, views, strict=True)]
    logits = np.column_stack([c.logit(m.logit(x[held])[:, None]) for c, m, x in zip(calibration, models, views, strict=True)])
    return Model(*models, calibration, Logistic(1.0).fit(logits, y))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = packed(text_features(batch.column("text")), meta_codes(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])


def train(views: DataFrame, known: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of views (doc_id, x) and known (doc_id, label).

    About ``sample`` of the labelled ids are picked; these, bounded by the
    parameter, are broadcast, and as many rows of numbers come to the driver.
    Labelled documents are no unlabelled ones, picked or not.
    """
    ids = cut(views.select("doc_id").filter("doc_id is not null").join(known, "doc_id", "left"), "known")
    n = ids.filter("label is not null").count()
    if not n:
        return None
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    picked = ids.filter(F.col("label").isNotNull() & (place < min(1.0, sample / n) * (1 << 20))).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = views.join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("doc_id", F.lit(12)))
    table = chosen.toArrow().sort_by([("h", "ascending"), ("x", "ascending")])
    if not table.num_rows:
        return None
    free = cut(views.join(ids.filter("label is null").select("doc_id").distinct(), "doc_id", "left_semi"), "unlabelled")
    return co_train(*unpacked(table.column("x").combine_chunks()), table.column("label").to_numpy(), Documents(free))


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = model.value.score(*unpacked(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.asarray(p, float)) for p in own)], names=["doc_id", "p_text", "p_meta", "score"])

    return score


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score, keep for every row: the probability of good quality by each view and by both.

    ``labels`` (doc_id, quality): null labels and null ids teach nothing; a
    document labelled twice counts by its larger label. Null texts are empty,
    null metadata is a value of its own. Without labels of both kinds all
    scores are 0.5, which keeps every row. Rows that repeat an id are scored each
    for itself.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label"))
    half = F.lit(0.5)
    scored = rows.select("doc_id", half.alias("p_text"), half.alias("p_meta"), half.alias("score"))
    if known.limit(1).count():
        views = cut(rows.mapInArrow(_features, "doc_id long, x binary"), "views")
        if model := train(views, known, sample):
            scored = views.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "doc_id long, p_text double, p_meta double, score double")
    return scored.withColumn("keep", F.col("score") >= least)
