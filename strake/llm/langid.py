"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of 1, 2 and 3 characters (ASCII letters lower-cased), each
length hashed to 2**16 places. Document frequencies are counted over all
training documents. The regression is fitted by follow-the-regularised-leader
with L1 and L2 penalties on a bounded sample, ``rows_per_language`` documents of
each language, spread by a hash of the id; one in five of them is left out of
the fit and sets the temperature that calibrates the probabilities. The
``languages`` most frequent values of lang are learnt (of equally frequent ones
the first by code point), so a column of junk makes no model that no machine
holds: driver and executors hold at most 0.8 MB a language, and the sample's
features.

A document's score needs only the sum of its n-grams' weights, so prediction is
three look-ups a character and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

PLACES = 1 << 16
ORDERS = 3
FEATURES = PLACES * ORDERS
ROWS_PER_LANGUAGE = 1000
LANGUAGES = 256
#: Rows of the sample in all: with many languages, each has fewer.
ROWS = 20_000
UNKNOWN = "und"
_STEP = K.mix64(np.arange(31, 31 + ORDERS, dtype=np.uint64)) | np.uint64(1)
_LOCAL = 1 << 17


def characters(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, ASCII lower-cased, and their rows."""
    low = K.LOWER[buf].tobytes()
    points = np.frombuffer(low.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (buf & 0xC0) != 0x80
    if lead.sum() != len(points):  # not UTF-8: bytes stand for characters
        points, lead = np.frombuffer(low, np.uint8).astype(np.uint32), np.ones(len(buf), bool)
    before = np.r_[0, np.cumsum(lead)]
    return points, np.repeat(np.arange(len(starts)), before[ends] - before[starts])


def features(points: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the features that end at a character, and their rows."""
    wide = points.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(points), np.uint64)
    for k in range(ORDERS):
        total[k:] += wide[: len(wide) - k] * _STEP[k]
        inside = row[k:] == row[: len(row) - k] if k else np.ones(len(row), bool)
        yield (K.mix64(total[k:][inside]) >> np.uint64(48)).astype(np.int64) + k * PLACES, row[k:][inside]


def _pieces(column: pa.Array):
    for i, j, buf, starts, ends in K.pieces(column, _LOCAL):
        yield i, j, *characters(buf, starts, ends)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES, np.int64)
    rows = 0
    for batch in batches:
        rows += batch.num_rows
        for _, _, points, row in _pieces(batch.column("text")):
            for f, r in features(points, row):
                pairs = np.sort(r * FEATURES + f)
                df += np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]]] % FEATURES, minlength=FEATURES) if len(pairs) else 0
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found]), pa.array(np.r_[rows, df[found]])], names=["f", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct features and their counts."""
    for batch in batches:
        fs, ns = [[]] * batch.num_rows, [[]] * batch.num_rows
        for i, j, points, row in _pieces(batch.column("text")):
            found = [(r, f) for f, r in features(points, row)]
            rows, feats = np.concatenate([r for r, _ in found]), np.concatenate([f for _, f in found])
            pairs, n = np.unique(rows * FEATURES + feats, return_counts=True)
            at = np.searchsorted(pairs, np.arange(j - i + 1) * FEATURES)
            for k in range(j - i):
                fs[i + k], ns[i + k] = pairs[at[k] : at[k + 1]] % FEATURES, n[at[k] : at[k + 1]]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(fs, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32()))], names=["lang", "h", "f", "n"])


class Follower:
    """Follow-the-regularised-leader (proximal, per coordinate) for a softmax regression."""

    def __init__(self, features: int, classes: int, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[rows]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[rows] += g - sigma * w
        self.n[rows] = n + g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on left-out rows (golden section on its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()

    lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray):
        self.langs, self.table, self.bias = langs, table, bias

    def probabilities(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.langs)))
        length = np.zeros(len(column))
        for i, j, points, row in _pieces(column):
            length[i:j] = np.bincount(row, minlength=j - i)
            for f, r in features(points, row):
                if len(r):
                    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    out[i + r[first]] += np.add.reduceat(self.table[f], first, axis=0)
        return softmax(out / np.maximum(length, 1)[:, None] + self.bias)


def train(rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES, epochs: int = 3, seed: int = 5) -> Model | None:
    """A model of a table (doc_id, text, lang); None if it has no rows."""
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not per:
        return None
    langs = sorted(per)
    rows_per_language = min(rows_per_language, max(1, ROWS // len(langs)))
    df = np.zeros(FEATURES)
    total = 0
    for f, n in zip(*(c.to_numpy() for c in rows.select("text").mapInArrow(_frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow().columns), strict=True):
        if f < 0:
            total = n
        else:
            df[f] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, rows_per_language / per[lang])))])
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    picked = rows.withColumn("h", h).filter(F.col("h") < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    sample = picked.select("text", "lang", F.xxhash64("doc_id", F.lit(seed + 1)).alias("h")).mapInArrow(_sparse, "lang string, h long, f array<int>, n array<int>").toArrow()
    data = []
    for batch in sample.to_batches():
        ends = np.asarray(batch.column("f").offsets)
        every, counts = batch.column("f").values.to_numpy(), batch.column("n").values.to_numpy()
        for k, (lang, hash_) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True)):
            f, n = every[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]
            if len(f):
                data.append((hash_, langs.index(lang), f, (n * idf[f] / max(1, n[f < PLACES].sum())).astype(np.float32)))
    data.sort(key=lambda x: (x[0], x[1], len(x[2])))
    if not data:
        return Model(langs, np.zeros((FEATURES, len(langs)), np.float32), np.zeros(len(langs)))
    scale = 1 / np.mean([np.sqrt((x * x).sum()) for _, _, _, x in data])
    fit, held = [d for i, d in enumerate(data) if i % 5], data[::5]
    follower = Follower(FEATURES + 1, len(langs))
    for _ in range(epochs):
        for _, label, f, x in fit or held:
            follower.learn(np.r_[f, FEATURES], np.r_[x * scale, 1.0], label)
    w = follower.weights()
    logits = np.array([w[FEATURES] + (x * scale) @ w[f] for _, _, f, x in held])
    t = temperature(logits, np.array([label for _, label, _, _ in held]))
    return Model(langs, (w[:FEATURES] * idf[:, None] * scale / t).astype(np.float32), w[FEATURES] / t)


def _predictor(model, names: list[str], drop_text: bool):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, letter = batch.column("doc"), batch.column("letter").to_numpy(zero_copy_only=False)
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if model is not None and batch.num_rows:
                p = model.value.probabilities(doc.field("text"))
                best = p.argmax(axis=1)
                lang = np.where(letter, np.array(model.value.langs, object)[best], UNKNOWN)
                score = np.where(letter, p[np.arange(len(best)), best], 0.0)
            if drop_text:
                kept = [f.name for f in doc.type if f.name != "text"]
                doc = pa.StructArray.from_arrays([doc.field(c) for c in kept], names=kept)
            yield pa.RecordBatch.from_arrays([doc, pa.array(lang, pa.string()), pa.array(score)], names=names)

    return predict


def identify(docs: DataFrame, training: Column, keep_text: bool = False, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """doc (a struct of all columns of ``docs``, the text only if asked), lang_pred, score for every row.

    ``training``: a condition on doc_id; only text and lang of rows that meet it
    and have both are learnt, and only the text is used to predict. A null text,
    or one without a letter, is "und" with score 0, as is everything if nothing
    can be learnt. Rows that repeat an id are each judged by their own text. Of
    two languages that are equally likely the first by code point is told.
    """
    return _identified(docs, training, keep_text, rows_per_language, languages)[0]


def _identified(docs: DataFrame, training: Column, keep_text: bool, rows_per_language: int, languages: int) -> tuple[DataFrame, int]:
    """What ``identify`` returns, and how many languages were learnt."""
    spark = docs.sparkSession
    rows = docs.filter(F.coalesce(training, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(rows, rows_per_language, languages)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    doc = packed.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", doc if keep_text else T.StructType([f for f in doc if f.name != "text"])), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    told = packed.mapInArrow(_predictor(spark.sparkContext.broadcast(model) if model else None, schema.names, not keep_text), schema)
    return told, len(model.langs) if model else 0


def accepted_rows(docs: DataFrame, training: Column, least: float = 1 / 15) -> DataFrame:
    """The rows of ``docs`` whose language is told, with all their columns.

    A row stays if its probability is at least ``least`` of the way from a guess
    among the learnt languages to certainty: 0.3 of four. Clean texts of a few
    words are told with little certainty, so the default rejects only what is
    hardly better than a guess. Null and empty texts and those without a letter
    are rejected, as are all rows if nothing can be learnt; repeated rows are each
    judged for themselves.
    """
    found, languages = _identified(docs, training, True, ROWS_PER_LANGUAGE, LANGUAGES)
    guess = 1 / languages if languages > 1 else 0.0
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= guess + least * (1 - guess))).select("doc.*")
