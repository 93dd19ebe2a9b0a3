"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

A candidate is a run of ``[A-Za-z0-9+/_=-]`` that is no plain word: one of 16 or
more, or one of 8 or more with a digit, a capital after a small letter, or one of
``+/_=``. The network sees 48 bytes of it at a time, with 24 bytes of context on
each side: a longer run is seen in overlapping parts, 16 bytes apart, up to its
end.

Labelled findings are the parts of candidates that a match of the fixed patterns
meets (in 16 bytes or all that the run has of matches), and all others. A network
that learnt only these would repeat the patterns, so every long secret is also
planted as ones that no pattern meets: upper-cased, recoded with the digits of
another alphabet, and split by dashes, each under another name or none, in the
contexts of other findings. Others that networks which have not learnt them take
for secrets are put aside, as they may be what is looked for. One secret in
four, with all that is planted of it, and one other in four are left out,
calibrate the probability, and set the threshold: the largest that still finds
``recall`` of the planted ones (or ``least``, if that is more; by default it is 0).

All distinct findings are learnt and all that are left out set the threshold.
Where there are more than ``block`` of a label they are dealt to tasks, so many of
each label to a task; of a label that is rarer each goes to several tasks. A
network starts from one task's lesson. In each of ROUNDS rounds every task then
goes once through all of its lesson, and the mean of the tasks' weights is the
next round's start (parameter averaging). Logits of what is left out stay in a
table: the threshold is found there exactly, and the probability is calibrated on
their whole histogram, 256 bins to one logit.

The patterns' spans are always reported. The network adds each candidate of
which a part that no pattern has met is over the threshold, as a span of kind
``token``.
"""

from __future__ import annotations

import copy
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import cut

KINDS = ("assign", "access", "hex")
ADDED = "token"
#: Findings of each label that a task learns; up to so many are learnt in the driver.
BLOCK = 1500
#: Passes over all findings, beyond the start from one block, and their rate.
ROUNDS, RATE = 3, 0.003
#: Share of left-out planted secrets that the threshold must find.
RECALL = 0.95
#: Windows that the network judges at once: what it computes of them fits a cache.
ROWS = 64
# fixed values: the base patterns of the scan
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
_LEAST = {"assign": 6, "access": 20, "hex": 24}
HEX = np.zeros(256, bool)
HEX[0x30:0x3A] = HEX[0x61:0x67] = True
RUN = np.zeros(256, bool)
RUN[0x30:0x3A] = RUN[0x41:0x5B] = RUN[0x61:0x7B] = True
RUN[[0x2B, 0x2F, 0x5F, 0x3D, 0x2D]] = True
SHORTEST, SHORT = 16, 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[0x2B, 0x2F, 0x5F, 0x3D]] = True
# fixed values: names and signs before planted secrets, and the digits that they are recoded with
_NAMED = (b"pwd", b"auth", b"credential", b"key", b"session", b"signature", b"bearer", b"private", b"")
_SIGNS = (b"=", b": ", b' = "', b" ", b":", b'": "')
_DIGITS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"abcdefghijklmnopqrstuvwxyz0123456789")
PLANTED = 3
BODY, SIDE, STEP = 48, 24, 16
WINDOW = BODY + 2 * SIDE


def _rows_with(low: bytes, needle: bytes, starts: np.ndarray, ends: np.ndarray) -> set[int]:
    """Rows in which the bytes occur."""
    out, at = set(), low.find(needle)
    while at >= 0:
        r = int(np.searchsorted(starts, at, "right")) - 1
        if at + len(needle) <= ends[r]:
            out.add(r)
            at = low.find(needle, int(ends[r]))
        else:
            at = low.find(needle, at + 1)
    return out


def base_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, kind, end) in bytes of the buffer, in order, of all matches that pass."""
    raw, low = buf.tobytes(), K.LOWER[buf].tobytes()
    out = []
    for r in set().union(*(_rows_with(low, w, starts, ends) for w in _WORDS)):
        text = raw[starts[r] : ends[r]]
        out += [(r, int(starts[r]) + m.start(), 0, int(starts[r]) + m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    for r in _rows_with(raw, b"AKIA", starts, ends):
        text = raw[starts[r] : ends[r]]
        out += [(r, int(starts[r]) + m.start(), 1, int(starts[r]) + m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    ws, we, row = K.words(buf, starts, HEX)
    for k in np.flatnonzero(we - ws >= _LEAST["hex"]):
        out.append((int(row[k]), int(ws[k]), 2, int(we[k])))
    return sorted(out)


def candidates(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every candidate."""
    ws, we, row = K.words(buf, starts, RUN)
    some = we - ws >= SHORT
    ws, we, row = ws[some], we[some], row[some]
    told = (buf >= 0x30) & (buf <= 0x39) | _SYMBOL[buf]
    told[1:] |= (buf[1:] >= 0x41) & (buf[1:] <= 0x5A) & (buf[:-1] >= 0x61) & (buf[:-1] <= 0x7A)
    told = np.r_[0, np.cumsum(told)]
    # a capital counts only after a small letter of the run itself
    first = np.where((buf[ws] >= 0x41) & (buf[ws] <= 0x5A), ws + 1, ws) if len(ws) else ws
    has = (we - ws >= SHORTEST) | (told[we] > told[first])
    return ws[has], we[has], row[has]


def parts(ws: np.ndarray, we: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and candidate of the parts of up to BODY bytes that the network sees; the last ends with its run."""
    n = 1 + np.maximum(0, -(-(we - ws - BODY) // STEP))
    of = np.repeat(np.arange(len(ws)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a = np.maximum(np.minimum(ws[of] + k * STEP, we[of] - BODY), ws[of])
    return a, np.minimum(a + BODY, we[of]), of


def windows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, ws: np.ndarray, we: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The bytes around each part: context, the part filled up with zeros, context."""
    out = np.zeros((len(ws), WINDOW), np.uint8)
    if not len(ws):
        return out
    for base, size, lo, hi, put in ((ws - SIDE, SIDE, starts[row], ws, 0), (ws, BODY, ws, we, SIDE), (we, SIDE, we, ends[row], SIDE + BODY)):
        at = base[:, None] + np.arange(size)
        ok = (at >= lo[:, None]) & (at < hi[:, None])
        out[:, put : put + size] = np.where(ok, buf[np.clip(at, 0, len(buf) - 1)], 0)
    return out


class Network:
    """Embedding, one convolution, maximum over places, one hidden layer: a logit for each window."""

    WIDTH, DIM, FILTERS, HIDDEN = 5, 8, 24, 16

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (256, self.DIM)),
            "conv": r.normal(0, 0.2, (self.WIDTH * self.DIM, self.FILTERS)),
            "cb": np.zeros(self.FILTERS),
            "h": r.normal(0, 0.2, (self.FILTERS + 1, self.HIDDEN)),
            "hb": np.zeros(self.HIDDEN),
            "o": r.normal(0, 0.3, self.HIDDEN),
            "ob": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_vector(self, flat: np.ndarray) -> None:
        """Weights are views of the vector from here on."""
        for k, v in self.p.items():
            self.p[k], flat = flat[: v.size].reshape(v.shape), flat[v.size :]

    def forward(self, x: np.ndarray, length: np.ndarray):
        """Place and height of each filter's maximum, inputs and outputs of the hidden layer, logits.

        Places are the last axis, so that inputs are copied and maxima found along
        neighbouring numbers; the product of one window is too small for BLAS to use threads.
        """
        n, t = x.shape[0], x.shape[1] - self.WIDTH + 1
        e = self.p["embed"].T.take(x, axis=1).swapaxes(0, 1)
        cols = np.empty((n, self.WIDTH, self.DIM, t))
        for k in range(self.WIDTH):
            cols[:, k] = e[:, :, k : k + t]
        c = self.p["conv"].T @ cols.reshape(n, -1, t)
        top = c.argmax(axis=2)
        pooled = np.maximum(np.take_along_axis(c, top[:, :, None], 2)[:, :, 0] + self.p["cb"], 0)
        f = np.column_stack([pooled, np.log2(np.maximum(length, 1)) / 8])
        h = np.maximum(f @ self.p["h"] + self.p["hb"], 0)
        return top, pooled, f, h, h @ self.p["o"] + self.p["ob"][0]

    def gradient(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the mean cross-entropy, as ``vector``."""
        top, pooled, f, h, z = self.forward(x, length)
        dz = (1 / (1 + np.exp(-z)) - y) / len(x)
        g = {"o": h.T @ dz, "ob": np.array([dz.sum()])}
        dh = dz[:, None] * self.p["o"] * (h > 0)
        g["h"], g["hb"] = f.T @ dh, dh.sum(0)
        dp = (dh @ self.p["h"].T)[:, : self.FILTERS] * (pooled > 0)
        g["cb"] = dp.sum(0)
        # what each byte at each place of each filter adds up to; the rest are two products
        seen = x[np.arange(len(x))[:, None, None], top[:, :, None] + np.arange(self.WIDTH)]  # rows, filters, places
        bins = seen * np.intp(self.WIDTH * self.FILTERS) + np.arange(self.FILTERS)[:, None] + np.arange(self.WIDTH) * self.FILTERS
        by = np.bincount(bins.ravel(), np.repeat(dp, self.WIDTH), 256 * self.WIDTH * self.FILTERS).reshape(256, -1)
        g["conv"] = (self.p["embed"].T @ by).reshape(self.DIM, self.WIDTH, self.FILTERS).transpose(1, 0, 2)
        g["embed"] = by @ self.p["conv"].reshape(self.WIDTH, self.DIM, self.FILTERS).transpose(0, 2, 1).reshape(-1, self.DIM)
        return np.concatenate([g[k].ravel() for k in self.p])

    def fit(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 4, whole: bool = False) -> None:
        """``steps`` batches, half of each label; ``whole``: as many as take each finding once at least."""
        r = np.random.default_rng(seed)
        weights = self.vector()
        self.set_vector(weights)
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        sides = [np.flatnonzero(y == 1), np.flatnonzero(y == 0)]
        if whole:
            steps = -(-max(map(len, sides)) // (batch // 2))
            passes = [np.resize(r.permutation(s), (steps, batch // 2)) for s in sides]
        for step in range(1, steps + 1):
            i = np.concatenate([s[step - 1] for s in passes] if whole else [r.choice(s, batch // 2) for s in sides])
            g = self.gradient(x[i], length[i], y[i])
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g**2
            weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.forward(x[i : i + ROWS], length[i : i + ROWS])[-1] for i in range(0, len(x), ROWS)]])

    def probability(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x, length) + self.shift, -50, 50)))

    def calibrate(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray, recall: float, least: float) -> None:
        """Platt scaling on left-out findings, then the recall-constrained threshold."""
        self.scale(self.logits(x, length), y, weight)
        found = np.sort(self.probability(x, length)[y == 1])
        self.threshold = max(least, float(found[int(len(found) * (1 - recall))])) if len(found) else 1.0

    def scale(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Platt scaling on logits."""
        ones, others = (weight * y).sum(), (weight * (1 - y)).sum()
        target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (others + 2))
        for _ in range(2000):
            p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50)))
            d = weight * (p - target) / weight.mean()
            self.slope -= 0.05 * ((d * z).mean() + 1e-3 * self.slope)
            self.shift -= 0.05 * d.mean()


def planted(x: np.ndarray, length: np.ndarray, seeds: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of a secret, PLANTED windows of secrets that no pattern meets, and their lengths: chosen by the seeds alone.

    Lengths vary, and contexts are those of windows ``around`` (or the secret's
    own, if there are none), with another name or without, so that neither tells
    a secret.
    """
    around = around if len(around) else x
    out, n = np.zeros((len(x) * PLANTED, WINDOW), np.uint8), np.repeat(length, PLANTED)
    for i, (row, size, seed) in enumerate(zip(x, length.tolist(), seeds.tolist(), strict=True)):
        r = np.random.default_rng(seed & (1 << 63) - 1)
        body = bytes(row[SIDE : SIDE + size])
        digits = np.frombuffer(_DIGITS[r.integers(len(_DIGITS))], np.uint8)
        recoded = digits[r.integers(0, len(digits), BODY)].tobytes()
        step = int(r.integers(4, 9))
        split = b"-".join((body.upper() if seed & 1 else body)[k : k + step] for k in range(0, size, step))
        for k, new in enumerate((body.upper(), recoded, split)):
            new = new[: int(r.integers(SHORTEST, (BODY if new is recoded else min(BODY, len(new))) + 1))].rstrip(b"-")
            context = around[r.integers(len(around))]
            w = out[i * PLANTED + k]
            w[:SIDE] = context[:SIDE]
            if name := _NAMED[r.integers(len(_NAMED))]:
                before = name + _SIGNS[r.integers(len(_SIGNS))]
                w[: SIDE - len(before)] = context[len(before) : SIDE]
                w[SIDE - len(before) : SIDE] = np.frombuffer(before, np.uint8)
            w[SIDE : SIDE + len(new)] = np.frombuffer(new, np.uint8)
            w[SIDE + BODY :] = context[SIDE + BODY :]
            n[i * PLANTED + k] = len(new)
    return out, n


def lesson(x: np.ndarray, length: np.ndarray, y: np.ndarray, h: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Findings and what is planted of their long secrets, with weights; without ``own``, these in the secrets' stead, if there are any."""
    long = (y == 1) & (length >= SHORTEST)
    more, n = planted(x[long], length[long], h[long], x[y == 0])
    kept = np.ones(len(y), bool) if own or not len(more) else y == 0
    # what is planted of a secret weighs as much as the secret
    weight = np.concatenate([np.ones(int(kept.sum())), np.full(len(more), 1 / PLANTED)])
    return np.concatenate([x[kept], more]), np.concatenate([length[kept], n]), np.concatenate([y[kept], np.ones(len(more))]), weight


def doubtful(x: np.ndarray, length: np.ndarray, y: np.ndarray, judges: list[Network] | None) -> np.ndarray:
    """Findings that no pattern meets but which a network that has not learnt them takes for secrets: they teach nothing.

    There are two judges, each taught without the half of these findings that it
    judges and without what the judges before put aside.
    """
    out = np.zeros(len(y), bool)
    others = np.flatnonzero(y == 0)
    for half, net in enumerate(judges or []):
        judged = others[half::2]
        out[judged[net.logits(x[judged], length[judged]) > 0]] = True
    return out


def taught(nets: list[Network], x: np.ndarray, length: np.ndarray, y: np.ndarray, judges: list[Network] | None, **how) -> list[Network | None]:
    """Copies of the networks after a lesson: one learns all that is not doubtful; of two each leaves out its half. None without both labels."""
    sure, others = ~doubtful(x, length, y, judges), np.flatnonzero(y == 0)
    out: list[Network | None] = []
    for half, start in enumerate(nets):
        use = sure.copy()
        if len(nets) == 2:
            use[others[half::2]] = False
        net = copy.deepcopy(start) if len(set(y[use])) == 2 else None
        if net:
            net.fit(x[use], length[use], y[use], **how)
        out.append(net)
    return out


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of candidates with their label, window and a hash that spreads them."""
    for batch in batches:
        labels, found, lengths, hashes = [], [], [], []
        for _, _, buf, starts, ends in K.pieces(batch.column("text")):
            ws, we, row = candidates(buf, starts)
            if not len(ws):
                continue
            hit = np.zeros(len(buf) + 1, np.int64)
            for _, a, _, b in base_spans(buf, starts, ends):
                hit[a:b] = 1
            hit = np.r_[0, np.cumsum(hit)]
            a, b, of = parts(ws, we)
            whole = (hit[we] - hit[ws])[of]
            labels.append((whole > 0) & (hit[b] - hit[a] >= np.minimum(whole, SHORTEST)))
            found += [w.tobytes() for w in windows(buf, starts, ends, a, b, row[of])]
            lengths.append(b - a)
            hashes.append(K.span_hashes(buf, a, b))
        if labels:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(labels)), pa.array(found, pa.binary()), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(hashes).view(np.int64))], names=["label", "bytes", "length", "h"])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["x"], np.uint8).reshape(-1, WINDOW), np.frombuffer(row["length"], np.int64), np.frombuffer(row["y"])


_PACKED = "task int, x binary, length binary, y binary, weight binary"


def _packer(held: bool, groups: dict[bool, int]):
    """Rows ordered by task and hash as one lesson a task. Of what is left out each finding counts in one task only."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("task", "label", "bytes", "length", "h")), strict=True))
        for task, some in itertools.groupby(rows, key=lambda r: r[0]):
            _, label, data, length, h = zip(*some, strict=True)
            x, n, y, w = lesson(np.frombuffer(b"".join(data), np.uint8).reshape(-1, WINDOW), np.array(length, np.int64), np.array(label, float), np.array(h, np.int64), not held)
            if held:
                own = np.where(y == 1, task < groups[True], task < groups[False])
                x, n, y, w = x[own], n[own], y[own], w[own]
            yield pa.RecordBatch.from_pylist([{"task": task, "x": x.tobytes(), "length": n.astype(np.int64).tobytes(), "y": y.tobytes(), "weight": w.tobytes()}], schema=pa.schema([("task", pa.int32()), *((c, pa.binary()) for c in ("x", "length", "y", "weight"))]))

    return pack


def _lessons(findings: DataFrame, total: dict[bool, int], block: int, held: bool) -> DataFrame:
    """A row for each task with the findings of one side, those of each label dealt to groups of about ``block``."""
    groups = {label: -(-n // block) for label, n in total.items()}
    tasks = max(groups.values())
    n = F.when(F.col("label"), F.lit(groups[True])).otherwise(F.lit(groups[False]))
    first = F.pmod(F.xxhash64("h"), n).cast("int")
    rows = findings.filter(F.col("held") == held).select("label", "h", "bytes", "length", F.explode(F.sequence(first, F.lit(tasks - 1), n)).alias("task"))
    width = min(tasks, 4096)
    dealt = rows.repartitionById(width, F.pmod("task", F.lit(width)).cast("int")).sortWithinPartitions("task", "h", "label")
    return cut(dealt.mapInArrow(_packer(held, groups), _PACKED), "lessons")


def _mean(lessons: DataFrame, nets: list[Network], judges: list[Network] | None) -> list[Network | None]:
    """The mean of the networks that each task has after a pass over its lesson; None of one that no task taught.

    Weights are added up as whole numbers of 2^-32, so sums do not depend on their order.
    """
    kind = pa.schema([("part", pa.int32()), ("sums", pa.binary()), ("counts", pa.binary())])
    shape = (len(nets), len(nets[0].vector()))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(len(nets), np.int64)
        for row in (r for b in batches for r in b.to_pylist()):
            for k, net in enumerate(taught(nets, *_unpacked(row), judges, rate=RATE, whole=True)):
                if net:
                    sums[k] += np.rint(net.vector() * 2**32).astype(np.int64)
                    counts[k] += 1
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId() % 64, "sums": sums.tobytes(), "counts": counts.tobytes()}], schema=kind)

    def added(table: pa.Table) -> pa.Table:
        both = {c: sum(np.frombuffer(b, np.int64) for b in table.column(c).to_pylist()).tobytes() for c in ("sums", "counts")}
        return pa.Table.from_pylist([{"part": table.column("part")[0].as_py(), **both}], schema=kind)

    schema = "part int, sums binary, counts binary"
    rows = lessons.mapInArrow(teach, schema).groupBy("part").applyInArrow(added, schema).collect()
    sums = sum(np.frombuffer(r.sums, np.int64).reshape(shape) for r in rows)
    counts = sum(np.frombuffer(r.counts, np.int64) for r in rows)
    out = copy.deepcopy(nets)
    for net, total, n in zip(out, sums, counts.tolist(), strict=True):
        net.set_vector(total / 2**32 / max(n, 1))
    return [net if n else None for net, n in zip(out, counts.tolist(), strict=True)]


def nth(values: DataFrame, n: int) -> float | None:
    """The n-th smallest z of a table, from 0: exact, by histograms of ever narrower ranges."""
    low, high, count = values.agg(F.min("z"), F.max("z"), F.count("z")).first()
    if not n < count:
        return None
    while low < high:
        place = F.least(F.lit(4095), F.floor((F.col("z") - F.lit(low)) / F.lit(high - low) * 4096)).cast("int")
        bins = values.filter(F.col("z").between(low, high)).groupBy(place.alias("bin")).agg(F.count("z").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
        for row in sorted(bins.collect()):
            if n < row.n:
                low, high = row.low, row.high
                break
            n -= row.n
    return low


def _calibrate(net: Network, lessons: DataFrame, recall: float, least: float) -> None:
    """As ``Network.calibrate``, over the lessons of all tasks."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            x, n, y = _unpacked(row)
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(net.logits(x, n)), pa.array(np.frombuffer(row["weight"]))], names=["y", "z", "weight"])

    judged = cut(lessons.mapInArrow(judge, "y double, z double, weight double"), "logits")
    sure = judged.filter("y = 1 OR z <= 0")
    if sure.filter("y = 0").isEmpty():
        sure = judged
    bins = sure.groupBy("y", F.round(F.least(F.greatest("z", F.lit(-100.0)), F.lit(100.0)) * 256).alias("bin")).agg(F.sum("weight").alias("weight")).orderBy("y", "bin").collect()
    y, z, weight = np.array([(r.y, r.bin / 256, r.weight) for r in bins]).T
    net.scale(z, y, weight)
    ones = sure.filter("y = 1").select("z")
    at = nth(ones, int(ones.count() * (1 - recall)))
    net.threshold = 1.0 if at is None else max(least, float(1 / (1 + np.exp(-np.clip(net.slope * at + net.shift, -50, 50)))))


def train(docs: DataFrame, block: int = BLOCK, recall: float = RECALL, least: float = 0.0) -> Network | None:
    """A network from all findings of a table with a column text; None without both labels.

    A finding is the distinct bytes of a part; of one that stands in several
    contexts the smallest window is taken, so reruns agree. Up to ``block`` of each
    label are learnt in the driver, more by tasks.
    """
    kinds = "label boolean, bytes binary, length long, h long"
    counted = docs.select("text").mapInArrow(_findings, kinds).groupBy("label", "h").agg(F.min("bytes").alias("bytes"), F.min("length").alias("length"))
    counted = cut(counted, "findings")
    total = {r.label: r.n for r in counted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return None
    # one in four of each label is left out: by place where there are few, by hash where there are many
    sides = []
    for label, n in total.items():
        own = counted.filter(F.col("label") == label)
        sides.append(own.withColumn("held", (F.row_number().over(W.orderBy("h")) - 1) % 4 == 0 if n <= block else F.pmod(F.xxhash64(F.lit("held"), "h"), F.lit(4)) == 0))
    findings = sides[0].unionByName(sides[1])
    many = max(total.values()) > block
    if many:
        findings = cut(findings, "sides")
        fit, held = (_lessons(findings, total, block, side) for side in (False, True))
        x, n, y = _unpacked(fit.orderBy("task").first().asDict())
    else:
        rows = findings.orderBy("h", "label").toArrow()
        x = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW)
        y, n, h = rows.column("label").to_numpy().astype(float), rows.column("length").to_numpy(), rows.column("h").to_numpy()
        out = rows.column("held").to_numpy()
        if len(set(y[out])) < 2 or len(set(y[~out])) < 2:
            return None
        x_held, n_held, y_held, w_held = lesson(x[out], n[out], y[out], h[out], False)
        x, n, y, _ = lesson(x[~out], n[~out], y[~out], h[~out], True)

    def learn(count: int, judges: list[Network] | None, steps: int) -> list[Network | None]:
        nets = taught([Network() for _ in range(count)], x, n, y, judges, steps=steps)
        for _ in range(ROUNDS if many else 0):
            nets = _mean(fit, [net or Network() for net in nets], judges)
        return nets

    judges = None
    for _ in range(2 if (y == 0).sum() >= 4 else 0):
        pair = learn(2, judges, 400)
        if None in pair:
            break
        judges = pair
        if not many and doubtful(x, n, y, judges).sum() == (y == 0).sum():
            judges = None
            break
    (net,) = learn(1, judges, 700)
    if net is None:  # all that no pattern meets is doubtful: then nothing is
        (net,) = learn(1, None, 700)
    if net is None:
        return None
    if many:
        _calibrate(net, held, recall, least)
        return net
    sure = (y_held == 1) | (net.logits(x_held, n_held) <= 0)
    if not (y_held[sure] == 0).any():
        sure[:] = True
    net.calibrate(x_held[sure], n_held[sure], y_held[sure], w_held[sure], recall, least)
    return net


def _scanner(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value if model is not None else None
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, _, buf, starts, ends in K.pieces(batch.column("text")):
                base = base_spans(buf, starts, ends)
                spans = [(r, a, k, b) for r, a, k, b in base]
                if net is not None:
                    ws, we, row = candidates(buf, starts)
                    if len(ws):
                        first, last, of = parts(ws, we)
                        p = net.probability(windows(buf, starts, ends, first, last, row[of]), last - first)
                        met = np.zeros(len(buf) + 1, np.int64)
                        for _, a, _, b in base:
                            met[a:b] = 1
                        met = np.r_[0, np.cumsum(met)]
                        new = np.zeros(len(ws), bool)
                        new[of[(p >= net.threshold) & (met[last] == met[first])]] = True
                        spans += [(int(r), int(a), len(KINDS), int(b)) for r, a, b in zip(row[new], ws[new], we[new], strict=True)]
                for r, own in itertools.groupby(sorted(spans), key=lambda s: s[0]):
                    point = np.r_[0, np.cumsum((buf[starts[r] : ends[r]] & 0xC0) != 0x80)]
                    found[i + r] = [{"kind": (*KINDS, ADDED)[k], "start": int(point[a - starts[r]]), "end": int(point[b - starts[r]])} for _, a, k, b in own]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return scan


def scan(docs: DataFrame, block: int = BLOCK, recall: float = RECALL, least: float = 0.0) -> DataFrame:
    """doc_id, spans (kind, start, end in code points) for every row, by start, then kind as listed.

    Kinds are assign, access, hex (the fixed patterns) and token (added by the
    network). A null or empty text has no spans; rows that repeat an id are
    scanned each for itself; a corpus without findings of both labels trains no
    network, and only the patterns' spans are reported.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    net = train(rows, block, recall, least)
    return rows.mapInArrow(_scanner(spark.sparkContext.broadcast(net) if net else None), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
