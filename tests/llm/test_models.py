import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from common import WORD, corpus, docs, prose
from pyspark.sql import functions as F

from strake.llm import langid, lm, quality, secrets
from strake.llm import textkit as K
from strake.llm.queries import fold


def folded(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


# op3


def brute_ppm(training, texts, contexts=lm.CONTEXTS):
    """log10 probability by walking the contexts of each symbol, with escapes and exclusions, from plain counts."""
    counts = [Counter() for _ in range(lm.DEPTH + 1)]
    total = 0
    for t in training:
        s = bytes([lm.BEGIN] * lm.DEPTH) + t + bytes([lm.END])
        for p in range(lm.DEPTH, len(s)):
            total += 1
            for k in range(lm.DEPTH + 1):
                counts[k][s[p - k : p], s[p]] += 1
    trie = []
    for k, c in enumerate(counts):
        by = {}
        for (ctx, s), n in c.items():
            by.setdefault(ctx, {})[s] = n
        trie.append({ctx: d for ctx, d in by.items() if k < 3 or sum(d.values()) * contexts >= total})
    out = []
    for t in texts:
        s = bytes([lm.BEGIN] * lm.DEPTH) + t + bytes([lm.END])
        score = 0.0
        for p in range(lm.DEPTH, len(s)):
            excluded = set()
            for k in range(lm.DEPTH, -1, -1):
                seen = {x: n for x, n in trie[k].get(s[p - k : p], {}).items()}
                if not seen:
                    continue
                left = {x: n for x, n in seen.items() if x not in excluded}
                if not left:
                    continue
                q, n = len(left), sum(left.values())
                if s[p] in left:
                    score += math.log10((2 * left[s[p]] - 1) / (2 * n))
                    break
                score += math.log10(q / (2 * n))
                excluded = set(seen)
            else:
                score -= math.log10(lm.UNIVERSE - len(trie[0].get(b"", {})))
        out.append(score)
    return out


@pytest.mark.parametrize("contexts", [60, lm.CONTEXTS])
def test_ppm_and_base_are_brute_force(spark, contexts):
    rows = [r for r in corpus(6, 50) if r[0] != 7000]
    found = lm.score(docs(spark, rows), fold(5) != 1, contexts=contexts).collect()
    training = [t or "" for i, t, *_ in rows if i is not None and folded(i, 5) != 1]
    counts = Counter(w for t in training for w in [*WORD.findall(lower(t)), "\0end"])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    want = {}
    for (i, t, *_), score in zip(rows, brute_ppm([t.encode() for t in training], [(t or "").encode() for _, t, *_ in rows], contexts), strict=True):
        tokens = [*WORD.findall(lower(t)), "\0end"]
        want[i] = (i is None or folded(i, 5) == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), score)
    for r in found:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-6) and r.score == pytest.approx(w[5], rel=1e-5, abs=1e-4)


@pytest.mark.parametrize(("partitions", "direct"), [(3, 1024), (48, 1024), (12, 0)])
def test_ppm_keeps_rare_contexts(spark, partitions, direct):
    """However many symbols are learnt, contexts that occur once count; with many buckets some contexts are hot."""
    rows = [(i, prose(i, 300)) for i in range(150)] + [(900 + i, prose(i, 40) + " Zq%d rare" % i) for i in range(12)]
    training = [t.encode() for i, t in rows if folded(i, 5) != 1]
    assert sum(map(len, training)) > 1.2 * lm.CONTEXTS
    got = {r.doc_id: r.score for r in lm.score(docs(spark, rows), fold(5) != 1, partitions, direct=direct).collect()}
    some = rows[:6] + rows[-12:]
    for (i, _), want in zip(some, brute_ppm(training, [t.encode() for _, t in some], 1 << 60), strict=True):
        assert got[i] == pytest.approx(want, rel=1e-5, abs=1e-4)


def test_ppm_beats_the_words_on_held_out_text(spark):
    """On held-out documents of the given tables, though the words' score does not spell unknown words."""
    found = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), fold(5) != 1)
    r = found.filter("held_out").agg(F.sum("score").alias("p"), F.sum("base_score").alias("b")).first()
    assert r.p > 0.98 * r.b


def test_ppm_without_training(spark):
    r = lm.score(docs(spark, [(1, "abc")]), F.lit(False)).first()
    assert r.train_tokens == 0 and r.score == pytest.approx(-4 * math.log10(lm.UNIVERSE))
    assert lm.score(docs(spark, []), fold(5) != 1).count() == 0


# op4


def _languages(n=160):
    syllables = {"aa": "ba be bi bo bu", "bb": "xi xo zu zy qa", "cc": "né lé à çu ère"}
    r = np.random.default_rng(0)
    out = []
    for i in range(n):
        lang = list(syllables)[i % 3]
        out.append((i, " ".join("".join(r.choice(syllables[lang].split(), 3)) for _ in range(30)), lang))
    return out


def test_language_id_on_held_out(spark):
    rows = [*_languages(), (900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, "babe bibo", None), (None, "néléà", "cc"), (900, None, "aa")]
    out = langid.identify(docs(spark, rows), fold(3) != 1).select("doc.doc_id", "lang_pred", "score").collect()
    assert len(out) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    for r in out:
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id == 903:
            assert r.lang_pred == "aa"
        else:
            assert r.lang_pred == truth[r.doc_id] and 0.3 < r.score <= 1


def test_language_id_learns_from_text_alone(spark):
    """lang, source and id of what is judged, and rows of the held-out fold, change nothing."""
    rows = _languages(90)
    base = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, rows), fold(3) != 1).select("doc.doc_id", "lang_pred", "score").collect()}
    other = [(i, t, "zz" if folded(i, 3) == 1 else lang, f"s{i}") for i, t, lang in rows]
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, other), fold(3) != 1).select("doc.doc_id", "lang_pred", "score").collect()} == base


def test_language_id_bounds_languages_and_takes_long_texts(spark):
    """Of very many values of lang the most frequent are learnt; a very long text is judged whole."""
    rows = _languages(120)
    junk = [(5000 + i, prose(i, 5), f"junk{i:04d}") for i in range(400)]
    long = (9000, " ".join(t for _, t, lang in rows if lang == "bb") * 300 + " ba be", None)
    model = langid.train(docs(spark, [*rows, *junk]).select("doc_id", "text", "lang"), languages=3)
    assert model.langs == ["aa", "bb", "cc"] and model.table.shape == (langid.FEATURES, 3)
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, [*rows, *junk, long]), fold(3) != 1, languages=3).select("doc.doc_id", "lang_pred").collect()}
    assert out[9000] == "bb" and all(out[i] == lang for i, _, lang in rows)


def test_language_ties_go_to_the_first():
    model = langid.Model(["aa", "bb"], np.zeros((langid.FEATURES, 2), np.float32), np.zeros(2))
    batch = pa.RecordBatch.from_arrays([pa.array([{"text": "abc"}]), pa.array([True])], names=["doc", "letter"])
    out = next(langid._predictor(type("B", (), {"value": model}), ["doc", "lang_pred", "score"], False)(iter([batch])))
    assert out.column("lang_pred").to_pylist() == ["aa"] and out.column("score").to_pylist() == [0.5]


def test_language_id_without_labels(spark):
    rows = [(i, t, None) for i, t, _ in _languages(9)]
    assert {(r.lang_pred, r.score) for r in langid.identify(docs(spark, rows), fold(3) != 1).collect()} == {("und", 0.0)}
    assert langid.identify(docs(spark, []), fold(3) != 1).count() == 0
    table = docs(spark, _languages(60))
    assert langid.accepted_rows(table, fold(3) != 1).columns == table.columns


def test_features_respect_rows_and_characters():
    buf, s, e = K.joined(["aé", "b", "", "Aé"])
    points, row = langid.characters(buf, s, e)
    assert points.tolist() == [97, 233, 98, 97, 233] and row.tolist() == [0, 0, 1, 3, 3]
    got = [sorted(zip(r.tolist(), f.tolist(), strict=True)) for f, r in langid.features(points, row)]
    assert len(got[0]) == 5 and len(got[1]) == 2 and len(got[2]) == 0 and got[1][0][1] == got[1][1][1]


def test_temperature_calibrates():
    r = np.random.default_rng(1)
    z = r.normal(0, 1, (4000, 3))
    y = np.array([r.choice(3, p=p) for p in langid.softmax(z)])
    assert langid.temperature(z * 4, y) == pytest.approx(4, rel=0.15)


# op6


def _quality(n=900):
    r = np.random.default_rng(2)
    out, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 60) if good else " ".join(w + r.choice(["%%%", "$$$", "!!"]) for w in prose(i, 60).split())
        source = "books" if (r.random() < 0.8) == good else "web"
        out.append((i, text, "en", source))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    return out, labels


def test_quality_on_unlabelled(spark):
    rows, labels = _quality()
    rows += [(None, None, None, None), (5000, "", None, "web"), (5000, "", None, "web")]
    table = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0), (0, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs(spark, rows), table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    known = {i for i, *_ in labels}
    judged = [(r.keep, r.doc_id % 4 != 0) for r in out if r.doc_id is not None and r.doc_id < 900 and r.doc_id not in known]
    assert np.mean([a == b for a, b in judged]) > 0.97
    by_meta = [(r.p_meta >= 0.5, r.doc_id % 4 != 0) for r in out if r.doc_id is not None and r.doc_id < 900]
    assert np.mean([a == b for a, b in by_meta]) > 0.6


def test_quality_exchanges_labels():
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 600)
    text, meta = r.normal(0, 1, (600, 4)) + 2 * y[:, None], r.normal(0, 1, (600, 3)) + 1.5 * y[:, None]
    label = np.where(np.arange(600) < 60, y, -1)
    model = quality.co_train(text, meta, label)
    assert (model.score(text, meta)[2].round() == y).mean() > 0.95
    assert quality.co_train(text, meta, np.full(600, -1)) is None


def test_quality_takes_the_surest_of_all_documents(spark):
    """Over a table in many partitions the same rows are taken as in memory, none twice."""
    r = np.random.default_rng(6)
    text, codes = r.normal(0, 1, (500, quality.TEXT_FEATURES)).astype(np.float16).astype(np.float32), r.integers(0, 60, (500, 3)).astype(np.uint8)
    meta = quality.meta_features(codes)
    models = [quality.Logistic().fit(x[:200], r.integers(0, 2, 200).astype(float)) for x in (text, meta)]
    rows = [(i, x) for i, x in enumerate(quality.packed(text, codes))]
    table = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, x binary").repartition(13)
    here, there = quality.Rows(text, meta), quality.Documents(table)
    for _ in range(3):
        a, b = here.take(models, 15, 0.6), there.take(models, 15, 0.6)
        assert [(k, v) for k, v, _ in a] == [(k, v) for k, v, _ in b]
        for (_, _, x), (_, _, y) in zip(a, b, strict=True):
            assert len(x[0]) and all((m == n).all() for m, n in zip(x, y, strict=True))
    assert sorted(set(range(500)) - there.taken) == here.left.tolist()


def test_quality_without_labels(spark):
    rows, _ = _quality(12)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.keep) for r in quality.classify(docs(spark, rows), none).collect()} == {(0.5, True)}
    assert quality.classify(docs(spark, []), none).count() == 0


# op7

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def _secrets():
    r = np.random.default_rng(4)
    hexes = ["".join(r.choice(list("0123456789abcdef"), 40)) for _ in range(240)]
    rows = [(i, f'{prose(i, 12)} token = "{h}" {prose(i + 1, 9)} {10**15 + i * 7919}') for i, h in enumerate(hexes)]
    rows += [
        (1000, "é PassWord: 'hunter22' née api-key=x apikey=\"abc.def=\" Secret:token=abcdefg password=token:abcdef"),
        (1001, "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 13 + " AKIA123"),
        (1002, "ſecret=abcdefgh toKen=abcdefgh " + "a" * 24 + "g" + "b" * 23),
        (1003, None),
        (1004, ""),
        (1005, "token token=12345 passwd = \n abcdef token==abcdef"),
        (None, "secret=abcdef"),
        (1000, "secret=abcdef"),
        (1006, prose(1, 20_000) + " password=abcdef"),
        (1007, f"see {''.join(r.choice(list('0123456789abcdef'), 20)).upper()}{''.join(r.choice(list('0123456789ABCDEF'), 20))} here"),
    ]
    return rows


def test_secret_scan_base_spans(spark):
    rows = _secrets()
    found = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans if s.kind != "token"]) for r in secrets.scan(docs(spark, rows)).collect())
    assert found == sorted((str(i), base(t)) for i, t in rows)


def test_secret_network_finds_what_patterns_miss():
    rows = _secrets()[:240]
    column = pa.array([t for _, t in rows])
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    got = next(secrets._findings(iter([batch])))
    y = got.column("label").to_numpy(zero_copy_only=False).astype(float)
    x = np.frombuffer(b"".join(got.column("bytes").to_pylist()), np.uint8).reshape(-1, secrets.WINDOW)
    length = got.column("length").to_numpy()
    net = secrets.Network()
    held = np.arange(len(y)) % 4 < 2
    net.fit(x[~held], length[~held], y[~held])
    net.calibrate(x[held], length[held], y[held], np.ones(held.sum()), 0.99, 0.5)
    p = net.probability(x[held], length[held])
    assert 0 < y[held].mean() < 1
    assert (p[y[held] == 1] >= net.threshold).mean() >= 0.98 and (p[y[held] == 0] >= net.threshold).mean() <= 0.02


def _hidden(seed, n=60):
    """Texts with a secret that no pattern meets, or with a run that is none, and whether it is one."""
    r = np.random.default_rng(seed)
    digits = {"upper": "0123456789ABCDEF", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
    out = []
    for i in range(n):
        for kind, of in digits.items():
            body = "".join(r.choice(list(of), int(r.integers(28, 44))))
            out.append((f"{prose(i, 8)} {r.choice(['pwd=', 'my key is ', 'auth: ', ''])}{body} {prose(i + 9, 6)}", body, True, kind))
        card, day, call = "".join(map(str, r.integers(0, 10, 16))), f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}", f"555-{r.integers(1000, 9999)}"
        for body in (card, day, call, prose(i + 300, 6).replace(" ", "-"), prose(i + 400, 5).replace(" ", "/")):
            out.append((f"{prose(i + 600, 9)} {body} {prose(i + 700, 7)}", body, False, ""))
    return out


def test_secret_scan_adds_secrets_whose_pattern_is_hidden(spark):
    """The patterns' findings teach the network; what no pattern meets is found, and cards, dates, calls and words are left alone."""
    r = np.random.default_rng(7)
    known = [f'{prose(i, 12)} token = "{"".join(r.choice(list("0123456789abcdef"), 40))}" {prose(i + 1, 9)}' for i in range(240)]
    hidden, decoys = _hidden(8, 20), _hidden(9, 120)
    rows = [*enumerate([*known, *(t for t, _, is_, _ in decoys if not is_)]), *((10_000 + i, t) for i, (t, *_) in enumerate(hidden))]
    found = {r.doc_id: [t[s.start : s.end] for s in r.spans if s.kind == "token"] for t, r in ((dict(rows)[r.doc_id], r) for r in secrets.scan(docs(spark, rows)).collect())}
    told = [(any(body in s for s in found[10_000 + i]), is_, kind) for i, (_, body, is_, kind) in enumerate(hidden)]
    for kind in ("upper", "base64", "base62"):
        assert np.mean([f for f, _, k in told if k == kind]) >= 0.9, kind
    assert np.mean([f for f, is_, _ in told if not is_]) <= 0.02
    assert not any(found[i] for i in range(240))


def test_planted_secrets_are_met_by_no_pattern():
    rows = _secrets()[:60]
    got = next(secrets._findings(iter([pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])])))
    y = got.column("label").to_numpy(zero_copy_only=False)
    x, n = np.frombuffer(b"".join(got.column("bytes").to_pylist()), np.uint8).reshape(-1, secrets.WINDOW)[y], got.column("length").to_numpy()[y]
    h, others = got.column("h").to_numpy()[y], np.full((3, secrets.WINDOW), 32, np.uint8)
    more, size = secrets.planted(x, n, h, others)
    assert len(more) == secrets.PLANTED * len(x) and (more == secrets.planted(x, n, h, others)[0]).all()
    texts = [bytes(w[: secrets.SIDE + s]).decode("latin-1") for w, s in zip(more, size, strict=True)]
    assert not any(ASSIGN.search(t) for t in texts) and np.mean([bool(base(t)) for t in texts]) < 0.02


def test_candidates_are_all_but_plain_words():
    text = "Wordlike words wordsandwords self-evident 2024-01-02 abcDefgh a_b_c_d_e short1 aaaaaaaaaaaaaaaaaaaa Https://x.y/abcdefgh CAPITALS xCAPITALS"
    buf, s, e = K.joined([text, "Abcdefgh", "abcdefgH"])
    a, b, row = secrets.candidates(buf, s)
    assert [buf[x:y].tobytes().decode() for x, y in zip(a, b, strict=True)] == ["2024-01-02", "abcDefgh", "a_b_c_d_e", "aaaaaaaaaaaaaaaaaaaa", "y/abcdefgh", "xCAPITALS", "abcdefgH"]


def test_secret_network_sees_whole_runs():
    """A token anywhere in a long run is looked at, after a pattern's match too."""

    class Marked:
        threshold, value = 0.5, property(lambda self: self)

        def probability(self, x, length):
            return np.array([float(bytes(w[secrets.SIDE : secrets.SIDE + secrets.BODY]).count(b"Z9") >= 8) for w in x])

    token = "Z9" * 8
    texts = [f"{'x' * n}/{token}{'y' * k} {'x' * 70}1" for n in (0, 40, 47, 60, 200) for k in (0, 30, 100)] + ["ab" * 12 + "x" * 60 + token]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    out = next(secrets._scanner(Marked())(iter([batch]))).column("spans").to_pylist()
    assert [[(s["start"], s["end"]) for s in spans if s["kind"] == "token"] for spans in out] == [[(0, len(t.split(" ")[0]))] for t in texts]
    a, b, of = secrets.parts(np.array([0, 100, 300]), np.array([48, 149, 316]))
    assert list(zip(a.tolist(), b.tolist(), of.tolist(), strict=True)) == [(0, 48, 0), (100, 148, 1), (101, 149, 1), (300, 316, 2)]


def test_secret_threshold_is_the_recall_quantile(spark, monkeypatch):
    """Secrets that the network is unsure of pull the threshold below one half."""
    seen = []
    calibrate = secrets.Network.calibrate
    monkeypatch.setattr(secrets.Network, "fit", lambda self, *a, **k: None)
    monkeypatch.setattr(secrets.Network, "calibrate", lambda self, x, n, y, w, recall, least: (calibrate(self, x, n, y, w, recall, least), seen.append(np.sort(self.probability(x, n)[y == 1]))))
    net = secrets.train(docs(spark, _secrets()))
    assert net.threshold == seen[0][int(len(seen[0]) * (1 - secrets.RECALL))] < 0.5


def test_secret_network_learns_every_finding(spark, monkeypatch):
    """More findings than a block: each is in a lesson, each left-out one in the threshold, and what is hidden is found as by one task."""
    made = []
    written = secrets.cut
    monkeypatch.setattr(secrets, "cut", lambda df, name: (made.append((name, written(df, name))), made[-1][1])[1])
    r = np.random.default_rng(7)
    known = [f'{prose(i, 12)} token = "{"".join(r.choice(list("0123456789abcdef"), 40))}" {prose(i + 1, 9)}' for i in range(240)]
    hidden, decoys = _hidden(8, 20), _hidden(9, 120)
    rows = [*enumerate([*known, *(t for t, _, is_, _ in decoys if not is_)]), *((10_000 + i, t) for i, (t, *_) in enumerate(hidden))]
    nets = []
    train = secrets.train
    monkeypatch.setattr(secrets, "train", lambda *a: nets.append(train(*a)) or nets[-1])
    texts = dict(rows)
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "token"] for r in secrets.scan(docs(spark, rows), 100).collect()}
    assert [name for name, _ in made] == ["findings", "sides", "lessons", "lessons", "logits"]
    (_, findings), (_, sides), (_, fit), (_, held), (_, logits) = made
    assert findings.count() == sides.count() > 500
    fit, held = ([(bytes(w), float(k), n) for row in t.collect() for w, k, n in zip(*(secrets._unpacked(row.asDict())[i] for i in (0, 2, 1)), strict=True)] for t in (fit, held))
    sides = sides.collect()
    assert {(bytes(r.bytes), float(r.label), r.length) for r in sides if not r.held} <= set(fit)
    assert sorted(w for w, k, _ in held if not k) == sorted(bytes(r.bytes) for r in sides if r.held and not r.label)
    assert sum(k for _, k, _ in held) == secrets.PLANTED * sum(r.label and r.held and r.length >= secrets.SHORTEST for r in sides)
    z = np.sort([r.z for r in logits.collect() if r.y])
    at = z[int(len(z) * (1 - secrets.RECALL))]
    (net,) = nets
    assert len(z) == sum(k for _, k, _ in held) and net.threshold == pytest.approx(1 / (1 + np.exp(-(net.slope * at + net.shift))), rel=1e-12)
    told = [(any(body in s for s in found[10_000 + i]), is_) for i, (_, body, is_, _) in enumerate(hidden)]
    assert np.mean([f for f, is_ in told if is_]) >= 0.9 and np.mean([f for f, is_ in told if not is_]) <= 0.02


def test_secret_pass_takes_each_finding(monkeypatch):
    x, y = np.zeros((150, secrets.WINDOW), np.uint8), np.array([0] * 139 + [1] * 11, float)
    seen = set()
    forward = secrets.Network.forward
    monkeypatch.setattr(secrets.Network, "forward", lambda self, x, n: (seen.update(n.tolist()), forward(self, x, n))[1])
    secrets.Network().fit(x, np.arange(150), y, whole=True)
    assert seen == set(range(150))


def test_secret_gradients():
    """The network's analytic gradient is that of its loss."""
    r = np.random.default_rng(5)
    x, n, y = r.integers(0, 256, (6, secrets.WINDOW)).astype(np.uint8), np.full(6, 20), np.array([0, 1, 0, 1, 0, 1.0])
    net = secrets.Network()

    def loss(net):
        z = net.forward(x, n)[-1]
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z))))

    before = loss(net)
    net.fit(x, n, y, steps=60, batch=12)
    assert loss(net) < 0.3 * before


def _plain_pass(net, x, n, y):
    """Logits and gradient by way of every window's inputs, written out."""
    p, e = net.p, net.p["embed"][x]
    cols = np.lib.stride_tricks.sliding_window_view(e, net.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - net.WIDTH + 1, -1)
    c = cols @ p["conv"] + p["cb"]
    top = c.argmax(axis=1)
    pooled = np.maximum(np.take_along_axis(c, top[:, None, :], 1)[:, 0], 0)
    f = np.column_stack([pooled, np.log2(np.maximum(n, 1)) / 8])
    h = np.maximum(f @ p["h"] + p["hb"], 0)
    z = h @ p["o"] + p["ob"][0]
    dz = (1 / (1 + np.exp(-z)) - y) / len(x)
    dh = dz[:, None] * p["o"] * (h > 0)
    dp = (dh @ p["h"].T)[:, : net.FILTERS] * (pooled > 0)
    at = np.take_along_axis(cols, top[:, :, None], 1)
    embed = np.zeros_like(p["embed"])
    of = np.einsum("nf,if->nfi", dp, p["conv"]).reshape(len(x), net.FILTERS, net.WIDTH, net.DIM)
    np.add.at(embed, x[np.arange(len(x))[:, None, None], top[:, :, None] + np.arange(net.WIDTH)], of)
    g = {"embed": embed, "conv": np.einsum("nfi,nf->if", at, dp), "cb": dp.sum(0), "h": f.T @ dh, "hb": dh.sum(0), "o": h.T @ dz, "ob": np.array([dz.sum()])}
    return z, np.concatenate([g[k].ravel() for k in p])


def test_secret_network_learns_in_less_time_than_plainly():
    """The same logits and gradient, also of texts' ends and of bytes over 127, in less than two thirds of the CPU time."""
    r = np.random.default_rng(6)
    x, n, y = r.integers(0, 256, (64, secrets.WINDOW)).astype(np.uint8), r.integers(8, 49, 64), r.integers(0, 2, 64).astype(float)
    x[:16, 60:], x[16:32] = 0, x[32:48]
    net = secrets.Network()
    net.p["cb"] += r.normal(0, 0.2, net.FILTERS)
    z, g = _plain_pass(net, x, n, y)
    assert np.allclose(net.logits(x, n), z, rtol=1e-10, atol=1e-12)
    assert np.allclose(net.gradient(x, n, y), g, rtol=1e-9, atol=1e-12) and (g != 0).mean() > 0.1

    def spent(work):
        times = []
        for _ in range(9):
            begun = time.thread_time()
            work()
            times.append(time.thread_time() - begun)
        return min(times)

    plain = spent(lambda: [_plain_pass(net, x, n, y) for _ in range(12)])
    assert spent(lambda: net.fit(x, n, y, steps=12)) < plain * 2 / 3


def test_secret_scan_without_findings(spark):
    out = secrets.scan(docs(spark, [(1, prose(1, 20)), (2, "secret=abcdef")])).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in out) == [(1, 0), (2, 1)]
    assert secrets.scan(docs(spark, [])).count() == 0
