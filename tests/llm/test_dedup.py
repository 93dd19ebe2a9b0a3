from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from common import WORD, corpus, docs, prose, sha
from pyspark.sql import functions as F

from strake.llm import exact, exchange, jaccard, suffix
from strake.llm.components import components


def removed(rows, threshold=50):
    """Spans and kept bytes by checking every window against all documents with smaller ids."""
    ids = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in ids:
        for p in range(len(b) - threshold + 1):
            w = b[p : p + threshold]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in ids:
        gone = bytearray(len(b))
        for p in range(len(b) - threshold + 1):
            if first[b[p : p + threshold]] < i:
                gone[p : p + threshold] = b"\1" * threshold
        spans = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(bytes(gone), np.uint8).astype(int), 0])).tolist()
        out.append((spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("seed", "partitions", "direct"), [(1, None, 1024), (2, None, 1024), (1, 5, 0), (2, 10, 0)])
def test_suffix_dedup_is_brute_force(spark, seed, partitions, direct):
    """With and without relays between blocks and buckets."""
    rows = corpus(seed)
    found = sorted(((r.doc_id if r.doc_id is not None else 1 << 62), r.n_bytes, r.spans, bytes(r.kept)) for r in suffix.suffix_dedup(docs(spark, rows), partitions=partitions, direct=direct).collect())
    want = sorted(((i if i is not None else 1 << 62), len((t or "").encode()), s, k) for (i, t, *_), (s, k) in zip(rows, removed(rows), strict=True))
    assert found == want
    assert any(s for _, _, s, _ in found)


def test_suffix_dedup_across_pieces_and_blocks(spark):
    """A passage in many documents is cut everywhere but in the first, however they are dealt."""
    passage = prose(3, 60)
    rows = [(i, prose(100 + i, 30) + "|" + passage + "|" + prose(200 + i, 30)) for i in range(120)]
    found = {r.doc_id: bytes(r.kept).decode() for r in suffix.suffix_dedup(docs(spark, rows), partitions=7).collect()}
    assert passage in found[0] and not any(passage in found[i] for i in range(1, 120))
    assert [(s, k) for s, k in removed(rows)][5][1] == found[5].encode()


def test_suffix_dedup_empty(spark):
    assert suffix.suffix_dedup(docs(spark, [])).collect() == []


def test_radix_groups_order_equal_windows():
    data = np.frombuffer(b"abcabcabcabcxabcabcabc" * 40, np.uint8)
    at = np.arange(len(data) - 20)
    for depth in (5, 8, 13, 20):
        group = suffix.radix_groups(data, at, depth)
        by = defaultdict(set)
        for g, p in zip(group.tolist(), at.tolist(), strict=True):
            by[bytes(data[p : p + depth])].add(g)
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_even_keys_are_even():
    for n, each in ((1, 1), (4, 3), (51, 2), (211, 1)):
        keys = exchange.even_keys(n, each)
        assert len(set(keys)) == each * n
        assert (np.bincount(exchange._murmur3(np.array(keys)).astype(np.int64) % n, minlength=n) == each).all()


def test_relays_send_fewer_rows(spark):
    """Rows of each step grow with n * sqrt(n) by relays, with the square of n without; what is said is the same."""
    rows = spark.createDataFrame([(i, prose(i, 30)) for i in range(400)], "doc_id long, text string")

    def sent(n, direct):
        blocks, route = exchange.in_blocks(rows, n, direct)

        def asks(table):
            sizes = np.ones(route.n, np.int64)
            blk = table.column("blk")[0].as_py()
            return route.asks(blk, [(np.full(route.n, blk), sizes)])

        asked = blocks.groupBy("blk").applyInArrow(asks, exchange.ROWS).cache()
        found = route.answer(asked, lambda columns: [(columns[0][0] * 2, columns[0][1])])
        for r in found.groupBy("key").agg(F.collect_list("payload").alias("p")).collect():
            ids, _, ((data, sizes),) = exchange.opened([bytes(p) for p in r.p])
            assert sorted(ids.tolist()) == list(range(n)) and (data == 2 * r.key).all() and (sizes == 1).all()
        return asked.count()

    blocks = {n: exchange.in_blocks(rows, n)[0].select("blk").distinct().count() for n in (16, 64)}
    for n, root in ((16, 4), (64, 8)):
        assert sent(n, 1024) == blocks[n] * n and sent(n, 0) == blocks[n] * root


def test_pack_round_trip():
    arrays = [np.arange(5, dtype=np.uint16), np.zeros(0, np.int64), np.array([1.5])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, exchange.unpack(exchange.pack(*arrays)), strict=True))


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_exact_dedup_is_brute_force(spark, partitions):
    rows = corpus(3, 80)
    by = defaultdict(list)
    for n, (i, t, *_) in enumerate(rows):
        t = t or ""
        by["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i is None, i or 0, n))
    want = []
    for norm, group in by.items():
        best = min(group)
        for g in group:
            i = rows[g[3]][0]
            want.append((str(i), str(rows[best[3]][0]), len(group), sha(norm.encode())))
    out = exact.exact_dedup(docs(spark, rows), partitions).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == sorted(want)
    assert sum(r.kept for r in out) == len(by) and all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_dedup_of_one_hot_text(spark):
    """One text in nearly all rows spreads over the partitions and is still one group."""
    rows = [(i, "the same text\n" + " " * (i % 3)) for i in range(500)] + [(1000 + i, prose(i, 5)) for i in range(20)]
    out = exact.exact_dedup(docs(spark, rows), 9).collect()
    hot = [r for r in out if r.doc_id < 500]
    assert {(r.keep_id, r.group_size) for r in hot} == {(2, 500)} and [r.doc_id for r in hot if r.kept] == [2]
    kept = exact.unique_rows(docs(spark, rows), 9)
    assert kept.columns == docs(spark, rows).columns and kept.count() == 21


def test_exact_dedup_of_copies_that_tie(spark):
    """Copies of one text without an id spread over the partitions, and one of them stays."""
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.col("id").alias("other"))
    marked = exact._marked(rows, False, 9)
    per = [r["count"] for r in marked.groupBy("_part").count().collect()]
    assert len(per) == 9 and max(per) < 2 * 100_000 / 9
    out = exact.exact_dedup(rows, 9).groupBy("kept", "group_size", "keep_id").count().collect()
    assert sorted(map(tuple, out)) == [(False, 100_000, None, 99_999), (True, 100_000, None, 1)]
    assert exact.unique_rows(rows, 9).count() == 1


def test_unique_rows_hold_no_texts(spark):
    """A run of long texts is counted, not kept: the memory of a worker stays small."""
    text = "x" * 100_000
    part = pa.RecordBatch.from_arrays([pa.array([1] * 100), pa.array([text] * 100), pa.array(["s"] * 100), pa.array([text] * 100)], names=["_id", "_doc", "_sha", "_norm"])
    before = pa.total_allocated_bytes()
    most = 0

    def batches():
        nonlocal most
        for _ in range(30):
            yield pa.RecordBatch.from_arrays([c.take(pa.array(range(100))) for c in part.columns], names=part.schema.names)
            most = max(most, pa.total_allocated_bytes() - before)

    class Task:
        partitionId = staticmethod(lambda: 0)

    monkey, exact.TaskContext = exact.TaskContext, type("C", (), {"get": staticmethod(lambda: Task)})
    try:
        out = list(exact._runs(["_doc", "_sha"], True)(batches()))
    finally:
        exact.TaskContext = monkey
    assert [(b.num_rows, b.column("_size").to_pylist()) for b in out] == [(1, [3000])] and most < 100_000_000


def test_runs_of_one_digest_are_told_apart(spark, monkeypatch):
    """Texts that share a digest are compared in full, inside a partition and across partitions."""
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lit("same"))
    rows = [(i, "a" * 40 + "bcd"[i // 20]) for i in range(60)]
    for n in (1, 7):
        assert {r.group_size for r in exact.exact_dedup(docs(spark, rows), n).collect()} == {20}
        assert exact.unique_rows(docs(spark, rows), n).count() == 3


def test_exact_dedup_empty(spark):
    assert exact.exact_dedup(docs(spark, [])).count() == 0


def links(rows, threshold=0.8, n=5):
    """Links between texts, classes and copies by comparing all pairs."""
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        if i is not None and w:
            sets.setdefault(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))), []).append(i)
    texts = list(sets)
    edges = [(a, b) for x, a in enumerate(texts) for b in texts[:x] if 10 * len(a & b) >= 8 * len(a | b)]
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in edges:
        root[find(a)] = find(b)
    least = {}
    for t in texts:
        least[find(t)] = min(least.get(find(t), 1 << 62), *sets[t])
    out = {}
    for t in texts:
        for i in sets[t]:
            out[i] = (least[find(t)], sum(t in e for e in edges), len(sets[t]))
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_are_all_pairs(spark, block):
    rows = corpus(4, 120)
    base = prose(42, 60).split()
    for k in range(30):  # a cluster that does not fit in a block of 4
        words = list(base)
        words[k] = f"w{k}"
        rows.append((2000 + k, " ".join(words)))
    want = links(rows)
    found = jaccard.near_duplicates(docs(spark, rows), block=block).collect()
    assert len(found) == len(rows)
    for r in found:
        text_less = r.doc_id is None or r.doc_id not in want
        assert (r.class_id, r.n_links, r.n_copies) == ((r.doc_id, 0, 1) if text_less else want[r.doc_id])
    assert max(r.n_links for r in found) > 10


def test_one_of_each_keeps_columns_and_clean_rows(spark):
    rows = corpus(4, 60)
    table = docs(spark, rows)
    kept = jaccard.one_of_each(table)
    want = links(rows)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows if i is None or i not in want or want[i][0] == i}
    assert jaccard.one_of_each(docs(spark, [])).count() == 0


def test_least_matches_follow_the_posterior():
    least = jaccard.least_matches()
    assert all(least[n] <= 0.8 * n for n in least) and least[96] > least[16] and least[96] / 96 > 0.4


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_texts_and_many_blocks(spark):
    """Blocks without a window, and blocks without a document, are no trouble to any operator."""
    rows = [(i, prose(i, 2)) for i in range(12)] + [(50, prose(70, 40)), (51, prose(70, 40))]
    table = docs(spark, rows)
    got = {r.doc_id: (r.spans, bytes(r.kept)) for r in suffix.suffix_dedup(table, partitions=40).collect()}
    assert got == {i: v for (i, *_), v in zip(rows, removed(rows), strict=True)}
    assert suffix.suffix_dedup(docs(spark, rows[:12]), partitions=5).filter("size(spans) > 0").count() == 0
    assert sum(r.kept for r in exact.exact_dedup(table, 40).collect()) == len({t for _, t in rows})
    found = {r.doc_id: r.class_id for r in jaccard.near_duplicates(table, partitions=40).collect()}
    want = links(rows)
    assert found == {i: want[i][0] for i, _ in rows}
