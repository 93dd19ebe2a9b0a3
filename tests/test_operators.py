"""Sampling, boundaries, partitioning, sorting, splitting and validation."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strake.operators import assignment, partitioning, sampling, sorting, validation
from strake.operators import boundaries as B


def table(spark, keys, path="f"):
    return spark.createDataFrame([(k, bytes([i % 256]) * 90, path, i) for i, k in enumerate(keys)], "key binary, value binary, path string, record_index long")


def keys(n, seed=42):
    r = random.Random(seed)
    return [r.randbytes(10) for _ in range(n)]


def text(n):
    return str(n).encode().ljust(10, b"\0")


def test_bernoulli(spark):
    df = table(spark, keys(2000))
    n = sampling.bernoulli(df, 0.1, 1).count()
    assert 130 < n < 270 and sampling.bernoulli(df, 0.1, 1).count() == n
    assert sampling.bernoulli(df, 1.0).count() == 2000
    assert sampling.bernoulli(table(spark, keys(3)), 1e-9).count() == 1
    assert sampling.bernoulli(table(spark, keys(3)).limit(0), 0.5).count() == 0


@pytest.mark.parametrize("rate", [0, -1, 1.5])
def test_rates(rate):
    with pytest.raises(ValueError, match="rate"):
        sampling.check_rate(rate)


def test_prefix_takes_the_first_of_each_range(spark):
    df = table(spark, keys(250), "a").union(table(spark, keys(5), "b"))
    got = {(r.path, r.record_index) for r in sampling.prefix(df, 0.01).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 0)}


def test_systematic_and_reservoir(spark):
    df = table(spark, keys(100))
    assert [r.record_index for r in sampling.systematic(df, 0.1).orderBy("record_index").collect()] == list(range(0, 100, 10))
    assert sampling.reservoir(df, 7).count() == 7 and sampling.reservoir(df, 700).count() == 100


def test_seeds_and_estimates():
    assert sampling.seed_of("") == 0 and sampling.seed_of("a") == 97 and sampling.seed_of("worker-1") == sampling.seed_of("worker-1") != sampling.seed_of("worker-2")
    assert sampling.seed_of("polygenelubricants") == -(1 << 31)
    assert sampling.estimated(100_099, 0.1) == 100 and sampling.estimated(0) == 0


@pytest.mark.parametrize(("n", "p", "rule", "want"), [(10, 2, "coordinator", [5]), (10, 3, "coordinator", [3, 6]), (11, 4, "coordinator", [2, 4, 6]), (11, 4, "balanced", [2, 5, 8]), (3, 9, "coordinator", [1, 2]), (0, 4, "coordinator", []), (5, 1, "balanced", []), (2, 4, "balanced", [0, 1, 1])])
def test_picks(n, p, rule, want):
    assert B.picks(n, p, rule) == want


def test_picks_need_samples_and_partitions():
    for bad in ((0, 3, "balanced"), (3, 0, "balanced"), (3, 2, "other")):
        with pytest.raises(ValueError, match="."):
            B.picks(*bad)


@pytest.mark.parametrize("rule", ["coordinator", "balanced"])
def test_boundaries_are_those_of_the_sorted_sample(spark, rule):
    ks = keys(307) + keys(50)
    want = [sorted(ks)[i] for i in B.picks(len(ks), 16, rule)]
    assert [bytes(b) for b in B.boundaries(table(spark, ks).repartition(5), 16, rule)] == want


def test_boundary_of_ten_samples(spark):
    df = table(spark, [text(i * 10) if i < 10 else b"99" + b"\0" * 8 for i in range(1, 11)])
    assert [bytes(b) for b in B.boundaries(df, 2)] == [text(60)]
    assert B.boundaries(df, 1) == []


def test_decimal_ranges():
    assert B.decimal_range("0", "1000", 3) == [text(333), text(666)] and B.decimal_range("0", "9", 1) == []


@pytest.mark.parametrize(("mib", "workers", "want"), [(0, 3, 9), (1, 3, 9), (32 * 9, 3, 9), (32 * 10, 3, 12), (32 * 4000, 3, 1500), (3200, 1, 100), (95, 1, 3), (128, 1, 4)])
def test_dynamic_count(mib, workers, want):
    assert B.dynamic_count(mib * B.MIB, workers) == want


@pytest.mark.parametrize(("p", "n"), [(3, 3), (9, 3), (10, 3), (5, 1), (2, 5)])
def test_shuffle_map(p, n):
    got = B.shuffle_map(p, list(range(n)))
    each = max(1, p // n)
    assert sorted(got) == list(range(p)) and all(w == min(k // each, n - 1) for k, w in got.items())
    assert sorted(x for w in range(n) for x in B.assigned(got, w)) == list(range(p))
    assert B.shuffle_map(p, []) == {} and set(B.shuffle_map(p, [4, 7, 9]).values()) <= {4, 7, 9}


def test_balanced_workers():
    assert [list(B.worker_partitions(w, 3, 10)) for w in range(3)] == [[0, 1, 2, 3], [4, 5, 6], [7, 8, 9]]
    with pytest.raises(ValueError, match="worker"):
        B.worker_partitions(3, 3, 10)


def test_strategies():
    assert B.strategy_count("A", 4) == 4 and B.strategy_count("B", 4, 10) == 10 and B.strategy_count("B", 2, None, 0) == 6
    with pytest.raises(ValueError, match="strategy"):
        B.strategy_count("C", 1)


def test_a_key_on_a_boundary_goes_up(spark):
    limits = [text(333), text(666)]
    df = partitioning.assign(table(spark, [text(100), text(333), text(500), text(666), text(999)]), limits)
    assert [r.pid for r in df.orderBy("record_index").collect()] == [0, 1, 1, 2, 2]
    assert [r.records for r in partitioning.histogram(partitioning.assign(table(spark, [text(1)]), limits), 3).orderBy("pid").collect()] == [1, 0, 0]
    assert partitioning.assign(table(spark, keys(5)), []).filter("pid <> 0").count() == 0


@pytest.mark.parametrize("n", [3, partitioning.FEW, partitioning.FEW + 1, 300])
def test_both_ways_of_searching_agree(spark, n):
    ks = keys(400)
    limits = sorted(keys(n, 7))
    got = {r.record_index: r.pid for r in partitioning.assign(table(spark, ks + limits), limits).collect()}
    assert all(got[i] == sum(b <= k for b in limits) for i, k in enumerate(ks + limits))


def test_exchange_puts_partition_n_in_task_n(spark):
    df = partitioning.exchange(partitioning.assign(table(spark, keys(200)), sorted(keys(4, 9))), 5)
    assert "repartition_by_num" in df._jdf.queryExecution().toString().lower()
    assert all(pid == task for pid, task in df.selectExpr("pid", "spark_partition_id()").collect())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(min_size=10, max_size=10).map(lambda b: b[:2] + b"\0" * 8), max_size=60), st.integers(1, 9))
def test_range_sort_is_a_sort(spark, ks, parts):
    df = table(spark, ks)
    ordered, limits = sorting.range_sort(df, parts, rate=0.5)
    rows = ordered.collect()
    assert [bytes(r.key) + bytes(r.value) for r in rows] == sorted(k + bytes([i % 256]) * 90 for i, k in enumerate(ks))
    assert all(r.pid == sum(bytes(b) <= bytes(r.key) for b in limits) for r in rows)


def test_equal_keys_all_stay(spark):
    runs = [table(spark, [text(100), text(300), text(500)]), table(spark, [text(100), text(300), text(700)])]
    assert [bytes(r.key) for r in sorting.merge_runs(runs).collect()] == sorted([text(100), text(300)] * 2 + [text(500), text(700)])


def test_ten_runs(spark):
    runs = [table(spark, [text(100 + 10 * j + i) for j in range(10)]) for i in range(10)]
    seen = []
    assert sorting.merge_with_callback(sorting.merge_runs(runs), lambda r: seen.append(bytes(r.key))) == 100
    assert seen == sorted(seen) and sorting.merge_statistics([("a", 1050), ("b", 99)]) == (10, 1000)


def test_ranks_and_top_k(spark):
    ks = keys(100)
    got = sorted((r.global_rank, bytes(r.key)) for r in sorting.ranked(table(spark, ks).repartition(7), "key").collect())
    assert got == list(enumerate(sorted(ks), 1))
    assert [bytes(r.key) for r in sorting.top_k(table(spark, ks), 5, "key").collect()] == sorted(ks)[:5]


def test_ranks_do_not_hang_on_the_partitions(spark):
    """More rows than are sampled, in ever other partitions: the ranks are those of one sort."""
    r = random.Random(3)
    rows = [(f"f{r.randrange(3)}", r.randrange(-50, 50), r.randbytes(10)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "path string, n long, key binary")
    want = list(enumerate(sorted(rows), 1))
    for split, parts in ((1, 2), (9, 60)):
        got = sorted((x.global_rank, (x.path, x.n, bytes(x.key))) for x in sorting.ranked(df.repartition(split), "path", "n", "key", partitions=parts).collect())
        assert got == want
    assert sorting.ranked(df.limit(0), "path").count() == 0


def test_record_ranges(spark):
    files = spark.createDataFrame([("b", 1050), ("a", 399), ("c", 99), ("b", 1050)], "path string, size_bytes long")
    got = sorted(tuple(r) for r in assignment.record_ranges(files, 4).collect())
    # 13 records: 4, 3, 3, 3
    assert got == [(0, "a", 0, 3, 399), (0, "b", 0, 1, 1050), (1, "b", 1, 3, 1050), (2, "b", 4, 3, 1050), (3, "b", 7, 3, 1050)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=8), st.integers(1, 6))
def test_record_ranges_cover_everything_once(spark, sizes, workers):
    files = spark.createDataFrame([(f"f{i:02d}", n) for i, n in enumerate(sizes)], "path string, size_bytes long")
    rows = assignment.record_ranges(files, workers).collect()
    seen = sorted((r.file_path, r.start_record + k) for r in rows for k in range(r.record_count))
    assert seen == [(f"f{i:02d}", k) for i, n in enumerate(sizes) for k in range(n // 100)]
    per = [sum(r.record_count for r in rows if r.worker_index == w) for w in range(workers)]
    assert max(per) - min(per) <= 1 and per == sorted(per, reverse=True)


def test_validation_sees_what_is_wrong(spark):
    good = spark.createDataFrame([(0, 0, b"a"), (0, 1, b"b"), (1, 0, b"b"), (10, 0, b"c"), (2, 0, b"b")], "pid int, record_index long, key binary")
    assert all(r.is_sorted for r in validation.inversions(good).collect()) and all(r.follows for r in validation.global_order(good).collect())
    bad = good.union(spark.createDataFrame([(1, 1, b"a"), (11, 0, b"b")], good.schema))
    assert {r.pid for r in validation.inversions(bad).collect() if not r.is_sorted} == {1}
    assert {r.pid for r in validation.global_order(bad).collect() if not r.follows} == {1, 11}


def test_parity(spark):
    a = table(spark, keys(50))
    assert validation.parity(a, a.orderBy("key"))["same"] and not validation.parity(a, a.limit(49))["same"]
    twice = table(spark, keys(3) + keys(3))
    assert validation.parity(twice, twice)["same"] and not validation.parity(twice, twice, unique=True)["same"]
    assert validation.parity(a.limit(0), a.limit(0))["same"]


def test_record_ranges_make_no_pairs(spark):
    """Rows before the last filter are as many as files and workers, not their product."""
    files = spark.createDataFrame([(f"f{i:03d}", 1000) for i in range(100)], "path string, size_bytes long")
    rows = assignment.record_ranges(files, 50)
    assert rows.count() <= 150 and rows.groupBy("worker_index").sum("record_count").count() == 50
    assert [tuple(r) for r in assignment.whole_ranges(files.limit(1)).collect()] == [(0, "f000", 0, 10, 1000)]


def test_inversions_of_files_across_splits(spark, tmp_path):
    from strake.sources import records as S

    r = random.Random(2)
    for name, ks in (("a", sorted(keys(500))), ("b", keys(500, 3)), ("c", [b"k" * 10] * 40), ("d", sorted(keys(200), reverse=True))):
        (tmp_path / name).write_bytes(b"".join(k + r.randbytes(90) for k in ks))
    want = {"a": 0, "b": sum(x > y for x, y in zip(keys(500, 3), keys(500, 3)[1:], strict=False)), "c": 0, "d": 199}
    for size in (300, 5_000, 1 << 20):
        found = validation.file_inversions(S.read_records(spark, str(tmp_path), "binary", position=True, split_bytes=size)).collect()
        assert {x.path.rsplit("/", 1)[1]: x.inversions for x in found} == want and all(x.is_sorted == (x.inversions == 0) for x in found)
