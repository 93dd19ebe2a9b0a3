import functools

import pytest
from oracle import same

import __spark_entry__
from strake.operators import sorting
from strake.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query_is_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_files_of_many_splits_are_sorted_whole(spark, monkeypatch):
    monkeypatch.setattr(sorting, "read_records", functools.partial(sorting.read_records, split_bytes=5_000))
    same(spark, QUERIES["sorted_chunks"], ORACLES["sorted_chunks"])


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["event_id", "key_hex", "global_rank"] and found.count() == 1000


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
