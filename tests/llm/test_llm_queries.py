import os
import sys

import pytest
from pyspark.sql import functions as F

from strake.llm import quality
from strake.llm.queries import ORACLES, QUERIES, fold

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same  # noqa: E402


@pytest.mark.parametrize("name", ORACLES)
def test_query_is_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


COLUMNS = {
    "op1_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op2_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3_ppm_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6_quality": {"doc_id": "bigint", "p_text": "double", "p_meta": "double", "score": "double", "keep": "boolean"},
    "op7_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_ngram_jaccard_join": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint", "n_copies": "bigint"},
    "op9_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_has_a_row_for_each(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == COLUMNS[name]
    assert found.count() == (50 if name == "op5_main_text" else 200)


def test_language_on_the_small_tables(spark):
    """Held-out accuracy on the given tables."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    told = QUERIES["op4_language_id"](spark, sf).join(docs, "doc_id").filter("held_out")
    assert told.filter("lang = lang_pred").count() > 0.98 * told.count()


def test_quality_on_labels_that_are_left_out(spark):
    """Documents whose label the classifier was not given, on the given tables."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("out", fold(4) == 0)
    judged = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.filter("not out").drop("out")).join(labels.filter("out"), "doc_id")
    n = judged.count()
    assert n > 300 and judged.filter("keep = (quality = 1)").count() > 0.98 * n
    assert judged.filter("(p_text >= 0.5) = (quality = 1)").count() > 0.97 * n
    assert judged.agg(F.max("score") - F.min("score")).first()[0] > 0.8


def test_quality_of_long_and_tied_texts(spark):
    """A very long text is read whole; rows alike in every column have one score, and one of 0.5 is kept."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one = docs.limit(1)
    long = one.select(F.lit(10**9).alias("doc_id"), F.repeat("text", 300).alias("text"), "lang", "source", "n_chars")
    out = quality.classify(docs.unionByName(one).unionByName(long), labels)
    again = out.join(one.select("doc_id"), "doc_id", "left_semi").select("p_text", "p_meta", "score").distinct()
    assert again.count() == 1 and out.filter(f"doc_id = {10**9} and score between 0 and 1").count() == 1
    none = labels.filter("false")
    assert quality.classify(docs, none).filter("keep and score = 0.5").count() == docs.count()
