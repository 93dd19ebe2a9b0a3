"""The corpus pipeline: documents in, a clean and weighted mix out.

Each stage takes the rows that the one before kept, applies one operator, and
returns what it keeps, with the columns of documents. ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again, so a lost executor
never costs an earlier stage, and then deletes what the stage wrote on its way.

In every stage further columns of any name pass through unread, an empty table
gives an empty table, and null ids are ids like others unless it is said otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strake.llm import decontaminate, exact, jaccard, langid, mixing
from strake.llm.queries import fold
from strake.llm.scratch import clear, cut, made


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those in no language that the classifier can tell.

    Null and empty texts go. Repeated rows stay or go alike; of languages that are
    equally likely the first by code point is told. Null lang teaches nothing;
    without any lang all rows go.
    """
    return langid.accepted_rows(docs, fold(3) != 1)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents that are equal but for white space.

    The longest original stays, then the smallest id, null ids last; of rows that
    tie in both one stays. Null texts are empty, and one empty text stays.
    """
    return exact.unique_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates (word 5-grams, similarity of 0.8 or more): the smallest id.

    Documents without a word or without an id are like no other and stay.
    Rows that repeat an id all stay or all go, as the id's class says.
    """
    return jaccard.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay, repeated rows stay or go alike;
    null and empty items have no window.
    """
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target says; copies are numbered by copy_no, the last column.

    A null source is a source, the last. Documents without a word go where their
    source has none, else they are taken at its rate; rows that repeat an id and a
    length are taken alike. A column of the name copy_no is replaced.
    """
    return mixing.mix(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mixed),
]

#: The first stage is a trained classifier, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = made()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
            clear(begin, made() - 1)
    return docs
