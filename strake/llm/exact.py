"""Exact deduplication by content sort.

Rows are range-partitioned by splitters that Spark samples from bounded keys:
the first normalised characters, the digest of the normalised text, the order of
preference, and the row's place in its input. They are sorted externally by the
same key and the whole normalised text, so equal texts stand side by side, and
each text is compared in full with the one before. Because preference and place
are part of the key, a text with very many copies, even of one id, spreads over
as many partitions as it needs; only the first and last run of a partition can
go on in a neighbour, and those (two a partition) are joined up afterwards, by
their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut, width

SPACE = " \t\n\x0b\x0c\r"
LEAD = 32
#: The first run of a partition, the last one (if another), and all between.
FIRST, LAST, INNER = 1, 2, 0
_MARKS = T.StructType([T.StructField("_keep", T.LongType()), T.StructField("_size", T.LongType()), T.StructField("_head", T.BooleanType()), T.StructField("_edge", T.IntegerType()), T.StructField("_part", T.IntegerType()), T.StructField("_norm", T.StringType())])


def _runs(keep: list[str], heads_only: bool):
    """Marks the runs of equal texts in one sorted partition; with ``heads_only``, returns each run's first row alone.

    Of the run that is open it holds the first row, or the rows' ids and digests,
    and one text; ``_norm`` is set on the heads of the partition's first and last
    run.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # of the open run
        size = 0  # rows of the open run so far
        last: pa.Scalar | None = None  # its text
        begun = False

        def out(rows: pa.Table, lengths: np.ndarray, norm: str | None, ended: bool) -> pa.RecordBatch:
            """rows of whole runs; norm: the text of the first run if it is the partition's first, of the last if the partition ends."""
            nonlocal begun
            k = len(lengths)
            edge = np.zeros(k, np.int32)
            if ended:
                edge[-1] = LAST
            if not begun:
                edge[0] = FIRST
            begun = True
            run = np.arange(k) if heads_only else np.repeat(np.arange(k), lengths)
            head = np.ones(k, bool) if heads_only else np.zeros(len(run), bool)
            starts = np.arange(k) if heads_only else np.cumsum(lengths) - lengths
            head[starts] = True
            texts = [None] * len(run)
            for r in np.flatnonzero(edge):
                texts[starts[r]] = norm
            ids = rows.column("_id").take(pa.array(starts[run]))
            columns = [*[rows.column(c).combine_chunks() for c in keep], ids.combine_chunks(), pa.array(lengths[run], pa.int64()), pa.array(head), pa.array(edge[run]), pa.array(np.full(len(run), part, np.int32)), pa.array(texts, pa.string())]
            return pa.Table.from_arrays(columns, names=[*keep, *_MARKS.names]).combine_chunks().to_batches()[0]

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            norm = batch.column("_norm")
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = ~pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is None or norm[0].as_py() != last.as_py()
            at = np.flatnonzero(new)
            rows = batch.drop_columns(["_norm"])
            more = int(at[0]) if len(at) else n  # rows that go on with the open run
            if more:
                size += more
                if not heads_only:
                    held.append(rows.slice(0, more))
            if not len(at):
                continue
            if held:  # the open run has ended
                yield out(pa.Table.from_batches(held), np.array([size]), last.as_py() if not begun else None, False)
            if len(at) > 1:
                lengths = np.diff(at)
                whole = rows.take(pa.array(at[:-1])) if heads_only else rows.slice(at[0], int(at[-1] - at[0]))
                yield out(pa.Table.from_batches([whole]), lengths, norm[int(at[0])].as_py() if not begun else None, False)
            size = n - int(at[-1])
            # a copy: a slice would keep the whole batch
            held = [rows.take(pa.array([at[-1]])) if heads_only else rows.take(pa.array(np.arange(at[-1], n)))]
            last = pa.scalar(norm[int(at[-1])].as_py(), pa.string())
        if held:
            yield out(pa.Table.from_batches(held), np.array([size]), last.as_py(), True)

    return mark


def _marked(docs: DataFrame, packed: bool, partitions: int | None) -> DataFrame:
    """Every row with its run: _id, _sha, _keep, _size, _kept; with ``packed``, the first row of each run: _doc, _kept."""
    n = width(docs, partitions)
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.translate(text, SPACE, "")
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc") if packed else text.alias("_text")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), carried, F.length(text).alias("_points"), F.substring(norm, 1, LEAD).alias("_lead"), F.sha2(norm.cast("binary"), 256).alias("_sha"), F.monotonically_increasing_id().alias("_place"))
    first = [F.col("_points").desc(), F.col("_id").asc_nulls_last(), F.col("_place")]
    moved = F.coalesce(F.col("_doc.text"), F.lit("")) if packed else F.col("_text")
    placed = rows.repartitionByRange(n, "_lead", "_sha", *first).withColumn("_norm", F.translate(moved, SPACE, ""))
    ordered = placed.sortWithinPartitions("_lead", "_sha", "_norm", *first)
    keep = ["_doc", "_sha"] if packed else ["_id", "_sha"]
    schema = T.StructType([*[ordered.schema[c] for c in keep], *_MARKS.fields])
    marked = cut(ordered.select(*dict.fromkeys(["_id", *keep]), "_norm").mapInArrow(_runs(keep, packed), schema), "runs")
    # two runs a partition at most: grouped by their whole texts, then known by partition and side, a few numbers each
    ends = marked.filter(f"_edge <> {INNER} and _head").select("_sha", "_norm", "_part", "_edge", "_keep", "_size")
    met = ends.groupBy("_sha", "_norm").agg(F.min_by("_keep", "_part").alias("e_keep"), F.min("_part").alias("e_first"), F.sum("_size").alias("e_size"), F.collect_set(F.struct("_part", "_edge")).alias("at"))
    met = met.select("e_keep", "e_first", "e_size", F.explode("at").alias("at")).select("e_keep", "e_first", "e_size", F.col("at._part").alias("e_part"), F.col("at._edge").alias("e_edge"))
    joined = marked.join(F.broadcast(met), (F.col("_edge") != INNER) & (F.col("_edge") == F.col("e_edge")) & (F.col("_part") == F.col("e_part")), "left")
    inner = F.col("e_part").isNull()
    keep_id = F.when(inner, F.col("_keep")).otherwise(F.col("e_keep"))
    return joined.withColumn("_keep", keep_id).withColumn("_size", F.coalesce("e_size", "_size")).withColumn("_kept", F.col("_head") & (inner | (F.col("e_first") == F.col("_part"))))


def exact_dedup(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after the six ASCII white-space characters
    are deleted; a null text counts as empty. Of equal texts the row with the
    most code points in the original text stays, then the smallest id, null ids
    last; of rows that tie in both (repeated rows) exactly one stays. An empty
    table gives no rows. Other columns are not read.
    """
    marked = _marked(docs, False, partitions)
    return marked.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def unique_rows(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns.

    Nulls, ties and empty tables as there. Of repeated rows one stays, whatever
    their other columns; these are returned as they are, under any name.
    """
    return _marked(docs, True, partitions).filter("_kept").select("_doc.*")
