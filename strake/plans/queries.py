"""Queries that apply the operators to the driver's tables, and their SQL.

Records are derived alike in both engines: a key is the first ten bytes of the
MD5 of an event's id (all different) or of an order line's key (often equal), a
value some text filled up with zero bytes. An event's type or a line's number
stands for a file. Queries about files write such records with the library's
sink, once a session, and read them with its source. Bytes leave a query as hex,
whose order is the bytes' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import record as R
from ..operators import assignment, partitioning, sampling, sorting, validation
from ..operators import boundaries as B
from ..sources import records as S
from ..sources import shared
from . import job

PARTS, WORKERS = 16, 3
SHARE = 1 / 16


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _key(text: Column) -> Column:
    return F.unhex(F.substring(F.md5(text.cast("binary")), 1, 20))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, path, key, value."""
    said = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    return _read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("path"), _key(F.col("event_id").cast("string")).alias("key"), F.rpad(F.encode(said, "UTF-8"), R.VALUE, F.lit(bytearray(1))).alias("value"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, key, value of order lines; many keys are equal, and so are some records."""
    named = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    value = F.rpad(F.encode(F.concat_ws("|", F.col("l_partkey").cast("string"), "l_returnflag"), "UTF-8"), R.VALUE, F.lit(bytearray(1)))
    return _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("path"), _key(named).alias("key"), value.alias("value"))


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of record files, written once a session.

    lines and lines_hex: the order lines, partition.N for line number N + 1, by key
    and value, binary or hex; lines_raw: each line's hex key and value as raw text.
    arrived and by_key: events, partition.N for the N-th type, by id or by key.
    """
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _stored:
        path = shared.folder(spark, name)
        if name == "lines_raw":
            lines(spark, sf_dir).select(F.rpad(F.concat(F.substring(F.hex("key"), 1, 10), F.hex(F.substring("key", 6, 5)), F.lit(" raw")), 99, ".").alias("line")).repartition(3).write.text(path)
        elif name.startswith("lines"):
            rows = lines(spark, sf_dir).withColumn("pid", F.col("path").cast("int") - 1)
            S.write_records(rows.repartitionById(7, "pid").sortWithinPartitions("key", "value"), path, "ascii" if name == "lines_hex" else "binary")
        else:
            rows = events(spark, sf_dir)
            kinds = rows.select("path").distinct().withColumn("pid", F.row_number().over(W.orderBy("path")) - 1)
            placed = rows.join(F.broadcast(kinds), "path")  # a row for each type of event
            S.write_records(placed.repartitionById(kinds.count(), "pid").sortWithinPartitions("event_id" if name == "arrived" else "key"), path)
        _stored[at] = path
    return _stored[at]


def _split(path: str) -> int:
    """Split bytes for some 32 splits of a small input."""
    return max(50_000, S.total_bytes(path) // 32)


def _number(path: str = "path") -> Column:
    return F.regexp_extract(path, r"partition\.(\d+)$", 1).cast("int")


def _event(read: DataFrame) -> DataFrame:
    """event_id and path (its type), from an event's value, beside key, value and record_index."""
    said = F.split(F.translate(F.decode("value", "ISO-8859-1"), "\0", ""), r"\|")
    return read.withColumn("event_id", said[0].cast("long")).withColumn("path", said[2])


def _limits(records: DataFrame, rule: str = "coordinator", parts: int = PARTS) -> list:
    return B.boundaries(sampling.hashed(records.withColumn("h", F.hex("key")), "h", SHARE), parts, rule)


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    records = events(spark, sf_dir)
    limits = _limits(records)
    return partitioning.assign(records, limits), limits


def record_encode(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", R.hex_line(F.col("key"), F.col("value")).alias("line"), R.valid(F.col("key"), F.col("value")).alias("is_valid"))


def record_round_trip(spark, sf_dir):
    back = R.deserialize(R.serialize(F.col("key"), F.col("value")))
    return events(spark, sf_dir).select("event_id", back.alias("r")).select("event_id", F.hex("r.key").alias("key_hex"), F.octet_length("r.value").cast("long").alias("value_bytes"))


def text_lines(spark, sf_dir):
    """event_id, line: hex in both cases, raw lines of three lengths, and lines that are no record."""
    line = R.hex_line(F.col("key"), F.col("value"))
    digits = F.repeat(F.md5(F.col("event_id").cast("string").cast("binary")), 4)
    m = F.col("event_id") % 5
    shape = F.when(m == 0, line).when(m == 1, F.lower(line)).when(m == 2, F.substring(digits, F.lit(1), (F.lit(98) + F.col("event_id") % 3).cast("int"))).when(m == 3, "TOOSHORT").otherwise(F.concat(F.lit("ZZ"), F.substring(line, 3, 300)))
    return events(spark, sf_dir).select("event_id", shape.alias("line"))


def ascii_line_parse(spark, sf_dir):
    found = text_lines(spark, sf_dir).select("event_id", R.line_kind(F.col("line")).alias("kind"), R.parse_line(F.col("line")).alias("r"))
    return found.select("event_id", "kind", F.hex("r.key").alias("key_hex"), F.coalesce(F.octet_length("r.value"), F.lit(0)).cast("long").alias("value_bytes"))


def hex_decode(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, "0g").when(F.col("event_id") % 3 == 1, F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 7)).otherwise(F.md5(F.col("event_id").cast("string").cast("binary")))
    return events(spark, sf_dir).select("event_id", F.hex(R.decode_hex(text)).alias("bytes"))


def _detect(df: DataFrame, key: str, text: str) -> DataFrame:
    head = R.head_of(F.col(text))
    return df.select(key, R.detected(head).alias("format"), F.round(F.coalesce(R.printable_share(head), F.lit(0.0)), 6).alias("ascii_ratio"), F.length(head).cast("long").alias("bytes_read"))


def format_detect(spark, sf_dir):
    return _detect(_read(spark, sf_dir, "documents"), "doc_id", "text")


def format_detect_pages(spark, sf_dir):
    return _detect(_read(spark, sf_dir, "pages"), "page_id", "html")


def _files(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("path").agg((F.count("*") * R.SIZE + 37).alias("size_bytes"))


def _scanned(read: DataFrame) -> DataFrame:
    return read.select((_number() + 1).cast("string").alias("path"), "record_index", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


def read_binary(spark, sf_dir):
    """Every record of binary files, read in many splits."""
    path = stored(spark, sf_dir, "lines")
    return _scanned(S.read_records(spark, path, "binary", position=True, split_bytes=_split(path)))


def read_hex(spark, sf_dir):
    """Every record of hex files, whose format is detected."""
    return _scanned(S.read_records(spark, stored(spark, sf_dir, "lines_hex"), position=True))


def read_hex_splits(spark, sf_dir):
    """The same files in many splits, counted."""
    path = stored(spark, sf_dir, "lines_hex")
    read = S.read_records(spark, path, split_bytes=_split(path))
    return validation.checksum(read)


def read_raw(spark, sf_dir):
    """Every record of raw text files."""
    path = stored(spark, sf_dir, "lines_raw")
    read = S.read_records(spark, path, "ascii", split_bytes=_split(path))
    return read.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


def detect_files(spark, sf_dir):
    """The detection's report on binary and hex files."""
    found = S.detect_report(spark, [stored(spark, sf_dir, "lines"), stored(spark, sf_dir, "lines_hex")])
    return found.select((_number() + 1).alias("file"), "size_bytes", "format", F.round("ascii_ratio", 6).alias("ascii_ratio"), "bytes_read")


def count_records(spark, sf_dir):
    return S.count_by_file(spark, stored(spark, sf_dir, "lines"), "binary").select((_number() + 1).cast("string").alias("path"), "records")


def count_text(spark, sf_dir):
    return S.count_by_file(spark, stored(spark, sf_dir, "lines_hex"), "ascii").select((_number() + 1).cast("string").alias("path"), "records")


def count_complete(spark, sf_dir):
    return _files(spark, sf_dir).select("path", "size_bytes", F.floor(F.col("size_bytes") / R.SIZE).cast("long").alias("records"), (F.floor(F.col("size_bytes") / R.SIZE) * R.SIZE).cast("long").alias("memory_bytes"))


def input_size(spark, sf_dir):
    path = stored(spark, sf_dir, "lines")
    return spark.createDataFrame([(S.total_bytes(path), len(S.list_files(path)))], "total_bytes long, files long")


def record_ranges(spark, sf_dir):
    return assignment.record_ranges(_files(spark, sf_dir), WORKERS)


def worker_ranges(spark, sf_dir):
    return assignment.record_ranges(_files(spark, sf_dir), WORKERS).filter("worker_index = 1")


def whole_ranges(spark, sf_dir):
    return assignment.whole_ranges(_files(spark, sf_dir))


def _arrived(spark, sf_dir):
    path = stored(spark, sf_dir, "arrived")
    return S.read_records(spark, path, "binary", position=True, split_bytes=_split(path))


def sample_prefix(spark, sf_dir):
    return _event(sampling.prefix(_arrived(spark, sf_dir), 0.01)).select("event_id", "path", "record_index")


def sample_systematic(spark, sf_dir):
    return _event(sampling.systematic(_arrived(spark, sf_dir), 0.05)).select("event_id", "path", "record_index")


def random_samples(spark, sf_dir):
    """What holds for any draw of the random samples: records of the input, each once, about as many as asked."""
    every = events(spark, sf_dir).select("event_id", "key")
    n = every.count()

    def held(name, sample, low, high):
        found = sample.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
        known = sample.join(every, ["event_id", "key"], "left_semi").agg(F.count("*").alias("known"))
        return found.crossJoin(known).select(F.lit(name).alias("sample"), (F.col("n") == F.col("ids")).alias("once"), (F.col("n") == F.col("known")).alias("from_input"), F.col("n").between(low, high).alias("as_many"))  # one row each

    five = 5 * (n * 0.09) ** 0.5
    read = _event(S.read_records(spark, stored(spark, sf_dir, "arrived"), "binary", sample_rate=0.1, seed=sampling.seed_of("worker-1"))).select("event_id", "key")
    files = len(S.list_files(stored(spark, sf_dir, "arrived")))
    drawn = [held("bernoulli", sampling.bernoulli(every, 0.1, 42), int(n * 0.1 - five), int(n * 0.1 + five)), held("reservoir", sampling.reservoir(every, 50, 42), 50, 50), held("blocks", read, int(n * 0.1) - files * S.SAMPLE_BLOCK, int(n * 0.1) + files * S.SAMPLE_BLOCK)]
    return drawn[0].union(drawn[1]).union(drawn[2])


def sample_hash(spark, sf_dir):
    return sampling.hashed(events(spark, sf_dir).withColumn("key_hex", F.hex("key")), "key_hex", 0.1).select("event_id", "key_hex")


def sample_keys(spark, sf_dir):
    return sampling.hashed(events(spark, sf_dir).select(F.hex("key").alias("key_hex")), "key_hex", 0.1)


def sample_bernoulli(spark, sf_dir):
    return sampling.bernoulli(events(spark, sf_dir), 0.1, 42).select("event_id", F.hex("key").alias("key_hex"))


def sample_reservoir(spark, sf_dir):
    return sampling.reservoir(events(spark, sf_dir), 50, 42).select("event_id", F.hex("key").alias("key_hex"))


def sample_estimate(spark, sf_dir):
    files = S.list_files(stored(spark, sf_dir, "lines"))
    return spark.createDataFrame([(p, sampling.estimated(n)) for p, n in files], "path string, samples long").withColumn("path", (_number() + 1).cast("string"))


def _boundary_rows(spark, limits):
    rows = [(i, bytes(b).hex().upper()) for i, b in enumerate(limits, 1)]
    return spark.createDataFrame(rows, "boundary int, key_hex string")


def boundaries_coordinator(spark, sf_dir):
    return _boundary_rows(spark, _limits(events(spark, sf_dir)))


def boundaries_balanced(spark, sf_dir):
    return _boundary_rows(spark, _limits(events(spark, sf_dir), "balanced"))


def boundaries_few_samples(spark, sf_dir):
    return _boundary_rows(spark, B.boundaries(events(spark, sf_dir).filter("event_id < 5"), PARTS, "coordinator"))


def boundaries_decimal(spark, sf_dir):
    return _boundary_rows(spark, B.decimal_range("0", "1000", 8))


def _grid(spark):
    return spark.range(0, 40).withColumn("workers", (F.col("id") % 4 + 1)).withColumn("total_bytes", F.col("id") * F.col("id") * 40_000_000)


def dynamic_partitions(spark, sf_dir):
    return _grid(spark).select("total_bytes", "workers", B.dynamic_count_column(F.col("total_bytes"), F.col("workers")).alias("partitions"))


def _pids(spark):
    shapes = spark.createDataFrame([(3, 3), (9, 3), (10, 3), (5, 1), (16, 5), (288, 20)], "partitions long, workers long")
    return shapes.withColumn("pid", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)))


def shuffle_map(spark, sf_dir):
    return _pids(spark).withColumn("worker_index", B.shuffle_map_column(F.col("pid"), F.col("partitions"), F.col("workers")))


def worker_partitions(spark, sf_dir):
    return _pids(spark).withColumn("worker_index", B.worker_partitions_column(F.col("pid"), F.col("partitions"), F.col("workers")))


def assigned_partitions(spark, sf_dir):
    return shuffle_map(spark, sf_dir).filter("worker_index = 0").select("partitions", "workers", "pid")


def partition_assign(spark, sf_dir):
    return _placed(spark, sf_dir)[0].select("event_id", F.hex("key").alias("key_hex"), "pid")


def partition_ties(spark, sf_dir):
    """Boundaries are keys of the data, and many records have them: all go up."""
    records = lines(spark, sf_dir)
    return partitioning.assign(records, _limits(records, "balanced", 8)).groupBy("pid").agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"))


def partition_histogram(spark, sf_dir):
    """With the empty partitions that repeated boundaries leave."""
    records, limits = events(spark, sf_dir), _limits(events(spark, sf_dir))
    twice = sorted([*limits, *limits])
    return partitioning.histogram(partitioning.assign(records, twice), len(twice) + 1)


def partition_many(spark, sf_dir):
    """More boundaries than are compared one by one."""
    records = events(spark, sf_dir)
    limits = _limits(records, "balanced", 64)
    return partitioning.assign(records, limits).groupBy("pid").agg(F.count("*").alias("records"))


def partition_minmax(spark, sf_dir):
    return validation.extremes(_placed(spark, sf_dir)[0]).select("pid", "records", F.hex("min_key").alias("min_key"), F.hex("max_key").alias("max_key"))


def filter_worker(spark, sf_dir):
    placed, limits = _placed(spark, sf_dir)
    return partitioning.of_worker(placed, B.shuffle_map(len(limits) + 1, list(range(WORKERS))), 1).select("event_id", "pid")


def range_sort(spark, sf_dir):
    """The whole way: sample, boundaries, exchange, local sort; the place of each record in its partition."""
    records = events(spark, sf_dir)
    ordered, _ = sorting.range_sort(records, PARTS, _limits(records))
    numbered = ordered.withColumn("at", F.monotonically_increasing_id())
    return numbered.select("event_id", "pid", F.hex("key").alias("key_hex"), (F.col("at") - F.shiftleft(F.shiftright("at", 33), 33)).alias("place"))


def global_sort(spark, sf_dir):
    return sorting.ranked(events(spark, sf_dir), "key", "value").select("event_id", F.hex("key").alias("key_hex"), "global_rank")


def sort_ties(spark, sf_dir):
    """Equal keys all stay: their number, and the rank of the first."""
    ranked = sorting.ranked(lines(spark, sf_dir), "key", "value")
    return ranked.groupBy(F.hex("key").alias("key_hex")).agg(F.count("*").alias("records"), F.min("global_rank").alias("first_rank"))


def run_merge(spark, sf_dir):
    """A sorted run for each file, merged; one scan however many files there are."""
    runs = sorting.sort_files(spark, stored(spark, sf_dir, "arrived"), "binary")
    return _event(sorting.ranked(sorting.merge_runs([runs]), "key", "value")).select("event_id", "path", "global_rank")


def merge_files(spark, sf_dir):
    """Files merged into one file, read again: each record's place in it."""
    path = shared.folder(spark, "merged")
    sorting.merge_files(spark, stored(spark, sf_dir, "arrived"), path, kind="binary")
    return _event(S.read_records(spark, path, "binary", position=True, split_bytes=_split(path))).select("event_id", "path", "record_index")


def merge_partition(spark, sf_dir):
    """Runs of the files, merged into partitions."""
    runs = sorting.sort_files(spark, stored(spark, sf_dir, "arrived"), "binary")
    return sorting.merge_and_partition([runs], _limits(events(spark, sf_dir))).groupBy("pid").agg(F.count("*").alias("records"), F.hex(F.min("key")).alias("min_key"))


def partition_files(spark, sf_dir):
    """Files merged into a file for each partition, read again: empty ones too."""
    path, limits = shared.folder(spark, "parts"), _limits(events(spark, sf_dir))
    sorting.merge_files(spark, stored(spark, sf_dir, "arrived"), path, sorted([*limits, *limits]), "binary")
    found = validation.extremes(validation.outputs(spark, path)).select("pid", "records", F.hex("min_key").alias("min_key"), F.hex("max_key").alias("max_key"))
    every = spark.createDataFrame([(n,) for n, _ in S.list_outputs(path)], "pid int")
    return every.join(found, "pid", "left").select("pid", F.coalesce("records", F.lit(0)).alias("records"), "min_key", "max_key")


def verify_outputs(spark, sf_dir):
    """The report on a sorted folder, against its source."""
    path, limits = shared.folder(spark, "checked"), _limits(events(spark, sf_dir))
    source = stored(spark, sf_dir, "arrived")
    sorting.merge_files(spark, source, path, limits, "binary")
    done = validation.report(spark, path, S.read_records(spark, source, "binary"))
    return spark.createDataFrame([tuple(done[k] for k in ("files", "records", "sorted", "ordered", "same"))], "files long, records long, sorted boolean, ordered boolean, same boolean")


def sorted_chunks(spark, sf_dir):
    """Each file ordered for itself, also one of many splits."""
    return _event(sorting.sort_each_file(spark, stored(spark, sf_dir, "arrived"), "binary")).select("event_id", "path", "record_index")


def top_k(spark, sf_dir):
    return sorting.top_k(events(spark, sf_dir), 100, "key", "value").select("event_id", F.hex("key").alias("key_hex"))


def merge_statistics(spark, sf_dir):
    return spark.createDataFrame([sorting.merge_statistics(S.list_files(stored(spark, sf_dir, "lines")))], "records long, memory_bytes long")


def is_sorted(spark, sf_dir):
    """Files in order of arrival are not sorted by key; files by key are."""
    found = validation.file_inversions(_arrived(spark, sf_dir)).withColumn("path", _number().cast("string"))
    path = stored(spark, sf_dir, "by_key")
    ordered = S.read_records(spark, path, "binary", position=True, split_bytes=_split(path))
    return found.union(validation.file_inversions(ordered).withColumn("path", F.concat(F.lit("sorted-"), _number()))).select("path", "inversions", "is_sorted")


def global_order(spark, sf_dir):
    return validation.global_order(_placed(spark, sf_dir)[0]).select("pid", "records", "follows")


def data_parity(spark, sf_dir):
    """Files hold what was written; their keys are not all different."""
    before, after = lines(spark, sf_dir), S.read_records(spark, stored(spark, sf_dir, "lines"), "binary")
    rows = [(unique, *(validation.parity(before, after, unique)[k] for k in ("records_before", "records_after", "same"))) for unique in (False, True)]
    return spark.createDataFrame(rows, "unique_keys boolean, records_before long, records_after long, same boolean")


def order_free_checksum(spark, sf_dir):
    return validation.checksum(S.read_records(spark, stored(spark, sf_dir, "lines"), "binary"))


def partition_checksum(spark, sf_dir):
    records = events(spark, sf_dir)
    ordered, _ = sorting.range_sort(records, PARTS, _limits(records))
    return validation.transport_checksum(ordered)


def dedupe_records(spark, sf_dir):
    """Records are equal by key and value."""
    return lines(spark, sf_dir).dropDuplicates(["key", "value"]).select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


def key_projection(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(F.hex(F.substring("key", 1, 2)).alias("lead")).agg(F.count("*").alias("records"))


def disk_estimate(spark, sf_dir):
    return _files(spark, sf_dir).select("path", "size_bytes", job.required_column(F.col("size_bytes")).alias("required_bytes"))


def split_bytes(spark, sf_dir):
    """Splits of up to 1000 records that a reader plans for each file."""
    splits = S.plan_splits(stored(spark, sf_dir, "lines"), "binary", 100_000)
    found = spark.createDataFrame([(s.path, s.start, s.count) for s in splits], "path string, start_record long, record_count long")
    return found.withColumn("path", (_number() + 1).cast("string"))


def window_check(spark, sf_dir):
    """Adjacent keys of the whole order: the least and the greatest step up to each rank's block, by their first four bytes.

    Steps are taken inside blocks of 1000 ranks and, between them, from the last
    of one block to the first of the next: one row a block goes there.
    """
    ranked = sorting.ranked(events(spark, sf_dir), "key", "value")
    lead = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    parted = ranked.select(lead.alias("n"), "global_rank", F.floor((F.col("global_rank") - 1) / 1000).alias("block"))
    step = F.col("n") - F.lag("n").over(W.partitionBy("block").orderBy("global_rank"))
    inside = parted.withColumn("step", step).groupBy("block").agg(F.min("step").alias("least"), F.max("step").alias("most"), F.min("n").alias("first"), F.max("n").alias("last"))
    before = inside.select((F.col("block") + 1).alias("block"), F.col("last").alias("before"))
    edge = F.col("first") - F.col("before")
    return inside.join(before, "block", "left").select("block", F.least("least", edge).alias("least"), F.greatest("most", edge).alias("most"))


_EV = """e AS (SELECT event_id, event_type AS path, upper(substr(md5(event_id::VARCHAR), 1, 20)) AS key_hex,
             hex(encode(event_id::VARCHAR || '|' || user_id::VARCHAR || '|' || event_type)) AS v0 FROM events),
       ev AS (SELECT *, v0 || repeat('0', 180 - length(v0)) AS value_hex FROM e)"""
_LI = """l0 AS (SELECT l_linenumber::VARCHAR AS path, upper(substr(md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR), 1, 20)) AS key_hex,
              hex(encode(l_partkey::VARCHAR || '|' || l_returnflag)) AS v0 FROM lineitem),
       li AS (SELECT *, v0 || repeat('0', 180 - length(v0)) AS value_hex FROM l0)"""
_FI = _LI + ", fi AS (SELECT path, count(*) * 100 + 37 AS size_bytes FROM li GROUP BY path)"


def _hash(share: float) -> str:
    return f"('0x' || substr(md5(key_hex), 1, 8))::BIGINT < {int(share * 2**32)}"


def _bounds(source: str, rule: str = "coordinator", parts: int = PARTS) -> str:
    # only the coordinator's rule lowers the number of partitions to that of the samples
    at, count = ("i * (m // p)", f"least({parts}, greatest(m, 1))") if rule == "coordinator" else ("(m * i) // p", str(parts))
    return f"""s AS (SELECT key_hex, row_number() OVER (ORDER BY key_hex) - 1 AS rn FROM {source} WHERE {_hash(SHARE)}),
       q AS (SELECT m, {count} AS p FROM (SELECT count(*) AS m FROM s)),
       b AS (SELECT i AS boundary, key_hex FROM (SELECT unnest(range(1, p)) AS i, m, p FROM q) x JOIN s ON s.rn = {at})"""


_PL = f"WITH {_EV}, {_bounds('ev')}, pl AS (SELECT ev.*, (SELECT count(*) FROM b WHERE b.key_hex <= ev.key_hex)::INT AS pid FROM ev)"
_SHAPES = "g AS (SELECT * FROM (VALUES (3, 3), (9, 3), (10, 3), (5, 1), (16, 5), (288, 20)) t(partitions, workers)), r AS (SELECT partitions::BIGINT AS partitions, workers::BIGINT AS workers, unnest(range(partitions)) AS pid FROM g)"
_RANGES = f"""WITH {_FI}, f AS (SELECT *, size_bytes // 100 AS n FROM fi),
    c AS (SELECT *, sum(n) OVER (ORDER BY path)::BIGINT AS hi, (sum(n) OVER ())::BIGINT AS total FROM f),
    w AS (SELECT *, hi - n AS lo, i * (total // {WORKERS}) + least(i, total % {WORKERS}) AS a, (i + 1) * (total // {WORKERS}) + least(i + 1, total % {WORKERS}) AS z FROM c, (SELECT unnest(range({WORKERS})) AS i))
    SELECT i AS worker_index, path AS file_path, greatest(lo, a) - lo AS start_record, least(hi, z) - greatest(lo, a) AS record_count, size_bytes AS file_size_bytes FROM w WHERE least(hi, z) > greatest(lo, a)"""
_IX = f"WITH {_EV}, ix AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY event_id) - 1 AS record_index, count(*) OVER (PARTITION BY path) AS n FROM ev)"
_MAP = "least(pid // greatest(1, partitions // workers), workers - 1)"
_WIDE = "(partitions % workers) * (partitions // workers + 1)"
_LINE = "key_hex || ' ' || value_hex"
_TEXT = f"""WITH {_EV}, t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN {_LINE} WHEN 1 THEN lower({_LINE})
      WHEN 2 THEN substr(repeat(md5(event_id::VARCHAR), 4), 1, (98 + event_id % 3)::INT) WHEN 3 THEN 'TOOSHORT' ELSE 'ZZ' || substr({_LINE}, 3) END AS line FROM ev)"""


_PRINTABLE = "len(list_filter(regexp_extract_all(head, '..'), lambda x: x BETWEEN '20' AND '7E' OR x IN ('0A', '0D')))::DOUBLE"


def _detect_sql(table: str, key: str, text: str) -> str:
    return f"""WITH h AS (SELECT {key}, substr(hex(encode(coalesce({text}, ''))), 1, 2000) AS head FROM {table}),
        r AS (SELECT *, CASE WHEN length(head) > 0 THEN {_PRINTABLE} / (length(head) / 2) ELSE 0.0 END AS ratio FROM h)
        SELECT {key}, CASE WHEN ratio > 0.9 THEN 'ascii' ELSE 'binary' END AS format, round(ratio, 6) AS ascii_ratio, (length(head) // 2)::BIGINT AS bytes_read FROM r"""


_AT = "row_number() OVER (PARTITION BY path ORDER BY key_hex, value_hex) - 1"
_SCANNED = f"WITH {_LI} SELECT path, {_AT} AS record_index, key_hex, value_hex FROM li"
_SUM = "sum(('0x' || substr(md5(unhex(key_hex || value_hex)), 1, 15))::BIGINT::HUGEINT)::VARCHAR"
_CHECKED = f"WITH {_LI} SELECT count(*) AS records, count(DISTINCT key_hex) AS keys, {_SUM} AS checksum FROM li"
_COUNTED = f"WITH {_LI} SELECT path, count(*) AS records FROM li GROUP BY path"


ORACLES = {
    "record_encode": f"WITH {_EV} SELECT event_id, {_LINE} AS line, true AS is_valid FROM ev",
    "record_round_trip": f"WITH {_EV} SELECT event_id, key_hex, length(value_hex) // 2 AS value_bytes FROM ev",
    "ascii_line_parse": _TEXT
    + """, k AS (SELECT *, CASE WHEN length(line) = 201 AND regexp_full_match(line, '[0-9A-Fa-f]{20} [0-9A-Fa-f]{180}') THEN 'hex' WHEN length(line) BETWEEN 98 AND 100 THEN 'raw' END AS kind FROM t)
        SELECT event_id, kind, CASE kind WHEN 'hex' THEN upper(substr(line, 1, 20)) WHEN 'raw' THEN hex(encode(substr(line, 1, 10))) END AS key_hex, CASE WHEN kind IS NOT NULL THEN 90 ELSE 0 END::BIGINT AS value_bytes FROM k""",
    "hex_decode": f"WITH {_EV} SELECT event_id, CASE WHEN event_id % 3 = 2 THEN upper(md5(event_id::VARCHAR)) END AS bytes FROM ev",
    "format_detect": _detect_sql("documents", "doc_id", "text"),
    "format_detect_pages": _detect_sql("pages", "page_id", "html"),
    "read_binary": _SCANNED,
    "read_hex": _SCANNED,
    "read_hex_splits": _CHECKED,
    "read_raw": f"WITH {_LI} SELECT hex(encode(substr(key_hex, 1, 10))) AS key_hex, rpad(hex(encode(rpad(substr(key_hex, 11, 10) || ' raw', 89, '.'))), 180, '0') AS value_hex FROM li",
    "detect_files": f"""WITH {_LI}, n AS (SELECT path::INT AS file, key_hex || value_hex AS line, row_number() OVER (PARTITION BY path ORDER BY key_hex, value_hex) AS k, count(*) OVER (PARTITION BY path) AS n FROM li),
        h AS (SELECT file, any_value(n) AS n, string_agg(line, '' ORDER BY k) AS head FROM n WHERE k <= 10 GROUP BY file),
        r AS (SELECT *, {_PRINTABLE} / (length(head) / 2) AS ratio FROM h)
        SELECT file, n * 100 AS size_bytes, CASE WHEN ratio > 0.9 THEN 'ascii' ELSE 'binary' END AS format, round(ratio, 6) AS ascii_ratio, (length(head) // 2)::BIGINT AS bytes_read FROM r
        UNION ALL SELECT file, n * 202, 'ascii', 1.0, least(1000, n * 202)::BIGINT FROM h""",
    "count_records": _COUNTED,
    "count_text": _COUNTED,
    "count_complete": f"WITH {_FI} SELECT path, size_bytes, size_bytes // 100 AS records, size_bytes // 100 * 100 AS memory_bytes FROM fi",
    "input_size": f"WITH {_LI} SELECT count(*) * 100 AS total_bytes, count(DISTINCT path) AS files FROM li",
    "record_ranges": _RANGES,
    "worker_ranges": f"SELECT * FROM ({_RANGES}) WHERE worker_index = 1",
    "whole_ranges": f"WITH {_FI} SELECT 0::BIGINT AS worker_index, path AS file_path, 0::BIGINT AS start_record, size_bytes // 100 AS record_count, size_bytes AS file_size_bytes FROM fi",
    "random_samples": "SELECT unnest(['bernoulli', 'reservoir', 'blocks']) AS sample, true AS once, true AS from_input, true AS as_many",
    "sample_prefix": f"{_IX} SELECT event_id, path, record_index FROM ix WHERE record_index < greatest(1, floor(n * 0.01::DOUBLE))",
    "sample_systematic": f"{_IX} SELECT event_id, path, record_index FROM ix WHERE record_index % 20 = 0",
    "sample_hash": f"WITH {_EV} SELECT event_id, key_hex FROM ev WHERE {_hash(0.1)}",
    "sample_keys": f"WITH {_EV} SELECT key_hex FROM ev WHERE {_hash(0.1)}",
    "sample_estimate": f"WITH {_LI} SELECT path, floor(count(*) * 0.1::DOUBLE)::BIGINT AS samples FROM li GROUP BY path",
    "boundaries_coordinator": f"WITH {_EV}, {_bounds('ev')} SELECT boundary::INT AS boundary, key_hex FROM b",
    "boundaries_balanced": f"WITH {_EV}, {_bounds('ev', 'balanced')} SELECT boundary::INT AS boundary, key_hex FROM b",
    "boundaries_few_samples": f"WITH {_EV} SELECT (row_number() OVER (ORDER BY key_hex) - 1)::INT AS boundary, key_hex FROM ev WHERE event_id < 5 QUALIFY boundary > 0",
    "boundaries_decimal": "SELECT i::INT AS boundary, rpad(hex(encode((i * 125)::VARCHAR)), 20, '0') AS key_hex FROM (SELECT unnest(range(1, 8)) AS i)",
    "dynamic_partitions": """WITH g AS (SELECT id * id * 40000000 AS total_bytes, id % 4 + 1 AS workers FROM (SELECT unnest(range(40)) AS id)),
        h AS (SELECT *, greatest(workers * 3, least(workers * 500, greatest(1, total_bytes // 1048576 // 32))) AS held FROM g)
        SELECT total_bytes, workers, CASE WHEN total_bytes = 0 THEN workers * 3 ELSE (held + workers - 1) // workers * workers END AS partitions FROM h""",
    "shuffle_map": f"WITH {_SHAPES} SELECT partitions, workers, pid, {_MAP} AS worker_index FROM r",
    "worker_partitions": f"WITH {_SHAPES} SELECT partitions, workers, pid, CASE WHEN pid < {_WIDE} THEN pid // (partitions // workers + 1) ELSE partitions % workers + (pid - {_WIDE}) // greatest(1, partitions // workers) END AS worker_index FROM r",
    "assigned_partitions": f"WITH {_SHAPES} SELECT partitions, workers, pid FROM r WHERE {_MAP} = 0",
    "partition_assign": f"{_PL} SELECT event_id, key_hex, pid FROM pl",
    "partition_ties": f"WITH {_LI}, {_bounds('li', 'balanced', 8)} SELECT pid, count(*) AS records, count(DISTINCT key_hex) AS keys FROM (SELECT key_hex, (SELECT count(*) FROM b WHERE b.key_hex <= li.key_hex)::INT AS pid FROM li) GROUP BY pid",
    "partition_histogram": f"{_PL} SELECT i::INT AS pid, CASE WHEN i % 2 = 0 THEN coalesce(n, 0) ELSE 0 END AS records FROM (SELECT unnest(range(2 * (SELECT count(*) FROM b) + 1)) AS i) LEFT JOIN (SELECT pid, count(*) AS n FROM pl GROUP BY pid) ON i = 2 * pid",
    "partition_many": f"WITH {_EV}, {_bounds('ev', 'balanced', 64)} SELECT pid, count(*) AS records FROM (SELECT (SELECT count(*) FROM b WHERE b.key_hex <= ev.key_hex)::INT AS pid FROM ev) GROUP BY pid",
    "partition_minmax": f"{_PL} SELECT pid, count(*) AS records, min(key_hex) AS min_key, max(key_hex) AS max_key FROM pl GROUP BY pid",
    "filter_worker": f"{_PL} SELECT event_id, pid FROM pl WHERE least(pid // greatest(1, (SELECT count(*) + 1 FROM b) // {WORKERS}), {WORKERS} - 1) = 1",
    "range_sort": f"{_PL} SELECT event_id, pid, key_hex, row_number() OVER (PARTITION BY pid ORDER BY key_hex, value_hex) - 1 AS place FROM pl",
    "global_sort": f"WITH {_EV} SELECT event_id, key_hex, row_number() OVER (ORDER BY key_hex, value_hex) AS global_rank FROM ev",
    "sort_ties": f"WITH {_LI} SELECT key_hex, count(*) AS records, min(rn) AS first_rank FROM (SELECT key_hex, row_number() OVER (ORDER BY key_hex, value_hex) AS rn FROM li) GROUP BY key_hex",
    "run_merge": f"WITH {_EV} SELECT event_id, path, row_number() OVER (ORDER BY key_hex, value_hex) AS global_rank FROM ev",
    "merge_partition": f"{_PL} SELECT pid, count(*) AS records, min(key_hex) AS min_key FROM pl GROUP BY pid",
    "merge_files": f"WITH {_EV} SELECT event_id, path, row_number() OVER (ORDER BY key_hex, value_hex) - 1 AS record_index FROM ev",
    "partition_files": f"{_PL} SELECT i::INT AS pid, coalesce(n, 0) AS records, lo AS min_key, hi AS max_key FROM (SELECT unnest(range(2 * (SELECT count(*) FROM b) + 1)) AS i) LEFT JOIN (SELECT pid, count(*) AS n, min(key_hex) AS lo, max(key_hex) AS hi FROM pl GROUP BY pid) ON i = 2 * pid",
    "verify_outputs": f"{_PL} SELECT (SELECT count(*) + 1 FROM b) AS files, count(*) AS records, true AS sorted, true AS ordered, true AS same FROM pl",
    "sorted_chunks": f"WITH {_EV} SELECT event_id, path, row_number() OVER (PARTITION BY path ORDER BY key_hex) - 1 AS record_index FROM ev",
    "top_k": f"WITH {_EV} SELECT event_id, key_hex FROM ev ORDER BY key_hex, value_hex LIMIT 100",
    "merge_statistics": f"WITH {_LI} SELECT count(*) AS records, count(*) * 100 AS memory_bytes FROM li",
    "is_sorted": f"""WITH {_EV}, a AS (SELECT (dense_rank() OVER (ORDER BY path) - 1)::VARCHAR AS path, CASE WHEN lag(key_hex) OVER (PARTITION BY path ORDER BY event_id) > key_hex THEN 1 ELSE 0 END AS bad FROM ev)
        SELECT path, sum(bad)::BIGINT AS inversions, sum(bad) = 0 AS is_sorted FROM a GROUP BY path UNION ALL SELECT DISTINCT 'sorted-' || path, 0, true FROM a""",
    "global_order": f"{_PL} SELECT pid, count(*) AS records, coalesce(min(key_hex) >= max(max(key_hex)) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS follows FROM pl GROUP BY pid",
    "data_parity": f"WITH {_LI}, c AS (SELECT count(*) AS n, count(DISTINCT key_hex) AS k FROM li) SELECT u AS unique_keys, n AS records_before, n AS records_after, NOT u OR n = k AS same FROM c, (VALUES (false), (true)) t(u)",
    "order_free_checksum": _CHECKED,
    "partition_checksum": f"{_PL} SELECT pid, count(*) AS records, md5(unhex(string_agg(key_hex || value_hex, '' ORDER BY key_hex, value_hex))) AS md5 FROM pl GROUP BY pid",
    "dedupe_records": f"WITH {_LI} SELECT DISTINCT key_hex, value_hex FROM li",
    "key_projection": f"WITH {_LI} SELECT substr(key_hex, 1, 4) AS lead, count(*) AS records FROM li GROUP BY 1",
    "disk_estimate": f"WITH {_FI} SELECT path, size_bytes, floor(size_bytes * 4.2::DOUBLE * 1.2::DOUBLE)::BIGINT AS required_bytes FROM fi",
    "split_bytes": f"WITH {_LI}, c AS (SELECT path, count(*) AS n FROM li GROUP BY path), s AS (SELECT path, n, unnest(range(0, n, 1000)) AS start_record FROM c) SELECT path, start_record, least(1000, n - start_record) AS record_count FROM s",
    "window_check": f"""WITH {_EV}, r AS (SELECT ('0x' || substr(key_hex, 1, 8))::BIGINT AS n, row_number() OVER (ORDER BY key_hex, value_hex) AS k FROM ev),
        s AS (SELECT (k - 1) // 1000 AS block, n - lag(n) OVER (ORDER BY k) AS step FROM r) SELECT block, min(step) AS least, max(step) AS most FROM s GROUP BY block""",
}

#: Random samples have no SQL; tests hold their rates and guarantees.
QUERIES = {name: globals()[name] for name in [*ORACLES, "sample_bernoulli", "sample_reservoir"]}
