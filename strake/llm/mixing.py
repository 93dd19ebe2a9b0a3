"""Mixing sources to target weights, with DataFrame functions only.

Words are counted once a document and written as a narrow table; the texts are
not read again. Per source the counts meet in one partial aggregate. Targets
follow by water filling: every source's share of all words by weight, cut at
``cap`` times its size, the excess reshared until none is above. Each round is
one aggregate over the table of sources, which is never collected.

A document is then taken ``floor(rate)`` times, and once more with probability
equal to the fraction, where rate = target / source size. Coins are hashes of
ids. Were they independent, a few long documents would carry a source far from
its target, so they are balanced: the classes of a source's texts by their bytes
(16 an octave) are gone through from the longest down, and of each class the documents with the
smallest coins are taken, as many as bring the words taken so far back on
course. The words that are left over those that the target still lacks are a
martingale, so a document's own probability stays the fraction (but where a
class weighs more than all shorter ones can make up for), while a source misses
its target by about one document of its shortest classes. The number of a class is rounded by a hash of its name. What a document needs to know is one
threshold for its class: the coin of the last one taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Tables of up to so many sources, or size classes of sources, are broadcast (some 60 bytes each); longer ones are joined by a salted key.
BROADCAST_SOURCES = 100_000
SALTS = 64


def unit(key: Column, seed: int = 17) -> Column:
    """A number in [0, 1) from a text: the first 52 bits of an MD5."""
    said = F.concat(F.lit(f"{seed}:"), key)
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def coin(doc_id: str = "doc_id", text: str = "text", seed: int = 17) -> Column:
    """A row's coin: a hash of the id, of the text where the id is null."""
    return unit(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit("")), seed)


def bytes_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def size_class(length: Column) -> Column:
    """The class of a text by its bytes, which are known without a look at them: up to 31 each for itself, from there 16 an octave."""
    bits = F.length(F.bin(length))
    return (bits * 32 + F.floor(length / F.pow(F.lit(2.0), F.greatest(bits - 5, F.lit(0))))).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, target of a table (source, size); weights repeat over the sources in code-point order, null last."""
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = cut(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    firsts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("first"))
    rank = F.col("first") + F.col("at") - F.shiftleft("part", 33)
    # firsts has a row for each partition of the sort: bounded by the shuffle width
    ranked = ordered.withColumn("part", part).join(F.broadcast(firsts), "part").withColumn("rank", rank)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", weight.cast("long").alias("w")), "weights")

    big = lambda c: c.cast("decimal(38,0)")
    limit = F.lit(cap) * F.col("source_size")
    total, open_w, n_capped = table.agg(F.sum("source_size"), F.sum("w"), F.lit(0)).first()
    if not total:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    left = total
    while True:  # the capped set only grows, so the rounds end; most inputs take two or three
        over = big(F.lit(left)) * big(F.col("w")) > big(limit) * big(F.lit(open_w))
        n, held, free = table.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("w")))).first()
        if n == n_capped:
            break
        left, open_w, n_capped = total - (held or 0), free or 0, n
    share = F.lit(float(left)) / F.lit(float(open_w)) * F.col("w")
    return table.select("source", "source_size", F.when(over, limit.cast("double")).otherwise(share).alias("target"))


def _balanced(classes: Column, extra: Column, words: Column) -> Column:
    """How many of each size class are taken once more, as an array of (class, k, first).

    classes: of (class, n, words, first, u) from the longest down; extra: the words
    to be taken of them; words: what they have in all. At most a thousand classes.
    """
    none = F.array().cast("array<struct<class:int,k:long,first:long>>")

    def step(state: Column, c: Column) -> Column:
        p = F.when(state["rest"] > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), state["left"] / state["rest"]))).otherwise(F.lit(0.0))
        k = F.least(F.floor(p * c["n"].cast("double") + c["u"]).cast("long"), c["n"])
        took = k.cast("double") * (c["words"].cast("double") / c["n"].cast("double"))
        one = F.struct(c["class"].alias("class"), k.alias("k"), c["first"].alias("first"))
        return F.struct((state["left"] - took).alias("left"), (state["rest"] - c["words"].cast("double")).alias("rest"), F.concat(state["ks"], F.array(one)).alias("ks"))

    begin = F.struct(extra.alias("left"), words.cast("double").alias("rest"), none.alias("ks"))
    return F.aggregate(classes, begin, step, lambda s: s["ks"])


def thresholds(sizes: DataFrame, targets: DataFrame, seed: int = 17, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """source, class, source_size, target, last: rows of a class whose coin is at most ``last`` are taken once more.

    sizes (source, size, length, coin) are sorted once, by source, class and coin, and
    written; a class's last coin stands at a known place of that order, so no
    source or class is held by one task.
    """
    ordered = sizes.select("source", size_class(F.col("length")).alias("class"), "size", "coin").orderBy("source", "class", "coin").withColumn("at", F.monotonically_increasing_id())
    ordered = cut(ordered, "coins")
    part = F.shiftright("at", 33)
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # a row for each partition of the sort: bounded by the shuffle width
    firsts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    placed = ordered.withColumn("part", part).join(F.broadcast(firsts), "part").withColumn("place", F.col("offset") + F.col("at") - F.shiftleft("part", 33))
    classes = placed.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("place").alias("first"))
    u = unit(F.concat_ws(":", F.coalesce("source", F.lit("")), F.col("class").cast("string")), seed)
    of = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "n", "words", "first", u.alias("u"))), asc=False).alias("classes"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = targets.withColumnsRenamed({"source": "t_source"})
    taken = of.join(known, F.col("source").eqNullSafe(F.col("t_source")))
    extra = (rate - F.floor(rate)) * F.col("source_size").cast("double")
    each = taken.select("source", "source_size", "target", F.explode(_balanced(F.col("classes"), extra, F.col("source_size"))).alias("c"))
    each = cut(each.select("source", "source_size", "target", F.col("c.class").alias("class"), F.when(F.col("c.k") > 0, F.col("c.first") + F.col("c.k") - 1).alias("place")), "classes")
    wanted = each.filter("place is not null").select("place")
    last = placed.join(F.broadcast(wanted) if each.count() <= broadcast_sources else wanted, "place").select("place", F.col("coin").alias("last"))
    return cut(each.join(last, "place", "left").select("source", "class", "source_size", "target", F.coalesce("last", F.lit(-1.0)).alias("last")), "thresholds")


def with_targets(rows: DataFrame, found: DataFrame, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """rows (source, length) with their class's threshold, source's size and target: a broadcast while the table's counted size allows it, else a salted join."""
    found = found.withColumnsRenamed({"source": "t_source", "class": "t_class"})
    same = F.col("source").eqNullSafe(F.col("t_source")) & (size_class(F.col("length")) == F.col("t_class"))
    if found.count() <= broadcast_sources:
        return rows.join(F.broadcast(found), same).drop("t_source", "t_class")
    many = found.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("coin", "length"), F.lit(SALTS)).cast("int"))
    return salted.join(many, same & (F.col("salt") == F.col("t_salt"))).drop("t_source", "t_class", "t_salt", "salt")


def copies() -> Column:
    """How often a row is taken, of its coin, its class's threshold and its source's size and target."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(F.col("coin") <= F.col("last"), 1).otherwise(0)).cast("long")


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often each row goes into the mix.

    A null text has size 0, an empty one too; a null source is a source, the
    last. Rows that repeat an id share its coin, so of one length they are taken
    alike. Sources without a word have target 0 and are not taken. Other columns of ``docs`` are not read; an empty
    table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), bytes_of().alias("length"), coin(seed=seed).alias("coin"))
    sizes = cut(read, "sizes")
    found = thresholds(sizes, source_targets(sizes.select("source", "size"), weights, cap), seed, broadcast_sources)
    rows = with_targets(sizes, found, broadcast_sources)
    return rows.withColumn("copies", copies()).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, numbered by ``copy_no`` from 0.

    All columns are returned; one of the name copy_no is replaced. The classes'
    thresholds are joined to the rows, so texts are not shuffled, and their words
    are counted once. Nulls, repeated
    rows and empty tables as in ``mix_counts``.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(docs.select("source", size.alias("size"), bytes_of().alias("length"), coin(seed=seed).alias("coin")), "sizes")
    found = thresholds(sizes, source_targets(sizes.select("source", "size"), weights, cap), seed, broadcast_sources)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copy_no"]).alias("doc"), "source", bytes_of().alias("length"), coin(seed=seed).alias("coin"))
    rows = with_targets(packed, found, broadcast_sources).withColumn("copies", copies())
    many = F.when(F.col("copies") > 0, F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.select("doc", F.explode(many).alias("copy_no")).select("doc.*", "copy_no")
