"""Connected components of a graph that is too large for one machine.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every round
is a minimum for each node, which is partly aggregated before the shuffle, and a
join with the edges, whose skewed keys Spark splits. Rounds grow with the
logarithm of the longest path. Each ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root of all nodes of a table (a, b); root is the smallest node of the component."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(now, "edges")
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
        if not found[0]:
            break
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least).distinct(), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
