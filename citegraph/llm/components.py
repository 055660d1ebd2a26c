"""Connected components of a link table by alternating star contractions.

Each round rewrites every link towards the smallest id around (large star, then
small star); after a few rounds every node links to its component's smallest id.
Minima are aggregates with a map-side part and are joined back to the links, so a
hub holding a third of all links is an ordinary skewed join, never one task's group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("hi", "lo").union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    return both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return joined.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): for every id that occurs in a link, the smallest id
    reachable from it, itself included.  `links` has two integer columns; loops,
    repeated links, nulls (ignored) and either direction are allowed.
    """
    a, b = links.columns[:2]
    now = stored(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"`{a}` is not null and `{b}` is not null and hi > lo").distinct(), "links"
    )
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).alias("mark")
    before = now.agg(mark).first().mark
    while True:
        last, now = now, stored(_small_star(_large_star(now)), "links")
        discard(last)
        after = now.agg(mark).first().mark
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
