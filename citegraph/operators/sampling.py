"""Dense index, deterministic random draws, first-N.

``dense_index`` numbers rows 0..n-1 in key order without a global window: rows
are range-partitioned and sorted within partitions, each row gets its in-partition
position from ``monotonically_increasing_id``, and partition offsets come from a
per-partition count table whose size is bounded by the partition count (so it
is safe to broadcast).  The range-partitioned frame is checkpointed first, because
range bounds come from sampling and must not change between the two uses.

Random draws are MD5-based so an independent SQL engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegraph.session import cut_lineage

_MID_SHIFT = 1 << 33  # monotonically_increasing_id = partition_id * 2^33 + row


def dense_index(df: DataFrame, key: str, name: str = "i", total: str | None = "n") -> DataFrame:
    """Adds ``name`` = 0-based rank of ``key`` (must be unique) and optionally
    ``total`` = row count."""
    ranged = (
        df.repartitionByRange(F.col(key))
        .sortWithinPartitions(key)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: an unpartitioned window here is bounded by the partition count
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(F.lit(1))).alias("_n"),
    )
    out = ranged.join(F.broadcast(offs), "_pid").withColumn(
        name, F.col("_mid") - F.col("_pid").cast("long") * F.lit(_MID_SHIFT) + F.col("_off")
    )
    if total:
        out = out.withColumnRenamed("_n", total)
    return out.drop("_pid", "_mid", "_off", "_n")


def md5_uniform(*parts) -> Column:
    """Non-negative 60-bit integer from MD5 of ``a:b:c``; identical in DuckDB as
    ``('0x' || substr(md5(a || ':' || b || ':' || c), 1, 15))::UBIGINT``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    s = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def random_docs(owners: DataFrame, owner_key: str, docs: DataFrame, doc_key: str, k: int, seed: int = 0,
                indexed: DataFrame | None = None) -> DataFrame:
    """``k`` uniform draws with replacement from ``docs`` for every owner.

    Rows ``(owner_key, draw, sampled_<doc_key>)``.  Draw ``j`` of owner ``o`` picks
    index ``md5(o:j:seed) mod n`` in the dense index of ``docs`` (an equi-join,
    so it is distributed; nothing goes through the driver).
    """
    idx = indexed if indexed is not None else dense_index(docs.select(doc_key), doc_key)
    n = idx.select(F.max("n")).scalar()
    draws = owners.select(owner_key).select(
        owner_key, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw")
    )
    draws = draws.withColumn("i", F.pmod(md5_uniform(F.col(owner_key), F.col("draw"), F.lit(seed)), n))
    return draws.join(idx.select("i", F.col(doc_key).alias("sampled_" + doc_key)), "i").drop("i")


def random_doc(docs: DataFrame, doc_key: str, seed: int = 0) -> DataFrame:
    """One document chosen by ``md5('random:seed') mod n``."""
    idx = dense_index(docs.select(doc_key), doc_key)
    n = idx.select(F.max("n")).scalar()
    pick = idx.where(F.col("i") == F.pmod(md5_uniform(F.lit("random"), F.lit(seed)), n)).select(doc_key)
    return docs.join(pick, doc_key, "left_semi")


def first_n(df: DataFrame, group: str, order: list, n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group in a fixed order (ties broken by the order
    columns, so the result is deterministic).  ``row_number <= n`` lets Spark
    insert a partial top-k before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
