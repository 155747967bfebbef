"""Places and running totals within groups of any size: range partitions with offsets, no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stage


def running_total(df: DataFrame, groups: list[str], order: list[Column], weight: Column, name: str, total: str | None = None) -> DataFrame:
    """``df`` with ``name``, the sum of ``weight`` over the group's rows up to this one in ``order``, and ``total``, that of all.

    Rows are partitioned by ranges of (groups, order), so a group that holds any share of them is spread; a partition adds up its
    own rows, and what came before it is added. Only a partition's first group can have begun in another one and only its
    first and last can lie in several, so these sums are at most two rows a partition, which bounds their broadcast. ``order`` should
    end with a unique column: rows that are equal in it are taken in any order. A null group value is a group of its own.
    """
    cells = [F.col(f"`{g}`") for g in groups]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__w", weight).repartitionByRange(parts, *[c.asc_nulls_first() for c in cells], *order)
    placed = stage(placed.withColumn("__pid", F.spark_partition_id()))
    sums = placed.groupBy("__pid", *cells).agg(F.sum("__w").alias("__s"))
    # Groups that lie in one partition need no offset: keep those that share their key with another partition.
    within = Window.partitionBy(*cells)
    spread = sums.withColumn("__n", F.count("*").over(within)).filter("__n > 1")  # a row a group and partition
    before = F.coalesce(F.sum("__s").over(within.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = stage(spread.select("__pid", *[c.alias(f"__g{i}") for i, c in enumerate(cells)], before.alias("__before"), F.sum("__s").over(within).alias("__all")))
    local = Window.partitionBy("__pid", *cells)
    own = placed.withColumn("__own", F.sum("__w").over(local.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__sum", F.sum("__w").over(local))
    on = [F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    offsets = spread.withColumnRenamed("__pid", "__p")
    joined = own.join(F.broadcast(offsets), [F.col("__pid") == F.col("__p"), *on], "left")
    out = joined.withColumn(name, F.col("__own") + F.coalesce("__before", F.lit(0)))
    if total:
        out = out.withColumn(total, F.coalesce("__all", F.col("__sum")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in (name, total)], name, *([total] if total else []))


def places(df: DataFrame, groups: list[str], order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """``df`` with ``name``, the place from 1 within the group in ``order``, and ``total``, the group's rows (see running_total)."""
    return running_total(df, groups, order, F.lit(1), name, total)
