"""Top N items within every group, by per-group score histograms.

1. Scores of groups of more than N rows are counted per group and bucket (equal widths between the group's extremes;
infinite scores have buckets of their own). 2. From the top, the bucket in which the count reaches N is the group's lower
threshold: at least N rows are in it or above. 3. Where that bucket holds many more rows than are still needed, it is divided
again, as long as that helps: an outlier can't keep a whole group in one bucket. 4. Rows below the thresholds go. The
rest is ranked exactly with the tie keys; Spark limits each map task's rows to N a group before the shuffle
(WindowGroupLimit), so a million ties at the threshold don't meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import join_checked, stage

BUCKETS = 128
#: A threshold's bucket is divided again while it holds more than this many times N rows, at most LEVELS times.
COARSE, LEVELS = 8, 6


def latest(df: DataFrame, keys: list[str], updated: str, row_id: str) -> DataFrame:
    """The row of each key with the latest ``updated`` (missing: oldest), of equals the one with the largest id."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(updated).alias("__t"), F.col(row_id).alias("__i"), *[F.col(f"`{c}`") for c in rest])).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.`{c}`").alias(c) for c in rest])


def _bucket(score: Column, low: Column, high: Column) -> Column:
    """0 for minus infinity, BUCKETS + 1 for plus infinity, else 1 to BUCKETS; never falls as the score grows."""
    place = F.floor((score - low) / (high - low) * BUCKETS).cast("int")
    inside = F.when(high > low, F.least(F.greatest(place, F.lit(0)), F.lit(BUCKETS - 1)) + 1).otherwise(F.lit(1))
    return F.when(score == float("inf"), BUCKETS + 1).when(score == float("-inf"), 0).otherwise(inside)


def _thresholds(rows: DataFrame, keys: list[str], value: Column, n: int) -> DataFrame:
    """(keys, __least): per group of more than ``n`` rows a score that at least ``n`` rows reach.

    ``rows`` have non-null ``keys``. Only groups whose threshold bucket is still coarse are counted again, within that bucket.
    """
    finite = F.when(F.abs(value) != float("inf"), value)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(finite).alias("__low"), F.max(finite).alias("__high"))
    open_ = stage(sizes.filter(F.col("__n") > n).select(*keys, "__low", "__high", F.lit(n).cast("bigint").alias("__need")))
    out = None
    for level in range(LEVELS):
        inside = join_checked(rows.select(*keys, value.alias("__v")), open_, keys)
        if level:
            inside = inside.filter((F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))
        bucket = _bucket(F.col("__v"), F.col("__low"), F.col("__high"))
        counts = inside.groupBy(*keys, "__need", bucket.alias("__b")).agg(F.count("*").alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        above = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__b").desc()))  # at most BUCKETS + 2 rows a group
        first = counts.withColumn("__above", above).filter(F.col("__above") >= F.col("__need"))
        first = first.groupBy(*keys).agg(F.max_by(F.struct("__low", "__high", "__c", "__above", "__need"), "__b").alias("s")).select(*keys, "s.*")
        first = stage(first.withColumn("__need", F.col("__need") - F.col("__above") + F.col("__c")))
        coarse = (F.col("__c") > COARSE * n) & (F.col("__low") < F.col("__high")) & (F.lit(level) < LEVELS - 1)
        done = first.filter(~coarse).select(*keys, F.col("__low").alias("__least"))
        out = done if out is None else out.unionByName(done)
        open_ = first.filter(coarse).select(*keys, "__low", "__high", "__need")
        if open_.isEmpty():
            break
    return out


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` rows of each group with the highest ``score`` (double), ties by ``ties`` ascending, with ``rank`` from 1.

    Null and NaN scores do not rank. A null group value is a group of its own. Rows equal in score and all tie keys
    are interchangeable; repeated rows rank repeatedly. A column called ``rank`` in ``df`` is replaced. Empty stays empty.
    ``df`` is read several times: it should be a table or staged.
    """
    value = F.col(f"`{score}`")
    rows = df.drop(rank).filter(value.isNotNull() & ~F.isnan(value))
    keys = [f"__g{i}" for i in range(len(groups))]
    # Keys without nulls, so that they can be joined: a flag beside the value.
    solid = [F.struct(F.col(f"`{g}`").isNull().alias("gone"), F.coalesce(F.col(f"`{g}`").cast("string"), F.lit("")).alias("v")).alias(k) for g, k in zip(groups, keys)]
    keyed = rows.select("*", *solid)
    limits = stage(_thresholds(keyed.select(*keys, value.alias("__score")), keys, F.col("__score"), n))
    kept = join_checked(keyed, limits, keys, "left").filter(F.col("__least").isNull() | (value >= F.col("__least")))
    order = Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy(value.desc(), *[F.col(f"`{t}`").asc() for t in ties])
    return kept.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n).select(*rows.columns, F.col(rank).cast("int").alias(rank))
