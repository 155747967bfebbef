"""Ranks, percentiles, top N and rank metrics with stated ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..plans.ranks import places, running_total
from ..plans.runtime import join_checked, stage


def rank_in_group(df: DataFrame, groups: list[str], score: str, ties: list[Column], top: int = 5, top_bonus: float = 0.08, high: float = 0.9, high_bonus: float = 0.04) -> DataFrame:
    """``role_rank`` (score descending, then ``ties``), ``role_count``, ``role_percentile`` and ``role_bonus``.

    The percentile is 1 for the first and 0 for the last, 1 in a group of one.
    """
    ranked = places(df, groups, [F.col(score).desc(), *ties], "role_rank", "role_count")
    ranked = ranked.withColumns({c: F.col(c).cast("int") for c in ("role_rank", "role_count")})
    percentile = F.when(F.col("role_count") == 1, F.lit(1.0)).otherwise((F.col("role_count") - F.col("role_rank")) / (F.col("role_count") - 1))
    bonus = F.when(F.col("role_rank") <= top, F.lit(top_bonus)).when(percentile >= high, F.lit(high_bonus)).otherwise(F.lit(0.0))
    return ranked.withColumns({"role_percentile": percentile, "role_bonus": bonus})


def mid_ranks(df: DataFrame, value: str, name: str, groups: list[str] | None = None) -> DataFrame:
    """``df`` with the average rank (from 1, ascending) of ``value``, equal values sharing one.

    Ranks come from counts per distinct value, added up over range partitions; neither a group nor its distinct values meet in
    one task. A value that many rows hold is joined salted or broadcast. Null values have no rank and are left out.
    """
    keys = groups or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = running_total(counts, keys, [F.col(value)], F.col("__n"), "__upto")
    ranks = stage(upto.select(*keys, value, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name)))
    return join_checked(df, ranks, [*keys, value])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ``spearman``, the correlation of mid-ranks; 0 if either side is constant or there are under two rows."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    ranked = mid_ranks(mid_ranks(rows, "a", "ra"), "b", "rb")
    flat = (F.coalesce(F.stddev_pop("ra"), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop("rb"), F.lit(0.0)) == 0)
    cov = F.covar_pop("ra", "rb") / F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))
    return ranked.agg(F.when(flat, F.lit(0.0)).otherwise(cov).alias("spearman"))


def precision_at(df: DataFrame, label: str, score: str, ties: list[Column], n: int) -> DataFrame:
    """One row: ``n_rows`` taken, ``hits`` and ``precision`` among the ``n`` highest scores (a top-n report)."""
    top = df.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), *ties).limit(n)
    return top.agg(F.count("*").alias("n_rows"), F.count_if(F.col(label)).alias("hits"), F.try_divide(F.count_if(F.col(label)).cast("double"), F.count("*")).alias("precision"))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(label).cast("double") - F.col(score), F.lit(2.0))).alias("brier"))


def top_overlap(df: DataFrame, id_col: str, a: Column, b: Column, n: int) -> DataFrame:
    """One row: how many ids are among the first ``n`` by both orders (ties by id)."""
    first = lambda order: df.orderBy(order, id_col).select(id_col).limit(n)
    return first(a).intersect(first(b)).agg(F.count("*").alias("overlap"))


def max_normalized(df: DataFrame, value: str, name: str) -> DataFrame:
    """``value`` by the largest value of the table (0 if that is not positive), rounded to three digits before."""
    high = df.agg(F.max(F.round(value, 3)).alias("__m"))  # one row
    return df.join(F.broadcast(high)).withColumn(name, F.when(F.col("__m") > 0, F.round(value, 3) / F.col("__m")).otherwise(F.lit(0.0))).drop("__m")


def blended(weights: dict[str, float]) -> Column:
    """Weighted mean of score columns, clipped to 0..1; null unless every score is there (those of all sets are blended)."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    return clamp(sum(F.col(c) * w for c, w in weights.items()) / total)
