"""Grouped measures: ratios of sums, weighted means with the reference's three weightings, shares, roll-ups, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp


def ratio_of_sums(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator sums to nothing."""
    return F.coalesce(F.try_divide(F.sum(numerator), F.sum(denominator)), F.lit(0.0))


def mean_at_least_one(value: Column, weight: Column) -> Column:
    """Mean of the non-null values with weights of at least 1; 0 without values."""
    w = F.when(value.isNotNull(), F.greatest(F.coalesce(weight, F.lit(0)), F.lit(1)))
    return F.coalesce(F.try_divide(F.sum(value * w), F.sum(w)), F.lit(0.0))


def mean_positive(value: Column, weight: Column, plain_fallback: bool) -> Column:
    """Mean over positive weights; without any, the plain mean (``plain_fallback``) or 0."""
    w = F.when(value.isNotNull() & (weight > 0), weight)
    weighted = F.try_divide(F.sum(value * w), F.sum(w))
    return F.coalesce(weighted, F.avg(value) if plain_fallback else F.lit(None), F.lit(0.0))


def share_where(value: Column, condition: Column) -> Column:
    """Part of ``sum(value)`` for which ``condition`` holds; 0 of nothing."""
    return F.coalesce(F.try_divide(F.sum(F.when(condition, value).otherwise(F.lit(0))), F.sum(value)), F.lit(0.0))


def with_exposure(part: Column, whole: Column, exposure: Column, units: Column) -> Column:
    """``part / whole``; if there is no whole, ``exposure / units``; else 0."""
    return F.when(whole > 0, part / whole).otherwise(F.coalesce(F.try_divide(exposure, units), F.lit(0.0)))


def largest(order: list[Column], value: Column) -> Column:
    """``value`` of the row with the largest ``order`` (compared left to right)."""
    return F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))).getField("v")


def goalie_quality(save_percentage: Column, goals_against_average: Column, games: Column) -> Column:
    """0.55 / 0.30 / 0.15 of save rate, goals against and sample; 0 without both rates."""
    saves = F.when(save_percentage > 0, clamp((save_percentage - 0.880) / 0.050)).otherwise(F.lit(0.0))
    goals = F.when(goals_against_average > 0, clamp((3.50 - goals_against_average) / 1.50)).otherwise(F.lit(0.0))
    score = saves * 0.55 + goals * 0.30 + clamp(games / 35.0) * 0.15
    return F.when((save_percentage == 0) & (goals_against_average == 0), F.lit(0.0)).otherwise(score)


def goalie_metrics(lines: DataFrame, by: list[str]) -> DataFrame:
    """Per group: games, shots, saves, goals against, rates (ratio of sums, else games-weighted mean) and quality.

    Lines without any goalie measure do not count. ``minutes`` is a double column of the lines.
    """
    goalies = lines.filter("save_percentage is not null or goals_against_average is not null or saves is not null or shots_against is not null")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = goalies.groupBy(*by).agg(
        total("games"), F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("minutes"), *[total(c) for c in ("shots_against", "saves", "goals_against", "shutouts")],
        mean_at_least_one(F.col("save_percentage"), F.col("games")).alias("__sv"), mean_at_least_one(F.col("goals_against_average"), F.col("games")).alias("__gaa"),
    )
    rated = sums.withColumns({
        "save_percentage": F.when(F.col("shots_against") > 0, F.col("saves") / F.col("shots_against")).otherwise(F.col("__sv")),
        "goals_against_average": F.when(F.col("minutes") > 0, F.col("goals_against") * 60 / F.col("minutes")).otherwise(F.col("__gaa")),
    })
    return rated.withColumn("quality_score", goalie_quality(F.col("save_percentage"), F.col("goals_against_average"), F.col("games"))).drop("__sv", "__gaa")


def examples(order: list[Column], name: Column, n: int = 5) -> Column:
    """Array of the ``n`` first names by ``order`` (ascending). Collects a whole group: for groups of bounded size."""
    return F.transform(F.slice(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], name.alias("name")))), 1, n), lambda x: x["name"])


def dense_grid(df: DataFrame, rows: list[str], columns: list[str], measures: dict[str, Column]) -> DataFrame:
    """Every pair of a seen row key and a seen column key with its measures, 0 where it has no rows.

    Both key sets are distinct values, not rows; the grid is as large as their product, which is its definition.
    """
    grouped = df.groupBy(*rows, *columns).agg(*[m.alias(name) for name, m in measures.items()])
    grid = df.select(*rows).distinct().join(df.select(*columns).distinct(), F.lit(True))
    return grid.join(grouped, [*rows, *columns], "left").fillna(0, list(measures))
