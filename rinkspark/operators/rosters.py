"""Snapshots of who belongs where: point-in-time overlays, assignments by date, persons in two organizations, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_assignment(rows: DataFrame, key: str, date: str, games: str, row_id: str) -> DataFrame:
    """One row a key: the latest dated one; without any date the one of most games, marked low confidence."""
    order = Window.partitionBy(key).orderBy(F.col(date).desc_nulls_last(), F.col(games).desc_nulls_last(), row_id)
    place = rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return place.withColumn("confidence", F.when(F.col(date).isNull(), "low").otherwise("high"))


def overlay_snapshot(base: DataFrame, snapshot: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Rows of both with ``status`` matched, new (snapshot only) or dropped (base only); ``keep`` comes from the base.

    Keys are unique on both sides (see reconcile.reject_ambiguous) and null-safe.
    """
    left = base.select(*on, *keep, F.lit(True).alias("__b"))
    right = snapshot.select(*[F.col(c).alias(f"__r_{c}") for c in on], F.lit(True).alias("__s"))
    joined = left.join(right, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on], "full")
    status = F.when(F.col("__b") & F.col("__s"), "matched").when(F.col("__s"), "new").otherwise("dropped")
    return joined.select(*[F.when(F.col("__b"), F.col(c)).otherwise(F.col(f"__r_{c}")).alias(c) for c in on], *keep, status.alias("status"))


def in_several_organizations(rows: DataFrame, name_key: Column, organization: str, born: str, row_id: str, days: int = 366) -> DataFrame:
    """(row_id, others): rows whose name stands in another organization for someone born within ``days``.

    Counted with a range frame over birth dates per name, minus the frame of the same organization; no self-join. Rows
    without a birth date or key are left out.
    """
    keyed = rows.select(row_id, F.col(organization).alias("__o"), F.unix_date(born).cast("bigint").alias("__d"), name_key.alias("__k")).dropna()
    every = Window.partitionBy("__k").orderBy("__d").rangeBetween(-days, days)
    own = Window.partitionBy("__k", "__o").orderBy("__d").rangeBetween(-days, days)
    return keyed.select(row_id, (F.count("*").over(every) - F.count("*").over(own)).alias("others")).filter("others > 0")


def banded(value: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the band below the first bound that is larger; the last name beyond, null of null."""
    out = None
    for bound, name in zip(bounds, names):
        out = F.when(value < bound, name) if out is None else out.when(value < bound, name)
    return out.when(value.isNotNull(), names[-1])


def tiered(conditions: list[Column]) -> Column:
    """0 for rows that meet the first condition, 1 the second, and so on; the number of conditions for the rest."""
    out = None
    for i, c in enumerate(conditions):
        out = F.when(c, i) if out is None else out.when(c, i)
    return out.otherwise(len(conditions))
