"""Integrity audits and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies) of keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def duplicate_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``duplicates``, the rows beyond the first of each key."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows of ``child`` whose non-null key the parent lacks."""
    return child.filter(F.col(on).isNotNull()).join(parent.select(on).distinct(), on, "left_anti")


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, missing) for every column; blanks and NaN are missing."""

    def gone(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return c.isNull() | (F.trim(c) == "" if kind == "string" else F.isnan(c) if kind in ("double", "float") else F.lit(False))

    counts = df.agg(*[F.count_if(gone(n, k)).alias(n) for n, k in df.dtypes])
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("missing")) for n in df.columns])
    return counts.select(F.inline(pairs))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: ``n_rows`` and ``digest``, the same for the same rows in any order, with repeats counted.

    A row is the text of its cells in order of the column names. The digest adds both 60-bit halves of the rows' md5 as whole
    numbers of 38 digits, so any engine with md5 can recompute it; sums are made before the shuffle.
    """
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    mark = F.md5(F.concat_ws("\x1f", *cells))
    half = lambda at: F.sum(F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = [F.coalesce(half(at), F.lit(0).cast("decimal(38,0)")).cast("string") for at in (1, 16)]
    return df.agg(F.count("*").alias("n_rows"), F.md5(F.concat_ws(":", F.count("*").cast("string"), *sums)).alias("digest"))


def threshold_checks(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """``limits`` (metric, low, high) against ``metrics`` (metric, value): value and status pass, fail or missing."""
    joined = limits.join(metrics, "metric", "left")
    inside = (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    return joined.withColumn("status", F.when(F.col("value").isNull(), "missing").when(inside, "pass").otherwise("fail"))


def evidence_depth(rows: Column, leagues: Column) -> Column:
    """high from three lines or two leagues on, medium for two lines, else low."""
    return F.when((rows >= 3) | (leagues >= 2), "high").when(rows == 2, "medium").otherwise("low")


def pick_priority(pick: Column) -> Column:
    """How soon a gap should be closed, by the place of the player; standard without one."""
    return F.when(F.coalesce(pick, F.lit(0)) <= 0, "standard").when(pick <= 32, "critical").when(pick <= 96, "high").when(pick <= 160, "medium").otherwise("standard")


def dataset_status(share: Column) -> Column:
    """Status of a table by the share of its rows that have evidence; empty without rows."""
    return F.when(share.isNull(), "empty").when(share >= 0.65, "strong").when(share >= 0.35, "usable").otherwise("thin")
