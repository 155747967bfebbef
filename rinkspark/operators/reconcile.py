"""Deduplication and reconciliation within groups, with audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum_key
from ..plans.runtime import join_checked, stage

# Priority of a source label.
PRIORITY = {"league-feed": 60, "open-stats": 60, "club-site": 55, "guide-pdf": 50, "wiki-career": 25, "fan-archive": 10}


def source_priority(labels: Column, priority: dict[str, int] = PRIORITY, default: int = 10) -> Column:
    """Highest priority of the ``;``- or ``+``-joined labels; unknown labels count ``default``."""
    known = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    each = F.transform(F.split(F.coalesce(labels, F.lit("")), "\\s*[;+]\\s*"), lambda x: F.coalesce(F.try_element_at(known, F.trim(x)), F.lit(default)))
    return F.array_max(each)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order``; a null key is a key. Ranking is limited before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", place).filter("__n = 1").drop("__n")


def repeated_rows(df: DataFrame, row_id: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows that equal an earlier row in all columns but ``row_id`` and ``ignore``."""
    columns = [c for c in df.columns if c != row_id and c not in ignore]
    place = F.row_number().over(Window.partitionBy(*columns).orderBy(row_id))
    return df.withColumn("__n", place).filter("__n > 1").drop("__n")


def conflicts(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, row_count, conflict_fields) of the keys whose rows hold two or more values in a field."""
    differ = [F.when(F.min(f) != F.max(f), F.lit(f)).alias(f"__{f}") for f in fields]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("row_count"), *differ)
    return grouped.select(*keys, "row_count", F.concat_ws("; ", *[f"`__{f}`" for f in fields]).alias("conflict_fields")).filter("conflict_fields <> ''")


def prefer_by_priority(df: DataFrame, keys: list[str], fields: list[str], priority: Column, row_id: str) -> DataFrame:
    """One row a key: each field from the row of highest priority that has it, then the longest text, then the first row."""
    ranked = df.withColumn("__p", priority)
    best = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col("__p"), F.length(F.col(f).cast("string")), -F.col(row_id), F.col(f).alias("v")))).getField("v").alias(f) for f in fields]
    return ranked.groupBy(*keys).agg(F.count("*").alias("row_count"), *best)


def sum_phases(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Phases of one season added up; a measure that every phase lacks stays null."""
    return df.groupBy(*keys).agg(F.count("*").alias("phases"), *[F.sum(c).alias(c) for c in sums])


def reject_ambiguous(df: DataFrame, id_col: str, name_key: Column, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): every row of an id with conflicting values, or of a name with several ids."""
    keyed = df.withColumn("__name", name_key)
    by_id = keyed.groupBy(id_col).agg(F.count_distinct(F.struct(*values)).alias("__v"))
    by_name = keyed.filter("__name is not null").groupBy("__name").agg(F.count_distinct(id_col).alias("__i"))
    marked = keyed.join(by_id, id_col, "left").join(by_name, "__name", "left")
    reason = F.when(F.col("__v") > 1, "conflicting_id").when(F.col("__i") > 1, "ambiguous_name")
    marked = marked.withColumn("reason", reason)
    return marked.filter("reason is null").select(*df.columns), marked.filter("reason is not null").select(*df.columns, "reason")


def with_club(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """``df`` with ``club``: the team's letters and digits, a league's code replaced by its team; null without a team.

    Each distinct spelling of a league is read once; the dictionary is joined to the rows, broadcast only if it was counted
    to be small. ``aliases`` (league, code, team) is reduced to one team per league and code.
    """
    codes = aliases.groupBy(F.col("league").alias("__l"), alnum_key(F.col("code")).alias("__key")).agg(F.min(alnum_key(F.col("team"))).alias("__team")).dropna()
    keyed = df.withColumns({"__l": F.coalesce("league", F.lit("")), "__spelled": F.col("team")})
    spelled = keyed.select("__l", "__spelled").distinct().filter("__spelled is not null").withColumn("__key", alnum_key(F.col("__spelled")))
    clubs = join_checked(spelled, codes, ["__l", "__key"], "left").select("__l", "__spelled", F.nullif(F.coalesce("__team", "__key"), F.lit("")).alias("club"))
    return join_checked(keyed.drop("club"), stage(clubs), ["__l", "__spelled"], "left").drop("__l", "__spelled")


def merged_labels(df: DataFrame, keys: list[str], labels: str, name: str = "sources", joiner: str = "; ") -> DataFrame:
    """(keys, ``name``): each group's distinct labels, those of cells of highest priority first, then by name.

    A cell may hold several labels (``;`` or ``+``). Distinct labels are made before the shuffle; their number bounds the list.
    """
    cell = F.col(f"`{labels}`")
    each = df.select(*keys, source_priority(cell).alias("__p"), F.explode(F.split(cell, "[;+]")).alias("__l")).withColumn("__l", F.trim("__l")).filter("__l <> ''")
    best = each.groupBy(*keys, "__l").agg(F.max("__p").alias("__p"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("__p")).alias("p"), F.col("__l").alias("l"))))
    return best.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), joiner).alias(name))
