"""Scores of players from weighted components, and how well an order of players foretold what came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from . import ranking

# Weights of the components.
POSITION_VALUE = {"C": 1.0, "D": 0.88, "RW": 0.72, "LW": 0.7, "F": 0.68, "G": 0.5}
CONTEXTUAL = {"production": 0.36, "consensus": 0.28, "age": 0.10, "size": 0.08, "hand": 0.05, "position_value": 0.05, "sample": 0.08}
ROLE_AWARE = {
    "forward": {"production": 0.40, "consensus": 0.24, "age": 0.10, "sample": 0.12, "several": 0.07, "size": 0.07, "hand": 0.03, "position_value": 0.03},
    "defense": {"production": 0.28, "consensus": 0.26, "age": 0.08, "sample": 0.11, "several": 0.05, "size": 0.15, "hand": 0.07, "position_value": 0.05},
    "goalie": {"consensus": 0.42, "size": 0.18, "sample": 0.12, "several": 0.10, "age": 0.08, "slot": 0.06, "hand": 0.04},
}
HYBRID = {
    "forward": {"consensus": 0.34, "production": 0.26, "contextual": 0.22, "several": 0.10, "sample": 0.08},
    "defense": {"consensus": 0.30, "production": 0.20, "contextual": 0.25, "size": 0.10, "hand": 0.07, "sample": 0.08},
    "goalie": {"consensus": 0.45, "role_aware": 0.35, "sample": 0.10, "several": 0.10},
}


def weighted(weights: dict[str, float]) -> Column:
    """Weighted sum of columns, 0 to 1; missing components count 0."""
    return clamp(sum(F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()))


def by_role(weights: dict[str, dict[str, float]]) -> Column:
    return F.when(F.col("role_group") == "forward", weighted(weights["forward"])).when(F.col("role_group") == "defense", weighted(weights["defense"])).otherwise(weighted(weights["goalie"]))


def baseline_scores(features: DataFrame) -> DataFrame:
    """``features`` (see features.feature_table; ``slot`` optional) with contextual, role_aware and role_specific_hybrid scores."""
    games, rows = F.col("total_games"), F.col("pre_draft_row_count")
    several = clamp(0.35 + F.least(games, F.lit(80)) / 200.0 + F.least(F.col("pre_draft_league_count"), F.lit(3)) * 0.08 + F.col("playoff_row_count") * 0.06)
    value = F.create_map(*[F.lit(x) for pair in POSITION_VALUE.items() for x in pair])
    parts = {
        "production": F.col("adjusted_production_score"), "consensus": F.col("consensus_score"), "age": F.col("age_score"), "size": F.col("size_score"), "hand": F.col("handedness_score"),
        "position_value": F.coalesce(F.try_element_at(value, F.col("position")), F.lit(0.65)), "several": F.when(rows <= 1, 0.35).otherwise(several),
        "sample": clamp(clamp(games / 55.0) * 0.8 + F.col("adult_evidence_weight") * 0.12 + F.col("playoff_evidence_weight") * 0.08),
        "slot": F.col("slot") if "slot" in features.columns else F.lit(0.0),
    }
    out = features.withColumns(parts).withColumn("contextual", weighted(CONTEXTUAL)).withColumn("role_aware", by_role(ROLE_AWARE))
    return out.withColumn("role_specific_hybrid", by_role(HYBRID))


def board_lift(df: DataFrame, score: str, tie: str, tops: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """Per top N by ``score`` (a report): outcome means of the first N and their lift over all rows of ``df``.

    ``df`` has games, points and the labels is_nhler, is_impact, is_bust. Ties go to the smaller ``tie``.
    """
    every = df.agg(F.avg("games").alias("__g"), F.avg("points").alias("__p"))  # one row
    best = df.orderBy(F.col(score).desc(), tie).limit(max(tops))
    placed = best.withColumn("__n", F.row_number().over(Window.partitionBy().orderBy(F.col(score).desc(), tie)))  # at most the largest N rows
    each = placed.withColumn("top_n", F.explode(F.array(*[F.lit(t) for t in tops]))).filter("__n <= top_n")
    sums = each.groupBy("top_n").agg(F.count("*").alias("players"), F.avg("games").alias("avg_games"), F.avg("points").alias("avg_points"), *[F.count_if(c).alias(n) for c, n in (("is_nhler", "nhlers"), ("is_impact", "impacts"), ("is_bust", "busts"))])
    lift = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0))), F.lit(0.0))
    return sums.join(F.broadcast(every)).withColumns({"games_lift": lift("avg_games", "__g"), "points_lift": lift("avg_points", "__p")}).drop("__g", "__p")


def binary_targets(df: DataFrame, score: str, tie: str, n: int = 10) -> DataFrame:
    """Per target: count, positive rate, Brier score and precision among the first ``n`` (busts by the score turned round)."""
    out = None
    for target, column, turned in (("nhler", "is_nhler", False), ("impact", "is_impact", False), ("bust", "is_bust", True)):
        rows = df.withColumn("__s", 1 - F.col(score) if turned else F.col(score)).withColumn("__y", F.col(column))
        sums = rows.agg(F.lit(target).alias("target"), F.count("*").alias("players"), F.avg(F.col("__y").cast("double")).alias("positive_rate"), F.avg(F.pow(F.col("__y").cast("double") - F.col("__s"), F.lit(2.0))).alias("brier"))
        one = sums.join(F.broadcast(ranking.precision_at(rows, "__y", "__s", [F.col(tie)], n).select("precision")))  # one row each
        out = one if out is None else out.unionByName(one)
    return out
