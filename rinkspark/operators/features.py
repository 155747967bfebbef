"""The feature table: one row a player from the lines before the draft, with goalie and advanced measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, logistic
from ..plans.runtime import join_checked
from . import aggregates as agg
from . import scoring


def line_features(lines: DataFrame, leagues: DataFrame) -> DataFrame:
    """Per player of ``lines`` (player_id, line_id, season, league, games, points, regular_season): rows, leagues, sums, shares.

    ``leagues`` (league, league_family, competition_level, adult_league, league_weight) is unique by league; a league that it
    lacks has weight 0.7 and no level. A share is of the games; of a player without games it is of the lines. The primary line
    has the most games, of equals the smallest line_id.
    """
    known = join_checked(lines, leagues, "league", "left")
    g = F.coalesce("games", F.lit(0))
    weight = F.coalesce("league_weight", F.lit(scoring.UNKNOWN_LEAGUE))
    adult = F.coalesce("adult_league", F.lit(False))
    junior = F.coalesce(F.col("competition_level").isin("junior", "junior_a"), F.lit(False))
    college = ~junior & F.coalesce(F.col("league_family") == "College", F.lit(False))
    playoff = ~F.coalesce("regular_season", F.lit(True))
    order = [g, -F.col("line_id")]

    def share(condition: Column) -> Column:
        of_games = F.try_divide(F.sum(F.when(condition, g).otherwise(0)).cast("double"), F.sum(g))
        return F.coalesce(of_games, F.try_divide(F.count_if(condition).cast("double"), F.count("*")))

    return known.groupBy("player_id").agg(
        F.count("*").alias("pre_draft_row_count"), F.count_distinct("league").alias("pre_draft_league_count"), F.sum(g).alias("total_games"), F.sum(F.coalesce("points", F.lit(0))).alias("total_points"),
        F.coalesce(F.try_divide(F.sum(F.coalesce("points", F.lit(0))).cast("double"), F.sum(g)), F.lit(0.0)).alias("points_per_game"),
        F.sum(F.when(playoff, 0).otherwise(g)).alias("regular_season_games"), F.sum(F.when(playoff, g).otherwise(0)).alias("playoff_games"), F.count_if(playoff).alias("playoff_row_count"),
        F.sum(F.when(adult, g).otherwise(0)).alias("adult_games"), share(adult).alias("adult_game_share"), share(junior).alias("junior_game_share"), share(college).alias("college_game_share"),
        F.coalesce(F.try_divide(F.sum(F.when(playoff, g).otherwise(0)).cast("double"), F.sum(g)), F.lit(0.0)).alias("playoff_game_share"),
        F.coalesce(F.try_divide(F.sum(g * weight), F.sum(g)), F.avg(weight)).alias("average_league_weight"),
        agg.largest(order, F.col("league")).alias("primary_league"), agg.largest(order, F.col("league_family")).alias("primary_league_family"), agg.largest(order, F.col("competition_level")).alias("primary_competition_level"),
    )


def advanced_metrics(sums: DataFrame, role: Column) -> DataFrame:
    """``sums`` (games, plus_minus, shots, blocks, faceoff_wins, faceoff_losses) with rates, sample weight and role score."""
    rate = lambda c, by: F.coalesce(F.try_divide(F.col(c).cast("double"), by), F.lit(0.0))
    taken = F.col("faceoff_wins") + F.col("faceoff_losses")
    out = sums.withColumns({
        "sample_weight": F.when(F.col("games") > 0, F.least(F.col("games") / 20.0, F.lit(1.0))).otherwise(0.0),
        "plus_minus_per_game": rate("plus_minus", F.col("games")), "shots_per_game": rate("shots", F.col("games")), "blocks_per_game": rate("blocks", F.col("games")), "faceoff_percentage": rate("faceoff_wins", taken),
    })
    plus, shots, blocks = logistic(F.col("plus_minus_per_game") * 2), clamp(F.col("shots_per_game") / 4), clamp(F.col("blocks_per_game") / 2)
    faceoffs = F.when(taken > 0, clamp((F.col("faceoff_percentage") - 0.35) / 0.30)).otherwise(0.0)
    score = F.when(role == "defense", 0.35 * plus + 0.25 * shots + 0.40 * blocks).when(role == "forward", 0.20 * plus + 0.50 * shots + 0.30 * faceoffs).otherwise(0.0)
    return out.withColumn("advanced_role_score", score * F.col("sample_weight"))


def consensus_score(rank: Column, ceiling: Column) -> Column:
    """1 for the first rank down to 0 for ``ceiling``; null without a rank."""
    return F.when(ceiling <= 1, 1.0).otherwise(clamp(1 - (rank - 1) / (ceiling - 1).cast("double")))


def feature_table(people: DataFrame, lines: DataFrame, leagues: DataFrame, adjusted: DataFrame) -> DataFrame:
    """One row a player of ``people`` (unique player_id, position, handedness, height_cm, weight_kg, age_at_draft, consensus_rank).

    ``lines`` are those before the draft with goalie columns and ``minutes``; ``adjusted`` is scoring.adjusted_production's
    result. Sums and shares of a player without lines are 0, scores of one without adjusted production too.
    """
    goalies = agg.goalie_metrics(lines, ["player_id"])
    goalies = goalies.select("player_id", *[F.col(c).alias(f"goalie_{c}") for c in goalies.columns if c != "player_id"])
    scored = adjusted.select("player_id", "adjusted_ppg", "role_percentile", "adjusted_score", "adult_tier")
    tops = people.agg(F.max("consensus_rank").alias("__ranks")).crossJoin(scored.agg(F.max("adjusted_score").alias("__top")))  # one row
    out = people.join(line_features(lines, leagues), "player_id", "left").join(goalies, "player_id", "left").join(scored, "player_id", "left").join(F.broadcast(tops))
    role = scoring.role_of(F.col("position"))
    out = out.withColumns({
        "role_group": role, "consensus_score": consensus_score(F.col("consensus_rank"), F.col("__ranks")),
        "adjusted_production_score": F.when(F.col("__top") > 0, clamp(F.coalesce("adjusted_score", F.lit(0.0)) / F.col("__top"))).otherwise(0.0),
        "adult_evidence_weight": F.when(F.col("adjusted_score").isNotNull(), scoring.adult_weight(F.col("adult_games"))).otherwise(0.0),
        "playoff_evidence_weight": F.when(F.col("adjusted_score").isNotNull(), scoring.playoff_weight(F.col("playoff_games"))).otherwise(0.0),
        "adult_sample_tier": F.coalesce("adult_tier", F.when(F.col("adult_games") > 0, "exposure").otherwise("none")),
        "size_score": scoring.size_score(F.col("position"), F.col("height_cm"), F.col("weight_kg")), "handedness_score": scoring.hand_score(F.col("position"), F.col("handedness")), "age_score": scoring.age_score(F.col("age_at_draft")),
    })
    numbers = [n for n, k in out.dtypes if k in ("bigint", "double", "int") and n not in ("height_cm", "weight_kg", "age_at_draft", "consensus_rank", "consensus_score", "size_score", "age_score")]
    return out.drop("__ranks", "__top", "adult_tier").fillna(0, [n for n in numbers if not n.startswith("__")])
