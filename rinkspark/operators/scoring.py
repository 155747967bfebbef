"""Scores as column expressions: evidence weights, production features, projection, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .aggregates import largest
from .ranking import rank_in_group

# Fixed values: (games below, weight); from the last bound on, a base plus a slope over a span of games.
ADULT_STEPS, ADULT_REST = ((1, 0.0), (5, 0.12), (10, 0.32), (16, 0.62)), (0.78, 16, 24, 110.0)
PLAYOFF_STEPS, PLAYOFF_REST = ((1, 0.0), (3, 0.18), (6, 0.42), (10, 0.68)), (0.82, 10, 15, 85.0)
TIERS = ((1, "none"), (5, "exposure"), (10, "small"), (16, "meaningful"))
#: Weight of a league that the dimension lacks.
UNKNOWN_LEAGUE = 0.70


def stepped(games: Column, steps: tuple, rest: tuple) -> Column:
    out = None
    for below, weight in steps:
        out = F.when(games < below, F.lit(weight)) if out is None else out.when(games < below, F.lit(weight))
    base, start, span, slope = rest
    return out.otherwise(F.least(F.lit(1.0), F.lit(base) + F.least(games - start, F.lit(span)) / slope))


def adult_weight(games: Column) -> Column:
    return stepped(games, ADULT_STEPS, ADULT_REST)


def playoff_weight(games: Column) -> Column:
    return stepped(games, PLAYOFF_STEPS, PLAYOFF_REST)


def adult_tier(games: Column) -> Column:
    out = None
    for below, tier in TIERS:
        out = F.when(games < below, F.lit(tier)) if out is None else out.when(games < below, F.lit(tier))
    return out.otherwise(F.lit("strong"))


def role_of(position: Column) -> Column:
    """G goalie, D or anything that ends in HD defense, the rest forward."""
    return F.when(position == "G", "goalie").when((position == "D") | position.endswith("HD"), "defense").otherwise("forward")


def size_score(position: Column, height: Column, weight: Column) -> Column:
    part = lambda h0, hs, hw, w0, ws, ww: clamp((height - h0) / float(hs)) * hw + clamp((weight - w0) / float(ws)) * ww
    return F.when(position == "G", part(180, 20, 0.8, 75, 20, 0.2)).when(position == "D", part(178, 18, 0.7, 72, 22, 0.3)).otherwise(part(172, 18, 0.65, 68, 20, 0.35))


def hand_score(position: Column, hand: Column) -> Column:
    known = hand.isNotNull() & (hand != "")
    return F.when((position == "D") & (hand == "R"), 1.0).when((position == "G") & known, 0.55).when(known, 0.5).otherwise(0.35)


def age_score(age: Column) -> Column:
    return clamp((18.9 - age) / 1.4)


def adjusted_production(lines: DataFrame, positions: DataFrame, leagues: DataFrame) -> DataFrame:
    """Per skater with games: production adjusted for league and stage, and its rank among the role in league and season.

    lines: player_id, season, league, games, points, regular_season, line_id. leagues: league, adult_league,
    league_weight, playoff_weight (a small dimension, unique). Primary line: most games, then the smallest line_id.
    Ties in the rank go to the smaller player_id. Null games count 0; negative games count 0 in the denominator.
    """
    games = F.coalesce("games", F.lit(0))
    weighted = lines.join(F.broadcast(leagues), "league", "left").withColumns({
        "games": games, "points": F.coalesce("points", F.lit(0)), "lw": F.coalesce("league_weight", F.lit(UNKNOWN_LEAGUE)),
        "sw": F.when(~F.col("regular_season"), F.coalesce("playoff_weight", F.lit(1.0))).otherwise(F.lit(1.0)),
    })
    value = F.when(F.col("games") > 0, F.col("points") * F.col("lw") * F.col("sw")).otherwise(F.lit(0.0))
    total = F.sum(F.greatest("games", F.lit(0)))
    primary = [F.col("games"), -F.col("line_id")]
    features = weighted.groupBy("player_id").agg(
        total.alias("games"), F.sum("points").alias("points"), (F.sum(value) / F.nullif(total, F.lit(0))).alias("adjusted_ppg"), F.try_divide(F.sum(F.col("lw") * F.col("games")), total).alias("league_weight"),
        F.coalesce(F.sum(F.when(F.col("adult_league"), F.col("games"))), F.lit(0)).alias("adult_games"), F.coalesce(F.sum(F.when(~F.col("regular_season"), F.col("games"))), F.lit(0)).alias("playoff_games"),
        largest(primary, F.col("league")).alias("league"), largest(primary, F.col("season")).alias("season"),
    )
    roles = positions.select("player_id", role_of(F.col("position")).alias("role_group"))
    skaters = features.filter("games > 0").join(roles, "player_id").filter("role_group <> 'goalie'")
    ranked = rank_in_group(skaters, ["season", "league", "role_group"], "adjusted_ppg", [F.col("player_id")])
    bonus = {"adult_bonus": adult_weight(F.col("adult_games")) * 0.07, "playoff_bonus": playoff_weight(F.col("playoff_games")) * 0.08, "adult_tier": adult_tier(F.col("adult_games"))}
    return ranked.withColumns(bonus).withColumn("adjusted_score", F.col("adjusted_ppg") + F.col("adult_bonus") + F.col("playoff_bonus") + F.col("role_bonus"))


# What a position adds.
POSITION_PREMIUM = {"C": 0.06, "RHD": 0.05, "LHD": 0.02, "G": -0.04, "LW": 0.0, "RW": 0.0}


def projection(rows: DataFrame) -> DataFrame:
    """``rows`` (age, ppg, league_factor, height_cm, position, consensus_rank, games, has_text) with projection columns.

    Missing league factors count 0.9; other missing inputs give no bonus. ``positives`` and ``risks`` are arrays of what drove
    the projection, in a fixed order.
    """
    age = F.greatest(F.lit(0.0), F.coalesce(18.5 - F.col("age"), F.lit(0.0))) * 0.055
    production = F.least(F.lit(1.0), F.coalesce(F.col("ppg"), F.lit(0.0)) * F.coalesce("league_factor", F.lit(0.9)) / 1.25)
    size = F.when((F.col("height_cm") >= 188) & (F.col("position") != "G"), 0.04).otherwise(0.0)
    rank = F.col("consensus_rank")
    consensus = F.greatest(F.lit(0.0), F.coalesce((80 - rank) / 80.0, F.lit(0.0))) * 0.32
    over = lambda n, w: F.greatest(F.lit(0.0), F.coalesce((rank - n).cast("double"), F.lit(0.0))) * w
    position = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in POSITION_PREMIUM.items() for x in pair]), F.col("position")), F.lit(0.0))
    out = rows.withColumn("production", production).withColumn("nhl_probability", clamp(0.14 + 0.38 * F.col("production") + consensus + age + size + position))
    out = out.withColumns({"impact_probability": clamp(0.38 * F.col("nhl_probability") + 0.16 * F.col("production") - over(20, 0.003)), "bust_risk": clamp(1 - F.col("nhl_probability") + over(45, 0.006))})
    value = 7 * F.col("nhl_probability") + 5 * F.col("impact_probability") - 2 * F.col("bust_risk")
    text = F.when(F.coalesce("has_text", F.lit(False)), 0.08).otherwise(0.0)
    tags = lambda *pairs: F.array_compact(F.array(*[F.when(c, tag) for c, tag in pairs]))
    positives = tags((F.col("production") >= 0.65, F.lit("production")), (age > 0.02, F.lit("young")), (position > 0, F.concat(F.lit("position "), F.col("position"))), (size > 0, F.lit("frame")), (rank <= 25, F.lit("consensus")))
    risks = tags((F.col("production") < 0.45, F.lit("production")), (rank > 40, F.lit("consensus")), ((F.col("height_cm") < 180) & (F.col("position") != "G"), F.lit("size")))
    return out.withColumns({"expected_value": value, "confidence": clamp(0.45 + F.least(F.coalesce("games", F.lit(0)), F.lit(60)) / 180.0 + text), "positives": positives, "risks": risks})
