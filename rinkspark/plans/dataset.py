"""A dataset directory of one class: typed tables, their joins into one row a player, and incremental runs."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources.sinks import recover_directory, replace_directory
from ..sources.tables import read_csv_table

# Tables of a dataset, whether it needs them, and their columns.
TABLES = {
    "players": (True, "player_id name birth_date nationality position handedness height_cm weight_kg age_at_draft source source_id source_url"),
    "draft_selections": (True, "player_id draft_year team_id team_name round_number overall_pick drafted_from_team drafted_from_league source source_id source_url"),
    "nhl_outcomes": (True, "player_id nhl_games nhl_goals nhl_assists nhl_points seasons_played last_season value_proxy source source_id source_url"),
    "rankings": (False, "player_id draft_year source rank scope position source_id source_url"),
    "season_stat_lines": (False, "player_id season league team games goals assists points age timing regular_season source source_id source_url goalie_minutes shots_against saves goals_against save_percentage goals_against_average wins losses ties shutouts"),
    "advanced_stat_lines": (False, "player_id season league team timing regular_season games plus_minus shots blocks faceoff_wins faceoff_losses faceoff_percentage source source_id source_url"),
}
WHOLE = set("height_cm weight_kg draft_year round_number overall_pick nhl_games nhl_goals nhl_assists nhl_points seasons_played rank games goals assists points shots_against saves goals_against wins losses ties shutouts plus_minus shots blocks faceoff_wins faceoff_losses".split())
REAL = set("age_at_draft value_proxy age save_percentage goals_against_average faceoff_percentage".split())


def typed(name: str) -> Column:
    c = F.col(f"`{name}`")
    if name in WHOLE:
        return fn.whole_strict(c).cast("int").alias(name)
    if name in REAL:
        return fn.cell(c).try_cast("double").alias(name)
    if name == "birth_date":
        return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date").alias(name)
    if name == "regular_season":
        return F.when(c.isNull(), True).otherwise(fn.flag(c)).alias(name)
    if name == "goalie_minutes":
        return fn.minutes(c).alias(name)
    return c.alias(name)


def load_dataset(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The typed tables of ``directory``; a required one that is missing raises, an optional one is empty."""
    out = {}
    for name, (required, columns) in TABLES.items():
        raw = read_csv_table(spark, os.path.join(directory, f"{name}.csv"), columns.split(), required)
        out[name] = raw.select(*[typed(c) for c in columns.split()])
    return out


def consensus_rank(selections: DataFrame, rankings: DataFrame) -> DataFrame:
    """(player_id, consensus_rank): the consensus source's rank, else the best rank, else the overall pick."""
    ranks = rankings.groupBy("player_id").agg(F.min(F.when(F.lower("source") == "consensus", F.col("rank"))).alias("said"), F.min("rank").alias("best"))
    return selections.select("player_id", "overall_pick").join(ranks, "player_id", "left").select("player_id", F.coalesce("said", "best", "overall_pick").alias("consensus_rank"))


def outcome_labels(outcomes: DataFrame) -> DataFrame:
    """Regular, impact and bust labels; null without an outcome."""
    games, points = F.col("nhl_games"), F.coalesce("nhl_points", F.lit(0))
    return outcomes.withColumns({"is_nhler": games >= 100, "is_impact": (games >= 200) | (points >= 100), "is_bust": games < 50})


def nested_players(players: DataFrame, lines: DataFrame, sort: list[str], fields: list[str]) -> DataFrame:
    """``players`` with ``stat_lines``, the array of their lines' ``fields`` in order of ``sort`` (empty without lines).

    A player's lines are few by nature; the array holds one player's only.
    """
    one = F.struct(*[F.col(c) for c in dict.fromkeys([*sort, *fields])])
    arrays = lines.groupBy("player_id").agg(F.array_sort(F.collect_list(one)).alias("stat_lines"))
    empty = F.array().cast(arrays.schema["stat_lines"].dataType)
    return players.join(arrays, "player_id", "left").withColumn("stat_lines", F.coalesce("stat_lines", empty))


def prospects(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a selected player, by overall pick (missing last): bio, pick, rank, primary line, outcome labels.

    The primary line is the pre-draft line with the most games, of equals the first by season, league and team.
    """
    lines = tables["season_stat_lines"].filter("timing = 'pre_draft'")
    first = Window.partitionBy("player_id").orderBy(F.col("games").desc_nulls_last(), "season", "league", "team")
    primary = lines.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("player_id", *[F.col(c).alias(f"line_{c}") for c in ("season", "league", "team", "games", "points")])
    picks = tables["draft_selections"].select("player_id", "draft_year", "team_id", "round_number", "overall_pick", "drafted_from_league", "drafted_from_team")
    outcomes = outcome_labels(tables["nhl_outcomes"]).select("player_id", "nhl_games", "nhl_points", "is_nhler", "is_impact", "is_bust")
    out = tables["players"].drop("source", "source_id", "source_url").join(picks, "player_id").join(consensus_rank(tables["draft_selections"], tables["rankings"]), "player_id").join(primary, "player_id", "left").join(outcomes, "player_id", "left")
    return out.withColumn("order_pick", F.coalesce("overall_pick", F.lit(9999))).orderBy("order_pick", "player_id")


def run_once(spark: SparkSession, inputs: DataFrame, state: str, job) -> bool:
    """Run ``job()`` unless ``state`` (a path on any file system that Hadoop knows) records the same fingerprint of ``inputs``.

    The state is written after the job, so a run that failed runs again. Returns whether it ran.
    """
    from ..operators.audit import fingerprint

    now = fingerprint(inputs).first().asDict()
    if recover_directory(spark, state) and json.loads(spark.read.text(state).first().value) == now:
        return False
    job()
    spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{state}.new")
    replace_directory(spark, f"{state}.new", state)
    return True
