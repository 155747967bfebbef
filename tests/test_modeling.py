"""Known values of features, ranks over range partitions, enrichment, and tables that must not be lost."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from rinkspark.functions import scalars as fn
from rinkspark.operators import aggregates as agg
from rinkspark.operators import baselines, enrichment, features, ranking, scoring
from rinkspark.plans import ranks
from rinkspark.plans.runtime import join_spread
from rinkspark.sources import sinks, tables

LEAGUES = [("NCAA", "College", "college", False, 1.12), ("Liiga", "Pro", "pro", True, 1.2)]


def test_shares_and_tier(spark):
    leagues = spark.createDataFrame(LEAGUES, "league string, league_family string, competition_level string, adult_league boolean, league_weight double")
    lines = [("a", 1, "NCAA", 20, 10, True), ("a", 2, "NCAA", 4, 1, True), ("a", 3, "Liiga", 10, 2, True), ("z", 4, "Liiga", 0, 0, True), ("n", 5, "Elsewhere", None, None, None)]
    rows = {r.player_id: r for r in features.line_features(spark.createDataFrame(lines, "player_id string, line_id bigint, league string, games int, points int, regular_season boolean"), leagues).collect()}
    assert (round(rows["a"].college_game_share, 6), round(rows["a"].adult_game_share, 6)) == (0.705882, 0.294118)
    assert (rows["z"].adult_game_share, rows["z"].average_league_weight, rows["n"].average_league_weight, rows["n"].total_games) == (1.0, 1.2, 0.7, 0)
    r = spark.range(1).select(scoring.adult_tier(F.lit(10)).alias("t"), scoring.adult_weight(F.lit(10)).alias("w")).first()
    assert (r.t, r.w) == ("meaningful", 0.62)


def test_goalie_and_advanced_values(spark):
    line = spark.createDataFrame([("g", 47, 2705.0, 1665, 1514, 151, None, None, 1)], "p string, games int, minutes double, shots_against int, saves int, goals_against int, save_percentage double, goals_against_average double, shutouts int")
    r = agg.goalie_metrics(line, ["p"]).first()
    assert (round(r.save_percentage, 6), round(r.goals_against_average, 6)) == (0.909309, 3.349353)
    sums = spark.createDataFrame([(10, 5, 20, 15, 0, 0), (0, 0, 0, 0, 0, 0)], "games int, plus_minus int, shots int, blocks int, faceoff_wins int, faceoff_losses int")
    a, b = features.advanced_metrics(sums, F.lit("defense")).orderBy(F.desc("games")).collect()
    assert (a.plus_minus_per_game, a.shots_per_game, a.blocks_per_game, a.sample_weight, b.advanced_role_score) == (0.5, 2.0, 1.5, 0.5, 0.0)


def test_blend_needs_every_score(spark):
    df = spark.createDataFrame([("p1", 1.0, 0.0), ("p2", 0.0, 1.0), ("p3", 1.0, None)], "p string, a double, b double")
    assert [r.s for r in df.orderBy("p").select(ranking.blended({"a": 0.75, "b": 0.25}).alias("s")).collect()] == [0.75, 0.25, None]


def test_lift_report(spark):
    df = spark.createDataFrame([(f"p{i:02}", 1 - i / 40, 400 - 10 * i, i) for i in range(40)], "p string, score double, games int, points int").withColumns({"is_nhler": F.col("games") >= 100, "is_impact": F.col("games") >= 200, "is_bust": F.col("games") < 50})
    r = {x.top_n: x for x in baselines.board_lift(df, "score", "p").collect()}
    assert (r[10].players, r[50].players, r[10].nhlers, r[50].games_lift) == (10, 40, 10, 1.0) and r[10].games_lift > 1.7
    assert baselines.board_lift(df.limit(0), "score", "p").count() == 0


def test_places_of_a_group_that_fills_many_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").withColumn("n", F.lit(7))
    got = {r.i: (r.place, r.n) for r in ranks.places(df, ["g"], [F.col("v").desc(), F.col("i")], "place", "n").collect()}
    for g in ("hot", "a", "b", None):
        own = sorted((-v, i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    assert ranks.places(df.limit(0), ["g"], [F.col("i")], "place").count() == 0


def test_hot_keys_are_spread(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    right = spark.createDataFrame([(k, k * 2) for k in ["hot", "k0", "k3", "other"]], "k string, w string")
    got = sorted((r.k, r.i, r.w) for r in join_spread(left, right, "k", 7).collect())
    assert got == sorted((k, i, k * 2) for k, i in [("hot" if i % 3 else f"k{i}", i) for i in range(300)] if k in ("hot", "k0", "k3"))


def test_every_letter_is_transliterated(spark):
    text = "Рыбаков Ольга Эрн Ёж объём Щукин Юрьев"
    assert spark.range(1).select(fn.transliterate(F.lit(text)).alias("t")).first().t == "rybakov olga ern yozh obyom shchukin yurev"
    r = spark.range(1).select(*[fn.transliterate(F.lit(c)).alias(c) for c in fn.CYRILLIC]).first().asDict()
    assert r == fn.CYRILLIC


def test_enrichment_dispositions(spark):
    players = spark.createDataFrame([("1", "Ann Lee"), ("2", "Bo Ek"), ("3", "Bo Ek"), ("4", "Cy Moss"), ("5", "Dee Fox"), ("6", None)], "player_id string, name string")
    eligible = spark.createDataFrame([(p, "L") for p in "12346"], "player_id string, league string")
    feed = spark.createDataFrame([(1, "ann lee", "L", "s1", 5, "x"), (2, "Ann Lee", "L", "s1", 9, "x"), (3, "Bo Ek", "L", "s1", 5, "y"), (4, "Cy Moss", "M", "s1", 5, "z"), (5, None, "L", "s1", 5, "n")], "row_no bigint, name string, league string, season string, games int, source_id string")
    matched, report = enrichment.enrich(players, eligible, feed, [("exact", fn.person_key)], "row_no", "source_id", ["season", "league"], [F.col("games").desc()])
    assert [(r.player_id, r.row_no) for r in matched.collect()] == [("1", 2)]
    assert {r.player_id: r.disposition for r in report.collect()} == {"1": "matched", "2": "ambiguous_identity", "3": "ambiguous_identity", "4": "unmatched_in_source", "5": "not_eligible", "6": "unmatched_in_source"}


def test_paths_with_a_scheme_are_found(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\n")
    for where in (str(path), f"file:{path}", f"file://{path}"):
        assert tables.read_csv_table(spark, where, ["a", "c"], required=False).count() == 1
    assert tables.read_csv_table(spark, f"file://{tmp_path}/none.csv", ["a"], required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_csv_table(spark, f"file://{tmp_path}/none.csv", ["a"])


def test_replacement_that_stopped_between_its_moves(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(target)
    os.rename(tmp_path / "t", tmp_path / "t.old")  # stopped here: moved aside, nothing in place
    assert sinks.recover_directory(spark, target) and spark.read.parquet(target).count() == 3
    spark.range(5).write.parquet(f"{target}.new")
    os.rename(tmp_path / "t", tmp_path / "t.old")
    sinks.replace_directory(spark, f"{target}.new", target)
    assert spark.read.parquet(target).count() == 5 and not os.path.exists(tmp_path / "t.old")
    assert not sinks.recover_directory(spark, f"file://{tmp_path}/nothing")
