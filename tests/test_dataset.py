import datetime as dt

import pytest
from pyspark.sql import functions as F

from rinkspark.operators import rosters
from rinkspark.plans import dataset


def write(path, name, text):
    (path / f"{name}.csv").write_text(text, encoding="utf-8")


@pytest.fixture()
def folder(tmp_path):
    write(tmp_path, "players", "player_id,name,birth_date,position,height_cm,age_at_draft\np1,Ann,2001-05-14,C,180,18.1\np2,Bo,,D,x,\n")
    write(tmp_path, "draft_selections", "player_id,draft_year,overall_pick\np1,2019,2\np2,2019,\n")
    write(tmp_path, "nhl_outcomes", "player_id,nhl_games,nhl_points\np1,150,101\n")
    write(tmp_path, "rankings", "player_id,source,rank\np1,consensus,7\np1,other,3\np2,other,9\n")
    write(tmp_path, "season_stat_lines", "player_id,season,league,team,games,points,timing,regular_season,goalie_minutes\np1,2018-19,L,T,10,5,pre_draft,true,\np1,2018-19,M,T,12,n/a,pre_draft,no,12:30\np1,2020-21,N,T,50,9,post_draft,true,\n")
    return tmp_path


def test_prospects(spark, folder):
    tables = dataset.load_dataset(spark, str(folder))
    rows = {r.player_id: r for r in dataset.prospects(tables).collect()}
    assert (rows["p1"].consensus_rank, rows["p1"].line_league, rows["p1"].line_points, rows["p1"].is_nhler, rows["p1"].is_impact, rows["p1"].is_bust) == (7, "M", None, True, True, False)
    assert (rows["p2"].consensus_rank, rows["p2"].line_league, rows["p2"].is_nhler, rows["p2"].height_cm, rows["p2"].birth_date) == (9, None, None, None, None)
    assert rows["p1"].birth_date == dt.date(2001, 5, 14)
    nested = {r.player_id: [x.league for x in r.stat_lines] for r in dataset.nested_players(tables["players"], tables["season_stat_lines"], ["season", "league"], ["games"]).collect()}
    assert nested == {"p1": ["L", "M", "N"], "p2": []}
    (folder / "players.csv").unlink()
    with pytest.raises(FileNotFoundError):
        dataset.load_dataset(spark, str(folder))


def test_run_once(spark, tmp_path):
    df, ran = spark.range(3), []
    state = str(tmp_path / "state.json")
    assert dataset.run_once(spark, df, state, lambda: ran.append(1)) and not dataset.run_once(spark, df, state, lambda: ran.append(2))
    assert dataset.run_once(spark, df.union(df), state, lambda: ran.append(3)) and ran == [1, 3]


def test_rosters(spark):
    rows = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1), 5), (2, "a", dt.date(2024, 2, 1), 1), (3, "b", None, 2), (4, "b", None, 9)], "i int, k string, d date, g int")
    assert {(r.i, r.confidence) for r in rosters.latest_assignment(rows, "k", "d", "g", "i").collect()} == {(2, "high"), (4, "low")}
    base = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v int")
    snap = spark.createDataFrame([("y",), ("z",), (None,)], "k string")
    assert {tuple(r) for r in rosters.overlay_snapshot(base, snap, ["k"], ["v"]).collect()} == {("x", 1, "dropped"), ("y", 2, "matched"), ("z", None, "new"), (None, 3, "matched")}
    people = [(1, "ann", "A", dt.date(2000, 1, 1)), (2, "ann", "B", dt.date(2000, 9, 1)), (3, "ann", "C", dt.date(2009, 1, 1)), (4, "ann", "A", dt.date(2000, 1, 1)), (5, None, "A", None)]
    got = rosters.in_several_organizations(spark.createDataFrame(people, "i int, n string, o string, b date"), F.col("n"), "o", "b", "i")
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 2), (4, 1)}
