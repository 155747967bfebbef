"""Queries of features, baselines, enrichment, depth and audits over the prospect tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import leagues as lg
from ..functions import scalars as fn
from ..functions.text import alnum_key
from ..operators import aggregates as agg
from ..operators import audit, baselines, enrichment, features, ranking, reconcile, scoring
from ..sources.tables import table
from . import prospects as pr
from .prospects import _q, _r

# Family and level of these tables' leagues.
LEVELS = (("NKL", "Pro", "pro"), ("VKL", "Pro", "pro"), ("MKL", "Junior", "junior"), ("Alpenliga", "Pro", "pro"), ("Suurliiga U20", "Junior", "junior"), ("Ostland Juniorliga", "Junior", "junior"), ("Prairie Junior League", "Junior", "junior_a"), ("Coastal College Conf.", "College", "college"))
_LEVEL_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LEVELS) + ") AS lv(league, league_family, competition_level)"


def league_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEVELS), "league string, league_family string, competition_level string").join(pr.leagues(spark), "league")


def _people(spark: SparkSession, d: str) -> DataFrame:
    best = reconcile.keep_first(table(spark, d, "board"), ["player_id"], [F.col("loaded_at").desc(), F.col("board_row_id").desc()])
    return table(spark, d, "players").select("player_id", "position", "handedness", "height_cm", "weight_kg", "age_at_draft").join(best.select("player_id", "consensus_rank"), "player_id")


def _features(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "season_stat_lines").filter("timing = 'pre_draft'").withColumn("minutes", fn.minutes(F.col("goalie_minutes")))
    return features.feature_table(_people(spark, d), lines, league_levels(spark), pr.adjusted_production(spark, d))


WHOLE = ("pre_draft_row_count", "pre_draft_league_count", "total_games", "total_points", "regular_season_games", "playoff_games", "playoff_row_count", "adult_games", "goalie_games", "goalie_shots_against", "goalie_saves", "goalie_shutouts")
REAL = ("points_per_game", "adult_game_share", "junior_game_share", "college_game_share", "playoff_game_share", "average_league_weight", "consensus_score", "adjusted_production_score", "adult_evidence_weight", "playoff_evidence_weight", "handedness_score", "size_score", "age_score", "goalie_save_percentage", "goalie_quality_score")
TEXT = ("player_id", "role_group", "primary_league", "primary_league_family", "primary_competition_level", "adult_sample_tier")


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """One row a listed player, all features of the lines before the draft."""
    return _features(spark, d).select(*TEXT, *WHOLE, *[_r(c, 5) for c in REAL])


def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    out = baselines.baseline_scores(_features(spark, d))
    return out.select("player_id", *[_r(c, 4) for c in ("contextual", "role_aware", "role_specific_hybrid")])


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Score of the feature table's consensus, and games and points in adult leagues after the draft as outcome."""
    later = table(spark, d, "season_stat_lines").filter("timing <> 'pre_draft'").join(F.broadcast(pr.leagues(spark).filter("adult_league").select("league")), "league")
    sums = later.groupBy("player_id").agg(F.coalesce(F.sum("games"), F.lit(0)).alias("games"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"))
    people = _people(spark, d).filter("consensus_rank is not null")
    top = people.agg(F.max("consensus_rank").alias("m"))  # one row
    scored = people.join(F.broadcast(top)).select("player_id", features.consensus_score(F.col("consensus_rank"), F.col("m")).alias("score"))
    games, points = F.col("games"), F.col("points")
    return scored.join(sums, "player_id").withColumns({"is_nhler": games >= 100, "is_impact": (games >= 200) | (points >= 100), "is_bust": games < 50})


def board_lift(spark: SparkSession, d: str) -> DataFrame:
    out = baselines.board_lift(_judged(spark, d), "score", "player_id")
    return out.select("top_n", "players", "nhlers", "impacts", "busts", *[_r(c) for c in ("avg_games", "avg_points", "games_lift", "points_lift")])


def outcome_targets(spark: SparkSession, d: str) -> DataFrame:
    out = baselines.binary_targets(_judged(spark, d), "score", "player_id")
    return out.select("target", "players", *[_r(c) for c in ("positive_rate", "brier", "precision")])


def outcome_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.spearman(_judged(spark, d), "games", "score").select(_q(F.col("spearman")).alias("spearman"))


FEED_SCOPE = ["season", "league", "regular_season"]


def _enriched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "russian_open_stats_2024")
    feed = rows.select("row_no", "name", "season", "league", "team", fn.flag(F.col("regular_season")).alias("regular_season"), *[fn.whole_strict(F.col(c)).alias(c) for c in ("games", "goals", "assists", "points")], "source", "source_id", "loaded_at")
    eligible = table(spark, d, "season_stat_lines").select("player_id", "league")
    keys = [("exact", fn.person_key), ("initial", fn.initial_surname_key)]
    best = [F.col("games").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), F.col("row_no")]
    return enrichment.enrich(table(spark, d, "players").select("player_id", "name"), eligible, feed, keys, "row_no", "source_id", FEED_SCOPE, best)


def feed_matches(spark: SparkSession, d: str) -> DataFrame:
    """What became of every player in the open statistics."""
    return _enriched(spark, d)[1]


def feed_dispositions(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d)[1].groupBy("disposition").agg(F.count("*").alias("players"), F.sum("lines").alias("lines"))


def enriched_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines before the draft with the open statistics' lines in place of those of the same player, season, league and stage."""
    columns = ["player_id", "season", "league", "team", "regular_season", "games", "goals", "assists", "points", "source"]
    base = table(spark, d, "season_stat_lines").filter("timing = 'pre_draft'").select(*[F.col(c).cast("bigint").alias(c) if c in columns[5:9] else F.col(c) for c in columns])
    return enrichment.replaced_lines(base, _enriched(spark, d)[0].select(*columns), FEED_SCOPE)


def league_names(spark: SparkSession, d: str) -> DataFrame:
    """Every league written in three tables, and some other names, with the usual name."""
    written = table(spark, d, "season_stat_lines").select("league").unionByName(table(spark, d, "russian_open_stats_2024").select("league")).unionByName(table(spark, d, "board").select(F.col("primary_league").alias("league")))
    others = spark.createDataFrame([(n,) for n in (" swe-jr. ", "BIG  TEN", "u20  SM-sarja", "Hockey East", "", "nla", "Somewhere")], "league string")
    return written.distinct().unionByName(others).distinct().select("league", lg.league_name(F.col("league")).alias("league_name"))


def depth_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per club, league and role of the players' latest lines: numbers, means and the five best scorers."""
    lines = reconcile.keep_first(table(spark, d, "season_stat_lines"), ["player_id"], [F.col("season").desc(), F.col("games").desc_nulls_last(), F.col("line_id")])
    lines = reconcile.with_club(lines, table(spark, d, "team_aliases")).join(table(spark, d, "players").select("player_id", "name", "position"), "player_id")
    rows = lines.select("club", "league", scoring.role_of(F.col("position")).alias("role"), "player_id", "name", "age", F.coalesce("games", F.lit(0)).alias("games"), F.try_divide(F.coalesce("points", F.lit(0)).cast("double"), F.col("games")).alias("ppg"), "save_percentage")
    keys = ["club", "league", "role"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("players"), F.avg(F.when(F.col("age") > 0, F.col("age"))).alias("avg_age"), F.avg(F.when(F.col("games") > 0, F.col("ppg"))).alias("avg_ppg"), agg.mean_at_least_one(F.when(F.col("save_percentage") > 0, F.col("save_percentage")), F.col("games")).alias("avg_save"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ppg").desc_nulls_last(), "player_id"))
    best = rows.withColumn("n", place).filter("n <= 5").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), "; ").alias("examples"))  # five at most
    joined = sums.join(best.select(*[F.col(k).alias(f"b_{k}") for k in keys], "examples"), [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys])
    return joined.select(*keys, "players", _q(F.col("avg_age"), 4).alias("avg_age"), _q(F.col("avg_ppg"), 5).alias("avg_ppg"), _q(F.col("avg_save"), 5).alias("avg_save"), "examples")


def player_flags(spark: SparkSession, d: str) -> DataFrame:
    """Warnings about each player's lines."""
    lines = table(spark, d, "season_stat_lines").withColumn("minutes", fn.minutes(F.col("goalie_minutes")))
    sums = lines.groupBy("player_id").agg(F.count("*").alias("lines"), F.coalesce(F.sum("games"), F.lit(0)).alias("games"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.count_distinct(F.nullif(F.trim("league"), F.lit(""))).alias("leagues"))
    goalies = agg.goalie_metrics(lines, ["player_id"]).select("player_id", F.col("games").alias("g"), "save_percentage", "goals_against_average")
    rows = table(spark, d, "players").select("player_id", scoring.role_of(F.col("position")).alias("role")).join(sums, "player_id", "left").join(goalies, "player_id", "left").fillna(0)
    flag = lambda c, name: F.when(c, F.lit(name))
    goalie = F.col("role") == "goalie"
    flags = [flag(F.col("lines") == 0, "missing_stat_lines"), flag((F.col("games") != 0) & (F.col("lines") == 1), "low_evidence_single_line"), flag(goalie & (F.col("g") < 10), "goalie_short_sample"), flag(goalie & ((F.col("save_percentage") == 0) | (F.col("goals_against_average") == 0)), "goalie_missing_rates"), flag(~goalie & (F.col("games") != 0) & (F.col("points") == 0), "skater_missing_points"), flag(F.col("leagues") >= 3, "multi_league_profile")]
    return rows.select("player_id", F.concat_ws(";", *flags).alias("flags"))


def stat_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Per league, season and source: lines, players, lines with any statistic and with any of a goalie."""
    any_of = lambda *cs: F.coalesce(*[F.col(c).cast("string") for c in cs]).isNotNull()
    out = table(spark, d, "season_stat_lines").groupBy("league", "season", "source")
    return out.agg(F.count("*").alias("lines"), F.count_distinct("player_id").alias("players"), F.count_if(any_of("games", "goals", "assists", "points")).alias("with_statistics"), F.count_if(any_of("goalie_minutes", "saves", "goals_against", "save_percentage", "goals_against_average", "wins", "losses", "ties", "shutouts")).alias("with_goalie_statistics"))


def evidence_depth(spark: SparkSession, d: str) -> DataFrame:
    """How much stands behind each listed player, and how soon a gap should be closed."""
    f = features.line_features(table(spark, d, "season_stat_lines").filter("timing = 'pre_draft'"), league_levels(spark)).select("player_id", "pre_draft_row_count", "pre_draft_league_count")
    rows = _people(spark, d).select("player_id", "consensus_rank").join(f, "player_id", "left").fillna(0, ["pre_draft_row_count", "pre_draft_league_count"])
    return rows.select("player_id", audit.evidence_depth(F.col("pre_draft_row_count"), F.col("pre_draft_league_count")).alias("evidence_depth"), audit.pick_priority(F.col("consensus_rank")).alias("priority"))


def board_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of each board by the share of its rows that have evidence."""
    rows = reconcile.keep_first(table(spark, d, "board"), ["board_id", "player_id"], [F.col("loaded_at").desc(), F.col("board_row_id").desc()])
    joined = rows.select("board_id", "player_id").join(evidence_depth(spark, d).select("player_id", "evidence_depth"), "player_id")
    share = F.avg(F.col("evidence_depth").isin("high", "medium").cast("int"))
    return joined.groupBy("board_id").agg(F.count("*").alias("players"), audit.dataset_status(share).alias("status"))


def pre_draft_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the season before each player's class: those of the listed league if there are any, else all, most games first."""
    listed = reconcile.keep_first(table(spark, d, "board"), ["player_id"], [F.col("loaded_at").desc(), F.col("board_row_id").desc()]).select("player_id", "primary_league")
    year = F.substring_index("player_id", "-", 1).try_cast("int")
    lines = table(spark, d, "season_stat_lines").filter(F.col("season") == fn.season_before(year)).join(listed, "player_id", "left")
    tier = F.when(F.col("league") == F.col("primary_league"), 1).otherwise(2)
    best = lines.withColumn("tier", tier).withColumn("first", F.min("tier").over(Window.partitionBy("player_id"))).filter("tier = first")  # a player's few lines
    place = F.row_number().over(Window.partitionBy("player_id").orderBy(F.coalesce("games", F.lit(0)).desc(), "line_id"))
    return best.select("player_id", "line_id", "league", place.alias("place"))


def season_ages(spark: SparkSession, d: str) -> DataFrame:
    """Age at each line's season's end (1 June)."""
    lines = table(spark, d, "season_stat_lines").select("line_id", "player_id", "season").join(table(spark, d, "players").select("player_id", "birth_date"), "player_id")
    return lines.select("line_id", fn.age_at(fn.season_end(F.col("season")), F.col("birth_date"), 1).alias("age"))


def projected_roles(spark: SparkSession, d: str) -> DataFrame:
    """Role that each text foresees for the player it is about."""
    docs = table(spark, d, "documents").filter("player_id is not null").select("doc_id", "player_id", "text")
    return docs.join(table(spark, d, "players").select("player_id", "position"), "player_id").select("doc_id", fn.foreseen_role(F.lower("text"), F.col("position")).alias("role"))


def feed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the open statistics as comparable text, and saves computed where they are missing."""
    rows = table(spark, d, "russian_open_stats_2024")
    return rows.select("row_no", *[fn.comparable(F.col(c)).alias(c) for c in ("games", "points", "save_percentage", "goals_against_average")], fn.stage_text(F.col("regular_season")).alias("regular_season"), fn.saves_of(F.col("shots_against"), F.col("goals_against")).alias("saves"), fn.leading_zero(F.col("save_percentage")).alias("save_text"))


def line_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per player and season: the sources, those of highest priority first."""
    rows = table(spark, d, "season_stat_lines").select("player_id", "season", "source")
    return reconcile.merged_labels(rows, ["player_id", "season"], "source")


_PEOPLE = f"pp AS (SELECT p.player_id, position, handedness, height_cm, weight_kg, age_at_draft, consensus_rank FROM players p JOIN (SELECT player_id, consensus_rank FROM board QUALIFY {pr._LATEST_PLAYER}) b USING (player_id))"
_AP = f"ap AS ({pr.SQL['adjusted_production'].strip()})"
_LINES = f"""ll AS (SELECT s.*, coalesce(games, 0) AS g, coalesce(points, 0) AS pts, coalesce(adult_league, false) AS adult, coalesce(league_weight, 0.7) AS lw, coalesce(competition_level IN ('junior', 'junior_a'), false) AS junior,
  NOT coalesce(competition_level IN ('junior', 'junior_a'), false) AND coalesce(league_family = 'College', false) AS college, NOT coalesce(regular_season, true) AS playoff, league_family, competition_level
  FROM season_stat_lines s LEFT JOIN {pr._LEAGUE_SQL} USING (league) LEFT JOIN {_LEVEL_SQL} USING (league) WHERE timing = 'pre_draft'),
lf AS (SELECT player_id, count(*) AS pre_draft_row_count, count(DISTINCT league) AS pre_draft_league_count, CAST(sum(g) AS BIGINT) AS total_games, CAST(sum(pts) AS BIGINT) AS total_points, coalesce(sum(pts)::DOUBLE / nullif(sum(g), 0), 0) AS points_per_game,
  CAST(sum(CASE WHEN playoff THEN 0 ELSE g END) AS BIGINT) AS regular_season_games, CAST(sum(CASE WHEN playoff THEN g ELSE 0 END) AS BIGINT) AS playoff_games, count(*) FILTER (playoff) AS playoff_row_count, CAST(sum(CASE WHEN adult THEN g ELSE 0 END) AS BIGINT) AS adult_games,
  {', '.join(f"coalesce(sum(CASE WHEN {c} THEN g ELSE 0 END)::DOUBLE / nullif(sum(g), 0), count(*) FILTER ({c})::DOUBLE / count(*)) AS {c}_game_share" for c in ('adult', 'junior', 'college'))},
  coalesce(sum(CASE WHEN playoff THEN g ELSE 0 END)::DOUBLE / nullif(sum(g), 0), 0) AS playoff_game_share, coalesce(sum(g * lw) / nullif(sum(g), 0), avg(lw)) AS average_league_weight,
  arg_max(league, (g, -line_id)) AS primary_league, arg_max(struct_pack(v := league_family), (g, -line_id)).v AS primary_league_family, arg_max(struct_pack(v := competition_level), (g, -line_id)).v AS primary_competition_level FROM ll GROUP BY 1)"""
_GM = f"gm AS ({pr.SQL['goalie_metrics'].strip().replace('FROM season_stat_lines', 'FROM (SELECT * FROM season_stat_lines WHERE timing = ' + chr(39) + 'pre_draft' + chr(39) + ') AS sl').replace('round(a + 1e-9, 6)', 'a').replace('+ 1e-9, 5) AS quality', ', 9) AS quality')})"
_SIZE = "CASE WHEN position = 'G' THEN greatest(0, least(1, (height_cm - 180) / 20.0)) * 0.8 + greatest(0, least(1, (weight_kg - 75) / 20.0)) * 0.2 WHEN position = 'D' THEN greatest(0, least(1, (height_cm - 178) / 18.0)) * 0.7 + greatest(0, least(1, (weight_kg - 72) / 22.0)) * 0.3 ELSE greatest(0, least(1, (height_cm - 172) / 18.0)) * 0.65 + greatest(0, least(1, (weight_kg - 68) / 20.0)) * 0.35 END"
_FT = f"""WITH {_PEOPLE}, {_AP}, {_LINES}, {_GM},
ft AS (SELECT pp.*, {pr._ROLE} AS role_group, lf.* EXCLUDE (player_id), {', '.join(f"coalesce(lf.{c}, 0) AS n_{c}" for c in WHOLE[:8])}, {', '.join(f"coalesce(lf.{c}, 0) AS d_{c}" for c in REAL[:6])},
  coalesce(gm.games, 0) AS goalie_games, coalesce(gm.shots_against, 0) AS goalie_shots_against, coalesce(gm.saves, 0) AS goalie_saves, coalesce(gm.shutouts, 0) AS goalie_shutouts, coalesce(gm.save_percentage, 0) AS goalie_save_percentage, coalesce(gm.quality_score, 0) AS goalie_quality_score,
  greatest(0, least(1, 1 - (consensus_rank - 1) / ((SELECT max(consensus_rank) FROM pp) - 1)::DOUBLE)) AS cs0, greatest(0, least(1, coalesce(ap.adjusted_score, 0) / (SELECT max(adjusted_score) FROM ap))) AS aps,
  CASE WHEN ap.player_id IS NULL THEN 0 ELSE {pr._ADULT.replace('adult_games', 'lf.adult_games')} END AS aew, CASE WHEN ap.player_id IS NULL THEN 0 ELSE {pr._PLAYOFF.replace('playoff_games', 'lf.playoff_games')} END AS pew,
  coalesce(ap.adult_tier, CASE WHEN lf.adult_games > 0 THEN 'exposure' ELSE 'none' END) AS adult_sample_tier,
  CAST(CASE WHEN position = 'D' AND handedness = 'R' THEN 1.0 WHEN position = 'G' AND handedness <> '' THEN 0.55 WHEN handedness <> '' THEN 0.5 ELSE 0.35 END AS DOUBLE) AS hand,
  CASE WHEN height_cm IS NULL OR weight_kg IS NULL THEN NULL ELSE {_SIZE} END AS size, CASE WHEN age_at_draft IS NULL THEN NULL ELSE greatest(0, least(1, (18.9 - age_at_draft) / 1.4)) END AS ages
  FROM pp LEFT JOIN lf USING (player_id) LEFT JOIN gm ON gm.player_id = pp.player_id LEFT JOIN ap ON ap.player_id = pp.player_id),
fc AS (SELECT *, CASE WHEN consensus_rank IS NULL THEN NULL ELSE cs0 END AS cs FROM ft)"""
_REAL_SQL = ", ".join(f"round(CAST({src} AS DOUBLE) + 1e-9, 5) AS {c}" for c, src in zip(REAL, [*(f"d_{c}" for c in REAL[:6]), "cs", "aps", "aew", "pew", "hand", "size", "ages", "goalie_save_percentage", "goalie_quality_score"]))
_VALUE = "CASE position WHEN 'C' THEN 1.0 WHEN 'D' THEN 0.88 WHEN 'RW' THEN 0.72 WHEN 'LW' THEN 0.7 WHEN 'F' THEN 0.68 WHEN 'G' THEN 0.5 ELSE 0.65 END"


def _weighted_sql(weights: dict[str, float]) -> str:
    return "greatest(0, least(1, " + " + ".join(f"coalesce({c}, 0) * {w}" for c, w in weights.items()) + "))"


def _by_role_sql(weights: dict[str, dict[str, float]]) -> str:
    return "CASE role_group " + " ".join(f"WHEN '{r}' THEN {_weighted_sql(w)}" for r, w in weights.items()) + " END"


_JUDGED = f"""WITH {_PEOPLE}, sm AS (SELECT player_id, coalesce(sum(games), 0) AS games, coalesce(sum(points), 0) AS points FROM season_stat_lines JOIN {pr._LEAGUE_SQL} USING (league) WHERE timing <> 'pre_draft' AND adult_league GROUP BY 1),
j AS (SELECT player_id, greatest(0, least(1, 1 - (consensus_rank - 1) / ((SELECT max(consensus_rank) FROM pp) - 1)::DOUBLE)) AS score, games, points, games >= 100 AS is_nhler, games >= 200 OR points >= 100 AS is_impact, games < 50 AS is_bust FROM pp JOIN sm USING (player_id) WHERE consensus_rank IS NOT NULL)"""
_TARGETS = [("nhler", "is_nhler", "score"), ("impact", "is_impact", "score"), ("bust", "is_bust", "1 - score")]
_PKEY = "lower(regexp_replace(strip_accents({}), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_IKEY = "regexp_replace(trim(regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^(.).*?([^ ]*)$', '\\1\\2')"
_FEED = f"""WITH fe AS (SELECT row_no, name, season, league, team, lower(trim(regular_season)) IN ('1', 'true', 'yes', 'y') AS regular_season, {', '.join(f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN CAST(trim({c}) AS BIGINT) END AS {c}" for c in ('games', 'goals', 'assists', 'points'))}, source, source_id, loaded_at, {_PKEY.format('name')} AS k1, {_IKEY.format('name')} AS k2 FROM russian_open_stats_2024),
pl AS (SELECT player_id, k1, k2, count(*) OVER (PARTITION BY k1) AS n1, count(*) OVER (PARTITION BY k2) AS n2 FROM (SELECT player_id, {_PKEY.format('name')} AS k1, {_IKEY.format('name')} AS k2 FROM players)),
el AS (SELECT DISTINCT player_id, league FROM season_stat_lines WHERE league IS NOT NULL),
m1 AS (SELECT pl.player_id, fe.row_no, 0 AS step FROM pl JOIN el USING (player_id) JOIN fe ON fe.k1 = pl.k1 AND fe.league = el.league WHERE n1 = 1),
m2 AS (SELECT pl.player_id, fe.row_no, fe.source_id, 1 AS step FROM pl JOIN el USING (player_id) JOIN fe ON fe.k2 = pl.k2 AND fe.league = el.league WHERE n1 = 1 AND n2 = 1),
mm AS (SELECT * FROM m1 UNION ALL SELECT player_id, row_no, step FROM m2 WHERE player_id IN (SELECT player_id FROM m2 GROUP BY 1 HAVING count(DISTINCT source_id) = 1)),
mf AS (SELECT mm.player_id, step, fe.* FROM mm JOIN (SELECT player_id, min(step) AS step FROM mm GROUP BY 1) x USING (player_id, step) JOIN fe USING (row_no)
  QUALIFY row_number() OVER (PARTITION BY mm.player_id, season, league, regular_season ORDER BY games DESC NULLS LAST, loaded_at DESC NULLS LAST, row_no) = 1),
fd AS (SELECT pl.player_id, CASE WHEN pl.player_id NOT IN (SELECT player_id FROM el) THEN 'not_eligible' WHEN n1 > 1 THEN 'ambiguous_identity' WHEN c.lines IS NULL THEN 'unmatched_in_source' ELSE 'matched' END AS disposition, CASE c.step WHEN 0 THEN 'exact' WHEN 1 THEN 'initial' END AS method, coalesce(c.lines, 0) AS lines
  FROM pl LEFT JOIN (SELECT player_id, count(*) AS lines, min(step) AS step FROM mf GROUP BY 1) c USING (player_id))"""
_ALIAS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in lg.LEAGUE_NAMES.items()) + ") AS al(a, b)"
_NUM = "CASE WHEN isfinite(TRY_CAST({0} AS DOUBLE)) THEN regexp_replace(regexp_replace(printf('%.3f', TRY_CAST({0} AS DOUBLE)), '0+$', ''), '[.]$', '') ELSE lower({0}) END"
_DEPTH = "CASE WHEN coalesce(pre_draft_row_count, 0) >= 3 OR coalesce(pre_draft_league_count, 0) >= 2 THEN 'high' WHEN pre_draft_row_count = 2 THEN 'medium' ELSE 'low' END"

QUERIES = {f.__name__: f for f in (feature_table, baseline_scores, board_lift, outcome_targets, outcome_rank, feed_matches, feed_dispositions, enriched_lines, league_names, depth_rows, player_flags, stat_evidence, evidence_depth, board_status, pre_draft_rows, season_ages, projected_roles, feed_cells, line_sources)}

SQL = {
    "feature_table": f"{_FT} SELECT player_id, role_group, primary_league, primary_league_family, primary_competition_level, adult_sample_tier, {', '.join(f'CAST(n_{c} AS BIGINT) AS {c}' for c in WHOLE[:8])}, {', '.join(WHOLE[8:])}, {_REAL_SQL} FROM fc",
    "baseline_scores": f"""{_FT}, bc AS (SELECT player_id, role_group, aps AS production, cs AS consensus, ages AS age, size, hand, {_VALUE} AS position_value, 0 AS slot,
  CASE WHEN n_pre_draft_row_count <= 1 THEN 0.35 ELSE greatest(0, least(1, 0.35 + least(n_total_games, 80) / 200.0 + least(n_pre_draft_league_count, 3) * 0.08 + n_playoff_row_count * 0.06)) END AS several,
  greatest(0, least(1, greatest(0, least(1, n_total_games / 55.0)) * 0.8 + aew * 0.12 + pew * 0.08)) AS sample FROM fc),
b1 AS (SELECT *, {_weighted_sql(baselines.CONTEXTUAL)} AS contextual, {_by_role_sql(baselines.ROLE_AWARE)} AS role_aware FROM bc)
SELECT player_id, round(contextual + 1e-9, 4) AS contextual, round(role_aware + 1e-9, 4) AS role_aware, round({_by_role_sql(baselines.HYBRID)} + 1e-9, 4) AS role_specific_hybrid FROM b1""",
    "board_lift": f"""{_JUDGED}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, player_id) AS n FROM j), a AS (SELECT avg(games) AS g, avg(points) AS p FROM j)
SELECT CAST(t AS INTEGER) AS top_n, count(*) AS players, count(*) FILTER (is_nhler) AS nhlers, count(*) FILTER (is_impact) AS impacts, count(*) FILTER (is_bust) AS busts, round(avg(games) + 1e-9, 6) AS avg_games, round(avg(points) + 1e-9, 6) AS avg_points,
  round(avg(games) / any_value(g) + 1e-9, 6) AS games_lift, round(avg(points) / any_value(p) + 1e-9, 6) AS points_lift FROM o, a, (VALUES (10), (25), (50)) AS tt(t) WHERE n <= t GROUP BY 1""",
    "outcome_targets": _JUDGED + "\n" + "\nUNION ALL\n".join(f"""SELECT '{t}' AS target, (SELECT count(*) FROM j) AS players, (SELECT round(avg(CAST({c} AS INTEGER)) + 1e-9, 6) FROM j) AS positive_rate, (SELECT round(avg(power(CAST({c} AS INTEGER) - ({s}), 2)) + 1e-9, 6) FROM j) AS brier,
  (SELECT round(avg(CAST({c} AS INTEGER)) + 1e-9, 6) FROM (SELECT {c} FROM j ORDER BY {s} DESC, player_id LIMIT 10)) AS "precision" """ for t, c, s in _TARGETS),
    "outcome_rank": f"""{_JUDGED}, r AS (SELECT rank() OVER (ORDER BY games) + (count(*) OVER (PARTITION BY games) - 1) / 2.0 AS ra, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rb FROM j)
SELECT round(corr(ra, rb) + 1e-9, 6) AS spearman FROM r""",
    "feed_matches": f"{_FEED} SELECT player_id, disposition, method, lines FROM fd",
    "feed_dispositions": f"{_FEED} SELECT disposition, count(*) AS players, CAST(sum(lines) AS BIGINT) AS lines FROM fd GROUP BY 1",
    "enriched_lines": f"""{_FEED} SELECT player_id, season, league, team, regular_season, CAST(games AS BIGINT) AS games, CAST(goals AS BIGINT) AS goals, CAST(assists AS BIGINT) AS assists, CAST(points AS BIGINT) AS points, source FROM season_stat_lines s WHERE timing = 'pre_draft'
  AND NOT EXISTS (SELECT 1 FROM mf WHERE mf.player_id = s.player_id AND mf.season IS NOT DISTINCT FROM s.season AND mf.league = s.league AND mf.regular_season IS NOT DISTINCT FROM s.regular_season)
UNION ALL SELECT player_id, season, league, team, regular_season, games, goals, assists, points, source FROM mf""",
    "league_names": f"""
WITH w AS (SELECT league FROM season_stat_lines UNION SELECT league FROM russian_open_stats_2024 UNION SELECT primary_league FROM board UNION SELECT * FROM (VALUES (' swe-jr. '), ('BIG  TEN'), ('u20  SM-sarja'), ('Hockey East'), (''), ('nla'), ('Somewhere')) AS t(x)),
c AS (SELECT league, trim(regexp_replace(coalesce(league, ''), '\\s+', ' ', 'g')) AS v FROM w)
SELECT league, CASE WHEN v = '' THEN 'Unknown' ELSE coalesce((SELECT any_value(b) FROM {_ALIAS_SQL} WHERE a = v), (SELECT any_value(b) FROM {_ALIAS_SQL} WHERE lower(a) = lower(v)), v) END AS league_name FROM c""",
    "depth_rows": f"""{pr._CLUBS}, k AS (SELECT s.*, {pr._ROLE} AS role, name FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY season DESC, games DESC NULLS LAST, line_id) = 1) s JOIN players USING (player_id)),
r AS (SELECT club, league, role, player_id, name, age, coalesce(games, 0) AS games, CAST(coalesce(points, 0) AS DOUBLE) / nullif(games, 0) AS ppg, save_percentage AS sv FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY club, league, role ORDER BY ppg DESC NULLS LAST, player_id) AS n FROM r)
SELECT club, league, role, count(*) AS players, round(avg(age) FILTER (age > 0) + 1e-9, 4) AS avg_age, round(avg(ppg) FILTER (games > 0) + 1e-9, 5) AS avg_ppg, round(coalesce(sum(sv * greatest(games, 1)) FILTER (sv > 0) / sum(greatest(games, 1)) FILTER (sv > 0), 0) + 1e-9, 5) AS avg_save,
  string_agg(name, '; ' ORDER BY n) FILTER (n <= 5) AS examples FROM o GROUP BY 1, 2, 3""",
    "player_flags": f"""
WITH gm AS ({pr.SQL['goalie_metrics'].strip()}), l AS (SELECT player_id, count(*) AS lines, coalesce(sum(games), 0) AS games, coalesce(sum(points), 0) AS points, count(DISTINCT nullif(trim(league), '')) AS leagues FROM season_stat_lines GROUP BY 1),
x AS (SELECT p.player_id, {pr._ROLE} AS role, coalesce(lines, 0) AS lines, coalesce(l.games, 0) AS games, coalesce(points, 0) AS points, coalesce(leagues, 0) AS leagues, coalesce(gm.games, 0) AS g, coalesce(save_percentage, 0) AS sv, coalesce(goals_against_average, 0) AS ga FROM players p LEFT JOIN l USING (player_id) LEFT JOIN gm USING (player_id))
SELECT player_id, concat_ws(';', CASE WHEN lines = 0 THEN 'missing_stat_lines' END, CASE WHEN games <> 0 AND lines = 1 THEN 'low_evidence_single_line' END, CASE WHEN role = 'goalie' AND g < 10 THEN 'goalie_short_sample' END, CASE WHEN role = 'goalie' AND (sv = 0 OR ga = 0) THEN 'goalie_missing_rates' END,
  CASE WHEN role <> 'goalie' AND games <> 0 AND points = 0 THEN 'skater_missing_points' END, CASE WHEN leagues >= 3 THEN 'multi_league_profile' END) AS flags FROM x""",
    "stat_evidence": """
SELECT league, season, source, count(*) AS lines, count(DISTINCT player_id) AS players, count(*) FILTER (games IS NOT NULL OR goals IS NOT NULL OR assists IS NOT NULL OR points IS NOT NULL) AS with_statistics,
  count(*) FILTER (goalie_minutes IS NOT NULL OR saves IS NOT NULL OR goals_against IS NOT NULL OR save_percentage IS NOT NULL OR goals_against_average IS NOT NULL OR wins IS NOT NULL OR losses IS NOT NULL OR ties IS NOT NULL OR shutouts IS NOT NULL) AS with_goalie_statistics FROM season_stat_lines GROUP BY 1, 2, 3""",
    "evidence_depth": f"""WITH {_PEOPLE}, {_LINES} SELECT player_id, {_DEPTH} AS evidence_depth, CASE WHEN coalesce(consensus_rank, 0) <= 0 THEN 'standard' WHEN consensus_rank <= 32 THEN 'critical' WHEN consensus_rank <= 96 THEN 'high' WHEN consensus_rank <= 160 THEN 'medium' ELSE 'standard' END AS priority FROM pp LEFT JOIN lf USING (player_id)""",
    "board_status": f"""WITH {_PEOPLE}, {_LINES}, e AS (SELECT player_id, {_DEPTH} AS depth FROM pp LEFT JOIN lf USING (player_id)), c AS (SELECT board_id, player_id FROM board QUALIFY {pr._LATEST}),
s AS (SELECT board_id, count(*) AS players, avg(CAST(depth IN ('high', 'medium') AS INTEGER)) AS r FROM c JOIN e USING (player_id) GROUP BY 1) SELECT board_id, players, CASE WHEN r >= 0.65 THEN 'strong' WHEN r >= 0.35 THEN 'usable' ELSE 'thin' END AS status FROM s""",
    "pre_draft_rows": f"""
WITH b AS (SELECT player_id, primary_league FROM board QUALIFY {pr._LATEST_PLAYER}), l AS (SELECT s.*, CASE WHEN league = primary_league THEN 1 ELSE 2 END AS tier, TRY_CAST(split_part(player_id, '-', 1) AS INTEGER) AS y FROM season_stat_lines s LEFT JOIN b USING (player_id)),
t AS (SELECT *, min(tier) OVER (PARTITION BY player_id) AS first FROM l WHERE season = (y - 1) || '-' || right(CAST(y AS VARCHAR), 2))
SELECT player_id, line_id, league, CAST(row_number() OVER (PARTITION BY player_id ORDER BY coalesce(games, 0) DESC, line_id) AS INTEGER) AS place FROM t WHERE tier = first""",
    "season_ages": """
SELECT line_id, round(date_diff('day', birth_date, make_date(CAST(left(season, 4) AS INTEGER) + 1, 6, 1)) / 365.25, 1) AS age FROM season_stat_lines JOIN players USING (player_id)""",
    "projected_roles": """
SELECT doc_id, CASE WHEN lower(text) LIKE '%middle-six%' THEN 'middle-six forward' WHEN lower(text) LIKE '%top-six%' THEN 'top-six forward' WHEN lower(text) LIKE '%matchup%' AND position = 'C' THEN 'matchup center'
  WHEN position LIKE '%HD' AND lower(text) LIKE '%transition%' THEN 'transition defenseman' WHEN position LIKE '%HD' THEN 'two-way defenseman' ELSE 'needs role projection review' END AS role FROM documents d JOIN players USING (player_id)""",
    "feed_cells": "SELECT row_no, " + ", ".join(f"CASE WHEN trim({c}) <> '' THEN {_NUM.format(f'trim({c})')} END AS {c}" for c in ("games", "points", "save_percentage", "goals_against_average")) + """,
  CASE WHEN lower(trim(regular_season)) IN ('false', '0', 'no', 'playoffs', 'playoff') THEN 'false' ELSE 'true' END AS regular_season, CAST(CASE WHEN regexp_full_match(trim(shots_against), '[+-]?[0-9]+') AND regexp_full_match(trim(goals_against), '[+-]?[0-9]+') THEN CAST(trim(shots_against) AS BIGINT) - CAST(trim(goals_against) AS BIGINT) END AS BIGINT) AS saves,
  CASE WHEN trim(save_percentage) LIKE '.%' THEN '0' || trim(save_percentage) ELSE trim(save_percentage) END AS save_text FROM russian_open_stats_2024""",
    "line_sources": f"""SELECT player_id, season, string_agg(source, '; ' ORDER BY p DESC, source) AS sources FROM (SELECT DISTINCT player_id, season, source, {pr._PRIORITY} AS p FROM season_stat_lines WHERE source IS NOT NULL) GROUP BY 1, 2""",
}
