"""Queries over the prospect tables: linkage, reconciliation, features, ranking, models, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.text import alnum_key
from ..operators import aggregates as agg
from ..operators import audit, linkage, models, ranking, reconcile, rosters, scoring, units
from ..plans import dataset
from ..sources.tables import table

# League dimension of these tables (adult flag, weight, playoff weight).
LEAGUES = (("NKL", True, 1.10, 1.10), ("VKL", True, 0.92, 1.08), ("MKL", False, 0.70, 1.0), ("Alpenliga", True, 1.0, 1.1), ("Suurliiga U20", False, 0.62, 1.0), ("Ostland Juniorliga", False, 0.58, 1.0), ("Prairie Junior League", False, 0.55, 1.0), ("Coastal College Conf.", False, 0.80, 1.02))
_LEAGUE_SQL = "(VALUES " + ", ".join(f"('{n}', {str(a).lower()}, CAST({w} AS DOUBLE), CAST({p} AS DOUBLE))" for n, a, w, p in LEAGUES) + ") AS lg(league, adult_league, league_weight, playoff_weight)"


def leagues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEAGUES), "league string, adult_league boolean, league_weight double, playoff_weight double")


def _q(value, digits: int = 6):
    """Rounded after a nudge that takes exact ties to the same side in every engine."""
    return F.round(value + F.lit(1e-9), digits)


def _r(c: str, digits: int = 6):
    return _q(F.col(c), digits).alias(c)


def adjusted_production(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "season_stat_lines").filter("timing = 'pre_draft'")
    out = scoring.adjusted_production(lines, table(spark, d, "players"), leagues(spark))
    return out.select("player_id", "season", "league", "role_group", "games", "points", _r("adjusted_ppg"), "adult_games", "playoff_games", "adult_tier", _r("role_percentile"), _r("adjusted_score", 5))


def goalie_metrics(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "season_stat_lines").withColumn("minutes", fn.minutes(F.col("goalie_minutes")))
    out = agg.goalie_metrics(lines, ["player_id"])
    return out.select("player_id", "games", _r("minutes", 3), "shots_against", "saves", "goals_against", "shutouts", _r("save_percentage"), _r("goals_against_average", 4), _r("quality_score", 5))


def player_shares(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "season_stat_lines").join(F.broadcast(leagues(spark)), "league", "left")
    g = F.coalesce("games", F.lit(0))
    out = lines.groupBy("player_id").agg(F.sum(g).alias("games"), F.count_distinct("league").alias("leagues"), agg.share_where(g, F.col("adult_league")).alias("adult_share"), agg.share_where(g, ~F.col("regular_season")).alias("playoff_share"), agg.ratio_of_sums(g * F.col("league_weight"), g).alias("league_mean"))
    return out.select("player_id", "games", "leagues", _r("adult_share"), _r("playoff_share"), _r("league_mean"))


def primary_line(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "season_stat_lines").filter("timing = 'pre_draft'").withColumn("g", F.coalesce("games", F.lit(0)))
    return lines.groupBy("player_id").agg(agg.largest([F.col("g"), -F.col("line_id")], F.struct("line_id", "season", "league")).alias("p")).select("player_id", "p.*")


def development_path(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "season_stat_lines").filter("timing <> 'pre_draft'")
    one = lines.groupBy("player_id", "league").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.sum("games").alias("games"))
    return one.select("player_id", "league", "first_season", "last_season", "games")


def league_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "season_stat_lines").groupBy("league", "season").agg(F.count("*").alias("lines"), F.count_distinct("player_id").alias("players"), F.sum("games").alias("games"), F.count_if(F.col("points").isNull()).alias("no_points"), agg.ratio_of_sums(F.col("points"), F.when(F.col("points").isNotNull(), F.col("games"))).alias("ppg"))
    return out.withColumn("ppg", _q(F.col("ppg")))


def identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Guide profiles and players by unique full-name keys, then by unique initial and surname."""
    profiles, players = (table(spark, d, t) for t in ("ep_pdf_profiles", "players"))
    ours = profiles.select(F.col("player_id").alias("source_id"), "name")
    base = players.select(F.col("player_id").alias("base_id"), "name")
    steps = [("exact", fn.name_key(F.col("name")), fn.name_key(F.col("name"))), ("initial", fn.initial_surname_key(F.col("name")), fn.initial_surname_key(F.col("name")))]
    return linkage.cascade_match(ours, base, "source_id", "base_id", steps)


def identity_cascade(spark: SparkSession, d: str) -> DataFrame:
    """``identity_pairs``, and for profiles that no key pairs the player of the most similar folded name (0.9 or more)."""
    profiles, players = (table(spark, d, t) for t in ("ep_pdf_profiles", "players"))
    ours = profiles.select(F.col("player_id").alias("source_id"), "name")
    base = players.select(F.col("player_id").alias("base_id"), "name")
    steps = [(m, key(F.col("name")), key(F.col("name"))) for m, key in (("exact", fn.name_key), ("initial", fn.initial_surname_key))]
    return linkage.cascade_match(ours, base, "source_id", "base_id", steps, fuzzy=(alnum_key(F.col("name")), alnum_key(F.col("name")), "name", 0.9))


def unmatched_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The three closest registered names of each unregistered spelling, of all registered names."""
    spelled = table(spark, d, "open_stats_matches").filter("source_name is not null and source_name <> name").select("match_row", "source_name")
    out = linkage.closest(spelled, table(spark, d, "players").select("player_id", "name"), "match_row", "player_id", fn.name_key(F.col("source_name")), fn.name_key(F.col("name")), "name")
    return out.select("match_row", "player_id", F.round("similarity", 6).alias("similarity"), "place")


def bio_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Blank handedness of players filled from a guide profile of the same name key, if the key has one profile."""
    players = table(spark, d, "players").withColumn("k", alnum_key(F.col("name")))
    profiles = table(spark, d, "ep_pdf_profiles").withColumn("k", alnum_key(F.col("name")))
    once = profiles.groupBy("k").agg(F.count("*").alias("n"), F.min("handedness").alias("handedness")).filter("n = 1")
    return linkage.fill_blanks(players, once, "k", ["handedness"]).select("player_id", "handedness")


def replaced_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the lowest trusted source replaced, per player and season, by the league feed's."""
    lines = table(spark, d, "season_stat_lines").select("line_id", "player_id", "season", "source", "games", "points")
    return linkage.replace_scope(lines.filter("source <> 'league-feed'"), lines.filter("source = 'league-feed'"), ["player_id", "season"])


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Players with no statistics, with them, and statistics without a player."""
    return linkage.coverage(table(spark, d, "players"), table(spark, d, "season_stat_lines").filter("games > 0"), ["player_id"])


def league_context(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "russian_open_stats_2024").select("row_no", "league")
    out = linkage.lookup(lines, leagues(spark).filter("league <> 'MKL'"), "league", {"adult_league": False, "league_weight": 0.7, "playoff_weight": 1.0})
    return out.select("row_no", "league", "adult_league", "league_weight")


def reconciled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Per player, season, league, club and stage: each field from the source of highest priority, longest text, first row."""
    lines = reconcile.with_club(table(spark, d, "season_stat_lines").withColumn("stage", F.col("regular_season")), table(spark, d, "team_aliases"))
    keys = ["player_id", "season", "league", "club", "stage"]
    fields = ["games", "goals", "assists", "points"]
    return reconcile.prefer_by_priority(lines, keys, fields, reconcile.source_priority(F.col("source")), "line_id")


def line_conflicts(spark: SparkSession, d: str) -> DataFrame:
    lines = reconcile.with_club(table(spark, d, "season_stat_lines"), table(spark, d, "team_aliases"))
    return reconcile.conflicts(lines, ["player_id", "season", "league", "club", "regular_season"], ["games", "goals", "assists", "points"])


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "board")
    return reconcile.repeated_rows(rows, "board_row_id", ("loaded_at",)).select("board_row_id", "board_id", "player_id")


def season_totals(spark: SparkSession, d: str) -> DataFrame:
    first = reconcile.keep_first(table(spark, d, "season_stat_lines"), ["player_id", "season", "league", "regular_season"], [F.col("games").desc_nulls_last(), F.col("line_id")])
    return reconcile.sum_phases(first, ["player_id", "season"], ["games", "goals", "assists", "points"])


def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "players").select("player_id", "name", "nationality")
    _, rejected = reconcile.reject_ambiguous(people, "player_id", fn.name_key(F.col("name")), ["name", "nationality"])
    return rejected.select("player_id", "reason")


def rank_quality(spark: SparkSession, d: str) -> DataFrame:
    """Mid-rank correlation of model and board score, with precision among the first 25."""
    rows = table(spark, d, "board").select("board_row_id", "model_score", "board_score", "consensus_rank").withColumn("hit", F.coalesce(F.col("consensus_rank") <= 50, F.lit(False)))
    corr = ranking.spearman(rows, "model_score", "board_score").select(_q(F.col("spearman")).alias("spearman"))
    top = ranking.precision_at(rows, "hit", "board_score", [F.col("board_row_id")], 25).select("hits", _q(F.col("precision")).alias("precision"))
    loss = ranking.brier(rows, "hit", "model_score").select(_q(F.col("brier")).alias("brier"))
    return corr.join(top).join(loss)  # one row each


def board_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Places by (score, player) both descending within a board of the latest rows, and the move against consensus."""
    rows = reconcile.keep_first(table(spark, d, "board"), ["board_id", "player_id"], [F.col("loaded_at").desc(), F.col("board_row_id").desc()])
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("board_id").orderBy(F.col("board_score").desc_nulls_last(), F.col("player_id").desc()))
    ranked = rows.withColumn("board_rank", place)
    move = F.col("board_rank") - F.col("consensus_rank")
    label = F.when(move <= -8, "model_higher").when(move >= 8, "consensus_higher").when(move.isNotNull(), "aligned")
    return ranked.select("board_id", "player_id", "board_rank", move.alias("move"), label.alias("disagreement"))


def movement_by_role(spark: SparkSession, d: str) -> DataFrame:
    out = board_ranks(spark, d).join(table(spark, d, "players").select("player_id", scoring.role_of(F.col("position")).alias("role")), "player_id")
    return out.groupBy("role", "disagreement").agg(F.count("*").alias("players"), _q(F.avg(F.abs("move"))).alias("mean_move"), F.max(F.abs("move")).alias("largest_move"))


def blended_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.max_normalized(table(spark, d, "board").withColumn("adjusted_ppg", F.nanvl("adjusted_ppg", F.lit(None).cast("double"))), "adjusted_ppg", "production")
    rows = rows.withColumn("production", F.when(F.col("adjusted_ppg").isNotNull(), F.col("production")))
    rows = rows.withColumn("consensus", F.when(F.col("consensus_rank").isNotNull(), fn.clamp(1 - (F.col("consensus_rank") - 1) / 224.0)))
    """Blend of three scores, for the rows that have all of them."""
    return rows.select("board_row_id", _q(ranking.blended({"consensus": 0.5, "model_score": 0.3, "production": 0.2}), 6).alias("hybrid")).filter("hybrid is not null")


def components(spark: SparkSession, d: str) -> DataFrame:
    """Every player; the size is null where the cells are no measures in cm and kg (``component_scores`` reads all units)."""
    p = table(spark, d, "players").withColumns({"height_cm": F.when(F.col("height_cm").between(150, 220), F.col("height_cm")), "weight_kg": F.when(F.col("weight_kg").between(50, 130), F.col("weight_kg"))})
    return p.select("player_id", _q(scoring.size_score(F.col("position"), F.col("height_cm"), F.col("weight_kg")), 6).alias("size"), scoring.hand_score(F.col("position"), F.col("handedness")).alias("hand"), _q(scoring.age_score(F.col("age_at_draft")), 6).alias("age"))


def component_scores(spark: SparkSession, d: str) -> DataFrame:
    """``components`` of every player: measures in any unit are brought to cm and kg, size is null where one is missing."""
    sized = table(spark, d, "players").select("player_id", "position", "handedness", "age_at_draft", F.col("height_cm").cast("string").alias("h"), F.col("weight_kg").cast("string").alias("w"))
    for cell, measure in (("h", units.HEIGHT), ("w", units.WEIGHT)):
        sized = units.to_common_unit(sized.withColumnRenamed(cell, "cell"), measure).withColumn(cell, F.col("tenths") / 10.0).drop("cell", "unit", "tenths")
    return sized.select("player_id", _q(scoring.size_score(F.col("position"), F.col("h"), F.col("w")), 6).alias("size"), scoring.hand_score(F.col("position"), F.col("handedness")).alias("hand"), _q(scoring.age_score(F.col("age_at_draft")), 6).alias("age"))


def projections(spark: SparkSession, d: str) -> DataFrame:
    best = reconcile.keep_first(table(spark, d, "board"), ["player_id"], [F.col("loaded_at").desc(), F.col("board_row_id").desc()])
    rows = best.select("player_id", "consensus_rank", "primary_league").join(table(spark, d, "players").select("player_id", F.col("age_at_draft").alias("age"), "height_cm", "position"), "player_id")
    totals = table(spark, d, "season_stat_lines").filter("timing = 'pre_draft'").groupBy("player_id").agg(F.sum("games").alias("games"), F.sum("points").alias("points"))
    rows = rows.join(totals, "player_id", "left").withColumn("ppg", F.try_divide(F.col("points"), F.col("games")))
    rows = rows.join(F.broadcast(leagues(spark).select(F.col("league").alias("primary_league"), F.col("league_weight").alias("league_factor"))), "primary_league", "left")
    noted = table(spark, d, "documents").filter("player_id is not null and trim(text) <> ''").select("player_id").distinct().withColumn("has_text", F.lit(True))
    out = scoring.projection(rows.join(noted, "player_id", "left"))
    return out.select("player_id", *[_r(c, 5) for c in ("nhl_probability", "impact_probability", "bust_risk", "expected_value", "confidence")], F.concat_ws(";", "positives").alias("positives"), F.concat_ws(";", "risks").alias("risks"))


def cross_validated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Role models of being an early pick, scored on the fold that they did not see."""
    best = reconcile.keep_first(table(spark, d, "board"), ["player_id"], [F.col("loaded_at").desc(), F.col("board_row_id").desc()])
    rows = best.select("player_id", fn.clamp(F.coalesce(F.nanvl("adjusted_ppg", F.lit(None)), F.lit(0.0)), 0, 5).alias("ppg"), "adult_game_share", "model_score", F.lower(F.trim("role_group")).alias("role"), (F.coalesce("consensus_rank", F.lit(999)) <= 60).cast("int").alias("early"))
    out = models.cross_validated(rows, ["role"], ["ppg", "adult_game_share", "model_score"], "early", "player_id")
    return out.select("player_id", "role", "fold", F.round("score", 6).alias("score"))


def cv_folds(spark: SparkSession, d: str) -> DataFrame:
    return cross_validated_scores(spark, d).select("player_id", "role", "fold")


def missing_by_column(spark: SparkSession, d: str) -> DataFrame:
    return audit.missing_counts(table(spark, d, "players"))


def integrity(spark: SparkSession, d: str) -> DataFrame:
    """Counts of broken references and repeated keys against their limits."""
    players, lines = table(spark, d, "players"), table(spark, d, "season_stat_lines")
    counts = [("orphan_lines", audit.orphans(lines, players, "player_id").agg(F.count("*").alias("value"))), ("duplicate_players", audit.duplicate_total(players, ["player_id"]).select(F.col("duplicates").alias("value"))), ("players", players.agg(F.count("*").alias("value")))]
    metrics = None
    for name, one in counts:
        row = one.select(F.lit(name).alias("metric"), F.col("value").cast("bigint").alias("value"))
        metrics = row if metrics is None else metrics.unionByName(row)
    limits = spark.createDataFrame([("orphan_lines", 0, 0), ("duplicate_players", 0, 0), ("players", 100, None), ("teams", 32, None)], "metric string, low bigint, high bigint")
    return audit.threshold_checks(metrics, limits)


def digests(spark: SparkSession, d: str) -> DataFrame:
    """Rows and order-free digest of the registry."""
    return audit.fingerprint(table(spark, d, "players"))


def club_depth(spark: SparkSession, d: str) -> DataFrame:
    """Clubs of each season by role, every pair, with counts; roles are three."""
    lines = table(spark, d, "season_stat_lines").join(table(spark, d, "players").select("player_id", scoring.role_of(F.col("position")).alias("role")), "player_id").withColumn("club", alnum_key(F.col("team")))
    out = agg.dense_grid(lines, ["season", "club"], ["role"], {"players": F.count_distinct("player_id"), "games": F.coalesce(F.sum("games"), F.lit(0))})
    return out.select("season", "club", "role", "players", "games")


def document_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    weights = {"speed": 2.0, "wrist shot": 1.5, "discipline": 1.0, "risk": -1.0}
    tags = {"skating": ("speed", "edge work", "mobility"), "scoring": ("wrist shot", "release"), "defending": ("gap control", "slot")}
    return docs.select("doc_id", fn.keyword_score(F.col("text"), weights).alias("score"), F.array_join(fn.keyword_tags(F.col("text"), tags), ";").alias("tags"))


def typed_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "russian_open_stats_2024")
    return rows.select("row_no", fn.whole_strict(F.col("games")).alias("games_strict"), fn.whole_lenient(F.col("goals")).alias("goals_lenient"), fn.flag(F.col("regular_season")).alias("regular"), fn.season_label(F.col("season")).alias("season_label"), _q(fn.minutes(F.col("goalie_minutes")), 4).alias("minutes"))


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "players")
    return p.select("player_id", fn.name_key(F.col("name")).alias("name_key"), fn.person_key(F.col("name")).alias("person_key"), fn.initial_surname_key(F.col("name")).alias("initial_key"), fn.slug(F.col("name")).alias("slug"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Leagues on both sides, and on one side only, of the lines and the open statistics."""
    a = table(spark, d, "season_stat_lines").select("player_id").distinct()
    b = table(spark, d, "open_stats_matches").filter("matched = 'true'").select("player_id").distinct()
    both, gone = a.intersect(b), a.exceptAll(b)
    return both.agg(F.count("*").alias("in_both")).join(gone.agg(F.count("*").alias("lines_only")))  # one row each


def nested_lines(spark: SparkSession, d: str) -> DataFrame:
    out = dataset.nested_players(table(spark, d, "players").select("player_id"), table(spark, d, "season_stat_lines"), ["season", "line_id"], ["league"])
    return out.select("player_id", F.size("stat_lines").alias("lines"), F.array_join(F.array_distinct(F.transform("stat_lines", lambda x: x["league"])), "; ").alias("leagues"))


def current_clubs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "season_stat_lines").select("line_id", "player_id", "team", "games", "loaded_at")
    return rosters.latest_assignment(lines, "player_id", "loaded_at", "games", "line_id").select("player_id", "line_id", "confidence")


def board_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Players of the main board against players of all other boards."""
    b = table(spark, d, "board").select("board_id", "player_id", "draft_year").distinct()
    return rosters.overlay_snapshot(b.filter("board_id <> 'main-board'").groupBy("player_id").agg(F.count("*").alias("boards")), b.filter("board_id = 'main-board'"), ["player_id"], ["boards"])


def shared_names(spark: SparkSession, d: str) -> DataFrame:
    """Players whose name another nation also lists for someone born within twenty years."""
    p = table(spark, d, "players").select("player_id", "name", "nationality", "birth_date")
    return rosters.in_several_organizations(p, fn.name_key(F.col("name")), "nationality", "birth_date", "player_id", 7305)


def age_bands(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "season_stat_lines").filter("regular_season")
    band = rosters.banded(F.col("age"), [17, 18, 19, 21], ["u17", "17", "18", "19-20", "21+"])
    order = rosters.tiered([F.col("games") >= 50, F.col("games") >= 20])
    return lines.groupBy("league", band.alias("band")).agg(F.count("*").alias("lines"), F.sum("games").alias("games"), F.min(order).alias("best_tier"))


_LATEST = "row_number() OVER (PARTITION BY board_id, player_id ORDER BY loaded_at DESC, board_row_id DESC) = 1"
_LATEST_PLAYER = "row_number() OVER (PARTITION BY player_id ORDER BY loaded_at DESC, board_row_id DESC) = 1"
_ROLE = "CASE WHEN position = 'G' THEN 'goalie' WHEN position = 'D' OR position LIKE '%HD' THEN 'defense' ELSE 'forward' END"
_PRIORITY = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in reconcile.PRIORITY.items()) + " ELSE 10 END"
_ADULT = "CASE WHEN adult_games < 1 THEN 0 WHEN adult_games < 5 THEN 0.12 WHEN adult_games < 10 THEN 0.32 WHEN adult_games < 16 THEN 0.62 ELSE least(1.0, 0.78 + least(adult_games - 16, 24) / 110.0) END"
_PLAYOFF = "CASE WHEN playoff_games < 1 THEN 0 WHEN playoff_games < 3 THEN 0.18 WHEN playoff_games < 6 THEN 0.42 WHEN playoff_games < 10 THEN 0.68 ELSE least(1.0, 0.82 + least(playoff_games - 10, 15) / 85.0) END"
_KEY = "lower(regexp_replace(strip_accents(name), '[^A-Za-z0-9]', '', 'g'))"
_SPELLED = "lower(regexp_replace(strip_accents({}), '[^A-Za-z0-9]', '', 'g'))"
_CLUBS = f"""WITH al AS (SELECT league, {_SPELLED.format('code')} AS k, min({_SPELLED.format('team')}) AS t FROM team_aliases GROUP BY 1, 2),
s AS (SELECT s.*, coalesce(al.t, {_SPELLED.format('s.team')}) AS club FROM season_stat_lines s LEFT JOIN al ON al.league = s.league AND al.k = {_SPELLED.format('s.team')})"""
_CLAMP = "greatest(0.0, least(1.0, {}))"


def _field(f: str) -> str:
    return f"arg_max({f}, (p, length(CAST({f} AS VARCHAR)), -line_id)) FILTER ({f} IS NOT NULL) AS {f}"


QUERIES = {f.__name__: f for f in (adjusted_production, goalie_metrics, player_shares, primary_line, development_path, league_rollup, identity_pairs, identity_cascade, unmatched_candidates, bio_overlay, replaced_lines, evidence_coverage, league_context, reconciled_lines, line_conflicts, repeated_lines, season_totals, ambiguous_names, rank_quality, board_ranks, movement_by_role, blended_scores, components, component_scores, projections, cross_validated_scores, cv_folds, missing_by_column, integrity, digests, club_depth, document_tags, typed_cells, name_keys, set_operations, nested_lines, current_clubs, board_overlay, shared_names, age_bands)}

SQL = {
    "adjusted_production": f"""
WITH l AS (SELECT s.*, coalesce(games, 0) AS g, coalesce(points, 0) AS p, coalesce(adult_league, false) AS adult, coalesce(league_weight, 0.7) AS lw, CASE WHEN NOT regular_season THEN coalesce(playoff_weight, 1.0) ELSE 1.0 END AS sw
  FROM season_stat_lines s LEFT JOIN {_LEAGUE_SQL} USING (league) WHERE timing = 'pre_draft'),
f AS (SELECT player_id, CAST(sum(greatest(g, 0)) AS BIGINT) AS games, CAST(sum(p) AS BIGINT) AS points, sum(CASE WHEN g > 0 THEN p * lw * sw ELSE 0 END) / nullif(sum(greatest(g, 0)), 0) AS appg,
  CAST(coalesce(sum(g) FILTER (adult), 0) AS BIGINT) AS adult_games, CAST(coalesce(sum(g) FILTER (NOT regular_season), 0) AS BIGINT) AS playoff_games,
  arg_max(league, (g, -line_id)) AS league, arg_max(season, (g, -line_id)) AS season FROM l GROUP BY 1),
k AS (SELECT f.*, {_ROLE} AS role_group FROM f JOIN players USING (player_id) WHERE games > 0),
r AS (SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY season, league, role_group) AS n FROM k WHERE role_group <> 'goalie' WINDOW w AS (PARTITION BY season, league, role_group ORDER BY appg DESC, player_id)),
q AS (SELECT *, CASE WHEN n = 1 THEN 1.0 ELSE CAST(n - rk AS DOUBLE) / (n - 1) END AS pct FROM r)
SELECT player_id, season, league, role_group, games, points, round(appg + 1e-9, 6) AS adjusted_ppg, adult_games, playoff_games,
  CASE WHEN adult_games < 1 THEN 'none' WHEN adult_games < 5 THEN 'exposure' WHEN adult_games < 10 THEN 'small' WHEN adult_games < 16 THEN 'meaningful' ELSE 'strong' END AS adult_tier,
  round(pct + 1e-9, 6) AS role_percentile, round(appg + 0.07 * ({_ADULT}) + 0.08 * ({_PLAYOFF}) + CASE WHEN rk <= 5 THEN 0.08 WHEN pct >= 0.9 THEN 0.04 ELSE 0 END + 1e-9, 5) AS adjusted_score FROM q""",
    "goalie_metrics": """
WITH g AS (SELECT *, CASE WHEN goalie_minutes LIKE '%:%' THEN CAST(split_part(goalie_minutes, ':', 1) AS DOUBLE) + CAST(split_part(goalie_minutes, ':', 2) AS DOUBLE) / 60 ELSE TRY_CAST(goalie_minutes AS DOUBLE) END AS m FROM season_stat_lines
  WHERE save_percentage IS NOT NULL OR goals_against_average IS NOT NULL OR saves IS NOT NULL OR shots_against IS NOT NULL),
s AS (SELECT player_id, CAST(coalesce(sum(games), 0) AS BIGINT) AS games, coalesce(sum(m), 0) AS minutes, CAST(coalesce(sum(shots_against), 0) AS BIGINT) AS shots_against, CAST(coalesce(sum(saves), 0) AS BIGINT) AS saves,
  CAST(coalesce(sum(goals_against), 0) AS BIGINT) AS goals_against, CAST(coalesce(sum(shutouts), 0) AS BIGINT) AS shutouts,
  coalesce(sum(save_percentage * greatest(coalesce(games, 0), 1)) / sum(greatest(coalesce(games, 0), 1)) FILTER (save_percentage IS NOT NULL), 0) AS sv,
  coalesce(sum(goals_against_average * greatest(coalesce(games, 0), 1)) / sum(greatest(coalesce(games, 0), 1)) FILTER (goals_against_average IS NOT NULL), 0) AS gaa FROM g GROUP BY 1),
r AS (SELECT *, CASE WHEN shots_against > 0 THEN CAST(saves AS DOUBLE) / shots_against ELSE sv END AS a, CASE WHEN minutes > 0 THEN goals_against * 60 / minutes ELSE gaa END AS b FROM s)
SELECT player_id, games, round(minutes + 1e-9, 3) AS minutes, shots_against, saves, goals_against, shutouts, round(a + 1e-9, 6) AS save_percentage, round(b + 1e-9, 4) AS goals_against_average,
  round(CASE WHEN a = 0 AND b = 0 THEN 0.0 ELSE CASE WHEN a > 0 THEN greatest(0, least(1, (a - 0.88) / 0.05)) ELSE 0 END * 0.55 + CASE WHEN b > 0 THEN greatest(0, least(1, (3.5 - b) / 1.5)) ELSE 0 END * 0.3 + greatest(0, least(1, games / 35.0)) * 0.15 END + 1e-9, 5) AS quality_score FROM r""",
    "player_shares": f"""
SELECT player_id, CAST(sum(coalesce(games, 0)) AS BIGINT) AS games, count(DISTINCT league) AS leagues,
  round(coalesce(CAST(sum(coalesce(games, 0)) FILTER (adult_league) AS DOUBLE) / nullif(sum(coalesce(games, 0)), 0), 0) + 1e-9, 6) AS adult_share,
  round(coalesce(CAST(sum(coalesce(games, 0)) FILTER (NOT regular_season) AS DOUBLE) / nullif(sum(coalesce(games, 0)), 0), 0) + 1e-9, 6) AS playoff_share,
  round(coalesce(sum(coalesce(games, 0) * league_weight) / nullif(sum(coalesce(games, 0)), 0), 0) + 1e-9, 6) AS league_mean
FROM season_stat_lines LEFT JOIN {_LEAGUE_SQL} USING (league) GROUP BY 1""",
    "primary_line": "SELECT player_id, line_id, season, league FROM season_stat_lines WHERE timing = 'pre_draft' QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY coalesce(games, 0) DESC, line_id) = 1",
    "development_path": "SELECT player_id, league, min(season) AS first_season, max(season) AS last_season, CAST(sum(games) AS BIGINT) AS games FROM season_stat_lines WHERE timing <> 'pre_draft' GROUP BY 1, 2",
    "league_rollup": "SELECT league, season, count(*) AS lines, count(DISTINCT player_id) AS players, CAST(sum(games) AS BIGINT) AS games, count(*) FILTER (points IS NULL) AS no_points, round(coalesce(CAST(sum(points) AS DOUBLE) / nullif(sum(games) FILTER (points IS NOT NULL), 0), 0) + 1e-9, 6) AS ppg FROM season_stat_lines GROUP BY 1, 2",
    "bio_overlay": f"""
WITH o AS (SELECT {_KEY} AS k, min(handedness) AS h FROM ep_pdf_profiles GROUP BY 1 HAVING count(*) = 1)
SELECT player_id, coalesce(nullif(trim(handedness), ''), h) AS handedness FROM players p LEFT JOIN o ON o.k = {_KEY.replace('name', 'p.name')}""",
    "replaced_lines": """
SELECT line_id, player_id, season, source, games, points FROM season_stat_lines b WHERE source = 'league-feed'
  OR NOT EXISTS (SELECT 1 FROM season_stat_lines f WHERE f.source = 'league-feed' AND f.player_id = b.player_id AND f.season = b.season)""",
    "evidence_coverage": """
SELECT coalesce(a.player_id, b.player_id) AS player_id, CASE WHEN a.player_id IS NOT NULL AND b.player_id IS NOT NULL THEN 'covered' WHEN a.player_id IS NOT NULL THEN 'missing' ELSE 'external' END AS status
FROM (SELECT DISTINCT player_id FROM players) a FULL JOIN (SELECT DISTINCT player_id FROM season_stat_lines WHERE games > 0) b ON a.player_id = b.player_id""",
    "league_context": f"SELECT row_no, r.league, coalesce(adult_league, false) AS adult_league, coalesce(league_weight, 0.7) AS league_weight FROM russian_open_stats_2024 r LEFT JOIN (SELECT * FROM {_LEAGUE_SQL} WHERE league <> 'MKL') x ON x.league = r.league",
    "reconciled_lines": f"{_CLUBS} SELECT player_id, season, league, club, regular_season AS stage, count(*) AS row_count, {', '.join(_field(f) for f in ('games', 'goals', 'assists', 'points'))} FROM (SELECT *, {_PRIORITY} AS p FROM s) GROUP BY 1, 2, 3, 4, 5",
    "line_conflicts": _CLUBS + """,
g AS (SELECT player_id, season, league, club, regular_season, count(*) AS row_count, """ + ", ".join(f"min({f}) <> max({f}) AS x{f}" for f in ("games", "goals", "assists", "points")) + """ FROM s GROUP BY 1, 2, 3, 4, 5)
SELECT player_id, season, league, club, regular_season, row_count, concat_ws('; ', """ + ", ".join(f"CASE WHEN x{f} THEN '{f}' END" for f in ("games", "goals", "assists", "points")) + """) AS conflict_fields FROM g WHERE conflict_fields <> ''""",
    "repeated_lines": "SELECT board_row_id, board_id, player_id FROM board QUALIFY row_number() OVER (PARTITION BY board_id, player_id, draft_year, name, position, role_group, nationality, primary_league, consensus_rank, model_score, board_score, adjusted_ppg, role_rank, adult_game_share, evidence_depth, badges ORDER BY board_row_id) > 1",
    "season_totals": """
WITH k AS (SELECT * FROM season_stat_lines QUALIFY row_number() OVER (PARTITION BY player_id, season, league, regular_season ORDER BY games DESC NULLS LAST, line_id) = 1)
SELECT player_id, season, count(*) AS phases, CAST(sum(games) AS BIGINT) AS games, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(points) AS BIGINT) AS points FROM k GROUP BY 1, 2""",
    "ambiguous_names": "SELECT player_id, 'ambiguous_name' AS reason FROM (SELECT player_id, count(*) OVER (PARTITION BY lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g'))) AS n FROM players) WHERE n > 1",
    "rank_quality": """
WITH b AS (SELECT *, coalesce(consensus_rank <= 50, false) AS hit FROM board),
r AS (SELECT rank() OVER (ORDER BY model_score) + (count(*) OVER (PARTITION BY model_score) - 1) / 2.0 AS ra, rank() OVER (ORDER BY board_score) + (count(*) OVER (PARTITION BY board_score) - 1) / 2.0 AS rb FROM b WHERE model_score IS NOT NULL AND board_score IS NOT NULL),
t AS (SELECT hit FROM b WHERE board_score IS NOT NULL ORDER BY board_score DESC, board_row_id LIMIT 25)
SELECT (SELECT round(corr(ra, rb) + 1e-9, 6) FROM r) AS spearman, (SELECT count(*) FILTER (hit) FROM t) AS hits, (SELECT round(CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) + 1e-9, 6) FROM t) AS "precision", (SELECT round(avg(power(CAST(hit AS INTEGER) - model_score, 2)) + 1e-9, 6) FROM b) AS brier""",
    "board_ranks": f"""
WITH c AS (SELECT * FROM board QUALIFY {_LATEST}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY board_id ORDER BY board_score DESC NULLS LAST, player_id DESC) AS INTEGER) AS board_rank FROM c)
SELECT board_id, player_id, board_rank, board_rank - consensus_rank AS move, CASE WHEN board_rank - consensus_rank <= -8 THEN 'model_higher' WHEN board_rank - consensus_rank >= 8 THEN 'consensus_higher' WHEN consensus_rank IS NOT NULL THEN 'aligned' END AS disagreement FROM r""",
    "movement_by_role": f"""
WITH c AS (SELECT * FROM board QUALIFY {_LATEST}), r AS (SELECT board_id, player_id, row_number() OVER (PARTITION BY board_id ORDER BY board_score DESC NULLS LAST, player_id DESC) - consensus_rank AS move FROM c),
x AS (SELECT {_ROLE} AS role, CASE WHEN move <= -8 THEN 'model_higher' WHEN move >= 8 THEN 'consensus_higher' WHEN move IS NOT NULL THEN 'aligned' END AS disagreement, move FROM r JOIN players USING (player_id))
SELECT role, disagreement, count(*) AS players, round(avg(abs(move)) + 1e-9, 6) AS mean_move, CAST(max(abs(move)) AS INTEGER) AS largest_move FROM x GROUP BY 1, 2""",
    "blended_scores": """
WITH b AS (SELECT * FROM board WHERE NOT isnan(adjusted_ppg) AND consensus_rank IS NOT NULL AND model_score IS NOT NULL), m AS (SELECT max(round(adjusted_ppg, 3)) AS m FROM board WHERE NOT isnan(adjusted_ppg)),
s AS (SELECT board_row_id, model_score, CASE WHEN m > 0 THEN round(adjusted_ppg, 3) / m ELSE 0 END AS prod, greatest(0, least(1, 1 - (consensus_rank - 1) / 224.0)) AS cons FROM b, m)
SELECT board_row_id, round(greatest(0, least(1, cons * 0.5 + model_score * 0.3 + prod * 0.2)) + 1e-9, 6) AS hybrid FROM s""",
    "components": """
SELECT player_id, round(CASE WHEN height_cm IS NULL THEN NULL WHEN position = 'G' THEN greatest(0, least(1, (height_cm - 180) / 20.0)) * 0.8 + greatest(0, least(1, (weight_kg - 75) / 20.0)) * 0.2
  WHEN position = 'D' THEN greatest(0, least(1, (height_cm - 178) / 18.0)) * 0.7 + greatest(0, least(1, (weight_kg - 72) / 22.0)) * 0.3
  ELSE greatest(0, least(1, (height_cm - 172) / 18.0)) * 0.65 + greatest(0, least(1, (weight_kg - 68) / 20.0)) * 0.35 END + 1e-9, 6) AS size,
  CAST(CASE WHEN position = 'D' AND handedness = 'R' THEN 1.0 WHEN position = 'G' AND handedness <> '' THEN 0.55 WHEN handedness <> '' THEN 0.5 ELSE 0.35 END AS DOUBLE) AS hand,
  round(CASE WHEN age_at_draft IS NULL THEN NULL ELSE greatest(0, least(1, (18.9 - age_at_draft) / 1.4)) END + 1e-9, 6) AS age
FROM (SELECT * REPLACE (CASE WHEN height_cm BETWEEN 150 AND 220 AND weight_kg BETWEEN 50 AND 130 THEN height_cm END AS height_cm) FROM players)""",
    "projections": f"""
WITH b AS (SELECT player_id, consensus_rank, primary_league FROM board QUALIFY {_LATEST_PLAYER}),
t AS (SELECT player_id, sum(games) AS games, CAST(sum(points) AS DOUBLE) / nullif(sum(games), 0) AS ppg FROM season_stat_lines WHERE timing = 'pre_draft' GROUP BY 1),
i AS (SELECT b.player_id, coalesce(greatest(0, 18.5 - p.age_at_draft), 0) * 0.055 AS ab, least(1.0, coalesce(ppg, 0) * coalesce(league_weight, 0.9) / 1.25) AS prod, CASE WHEN height_cm >= 188 AND position <> 'G' THEN 0.04 ELSE 0 END AS sz, consensus_rank AS r, coalesce(games, 0) AS g, position AS pos, height_cm AS h,
  CASE position WHEN 'C' THEN 0.06 WHEN 'RHD' THEN 0.05 WHEN 'LHD' THEN 0.02 WHEN 'G' THEN -0.04 ELSE 0 END AS pp, CASE WHEN player_id IN (SELECT player_id FROM documents WHERE trim(text) <> '') THEN 0.08 ELSE 0 END AS txt
  FROM b JOIN players p USING (player_id) LEFT JOIN t USING (player_id) LEFT JOIN {_LEAGUE_SQL} ON lg.league = b.primary_league),
n AS (SELECT *, greatest(0, least(1, 0.14 + 0.38 * prod + coalesce(greatest(0, (80 - r) / 80.0), 0) * 0.32 + ab + sz + pp)) AS nhl FROM i),
x AS (SELECT *, greatest(0, least(1, 0.38 * nhl + 0.16 * prod - 0.003 * greatest(0, coalesce(r - 20, 0)))) AS imp, greatest(0, least(1, 1 - nhl + 0.006 * greatest(0, coalesce(r - 45, 0)))) AS bust FROM n)
SELECT player_id, round(nhl + 1e-9, 5) AS nhl_probability, round(imp + 1e-9, 5) AS impact_probability, round(bust + 1e-9, 5) AS bust_risk, round(7 * nhl + 5 * imp - 2 * bust + 1e-9, 5) AS expected_value, round(greatest(0, least(1, 0.45 + least(g, 60) / 180.0 + txt)) + 1e-9, 5) AS confidence,
  concat_ws(';', CASE WHEN prod >= 0.65 THEN 'production' END, CASE WHEN ab > 0.02 THEN 'young' END, CASE WHEN pp > 0 THEN 'position ' || pos END, CASE WHEN sz > 0 THEN 'frame' END, CASE WHEN r <= 25 THEN 'consensus' END) AS positives,
  concat_ws(';', CASE WHEN prod < 0.45 THEN 'production' END, CASE WHEN r > 40 THEN 'consensus' END, CASE WHEN h < 180 AND pos <> 'G' THEN 'size' END) AS risks FROM x""",
    "cv_folds": f"""
WITH b AS (SELECT player_id, lower(trim(role_group)) AS role FROM board QUALIFY {_LATEST_PLAYER})
SELECT player_id, role, CAST((row_number() OVER (PARTITION BY role ORDER BY player_id) - 1) % 5 AS INTEGER) AS fold FROM b""",
    "missing_by_column": "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL{' OR trim(' + c + ') = ' + chr(39) * 2 if k == 's' else ' OR isnan(' + c + ')' if k == 'd' else ''}) AS missing FROM players" for c, k in (("player_id", "s"), ("name", "s"), ("birth_date", "i"), ("nationality", "s"), ("position", "s"), ("handedness", "s"), ("height_cm", "i"), ("weight_kg", "i"), ("age_at_draft", "d"), ("source", "s"), ("source_id", "s"), ("source_url", "s"))),
    "integrity": """
WITH m AS (SELECT 'orphan_lines' AS metric, count(*) AS value FROM season_stat_lines WHERE player_id NOT IN (SELECT player_id FROM players)
  UNION ALL SELECT 'duplicate_players', count(*) - count(DISTINCT player_id) FROM players UNION ALL SELECT 'players', count(*) FROM players),
l AS (SELECT * FROM (VALUES ('orphan_lines', 0, 0), ('duplicate_players', 0, 0), ('players', 100, NULL), ('teams', 32, NULL)) AS t(metric, low, high))
SELECT metric, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, CAST(value AS BIGINT) AS value, CASE WHEN value IS NULL THEN 'missing' WHEN (low IS NULL OR value >= low) AND (high IS NULL OR value <= high) THEN 'pass' ELSE 'fail' END AS status FROM l LEFT JOIN m USING (metric)""",
    "digests": """
WITH m AS (SELECT md5(concat_ws(chr(31), """ + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted("player_id name birth_date nationality position handedness height_cm weight_kg age_at_draft source source_id source_url".split())) + """)) AS m FROM players),
s AS (SELECT count(*) AS n, coalesce(sum(CAST('0x' || m[1:15] AS BIGINT)), 0) AS a, coalesce(sum(CAST('0x' || m[16:30] AS BIGINT)), 0) AS b FROM m)
SELECT n AS n_rows, md5(n || ':' || a || ':' || b) AS digest FROM s""",
    "club_depth": f"""
WITH l AS (SELECT lower(regexp_replace(strip_accents(team), '[^A-Za-z0-9]', '', 'g')) AS club, player_id, games, {_ROLE} AS role, season FROM season_stat_lines JOIN players USING (player_id)),
g AS (SELECT * FROM (SELECT DISTINCT season, club FROM l) CROSS JOIN (SELECT DISTINCT role FROM l))
SELECT g.season, g.club, g.role, count(DISTINCT player_id) AS players, CAST(coalesce(sum(games), 0) AS BIGINT) AS games FROM g LEFT JOIN l ON l.season = g.season AND l.club = g.club AND l.role = g.role GROUP BY 1, 2, 3""",
    "document_tags": """
SELECT doc_id, CAST(CASE WHEN lower(text) LIKE '%speed%' THEN 2.0 ELSE 0 END + CASE WHEN lower(text) LIKE '%wrist shot%' THEN 1.5 ELSE 0 END + CASE WHEN lower(text) LIKE '%discipline%' THEN 1.0 ELSE 0 END - CASE WHEN lower(text) LIKE '%risk%' THEN 1.0 ELSE 0 END AS DOUBLE) AS score,
  concat_ws(';', CASE WHEN regexp_matches(lower(text), 'speed|edge work|mobility') THEN 'skating' END, CASE WHEN regexp_matches(lower(text), 'wrist shot|release') THEN 'scoring' END, CASE WHEN regexp_matches(lower(text), 'gap control|slot') THEN 'defending' END) AS tags FROM documents""",
    "typed_cells": """
SELECT row_no, CASE WHEN regexp_full_match(trim(games), '[+-]?[0-9]+') THEN CAST(trim(games) AS BIGINT) END AS games_strict,
  coalesce(CAST(trunc(CASE WHEN isnan(TRY_CAST(trim(goals) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(goals) AS DOUBLE) END) AS BIGINT), 0) AS goals_lenient, lower(trim(regular_season)) IN ('1', 'true', 'yes', 'y') AS regular,
  CASE WHEN regexp_matches(season, '[0-9]{4}\\s*[-–/]\\s*[0-9]{2,4}') THEN regexp_extract(season, '([0-9]{4})\\s*[-–/]', 1) || '-' || right(regexp_extract(season, '[0-9]{4}\\s*[-–/]\\s*([0-9]{2,4})', 1), 2) ELSE trim(season) END AS season_label, round(CASE WHEN goalie_minutes LIKE '%:%' THEN CAST(split_part(goalie_minutes, ':', 1) AS DOUBLE) + CAST(split_part(goalie_minutes, ':', 2) AS DOUBLE) / 60 ELSE TRY_CAST(trim(goalie_minutes) AS DOUBLE) END + 1e-9, 4) AS minutes FROM russian_open_stats_2024""",
    "name_keys": """
SELECT player_id, lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS name_key, lower(regexp_replace(strip_accents(name), '[^A-Za-z0-9]', '', 'g')) AS person_key,
  lower(strip_accents(name[1]) || strip_accents(list_last(string_split(trim(name), ' ')))) AS initial_key, trim(lower(regexp_replace(strip_accents(name), '[^A-Za-z0-9]+', '-', 'g')), '-') AS slug FROM players""",
    "set_operations": """
SELECT (SELECT count(*) FROM (SELECT DISTINCT player_id FROM season_stat_lines INTERSECT SELECT DISTINCT player_id FROM open_stats_matches WHERE matched = 'true')) AS in_both,
  (SELECT count(*) FROM (SELECT DISTINCT player_id FROM season_stat_lines EXCEPT SELECT DISTINCT player_id FROM open_stats_matches WHERE matched = 'true')) AS lines_only""",
    "identity_pairs": """
WITH k AS (SELECT player_id, lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS k1, regexp_replace(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9а-я]+', ' ', 'g')), '^(.).*?([^ ]*)$', '\\1\\2') AS k2, 'p' AS side FROM players
  UNION ALL SELECT player_id, lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')), regexp_replace(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9а-я]+', ' ', 'g')), '^(.).*?([^ ]*)$', '\\1\\2'), 'g' FROM ep_pdf_profiles),
a AS (SELECT min(player_id) FILTER (side = 'g') AS source_id, min(player_id) FILTER (side = 'p') AS base_id, 1 AS step FROM k GROUP BY k1 HAVING count(*) FILTER (side = 'g') = 1 AND count(*) FILTER (side = 'p') = 1
  UNION ALL SELECT min(player_id) FILTER (side = 'g'), min(player_id) FILTER (side = 'p'), 2 FROM k GROUP BY k2 HAVING count(*) FILTER (side = 'g') = 1 AND count(*) FILTER (side = 'p') = 1),
f AS (SELECT source_id, arg_min(base_id, (step, base_id)) AS base_id, min(step) AS step FROM a GROUP BY 1), o AS (SELECT arg_min(source_id, (step, source_id)) AS source_id, base_id, min(step) AS step FROM f GROUP BY base_id)
SELECT p.player_id AS source_id, o.base_id, CASE step WHEN 1 THEN 'exact' WHEN 2 THEN 'initial' END AS method FROM ep_pdf_profiles p LEFT JOIN o ON o.source_id = p.player_id""",
    "nested_lines": """
WITH f AS (SELECT player_id, league, min((season, line_id)) AS o FROM season_stat_lines GROUP BY 1, 2), g AS (SELECT player_id, string_agg(league, '; ' ORDER BY o) AS leagues FROM f GROUP BY 1), n AS (SELECT player_id, count(*) AS lines FROM season_stat_lines GROUP BY 1)
SELECT player_id, CAST(coalesce(lines, 0) AS INTEGER) AS lines, coalesce(leagues, '') AS leagues FROM players LEFT JOIN n USING (player_id) LEFT JOIN g USING (player_id)""",
    "current_clubs": "SELECT player_id, line_id, CASE WHEN loaded_at IS NULL THEN 'low' ELSE 'high' END AS confidence FROM season_stat_lines QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY loaded_at DESC NULLS LAST, games DESC NULLS LAST, line_id) = 1",
    "board_overlay": """
WITH o AS (SELECT player_id, count(*) AS boards FROM (SELECT DISTINCT board_id, player_id, draft_year FROM board WHERE board_id <> 'main-board') GROUP BY 1), m AS (SELECT DISTINCT player_id, draft_year FROM board WHERE board_id = 'main-board')
SELECT coalesce(o.player_id, m.player_id) AS player_id, boards, CASE WHEN o.player_id IS NULL THEN 'new' WHEN m.player_id IS NULL THEN 'dropped' ELSE 'matched' END AS status FROM o FULL JOIN m ON o.player_id = m.player_id""",
    "shared_names": """
WITH k AS (SELECT player_id, nationality AS o, birth_date AS b, lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM players WHERE nationality IS NOT NULL AND birth_date IS NOT NULL)
SELECT a.player_id, count(*) AS others FROM k a JOIN k c ON a.k = c.k AND a.o <> c.o AND abs(date_diff('day', a.b, c.b)) <= 7305 GROUP BY 1""",
    "age_bands": """
SELECT league, CASE WHEN age < 17 THEN 'u17' WHEN age < 18 THEN '17' WHEN age < 19 THEN '18' WHEN age < 21 THEN '19-20' WHEN age IS NOT NULL THEN '21+' END AS band, count(*) AS lines, CAST(sum(games) AS BIGINT) AS games,
  CAST(min(CASE WHEN games >= 50 THEN 0 WHEN games >= 20 THEN 1 ELSE 2 END) AS INTEGER) AS best_tier FROM season_stat_lines WHERE regular_season GROUP BY 1, 2""",
}
