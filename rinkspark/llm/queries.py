"""The queries of this folder's operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import packed_values
from ..queries.cleaning import packed_sql
from ..sources.tables import table
from . import leakage as s8
from . import mixing as s9
from . import names as s2
from . import persons as s6
from . import survivorship as s1
from . import topn as s7
from . import truncation as s10

LINE_FIELDS = ("games", "goals", "assists", "points", "age", "shots_against", "saves", "goals_against", "save_percentage", "goals_against_average", "wins", "losses", "ties", "shutouts")
AUDIT_FIELDS = ("sources", "conflict_fields", "chosen_sources")
SEASON_KEYS = ("player_id", "season", "league", "regular_season", "club")


def _line_survivors(spark: SparkSession, d: str, values: bool) -> tuple[DataFrame, s1.Survivorship]:
    spec = s1.Survivorship(SEASON_KEYS, "line_id", "loaded_at", LINE_FIELDS, "trust_level", "source")
    trust = table(spark, d, "source_trust").groupBy("source").agg(F.max("trust_level").alias("trust_level"))
    rows = table(spark, d, "season_stat_lines").drop("timing", "source_id", "source_url", "goalie_minutes")
    trusted = lambda df: s1.join_checked(df, trust, "source", "left")
    lines = s1.with_club(trusted(rows), table(spark, d, "team_aliases"))
    return s1.survive(lines, spec, values, trusted(rows.select("line_id", "source", "loaded_at"))), spec


def _audit_survivors(spark: SparkSession, d: str, values: bool) -> tuple[DataFrame, s1.Survivorship]:
    same = {f: F.nullif(F.to_json(packed_values(F.col(f))), F.lit("[]")) for f in AUDIT_FIELDS}
    spec = s1.Survivorship(SEASON_KEYS, "audit_id", "run_at", AUDIT_FIELDS, compare=same)
    rows = table(spark, d, "stat_reconciliation_audit").drop("row_count", "action")
    return s1.survive(s1.with_club(rows, table(spark, d, "team_aliases")), spec, values, rows.select("audit_id", "run_at")), spec


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    lines, line_spec = _line_survivors(spark, d, False)
    runs, run_spec = _audit_survivors(spark, d, False)
    return s1.conflict_cases(lines, line_spec, "season_stat_lines").unionByName(s1.conflict_cases(runs, run_spec, "stat_reconciliation_audit"))


def p1_golden_lines(spark: SparkSession, d: str) -> DataFrame:
    return s1.golden_records(*_line_survivors(spark, d, True))


NAME_CELLS = (("russian_open_stats_2024", "row_no", "name"), ("ep_pdf_match_audit", "match_row", "source_name"), ("ep_pdf_match_audit", "match_row", "base_name"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Spelling -> registered name by the trie join; of namesakes the one with a line for the row's club.

    A cell without a club, or whose club names none of them, goes to the namesake with the smallest player_id.
    """
    aliases, players = table(spark, d, "team_aliases"), table(spark, d, "players").select("player_id", "name")
    cells = None
    for t, key, column in NAME_CELLS:
        rows = table(spark, d, t)
        rows = s1.with_club(rows.select(key, column, "league", "team"), aliases) if "team" in rows.columns else rows.withColumn("club", F.lit(None).cast("string"))
        part = rows.select(F.lit(f"{t}.{column}").alias("field_name"), F.col(key).alias("row_id"), F.col(column).alias("spelling"), "club").filter("spelling is not null")
        cells = part if cells is None else cells.unionByName(part)

    links = s2.stage(s2.link_spellings(cells.select("spelling"), players, "spelling"))
    people = s2.person_keys(players).join(links.select("first", "last").distinct(), ["first", "last"])
    people = s2.stage(people)
    lines = s1.with_club(table(spark, d, "season_stat_lines").select("player_id", "league", "team").distinct(), aliases)
    namesakes = links.join(people, ["first", "last"]).select("spelling", "player_id")
    several = namesakes.groupBy("spelling").agg(F.count("*").alias("n"), F.min("player_id").alias("any_player"))
    by_club = namesakes.join(several.filter("n > 1").select("spelling"), "spelling").join(lines.select("player_id", "club").distinct(), "player_id")
    by_club = s2.stage(by_club.groupBy("spelling", "club").agg(F.min("player_id").alias("club_player")))
    tied = s2.join_checked(s2.join_checked(cells, several, "spelling"), by_club, ["spelling", "club"], "left")
    return tied.select("field_name", "row_id", F.coalesce("club_player", "any_player").alias("player_id")).distinct()


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return s6.match_profiles(table(spark, d, "players"), table(spark, d, "ep_pdf_profiles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_scores(spark, d).select("player_id", "source_player_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "board").select("board_id", "player_id", F.lower(F.trim("role_group")).alias("role_group"), "adjusted_ppg", "loaded_at", "board_row_id")
    current = s7.stage(s7.latest(rows, ["board_id", "player_id"], "loaded_at", "board_row_id"))
    return s7.top_n(current, ["board_id", "role_group"], "adjusted_ppg", ["player_id"], 3, "role_rank").select("board_id", "role_group", "role_rank", "player_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = s8.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.filter(F.col("words") >= s8.WINDOW).select("doc_id", "item_id").distinct()


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return s8.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("errors > 0")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return s9.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return s9.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return s10.cut_texts(table(spark, d, "documents")).filter("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return s10.truncation_rates(s10.cut_texts(table(spark, d, "documents"), keep=("source",)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_golden_lines": p1_golden_lines,
    "p2_found": p2_found,
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

_CLUB = "lower(regexp_replace(strip_accents({}), '[^A-Za-z0-9]', '', 'g'))"
_GROUPED = f"""
WITH al AS (SELECT league, {_CLUB.format('code')} AS k, min({_CLUB.format('team')}) AS t FROM team_aliases GROUP BY 1, 2),
l AS (SELECT s.*, coalesce(al.t, {_CLUB.format('s.team')}) AS club, coalesce(trust_level, -1) AS tr FROM season_stat_lines s
  LEFT JOIN al ON al.league = s.league AND al.k = {_CLUB.format('s.team')} LEFT JOIN source_trust x ON x.source = s.source),
r AS (SELECT s.audit_id, s.run_at, s.player_id, s.season, s.league, s.regular_season, coalesce(al.t, {_CLUB.format('s.team')}) AS club,
  {', '.join(f"nullif(CAST(to_json({packed_sql('s.' + f)}) AS VARCHAR), '[]') AS {f}" for f in AUDIT_FIELDS)}
  FROM stat_reconciliation_audit s LEFT JOIN al ON al.league = s.league AND al.k = {_CLUB.format('s.team')})"""


def _cases_sql(name: str, rows: str, row_id: str, order: str, f: str) -> str:
    return f"""SELECT '{name}' AS table_name, min({row_id}) AS group_id, '{f}' AS field_name, arg_max({row_id}, ({order}, -{row_id})) FILTER ({f} IS NOT NULL) AS chosen_id
FROM {rows} GROUP BY player_id, season, league, regular_season, club HAVING count(*) >= 2 AND count({f}) > 0 AND (count({f}) < count(*) OR min({f}) <> max({f}))"""


_CASES = [_cases_sql("season_stat_lines", "l", "line_id", "tr, loaded_at", f) for f in LINE_FIELDS] + [_cases_sql("stat_reconciliation_audit", "r", "audit_id", "run_at", f) for f in AUDIT_FIELDS]

def _golden_sql() -> str:
    best = lambda v, f: f"arg_max({v}, (tr, loaded_at, -line_id)) FILTER ({f} IS NOT NULL)"
    differ = lambda f: f"count({f}) > 0 AND (count({f}) < count(*) OR min({f}) <> max({f}))"
    return f"""SELECT player_id, season, league, regular_season, club, min(line_id) AS group_id, count(*) AS row_count, {', '.join(f"{best(f, f)} AS {f}" for f in LINE_FIELDS)},
  coalesce(string_agg(DISTINCT source, '; ' ORDER BY source), '') AS sources, concat_ws('; ', {', '.join(f"CASE WHEN {differ(f)} THEN '{f}' END" for f in LINE_FIELDS)}) AS conflict_fields,
  concat_ws('; ', {', '.join(f"CASE WHEN count({f}) > 0 THEN '{f}:' || {best('source', f)} END" for f in LINE_FIELDS)}) AS chosen_sources
FROM l WHERE player_id IS NOT NULL AND season IS NOT NULL AND league IS NOT NULL AND regular_season IS NOT NULL AND club IS NOT NULL GROUP BY 1, 2, 3, 4, 5"""


SQL: dict[str, str] = {
    "p1_found": _GROUPED + "\n" + "\nUNION ALL\n".join(_CASES),
    "p1_golden_lines": _GROUPED + "\n" + _golden_sql(),
    "p7_found": """
WITH cur AS (
  SELECT *, lower(trim(role_group)) AS rg,
         row_number() OVER (PARTITION BY board_id, player_id ORDER BY loaded_at DESC, board_row_id DESC) AS k
  FROM board),
ranked AS (
  SELECT board_id, rg AS role_group, player_id,
         row_number() OVER (PARTITION BY board_id, rg ORDER BY adjusted_ppg DESC, player_id) AS r
  FROM cur WHERE k = 1 AND adjusted_ppg IS NOT NULL AND NOT isnan(adjusted_ppg))
SELECT board_id, role_group, CAST(r AS INTEGER) AS role_rank, player_id FROM ranked WHERE r <= 3
""",
}
