"""Rows that fail to parse, packed fields, mixed units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bad_rows as bad
from ..operators import packed, units
from ..sources.tables import table

# The columns of a record of each layout, in order.
LAYOUTS = {
    "russian_open_stats_2024": "name season league team games goals assists points regular_season source source_id source_url goalie_minutes shots_against saves goals_against save_percentage goals_against_average wins losses ties shutouts".split(),
    "open_stats_matches": "player_id name matched source_name source source_id source_url league team games goals assists points regular_season".split(),
}
RULES = {
    "russian_open_stats_2024": [bad.Rule("games", bad.WHOLE, "bigint"), bad.Rule("goals_against_average", bad.DECIMAL, "double")],
    "open_stats_matches": [bad.Rule("points", bad.WHOLE, "bigint")],
}


def _raw_records(spark: SparkSession, d: str) -> DataFrame:
    """Records with ``shape`` (the structural reason) and the ruled cells of their layout."""
    line = bad.record_text(F.col("line_text"))
    raw = table(spark, d, "open_stats_raw").select("line_no", "layout", line.alias("line"))
    columns = F.create_map(*[x for k, v in LAYOUTS.items() for x in (F.lit(k), F.lit(len(v)))])
    raw = raw.withColumn("shape", bad.structure_error(F.col("line"), F.try_element_at(columns, F.col("layout"))))
    cells = raw.withColumn("cells", F.when(F.col("shape").isNull(), bad.record_cells(F.col("line"))))
    ruled: dict[str, list] = {}
    for layout, rules in RULES.items():
        for rule in rules:
            cell = F.when(F.col("layout") == layout, F.try_element_at("cells", F.lit(LAYOUTS[layout].index(rule.column) + 1)))
            ruled.setdefault(rule.column, []).append(cell)
    return cells.withColumns({name: F.coalesce(*found) for name, found in ruled.items()}).drop("cells", "line")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    every = [rule for rules in RULES.values() for rule in rules]
    parts = [("open_stats_raw", bad.rejected_rows(_raw_records(spark, d), "line_no", every, F.col("shape")))]
    parts += [(name, bad.rejected_rows(table(spark, d, name), key, RULES[name])) for name, key in (("russian_open_stats_2024", "row_no"), ("open_stats_matches", "match_row"))]
    out = None
    for name, part in parts:
        rows = part.select(F.lit(name).alias("table_name"), "row_id", "reason")
        out = rows if out is None else out.unionByName(rows)
    return out


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    good, _ = bad.load_valid(table(spark, d, "russian_open_stats_2024"), "row_no", RULES["russian_open_stats_2024"])
    return good.select("row_no", "games", "goals_against_average")


def p3_loaded_open_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every valid row of russian_open_stats_2024 with all its columns, the ruled ones cast."""
    return bad.load_valid(table(spark, d, "russian_open_stats_2024"), "row_no", RULES["russian_open_stats_2024"])[0]


def p3_loaded_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every valid row of open_stats_matches with all its columns, the ruled ones cast."""
    return bad.load_valid(table(spark, d, "open_stats_matches"), "match_row", RULES["open_stats_matches"])[0]


def _loaded_raw(spark: SparkSession, d: str, layout: str) -> DataFrame:
    """The valid records of one layout in open_stats_raw as rows of its columns, the ruled ones cast."""
    raw = table(spark, d, "open_stats_raw").filter(F.col("layout") == layout).select("line_no", bad.record_text(F.col("line_text")).alias("line"))
    whole = raw.filter(bad.structure_error(F.col("line"), F.lit(len(LAYOUTS[layout]))).isNull()).withColumn("cells", bad.record_cells(F.col("line")))
    rows = whole.select("line_no", *[F.try_element_at("cells", F.lit(i)).alias(c) for i, c in enumerate(LAYOUTS[layout], 1)])
    return bad.load_valid(rows, "line_no", RULES[layout])[0]


def p3_loaded_raw_open_stats(spark: SparkSession, d: str) -> DataFrame:
    return _loaded_raw(spark, d, "russian_open_stats_2024")


def p3_loaded_raw_matches(spark: SparkSession, d: str) -> DataFrame:
    return _loaded_raw(spark, d, "open_stats_matches")


PACKED = (("stat_reconciliation_audit", "audit_id", ["sources", "chosen_sources"]), ("board", "board_row_id", ["badges"]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key, fields in PACKED:
        rows = packed.split_packed(table(spark, d, name), key, fields).filter("items >= 2").select(F.lit(name).alias("table_name"), "row_id", "field_name", "item_no", "item_text")
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of one measure from all their tables share one dictionary and one pass."""
    players, profiles, open_stats = (table(spark, d, t) for t in ("players", "ep_pdf_profiles", "russian_open_stats_2024"))

    def cells(df: DataFrame, name: str, key: str, column: str, where=None) -> DataFrame:
        kept = df if where is None else df.filter(where)
        return kept.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.lit(column).alias("field_name"), F.col(column).cast("string").alias("cell")).filter("cell is not null")

    no_height = F.coalesce(F.trim("height_cm"), F.lit("")) == ""
    height = cells(players, "players", "player_id", "height_cm").unionByName(cells(profiles, "ep_pdf_profiles", "player_id", "height_cm")).unionByName(cells(profiles, "ep_pdf_profiles", "player_id", "height_text", no_height))
    weight = cells(players, "players", "player_id", "weight_kg").unionByName(cells(profiles, "ep_pdf_profiles", "player_id", "weight_kg"))
    share = cells(open_stats, "russian_open_stats_2024", "row_no", "save_percentage")
    out = None
    for rows, measure in ((height, units.HEIGHT), (weight, units.WEIGHT), (share, units.SHARE)):
        found = units.to_common_unit(rows, measure).filter(F.col("unit") != measure.unit).select("table_name", "row_key", "field_name", "tenths")
        out = found if out is None else out.unionByName(found)
    return out


_CELLS = """
rows AS (
  SELECT line_no AS row_id, layout, regexp_replace(coalesce(line_text, ''), '\\r+$', '') AS line FROM open_stats_raw),
shaped AS (
  SELECT *, CASE
    WHEN NOT regexp_full_match(line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') THEN 'broken_quoting'
    WHEN len(regexp_extract_all(',' || line, ',("([^"]|"")*"|[^",]*)')) <> CASE layout WHEN 'russian_open_stats_2024' THEN 22 WHEN 'open_stats_matches' THEN 14 ELSE -1 END THEN 'column_count' END AS shape,
    regexp_extract_all(',' || line, ',("([^"]|"")*"|[^",]*)', 1) AS c
  FROM rows),
cells AS (
  SELECT 'open_stats_raw' AS table_name, row_id, false AS dec, trim(c[CASE layout WHEN 'open_stats_matches' THEN 13 ELSE 5 END], '"') AS v FROM shaped WHERE shape IS NULL
  UNION ALL SELECT 'open_stats_raw', row_id, true, trim(c[18], '"') FROM shaped WHERE shape IS NULL AND layout = 'russian_open_stats_2024'
  UNION ALL SELECT 'russian_open_stats_2024', row_no, false, games FROM russian_open_stats_2024
  UNION ALL SELECT 'russian_open_stats_2024', row_no, true, goals_against_average FROM russian_open_stats_2024
  UNION ALL SELECT 'open_stats_matches', match_row, false, points FROM open_stats_matches)
"""
_BAD_CELL = """lower(trim(v)) NOT IN ('', 'n/a', 'na', '-', '—')
  AND NOT regexp_full_match(trim(v), CASE WHEN dec THEN '[0-9]+(\\.[0-9]+)?' ELSE '[0-9]+' END)"""

_ITEM = r"""(?:[;,|\t]| +[/+](?: |$))(?:[ ]*("(?:[^"\\]|\\.|"")*"|''(?:[^''\\]|\\.)*''|(?:[^;,|\t /+]|[/+][^ ;,|\t]| +[^;,|\t /+]| +[/+][^ ;,|\t])+))?"""


def packed_sql(cell: str) -> str:
    """SQL for the list of values in a packed cell with well-formed quotes."""
    item = "trim(CASE WHEN x LIKE '\"%\"' THEN replace(x[2:-2], '\"\"', '\"') WHEN x LIKE '''%''' THEN x[2:-2] ELSE x END)"
    listed = f"regexp_extract_all(';' || {cell}, '{_ITEM}', 1)"
    return f"""list_filter(CASE WHEN trim({cell}) LIKE '[%]' THEN from_json(trim({cell}), '["VARCHAR"]') ELSE list_transform(list_transform({listed}, lambda x: trim(x)), lambda x: {item}) END, lambda x: trim(x) <> '')"""


def _height_sql(cell: str) -> str:
    n = f"TRY_CAST(replace(regexp_extract({cell}, '[0-9]+([.,][0-9]+)?'), ',', '.') AS DECIMAL(20,6))"
    n2 = f"TRY_CAST(regexp_extract({cell}, '[0-9]+[^0-9]+([0-9]+)', 1) AS DECIMAL(20,6))"
    return f"""CASE
    WHEN regexp_matches({cell}, 'mm') THEN {n} * 1
    WHEN regexp_matches({cell}, 'cm') THEN NULL
    WHEN regexp_matches({cell}, '^[0-9]m[0-9]+$') THEN {n} * 1000 + {n2} * 10
    WHEN regexp_matches({cell}, 'm') THEN {n} * 1000
    WHEN regexp_matches({cell}, 'f|^[0-9]-|[0-9][''′]') THEN ({n} * 12 + {n2}) * 25.4
    WHEN regexp_matches({cell}, 'in|"') THEN {n} * 25.4
    WHEN {n} < 3 THEN {n} * 1000 WHEN {n} < 100 THEN {n} * 25.4 WHEN {n} > 1000 THEN {n} END"""


def _weight_sql(cell: str) -> str:
    n = f"TRY_CAST(replace(regexp_extract({cell}, '[0-9]+([.,][0-9]+)?'), ',', '.') AS DECIMAL(20,6))"
    n2 = f"TRY_CAST(regexp_extract({cell}, '[0-9]+[^0-9]+([0-9]+)', 1) AS DECIMAL(20,6))"
    return f"""CASE
    WHEN regexp_matches({cell}, 'k') THEN NULL
    WHEN regexp_matches({cell}, 'st') THEN ({n} * 14 + {n2}) * CAST(4.5359237 AS DECIMAL(10,7))
    WHEN regexp_matches({cell}, 'lb|pound') OR ({n} BETWEEN 136 AND 400) THEN {n} * CAST(4.5359237 AS DECIMAL(10,7))
    WHEN {n} > 1000 THEN {n} * 0.01 END"""


_SHARE = """CASE
    WHEN regexp_matches(save_percentage, '^ *0?[.,]') THEN NULL
    ELSE TRY_CAST(replace(regexp_extract(save_percentage, '[0-9]+([.,][0-9]+)?'), ',', '.') AS DECIMAL(20,6)) * CASE WHEN regexp_matches(save_percentage, '^[0-9]{3}( *‰)?$') THEN 1 ELSE 10 END END"""

QUERIES = {"p3_found": p3_found, "p3_loaded": p3_loaded, "p3_loaded_open_stats": p3_loaded_open_stats, "p3_loaded_matches": p3_loaded_matches, "p3_loaded_raw_open_stats": p3_loaded_raw_open_stats, "p3_loaded_raw_matches": p3_loaded_raw_matches, "p4_found": p4_found, "p5_found": p5_found}
SQL = {
    "p3_found": f"""
WITH {_CELLS}
SELECT 'open_stats_raw' AS table_name, row_id, shape AS reason FROM shaped WHERE shape IS NOT NULL
UNION ALL
SELECT DISTINCT table_name, row_id, 'invalid_value' FROM cells WHERE {_BAD_CELL}""",
    "p3_loaded": f"""
WITH {_CELLS}
SELECT row_no,
  CASE WHEN lower(trim(games)) NOT IN ('', 'n/a', 'na', '-', '—') THEN CAST(trim(games) AS BIGINT) END AS games,
  CASE WHEN lower(trim(goals_against_average)) NOT IN ('', 'n/a', 'na', '-', '—') THEN CAST(trim(goals_against_average) AS DOUBLE) END AS goals_against_average
FROM russian_open_stats_2024 WHERE row_no NOT IN (SELECT row_id FROM cells WHERE table_name = 'russian_open_stats_2024' AND {_BAD_CELL})""",
    "p4_found": "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS table_name, {k} AS row_id, '{f}' AS field_name, CAST(i AS INTEGER) AS item_no, items[i] AS item_text
FROM (SELECT {k}, items, unnest(range(1, len(items) + 1)) AS i FROM (SELECT {k}, {packed_sql(f)} AS items FROM {t}) WHERE len(items) >= 2)"""
        for t, k, fields in PACKED
        for f in fields
    ),
    "p5_found": f"""
SELECT * FROM (
SELECT 'players' AS table_name, player_id AS row_key, 'height_cm' AS field_name, CAST(round({_height_sql("CAST(height_cm AS VARCHAR)")}) AS INTEGER) AS tenths FROM players
UNION ALL SELECT 'players', player_id, 'weight_kg', CAST(round({_weight_sql("CAST(weight_kg AS VARCHAR)")}) AS INTEGER) FROM players
UNION ALL SELECT 'ep_pdf_profiles', player_id, 'height_cm', CAST(round({_height_sql("height_cm")}) AS INTEGER) FROM ep_pdf_profiles
UNION ALL SELECT 'ep_pdf_profiles', player_id, 'height_text', CAST(round({_height_sql("replace(height_text, 'listed', '')")}) AS INTEGER) FROM ep_pdf_profiles WHERE height_cm IS NULL
UNION ALL SELECT 'ep_pdf_profiles', player_id, 'weight_kg', CAST(round({_weight_sql("weight_kg")}) AS INTEGER) FROM ep_pdf_profiles
UNION ALL SELECT 'russian_open_stats_2024', CAST(row_no AS VARCHAR), 'save_percentage', CAST(round({_SHARE}) AS INTEGER) FROM russian_open_stats_2024)
WHERE tenths IS NOT NULL""",
}
