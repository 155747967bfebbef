"""Rows that fail to parse: set apart with the reason while the valid rows load.

Structure (quoting, number of columns) is checked per record. Values are judged once per distinct value and column:
the distinct values are cast, those that fail form a dictionary of invalid values with reasons, and the dictionary is
joined back to the rows. The dictionary is broadcast only after it was counted; else the join is salted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..plans.runtime import join_checked, stage
from ..sources.tables import NULL_MARKS

# What a typed number may look like.
WHOLE = "^[0-9]+$"
DECIMAL = "^[0-9]+(?:\\.[0-9]+)?$"

_QUOTED_FIELD = '"(?:[^"]++|"")*+"'


@dataclass(frozen=True)
class Rule:
    """What a column's cells must look like: a pattern, and the type that they are then cast to."""

    column: str
    pattern: str
    sql_type: str


def record_text(line: Column) -> Column:
    """The record without a carriage return at its end; null is an empty record."""
    return F.regexp_replace(F.coalesce(line, F.lit("")), "\\r+\\z", "")


def structure_error(line: Column, columns: Column) -> Column:
    """``broken_quoting``, ``column_count`` or null for one comma-separated record that should have ``columns`` cells.

    All well-formed quoted cells are taken out; any quote that is left is a broken one, and the commas that are left
    are the separators. A record for which ``columns`` is null (an unknown layout) fails with column_count.
    """
    rest = F.regexp_replace(line, f"(^|,){_QUOTED_FIELD}(?=,|\\z)", "$1")
    count = F.length(rest) - F.length(F.replace(rest, F.lit(","), F.lit(""))) + 1
    return F.when(rest.contains('"'), F.lit("broken_quoting")).when(~F.coalesce(count == columns, F.lit(False)), F.lit("column_count"))


def record_cells(line: Column) -> Column:
    """Array of the cells of a well-formed record, unquoted."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f'\\G,({_QUOTED_FIELD}|[^,"]*+)'), F.lit(1))
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def filled(cell: Column) -> Column:
    """The cell without surrounding blanks; null if it is empty or a null mark."""
    text = blank_to_null(cell)
    return F.when(~F.lower(text).isin(*NULL_MARKS), text)


def invalid_values(values: DataFrame, rules: list[Rule]) -> DataFrame:
    """Dictionary (column_name, value, reason) of the distinct ``values`` (column_name, value) that fail their rule."""
    ok = F.lit(True)
    for rule in rules:
        good = F.col("value").rlike(rule.pattern) & F.col("value").try_cast(rule.sql_type).isNotNull()
        ok = F.when(F.col("column_name") == rule.column, good).otherwise(ok)
    distinct = values.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.lit(1).alias("seen"))
    return distinct.filter(~ok).select("column_name", "value", F.lit("invalid_value").alias("reason"))


def rejected_rows(rows: DataFrame, row_id: str, rules: list[Rule], structure: Column | None = None) -> DataFrame:
    """(row_id, reason, bad_columns) of the rows that fail; structural reasons (an expression on ``rows``) come first.

    Cells that are null, blank or a null mark are valid. Rows keep their multiplicity by row_id only: repeated ids
    give one row each id with its first reason. An empty table gives an empty result; further columns are not read.
    """
    shape = structure if structure is not None else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(r.column).alias("column_name"), filled(F.col(f"`{r.column}`")).alias("value")) for r in rules])
    flat = rows.select(F.col(f"`{row_id}`").alias("row_id"), shape.alias("shape"), cells.alias("cells"))
    values = flat.filter("shape is null").select("row_id", F.explode("cells").alias("c")).select("row_id", "c.*").filter("value is not null")
    dictionary = stage(invalid_values(values, rules))
    bad = join_checked(values, dictionary, ["column_name", "value"]).groupBy("row_id").agg(F.sort_array(F.collect_set("column_name")).alias("bad_columns"))
    bad = bad.select("row_id", F.lit("invalid_value").alias("reason"), "bad_columns")
    broken = flat.filter("shape is not null").select("row_id", F.col("shape").alias("reason"), F.array().cast("array<string>").alias("bad_columns"))
    return bad.unionByName(broken)


def load_valid(rows: DataFrame, row_id: str, rules: list[Rule], structure: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The valid rows with the ruled columns cast, and the rejected ones with their reason (see rejected_rows)."""
    rejected = stage(rejected_rows(rows, row_id, rules, structure))
    good = rows.join(rejected.select(F.col("row_id").alias(row_id)), row_id, "left_anti")
    return good.withColumns({r.column: filled(F.col(f"`{r.column}`")).try_cast(r.sql_type) for r in rules}), rejected
