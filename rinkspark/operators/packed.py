"""Fields that pack several values: a parsing expression grammar, run by the JVM.

The grammar, first alternative that fits wins (possessive repetition = no way back into an alternative):

    cell    <- bracketed / list
    bracketed <- '[' JSON strings ']'            (a broken one is read as a list without its brackets)
    list    <- item (sep item)*
    item    <- blank* (quoted / loose / bare) blank* &(sep / end)
    quoted  <- '"' ([^"\\] / '\\' . / '""')* '"'   and the same with single quotes
    loose   <- a quote up to the first same quote before a separator (stray quotes inside; an error)
    bare    <- (!sep .)*                         (a quote that never closes ends up here; an error)
    sep     <- ';' / ',' / '|' / tab / ' / ' / ' + '

Java's possessive quantifiers give exactly the committed choice of such a grammar, and need no stack for long cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "(?:[;,|\\t]|(?<=\\s)[/+](?=\\s|$))"
_END = f"(?=\\s*(?:{SEPARATOR}|$))"
_QUOTED = '"(?:[^"\\\\]++|\\\\.|"")*+"' + _END + "|" + "'(?:[^'\\\\]++|\\\\.|'')*+'" + _END
_LOOSE = "|".join(f"{q}(?:(?!{q}\\s*(?:{SEPARATOR}|$))(?!{SEPARATOR})[\\s\\S])*+{q}" + _END for q in ('"', "'"))
_BARE = f"(?:(?!{SEPARATOR})[\\s\\S])*+"
ITEM = f"\\G{SEPARATOR}(?:(?!{SEPARATOR})\\s)*+((?:{_QUOTED})|(?:{_LOOSE})|(?:{_BARE}))\\s*?(?={SEPARATOR}|$)"
ITEM_TYPE = "array<struct<text:string,error:boolean>>"


def _item(raw: Column) -> Column:
    """Struct of the value without quotes and whether its quoting was broken."""
    text = F.regexp_replace(raw, "(?U)^\\s+|\\s+$", "")
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    double = text.rlike('^"(?:[^"\\\\]++|\\\\.|"")*+"$')
    single = text.rlike("^'(?:[^'\\\\]++|\\\\.|'')*+'$")
    loose = text.rlike('^(?:"[\\s\\S]*"|\'[\\s\\S]*\')$') & (F.length(text) >= 2)
    value = (
        F.when(double, F.regexp_replace(F.regexp_replace(inner, '""', '"'), '\\\\(["\\\\])', "$1"))
        .when(single, F.regexp_replace(F.regexp_replace(inner, "''", "'"), "\\\\(['\\\\])", "$1"))
        .when(loose, inner)
        .otherwise(text)
    )
    broken = ~double & ~single & (loose | text.rlike("^[\"']") | text.contains('"'))
    return F.struct(F.regexp_replace(value, "(?U)^\\s+|\\s+$", "").alias("text"), broken.alias("error"))


def parse_packed(cell: Column) -> Column:
    """Array of (text, error) for the values in ``cell``, in order, without empty places; null gives no value."""
    cell = F.coalesce(cell.cast("string"), F.lit(""))
    bare = F.regexp_replace(cell, "(?U)^\\s+|\\s+$", "")
    bracketed = bare.startswith("[") & bare.endswith("]")
    json = F.when(bracketed, F.from_json(bare, "array<string>"))
    ours = F.when(bracketed, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(cell)
    listed = F.transform(F.regexp_extract_all(F.concat(F.lit(";"), ours), F.lit(ITEM), F.lit(1)), _item)
    read = F.transform(json, lambda x: F.struct(F.regexp_replace(x, "(?U)^\\s+|\\s+$", "").alias("text"), F.lit(False).alias("error")))
    return F.filter(F.coalesce(read, listed).cast(ITEM_TYPE), lambda x: x["text"] != "")


def packed_values(cell: Column) -> Column:
    """The values alone, as an array of strings."""
    return F.transform(parse_packed(cell), lambda x: x["text"])


def split_packed(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """One row per value of the packed ``fields``: row_id, field_name, item_no (from 1), item_text, item_error, items.

    ``items`` is the number of values in the cell. Nulls, blank cells and cells of separators give no row; repeated
    values stay; a broken quote never swallows the rest of a cell, its item is kept with item_error true. Works row
    by row without a shuffle, so neither hot values nor skew matter; other columns of ``df`` are not read.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), parse_packed(F.col(f"`{f}`")).alias("parsed")) for f in fields])
    rows = df.select(F.col(f"`{row_id}`").alias("row_id"), F.explode(cells).alias("c"))
    rows = rows.select("row_id", "c.field_name", F.size("c.parsed").alias("items"), F.posexplode("c.parsed").alias("at", "item"))
    return rows.select("row_id", "field_name", (F.col("at") + 1).cast("int").alias("item_no"), F.col("item.text").alias("item_text"), F.col("item.error").alias("item_error"), "items")
