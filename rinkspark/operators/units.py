"""Quantities recorded in different units, brought to one unit.

A cell is reduced to its numbers and a spelling: the cell with each number replaced by ``#``. Only the distinct unit
words of the spellings are looked up: character bigrams of known aliases form an inverted index, aliases that share
enough bigrams are verified with a weighted edit distance, and the resulting alias dictionary (unit word -> unit) is
joined to all rows. Numbers without a unit are judged by their size, one range per unit and measure.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold
from ..plans.runtime import join_checked, stage

# Exact size of each unit in tenths of the common unit (centimetre, kilogram, percent).
TENTHS = {
    "cm": "10", "mm": "1", "m": "1000", "in": "25.4", "ft": "304.8",
    "kg": "10", "g": "0.01", "lb": "4.5359237", "st": "63.5029318",
    "%": "10", "permille": "1", "fraction": "1000",
}

# Spellings of each unit.
ALIASES = {
    "cm": ("cm", "cms", "centimeter", "centimeters", "centimetre", "centimetres"),
    "mm": ("mm", "millimeter", "millimeters", "millimetre", "millimetres"),
    "m": ("m", "meter", "meters", "metre", "metres"),
    "in": ("in", "ins", "inch", "inches", '"', "″", "''", "”", "′′"),
    "ft": ("ft", "foot", "feet", "'", "′", "’"),
    "kg": ("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms"),
    "g": ("g", "gr", "gram", "grams", "gramme", "grammes"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "st": ("st", "stone", "stones"),
    "%": ("%", "pct", "percent", "percentage"),
    "permille": ("‰", "permille", "permil"),
}
# The smaller unit that a second bare number is in.
SUBUNIT = {"ft": "in", "st": "lb", "m": "cm"}


@dataclass(frozen=True)
class Measure:
    """A measured quantity: its common unit, its other units, and (low, high, unit) for numbers without a unit."""

    unit: str
    units: tuple[str, ...]
    bare: tuple[tuple[float, float, str], ...]


# What an adult's height and weight and a save percentage can be in each unit.
HEIGHT = Measure("cm", ("cm", "mm", "m", "in", "ft"), ((1.2, 2.6, "m"), (4.0, 8.0, "ft"), (45.0, 100.0, "in"), (120.0, 260.0, "cm"), (1200.0, 2600.0, "mm")))
WEIGHT = Measure("kg", ("kg", "g", "lb", "st"), ((40.0, 135.0, "kg"), (135.0, 400.0, "lb"), (40000.0, 200000.0, "g")))
SHARE = Measure("fraction", ("%", "permille"), ((0.0, 1.0, "fraction"), (1.0, 100.0, "%"), (100.0, 1000.0, "permille")))

NUMBER = "[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+"
#: Share of an alias's bigrams that a unit word must have, and the weighted distance allowed per letter.
MIN_SHARED, MAX_DISTANCE = 0.5, 0.3


def numbers(cell: Column) -> Column:
    """The numbers in a cell, as decimals, comma or point before the fraction."""
    found = F.regexp_extract_all(cell, F.lit(f"({NUMBER})"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("decimal(20,6)"))


def unit_words(cell: Column) -> Column:
    """The word after each number, folded, '' where none follows; ``-`` between two numbers is kept."""
    plain = F.regexp_replace(fold(cell), NUMBER, "#")
    after = F.regexp_extract_all(plain, F.lit("#\\s*([^#]*)"), F.lit(1))
    return F.transform(after, lambda x: F.regexp_extract(F.regexp_replace(x, "\\.$|\\.(?=\\s)", ""), "^([\\p{L}]+|[^\\p{L}\\s]+)?", 1))


def grams(word: Column) -> Column:
    """Distinct character bigrams of a padded word."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def weighted_distance(a: str, b: str) -> float:
    """Edit distance per letter of the longer word; vowels and doubled letters are cheap, swaps cost one."""
    def cost(word: str, i: int) -> float:
        return 0.5 if word[i] in "aeiouy" or i and word[i] == word[i - 1] else 1.0

    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        rows[i][0] = rows[i - 1][0] + cost(a, i - 1)
    for j in range(1, len(b) + 1):
        rows[0][j] = rows[0][j - 1] + cost(b, j - 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            swap = 0.0 if a[i - 1] == b[j - 1] else max(cost(a, i - 1), cost(b, j - 1))
            best = min(rows[i - 1][j] + cost(a, i - 1), rows[i][j - 1] + cost(b, j - 1), rows[i - 1][j - 1] + swap)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 1.0)
            rows[i][j] = best
    return rows[-1][-1] / max(1, len(a), len(b))


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)], dtype="float64")


def alias_dictionary(words: DataFrame, units: tuple[str, ...]) -> DataFrame:
    """(word, unit) for the distinct ``words`` that spell one of ``units``; a misspelt word goes to its nearest alias.

    Words of one or two characters must equal an alias: no edit leaves them recognisable.
    """
    spark = words.sparkSession
    known = spark.createDataFrame([(a, u) for u in units for a in ALIASES[u]], "alias string, unit string")  # bounded: the fixed list above
    index = known.withColumn("gram", F.explode(grams(F.col("alias")))).withColumn("alias_grams", F.size(grams(F.col("alias"))))
    distinct = words.select("word").filter("word <> ''").groupBy("word").agg(F.lit(1).alias("seen"))
    hits = distinct.select("word", F.explode(grams(F.col("word"))).alias("gram")).join(F.broadcast(index), "gram")
    near = hits.groupBy("word", "alias", "unit", "alias_grams").agg(F.count("*").alias("shared")).filter(F.col("shared") >= MIN_SHARED * F.col("alias_grams"))
    exact = F.col("word") == F.col("alias")
    long_enough = (F.length("word") >= 3) & (F.length("alias") >= 3)
    checked = near.filter(exact | long_enough).withColumn("distance", F.when(exact, F.lit(0.0)).otherwise(_distance("word", "alias")))
    best = checked.filter(F.col("distance") <= MAX_DISTANCE).groupBy("word").agg(F.min(F.struct("distance", "unit")).alias("best"))
    return best.select("word", F.col("best.unit").alias("unit"))


def _tenths(measure: Measure) -> Column:
    """Tenths of the common unit from ``__nums`` and ``__u1``, ``__u2`` (units, or null)."""
    first, second = F.try_element_at("__nums", F.lit(1)), F.try_element_at("__nums", F.lit(2))
    size = F.lit(None).cast("string")
    for low, high, unit in reversed(measure.bare):
        size = F.when((first >= low) & (first <= high), F.lit(unit)).otherwise(size)
    dashed = (F.col("__w1") == "-") & second.isNotNull() & F.lit("ft" in measure.units)
    unit1 = F.when(dashed, F.lit("ft")).when(F.col("__w1") == "", size).otherwise(F.col("__u1"))
    sub = F.create_map(*[F.lit(x) for pair in SUBUNIT.items() for x in pair])
    unit2 = F.coalesce(F.col("__u2"), F.try_element_at(sub, unit1))
    scale = F.create_map(*[x for unit, factor in TENTHS.items() for x in (F.lit(unit), F.lit(factor).cast("decimal(20,10)"))])
    total = first * F.try_element_at(scale, unit1) + F.when(second.isNotNull(), second * F.try_element_at(scale, unit2)).otherwise(F.lit(0))
    return F.struct(unit1.alias("unit"), F.round(total, 0).try_cast("int").alias("tenths"))


def to_common_unit(cells: DataFrame, measure: Measure) -> DataFrame:
    """``cells`` (any columns, one of them ``cell``, a string) with ``unit`` as recorded and ``tenths`` of the common unit.

    Columns called unit and tenths are replaced; repeated rows stay; an empty table stays empty.

    tenths is null for a null, blank or unreadable cell, a unit of another measure, or more than two numbers; then
    unit is null too. Distances are exact, rounded half up. The alias dictionary is counted before it is broadcast;
    the join on unit words is salted beyond that, so a word that every row has is no hot key.
    """
    parsed = cells.drop("unit", "tenths").withColumns({"__nums": numbers(F.col("cell")), "__words": unit_words(F.col("cell"))})
    w1, w2 = F.coalesce(F.try_element_at("__words", F.lit(1)), F.lit("")), F.coalesce(F.try_element_at("__words", F.lit(2)), F.lit(""))
    parsed = parsed.withColumns({"__w1": w1, "__w2": w2}).drop("__words")
    words = parsed.select(F.explode(F.array("__w1", "__w2")).alias("word"))
    dictionary = stage(alias_dictionary(words, measure.units))
    for n in ("1", "2"):
        parsed = join_checked(parsed, dictionary.select(F.col("word").alias(f"__w{n}"), F.col("unit").alias(f"__u{n}")), f"__w{n}", "left")
    done = parsed.withColumn("__r", F.when(F.size("__nums").between(1, 2), _tenths(measure)))
    readable = F.col("__r.tenths").isNotNull()
    return done.withColumns({"unit": F.when(readable, F.col("__r.unit")), "tenths": F.col("__r.tenths")}).drop("__nums", "__w1", "__w2", "__u1", "__u2", "__r")
