"""Scalar expressions: name keys, typed cells, dates, rates, text features. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import NULL_MARKS
from .text import alnum_key, blank_to_null, fold

# Given names that stand for the same person.
GIVEN_NAMES = {"egor": "yegor", "jack": "john", "jake": "jacob", "jc": "jeanchristophe", "mitch": "mitchell", "nick": "nicholas", "tony": "anthony", "will": "william"}
# Cyrillic letters in Latin spelling.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Suffixes of names.
NAME_SUFFIX = "(?i)[\\s,]+(?:jr|sr|ii|iii|iv|v)\\.?$"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


# ---- names and text keys


def name_key(name: Column) -> Column:
    """Lower-case letters and digits, accents kept."""
    return F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]", "")


def person_key(name: Column) -> Column:
    """Letters and digits without case and accents, name suffixes dropped."""
    return alnum_key(F.regexp_replace(name, NAME_SUFFIX, ""))


def person_alias_key(name: Column) -> Column:
    """The canonical given name and the last token."""
    parts = F.split(F.trim(F.regexp_replace(fold(F.regexp_replace(name, NAME_SUFFIX, "")), "[^\\p{L}\\p{N}]+", " ")), " ")
    first = F.coalesce(F.try_element_at(literal_map(GIVEN_NAMES), F.element_at(parts, 1)), F.element_at(parts, 1))
    return F.concat(first, F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("")))


def initial_surname_key(name: Column) -> Column:
    """First initial and last token, folded."""
    parts = F.split(F.trim(F.regexp_replace(fold(name), "[^\\p{L}\\p{N}]+", " ")), " ")
    return F.concat(F.substring(F.element_at(parts, 1), 1, 1), F.element_at(parts, -1))


def given_initial_key(name: Column) -> Column:
    """Given name and surname initial, for sources that hide surnames; null unless the name has two tokens."""
    parts = F.split(F.trim(F.regexp_replace(fold(name), "[^\\p{L}\\p{N}]+", " ")), " ")
    return F.when(F.size(parts) == 2, F.concat(F.element_at(parts, 1), F.substring(F.element_at(parts, 2), 1, 1)))


def given_first(name: Column) -> Column:
    """``Last, First`` as ``First Last``."""
    return F.trim(F.regexp_replace(name, "^([^,]+),\\s*(.+)$", "$2 $1"))


def transliterate(text: Column) -> Column:
    """Lower case, every Cyrillic letter in Latin spelling (the signs are left out)."""
    one = {letter: latin for letter, latin in CYRILLIC.items() if len(latin) == 1}
    out = F.translate(F.lower(text), "".join(one), "".join(one.values()))
    for letter, latin in CYRILLIC.items():
        if len(latin) != 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def slug(text: Column, joiner: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")


def team_and_league(text: Column) -> Column:
    """Struct (team, league) of ``Team [League]`` or ``Team (League)``; league is null where none is written."""
    league = F.nullif(F.regexp_extract(text, "[\\[(]([^\\])]+)[\\])]\\s*$", 1), F.lit(""))
    return F.struct(F.trim(F.regexp_replace(text, "\\s*[\\[(][^\\])]+[\\])]\\s*$", "")).alias("team"), league.alias("league"))


def add_label(labels: Column, label: Column, joiner: str = "; ") -> Column:
    """``labels`` with ``label`` appended unless it is there; blanks are no labels."""
    have = F.filter(F.transform(F.split(F.coalesce(labels, F.lit("")), "[;+]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(F.concat(have, F.when(blank_to_null(label).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.trim(label))))), joiner)


# ---- typed cells


def cell(text: Column) -> Column:
    """Trimmed cell; null for blanks and null marks."""
    out = blank_to_null(text)
    return F.when(~F.lower(out).isin(*NULL_MARKS), out)


def whole_strict(text: Column) -> Column:
    """Whole number, null for anything else (3.7 is none)."""
    return F.when(cell(text).rlike("^[+-]?[0-9]+$"), cell(text)).try_cast("bigint")


def whole_lenient(text: Column) -> Column:
    """Number cut to a whole one, 0 where there is none."""
    number = cell(text).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(0).cast("bigint"))


def flag(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "y")


def minutes(text: Column) -> Column:
    """``MM:SS`` or a number as minutes."""
    clock = F.regexp_extract(text, "^\\s*([0-9]+):([0-9]{1,2})\\s*$", 1)
    seconds = F.regexp_extract(text, "^\\s*([0-9]+):([0-9]{1,2})\\s*$", 2)
    return F.when(clock != "", clock.try_cast("double") + seconds.try_cast("double") / 60.0).otherwise(cell(text).try_cast("double"))


def money(text: Column) -> Column:
    """``$4.5M``, ``850K`` or ``1,250,000`` as whole units."""
    bare = F.upper(F.regexp_replace(text, "[$,\\s]", ""))
    scale = F.when(bare.endswith("M"), 1_000_000).when(bare.endswith("K"), 1_000).otherwise(1)
    return F.round(F.regexp_replace(bare, "[MK]$", "").try_cast("double") * scale).try_cast("bigint")


def share_of_one(value: Column) -> Column:
    """A rate that may be a percentage, as a share."""
    return F.when(value > 1, value / 100.0).otherwise(value)


def season_label(text: Column) -> Column:
    """``2018–19`` or ``2018/2019`` as ``2018-19``."""
    first, second = (F.regexp_extract(text, "([0-9]{4})\\s*[-–/]\\s*([0-9]{2,4})", i) for i in (1, 2))
    return F.when(first != "", F.concat(first, F.lit("-"), F.substring(second, -2, 2))).otherwise(F.trim(text))


def regular_season_of(*texts: Column) -> Column:
    """False if any of the texts hints at playoffs."""
    return ~F.lower(F.concat_ws(" ", *texts)).rlike("playoff|postseason|slutspel")


def age_at(day: Column, born: Column, digits: int = 2) -> Column:
    return F.round(F.datediff(day, born) / F.lit(365.25), digits)


def typed_date(text: Column) -> Column:
    formats = ("yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "M/d/yyyy", "d.M.yyyy")
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats])


# ---- numbers


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def logistic(value: Column) -> Column:
    """Without overflow at either end."""
    small = F.exp(-F.abs(value))
    return F.when(value >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


# ---- text features


def keyword_score(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the keywords that the text holds."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for word, weight in weights.items():
        total = total + F.when(lower.contains(word), F.lit(float(weight))).otherwise(F.lit(0.0))
    return total


def keyword_tags(text: Column, tags: dict[str, tuple[str, ...]]) -> Column:
    """Array of the tags of which the text holds a keyword, in the order given."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda words: lower.rlike("|".join(words))
    return F.array_compact(F.array(*[F.when(hit(words), F.lit(tag)) for tag, words in tags.items()]))


def first_sentences(text: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.trim(text), "(?<=[.!?])\\s+"), lambda x: x != ""), 1, n), " ")


def word_set(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct folded words without the stop words."""
    words = F.filter(F.split(fold(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    return F.array_distinct(F.filter(words, lambda x: ~x.isin(*stop)) if stop else words)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def list_cell(text: Column, separator: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def json_or_jsonp(text: Column) -> Column:
    """The JSON inside ``callback( ... )`` or the text itself."""
    return F.regexp_replace(F.trim(text), "(?s)^[\\w$.]*\\(\\s*(.*?)\\s*\\)\\s*;?$", "$1")


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[blank_to_null(v.cast("string")) for v in values])


# ---- seasons, roles and cells of feeds


def season_before(year: Column) -> Column:
    """The season that ends in ``year``, as ``2018-19``."""
    return F.concat((year - 1).cast("string"), F.lit("-"), F.substring(year.cast("string"), -2, 2))


def season_end(season: Column) -> Column:
    """1 June of the year in which a season (``2018-19``) ends; null for other texts."""
    year = F.regexp_extract(season, "^([0-9]{4})-[0-9]{2}$", 1).try_cast("int") + 1
    return F.make_date(year, F.lit(6), F.lit(1))


def foreseen_role(text: Column, position: Column) -> Column:
    """Role that a text (lower case) foresees."""
    defense = position.endswith("HD")
    out = F.when(text.contains("middle-six"), "middle-six forward").when(text.contains("top-six"), "top-six forward").when(text.contains("matchup") & (position == "C"), "matchup center")
    return out.when(defense & text.contains("transition"), "transition defenseman").when(defense, "two-way defenseman").otherwise("needs role projection review")


def comparable(text: Column) -> Column:
    """A cell as text that is equal for equal numbers (three digits, no trailing zeros), else in lower case; null if blank."""
    bare = blank_to_null(text)
    number = bare.try_cast("double")
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", number), "0+$", ""), "[.]$", "")
    return F.when(F.abs(number) < float("inf"), digits).otherwise(F.lower(bare))


def stage_text(text: Column) -> Column:
    """``false`` for playoffs, else ``true``."""
    return F.when(F.coalesce(F.lower(F.trim(text)).isin("false", "0", "no", "playoffs", "playoff"), F.lit(False)), "false").otherwise("true")


def saves_of(shots: Column, goals: Column) -> Column:
    """Shots less goals, null unless both are whole numbers."""
    return whole_strict(shots) - whole_strict(goals)


def leading_zero(text: Column) -> Column:
    """``.915`` as ``0.915``."""
    return F.regexp_replace(F.trim(text), "^[.]", "0.")


def ice_time(text: Column) -> Column:
    """``MM:SS``, seconds (above 120) or minutes, as minutes."""
    value = minutes(text)
    return F.when(~text.contains(":") & (value > 120), value / 60.0).otherwise(value)


def born_on(text: Column) -> Column:
    """The date after ``Born`` (``Born May 14 2001``), month in full or short; null without one."""
    said = F.regexp_extract(text, "Born ([A-Z][a-z]+ [0-9]{1,2} [0-9]{4})", 1)
    return F.coalesce(*[F.try_to_timestamp(F.nullif(said, F.lit("")), F.lit(f)).cast("date") for f in ("MMMM d yyyy", "MMM d yyyy")])
