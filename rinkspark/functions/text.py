"""Column expressions on text that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that Unicode does not decompose, with their usual plain spelling.
PLAIN_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}

# Characters that are not seen (soft hyphen, zero-width and direction marks, byte order mark).
INVISIBLE = "[\\u00AD\\u034F\\u061C\\u180E\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\u2066-\\u206F\\uFEFF\\uFE00-\\uFE0F]"


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Lower-case letters with accents and the letters without, by Unicode decomposition."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x500), *range(0x1E00, 0x2000)]:
        ch = chr(code)
        if ch != ch.lower() or ch == "й":
            continue
        base = [c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != ch:
            marked.append(ch)
            plain.append(base[0].lower())
    return "".join(marked), "".join(plain)


def fold(col: Column) -> Column:
    """Lower case without accents, combining marks and invisible characters; null stays null."""
    out = F.regexp_replace(F.lower(col), INVISIBLE, "")
    out = F.translate(out, *accent_map())
    out = F.regexp_replace(out, "\\p{M}+", "")
    for letter, spelled in PLAIN_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


def alnum_key(col: Column) -> Column:
    """Folded letters and digits only: equal for texts that differ in case, accents, punctuation or spacing."""
    return F.regexp_replace(fold(col), "[^\\p{L}\\p{N}]+", "")


def blank_to_null(col: Column) -> Column:
    """Trimmed text (any Unicode blank), null where nothing is left."""
    return F.nullif(F.regexp_replace(col, "(?U)^\\s+|\\s+$", ""), F.lit(""))
