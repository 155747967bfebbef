"""Words of a text without case, accents, punctuation, markup, invisible characters and layout (in Python workers)."""

from __future__ import annotations

import html
import re
import unicodedata

from ..functions.text import PLAIN_LETTERS

# Tags that stand inside a word or between words without a break.
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|font|mark|small|sub|sup|code|q|cite)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_SPLIT_WORD = re.compile("(?<=\\w)[\\-\u2010\u2011\u00ad][ \t]*\r?\n\\s*(?=\\w)")
_APOSTROPHE = re.compile("(?<=\\w)['\u2019\u02bc](?=\\w)")
_WORD = re.compile(r"[^\W_]+")
_PLAIN = str.maketrans(PLAIN_LETTERS)


def clean(text: str | None) -> str:
    """Lower-case text of the visible letters; null is empty."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = _SPLIT_WORD.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if c < "\u0300" and c != "\u00ad" or not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        text = text.lower().translate(_PLAIN)
    return _APOSTROPHE.sub("", text.lower())


def words(text: str | None) -> list[str]:
    return _WORD.findall(clean(text))
