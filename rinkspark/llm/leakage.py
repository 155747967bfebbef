"""Evaluation passages that appear in a corpus: pigeonhole matching with an error budget, verified bit-parallel.

A leak is a window of ``WINDOW`` consecutive words of a test item. Each item is split into pieces of
``WINDOW // (ERRORS + 2)`` words; every window holds ERRORS + 1 whole pieces, so within the error budget at least
one of them stands in the document unchanged. 1. All pieces of a block of items go into one Aho-Corasick automaton, and
each document is read once. 2. For a piece that is found, Myers' bit-parallel algorithm measures the edit distance
(on words) between the item's window and the document's; it decides every leak. 3. An exact check counts the consecutive
words.

Items are read in blocks of at most ITEM_BLOCK, one at a time, so the automaton, its broadcast and what the driver holds
have a fixed bound however many items there are; documents are never shuffled and never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import stage
from .words import words

WINDOW, ERRORS = 12, 1  # one_error_reach holds for a budget of one
PIECE = WINDOW // (ERRORS + 2)
#: Items in one automaton (some 10 kB each when built).
ITEM_BLOCK = 5_000
FOUND = "doc_id bigint, item_id bigint, words int, errors int"


def pieces(item: list[str]) -> list[tuple[int, str]]:
    """(position, text) of the item's pieces, side by side from its start; the last is moved back to the item's end."""
    starts = list(range(0, max(1, len(item) - PIECE + 1), PIECE))
    if len(item) >= PIECE and starts[-1] + PIECE < len(item):
        starts.append(len(item) - PIECE)
    return [(s, " ".join(item[s : s + PIECE])) for s in starts]


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """For each position of ``text``, the least edits (of words) that turn ``pattern`` into words ending there."""
    m, peq = len(pattern), {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


def exact_run(item: list[str], at: int, text: list[str], pos: int) -> tuple[int, int]:
    """Start in the item and length of the longest run of equal words around item[at] == text[pos]."""
    left = 0
    while left < at and left < pos and item[at - left - 1] == text[pos - left - 1]:
        left += 1
    right = 0
    while at + right < len(item) and pos + right < len(text) and item[at + right] == text[pos + right]:
        right += 1
    return at - left, left + right


def one_error_reach(item: list[str], start: int, text: list[str], first: int, run: int) -> int:
    """Most item words that a window can match if one word is unequal, missing or added at an end of an exact run."""
    best = 0
    for i, p, step in ((start + run, first + run, 1), (start - 1, first - 1, -1)):
        for di, dp in ((1, 1), (0, 1), (1, 0)):
            a, b, n = i + di * step, p + dp * step, 0
            while 0 <= a < len(item) and 0 <= b < len(text) and n < WINDOW and item[a] == text[b]:
                a, b, n = a + step, b + step, n + 1
            best = max(best, n)
    return run + best


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, str], ...]):
    import ahocorasick

    parsed = [(i, words(t)) for i, t in items]
    where: dict[str, list[tuple[int, int]]] = {}
    for n, (_, item) in enumerate(parsed):
        if len(item) >= WINDOW:
            for at, piece in pieces(item):
                where.setdefault(f" {piece} ", []).append((n, at))
    machine = ahocorasick.Automaton()
    for piece, places in where.items():
        machine.add_word(piece, (len(piece), places))
    if where:
        machine.make_automaton()
    return machine if where else None, parsed


def window_errors(item: list[str], starts: range, around: list[str]) -> int:
    """The least edits of words between a window of the item, from one of ``starts`` on, and words of the document."""
    least = WINDOW
    for s in starts:
        least = min(least, *myers(item[s : s + WINDOW], around))
        if not least:
            break
    return least


def leaks_in(text: str | None, machine, parsed) -> list[tuple[int, int, int]]:
    """(item_id, longest exact run of words, errors of the best window) for each item that ``text`` leaks.

    Every leak is verified by the edit distance of a window to the document's words around the piece that was found.
    """
    have = words(text)
    if len(have) < WINDOW - ERRORS:
        return []
    line, best = f" {' '.join(have)} ", {}
    hits = list(machine.iter(line))
    if not hits:
        return []
    places_of: dict[int, int] = {}
    at = 0
    for k, w in enumerate(have):
        places_of[at] = k
        at += len(w) + 1
    for end, (length, places) in hits:
        pos = places_of[end - length + 1]
        for n, at in places:
            item = parsed[n][1]
            known = best.get(n)
            if known and known[2] <= pos < known[3] and pos - at == known[4]:
                continue  # inside the run that is already counted
            start, run = exact_run(item, at, have, pos)
            first = pos - (at - start)
            if run >= WINDOW:
                starts, around = range(start, start + 1), have[first : first + WINDOW]
            elif one_error_reach(item, start, have, first, run) < WINDOW - ERRORS:
                continue  # no window with this piece can be within the budget
            else:
                starts, around = range(max(0, at + PIECE - WINDOW), min(at, len(item) - WINDOW) + 1), have[max(0, pos - WINDOW - ERRORS) : pos + WINDOW + ERRORS]
            errors = window_errors(item, starts, around)
            if errors <= ERRORS and (known is None or (run, -errors) > (known[0], -known[1])):
                best[n] = (run, errors, first, first + run, pos - at)
    out: dict[int, tuple[int, int]] = {}
    for n, b in best.items():
        i = parsed[n][0]
        out[i] = max(out.get(i, (0, -WINDOW)), (b[0], -b[1]))
    return [(i, run, -errors) for i, (run, errors) in out.items()]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id, words, errors) of each document and test item of which it holds a window.

    ``words`` is the longest run of consecutive words of the item, ``errors`` the edits (at most ERRORS) of the best window.
    Null and empty texts leak nothing, items of under WINDOW words can't leak, different texts of one item id count as
    one item, repeated items give one row an id, rows of a repeated doc_id one each; other columns are not read. Up to
    ITEM_BLOCK items the documents are read once, else once a block; the driver holds one block at a time.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).dropna().distinct()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def page(after) -> list:
        more = rows if after is None else rows.filter((F.col("i") > after.i) | ((F.col("i") == after.i) & (F.col("t") > after.t)))
        return more.orderBy("i", "t").limit(ITEM_BLOCK).collect()  # a block of the stated query set

    def leaks(block: list) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(tuple((r.i, r.t) for r in block))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine, parsed = _automaton(sent.value)
            for batch in batches:
                found = []
                if machine is not None:
                    for d, t in zip(batch["doc_id"], batch["text"]):
                        found += [(d, *x) for x in leaks_in(t, machine, parsed)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "words", "errors"])

        return slim.mapInPandas(scan, FOUND), sent

    block = page(None)
    part, sent = leaks(block)
    if len(block) < ITEM_BLOCK:
        return part
    out = None
    while block:
        part = stage(part)
        sent.destroy()
        out = part if out is None else out.unionByName(part)
        block = page(block[-1])
        if block:
            part, sent = leaks(block)
    # A page may end between two texts of one item.
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", (-F.col("errors")).alias("e"))).alias("b")).select("doc_id", "item_id", "b.words", (-F.col("b.e")).alias("errors"))
