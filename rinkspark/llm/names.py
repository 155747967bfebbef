"""Variant spellings of persons' names: a trie join over shards.

A spelling is read as tokens; every token order is tried as (first name, surname). First names are resolved over a
dictionary (registered first names, nicknames learned from the spellings themselves). Registered names are sharded by
first name and surname length, large shards routed by pieces of the name; each shard builds a trie of its surnames and
runs each query's Levenshtein automaton over it, which enumerates the surnames within ``MAX_EDITS``, of which those count
that leave half of the letters as they are. Spellings whose folded form equals a registered name need no trie.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import join_checked, stage, tasks

MAX_EDITS = 2
#: Names of one trie, and queries that one task runs over it.
SHARD_NAMES, SHARD_QUERIES = 20_000, 2_000
#: Different surnames with which a learned nickname must stand beside its first name.
NICKNAME_SUPPORT = 2

# Cyrillic letters in Latin spelling.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "a b v g d e zh z i j k l m n o p r s t u f h ts ch sh sch _ y _ e yu ya e".replace("_", "").split(" ")))
# Spellings that sound alike, in the order in which they are replaced.
ALIKE = (("sch", "sh"), ("ae", "a"), ("oe", "o"), ("ph", "f"), ("ck", "k"), ("c", "k"), ("q", "k"), ("w", "v"), ("ff", "v"), ("x", "ks"), ("tz", "ts"), ("yo", "e"), ("y", "i"), ("j", "i"))

_LATIN = str.maketrans(CYRILLIC | {"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe"})
_QUOTED = re.compile("[\"“”„«»]([^\"“”„«»]+)[\"“”„«»]|(?<!\\w)['‘’]([^'‘’]+)['‘’](?!\\w)|\\(([^()]+)\\)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CAMEL = re.compile(r"(?<=[a-zà-ÿа-яё])(?=[A-ZÀ-ÞА-ЯЁ])")


def plain(token: str) -> str:
    """Lower-case Latin letters without accents."""
    out = unicodedata.normalize("NFKD", token.lower().replace("й", "j"))
    out = "".join(c for c in out if not unicodedata.combining(c)).translate(_LATIN)
    return re.sub("[^a-z]", "", out) or re.sub(r"\W", "", out)


def sound(token: str) -> str:
    """The token with alike spellings made one and doubled letters made single."""
    out = plain(token)
    for a, b in ALIKE:
        out = out.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", out)


def name_parts(name: str) -> list[str]:
    """The sounds of the tokens of a name, without what stands in quotes or brackets."""
    tokens = [sound(t) for part in _TOKEN.findall(_QUOTED.sub(" ", name)) for t in _CAMEL.split(part)]
    return [t for t in tokens if t]


def read_spelling(name: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """((first, surname) readings in every token order, (nickname, first name) pairs written out) of a spelling.

    A reading's first name is one letter if only an initial is written. Initials and third tokens may be left out.
    """
    nicks = [next(g for g in m.groups() if g) for m in _QUOTED.finditer(name)]
    tokens = name_parts(name)
    full = [t for t in tokens if len(t) > 1]
    readings = [(a, b) for i, a in enumerate(full) for j, b in enumerate(full) if i != j]
    if len(full) == 1:
        readings = [(a, full[0]) for a in tokens if len(a) == 1]
    said = [(sound(n), full[0]) for n in nicks if full and sound(n)] if len(full) >= 2 else []
    return list(dict.fromkeys(readings)), said


def osa(a: str, b: str, limit: int = 9) -> int:
    """Edit distance in which a swap of neighbours is one edit; ``limit`` if it is that or more."""
    if abs(len(a) - len(b)) >= limit:
        return limit
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return min(limit, one[-1])


def build_trie(names: list[str]) -> dict:
    """Nested dicts by letter; the key '' holds the name that ends there."""
    root: dict = {}
    for name in names:
        node = root
        for c in name:
            node = node.setdefault(c, {})
        node[""] = name
    return root


def neighbours(trie: dict, query: str, edits: int, length: int | None = None) -> list[str]:
    """Names of the trie within ``edits`` of ``query``: the query's Levenshtein automaton, as bit sets of its states.

    Bit i of row e: the first i letters of the query are read with e edits. A branch ends when no row has a bit left. If
    all names have ``length`` letters, states from which the edits that are left can't make up the rest of it go too.
    """
    m = len(query)
    full, accept = (1 << m + 1) - 1, 1 << m
    masks: dict[str, int] = {}
    for i, c in enumerate(query):
        masks[c] = masks.get(c, 0) | 1 << i
    keep = None
    if length is not None:
        keep = [[sum(1 << i for i in range(m + 1) if abs((m - i) - (length - d)) <= edits - e) for e in range(edits + 1)] for d in range(length + 1)]
    out, stack = [], [(trie, tuple((1 << e + 1) - 1 & full for e in range(edits + 1)), 1)]
    while stack:
        node, rows, depth = stack.pop()
        allowed = keep[depth] if keep and depth <= length else None
        for c, child in node.items():
            if not c:
                if any(r & accept for r in rows):
                    out.append(child)
                continue
            mask = masks.get(c, 0)
            below = rows[0]
            now = (below & mask) << 1
            if allowed:
                now &= allowed[0]
            alive, new = now, [now]
            for e in range(1, edits + 1):
                r = rows[e]
                now = ((r & mask) << 1 | below | below << 1 | now << 1) & (allowed[e] if allowed else full)
                new.append(now)
                alive |= now
                below = r
            if alive:
                stack.append((child, tuple(new), depth + 1))
    return out


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = [read_spelling(n) for n in batch["name"]]
        yield pd.DataFrame({"name": batch["name"], "readings": [[{"f": a, "l": b} for a, b in r] for r, _ in read], "nicks": [[{"nick": a, "f": b} for a, b in s] for _, s in read]})


READ = "name string, readings array<struct<f:string,l:string>>, nicks array<struct<nick:string,f:string>>"


def _piece(text: Column, length: Column, i: int, edits: int, shift: Column | None = None) -> Column:
    """The i-th of ``edits`` + 1 nearly equal pieces of names of ``length``; with ``shift``, letters moved so in ``text``."""
    k = edits + 1
    base, longer = F.floor(length / k).cast("int"), (length % k).cast("int")
    start = base * i + F.greatest(F.lit(i) - (F.lit(k) - longer), F.lit(0))
    size = base + F.when(F.lit(i) >= F.lit(k) - longer, 1).otherwise(0)
    at = start if shift is None else start + shift
    inside = (at >= 0) & (at + size <= F.length(text))
    return F.when(inside, F.concat(F.lit(f"{i}:"), F.substring(text, at + 1, size)))


def _routes(query: Column, length: Column, edits: int) -> Column:
    """Every piece that a name of ``length`` within ``edits`` of ``query`` may share with it, at the places where it may stand.

    One of ``edits`` + 1 pieces is free of edits; before it and behind it together at most ``edits`` letters were put in
    or taken out, which bounds how far it has moved.
    """
    out = []
    surplus = F.length(query) - length
    for i in range(edits + 1):
        for move in range(-edits, edits + 1):
            shift = F.lit(move)
            fits = (F.abs(shift) + F.abs(surplus - shift)) <= edits
            out.append(F.when(fits, _piece(query, length, i, edits, shift)))
    return F.array_distinct(F.array_compact(F.array(*out)))


def trie_join(queries: DataFrame, names: DataFrame, keys: list[str], query: str, name: str, edits: int = MAX_EDITS) -> DataFrame:
    """(keys, query, name, edits) of all pairs with equal ``keys`` and at most ``edits`` edits (a swap counts one).

    Both sides are made distinct. Shards are (keys, length of the name). Names of a shard of more than SHARD_NAMES are routed by
    their pieces (pigeonhole), so a query meets only those that share a piece with it. Of a shard with many queries
    each part builds the trie once for at least as many queries as it has names. Pairs found are those within ``edits``
    single-letter edits; a pair may come out once a shared piece.
    """
    slim = names.select(*keys, F.col(name).alias("__n")).dropna().distinct().withColumn("__len", F.length("__n"))
    asked = queries.select(*keys, F.col(query).alias("__q")).dropna().distinct()
    asked = asked.withColumn("__len", F.explode(F.sequence(F.greatest(F.length("__q") - edits, F.lit(1)), F.length("__q") + edits)))
    on = [*keys, "__len"]
    big = stage(slim.groupBy(*on).agg(F.count("*").alias("__ns")).filter(F.col("__ns") > SHARD_NAMES).select(*on, F.lit(True).alias("__big")))
    whole = F.array(F.lit(""))
    shard = [*on, "__piece"]
    if big.isEmpty():
        right, left = slim.withColumn("__piece", F.lit("")), asked.withColumn("__piece", F.lit(""))
    else:
        pieces = F.array(*[_piece(F.col("__n"), F.col("__len"), i, edits) for i in range(edits + 1)])
        right = join_checked(slim, big, on, "left").select(*on, "__n", F.explode(F.when(F.col("__big"), pieces).otherwise(whole)).alias("__piece"))
        left = join_checked(asked, big, on, "left").select(*on, "__q", F.explode(F.when(F.col("__big"), _routes(F.col("__q"), F.col("__len"), edits)).otherwise(whole)).alias("__piece"))
    loads = left.groupBy(*shard).agg(F.count("*").alias("__qs")).filter(F.col("__qs") > SHARD_QUERIES)
    hot = stage(loads.join(right.groupBy(*shard).agg(F.count("*").alias("__ns")), shard).select(*shard, F.ceil(F.col("__qs") / F.greatest(F.lit(SHARD_QUERIES), F.col("__ns"))).cast("int").alias("__parts")))
    if hot.isEmpty():
        left, right = left.withColumn("__part", F.lit(0)), right.withColumn("__part", F.lit(0))
    else:
        parts = F.coalesce("__parts", F.lit(1))
        left = join_checked(left, hot, shard, "left").withColumn("__part", F.pmod(F.xxhash64("__q"), parts).cast("int")).drop("__parts")
        right = join_checked(right, hot, shard, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    n = tasks(left)  # a stated number: shards are few bytes, and would else be merged into few tasks
    bucket = F.pmod(F.xxhash64(*shard, "__part"), F.lit(n)).cast("int")
    left, right = left.withColumn("__bucket", bucket), right.withColumn("__bucket", bucket)
    kinds = dict(slim.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{query}` string", f"`{name}` string", "edits int"])
    columns = [*shard, "__part"]

    def run(asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        found, members = [], {}
        for *at, known in zip(*[have[c] for c in columns], have["__n"]):
            members.setdefault(tuple(at), []).append(known)
        asking: dict[tuple, list[str]] = {}
        for *at, q in zip(*[asks[c] for c in columns], asks["__q"]):
            asking.setdefault(tuple(at), []).append(q)
        for at, qs in asking.items():
            if at in members:
                trie = build_trie(members[at])
                for q in qs:
                    found += [(*at[: len(keys)], q, known, osa(q, known)) for known in neighbours(trie, q, edits, int(at[len(keys)]))]
        return pd.DataFrame(found, columns=[*keys, query, name, "edits"])

    return left.repartition(n, "__bucket").groupBy("__bucket").cogroup(right.repartition(n, "__bucket").groupBy("__bucket")).applyInPandas(run, schema)


def alike(query: str) -> Column:
    """Whether at least half of the letters of ``query`` are free of edits."""
    return 2 * F.col("edits") <= F.length(query)


def _first_vocabulary(known: DataFrame, nicks: DataFrame) -> DataFrame:
    """(word, first, extra): registered first names and nicknames, with what a nickname costs."""
    both = known.select(F.col("first").alias("word"), "first", F.lit(0.0).alias("extra")).unionByName(nicks.select(F.col("nick").alias("word"), "first", F.lit(0.25).alias("extra")))
    return both.groupBy("word", "first").agg(F.min("extra").alias("extra"))


def _near_first_names(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(f, first, cost): the first names that are one or two edits from a written one, registered itself or not."""
    near = trie_join(asked, vocabulary, [], "f", "word").filter("edits > 0")
    guessed = near.filter(alike("f")).join(vocabulary, "word").select("f", "first", (F.col("edits") + F.col("extra")).alias("cost"))
    return guessed.groupBy("f", "first").agg(F.min("cost").alias("cost"))


def learn_nicknames(read: DataFrame, registered: DataFrame) -> DataFrame:
    """(nick, first): written out beside a registered first name, or seen in its place with several whole surnames."""
    firsts = registered.select("first").distinct()
    said = read.select(F.explode("nicks").alias("n")).select("n.nick", F.col("n.f").alias("first"))
    surname = registered.groupBy("last").agg(F.min("first").alias("first"), F.max("first").alias("other")).filter("first = other").drop("other")
    pairs = read.filter(F.size("readings") == 2).select(F.explode("readings").alias("r")).select(F.col("r.f").alias("nick"), F.col("r.l").alias("last")).filter("length(nick) > 2").distinct()
    pairs = pairs.join(firsts.select(F.col("first").alias("nick")), "nick", "left_anti")
    seen = pairs.join(surname, "last").filter(F.levenshtein("nick", "first") > 1).groupBy("nick", "first").agg(F.count("*").alias("n")).filter(F.col("n") >= NICKNAME_SUPPORT)
    both = said.unionByName(seen.select("nick", "first")).filter("nick <> first").join(firsts, "first", "left_semi")
    return both.distinct()


def link_spellings(spellings: DataFrame, registered_names: DataFrame, name: str = "name") -> DataFrame:
    """(spelling, first, last, cost): the registered person names (as sounds) that a spelling fits best.

    ``registered_names`` has the column ``name``. Spellings equal to a registered name, null or without letters give
    nothing. Of several names the ones of least cost come out, all of them if they tie.
    """
    spelled = spellings.select(F.col(name).alias("name")).dropna().distinct()
    known = registered_names.select("name").dropna().distinct()
    unknown = spelled.join(known, "name", "left_anti")
    read = stage(unknown.mapInPandas(_read, READ), wide=True)
    registered = known.mapInPandas(_read, READ).select("name", F.element_at("readings", 1).alias("r")).filter("r is not null")
    registered = stage(registered.select("name", F.col("r.f").alias("first"), F.col("r.l").alias("last")), wide=True)
    pairs = registered.select("first", "last").distinct()

    nicks = stage(learn_nicknames(read, pairs))
    asked = read.select("name", F.explode("readings").alias("r")).select("name", F.col("r.f").alias("f"), F.col("r.l").alias("l"))
    vocabulary = stage(_first_vocabulary(pairs.select("first").distinct(), nicks))
    registered_last = pairs.withColumnRenamed("last", "l")

    def tries(rows: DataFrame, firsts: DataFrame) -> DataFrame:
        tried = rows.filter("length(f) > 1").join(firsts, "f").groupBy("name", "l", "first").agg(F.min("cost").alias("cost"))
        return stage(tried.select("name", "l", F.col("first").alias("first"), "cost"))  # a column of its own, as ``pairs`` is joined

    def whole_of(rows: DataFrame) -> DataFrame:
        return rows.join(registered_last, ["first", "l"]).select("name", "first", F.col("l").alias("last"), "cost")

    def guesses(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Registered surnames near those of ``rows``, where an edit can still do as well as what is ``found``."""
        least = found.groupBy("name").agg(F.min("cost").alias("least"))
        rest = rows.join(least, "name", "left").filter((F.col("cost") + 1 <= F.coalesce("least", F.lit(MAX_EDITS + 1.0))))
        near = trie_join(rest, pairs, ["first"], "l", "last").filter(alike("l"))
        cost = (F.col("cost") + F.col("edits")).alias("cost")
        return rest.join(near, ["first", "l"]).select("name", "first", "last", cost).filter(F.col("cost") <= MAX_EDITS + 1)

    def by_initial(found: DataFrame) -> DataFrame:
        """For spellings with an initial that nothing was found for: the surname that is one edit away."""
        rest = asked.filter("length(f) = 1").join(found.select("name"), "name", "left_anti")
        known = pairs.select(F.substring("first", 1, 1).alias("f"), "first", "last")
        near = trie_join(rest, known, ["f"], "l", "last").filter("edits <= 1").filter(alike("l"))
        return rest.join(near, ["f", "l"]).join(known, ["f", "last"]).select("name", "first", "last", (F.col("edits") + 0.5).alias("cost"))

    written = tries(asked, vocabulary.select(F.col("word").alias("f"), "first", F.col("extra").alias("cost")))
    initials = asked.filter("length(f) = 1").join(pairs.select("first", F.col("last").alias("l"), F.substring("first", 1, 1).alias("f")), ["f", "l"])
    whole = stage(whole_of(written).unionByName(initials.select("name", "first", F.col("l").alias("last"), F.lit(0.5).alias("cost"))))

    # Whole matches cost less than one edit, so near first names are tried for the other spellings only.
    left = asked.join(whole.select("name").distinct(), "name", "left_anti")
    near = tries(left, stage(_near_first_names(left.select("f").filter("length(f) > 1").distinct(), vocabulary)))
    found = stage(whole.unionByName(whole_of(near)))
    found = stage(found.unionByName(guesses(written, found)))
    found = found.unionByName(guesses(near, found)).unionByName(by_initial(found))
    least = found.groupBy("name").agg(F.min("cost").alias("least"))
    return found.join(least, "name").filter("cost = least").groupBy(F.col("name").alias("spelling"), "first", "last").agg(F.min("cost").alias("cost"))


def person_keys(people: DataFrame, name: str = "name") -> DataFrame:
    """``people`` with the sounds ``first`` and ``last`` of their name (null if it has no two tokens)."""
    fields = T.StructType([T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])

    @F.pandas_udf(fields)
    def keys(names: pd.Series) -> pd.DataFrame:
        read = [(read_spelling(n)[0] if n else []) or [(None, None)] for n in names]
        return pd.DataFrame({"first": [r[0][0] for r in read], "last": [r[0][1] for r in read]})

    return people.withColumn("__k", keys(F.col(name))).select(*people.columns, "__k.first", "__k.last")
