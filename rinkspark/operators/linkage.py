"""Lookup joins and record linkage by keys: dimensions with a fallback, unique-only links, cascades, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..plans.runtime import join_checked, stage
from .similar import Similar, ratio  # noqa: F401

#: Base keys and source keys that one task of ``closest`` compares at once, and source keys for which a task is worth its while.
SHARD_KEYS, SHARD_ASKED, FEW_ASKED = 1_000_000, 20_000, 250


def lookup(rows: DataFrame, dimension: DataFrame, on: str, fallback: dict[str, object], default_key: str = "Unknown") -> DataFrame:
    """``rows`` with the dimension's columns by ``on``; else those of ``default_key``, else the constants of ``fallback``.

    The first row of a repeated dimension key (in column order) counts; the dimension is counted before a broadcast.
    """
    columns = [c for c in dimension.columns if c != on]
    unique = dimension.dropna(subset=[on]).groupBy(on).agg(F.min(F.struct(*columns)).alias("__d"))
    default = unique.filter(F.col(on) == default_key).select("__d").limit(1).collect()
    constants = default[0]["__d"].asDict() if default else {}
    joined = join_checked(rows.drop(*columns), unique, on, "left")
    return joined.select(*[c for c in rows.columns if c not in columns], *[F.coalesce(F.col(f"__d.`{c}`"), F.lit(constants.get(c, fallback.get(c)))).alias(c) for c in columns])


def fill_blanks(base: DataFrame, overlay: DataFrame, on: str, columns: list[str], prefer: str = "base") -> DataFrame:
    """``base`` with blank (``prefer`` base) or all (``prefer`` overlay) ``columns`` taken from the overlay's filled ones.

    ``overlay`` has unique keys; rows of ``base`` without a partner stay as they are.
    """
    other = overlay.select(on, *[F.col(f"`{c}`").alias(f"__o_{c}") for c in columns])
    joined = base.join(other, on, "left")

    def pick(c: str) -> Column:
        kind = dict(base.dtypes)[c]
        ours, theirs = (blank_to_null(x) if kind == "string" else x for x in (F.col(f"`{c}`"), F.col(f"`__o_{c}`")))
        return (F.coalesce(ours, theirs) if prefer == "base" else F.coalesce(theirs, ours)).alias(c)

    return joined.select(*[pick(c) if c in columns else F.col(f"`{c}`") for c in base.columns])


def unique_keys(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """(key, row_id) of the keys that exactly one row has; null keys are none."""
    return df.select(key.alias("key"), F.col(row_id).alias(row_id)).filter("key is not null and key <> ''").groupBy("key").agg(F.count("*").alias("__n"), F.min(row_id).alias(row_id)).filter("__n = 1").drop("__n")


def cascade_match(source: DataFrame, base: DataFrame, source_id: str, base_id: str, steps: list[tuple[str, Column, Column]], approved: DataFrame | None = None, fuzzy: tuple[Column, Column, str, float] | None = None) -> DataFrame:
    """(source_id, base_id, method): each source row's base row by the first step whose keys are unique on both sides.

    ``steps`` are (method, key of source, key of base). ``approved`` (source_id, base_id) goes before all, as ``manual``.
    ``fuzzy`` (key of source, key of base, base text, least) goes last: rows without a pair in any step get the base row
    of the most similar key, if it is ``least`` similar (ties: smallest base text, then id; used base rows included).
    A base row is used once: by the earliest step, of those by the smallest source_id. Unmatched rows have method null.
    """
    found = None
    if approved is not None:
        found = approved.select(source_id, base_id, F.lit(0).alias("step"))
    for i, (_, ours, theirs) in enumerate(steps, 1):
        pairs = unique_keys(source, ours, source_id).join(unique_keys(base, theirs, base_id), "key").select(source_id, base_id, F.lit(i).alias("step"))
        found = pairs if found is None else found.unionByName(pairs)
    if fuzzy is not None:
        ours, theirs, text, least = fuzzy
        found = stage(found)
        left = source.join(found.select(source_id), source_id, "left_anti")
        near = closest(left, base, source_id, base_id, ours, theirs, text, 1, least)
        found = found.unionByName(near.select(source_id, base_id, F.lit(len(steps) + 1).alias("step")))
    first = found.groupBy(source_id).agg(F.min(F.struct("step", base_id)).alias("m")).select(source_id, "m.*")
    once = first.groupBy(base_id).agg(F.min(F.struct("step", source_id)).alias("m")).select(F.col(f"m.{source_id}").alias(source_id), base_id, F.col("m.step").alias("step"))
    methods = F.create_map(*[F.lit(x) for i, m in enumerate(["manual", *[s[0] for s in steps], "fuzzy"]) for x in (i, m)])
    return source.select(source_id).distinct().join(once, source_id, "left").select(source_id, base_id, F.element_at(methods, F.col("step")).alias("method"))


def replace_scope(base: DataFrame, fresh: DataFrame, scope: list[str]) -> DataFrame:
    """``base`` without the rows whose ``scope`` occurs in ``fresh``, and the rows of ``fresh`` (null-safe scopes)."""
    scopes = fresh.select(*[F.col(c).alias(f"__s_{c}") for c in scope]).distinct()
    kept = base.join(scopes, [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in scope], "left_anti")
    return kept.unionByName(fresh.select(*base.columns))


def upsert(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``fresh`` override non-blank fields of ``base`` by ``key``; new keys are added. Keys are unique."""
    both = base.select(F.col(key), F.struct(*base.columns).alias("b")).join(fresh.select(F.col(key), F.struct(*fresh.columns).alias("f")), key, "full")
    kinds = dict(base.dtypes)

    def pick(c: str) -> Column:
        if c not in fresh.columns:
            return F.col(f"b.`{c}`").alias(c)
        new = F.col(f"f.`{c}`")
        return F.coalesce(blank_to_null(new) if kinds[c] == "string" else new, F.col(f"b.`{c}`")).alias(c)

    return both.select(*[F.col(key) if c == key else pick(c) for c in base.columns])


def closest(source: DataFrame, base: DataFrame, source_id: str, base_id: str, source_key: Column, base_key: Column, base_text: str, top: int = 3, least: float = 0.0) -> DataFrame:
    """(source_id, base_id, similarity, place): the ``top`` base rows whose keys are most similar, of all base rows.

    Similarity is twice the matched letters by all letters, ``least`` or more; null keys count as empty. Ties go to the
    smallest base text, then id. Distinct source keys are packed into blocks, one a core or more (SHARD_ASKED keys at most),
    distinct base keys into shards of SHARD_KEYS, once each; a task holds a block and reads shard after shard, whose names must
    reach the best found before. No base row is left out but by an exact bound.
    """
    empty = F.lit("")
    asked = source.select(source_id, F.coalesce(source_key, empty).alias("__a"))
    rows = base.select(F.coalesce(base_key, empty).alias("__b"), F.coalesce(base_text, empty).alias("__t"), base_id)
    first = Window.partitionBy("__b").orderBy("__t", base_id)
    names = rows.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= top).drop("__n")
    names, spellings = stage(names), stage(asked.select("__a").distinct())
    keys = names.select("__b").distinct()
    cores, asks = source.sparkSession.sparkContext.defaultParallelism, spellings.count()
    of_keys, of_asked = -(-keys.count() // SHARD_KEYS), max(-(-asks // SHARD_ASKED), min(cores, -(-asks // FEW_ASKED)))
    cut = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(1, n))).cast("int")
    blocks = spellings.groupBy(cut("__a", of_asked).alias("__q")).agg(F.collect_list("__a").alias("asks"))  # bounded: SHARD_ASKED, SHARD_KEYS
    shards = stage(keys.groupBy(cut("__b", of_keys).alias("__k")).agg(F.collect_list("__b").alias("have")), wide=True)
    blocks = stage(blocks.repartitionByRange(max(1, of_asked), "__q"), wide=True)
    runs = max(1, min(of_keys, -(-cores // max(1, of_asked))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A shard and a block a row."""
        shard, best, found = None, {}, {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if shard != row.shard:
                    shard, texts = row.shard, Similar(list(row.have))
                asks = list(row.asks)
                for q in asks:
                    best.setdefault(q, [least] * top)
                for q, have in texts.top(asks, best).items():
                    of = [*found.get(q, ()), *((v, b) for b, v in have.items())]
                    if of:
                        found[q] = [x for x in of if x[0] >= best[q][0]]
        rows = [(q, b, v) for q, of in found.items() for v, b in of]
        yield pd.DataFrame(rows, columns=["__a", "__b", "similarity"])

    both = shards.withColumnRenamed("__k", "shard").coalesce(runs).hint("shuffle_replicate_nl").crossJoin(blocks)
    pairs = both.mapInPandas(run, "__a string, __b string, similarity double").join(names, "__b")
    order = Window.partitionBy("__a").orderBy(F.col("similarity").desc(), "__t", base_id)
    best = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    lists = stage(best.groupBy("__a").agg(F.collect_list(F.struct(base_id, "similarity", "place")).alias("__best")))  # ``top`` at most
    return join_checked(asked, lists, "__a").select(source_id, F.explode("__best").alias("m")).select(source_id, "m.*")


def coverage(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """``expected`` keys with status covered or missing; keys only in ``present`` are external."""
    a = expected.select(*on).distinct().withColumn("__e", F.lit(True))
    b = present.select(*on).distinct().withColumn("__p", F.lit(True))
    status = F.when(F.col("__e") & F.col("__p"), "covered").when(F.col("__e"), "missing").otherwise("external")
    return a.join(b, on, "full").select(*on, status.alias("status"))
