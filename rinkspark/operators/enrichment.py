"""Lines of a feed tied to registered players by name keys within their leagues, put in place of older lines of one scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import join_checked, stage
from .linkage import replace_scope
from .reconcile import keep_first

Key = tuple[str, Callable[[Column], Column]]


def enrich(players: DataFrame, eligible: DataFrame, feed: DataFrame, keys: list[Key], feed_id: str, identity: str, scope: list[str], best: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(matched feed lines with player_id and method, one row a player with its disposition).

    ``players`` has unique player_id and name, ``eligible`` (player_id, league) the leagues in which a player is sought,
    ``feed`` name, league and a unique ``feed_id``. The first of ``keys`` (method, key of a name) that gives lines counts. A
    key that several players have gives none (ambiguous_identity); keys after the first need lines of one ``identity`` only.
    Of several lines of one ``scope`` the first by ``best`` stays. A player without a league is not_eligible, one without
    lines unmatched. Null names and leagues match nothing.
    """
    wanted = eligible.select("player_id", "league").dropna().distinct()
    found = None
    several = None
    for step, (method, key) in enumerate(keys):
        named = players.select("player_id", key(F.col("name")).alias("__k")).filter("__k <> ''")
        counts = named.groupBy("__k").agg(F.count("*").alias("__n"), F.min("player_id").alias("player_id"))
        own = stage(counts.filter("__n = 1").select("__k", "player_id").join(wanted, "player_id"))
        lines = join_checked(feed.withColumn("__k", key(F.col("name"))), own, ["__k", "league"])
        if step:
            once = lines.groupBy("player_id").agg(F.count_distinct(identity).alias("__i")).filter("__i = 1").select("player_id")
            lines = lines.join(once, "player_id", "left_semi")
        part = lines.select("player_id", feed_id, F.lit(step).alias("step"), F.lit(method).alias("method"))
        found = part if found is None else found.unionByName(part)
        if several is None:
            several = named.join(counts.filter("__n > 1").select("__k"), "__k", "left_semi").select("player_id", F.lit(True).alias("__several"))
    several = stage(several.distinct())
    found = stage(found.join(several.select("player_id"), "player_id", "left_anti"))
    first = found.groupBy("player_id").agg(F.min("step").alias("step"))
    taken = found.join(first, ["player_id", "step"]).join(feed, feed_id)
    matched = stage(keep_first(taken, ["player_id", *scope], best).drop("step"))
    counted = matched.groupBy("player_id").agg(F.count("*").alias("lines"), F.min("method").alias("method"))
    out = players.select("player_id").join(wanted.select("player_id").distinct().withColumn("__e", F.lit(True)), "player_id", "left")
    out = out.join(several, "player_id", "left").join(counted, "player_id", "left")
    disposition = F.when(F.col("__e").isNull(), "not_eligible").when(F.col("__several"), "ambiguous_identity").when(F.col("lines").isNull(), "unmatched_in_source").otherwise("matched")
    return matched, out.select("player_id", disposition.alias("disposition"), "method", F.coalesce("lines", F.lit(0)).alias("lines"))


def replaced_lines(base: DataFrame, matched: DataFrame, scope: list[str]) -> DataFrame:
    """``base`` with the matched lines in place of those of the same player and scope."""
    return replace_scope(base, matched, ["player_id", *scope])
