"""Staging of intermediate results and joins whose broadcast side is measured first."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counted at run time may be broadcast.
BROADCAST_ROWS = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a new local folder; on a cluster this raises, as the executors
    could not read a folder of the driver's machine.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rinkspark-ckpt-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Lineage is cut, so a lost executor costs a re-read of files and not a recomputation. ``wide`` is for rows that are
    small in bytes but dear in CPU: shuffles then keep their number of partitions instead of being merged by size.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not wide:
        return df.checkpoint(eager=True)
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.coalescePartitions.enabled"
    before = conf.get(name, "true")
    conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(name, before)


def tasks(df: DataFrame) -> int:
    """Partitions for a stage that is dear in CPU: three a core, and no fewer than other shuffles have."""
    spark = df.sparkSession
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting beyond them."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join with ``right`` (unique keys ``on``, narrow rows), broadcast only if it was counted to be small.

    Beyond ``rows`` the join shuffles; ``left`` is salted and ``right`` repeated ``salts`` times, so one key
    that holds a third of ``left`` is spread over ``salts`` tasks.
    """
    if fits_broadcast(right, rows):
        return left.join(F.broadcast(right), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")


def join_spread(left: DataFrame, right: DataFrame, on: str, load: int = 2_000) -> DataFrame:
    """Inner join with wide rows of ``right`` (unique keys ``on``); no task gets more than about ``load`` rows of one key.

    Keys that more rows of ``left`` hold are counted, and their rows split into parts of ``load``; only those rows of
    ``right`` are repeated, once a part. ``left`` is read twice: it should be staged.
    """
    hot = left.groupBy(on).agg(F.count("*").alias("__n")).filter(F.col("__n") > load)
    hot = stage(hot.select(on, F.ceil(F.col("__n") / load).cast("int").alias("__parts")))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.coalesce("__parts", F.lit(1))).cast("int")
    rows = join_checked(left, hot, on, "left").withColumn("__part", part).drop("__parts")
    wide = join_checked(right, hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return rows.join(wide, [on, "__part"]).drop("__part")
