"""Mixing sources to target shares of tokens, by hash-threshold histograms.

1. Tokens are counted by a public tokenizer. 2. The total is the largest at which every source can give its share with
at most ``max_repeats`` copies of each text (or a stated total, then short sources give all they may). 3. A source's
budget is some whole copies of all its texts and a remainder. The remainder is drawn by a threshold on a 60-bit hash of
the id: tokens are summed by source and 12-bit hash bucket, the bucket in which the budget ends is found, and only the
texts of that boundary bucket are summed again by the next 12 bits, up to five times. 4. Texts below the threshold are
kept by a filter; nothing is sorted, and a source may hold any share of the rows. A larger total keeps every text of a
smaller one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import join_checked, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BITS, LEVELS = 12, 5


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``tokens`` (bigint) of the whole text; a null or empty text has none."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("tokens", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(tokenizer).encode_batch_fast
        for batch in batches:
            texts = batch["__text"].fillna("").tolist()
            sizes = [len(e.ids) for i in range(0, len(texts), 256) for e in encode(texts[i : i + 256], add_special_tokens=False)]
            yield batch[keep].assign(tokens=pd.Series(sizes, index=batch.index, dtype="int64"))

    return docs.select(*keep, F.col(text).alias("__text")).mapInPandas(count, schema)


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, whole, remainder) of each targeted source.

    Repeated targets count once (largest share). A source without texts or with a share of 0 gets no budget; it does
    not hold the others back, as no repetition can serve it.
    """
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    able = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("available") * F.greatest("max_repeats", F.lit(0)) / F.col("target_share"))
    most = F.lit(float(total)) if total is not None else F.coalesce(F.min(able).over(Window.partitionBy()), F.lit(0.0))  # one row a targeted source
    budget = F.least(most * F.coalesce("target_share", F.lit(0.0)), F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("double"))
    out = rows.withColumn("budget", F.round(budget).cast("bigint"))
    whole = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("bigint")
    return out.withColumn("whole", whole).withColumn("remainder", F.col("budget") - F.col("whole") * F.col("available"))


def thresholds(counted: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, threshold): texts with a smaller hash sum to the source's remainder, as near as whole texts allow.

    Only the texts of the boundary buckets, one in 4,096, go on to the next level.
    """
    state = stage(plan.select("source", F.lit(0).cast("bigint").alias("floor"), F.col("remainder").alias("left")))
    rows = counted.select("source", "hash", "tokens")
    for level in range(LEVELS):
        final = level == LEVELS - 1
        width = F.lit(1 << BITS * (LEVELS - level - 1)).cast("bigint")
        inside = join_checked(rows, state, "source").filter((F.col("hash") >= F.col("floor")) & (F.col("hash") < F.col("floor") + width * (1 << BITS)))
        if level:
            inside = stage(inside)
            rows = inside.select("source", "hash", "tokens")
        bucket = F.floor((F.col("hash") - F.col("floor")) / width).cast("int")
        sums = inside.groupBy("source", "floor", "left", bucket.alias("bucket")).agg(F.sum("tokens").alias("t"))
        run = F.sum("t").over(Window.partitionBy("source").orderBy("bucket"))  # at most 4,096 rows a source
        ends = sums.withColumn("upto", run).groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"), "t"))).alias("e"), F.max("upto").alias("all")
        )
        state = state.join(ends, "source", "left")
        step = F.col("e.bucket") + (F.lit(1) if final else F.lit(0)) * (2 * (F.col("left") - F.col("e.before")) >= F.col("e.t")).cast("int")
        state = stage(
            state.select(
                "source",
                F.when(F.col("e").isNotNull(), F.col("floor") + step * width).when(F.col("all").isNotNull(), F.col("floor") + width * (1 << BITS)).otherwise(F.col("floor")).alias("floor"),
                F.when(F.col("e").isNotNull(), F.col("left") - F.col("e.before")).otherwise(F.col("left") - F.coalesce("all", F.lit(0))).alias("left"),
            )
        )
    return state.select("source", F.col("floor").alias("threshold"))


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The drawn texts (doc_id, source, tokens, copies) and the report of shares.

    ``copies`` is 1 or more and at most max_repeats. Texts of a null or untargeted source are not drawn; texts without
    tokens come with their source's whole copies. Rows of one id are drawn together. The report has a row a targeted
    source: source, target_share, max_repeats, available_tokens, budget_tokens, drawn_tokens, drawn_texts, share.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = token_counts(named.filter("source is not null"), ["doc_id", "source"], tokenizer=tokenizer)
    counted = stage(counted.withColumn("hash", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << BITS * LEVELS) - 1))))
    plan = stage(budgets(counted.groupBy("source").agg(F.sum("tokens").alias("available")), targets, total))
    limits = stage(plan.select("source", "whole").join(thresholds(counted, plan), "source"))
    copies = F.col("whole") + (F.col("hash") < F.col("threshold")).cast("bigint")
    drawn = join_checked(counted, limits, "source").select("doc_id", "source", "tokens", copies.alias("copies")).filter("copies > 0")
    sums = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_texts"))
    every = Window.partitionBy()  # one row a targeted source
    report = plan.join(sums, "source", "left").fillna(0, ["drawn_tokens", "drawn_texts"])
    report = report.withColumn("share", F.try_divide(F.col("drawn_tokens"), F.sum("drawn_tokens").over(every)))
    return drawn, report.select("source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"), "drawn_tokens", "drawn_texts", "share")
