"""Files that arrive over time: each batch runs the same replacement as a batch job, and dated rows wait for their day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linkage import replace_scope
from ..sources.sinks import recover_directory, replace_directory


def not_future(rows: DataFrame, column: str, day: str) -> DataFrame:
    """Rows dated up to ``day``; undated rows stay."""
    return rows.filter(F.col(column).isNull() | (F.col(column) <= F.lit(day).cast("date")))


def upsert_batches(spark: SparkSession, source: str, schema: str, target: str, scope: list[str], checkpoint: str):
    """A started query: every micro-batch of Parquet files below ``source`` replaces its scopes in the table ``target``.

    The table is written beside and moved; a batch that is run again after a failure gives the same table. Only a table that
    does not exist is empty: one that can't be read stops the stream and stays as it is.
    """

    def apply(batch: DataFrame, number: int) -> None:
        base = spark.read.parquet(target) if recover_directory(spark, target) else batch.limit(0)
        replace_scope(base, batch, scope).write.mode("overwrite").parquet(f"{target}.new")
        replace_directory(spark, f"{target}.new", target)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` per window and key; on a stream, rows later than ``late`` are left out."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
