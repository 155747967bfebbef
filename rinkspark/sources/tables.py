"""Table scans. Parquet tables by directory and name; header CSV with every cell a string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that stand for a missing number in typed cells.
NULL_MARKS = ("n/a", "na", "-", "—")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``directory`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is on its file system (any that Hadoop knows); an error other than absence is raised."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_csv_table(spark: SparkSession, path: str, columns: list[str], required: bool = True) -> DataFrame:
    """Header CSV as strings in the order of ``columns``; blanks become null, missing optional columns null.

    A required table that does not exist raises FileNotFoundError; an optional one is empty.
    """
    empty = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    if not path_exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return empty
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    have = set(raw.columns)
    return raw.select(*[(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in have else F.lit(None).cast("string")).alias(c) for c in columns])
