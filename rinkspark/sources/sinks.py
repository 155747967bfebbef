"""Sinks: CSV with fixed columns, JSON, appends, and directories that are replaced as a whole with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Header CSV with ``columns`` in order; missing columns and nulls are blank."""
    cells = [(F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns]
    df.select(*cells).fillna("").write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def append_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    write_csv(df, path, columns, "append")


def write_nested(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def fixed_decimals(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as text with ``digits`` digits; null is blank."""
    return df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.format_string(f"%.{digits}f", f"`{c}`")).otherwise(F.lit("")).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes])


def _paths(spark: SparkSession, *paths: str) -> tuple:
    out = [spark._jvm.org.apache.hadoop.fs.Path(p.rstrip("/")) for p in paths]
    return out[0].getFileSystem(spark._jsc.hadoopConfiguration()), *out


def recover_directory(spark: SparkSession, target: str) -> bool:
    """Put the old directory back if a replacement stopped after it was moved aside; whether ``target`` exists then."""
    fs, at, old = _paths(spark, target, f"{target.rstrip('/')}.old")
    if not fs.exists(at) and fs.exists(old) and not fs.rename(old, at):
        raise OSError(f"{target}.old could not be moved back")
    return fs.exists(at)


def replace_directory(spark: SparkSession, staged: str, target: str) -> None:
    """Move ``staged`` to ``target``; the old target is moved aside first and removed last.

    Works on any file system that Hadoop knows. Between the two moves there is no target for a moment; if the job stops there,
    the old one is still whole, and ``recover_directory`` puts it back before the next read or replacement. Refuses paths of
    which one holds the other.
    """
    if f"{staged.rstrip('/')}/".startswith(f"{target.rstrip('/')}/") or f"{target.rstrip('/')}/".startswith(f"{staged.rstrip('/')}/"):
        raise ValueError("one path holds the other")
    fs, a, b, old = _paths(spark, staged, target, f"{target.rstrip('/')}.old")
    if not fs.exists(a):
        raise FileNotFoundError(staged)
    if recover_directory(spark, target):
        fs.delete(old, True)
        if not fs.rename(b, old):
            raise OSError(f"{target} could not be moved aside")
    if not fs.rename(a, b):
        recover_directory(spark, target)
        raise OSError(f"{staged} could not be moved to {target}")
    fs.delete(old, True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", "^.*?(?=[^/]+$)", "").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """(path, status) of files that were changed, added or removed since ``recorded`` (path, bytes, sha256)."""
    now = manifest(spark, path).select("path", F.col("sha256").alias("now"))
    both = now.join(recorded.select("path", F.col("sha256").alias("then")), "path", "full")
    status = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", status.alias("status")).filter("status is not null")
