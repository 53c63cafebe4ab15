"""Bounded log sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.formats import trimmed


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, file) of every line of the files, trimmed at both ends; a last line without its end counts too."""
    raw = spark.read.text(list(paths))
    return raw.select(trimmed(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("file"))


def local_name(file: Column) -> Column:
    """A local file's path without its scheme, as configurations name files."""
    return F.when(file.startswith("file:"), F.url_decode(F.replace(F.regexp_replace(file, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))).otherwise(file)


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``lines`` with a number that grows in reading order within a file."""
    return lines(spark, *paths).withColumn("line_no", F.monotonically_increasing_id())


def skip_first(numbered: DataFrame, start_from: int) -> DataFrame:
    """Without the first ``start_from - 1`` lines of each file (one at least if it is positive); negative reads nothing."""
    if start_from < 0:
        return numbered.where(F.lit(False))
    if start_from == 0:
        return numbered
    skipped = max(1, start_from - 1)
    # Only the smallest numbers of a file are needed: a per-file limit before the one anti join.
    first = Window.partitionBy("file").orderBy("line_no")
    head = numbered.select("file", "line_no").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= skipped)
    return numbered.join(head.select("file", "line_no"), ["file", "line_no"], "left_anti")


def skip_first_of_each(numbered: DataFrame, most: int) -> DataFrame:
    """``skip_first`` by each line's own ``start_from``, of which ``most`` is the greatest."""
    kept = numbered.where("start_from >= 0")
    if most <= 0:
        return kept
    first = Window.partitionBy("file").orderBy("line_no")
    # The constant bound lets each task keep the first lines of a file only.
    head = kept.where("start_from > 0").select("file", "line_no", "start_from").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= max(1, most - 1))
    return kept.join(head.where("rn <= greatest(1, start_from - 1)").select("file", "line_no"), ["file", "line_no"], "left_anti")


def without_matching_own(df: DataFrame) -> DataFrame:
    """Without lines that match the ``skip_pattern`` that stands beside them."""
    return df.where(F.expr("skip_pattern = '' OR NOT value RLIKE skip_pattern"))


def without_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(~F.col("value").rlike(pattern)) if pattern else df
