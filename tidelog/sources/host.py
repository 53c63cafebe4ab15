"""Host samples: the output of ``uptime`` and ``free``, taken where this runs."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import hoststats


def _output(command: str) -> str | None:
    try:
        return subprocess.run([command], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def sample(spark: SparkSession) -> DataFrame:
    """One row: the parsed sample with metrics_ts; memory fields are NULL where ``free`` is missing."""
    row = spark.createDataFrame([(_output("uptime"), _output("free"))], "uptime string, free string")
    return row.select(F.current_timestamp().alias("metrics_ts"), *[c.alias(n) for n, c in (hoststats.uptime_columns(F.col("uptime")) | hoststats.memory_columns(F.col("free"))).items()])
