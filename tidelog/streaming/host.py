"""A host sampler on a processing-time trigger, aligned to minute marks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import hoststats
from tidelog.plans.config import next_run_minute
from tidelog.sources import host


def start_host_sampler(spark: SparkSession, host_id: int, save: Callable[[DataFrame], None], checkpoint: str, every_minutes: int = 5, aligned: bool = True) -> StreamingQuery:
    """Gives one host-metric row to ``save`` at each mark. The driver's host is sampled."""
    if aligned:
        now = time.localtime()
        wait = next_run_minute(now.tm_min, every_minutes) * 60 - now.tm_sec
        time.sleep(max(0, wait))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: save(hoststats.host_rows(host.sample(spark), host_id))).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every_minutes} minutes").start()
