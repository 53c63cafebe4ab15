"""Metric cells per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import timebin

# Numbers of the metric types.
METRIC_TYPES = {"req_count": 1, "bytes": 2, "status": 3, "client_ip": 4, "method": 5, "referer": 6, "path": 7, "family": 11, "os": 12, "device": 13, "human": 14, "intent": 15}


def agent_field(name: str, default: str) -> Column:
    """A user-agent attribute; requests without an agent count with the default."""
    return F.coalesce(F.col(f"user_agent.{name}"), F.lit(default))


def cells(requests: DataFrame, keep: list[str] = (), types: tuple[str, ...] | None = None) -> DataFrame:
    """Up to thirteen (metric_type, key_value, value) rows for each request, next to the columns named in ``keep``.

    Of ``types`` only, where given: what the others need is then never computed.
    """
    ok = F.col("status").startswith("2")

    def cell(kind: str, key: Column, value: Column = None, when: Column = None) -> Column | None:
        if types is not None and kind not in types:
            return None
        made = F.struct(F.lit(METRIC_TYPES[kind]).alias("metric_type"), key.alias("key_value"), (F.lit(1) if value is None else value).cast("bigint").alias("value"))
        return made if when is None else F.when(when, made)

    every = [
        cell("req_count", F.lit("")),
        cell("bytes", F.lit(""), F.col("bytes_sent")),
        cell("status", F.col("status")),
        cell("method", F.col("method")),
        cell("referer", F.col("referer"), when=F.col("referer") != ""),
        cell("path", F.col("path1"), when=ok),
        cell("path", F.col("path2"), when=ok & (F.col("path2") != "")),
        cell("path", F.col("path3"), when=ok & (F.col("path3") != "")),
        cell("family", agent_field("family", "Other")),
        cell("os", agent_field("os", "Other")),
        cell("device", agent_field("device_type", "Unknown")),
        cell("human", agent_field("human", "Unknown")),
        cell("intent", agent_field("intent", "Unknown")),
    ]
    every = F.array(*[c for c in every if c is not None])
    return requests.select(*keep, F.explode(F.filter(every, lambda c: c.isNotNull())).alias("c")).select(*keep, "c.metric_type", "c.key_value", "c.value")


def rollup(requests: DataFrame, minutes: int | Column = 10, by: list[str] = (), types: tuple[str, ...] | None = None) -> DataFrame:
    """Sums by (metric_type, key_value, time_window); lines without a readable timestamp have no window and are left out.

    The unpivot happens map-side, sums are partial before the one shuffle.
    """
    windowed = requests.where(F.col("ts_wall").isNotNull()).withColumn("time_window", timebin.window_id(F.col("ts_wall"), minutes))
    made = cells(windowed, [*by, "time_window"], types)
    return made.groupBy(*by, "metric_type", "key_value", "time_window").agg(F.sum("value").alias("metric_value"))


def live_windows(rolled: DataFrame, slots: int) -> DataFrame:
    """Each cell's windows with ``live`` for the newest ``slots`` of a key, the others being evicted."""
    from pyspark.sql import Window

    newest = Window.partitionBy("metric_type", "key_value").orderBy(F.desc("time_window"))
    return rolled.withColumn("live", F.row_number().over(newest) <= slots)
