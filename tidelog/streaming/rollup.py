"""Streaming rollups and counters."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidelog.functions import timebin
from tidelog.operators import counters, parse
from tidelog.operators.rollup import cells
from tidelog.operators.sinks import MetricTable
from tidelog.operators.versions import Versions
from tidelog.streaming import slots


def windowed(requests: DataFrame, minutes: int, slots: int | None) -> DataFrame:
    """Sums per tumbling wall-clock window; with ``slots`` a watermark of so many windows closes them."""
    timed = requests.where(F.col("ts_wall").isNotNull())
    if slots:
        timed = timed.withWatermark("ts_wall", f"{slots * timebin.window_size(minutes)} minutes")
    made = cells(timed, ["ts_wall"])
    size = timebin.window_size(minutes)
    grouped = made.groupBy(F.window("ts_wall", f"{size} minutes").alias("w"), "metric_type", "key_value").agg(F.sum("value").alias("metric_value"))
    return grouped.select("metric_type", "key_value", F.date_format("w.start", "yyyyMMddHHmm").cast("bigint").alias("time_window"), "metric_value")


def start_bounded(lines: DataFrame, minutes: int, table: MetricTable, domain_id: int, checkpoint: str) -> StreamingQuery:
    """Everything there is, once, into a metric table: cells that a batch changed replace what the table had of them."""
    out = windowed(parse.requests(lines), minutes, None)
    return _saved(out, table, domain_id, True, checkpoint).outputMode("update").trigger(availableNow=True).start()


def _saved(out: DataFrame, table: MetricTable, domain_id: int, replace: bool, checkpoint: str) -> DataStreamWriter:
    def save(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch.withColumn("domain_id", F.lit(domain_id).cast("bigint")), replace, checkpoint, batch_id)

    return out.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def start_metrics(lines: DataFrame, table: MetricTable, domain_id: int, minutes: int, slots: int, checkpoint: str, replace: bool = True, every: str = "10 seconds", available_now: bool = False) -> StreamingQuery:
    """Closed windows into a metric table; late rows are dropped by the watermark, replayed batches are skipped."""
    out = windowed(parse.requests(lines), minutes, slots)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return _saved(out, table, domain_id, replace, checkpoint).outputMode("append").trigger(**trigger).start()


class Tops:
    """The largest keys of each dimension, from the counts that changed; of each file, where counts have one.

    Counts only grow, so a key that did not change enters no top: the tops of the changed keys and the tops before are all that is
    needed. ``WIDER`` times as many keys as are shown are held, with their counts at the last report. With ``versions`` what is held is written
    with each batch and read at the start, so that changes are those since the last report also after a restart or when a batch is repeated.
    """

    WIDER = 20

    def __init__(self, n: int, versions: Versions | None = None) -> None:
        self.n, self.versions = max(1, n), versions
        self.counts: dict[tuple[str, ...], int] = {}

    def update(self, changed: DataFrame, batch_id: int | None = None) -> tuple[dict[tuple[str, ...], int], dict[tuple[str, ...], int]]:
        """(counts, counts before) of the held keys after a batch of changed (file, dimension, key, n); new keys had none before.

        Rows that have ``left`` true are of keys that left the state with these counts: they are held no more.
        """
        by = tuple(c for c in ("file",) if c in changed.columns)
        before = self.counts
        if self.versions is not None:
            held = self.versions.newest(batch_id) or {"counts": []}
            before = {tuple(k): n for *k, n in held["counts"]}
        now = dict(before)
        rows = changed
        if "left" in changed.columns:
            for r in counters.top(changed.where("left").drop("left"), self.WIDER * self.n, by).collect():
                now.pop((*[r[b] for b in by], r.dimension, r.key), None)
            rows = changed.where("NOT left").drop("left")
        now.update({(*[r[b] for b in by], r.dimension, r.key): r.n for r in counters.top(rows, self.WIDER * self.n, by).collect()})
        groups: dict[tuple, list] = {}
        for k, n in now.items():
            groups.setdefault(k[:-1], []).append((k, n))
        held = {}
        for mine in groups.values():
            held.update(sorted(mine, key=lambda x: (-x[1], x[0][-1] or ""))[: self.WIDER * self.n])
        self.counts = held
        if self.versions is not None and batch_id not in self.versions.numbers():
            self.versions.publish({"n": batch_id, "counts": [[*k, n] for k, n in held.items()]})
        return held, before


def start_counters(lines: DataFrame, show: Callable[[dict, dict], None], checkpoint: str, top_n: int = 10, every: str = "30 seconds", by: tuple[str, ...] = (), idle_minutes: float | None = None) -> StreamingQuery:
    """Exact running sums and counts by dimension, rejected lines included; ``show`` gets the largest ones and what they were at the trigger before.

    Each trigger emits only the keys that it changed; the totals of all keys are in the state store. With ``idle_minutes`` keys that have no line for so
    long, by the machine's clock, leave it; should they come back, they count from nothing.
    """
    spark, found = lines.sparkSession, parse.detect(lines)
    every_line = parse.to_requests(parse.of_first_format(found) if "first_format" in lines.columns else found, keep_rejected=True)
    tops = Tops(top_n, Versions(spark, f"{checkpoint}-tops"))
    if idle_minutes is None:
        counted = counters.report_counts(every_line, by)
    else:
        counted = slots.running_counts(every_line, by, idle_minutes)
    with slots.state_in_rocksdb(spark) if idle_minutes is not None else nullcontext():
        return counted.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: show(*tops.update(batch, batch_id))).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def start_sketches(lines: DataFrame, folder: str, checkpoint: str, minutes: int = 60, every: str | None = None) -> StreamingQuery:
    """Heavy hitters of each window and batch as sketches in a folder, from which ``counters.top_of_sketches`` answers for any windows, batches and runs.

    A repeated batch writes its own part anew. With ``every`` the stream goes on, else it ends with its input.
    """
    timed = parse.requests(lines).where(F.col("ts_wall").isNotNull()).withColumn("time_window", timebin.window_id(F.col("ts_wall"), minutes))
    run = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def save(batch: DataFrame, batch_id: int) -> None:
        counters.sketches(batch, by=("time_window",)).write.mode("overwrite").parquet(f"{folder}/run={run}/batch={batch_id}")

    writer = timed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
