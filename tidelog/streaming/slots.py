"""Live windows of each key, kept as state: a key has so many slots, and a new window takes the place of its oldest one.

A line is counted if its window is among the newest ``slots`` windows that its key has had, itself included, when it arrives; later ones are
dropped. A window that leaves its slot is emitted with its sum, once: it cannot come back, as it is older than all that are live. With ``idle_minutes`` a key
that has no line for so long, by the clock of the log, leaves the state and its live windows are emitted; lines that lie
as far behind the newest one are dropped before they reach a key.

State is one map of a few windows for each key, in RocksDB on the executors. Lines of a key that follow each other in one window are summed
before they are shuffled, so a key that stands in every line sends a few rows a batch and its task stays small.
What is live when a bounded run ends is read from the state (``live``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidelog.functions import timebin
from tidelog.operators import counters, rollup
from tidelog.operators.sinks import MetricTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTS = "spark.sql.shuffle.partitions"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class state_in_rocksdb:
    """A context in which streams keep their state where maps and timers can be kept; sessions start with a store that has none.

    A stream that begins here has ``parts`` stores, where given, else as many as the session's shuffles have parts; each costs a start of a worker a batch.
    """

    def __init__(self, spark: SparkSession, parts: int | None = None) -> None:
        self.spark = spark
        self.settings = {_PROVIDER: _ROCKS} | ({_PARTS: str(parts)} if parts else {})

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def stretches(cells: DataFrame, keys: list[str], block: int | None = None) -> DataFrame:
    """``cells`` (keys, time_window, place, seen_ms, value) with neighbouring ones of a key and window as one: first place, newest time, sum.

    Neighbours within an Arrow batch are summed. Nothing is lost by that where each partition holds lines that arrived one after the other, or, with ``block``,
    all lines of each so many places one after the other: neighbours of two blocks stay apart, as others may have arrived between them.
    """
    key_columns = [*keys, "time_window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).sort_by([(k, "ascending") for k in [*keys, "place"]])
            new = np.zeros(len(t), bool)
            new[0] = True
            for k in key_columns:
                codes = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            if block is not None:
                blocks = t.column("place").to_numpy() // block
                new[1:] |= blocks[1:] != blocks[:-1]
            at = np.flatnonzero(new)
            sums = np.add.reduceat(t.column("value").to_numpy(), at)
            seen = np.maximum.reduceat(t.column("seen_ms").to_numpy(), at)
            first = t.take(pa.array(at))
            columns = {"value": pa.array(sums, pa.int64()), "seen_ms": pa.array(seen, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(n, first.column(n).combine_chunks()) for n in t.column_names], schema=batch.schema)

    return cells.mapInArrow(run, cells.schema)


class Slots(StatefulProcessor):
    """(key, time_window, metric_value) of windows that leave the slots of their key; rows say how many it has."""

    def __init__(self, keys: list[str], timed: bool) -> None:
        self.keys, self.timed = keys, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "time_window bigint", "metric_value bigint")
        if self.timed:
            self.seen = handle.getValueState("seen", "ms bigint")

    def _left(self, key: tuple, gone: list[tuple[int, int]]) -> pd.DataFrame:
        columns = {k: [x] * len(gone) for k, x in zip(self.keys, key, strict=True)}
        columns |= {"time_window": [w for w, _ in gone], "metric_value": [v for _, v in gone]}
        # Plain objects, as Arrow has no single array for pandas' own strings.
        return pd.DataFrame({k: pd.Series(x, dtype=object) for k, x in columns.items()})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = {w[0]: v[0] for w, v in self.windows.iterator()} if self.windows.exists() else {}
        live, gone = dict(had), []
        arrived = pd.concat(list(rows)).sort_values("place", kind="stable")
        slots = int(arrived["slots"].iloc[-1])
        for window, value in zip(arrived["time_window"].tolist(), arrived["value"].tolist(), strict=True):
            if window in live:
                live[window] += value
            elif len(live) < slots:
                live[window] = value
            elif window > (oldest := min(live)):
                gone.append((oldest, live.pop(oldest)))
                live[window] = value
        for window in had.keys() - live.keys():
            self.windows.removeKey((window,))
        for window, value in live.items():
            if had.get(window) != value:
                self.windows.updateValue((window,), (value,))
        if self.timed:
            newest = int(arrived["seen_ms"].max())
            before = self.seen.get()[0] if self.seen.exists() else None
            if before is None or newest > before:
                self.seen.update((newest,))
            if before is None:
                self.handle.registerTimer(newest)
        yield self._left(key, gone)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        if seen > timerValues.getCurrentWatermarkInMs():
            # Lines came since the timer was set: one timer a key, moved when it goes off.
            self.handle.registerTimer(seen)
            yield self._left(key, [])
            return
        gone = sorted((w[0], v[0]) for w, v in self.windows.iterator()) if self.windows.exists() else []
        self.windows.clear()
        self.seen.clear()
        yield self._left(key, gone)

    def close(self) -> None:
        pass


def slot_windows(requests: DataFrame, minutes: int | Column, slots: int | Column, place: str, by: tuple[str, ...] = (), idle_minutes: int | None = None, in_order: bool = True, block: int | None = None) -> DataFrame:
    """(by, metric_type, key_value, time_window, metric_value) of windows as they leave their slots, of a stream.

    ``place`` is a number that grows as lines arrive, within a batch at least. Each value of ``by`` has slots of its own, and may have its own
    size and number of windows. ``in_order`` says that each partition holds lines that arrived one after the other, as those of the tail source and of
    whole files do; without it every cell is shuffled by itself. With ``block`` that is said of the lines of each so many places only, all in one partition.
    """
    if isinstance(slots, int) and slots < 1:
        raise ValueError("a key has one slot at least")
    many = F.lit(slots) if isinstance(slots, int) else F.greatest(slots, F.lit(1))
    made = {"time_window": timebin.window_id(F.col("ts_wall"), minutes), "place": F.col(place).cast("bigint"), "seen_ms": F.unix_millis("ts_wall"), "slots": many.cast("int")}
    timed = requests.where(F.col("ts_wall").isNotNull()).withColumns(made)
    keys = [*by, "metric_type", "key_value"]
    cells = rollup.cells(timed, [*by, "time_window", "place", "seen_ms", "slots"])
    cells = stretches(cells, keys, block) if in_order else cells
    mode = "none"
    if idle_minutes is not None:
        cells, mode = cells.withColumn("seen", F.timestamp_millis("seen_ms")).withWatermark("seen", f"{idle_minutes} minutes"), "eventTime"
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", time_window bigint, metric_value bigint"
    return cells.groupBy(*keys).transformWithStateInPandas(Slots(keys, idle_minutes is not None), schema, "Append", mode)


class Counts(StatefulProcessor):
    """(key, n, left): the running sum of each key that a batch has, and the last one of a key that has had no line for so many milliseconds."""

    def __init__(self, keys: list[str], idle_ms: int) -> None:
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n bigint, ms bigint")

    def _rows(self, key: tuple, *found: tuple[int, bool]) -> pd.DataFrame:
        columns = {k: [x] * len(found) for k, x in zip(self.keys, key, strict=True)} | {"n": [n for n, _ in found], "left": [left for _, left in found]}
        return pd.DataFrame({k: pd.Series(x, dtype=object) for k, x in columns.items()})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had, now = self.sums.get() if self.sums.exists() else None, timerValues.getCurrentProcessingTimeInMs()
        n = sum(int(r["n"].sum()) for r in rows)
        if had is None:
            self.handle.registerTimer(now + self.idle_ms)
        else:
            n += had[0]
        self.sums.update((n, now))
        yield self._rows(key, (n, False))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, seen = self.sums.get()
        if seen + self.idle_ms > timerValues.getCurrentProcessingTimeInMs():
            # Lines came since the timer was set: one timer a key, moved when it goes off.
            self.handle.registerTimer(seen + self.idle_ms)
            yield self._rows(key)
            return
        self.sums.clear()
        yield self._rows(key, (n, True))

    def close(self) -> None:
        pass


def running_counts(lines: DataFrame, by: tuple[str, ...], idle_minutes: float) -> DataFrame:
    """(by, dimension, key, n, left) of a stream of accepted and rejected lines, from state that keys leave which have had no line for so long by the machine's clock.

    Rows are summed within an Arrow batch before they are shuffled.
    """
    keys = [*by, "dimension", "key"]
    rows = counters.report_rows(lines, by)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).cast(batch.schema)
            yield from t.combine_chunks().to_batches()

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n bigint, left boolean"
    return rows.select(*keys, "n").mapInArrow(summed, rows.schema).groupBy(*keys).transformWithStateInPandas(Counts(keys, round(idle_minutes * 60_000)), schema, "Update", "processingTime")


def live(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(keys, time_window, metric_value) of the windows that are in the state of a stopped stream of ``slot_windows``."""
    with state_in_rocksdb(spark):
        state = spark.read.format("statestore").option("stateVarName", "windows").load(checkpoint)
        return state.select("key.*", F.col("user_map_key.time_window").alias("time_window"), F.col("user_map_value.metric_value").alias("metric_value"))


def start_slots(requests: DataFrame, minutes: int, slots: int, place: str, table: MetricTable, domain_id: int, checkpoint: str, replace: bool = True, every: str | None = None, idle_minutes: int | None = None, in_order: bool = True, block: int | None = None, parts: int | None = None) -> StreamingQuery:
    """Windows into a metric table as they leave their slots; with ``every`` a running stream, else one that ends with its input (see ``flush``)."""
    out = slot_windows(requests, minutes, slots, place, (), idle_minutes, in_order, block)

    def save(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch.withColumn("domain_id", F.lit(domain_id).cast("bigint")), replace, checkpoint, batch_id)

    with state_in_rocksdb(out.sparkSession, parts):
        writer = out.writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def flush(spark: SparkSession, table: MetricTable, domain_id: int, checkpoint: str, replace: bool = True) -> None:
    """The live windows of a stream that has ended into its table, once: what was emitted before is never live."""
    table.upsert(live(spark, checkpoint).withColumn("domain_id", F.lit(domain_id).cast("bigint")), replace, f"{checkpoint}#end", 0)
