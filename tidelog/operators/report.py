"""Console reports from small collected tops."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import counters
from tidelog.operators.sinks import live_json


def top_report(counts: dict[tuple[str, str], int], n: int = 10, previous: dict[tuple[str, str], int] | None = None) -> str:
    """The top keys of each printed dimension from (dimension, key) counts; with ``previous`` ones, changes in parentheses."""
    lines = []
    for dimension in counters.PRINTED:
        mine = sorted(((key, c) for (d, key), c in counts.items() if d == dimension), key=lambda x: (-x[1], x[0] or ""))[: max(1, n)]
        width = min(15, max([10, *(len(key or "") for key, _ in mine)]))
        lines.append(f"--- {dimension} ---")
        for key, c in mine:
            delta = "" if previous is None else f" (+{c - previous.get((dimension, key), 0)})"
            lines.append(f"{(key or '-not set-')[:width]:<{width}} {c}{delta}")
    return "\n".join(lines)


def counter_report(requests: DataFrame, n: int = 10, previous: dict[tuple[str, str], int] | None = None, rejected: int | None = None) -> str:
    """Totals, with the lines read where ``rejected`` ones are known, and the top keys of each printed dimension."""
    total = counters.totals(requests).first().asDict()
    if rejected is not None:
        total = {"lines": total["requests"] + rejected, "rejected": rejected} | total
    tops = {(r.dimension, r.key): r.n for r in counters.top(counters.by_dimension(requests, counters.PRINTED), n).collect()}
    return "\n".join([f"{k}: {v}" for k, v in total.items()] + [top_report(tops, n, previous)])


def sums_report(counts: dict[tuple[str, str], int], before: dict[tuple[str, str], int] | None, n: int = 10) -> str:
    """A report of counts as ``counters.report_counts`` gives them: sums, then tops, with changes where there are counts to compare with."""
    change = lambda d: "" if before is None else f" (+{counts.get((d, ''), 0) - before.get((d, ''), 0)})"
    lines = [f"{d}: {counts.get((d, ''), 0)}{change(d)}" for d in counters.SUMS if (d, "") in counts or d == "lines"]
    return "\n".join([*lines, top_report(counts, n, before)])


def live_report(counts: dict[tuple[str, str], int], before: dict[tuple[str, str], int], n: int = 10) -> str:
    """A report of a running count: the lines so far and the tops, with changes since the report before."""
    return sums_report(counts, before, n)


def metrics_reports(rolled: DataFrame, slots: Column | None = None, most_keys: int = 1000, by: tuple[str, ...] = ("file",)) -> dict[tuple, str]:
    """{type: {key: {"Values": {window: n}}}} for each value of ``by``, in one pass, of each key's newest ``slots`` windows where given.

    A type's ``most_keys`` largest keys are shown, as a console dump must fit the driver; ``write_metrics`` and the metric table have all of them.
    """
    newest = Window.partitionBy(*by, "metric_type", "key_value").orderBy(F.desc("time_window"))
    live = rolled if slots is None else rolled.withColumn("_slots", slots).withColumn("_nth", F.row_number().over(newest)).where("_nth <= _slots").drop("_slots", "_nth")
    size = live.groupBy(*by, "metric_type", "key_value").agg(F.sum("metric_value").alias("size"))
    nth = F.row_number().over(Window.partitionBy(*by, "metric_type").orderBy(F.desc("size"), "key_value"))
    shown = size.withColumn("nth", nth).where(F.col("nth") <= most_keys).select(*by, "metric_type", "key_value")
    found: dict[tuple, dict] = {}
    for r in live_json(live.join(shown, [*by, "metric_type", "key_value"]), by).collect():
        found.setdefault(tuple(r[b] for b in by), {}).setdefault(str(r.metric_type), {})[r.key_value] = json.loads(r.value)
    return {k: json.dumps(v, indent=4, sort_keys=True) for k, v in found.items()}


def metrics_report(rolled: DataFrame, slots: int | None = None, most_keys: int = 1000) -> str:
    """``metrics_reports`` of one whole."""
    return metrics_reports(rolled, None if slots is None else F.lit(slots), most_keys, ()).get((), "{}")


def write_metrics(rolled: DataFrame, directory: str) -> None:
    """What ``metrics_report`` shows, of all keys: a line of JSON each, written by the executors."""
    keys = live_json(rolled).withColumn("values", F.from_json("value", "struct<Values: map<string, bigint>>"))
    keys.select(F.to_json(F.struct("metric_type", "key_value", "values.Values")).alias("value")).write.mode("append").text(directory)
