"""Running totals, counts by dimension, top-N and change since the window before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.rollup import agent_field

DIMENSIONS = {
    "lines": lambda: F.lit(""),
    "client": lambda: F.col("client_ip"),
    "device": lambda: agent_field("device_type", "Unknown"),
    "intent": lambda: agent_field("intent", "Unknown"),
    "method": lambda: F.col("method"),
    "status": lambda: F.col("status"),
    "family": lambda: agent_field("family", "Other"),
    "os": lambda: agent_field("os", "Other"),
    "referer": lambda: F.col("referer"),
    "path": lambda: F.col("path"),
}
#: Printed dimensions in order, and those cut to the top N.
PRINTED = ("intent", "status", "method", "family", "os", "client", "referer", "path")
TOP_DIMENSIONS = ("client", "referer", "path")


def totals(requests: DataFrame) -> DataFrame:
    human = agent_field("human", "Unknown")
    return requests.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(human == "Human").alias("humans"),
        F.count_if(human == "NonHuman").alias("non_humans"),
        F.count_if(F.col("malicious") != 0).alias("malicious"),
    )


def by_dimension(requests: DataFrame, dimensions: tuple[str, ...] = tuple(d for d in DIMENSIONS if d != "lines")) -> DataFrame:
    """(dimension, key, n) of all dimensions in one pass."""
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), DIMENSIONS[d]().alias("key")) for d in dimensions])
    return requests.select(F.explode(each).alias("d")).groupBy("d.dimension", "d.key").agg(F.count("*").alias("n"))


#: Sums over all lines, in the order they are printed.
SUMS = ("lines", "rejected", "requests", "bytes", "humans", "non_humans", "malicious")


def report_rows(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, dimension, key, n): what each line adds to a report, from accepted lines and rejected ones (``to_requests(keep_rejected=True)``)."""
    human, ok = agent_field("human", "Unknown"), F.col("format").isNotNull()
    ones = {"lines": F.lit(1), "rejected": F.when(~ok, 1), "requests": F.when(ok, 1), "bytes": F.col("bytes_sent"), "humans": F.when(human == "Human", 1), "non_humans": F.when(human == "NonHuman", 1), "malicious": F.when(F.col("malicious") != 0, 1)}
    add = lambda d, key, n: F.struct(F.lit(d).alias("dimension"), key.alias("key"), n.cast("bigint").alias("n"))
    sums = [add(d, F.lit(""), F.when(ok, ones[d]) if d not in ("lines", "rejected") else ones[d]) for d in SUMS]
    keyed = [add(d, DIMENSIONS[d](), F.when(ok, 1)) for d in PRINTED]
    return lines.select(*by, F.explode(F.filter(F.array(*sums, *keyed), lambda x: x["n"].isNotNull())).alias("d")).select(*by, "d.dimension", "d.key", "d.n")


def report_counts(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All sums and counts of a report, in one pass."""
    return report_rows(lines, by).groupBy(*by, "dimension", "key").agg(F.sum("n").alias("n"))


def top(counts: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The n largest keys of each dimension (of each value of ``by``), ties by key; n below one keeps one."""
    order = Window.partitionBy(*by, "dimension").orderBy(F.desc("n"), F.asc("key"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, n))


def top_of(requests: DataFrame, dimension: str, n: int) -> DataFrame:
    """The n largest keys of one dimension: partial tops meet in one small task."""
    counts = requests.groupBy(DIMENSIONS[dimension]().alias("key")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("key")).limit(max(1, n))


#: Keys that a sketch tracks; it is exact while there are no more, see ``sketch_error``.
TRACKED = 4096


def sketches(requests: DataFrame, dimensions: tuple[str, ...] = TOP_DIMENSIONS, by: tuple[str, ...] = (), tracked: int = TRACKED) -> DataFrame:
    """(by, dimension, lines, sketch): heavy hitters of each dimension, in bounded memory whatever the number of keys.

    Sketches are tables like others: those of windows, batches or runs may be kept and merged later.
    """
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(DIMENSIONS[d](), F.lit("")).alias("key")) for d in dimensions])
    keyed = requests.select(*by, F.explode(each).alias("d")).select(*by, "d.dimension", "d.key")
    return keyed.groupBy(*by, "dimension").agg(F.count("*").alias("lines"), F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("sketch"))


def merged_sketches(made: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of the same dimension (and ``by``) as one."""
    return made.groupBy(*by, "dimension").agg(F.sum("lines").alias("lines"), F.expr("approx_top_k_combine(sketch)").alias("sketch"))


def sketch_error(lines: Column, tracked: Column) -> Column:
    """By how much a count of a sketch may be off: 3.5 / m of all lines, m being the power of two from 4/3 of the tracked keys on."""
    size = F.pow(F.lit(2.0), F.ceil(F.log2(tracked / 0.75)))
    return F.ceil(3.5 * lines / size).cast("bigint")


def top_of_sketches(made: DataFrame, n: int, by: tuple[str, ...] = (), tracked: int = TRACKED) -> DataFrame:
    """(by, dimension, key, n, error, rank) of the n largest keys, ties by key. Counts are off by ``error`` at most.

    Keys with more than twice ``error`` of the lines are there. ``tracked`` is what the sketches were made with.
    """
    whole = merged_sketches(made, by).withColumn("tracked", F.col("sketch.maxItemsTracked"))
    # All that are tracked, so that ties at the end go by key.
    listed = whole.select(*by, "dimension", sketch_error(F.col("lines"), F.col("tracked")).alias("error"), F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("t"))
    order = Window.partitionBy(*by, "dimension").orderBy(F.desc("n"), F.asc("key"))
    return listed.select(*by, "dimension", F.col("t.item").alias("key"), F.col("t.count").alias("n"), "error").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, n))


def approximate_top(requests: DataFrame, dimension: str, n: int) -> DataFrame:
    """(key, n) of one dimension's heavy hitters."""
    return top_of_sketches(sketches(requests, (dimension,), tracked=max(TRACKED, n)), n, tracked=max(TRACKED, n)).select("key", "n")


def change(rolled: DataFrame) -> DataFrame:
    """Each cell's value and its change against the window before."""
    before = Window.partitionBy("metric_type", "key_value").orderBy("time_window")
    return rolled.withColumn("delta", F.col("metric_value") - F.coalesce(F.lag("metric_value").over(before), F.lit(0)))
