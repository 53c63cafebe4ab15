"""Lines to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import agents, formats, threats, timebin, urls
from tidelog.functions.formats import part

#: Files whose formats are sent to all executors; lines of more files meet them by a shuffle.
BROADCAST_FILES = 100_000
#: Lines of a file whose order is looked at in one task.
BLOCK = 100_000


def detect(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``lines`` with ``parts`` and ``format``; rejected lines have a NULL format."""
    return formats.capture(lines.withColumn(line_col, formats.trimmed(F.col(line_col))), line_col)


def first_formats(detected: DataFrame, file_col: str, order_col: str) -> DataFrame:
    """(file, first_format) of each file: the format of its first accepted line.

    A line that fits several formats counts as the first of nginx_custom, nginx, vhost, combined and common that it fits (``capture``).
    """
    return detected.where("format is not null").groupBy(file_col).agg(F.min_by("format", order_col).alias("first_format"))


def with_first_format(detected: DataFrame, file_col: str, order_col: str) -> DataFrame:
    """``detected`` with its file's ``first_format``: one row a file is joined back."""
    first = first_formats(detected, file_col, order_col)
    if not detected.isStreaming and detected.select(file_col).distinct().limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        first = F.broadcast(first)
    return detected.join(first, file_col, "left")


def of_first_format(detected: DataFrame) -> DataFrame:
    """Lines that don't fit their file's ``first_format`` are rejected like those that fit no format.

    A file's lines are all read as its first one is, so what is read as nginx where any format may come is a combined line in a combined file.
    """
    read_as = F.when(F.col("format") == F.col("first_format"), F.col("format")).when((F.col("first_format") == "combined") & (F.col("format") == "nginx"), "combined")
    return detected.withColumn("format", read_as).drop("first_format")


def keep_first_format(detected: DataFrame, file_col: str, order_col: str) -> DataFrame:
    """Only lines that fit the format that each file's first accepted line has."""
    return of_first_format(with_first_format(detected, file_col, order_col)).where("format is not null")


def to_requests(detected: DataFrame, keep_rejected: bool = False) -> DataFrame:
    """Accepted lines as request columns; columns of the input other than ``parts`` come first. Rejected lines are left out, or kept with NULLs."""
    others = [c for c in detected.columns if c not in ("parts", "value")]
    accepted = detected.withColumn("parts", F.when(F.col("format").isNotNull(), F.col("parts"))) if keep_rejected else detected.where("format is not null")
    nginx = F.col("format").isin("nginx", "nginx_custom")
    plain = F.col("format") == "common"
    fields = accepted.select(
        *others,
        part("vhost").alias("domain"),
        part("client_ip").alias("client_ip"),
        F.when(nginx, "").otherwise(part("logname")).alias("remote_logname"),
        part("user").alias("remote_user"),
        part("stamp").alias("stamp"),
        part("method").alias("method"),
        part("uri").alias("uri"),
        part("protocol").alias("protocol"),
        part("status").alias("status"),
        F.coalesce(part("bytes").try_cast("bigint"), F.lit(0)).alias("bytes_sent"),
        F.when(plain, "").otherwise(part("referer")).alias("raw_referer"),
        F.when(~plain, part("agent")).alias("agent"),
        part("request_time").try_cast("double").alias("request_time"),
        part("upstream_time").try_cast("double").alias("upstream_time"),
    )
    return enrich(fields)


def enrich(fields: DataFrame) -> DataFrame:
    """Path levels, traffic source, threat and agent classes, timestamps."""
    uri = F.col("uri")
    # The decoded path is used many times; a projection of its own keeps it computed once.
    once = fields.withColumn("decoded", urls.decoded_path(uri))
    path = F.col("decoded")
    levels = once.withColumns({f"path{k}": urls.path_level(path, k) for k in (1, 2, 3)})
    source = F.when(F.col("agent").isNull(), "").otherwise(urls.traffic_source(F.col("raw_referer"), uri))
    full = agents.with_user_agent(levels).withColumns(
        {
            "path": F.coalesce(path, F.substring_index(uri, "?", 1)),
            "referer": source,
            "malicious": threats.threat_class(path, uri, urls.raw_query(uri)),
            "ts": timebin.instant(F.col("stamp")),
            "ts_wall": timebin.wall_clock(F.col("stamp")),
            "tz_offset": timebin.offset(F.col("stamp")),
            "is_out_of_order": F.col("is_out_of_order") if "is_out_of_order" in fields.columns else F.lit(False),
        }
    )
    return full.withColumn("ts_local", F.col("ts_wall").cast("timestamp_ntz")).drop("decoded", "agent", "raw_referer", "stamp")


def requests(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """The requests of lines; where lines say what format their file began with (``first_format``), of that format only."""
    found = detect(lines, line_col)
    return to_requests(of_first_format(found) if "first_format" in lines.columns else found)


def only(requests: DataFrame, condition: Column) -> DataFrame:
    """The requests for which ``condition`` holds.

    The rows that stay come out of a generator: a filter would be pushed below the projections that requests are made with, where it holds each
    of their steps as often as it names them, hundreds of times for attributes of the agent.
    """
    return requests.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).drop("_kept")


def line_counts(detected: DataFrame) -> DataFrame:
    """Processed and rejected lines."""
    return detected.agg(F.count_if(F.col("format").isNotNull()).alias("processed"), F.count_if(F.col("format").isNull()).alias("rejected"))


def flag_out_of_order(requests: DataFrame, file_col: str, order_col: str) -> DataFrame:
    """Marks requests whose timestamp lies before that of an earlier line of the file.

    ``order_col`` is a number. Lines are compared within blocks of about ``BLOCK`` numbers and with the newest timestamp of the
    blocks before, so that a file of any length is spread over tasks.
    """
    blocked = requests.withColumn("_block", F.floor(F.col(order_col) / BLOCK))
    tops = blocked.groupBy(file_col, "_block").agg(F.max("ts").alias("_top"))
    before = Window.partitionBy(file_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select(file_col, "_block", F.max("_top").over(before).alias("_before"))
    here = Window.partitionBy(file_col, "_block").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    own = blocked.withColumn("_newest", F.max("ts").over(here)).join(earlier, [file_col, "_block"])
    late = F.coalesce(F.col("ts") < F.greatest("_before", "_newest"), F.lit(False))
    return own.withColumn("is_out_of_order", late).select(*requests.columns, *(["is_out_of_order"] if "is_out_of_order" not in requests.columns else []))
