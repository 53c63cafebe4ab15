"""Access-log line formats, all read with one pattern.

The five formats share their middle; they differ in a leading host, in the closing referer and agent, and in two numbers after
those. One pass captures everything, and which parts are there names the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("common", "combined", "vhost", "nginx", "nginx_custom")
# The pattern of a log line.
LINE = r'^(?:(\S+) )?(\S+) (\S+) (\S+) \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+)( "([^"]*)" "([^"]*)"( (\S+) (\S+))?)?$'
GROUPS = ("vhost", "client_ip", "logname", "user", "stamp", "method", "uri", "protocol", "status", "bytes", "closing", "referer", "agent", "times", "request_time", "upstream_time")
_MARK, _ESCAPE = "\x01", "\x02"


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def capture(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``lines`` with the captured parts as the array ``parts`` and the name of the format, NULL if none fits.

    The parts come out of a generator: filters on the format are not pushed below it, where they would run the pattern again.
    A line that holds the mark between parts itself is written without it before the pattern runs, and its parts are set right after.
    """
    line = F.col(line_col)
    clean = F.when(line.rlike("[\\x01\\x02]"), F.replace(F.replace(line, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))).otherwise(line)
    # A projection of its own, as the generator would run the pattern wherever it names the text.
    flat = F.col("_flat")
    marked = lines.withColumn("_flat", F.regexp_replace(clean, LINE, _MARK + _MARK.join(f"${k}" for k in range(1, len(GROUPS) + 1))))
    split = F.split(flat, _MARK)
    right = F.transform(split, lambda x: F.replace(F.replace(x, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE)))
    with_parts = marked.select(*[F.col(f"`{c}`") for c in lines.columns], F.explode_outer(F.array(F.when(flat.contains(_ESCAPE), right).otherwise(split))).alias("parts"))
    has_host, has_end, has_times = part("vhost") != "", part("closing") != "", part("times") != ""
    name = (
        F.when(F.coalesce(F.size("parts"), F.lit(0)) != len(GROUPS) + 1, None)
        .when(has_host, F.when(has_end & ~has_times, "vhost"))
        .when(has_times, F.when(part("logname") == "-", "nginx_custom"))
        .when(has_end, F.when(part("logname") == "-", "nginx").otherwise("combined"))
        .otherwise("common")
    )
    return with_parts.withColumn("format", name)


def part(name: str) -> Column:
    return F.get("parts", F.lit(GROUPS.index(name) + 1))
