"""Host samples from the text of ``uptime`` and ``free``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def uptime_columns(text: Column) -> dict[str, Column]:
    """Time, minutes up, users and load averages; what the text lacks is NULL."""
    up = F.regexp_extract(text, r"up\s+(.*?),\s*(?:\d+\s+users?|load)", 1)
    days = F.coalesce(_number(up, r"(\d+)\s+days?"), F.lit(0))
    hours, minutes = _number(up, r"(\d{1,2}):(\d{2})", 1), _number(up, r"(\d{1,2}):(\d{2})", 2)
    alone = _number(up, r"(\d+)\s+min")
    total = days * 1440 + F.coalesce(hours * 60 + minutes, alone, F.lit(0))
    # The decimals after the word "average", and the first word where it is a clock.
    loads = F.regexp_extract_all(F.when(F.instr(text, "average") > 0, F.substring_index(text, "average", -1)), F.lit("[0-9]+[.][0-9]+"), F.lit(0))
    first = F.substring_index(F.ltrim(text), " ", 1)
    clock = F.when(F.try_to_timestamp(first, F.lit("HH:mm:ss")).isNotNull() | F.try_to_timestamp(first, F.lit("HH:mm")).isNotNull(), first)
    return {
        "sample_time": F.coalesce(clock, F.date_format(F.current_timestamp(), "HH:mm:ss")),
        "up_duration_minutes": F.when(up != "", total),
        "users": _number(text, r"(\d+)\s+users?"),
        **{f"load_average{n}": F.when(F.size(loads) == 3, F.get(loads, F.lit(g))) for g, n in ((0, 1), (1, 5), (2, 15))},
    }


def memory_columns(text: Column, compat: bool = False) -> dict[str, Column]:
    """Memory and swap in use in KiB; ``compat`` reports swap as zero."""
    lines = F.split(text, "\n")

    def field(line: int, at: int) -> Column:
        words = F.split(F.trim(F.try_element_at(lines, F.lit(line))), r"\s+")
        return F.try_element_at(words, F.lit(at)).try_cast("bigint")

    return {
        "memory_use": field(2, 3),
        "memory_free": field(2, 4),
        "cache_use": field(2, 6),
        "memory_available": field(2, 7),
        "swap_use": F.lit(0).cast("bigint") if compat else field(3, 3),
    }


def parse_uptime(df: DataFrame, text_col: str = "value") -> DataFrame:
    return df.withColumns(uptime_columns(F.col(text_col)))


def parse_memory(df: DataFrame, text_col: str = "value", compat: bool = False) -> DataFrame:
    return df.withColumns(memory_columns(F.col(text_col), compat))


def host_rows(samples: DataFrame, host_id: int) -> DataFrame:
    """Rows of the host-metric table; a missing memory sample counts as zeros."""
    memory = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("swap_use", "cache_use", "memory_use", "memory_free", "memory_available")]
    return samples.select(F.lit(host_id).alias("host_id"), "metrics_ts", "up_duration_minutes", "users", "load_average1", "load_average5", "load_average15", *memory)
