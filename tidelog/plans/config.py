"""Configuration of monitored files: defaults, clamping, inheritance."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_KEY, HOST_KEY = "--default--", "--OS-metrics--"
HANDLERS = ("COUNTER", "METRICS", "WRITE_TO_FILE")


@dataclass(frozen=True)
class FileConfig:
    enabled: bool = True
    follow: bool = False
    start_from: int = 0
    handlers: tuple[str, ...] = ()
    domain_name: str = ""
    host_id: int = 0
    time_window_minutes: int = 10
    metrics_window_size: int = 3
    counter_interval: int = 30
    top_n: int = 10
    replace_existing: bool = True
    write_metrics_to_db: bool = False
    save_raw_logs: bool = False
    only_relevant: int = 0
    mask_ip: bool = False
    skip_pattern: str = ""
    write_to_file: str = ""
    idle_minutes: int = 0
    trigger_bytes: int = 0
    host_metrics: bool = False
    host_interval: int = 5
    db_address: str = ""
    db_name: str = ""
    db_user: str = ""
    db_password: str = field(default="", repr=False)


# Names of the settings in configuration files.
NAMES = {
    "Enabled": "enabled",
    "Follow": "follow",
    "StartFrom": "start_from",
    "Handlers": "handlers",
    "DomainName": "domain_name",
    "HostId": "host_id",
    "TimeWindowSizeMinutes": "time_window_minutes",
    "MetricsWindowSize": "metrics_window_size",
    "CounterOutputIntervalSeconds": "counter_interval",
    "CounterTopNForKeyedMetrics": "top_n",
    "ReplaceExistingMetrics": "replace_existing",
    "WriteMetricsToDb": "write_metrics_to_db",
    "SaveLogsToDb": "save_raw_logs",
    "SaveLogsToDbOnlyRelevant": "only_relevant",
    "SaveLogsToDbMaskIPs": "mask_ip",
    "SkipIfLineMatchesRegex": "skip_pattern",
    "WriteToFileTargetFile": "write_to_file",
    "OSMetricsEnabled": "host_metrics",
    "OSMetricsIntervalMinutes": "host_interval",
    "DbAddress": "db_address",
    "DbDatabase": "db_name",
    "DbUser": "db_user",
    "DbPassword": "db_password",
}
#: Settings of our own: minutes after which a key without lines leaves the state of a followed file, and bytes that a trigger takes in (0: no limit).
NAMES |= {"KeyIdleMinutes": "idle_minutes", "MaxBytesPerTrigger": "trigger_bytes"}
_BASE = FileConfig()
_KINDS = {f.name: type(getattr(_BASE, f.name)) for f in fields(FileConfig)}


def _typed(values: dict) -> dict:
    """Settings of the right type; others, null included, count as absent."""
    out = {}
    for key, value in values.items():
        name = NAMES.get(key)
        if name is None or value is None:
            continue
        kind = _KINDS[name]
        if kind is tuple and isinstance(value, list):
            out[name] = tuple(str(v) for v in value)
        elif kind is bool and isinstance(value, bool) or kind is str and isinstance(value, str):
            out[name] = value
        elif kind is int and isinstance(value, int | float) and not isinstance(value, bool):
            out[name] = int(value)
    return out


def clamped(c: FileConfig) -> FileConfig:
    return replace(
        c,
        counter_interval=c.counter_interval if c.counter_interval >= 1 else 30,
        top_n=c.top_n if 1 <= c.top_n <= 100 else 10,
        metrics_window_size=c.metrics_window_size if 2 <= c.metrics_window_size <= 10 else 3,
    )


def load(text: str) -> dict[str, FileConfig]:
    """Configs by file, the host entry included; settings that a file lacks come from the default entry."""
    document = json.loads(text)
    default = _typed(document.get(DEFAULT_KEY) or {})
    out = {}
    for path, values in document.items():
        if path == DEFAULT_KEY:
            continue
        own = _typed(values or {})
        if path == HOST_KEY:
            mine = clamped(FileConfig(**own))
            base = clamped(FileConfig(**default))
            inherited = {n: getattr(base, n) for n in ("db_address", "db_name", "db_user", "db_password") if not getattr(mine, n)}
            out[path] = replace(mine, **inherited, host_id=mine.host_id if mine.host_id >= 1 else base.host_id)
            continue
        if not own.get("handlers"):
            own.pop("handlers", None)
        out[path] = clamped(FileConfig(**(default | own)))
        if "WRITE_TO_FILE" in out[path].handlers and not out[path].write_to_file:
            raise ValueError(f"{path}: WRITE_TO_FILE needs a target")
    return out


def default_of(text: str) -> FileConfig:
    """The settings of files that have no entry of their own."""
    return clamped(FileConfig(**_typed(json.loads(text).get(DEFAULT_KEY) or {})))


def for_file(configs: dict[str, FileConfig], path: str, default: FileConfig | None = None) -> FileConfig:
    return configs.get(path) or default or clamped(FileConfig())


#: Settings that meet lines as columns, by the names they have there.
COLUMNS = {"domain_name": "string", "time_window_minutes": "int", "metrics_window_size": "int", "start_from": "int", "skip_pattern": "string", "host_id": "int"}


def with_settings(lines: DataFrame, configs: dict[str, FileConfig], default: FileConfig, file_col: str = "file") -> DataFrame:
    """``lines`` with the settings in ``COLUMNS`` of their file, those of ``default`` where it has no entry.

    Entries are a table that is joined to the lines: as many as the configuration file has, which the driver has read, so they are sent to all executors.
    """
    schema = f"{file_col} string, " + ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items())
    rows = [(path, *[getattr(c, name) for name in COLUMNS]) for path, c in configs.items() if path != HOST_KEY]
    table = lines.sparkSession.createDataFrame(rows, schema)
    found = lines.join(F.broadcast(table), file_col, "left")
    return found.withColumns({c: F.coalesce(c, F.lit(getattr(default, c)).cast(kind)) for c, kind in COLUMNS.items()})


def next_run_minute(minute: int, every: int) -> int:
    """Minutes until the next aligned mark of a sampler that runs every 1, 5, 10, 15, 30 or 60 minutes."""
    if every not in (1, 5, 10, 15, 30, 60):
        raise ValueError(every)
    return -minute % every
