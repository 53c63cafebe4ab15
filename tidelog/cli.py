"""Command line: counters, metrics or JSON lines of access logs."""

from __future__ import annotations

import argparse
import fnmatch
import json
import logging
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import counters, database, parse, report, rollup, sinks
from tidelog.operators.versions import Versions
from tidelog.plans import config
from tidelog.plans.shared import shared_dir
from tidelog.sources import logs
from tidelog.sources.tail import TailSource
from tidelog.streaming import rollup as streaming
from tidelog.streaming import slots
from tidelog.streaming.host import start_host_sampler

PROFILES = {"count": "COUNTER", "metrics": "METRICS", "security": ""}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidelog", description=__doc__, add_help=False)
    p.add_argument("-l", dest="log_level", default="info", choices=("debug", "info", "warn"))
    p.add_argument("-p", dest="profile", default="metrics", choices=tuple(PROFILES))
    p.add_argument("-c", dest="config", default="")
    p.add_argument("-f", dest="follow", action="store_true")
    p.add_argument("-w", dest="window", type=int, default=1)
    p.add_argument("-s", dest="start_from", type=int, default=0)
    p.add_argument("-d", dest="domain", default="")
    p.add_argument("-a", dest="handler", default="")
    p.add_argument("-t", dest="target", default="")
    p.add_argument("-n", dest="top_n", type=int, default=10)
    p.add_argument("-i", dest="interval", type=int, default=30)
    p.add_argument("-o", dest="log_file", default="")
    p.add_argument("-m", dest="trigger_bytes", type=int, default=0)
    p.add_argument("-h", action="help")
    p.add_argument("path", nargs="?", default="")
    return p.parse_args(argv)


def configs(args: argparse.Namespace) -> dict[str, config.FileConfig]:
    """A configuration file wins over the path; a command-line run never writes to a database."""
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            return config.load(f.read())
    if not args.path:
        raise SystemExit("a log file or a configuration file is needed")
    handler = args.handler or PROFILES[args.profile]
    return {
        args.path: config.clamped(
            config.FileConfig(follow=args.follow, start_from=args.start_from, time_window_minutes=args.window, domain_name=args.domain, handlers=(handler,) if handler else (), write_to_file=args.target, top_n=args.top_n, counter_interval=args.interval, trigger_bytes=args.trigger_bytes)
        )
    }


def run_all(spark: SparkSession, found: dict[str, config.FileConfig], default: config.FileConfig, tables_of: Callable[[config.FileConfig], database.Tables | None]) -> dict[str, list[str]]:
    """What the handlers of bounded files print, by file; rows go to the tables of their configuration where it says so.

    All files are one plan: their lines meet their settings by name, those of ``default`` where a file that a folder or pattern lists has no entry of its own.
    Lines are read in the format that their file's first accepted one has. Each kind of output is one job, whatever the number of files.
    """
    numbered = logs.numbered_lines(spark, *_apart(found)).withColumn("file", logs.local_name(F.col("file")))
    named = {os.path.abspath(p) if "://" not in p else p: c for p, c in found.items()}
    lines = config.with_settings(numbered, named, default)
    lines = logs.without_matching_own(logs.skip_first_of_each(lines, max([0, default.start_from, *[c.start_from for c in found.values()]])))
    every_line = parse.to_requests(parse.of_first_format(parse.with_first_format(parse.detect(lines), "file", "line_no")), keep_rejected=True)
    # Parsed once for all that follows, which reads the columns it needs.
    parsed = f"{shared_dir(spark)}/tidelog/parsed-{uuid.uuid4().hex}"
    every_line.write.parquet(parsed)
    try:
        return _handled(spark, spark.read.schema(every_line.schema).parquet(parsed), numbered, named, default, tables_of)
    finally:
        Versions(spark, parsed).delete(parsed)


def _handled(spark: SparkSession, every_line: DataFrame, numbered: DataFrame, named: dict[str, config.FileConfig], default: config.FileConfig, tables_of: Callable) -> dict[str, list[str]]:
    requests = every_line.where("format is not null")
    files = [r.file for r in numbered.select("file").distinct().collect()]
    settings = {f: config.for_file(named, f, default) for f in files}
    out: dict[str, list[str]] = {f: [] for f in files}

    def with_handler(handler: str) -> list[str]:
        return [f for f in files if handler in settings[f].handlers]

    for kept, mine in _by_tables(settings, tables_of):
        for group in _alike({f: settings[f] for f in mine if settings[f].save_raw_logs}, "only_relevant", "mask_ip").values():
            database.save_raw_logs(_of(requests, group), settings[group[0]], kept)
        for group in _alike({f: settings[f] for f in mine if settings[f].write_metrics_to_db and "METRICS" in settings[f].handlers}, "replace_existing").values():
            database.save_metrics(_of(requests, group), settings[group[0]], kept)
    counted = with_handler("COUNTER")
    if counted:
        most = max(settings[f].top_n for f in counted)
        found_counts: dict[str, dict] = {f: {} for f in counted}
        for r in counters.top(counters.report_counts(_of(every_line, counted), ("file",)), most, ("file",)).collect():
            found_counts[r.file][r.dimension, r.key] = r.n
        for f in counted:
            out[f].append(report.sums_report(found_counts[f], None, settings[f].top_n))
    if measured := with_handler("METRICS"):
        rolled = rollup.rollup(_of(requests, measured), F.col("time_window_minutes"), ["file", "metrics_window_size"])
        dumps = report.metrics_reports(rolled, F.col("metrics_window_size"))
        for f in measured:
            out[f].append(dumps.get((f,), "{}"))
    for (target,), group in _alike({f: settings[f] for f in with_handler("WRITE_TO_FILE")}, "write_to_file").items():
        sinks.write_json_lines(parse.flag_out_of_order(_of(requests, group), "file", "line_no"), target)
    for f in files:
        for handler in set(settings[f].handlers) - set(config.HANDLERS):
            logging.warning("unknown handler %s", handler)
    return out


def _apart(paths: Iterable[str]) -> list[str]:
    """Paths without those that a folder or pattern among them lists as well, so that no file is read twice."""
    others = [p for p in paths if not os.path.isfile(p)]
    return [p for p in paths if not any(p != q and (p.startswith(q.rstrip("/") + "/") or fnmatch.fnmatch(p, q)) for q in others)]


def _of(rows: DataFrame, files: list[str]) -> DataFrame:
    return rows.where(F.col("file").isin(*files))


def _alike(settings: dict[str, config.FileConfig], *names: str) -> dict[tuple, list[str]]:
    """Files by the values of some settings."""
    out: dict[tuple, list[str]] = {}
    for f, c in settings.items():
        out.setdefault(tuple(getattr(c, n) for n in names), []).append(f)
    return out


def _by_tables(settings: dict[str, config.FileConfig], tables_of: Callable[[config.FileConfig], database.Tables | None]) -> list[tuple[database.Tables, list[str]]]:
    """Files by the tables that they are kept in."""
    groups = _alike({f: c for f, c in settings.items() if c.save_raw_logs or c.write_metrics_to_db}, "db_address", "db_name", "db_user", "db_password")
    out = [(tables_of(settings[mine[0]]), mine) for mine in groups.values()]
    return [(kept, mine) for kept, mine in out if kept is not None]


def run(spark: SparkSession, path: str, c: config.FileConfig, kept: database.Tables | None = None) -> list[str]:
    """``run_all`` for one file, or all that a folder or pattern lists under the same settings."""
    return [text for texts in run_all(spark, {path: c}, c, lambda _: kept).values() for text in texts]


def follow_all(spark: SparkSession, found: dict[str, config.FileConfig], tables_of: Callable[[config.FileConfig], database.Tables | None], name: str) -> list[StreamingQuery]:
    """Streams of growing files: a report with changes every interval, windows that leave their slots into a metric table, raw logs, JSON lines.

    Each kind is one stream for all files, which carries their settings beside their lines. ``name`` stands for this set of files in the checkpoints.
    """
    spark.dataSource.register(TailSource)
    root = f"{shared_dir(spark)}/tidelog/follow-{uuid.uuid5(uuid.NAMESPACE_URL, name).hex}"
    default = config.clamped(config.FileConfig())
    out = []

    def lines(kind: str, files: list[str]) -> DataFrame:
        source = spark.readStream.format("access_log_tail").option("paths", json.dumps(files)).option("startFrom", json.dumps({f: found[f].start_from for f in files}))
        source = source.option("maxBytesPerTrigger", max(found[f].trigger_bytes for f in files))
        if local := _local(root):
            source = source.option("journal", f"{local}/{kind}.journal")
        return logs.without_matching_own(config.with_settings(source.load(), {f: found[f] for f in files}, default))

    def with_handler(handler: str) -> list[str]:
        return [f for f, c in found.items() if handler in c.handlers]

    for (seconds,), files in _alike({f: found[f] for f in with_handler("COUNTER")}, "counter_interval").items():

        def show(counts: dict, before: dict, files: list[str] = files) -> None:
            for f in files:
                mine, had = ({k[1:]: n for k, n in x.items() if k[0] == f} for x in (counts, before))
                if mine:
                    print(*([f"=== {f} ==="] if len(files) > 1 else []), report.live_report(mine, had, found[f].top_n), sep="\n")

        idle = max(found[f].idle_minutes for f in files)
        most = max(found[f].top_n for f in files)
        out.append(streaming.start_counters(lines(f"counter-{seconds}", files), show, f"{root}/counter-{seconds}", most, f"{seconds} seconds", ("file",), idle or None))
    measured = with_handler("METRICS")
    if measured:
        out.append(_follow_metrics(spark, parse.requests(lines("slots", measured)), {f: found[f] for f in measured}, tables_of, root))
    written = [f for f, c in found.items() if "WRITE_TO_FILE" in c.handlers or c.save_raw_logs]
    if written:
        out.append(_follow_rows(parse.requests(lines("rows", written)), {f: found[f] for f in written}, tables_of, root))
    return out


def _local(root: str) -> str | None:
    """A local folder's path, if it is one."""
    return root.removeprefix("file://") if root.startswith(("file:///", "/")) else None


def _follow_metrics(spark: SparkSession, requests: DataFrame, settings: dict[str, config.FileConfig], tables_of: Callable, root: str) -> StreamingQuery:
    own = sinks.MetricTable(spark, f"{root}/metrics")
    places, saved = [], set()
    for kept, files in _by_tables({f: c for f, c in settings.items() if c.write_metrics_to_db}, tables_of):
        ids = {d: database.domain_id(spark, d, kept) for (d,) in _alike({f: settings[f] for f in files}, "domain_name")}
        places += [(kept.upsert, replace, {f: ids[settings[f].domain_name] for f in group}) for (replace,), group in _alike({f: settings[f] for f in files}, "replace_existing").items()]
        saved |= set(files)
    places += [(own.upsert, replace, {f: 1 for f in group}) for (replace,), group in _alike({f: c for f, c in settings.items() if f not in saved}, "replace_existing").items()]

    def save(batch: DataFrame, batch_id: int) -> None:
        for k, (upsert, replace, ids) in enumerate(places):
            table = spark.createDataFrame(list(ids.items()), "file string, domain_id bigint")
            upsert(batch.join(F.broadcast(table), "file").drop("file"), replace, f"{root}/slots#{k}", batch_id)

    idle = max(c.idle_minutes for c in settings.values())
    windows = slots.slot_windows(requests, F.col("time_window_minutes"), F.col("metrics_window_size"), "place", ("file",), idle or None)
    with slots.state_in_rocksdb(spark):
        return windows.writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", f"{root}/slots").trigger(processingTime="10 seconds").start()


def _follow_rows(requests: DataFrame, settings: dict[str, config.FileConfig], tables_of: Callable, root: str) -> StreamingQuery:
    """JSON lines and raw logs of a batch, each target once however often the batch is repeated."""
    places = _by_tables({f: c for f, c in settings.items() if c.save_raw_logs}, tables_of)
    targets = _alike({f: c for f, c in settings.items() if "WRITE_TO_FILE" in c.handlers}, "write_to_file")
    run = uuid.uuid5(uuid.NAMESPACE_URL, root).hex
    newest = Versions(requests.sparkSession, f"{root}/rows-newest")

    def flagged(batch: DataFrame, batch_id: int) -> DataFrame:
        """With the flag of lines that are older than one before them, in this batch or an earlier one; a row a file is kept from batch to batch."""
        before = (newest.newest(batch_id) or {"seconds": {}})["seconds"]
        now = {r.file: r.at for r in batch.groupBy("file").agg(F.max(F.unix_micros("ts")).alias("at")).collect() if r.at is not None}
        if batch_id not in newest.numbers():
            newest.publish({"n": batch_id, "seconds": {f: max(x for x in (before.get(f), now.get(f)) if x is not None) for f in before | now}})
        known = batch.sparkSession.createDataFrame(list(before.items()), "file string, _before bigint")
        here = parse.flag_out_of_order(batch, "file", "place").join(F.broadcast(known), "file", "left")
        return here.withColumn("is_out_of_order", F.col("is_out_of_order") | F.coalesce(F.unix_micros("ts") < F.col("_before"), F.lit(False))).drop("_before")

    def save(batch: DataFrame, batch_id: int) -> None:
        # Parsed once for all targets of the batch.
        batch = batch.persist()
        try:
            told = flagged(batch, batch_id) if targets else batch
            for (target,), files in targets.items():
                sinks.json_lines(_of(told, files)).write.mode("overwrite").text(f"{target}/run={run}/batch={batch_id}")
            for kept, files in places:
                for k, group in enumerate(_alike({f: settings[f] for f in files}, "only_relevant", "mask_ip").values()):
                    database.save_raw_logs(_of(batch, group), settings[group[0]], kept, f"{root}/rows#{k}", batch_id)
        finally:
            batch.unpersist()

    return requests.writeStream.foreachBatch(save).option("checkpointLocation", f"{root}/rows").start()


def follow(spark: SparkSession, path: str, c: config.FileConfig, kept: database.Tables | None = None) -> list[StreamingQuery]:
    """``follow_all`` for one file."""
    return follow_all(spark, {path: c}, lambda _: kept, path)


def sample_host(spark: SparkSession, c: config.FileConfig, kept: database.Tables, checkpoint: str, aligned: bool = True) -> StreamingQuery | None:
    """The host sampler, if the configuration turns it on."""
    if not c.host_metrics:
        return None
    return start_host_sampler(spark, c.host_id, lambda rows: kept.append("host_metrics", rows), checkpoint, c.host_interval, aligned)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    level = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING}[args.log_level]
    try:
        logging.basicConfig(level=level, filename=args.log_file or None)
    except OSError:
        logging.basicConfig(level=level)
    spark = SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found, default = configs(args), config.clamped(config.FileConfig())
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            default = config.default_of(f.read())
    root = f"{shared_dir(spark)}/tidelog"

    def tables_of(c: config.FileConfig) -> database.Tables:
        return database.tables(spark, c, f"{root}/tables")

    sampler = found.pop(config.HOST_KEY, None)
    if sampler is not None and sampler.host_metrics:
        sample_host(spark, sampler, tables_of(sampler), f"{root}/host-sampler")
    enabled = {path: c for path, c in found.items() if c.enabled}
    bounded = {path: c for path, c in enabled.items() if not c.follow}
    if bounded:
        for texts in run_all(spark, bounded, default, tables_of).values():
            print(*texts, sep="\n")
    if followed := {path: c for path, c in enabled.items() if c.follow}:
        follow_all(spark, followed, tables_of, os.path.abspath(args.config or args.path))
    if spark.streams.active:
        spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
