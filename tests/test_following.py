"""Followed files: rotation without limit, compressed and copied files, formats, slots, idle keys, restarts, many files at once."""

import bz2
import gzip
import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tests.test_engine import line
from tidelog import cli
from tidelog.operators import counters, database, parse, report, sinks
from tidelog.plans import catalog, config
from tidelog.sources import tail
from tidelog.streaming import rollup as streaming
from tidelog.streaming import slots


class Followed:
    """A reader that is triggered by hand."""

    def __init__(self, path, **kw):
        self.reader = tail.TailReader([str(path)], kw.pop("start_from", 0), 1 << 20, **kw)
        self.at = self.reader.initialOffset()

    def take(self):
        then = self.reader.latestOffset()
        found = [x for part in self.reader.partitions(self.at, then) for x, *_ in self.reader.read(part)]
        self.at = then
        return found


@pytest.fixture
def settled(monkeypatch):
    monkeypatch.setattr(tail, "SETTLED", 0.0)


def rotate(p, kept, packed=None):
    """Moves every rotated file one up; ``packed`` are compressed once they are there."""
    folder, name = os.path.split(p)
    for k in range(kept, 0, -1):
        for end in ("", ".gz"):
            old = os.path.join(folder, f"{name}.{k}{end}")
            if os.path.exists(old):
                os.rename(old, os.path.join(folder, f"{name}.{k + 1}{end}"))
    os.rename(p, os.path.join(folder, f"{name}.1"))
    for k in packed or ():
        if os.path.exists(os.path.join(folder, f"{name}.{k}")):
            pack(os.path.join(folder, f"{name}.{k}"))


def pack(path, opener=gzip.open, end=".gz"):
    with open(path, "rb") as f, opener(path + end, "wb") as g:
        shutil.copyfileobj(f, g)
    os.remove(path)


@pytest.mark.parametrize("packed", [(), (2,)])
def test_fifty_rotations_between_two_triggers_lose_nothing(tmp_path, settled, packed):
    p = tmp_path / "access.log"
    p.write_text("first\n")
    f = Followed(p)
    assert f.take() == ["first"]
    want = []
    for k in range(50):
        with p.open("a") as out:
            out.write(f"line {k} a\nline {k} b\n")
        want += [f"line {k} a", f"line {k} b"]
        rotate(str(p), 60, packed)
        p.write_text("")
    p.write_text("now\n")
    assert sorted(f.take()) == sorted([*want, "now"]) and f.take() == []
    with p.open("a") as out:
        out.write("more\n")
    assert f.take() == ["more"]


def test_a_file_is_read_on_after_it_was_compressed_or_copied(tmp_path, settled):
    p = tmp_path / "access.log"
    p.write_text("a\n")
    (tmp_path / "access.log.7").write_text("from before\n")
    with gzip.open(tmp_path / "access.log.8.gz", "wt") as g:
        g.write("long before\n")
    f = Followed(p)
    assert f.take() == ["a"]
    with p.open("a") as out:
        out.write("b\n")
    os.rename(p, tmp_path / "access.log.1")
    pack(str(tmp_path / "access.log.1"), bz2.open, ".bz2")
    p.write_text("c\n")
    assert f.take() == ["b", "c"]
    # The old ones are compressed too, and stay read.
    pack(str(tmp_path / "access.log.7"))
    os.rename(tmp_path / "access.log.1.bz2", tmp_path / "access.log.2.bz2")
    assert f.take() == []
    # Copied and truncated in place.
    with p.open("a") as out:
        out.write("d\n")
    shutil.copy(p, tmp_path / "access.log.1")
    p.write_text("e\n")
    assert sorted(f.take()) == ["d", "e"] and f.take() == []
    # While the plain file is there, its compressed form is being written.
    os.rename(p, tmp_path / "access.log.0")
    p.write_text("")
    with (tmp_path / "access.log.0").open("a") as out:
        out.write("f\n")
    (tmp_path / "access.log.0.gz").write_bytes(gzip.compress(b"e\nf\n")[:7])
    assert f.take() == ["f"] and f.take() == []


def test_the_first_trigger_after_a_restart_is_bounded(tmp_path):
    p, journal = tmp_path / "big.log", str(tmp_path / "state" / "journal")
    p.write_text("".join(f"line {i}\n" for i in range(100)))
    f = Followed(p, per_trigger=50, journal=journal)
    got = f.take()
    again = tail.TailReader([str(p)], 0, 1 << 20, 50, journal)
    at, steps = f.at, 0
    while (then := again.latestOffset()) != at and steps < 200:
        new = [x for part in again.partitions(at, then) for x, *_ in again.read(part)]
        assert 0 < sum(len(x) + 1 for x in new) <= 60
        got, at, steps = got + new, then, steps + 1
    assert got == [f"line {i}" for i in range(100)] and steps > 8


def test_places_grow_and_formats_stay(tmp_path, settled):
    p = tmp_path / "a.log"
    common = line(0).split(' "-"')[0]
    p.write_text(f"junk\n{common}\n{line(1)}\n")
    f = Followed(p)

    def rows():
        then = f.reader.latestOffset()
        found = [x for part in f.reader.partitions(f.at, then) for x in f.reader.read(part)]
        f.at = then
        return found

    first = rows()
    rotate(str(p), 1)
    p.write_text(f"{line(2)}\n")
    second = rows()
    assert [x[2] for x in first + second] == ["common"] * 4
    places = [x[3] for x in first + second]
    assert places == sorted(set(places))
    assert json.loads(f.at["files"])[str(p)]["format"] == "common"


def test_names_of_formats_agree(spark):
    tails = ("", ' "-" "curl"', ' "-" "curl" 0.1 0.2')
    heads = ("1.1.1.1 - - ", "1.1.1.1 id - ", "shop 1.1.1.1 - - ", "shop 1.1.1.1 id u ")
    lines = [f'{h}[10/Oct/2000:13:00:36 +0000] "GET / HTTP/1.1" 200 10{t}' for h in heads for t in tails] + ["junk", ""]
    found = parse.detect(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {r.value: r.format for r in found} == {x: tail.format_of(x) for x in lines}


def mixed():
    """An nginx line, a common one and an nginx one, as a file and as a combined file."""
    common = line(1).split(' "-"')[0]
    return [line(0), common, line(2)], [line(0).replace("1.1.1.1 -", "1.1.1.1 id"), common, line(2)]


def test_a_bounded_file_is_read_in_its_first_format(spark, tmp_path):
    for k, lines in enumerate(mixed()):
        p = tmp_path / f"{k}.log"
        p.write_text("\n".join(lines))
        text = cli.run(spark, str(p), config.FileConfig(handlers=("COUNTER",)))[0]
        assert "lines: 3" in text and "rejected: 1" in text and "requests: 2" in text, text


def drained(*queries):
    for q in queries:
        q.processAllAvailable()


def test_a_followed_file_is_read_in_its_first_format(spark, tmp_path, capsys):
    p, lines = tmp_path / "f.log", mixed()[0]
    p.write_text("\n".join(lines[:2]) + "\n")
    c = config.FileConfig(follow=True, handlers=("WRITE_TO_FILE", "COUNTER"), write_to_file=str(tmp_path / "out"), counter_interval=1)
    queries = cli.follow(spark, str(p), c)
    try:
        drained(*queries)
        os.rename(p, tmp_path / "f.log.1")
        p.write_text("\n".join(lines[1:]) + "\n")
        drained(*queries)
    finally:
        for q in queries:
            q.stop()
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    told = capsys.readouterr().out
    assert "lines: 4 (+2)" in told and "rejected: 2 (+1)" in told and "requests: 2 (+1)" in told


def test_counters_go_on_after_a_restart(spark, tmp_path):
    source, reports = tmp_path / "in", []
    source.mkdir()

    def run(*lines):
        (source / f"{time.time_ns()}.txt").write_text("\n".join(lines))
        q = streaming.start_counters(spark.readStream.text(str(source)), lambda now, before: reports.append(report.live_report(now, before)), str(tmp_path / "c"), every="0 seconds")
        q.processAllAvailable()
        q.stop()

    run(*[line(0)] * 9)
    run(line(1, 404), "junk")
    assert "lines: 11 (+2)" in reports[-1] and "200        9 (+0)" in reports[-1] and "404        1 (+1)" in reports[-1] and "rejected: 1 (+1)" in reports[-1]


def test_a_repeated_batch_of_counters_shows_the_same_changes(spark, tmp_path):
    from tidelog.operators.versions import Versions

    tops = streaming.Tops(1, Versions(spark, str(tmp_path)))
    rows = lambda n: spark.createDataFrame([("status", "200", n)], "dimension string, key string, n bigint")
    tops.update(rows(5), 0)
    first, again = tops.update(rows(8), 1), streaming.Tops(1, Versions(spark, str(tmp_path))).update(rows(8), 1)
    assert first == again == ({("status", "200"): 8}, {("status", "200"): 5})


def slotted(rows, n):
    """Sums of what the slots keep of (key, window, value) in order."""
    live, out = {}, {}
    for key, window, value in rows:
        mine = live.setdefault(key, set())
        if window not in mine:
            if len(mine) >= n and window < min(mine):
                continue
            mine.add(window)
            if len(mine) > n:
                mine.remove(min(mine))
        out[key, window] = out.get((key, window), 0) + value
    return out


@pytest.mark.parametrize("in_order", [True, False])
def test_slots_keep_the_newest_windows_of_each_key(spark, tmp_path, in_order):
    import random

    rng, source = random.Random(4), tmp_path / "in"
    source.mkdir()
    minutes = [min(59, max(0, k // 4 + rng.randrange(-25, 10))) for k in range(240)]
    lines = [(k, line(m, ip=f"1.1.1.{k % 3}", uri=f"/{k % 2}")) for k, m in enumerate(minutes)]
    table = sinks.MetricTable(spark, str(tmp_path / "m"))
    for k in range(2):
        made = spark.createDataFrame(lines[120 * k : 120 * k + 120], "n int, value string")
        (made.repartitionByRange(3, "n") if in_order else made.repartition(3)).write.parquet(str(source / f"part={k}"))
        stream = spark.readStream.schema("n int, value string, part int").parquet(str(source))
        slots.start_slots(parse.requests(stream), 1, 3, "n", table, 7, str(tmp_path / "c"), in_order=in_order).awaitTermination()
    before = table.read().where("metric_type = 7").count()
    slots.flush(spark, table, 7, str(tmp_path / "c"))
    got = {(r.key_value, r.time_window): r.metric_value for r in table.read().where("metric_type = 7").collect()}
    want = slotted([(f"/{k % 2}", 200010101300 + m, 1) for k, m in enumerate(minutes)], 3)
    assert got == want and before < len(want) and sum(want.values()) < 240
    live = slots.live(spark, str(tmp_path / "c")).groupBy("metric_type", "key_value").count()
    assert live.agg(F.max("count")).first()[0] == 3
    with pytest.raises(ValueError):
        slots.slot_windows(parse.requests(stream), 1, 0, "n")


def test_idle_keys_leave_the_state_with_their_last_sums(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    table = sinks.MetricTable(spark, str(tmp_path / "m"))
    stream = spark.readStream.schema("n int, value string, part int").parquet(str(source))
    q = slots.start_slots(parse.requests(stream), 1, 5, "n", table, 7, str(tmp_path / "c"), replace=False, every="0 seconds", idle_minutes=10)
    try:
        for k, new in enumerate([[line(0, uri="/gone"), line(1, uri="/gone"), line(1, uri="/stays")], [line(8, uri="/stays"), line(30, uri="/late")], [line(31, uri="/late"), line(2, uri="/gone")]]):
            spark.createDataFrame([(100 * k + i, x) for i, x in enumerate(new)], "n int, value string").coalesce(1).write.parquet(str(source / f"part={k}"))
            q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.key_value, r.time_window): r.metric_value for r in table.read().where("metric_type = 7").collect()}
    assert got == {("/gone", 200010101300): 1, ("/gone", 200010101301): 1, ("/stays", 200010101301): 1, ("/stays", 200010101308): 1}
    assert {r.key_value for r in slots.live(spark, str(tmp_path / "c")).where("metric_type = 7").collect()} == {"/late"}


def test_idle_counters_leave_the_state(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    (source / "1.txt").write_text("\n".join([line(0)] * 3 + ["junk"]))
    q = streaming.start_counters(spark.readStream.text(str(source)), lambda now, before: seen.append(now), str(tmp_path / "c"), every="1 seconds", idle_minutes=0.05)
    # With timers by the machine's clock a stream is never done.
    try:
        for _ in range(80):
            time.sleep(0.5)
            if len(seen) > 1 and seen[-1] == {}:
                break
    finally:
        q.stop()
    assert any(n.get(("status", "200")) == 3 and n.get(("rejected", "")) == 1 for n in seen) and seen[-1] == {}
    with slots.state_in_rocksdb(spark):
        assert spark.read.format("statestore").option("stateVarName", "sums").load(str(tmp_path / "c")).count() == 0


def many_files(tmp_path, n):
    """``n`` files of which every other one has settings of its own."""
    settings = {"Handlers": ["METRICS", "COUNTER"], "WriteMetricsToDb": True, "SaveLogsToDb": True, "DomainName": "rest", "TimeWindowSizeMinutes": 60, "HostId": 3}
    document = {"--default--": settings, str(tmp_path / "logs"): {}}
    (tmp_path / "logs").mkdir()
    for k in range(n):
        p = tmp_path / "logs" / f"{k}+x.log"
        p.write_text("\n".join([line(m, ip=f"1.1.1.{k}") for m in (0, 7, 20)] + ["junk"] * (k % 2)))
        if k % 2 == 0:
            document[str(p)] = {"DomainName": f"d{k}", "TimeWindowSizeMinutes": 5, "HostId": k, "SkipIfLineMatchesRegex": ":20:" if k % 4 == 0 else "", "StartFrom": 2 if k == 2 else 0}
    return json.dumps(document)


def test_many_bounded_files_are_one_plan(spark, tmp_path):
    text = many_files(tmp_path, 12)
    found, default = config.load(text), config.default_of(text)
    kept = database.ParquetTables(spark, str(tmp_path / "t"))
    del found[str(tmp_path / "logs")]
    out = cli.run_all(spark, {str(tmp_path / "logs"): default} | {p: c for p, c in found.items() if not p.endswith(".log")} | found, default, lambda _: kept)
    assert len(out) == 12 and all(len(x) == 2 for x in out.values())
    names = {r.domain_id: r.domain for r in kept.domains().collect()}
    got = {}
    for r in kept.metrics.read().where("metric_type = 1").collect():
        got.setdefault(names[r.domain_id], {})[r.time_window] = r.metric_value
    assert got["rest"] == {200010101300: 18} and got["d6"] == {200010101300: 1, 200010101305: 1, 200010101320: 1}
    assert got["d4"] == {200010101300: 1, 200010101305: 1} and got["d2"] == {200010101305: 1, 200010101320: 1} and len(got) == 7
    raw = spark.read.parquet(str(tmp_path / "t" / "raw_logs"))
    assert raw.count() == sum(sum(x.values()) for x in got.values())
    assert {r.host_id for r in raw.where("client_ip = X'01010106'").collect()} == {6} and {r.host_id for r in raw.where("client_ip = X'01010107'").collect()} == {3}
    report_7 = next(x for f, x in out.items() if f.endswith("/7+x.log"))
    assert "lines: 4" in report_7[0] and "rejected: 1" in report_7[0]


def test_many_followed_files_are_a_stream_for_each_kind_of_output(spark, tmp_path):
    logs = {}
    for k in range(6):
        p = tmp_path / f"{k}.log"
        p.write_text("\n".join(line(m) for m in (0, 7, 20, 40)) + "\n")
        logs[str(p)] = {"DomainName": f"d{k % 4}", "TimeWindowSizeMinutes": 5 if k < 3 else 60, "MetricsWindowSize": 2 + k % 2, "WriteToFileTargetFile": str(tmp_path / f"out{k % 2}")}
    text = json.dumps({"--default--": {"Handlers": ["METRICS", "WRITE_TO_FILE"], "Follow": True, "WriteMetricsToDb": True, "SaveLogsToDb": True, "ReplaceExistingMetrics": False}} | logs)
    kept = database.ParquetTables(spark, str(tmp_path / "t"))
    queries = cli.follow_all(spark, config.load(text), lambda _: kept, str(tmp_path))
    try:
        assert len(queries) == 2
        drained(*queries)
        assert all(q.exception() is None for q in queries)
    finally:
        for q in queries:
            q.stop()
    names = {r.domain_id: r.domain for r in kept.domains().collect()}
    got = {(names[r.domain_id], r.time_window): r.metric_value for r in kept.metrics.read().where("metric_type = 1").collect()}
    # Files 0 and 4 share a name, 1 and 5 too; of four windows the oldest ones have left their two or three slots.
    assert got == {("d0", 200010101300): 1, ("d0", 200010101305): 1, ("d1", 200010101300): 1, ("d2", 200010101300): 1, ("d2", 200010101305): 1}
    assert spark.read.parquet(str(tmp_path / "t" / "raw_logs")).count() == 24
    assert spark.read.text(str(tmp_path / "out0")).count() == spark.read.text(str(tmp_path / "out1")).count() == 12


def test_reports_take_one_pass(spark):
    rows = spark.createDataFrame([(line(0),), (line(1, 404),), ("junk",)], "value string")
    every = parse.to_requests(parse.detect(rows), keep_rejected=True)
    got = {(r.dimension, r.key): r.n for r in counters.report_counts(every).collect()}
    assert [got.get((d, "")) for d in counters.SUMS] == [3, 1, 2, 20, None, 2, None]
    assert got["status", "200"] == got["status", "404"] == 1 and ("status", None) not in got


def test_sketches_of_windows_and_runs_keep_the_heavy_keys(spark, tmp_path):
    import random

    rng = random.Random(6)
    keys = [f"/{min(int(rng.paretovariate(0.9)), 4000)}" for _ in range(6000)]
    rows = spark.createDataFrame([(k % 60, x) for k, x in enumerate(keys)], "w int, path string")
    whole = rows.groupBy("path").count()
    exact = {r["path"]: r["count"] for r in whole.collect()}
    made = counters.sketches(rows, ("path",), ("w",), 96)
    made.write.parquet(str(tmp_path / "s"))
    got = {r.key: (r.n, r.error) for r in counters.top_of_sketches(spark.read.parquet(str(tmp_path / "s")), 10, tracked=96).collect()}
    assert len(exact) > 128 and {e for _, e in got.values()} == {165}
    assert all(abs(n - exact[k]) <= e for k, (n, e) in got.items())
    heavy = {k for k, n in exact.items() if n > 2 * 165}
    assert len(heavy) >= 3 and heavy <= set(got)


def test_a_stream_of_sketches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.txt").write_text("\n".join([line(m, ip=f"1.1.1.{m % 3}") for m in range(10 + k)]))
        streaming.start_sketches(spark.readStream.text(str(source)), str(tmp_path / "s"), str(tmp_path / "c"), 5).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "s"))
    assert kept.select("batch", "time_window").distinct().count() == 5
    top = counters.top_of_sketches(kept, 2).where("dimension = 'client'").orderBy("rank").collect()
    assert [(r.key, r.n) for r in top] == [("1.1.1.0", 8), ("1.1.1.1", 7)]


def test_lines_out_of_order_are_flagged_in_json(spark, tmp_path):
    p = tmp_path / "o.log"
    p.write_text("\n".join(line(m) for m in (5, 3, 7)) + "\n")
    flags = lambda d: sorted((x["timestamp"][14:16], x["is_out_of_order"]) for x in (json.loads(r.value) for r in spark.read.text(str(d)).collect()))
    cli.run(spark, str(p), config.FileConfig(handlers=("WRITE_TO_FILE",), write_to_file=str(tmp_path / "bounded")))
    assert flags(tmp_path / "bounded") == [("03", True), ("05", False), ("07", False)]
    q = cli.follow(spark, str(p), config.FileConfig(follow=True, handlers=("WRITE_TO_FILE",), write_to_file=str(tmp_path / "out")))
    try:
        drained(*q)
        with p.open("a") as out:
            out.write("".join(line(m) + "\n" for m in (6, 9, 8)))
        drained(*q)
    finally:
        q[0].stop()
    assert flags(tmp_path / "out") == [("03", True), ("05", False), ("06", True), ("07", False), ("08", True), ("09", False)]


def test_disabled_files_are_left_alone(spark, tmp_path, capsys):
    for name in ("on", "off"):
        (tmp_path / f"{name}.log").write_text(line(1 if name == "on" else 2))
    (tmp_path / "c.json").write_text(json.dumps({"--default--": {"Handlers": ["METRICS"], "TimeWindowSizeMinutes": 1}, str(tmp_path / "on.log"): {}, str(tmp_path / "off.log"): {"Enabled": False}}))
    cli.main(["-c", str(tmp_path / "c.json")])
    told = capsys.readouterr().out
    assert "200010101301" in told and "200010101302" not in told


def test_arrivals_are_dealt_over_files_in_whole_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_BLOCK", 50)
    ids = spark.range(1000).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value")
    ids.write.parquet(str(tmp_path / "events.parquet"))
    files = catalog._arrive(spark, str(tmp_path), str(tmp_path / "lines"), "parquet", ["event_id", "value"])
    assert files == spark.sparkContext.defaultParallelism > 1
    for k in range(4):
        part = spark.read.parquet(str(tmp_path / "lines" / f"part={k}"))
        assert len(part.inputFiles()) == files
        rows = part.select("event_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
        assert {r.event_id for r in rows} == {i for i in range(1000) if (3 if i % 10 == 3 else 3 * i // 1000) == k}
        by_block, by_file = {}, {}
        for r in sorted(rows, key=lambda r: r["at"]):
            by_block.setdefault(r.event_id // 50, set()).add(r.file)
            by_file.setdefault(r.file, []).append(r.event_id)
        assert all(len(x) == 1 for x in by_block.values()) and all(x == sorted(x) for x in by_file.values()) and len(by_file) > 1


def test_lines_of_two_blocks_are_not_summed(spark):
    # Places 3 to 24 lie in another partition and may close the window.
    made = spark.createDataFrame([(1, "", 7, p, 1, 3, 1) for p in (1, 2, 25, 26)], "metric_type int, key_value string, time_window bigint, place bigint, seen_ms bigint, slots int, value bigint").coalesce(1)
    got = slots.stretches(made, ["metric_type", "key_value"], 10).collect()
    assert sorted((r.place, r.value) for r in got) == [(1, 2), (25, 2)]
