"""Sinks, sources, streaming, configuration, command line and reports."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidelog import cli
from tidelog.functions import formats
from tidelog.operators import counters, parse, report, rollup, sinks
from tidelog.plans import catalog, config
from tidelog.sources import host, logs, tail
from tidelog.streaming import rollup as streaming


def line(minute, status=200, ip="1.1.1.1", uri="/a/b", agent="curl/8", size=10):
    return f'{ip} - - [10/Oct/2000:13:{minute:02d}:36 +0000] "GET {uri} HTTP/1.1" {status} {size} "-" "{agent}"'


def frame(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string")


def test_rollup_sums_and_quirks(spark):
    r = parse.requests(frame(spark, [line(0), line(9), line(10, 404), line(11, uri="/bad%zz"), line(12).replace("10/Oct/2000", "bad")]))
    got = {(x.metric_type, x.key_value, x.time_window): x.metric_value for x in rollup.rollup(r, 10).collect()}
    assert got[1, "", 200010101300] == 2 and got[1, "", 200010101310] == 2 and got[2, "", 200010101300] == 20
    assert got[7, "/a/b", 200010101300] == 2 and got[7, "", 200010101310] == 1 and (7, "/a", 200010101310) not in got
    assert sum(v for (t, _, _), v in got.items() if t == 3) == 4


def test_counters_top_and_report(spark):
    r = parse.requests(frame(spark, [line(0, ip=f"1.1.1.{i % 3}") for i in range(7)] + [line(0, uri="/x?q=alert")]))
    assert counters.totals(r).first().asDict() == {"requests": 8, "bytes": 80, "humans": 0, "non_humans": 8, "malicious": 1}
    assert [(x.key, x.n) for x in counters.top_of(r, "client", 2).collect()] == [("1.1.1.0", 3), ("1.1.1.1", 3)]
    assert [(x.key, x.n) for x in counters.top_of(r, "client", 0).collect()] == [("1.1.1.0", 3)]
    assert counters.approximate_top(r, "client", 1).count() == 1
    text = report.counter_report(r, 1, {("status", "200"): 5}, rejected=2)
    assert "lines: 10" in text and "requests: 8" in text and "200        8 (+3)" in text and "-not set-" in text
    dump = json.loads(report.metrics_report(rollup.rollup(r, 10)))
    assert dump["1"][""]["Values"]["200010101300"] == 8
    rolled = rollup.rollup(parse.requests(frame(spark, [line(m) for m in (0, 15, 25, 25, 35)])), 10)
    live = json.loads(report.metrics_report(rolled, 2))
    assert live["1"][""]["Values"] == {"200010101320": 2, "200010101330": 1}
    assert list(json.loads(report.metrics_report(rolled, None, 1))["3"]) == ["200"]


def test_only_the_wanted_cells_are_made(spark):
    r = parse.requests(frame(spark, [line(0), line(9)]))
    one = rollup.rollup(r, 10, types=("status",))
    assert [(x.metric_type, x.key_value, x.metric_value) for x in one.collect()] == [(3, "200", 2)]
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "zgrab" not in plan


def test_marks_in_lines_are_text(spark):
    forged = "\x01".join(["x", "", "6.6.6.6", "-", "-", "10/Oct/2000:13:00:36 +0000", "GET", "/", "HTTP/1.1", "200", "1", "", "", "", "", "", ""])
    good = line(0, agent="a\x01b\x02c\x02a")
    got = parse.requests(frame(spark, [forged, good, line(1, uri="/p\x01q"), line(2)])).orderBy("n").collect()
    assert [r.n for r in got] == [1, 2, 3] and got[0].user_agent.full_name == "a\x01b\x02c\x02a" and got[1].uri == "/p\x01q"
    assert got[0].client_ip == "1.1.1.1"


def test_out_of_order_over_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(parse, "BLOCK", 7)
    rng = random.Random(2)
    minutes = {f: [rng.randrange(60) for _ in range(50)] for f in ("a", "b")}
    rows = [(f, i, line(m)) for f, ms in minutes.items() for i, m in enumerate(ms)]
    r = parse.requests(spark.createDataFrame(rows, "file string, n int, value string"))
    got = {(x.file, x.n): x.is_out_of_order for x in parse.flag_out_of_order(r, "file", "n").collect()}
    assert got == {(f, i): i > 0 and m < max(ms[:i]) for f, ms in minutes.items() for i, m in enumerate(ms)}


def test_metric_table_upserts_and_replay(spark, tmp_path):
    table = sinks.MetricTable(spark, str(tmp_path / "m"))
    row = spark.createDataFrame([(1, 1, "", 200010101300, 5)], sinks.MetricTable.SCHEMA)
    assert table.read().count() == 0
    assert table.upsert(row, False, "q", 0) and not table.upsert(row, False, "q", 0) and table.upsert(row, False, "q", 1)
    assert table.read().first().metric_value == 10
    assert table.upsert(row, True) and table.read().first().metric_value == 5
    other = spark.createDataFrame([(1, 1, "", 200010111300, 7), (1, 1, "", 200010111310, 8)], sinks.MetricTable.SCHEMA)
    before = table._head()["days"]["20001010"]
    table.upsert(other, False)
    assert table._head()["days"]["20001010"] == before and sorted(r.metric_value for r in table.read().collect()) == [5, 7, 8]
    assert table.upsert(other.limit(0), False, "q", 2) and table.read().count() == 3
    assert len(os.listdir(tmp_path / "m" / "heads")) <= 4 and len([x for x in os.listdir(tmp_path / "m" / "staged")]) == 0
    stale = table._head() | {"n": table._head()["n"]}
    with pytest.raises(RuntimeError):
        table._publish(stale)


def test_json_lines_round_trip(spark, tmp_path):
    r = parse.requests(frame(spark, [line(0), line(1).replace("+0000", "-0730")]))
    sinks.write_json_lines(r, str(tmp_path / "j"))
    got = sorted((json.loads(x.value) for x in spark.read.text(str(tmp_path / "j")).collect()), key=lambda d: d["timestamp"])
    assert [g["timestamp"] for g in got] == ["2000-10-10T13:00:36Z", "2000-10-10T13:01:36-07:30"] and got[0]["user_agent"]["family"] == "Script"
    with pytest.raises(ValueError):
        sinks.write_json_lines(r, "")


def test_text_source(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_text("one\r\n  two\t\n\nlast")
    assert sorted(r.value for r in logs.lines(spark, str(p)).collect()) == ["", "last", "one", "two"]
    n = logs.numbered_lines(spark, str(p))
    assert [logs.skip_first(n, k).count() for k in (0, 1, 2, 3, -1)] == [4, 3, 3, 2, 0]
    assert logs.without_matching(n, "^o").count() == 3


def test_tail_through_rotation(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SETTLED", 0.0)
    p = tmp_path / "access.log"
    p.write_text("a\nb\nhalf")
    r = tail.TailReader([str(p)], 0, 4)

    def take(start, end):
        return [x for part in r.partitions(start, end) for x, *_ in r.read(part)]

    o0 = r.initialOffset()
    o1 = r.latestOffset()
    assert take(o0, o1) == ["a", "b"]
    with p.open("a") as f:
        f.write(" done\nlate\n")
    os.rename(p, tmp_path / "access.log.1")
    p.write_text("new\n")
    o2 = r.latestOffset()
    assert take(o1, o2) == ["half done", "late", "new"] and take(o2, o2) == []
    # Two rotations at once, a line written to the renamed file and one without an end.
    os.rename(tmp_path / "access.log.1", tmp_path / "access.log.3")
    with p.open("a") as f:
        f.write("second\n")
    os.rename(p, tmp_path / "access.log.2")
    p.write_text("between\nopen end")
    os.rename(p, tmp_path / "access.log.1")
    with (tmp_path / "access.log.2").open("a") as f:
        f.write("after the rename\n")
    os.utime(tmp_path / "access.log.1")
    p.write_text("newest\n")
    o3 = r.latestOffset()
    assert sorted(take(o2, o3)) == sorted(["second", "after the rename", "between", "open end", "newest"])
    # Truncated in place, and grown beyond where it was read.
    p.write_text("other start\nand more than before\n")
    o4 = r.latestOffset()
    assert take(o3, o4) == ["other start", "and more than before"]
    assert json.loads(tail.TailReader([str(p)], -1, 100).initialOffset()["files"])[str(p)]["files"][-1] == json.loads(o4["files"])[str(p)]["files"][-1]
    missing = tail.TailReader([str(tmp_path / "none")], 0, 100)
    assert missing.partitions(missing.initialOffset(), missing.latestOffset()) == []


def test_tail_takes_in_what_a_trigger_may(tmp_path):
    p = tmp_path / "big.log"
    p.write_text("".join(f"line {i}\n" for i in range(100)))
    r = tail.TailReader([str(p)], 0, 1 << 20, 50)
    got, at, steps = [], r.initialOffset(), 0
    while True:
        then = r.latestOffset()
        if then == at:
            break
        got += [x for part in r.partitions(at, then) for x, *_ in r.read(part)]
        at, steps = then, steps + 1
    assert got == [f"line {i}" for i in range(100)] and 10 <= steps <= 20


def test_tail_stream(spark, tmp_path):
    p = tmp_path / "s.log"
    p.write_text(line(0) + "\n" + line(1) + "\n")
    spark.dataSource.register(tail.TailSource)
    stream = spark.readStream.format("access_log_tail").option("paths", json.dumps([str(p)])).load()
    q = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        with p.open("a") as f:
            f.write(line(2) + "\n")
        q.processAllAvailable()
        assert spark.table("tailed").count() == 3
    finally:
        q.stop()


def test_stream_equals_batch_and_late_rows_drop(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [line(m) for m in (0, 5, 12, 25, 40)]
    (source / "1.txt").write_text("\n".join(lines))
    stream = spark.readStream.text(str(source))
    bounded = sinks.MetricTable(spark, str(tmp_path / "b"))
    streaming.start_bounded(stream, 10, bounded, 7, str(tmp_path / "c1")).awaitTermination()
    batch = rollup.rollup(parse.requests(spark.read.text(str(source))), 10)
    assert sorted(map(tuple, bounded.read().select(*sorted(batch.columns)).collect())) == sorted(map(tuple, batch.select(*sorted(batch.columns)).collect()))
    table = sinks.MetricTable(spark, str(tmp_path / "m"))
    q = streaming.start_metrics(spark.readStream.text(str(source)), table, 7, 10, 2, str(tmp_path / "c2"), every="0 seconds")
    try:
        q.processAllAvailable()
        (source / "2.txt").write_text(line(1) + "\n" + line(59))
        q.processAllAvailable()
        (source / "3.txt").write_text(line(59))
        q.processAllAvailable()
        counts = {r.time_window: r.metric_value for r in table.read().where("metric_type = 1").collect()}
        assert counts[200010101300] == 2 and counts[200010101310] == 1
    finally:
        q.stop()


def test_config_rules():
    text = json.dumps({
        "--default--": {"Handlers": ["METRICS"], "TimeWindowSizeMinutes": 5, "HostId": 4, "DbUser": "u", "DbPassword": "secret", "CounterTopNForKeyedMetrics": 7, "Follow": True},
        "/a.log": {"Handlers": [], "MetricsWindowSize": 50, "TimeWindowSizeMinutes": None, "CounterTopNForKeyedMetrics": 0},
        "/b.log": {"Handlers": ["COUNTER"], "Follow": False, "Enabled": "yes"},
        "--OS-metrics--": {"OSMetricsEnabled": True},
    })
    c = config.load(text)
    assert set(c) == {"/a.log", "/b.log", "--OS-metrics--"}
    assert c["/a.log"].handlers == ("METRICS",) and c["/a.log"].metrics_window_size == 3 and c["/a.log"].time_window_minutes == 5 and c["/a.log"].top_n == 10
    assert c["/b.log"].handlers == ("COUNTER",) and not c["/b.log"].follow and c["/b.log"].enabled
    host_config = c["--OS-metrics--"]
    assert (host_config.db_user, host_config.host_id) == ("u", 4) and "secret" not in repr(host_config)
    assert config.load(json.dumps({"--default--": {}})) == {}
    with pytest.raises(ValueError):
        config.load(json.dumps({"/a": {"Handlers": ["WRITE_TO_FILE"]}}))
    assert [config.next_run_minute(m, 15) for m in (0, 1, 59)] == [0, 14, 1]


def test_command_line(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text("\n".join(line(i) for i in range(3)))
    out = {k: cli.configs(cli.arguments(["-p", k, str(p)]))[str(p)] for k in ("count", "metrics", "security")}
    assert [out[k].handlers for k in out] == [("COUNTER",), ("METRICS",), ()]
    assert "requests: 3" in cli.run(spark, str(p), out["count"])[0]
    assert json.loads(cli.run(spark, str(p), out["metrics"])[0])["3"]["200"]["Values"]["200010101302"] == 1
    with pytest.raises(SystemExit):
        cli.configs(cli.arguments([]))


def test_host_texts(spark):
    from tidelog.operators import hoststats

    texts = {
        "12:13  up 13 days, 13:27, 11 users, load averages: 1.25 1.50 1.52": ("12:13", 19527, 11, "1.25", "1.50", "1.52"),
        "09:18:58 up 34 days, 14:35,  2 users,  load average: 0.04, 0.03, 0.00": ("09:18:58", 49835, 2, "0.04", "0.03", "0.00"),
        "09:18:58 up 14:35,  2 users,  load average: 0.04, 0.03, 0.00": ("09:18:58", 875, 2, "0.04", "0.03", "0.00"),
        "09:18:58 up 34 min,  1 user,  load average: 0.04, 0.03, 0.00": ("09:18:58", 34, 1, "0.04", "0.03", "0.00"),
    }
    got = hoststats.parse_uptime(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert {r.value: tuple(r)[1:] for r in got} == texts
    free = "               total        used        free      shared  buff/cache   available\nMem:         8131912     1142280     5147464        4044     2163520     6989632\nSwap:        2097148        1024     2096124"
    assert tuple(hoststats.parse_memory(spark.createDataFrame([(free,)], "value string")).drop("value").first()) == (1142280, 5147464, 2163520, 6989632, 1024)


def test_host_sample_and_out_of_order(spark):
    assert isinstance(host.sample(spark).first().metrics_ts, dt.datetime)
    r = parse.requests(frame(spark, [line(5), line(3), line(7)])).withColumn("file", F.lit("f"))
    assert [x.is_out_of_order for x in parse.flag_out_of_order(r, "file", "n").orderBy("n").collect()] == [False, True, False]


def test_follow_and_sampler(spark, tmp_path):
    from tidelog.streaming.host import start_host_sampler

    p = tmp_path / "f.log"
    p.write_text("\n".join(line(i) for i in range(3)) + "\n")
    c = config.FileConfig(follow=True, handlers=("COUNTER", "WRITE_TO_FILE"), write_to_file=str(tmp_path / "out"), counter_interval=1)
    got = []
    queries = [*cli.follow(spark, str(p), c), start_host_sampler(spark, 3, lambda df: got.append(df.first()), str(tmp_path / "h"), aligned=False)]
    try:
        queries[1].processAllAvailable()
        for _ in range(100):
            if got:
                break
            import time

            time.sleep(0.2)
        assert spark.read.text(str(tmp_path / "out")).count() == 3 and got[0].host_id == 3
    finally:
        for q in queries:
            q.stop()


def test_running_tops_show_changes(spark):
    tops = streaming.Tops(1)
    rows = lambda *x: spark.createDataFrame([("status", k, n) for k, n in x] + [("lines", "", sum(n for _, n in x))], "dimension string, key string, n bigint")
    tops.update(rows(("200", 5), ("404", 2)))
    counts, before = tops.update(rows(("200", 8), ("500", 1)))
    text = report.live_report(counts, before, 2)
    assert "lines: 9 (+2)" in text and "200        8 (+3)" in text and "404        2 (+0)" in text


def database_lines():
    shop = line(1).replace("1.1.1.1 -", "shop.example:80 2.2.2.2 -")
    browser = line(0, agent="Mozilla/5.0 (Macintosh; Intel Mac OS X 10.15; rv:138.0) Gecko/20100101 Firefox/138.0", ip="10.0.0.1")
    return [browser, line(2), line(3, 404), shop, "junk"]


@pytest.mark.parametrize("jdbc", [False, True])
def test_configured_run_keeps_rows(spark, tmp_path, jdbc):
    from tidelog.operators import database

    # A file is read in one format, so the line of another host is a file of its own.
    p = tmp_path / "logs"
    p.mkdir()
    lines = database_lines()
    (p / "x.log").write_text("\n".join(x for x in lines if not x.startswith("shop")))
    (p / "y.log").write_text("\n".join(x for x in lines if x.startswith("shop")))
    settings = {"Handlers": ["METRICS"], "WriteMetricsToDb": True, "SaveLogsToDb": True, "SaveLogsToDbOnlyRelevant": 1, "SaveLogsToDbMaskIPs": False, "HostId": 4, "DomainName": "example.org", "ReplaceExistingMetrics": False}
    if jdbc:
        settings["DbAddress"] = f"jdbc:derby:{tmp_path}/db;create=true"
    found = config.load(json.dumps({"--default--": settings, str(p): {}}))
    c = config.for_file(found, str(p))
    kept = database.tables(spark, c, str(tmp_path / "t"))
    for _ in range(2):
        cli.run(spark, str(p), c, kept)

    def read(name):
        if jdbc:
            df = spark.read.jdbc(c.db_address, name)
            return df.toDF(*[x.lower() for x in df.columns])
        return kept.metrics.read() if name == "metrics" else spark.read.parquet(str(tmp_path / "t" / name))

    domains = {r.domain: r.domain_id for r in read("domains").collect()}
    assert set(domains) == {"example.org", "shop.example:80"} and sorted(domains.values()) == [1, 2]
    counts = {r.domain_id: r.metric_value for r in read("metrics").where("metric_type = 1").collect()}
    assert counts == {domains["example.org"]: 6, domains["shop.example:80"]: 2}
    raw = read("raw_logs").collect()
    assert len(raw) == 2 and {bytes(r.client_ip) for r in raw} == {bytes([10, 0, 0, 1])} and raw[0].host_id == 4
    assert config.load(json.dumps({"--default--": settings, str(p): {"WriteMetricsToDb": False}}))[str(p)].write_metrics_to_db is False


def test_upsert_statements():
    for url, word in (("jdbc:mysql://h/d", "ON DUPLICATE KEY"), ("jdbc:postgresql://h/d", "ON CONFLICT"), ("jdbc:derby:x", "MERGE INTO")):
        assert word in sinks.upsert_statement(url, "metrics", "staged", True) and "metric_value +" in sinks.upsert_statement(url, "metrics", "staged", False)


def test_host_sampler_of_a_configuration(spark, tmp_path):
    from tidelog.operators import database

    c = config.load(json.dumps({"--default--": {"HostId": 3}, "--OS-metrics--": {"OSMetricsEnabled": True, "OSMetricsIntervalMinutes": 1}}))[config.HOST_KEY]
    kept = database.ParquetTables(spark, str(tmp_path / "t"))
    assert cli.sample_host(spark, config.FileConfig(), kept, "unused") is None
    q = cli.sample_host(spark, c, kept, str(tmp_path / "c"), aligned=False)
    try:
        import time

        for _ in range(150):
            if list((tmp_path / "t" / "host_metrics").glob("*/*/_SUCCESS")):
                break
            time.sleep(0.2)
        assert spark.read.parquet(str(tmp_path / "t" / "host_metrics")).first().host_id == 3
    finally:
        q.stop()


@pytest.mark.parametrize("name", ["relevant_logs", "ua_class", "ua_robots_override"])
def test_filters_run_no_step_of_a_request_again(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # The line pattern stands there once, and so does the decoding of paths; a pushed filter would repeat what it names.
    assert plan.count(formats.LINE) == 1 and plan.count("UrlCodec.decode") == 1 and max(map(len, plan.splitlines())) < 20_000


def test_only_keeps_what_a_filter_keeps(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None), (3, True)], "n int, ok boolean")
    kept = parse.only(rows, F.col("ok"))
    assert kept.columns == rows.columns and sorted(kept.collect()) == sorted(rows.where("ok").collect())
