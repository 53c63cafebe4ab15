"""Published vectors of log lines, URIs, user agents, timestamps and host samples: fixed values, as they say what is to be matched."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.functions import agents, timebin
from tidelog.operators import hoststats, parse
from tidelog.plans import fixture

HEAD = '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET {uri} HTTP/1.1" 200 612'


def parsed(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string")
    return [r.asDict(recursive=True) for r in parse.requests(df).orderBy("n").collect()]


def test_formats(spark):
    common = '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /p1/p2/p3/apache_pb.gif HTTP/1.0" 200 2326'
    nginx = HEAD.format(uri="/") + ' "-" "Mozilla/5.0 (Macintosh)"'
    vhost = 'example.com:80 127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 200 2326 "http://www.example.com/start.html" "Mozilla/4.08 [en] (Win98; I ;Nav)"'
    custom = HEAD.format(uri="/") + ' "-" "Mozilla/5.0" 0.123 0.456'
    c, n, v, k = parsed(spark, common, nginx, vhost, "  " + custom + "\t")
    assert (c["format"], c["path1"], c["path2"], c["path3"], c["user_agent"], c["bytes_sent"], c["remote_logname"], c["remote_user"]) == ("common", "/p1", "/p1/p2", "/p1/p2/p3", None, 2326, "-", "frank")
    assert (n["format"], n["remote_logname"], n["referer"], n["user_agent"]["os"], n["user_agent"]["family"]) == ("nginx", "", "", "MacOS", "Other")
    assert (v["format"], v["domain"], v["referer"]) == ("vhost", "example.com:80", "example.com")
    assert (k["format"], k["user_agent"]["human"], k["request_time"], k["upstream_time"]) == ("nginx_custom", "NonHuman", 0.123, 0.456)


def test_rejected(spark):
    bad = ["", "junk", HEAD.format(uri="/").replace("612", "-") + ' "-" "x"', '1.1.1.1 - - [10/Oct/2000:13:55:36 -0700] "-" 200 1 "-" "x"', HEAD.format(uri="/") + ' "-" "a \\" b"', "h:80 " + HEAD.format(uri="/")]
    df = spark.createDataFrame([(x,) for x in bad], "value string")
    assert parse.line_counts(parse.detect(df)).first().asDict() == {"processed": 0, "rejected": len(bad)}


@pytest.mark.parametrize("_", [0])
def test_uris(spark, _):
    vectors = [
        ("/a/b/", "/a/b/", "/a", "/a/b", "/a/b/", 0), ("*", "*", "/", "", "", 0), ("/p%20q/r", "/p q/r", "/p q", "/p q/r", "", 0), ("/a+b", "/a+b", "/a+b", "", "", 0),
        ("//h/x", "//h/x", "/", "//h", "//h/x", 0), ("/x/../../etc/passwd", "/x/../../etc/passwd", "/x", "/x/..", "/x/../..", 30), ("/a/%2e%2e/b", "/a/../b", "/a", "/a/..", "/a/../b", 30),
        ("/n%00ull", "/n\0ull", "/n\0ull", "", "", 30), ("/s?q=<script>1", "/s", "/s", "", "", 20), ("/s?q=%3Cscript%3E1", "/s", "/s", "", "", 0), ("/s?alerts=1", "/s", "/s", "", "", 20),
        ("/s?q='+update+t", "/s", "/s", "", "", 10), ("/s?q='+UPDATE+t", "/s", "/s", "", "", 0), ("/bad%zz/p?x=1", "/bad%zz/p", "", "", "", 1), ("index.html", "index.html", "", "", "", 1),
        ("example.com:443", "", "", "", "", 0), ("/", "/", "/", "", "", 0), ("1.2.3.4:443", "1.2.3.4:443", "", "", "", 1), ("http://h.example/a/b?c", "/a/b", "/a", "/a/b", "", 0),
    ]
    got = parsed(spark, *[HEAD.format(uri=v[0]) + ' "-" "x"' for v in vectors])
    assert [(g["uri"], g["path"], g["path1"], g["path2"], g["path3"], g["malicious"]) for g in got] == vectors


def test_sources(spark):
    vectors = [
        ("/", "-", ""), ("/", "https://example.com/somepage", "example.com"), ("/?a=b&utm_source=justexample", "https://example.com/x", "justexample"), ("/a.php?apx=upx&AAAutm_source=google", "http://casualgames.dev/wp?apx=upx", "casualgames.dev"),
        ("/a.php?apx=upx&utm_source=google&o=1", "http://casualgames.dev/", "google"), ("/", "https://www.example.com:8443/p", "example.com"), ("/", "http://u:p@[::1]:80/", "::1"), ("/", "//host.com/x", "host.com"),
        ("/", "example.net/nope", ""), ("/", "http://www.www.x.org", "www.x.org"), ("/", "http://a.b/%zz", ""), ("/", "", ""), ("/", "http://WWW.Big.org/", "WWW.Big.org"),
    ]
    got = parsed(spark, *[HEAD.format(uri=u) + f' "{r}" "x"' for u, r, _ in vectors])
    assert [g["referer"] for g in got] == [v[2] for v in vectors]


def test_user_agents(spark):
    more = [("", "Unknown", "Other", "NonHuman", "Other", "Unknown"), ("-", "Unknown", "Other", "NonHuman", "Other", "Unknown"), ("curl/8.0", "Script", "Script", "NonHuman", "Other", "Scraping"), ("Mozilla/5.0 (compatible; FooBot/1.0)", "Script", "OtherBot", "NonHuman", "Other", "Unknown"), ("Mozilla/5.0 (compatible; BLEXBot/1.0)", "Script", "OtherBot", "NonHuman", "Other", "Processing"), ("facebook/1.1", "Script", "OtherBot", "NonHuman", "Other", "Unknown"), ("x (Claude)", "Script", "AIBot", "NonHuman", "Other", "Unknown")]
    rows = [*fixture.AGENTS, *more]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "n int, agent string").withColumn("path1", F.lit("/"))
    got = agents.with_user_agent(df).orderBy("n").select("user_agent.*").collect()
    assert [(g.full_name, g.device_type, g.family, g.human, g.os, g.intent) for g in got] == [tuple(r) for r in rows]
    robots = agents.with_user_agent(df.withColumn("path1", F.lit("/robots.txt"))).orderBy("n").select("user_agent.*").collect()
    assert all(r.human == "NonHuman" and r.device_type == "Script" and r.family not in ("Chrome", "Safari", "Other", "Scanner") for r in robots)


def test_timestamps(spark):
    df = spark.createDataFrame([("10/Oct/2000:13:55:36 -0700",), ("bad",)], "s string").select(timebin.instant(F.col("s")).alias("i"), *[timebin.window_id(timebin.wall_clock(F.col("s")), m).alias(f"w{m}") for m in (1, 5, 7, 15, 30, 60)])
    good, bad = df.collect()
    assert good.i == dt.datetime(2000, 10, 10, 20, 55, 36)
    assert tuple(good)[1:] == (200010101355, 200010101355, 200010101350, 200010101345, 200010101330, 200010101300) and set(bad) == {None}
    ms = spark.range(1).select(timebin.millisecond_instant(F.lit("06/Feb/2009:12:14:14.655")).alias("t")).first().t
    assert ms == dt.datetime(2009, 2, 6, 12, 14, 14, 655000)


def test_host_samples(spark):
    rows = ["12:13  up 13 days, 13:27, 11 users, load averages: 1.25 1.50 1.52", "09:18:58 up 14:35,  2 users,  load average: 0.04, 0.03, 0.00", "odd"]
    got = hoststats.parse_uptime(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert tuple(got[0])[1:] == ("12:13", 19527, 11, "1.25", "1.50", "1.52") and got[1].up_duration_minutes == 875 and got[2].up_duration_minutes is None
    free = "head\nMem: 8131912 1142280 5147464 4044 2163520 6989632\nSwap: 10 7 3"
    m = hoststats.parse_memory(spark.createDataFrame([(free,)], "value string")).first()
    assert (m.memory_use, m.memory_free, m.cache_use, m.memory_available, m.swap_use) == (1142280, 5147464, 2163520, 6989632, 7)
