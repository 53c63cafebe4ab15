"""Every registered query over the derived access log, with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import timebin, urls
from tidelog.operators import counters, hoststats, parse, rawlogs, rollup, sinks
from tidelog.plans import fixture
from tidelog.plans.shared import shared_dir
from tidelog.streaming import rollup as streaming
from tidelog.streaming import slots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def _shown(c: str) -> Column:
    """A path whose NUL characters are written out, as engines disagree on showing them."""
    return F.replace(F.col(c), F.lit("\x00"), F.lit("%00"))


def requests(spark: SparkSession, sf_dir: str, fmt: str = "nginx") -> DataFrame:
    return parse.requests(fixture.spark_log(spark, sf_dir, fmt)).withColumns({c: _shown(c) for c in ("path", "path1", "path2", "path3")})


# ---- DuckDB side: the same facts from the rules, not from the log lines ----

_AGENT_ROWS = ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in a[1:]) + ")" for i, a in enumerate(fixture.AGENTS))
REQ = f"""
WITH f AS ({fixture.duckdb_fields()}),
agent_classes(k, device, family, human, os, intent) AS (VALUES {_AGENT_ROWS}),
u AS (SELECT *, split_part(uri, '?', 1) AS rp, CASE WHEN instr(uri, '?') > 0 THEN substr(uri, instr(uri, '?') + 1) ELSE '' END AS q,
        strptime(left(stamp, 20), '%d/%b/%Y:%H:%M:%S') AS wall FROM f),
v AS (SELECT *, regexp_matches(rp, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)') AS bad FROM u),
w AS (SELECT *, CASE WHEN bad THEN rp ELSE url_decode(replace(replace(rp, '%00', '%2500'), '+', '%2B')) END AS path FROM v),
x AS (SELECT *, string_split(path, '/') AS p FROM w),
y AS (SELECT *, CASE WHEN bad THEN '' ELSE '/' || p[2] END AS path1,
        CASE WHEN bad OR len(p) < 3 THEN '' ELSE '/' || p[2] || '/' || p[3] END AS path2,
        CASE WHEN bad OR len(p) < 4 THEN '' ELSE '/' || p[2] || '/' || p[3] || '/' || p[4] END AS path3 FROM x),
req AS (SELECT event_id, ip AS client_ip, stamp, wall, method, uri, path, path1, path2, path3, status, CAST(bytes AS BIGINT) AS bytes_sent,
        CASE WHEN regexp_extract(uri, '[?&]utm_source=([^&]+)', 1) <> '' THEN regexp_extract(uri, '[?&]utm_source=([^&]+)', 1)
             ELSE regexp_replace(regexp_extract(y.referer, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') END AS referer,
        CASE WHEN bad THEN 1 WHEN contains(path, '/../') OR contains(uri, '%00') THEN 30
             WHEN regexp_matches(q, '<script|script>|alert|onmouseover|onmouseout') THEN 20
             WHEN regexp_matches(q, '''.*(insert|update|exec|execute)') THEN 10 ELSE 0 END AS malicious,
        ua, CASE WHEN path1 = '/robots.txt' AND a.family NOT IN ('AIBot', 'SEOBot', 'Script', 'SearchBot', 'SocialBot') THEN 'OtherBot' ELSE a.family END AS family,
        CASE WHEN path1 = '/robots.txt' THEN 'Script' ELSE a.device END AS device,
        CASE WHEN path1 = '/robots.txt' THEN 'NonHuman' ELSE a.human END AS human, a.os, a.intent
        FROM y JOIN agent_classes a ON a.k = event_id % 20)
"""


def _window(minutes: int, wall: str = "wall") -> str:
    return f"CAST(strftime({wall}, '%Y%m%d%H') AS BIGINT) * 100 + CAST(floor(extract('minute' FROM {wall}) / {minutes}) * {minutes} AS BIGINT)"


def _cells(minutes: int) -> str:
    ok = "status LIKE '2%'"
    parts = [(1, "''", "1", ""), (2, "''", "bytes_sent", ""), (3, "status", "1", ""), (5, "method", "1", ""), (6, "referer", "1", "WHERE referer <> ''"), (7, "path1", "1", f"WHERE {ok}"), (7, "path2", "1", f"WHERE {ok} AND path2 <> ''"), (7, "path3", "1", f"WHERE {ok} AND path3 <> ''"), (11, "family", "1", ""), (12, "os", "1", ""), (13, "device", "1", ""), (14, "human", "1", ""), (15, "intent", "1", "")]
    every = " UNION ALL ".join(f"SELECT {t} AS metric_type, {k} AS key_value, {_window(minutes)} AS time_window, CAST({v} AS BIGINT) AS v FROM req {w}" for t, k, v, w in parts)
    return REQ + f", cells AS ({every}), rolled AS (SELECT metric_type, key_value, time_window, CAST(sum(v) AS BIGINT) AS metric_value FROM cells GROUP BY ALL) "


# The five line patterns, from the groups that each format has in common.
_RX_MIDDLE = r'\[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+)'
_RX_END = r' "([^"]*)" "([^"]*)"'
_PATTERNS = {
    "common": (rf"^(\S+) (\S+) (\S+) {_RX_MIDDLE}$", ("client_ip", "remote_logname", "remote_user")),
    "combined": (rf"^(\S+) (\S+) (\S+) {_RX_MIDDLE}{_RX_END}$", ("client_ip", "remote_logname", "remote_user")),
    "vhost": (rf"^(\S+) (\S+) (\S+) (\S+) {_RX_MIDDLE}{_RX_END}$", ("domain", "client_ip", "remote_logname", "remote_user")),
    "nginx": (rf"^(\S+) - (\S+) {_RX_MIDDLE}{_RX_END}$", ("client_ip", "remote_user")),
    "nginx_custom": (rf"^(\S+) - (\S+) {_RX_MIDDLE}{_RX_END} (\S+) (\S+)$", ("client_ip", "remote_user")),
}


def _parse_oracle(fmt: str) -> str:
    pattern, first = _PATTERNS[fmt]
    names = [*first, "stamp", "method", "uri", "protocol", "status", "bytes"]
    if fmt != "common":
        names += ["raw_referer", "agent"]
    if fmt == "nginx_custom":
        names += ["t1", "t2"]
    listed = ", ".join(f"'{n}'" for n in names)
    text = lambda n: f"g.{n}" if n in names else "''"
    return f"""WITH f AS ({fixture.duckdb_fields()}), l AS (SELECT event_id, {fixture.line(fmt, "duckdb")} AS line FROM f),
m AS (SELECT event_id, regexp_extract(line, '{pattern}', [{listed}]) AS g FROM l WHERE regexp_matches(line, '{pattern}'))
SELECT event_id, '{fmt}' AS format, {text("domain")} AS domain, g.client_ip AS client_ip, {text("remote_logname")} AS remote_logname, g.remote_user AS remote_user, g.method AS method, g.uri AS uri,
g.protocol AS protocol, g.status AS status, CAST(g.bytes AS BIGINT) AS bytes_sent, {text("agent")} AS agent FROM m"""


def _parse_query(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = parse.requests(fixture.spark_log(spark, sf_dir, fmt))
        return r.select("event_id", "format", "domain", "client_ip", "remote_logname", "remote_user", "method", "uri", "protocol", "status", "bytes_sent", F.coalesce("user_agent.full_name", F.lit("")).alias("agent"))

    return run


for _fmt in _PATTERNS:
    query(f"parse_{_fmt}", _parse_oracle(_fmt))(_parse_query(_fmt))


@query(
    "format_detect",
    f"""WITH f AS ({fixture.duckdb_fields()}) SELECT event_id % 7 AS turn,
    CASE event_id % 7 WHEN 0 THEN 'common' WHEN 1 THEN 'combined' WHEN 2 THEN 'vhost' WHEN 3 THEN 'nginx' WHEN 4 THEN 'nginx_custom' ELSE 'rejected' END AS format, count(*) AS n FROM f GROUP BY ALL""",
)
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.detect(fixture.spark_log(spark, sf_dir, "mixed"))
    return found.groupBy((F.col("event_id") % 7).alias("turn"), F.coalesce("format", F.lit("rejected")).alias("format")).agg(F.count("*").alias("n"))


@query("line_counts", f"WITH f AS ({fixture.duckdb_fields()}) SELECT count(*) FILTER (event_id % 7 < 5) AS processed, count(*) FILTER (event_id % 7 >= 5) AS rejected FROM f")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.line_counts(parse.detect(fixture.spark_log(spark, sf_dir, "mixed")))


@query("sticky_format", f"WITH f AS ({fixture.duckdb_fields()}), l AS (SELECT *, event_id % 2 AS file, event_id % 7 AS k FROM f), first AS (SELECT file, min_by(k, event_id) AS k FROM l WHERE k < 5 GROUP BY file) SELECT file, count(*) AS n FROM l JOIN first USING (file) WHERE l.k = first.k OR first.k = 1 AND l.k = 3 GROUP BY file")
def sticky_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.detect(fixture.spark_log(spark, sf_dir, "mixed")).withColumn("file", F.col("event_id") % 2)
    return parse.keep_first_format(found, "file", "event_id").groupBy("file").agg(F.count("*").alias("n"))


@query(
    "log_timestamp",
    REQ + "SELECT event_id, epoch(strptime(stamp, '%d/%b/%Y:%H:%M:%S %z'))::BIGINT AS instant, epoch(wall)::BIGINT AS wall, right(stamp, 5) AS tz_offset FROM req",
)
def log_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("event_id", F.unix_seconds("ts").alias("instant"), F.unix_seconds("ts_wall").alias("wall"), "tz_offset")


@query("path_levels", REQ + "SELECT event_id, path, path1, path2, path3 FROM req")
def path_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("event_id", "path", "path1", "path2", "path3")


@query("threat_class", REQ + "SELECT event_id, malicious FROM req")
def threat_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("event_id", F.col("malicious").cast("int").alias("malicious"))


@query("traffic_source", REQ + "SELECT event_id, referer FROM req")
def traffic_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("event_id", "referer")


@query(
    "page_source",
    r"""SELECT page_id, CASE WHEN regexp_extract(url, '[?&]utm_source=([^&]+)', 1) <> '' THEN regexp_extract(url, '[?&]utm_source=([^&]+)', 1)
    ELSE regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') END AS source FROM pages""",
)
def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", urls.traffic_source(F.col("url"), F.col("url")).alias("source"))


@query("ua_class", REQ + "SELECT event_id, ua AS full_name, a.os, a.family, a.device AS device_type, a.human, a.intent FROM req JOIN agent_classes a ON a.k = event_id % 20 WHERE path1 <> '/robots.txt'")
def ua_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.only(requests(spark, sf_dir), F.col("path1") != "/robots.txt").select("event_id", "user_agent.*")


@query("ua_robots_override", REQ + "SELECT event_id, family, device AS device_type, human, os, intent FROM req WHERE path1 = '/robots.txt'")
def ua_robots_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.only(requests(spark, sf_dir), F.col("path1") == "/robots.txt").select("event_id", "user_agent.family", "user_agent.device_type", "user_agent.human", "user_agent.os", "user_agent.intent")


def _window_query(minutes: int):
    return lambda spark, sf_dir: requests(spark, sf_dir).groupBy(timebin.window_id(F.col("ts_wall"), minutes).alias("time_window")).agg(F.count("*").alias("n"))


for _m in (1, 5, 10, 15, 30, 60):
    query(f"time_window_{_m}", REQ + f"SELECT {_window(_m)} AS time_window, count(*) AS n FROM req GROUP BY 1")(_window_query(_m))


@query("metric_rollup", _cells(10) + "SELECT * FROM rolled")
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup(requests(spark, sf_dir), 10)


def _metric_query(name: str):
    return lambda spark, sf_dir: rollup.rollup(requests(spark, sf_dir), 60, types=(name,))


for _name, _number in rollup.METRIC_TYPES.items():
    if _name != "client_ip":
        query(f"metric_{_name}", _cells(60) + f"SELECT * FROM rolled WHERE metric_type = {_number}")(_metric_query(_name))


@query("metric_by_domain", _cells(60).replace("FROM req ", "FROM req ") + "SELECT 'example.org' AS domain, metric_type, CAST(sum(metric_value) AS BIGINT) AS metric_value FROM rolled GROUP BY ALL")
def metric_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).withColumn("domain", rawlogs.request_domain(F.col("domain"), "example.org"))
    return rollup.rollup(r, 60, ["domain"]).groupBy("domain", "metric_type").agg(F.sum("metric_value").alias("metric_value"))


@query("counter_totals", REQ + "SELECT count(*) AS requests, CAST(sum(bytes_sent) AS BIGINT) AS bytes, count(*) FILTER (human = 'Human') AS humans, count(*) FILTER (human = 'NonHuman') AS non_humans, count(*) FILTER (malicious <> 0) AS malicious FROM req")
def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.totals(requests(spark, sf_dir))


_DIMENSIONS = {"client": "client_ip", "device": "device", "intent": "intent", "method": "method", "status": "status", "family": "family", "os": "os", "referer": "referer", "path": "path"}
_COUNTS = REQ + ", counts AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS key, count(*) AS n FROM req GROUP BY {c}" for d, c in _DIMENSIONS.items()) + ") "


@query("counter_by_dim", _COUNTS + "SELECT * FROM counts")
def counter_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.by_dimension(requests(spark, sf_dir))


@query("topn_all", _COUNTS + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS INTEGER) AS rank FROM counts) WHERE rank <= 10")
def topn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.top(counters.by_dimension(requests(spark, sf_dir)), 10)


def _top_query(dimension: str):
    return lambda spark, sf_dir: counters.top_of(requests(spark, sf_dir), dimension, 10)


for _d in counters.TOP_DIMENSIONS:
    query(f"topn_{_d}s", REQ + f"SELECT {_DIMENSIONS[_d]} AS key, count(*) AS n FROM req GROUP BY 1 ORDER BY n DESC, key LIMIT 10")(_top_query(_d))


@query("heavy_hitters", _COUNTS + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS INTEGER) AS rank FROM counts WHERE dimension IN ('client', 'referer', 'path')) WHERE rank <= 10")
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top keys from sketches of each hour, which track more keys than there are here and so are exact."""
    r = requests(spark, sf_dir).withColumn("time_window", timebin.window_id(F.col("ts_wall"), 60))
    return counters.top_of_sketches(counters.sketches(r, by=("time_window",)), 10).drop("error")


@query("counter_delta", _cells(60) + "SELECT *, CAST(metric_value - coalesce(lag(metric_value) OVER (PARTITION BY metric_type, key_value ORDER BY time_window), 0) AS BIGINT) AS delta FROM rolled")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.change(rollup.rollup(requests(spark, sf_dir), 60))


_RELEVANT = "malicious = 0 AND (status LIKE '2%' OR status LIKE '5%') AND device <> 'Script' AND family NOT IN ('Scanner', 'SEOBot', 'Script')"


@query("relevant_logs", REQ + f"SELECT event_id, status, family, device FROM req WHERE {_RELEVANT}")
def relevant_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.only(requests(spark, sf_dir), rawlogs.is_relevant()).select("event_id", "status", "user_agent.family", F.col("user_agent.device_type").alias("device"))


def _raw_oracle(masked: bool) -> str:
    return REQ + f"""SELECT event_id, 'example.org' AS domain, {"CAST(NULL AS VARCHAR)" if masked else "client_ip"} AS client_ip, '-' AS remote_user, left(method, 20) AS http_method,
    left(coalesce(nullif(path3, ''), nullif(path2, ''), path1), 100) AS path3, left(path, 100) AS request_uri, status AS http_status, bytes_sent, left(referer, 100) AS referer,
    CAST(malicious AS INTEGER) AS is_malicious, {"right" if masked else "left"}(ua, 100) AS ua_string, os AS ua_os, family AS ua_family, device AS ua_device_type, human AS ua_is_human, intent AS ua_intent FROM req"""


def _raw_query(masked: bool):
    return lambda spark, sf_dir: rawlogs.raw_rows(requests(spark, sf_dir), masked, "example.org", ["event_id"]).drop("request_ts").withColumn("is_malicious", F.col("is_malicious").cast("int"))


query("rawlog_projection_masked", _raw_oracle(True))(_raw_query(True))
query("rawlog_projection_unmasked", _raw_oracle(False))(_raw_query(False))


@query("packed_addresses", REQ + "SELECT client_ip, concat(lower(lpad(hex(CAST(split_part(client_ip, '.', 1) AS INTEGER)), 2, '0')), lower(lpad(hex(CAST(split_part(client_ip, '.', 2) AS INTEGER)), 2, '0')), lower(lpad(hex(CAST(split_part(client_ip, '.', 3) AS INTEGER)), 2, '0')), lower(lpad(hex(CAST(split_part(client_ip, '.', 4) AS INTEGER)), 2, '0'))) AS packed FROM (SELECT DISTINCT client_ip FROM req)")
def packed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("client_ip").distinct().select("client_ip", F.lower(F.hex(rawlogs.packed_ip("client_ip"))).alias("packed"))


_VHOST = "concat('shop', CAST(event_id % 3 AS VARCHAR), '.example.com:80')"


@query("domain_dim", REQ + f", names AS (SELECT DISTINCT {_VHOST} AS domain FROM req WHERE {_VHOST} <> 'shop1.example.com:80') SELECT CAST(7 AS BIGINT) AS domain_id, 'shop1.example.com:80' AS domain UNION ALL SELECT 7 + row_number() OVER (ORDER BY domain), domain FROM names")
def domain_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.sql("SELECT CAST(7 AS BIGINT) AS domain_id, 'shop1.example.com:80' AS domain")
    return rawlogs.assign_ids(requests(spark, sf_dir, "vhost"), known, "domain", "domain_id")


@query("request_domain_join", REQ + f", ids AS (SELECT domain, row_number() OVER (ORDER BY domain) AS domain_id FROM (SELECT DISTINCT {_VHOST} AS domain FROM req)) SELECT domain_id, domain, count(*) AS n FROM (SELECT {_VHOST} AS domain FROM req) JOIN ids USING (domain) GROUP BY ALL")
def request_domain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir, "vhost").withColumn("domain", rawlogs.request_domain(F.col("domain"), "example.org")).select("domain")
    ids = rawlogs.assign_ids(r, spark.createDataFrame([], "domain_id bigint, domain string"), "domain", "domain_id")
    return r.groupBy("domain").agg(F.count("*").alias("n")).join(ids, "domain").select("domain_id", "domain", "n")


def _upsert_query(replace: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = requests(spark, sf_dir)
        early = rollup.rollup(r.where("event_id % 3 < 2"), 60).withColumn("domain_id", F.lit(1))
        late = rollup.rollup(r.where("event_id % 3 > 0"), 60).withColumn("domain_id", F.lit(1))
        return sinks.merge(early, late, replace).drop("domain_id")

    return run


def _upsert_oracle(value: str) -> str:
    base = _cells(60)
    head, tail = base.rsplit(", rolled AS", 1)
    tagged = head.replace("AS v FROM req", "AS v, event_id FROM req")
    halves = ", ".join(f"{n} AS (SELECT metric_type, key_value, time_window, CAST(sum(v) AS BIGINT) AS m FROM cells WHERE event_id % 3 {c} GROUP BY ALL)" for n, c in (("early", "< 2"), ("late", "> 0")))
    return f"{tagged}, {halves} SELECT metric_type, key_value, time_window, CAST({value} AS BIGINT) AS metric_value FROM early FULL JOIN late USING (metric_type, key_value, time_window)"


query("metrics_upsert_replace", _upsert_oracle("coalesce(late.m, early.m)"))(_upsert_query(True))
query("metrics_upsert_add", _upsert_oracle("coalesce(early.m, 0) + coalesce(late.m, 0)"))(_upsert_query(False))


@query("json_lines", REQ + "SELECT event_id, concat(strftime(wall, '%Y-%m-%dT%H:%M:%S'), CASE right(stamp, 5) WHEN '+0000' THEN 'Z' WHEN '+0200' THEN '+02:00' ELSE '-07:30' END) AS stamp, client_ip, method, path, status, bytes_sent, referer, CAST(malicious AS INTEGER) AS malicious, family FROM req")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).withColumn("protocol", F.col("event_id").cast("string"))
    kind = "timestamp string, client_ip string, method string, path string, protocol string, status string, bytes_sent bigint, referer string, user_agent struct<family: string>, malicious int"
    back = sinks.json_lines(r).select(F.from_json("value", kind).alias("j"))
    return back.select(F.col("j.protocol").cast("bigint").alias("event_id"), F.col("j.timestamp").alias("stamp"), "j.client_ip", "j.method", "j.path", "j.status", "j.bytes_sent", "j.referer", "j.malicious", "j.user_agent.family")


@query("live_windows", _cells(10) + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_type, key_value ORDER BY time_window DESC) <= 3 AS live FROM rolled)")
def live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.live_windows(rollup.rollup(requests(spark, sf_dir), 10), 3)


#: Lines arrive in three parts by order, and every tenth of them only at the end.
_ARRIVAL = "CASE WHEN event_id % 10 = 3 THEN 3 ELSE CAST(floor(3.0 * event_id / (max(event_id) OVER () + 1)) AS INTEGER) END"
_END = "date_trunc('hour', wall) + INTERVAL 10 MINUTE * (1 + CAST(floor(extract('minute' FROM wall) / 10) AS INTEGER))"


#: Lines of so many event_ids stand together in a file, in their order.
_BLOCK = 10_000


def _arrive(spark: SparkSession, sf_dir: str, folder: str, form: str, columns: list[str]) -> int:
    """The log as four arrivals in the order of ``_ARRIVAL``, a folder each; how many files each of them has.

    Blocks of lines are dealt over as many files as there are cores. All arrivals have as many files, empty ones if need be, so that a trigger of that many is one arrival.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrival = F.expr(_ARRIVAL.replace("max(event_id) OVER ()", str(events.agg(F.max("event_id")).first()[0])))
    files = spark.sparkContext.defaultParallelism
    empty = spark.createDataFrame([], "event_id bigint, value string").select(*columns).coalesce(1)
    for k in range(4):
        own = events.where(arrival == k).repartition(files, F.floor(F.col("event_id") / _BLOCK)).sortWithinPartitions("event_id")
        part = f"{folder}/part={k}"
        fixture.as_log(own).select(*columns).write.format(form).save(part)
        for _ in range(files - len(spark.read.format(form).schema(empty.schema).load(part).inputFiles())):
            empty.write.format(form).mode("append").save(part)
    return files


@query(
    "late_dropped",
    # A batch drops what lies in windows that were closed by the lines before the batch before it.
    _cells(10).replace("\nreq AS (", "\nall_req AS (").rsplit(", cells AS (", 1)[0]
    + f""", arrived AS (SELECT *, {_ARRIVAL} AS batch, {_END} AS w_end FROM all_req), newest AS (SELECT batch, max(wall) AS wall FROM arrived GROUP BY batch),
    marks AS (SELECT b.batch, max(n.wall) FILTER (n.batch < b.batch - 1) - INTERVAL 30 MINUTE AS late, max(n.wall) - INTERVAL 30 MINUTE AS done FROM newest b, newest n GROUP BY b.batch),
    req AS (SELECT a.* FROM arrived a JOIN marks USING (batch) WHERE (late IS NULL OR w_end > late) AND w_end <= done), cells AS ("""
    + _cells(10).rsplit(", cells AS (", 1)[1]
    + "SELECT * FROM rolled",
)
def late_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream with a watermark of three ten-minute windows keeps of lines that arrive late, in the windows that it closed."""
    root = f"{shared_dir(spark)}/tidelog/late-{uuid.uuid4().hex}"
    files = _arrive(spark, sf_dir, f"{root}/lines", "text", ["value"])
    stream = spark.readStream.schema("value string, part int").option("maxFilesPerTrigger", files).text(f"{root}/lines").select("value")
    table = sinks.MetricTable(spark, f"{root}/metrics")
    streaming.start_metrics(stream, table, 1, 10, 3, f"{root}/checkpoint", available_now=True).awaitTermination()
    return table.read().select("metric_type", _shown("key_value").alias("key_value"), "time_window", "metric_value")


#: A line counts while fewer than three later windows of its key have arrived before it.
_SLOTTED = (
    _cells(10).replace("\nreq AS (", "\nall_req AS (").rsplit(", cells AS (", 1)[0]
    + f", req AS (SELECT *, ({_ARRIVAL}) * 1000000000000 + event_id AS place FROM all_req), cells AS ("
    + _cells(10).rsplit(", cells AS (", 1)[1].replace("AS v FROM req", "AS v, place FROM req").rsplit(", rolled AS", 1)[0]
    + """, firsts AS (SELECT metric_type, key_value, time_window, min(place) AS first FROM cells GROUP BY ALL),
    ends AS (SELECT a.metric_type, a.key_value, a.time_window, list_sort(list(b.first))[3] AS until FROM firsts a JOIN firsts b USING (metric_type, key_value) WHERE b.time_window > a.time_window GROUP BY ALL)
    SELECT metric_type, key_value, time_window, CAST(sum(v) AS BIGINT) AS metric_value FROM cells LEFT JOIN ends USING (metric_type, key_value, time_window) WHERE until IS NULL OR place < until GROUP BY ALL"""
)


@query("slot_windows", _SLOTTED)
def slot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three slots a key keep of lines that arrive late: windows that left their slots, and those that are live at the end."""
    root = f"{shared_dir(spark)}/tidelog/slots-{uuid.uuid4().hex}"
    table = sinks.MetricTable(spark, f"{root}/metrics")
    files = _arrive(spark, sf_dir, f"{root}/lines", "parquet", ["event_id", "value"])
    stream = spark.readStream.schema("event_id bigint, value string, part int").option("maxFilesPerTrigger", files).parquet(f"{root}/lines").drop("part")
    # A key is a class, a path or the like: a store a core is enough for them.
    slots.start_slots(parse.requests(stream), 10, 3, "event_id", table, 1, f"{root}/checkpoint", block=_BLOCK, parts=files).awaitTermination()
    slots.flush(spark, table, 1, f"{root}/checkpoint")
    return table.read().select("metric_type", _shown("key_value").alias("key_value"), "time_window", "metric_value")


@query("out_of_order", REQ + "SELECT count(*) FILTER (o) AS out_of_order FROM (SELECT coalesce(epoch(strptime(stamp, '%d/%b/%Y:%H:%M:%S %z')) < max(epoch(strptime(stamp, '%d/%b/%Y:%H:%M:%S %z'))) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS o FROM req)")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).select(F.lit("log").alias("file"), "event_id", "ts")
    return parse.flag_out_of_order(r, "file", "event_id").agg(F.count_if("is_out_of_order").alias("out_of_order"))


@query("stream_rollup", _cells(10) + "SELECT * FROM rolled")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    root = f"{shared_dir(spark)}/tidelog/stream-{uuid.uuid4().hex}"
    table = sinks.MetricTable(spark, f"{root}/metrics")
    streaming.start_bounded(fixture.as_log(stream), 10, table, 1, f"{root}/checkpoint").awaitTermination()
    return table.read().select("metric_type", _shown("key_value").alias("key_value"), "time_window", "metric_value")


_UPTIME, _MEMORY = ("sample_time", "up_duration_minutes", "users", "load_average1", "load_average5", "load_average15"), ("memory_use", "memory_free", "cache_use", "memory_available", "swap_use")


def _samples(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{fixture.host_samples('spark')[text]} AS value")


def _sampled(columns: tuple[str, ...]) -> str:
    made = fixture.host_samples("duckdb")
    return "SELECT event_id, " + ", ".join(f"{made[c]} AS {c}" for c in columns) + " FROM events"


@query("host_uptime", _sampled(_UPTIME))
def host_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hoststats.parse_uptime(_samples(spark, sf_dir, "uptime")).drop("value")


@query("host_memory", _sampled(_MEMORY))
def host_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hoststats.parse_memory(_samples(spark, sf_dir, "free")).drop("value")
