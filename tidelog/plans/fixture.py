"""An access log derived from the events table, as the same expressions for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# User agents of the test log with their classes (device, family, human, os, intent).
AGENTS = (
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_7_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) CriOS/137.0.7151.51 Mobile/15E148 Safari/604.1", "Mobile", "Chrome", "Unknown", "IOS", "Unknown"),
    ("Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko); compatible; GPTBot/1.1; +https://openai.com/gptbot", "Script", "AIBot", "NonHuman", "Other", "Processing"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/136.0.0.0 Safari/537.36", "Desktop", "Chrome", "Unknown", "MacOS", "Unknown"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.124 Safari/537.36 Edg/91.0.864.59", "Desktop", "Edge", "Unknown", "Windows", "Unknown"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.3.1 Safari/605.1.15", "Desktop", "Safari", "Unknown", "MacOS", "Unknown"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10.15; rv:138.0) Gecko/20100101 Firefox/138.0", "Desktop", "Firefox", "Unknown", "MacOS", "Unknown"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_7_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.4 Mobile/15E148 Safari/604.1", "Mobile", "Safari", "Unknown", "IOS", "Unknown"),
    ("Mozilla/5.0 (Linux; Android 15) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/136.0.7103.127 Mobile Safari/537.36", "Mobile", "Chrome", "Unknown", "Android", "Unknown"),
    ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "Script", "SearchBot", "NonHuman", "Other", "Processing"),
    ("Mozilla/5.0 (Linux; Android 6.0.1; Nexus 5X Build/MMB29P) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/W.X.Y.Z Mobile Safari/537.36 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "Script", "SearchBot", "NonHuman", "Other", "Processing"),
    ("Mozilla/5.0 (compatible; AhrefsBot/7.0; +http://ahrefs.com/robot/)", "Script", "SEOBot", "NonHuman", "Other", "Processing"),
    ("Mozilla/5.0 (Linux; Android 8.0; Pixel 2 Build/OPD3.170816.012) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/56.0.1511.1269 Mobile Safari/537.36; Bytespider", "Script", "SocialBot", "NonHuman", "Other", "Processing"),
    ("Mozilla/5.0 (Linux; Android 5.0) AppleWebKit/537.36 (KHTML, like Gecko) Mobile Safari/537.36 (compatible; Bytespider; spider-feedback@bytedance.com)", "Script", "SocialBot", "NonHuman", "Other", "Processing"),
    ("Dalvik/2.1.0 (Linux; U; Android 9.0; ZTE BA520 Build/MRA58K)", "Mobile", "Other", "Unknown", "Android", "Unknown"),
    ("facebookexternalhit/1.1 (+http://www.facebook.com/externalhit_uatext.php)", "Script", "SocialBot", "NonHuman", "Other", "Processing"),
    ("facebook/1.1", "Script", "OtherBot", "NonHuman", "Other", "Unknown"),
    ("meta-externalagent/1.1 (+https://developers.facebook.com/docs/sharing/webmasters/crawler)", "Script", "AIBot", "NonHuman", "Other", "Processing"),
    ("Mozilla/5.0 zgrab/0.x", "Script", "Scanner", "NonHuman", "Other", "Scanning"),
    (
        "Expanse, a Palo Alto Networks company, searches across the global IPv4 space multiple times per day to identify customers&#39; presences on the Internet. If you would like to be excluded from our scans, please send IP addresses/domains to: scaninfo@paloaltonetworks.com",
        "Script", "Scanner", "NonHuman", "Other", "Scanning",
    ),
    ("Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; Amazonbot/0.1; +https://developer.amazon.com/support/amazonbot) Chrome/119.0.6045.214 Safari/537.36", "Script", "AIBot", "NonHuman", "Other", "Processing"),
)

_STAMP = {"spark": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')", "duckdb": "strftime(ts, '%d/%b/%Y:%H:%M:%S')"}
_TEXT = {"spark": "STRING", "duckdb": "VARCHAR"}


def fields(dialect: str) -> dict[str, str]:
    text = _TEXT[dialect]
    agents = " ".join(f"WHEN {i} THEN '{a[0]}'" for i, a in enumerate(AGENTS))
    return {
        "event_id": "event_id",
        "ip": f"concat('10.', CAST(user_id % 4 AS {text}), '.0.', CAST(user_id % 256 AS {text}))",
        "stamp": f"concat({_STAMP[dialect]}, CASE event_id % 3 WHEN 0 THEN ' +0000' WHEN 1 THEN ' +0200' ELSE ' -0730' END)",
        "method": "CASE WHEN event_id % 10 < 7 THEN 'GET' WHEN event_id % 10 < 9 THEN 'POST' ELSE 'HEAD' END",
        "uri": "CASE event_id % 12 WHEN 0 THEN '/' WHEN 1 THEN '/robots.txt' WHEN 2 THEN '/a/b/c/d.html' WHEN 3 THEN '/a/b/' WHEN 4 THEN '/shop?id=1&utm_source=mail' WHEN 5 THEN '/x/../../etc/passwd'"
        " WHEN 6 THEN '/s?q=<script>1' WHEN 7 THEN concat('/s?q=', chr(39), '+update+t') WHEN 8 THEN '/p%20q/r' WHEN 9 THEN '/bad%zz/path?x=1' WHEN 10 THEN '/n%00ull' ELSE '/img/logo.png' END",
        "status": "CASE WHEN event_type = 'error' THEN '500' WHEN event_id % 13 = 0 THEN '404' WHEN event_id % 11 = 0 THEN '301' ELSE '200' END",
        "bytes": f"CAST(CAST(floor(value * 100) AS BIGINT) AS {text})",
        "referer": "CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN 'https://www.example.com:8443/p?x=1' WHEN 2 THEN 'http://news.example.org/a' WHEN 3 THEN 'example.net/nope' ELSE '' END",
        "ua": f"CASE event_id % 20 {agents} END",
    }


def line(fmt: str, dialect: str) -> str:
    """A line of the format over the columns of ``fields``; ``mixed`` takes turns, with junk and empty lines."""
    head = "concat(ip, ' {log} ', '{user}', ' [', stamp, '] \"', method, ' ', uri, ' HTTP/1.1\" ', status, ' ', bytes)"
    tail = "concat(' \"', referer, '\" \"', ua, '\"')"
    plain = head.format(log="-", user="-")
    named = head.format(log="ident", user="frank")
    forms = {
        "common": named,
        "combined": f"concat({named}, {tail})",
        "vhost": f"concat('shop', CAST(event_id % 3 AS {_TEXT[dialect]}), '.example.com:80 ', {named}, {tail})",
        "nginx": f"concat({plain}, {tail})",
        "nginx_custom": f"concat({plain}, {tail}, ' 0.123 0.456')",
    }
    forms["mixed"] = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {forms[f]}" for i, f in enumerate(("common", "combined", "vhost", "nginx", "nginx_custom"))) + " WHEN 5 THEN 'junk' ELSE '' END"
    return forms[fmt]


def spark_log(spark: SparkSession, sf_dir: str, fmt: str = "nginx") -> DataFrame:
    """(event_id, value) from the events table."""
    # The table is one row group: without this one core would do all that follows.
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet").repartition(spark.sparkContext.defaultParallelism), fmt)


def as_log(events: DataFrame, fmt: str = "nginx") -> DataFrame:
    made = events.selectExpr(*[f"{e} AS {c}" for c, e in fields("spark").items()])
    return made.selectExpr("event_id", f"{line(fmt, 'spark')} AS value")


def duckdb_fields() -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in fields("duckdb").items()) + " FROM events"


def host_samples(dialect: str) -> dict[str, str]:
    """What ``uptime`` and ``free`` might print, with the numbers in it, by event: as many samples as there are events."""
    text = _TEXT[dialect]
    word = lambda n: f"CAST({n} AS {text})"
    two = lambda n: f"lpad({word(n)}, 2, '0')"
    load = lambda n: f"concat({word(f'CAST(floor((event_id % {n}) / 100) AS BIGINT)')}, '.', {two('event_id % 100')})"
    days, hours, minutes, users = "event_id % 400", "event_id % 24", "event_id % 60", "1 + event_id % 12"
    short = f"concat({two(hours)}, ':', {two(minutes)})"
    clock = f"CASE WHEN event_id % 4 = 0 THEN {short} ELSE concat({short}, ':', {two('event_id % 50')}) END"
    loads = [load(n) for n in (1000, 700, 300)]
    up = f"CASE event_id % 4 WHEN 2 THEN concat({word(hours)}, ':', {two(minutes)}) WHEN 3 THEN concat({word(minutes)}, ' min') ELSE concat({word(days)}, ' days, ', {word(hours)}, ':', {two(minutes)}) END"
    end = f"CASE WHEN event_id % 4 = 0 THEN concat(' users, load averages: ', {loads[0]}, ' ', {loads[1]}, ' ', {loads[2]}) ELSE concat(' users,  load average: ', {loads[0]}, ', ', {loads[1]}, ', ', {loads[2]}) END"
    memory = {"memory_use": "event_id * 13", "memory_free": "event_id * 7 + 1", "cache_use": "event_id * 5 + 2", "memory_available": "event_id * 12 + 3", "swap_use": "event_id % 1000"}
    used, free, cache, rest, swap = (word(x) for x in memory.values())
    return {
        "event_id": "event_id",
        "uptime": f"concat({clock}, '  up ', {up}, ',  ', {word(users)}, {end})",
        "free": f"concat('       total  used  free  shared  buff/cache  available', chr(10), 'Mem:   9999999999  ', {used}, '     ', {free}, '  4044  ', {cache}, '  ', {rest}, chr(10), 'Swap:  2097148  ', {swap}, '  2096124')",
        "sample_time": clock,
        "up_duration_minutes": f"CAST(CASE WHEN event_id % 4 < 2 THEN ({days}) * 1440 ELSE 0 END + CASE WHEN event_id % 4 < 3 THEN ({hours}) * 60 ELSE 0 END + {minutes} AS INT)",
        "users": f"CAST({users} AS INT)",
        **{f"load_average{n}": x for n, x in zip((1, 5, 15), loads, strict=True)},
        **{k: f"CAST({x} AS BIGINT)" for k, x in memory.items()},
    }
