"""Where a run's rows are kept: a JDBC database, or Parquet tables in the shared folder where none is named."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import parse, rawlogs, rollup, sinks
from tidelog.operators.versions import Conflict, Versions
from tidelog.plans.config import FileConfig
from tidelog.plans.shared import shared_dir

#: Longest key of a metric row in a database.
MOST_KEY = 255
_TABLES = {
    "metrics": "domain_id BIGINT NOT NULL, metric_type INT NOT NULL, key_value VARCHAR(255) NOT NULL, time_window BIGINT NOT NULL, metric_value BIGINT, PRIMARY KEY (domain_id, metric_type, key_value, time_window)",
    "metrics_incoming": "domain_id BIGINT NOT NULL, metric_type INT NOT NULL, key_value VARCHAR(255) NOT NULL, time_window BIGINT NOT NULL, metric_value BIGINT, attempt VARCHAR(64) NOT NULL",
    "domains": "domain_id BIGINT NOT NULL PRIMARY KEY, domain VARCHAR(255) NOT NULL",
    "domains_incoming": "domain_id BIGINT NOT NULL, domain VARCHAR(255) NOT NULL, attempt VARCHAR(64) NOT NULL",
    "ledger": "query_id VARCHAR(255) NOT NULL PRIMARY KEY, batch_id BIGINT NOT NULL",
}
#: The ledger's line that holds the greatest domain id.
_DOMAIN_IDS = "#domain-ids"
#: Domains of a batch up to which they are sent to all executors; more meet the rows by a shuffle.
BROADCAST_DOMAINS = 100_000


def jdbc_url(c: FileConfig) -> str:
    return c.db_address if c.db_address.startswith("jdbc:") else f"jdbc:mysql://{c.db_address}/{c.db_name}"


class ParquetTables:
    """Tables as Parquet under a folder. What a batch of a query appended is a folder of its own, which a replay writes anew."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.metrics = sinks.MetricTable(spark, f"{root}/metrics")
        self.known = Versions(spark, f"{root}/domain-versions")

    def domains(self) -> DataFrame:
        schema, head = "domain_id bigint, domain string", self.known.newest()
        return self.spark.read.schema(schema).parquet(*head["folders"]) if head else self.spark.createDataFrame([], schema)

    def greatest_domain_id(self) -> int:
        head = self.known.newest()
        return head["top"] if head else 0

    def add_domains(self, fresh: DataFrame, after: int, top: int) -> bool:
        """Rows with the ids from ``after`` + 1 to ``top``; false if another writer took them."""
        head = self.known.newest() or {"n": 0, "folders": [], "top": 0}
        if head["top"] != after:
            return False
        folder = f"{self.root}/domains/version={head['n'] + 1}-{uuid.uuid4().hex}"
        fresh.select("domain_id", "domain").write.parquet(folder)
        try:
            self.known.publish({"n": head["n"] + 1, "folders": [*head["folders"], folder], "top": top})
        except Conflict:
            self.known.delete(folder)
            return False
        return True

    def append(self, name: str, rows: DataFrame, query: str = "", batch_id: int | None = None) -> None:
        run = hashlib.sha256(query.encode()).hexdigest()[:16] if batch_id is not None else uuid.uuid4().hex
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}/batch={batch_id or 0}")

    def upsert(self, rows: DataFrame, replace: bool, query: str = "", batch_id: int | None = None) -> None:
        self.metrics.upsert(rows, replace, query, batch_id)


class JdbcTables:
    """Tables of a database, made where they are missing. A ledger in it says which batches of which queries are in."""

    def __init__(self, spark: SparkSession, url: str, user: str = "", password: str = "") -> None:
        self.spark, self.url = spark, url
        self.properties = {k: v for k, v in (("user", user), ("password", password)) if v}
        for name, columns in _TABLES.items():
            if not sinks.has_table(spark, url, self.properties, name):
                sinks.execute(spark, url, self.properties, [f"CREATE TABLE {name} ({columns})"])

    def domains(self) -> DataFrame:
        found = self.spark.read.jdbc(self.url, "domains", properties=self.properties)
        return found.toDF(*[c.lower() for c in found.columns]).select("domain_id", "domain")

    def greatest_domain_id(self) -> int:
        with sinks.Transaction(self.spark, self.url, self.properties) as t:
            noted = t.number("SELECT batch_id FROM ledger WHERE query_id = ?", _DOMAIN_IDS)
            # Tables from before the ledger have domains that it does not know of.
            return noted if noted is not None else t.number("SELECT COALESCE(MAX(domain_id), 0) FROM domains") or 0

    def add_domains(self, fresh: DataFrame, after: int, top: int) -> bool:
        """Rows with the ids from ``after`` + 1 to ``top``; false if another writer took them."""
        taken: list[bool] = []

        def move(t: sinks.Transaction, attempt: str) -> None:
            if t.number("SELECT batch_id FROM ledger WHERE query_id = ?", _DOMAIN_IDS) is None:
                t.run("INSERT INTO ledger (query_id, batch_id) VALUES (?, ?)", _DOMAIN_IDS, after)
            if t.run("UPDATE ledger SET batch_id = ? WHERE query_id = ? AND batch_id = ?", top, _DOMAIN_IDS, after):
                t.run("INSERT INTO domains (domain_id, domain) SELECT domain_id, domain FROM domains_incoming WHERE attempt = ?", attempt)
                taken.append(True)

        sinks.staged_once(fresh.select("domain_id", "domain"), self.url, "domains_incoming", self.properties, "", None, move)
        return bool(taken)

    def append(self, name: str, rows: DataFrame, query: str = "", batch_id: int | None = None) -> None:
        sinks.append_jdbc(rows, self.url, name, self.properties, query, batch_id)

    def upsert(self, rows: DataFrame, replace: bool, query: str = "", batch_id: int | None = None) -> None:
        cut = rows.withColumn("key_value", F.left("key_value", F.lit(MOST_KEY)))
        sinks.upsert_jdbc(cut, self.url, "metrics", "metrics_incoming", self.properties, replace, query, batch_id)


Tables = ParquetTables | JdbcTables


def tables(spark: SparkSession, c: FileConfig, root: str) -> Tables:
    return JdbcTables(spark, jdbc_url(c), c.db_user, c.db_password) if c.db_address else ParquetTables(spark, root)


def with_domain_ids(rows: DataFrame, kept: Tables) -> DataFrame:
    """``rows`` with domain_id for their domain; new domains get the next ids, in order of name, unless another writer was first with them.

    Names stay on the executors: those that are new are numbered in ranges and written from there.
    """
    spark = rows.sparkSession
    named = rows.withColumn("domain", F.left("domain", F.lit(rawlogs.MOST_NAME)))
    root = f"{shared_dir(spark)}/tidelog/domains-{uuid.uuid4().hex}"
    named.select("domain").where("domain IS NOT NULL").distinct().write.parquet(f"{root}/names")
    names = spark.read.parquet(f"{root}/names")
    for attempt in range(100):
        after = kept.greatest_domain_id()
        fresh, n = rawlogs.numbered(names.join(kept.domains(), "domain", "left_anti"), "domain", "domain_id", after, f"{root}/{attempt}")
        if not n or kept.add_domains(fresh, after, after + n):
            break
    else:
        raise Conflict("other writers took the next domain ids a hundred times")
    wanted = kept.domains().join(names, "domain", "left_semi")
    return named.join(F.broadcast(wanted) if names.count() <= BROADCAST_DOMAINS else wanted, "domain")


def domain_id(spark: SparkSession, name: str, kept: Tables) -> int:
    """The id of one name."""
    return with_domain_ids(spark.createDataFrame([(name,)], "domain string"), kept).first().domain_id


def own(requests: DataFrame, c: FileConfig, name: str) -> Column:
    """A setting: the one that stands beside each row, or that of ``c`` where none does."""
    return F.col(name) if name in requests.columns else F.lit(getattr(c, name))


def save_metrics(requests: DataFrame, c: FileConfig, kept: Tables, query: str = "", batch_id: int | None = None) -> None:
    """Metric rows by domain, if the configuration wants them kept."""
    if not c.write_metrics_to_db:
        return
    named = requests.withColumn("domain", rawlogs.request_domain(F.col("domain"), own(requests, c, "domain_name")))
    rows = with_domain_ids(rollup.rollup(named, own(requests, c, "time_window_minutes"), ["domain"]), kept)
    kept.upsert(rows.select(*sinks.KEY, "metric_value"), c.replace_existing, query, batch_id)


def save_raw_logs(requests: DataFrame, c: FileConfig, kept: Tables, query: str = "", batch_id: int | None = None) -> None:
    """Raw-log rows, if the configuration wants them kept: only relevant ones and masked ones where it says so. A batch that is replayed is kept once."""
    if not c.save_raw_logs:
        return
    chosen = parse.only(requests, rawlogs.is_relevant()) if c.only_relevant > 0 else requests
    chosen = chosen.withColumn("_host_id", own(chosen, c, "host_id"))
    rows = with_domain_ids(rawlogs.raw_rows(chosen, c.mask_ip, own(chosen, c, "domain_name"), ["_host_id"]), kept)
    kept.append("raw_logs", rows.drop("domain").withColumnRenamed("_host_id", "host_id").withColumn("client_ip", rawlogs.packed_ip("client_ip")), query, batch_id)
