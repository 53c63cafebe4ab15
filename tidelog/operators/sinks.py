"""Sinks: JSON lines, metric tables with replacing or adding upserts, JDBC batches."""

from __future__ import annotations

import hashlib
import math
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.versions import Conflict, Versions

KEY = ("domain_id", "metric_type", "key_value", "time_window")
REQUEST_FIELDS = ("domain", "client_ip", "remote_logname", "remote_user", "ts", "method", "path", "path1", "path2", "path3", "protocol", "status", "bytes_sent", "referer", "user_agent", "malicious", "is_out_of_order")


def json_lines(requests: DataFrame, path1_to_end: tuple[str, ...] = REQUEST_FIELDS) -> DataFrame:
    """One JSON object per request, the timestamp with the line's own offset."""
    zone = F.concat(F.substring("tz_offset", 1, 3), F.lit(":"), F.substring("tz_offset", 4, 2))
    stamp = F.concat(F.date_format("ts_wall", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("tz_offset") == "+0000", "Z").otherwise(zone))
    fields = [stamp.alias("timestamp") if c == "ts" else F.col(c) for c in path1_to_end]
    return requests.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(requests: DataFrame, directory: str) -> None:
    if not directory:
        raise ValueError("a target directory is needed to write JSON lines")
    json_lines(requests).write.mode("append").text(directory)


def merge(current: DataFrame, fresh: DataFrame, replace: bool, key: tuple[str, ...] = KEY) -> DataFrame:
    """``current`` after an upsert of ``fresh``: new values replace old ones, or add to them."""
    new = fresh.groupBy(*key).agg(F.sum("metric_value").alias("_new"))
    both = current.select(*key, F.col("metric_value").alias("_old")).join(new, list(key), "full_outer")
    value = F.coalesce("_new", "_old") if replace else F.coalesce("_old", F.lit(0)) + F.coalesce("_new", F.lit(0))
    return both.select(*key, value.alias("metric_value"))


class MetricTable:
    """A metric table kept as Parquet by day, and within a day by buckets of keys; a head names each bucket's folder and the batches that are in.

    An upsert rewrites only the buckets that it touches, each in a task of its own. A day begins with as many buckets as its first rows need and gets twice as
    many or more when it holds over twice ``per_bucket`` rows a bucket. A batch that was merged before is skipped, so adding upserts survive the replay of
    a micro-batch.

    Any number of writers may work on a table. Each merges into the newest version and then puts the next one in place, which only one can. Whoever
    comes second keeps its work if the buckets that it touched are as they were, else it merges again. Folders that were replaced are deleted after
    ``keep_seconds``, so that running reads finish.
    """

    SCHEMA = "domain_id bigint, metric_type int, key_value string, time_window bigint, metric_value bigint"

    def __init__(self, spark: SparkSession, root: str, per_bucket: int = 1_000_000, keep_seconds: int = 600) -> None:
        self.spark, self.root, self.per_bucket, self.keep_seconds = spark, root.rstrip("/"), per_bucket, keep_seconds
        self.versions = Versions(spark, self.root)

    def _head(self) -> dict:
        head = self.versions.newest() or {"n": 0, "days": {}, "batches": {}, "gone": []}
        # Days of earlier tables are a folder each: one bucket, of a size that isn't known.
        days = {d: {"buckets": 1, "files": {"0": [x, 0]}} if isinstance(x, str) else x for d, x in head["days"].items()}
        return head | {"days": days, "gone": [[x, 0] if isinstance(x, str) else x for x in head["gone"]]}

    def _publish(self, head: dict) -> None:
        self.versions.publish(head)

    def _rows_of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)

    def read(self, days: list[str] | None = None) -> DataFrame:
        """The table, or some of its days."""
        head = self._head()
        return self._rows_of([folder for d, day in head["days"].items() if days is None or d in days for folder, _ in day["files"].values()])

    def upsert(self, fresh: DataFrame, replace: bool, query: str = "", batch_id: int | None = None) -> bool:
        """Merge rows; false if the batch of the query is in already."""
        if batch_id is not None and self._head()["batches"].get(query, -1) >= batch_id:
            return False
        # Written first, so that the batch is computed once however often it is merged.
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        fresh.select(*KEY, "metric_value").write.parquet(staged)
        new = self.spark.read.schema(self.SCHEMA).parquet(staged)
        try:
            sizes = {str(r.day): r.n for r in new.groupBy(_day().alias("day")).agg(F.count("*").alias("n")).collect()}
            for attempt in range(100):
                head = self._head()
                if batch_id is not None and head["batches"].get(query, -1) >= batch_id:
                    return False
                data = f"{self.root}/data/{uuid.uuid4().hex}"
                try:
                    if self._put(head, self._merged(head, new, sizes, replace, data), query, batch_id):
                        return True
                except Exception:
                    # Folders of an old version may be gone by now; nothing else may change under a merge.
                    if self._head()["n"] == head["n"]:
                        raise
                self.versions.delete(data)
                time.sleep(random.uniform(0, 0.05 * min(20, attempt + 1)))
            raise Conflict(f"{self.root}: other writers were first a hundred times")
        finally:
            self.versions.delete(staged)

    def _merged(self, head: dict, new: DataFrame, sizes: dict[str, int], replace: bool, data: str) -> dict[str, dict]:
        """Writes what ``new`` changes; the touched days, with only those buckets that were written."""
        if not sizes:
            return {}
        buckets, whole = {}, set()
        for day, n in sizes.items():
            known = head["days"].get(day)
            rows = n + (sum(x for _, x in known["files"].values()) if known else 0)
            buckets[day] = known["buckets"] if known else _power(rows / self.per_bucket)
            if known and rows > 2 * self.per_bucket * known["buckets"]:
                buckets[day] = _power(rows / self.per_bucket)
                whole.add(day)
        # Values of a map in the plan: one number a day of the batch.
        counts = F.create_map(*[F.lit(x) for d, b in buckets.items() for x in (int(d), b)])
        place = [_day().alias("day"), F.pmod(F.xxhash64("domain_id", "metric_type", "key_value"), F.element_at(counts, _day())).alias("bucket")]
        touched = new.select(*place).distinct().groupBy("day").agg(F.collect_set("bucket").alias("buckets")).collect()
        old = [head["days"][str(r.day)]["files"] for r in touched if str(r.day) in head["days"] and str(r.day) in whole]
        folders = [folder for files in old for folder, _ in files.values()]
        for r in touched:
            if str(r.day) in head["days"] and str(r.day) not in whole:
                files = head["days"][str(r.day)]["files"]
                folders += [files[str(b)][0] for b in r.buckets if str(b) in files]
        merged = merge(self._rows_of(folders), new, replace) if folders else new.groupBy(*KEY).agg(F.sum("metric_value").cast("bigint").alias("metric_value"))
        tasks = sum(buckets[str(r.day)] if str(r.day) in whole else len(r.buckets) for r in touched)
        merged.select("*", *place).repartition(tasks, "day", "bucket").write.partitionBy("day", "bucket").parquet(data)
        made: dict[str, dict] = {}
        for r in self.spark.read.schema(self.SCHEMA + ", day bigint, bucket bigint").parquet(data).groupBy("day", "bucket").agg(F.count("*").alias("n")).collect():
            day = made.setdefault(str(r.day), {"buckets": buckets[str(r.day)], "whole": str(r.day) in whole, "files": {}})
            day["files"][str(r.bucket)] = [f"{data}/day={r.day}/bucket={r.bucket}", r.n]
        return made

    def _put(self, read: dict, made: dict[str, dict], query: str, batch_id: int | None) -> bool:
        """The next version, from the newest one; false if others have changed what was merged."""
        while True:
            head = self._head()
            if batch_id is not None and head["batches"].get(query, -1) >= batch_id:
                return False
            for d, day in made.items():
                was, now = read["days"].get(d), head["days"].get(d)
                if (was is None) != (now is None) or was and (was["buckets"] != now["buckets"] or day["whole"] and was != now or any(was["files"].get(b) != now["files"].get(b) for b in day["files"])):
                    return False
            days, gone, now = dict(head["days"]), [], time.time()
            for d, day in made.items():
                before = head["days"].get(d, {"files": {}})["files"]
                kept = {} if day["whole"] else {b: f for b, f in before.items() if b not in day["files"]}
                gone += [[folder, now] for b, (folder, _) in before.items() if b not in kept]
                days[d] = {"buckets": day["buckets"], "files": kept | day["files"]}
            old = [folder for folder, at in head["gone"] if at < now - self.keep_seconds]
            batches = head["batches"] | ({query: batch_id} if batch_id is not None else {})
            try:
                self._publish({"n": head["n"] + 1, "days": days, "batches": batches, "gone": [x for x in head["gone"] if x[0] not in old] + gone})
            except Conflict:
                continue
            self.versions.delete(*old)
            return True


def _day() -> Column:
    return F.floor(F.coalesce("time_window", F.lit(0)) / 10_000).cast("bigint")


def _power(x: float) -> int:
    """The smallest power of two that is no smaller."""
    return 1 << max(0, math.ceil(x) - 1).bit_length()


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str], batch: int = 5000, writers: int = 8) -> None:
    """Appends in batches over a bounded number of connections."""
    rows.coalesce(writers).write.jdbc(url, table, mode="append", properties={"batchsize": str(batch), "rewriteBatchedStatements": "true", **properties})


def upsert_statement(url: str, table: str, staged: str, replace: bool, attempt: str | None = None) -> str:
    """The statement that merges staged metric rows (those of one attempt, where given) into the table, in the database's own words."""
    keys, columns = ", ".join(KEY), ", ".join((*KEY, "metric_value"))
    chosen = f"SELECT {columns} FROM {staged}" + (f" WHERE attempt = '{attempt}'" if attempt else "")
    if url.startswith(("jdbc:mysql:", "jdbc:mariadb:")):
        value = "VALUES(metric_value)" if replace else "metric_value + VALUES(metric_value)"
        return f"INSERT INTO {table} ({columns}) {chosen} ON DUPLICATE KEY UPDATE metric_value = {value}"
    if url.startswith(("jdbc:postgresql:", "jdbc:sqlite:")):
        value = "excluded.metric_value" if replace else f"{table}.metric_value + excluded.metric_value"
        return f"INSERT INTO {table} ({columns}) {chosen}{'' if attempt else ' WHERE true'} ON CONFLICT ({keys}) DO UPDATE SET metric_value = {value}"
    on = " AND ".join(f"t.{k} = s.{k}" for k in KEY)
    value = "s.metric_value" if replace else "t.metric_value + s.metric_value"
    mine, own = (f" AND s.attempt = '{attempt}'", f" AND s.attempt = '{attempt}'") if attempt else ("", "")
    return f"MERGE INTO {table} t USING {staged} s ON {on}{mine} WHEN MATCHED{own} THEN UPDATE SET metric_value = {value} WHEN NOT MATCHED{own} THEN INSERT ({columns}) VALUES ({', '.join(f's.{c}' for c in (*KEY, 'metric_value'))})"


def _connection(spark: SparkSession, url: str, properties: dict[str, str]):
    jvm = spark._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    if "driver" in properties:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    return jvm.java.sql.DriverManager.getConnection(url, given)


class Transaction:
    """One transaction of a database: committed if nothing failed, else undone."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str]) -> None:
        self.given = (spark, url, properties)

    def __enter__(self) -> Transaction:
        self.connection = _connection(*self.given)
        self.connection.setAutoCommit(False)
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                self.connection.commit()
            else:
                self.connection.rollback()
        finally:
            self.connection.close()

    def _prepared(self, text: str, values: tuple):
        statement = self.connection.prepareStatement(text)
        for k, v in enumerate(values, 1):
            if isinstance(v, int):
                statement.setLong(k, v)
            else:
                statement.setString(k, v)
        return statement

    def run(self, text: str, *values: str | int) -> int:
        """Rows that the statement changed."""
        statement = self._prepared(text, values)
        try:
            return statement.executeUpdate()
        finally:
            statement.close()

    def number(self, text: str, *values: str | int) -> int | None:
        """The one number that a query gives, if it gives one."""
        statement = self._prepared(text, values)
        try:
            found = statement.executeQuery()
            return found.getLong(1) if found.next() else None
        finally:
            statement.close()

    def columns(self, table: str) -> dict[str, str]:
        """The names of a table's columns as they are written in statements, by their lower-case names."""
        data, out = self.connection.getMetaData(), {}
        quote = data.getIdentifierQuoteString().strip()
        for name in (table, table.upper()):
            found = data.getColumns(None, None, name, None)
            while found.next():
                c = found.getString("COLUMN_NAME")
                out.setdefault(c.lower(), f"{quote}{c}{quote}")
        return out

    def claim(self, query: str, batch_id: int) -> bool:
        """Notes in the ledger that a batch is in, in this transaction; false if it was before. The ledger's row is locked until the end."""
        if self.run("UPDATE ledger SET batch_id = ? WHERE query_id = ? AND batch_id < ?", batch_id, query, batch_id):
            return True
        if self.number("SELECT batch_id FROM ledger WHERE query_id = ?", query) is not None:
            return False
        self.run("INSERT INTO ledger (query_id, batch_id) VALUES (?, ?)", query, batch_id)
        return True


def execute(spark: SparkSession, url: str, properties: dict[str, str], statements: list[str]) -> None:
    """Runs the statements in one transaction."""
    with Transaction(spark, url, properties) as t:
        for text in statements:
            t.run(text)


def has_table(spark: SparkSession, url: str, properties: dict[str, str], name: str) -> bool:
    connection = _connection(spark, url, properties)
    try:
        return any(connection.getMetaData().getTables(None, None, n, None).next() for n in (name, name.upper()))
    finally:
        connection.close()


def ledger_name(query: str) -> str:
    """A query's name in the ledger: long ones by their hash."""
    return query if len(query) <= 200 else hashlib.sha256(query.encode()).hexdigest()


def staged_once(rows: DataFrame, url: str, staged: str, properties: dict[str, str], query: str, batch_id: int | None, move: Callable[[Transaction, str], None]) -> bool:
    """Rows to a database exactly once a batch: appended to a staging table under the name of this attempt over a bounded number of connections,
    then moved from there by the database in one transaction with the ledger's entry. False if the batch was in before.

    Attempts don't touch each other's rows until one is in; that one removes what other attempts of its query have left.
    """
    spark, name = rows.sparkSession, ledger_name(query)
    if batch_id is not None:
        with Transaction(spark, url, properties) as t:
            at = t.number("SELECT batch_id FROM ledger WHERE query_id = ?", name)
        if at is not None and at >= batch_id:
            return False
    mine = hashlib.sha256(name.encode()).hexdigest()[:16]
    attempt = f"{mine}-{uuid.uuid4().hex[:16]}"
    write_jdbc(rows.withColumn("attempt", F.lit(attempt)), url, staged, properties)
    with Transaction(spark, url, properties) as t:
        column = t.columns(staged)["attempt"]
        done = batch_id is None or t.claim(name, batch_id)
        if done:
            move(t, attempt)
        if batch_id is None:
            t.run(f"DELETE FROM {staged} WHERE {column} = ?", attempt)
        else:
            t.run(f"DELETE FROM {staged} WHERE {column} LIKE ?", f"{mine}-%")
    return done


def upsert_jdbc(rows: DataFrame, url: str, table: str, staged: str, properties: dict[str, str], replace: bool, query: str = "", batch_id: int | None = None) -> bool:
    """Metric rows into a database table with a key over ``KEY``, exactly once a batch (see ``staged_once``)."""
    summed = rows.groupBy(*KEY).agg(F.sum("metric_value").alias("metric_value"))
    return staged_once(summed, url, staged, properties, query, batch_id, lambda t, attempt: t.run(upsert_statement(url, table, staged, replace, attempt)))


def append_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str], query: str = "", batch_id: int | None = None) -> bool:
    """Rows appended to a database table, exactly once a batch; the table and its staging table are made if they are missing."""
    staged = f"{table}_incoming"
    for name, like, kinds in ((table, rows, {}), (staged, rows.withColumn("attempt", F.lit("")), {"createTableColumnTypes": "attempt VARCHAR(64)"})):
        if not has_table(rows.sparkSession, url, properties, name):
            write_jdbc(like.limit(0), url, name, properties | kinds)

    def move(t: Transaction, attempt: str) -> None:
        to, of = t.columns(table), t.columns(staged)
        t.run(f"INSERT INTO {table} ({', '.join(to[c.lower()] for c in rows.columns)}) SELECT {', '.join(of[c.lower()] for c in rows.columns)} FROM {staged} WHERE {of['attempt']} = ?", attempt)

    return staged_once(rows, url, staged, properties, query, batch_id, move)


def live_json(rolled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, metric_type, key_value, value): {"Values": {window: n}} of each key; for console dumps of live cells."""
    keys = rolled.groupBy(*by, "metric_type", "key_value").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("time_window").cast("string"), "metric_value")))).alias("w"))
    return keys.select(*by, "metric_type", "key_value", F.to_json(F.struct(F.col("w").alias("Values"))).alias("value"))
