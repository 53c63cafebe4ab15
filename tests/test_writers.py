"""Tables with several writers, repeated batches and many keys, as Parquet and in a database."""

import threading

import pytest
from pyspark.sql import functions as F

from tidelog.operators import database, rawlogs, sinks
from tidelog.operators.versions import Conflict, Versions

KEYED = "domain_id bigint, metric_type int, key_value string, time_window bigint, metric_value bigint"


def rows(spark, *values):
    return spark.createDataFrame([(1, 1, k, w, n) for k, w, n in values], KEYED)


def at_once(*jobs):
    """Runs the jobs in threads; what they raised."""
    failed = []

    def tried(job):
        try:
            job()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=tried, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return failed


def test_a_version_is_put_in_place_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    failed = at_once(*[lambda k=k: v.publish({"n": 1, "by": k}) for k in range(8)])
    assert len(failed) == 7 and all(isinstance(e, Conflict) for e in failed) and v.newest()["n"] == 1
    for n in range(2, 6):
        v.publish({"n": n})
    assert v.numbers() == [4, 5] and v.newest(5) == {"n": 4} and Versions(spark, str(tmp_path / "none")).newest() is None


def test_writers_of_one_table_lose_nothing(spark, tmp_path):
    """Days of their own, the same day with other keys, and the very same key."""

    def work(k):
        table = sinks.MetricTable(spark, str(tmp_path / "m"), per_bucket=2)
        for batch in range(3):
            new = rows(spark, (f"own{k}", 200001011200 + 10_000 * k, 1), (f"own{k}", 200002011200, 1), ("all", 200003011200, 1))
            assert table.upsert(new, False, f"q{k}", batch)
            assert not table.upsert(new, False, f"q{k}", batch)

    assert at_once(*[lambda k=k: work(k) for k in range(4)]) == []
    got = {(r.key_value, r.time_window // 10_000): r.metric_value for r in sinks.MetricTable(spark, str(tmp_path / "m")).read().collect()}
    assert got == {("all", 20000301): 12} | {(f"own{k}", 20000101 + k): 3 for k in range(4)} | {(f"own{k}", 20000201): 3 for k in range(4)}


def test_a_day_is_many_buckets_and_grows(spark, tmp_path):
    table = sinks.MetricTable(spark, str(tmp_path / "m"), per_bucket=100, keep_seconds=0)
    many = lambda n, m: spark.range(n, m).select(F.lit(1).cast("bigint").alias("domain_id"), F.lit(1).alias("metric_type"), F.col("id").cast("string").alias("key_value"), F.lit(200001011200).alias("time_window"), F.lit(1).cast("bigint").alias("metric_value"))
    table.upsert(many(0, 1000), True)
    day = table._head()["days"]["20000101"]
    assert day["buckets"] == 16 and sum(n for _, n in day["files"].values()) == 1000
    table.upsert(many(7, 8), False)
    after = table._head()["days"]["20000101"]
    assert sum(after["files"][b] != day["files"][b] for b in day["files"]) == 1
    table.upsert(many(1000, 5000), True)
    grown = table._head()["days"]["20000101"]
    assert grown["buckets"] == 64 and sum(n for _, n in grown["files"].values()) == 5000
    assert table.read().agg(F.sum("metric_value")).first()[0] == 5001
    table.upsert(rows(spark, ("x", None, 4)), True)
    assert table.read().where("time_window IS NULL").first().metric_value == 4


@pytest.fixture
def derby(spark, tmp_path):
    return database.JdbcTables(spark, f"jdbc:derby:{tmp_path}/db;create=true")


def read(spark, kept, name):
    df = spark.read.jdbc(kept.url, name)
    return df.toDF(*[c.lower() for c in df.columns])


def test_a_repeated_batch_changes_nothing_in_a_database(spark, derby):
    for batch in (0, 0, 1, 1, 0):
        derby.upsert(rows(spark, ("a'b", 200001011200, 5), ("c", 200001011200, 1)), False, "q", batch)
        derby.append("raw_logs", spark.createDataFrame([(1, "x")], "domain_id bigint, ua string"), "raw", batch)
    derby.upsert(rows(spark, ("c", 200001011200, 1)), False, "other" * 100, 0)
    assert {r.key_value: r.metric_value for r in read(spark, derby, "metrics").collect()} == {"a'b": 10, "c": 3}
    assert read(spark, derby, "raw_logs").count() == 2 and read(spark, derby, "metrics_incoming").count() == 0 and read(spark, derby, "raw_logs_incoming").count() == 0
    assert sorted(r.batch_id for r in read(spark, derby, "ledger").collect()) == [0, 1, 1]


def test_what_a_broken_attempt_left_is_not_merged(spark, derby, monkeypatch):
    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "upsert_statement", broken)
        with pytest.raises(RuntimeError):
            derby.upsert(rows(spark, ("a", 200001011200, 5)), False, "q", 0)
    assert read(spark, derby, "metrics_incoming").count() == 1 and read(spark, derby, "ledger").count() == 0
    derby.upsert(rows(spark, ("a", 200001011200, 5)), False, "q", 0)
    assert read(spark, derby, "metrics").first().metric_value == 5 and read(spark, derby, "metrics_incoming").count() == 0


def test_writers_of_one_database_keep_out_of_each_other(spark, derby):
    def work(k):
        for batch in range(2):
            derby.upsert(rows(spark, (f"k{k}", 200001011200, 1)), False, f"q{k}", batch)

    # A database may turn a writer away that waits for a row; the batch is then repeated, as a stream does.
    def stubborn(k):
        for left in reversed(range(5)):
            try:
                return work(k)
            except Exception:  # noqa: BLE001
                if not left:
                    raise

    assert at_once(*[lambda k=k: stubborn(k) for k in range(3)]) == []
    assert {r.key_value: r.metric_value for r in read(spark, derby, "metrics").collect()} == {f"k{k}": 2 for k in range(3)}


@pytest.mark.parametrize("jdbc", [False, True])
def test_domain_ids_are_dense_and_given_once(spark, tmp_path, jdbc):
    kept = database.JdbcTables(spark, f"jdbc:derby:{tmp_path}/d;create=true") if jdbc else database.ParquetTables(spark, str(tmp_path / "t"))
    first = database.with_domain_ids(spark.createDataFrame([("b",), ("a",), ("b",)], "domain string"), kept).collect()
    assert sorted((r.domain, r.domain_id) for r in first) == [("a", 1), ("b", 2), ("b", 2)]
    second = database.with_domain_ids(spark.createDataFrame([("c",), ("a",), ("x" * 300,)], "domain string"), kept).collect()
    assert sorted((r.domain, r.domain_id) for r in second) == [("a", 1), ("c", 3), ("x" * 255, 4)]
    # Another writer takes the next ids between the look and the step.
    real = kept.greatest_domain_id
    taken = []

    def slow():
        found = real()
        if not taken:
            taken.append(True)
            database.with_domain_ids(spark.createDataFrame([("e",), ("d",)], "domain string"), kept)
        return found

    kept.greatest_domain_id = slow
    third = database.with_domain_ids(spark.createDataFrame([("d",), ("f",)], "domain string"), kept).collect()
    assert sorted((r.domain, r.domain_id) for r in third) == [("d", 5), ("f", 7)]
    assert sorted(r.domain_id for r in kept.domains().collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_many_names_are_numbered_in_ranges(spark, tmp_path):
    names = spark.range(0, 200_000, numPartitions=8).select(F.concat(F.lit("d"), F.col("id")).alias("domain"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, n = rawlogs.numbered(names, "domain", "domain_id", 10, str(tmp_path / "n"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == 200_000 and len(found.inputFiles()) > 1
    assert found.agg(F.min("domain_id"), F.max("domain_id"), F.countDistinct("domain_id")).first()[:] == (11, 200_010, 200_000)
    wrong = found.alias("a").join(found.alias("b"), F.expr("b.domain_id = a.domain_id + 1")).where("b.domain <= a.domain")
    assert wrong.count() == 0


def test_a_table_from_before_buckets_is_read_and_goes_on(spark, tmp_path):
    table = sinks.MetricTable(spark, str(tmp_path / "m"))
    rows(spark, ("a", 200001011200, 5), ("b", 200001011200, 1)).write.parquet(str(tmp_path / "m" / "data" / "x" / "day=20000101"))
    table.versions.publish({"n": 1, "days": {"20000101": str(tmp_path / "m" / "data" / "x" / "day=20000101")}, "batches": {}, "gone": []})
    table.upsert(rows(spark, ("a", 200001011200, 2)), False)
    assert {r.key_value: r.metric_value for r in table.read().collect()} == {"a": 7, "b": 1}
