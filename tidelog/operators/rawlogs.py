"""Raw-log rows: relevance filter, masking and truncation; request and domain look-ups."""

from __future__ import annotations

import ipaddress
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidelog.operators.rollup import agent_field
from tidelog.plans.shared import shared_dir


#: Longest domain name.
MOST_NAME = 255


def is_relevant() -> Column:
    """Harmless requests of browsers and unknown agents that ended in 2xx or 5xx."""
    ended = F.col("status").startswith("2") | F.col("status").startswith("5")
    device, family = agent_field("device_type", "Unknown"), agent_field("family", "Other")
    return (F.col("malicious") == 0) & ended & (device != "Script") & ~family.isin("Scanner", "SEOBot", "Script")


@F.pandas_udf(BinaryType())
def packed_ip(ip: pd.Series) -> pd.Series:
    def pack(x):
        try:
            return ipaddress.ip_address(x).packed
        except ValueError:
            return None

    # An address is packed once a batch.
    codes, names = pd.factorize(ip)
    packed = [*map(pack, names), None]
    return pd.Series([packed[c] for c in codes], dtype=object)


def raw_rows(requests: DataFrame, masked: bool, domain: str | Column = "", keep: list[str] = ()) -> DataFrame:
    """The columns of the raw-log table. Masked rows have no address, and the end of the agent instead of its start."""
    agent = F.coalesce(F.col("user_agent.full_name"), F.lit(""))
    deepest = F.coalesce(F.nullif("path3", F.lit("")), F.nullif("path2", F.lit("")), F.col("path1"))
    return requests.select(
        *keep,
        request_domain(F.col("domain"), domain).alias("domain"),
        F.col("ts").alias("request_ts"),
        (F.lit(None).cast("string") if masked else F.col("client_ip")).alias("client_ip"),
        F.left("remote_user", F.lit(100)).alias("remote_user"),
        F.left("method", F.lit(20)).alias("http_method"),
        F.left(deepest, F.lit(100)).alias("path3"),
        F.left("path", F.lit(100)).alias("request_uri"),
        F.col("status").alias("http_status"),
        "bytes_sent",
        F.left("referer", F.lit(100)).alias("referer"),
        F.col("malicious").alias("is_malicious"),
        (F.right(agent, F.lit(100)) if masked else F.left(agent, F.lit(100))).alias("ua_string"),
        F.left(agent_field("os", "Other"), F.lit(20)).alias("ua_os"),
        F.left(agent_field("family", "Other"), F.lit(20)).alias("ua_family"),
        F.left(agent_field("device_type", "Unknown"), F.lit(20)).alias("ua_device_type"),
        F.left(agent_field("human", "Unknown"), F.lit(20)).alias("ua_is_human"),
        F.left(agent_field("intent", "Unknown"), F.lit(20)).alias("ua_intent"),
    )


def request_domain(domain: Column, configured: str | Column) -> Column:
    """The line's own domain where it has one, else the configured one."""
    return F.coalesce(F.nullif(domain, F.lit("")), F.lit(configured) if isinstance(configured, str) else configured)


def numbered(names: DataFrame, name_col: str, id_col: str, after: int, folder: str) -> tuple[DataFrame, int]:
    """``names`` (distinct) with the numbers from ``after`` + 1 on in order of name, and how many they are.

    Names are dealt by ranges and numbered within each; the driver gets the size of each range only. The numbers are fixed by writing them to ``folder``.
    """
    spark = names.sparkSession
    # The upper bits say which range a row is in, the lower 33 its place there.
    dealt = names.select(name_col).repartitionByRange(name_col).sortWithinPartitions(name_col).withColumn("_at", F.monotonically_increasing_id())
    dealt.write.parquet(folder)
    fixed = spark.read.schema(dealt.schema).parquet(folder)
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in fixed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    first = [after + sum(n for p, n in sizes.items() if p < k) for k in range(max(sizes, default=0) + 1)]
    base = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in first]), part + 1)
    return fixed.select((base + place + 1).cast("bigint").alias(id_col), name_col), sum(sizes.values())


def assign_ids(names: DataFrame, known: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """``known`` (id, name) with new names appended under the next ids, in order of name.

    Names are cut to ``MOST_NAME`` characters before they are looked up as well as before they are kept. Only names that are new are
    numbered; those are one row per domain, not per request.
    """
    fresh = names.select(F.left(name_col, F.lit(MOST_NAME)).alias(name_col)).distinct().join(known, name_col, "left_anti")
    top = known.agg(F.max(id_col)).first()[0] or 0
    more, _ = numbered(fresh, name_col, id_col, top, f"{shared_dir(names.sparkSession)}/tidelog/ids-{uuid.uuid4().hex}")
    return known.select(id_col, name_col).union(more)
