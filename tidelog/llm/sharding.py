"""Balanced label propagation: shards of near-equal bytes that keep linked documents together.

Documents with equal texts are linked. They start in shards by hash; singles wait, as they fit anywhere. In each round the
members of a group look at the bytes their neighbours hold in each shard and ask to move to the largest one that has
room. A shard grants the fraction of the bytes asked for that its quota allows: its room, and half of what asks to leave
it. Small group parts move whole, parts above a quarter of a quota are divided by document hash. A group that outgrows a
shard so fills one after the other. The order of groups and documents is a hash, so a round is two aggregations and two joins.

Then every shard keeps linked documents, in group order, up to an equal share of all bytes; what is over and the singles are laid
on a line by running bytes, and each goes to the shard whose remaining room covers its place: first the documents above the
mean size, then the others, which even out. So shards differ by about the size of a small document, and a group is cut only where it must be. Running sums and slots are taken within hash levels of about
PER_LEVEL rows and carried over by sums of level totals, a thousand to one from step to step, so no task sees a shard's or a
group's rows at once. Group sizes are written before rows meet them, so that Spark can split the rows of a hot text.

Only DataFrame functions are used. Null texts hold no bytes and are linked to empty ones; null and repeated doc_ids are
documents of their own. An empty table gives no rows. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import blocks_of, discard, read_table, written

SHARDS = 16
ROUNDS = 4
PER_LEVEL = 2000
#: Levels that a group may fill.
_PARTS = 1_000_000
_SPREAD = 1 << 30


def _unit(*columns: Column) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*columns, F.lit("unit")), F.lit(_SPREAD)) / F.lit(float(_SPREAD))


def _offsets(totals: DataFrame, keys: list[str], level: str, most: int) -> DataFrame:
    """(keys, level, _offset): the sum of _v over the levels before. ``most`` bounds the levels; a window sees a thousand of them."""
    if most < 1000:
        before = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, level, F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_offset"))
    upper = level + "_"
    totals = totals.withColumn(upper, F.floor(F.col(level) / 1000))
    above = _offsets(totals.groupBy(*keys, upper).agg(F.sum("_v").alias("_v")), keys, upper, most // 1000).withColumnRenamed("_offset", "_up")
    before = Window.partitionBy(*keys, upper).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.withColumn("_in", F.coalesce(F.sum("_v").over(before), F.lit(0)))
    return inner.join(above, [*keys, upper]).select(*keys, level, (F.col("_up") + F.col("_in")).alias("_offset"))


def running(df: DataFrame, keys: list[str], level: str, most: int, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, in the order of level (at most ``most``) and ``order``, within ``keys``."""
    totals = df.withColumn("_v", value).groupBy(*keys, level).agg(F.sum("_v").alias("_v"))
    here = Window.partitionBy(*keys, level).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_own", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return own.join(_offsets(totals, keys, level, most), [*keys, level]).withColumn(name, F.col("_offset") + F.col("_own")).drop("_offset", "_own")


def _by_shard(values: dict[int, float], shard: Column | str, shards: int) -> Column:
    """A value for each shard as an expression."""
    return F.element_at(F.array(*[F.lit(float(values.get(s, 0.0))) for s in range(shards)]), (F.col(shard) if isinstance(shard, str) else shard).cast("int") + 1)


def propagate(linked: DataFrame, capacity: float, shards: int, rounds: int) -> DataFrame:
    """Linked documents (gid, size, r, shard) after some rounds of moves towards their neighbours."""
    now = linked
    for _ in range(rounds):
        cells = now.groupBy("gid", "shard").agg(F.sum("size").alias("held"))
        loads = {r.shard: float(r.b) for r in now.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
        room = {s: capacity - loads.get(s, 0.0) for s in range(shards)}
        best = cells.where(_by_shard(room, "shard", shards) > 0).groupBy("gid").agg(F.max(F.struct("held", (-F.col("shard")).alias("s"))).alias("top"))
        asks = cells.join(best, "gid").select("gid", "shard", "held", (-F.col("top.s")).alias("dest"), F.col("top.held").alias("most"))
        asks = asks.where((F.col("dest") != F.col("shard")) & ((F.col("held") < F.col("most")) | ((F.col("held") == F.col("most")) & (F.col("shard") > F.col("dest")))))
        asks = written(asks.select("gid", "shard", "dest", "held"), "sharding-asks")
        inward = {r.dest: float(r.b) for r in asks.groupBy("dest").agg(F.sum("held").alias("b")).collect()}
        outward = {r.shard: float(r.b) for r in asks.groupBy("shard").agg(F.sum("held").alias("b")).collect()}
        if not inward:
            discard(asks)
            break
        quota = {s: max(0.0, room[s] + outward.get(s, 0.0) / 2) for s in range(shards)}
        grant = {s: min(1.0, quota[s] / inward[s]) for s in inward}
        chance = F.when(F.col("held") > _by_shard(quota, "dest", shards) / 4, _unit(F.col("r"))).otherwise(_unit(F.col("gid"), F.col("shard")))
        moves = now.join(asks, ["gid", "shard"], "left")
        after = written(moves.select("doc_id", "size", "text_crc32", "gid", "r", "members", F.when(F.col("dest").isNotNull() & (chance < _by_shard(grant, "dest", shards)), F.col("dest")).otherwise(F.col("shard")).alias("shard")), "sharding-linked")
        discard(asks)
        if now is not linked:
            discard(now)
        now = after
    return now


def fill(pool: DataFrame, most: int, loads: dict[int, float], share: float, shards: int) -> DataFrame:
    """``pool`` with a shard for each row: rows lie on a line by running bytes, shards have lengths like their room there."""
    held = float(pool.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    room = [max(0.0, share - loads.get(s, 0.0)) for s in range(shards)]
    scale = held / (sum(room) or 1.0)
    ends, at = [], 0.0
    for x in room[:-1]:
        at += x * scale
        ends.append(at)
    lined = running(pool, [], "level", most, ["gid", "r", "doc_id"], F.col("size"), "over")
    middle = F.col("over") + F.col("size") / 2
    return lined.withColumn("shard", F.aggregate(F.array(*[F.lit(float(e)) for e in ends]), F.lit(0), lambda acc, e: acc + F.when(middle >= e, 1).otherwise(0)))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, gid, shard, slot) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("gid"))
    rows = written(rows.withColumn("r", F.xxhash64("doc_id", "gid")), "sharding-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total / shards
    groups = written(rows.groupBy("gid").agg(F.count("*").alias("members")).where("members > 1"), "sharding-groups")
    every = written(rows.join(groups, "gid", "left").withColumn("shard", F.pmod("r", F.lit(shards)).cast("int")), "sharding-every")
    linked = propagate(every.where("members is not null"), share, shards, rounds)
    levels = blocks_of(n, PER_LEVEL)
    parts = F.ceil(F.col("members") / PER_LEVEL)
    linked = linked.withColumn("level", F.pmod(F.xxhash64("gid", F.lit("level")), F.lit(levels)) * _PARTS + F.pmod(F.shiftright("r", 7), F.least(parts, F.lit(_PARTS))))
    most = (levels + 1) * _PARTS
    linked = written(running(linked, ["shard"], "level", most, ["gid", "r", "doc_id"], F.col("size"), "over"), "sharding-order")
    stays = F.col("over") + F.col("size") <= F.lit(share)
    settled = linked.where(stays)
    loads = {r.shard: float(r.b) for r in settled.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    columns = ["doc_id", "size", "text_crc32", "gid", "r", "members"]
    moved = linked.where(~stays).withColumn("level", F.col("level") + levels).select(*columns, "level")
    singles = every.where("members is null").withColumn("level", F.pmod(F.shiftright("r", 7), F.lit(levels))).select(*columns, "level")
    pool = moved.union(singles)
    small = F.col("size") <= total / max(1, n)
    large = written(fill(pool.where(~small), most + levels, loads, share, shards).select(*columns, "shard"), "sharding-large")
    for r in large.groupBy("shard").agg(F.sum("size").alias("b")).collect():
        loads[r.shard] = loads.get(r.shard, 0.0) + float(r.b)
    rest = fill(pool.where(small), most + levels, loads, share, shards)
    placed = written(settled.select(*columns, "shard").union(large).union(rest.select(*columns, "shard")), "sharding-placed")
    placed = placed.withColumn("level", F.pmod(F.shiftright("r", 9), F.lit(levels)))
    return running(placed, ["shard"], "level", levels, ["r", "gid", "doc_id"], F.lit(1), "slot").select("doc_id", "size", "text_crc32", "gid", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("gid").alias("text_group"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
