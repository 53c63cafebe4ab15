"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code point order (null last) weigh 1, 2, 3, repeating. Targets share the corpus's words by weight, stop at
``most`` times the source's size, and the excess is shared again by weight: with sources in order of size by weight, a
running share decides which stop. Each document's expected copies are target / source size; the whole part is taken and the
fraction is a probability. Two fractional documents exchange words, in a random direction that keeps both expectations
and the sum of words, until one of them is integral. A source's documents are dealt by hash to groups of about PER_GROUP; each
group goes from its largest documents to its smallest, so that the one that stays fractional is a small one. These residuals meet in a
tree of FAN_IN groups a step, until a source has one. That one is rounded, and where it is so large that no smaller ones could settle
it, what it misses is made up by turning over documents of its last group, each time the one that fits best. So a source's words end near
its target, and reruns agree however the rows are partitioned, since group, order and chance come from hashes of the rows.

Rows equal in id, source and text are one unit: they get the same copies and weigh together. Null text has size 0, null
sources form a source of their own, null ids are allowed. Ties of size go by hash. Texts are counted whole, however long. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import fresh, keyed_runs, read_table, written

FAN_IN = 64
PER_GROUP = 1024
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def exchange(p: float, a: float, q: float, b: float, chance: float) -> tuple[float, float]:
    """Probabilities after the exchange of words between documents of a and b words; one of them is 0 or 1."""
    up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
    if chance * (up + down) < down:
        return (1.0, q - up / b) if up == a * (1 - p) else (p + up / a, 0.0)
    return (0.0, q + down / b) if down == a * p else (p - down / a, 1.0)


def _integral(p: float) -> bool:
    return p <= 1e-12 or p >= 1 - 1e-12


def settle(rows: Iterator[tuple[str, float, float]], seed: int) -> Iterator[tuple[str, float]]:
    """(mark, probability) of each (mark, words, probability) after pairwise exchanges; one at most is left fractional."""
    held = None
    for mark, words, p in rows:
        if _integral(p) or not words:
            yield mark, float(p >= 0.5)
            continue
        if held is None:
            held = (mark, words, p)
            continue
        chance = xxhash.xxh64_intdigest(mark, seed) / 2**64
        p1, p2 = exchange(held[2], held[1], p, words, chance)
        first, second = (held[0], held[1], p1), (mark, words, p2)
        done, held = (first, second) if _integral(p1) else (second, first)
        yield done[0], float(done[2] >= 0.5)
        if _integral(held[2]):
            yield held[0], float(held[2] >= 0.5)
            held = None
    if held is not None:
        yield held[0], held[2]


def even_out(units: list[tuple[str, float, float]], error: float) -> tuple[float, dict[str, float]]:
    """What is left of ``error`` words too many or too few after turning over integral (mark, words, probability) units, and those."""
    now = {m: (w, p) for m, w, p in sorted(units)}
    out: dict[str, float] = {}
    while now:
        mark = min(now, key=lambda m: abs(error + now[m][0] * (1 - 2 * now[m][1])))
        words, p = now[mark]
        if abs(error + words * (1 - 2 * p)) >= abs(error):
            break
        error += words * (1 - 2 * p)
        out[mark] = 1.0 - p
        now[mark] = (words, 1.0 - p)
    return error, out


def reduce_group(rows: list[tuple[str, float, float]], seed: int, last: bool) -> dict[str, float]:
    """New probabilities of a group's (mark, words, probability) units: one at most stays fractional, none in the last step."""
    words = {m: w for m, w, _ in rows}
    out = {m: float(p >= 0.5) for m, w, p in rows if not w or _integral(p)}
    fractional = [x for x in rows if x[0] not in out]
    out |= dict(settle(iter(sorted(fractional, key=lambda x: (-x[1], x[0]))), seed))
    left = [m for m, _, _ in fractional if not _integral(out[m])]
    if last and left:
        (m,) = left
        others = [(x, words[x], out[x]) for x, _, _ in fractional if x != m]
        tries = [(p, *even_out(others, words[m] * (p - out[m]))) for p in sorted((0.0, 1.0), key=lambda p: abs(p - out[m]))]
        p, _, turned = min(tries, key=lambda x: abs(x[1]))
        out |= turned | {m: p}
    return out


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with target. One row a source: the windows here see no documents."""
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", ((F.row_number().over(alone) - 1) % 3 + 1).cast("double"))
    stop = F.lit(float(most)) * F.col("source_size")
    every = Window.partitionBy()
    order = Window.orderBy((stop / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"stop": stop, "total": F.sum("source_size").over(every).cast("double"), "weights": F.sum("weight").over(every), "stopped": F.coalesce(F.sum(stop).over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    s = s.withColumn("share", (F.col("total") - F.col("stopped")) / (F.col("weights") - F.col("gone")))
    s = s.withColumn("stops", F.col("share") * F.col("weight") > F.col("stop"))
    s = s.withColumn("final", F.min(F.when(~F.col("stops"), F.struct(F.col("stopped"), F.col("share")))).over(every)["share"])
    return s.select("source", "source_size", F.when(F.col("stops"), F.col("stop")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def marked(docs: DataFrame, id_col: str, source_col: str, text_col: str, name: str = "mix_mark") -> DataFrame:
    """``docs`` with a digest of id, source and text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, source_col, text_col)]
    return docs.withColumn(name, F.md5(F.concat_ws("\x01", *parts)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, copies): (mix_mark, id, source, size) of each row, and (mix_mark, source, source_size, target, copies) of each unit."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")
    own = fresh(docs, "mix_mark")
    rows = written(marked(docs, id_col, source_col, text_col, own).select(F.col(own).alias("mix_mark"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "mixing-rows")
    units = rows.groupBy("mix_mark", "source").agg((F.sum("size")).alias("words"))
    sizes = units.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("units"))
    targets = with_targets(sizes.select("source", "source_size")).withColumnsRenamed({"source": "s", "source_size": "words"})
    sources = sizes.join(targets, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", F.ceil(F.col("units") / PER_GROUP).alias("groups"))
    sources = written(sources, "mixing-sources")
    groups = sources.agg(F.coalesce(F.max("groups"), F.lit(1))).first()[0]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    s = sources.withColumnRenamed("source", "s")
    start = units.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumns({"whole": F.floor(rate + 1e-12).cast("int"), "p": F.greatest(rate - F.floor(rate + 1e-12), F.lit(0.0)), "bucket": F.pmod(F.xxhash64("mix_mark", F.lit(seed)), F.col("groups"))})
    columns = ["mix_mark", "source", "source_size", "target", "groups", "whole", "words", "p", "bucket", "decided"]
    now = start.withColumn("decided", F.lit(False)).select(columns)
    done: list[DataFrame] = []
    while not done or groups > FAN_IN ** (len(done) - 1):
        level = len(done)

        def step(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for _, rows in keyed_runs(batches, "deal"):
                last = rows.column("groups")[0].as_py() <= FAN_IN**level
                rows = rows.drop_columns(["deal"])
                marks = rows.column("mix_mark").to_pylist()
                if len(set(marks)) != len(marks):
                    raise ValueError("a unit came twice")
                found = reduce_group(list(zip(marks, rows.column("words").to_pylist(), rows.column("p").to_pylist(), strict=True)), seed + 1 + level, last)
                p = [found[m] for m in marks]
                at = rows.schema.get_field_index("p")
                rows = rows.set_column(at, "p", pa.array(p, pa.float64()))
                at = rows.schema.get_field_index("decided")
                rows = rows.set_column(at, "decided", pa.array([_integral(x) for x in p]))
                yield from rows.combine_chunks().to_batches()

        deal = F.concat(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")), F.lit("\x01"), F.floor(F.col("bucket") / FAN_IN**level).cast("string"))
        dealt = now.withColumn("deal", deal).repartition("deal").sortWithinPartitions("deal", "bucket", "mix_mark")
        kind = dict(start.dtypes)
        out = written(dealt.mapInArrow(step, ", ".join(f"{c} {kind.get(c, 'boolean')}" for c in columns)), f"mixing-{level}")
        done.append(out.where("decided"))
        now = out.where("not decided")
    copies = done[0]
    for more in done[1:]:
        copies = copies.union(more)
    return rows, copies.select("mix_mark", "source", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = mix(read_table(spark, sf_dir, "documents"))
    out = rows.drop("source").join(copies, "mix_mark")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", F.col("copies").cast("bigint").alias("copies"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    _, copies = mix(docs)
    own, times, copy = (fresh(docs, x) for x in ("mix_mark", "mix_copies", "mix_copy"))
    counts = copies.where("copies > 0").select(F.col("mix_mark").alias(own), F.col("copies").alias(times))
    taken = marked(docs, "doc_id", "source", "text", own).join(counts, own)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)


QUERIES = {"op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
