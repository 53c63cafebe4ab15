"""Shared pieces of the corpus operators: tables written to the shared folder, keyed runs, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
BROADCAST_IDS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hands documents to Python in smaller batches than Spark's default, as their texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is configured and one machine does all (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _FALLBACK.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return base.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def small(ids: DataFrame) -> DataFrame:
    """A written table of numbers, marked for broadcast where it has at most BROADCAST_IDS rows (about 30 MB); more are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_tidelog_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def blocks_of(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def keyed_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) for each run of equal keys in batches sorted by that key; one run is held at a time."""
    held: list[pa.Table] = []
    last: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).combine_chunks()
        values = keys.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        edges = [0, *cuts.tolist(), len(values)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = values[a]
            if held and k != last:
                yield last, pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = k
    if held:
        yield last, pa.concat_tables(held)


class Forest:
    """Union-find over hashable nodes; ``join`` is true if the two were apart."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


EDGE = "a bigint, b bigint"


def thin_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition's edges, only those that join something new: spanning forests of bounded size."""
    forest, a_out, b_out = Forest(), [], []
    for batch in batches:
        if len(forest.up) > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
            forest, a_out, b_out = Forest(), [], []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            if forest.join(a, b):
                a_out.append(a)
                b_out.append(b)
    yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node with an edge, root being the smallest node of its component.

    Alternating large-star and small-star rounds: each is two hash joins on the edges, written to the shared folder.
    Edges only ever get fewer, and a star's hub needs no list of its neighbours.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(thin_edges, EDGE).distinct(), name)

    def digest(df: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit(1048575)))).first())

    seen = digest(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = written(small, name)
        now_digest = digest(after)
        discard(now)
        now = after
        if now_digest == seen:
            break
        seen = now_digest
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``f`` over each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about that many bytes of text, so that a worker's memory stays bounded."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
