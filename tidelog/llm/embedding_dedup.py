"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors are folded first. K-means centroids of a bounded sample define cluster shards; a vector is built into its
``BUILDS`` nearest shards, so shards overlap, and asks its ``probes`` nearest ones. Per shard a graph is made: each node's
nearest nodes are pruned robustly (a candidate goes if a chosen neighbour is ``ALPHA`` times nearer to it than the node
is), reverse edges are added. The lists that a node got in different shards are united. Every vector then searches: a greedy
beam from the shard's medoid, then range expansion, which follows the neighbours of everything within ``SLACK`` of the
threshold until nothing new turns up. What is found is verified in double precision. A node found in two of the shards a
vector asks counts only in the first, so degrees add up without listing pairs; links are kept as a spanning forest per task.

Recall is audited against brute force over all vectors for a bounded sample of queries, one half of them at random and one half
among those with a link, and logged; below ``LEAST_RECALL`` the search is repeated with twice the probes and twice the beam, at last with all
shards and a scan of them instead of the graph, which is exact. A shard above ``MOST`` nodes is cut by hash into parts
that its queries all visit, and its queries into slices of about ``MOST_ASKING``, so a task's memory is bounded and no link is lost.

Vectors that are null, zero, of another length than most, or hold null or non-finite components link with nothing. Null
vec_ids take part, a component's id is its smallest id that is not null. Repeated rows are vectors of their own, and any number of
equal or near vectors keeps all its links. Components of other types than float are compared as doubles. Vectors of any length
are read whole. An empty table gives no rows. Only ``id_col`` and ``vector_col`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import blocks_of, components, discard, keyed_runs, read_table, written

SAMPLE = 20_000
PER_SHARD = 1500
MOST_SHARDS = 4096
MOST = 6000
MOST_ASKING = 20_000
BUILDS = 2
PROBES = 4
NEAREST = 48
DEGREE = 20
FAR = 6
ALPHA = 1.2
BEAM = 20
SLACK = 0.03
AUDIT = 256
LEAST_RECALL = 0.95
_log = logging.getLogger(__name__)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        c[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return c


def robust_prune(x: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Of each row's candidates (nearest first) the diverse ones, padded with len(x)."""
    n, c = near.shape
    out = np.full((n, degree), len(x), np.int32)
    for a in range(0, n, 256):
        own, far = near[a : a + 256], 1 - sims[a : a + 256]
        points = x[own]
        between = 1 - np.einsum("bid,bjd->bij", points, points)
        alive = np.isfinite(far)
        rows = np.arange(len(own))
        for k in range(degree):
            has = alive.any(axis=1)
            if not has.any():
                break
            best = np.where(alive, far, np.inf).argmin(axis=1)
            out[a : a + 256][has, k] = own[rows, best][has]
            alive &= alpha * between[rows, best] > far
            alive[rows, best] = False
    return out


def build_graph(x: np.ndarray) -> np.ndarray:
    """Neighbours of each node with reverse edges, at most twice DEGREE, padded with len(x)."""
    n = len(x)
    c = min(NEAREST, n - 1)
    if c < 1:
        return np.full((n, 1), n, np.int32)
    near, sims = np.empty((n, c), np.int32), np.empty((n, c), np.float32)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, c - 1, axis=1)[:, :c]
        value = np.take_along_axis(s, top, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        near[a : a + 512], sims[a : a + 512] = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
    kept = robust_prune(x, near, sims)
    if n > 2 * NEAREST:
        # Nearest nodes alone leave tight groups as islands; some far ones, pruned alike, lead in and out.
        far = np.random.default_rng(n).integers(0, n, (n, 4 * FAR)).astype(np.int32)
        values = np.concatenate([np.einsum("id,ijd->ij", x[a : a + 512], x[far[a : a + 512]]) for a in range(0, n, 512)])
        values[far == np.arange(n)[:, None]] = -np.inf
        order = np.argsort(-values, axis=1, kind="stable")
        kept = np.concatenate([kept, robust_prune(x, np.take_along_axis(far, order, axis=1), np.take_along_axis(values, order, axis=1), FAR)], axis=1)
    src, slot = np.nonzero(kept < n)
    dst = kept[src, slot]
    both = np.unique(np.concatenate([src * n + dst, dst.astype(np.int64) * n + src]))
    a, b = both // n, both % n
    close = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 200_000]], x[b[i : i + 200_000]]) for i in range(0, len(a), 200_000)])
    # Own choices come before reverse edges, which fill the list up, the nearest first.
    chosen = np.isin(both, src * n + dst)
    return padded(a, b, close + 4 * chosen, n, 2 * DEGREE)


def padded(a: np.ndarray, b: np.ndarray, close: np.ndarray, n: int, most: int) -> np.ndarray:
    """Lists of b by a, nearest first, at most that long."""
    order = np.lexsort((-close, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    ok = place < most
    out = np.full((n, max(1, min(most, int(place.max(initial=0)) + 1))), n, np.int32)
    out[a[ok], place[ok]] = b[ok]
    return out


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """(query, node) of what range-expanding greedy search from the medoid meets at ``least`` or more."""
    n, m = len(x), len(queries)
    mean = x.mean(axis=0)
    medoid = int((x @ mean).argmax())
    nodes = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    lists = np.concatenate([graph, np.full((1, graph.shape[1]), n, np.int32)])
    sims = np.full((m, n + 1), -np.inf, np.float32)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(m)
    ids = np.full((m, beam), n, np.int32)
    value = np.full((m, beam), -np.inf, np.float32)
    todo = np.zeros((m, beam), bool)
    ids[:, 0], todo[:, 0] = medoid, True
    value[:, 0] = queries @ x[medoid]
    sims[:, medoid], seen[:, medoid] = value[:, 0], True
    opened = np.zeros((m, n + 1), bool)
    active = rows
    while len(active):
        k = np.where(todo[active], value[active], -np.inf).argmax(axis=1)
        at = ids[active, k]
        todo[active, k] = False
        opened[active, at] = True
        around = lists[at]
        new = ~seen[active[:, None], around]
        seen[active[:, None], around] = True
        s = np.where(new, np.einsum("qd,qrd->qr", queries[active], nodes[around]), -np.inf)
        q, r = np.nonzero(new)
        sims[active[q], around[q, r]] = s[q, r]
        every = np.concatenate([value[active], s], axis=1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        value[active] = np.take_along_axis(every, top, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], around], axis=1), top, axis=1)
        todo[active] = np.take_along_axis(np.concatenate([todo[active], new], axis=1), top, axis=1)
        active = active[(todo[active] & np.isfinite(value[active])).any(axis=1)]
    while True:
        q, at = np.nonzero((sims >= least - SLACK) & ~opened)
        if not len(q):
            break
        opened[q, at] = True
        for a in range(0, len(q), 4000):
            around = lists[at[a : a + 4000]]
            code = np.unique((q[a : a + 4000, None].astype(np.int64) * (n + 1) + around)[~seen[q[a : a + 4000, None], around]])
            who, node = code // (n + 1), code % (n + 1)
            seen[who, node] = True
            sims[who, node] = np.einsum("ij,ij->i", queries[who], nodes[node])
    return np.argwhere(sims[:, :n] >= least - 1e-3)


def scan(x: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """(query, node) of all that lie at ``least`` or more."""
    return np.argwhere(queries @ x.T >= least - 1e-3)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Index:
    """Where vectors are built and where they ask."""

    def __init__(self, vectors: DataFrame, n: int) -> None:
        spark = vectors.sparkSession
        rate = int(min(1.0, 0.97 * SAMPLE / max(1, n)) * (1 << 30))
        picked = vectors.where(F.pmod(F.xxhash64("vector", F.lit("k-means")), F.lit(1 << 30)) < rate).select("node", "vector").toArrow()
        x = _unit(_vectors(picked.column("vector"))) if picked.num_rows else np.ones((1, 1))
        order = np.lexsort(x.T[:3])
        shards = max(1, min(MOST_SHARDS, len(x), blocks_of(n, PER_SHARD)))
        self.centroids = kmeans(x[order], shards).astype(np.float32)
        self.shards = shards

    def nearest(self, x: np.ndarray, most: int) -> np.ndarray:
        k = min(most, self.shards)
        out = np.empty((len(x), k), np.int32)
        for a in range(0, len(x), 2048):
            s = x[a : a + 2048].astype(np.float32) @ self.centroids.T
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out[a : a + 2048] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
        return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), kind))


def tally(vectors: DataFrame, index, probes: int) -> dict[int, tuple[int, int]]:
    """How many vectors each shard builds, and how many ask it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = index.value.nearest(_unit(_vectors(pa.chunked_array([batch.column(0)]))), probes) if batch.num_rows else np.empty((0, 1), np.int32)
            built, asks = (np.bincount(x.ravel(), minlength=index.value.shards) for x in (near[:, :BUILDS], near))
            at = np.flatnonzero(asks)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (at, built[at], asks[at])], names=["shard", "built", "asks"])

    found = vectors.select("vector").mapInArrow(count, "shard bigint, built bigint, asks bigint").groupBy("shard").agg(F.sum("built").alias("built"), F.sum("asks").alias("asks"))
    return {r.shard: (r.built, r.asks) for r in found.collect()}


def deal(vectors: DataFrame, index, parts: dict[int, int], slices: dict[int, int], probes: int) -> DataFrame:
    """(place, shard, node, weight, built, asks, near, vector): a row for each part and slice of a shard that a vector is built in or asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            raw = _vectors(table.column("vector"))
            near = index.value.nearest(_unit(raw), probes)
            nodes = table.column("node").to_numpy()
            take, place, shard, build, ask = [], [], [], [], []
            for k in range(near.shape[1]):
                for s in np.unique(near[:, k]).tolist():
                    every = np.flatnonzero(near[:, k] == s)
                    n, m = parts.get(s, 1), slices.get(s, 1)
                    part = (nodes[every] * 0x9E3779B1 >> 7) % n
                    own = (nodes[every] * 0x85EBCA6B >> 9) % m
                    for p in range(n):
                        for q in range(m):
                            here = (own == q) | (part == p) & (k < BUILDS)
                            who = every[here]
                            take.append(who)
                            place.append(np.full(len(who), (s << 40) + (p << 20) + q))
                            shard.append(np.full(len(who), s))
                            build.append(((part == p) & (k < BUILDS))[here])
                            ask.append((own == q)[here])
            if not take:
                continue
            who, where, of, built, asks = (np.concatenate(x) for x in (take, place, shard, build, ask))
            rows = table.take(pa.array(who))
            for a in range(0, len(who), 10_000):
                part = rows.slice(a, 10_000).combine_chunks()
                b = slice(a, a + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(where[b], pa.int64()), pa.array(of[b], pa.int32()), pa.array(nodes[who[b]], pa.int64()), part.column("weight").combine_chunks(), pa.array(built[b]), pa.array(asks[b]), _lists(near[who[b]], pa.int32()), part.column("vector").combine_chunks()], names=["place", "shard", "node", "weight", "built", "asks", "near", "vector"])

    return vectors.select("node", "weight", "vector").mapInArrow(run, f"place bigint, shard int, node bigint, weight bigint, built boolean, asks boolean, near array<int>, vector {dict(vectors.dtypes)['vector']}")


def _adjacency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, table in keyed_runs(batches, "place"):
        nodes = table.column("node").to_numpy()
        graph = build_graph(_unit(_vectors(table.column("vector"))).astype(np.float32))
        src, slot = np.nonzero(graph < len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[src], pa.int64()), pa.array(nodes[graph[src, slot]], pa.int64())], names=["node", "other"])


def _searcher(least: float, beam: int | None):
    """Searches each place with that beam; without one, scans it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in keyed_runs(batches, "place"):
            built = table.column("built").to_numpy()
            inner = table.filter(pa.array(built))
            table = table.filter(pa.array(table.column("asks").to_numpy()))
            if not inner.num_rows or not table.num_rows:
                continue
            raw, raw_q = _vectors(inner.column("vector")), _vectors(table.column("vector"))
            x, queries = _unit(raw).astype(np.float32), _unit(raw_q).astype(np.float32)
            nodes, asking = inner.column("node").to_numpy(), table.column("node").to_numpy()
            weight = inner.column("weight").to_numpy()
            shard = int(table.column("shard")[0].as_py())
            first = _vectors(inner.column("near")).astype(np.int32)[:, 0]
            near = _vectors(table.column("near")).astype(np.int32)
            order = np.argsort(nodes)
            others = inner.column("others").combine_chunks()
            lengths = np.diff(others.offsets.to_numpy())
            flat = others.flatten().to_numpy()
            src = np.repeat(np.arange(len(nodes)), lengths)
            at = np.searchsorted(nodes[order], flat).clip(max=len(nodes) - 1)
            here = nodes[order][at] == flat
            a, b = src[here], order[at[here]]
            close = np.concatenate([np.zeros(0, np.float32), *[np.einsum("ij,ij->i", x[a[i : i + 200_000]], x[b[i : i + 200_000]]) for i in range(0, len(a), 200_000)]])
            graph = padded(a, b, close, len(nodes), 4 * DEGREE) if len(a) and beam else np.full((len(nodes), 1), len(nodes), np.int32)
            label = np.arange(len(nodes))
            step = max(16, min(256, 1_500_000 // len(nodes)))
            ids, counts, ea, eb = [], [], [], []
            for start in range(0, len(asking), step):
                block = slice(start, start + step)
                pairs = search(x, graph, queries[block], least, beam) if beam else scan(x, queries[block], least)
                sure = np.concatenate([np.zeros(0, bool), *[cosines(raw_q[start + pairs[i : i + 50_000, 0]], raw[pairs[i : i + 50_000, 1]]) >= least for i in range(0, len(pairs), 50_000)]])
                pairs = pairs[sure]
                pairs = pairs[asking[start + pairs[:, 0]] != nodes[pairs[:, 1]]]
                q, node = start + pairs[:, 0], pairs[:, 1]
                counted = (first[node] == shard) | ~(near[q] == first[node][:, None]).any(axis=1)
                sums = np.bincount(pairs[:, 0], weights=weight[node] * counted, minlength=len(asking[block]))
                ids += asking[block].tolist()
                counts += sums.astype(np.int64).tolist()
                for i, mine in zip(*_runs(q, node), strict=True):
                    met, where = np.unique(label[mine], return_index=True)
                    own = np.flatnonzero(nodes == asking[i]) if len(met) else mine
                    spots = mine[where].tolist()
                    if len(own) and label[own[0]] not in met:
                        met = np.append(met, label[own[0]])
                    elif len(own) and len(met) == 1:
                        continue
                    if len(met) > 1:
                        label[np.isin(label, met)] = met.min()
                    ea += [int(asking[i])] * len(spots)
                    eb += nodes[spots].tolist()
            yield _found(ids, [None] * len(ids), counts)
            yield _found(ea, eb, [None] * len(ea))

    return run


def _runs(q: np.ndarray, node: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(q):
        return [], []
    cuts = np.flatnonzero(np.diff(q)) + 1
    return q[np.concatenate(([0], cuts))].tolist(), np.split(node, cuts)


def _found(a: list, b: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])


def audit(vectors: DataFrame, degrees: DataFrame, n: int, least: float) -> float:
    """The part of all links of a bounded sample of queries, by brute force over all vectors, that the search found."""
    spark = vectors.sparkSession

    def some(df: DataFrame, rows: int) -> DataFrame:
        rate = int(min(1.0, 0.45 * AUDIT / max(1, rows)) * (1 << 30))
        return df.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) < rate).select("node")

    linked = degrees.where("degree > 0")
    chosen = some(vectors, n).union(some(linked, linked.count())).distinct()
    picked = vectors.join(chosen, "node", "left_semi").select("node", "vector").toArrow()
    if not picked.num_rows:
        return 1.0
    sample = spark.sparkContext.broadcast((picked.column("node").to_numpy(), _vectors(picked.column("vector"))))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, queries = sample.value
        total = np.zeros(len(nodes), np.int64)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
            s = _unit(queries) @ _unit(_vectors(table.column("vector"))).T
            total += ((s >= least) & (nodes[:, None] != own[None, :])) @ weight
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(total, pa.int64())], names=["node", "exact"])

    exact = vectors.mapInArrow(brute, "node bigint, exact bigint").groupBy("node").agg(F.sum("exact").alias("exact"))
    known, found = exact.join(degrees, "node", "left").agg(F.sum("exact"), F.sum(F.least("exact", F.coalesce("degree", F.lit(0))))).first()
    return found / known if known else 1.0


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    return audited(rows, id_col, vector_col, least)[0]


def audited(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> tuple[DataFrame, float]:
    """(id, n_links, component_id, kept) of every row, and the recall that the audit found."""
    kind = "array<float>" if dict(rows.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col("vector")
    norm = F.aggregate(v, F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    sound = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (norm > 0), F.lit(False))
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    keyed = written(base.withColumn("sound", sound).withColumn("key", F.when(F.col("sound"), F.md5(F.concat_ws(",", F.transform("vector", lambda e: e.cast("string")))))), "vectors")
    length = keyed.where("sound").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    usable = keyed.where(F.col("sound") & (F.size("vector") == F.lit(length.d if length else 0)))
    folded = usable.groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + batch.num_rows), pa.int64()), *batch.columns], names=["node", *batch.schema.names])
            at += batch.num_rows

    id_kind = dict(keyed.dtypes)["id"]
    vectors = written(folded.mapInArrow(number, f"node bigint, key string, least_id {id_kind}, weight bigint, vector {kind}"), "vectors-distinct")
    spark = rows.sparkSession
    n = vectors.count()
    index = _Index(vectors, n)
    known = spark.sparkContext.broadcast(index)
    spread = 4 * spark.sparkContext.defaultParallelism
    even = vectors.repartition(spread, "node")
    parts = {s: -(-built // MOST) for s, (built, _) in tally(even, known, BUILDS).items() if built > MOST}
    built = deal(even, known, parts, {}, BUILDS).where("built").select("place", "node", "vector")
    edges = built.repartition(spread, "place").sortWithinPartitions("place").mapInArrow(_adjacency, "node bigint, other bigint")
    lists = written(edges.groupBy("node").agg(F.collect_set("other").alias("others")), "vectors-graph")
    probes, beam = PROBES, BEAM
    while True:
        slices = {s: -(-asks // MOST_ASKING) for s, (_, asks) in tally(even, known, probes).items() if asks > MOST_ASKING}
        asked = deal(even, known, parts, slices, probes)
        dealt = asked.join(lists, "node", "left").withColumn("others", F.when(F.col("built"), F.coalesce("others", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>")))
        dealt = dealt.repartition(spread, "place").sortWithinPartitions("place", "node")
        found = written(dealt.mapInArrow(_searcher(least, beam), "a bigint, b bigint, n bigint"), "vectors-found")
        degrees = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree"))
        recall = audit(vectors.select("node", "weight", "vector"), degrees, n, least)
        _log.info("recall %.4f with %d probes, beam %s", recall, probes, beam)
        if recall >= LEAST_RECALL or beam is None:
            break
        discard(found)
        probes, beam = (2 * probes, 2 * beam) if probes < index.shards else (probes, None)
    comps = components(found.where("b is not null").select("a", "b"), "vectors-links")
    comps = comps.withColumnRenamed("node", "c_node")
    ids = comps.join(vectors.select("node", "least_id"), F.col("c_node") == F.col("node")).groupBy("root").agg(F.min("least_id").alias("cid"))
    named = comps.join(ids, "root").select(F.col("c_node").alias("node"), "cid")
    classes = written(vectors.select("node", "key", "least_id", "weight").join(degrees, "node", "left").join(named, "node", "left").select("key", (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("cid", "least_id").alias("component")), "vectors-classes")
    out = keyed.select("id", "key").join(classes, "key", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), recall


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH RECURSIVE sound AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0),
usual AS (SELECT len(e) AS d FROM sound GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
v AS (SELECT sound.* FROM sound JOIN usual ON len(e) = d),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.row_id <> b.row_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
found AS (SELECT vec_id, min(other) AS least_id FROM reached GROUP BY vec_id),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least_id, vec_id) AS component_id, vec_id = coalesce(least_id, vec_id) AS kept
FROM embeddings LEFT JOIN degrees USING (vec_id) LEFT JOIN found USING (vec_id)
"""

QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
ORACLES = {"op9_embedding_dedup": ORACLE}
