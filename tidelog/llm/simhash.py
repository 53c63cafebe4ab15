"""SimHash near-duplicates: fingerprints of word shingles, linked through a grid of per-segment bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of their popcounts. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so links at ``most`` differing bits
lie within ``most`` of each other there. The grid join works on ``GROUPS`` runs of segments: if the distances over three
runs sum to 4 or less, one run has 1 or less. Each distinct fingerprint is stored in its cell of every run and looks up
the cells one step up, so that every pair within one step meets in a cell; pairs that meet are verified exactly. Inside
a cell a breadth-first search over the verified links gives a spanning forest, never all pairs, and equal fingerprints
have been folded into one before.

The pipeline's stage finds every pair of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. The same
grid join over the sets' fingerprints comes first, and its links are verified on the sets. It can't be all: at similarities of 0.80 to 0.85
few pairs are within 4 bits, and 64 bits can't tell the others from unrelated texts. So what it leaves apart is completed exactly: sets
that are alike share one of the first fifth (and one) of their hashes in any order that is the same for all. Hashes that many sets
hold come last in it, so that a passage in many texts makes no pairs of them; these first hashes are the cells where sets meet, their
sizes and the number of cells shared rule out most pairs, and the others are verified on the whole sets.

Null or empty texts (no word) have the fingerprint zero and link like any other. Null doc_ids take part in links; a
component's id is the smallest doc_id that is not null. Repeated rows stay, each with its component. An empty table gives
no rows. Columns of the input other than ``id_col`` and ``text_col`` are not read, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import EDGE, Forest, components, discard, fresh, keyed_runs, read_table, slices, small, written

BITS = 64
SEGMENT = 2
#: Segments in each run of the grid join.
GROUPS = (11, 11, 10)
#: Fingerprints of a partition whose links are held at a time, to tell none twice.
MOST_HELD = 1_000_000
#: What the pipeline's stage calls alike: shingles of ``WORDS`` words and a Jaccard similarity of ``SHARE`` or more.
WORDS = 5
SHARE = (4, 5)
#: Cells of each set that the first of the two rounds looks at.
FIRST = 3
#: A pair is checked where it shares so many cells; more rule out more pairs, over longer parts of the sets.
MEETINGS = 2
#: A hash counts as common if that many sets hold it, twice as many where more than MOST_COMMON hashes would be. Sets are counted in blocks
#: of about BLOCK hashes, of which only those count that are in ``LOCAL`` sets of the block. It decides the order alone.
COMMON, MOST_COMMON, BLOCK, LOCAL = 40, 1_000_000, 4_000_000, 4
_CELL = "cell bigint, uid bigint, n bigint, place bigint"
_POWERS = 3 ** np.arange(max(GROUPS), dtype=np.int64)


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of space-joined words, a block at a time."""
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    stops = ends[width - 1 :]
    h = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 200_000):
        pairs = zip(starts[at : at + 200_000].tolist(), stops[at : at + 200_000].tolist(), strict=True)
        yield np.array([h(joined[a:b], 42) for a, b in pairs], np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """Unsigned SimHash: a bit is one if set in over half of the hashes; zero without any."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text's shingles, repeats included."""
    return majority(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), width))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, mark_col: str | None = None) -> DataFrame:
    """(id, fp, mark): the fingerprint as a signed long, and a string that tells rows apart where asked for."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["id", "fp", "mark"])

    mark = F.col(mark_col) if mark_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), mark.alias("mark")).mapInArrow(run, f"id {kind}, fp bigint, mark string")


def cell_entries(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, fingerprint, probe) of the grid: each fingerprint's own cell in every run and the cells one step up."""
    pairs = np.stack([(fps >> np.uint64(i)) & np.uint64(3) for i in range(0, BITS, SEGMENT)], axis=1)
    counts = np.array([0, 1, 1, 2], np.int64)[pairs.astype(np.intp)]
    cells, who, probe = [], [], []
    at = 0
    for g, n in enumerate(GROUPS):
        own = counts[:, at : at + n] @ _POWERS[:n] + (g << 20)
        cells.append(own)
        who.append(fps)
        probe.append(np.zeros(len(fps), bool))
        for j in range(n):
            can = counts[:, at + j] < SEGMENT
            cells.append(own[can] + _POWERS[j])
            who.append(fps[can])
            probe.append(np.ones(int(can.sum()), bool))
        at += n
    return np.concatenate(cells), np.concatenate(who), np.concatenate(probe)


def cell_links(stored: np.ndarray, probes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links of a cell that together connect whatever its pairs connect."""
    label = np.full(len(stored), -1, np.int64)
    rest = np.arange(len(stored))
    while len(rest):
        front = [int(rest[0])]
        label[rest[0]], rest = front[0], rest[1:]
        while front and len(rest):
            i = front.pop()
            near = np.bitwise_count(stored[rest] ^ stored[i]) <= most
            if near.any():
                found = rest[near]
                label[found] = label[i]
                rest = rest[~near]
                for j in found.tolist():
                    yield int(stored[i]), int(stored[j])
                    front.append(j)
    step = max(1, 2_000_000 // max(1, len(stored)))
    for at in range(0, len(probes), step):
        block = probes[at : at + step]
        who, whom = np.nonzero(np.bitwise_count(block[:, None] ^ stored[None, :]) <= most)
        met = set()
        for i, j in zip(who.tolist(), whom.tolist(), strict=True):
            if (i, int(label[j])) not in met:
                met.add((i, int(label[j])))
                yield int(block[i]), int(stored[j])


def near_links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp) that connect all pairs at ``most`` or fewer differing bits."""
    if not 0 <= most < 2 * len(GROUPS):
        raise ValueError("the grid looks one step around: most must be below twice the number of runs")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 20_000):
                cells, who, probe = cell_entries(values[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(who.view(np.int64)), pa.array(probe)], names=["cell", "fp", "probe"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, a_out, b_out = Forest(), [], []
        for _, rows in keyed_runs(batches, "cell"):
            if rows.num_rows < 2:
                continue
            fps = rows.column("fp").to_numpy().view(np.uint64)
            probe = rows.column("probe").to_numpy()
            if probe.all():
                continue
            if len(forest.up) > MOST_HELD:
                # Links that other cells have as well are then told again.
                forest = Forest()
            for a, b in cell_links(fps[~probe], fps[probe], most):
                if forest.join(a, b):
                    a_out.append(a)
                    b_out.append(b)
            if len(a_out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a_out, b_out)], names=["a", "b"])
                a_out, b_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a_out, b_out)], names=["a", "b"])

    cells = distinct.mapInArrow(spread, "cell int, fp bigint, probe boolean")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, EDGE)


def fingerprint_classes(prints: DataFrame, most: int = 4) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint; root is a fingerprint of its component."""
    spread = 4 * prints.sparkSession.sparkContext.defaultParallelism
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")).repartition(spread, "fp"), "simhash-distinct")
    comps = written(components(near_links(distinct.select("fp"), most), "simhash-links"), "simhash-components")
    ids = comps.join(distinct, comps.node == distinct.fp).groupBy("root").agg(F.min("least").alias("cid"))
    named = comps.join(ids, "root").select(F.col("node").alias("fp"), "root", "cid")
    # Written, so that the joins with it have two plain exchanges and Spark can split a hot fingerprint.
    return written(distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("cid", "least").alias("component_id")), "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``."""
    prints = written(with_fingerprints(docs, id_col, text_col, width), "simhash")
    return prints.join(fingerprint_classes(prints, most), "fp").select("id", "fp", "component_id")


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text in rising order."""
    found = list(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), width))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is ``SHARE`` or more."""
    num, den = SHARE
    return len(np.intersect1d(a, b, assume_unique=True)) * (num + den) >= num * (len(a) + len(b))


def prefix(n: int) -> int:
    """How many of the least hashes of a set of ``n`` must hold one of any set that is alike."""
    num, den = SHARE
    return n - -(-num * n // den) + 1 if n else 0


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 36
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [shingle_set(t.as_py()) for t in part.column("text")]
            fps = np.array([majority(x[at : at + 200_000] for at in range(0, len(x), 200_000)) for x in sets], np.uint64).view(np.int64)
            own = [x.tobytes() for x in sets]
            uids = pa.array(range(uid, uid + len(own)), pa.int64())
            uid += len(own)
            keys = pa.array([xxhash.xxh3_128_digest(x) for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), uids, keys, pa.array(fps), pa.array(own, pa.binary())], names=["id", "mark", "uid", "key", "fp", "hashes"])


def common_hashes(sets: DataFrame) -> np.ndarray:
    """The hashes that many sets hold, in rising order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def out() -> pa.RecordBatch:
            every = np.sort(np.concatenate([np.empty(0, np.int64), *held]))
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, np.int64)
            times = np.diff(np.concatenate((starts, [len(every)])))
            many = times >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(every[starts][many]), pa.array(times[many])], names=["hash", "n"])

        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_buffer(), np.int64))
                total += len(held[-1])
                if total > BLOCK:
                    yield out()
                    held, total = [], 0
        yield out()

    counts = written(sets.select("hashes").mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")), "shingle-counts")
    least = COMMON
    while counts.where(F.col("n") >= least).count() > MOST_COMMON:
        least *= 2
    found = counts.where(F.col("n") >= least).select("hash").toArrow().column("hash").to_numpy()
    discard(counts)
    return np.sort(found)


def in_order(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set's hashes with the common ones last."""
    if not len(common):
        return hashes
    last = common[np.searchsorted(common, hashes).clip(max=len(common) - 1)] == hashes
    return np.concatenate([hashes[~last], hashes[last]])


def _entries(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "hashes"):
            cells, uids, sizes, places = [np.empty(0, np.int64)], [], [], []
            for uid, x in zip(part.column("uid").to_pylist(), part.column("hashes").to_pylist(), strict=True):
                own = in_order(np.frombuffer(x, np.int64), common.value)
                k = prefix(len(own))
                cells.append(own[:k])
                uids.append((uid, k))
                sizes.append(len(own))
                places.append(np.arange(k))
            times = [k for _, k in uids]
            columns = [np.concatenate(cells), np.repeat(np.array([u for u, _ in uids], np.int64), times), np.repeat(np.array(sizes, np.int64), times), np.concatenate([np.empty(0, np.int64), *places])]
            out = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "uid", "n", "place"])
            for at in range(0, out.num_rows, 100_000):
                yield out.slice(at, 100_000)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables sorted by cell, cut so that no cell goes on in the next one."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column("cell").to_numpy()
        cut = int(np.searchsorted(cells, cells[-1]))
        table = pa.Table.from_batches([batch])
        if held and held[-1].column("cell")[-1].as_py() != cells[0] or cut:
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            held = []
        held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of cells that hold two or more sets."""
    for table in whole_cells(batches):
        cells = table.column("cell").to_numpy()
        same = cells[1:] == cells[:-1]
        yield from table.filter(pa.array(np.append(same, False) | np.append(False, same)[: len(cells)])).to_batches()


def _cell_pairs(batches: Iterator[pa.RecordBatch], lags: int | None) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, short): pairs of a cell at most ``lags`` places apart in the order of size, in how many cells they met here,
    and in how many they must meet to be alike.

    Sets that are alike share ``least`` hashes or more. All sets have one order, so the first ``short`` shared hashes of a pair lie
    within the first n - least + short places of either set; they meet in those places only, which loses none.
    """
    num, den = SHARE
    for table in whole_cells(batches):
        cells, uid, n, place, label = (table.column(c).to_numpy() for c in ("cell", "uid", "n", "place", "label"))
        # No more than this can be shared beyond a set's own cells.
        rest = n - (n - -(-num * n // den) + 1)
        at, lag = np.arange(len(cells)), 1
        while len(at) and (lags is None or lag <= lags):
            at = at[at + lag < len(cells)]
            to = at + lag
            on = (cells[to] == cells[at]) & (n[at] * den >= n[to] * num)
            at, to = at[on], to[on]
            may = label[at] != label[to]
            i, j = at[may], to[may]
            least = -(-num * (n[i] + n[j]) // (num + den))
            short = np.minimum(MEETINGS, least - np.maximum(rest[i], rest[j]))
            early = (place[i] < n[i] - least + short) & (place[j] < n[j] - least + short)
            i, j, short = i[early], j[early], short[early]
            if len(i):
                found, times = np.unique(np.stack([np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j]), short]), axis=1, return_counts=True)
                columns = [found[0], found[1], times.astype(np.int64), found[2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["a", "b", "shared", "short"])
            lag += 1


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs], pa.bool_()))


def grid_pairs(sets: DataFrame, most: int = 4) -> DataFrame:
    """(a, b) between rows (uid, fp) that connect equal fingerprints and those at ``most`` or fewer differing bits."""
    prints = sets.select("uid", "fp")
    least = written(prints.groupBy("fp").agg(F.min("uid").alias("least")), "shingle-prints")
    same = prints.join(least, "fp").where("uid <> least").select(F.col("least").alias("a"), F.col("uid").alias("b"))
    links = near_links(least.select("fp"), most).toDF("fa", "fb")
    near = links.join(least.toDF("fa", "a"), "fa").join(least.toDF("fb", "b"), "fb")
    return same.union(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def alike_links(sets: DataFrame) -> DataFrame:
    """(a, b) between rows (uid, fp, hashes) of distinct sets that connect all pairs that are alike."""
    spark = sets.sparkSession

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs, f"{name}-pairs")
        nodes = written(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), f"{name}-nodes")
        needed = written(sets.select("uid", "hashes").join(small(nodes), "uid", "left_semi"), f"{name}-sets")
        both = pairs.join(needed.select(F.col("uid").alias("a"), F.col("hashes").alias("of_a")), "a").join(needed.select(F.col("uid").alias("b"), F.col("hashes").alias("of_b")), "b")
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(key)
        # Two sets a row are long; written lowers no further.
        spark.conf.set(key, "200")
        try:
            return written(both.select("a", "b", "of_a", "of_b").mapInArrow(_verify, EDGE), name)
        finally:
            spark.conf.set(key, before)
            for table in (pairs, nodes, needed):
                discard(table)

    def meet(cells: DataFrame, lags: int | None) -> DataFrame:
        return cells.repartition("cell").sortWithinPartitions("cell", "n", "uid").mapInArrow(lambda batches: _cell_pairs(batches, lags), f"{EDGE}, shared bigint, short bigint")

    common = spark.sparkContext.broadcast(common_hashes(sets))
    entries = sets.select("uid", "hashes").mapInArrow(lambda batches: _entries(batches, common), _CELL).repartition("cell").sortWithinPartitions("cell")
    cells = written(entries.mapInArrow(_shared, _CELL), "shingle-cells")
    # Links of the grid and neighbours in the first cells of each set first: what they connect is not paired again, so that a large
    # group costs no square of its size.
    neighbours = meet(cells.where(F.col("place") < FIRST).withColumn("label", F.col("uid")), 1).select("a", "b")
    first = checked(grid_pairs(sets).union(neighbours).distinct(), "shingle-first")
    groups = written(components(first, "shingle-groups"), "shingle-labels")
    labelled = cells.join(small(groups.select(F.col("node").alias("uid"), F.col("root").alias("label"))), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    pairs = meet(labelled, None).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("short").alias("short")).where("shared >= short").select("a", "b")
    rest = checked(pairs, "shingle-rest")
    discard(cells)
    return first.union(rest)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of alike texts: that with the smallest id, null ids last.

    Texts without words are alike, repeated rows are one, and other columns pass through whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    mark = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-")), F.lit("\x01"), F.coalesce(F.col(text_col), F.lit(""))))
    own, nth = fresh(docs, "mark"), fresh(docs, "nth")
    marked = docs.withColumn(own, mark)
    source = marked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(own).alias("mark"))
    prints = written(source.mapInArrow(_sets, f"id {kind}, mark string, uid bigint, key binary, fp bigint, hashes binary"), "shingle-sets")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("mark"))).alias("first")
    distinct = written(prints.groupBy("key").agg(F.min("uid").alias("uid"), first).drop("key"), "shingle-distinct")
    uids = written(distinct.select("uid"), "shingle-uids")
    sets = prints.select("uid", "fp", "hashes").join(small(uids), "uid", "left_semi")
    groups = components(alike_links(sets), "shingle-links")
    discard(prints)
    root = F.coalesce("root", "uid").alias("root")
    least = distinct.join(groups.withColumnRenamed("node", "uid"), "uid", "left").groupBy(root).agg(F.min("first").alias("first"))
    rows = marked.join(least.select(F.col("first.mark").alias(own)), own, "left_semi")
    once = F.row_number().over(Window.partitionBy(own).orderBy(own))
    return rows.withColumn(nth, once).where(F.col(nth) == 1).drop(own, nth)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are alike."""
    return one_of_each(docs)


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
ORACLES: dict[str, str] = {}
