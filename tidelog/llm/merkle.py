"""A Merkle manifest of a table: hash trees by group, over ranges of rows that are hashed on their own and then merged.

Rows become leaves, ordered by group (null first), id (null first) and leaf. The range exchange deals them into parts of consecutive rows; a
group may fill many parts and a part may hold many groups. With the rows of each group in each part counted, every leaf has its number.
A part keeps, for each level, the open run of up to ``fanout`` consecutive nodes (the mountain range). A run that begins at a multiple of the
fanout and is full, or ends where its level ends, is carried: its hash goes to the level above and the node is recorded. Runs that other parts have a share in
stay as peaks, fewer than ``fanout`` at each end of a level. Peaks of ``MERGED`` parts meet in one task, which closes what it can and hands on the rest,
until no part is left open. The ends of levels are known, so a short last run is hashed as it is, without padding, even a single node.
The groups' roots are the leaves of one more tree of the same kind.

A proof is what stands beside a leaf's path. Inside a part it comes from the part's own leaves; of other parts it takes nodes next to its ends only,
a few for each level, all of which are peaks or were made by a merge.

``H`` is the lowercase hex SHA-256 of its inputs joined; inputs that are hashes are joined as hex text. A leaf's fields are ``-`` where null, else the length in UTF-8
bytes, ``:`` and the value. Repeated rows are leaves of their own, side by side; rows that tie in group and id are ordered by leaf, so the
root depends on the rows alone. An empty table has no rows, no nodes and no root. Texts are hashed whole by Spark and are not shuffled; only the columns named are
read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import blocks_of, fresh, keyed_runs, read_table, written

FANOUT = 3
#: Leaves of a part (more only where there would be over MOST_PARTS), and parts whose peaks meet in one task.
PART = 20_000
MOST_PARTS = 100_000
MERGED = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "grp string, level int, idx bigint, hash binary, peak boolean, part bigint, total bigint"
_NODE_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())


def h(inputs: list[bytes]) -> bytes:
    """The hash of hashes, all as 32 bytes."""
    return hashlib.sha256(b"".join(inputs).hex().encode()).digest()


def field_hash(columns: list[Column]) -> Column:
    """The leaf of a row, as hex."""
    shown = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]), 256)


def level_sizes(n: int, fanout: int) -> list[int]:
    """Nodes of each level of a tree of n leaves."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


class Range:
    """A mountain range over consecutive leaves of one tree of ``n``: open runs by level, and what was recorded."""

    def __init__(self, n: int, fanout: int) -> None:
        self.sizes, self.fanout = level_sizes(n, fanout), fanout
        self.open: list[list[tuple[int, bytes]]] = [[] for _ in self.sizes]
        self.nodes: list[tuple[int, int, bytes]] = []
        self.peaks: list[tuple[int, int, bytes]] = []

    def push(self, level: int, idx: int, digest: bytes) -> None:
        k = self.fanout
        while True:
            run = self.open[level]
            if run and run[0][0] // k != idx // k:
                self._leave(level)
                run = self.open[level]
            run.append((idx, digest))
            first = idx // k * k
            if self.sizes[level] == 1 or run[0][0] != first or idx + 1 != min(first + k, self.sizes[level]):
                return
            digest = h([d for _, d in run])
            self.open[level] = []
            level, idx = level + 1, idx // k
            self.nodes.append((level, idx, digest))

    def _leave(self, level: int) -> None:
        self.peaks += [(level, i, d) for i, d in self.open[level]]
        self.open[level] = []

    def close(self) -> None:
        for level in range(len(self.sizes)):
            self._leave(level)


def merge_peaks(peaks: list[tuple[int, int, bytes]], n: int, fanout: int) -> Range:
    """Peaks of neighbouring ranges of one tree, in any order, as one range."""
    out = Range(n, fanout)
    waiting: list[dict[int, bytes]] = [{} for _ in out.sizes]
    for level, idx, digest in peaks:
        waiting[level][idx] = digest
    for level, here in enumerate(waiting):
        runs: dict[int, list[int]] = {}
        for idx in sorted(here):
            runs.setdefault(idx // fanout, []).append(idx)
        for parent, members in runs.items():
            whole = min(fanout, out.sizes[level] - parent * fanout)
            if out.sizes[level] > 1 and len(members) == whole:
                digest = h([here[i] for i in members])
                out.nodes.append((level + 1, parent, digest))
                waiting[level + 1][parent] = digest
            else:
                out.peaks += [(level, i, here[i]) for i in members]
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NODE_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _NODE_KINDS, strict=True)], names=["grp", "level", "idx", "hash", "peak", "part", "total"])


@dataclass
class Manifest:
    """``leaves``: part, pos, grp, id, hash and what was carried along; ``spans``: part, grp, first, n, total; ``nodes``: grp, level, idx, hash of all
    levels above the leaves; ``edges``: the nodes at the ends of parts; ``roots``: grp, total, hash."""

    fanout: int
    leaves: DataFrame
    spans: DataFrame
    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame


def group_key(group: Column) -> Column:
    """A group's name that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def build(rows: DataFrame, fanout: int = FANOUT, per_part: int = PART) -> Manifest:
    """The trees of ``rows`` (grp, id, hash as 32 bytes, more), leaves ordered by grp, id (null first) and hash.

    Rows that agree in all three are told apart by their place in the input, so that any number of them is dealt to many parts.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    extra = [c for c in rows.columns if c not in ("grp", "id", "hash")]
    order = [F.col("grp").asc(), F.col("id").asc_nulls_first(), F.col("hash").asc(), F.col("_row").asc()]
    n_rows = rows.count()
    parts = blocks_of(n_rows, max(per_part, n_rows // MOST_PARTS))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            places = [pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *places], names=[*batch.schema.names, "part", "pos"])
            at += n

    kinds = dict(dealt.dtypes)
    leaves = written(dealt.mapInArrow(number, ", ".join(f"`{c}` {kinds[c]}" for c in dealt.columns) + ", part bigint, pos bigint"), "manifest-leaves")
    counted = leaves.groupBy("part", "grp").agg(F.count("*").alias("n"))
    # A row for each part that holds some of a group.
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = written(counted.select("part", "grp", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("grp")).alias("total")), "manifest-spans")
    # As many as the exchange has made, which need not be as many as were asked for.
    parts = 1 + (spans.agg(F.max("part")).first()[0] or 0)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        here: Range | None = None
        grp = part = None
        at = total = 0

        def settle() -> None:
            here.close()
            out.extend((grp, *x, False, part, total) for x in here.nodes)
            out.extend((grp, *x, True, part, total) for x in here.peaks)

        for batch in batches:
            for p, g, first, n, digest in zip(*[batch.column(c).to_pylist() for c in ("part", "grp", "first", "total", "hash")], strict=True):
                if first is not None:
                    if here is not None:
                        settle()
                    grp, part, at, total, here = g, p, first, n, Range(n, fanout)
                    continue
                here.push(0, at, digest)
                at += 1
            if here is not None:
                out.extend((grp, *x, False, part, total) for x in here.nodes)
                here.nodes = []
            yield _batch(out)
            out = []
        if here is not None:
            settle()
        yield _batch(out)

    # Before the leaves of a part and group comes a row that says where they begin.
    heads = spans.select("part", "grp", F.lit(-1).cast("bigint").alias("pos"), "first", "total", F.lit(None).cast("binary").alias("hash"))
    bodies = leaves.select("part", "grp", "pos", F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("total"), "hash")
    # A group's head sorts before its leaves, and groups are in order inside a part.
    made = written(heads.union(bodies).repartition(parts, "part").sortWithinPartitions("part", "grp", "pos").mapInArrow(climb, _NODE), "manifest-nodes")
    steps = [made]
    while parts > 1:

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, table in keyed_runs(batches, "part"):
                out, trees = [], {}
                for grp, level, idx, digest, total in zip(*[table.column(c).to_pylist() for c in ("grp", "level", "idx", "hash", "total")], strict=True):
                    trees.setdefault((grp, total), []).append((level, idx, digest))
                for (grp, total), peaks in trees.items():
                    range_ = merge_peaks(peaks, total, fanout)
                    out += [(grp, *x, False, int(part), total) for x in range_.nodes]
                    out += [(grp, *x, True, int(part), total) for x in range_.peaks]
                yield _batch(out)

        open_peaks = steps[-1].where("peak").where(~_is_root(fanout)).withColumn("part", F.floor(F.col("part") / MERGED))
        parts = -(-parts // MERGED)
        steps.append(written(open_peaks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, _NODE), "manifest-merge"))
    every = steps[0]
    for step in steps[1:]:
        every = every.union(step)
    edges = made.where("peak")
    for step in steps[1:]:
        edges = edges.union(step.where("not peak"))
    roots = every.where("peak").where(_is_root(fanout)).select("grp", "total", "hash").union(every.where("not peak").where(_is_root(fanout)).select("grp", "total", "hash")).distinct()
    keep = leaves.select("part", "pos", "grp", "id", "hash", *extra)
    return Manifest(fanout, keep, spans, every.where("not peak").select("grp", "level", "idx", "hash"), edges.select("grp", "level", "idx", "hash"), written(roots, "manifest-roots"))


def _is_root(fanout: int) -> Column:
    """Whether a node is the only one of its level: its level's first node covers all leaves, and the level below (if any) has more than one node."""
    return (F.col("idx") == 0) & F.col("level").eqNullSafe(_height(F.col("total"), fanout))


def _height(total: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree of ``total`` leaves."""
    powers = [fanout**k for k in range(1, 64) if fanout**k < 1 << 62]
    return F.when(total <= 1, 0).otherwise(1 + F.size(F.filter(F.array(*[F.lit(p).cast("bigint") for p in powers]), lambda p: p < total)))


class Paths:
    """Siblings of the leaves ``first`` to ``first + len(leaves)`` of one tree, from these and the nodes next to them."""

    def __init__(self, leaves: list[bytes], first: int, n: int, fanout: int, beside: dict[tuple[int, int], bytes], above: list[tuple[int, list[bytes]]]) -> None:
        self.first, self.k, self.sizes, self.above = first, fanout, level_sizes(n, fanout), above
        self.levels: list[dict[int, bytes]] = []
        here = dict(enumerate(leaves, first))
        for level, size in enumerate(self.sizes):
            low, high = min(here), max(here)
            for idx in [*range(low // fanout * fanout, low), *range(high + 1, min(size, high // fanout * fanout + fanout))]:
                here[idx] = beside[level, idx]
            self.levels.append(here)
            if size > 1:
                here = {p: h([here[i] for i in range(p * fanout, min(size, p * fanout + fanout))]) for p in range(low // fanout, high // fanout + 1)}
        self._rest: tuple[int, list] = (-1, [])

    def of(self, idx: int) -> list[tuple[int, list[bytes]]]:
        """(place of the path's node among the run, the run's others) for each level from leaf ``idx`` to the root of all."""
        parent = idx // self.k
        if self._rest[0] != parent:
            steps, at = [], parent
            for level in range(1, len(self.sizes) - 1):
                steps.append(self._beside(level, at))
                at //= self.k
            self._rest = (parent, steps + self.above)
        return ([self._beside(0, idx)] if len(self.sizes) > 1 else []) + self._rest[1]

    def _beside(self, level: int, idx: int) -> tuple[int, list[bytes]]:
        first = idx // self.k * self.k
        here = self.levels[level]
        return idx - first, [here[i] for i in range(first, min(self.sizes[level], first + self.k)) if i != idx]


def fold(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for place, others in path:
        leaf = h([*others[:place], leaf, *others[place:]])
    return leaf


_PROOF = "array<struct<place: int, others: array<binary>>>"


def _needs(m: Manifest) -> DataFrame:
    """(part, grp, level, idx) of the nodes beside each part's own."""
    k, levels = m.fanout, F.sequence(F.lit(0), _height(F.col("total"), m.fanout))
    each = m.spans.select("part", "grp", "first", "n", "total", F.explode(levels).alias("level"))
    # Integer division on exact whole numbers: powers of the fanout stay far below 2^62 at these levels.
    power = F.element_at(F.array(*[F.lit(min(k**x, 1 << 62)).cast("bigint") for x in range(64)]), F.col("level") + 1)
    at = each.select("part", "grp", "level", F.expr("first").alias("first"), (F.col("first") + F.col("n") - 1).alias("last"), "total", power.alias("w"))
    low, high = F.expr("first div w"), F.expr("last div w")
    at = at.select("part", "grp", "level", low.alias("low"), high.alias("high"), F.expr("(total + w - 1) div w").alias("size"))
    left = F.when(F.expr(f"low % {k}") > 0, F.sequence(F.expr(f"low - low % {k}"), F.expr("low - 1"))).otherwise(F.array().cast("array<bigint>"))
    until = F.least(F.col("size"), F.expr(f"high - high % {k} + {k}"))
    right = F.when(until > F.col("high") + 1, F.sequence(F.col("high") + 1, until - 1)).otherwise(F.array().cast("array<bigint>"))
    return at.select("part", "grp", "level", F.explode(F.concat(left, right)).alias("idx"))


def prove(m: Manifest, above: DataFrame | None = None, changed: str | None = None, keep: bool = False) -> DataFrame:
    """(grp, id, leaf, subroot, root, proof_sha256, folded) of every leaf as hex, and with ``keep`` its ``proof``.

    ``above`` has (grp, root, proof) of each group in the tree over the groups; without it a group's own root ends the path. ``folded`` is the root
    that the column ``changed`` of the leaves (32 bytes; null: the leaf itself) gives with the leaf's siblings, recomputed for every leaf.
    """
    fanout = m.fanout
    id_kind = dict(m.leaves.dtypes)["id"]
    tops = m.roots.select("grp", F.col("hash").alias("subroot"))
    if above is None:
        tops = tops.select("grp", "subroot", F.col("subroot").alias("root"), F.lit(None).cast(_PROOF).alias("proof"))
    else:
        tops = tops.join(above.select("grp", "root", "proof"), "grp")
    none = lambda kind: F.lit(None).cast(kind)
    beside = _needs(m).join(m.edges.distinct(), ["grp", "level", "idx"]).groupBy("part", "grp").agg(F.collect_list(F.struct("level", "idx", "hash")).alias("beside"))
    heads = m.spans.join(beside, ["part", "grp"], "left").join(tops, "grp")
    heads = heads.select("part", "grp", F.lit(-1).cast("bigint").alias("pos"), none(id_kind).alias("id"), none("binary").alias("hash"), none("binary").alias("changed"), "first", "total", "beside", "subroot", "root", "proof")
    bodies = m.leaves.select("part", "grp", "pos", "id", "hash", (F.col(changed) if changed else none("binary")).alias("changed"), *[none(kind).alias(c) for c, kind in heads.dtypes[6:]])
    names = ["grp", "id", "leaf", "subroot", "root", "proof_sha256", "folded", *(["proof"] if keep else [])]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rows, kinds = None, [], None

        def told() -> Iterator[pa.RecordBatch]:
            side = {(x["level"], x["idx"]): x["hash"] for x in head["beside"] or ()}
            above_path = [(x["place"], x["others"]) for x in head["proof"] or ()]
            paths = Paths([r[1] for r in rows], head["first"], head["total"], fanout, side, above_path)
            subroot, root = head["subroot"].hex(), head["root"].hex()
            for low in range(0, len(rows), 2000):
                out = []
                for k, (who, leaf, other) in enumerate(rows[low : low + 2000], head["first"] + low):
                    path = paths.of(k)
                    proof = hashlib.sha256("".join([d.hex() for _, others in path for d in others]).encode()).hexdigest()
                    folded = fold(leaf if other is None else other, path).hex()
                    out.append((head["grp"], who, leaf.hex(), subroot, root, proof, folded, *([[{"place": p, "others": o} for p, o in path]] if keep else [])))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            if kinds is None:
                proof_kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.binary()))]))
                kinds = [pa.string(), batch.schema.field("id").type, *[pa.string()] * 5, *([proof_kind] if keep else [])]
            lists = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for k, first in enumerate(lists["first"]):
                if first is not None:
                    if rows:
                        yield from told()
                    head, rows = {c: v[k] for c, v in lists.items()}, []
                else:
                    rows.append((lists["id"][k], lists["hash"][k], lists["changed"][k]))
        if rows:
            yield from told()

    schema = f"grp string, id {id_kind}, leaf string, subroot string, root string, proof_sha256 string, folded string" + (f", proof {_PROOF}" if keep else "")
    return heads.union(bodies).repartition("part").sortWithinPartitions("part", "grp", "pos").mapInArrow(walk, schema)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, changed: Column | None = None, keep: bool = False) -> tuple[Manifest, Manifest, DataFrame]:
    """The trees by group, the tree over the groups' roots, and the proofs of all rows (see ``prove``).

    ``changed`` is the leaf (hex) that a row is checked with instead of its own, null for its own.
    """
    made = field_hash([F.col(f) for f in fields])
    source = docs.select(group_key(F.col(group_col)).alias("grp"), F.col(id_col).alias("id"), F.unhex(made).alias("hash"), (F.unhex(changed) if changed is not None else F.lit(None).cast("binary")).alias("changed"))
    # Written first, as the range exchange reads its rows twice: texts are read and hashed once.
    below = build(written(source, "manifest-rows"), fanout)
    top = build(below.roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "hash"), fanout)
    above = written(prove(top, keep=True).select(F.col("id").alias("grp"), F.unhex("root").alias("root"), "proof"), "manifest-above")
    return below, top, prove(below, above, "changed", keep)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, each proof checked with a leaf whose text may have lost its line ends; rows without doc_id aren't tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    tampered = fresh(docs, "tampered")
    docs = docs.withColumn(tampered, F.replace("text", F.lit("\n"), F.lit("")))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even, field_hash([F.col(tampered if f == "text" else f) for f in FIELDS]))
    _, _, proofs = manifest(docs, changed=changed)
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _oracle() -> str:
    def item(c: str) -> str:
        return f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(item(text if f == "text" else f) for f in FIELDS) + "))"

    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(k AS BIGINT))), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""
    climb = lambda name, base: f"""{name} AS (SELECT grp, 0 AS level, idx, hash, n FROM {base} UNION ALL
    SELECT grp, level + 1, idx // {FANOUT}, sha256(string_agg(hash, '' ORDER BY idx)), (n + {FANOUT - 1}) // {FANOUT} FROM {name} WHERE n > 1 GROUP BY grp, level, idx // {FANOUT}, n)"""
    paths = lambda name, base, tree: f"""{name} AS (SELECT id, grp, idx, idx AS at, 0 AS level, n, '' AS proof, changed AS folded FROM {base} UNION ALL
    SELECT p.id, p.grp, p.idx, p.at // {FANOUT}, p.level + 1, (p.n + {FANOUT - 1}) // {FANOUT}, concat(p.proof, coalesce(s.before, ''), coalesce(s.after, '')), sha256(concat(s.before, p.folded, s.after))
    FROM {name} p JOIN {tree}_sides s ON s.grp IS NOT DISTINCT FROM p.grp AND s.level = p.level AND s.idx = p.at WHERE p.n > 1)"""
    sides = lambda tree: f"""{tree}_sides AS (SELECT a.grp, a.level, a.idx, string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx) AS before, string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx) AS after
    FROM {tree} a LEFT JOIN {tree} b ON b.grp IS NOT DISTINCT FROM a.grp AND b.level = a.level AND b.idx // {FANOUT} = a.idx // {FANOUT} AND b.idx <> a.idx GROUP BY ALL)"""
    return f"""WITH RECURSIVE rows AS (SELECT doc_id, source, {leaf("text")} AS hash, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS changed FROM documents),
    leaves AS (SELECT row_number() OVER () AS id, doc_id, source AS grp, hash, changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM rows),
    {climb("low", "leaves")}, {sides("low")},
    subroots AS (SELECT grp AS id, hash, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, 0 AS grp FROM low WHERE n = 1),
    {climb("high", "subroots")}, {sides("high")},
    {paths("low_paths", "leaves", "low")},
    tops AS (SELECT l.id, s.grp, s.idx, s.n, l.folded AS changed, l.proof FROM low_paths l JOIN subroots s ON s.id IS NOT DISTINCT FROM l.grp WHERE l.n = 1),
    {paths("high_paths", "tops", "high")}
    SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, r.hash AS root, sha256(concat(t.proof, h.proof)) AS proof_sha256, h.folded AS folded_root, h.folded = r.hash AS verified
    FROM leaves l JOIN tops t USING (id) JOIN high_paths h ON h.id = l.id AND h.n = 1 JOIN subroots s ON s.id IS NOT DISTINCT FROM l.grp JOIN (SELECT hash FROM high WHERE n = 1) r ON true"""


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": _oracle()}
