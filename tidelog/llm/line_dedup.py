"""Line dedup: a once-seen and a twice-seen Bloom filter; only suspected repeats are shuffled for exact confirmation.

1. Each partition hashes the keys of its lines (one per key and document) and sends, for each of the two hash functions,
   the filter positions it set, with a mark where it set one more than once: pre-aggregated, four bytes a position.
2. Positions are merged by filter segment. A position set by two documents is in the twice-seen filter, so a key that
   occurs in two documents has both its positions there: no repeat is missed. The merged segments are written to the shared folder
   as lists of positions, or as bits where those are shorter; the driver reads them a partition at a time and folds them to sixteen
   bits per position in use, at most ``2 ** FILTER_BITS`` bits (128 MB), which bounds the broadcast at any input size; far beyond
   2 ** FILTER_BITS distinct lines it rules out fewer of them, and more are shuffled.
3. Only keys that the filter suspects are digested (128-bit BLAKE2b), counted per partition and shuffled; counts at or
   above ``min_docs`` confirm the repeat, and the smallest document id is its first occurrence.
4. Confirmed digests are broadcast if there are at most ``BROADCAST_KEYS`` of them; beyond that they are joined to the
   suspected lines and to the documents by key.

A key is the line with white space [\\x20\\x09-\\x0D] stripped and A-Z lower-cased. Null and empty texts are one empty line,
and keys under ``min_chars`` code points are never dropped. Every row counts as a document, repeated rows too. With
``keep="first"`` the line stays in the document with the smallest id (null ids last), at its first place there; rows that
share an id and hold the line all keep it. Other columns pass through untouched whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_batches, discard, fresh, read_table, written

FILTER_BITS = 30
SEGMENT_BITS = 18
BROADCAST_KEYS = 400_000
_SPACE = b" \t\n\x0b\x0c\r"
_FLUSH = 4_000_000


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def key_of(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def positions(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def digest_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def segment_bytes(twice: np.ndarray) -> bytes:
    """A segment's set places, four bytes each, or all its bits where those take fewer bytes."""
    at = np.flatnonzero(twice).astype(np.uint32)
    return at.tobytes() if at.nbytes < len(twice) // 8 else np.packbits(twice).tobytes()


def segment_bits(data: bytes) -> np.ndarray:
    """The packed bits of what ``segment_bytes`` gives."""
    if len(data) == (1 << SEGMENT_BITS) // 8:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(1 << SEGMENT_BITS, bool)
    bits[np.frombuffer(data, np.uint32)] = True
    return np.packbits(bits)


def twice_filter(docs: DataFrame, text_col: str, min_chars: int) -> tuple[np.ndarray, int]:
    """The twice-seen filter as packed bits, and its size as a power of two."""

    def segments(hashes: list[int]) -> Iterator[pa.RecordBatch]:
        both = positions(np.array(hashes, np.uint64))
        spots, times = np.unique(np.concatenate(both), return_counts=True)
        low = (spots & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.uint32) | ((times > 1).astype(np.uint32) << np.uint32(31))
        which = (spots >> np.uint64(SEGMENT_BITS)).astype(np.int32)
        names, starts = np.unique(which, return_index=True)
        parts = [x.tobytes() for x in np.split(low, starts[1:])] if len(names) else []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], names=["segment", "spots"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, held = xxhash.xxh3_64_intdigest, []
        for batch in batches:
            for text in batch.column(0):
                held += [h(k) for k in {key_of(x) for x in lines_of(text.as_py())} if _long_enough(k, min_chars)]
                if len(held) > _FLUSH:
                    yield from segments(held)
                    held = []
        yield from segments(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        once, twice = np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([int(twice.sum())], pa.int64()), pa.array([segment_bytes(twice)], pa.binary())], names=["segment", "n", "bits"])

        for batch in batches:
            for segment, spots in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if segment != now:
                    if now is not None:
                        yield out()
                    now = segment
                    once[:] = twice[:] = False
                marks = np.frombuffer(spots.as_buffer(), np.uint32)
                at = marks & np.uint32((1 << SEGMENT_BITS) - 1)
                twice[at] |= once[at] | (marks >> np.uint32(31)).astype(bool)
                once[at] = True
        if now is not None:
            yield out()

    sent = docs.select(text_col).mapInArrow(seen, "segment int, spots binary")
    merged = written(sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, n bigint, bits binary").where("n > 0"), "line-filter")
    used = merged.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER_BITS, max(SEGMENT_BITS, (16 * used).bit_length()))
    folded = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << SEGMENT_BITS) // 8
    for r in merged.toLocalIterator():
        at = (r.segment << SEGMENT_BITS) % (1 << bits) // 8
        folded[at : at + size] |= segment_bits(r.bits)
    discard(merged)
    return folded, bits


class Suspects:
    """Keys that the broadcast twice-seen filter cannot rule out."""

    def __init__(self, broadcast, bits: int, min_chars: int) -> None:
        self.broadcast, self.bits, self.min_chars = broadcast, bits, min_chars

    def of(self, keys: list[bytes]) -> set[bytes]:
        """Those of the keys that may occur in two documents."""
        if not keys:
            return set()
        packed = self.broadcast.value
        mask = np.uint64((1 << self.bits) - 1)
        hit = np.ones(len(keys), bool)
        for p in positions(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)):
            p = p & mask
            hit &= (packed[(p >> np.uint64(3)).astype(np.intp)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
        return {k for k, x in zip(keys, hit.tolist(), strict=True) if x and _long_enough(k, self.min_chars)}


def confirmed(docs: DataFrame, suspects: Suspects, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    """(digest, first): keys found in at least ``min_docs`` documents and the smallest id among those."""
    kind = dict(docs.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], ids)], names=["digest", "n", "first"])

        ids = None
        for batch in batches:
            ids = batch.schema.field(0).type
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for key in suspects.of(list({key_of(x) for x in lines_of(text.as_py())})):
                    if (had := held.get(d := digest_of(key))) is None:
                        held[d] = [1, who]
                    else:
                        had[0] += 1
                        if who is not None and (had[1] is None or who < had[1]):
                            had[1] = who
            if len(held) > 100_000:
                yield out()
                held = {}
        if ids is not None:
            yield out()

    counts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"digest binary, n bigint, first {kind}")
    return counts.groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_docs).select("digest", "first")


STRIPPED = "n_lines bigint, n_dropped bigint, kept string"


def _strip(text: str | None, who, repeats: dict[bytes, object], suspects: Suspects, keep_first: bool) -> tuple[int, int, str]:
    lines = lines_of(text)
    keys = [key_of(x) for x in lines]
    drop = {}
    for key in suspects.of(list(set(keys))):
        if (d := digest_of(key)) in repeats:
            drop[key] = keep_first and repeats[d] == who
    if not drop:
        return len(lines), 0, text or ""
    kept, stays = [], {k for k, first in drop.items() if first}
    for line, key in zip(lines, keys, strict=True):
        if key not in drop:
            kept.append(line)
        elif key in stays:
            stays.discard(key)
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none", broadcast_keys: int = BROADCAST_KEYS, drop_text: bool = False, name: str = "stripped") -> DataFrame:
    """``docs`` with a struct column ``name`` (n_lines, n_dropped, kept) after the others, which stay as they are.

    ``drop_text`` leaves the input's text out of the result.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    spark = docs.sparkSession
    bounded_batches(spark)
    packed, bits = twice_filter(docs, text_col, min_chars)
    suspects = Suspects(spark.sparkContext.broadcast(packed), bits, min_chars)
    repeats = written(confirmed(docs, suspects, id_col, text_col, min_docs), "line-repeats")
    n = repeats.count()
    keep_first = keep == "first"
    carried = docs.drop(text_col) if drop_text else docs
    rest = F.struct(*[carried[c] for c in carried.columns]) if carried.columns else F.struct(F.lit(0).alias("_"))
    base = docs.select(rest.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    row_type = base.schema["row"].dataType.simpleString()

    if n <= broadcast_keys:
        known = spark.sparkContext.broadcast({bytes(r.digest): r.first for r in repeats.toLocalIterator()})

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [_strip(t.as_py(), who, known.value, suspects, keep_first) for who, t in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
                yield _done(batch, done)

        out = base.mapInArrow(strip, f"row {row_type}, {STRIPPED}")
    else:
        mark = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("mark")
        base = base.withColumn("mark", mark)

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks, digests = [], []
                for m, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for key in suspects.of(list({key_of(x) for x in lines_of(t.as_py())})):
                        marks.append(m)
                        digests.append(digest_of(key))
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(digests, pa.binary())], names=["mark", "digest"])

        lists = base.select("mark", "text").mapInArrow(lines, "mark string, digest binary").distinct().join(repeats, "digest").groupBy("mark").agg(F.collect_list(F.struct("digest", "first")).alias("known"))

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [_strip(t.as_py(), who, {x["digest"]: x["first"] for x in known or ()}, suspects, keep_first) for who, t, known in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)]
                yield _done(batch, done)

        out = base.join(lists, "mark", "left").select("row", "id", "text", "known").mapInArrow(strip, f"row {row_type}, {STRIPPED}")
    return out.select(*[F.col("row").getField(c).alias(c) for c in carried.columns], F.struct("n_lines", "n_dropped", "kept").alias(name))


def _done(batch: pa.RecordBatch, done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.string())], names=["row", "n_lines", "n_dropped", "kept"])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs, min_docs=10, min_chars=1, drop_text=True)
    return out.select("doc_id", "stripped.n_lines", "stripped.n_dropped", F.sha2("stripped.kept", 256).alias("kept_sha256"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay once, in the first document that holds them. No document goes, though it may end up empty."""
    name = fresh(docs, "stripped")
    out = drop_repeated_lines(docs, min_docs=10, min_chars=1, keep="first", name=name)
    cut, kept = F.col(name)["n_dropped"] > 0, F.col(name)["kept"]
    text = F.when(cut, kept).otherwise(F.col("text"))
    chars = F.when(cut, F.length(kept).cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": chars}).drop(name)


_LINES = r"""
WITH lines AS (
  SELECT doc_id, row_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS place
  FROM (SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS row_id FROM documents)),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeats AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row_id) >= 10)
"""

ORACLE = (
    _LINES
    + """
SELECT doc_id, count(*) AS n_lines, count(r.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE r.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN repeats r USING (k) GROUP BY doc_id, row_id
"""
)

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": ORACLE}
