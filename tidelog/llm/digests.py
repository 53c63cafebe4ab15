"""Improbable-feature digests of documents: rare byte windows in chained Bloom filters.

The entropy of each 32-byte window is followed byte by byte with exact integers and put on a scale of 0 to 1000. How rare a
level is comes from a count over all windows of all documents; levels under ``LOW`` (runs of a byte, short periods) come
last. A window is selected if it is the rarest, leftmost one in at least ``WINS`` of the spans of ``SPAN`` windows that hold it.
If none wins so many, those with the most wins are selected, so that no text but the empty one is without a feature. Few wide windows fit a short text, so
texts under ``SHORT_BYTES`` have all their windows of ``NARROW`` bytes, in filters of their own.
Selected windows are hashed (XXH3, 128 bits) to five of 2048 bits; a filter takes ``PER_FILTER`` of them, then a new one is chained.
Likeness: each filter of the shorter chain meets the filter it overlaps most, as the part of the bits shared beyond
chance; the mean is weighted by features. Equal digests have likeness 1.

The next document is found by dealing texts, compressed, into ranges of (doc_id, hash of the text), which Spark's range exchange
finds over these two numbers; the head of each range also goes to the range before it, so every neighbour is met inside one task and
texts are shuffled once. Rows equal in both may fill several ranges: each but the last of them is then its own next. The driver
holds the first key of each range, at most about ``MOST_BUCKETS``.

Null texts are empty. An empty text has the empty digest, which is like itself (1) and nothing else (0); a text under 6 bytes
is one feature. Equal doc_ids are ordered by their texts' XXH64, null ones come last. A single document is its own next.
Whole texts are read, however long. An empty table gives no rows. Only ``id_col`` (integers) and ``text_col`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import blocks_of, read_table, slices

WINDOW = 32
LEVELS = 1001
LOW = 100
SPAN = 32
WINS = 8
#: Bytes from which texts have features of WINDOW bytes, and under which they have all those of NARROW bytes.
SHORT_BYTES = (128, 256)
NARROW = 6
PER_FILTER = 160
FILTER_BITS = 2048
BUCKET_BYTES = 24_000_000
MOST_BUCKETS = 100_000
_BLOCK = 1 << 18
_SCALE = 1 << 20
_F = np.array([0] + [round(k * math.log2(k) * _SCALE) for k in range(1, WINDOW + 2)], np.int64)
_DOWN = np.concatenate(([0], _F[:-1] - _F[1:]))  # from k to k - 1
_UP = _F[1:] - _F[:-1]  # from k to k + 1


def _block_levels(x: np.ndarray) -> np.ndarray:
    n = len(x)
    order = np.argsort(x, kind="stable").astype(np.int32)
    keys = x[order].astype(np.int32) * np.int32(2 * _BLOCK) + order
    t = np.arange(n, dtype=np.int32)
    ahead = np.empty(n, np.int32)
    ahead[order] = np.searchsorted(keys, keys + np.int32(WINDOW - 1), side="right").astype(np.int32) - t
    behind = np.empty(n, np.int32)
    behind[order] = t - np.searchsorted(keys, keys - np.int32(WINDOW - 1), side="left").astype(np.int32)
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = _F[np.bincount(x[:WINDOW], minlength=256)].sum()
    np.cumsum(_DOWN[ahead[: n - WINDOW]] + _UP[behind[WINDOW:]], out=sums[1:])
    sums[1:] += sums[0]
    # Entropy over its most, five bits, is 1 - sum / (32 * 5).
    return (1000 - (sums * 1000 + WINDOW * 5 * _SCALE - 1) // (WINDOW * 5 * _SCALE)).astype(np.int16)


def levels(x: np.ndarray) -> np.ndarray:
    """The entropy level of every window of the bytes."""
    if len(x) < WINDOW:
        return np.empty(0, np.int16)
    step = _BLOCK - WINDOW + 1
    return np.concatenate([_block_levels(x[at : at + _BLOCK]) for at in range(0, len(x) - WINDOW + 1, step)])


def rarity(counts: np.ndarray) -> np.ndarray:
    """The precedence of each level, the rarest first."""
    order = sorted(range(LEVELS), key=lambda k: (k < LOW, counts[k], k))
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    return out


def selected(ranks: np.ndarray) -> np.ndarray:
    """Places of the windows that win enough spans."""
    n = len(ranks)
    keys = (ranks << 40) + np.arange(n)
    if n <= SPAN:
        return np.array([int(keys.argmin())]) if n else np.empty(0, np.int64)
    padded = np.full(-(-n // SPAN) * SPAN, np.iinfo(np.int64).max)
    padded[:n] = keys
    grid = padded.reshape(-1, SPAN)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[: n - SPAN + 1], left[SPAN - 1 : n]) & ((1 << 40) - 1)
    cuts = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1], [True])))
    wins = np.diff(cuts)
    return best[cuts[:-1][wins >= min(WINS, int(wins.max()))]]


class Digest:
    """Chained filters: bits as an array of (filters, bytes) and features per filter."""

    def __init__(self, *kinds: list[bytes]) -> None:
        self.counts = np.array([min(PER_FILTER, len(features) - at) for features in kinds for at in range(0, len(features), PER_FILTER)], np.int64)
        bits = np.zeros((len(self.counts), FILTER_BITS), bool)
        first = 0
        for features in kinds:
            n = len(features)
            if n:
                hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(f) for f in features]), "<u2").reshape(n, 8)[:, :5] & (FILTER_BITS - 1)
                bits[(first + np.arange(n) // PER_FILTER)[:, None], hashes] = True
                first += -(-n // PER_FILTER)
        self.bits = np.packbits(bits, axis=1)

    def text(self) -> str:
        return "".join(f"{c:02x}{base64.b64encode(b.tobytes()).decode()}" for c, b in zip(self.counts.tolist(), self.bits, strict=True))


def likeness(a: Digest, b: Digest) -> float:
    if len(a.counts) > len(b.counts) or len(a.counts) == len(b.counts) and a.counts.sum() > b.counts.sum():
        a, b = b, a
    if not len(a.counts):
        return float(not len(b.counts))
    if a.bits.shape == b.bits.shape and (a.bits == b.bits).all():
        return 1.0
    mine, theirs = np.bitwise_count(a.bits).sum(axis=1, dtype=np.int64), np.bitwise_count(b.bits).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, own, n in zip(a.bits, mine.tolist(), a.counts.tolist(), strict=True):
        best = 0.0
        for at in range(0, len(theirs), 4096):
            shared = np.bitwise_count(b.bits[at : at + 4096] & row).sum(axis=1, dtype=np.int64)
            other = theirs[at : at + 4096]
            chance, most = own * other / FILTER_BITS, np.minimum(own, other)
            best = max(best, float(((shared - chance) / np.maximum(most - chance, 1e-9)).max()))
        total += max(0.0, min(1.0, best)) * n
    return total / float(a.counts.sum())


def digest(data: bytes, ranks: np.ndarray) -> Digest:
    n = len(data)
    # Texts between the two bounds have both kinds, so that an edit over a bound still meets its own kind.
    narrow = [data[p : p + NARROW] for p in range(n - NARROW + 1)] if NARROW <= n < SHORT_BYTES[1] else [data] if 0 < n < NARROW else []
    wide = [data[p : p + WINDOW] for p in selected(ranks).tolist()] if n >= SHORT_BYTES[0] else []
    return Digest(narrow, wide)


def level_counts(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Windows at each level and bytes of the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = np.zeros(LEVELS, np.int64), 0
        for batch in batches:
            for part in slices(batch, batch.schema.names[0], 1_000_000):
                datas = [(t.as_py() or "").encode() for t in part.column(0)]
                joined, places = joined_levels(datas)
                size += sum(map(len, datas))
                for a, b in places:
                    counts += np.bincount(joined[a:b], minlength=LEVELS)
        keep = np.flatnonzero(counts)
        rows = [*zip(keep.tolist(), counts[keep].tolist(), strict=True), (-1, size)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], names=["level", "n"])

    found = {r.level: r.n for r in docs.select(text_col).mapInArrow(count, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(k, 0) for k in range(LEVELS)], np.int64), found.get(-1, 0)


def joined_levels(datas: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Levels over the concatenated texts, and where each text's own windows lie."""
    joined = levels(np.frombuffer(b"".join(datas), np.uint8))
    ends = np.cumsum([len(d) for d in datas]).tolist()
    return joined, [(e - len(d), max(e - len(d), e - WINDOW + 1)) for d, e in zip(datas, ends, strict=True)]


def range_heads(keys: DataFrame, ranges: int) -> list[tuple]:
    """The first key (null, ~id, h) of each range of the keys (id, h) in falling order of id; a key that fills ranges is repeated."""
    order = [F.col("id").desc_nulls_last(), F.col("h").asc(), F.col("row").asc()]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1).select(["id", "h"])
                break
        for _ in batches:
            pass

    dealt = keys.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return sorted((r.id is None, ~r.id if r.id is not None else 0, r.h) for r in dealt.mapInArrow(first, "id bigint, h bigint").collect())


class _Doc:
    __slots__ = ("id", "text", "data", "ranks", "digest")

    def __init__(self, who, text: str, data: bytes, ranks: np.ndarray) -> None:
        self.id, self.text, self.data, self.ranks = who, text, data, ranks
        self.digest = digest(data, ranks)

    def edited(self, other: _Doc, rare: np.ndarray) -> tuple[bytes, Digest]:
        n = len(self.text)
        k = n // 3
        head, tail = self.text[: n - k].encode(), other.text[:k].encode()
        data = head + tail
        if len(data) < WINDOW:
            return data, digest(data, np.empty(0, np.int64))
        a, b = max(0, len(head) - WINDOW + 1), max(0, len(tail) - WINDOW + 1)
        seam = rare[levels(np.frombuffer(data[a : len(data) - b], np.uint8))]
        return data, digest(data, np.concatenate([self.ranks[:a], seam, other.ranks[:b]]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    counts, size = level_counts(source, "text")
    rare = spark.sparkContext.broadcast(rarity(counts))
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    heads = range_heads(source.select("id", h.alias("h")), blocks_of(size, max(BUCKET_BYTES, size // MOST_BUCKETS)))
    known = spark.sparkContext.broadcast(heads)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, heads, met = zstandard.ZstdCompressor(level=3), known.value, {}
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for i, h, text in zip(part.column("id").to_pylist(), part.column("h").to_pylist(), part.column("text"), strict=True):
                    key = (i is None, ~i if i is not None else 0, h)
                    left, right = bisect_left(heads, key), max(0, bisect_right(heads, key) - 1)
                    z = packer.compress((text.as_py() or "").encode())
                    at = right
                    if left < len(heads) and heads[left] == key:
                        n = met[key] = met.get(key, 0) + 1
                        if n == 1:
                            rows.append(((left or len(heads)) - 1, True, i, h, z))
                        # The first goes to the last range, so that one of them meets what comes after.
                        at = right - (n - 1) % (right - left + 1)
                    rows.append((at, False, i, h, z))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "guest", "id", "h", "z"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, table, heads = zstandard.ZstdDecompressor(), rare.value, known.value
        held: _Doc | None = None
        at = None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_OUT)

        def finish(doc: _Doc, other: _Doc) -> None:
            data, edited = doc.edited(other, table)
            rows.append((doc.id, len(doc.text), hashlib.sha256(data).hexdigest(), doc.digest.text(), edited.text(), likeness(doc.digest, edited), likeness(doc.digest, other.digest)))

        for batch in batches:
            for part in slices(batch, "z", 400_000):
                datas = [unpacker.decompress(z.as_py()) for z in part.column("z")]
                joined, places = joined_levels(datas)
                for (a, b), data, bucket, guest, who in zip(places, datas, part.column("bucket").to_pylist(), part.column("guest").to_pylist(), part.column("id").to_pylist(), strict=True):
                    if guest and (held is None or bucket != at):
                        continue
                    doc = _Doc(who, data.decode(), data, table[joined[a:b]])
                    if bucket != at:
                        if held is not None:
                            finish(held, held)
                        held, at = None, bucket
                    if held is not None:
                        finish(held, doc)
                    held = None if guest else doc
                yield out()
        # Only a range of equal rows, which ends without a guest, is left open.
        if held is not None:
            finish(held, held)
            yield out()

    dealt = source.withColumn("h", h).mapInArrow(deal, "bucket int, guest boolean, id bigint, h bigint, z binary").repartitionById(max(1, len(heads)), "bucket")
    sorted_rows = dealt.sortWithinPartitions(F.col("bucket"), F.col("guest"), F.col("id").desc_nulls_last(), F.col("h"))
    return sorted_rows.mapInArrow(walk, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_document_fingerprints": op10_document_fingerprints}
ORACLES: dict[str, str] = {}
