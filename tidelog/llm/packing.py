"""Bounded-space online packing of tokenized documents into windows of a power-of-two size.

Each partition keeps at most ``open_windows`` windows. A document's ids (closed by ``end_id``) first fill whole windows of
their own; the rest goes to the open window it fits best, else to a new window, else its head tops up the fullest window,
which is emitted, and the rest is placed again. What stays open at a partition's end is merged over a tree of
``FAN_IN`` partitions a step, each step leaving one open window; the last one is cut into sequences whose lengths are
powers of two, so that no sequence needs padding. Only open windows carry their ids from step to step: a task of the tree reads at most
FAN_IN * open_windows windows whatever the input, and closed sequences are never shuffled.

Null and empty texts are the single id ``end_id``. Null and repeated doc_ids are packed like others, every row for itself.
An empty table gives no rows. Texts are tokenized whole. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import keyed_runs, read_table, slices, written

WINDOW = 2048
END_ID = 1
FAN_IN = 64
TOKENIZER = "word_bpe_49k.json"
#: The tokenizer's own cuts; chunks of other letters than Latin ones, or with a letter that lower-cases to two, are left to it.
_CUT = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^ \p{L}\p{N}]+)"
_SPACES = "[\u0085\u00a0]"
_HARD = r"[^\x00-\x{24F}]|\x{130}|<\|"
#: The tokenizer's model sees bytes as characters: printable ones of Latin-1 as they are, the others from U+0100 on.
_UNSEEN = re.compile("[\x00-\x09\x0b-\x20\x7f-\xa0\xad]")
_BYTE_CHARS = {chr(x): chr(256 + k) for k, x in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class Tokens:
    """The ids of a lower-casing word BPE tokenizer as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its chunks between
    white space, and a chunk of Latin letters, digits and signs is the ids of its pieces, which go straight to the
    tokenizer's model. Texts are cut by columns: each distinct chunk is cut once, each distinct piece looked up once. Ids of
    pieces are kept in a cache of two generations: a full one becomes the old one.
    """

    def __init__(self, path: str, most: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct lower-cased pieces."""
        young, old = self.young, self.old
        young[""] = b""
        out = list(map(young.get, pieces))
        unknown = [p for p, ids in zip(pieces, out, strict=True) if ids is None]
        new = [p for p in unknown if p not in old]
        young.update((p, old[p]) for p in (unknown if len(new) < len(unknown) else ()) if p in old)
        if new:
            seen = "\n".join(new).encode().decode("latin-1")
            seen = _UNSEEN.sub(lambda m: _BYTE_CHARS[m[0]], seen)
            model = self.tokenizer.model
            young.update(zip(new, [array("I", [t.id for t in model.tokenize(x)]).tobytes() for x in seen.split("\n")], strict=True))
        if unknown:
            out = list(map(young.get, pieces))
        if len(young) > self.most:
            self.old, self.young = young, {}
        return out

    def chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk."""
        hard = pc.match_substring_regex(chunks, _HARD)
        plain = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(hard, "", chunks)), _SPACES, " ")
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _CUT, r" \1 "))
        pieces = lists.flatten().dictionary_encode()
        out = _joined(pa.array(self.pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices), lists)
        if pc.any(hard).as_py():
            out = pc.replace_with_mask(out, hard, pa.array([self.whole(x) for x in chunks.filter(hard).to_pylist()], pa.large_binary()))
        return out

    def of(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, null ones as empty."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = lists.flatten().dictionary_encode()
        return _joined(self.chunks(words.dictionary).take(words.indices), lists).to_pylist()


def _joined(values: pa.Array, lists: pa.Array) -> pa.Array:
    """The values of each list in one: they lie side by side."""
    if not len(values):
        return pa.array([b""] * len(lists), pa.large_binary())
    _, offsets, data = values.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(values) + 1)[np.asarray(lists.offsets)]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(cuts), data if data is not None else pa.py_buffer(b"")])


class Packer:
    """Open windows of pieces (id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int) -> None:
        self.window, self.most = window, open_windows
        self.open: list[tuple[int, list]] = []

    def place(self, who, start: int, ids: bytes, doc_tokens: int) -> Iterator[list]:
        size = self.window
        at, end = 0, len(ids) // 4
        while end - at >= size:
            yield [(who, start + at, ids[4 * at : 4 * (at + size)], doc_tokens)]
            at += size
        while at < end:
            rest = end - at
            best = fullest = None
            for i, (used, _) in enumerate(self.open):
                if used + rest <= size and (best is None or used > self.open[best][0]):
                    best = i
                if fullest is None or used > self.open[fullest][0]:
                    fullest = i
            if best is None and len(self.open) < self.most:
                self.open.append((0, []))
                best = len(self.open) - 1
            i = fullest if best is None else best
            used, pieces = self.open[i]
            take = min(rest, size - used)
            pieces.append((who, start + at, ids[4 * at : 4 * (at + take)], doc_tokens))
            at += take
            if used + take == size:
                self.open.pop(i)
                yield pieces
            else:
                self.open[i] = (used + take, pieces)

    def settle(self) -> Iterator[list]:
        """Pour the emptiest windows into the others until one is left."""
        while len(self.open) > 1:
            self.open.sort(key=lambda x: -x[0])
            used, pieces = self.open.pop()
            self.most = len(self.open)
            for piece in pieces:
                yield from self.place(*piece)


def powers(pieces: list) -> Iterator[list]:
    """One window's pieces cut into sequences whose lengths are powers of two."""
    total = sum(len(p[2]) // 4 for p in pieces)
    room, out = 0, []
    for who, start, ids, doc_tokens in pieces:
        at, end = 0, len(ids) // 4
        while at < end:
            if not room:
                if out:
                    yield out
                room, out = 1 << (total.bit_length() - 1), []
                total -= room
            take = min(room, end - at)
            out.append((who, start + at, ids[4 * at : 4 * (at + take)], doc_tokens))
            at, room = at + take, room - take
    if out:
        yield out


class _Rows:
    def __init__(self, ids_type: pa.DataType, keep_ids: bool) -> None:
        self.ids_type, self.keep_ids, self.rows = ids_type, keep_ids, []

    def add(self, sequence: int, pieces: list, part: int | None = None) -> None:
        offset = 0
        for who, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((who, start, n, zlib.crc32(ids), doc_tokens, sequence, offset, part, ids if self.keep_ids or part is not None else None))
            offset += n

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 9
        self.rows = []
        kinds = [self.ids_type, *[pa.int64()] * 6, pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = 16, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, ids."""
    if window & (window - 1) or not 0 < window <= 1 << 20:
        raise ValueError("window must be a power of two")
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, part int, ids binary"
    closing = np.array([end_id], "<u4").tobytes()

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokens, packer, n, rows = Tokens(tokenizer_path), Packer(window, open_windows), 0, None
        for batch in (piece for whole in batches for piece in slices(whole, "text", 6_000_000)):
            rows = rows or _Rows(batch.schema.field(0).type, keep_ids)
            for who, own in zip(batch.column(0).to_pylist(), tokens.of(batch.column(1)), strict=True):
                ids = own + closing
                for done in packer.place(who, 0, ids, len(ids) // 4):
                    rows.add((part << 32) + n, done)
                    n += 1
                if len(rows.rows) > (2_000 if keep_ids else 50_000):
                    yield rows.batch()
        if rows:
            for _, pieces in packer.open:
                rows.add((part << 32) + n, pieces, part)
                n += 1
            yield rows.batch()

    now = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(online, schema), "packing")
    closed = [now.where("part is null")]
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        last = parts <= FAN_IN

        def merge(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            for group, table in keyed_runs(batches, "group"):
                rows = _Rows(table.schema.field("doc_id").type, keep_ids)
                packer, n, base = Packer(window, open_windows), 0, (level << 58) + (int(group) << 32)
                cols = [table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
                for piece in zip(*cols, strict=True):
                    for done in packer.place(*piece):
                        rows.add(base + n, done)
                        n += 1
                for done in packer.settle():
                    rows.add(base + n, done)
                    n += 1
                for _, pieces in packer.open:
                    for done in powers(pieces) if last else [pieces]:
                        rows.add(base + n, done, None if last else int(group))
                        n += 1
                yield rows.batch()

        left = now.where("part is not null").withColumn("group", F.floor(F.col("part") / FAN_IN).cast("int"))
        now = written(left.repartition("group").sortWithinPartitions("group", "part", "sequence_id", "offset").mapInArrow(merge, schema), "packing-merge")
        closed.append(now.where("part is null"))
        parts = -(-parts // FAN_IN)
        if last:
            break
    out = closed[0]
    for more in closed[1:]:
        out = out.union(more)
    return out.drop("part") if keep_ids else out.drop("part", "ids")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
