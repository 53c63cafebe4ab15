"""Exact token counts of every prefix of a text by dynamic programming over a byte-pair vocabulary.

The encoding of a prefix is that of a shorter prefix and one more piece: the one ending there that the piece before it lets stand, which is
so if the two, encoded together, are the two again. There is exactly one such piece, so a table of the last piece and the count at
each prefix is filled from left to right, without encoding any prefix. What one piece follows is kept in a table of pairs; a pair that is not in it
is merged by the vocabulary's scores (highest first, leftmost among equal ones), which touches a few characters only.

A space is the vocabulary's space sign, and one stands before the text. Pieces hold that sign only at their start, and a character that the vocabulary
lacks is written in its UTF-8 bytes and joins with nothing; so texts are cut before runs of the sign and around line ends, and the
table of a cut stretch is kept for the next time it is met (``MOST`` stretches, in two generations).

``counts`` keeps, for each code point, by how much the count of the prefix that ends with it differs from the prefix before (one signed byte: a longer
prefix can have fewer tokens); ``tokens_at`` and ``longest_prefix`` answer from that store without the text or the tokenizer.

Null and empty texts have no tokens and an empty store. Whole texts are read, however long, one slice of a batch at a time; a stretch without
spaces is filled in one go, at some 100 bytes a character. Repeated rows and null ids are counted like any others, and there is nothing that ties could
change. An empty table gives no rows. Only ``id_col`` and ``text_col`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import read_table, slices

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
MOST = 200_000
_STRETCH = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Prefixes:
    """Prefix tables over one vocabulary: ``scores`` gives each piece its score."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.pieces = list(scores)
        #: A tree of the pieces' characters: each node is its branches and the number of the piece that ends there, -1 if none does.
        self.tree: tuple[dict, int] = ({}, -1)
        for number, piece in enumerate(self.pieces):
            node = self.tree
            for c in piece[:-1]:
                node = node[0].setdefault(c, ({}, -1))
            node[0][piece[-1]] = (node[0].get(piece[-1], ({}, -1))[0], number)
        #: Whether a piece may follow another one (or none, which is the number after the last), by both numbers.
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _stands(self, left: int, right: int) -> bool:
        """Whether the two pieces side by side are encoded as themselves."""
        if len(self.pairs) > 4 * MOST:
            self.pairs.clear()
        own = self.pieces[left : left + 1] + [self.pieces[right]]
        known = self.pairs[left << 32 | right] = self.merged("".join(own)) == own
        return known

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text, the plain way."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def table(self, stretch: str) -> bytes:
        """Changes of the count, a signed byte for each character."""
        pairs, tree, none, n = self.pairs, self.tree, len(self.pieces), len(stretch)
        # The last piece of each prefix, once it is known, and the count.
        last, counts = [none] + [-1] * n, [0] * (n + 1)
        for start in range(n):
            before, count, branches = last[start], counts[start] + 1, tree[0]
            for end in range(start, n):
                node = branches.get(stretch[end])
                if node is None:
                    break
                branches, piece = node
                if piece >= 0 and last[end + 1] < 0:
                    stands = pairs.get(before << 32 | piece)
                    if stands is None:
                        stands = self._stands(before, piece)
                    if stands:
                        last[end + 1], counts[end + 1] = piece, count
            if last[start + 1] < 0:
                # No piece ends here: a character that the vocabulary lacks.
                last[start + 1], counts[start + 1] = none, count - 1 + len(stretch[start].encode())
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])

    def of(self, text: str) -> bytes:
        """Changes of the count over the text, a signed byte for each code point."""
        if not text:
            return b""
        stretches = _STRETCH.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.young.get, stretches))
        if None in found:
            for k, known in enumerate(found):
                if known is None:
                    found[k] = self._kept(stretches[k])
        joined = b"".join(found)
        # The sign before the text is a part of its first prefix.
        return bytes([(joined[0] + joined[1]) & 255]) + joined[2:]

    def _kept(self, stretch: str) -> bytes:
        known = self.young.get(stretch)
        if known is None:
            known = self.old.get(stretch) or self.table(stretch)
            if len(stretch) <= 64:
                self.young[stretch] = known
        if len(self.young) > MOST:
            self.young, self.old = {}, self.young
        return known


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Prefixes:
    """Prefix tables over a SentencePiece model with byte fallback; a Python worker keeps them from task to task."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.vocab_size()) if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k))]
    return Prefixes({model.id_to_piece(k): model.get_score(k) for k in plain})


def running(changes: bytes) -> np.ndarray:
    """The count at each prefix of at least one code point."""
    return np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)


def counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, prefixes) of every row; ``prefixes`` is the store that questions are answered from."""
    kind = dict(docs.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary(tokenizer_path)
        for batch in (piece for whole in batches for piece in slices(whole, "text", 4_000_000)):
            stores = [tables.of(t or "") for t in batch.column("text").to_pylist()]
            totals = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in stores]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64()), pa.array(stores, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "prefixes"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text_col).alias("text"))
    return source.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, prefixes binary")


def longest_prefix(prefixes: str | Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from the store."""

    @F.pandas_udf("bigint")
    def fit(stores: pd.Series) -> pd.Series:
        def one(changes: bytes) -> int:
            fits = np.flatnonzero(running(changes) <= budget)
            return int(fits[-1]) + 1 if len(fits) else 0

        # A text of so few code points cannot exceed the budget: a code point is four tokens at most.
        return pd.Series([len(s) if 4 * len(s) <= budget - 1 else one(s) for s in stores], dtype="int64")

    return fit(prefixes)


def tokens_at(prefixes: str | Column, n_chars: str | Column) -> Column:
    """Tokens of the first ``n_chars`` code points (all, if there are fewer), from the store."""

    @F.pandas_udf("bigint")
    def at(stores: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(s[: max(0, int(k))], np.int8).sum(dtype=np.int64)) for s, k in zip(stores, places, strict=True)], dtype="int64")

    return at(prefixes, n_chars)


def truncated(docs: DataFrame, tokenizer_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens, in one pass over the texts; null texts stay null."""
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary(tokenizer_path)
        for batch in (piece for whole in batches for piece in slices(whole, text_col, 4_000_000)):
            texts = batch.column(text_col).to_pylist()
            fits = [np.flatnonzero(running(tables.of(t or "")) <= budget) for t in texts]
            short = [t if t is None else t[: int(f[-1]) + 1 if len(f) else 0] for t, f in zip(texts, fits, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.string()) if n == text_col else batch.column(n) for n in names], names=names)

    return docs.mapInArrow(cut, docs.schema)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, whether they exceed ``LIMIT`` tokens, and how many code points fit into it."""
    counted = counts(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), longest_prefix("prefixes", LIMIT).alias("fit_chars"))


QUERIES = {"op12_token_counts": op12_token_counts}
ORACLES: dict[str, str] = {}
