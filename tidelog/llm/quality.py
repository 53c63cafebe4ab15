"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other, then score together.

The content view sees which words a text holds: as written in lower case, as letters only, and as the first letters. The
metadata view sees language, source and layout counts (length, lines, words, letter cases, digits, signs, repeated words) in
quantile bins. Both are logistic regressions over features whose share differs between good and bad documents by ``Z_LEAST``
standard errors or more. In each round both views score all unlabelled documents, and those that one is ``SURE`` of (calibrated)
teach the other, unless that one holds the opposite to be likelier: their features are counted by label, and the log odds of the counts are where the weights of its regression start
and are drawn back to. Calibration and the combination are fitted on labelled documents kept apart.
A document is good if its quality is 1 and it is not toxic; ``kept`` is a combined probability of at least one half.

The regressions take at most about ``LABELLED`` labelled documents, chosen by a hash of doc_id, one row of each. Everything else, the exchange, the
quantiles and all scores, covers all documents and whole texts; features are made once, into a table in the shared folder.

Null texts are empty, null languages and sources are values of their own, labels with a null are not used, repeated rows are scored alike.
Without good or without bad labels, or with under ``LEAST_LABELS`` sampled labels, nothing is fitted: every document gets the share of good
labels (one half if none) and stays. An empty
table gives no rows. Extra columns pass through in ``classify`` whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_batches, discard, fresh, read_table, shared_dir, slices, written

#: Labels under which nothing is fitted: two views, each calibrated on a quarter held out, would reject documents on the word of a few.
LEAST_LABELS = 20
LABELLED = 15_000
BROADCAST_LABELS = 1_000_000
ROUNDS = 2
SURE = 0.995
#: A word has about four features; each takes its part of the log odds that it is taught.
PART = 0.25
TAUGHT_LEAST = 0.5
Z_LEAST = 3.5
SPACE_BITS = 18
SPACE = 1 << SPACE_BITS
_BASE = np.uint64(0x9E3779B97F4A7C15)
BINS = 12
_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_PLAIN = bytes(range(128, 256)) + _UPPER + _LOWER + _DIGIT + b" \t\n\x0b\x0c\r.,;:'\"!?()-"
#: For each byte whether it counts as upper case, digit, sign or loud.
_KINDS = np.array([[x in _UPPER for x in range(256)], [x in _DIGIT for x in range(256)], [x not in _PLAIN for x in range(256)], [x in b"!?" for x in range(256)]], np.int64)
NUMBERS = ("chars", "lines", "words", "upper", "digits", "signs", "loud", "length", "distinct", "stutter", "short_lines")


def _hashes(values: pa.Array, kind: int) -> np.ndarray:
    """Places of large strings in the content space: their bytes as the digits of a number in a fixed base, mixed."""
    at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint64)
    sizes = np.diff(at)
    full = sizes > 0
    powers = np.ones(int(sizes.max(initial=0)), np.uint64)
    np.cumprod(np.full(max(0, len(powers) - 1), _BASE), out=powers[1:])
    starts = (at[:-1] - at[0])[full]
    place = np.arange(len(data)) - np.repeat(starts, sizes[full])
    out = np.full(len(values), np.uint64(kind))
    if len(starts):
        out[full] += np.add.reduceat((data + np.uint64(1)) * powers[place], starts)
    out ^= out >> np.uint64(32)
    out *= _BASE
    out ^= out >> np.uint64(29)
    out *= _BASE
    return (out >> np.uint64(64 - SPACE_BITS)).astype(np.int64)


def token_features(tokens: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, starts): of each token itself, its letter runs and the first letters of longer ones; with weights, those that have one."""
    lower = pc.utf8_lower(tokens)
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, r"[^\p{L}]+", " "))
    runs = lists.flatten()
    whose = np.repeat(np.arange(len(tokens)), np.diff(np.asarray(lists.offsets)))
    size = pc.utf8_length(runs).to_numpy()
    rows, found = [np.arange(len(tokens)), whose[size > 0]], [_hashes(lower, 1), _hashes(runs, 2)[size > 0]]
    for n in (4, 5):
        long = size > n
        rows.append(whose[long])
        found.append(_hashes(pc.utf8_slice_codeunits(runs.filter(pa.array(long)), 0, n), n))
    row, feature = np.concatenate(rows), np.concatenate(found)
    if weights is not None:
        keep = weights[feature] != 0
        row, feature = row[keep], feature[keep]
    order = np.argsort(row, kind="stable")
    return feature[order], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(tokens)))))


def word_features(token: str) -> list[int]:
    """Places of a token's features in the content space."""
    return token_features(pa.array([token], pa.large_string()))[0].tolist()


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in rising order."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


class Texts:
    """Some texts by columns: the place of each text and the code of its distinct token, for every token between ASCII white space."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.ascii_split_whitespace(texts)
        every = lists.flatten().dictionary_encode()
        self.texts, self.n, self.tokens = texts, len(texts), every.dictionary
        self.lengths = pc.binary_length(every.dictionary).to_numpy()
        doc = np.repeat(np.arange(self.n), np.diff(np.asarray(lists.offsets)))
        code = every.indices.to_numpy().astype(np.int64)
        full = self.lengths[code] > 0
        self.doc, self.code = doc[full], code[full]
        # Each distinct token of each text.
        pairs = distinct((self.doc << 32) + self.code)
        self.pair_doc, self.pair_code = pairs >> 32, pairs & 0xFFFFFFFF

    def numbers(self) -> np.ndarray:
        """The numbers of the metadata view, a row a text."""
        total = lambda x: np.bincount(self.doc, weights=x[self.code], minlength=self.n)
        kinds = _KINDS[:, np.frombuffer(b"".join(self.tokens.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint8)]
        ends = np.cumsum(self.lengths)
        upper, digits, signs, loud = (total(np.diff(np.concatenate(([0], np.cumsum(k)))[np.concatenate(([0], ends))])) for k in kinds)
        size = pc.binary_length(self.texts).to_numpy().astype(float)
        words = np.bincount(self.doc, minlength=self.n)
        lines = [[len(x) < 40 for x in t.split(b"\n")] for t in self.texts.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]
        again = (self.doc[1:] == self.doc[:-1]) & (self.code[1:] == self.code[:-1])
        n, each, n_lines = np.maximum(1, size), np.maximum(1, words), np.array([len(x) for x in lines])
        return np.stack([
            np.log1p(size), np.log1p(n_lines), np.log1p(words), upper / n, digits / n, signs / n, loud / n, total(self.lengths) / each,
            np.bincount(self.pair_doc, minlength=self.n) / each, np.bincount(self.doc[1:][again], minlength=self.n) / each, np.array([sum(x) for x in lines]) / n_lines,
        ], axis=1)

    def features(self, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct features of each text in rising order, as (text, feature)."""
        flat, starts = token_features(self.tokens, weights)
        times = np.diff(starts)[self.pair_code]
        at = np.repeat(starts[self.pair_code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        found = distinct((np.repeat(self.pair_doc, times) << 32) + flat[at])
        return found >> 32, found & 0xFFFFFFFF


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Sparse rows of distinct features."""

    features: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, lists: list) -> Rows:
        return cls(np.concatenate([np.asarray(x, np.uint32) for x in lists]).view(np.int32) if lists else np.empty(0, np.int32), np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64))

    def blocks(self, most: int = 1 << 20) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """(rows, features, starts of the rows within them) of about ``most`` features, so that no copy is as long as all of them."""
        at = 0
        while at < len(self.starts) - 1:
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + most, side="right")) - 1)
            yield slice(at, to), slice(self.starts[at], self.starts[to]), self.starts[at : to + 1] - self.starts[at]
            at = to

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.starts) - 1)
        for rows, own, starts in self.blocks():
            # Adds each row by itself, so that its sum does not depend on the others.
            out[rows] = np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), weights=weights[self.features[own]], minlength=len(starts) - 1)
        return out

    def spread(self, values: np.ndarray, space: int) -> np.ndarray:
        """The sum of each feature's values over the rows that have it."""
        out = np.zeros(space)
        for rows, own, starts in self.blocks():
            out += np.bincount(self.features[own], weights=np.repeat(values[rows], np.diff(starts)), minlength=space)
        return out

    def take(self, which: np.ndarray) -> Rows:
        return Rows.of([self.features[self.starts[i] : self.starts[i + 1]] for i in which.tolist()])

    def only(self, chosen: np.ndarray) -> Rows:
        """The rows without features that are not chosen."""
        found, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for _, own, starts in self.blocks():
            features = self.features[own]
            keep = chosen[features]
            found.append(features[keep])
            sizes.append(np.diff(np.concatenate(([0], np.cumsum(keep)))[starts]))
        return Rows(np.concatenate(found), np.cumsum(np.concatenate(sizes)))

    @classmethod
    def unpacked(cls, column: pa.ChunkedArray) -> Rows:
        """Rows from packed features, filled in place."""
        sizes = pc.binary_length(column).to_numpy().astype(np.int64) // 4
        starts = np.concatenate(([0], np.cumsum(sizes)))
        features = np.empty(int(starts[-1]), np.int32)
        for k, steps in enumerate(column):
            np.cumsum(np.frombuffer(steps.as_buffer(), "<u4"), out=features[starts[k] : starts[k + 1]].view(np.uint32), dtype=np.uint32)
        return cls(features, starts)


@dataclass
class View:
    """Logistic regression over sparse presence features."""

    space: int
    least: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def prior(self, counts: np.ndarray) -> np.ndarray:
        """Weights from (bad, good) counts of each feature, the last place of each being the documents."""
        (b, n0), (a, n1) = ((x[:-1].astype(float), float(x[-1])) for x in counts)
        if not n0 or not n1:
            return np.zeros(self.space)
        p = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        return np.where((np.abs(z) >= self.least) & (a + b >= 4) & (np.abs(odds) >= TAUGHT_LEAST), PART * odds, 0.0)

    def fit(self, rows: Rows, good: np.ndarray, taught: np.ndarray | None = None, steps: int = 150, penalty: float = 0.03) -> None:
        n1, n0 = max(1.0, good.sum()), max(1.0, (1 - good).sum())
        a = rows.spread((good > 0.5).astype(float), self.space)
        b = rows.spread((good <= 0.5).astype(float), self.space)
        p = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        chosen = (np.abs(z) >= self.least) & (a + b >= 4)
        own = rows.only(chosen)
        start = np.zeros(self.space) if taught is None else self.prior(taught)
        # What the rows themselves do not choose keeps what it was taught.
        weights, bias = start.copy(), float(np.log(n1 / n0))
        fixed = rows.dot(np.where(chosen, 0.0, start))
        m, v, mb, vb = np.zeros(self.space), np.zeros(self.space), 0.0, 0.0
        for t in range(1, steps + 1):
            error = _sigmoid(own.dot(weights) + fixed + bias) - good
            g = (own.spread(error, self.space) + penalty * (weights - start)) / len(good)
            gb = float(error.mean())
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c, d = 1 - 0.9**t, 1 - 0.99**t
            weights -= 0.1 * (m / c) / (np.sqrt(v / d) + 1e-8) * chosen
            bias -= 0.1 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
        self.weights, self.bias = weights, bias

    def raw(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.weights) + self.bias

    def calibrate(self, rows: Rows, good: np.ndarray) -> None:
        (self.scale,), self.shift = platt(self.raw(rows)[:, None], good)

    def logit(self, rows: Rows) -> np.ndarray:
        return self.scale * self.raw(rows) + self.shift


def platt(x: np.ndarray, good: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a small logistic regression by Newton's method, with smoothed labels."""
    x = np.clip(x, -12, 12)
    n1, n0 = good.sum(), (1 - good).sum()
    y = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = _sigmoid(a @ w)
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(a.shape[1]), a.T @ (p - y) + 1e-2 * w)
    return w[:-1], float(w[-1])


def combined(content: np.ndarray, meta: np.ndarray, against: np.ndarray) -> np.ndarray:
    """What the combination sees: both calibrated views, the less favourable one, and the words that speak against a text.

    The last tells a short text, of which little is known, from one with a bad word among many good ones.
    """
    content, meta = np.clip(content, -12, 12), np.clip(meta, -12, 12)
    return np.stack([content, meta, np.minimum(content, meta), np.clip(against, -12, 0)], axis=-1)


@dataclass
class Model:
    prior: float
    content: View | None = None
    meta: View | None = None
    edges: list = field(default_factory=list)
    mix: tuple = ()


META_SPACE = 1 << 12
_CATEGORIES = META_SPACE - len(NUMBERS) * (BINS + 1)


def meta_rows(edges: list, langs: list, sources: list, numbers: np.ndarray) -> Rows:
    """The metadata features of each row."""
    bins = [k * (BINS + 1) + np.searchsorted(e, numbers[:, k]) for k, e in enumerate(edges)]
    base = len(NUMBERS) * (BINS + 1)
    places: dict[tuple, int] = {}
    for pair in {*(("lang", x) for x in langs), *(("source", x) for x in sources)}:
        places[pair] = base + zlib.crc32(f"{pair[0]}={pair[1]}".encode()) % _CATEGORIES
    named = np.array([sorted((places["lang", a], places["source", b])) for a, b in zip(langs, sources, strict=True)], np.int64).reshape(-1, 2)
    every = np.stack([*bins, named[:, 0], named[:, 1]], axis=1).astype(np.int32)
    # A language and a source at one place count once.
    keep = np.ones(every.shape, bool)
    keep[:, -1] = named[:, 0] != named[:, 1]
    return Rows(every[keep], np.concatenate(([0], np.cumsum(keep.sum(axis=1)))).astype(np.int64))


def train(words: Rows, meta: Rows, good: np.ndarray, edges: list, exchange: Callable[[list[View]], list[np.ndarray]]) -> Model:
    """A model from the features of labelled documents; ``exchange`` gives what each view is taught by the other."""
    prior = float(good.mean()) if len(good) else 0.5
    if len(good) < LEAST_LABELS or not 0 < good.sum() < len(good):
        return Model(prior)
    apart = np.arange(len(good)) % 4 == 3
    fit_views, held_views = ([rows.take(np.flatnonzero(which)) for rows in (words, meta)] for which in (~apart, apart))
    fit_good, held_good = good[~apart], good[apart]
    model = [View(SPACE, Z_LEAST), View(META_SPACE, Z_LEAST)]
    taught: list = [None, None]
    for turn in range(ROUNDS + 1):
        for k in (0, 1):
            model[k].fit(fit_views[k], fit_good, taught[k])
            model[k].calibrate(held_views[k], held_good)
        if turn < ROUNDS:
            taught = exchange(model)
    both = combined(*[v.logit(x) for v, x in zip(model, held_views, strict=True)], held_views[0].dot(np.minimum(model[0].weights, 0)))
    return Model(prior, *model, edges, platt(both, held_good))


def _chance(id_column: str, rate: float):
    return F.pmod(F.xxhash64(F.col(id_column), F.lit("co-training")), F.lit(1 << 30)) < int(min(1.0, rate) * (1 << 30))


def packed(features: np.ndarray) -> bytes:
    """Sorted features as steps, which compress well."""
    return np.diff(features, prepend=np.uint32(0)).astype("<u4").tobytes()


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 6_000_000):
            texts = Texts(part.column("text"))
            doc, found = texts.features()
            words = [packed(x) for x in np.split(found.astype("<u4"), np.searchsorted(doc, np.arange(1, texts.n)))]
            numbers = texts.numbers()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, numbers.size + 1, numbers.shape[1]), pa.int32()), pa.array(numbers.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.binary()), part.column("lang"), part.column("source"), lists], names=["id", "words", "lang", "source", "numbers"])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NUMBERS))


def bin_edges(made: DataFrame) -> list[np.ndarray]:
    """Quantiles of the numbers over all documents, from counts of their values to ten bits of precision."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = (_numbers(batch.column(0)).astype(np.float32).view(np.int32) >> 13).astype(np.int64) + (np.arange(len(NUMBERS)) << 32)
            found, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["key", "n"])

    table = made.select("numbers").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    edges = []
    for k in range(len(NUMBERS)):
        own = keys >> 32 == k
        total = np.cumsum(n[own])
        at = np.searchsorted(total, np.linspace(0, 1, BINS + 1)[1:-1] * (total[-1] if len(total) else 0))
        edges.append(np.unique(((keys[own][at] & 0xFFFFFFFF).astype(np.int32) << 13).view(np.float32)).astype(float) if own.any() else np.zeros(0))
    return edges


def exchanged(pool: DataFrame, edges: list, views: list[View]) -> list[np.ndarray]:
    """For each view the (bad, good) counts of its features over the documents of ``pool`` that the other view is sure of."""
    spaces = (SPACE + 1, META_SPACE + 1)
    shared = pool.sparkSession.sparkContext.broadcast(views)

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((2, n), np.int64) for n in spaces]
        for batch in batches:
            words = Rows.unpacked(pa.chunked_array([batch.column(0)]))
            meta = meta_rows(edges, batch.column(1).to_pylist(), batch.column(2).to_pylist(), _numbers(batch.column(3)))
            rows = (words, meta)
            says = [_sigmoid(view.logit(x)) for view, x in zip(shared.value, rows, strict=True)]
            for k in (0, 1):
                own, p = says[k], says[1 - k]
                times = np.diff(rows[k].starts)
                for good, sure in enumerate(((p <= 1 - SURE) & (own <= 0.5), (p >= SURE) & (own >= 0.5))):
                    counts[k][good, :-1] += np.bincount(rows[k].features[np.repeat(sure, times)], minlength=spaces[k] - 1)
                    counts[k][good, -1] += int(sure.sum())
        for k in (0, 1):
            for good in (0, 1):
                at = np.flatnonzero(counts[k][good])
                yield pa.RecordBatch.from_arrays([pa.array(at + ((2 * k + good) << 32)), pa.array(counts[k][good][at])], names=["key", "n"])

    table = pool.select("words", "lang", "source", "numbers").mapInArrow(teach, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    out = [np.zeros((2, size), np.int64) for size in spaces]
    for k in (0, 1):
        for good in (0, 1):
            own = keys >> 32 == 2 * k + good
            out[k][good][keys[own] & 0xFFFFFFFF] = n[own]
    return out


def gathered(sample: DataFrame, pieces: int = 8) -> tuple[Rows, pa.Table]:
    """The words and the other columns of a written sample, ordered by a hash of the id; it comes to the driver in pieces."""
    tables, found = [], []
    for k in range(pieces):
        table = sample.where(F.pmod(F.xxhash64("id"), F.lit(pieces)) == k).toArrow()
        found.append(Rows.unpacked(table.column("words")))
        tables.append(table.drop_columns(["words"]))
    discard(sample)
    table = pa.concat_tables(tables)
    order = np.argsort(np.array([zlib.crc32(str(i).encode()) for i in table.column("id").to_pylist()], np.int64), kind="stable")
    sizes = np.concatenate([np.diff(x.starts) for x in found])
    words = Rows(np.concatenate([x.features for x in found]), np.concatenate(([0], np.cumsum(sizes))))
    found.clear()
    return words.take(order), table.take(pa.array(order))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").alias("l_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double").alias("good"))
    n_known = known.count()
    if not n_known:
        return Model(0.5)
    kind = dict(docs.dtypes)["doc_id"]
    path = f"{shared_dir(spark)}/tidelog/quality-{uuid.uuid4().hex}"
    made = docs.select("doc_id", "text", "lang", "source").mapInArrow(_featurize, f"id {kind}, words binary, lang string, source string, numbers array<double>")
    made.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    made._tidelog_path = path
    edges = bin_edges(made)
    chosen = known.where(_chance("l_id", 0.97 * labelled / max(1, n_known))).groupBy("l_id").agg(F.min("good").alias("good"))
    # One row of each id: a repeated one brings no more rows to the driver than another.
    sample = made.join(F.broadcast(chosen), F.col("id") == F.col("l_id")).groupBy("id").agg(F.min(F.struct("words", "lang", "source", "numbers", "good")).alias("row")).select("id", "row.*")
    words, sample = gathered(written(sample, "quality-sample"))
    langs, sources, good = (sample.column(c).to_pylist() for c in ("lang", "source", "good"))
    numbers = np.array(sample.column("numbers").to_pylist(), float).reshape(-1, len(NUMBERS))
    ids = known.select("l_id").distinct()
    # Up to that many ids are a small broadcast; beyond it the features are shuffled.
    pool = made.join(F.broadcast(ids) if n_known <= BROADCAST_LABELS else ids, F.col("id") == F.col("l_id"), "left_anti")
    model = train(words, meta_rows(edges, langs, sources, numbers), np.array(good, float), edges, lambda views: exchanged(pool, edges, views))
    discard(made)
    return model


def scores(model: Model, part: pa.RecordBatch) -> np.ndarray:
    """The probabilities of the content view, the metadata view and both together for each of some (text, lang, source)."""
    texts = Texts(part.column("text"))
    doc, found = texts.features(model.content.weights)
    weights = model.content.weights[found]
    sums, against = (np.bincount(doc, weights=x, minlength=texts.n) for x in (weights, np.minimum(weights, 0)))
    a = model.content.scale * (sums + model.content.bias) + model.content.shift
    b = model.meta.logit(meta_rows(model.edges, part.column("lang").to_pylist(), part.column("source").to_pylist(), texts.numbers()))
    w, bias = model.mix
    both = (combined(a, b, against) * w).sum(axis=1) + bias
    return np.stack([_sigmoid(x) for x in (a, b, both)])


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, name: str = "verdict") -> DataFrame:
    """``docs`` with a struct column ``name`` (content, meta, score, kept) after the others."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = fit(docs, labels, labelled)
    fitted = found.content is not None
    model = spark.sparkContext.broadcast(found)
    row = F.struct(*[docs[c] for c in docs.columns])
    base = docs.select(row.alias("row"), F.col("text").alias("text"), F.col("lang").alias("lang"), F.col("source").alias("source"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "text", 6_000_000):
                done = scores(m, part) if fitted else np.full((3, part.num_rows), m.prior)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in done]], names=["row", "content", "meta", "score"])

    out = base.mapInArrow(score, f"row {base.schema['row'].dataType.simpleString()}, content double, meta double, score double")
    verdict = F.struct("content", "meta", "score", (F.col("score") >= 0.5 if fitted else F.lit(True)).alias("kept")).alias(name)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], verdict)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = classify(docs, read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "verdict.content", "verdict.meta", "verdict.score", "verdict.kept")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    name = fresh(docs, "verdict")
    return classify(docs, read_table(spark, sf_dir, "labels"), name=name).where(F.col(name)["kept"]).drop(name)


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
