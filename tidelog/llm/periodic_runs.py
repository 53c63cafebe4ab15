"""Periodic runs of words, found by the Kolpakov-Kucherov scheme.

A run is a stretch with smallest period q, as long as ``min_length`` words and ``min_exponent`` periods at least, that neither neighbouring word
extends. The words of a text are cut into Lempel-Ziv factors by a suffix automaton: each factor is the longest stretch that begins somewhere before
as well. Runs that touch a factor's edge come from two prefix tables (Main): for each period to the right or to the left of the edge, how far the words
agree with those a period on, forwards and backwards. The words looked at are the factor and as much before it as a run can hold that ends in it: the
factor before, and less than a period more. All other runs lie inside a factor and are copied from where its words stood before, in order of their
starts, so that copies of copies are there in time.

A word that a stretch holds fewer than ``min_exponent`` times is in no run of it, as a run holds each of its words once a period. Such words cut the stretch, and
what is left is cut again until nothing changes; each stretch of at least ``min_length`` words is then searched as described. A suffix automaton takes some
500 bytes a word of one stretch; nothing else grows faster than the text.

Words are stretches of bytes other than ASCII white space; null and empty texts have none and no runs. Ties in the greatest exponent go to the smallest start,
then the smallest period. Repeated rows and null ids are rows like others. Whole texts are read, however long. An empty table gives no rows.
Only ``id_col`` and ``text_col`` are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import read_table, slices

MIN_LENGTH = 6
MIN_EXPONENT = 4
RUN = "struct<start: bigint, length: bigint, period: bigint>"

Run = tuple[int, int, int]  # start, end, period


def factors(w: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, where its words begin before; -1 for a new word) of each Lempel-Ziv factor; the two places may overlap."""
    after: list[dict[int, int]] = [{}]
    link, size, first_end = [-1], [0], [-1]
    last = 0
    for at, x in enumerate(w):
        now = len(after)
        after.append({})
        size.append(size[last] + 1)
        first_end.append(at)
        link.append(0)
        p = last
        while p >= 0 and x not in after[p]:
            after[p][x] = now
            p = link[p]
        if p >= 0:
            q = after[p][x]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(after)
                after.append(dict(after[q]))
                size.append(size[p] + 1)
                first_end.append(first_end[q])
                link.append(link[q])
                link[q] = link[now] = twin
                while p >= 0 and after[p].get(x) == q:
                    after[p][x] = twin
                    p = link[p]
        last = now
    start, n = 0, len(w)
    while start < n:
        state, length = 0, 0
        while start + length < n:
            then = after[state].get(w[start + length])
            if then is None or first_end[then] - length >= start:
                break
            state, length = then, length + 1
        yield (start, length, first_end[state] - length + 1) if length else (start, 1, -1)
        start += max(1, length)


def prefix_table(w: Sequence[int]) -> list[int]:
    """For each place, how many words from there on are those from the beginning on."""
    n = len(w)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


class Search:
    """The runs of one sequence of numbers."""

    def __init__(self, w: Sequence[int], min_length: int, min_exponent: int) -> None:
        self.w, self.min_length, self.min_exponent = w, min_length, min_exponent
        self.found: list[Run] = []
        self.known: set[Run] = set()

    def _add(self, run: Run) -> None:
        if run not in self.known:
            self.known.add(run)
            insort(self.found, run)

    def _edge(self, at: int, before: int, after: int) -> None:
        """Runs that touch ``at`` and end in the factor of ``after`` words there, the factor before having ``before`` words."""
        low = max(0, at - before - (before + after) // (self.min_exponent - 1))
        if at - low + after < self.min_length:
            return
        left, right = self.w[low:at], self.w[at : at + after]
        n, m = len(left), len(right)
        ahead = prefix_table([*right, -1, *left, *right])
        behind = prefix_table([*left[::-1], -1, *right[::-1], *left[::-1]])
        # A period lies to the right of the edge, or to the left of it.
        self._crossing(at, [(p, behind[n + 1 + m - p], p + (ahead[p] if p < m else 0)) for p in range(1, m + 1)])
        self._crossing(at, [(p, p + (behind[p] if p < n else 0), ahead[m + 1 + n - p]) for p in range(1, n + 1)])

    def _crossing(self, at: int, reaches: list[tuple[int, int, int]]) -> None:
        """Runs from (period, words to the left, words to the right) of ``at``, periods ascending."""
        w, n, mine = self.w, len(self.w), []
        for p, back, forth in reaches:
            if back + forth < max(self.min_length, self.min_exponent * p):
                continue
            start, end = at - back, at + forth
            # Multiples of a period within its run are the same run.
            if any(p % q == 0 and s <= start and end <= e for s, e, q in mine):
                continue
            # The words looked at may end before the run does.
            while start > 0 and w[start - 1] == w[start - 1 + p]:
                start -= 1
            while end < n and w[end] == w[end - p]:
                end += 1
            mine.append((start, end, p))
            self._add((start, end, p))

    def _copies(self, start: int, length: int, source: int) -> None:
        k = bisect_right(self.found, (source + 1,))
        while k < len(self.found) and self.found[k][0] < source + length:
            a, b, p = self.found[k]
            if b < source + length:
                self._add((a + start - source, b + start - source, p))
            k += 1

    def runs(self) -> list[Run]:
        w, before = self.w, 0
        for start, length, source in factors(w):
            self._edge(start, before, length)
            if source >= 0 and length >= self.min_length + 2:
                self._copies(start, length, source)
            before = length
        self._edge(len(w), before, 0)
        return self.found


def stretches(codes: np.ndarray, min_length: int, least: int) -> Iterator[tuple[int, int]]:
    """Stretches of which every word stands in them ``least`` times."""
    left = [(0, len(codes))]
    while left:
        a, b = left.pop()
        if b - a < min_length:
            continue
        _, which, times = np.unique(codes[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(times[which] < least)
        if not len(rare):
            yield a, b
            continue
        edges = np.concatenate(([-1], rare, [b - a]))
        wide = np.flatnonzero(np.diff(edges) > min_length)
        left += [(a + int(edges[k]) + 1, a + int(edges[k + 1])) for k in wide]


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """Runs (start, end, period) of a sequence of numbers, by start, then period."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    out = []
    for a, b in stretches(codes, min_length, min_exponent):
        out += [(a + s, a + e, p) for s, e, p in Search(codes[a:b].tolist(), min_length, min_exponent).runs()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that come after the first period of a run, one space between them."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, end, period in runs:
        kept[start + period : end] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, edit: Callable[[int | None, int], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its runs (start, length, period) by start and period, and its words without repeated periods.

    ``edit`` may give, for an id and a number of words, the places of the words to read instead of the text's own.
    """
    kind = dict(docs.dtypes)[id_col]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, "text", 4_000_000)):
            found, short = [], []
            for who, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
                if edit is not None:
                    places = edit(who, len(words))
                    words, codes = [words[k] for k in places.tolist()], codes[places]
                runs = find_runs(codes, min_length, min_exponent)
                found.append([{"start": s, "length": e - s, "period": p} for s, e, p in runs])
                short.append(collapsed(words, runs).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, run_type), pa.array(short, pa.string())], names=["doc_id", "runs", "collapsed"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(search, f"doc_id {kind}, runs array<{RUN}>, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Places of words: of a tenth of all ids, the rest of the text from some word on repeats a period; documents without id stay."""
    places = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % p
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, with repeats planted: their number, the one with the greatest exponent, digests of the runs and of what is kept."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), edit=planted)
    # Runs come by start and period, so the first of equals stays.
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    top = F.aggregate("runs", F.lit(None).cast(RUN), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}
