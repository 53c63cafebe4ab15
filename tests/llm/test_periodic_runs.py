import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidelog.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"


def brute(w, min_length=6, min_exponent=4):
    """Runs (start, end, period) by comparing words a period apart."""
    n, out = len(w), set()
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q) and not any(s <= i and j + q <= e and q % p == 0 for s, e, p in out):
                out.add((i, j + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(rng, count):
    for _ in range(count):
        k, w = rng.choice([1, 2, 2, 3, 4]), []
        while len(w) < rng.randrange(1, 70):
            if rng.random() < 0.4:
                w += [rng.randrange(k) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 7)
            elif rng.random() < 0.3 and w:
                at = rng.randrange(len(w))
                w += w[at : at + rng.randrange(1, 30)]
            else:
                w.append(rng.randrange(k))
        yield w[:100]


def test_factors_are_the_longest_met_before():
    for w in sequences(random.Random(1), 400):
        at = 0
        for start, length, source in pr.factors(w):
            assert start == at
            assert w[start] not in w[:start] if source < 0 else source < start and w[source : source + length] == w[start : start + length]
            assert source < 0 or start + length == len(w) or not any(w[j : j + length + 1] == w[start : start + length + 1] for j in range(start))
            at += length
        assert at == len(w)


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_equal_brute_force(exponent):
    rng = random.Random(exponent)
    for w in sequences(rng, 1500):
        least = rng.choice([2, 4, 6])
        want = brute(w, least, exponent)
        assert pr.find_runs(np.array(w, np.int64), least, exponent) == want, w
        # Without the cuts at rare words as well.
        assert sorted(pr.Search(w, least, exponent).runs(), key=lambda r: (r[0], r[2])) == want


def test_long_sequences():
    assert pr.find_runs(np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]
    assert pr.find_runs(np.arange(30_000) % 7_000) == [(0, 30_000, 7_000)]
    assert pr.find_runs(np.arange(30_000)) == [] and pr.find_runs(np.zeros(5, np.int64)) == []
    with pytest.raises(ValueError):
        pr.find_runs(np.zeros(5, np.int64), 6, 1)


def expected(doc_id, text):
    """The contract of op11 by brute force."""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {k for s, e, q in runs for k in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pr.op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes[:6]] == ["bigint"] * 6
    rows = got.collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    for r in rows:
        if len((docs[r.doc_id] or "").split()) <= 1500:
            assert tuple(r) == expected(r.doc_id, docs[r.doc_id])


def test_awkward_tables(spark, monkeypatch):
    words = " ".join(["a b"] * 5 + ["c"] + ["d"] * 9 + ["x"] * 6 + ["y"] * 6 + ["the end  of it"])
    rows = [*cases.rows(), (20, words, None, None, None), (21, words.replace(" ", "\x0b\t "), None, None, None), (None, words, None, None, None), (20, words, None, None, None)]
    rows = [r for r in rows if r[1] != cases.LONG]
    for df in (spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(rows, cases.SCHEMA).withColumns({c: F.lit(1) for c in ("runs", "collapsed", "start", "id")})):
        monkeypatch.setattr(pr, "read_table", lambda *_, df=df: df)
        assert sorted(map(str, map(tuple, pr.op11_periodic_runs(spark, "").collect()))) == sorted(str(expected(r[0], r[1])) for r in rows)
    monkeypatch.setattr(pr, "read_table", lambda *_: cases.empty(spark))
    assert pr.op11_periodic_runs(spark, "").count() == 0
    found = pr.periodic_runs(spark.createDataFrame([(1, cases.LONG + " " + "z " * 8)], "key bigint, body string"), "key", "body").first()
    # The long text of the cases repeats every 5003 words.
    assert [tuple(r) for r in found.runs] == [(0, 30_000, 5003), (30_000, 8, 1)] and found.collapsed == " ".join([*cases.LONG.split()[:5003], "z"])
