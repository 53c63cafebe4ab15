import collections
import hashlib
import math

import numpy as np
import xxhash

from tests.llm import cases
from tidelog.llm import digests


def test_levels_match_entropy():
    rng = np.random.default_rng(1)
    x = rng.choice(np.frombuffer(b"abcdefgh   xyz", np.uint8), 3000)
    got = digests.levels(x)
    assert len(got) == 3000 - digests.WINDOW + 1
    for i in range(0, len(got), 53):
        c = collections.Counter(x[i : i + digests.WINDOW].tolist())
        h = -sum(v / digests.WINDOW * math.log2(v / digests.WINDOW) for v in c.values())
        assert abs(got[i] - 1000 * h / math.log2(digests.WINDOW)) <= 1.01


def test_blocks_join_without_seam(monkeypatch):
    x = np.frombuffer(("some words and others " * 400).encode(), np.uint8)
    whole = digests.levels(x)
    monkeypatch.setattr(digests, "_BLOCK", 1000)
    assert (digests.levels(x) == whole).all()


def test_selection_matches_brute_force():
    rng = np.random.default_rng(2)
    ranks = rng.integers(0, 30, 500)
    wins = collections.Counter()
    for i in range(500 - digests.SPAN + 1):
        span = ranks[i : i + digests.SPAN]
        wins[i + int(span.argmin())] += 1
    assert digests.selected(ranks).tolist() == sorted(k for k, n in wins.items() if n >= digests.WINS)


def signed_hash(text):
    return (xxhash.xxh64_intdigest((text or "").encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def slow(rows):
    """Everything from whole texts: counts, edits, digests and likenesses."""
    of = lambda t: np.frombuffer(t.encode(), np.uint8)
    counts = sum((np.bincount(digests.levels(of(r[1] or "")), minlength=digests.LEVELS) for r in rows), np.zeros(digests.LEVELS, np.int64))
    rare = digests.rarity(counts)
    made = lambda t: digests.digest(t.encode(), rare[digests.levels(of(t))])
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed_hash(r[1])))
    out = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        a, b, c = made(text), made(edited), made(after)
        out.append((r[0], n, hashlib.sha256(edited.encode()).hexdigest(), a.text(), b.text(), round(digests.likeness(a, b), 9), round(digests.likeness(a, c), 9)))
    return out


def rounded(got):
    return sorted(((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str)


def test_query_matches_brute_force(spark, monkeypatch):
    rows = cases.rows()
    for size in (digests.BUCKET_BYTES, 40_000, 3_000):
        monkeypatch.setattr(digests, "BUCKET_BYTES", size)
        got = digests.fingerprints(cases.clashing(spark)).collect()
        assert rounded(got) == sorted(slow(rows), key=str)
        by_text = collections.defaultdict(set)
        texts = {r[0]: r[1] for r in rows if r[0] is not None}
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if r.doc_id is not None:
                by_text[texts[r.doc_id] or ""].add(r.fingerprint)
        assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {""}
    assert digests.fingerprints(cases.empty(spark)).count() == 0


def test_one_id_over_many_ranges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    same = text(60)
    rows = [(i, text(40), "en", "a", 0) for i in (1, 2, 3, 2**63 - 1, -(2**63), 90)] + [(50, same, "en", "a", 0)] * 150 + [(50, text(30), "en", "a", 0) for _ in range(60)] + [(None, same, "en", "a", 0)] * 40
    monkeypatch.setattr(digests, "BUCKET_BYTES", 4_000)
    heads = []
    real = digests.range_heads
    monkeypatch.setattr(digests, "range_heads", lambda *x: heads.extend(real(*x)) or list(heads))
    got = digests.fingerprints(spark.createDataFrame(rows, cases.SCHEMA).repartition(6)).collect()
    assert len(set(heads)) < len(heads) > 10
    assert rounded(got) == sorted(slow(rows), key=str)
    heads.clear()
    got = digests.fingerprints(spark.createDataFrame(rows[6:60], cases.SCHEMA).repartition(3)).collect()
    assert len(set(heads)) == 1 < len(heads) and rounded(got) == sorted(slow(rows[6:60]), key=str)


def test_likeness():
    text = cases.LONG.encode()
    counts = np.bincount(digests.levels(np.frombuffer(text, np.uint8)), minlength=digests.LEVELS)
    rare = digests.rarity(counts)
    of = lambda t: digests.digest(t, rare[digests.levels(np.frombuffer(t, np.uint8))])
    a, half, other = of(text[:20_000]), of(text[:10_000] + b" ".join(b"%d" % (i * i) for i in range(2000))), of(b" ".join(b"x%dy" % (i**3) for i in range(3000)))
    assert digests.likeness(a, a) == 1.0
    assert 0.35 < digests.likeness(a, half) < 0.75
    assert digests.likeness(a, other) < 0.1


def test_every_text_has_a_feature():
    rng = np.random.default_rng(7)
    rare = digests.rarity(rng.integers(0, 1000, digests.LEVELS))
    of = lambda t: digests.digest(t, rare[digests.levels(np.frombuffer(t, np.uint8))])
    for size in range(64, 101):
        for _ in range(20):
            assert of(rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), size).tobytes()).counts.sum()
    ha, spam = of(b"ha ha " * 600), of(b"spam spam " * 600)
    assert ha.counts.sum() and spam.counts.sum() and of(b"a" * 5000).counts.sum()
    assert digests.likeness(ha, spam) < 1 and digests.likeness(ha, of(b"ha ha " * 500)) == 1


def test_short_texts_stay_near_their_edits():
    import random

    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "light", "paper", "green", "window", "garden"]
    told = lambda n: " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(60))[:n].encode()
    ranks = lambda data: np.zeros(max(0, len(data) - digests.WINDOW + 1), np.int64)
    for n in [*range(12, 150, 6), 126, 127, 128, 129, 200, 254, 255, 256, 257]:
        near, far = [], []
        for _ in range(10):
            text, other = told(n), told(n)
            edited = text[: n - n // 3] + other[: n // 3]
            own = digests.digest(text, ranks(text))
            near.append(digests.likeness(own, digests.digest(edited, ranks(edited))))
            far.append(digests.likeness(own, digests.digest(other, ranks(other))))
        assert min(near) >= 0.3 and np.mean(near) > np.mean(far) + 0.2, (n, near, far)
