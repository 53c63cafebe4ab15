import random
from collections import Counter, defaultdict

import pytest

from tests.llm import cases
from tidelog.llm import mixing


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = left / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)


def mixed(spark, df):
    rows, copies = mixing.mix(df)
    return rows.drop("source").join(copies, "mix_mark").collect()


def test_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", "s%d" % (i % 7 * (i % 3)), 0) for i in range(3000)] + [(9000 + i, "tiny", "en", "zz", 0) for i in range(5)] + [(9900 + i, None, "en", None, 0) for i in range(3)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = slow_targets(sizes)
    taken = Counter()
    for r in mixed(spark, df):
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.copies in (int(r.target / r.source_size) if r.source_size else 0, int(r.target / r.source_size + 1) if r.source_size else 0)
        taken[r.source] += r.copies * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t), s


def test_tree_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_GROUP", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "w " * (1 + i % 40), "en", "s%d" % (i % 3), 0) for i in range(900)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    a, b = (sorted((r.id, r.copies) for r in mixed(spark, df.repartition(n))) for n in (1, 6))
    assert a == b and len(a) == 900


def test_small_groups_are_settled_by_exchanges(monkeypatch):
    made = []
    real = mixing.exchange
    monkeypatch.setattr(mixing, "exchange", lambda *x: made.append(x) or real(*x))
    rng = random.Random(1)
    rows = [(f"m{i}", rng.randint(1, 2000), 0.37) for i in range(50)]
    words = {m: w for m, w, _ in rows}
    want = sum(w * p for _, w, p in rows)
    mean, misses = Counter(), []
    for seed in range(400):
        left = mixing.reduce_group(rows, seed, False)
        assert sum(not mixing._integral(p) for p in left.values()) <= 1
        assert sum(words[m] * p for m, p in left.items()) == pytest.approx(want)
        out = mixing.reduce_group(rows, seed, True)
        assert set(out.values()) <= {0.0, 1.0}
        misses.append(abs(sum(words[m] * p for m, p in out.items()) - want))
        mean.update(out)
    assert len(made) >= 2 * 400 * 30
    assert max(misses) <= 0.02 * want
    assert sum(mean.values()) / 400 / 50 == pytest.approx(0.37, abs=0.02)
    assert all(0.2 < mean[m] / 400 < 0.54 for m in words)


def test_a_document_that_outweighs_its_source_is_made_up_for():
    rows = [("big", 20_000, 0.3)] + [(f"m{i}", 100, 0.3) for i in range(49)]
    for seed in range(20):
        out = mixing.reduce_group(rows, seed, True)
        assert abs(sum(w * out[m] for m, w, _ in rows) - 7470) <= 7470 - 4900


def test_exchange_keeps_words_and_expectation():
    for p, a, q, b in ((0.3, 10, 0.6, 7), (0.9, 3, 0.8, 50), (0.1, 5, 0.1, 5)):
        down = min(a * p, b * (1 - q))
        up = min(a * (1 - p), b * q)
        ends = [mixing.exchange(p, a, q, b, c) for c in (0.0, 0.999999)]
        for x, y in ends:
            assert a * x + b * y == pytest.approx(a * p + b * q) and (x in (0, 1) or y in (0, 1))
        chance = down / (up + down)
        assert chance * ends[0][0] + (1 - chance) * ends[1][0] == pytest.approx(p)


def test_awkward_rows_and_empty(spark):
    out = mixed(spark, cases.clashing(spark))
    assert Counter(r.id for r in out) == Counter(r[0] for r in cases.rows())
    assert len({r.copies for r in out if r.id == 9}) == 1
    assert mixed(spark, cases.empty(spark)) == []
    stage = mixing.stage_mixing(spark, cases.docs(spark), "")
    want = Counter()
    for r in out:
        want[r.id] += r.copies
    assert Counter(r.doc_id for r in stage.collect()) == +want
