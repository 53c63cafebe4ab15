import math

import numpy as np

from tidelog.llm import embedding_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 24))
    near = x[rng.integers(0, 40, 300)] + rng.normal(size=(300, 24)) * 0.12
    tight = x[0] + rng.normal(size=(150, 24)) * 0.05
    rows = [(i, v.astype("float32").tolist(), 0) for i, v in enumerate(np.concatenate([x, near, tight]))]
    rows += [(2000, rows[3][1], 1), (2001, rows[3][1], 1), (2001, rows[3][1], 1), (None, rows[4][1], 2)]
    odd = [None, [], [0.0] * 24, [1.0] * 23 + [None], [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [1.0, 2.0]]
    return rows + [(3000 + i, v, 0) for i, v in enumerate(odd)]


def slow(rows, least=0.95):
    sound = [i for i, r in enumerate(rows) if r[1] and len(r[1]) == 24 and all(e is not None and math.isfinite(e) for e in r[1]) and any(r[1])]
    x = np.array([np.float32(rows[i][1]).astype(float) for i in sound])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= least
    label = np.arange(len(sound))
    while True:
        new = np.where(links, label[None, :], len(sound)).min(axis=1)
        if (new == label).all():
            break
        label = new
    out = [(r[0], 0, r[0]) for r in rows]
    for k, i in enumerate(sound):
        ids = [rows[sound[j]][0] for j in np.flatnonzero(label == label[k]) if rows[sound[j]][0] is not None]
        out[i] = (rows[i][0], int(links[k].sum()) - 1, min(ids, default=None))
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_SHARD", 200)
    rows = vectors()
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = slow(rows)
    assert sorted(((r.id, r.component_id) for r in got), key=str) == sorted(((w[0], w[2]) for w in want), key=str)
    degree, exact = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert 0.99 * exact <= degree <= exact
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_cut_shards_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST", 60)
    monkeypatch.setattr(embedding_dedup, "PER_SHARD", 400)
    rows = vectors()[:700]
    got = sorted((r.id, r.n_links) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    want = sorted((w[0], w[1]) for w in slow(rows))
    assert sum(n for _, n in got) >= 0.99 * sum(n for _, n in want) and all(a[1] <= b[1] for a, b in zip(got, want))


def test_one_great_cluster_in_parts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST", 150)
    monkeypatch.setattr(embedding_dedup, "MOST_ASKING", 100)
    monkeypatch.setattr(embedding_dedup, "PER_SHARD", 300)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(900, 16)) * 0.03, rng.normal(size=(200, 16))])
    rows = [(i, v.astype("float32").tolist(), 0) for i, v in enumerate(x)]
    out, recall = embedding_dedup.audited(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: (r.n_links, r.component_id) for r in out.collect()}
    want = {i: (n, c) for i, n, c in slow_wide(rows, 16)}
    assert recall >= 0.95 and {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    assert all(got[i][0] <= want[i][0] for i in got) and sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())


def slow_wide(rows, width):
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.95
    label = np.arange(len(rows))
    while (new := np.where(links, label[None, :], len(rows)).min(axis=1)).tolist() != label.tolist():
        label = new
    return [(rows[k][0], int(links[k].sum()) - 1, rows[label[k]][0]) for k in range(len(rows))]


def test_a_search_that_finds_nothing_ends_in_an_exact_scan(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_SHARD", 200)
    monkeypatch.setattr(embedding_dedup, "DEGREE", 1)
    monkeypatch.setattr(embedding_dedup, "FAR", 1)
    monkeypatch.setattr(embedding_dedup, "BEAM", 1)
    monkeypatch.setattr(embedding_dedup, "LEAST_RECALL", 1.01)
    rows = vectors()
    out, recall = embedding_dedup.audited(spark.createDataFrame(rows, SCHEMA))
    want = slow(rows)
    assert recall == 1.0
    assert sorted(((r.id, r.n_links, r.component_id) for r in out.collect()), key=str) == sorted(want, key=str)


def test_doubles_are_compared_as_doubles_and_other_columns_do_not_clash(spark):
    from pyspark.sql import functions as F

    # In single precision both pairs have the same cosine.
    c = 0.95
    rows = [(1, [1.0, 0.0]), (2, [c + 1e-9, math.sqrt(1 - (c + 1e-9) ** 2)]), (3, [c - 1e-9, -math.sqrt(1 - (c - 1e-9) ** 2)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({x: F.lit(1) for x in ("id", "key", "vector", "node", "weight", "near", "sound", "place")})
    got = {r.id: r.component_id for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_empty_and_lonely(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    one = embedding_dedup.near_duplicates(spark.createDataFrame([(5, [1.0, 0.0], 1)], SCHEMA)).first()
    assert tuple(one) == (5, 0, 5, True)
