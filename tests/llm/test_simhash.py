import random

import numpy as np
import pyarrow as pa
import xxhash

from tests.llm import cases
from tidelog.llm import simhash


def slow_fingerprint(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, most=4):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= most and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for lab, i in zip(label, ids):
        if i is not None:
            least[lab] = min(i, least.get(lab, i))
    return [least.get(lab) for lab in label]


def test_fingerprint_matches_definition():
    for text in [r[1] for r in cases.rows() if r[1] is None or len(r[1]) < 1000]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_text_in_blocks():
    words = [str(i).encode() for i in range(250_000)]
    assert sum(len(h) for h in simhash.shingle_hashes(words, 4)) == 250_000 - 3


def test_query_matches_brute_force(spark):
    rows = cases.rows()
    got = simhash.near_duplicates(cases.docs(spark)).collect()
    want = slow_components([slow_fingerprint(r[1]) for r in rows], [r[0] for r in rows])
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    signed = [(f + 2**63) % 2**64 - 2**63 for f in (slow_fingerprint(r[1]) for r in rows)]
    assert sorted([tuple(r) for r in got], key=key) == sorted([(r[0], f, c) for r, f, c in zip(rows, signed, want)], key=key)


def test_grid_join_finds_all_links(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:150]:
        for k in (1, 2, 3, 4, 5):
            for b in rng.sample(range(64), k):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    edges = [(r.a, r.b) for r in simhash.near_links(df).collect()]
    up = {f: f for f in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4
        up[root(a)] = root(b)
    want = slow_components(fps, fps)
    groups = {}
    for f, c in zip(signed, want):
        groups.setdefault(c, set()).add(root(f))
    assert all(len(g) == 1 for g in groups.values()) and len({r for g in groups.values() for r in g}) == len(groups)


def test_one_of_each_and_edges(spark):
    kept = simhash.one_of_each(cases.clashing(spark)).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(9) == 1 and ids.count(1) == 1 and 2 not in ids and 6 not in ids and 7 not in ids and 4 in ids
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.one_of_each(cases.empty(spark)).count() == 0


def test_stage_keeps_one_of_all_texts_alike(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 40, 300]))]
        texts.append(" ".join(words))
        for _ in range(5):
            for i in rng.sample(range(len(words)), max(1, len(words) // 60)):
                words[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    fps = [slow_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert any(bin(fps[i] ^ fps[j]).count("1") > 4 for i, j in links)
    label, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == sorted(set(label))


def test_a_passage_in_many_texts_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(200):
        own = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        texts.append(" ".join(own[:20] + passage + own[20:]))
        if i % 10 == 0:
            words = texts[-1].split()
            words[3] = "edited"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(simhash, "LOCAL", 2)
    sets = spark.createDataFrame([(i, simhash.shingle_set(t).tobytes()) for i, t in enumerate(texts)], "uid bigint, hashes binary")
    common = simhash.common_hashes(sets)
    assert len(common) == 36 and (np.diff(common) > 0).all()
    shared = simhash.shingle_set(texts[0]).view(np.int64)
    ordered = simhash.in_order(shared, common)
    assert sorted(ordered.tolist()) == sorted(shared.tolist()) and set(ordered[-36:].tolist()) == set(common.tolist())
    edited = {i for i, t in enumerate(texts) if "edited" in t}
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == [i for i in range(len(texts)) if i not in edited]


def test_sets_meet_only_where_alike_ones_must():
    rng = np.random.default_rng(9)
    # Like a group of copies that share four in five hashes: few are alike, each shares with each.
    group = np.sort(rng.choice(1 << 40, 90, replace=False))
    sets = [np.sort(np.concatenate([rng.choice(group, int(size * share), replace=False), rng.integers(1 << 41, 1 << 42, size - int(size * share))])) for size, share in zip(rng.integers(80, 90, 150), rng.choice((0.8, 0.9, 1.0), 150))]
    order = [np.concatenate([x[x > 1 << 40], x[x <= 1 << 40]]) for x in sets]
    entries = sorted((int(h), len(x), u, at) for u, x in enumerate(order) for at, h in enumerate(x[: simhash.prefix(len(x))]))
    cells, n, uid, place = (pa.array(x, pa.int64()) for x in zip(*entries, strict=True))
    batch = pa.RecordBatch.from_arrays([cells, uid, n, place, uid], names=["cell", "uid", "n", "place", "label"])
    shared, short, rows = {}, {}, 0
    for out in simhash._cell_pairs(iter([batch]), None):
        for a, b, k, least in zip(*[c.to_pylist() for c in out.columns], strict=True):
            shared[a, b], short[a, b], rows = shared.get((a, b), 0) + k, least, rows + k
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if simhash.alike(sets[i], sets[j])}
    assert alike and alike <= {p for p, k in shared.items() if k >= short[p]}
    of_cell = {}
    for h, size, u, _ in entries:
        of_cell.setdefault(h, []).append((size, u))
    met = sum(5 * min(a, b) >= 4 * max(a, b) for x in of_cell.values() for i, (a, _) in enumerate(x) for b, _ in x[:i])
    assert rows < 0.6 * met, (rows, met)


def test_links_are_told_again_rather_than_held(spark, monkeypatch):
    want = sorted(map(str, simhash.near_duplicates(cases.docs(spark)).collect()))
    monkeypatch.setattr(simhash, "MOST_HELD", 1)
    assert sorted(map(str, simhash.near_duplicates(cases.docs(spark)).collect())) == want
