import random

from tests.llm import cases
from tidelog.llm import common, line_dedup, pipeline, simhash


def test_components_match_brute_force(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200 + i, 201 + i) for i in range(30)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), "t").collect()}
    assert got == {n: root(n) for n in nodes}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint"), "t").count() == 0


def test_stages_in_order_over_small_tables(spark, tmp_path):
    docs = cases.docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "source mixing", "packing"]
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    out = pipeline.run(spark, str(tmp_path)).collect()
    kept = simhash.one_of_each(line_dedup.stage_line_dedup(spark, docs, "")).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in kept}
    ends = [r for r in out if r.start + r.length == r.doc_tokens]
    assert len(ends) == now.count()


def slow_first_lines(rows):
    """Texts by row after repeated lines (in ten documents or more) stay only in the document with the smallest id."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            holders.setdefault(k, []).append(r[0])
    out = []
    for r in rows:
        kept, met = [], set()
        for line in (r[1] or "").split("\n"):
            k = key(line)
            if not k or len(holders[k]) < 10:
                kept.append(line)
            elif r[0] == min(x for x in holders[k] if x is not None) and k not in met:
                met.add(k)
                kept.append(line)
        out.append("\n".join(kept))
    return out


def slow_groups(texts):
    """The place of the first text of each text's group at a Jaccard similarity of 0.8 in five-word shingles."""
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if label[i] != label[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_pipeline_by_brute_force(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from tests.llm.test_mixing import slow_targets
    from tidelog.llm import mixing, packing, quality

    rng = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 40, 90]))]
        if i % 10 == 3:
            words = " ".join(f"{w}!!!" for w in words).upper().split()
        if i > 20 and i % 6 == 0:
            words = rows[i - 20][1].split("\n")[0].split()
            words[len(words) // 2] = "edited"
        text = " ".join(words) + ("\nThe same closing line of many documents " if i % 3 == 0 else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, int("!!!" not in text), 0))
    rows += [(600, None, None, None, None), (601, "", "en", "s1", 0), (602, rows[5][1], "en", "s2", 1)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    docs.withColumns({c: F.lit(1) for c in ("id", "mark", "nth", "uid", "fp", "verdict", "stripped", "copies", "mix_mark", "mix_copies", "mix_copy")}).write.parquet(str(tmp_path / "documents.parquet"))
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    known.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in quality.classify(docs, known).where("verdict.kept").collect()}
    good = {r[0] for r in rows if "!!!" not in (r[1] or "")}
    assert len(good - kept) <= 3 and len(kept - good) <= 3
    now = [r for r in rows if r[0] in kept]
    now = [(r[0], t, *r[2:]) for r, t in zip(now, slow_first_lines(now), strict=True)]
    label = slow_groups([r[1] for r in now])
    now = [r for i, r in enumerate(now) if label[i] == i]
    sizes = {}
    for r in now:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    target, taken = slow_targets(sizes), dict.fromkeys(sizes, 0)
    tokens = packing.Tokens(packing.tokenizer_path())
    lengths = {r[0]: len(tokens.whole(r[1])) // 4 + 1 for r in now}
    out = pipeline.run(spark, str(tmp_path)).collect()
    starts, ids = {}, {}
    for p in out:
        starts.setdefault(p.doc_id, []).append(p.start)
        ids[p.doc_id] = ids.get(p.doc_id, 0) + p.length
        assert p.doc_tokens == lengths[p.doc_id]
    words = {r[0]: (r[3], len(r[1].split())) for r in now}
    for who, n in ids.items():
        copies = starts[who].count(0)
        assert n == copies * lengths[who] and copies <= 3
        taken[words[who][0]] += copies * words[who][1]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(5, 0.02 * t), s
    assert np.isclose(sum(target.values()), sum(sizes.values()), rtol=0.01) and mixing.MOST == 3


def test_empty_tables_and_no_labels(spark, tmp_path):
    cases.empty(spark).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    none.write.parquet(str(tmp_path / "a" / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path / "a")).count() == 0
    cases.docs(spark).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    none.write.parquet(str(tmp_path / "b" / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path / "b")).count() > 0
