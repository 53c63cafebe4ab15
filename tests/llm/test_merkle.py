import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidelog.llm import merkle


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(leaves, k):
    """(root, siblings of each leaf with the place of the path among them)"""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i // k * k
            path.append((i - run, [leaves[j] for j in range(run, min(len(leaves), run + k)) if j != i]))
        leaves = [sha(leaves[j : j + k]) for j in range(0, len(leaves), k)]
        at = [i // k for i in at]
    return leaves[0], paths


def brute(rows, k=3):
    """The contract of op13 on (doc_id, text, lang, source, n_chars) rows."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf((doc_id, source, lang, n_chars, text))
        bad = leaf((doc_id, source, lang, n_chars, text and text.replace("\n", ""))) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else own
        groups.setdefault((source is not None, (source or "").encode()), []).append(((doc_id is not None, doc_id or 0, own), doc_id, own, bad))
    below = []
    for g in sorted(groups):
        members = sorted(groups[g])
        root, paths = tree([m[2] for m in members], k)
        below.append((root, [(m, p) for m, p in zip(members, paths, strict=True)]))
    if not below:
        return []
    root, tops = tree([b[0] for b in below], k)
    out = []
    for (subroot, members), top in zip(below, tops, strict=True):
        for (_, doc_id, own, bad), path in members:
            folded = bad
            for place, others in path + top:
                folded = sha([*others[:place], folded, *others[place:]])
            out.append((doc_id, own, subroot, root, sha(d for _, others in path + top for d in others), folded, folded == root))
    return out


class Table:
    """Stands for a folder of tables."""

    def __init__(self, df):
        self.df = df

    def query(self, monkeypatch):
        monkeypatch.setattr(merkle, "read_table", lambda spark, sf_dir, name: self.df)
        return merkle.op13_merkle_manifest(self.df.sparkSession, "")


@pytest.mark.parametrize("per_part", [4, 20_000])
def test_query_equals_brute_force(spark, monkeypatch, per_part):
    build = merkle.build
    monkeypatch.setattr(merkle, "build", lambda rows, fanout=3: build(rows, fanout, per_part))
    monkeypatch.setattr(merkle, "MERGED", 3)
    got = Table(cases.docs(spark)).query(monkeypatch)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = Counter(map(tuple, got.collect()))
    assert got == Counter(brute(cases.rows())) and {r[-1] for r in got} == {True, False}


def test_awkward_tables(spark, monkeypatch):
    assert Table(cases.empty(spark)).query(monkeypatch).count() == 0
    want = Counter(brute(cases.rows()))
    clashing = cases.clashing(spark).withColumns({c: F.lit("x") for c in ("grp", "hash", "part", "pos", "tampered", "first", "total", "changed")})
    assert Counter(map(tuple, Table(clashing).query(monkeypatch).collect())) == want
    one = [(5, "a\nb", None, None, 3)]
    assert list(map(tuple, Table(spark.createDataFrame(one, cases.SCHEMA)).query(monkeypatch).collect())) == brute(one)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_trees_of_any_size_over_many_parts(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "MERGED", 2)
    sizes = {"+a": 1, "+b": 2, "+c": 3, "+d": 28, "+e": 9, "+f": 50}
    rows = [(g, i, hashlib.sha256(f"{g}{i}".encode()).digest()) for g, n in sizes.items() for i in range(n)]
    made = merkle.build(spark.createDataFrame(rows, "grp string, id bigint, hash binary"), fanout, 6)
    want = {g: tree([r[2].hex() for r in rows if r[0] == g], fanout) for g in sizes}
    assert {r.grp: r.hash.hex() for r in made.roots.collect()} == {g: w[0] for g, w in want.items()}
    nodes = made.nodes.collect()
    assert len(nodes) == len({(r.grp, r.level, r.idx) for r in nodes}) == sum(sum(merkle.level_sizes(n, fanout)[1:]) for n in sizes.values())
    for r in merkle.prove(made, keep=True).collect():
        assert [(p.place, [bytes(o).hex() for o in p.others]) for p in r.proof] == want[r.grp][1][r.id]
        assert r.folded == r.root == want[r.grp][0]
    # Another seventh of the rows in one part changes nothing but the parts.
    again = merkle.build(spark.createDataFrame(rows[::-1], "grp string, id bigint, hash binary"), fanout)
    assert sorted(map(tuple, again.roots.collect())) == sorted(map(tuple, made.roots.collect()))


@pytest.mark.parametrize("above", [False, True])
def test_every_leaf_is_folded_whatever_root_is_given(spark, above):
    rows = [("+a", i, hashlib.sha256(str(i).encode()).digest()) for i in range(40)]
    made = merkle.build(spark.createDataFrame(rows, "grp string, id bigint, hash binary"), 3, 6)
    want, wrong = made.roots.first().hash.hex(), bytes(32)
    made.roots = made.roots.withColumn("hash", F.lit(wrong))
    tops = made.roots.select("grp", F.col("hash").alias("root"), F.lit(None).cast(merkle._PROOF).alias("proof")) if above else None
    got = merkle.prove(made, tops).collect()
    assert len(got) == 40 and {(r.root, r.folded) for r in got} == {(wrong.hex(), want)}


def test_equal_rows_fill_many_parts(spark):
    digest = hashlib.sha256(b"x").digest()
    made = merkle.build(spark.createDataFrame([("", 1, digest)] * 100, "grp string, id bigint, hash binary"), 3, 10)
    assert made.leaves.groupBy("part").count().agg(F.max("count")).first()[0] < 50
    assert made.roots.first().hash.hex() == tree([digest.hex()] * 100, 3)[0]
    with pytest.raises(ValueError):
        merkle.build(made.leaves.select("grp", "id", "hash"), 1)
