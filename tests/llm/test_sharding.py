import zlib
from collections import Counter

from tests.llm import cases
from tidelog.llm import sharding


def test_sizes_slots_and_digests(spark):
    rows = cases.rows()
    out = sharding.shard_documents(cases.clashing(spark)).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == want
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_groups_stay_together_and_bytes_even(spark):
    rows = [(i, f"group {i % 40} " * 30, "en", "a", 0) for i in range(400)] + [(1000 + i, f"single {i} " * (i % 50 + 1), "en", "a", 0) for i in range(3000)] + [(9000 + i, "hot text " * 20, "en", "a", 0) for i in range(1200)]
    out = sharding.shard_documents(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    load = Counter()
    for r in out:
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.02 * min(load.values()) and len(load) == 16
    places = {}
    for r in out:
        places.setdefault(r.gid, Counter())[r.shard] += 1
    hot = next(c for c in places.values() if sum(c.values()) == 1200)
    assert len(hot) <= 12
    small = [c for c in places.values() if sum(c.values()) == 10]
    assert len(small) == 40 and sum(len(c) == 1 for c in small) >= 36


def test_same_again_and_empty(spark):
    a, b = (sorted(map(tuple, sharding.shard_documents(cases.docs(spark)).collect()), key=str) for _ in range(2))
    assert a == b
    assert sharding.shard_documents(cases.empty(spark)).count() == 0
