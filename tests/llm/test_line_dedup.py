import hashlib

import pytest

from tests.llm import cases
from tidelog.llm import line_dedup


def slow(rows, least=10):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(space))
    seen = {}
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_matches_brute_force_either_way(spark, broadcast_keys):
    out = line_dedup.drop_repeated_lines(cases.clashing(spark), broadcast_keys=broadcast_keys)
    got = [(r.doc_id, r.stripped.n_lines, r.stripped.n_dropped, hashlib.sha256(r.stripped.kept.encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=str) == sorted(slow(cases.rows()), key=str)
    assert out.columns[:-1] == cases.clashing(spark).columns


def test_first_occurrence_stays_once(spark):
    out = line_dedup.drop_repeated_lines(cases.docs(spark), keep="first").collect()
    holders = [r.doc_id for r in out if cases.SHARED in r.stripped.kept]
    assert holders == [100]


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(cases.empty(spark)).count() == 0
    assert line_dedup.stage_line_dedup(spark, cases.empty(spark), "").columns == cases.empty(spark).columns


def test_merged_filter_reaches_the_driver_in_few_bytes(spark, monkeypatch):
    import numpy as np

    size = (1 << line_dedup.SEGMENT_BITS) // 8
    rng = np.random.default_rng(3)
    for share in (0.00001, 0.01, 1 / 32, 0.5):
        twice = rng.random(1 << line_dedup.SEGMENT_BITS) < share
        data = line_dedup.segment_bytes(twice)
        assert len(data) <= min(size, 4 * int(twice.sum()))
        assert (line_dedup.segment_bits(data) == np.packbits(twice)).all()
    read = []
    whole = line_dedup.segment_bits
    monkeypatch.setattr(line_dedup, "segment_bits", lambda data: read.append(len(data)) or whole(data))
    lines = "\n".join(f"line {i} of them" for i in range(3000))
    docs = spark.createDataFrame([(i, lines) for i in range(3)], "doc_id bigint, text string")
    packed, bits = line_dedup.twice_filter(docs, "text", 1)
    assert sum(read) <= 4 * 2 * 3000 and int(np.unpackbits(packed).sum()) > 5000 and bits == 18
