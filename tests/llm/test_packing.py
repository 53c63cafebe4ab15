import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tests.llm import cases
from tidelog.llm import packing


def check(rows, out, tokens, window):
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(tokens.whole(r[1] or "") + b"\x01\0\0\0")
    pieces = defaultdict(list)
    for p in out:
        pieces[p.doc_id].append(p)
    for who, texts in want.items():
        mine = pieces.pop(who)
        assert sum(p.length for p in mine) == sum(len(t) // 4 for t in texts)
        for p in mine:
            assert any(len(t) // 4 == p.doc_tokens and zlib.crc32(t[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for t in texts)
    assert not pieces
    sequences = defaultdict(list)
    for p in out:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0


def test_pieces_tile_documents_and_sequences(spark):
    tokens = packing.Tokens(packing.tokenizer_path(), 500)
    for n, window in ((1, 2048), (5, 64)):
        out = packing.pack(cases.clashing(spark).repartition(n), packing.tokenizer_path(), window=window, open_windows=3).collect()
        check(cases.rows(), out, tokens, window)


def test_tree_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    out = packing.pack(cases.docs(spark).repartition(7), packing.tokenizer_path(), window=256).collect()
    check(cases.rows(), out, packing.Tokens(packing.tokenizer_path()), 256)


def test_tokens_equal_the_tokenizer():
    tokens = packing.Tokens(packing.tokenizer_path(), 40)
    rng = random.Random(2)
    odd = ["it's I'LL don'T 12a3 <|endoftext|>x", "ΟΔΟΣ İstanbul ﬁ 中文字 é", "ª º ² ½ ß ŉ", "", " \n", "'s't're'd", "a\x1cb \x85 c"]
    odd += ["".join(rng.choice("aAzÉñ'’.,;!?-_<|>01 \n\t́ßİſKÅ²ªΣ") for _ in range(50)) for _ in range(500)]
    odd += ["".join(chr(rng.choice((rng.randrange(0x20, 0x250), rng.randrange(0x250, 0x3000), 0x27, 0x20))) for _ in range(60)) for _ in range(500)]
    odd += ["".join(chr(x) for x in range(1, 0x250) if x != 0x20), None]
    for at in range(0, len(odd), 50):
        for text, ids in zip(odd[at : at + 50], tokens.of(pa.array(odd[at : at + 50], pa.string())), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokens.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_ids_round_trip_and_empty(spark):
    out = packing.pack(cases.docs(spark), packing.tokenizer_path(), keep_ids=True).where("doc_id = 4").orderBy("start").collect()
    assert b"".join(bytes(p.ids) for p in out) == packing.Tokens(packing.tokenizer_path()).whole(cases.LONG) + b"\x01\0\0\0"
    assert packing.pack(cases.empty(spark), packing.tokenizer_path()).count() == 0
