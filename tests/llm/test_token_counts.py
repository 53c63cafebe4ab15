import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import cases
from tidelog.llm import token_counts as tc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tc.tokenizer_path())


@pytest.fixture(scope="module")
def tables():
    return tc.vocabulary(tc.tokenizer_path())


def test_every_prefix_has_the_count_of_the_library(library, tables):
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "字", "\U0001f600", "the", "ing", "▁", "1", ".", "—", "\x00", "e", "th", "      ", "\r\n", "á", "<s>", "</s>", "<unk>", "<0x41>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(600)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x600)])) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [" " * 70, "a" * 50, "ab" * 40, "\n" * 20, " \n " * 10]
    for t in texts:
        assert tc.running(tables.of(t)).tolist() == [len(library.encode(t[: k + 1])) for k in range(len(t))], t


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tc, "MOST", 3)
    small = tc.vocabulary.__wrapped__(tc.tokenizer_path())
    t = cases.LONG[:3000]
    assert int(tc.running(small.of(t))[-1]) == len(library.encode(t)) and len(small.young) <= 4 and len(small.pairs) <= 13


def test_query_equals_the_library_on_whole_texts(spark, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = tc.op12_token_counts(spark, SF)
    assert got.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        t, n = rows[r.doc_id], len(library.encode(rows[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 4096)
        assert r.fit_chars == len(t) if n <= 4096 else len(library.encode(t[: r.fit_chars])) <= 4096 < len(library.encode(t[: r.fit_chars + 1]))


def test_questions_are_answered_from_the_store(spark, library):
    docs = cases.docs(spark)
    stored = tc.counts(docs, tc.tokenizer_path()).withColumn("k", F.lit(17)).select("doc_id", "n_tokens", tc.longest_prefix("prefixes", 5).alias("fit"), tc.tokens_at("prefixes", "k").alias("at"))
    want = sorted((str(i), len(library.encode(t or "")), max((k for k in range(len(t or "") + 1) if len(library.encode((t or "")[:k])) <= 5), default=0) if len(t or "") < 500 else None, len(library.encode((t or "")[:17]))) for i, t, *_ in cases.rows())
    got = sorted((str(r.doc_id), r.n_tokens, r.fit, r.at) for r in stored.collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert all(g[2] == w[2] for g, w in zip(got, want, strict=True) if w[2] is not None)
    cut = tc.truncated(docs, tc.tokenizer_path(), 5)
    assert cut.columns == docs.columns and all(r.text is None or len(library.encode(r.text)) <= 5 for r in cut.collect())
    assert cut.where("text is null").count() == 2


def test_awkward_tables(spark):
    path = tc.tokenizer_path()
    assert tc.counts(cases.empty(spark), path).count() == 0
    plain, clash = (sorted(map(str, tc.counts(d, path).collect())) for d in (cases.docs(spark), cases.clashing(spark).withColumns({c: F.lit(1) for c in ("n_bytes", "n_tokens", "prefixes")})))
    assert plain == clash and len(plain) == len(cases.rows())
