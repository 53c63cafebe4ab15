import random
import zlib

import numpy as np
import pyarrow as pa

from tests.llm import cases
from tidelog.llm import quality
from tidelog.llm.common import written


def corpus(n=1500):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choices(words, k=40))
        kind = i % 10
        if kind == 0:
            text += " vile{} vile{}".format(rng.randint(0, 5), rng.randint(0, 5))
        if kind == 1:
            text = "!!! ".join(text.upper().split())
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return docs, labels


def test_held_out_accuracy_and_stage(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, cases.SCHEMA)
    known = spark.createDataFrame(labels[:900], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r.verdict for r in quality.classify(d, known).collect()}
    test = range(900, 1500)
    assert sum(out[i].kept == (i % 10 > 1) for i in test) >= 0.97 * len(test)
    again = {r.doc_id: r.verdict.score for r in quality.classify(d.repartition(5), known).collect()}
    assert again == {i: v.score for i, v in out.items()}


def test_awkward_rows_and_missing_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, None), (None, 0, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, some):
        out = quality.classify(cases.clashing(spark), labels)
        assert out.columns[:-1] == cases.clashing(spark).columns
        assert all(r.verdict.kept for r in out.collect()) and out.count() == len(cases.rows())
    docs, labels = corpus(600)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    mixed = spark.createDataFrame(docs, cases.SCHEMA).union(cases.docs(spark))
    assert quality.classify(mixed, known).count() == 600 + len(cases.rows())
    assert quality.classify(cases.empty(spark), known).count() == 0


def test_every_unlabelled_document_teaches(spark, monkeypatch):
    monkeypatch.setattr(quality, "SURE", 0.985)
    rng = random.Random(3)
    docs, labels = corpus(1000)
    for i in range(1000, 7000):
        text = " ".join(rng.choices([f"w{k}" for k in range(200)], k=40))
        docs.append((i, "!!! ".join((text + f" rareword{i % 300}").upper().split()) if i % 10 == 1 else text, "en", "s", len(text)))
    d = spark.createDataFrame(docs, cases.SCHEMA)
    seen = []
    exchanged = quality.exchanged
    quality.exchanged = lambda pool, edges, views: seen.append((pool.count(), exchanged(pool, edges, views))) or seen[-1][1]
    try:
        model = quality.fit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    finally:
        quality.exchanged = exchanged
    assert [n for n, _ in seen] == [6000] * quality.ROUNDS
    taught = seen[-1][1][0]
    assert taught[:, -1].sum() > 4500 and (taught[:, :-1].max(axis=1) <= taught[:, -1]).all()
    assert model.content.weights[quality.word_features("rareword7")[-1]] < 0


def test_every_word_of_a_token_is_seen():
    joined = quality.word_features("one,two,three,four,vile")
    assert set(quality.word_features("vile")[1:]) <= set(joined) and quality.word_features("vile")[1] in joined


def test_without_a_model_every_document_stays(spark):
    docs = spark.createDataFrame(corpus(60)[0], cases.SCHEMA)
    for known in ([(i, 0, 0) for i in range(40)], [(i, int(i < 3), 0) for i in range(10)]):
        labels = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
        assert all(r.verdict.kept for r in quality.classify(docs, labels).collect())


def test_a_repeated_id_brings_one_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(quality, "train", lambda words, meta, good, *rest: seen.append(len(good)) or quality.Model(0.5))
    docs = spark.createDataFrame([(i, f"text {i}", "en", "a", 6) for i in range(60)], cases.SCHEMA)
    many = spark.range(5000).select(F.lit(3).cast("bigint").alias("doc_id"), F.concat(F.lit("copy "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(6).cast("bigint").alias("n_chars"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    quality.fit(docs.union(many), labels)
    assert 40 <= seen[0] <= 60


def test_sums_do_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    rows = quality.Rows.of([rng.integers(0, 50, rng.integers(0, 9)) for _ in range(300)])
    weights, values = rng.normal(size=50), rng.normal(size=300)
    lists = [rows.features[a:b] for a, b in zip(rows.starts[:-1], rows.starts[1:], strict=True)]
    chosen = rng.random(50) < 0.4
    few = rows.only(chosen)
    assert [few.features[a:b].tolist() for a, b in zip(few.starts[:-1], few.starts[1:])] == [x[chosen[x]].tolist() for x in lists]
    packed = quality.Rows.unpacked(pa.chunked_array([pa.array([quality.packed(np.unique(x).astype("<u4")) for x in lists], pa.binary())]))
    assert [packed.features[a:b].tolist() for a, b in zip(packed.starts[:-1], packed.starts[1:])] == [np.unique(x).tolist() for x in lists]
    whole = quality.Rows.blocks
    for most in (1, 7, 10_000):
        quality.Rows.blocks = lambda self, most=most: whole(self, most)
        try:
            assert np.allclose(rows.dot(weights), [weights[x].sum() for x in lists])
            assert np.allclose(rows.spread(values, 50), sum(np.bincount(x, minlength=50) * v for x, v in zip(lists, values, strict=True)))
        finally:
            quality.Rows.blocks = whole


def slow_numbers(text):
    import string

    data = (text or "").encode()
    words, lines, n = data.split(), data.split(b"\n"), max(1, len(data))
    each = max(1, len(words))
    count = lambda kind: sum(chr(x) in kind for x in data if x < 128)
    plain = string.ascii_letters + string.digits + " \t\n\x0b\x0c\r.,;:'\"!?()-"
    return [
        np.log1p(len(data)), np.log1p(len(lines)), np.log1p(len(words)), count(string.ascii_uppercase) / n, count(string.digits) / n,
        sum(x < 128 and chr(x) not in plain for x in data) / n, count("!?") / n, sum(map(len, words)) / each, len(set(words)) / each,
        sum(a == b for a, b in zip(words[:-1], words[1:])) / each, sum(len(x) < 40 for x in lines) / len(lines),
    ]


def test_columns_match_texts_one_by_one():
    rng = random.Random(4)
    texts = [r[1] for r in cases.rows()] + [" lead", "trail \n", " \t", "a a a B!? 12 #$", "é\xa0ß x"]
    texts += ["".join(rng.choice("aAbB1!? \n#é") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    for at in range(0, len(texts), 40):
        part = quality.Texts(pa.array(texts[at : at + 40], pa.string()))
        assert np.allclose(part.numbers(), [slow_numbers(t) for t in texts[at : at + 40]])
        doc, found = part.features()
        for i, text in enumerate(texts[at : at + 40]):
            want = {f for token in (text or "").encode().split() for f in quality.word_features(token.decode())}
            assert found[doc == i].tolist() == sorted(want)
    assert quality.Texts(pa.array([None, ""], pa.string())).features()[0].tolist() == []
    one, two = quality.word_features("Wörter,x1"), quality.word_features("wörter")
    assert len(one) == 5 and len(two) == 4 and one[1:] == [two[1], *one[2:3], *two[2:]] and quality.word_features("x")[1] == one[2]
    odd = ["a" * 50_000, "ab", "ba", "aab", "", "12", "é", "日本語日本語"]
    assert [f for t in odd for f in quality.word_features(t)] == quality.token_features(pa.array(odd, pa.large_string()))[0].tolist()
    many = {tuple(quality.word_features(f"{i}")) for i in range(3000)}
    assert len(many) > 2950
    weights = np.zeros(quality.SPACE)
    weights[two[1]] = 1.0
    feature, starts = quality.token_features(pa.array(["x", "wörter", "wörter."], pa.large_string()), weights)
    assert feature.tolist() == [two[1], two[1]] and starts.tolist() == [0, 0, 1, 2]


def test_metadata_rows():
    edges = [np.array([0.5, 1.5])] * len(quality.NUMBERS)
    numbers = np.array([[0.0] * 11, [1.0] * 11, [2.0] * 11])
    rows = quality.meta_rows(edges, ["en", None, "en"], ["s", "s", None], numbers)
    lists = [rows.features[a:b].tolist() for a, b in zip(rows.starts[:-1], rows.starts[1:])]
    assert [x[:11] for x in lists] == [[k * 13 + i for k in range(11)] for i in range(3)]
    assert all(len(x) == len(set(x)) == 13 and x == sorted(x) for x in lists)
    assert len(quality.meta_rows(edges, [], [], np.zeros((0, 11))).starts) == 1


def test_sample_in_pieces_is_the_sample_at_once(spark):
    rows = [(i, quality.packed(np.array(range(i, 3 * i, 2), np.uint32)), "en", [float(i)], i % 2.0) for i in range(200)]
    sample = written(spark.createDataFrame(rows, "id bigint, words binary, lang string, numbers array<double>, good double").repartition(3), "test-sample")
    words, table = quality.gathered(sample, 5)
    ids = table.column("id").to_pylist()
    assert ids == sorted(range(200), key=lambda i: zlib.crc32(str(i).encode())) and table.column("good").to_pylist() == [i % 2.0 for i in ids]
    assert [words.features[a:b].tolist() for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)] == [list(range(i, 3 * i, 2)) for i in ids]
