"""Awkward documents: nulls, empty and very long texts, ties, repeated rows, names that clash."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(30_000))
SHARED = "the same line stands in many documents"


def rows():
    base = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, "one", "en", None, 3),
        (4, LONG, "en", "b", len(LONG)),
        (5, "alpha beta gamma delta epsilon zeta", "en", "b", 35),
        (6, "ALPHA  beta\tgamma delta epsilon zeta", "en", "b", 36),
        (7, "alpha beta gamma delta epsilon zeta", None, None, 35),
        (None, "no id here at all", "fr", "a", 17),
        (None, None, None, None, None),
        (8, "é ñ ü 漢字 \U0001f600 ß", "de", "a", 13),
        (9, "repeated row of words", "en", "a", 21),
        (9, "repeated row of words", "en", "a", 21),
    ]
    return base + [(100 + i, f"own text number {i} of this one\n  {SHARED} \nend {i}", "en", "c" if i % 3 else "b", 60) for i in range(12)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    extra = ("id", "fp", "mark", "row", "score", "kept", "size", "shard", "slot", "n_lines", "known", "level", "value")
    return docs(spark).withColumns({c: F.lit(1) for c in extra})
