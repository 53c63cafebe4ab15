import itertools
import random

from tidelog.llm import chat_format as cf

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


#: The contract's own figures, apart from the module's: which labels may meet at what cost, and what the end costs.
MEET = {(3, 0): 0, (3, 1): 0, (3, 2): 2, (0, 0): 1, (0, 1): 0, (0, 2): 2, (1, 1): 1, (1, 2): 0, (2, 1): 0, (2, 2): 1}
END = (4, 2, 0)


def slow(roles):
    best = None
    for path in itertools.product(range(3), repeat=len(roles)):
        cost, state = 0, 3
        for role, label in zip(roles, path):
            if (state, label) not in MEET:
                break
            cost += MEET[state, label] + (1 if role < 0 else 3 * (role != label))
            state = label
        else:
            found = (cost + END[state], path)
            best = found if best is None or found < best else best
    return list(best[1])


def test_labels_are_cheapest_whole_and_in_parts():
    rng = random.Random(3)
    for n in range(1, 7):
        for _ in range(40):
            roles = [rng.randint(-1, 2) for _ in range(n)]
            want = slow(roles)
            assert cf.labels(roles) == want
            cuts = sorted(rng.sample(range(1, n), rng.randint(0, n - 1)))
            parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
            known = cf.borders([(i, 7, 7, True, [(len(p), cf.summary(p))]) for i, p in enumerate(parts)])
            got = []
            for i, p in enumerate(parts):
                entry, leave, at = known[i, 0]
                assert at == len(got)
                got += cf.labels(p, entry, leave)
            assert got == want


def test_query_matches_brute_force_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(cf, "PER_RANGE", 12)
    from pyspark.sql import functions as F

    rng = random.Random(8)
    roles = ["user", "assistant", "system", "Assistant ", "tool", None]
    rows = [(c, t, rng.choice(roles), rng.choice(["hi", "", None, "a <|user|> b"])) for c in range(25) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (77, 0, "user", "same"), (77, 0, "user", "same")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "uid", "part", "place", "mark", "before")})
    out = cf.repair(df).collect()
    assert len(out) == len(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        assert [r.role for r in mine] == [cf.ROLES[x] for x in slow([cf.role_number(r.source_role) for r in mine])]
        text = "".join(r.fragment for r in mine)
        heads = [h for h in text.split("<|end|>\n") if h]
        said = [h[2 : h.index("|>")] for h in heads]
        assert text.count("<|end|>") == len(said) and said[-1] == "assistant"
        assert all((a, b) in (("system", "user"), ("user", "assistant"), ("assistant", "user")) for a, b in zip(said, said[1:])) and said[0] in ("system", "user")
    assert cf.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation_spans_ranges(spark, monkeypatch):
    monkeypatch.setattr(cf, "PER_RANGE", 400)
    rng = random.Random(1)
    roles = [rng.choice(["user", "assistant", "system"]) for _ in range(3000)]
    out = cf.repair(spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], SCHEMA)).orderBy("position").collect()
    assert [r.role for r in out] == [cf.ROLES[x] for x in cf.labels([cf.role_number(r) for r in roles])]


def test_ties_and_roles_are_read_as_the_sql_reads_them(spark, monkeypatch):
    from collections import Counter

    import duckdb

    rows = [(1, 0, "user", f"text {k}") for k in range(6)] + [(1, 0, "user", "text 1"), (2, 0, "user\n", "a"), (2, 1, "\tAssistant \x0b", "b"), (2, 2, "user\xa0", "c"), (3, None, None, None), (3, None, None, ""), (None, 1, " SYSTEM\r\n", "s")]
    monkeypatch.setattr(cf, "read_table", lambda *_: spark.createDataFrame(rows, SCHEMA))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(cf.ORACLE)
    columns = [c[0] for c in found.description]
    got = cf.op1_chat_formatting(spark, "").select(columns).collect()
    assert Counter(map(tuple, got)) == Counter(found.fetchall())
    assert {r.action for r in got if r.source_role == "user\n"} == {"keep"} and "keep" not in {r.action for r in got if r.source_role == "user\xa0"}
