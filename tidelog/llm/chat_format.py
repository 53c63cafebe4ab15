"""Chat formatting: role repair of least cost over an automaton of legal turns, then rendering.

A conversation may open with a system turn; user and assistant alternate, user first, assistant last. Every source turn gets
a label. Costs: ``RELABEL`` for another role than its own (``UNKNOWN`` if its role is none of the three), ``MERGE`` to join the
turn to the one before under the same label, ``INSERT`` for each empty turn put in where two labels may not meet or where the
end is missing. Of the cheapest repairs the one with the first smaller label (system, user, assistant) is taken.

The program runs over any split of a conversation: turns are dealt by ranges of (conversation, turn); each range sums up
the conversations at its two ends as, for every state before, the cost of the best path to every state after and the paths' order.
The driver joins these few numbers per range into the states at the borders, and the ranges then label their turns, each between
known states. So a conversation of any length is never gathered, and the labels don't depend on the ranges.

Output is one row per source turn, with its fragment: what rendering adds with this turn. The fragments in order of position
are the rendered conversation; a merged run is never one string. Marker openings "<|" inside texts are written "< |".

Null texts are empty, null or unknown roles cost the same under every label, null turns come last, ties go by role, MD5 of the text (null as empty) and
place in the table, roles are read without case and without white space of ASCII around them, null conv_ids form one conversation. Conversations of any length and texts of any length are whole. Repeated
rows are turns of their own. An empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import blocks_of, keyed_runs, read_table, shared_dir, written

ROLES = ("system", "user", "assistant")
#: What may stand around a role.
BLANKS = " \t\n\x0b\x0c\r"
SYSTEM, USER, ASSISTANT, START = range(4)
RELABEL, UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
_FAR = 1 << 50
#: Turns in a range, and ranges whose numbers the driver joins.
PER_RANGE, MOST_RANGES = 50_000, 100_000
#: Empty turns to put in between a state and a label, where the two may meet at all.
INSERTED = {(START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, SYSTEM): (), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,), (USER, USER): (), (USER, ASSISTANT): (), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): ()}
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
MEET = {k: INSERT * len(v) + MERGE * (k[0] == k[1]) for k, v in INSERTED.items()}
END = [INSERT * len(CLOSING[s]) for s in range(4)]


def role_number(role: str | None) -> int:
    role = (role or "").strip(BLANKS).lower()
    return ROLES.index(role) if role in ROLES else -1


def label_cost(role: int, label: int) -> int:
    return UNKNOWN if role < 0 else RELABEL * (role != label)


def advance(costs: list[int], order: list[int], role: int) -> tuple[list[int], list[int], list[int]]:
    """Costs, path order and predecessors of the states after a turn; order says whose best path comes first."""
    out, back = [_FAR] * 4, [-1] * 4
    for label in (SYSTEM, USER, ASSISTANT):
        own = label_cost(role, label)
        best = None
        for state in range(4):
            if costs[state] < _FAR and (state, label) in MEET:
                found = (costs[state] + MEET[state, label] + own, order[state])
                if best is None or found < best:
                    best, back[label] = found, state
        if best is not None:
            out[label] = best[0]
    ranks = [0] * 4
    reached = sorted((order[back[s]], s) for s in range(4) if back[s] >= 0)
    for k, (_, s) in enumerate(reached):
        ranks[s] = k
    return out, ranks, back


def summary(roles: list[int]) -> list[tuple[list[int], list[int]]]:
    """For every state before the turns: costs and path order of the states after them."""
    out = []
    for entry in range(4):
        costs = [_FAR] * 4
        costs[entry] = 0
        order = [0] * 4
        for role in roles:
            costs, order, _ = advance(costs, order, role)
        out.append((costs, order))
    return out


def labels(roles: list[int], entry: int = START, leave: int | None = None) -> list[int]:
    """The labels of the cheapest path from a state to another (the cheapest end if None)."""
    costs = [_FAR] * 4
    costs[entry] = 0
    order, trail = [0] * 4, []
    for role in roles:
        costs, order, back = advance(costs, order, role)
        trail.append(back)
    state = min(range(4), key=lambda s: (costs[s] + END[s], order[s])) if leave is None else leave
    path = []
    for back in reversed(trail):
        path.append(state)
        state = back[state]
    return path[::-1]


def borders(parts: list[tuple]) -> dict[tuple[int, int], tuple[int, int | None, int]]:
    """(part, 0 or 1) to (state before, state after or None, turns before) for the first and last conversations of the parts.

    Each part is (part, first, last, whole, [(turns, summary), ...]) in order, whole if it holds one conversation.
    """
    chains: list[tuple[object, list]] = []
    for part, first, last, whole, ends in parts:
        segments = [(first, (part, 0), ends[0])] + ([] if whole else [(last, (part, 1), ends[1])])
        for conv, place, end in segments:
            if not (chains and chains[-1][0] == (conv,)):
                chains.append(((conv,), []))
            chains[-1][1].append((place, end))
    out = {}
    for _, chain in chains:
        after = [END]
        for _, (_, table) in reversed(chain[1:]):
            after.append([min(table[s][0][t] + after[-1][t] for t in range(4)) for s in range(4)])
        after.reverse()
        state, turns = START, 0
        for k, (place, (n, table)) in enumerate(chain):
            costs, order = table[state]
            leave = min((t for t in range(4) if costs[t] < _FAR), key=lambda t: (costs[t] + after[k][t], order[t]))
            out[place] = (state, leave if k + 1 < len(chain) else None, turns)
            state, turns = leave, turns + n
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 36
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(uid, uid + batch.num_rows), pa.int64())], names=[*batch.schema.names, "uid"])
        uid += batch.num_rows


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        roles = pa.array([role_number(r) for r in batch.column(2).to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), roles, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=["uid", "conv", "role", "part", "place"])
        at += n


def _conversations(table: pa.Table) -> Iterator[tuple[object, int, int]]:
    convs = table.column("conv").to_pylist()
    start = 0
    for i in range(1, len(convs) + 1):
        if i == len(convs) or convs[i] != convs[start]:
            yield convs[start], start, i
            start = i


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, source_role, text, position, role, action, before, after, fragment) of every source turn.

    before and after list the roles of the empty turns put in before it and, at the conversation's end, after it.
    """
    spark = turns.sparkSession
    kinds = dict(turns.dtypes)
    conv = kinds[conv_col]
    source = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("source_role"), F.col(text_col).alias("text"))
    path = f"{shared_dir(spark)}/tidelog/turns-{uuid.uuid4().hex}"
    numbered = source.mapInArrow(_number, f"conv {conv}, turn {kinds[turn_col]}, source_role string, text string, uid bigint")
    numbered.write.option("compression", "zstd").parquet(path)
    numbered = spark.read.schema(numbered.schema).parquet(path)
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("source_role").asc_nulls_last(), F.col("mark").asc(), F.col("uid").asc()]
    narrow = numbered.select("conv", "turn", "source_role", F.md5(F.coalesce("text", F.lit(""))).alias("mark"), "uid")
    n = numbered.count()
    ranges = blocks_of(n, max(PER_RANGE, n // MOST_RANGES))
    ordered = narrow.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("uid", "conv", "source_role")
    ordered = written(ordered.mapInArrow(_place, f"uid bigint, conv {conv}, role int, part int, place bigint"), "turns-order")
    parts = 1 + (ordered.agg(F.max("part")).first()[0] or 0)
    dealt = ordered.repartitionById(parts, "part").sortWithinPartitions("part", "place")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in keyed_runs(batches, "part"):
            roles = table.column("role").to_pylist()
            found = list(_conversations(table))
            (first, a, b), (last, c, d) = found[0], found[-1]
            rows = [(b - a, summary(roles[a:b])), (d - c, summary(roles[c:d]))] if len(found) > 1 else [(b - a, summary(roles[a:b]))]
            numbers = [[n, *[x for costs, order in s for x in (*costs, *order)]] for n, s in rows]
            kind = table.schema.field("conv").type
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([first], kind), pa.array([last], kind), pa.array([len(found) == 1]), pa.array([numbers], pa.list_(pa.list_(pa.int64())))], names=["part", "first", "last", "whole", "ends"])

    def table_of(numbers: list[int]) -> tuple[int, list]:
        rest = numbers[1:]
        return numbers[0], [(rest[8 * s : 8 * s + 4], rest[8 * s + 4 : 8 * s + 8]) for s in range(4)]

    summed = dealt.mapInArrow(ends, f"part int, first {conv}, last {conv}, whole boolean, ends array<array<bigint>>").collect()
    known = spark.sparkContext.broadcast(borders([(r.part, r.first, r.last, r.whole, [table_of(x) for x in r.ends]) for r in sorted(summed, key=lambda r: r.part)]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in keyed_runs(batches, "part"):
            roles = table.column("role").to_pylist()
            found = list(_conversations(table))
            given, states, before, after, positions = [], [], [], [], []
            for k, (_, a, b) in enumerate(found):
                side = 0 if k == 0 else 1 if k == len(found) - 1 else None
                entry, leave, turn = known.value[int(part), side] if side is not None else (START, None, 0)
                path = labels(roles[a:b], entry, leave)
                earlier = [entry, *path[:-1]]
                given += path
                states += earlier
                before += [[ROLES[x] for x in INSERTED[s, p]] for s, p in zip(earlier, path, strict=True)]
                after += [[] for _ in path[:-1]] + [[ROLES[x] for x in CLOSING[path[-1]]] if leave is None else None]
                positions += range(turn, turn + b - a)
            merged = [s == p for s, p in zip(states, given, strict=True)]
            ends_here = [x is not None for x in after]
            last = [e and (i + 1 == len(given) or positions[i + 1] == 0) for i, e in enumerate(ends_here)]
            yield pa.RecordBatch.from_arrays([table.column("uid").combine_chunks(), pa.array(positions, pa.int64()), pa.array([ROLES[x] for x in given]), pa.array([x != START for x in states]), pa.array(merged), pa.array(last), pa.array(before, pa.list_(pa.string())), pa.array([x or [] for x in after], pa.list_(pa.string()))], names=["uid", "position", "role", "inner", "merged", "last", "before", "after"])

    labelled = dealt.mapInArrow(label, "uid bigint, position bigint, role string, inner boolean, merged boolean, last boolean, before array<string>, after array<string>")
    joined = numbered.join(labelled, "uid")
    relabelled = F.lower(F.btrim(F.coalesce("source_role", F.lit("")), F.lit(BLANKS))) != F.col("role")
    action = F.when(F.col("merged") & relabelled, "relabel and merge").when(F.col("merged"), "merge").when(relabelled, "relabel").otherwise("keep")
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))

    def empties(column: str):
        return F.concat_ws("", F.transform(column, lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n<|end|>\n"))))

    opening = F.when(F.col("merged"), F.lit("\n")).otherwise(F.concat(F.when(F.col("inner"), F.lit("<|end|>\n")).otherwise(F.lit("")), empties("before"), F.lit("<|"), F.col("role"), F.lit("|>\n")))
    ending = F.when(F.col("last"), F.concat(F.lit("<|end|>\n"), empties("after"))).otherwise(F.lit(""))
    return joined.select(F.col("conv").alias("conv_id"), "turn", "source_role", "text", "position", "role", action.alias("action"), "before", "after", F.concat(opening, body, ending).alias("fragment"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(read_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "position", "source_role", "role", "action", F.concat_ws(",", "before").alias("before"), F.concat_ws(",", "after").alias("after"), "fragment")


def _least(*found: str) -> str:
    """The cheapest of (cost, path) pairs, given as cost and state before, with the next label's own cost."""
    return "list_min([" + ", ".join(f"{{'c': {cost}, 'p': p{state}}}" for cost, state in (f.split("|") for f in found)) + "])"


def _own(label: int) -> str:
    return f"CASE WHEN r < 0 THEN {UNKNOWN} WHEN r = {label} THEN 0 ELSE {RELABEL} END"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The program by whole paths, conversation by conversation.
ORACLE = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role AS source_role, coalesce(text, '') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, md5(coalesce(text, ''))) - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS n,
    CASE lower(trim(role, {_BLANKS})) WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE -1 END AS r FROM conversations),
steps AS (
  SELECT conv_id, position, n, {_own(0)} AS c0, '0' AS p0, {_own(1)} AS c1, '1' AS p1, {_own(2)} + {INSERT} AS c2, '2' AS p2 FROM turns WHERE position = 0
  UNION ALL
  SELECT conv_id, position, n, b0.c + {_own(0)}, b0.p || '0', b1.c + {_own(1)}, b1.p || '1', b2.c + {_own(2)}, b2.p || '2' FROM (
    SELECT t.conv_id, t.position, t.n, t.r, {_least(f"c0 + {MERGE}|0")} AS b0, {_least("c0|0", f"c1 + {MERGE}|1", "c2|2")} AS b1, {_least(f"c0 + {INSERT}|0", "c1|1", f"c2 + {MERGE}|2")} AS b2
    FROM steps s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.position = s.position + 1)),
paths AS (SELECT conv_id, {_least(f"c0 + {2 * INSERT}|0", f"c1 + {INSERT}|1", "c2|2")}.p AS path FROM steps WHERE position = n - 1),
told AS (SELECT t.*, CAST(substr(path, CAST(position + 1 AS BIGINT), 1) AS INTEGER) AS l, CASE WHEN position > 0 THEN CAST(substr(path, CAST(position AS BIGINT), 1) AS INTEGER) ELSE 3 END AS s
  FROM turns t JOIN paths p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
named AS (SELECT *, ['system', 'user', 'assistant'][l + 1] AS role, s = l AS merged, CASE WHEN l = 2 AND s IN (0, 3) THEN 'user' ELSE '' END AS before,
  CASE WHEN position < n - 1 OR l = 2 THEN '' WHEN l = 1 THEN 'assistant' ELSE 'user,assistant' END AS after FROM told),
worded AS (SELECT *, lower(trim(coalesce(source_role, ''), {_BLANKS})) <> role AS relabelled, chr(10) AS nl FROM named)
SELECT conv_id, turn, CAST(position AS BIGINT) AS position, source_role, role,
  CASE WHEN merged AND relabelled THEN 'relabel and merge' WHEN merged THEN 'merge' WHEN relabelled THEN 'relabel' ELSE 'keep' END AS action, before, after,
  CASE WHEN merged THEN nl ELSE CASE WHEN position > 0 THEN '<|end|>' || nl ELSE '' END || CASE WHEN before <> '' THEN '<|user|>' || nl || '<|end|>' || nl ELSE '' END || '<|' || role || '|>' || nl END
  || replace(body, '<|', '< |')
  || CASE WHEN position < n - 1 THEN '' ELSE '<|end|>' || nl || CASE after WHEN 'assistant' THEN '<|assistant|>' || nl || '<|end|>' || nl
     WHEN 'user,assistant' THEN '<|user|>' || nl || '<|end|>' || nl || '<|assistant|>' || nl || '<|end|>' || nl ELSE '' END END AS fragment
FROM worded
"""

QUERIES = {"op1_chat_formatting": op1_chat_formatting}
ORACLES = {"op1_chat_formatting": ORACLE}
