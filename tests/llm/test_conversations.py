"""Conversation repair against a version that tries every edit, on small parts and on whole ones."""

import hashlib
import random
import zlib
from functools import cache
from itertools import pairwise

import pytest

from sieveworks.llm import conversations as C
from sieveworks.llm import queries

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # states by the last initial
WHITE = " \t\n\v\f\r"


def brute(rows: list[tuple[str, str]]) -> dict:
    """rows: role and text after damage, in order."""
    faults, seen = [], set()
    for role, text in rows:
        solid = text.strip(WHITE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserted):
        """Cheapest cost, least audit and repaired lines of the rows from i on."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, letter, then, line):
            if then is not None:
                c, s, lines = then
                found.append((cost + c, letter + s, (*line, *lines)))

        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in NEXT:
                    add(3, "I", best(i, role[0], inserted + 1), (f"{role}:",))
        if i < len(rows):
            role, text = rows[i]
            add(4, "D", best(i + 1, state, 0), ())
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in NEXT:
                    add(extra, "K", best(i + 1, role[0], 0), (f"{role}:{text}",))
                for other in ("user", "assistant"):
                    if (state, other[0]) in NEXT:
                        add(3 + extra, "R", best(i + 1, other[0], 0), (f"{other}:{text}",))
        return min(found, default=None)

    for i in range(len(rows), -1, -1):  # from the end on, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, lines = best(0, "", 0)
    out = {k: sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def gaps(turns):
    turns = [t for t in turns if t is not None]
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def after_damage(rows):
    """What is left of (conv_id, turn, role, text), by conversation and in order."""
    out = {}
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        into = out.setdefault(conv_id, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        into += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {i: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).hexdigest())) for i, r in out.items()}


def wanted(rows):
    return {i: {"gaps": gaps([x[0] for x in r])} | brute([x[1:] for x in r]) for i, r in after_damage(rows).items()}


def found(report):
    return {r.conv_id: {c: r[c] for c in report.columns if c != "conv_id"} for r in report.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_least_audit(seed):
    rng = random.Random(seed)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "Well?", "and", "", f"{rng.random()}.", f"{rng.random()}"])) for _ in range(rng.randrange(9))]
        want = brute(rows)
        part, seen = C._Part(1, 0, 0), set()
        for role, text in rows:
            solid = text.strip(WHITE)
            part.add(None, role, text, 1, (role, text) not in seen, not solid, bool(solid) and solid[-1] not in ".!?")
            seen.add((role, text))
        row = dict(zip(C.PARTS.names, part.row(True), strict=True))
        assert {k: row[k] for k in want} == want, rows


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_conversation_repair(spark, sf_dir)) == wanted(rows)


def test_odd_rows_and_long_conversations(spark, tmp_path, request):
    """Nulls, ties, repeated rows, no rows left, clashing names, and a conversation in many parts."""
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "A."), (7, None, "user", None), (7, None, "user", "So."), (7, 1, "tool", "x."), (7, 1, "tool", "x."), (7, 1, None, "é\n "), (8, 3, "system", "S."), (8, 9, "system", "T")]
    rows += [(9, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{t}.", f"{t}"])) for t in range(700)]
    rows += [(100 + k, t, rng.choice(["user", "assistant"]), f"{k} {t}.") for k in range(60) for t in range(rng.randrange(1, 4))]
    table = spark.createDataFrame([(*r, "other", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part string, times int")
    table.repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    want = wanted(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so that the long one lies in several tasks
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert any(not after for after in after_damage(rows).values())
    assert found(queries.op12_conversation_repair(spark, str(tmp_path))) == want
    report, turns = C.repaired(C.damaged(table), times=C.F.col("times"))
    lines = {}
    for r in sorted(turns.collect(), key=lambda r: (r.piece, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv_id, row in found(report).items():
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(lines.get(conv_id, [])).encode()).hexdigest() == want[conv_id]["repaired_sha256"]


def test_tables_of_parts_give_the_same():
    """Tables of parts, joined, against one search over all rows."""
    rng = random.Random(5)
    for _ in range(200):
        signature = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 14)))
        cuts = sorted(rng.randrange(len(signature) + 1) for _ in range(3))
        pieces = [signature[a:b] for a, b in pairwise([0, *cuts, len(signature)])]
        columns = [[1] * len(pieces), [0] * len(pieces), list(range(len(pieces))), pieces, [None] * len(pieces), [None] * len(pieces), *[[0] * len(pieces)] * 5, ["u"] * len(pieces), ["a"] * len(pieces)]
        batch = C.pa.RecordBatch.from_arrays([C.pa.array(c) for c in columns], names=[str(k) for k in range(len(columns))])
        plan = [r for b in C._planned(iter([batch])) for r in b.to_pylist()]
        audit = "".join(C.Search(p, r["enter"]).audit(r["leave"]) for p, r in zip(pieces, plan, strict=True)) + "I" * C._AT_END[plan[-1]["leave"]]
        assert (plan[-1]["cost"], audit) == C.cheapest(signature)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    report, turns = C.repaired(empty, ids=empty)
    assert report.collect() == [] and turns.collect() == []
