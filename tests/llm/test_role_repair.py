"""Operator 13 against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from featsieve.llm import role_repair

DONE, BEGUN = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")


def cheapest(initials, faults, merge=False):
    """(cost, audit) by trying edits in the order of (cost, audit); ``merge`` leaves out what a better one has reached."""
    todo, met = [(0, "", 0, "")], set()
    while todo:
        cost, audit, i, made = heapq.heappop(todo)
        if not BEGUN.fullmatch(made) or (merge and (i, made[-1:]) in met):
            continue
        met.add((i, made[-1:]))
        if i == len(initials):
            if DONE.fullmatch(made):
                return cost, audit
        else:
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, made))
            if faults[i] not in "bd":
                late = faults[i] == "t"
                heapq.heappush(todo, (cost + late, audit + "K", i + 1, made + initials[i]))
                for r in "ua":
                    heapq.heappush(todo, (cost + 2 + late, audit + "R", i + 1, made + r))
        for r in "ua":
            heapq.heappush(todo, (cost + 2, audit + "I", i, made + r))


def plain(rows):
    """All results of one conversation's damaged rows (turn, role, text), in order."""
    white, faults, seen = " \t\n\x0b\f\r", [], set()
    for _, role, text in rows:
        left = text.rstrip(white)
        faults.append("b" if not left else "d" if (role, text) in seen else "-" if left[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = {t for t, *_ in rows if t is not None}
    initials = [r[:1] or "#" for _, r, _ in rows]
    cost, audit = cheapest(initials, faults, merge=True)
    lines, made, i = [], "", 0
    for action in audit:
        if action == "K":
            made += initials[i]
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
        elif action != "D":
            made += "u" if BEGUN.fullmatch(made + "u") else "a"
            lines.append({"u": "user", "a": "assistant"}[made[-1]] + ":" + (rows[i][2] if action == "R" else ""))
        i += action != "I"
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(conversations):
    """{conv_id: rows in order} of (conv_id, turn, role, text) rows."""
    out = {}
    for conv, turn, role, text in conversations:
        own = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            own += [(turn, "user" if hit == 4 else role, text)] * (1 + (hit == 3))
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rows in out.items()}


def compare(frame, conversations):
    want = {c: plain(rows) for c, rows in damage(conversations).items()}
    got = {r[0]: tuple(r)[1:] for r in frame.collect()}
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["s-", "u-", "a-", "st", "ut", "at", "ux", "ax", "?-"]), max_size=4), st.integers(0, 4))
def test_parse_and_joined_tables_find_the_cheapest_edits(rows, cut):
    text = "".join(rows)
    want = cheapest([r[0] for r in rows], [r[1].replace("x", "b") for r in rows])
    assert want == cheapest([r[0] for r in rows], [r[1].replace("x", "b") for r in rows], merge=True)
    assert role_repair.best(role_repair.parse(text)) == want
    parts = [role_repair.table(text[: 2 * cut]), role_repair.table(text[2 * cut : 2 * cut + 2]), role_repair.table(text[2 * cut + 2 :])]
    assert role_repair.best(role_repair.joined(role_repair.joined(parts[0], parts[1]), parts[2])[0]) == want


def test_tables_of_the_role_grammar():
    moves, _, accepting = role_repair.ROLES.tables
    accepted = set()
    todo = [("", (0,))]
    for word, stack in todo:
        if stack[-1] in accepting:
            accepted.add(word)
        if len(word) < 7:
            todo += [(word + c, after) for c in "sua" if (after := role_repair.ROLES.shift(stack, c))]
    assert accepted == {w for w in ("", "ua", "sua", "uaua", "suaua", "uauaua", "suauaua")}
    assert len(role_repair.ROLES.tops) == 6


def random_rows(seed, n, conversations):
    draw = random.Random(seed)
    texts = ["Yes.", "No?", "", " \t", "half", "Why not!  ", "naïve…", " "]
    return [(draw.choice(conversations), draw.choice([None, *range(12)]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), draw.choice(texts + [None, "x" * 400])) for _ in range(n)]


@pytest.mark.parametrize("piece_rows", [1, 3, 256])
def test_conversations_over_pieces_and_partitions(spark, piece_rows):
    """Ties, repeated rows, nulls everywhere, and conversations that lie in many pieces and partitions."""
    rows = random_rows(5, 60, [1, 2, None, 3]) + random_rows(6, 40, [*range(10, 40)]) + [(77, 0, "user", "Hi.")] * 7
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pid", "2 as kept", "'x' as `a.b`").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(role_repair.repair(frame, piece_rows), rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_text_keys_dropped_conversations_and_empty_tables(spark):
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(str(dropped), 0, "user", "gone"), ("b", 0, "user", "Long " * 100_000), ("b", 1, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    compare(role_repair.repair(frame), rows)
    found = {r.conv_id: r for r in role_repair.repair(frame).collect()}[str(dropped)]
    assert tuple(found)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert role_repair.repair(frame.limit(0)).count() == 0


def test_query_on_the_given_table(spark, data):
    from featsieve.llm import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(QUERIES["op13_role_repair"](spark, data), rows)
