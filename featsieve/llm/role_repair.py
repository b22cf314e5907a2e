"""Operator 13: conversations repaired to the role grammar by generalised LR parsing with edits.

The LR(0) tables are made from the grammar. At every row the parser holds the tops of a graph-structured stack; keeping,
reroling, deleting a row or inserting one shifts a role (or none) at a price, reductions follow at once, and equal tops
are merged by the least (cost, audit). Merging is exact as long as what may follow depends on the top alone, as in the
role grammar: its stacks with one top accept the same endings.

Conversations are cut where partitions of the ordered rows end and every ``PIECE_ROWS`` rows. What a piece does is a table
from the top in front of it to the least (cost, audit) of every top behind it; such tables are joined in order, so a
conversation with a third of all rows is parsed by many tasks. Only its results, the audit and the digest of its text,
are strings of the whole conversation.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import sliced, stored

PIECE_ROWS = 256
KEEP, REROLE, DELETE, INSERT = "KRDI"
# fixed values of the damage
BUCKETS = 20


@dataclass(frozen=True)
class Grammar:
    """Productions over one-letter symbols; upper case is a nonterminal, the first left side is the start."""

    rules: tuple[tuple[str, str], ...]

    @cached_property
    def tables(self) -> tuple[list[dict[str, int]], list[tuple[str, int] | None], set[int]]:
        """Per LR(0) state: where each symbol leads, the reduction (left side, length) or None; and the accepting states.

        A state with a shift and a finished rule shifts on, and reduces when the input ends.
        """
        start = self.rules[0][0]

        def closed(kernel: frozenset[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            items, todo = set(kernel), list(kernel)
            while todo:
                rule, dot = todo.pop()
                after = self.rules[rule][1][dot : dot + 1]
                for r, (left, _) in enumerate(self.rules):
                    if left == after and (r, 0) not in items:
                        items.add((r, 0))
                        todo.append((r, 0))
            return frozenset(items)

        states = [closed(frozenset((r, 0) for r, (left, _) in enumerate(self.rules) if left == start))]
        moves: list[dict[str, int]] = []
        for items in states:
            own: dict[str, int] = {}
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                target = closed(frozenset((r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == symbol))
                if target not in states:
                    states.append(target)
                own[symbol] = states.index(target)
            moves.append(own)
        finished = [[self.rules[r] for r, d in sorted(items) if d == len(self.rules[r][1])] for items in states]
        reductions = [(done[0][0], len(done[0][1])) if done and not own else None for done, own in zip(finished, moves)]
        accepting = set()
        for state, done in enumerate(finished):
            lefts = {left for left, _ in done}
            while more := {left for left, right in self.rules if right in lefts} - lefts:  # rules that only rename
                lefts |= more
            if start in lefts:
                accepting.add(state)
        return moves, reductions, accepting

    def shift(self, stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
        """The stack after a symbol and all reductions that leave no choice."""
        moves, reductions, _ = self.tables
        target = moves[stack[-1]].get(symbol)
        if target is None:
            return None
        stack = (*stack, target)
        while reductions[stack[-1]]:
            left, length = reductions[stack[-1]]
            below = stack[: len(stack) - length]
            goto = moves[below[-1]].get(left)
            if goto is None:
                break
            stack = (*below, goto)
        return stack

    @cached_property
    def tops(self) -> dict[int, tuple[int, ...]]:
        """Every top that symbols can lead to, with the shortest stack under it."""
        found, todo, met = {0: (0,)}, [(0,)], {(0,)}
        letters = sorted({c for _, right in self.rules for c in right if not c.isupper()})
        for stack in todo:
            for letter in letters:
                after = self.shift(stack, letter)
                if after is not None and after[-2:] not in met:  # the state below decides where a reduction leads
                    met.add(after[-2:])
                    found.setdefault(after[-1], after)
                    todo.append(after)
        return found


#: S: nothing or P; P: an optional system turn, then pairs T of user and assistant turns.
ROLES = Grammar((("S", ""), ("S", "P"), ("P", "sT"), ("P", "T"), ("T", "ua"), ("T", "Tua")))


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


def parse(rows: str, entry: int = 0, grammar: Grammar = ROLES, costs: Costs = Costs()) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of every stack top behind ``rows``, from the top ``entry``.

    ``rows`` holds two letters a row: the role initial and its fault (``-`` none, ``t`` truncated, ``x`` must go).
    """
    tops: dict[int, tuple[int, str, tuple[int, ...]]] = {entry: (0, "", grammar.tops[entry])}

    def offer(into: dict, stack: tuple[int, ...] | None, cost: int, audit: str) -> bool:
        if stack is None or (stack[-1] in into and into[stack[-1]][:2] <= (cost, audit)):
            return False
        into[stack[-1]] = (cost, audit, stack)
        return True

    def with_inserts(own: dict) -> dict:
        todo = sorted(own)
        while todo:
            cost, audit, stack = own[todo.pop(0)]
            for role in "ua":
                after = grammar.shift(stack, role)
                if offer(own, after, cost + costs.insert, audit + INSERT):
                    todo.append(after[-1])
        return own

    for i in range(0, len(rows), 2):
        role, fault = rows[i], rows[i + 1]
        after: dict[int, tuple[int, str, tuple[int, ...]]] = {}
        for cost, audit, stack in with_inserts(tops).values():
            offer(after, stack, cost + costs.delete, audit + DELETE)
            if fault != "x":
                kept = cost + (costs.truncated if fault == "t" else 0)
                offer(after, grammar.shift(stack, role), kept, audit + KEEP)
                for new in "ua":
                    offer(after, grammar.shift(stack, new), kept + costs.rerole, audit + REROLE)
        tops = after
    return {top: (cost, audit) for top, (cost, audit, _) in with_inserts(tops).items()}


@lru_cache(100_000)
def _parse_short(rows: str, entry: int) -> tuple[tuple[int, int, str], ...]:
    return tuple((top, *found) for top, found in parse(rows, entry).items())


def table(rows: str) -> dict[int, dict[int, tuple[int, str]]]:
    """``parse`` from every top: what a piece of a conversation does."""
    return {top: parse(rows, top) for top in ROLES.tops}


def joined(first: dict, second: dict) -> dict:
    """The table of two pieces in a row."""
    out: dict[int, dict[int, tuple[int, str]]] = {}
    for a, mids in first.items():
        own = out[a] = {}
        for mid, (c1, t1) in mids.items():
            for b, (c2, t2) in second[mid].items():
                if b not in own or (c1 + c2, t1 + t2) < own[b]:
                    own[b] = (c1 + c2, t1 + t2)
    return out


def best(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest (cost, audit) that ends in an accepting top."""
    return min(v for top, v in ends.items() if top in ROLES.tables[2])


def edited(audit: str, roles: Sequence[str], texts: Sequence[str], stack: tuple[int, ...] = (0,)) -> tuple[list[str], tuple[int, ...]]:
    """(repaired ``role:text`` lines, stack behind them): an audit leaves no choice of roles in this grammar."""
    lines, i = [], 0
    names = {"u": "user", "a": "assistant"}
    for action in audit:
        if action == KEEP:
            stack = ROLES.shift(stack, roles[i][:1])
            lines.append(f"{roles[i]}:{texts[i]}")
        elif action != DELETE:
            letter = next(c for c in "ua" if ROLES.shift(stack, c) is not None)
            stack = ROLES.shift(stack, letter)
            lines.append(f"{names[letter]}:{texts[i] if action == REROLE else ''}")
        i += action != INSERT
    return lines, stack


# --- rows ----------------------------------------------------------------------------------------

COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage, and ``kept``: dropped rows stay as marks, so that no conversation is lost.

    Nulls of role and text are one space, and so are nulls in the hashed key.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    hit = (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % BUCKETS).alias("_hit")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), hit)
    hit = F.col("_hit")
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    kept = rows.select("conv_id", "turn", role.alias("role"), F.when(hit != 0, text).otherwise("").alias("text"), (hit != 0).alias("kept"), hit)
    return kept.withColumn("_n", F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_hit", "_n")


def pieces_of(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows in order as pieces: pid (rising in order), conv_id, whole, turns, roles, texts, faults, firsts.

    ``whole``: the piece is surely its whole conversation, which neither begins nor ends its partition. ``faults`` has one
    letter a row: b blank, d duplicate of a row in the same partition, t truncated, - none. ``firsts`` are digests of
    the rows that may repeat a row of an earlier partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    fault = F.when(trimmed == "", "b").when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    marked = rows.select("conv_id", "turn", "role", "text", "kept", fault.alias("_fault"), digest.alias("_digest"))
    order = ["conv_id", "turn", "role", "_head", "_digest", "_spread"]
    ordered = marked.withColumn("_head", F.substring("text", 1, 256)).withColumn("_spread", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select(marked.columns)
    kind = marked.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("pid", T.LongType()), T.StructField("conv_id", kind), *T.StructType.fromDDL(
        "whole boolean, turns array<bigint>, roles array<string>, texts array<string>, faults string, firsts array<string>").fields])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        own: list[tuple] = []  # rows of the piece: turn, role, text, fault, digest or None
        state = {"made": 0, "bytes": 0, "held": 0, "cuts": 0, "first": True}
        seen: set[str] = set()
        conv, begun = None, False

        def close(ends: bool, last: bool) -> None:
            whole = ends and not (last or state["first"] or state["cuts"])
            turns, roles, texts, faults, digests = ([r[k] for r in own] for k in range(5))
            out.append((base + state["made"], conv, whole, turns, roles, texts, "".join(faults), [] if whole else digests))
            state["made"] += 1
            state["cuts"] += 1
            state["held"] += state["bytes"]
            state["bytes"] = 0
            own.clear()
            if ends:
                seen.clear()
                state["first"], state["cuts"] = False, 0

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)]
            out.clear()
            state["held"] = 0
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in sliced(batches, "text"):
            for now, turn, role, text, kept, fault, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and now != conv:
                    close(True, False)
                    if len(out) >= 1000 or state["held"] > 2_000_000:
                        yield flushed()
                conv, begun = now, True
                if not kept:
                    continue
                if len(own) >= piece_rows or state["bytes"] > 2_000_000:
                    close(False, False)
                    yield flushed()
                again = digest in seen
                seen.add(digest)
                own.append((turn, role, text, "d" if again and fault != "b" else fault, None if again or fault == "b" else digest))
                state["bytes"] += len(text)
        if begun:
            close(True, True)
            yield flushed()

    return ordered.mapInArrow(cut, schema)


def _signature(roles: Sequence[str], faults: str) -> str:
    """What ``parse`` reads: two letters a row."""
    return "".join((r[:1] if r[:1] in ("s", "u", "a") else "?") + ("x" if f in "bd" else f) for r, f in zip(roles, faults))


def _illegal(signature: str) -> int:
    initials = signature[::2]
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def _turns(turns: Sequence[int | None]) -> tuple[int | None, int | None, int]:
    """(least, greatest, number of distinct turns) without nulls."""
    known = {t for t in turns if t is not None}
    return (min(known), max(known), len(known)) if known else (None, None, 0)


def _whole_results(kind: T.DataType) -> tuple[T.StructType, object]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(COLUMNS).fields])
    arrow = to_arrow_schema(schema)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turns, roles, texts, faults in zip(*(c.to_pylist() for c in batch.columns)):
                signature = _signature(roles, faults)
                cost, audit = best({top: (c, a) for top, c, a in _parse_short(signature, 0)} if len(faults) <= 32 else parse(signature))
                low, high, distinct = _turns(turns)
                text = "\n".join(edited(audit, roles, texts)[0])
                out.append((conv, 0 if low is None else high - low + 1 - distinct, faults.count("b"), faults.count("d"), faults.count("t"), _illegal(signature), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    return schema, results


def _late(cut: DataFrame) -> DataFrame:
    """pid and the places of rows that repeat a row of an earlier partition of their conversation."""
    part = F.shiftright("pid", 32)
    each = cut.select("pid", "conv_id", part.alias("part"), F.posexplode("firsts").alias("at", "digest")).filter("digest is not null")
    first = each.groupBy("conv_id", "digest").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last")
    again = each.alias("e").join(first.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.digest") == F.col("f.digest")) & (F.col("e.part") > F.col("f.first")))
    return again.groupBy("pid").agg(F.collect_list("at").alias("late"))  # at most the rows of a piece


def _cut_results(cut: DataFrame) -> DataFrame:
    """Results of conversations that may lie in several pieces."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = cut.schema["conv_id"].dataType
    marked = cut.join(_late(cut), "pid", "left")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pid, conv, turns, roles, faults, late in zip(*(c.to_pylist() for c in batch.columns)):
                again = set(late or [])
                faults = "".join("d" if i in again else f for i, f in enumerate(faults))
                signature = _signature(roles, faults)
                edges = (turns[0], turns[-1]) if turns else (None, None)
                out.append((pid, conv, signature, faults.count("b"), faults.count("d"), *_turns(turns), *edges, pickle.dumps(table(signature))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), summary_arrow)] if out else [pa.array([], f.type) for f in summary_arrow], schema=summary_arrow)

    summary_schema = T.StructType([T.StructField("pid", T.LongType()), T.StructField("conv_id", kind), *T.StructType.fromDDL(
        "signature string, blank long, duplicate long, low long, high long, turns long, first_turn long, last_turn long, moves binary").fields])
    summary_arrow = to_arrow_schema(summary_schema)
    # no texts: a piece's summary is a few kilobytes
    summaries = marked.select("pid", "conv_id", "turns", "roles", "faults", "late").mapInArrow(summary, summary_schema)

    plan_schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(
        "pid long, audit_part string, stack array<int>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long").fields])
    plan_arrow = to_arrow_schema(plan_schema)

    def fold(part: pa.Table) -> pa.Table:
        """The cheapest audit of a conversation, cut into its pieces' parts."""
        rows = part.sort_by("pid").to_pylist()
        tables = [pickle.loads(r["moves"]) for r in rows]
        while len(tables) > 1:
            tables = [joined(a, b) for a, b in zip(tables[::2], tables[1::2])] + tables[len(tables) // 2 * 2 :]
        cost, audit = best(tables[0][0])
        lows, highs = [r["low"] for r in rows if r["low"] is not None], [r["high"] for r in rows if r["high"] is not None]
        filled = [r for r in rows if r["signature"]]
        distinct = sum(r["turns"] for r in rows) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in zip(filled, filled[1:]))
        signature = "".join(r["signature"] for r in rows)
        totals = (max(highs) - min(lows) + 1 - distinct if lows else 0, sum(r["blank"] for r in rows), sum(r["duplicate"] for r in rows), signature[1::2].count("t"), _illegal(signature), cost)
        out, at, stack = [], 0, (0,)
        for k, r in enumerate(rows):
            end, left = at, len(r["signature"]) // 2
            while end < len(audit) and (left or k == len(rows) - 1 or audit[end] == INSERT):
                left -= audit[end] != INSERT
                end += 1
            out.append((r["conv_id"], r["pid"], audit[at:end], list(stack), *(totals if k == 0 else [None] * 6)))
            initials = r["signature"][::2]
            stack, at = edited(audit[at:end], initials, initials, stack)[1], end
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out), plan_arrow)], schema=plan_arrow)

    plan = stored(summaries.groupBy("conv_id").applyInArrow(fold, plan_schema), "role-plan")

    final_schema, _ = _whole_results(kind)
    final_arrow = to_arrow_schema(final_schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in order: the digest is carried from piece to piece."""
        totals, audit, sha, any_line = None, [], None, False
        for batch in sliced(batches, "audit_part"):
            for row in batch.to_pylist():
                if row["gaps"] is not None:  # the first piece
                    if totals is not None:
                        yield one(totals, audit, sha)
                    totals, audit, sha, any_line = (row["conv_id"], *[row[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]), [], hashlib.sha256(), False
                audit.append(row["audit_part"])
                lines, _ = edited(row["audit_part"], row["roles"], row["texts"], tuple(row["stack"]))
                if lines:
                    sha.update(("\n" * any_line + "\n".join(lines)).encode())
                    any_line = True
        if totals is not None:
            yield one(totals, audit, sha)

    def one(totals: tuple, audit: list[str], sha: object) -> pa.RecordBatch:
        row = (*totals, "".join(audit), sha.hexdigest())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, final_arrow)], schema=final_arrow)

    texts = plan.join(cut.select("pid", "roles", "texts"), "pid").repartition("conv_id").sortWithinPartitions("conv_id", "pid")
    return texts.mapInArrow(digests, final_schema)


def repair(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation after the damage: conv_id, faults, cost and audit of the cheapest edits, digest of the result.

    Rows go by turn (nulls first); equal turns by role, then text (256 characters, then a digest), so repeated rows
    are neighbours. A null conv_id is a conversation of its own. Null role and text are one space: such a row is blank.
    An empty role has no initial and is never kept. Other columns are not read, whatever their names. Texts are used
    whole, at any length; an empty table gives no rows; a conversation without rows after the damage has zeros, an empty
    audit and the digest of the empty string.
    """
    cut = stored(pieces_of(damaged(conversations), piece_rows), "role-pieces")
    schema, results = _whole_results(cut.schema["conv_id"].dataType)
    whole = cut.filter("whole").select("conv_id", "turns", "roles", "texts", "faults").mapInArrow(results, schema)
    return whole.union(_cut_results(cut.filter("not whole")))


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
