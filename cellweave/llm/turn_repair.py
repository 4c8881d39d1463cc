"""Operator 11, conversation structure repair by rank-compressed dynamic programming.

A repaired conversation's role initials read ``(s?(ua)+)?``. Each row is kept (0),
reroled to user or assistant (3) or deleted (4; blank and duplicate rows must be);
an empty user or assistant turn may be inserted anywhere (3); a truncated row that
stays adds 3. Of the cheapest repairs the one whose audit string (initials of the
edits D, I, K, R) is least in ASCII order counts.

Audit strings are never compared. A macro edit is a run of insertions and the row's
own edit, so macros are prefix-free codes, numbered in ASCII order, and so are
the audits of a layer (all repairs of the first i rows). A layer holds for each of
four states (last initial) the least cost, the audit's rank within the layer, and a
parent pointer (state before, macro). A candidate's place is (cost, rank of its
parent, number of its macro); ranks are dealt anew by sorting at most four
pairs. Audit and repaired rows are read off the parent pointers.

Rows are sorted by range over conversation, turn (null first), role and text, and
packed in sorted order into blocks of at most ``BLOCK`` rows, so one conversation may span all
tasks. A conversation seen whole in one block is repaired at once. For the
others each block becomes a table: for each state before it, a layer behind it.
Tables compose (parents' ranks first, then the block's own), group by group of
``FAN``; the states at block borders are fixed downwards and every block is
repaired on its own.

Faults (the first of a row counts): ``blank`` (nothing but white space), ``duplicate`` (role and
text seen earlier in the conversation), ``truncated`` (the last such character is not
one of ``.!?``).

Defined cases: null roles and texts are one space; rows of one turn are ordered by
role, first 64 characters and a hash of the text; equal rows are duplicates; a role of no or another initial cannot be kept;
a null conversation is one conversation; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import map_batches, materialise, small_batches, table, written

#: Costs of the edits, and what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, and the initial of the last row.
START, S, U, A = range(4)
AFTER = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
INSERTED = {START: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
#: Insertions that end a conversation in each state.
CLOSING = {START: 0, A: 0, U: 1, S: 2}
#: Macro edits in ASCII order: a macro's number is its prefix-free code.
MACROS = sorted("I" * j + e for j in range(3) for e in "DKR")
BLOCK, FAN = 256, 256
NEVER = 1 << 40
BLANK, DUPLICATE, CUT = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"


def _moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(state before, state behind, cost, code) of every macro edit of a row."""
    out = []
    for before in range(4):
        for code, macro in enumerate(MACROS):
            state, cost = before, INSERT * (len(macro) - 1)
            for _ in macro[:-1]:
                state = INSERTED[state]
            if macro[-1] == "D":
                out.append((before, state, cost + DELETE, code))
            elif fault not in (BLANK, DUPLICATE):
                to = AFTER[state].get(initial) if macro[-1] == "K" else INSERTED[state]
                if to is not None:
                    out.append((before, to, cost + (REROLE if macro[-1] == "R" else 0) + (TRUNCATED if fault == CUT else 0), code))
    return out


_MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def _ranked(keys: list) -> list[int]:
    """Ranks of the keys that are there."""
    order = sorted(k for k in keys if k is not None)
    return [NEVER if k is None else order.index(k) for k in keys]


def layer(cost: list[int], rank: list[int], moves: list[tuple[int, int, int, int]]) -> tuple[list[int], list[int], list]:
    """The next layer: costs, ranks and parent pointers (state before, code) of the four states."""
    best = [None] * 4
    for before, behind, more, code in moves:
        if cost[before] < NEVER:
            found = (cost[before] + more, rank[before], code, before)
            if best[behind] is None or found < best[behind]:
                best[behind] = found
    return [b[0] if b else NEVER for b in best], _ranked([b and b[1:3] for b in best]), [b and (b[3], b[2]) for b in best]


def entered(state: int) -> tuple[list[int], list[int]]:
    return [0 if s == state else NEVER for s in range(4)], [0 if s == state else NEVER for s in range(4)]


def block_table(rows: list[tuple[str, int]]) -> list[list[int]]:
    """Costs and ranks behind the rows (initial, fault) for each state before them: four lists of 8."""
    out = []
    for state in range(4):
        cost, rank = entered(state)
        for row in rows:
            cost, rank, _ = layer(cost, rank, _MOVES[row])
        out.append([*cost, *rank])
    return out


def passed(cost: list[int], rank: list[int], through: list[list[int]]) -> tuple[list[int], list[int], list]:
    """The layer behind a table, and for each state the state before it."""
    best = [None] * 4
    for m in range(4):
        for q in range(4):
            if cost[m] < NEVER and through[m][q] < NEVER:
                found = (cost[m] + through[m][q], rank[m], through[m][4 + q], m)
                if best[q] is None or found < best[q]:
                    best[q] = found
    return [b[0] if b else NEVER for b in best], _ranked([b and b[1:3] for b in best]), [b and b[3] for b in best]


def compose(tables: list[list[list[int]]]) -> list[list[int]]:
    """The table of a sequence of tables."""
    out = []
    for state in range(4):
        cost, rank = entered(state)
        for t in tables:
            cost, rank, _ = passed(cost, rank, t)
        out.append([*cost, *rank])
    return out


def ending(cost: list[int], rank: list[int]) -> int:
    """The state in which the cheapest whole repair ends."""
    return min(range(4), key=lambda s: (cost[s] + INSERT * CLOSING[s], rank[s]))


def borders(tables: list[list[list[int]]], entry: int, leave: int | None) -> list[int]:
    """States before each table and behind the last; ``leave`` None: the cheapest end."""
    cost, rank = entered(entry)
    steps = []
    for t in tables:
        cost, rank, back = passed(cost, rank, t)
        steps.append(back)
    states = [ending(cost, rank) if leave is None else leave]
    for back in reversed(steps):
        states.append(back[states[-1]])
    return states[::-1]


def repaired(rows: list[tuple[str, int]], entry: int = START, leave: int | None = None) -> tuple[int, str, list[tuple[int | None, int | None]]]:
    """Cost, audit and turns of the cheapest repair: (row or None if inserted, role's state or None if kept)."""
    cost, rank = entered(entry)
    pointers = []
    for row in rows:
        cost, rank, back = layer(cost, rank, _MOVES[row])
        pointers.append(back)
    state = ending(cost, rank) if leave is None else leave
    total, tail, codes = cost[state], CLOSING[state] if leave is None else 0, []
    for back in reversed(pointers):
        state, code = back[state]
        codes.append(MACROS[code])
    turns = []
    for i, macro in enumerate(reversed(codes)):
        for edit in macro:
            if edit == "I":
                state = INSERTED[state]
                turns.append((None, state))
            elif edit == "K":
                state = AFTER[state][rows[i][0]]
                turns.append((i, None))
            elif edit == "R":
                state = INSERTED[state]
                turns.append((i, state))
    for _ in range(tail):
        state = INSERTED[state]
        turns.append((None, state))
    return total + INSERT * tail, "".join(reversed(codes)) + "I" * tail, turns


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def _faults(rows: list[dict], seen: set) -> list[int]:
    out = []
    for r in rows:
        text = r["text"].rstrip(SPACES)
        key = (r["role"], r["text"])
        out.append(BLANK if not text else DUPLICATE if key in seen else 0 if text[-1] in ".!?" else CUT)
        seen.add(key)
    return out


def _packed(sizes: int):
    """Sorted rows (conv_id, turn, role, text, gone) into blocks of one conversation: (conv_id, part, seq, whole, turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, seq, edge = TaskContext.get().partitionId(), None, 0, True

        def blocks(t: pa.Table, first_seq: int, whole: bool) -> pa.RecordBatch:
            turns = pa.StructArray.from_arrays([t.column(i).combine_chunks() for i in range(1, 5)], names=["turn", "role", "text", "gone"])
            at = np.append(np.arange(0, t.num_rows, sizes), t.num_rows).astype(np.int32)
            n = len(at) - 1
            return pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(pa.array(at[:-1])), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(first_seq, first_seq + n)), pa.array(np.full(n, whole and n == 1 and not first_seq)), pa.ListArray.from_arrays(pa.array(at), turns)], names=["conv_id", "part", "seq", "whole", "turns"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            ids = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
                yield blocks(t.slice(a, b - a), seq, not edge)
                seq, edge = 0, False
            held = t.slice(int(start[-1]))
            full = (held.num_rows - 1) // sizes * sizes
            if full:
                yield blocks(held.slice(0, full), seq, False)
                seq, held = seq + full // sizes, held.slice(full)
        if held is not None:
            yield blocks(held, seq, False)

    return run


_TURNS = "array<struct<turn:long,role:string,text:string,gone:boolean>>"
_COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns", "cost")
#: Values at the borders of a block, for what lies across them.
_EDGES = ("first_turn", "last_turn", "first_initial", "last_initial")


def _measured(rows: list[dict], faults: list[int]) -> dict:
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "n_rows": len(rows),
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(CUT),
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
        "n_turns": len(set(turns)),
        "first_turn": min(turns, default=None),
        "last_turn": max(turns, default=None),
        "first_initial": initials[0] if rows else None,
        "last_initial": initials[-1] if rows else None,
    }


def _turns(rows: list[dict], made: list) -> list[str]:
    return [f"{rows[i]['role'] if to is None else ROLE[to]}:{rows[i]['text']}" if i is not None else f"{ROLE[to]}:" for i, to in made]


def _present(turns: list[dict] | None) -> list[dict]:
    return [r for r in turns or [] if not r["gone"]]


def _batch(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def _longs(*names: str) -> dict[str, pa.DataType]:
    return {x: pa.string() if x.endswith("initial") else pa.int64() for x in names}


def _schema(conv: T.StructField, *names: str, **more: str) -> str:
    fields = {"conv_id": conv.dataType.simpleString()} | {x: "string" if x.endswith("initial") else "bigint" for x in names} | more
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Repair conversations that are one block each."""
    out = []
    for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        rows = _present(turns)
        faults = _faults(rows, set())
        m = _measured(rows, faults)
        cost, audit, made = repaired([(_initial(r["role"]), f) for r, f in zip(rows, faults)])
        gaps = m["last_turn"] - m["first_turn"] + 1 - m["n_turns"] if m["n_turns"] else 0
        out.append(m | {"conv_id": conv, "gaps": gaps, "cost": cost, "audit": audit, "repaired": _turns(rows, made)})
    return _batch(out, {"conv_id": batch.schema.field(0).type} | _longs("gaps", *_COUNTS) | {"audit": pa.string(), "repaired": pa.list_(pa.string())})


def _resolved(blocks: DataFrame, conv: T.StructField) -> DataFrame:
    """(conv_id, block, entry, leave, last) from (conv_id, block, last, t), by groups of FAN blocks."""
    grouped = materialise(blocks.groupBy("conv_id", F.expr(f"block div {FAN}").alias("outer")).agg(F.max("last").alias("ends"), F.array_sort(F.collect_list(F.struct("block", "t"))).alias("rows")))
    if grouped.where("outer > 0").limit(1).count():
        up = map_batches(grouped.select("conv_id", "outer", "ends", "rows"), lambda b: _up(b), _schema(conv, "block") + ", last boolean, t array<array<bigint>>")
        bounds = _resolved(up, conv).select("conv_id", F.col("block").alias("outer"), "entry", "leave", "last")
    else:
        bounds = grouped.select("conv_id", "outer", F.lit(START).cast("long").alias("entry"), F.lit(None).cast("long").alias("leave"), "ends")
    b = bounds.select(F.col("conv_id").alias("c2"), F.col("outer").alias("o2"), "entry", "leave")
    joined = grouped.join(b, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("outer") == F.col("o2"))).select("conv_id", "ends", "rows", "entry", "leave")

    def down(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for conv_id, ends, rows, entry, leave in zip(*(c.to_pylist() for c in batch.columns)):
            states = borders([r["t"] for r in rows], entry, leave)
            out += [{"conv_id": conv_id, "block": r["block"], "entry": states[i], "leave": states[i + 1], "last": ends and i == len(rows) - 1} for i, r in enumerate(rows)]
        return _batch(out, {"conv_id": batch.schema.field(0).type} | _longs("block", "entry", "leave") | {"last": pa.bool_()})

    return map_batches(joined, down, _schema(conv, "block", "entry", "leave") + ", last boolean")


def _up(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = [compose([r["t"] for r in rows]) for rows in batch.column(3).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.list_(pa.int64())))], names=["conv_id", "block", "last", "t"])


def _spread(blocks: DataFrame, conv: T.StructField) -> DataFrame:
    """(conv_id, part, gaps, counts, audit, repaired) of conversations that may lie in several blocks."""
    # blocks in order: their places are counted by partition, then numbered within the conversation
    runs = blocks.groupBy("conv_id", "part").agg((F.max("seq") + 1).alias("n"))
    ahead = runs.select(F.col("conv_id").alias("c2"), F.col("part").alias("p2"), F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("ahead"), F.sum("n").over(W.partitionBy("conv_id")).alias("blocks"))
    block = F.coalesce("ahead", F.lit(0)) + F.col("seq")
    numbered = written(blocks.join(ahead, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2"))).select("conv_id", block.alias("block"), (block == F.col("blocks") - 1).alias("last"), "turns"), "turn-blocks")
    # texts of a block that an earlier block has too: each block tells a text once
    said = numbered.select("conv_id", "block", F.explode(F.array_distinct(F.expr("transform(filter(turns, x -> not x.gone), x -> sha2(concat(hex(x.role), ':', x.text), 256))"))).alias("digest"))
    first = said.groupBy("conv_id", "digest").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c2"), F.col("digest").alias("d2"), "first")
    again = said.join(first, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("digest") == F.col("d2")) & (F.col("block") > F.col("first"))).groupBy("conv_id", "block").agg(F.collect_list("digest").alias("again"))
    again = again.select(F.col("conv_id").alias("c3"), F.col("block").alias("b3"), "again")
    known = numbered.join(again, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("block") == F.col("b3")), "left").select("conv_id", "block", "last", "turns", "again")

    def judged(turns: list[dict], again: list[str] | None) -> tuple[list[dict], list[int]]:
        rows = _present(turns)
        before = set(again or [])
        seen = {(r["role"], r["text"]) for r in rows if before and hashlib.sha256(f"{r['role'].encode().hex().upper()}:{r['text']}".encode()).hexdigest() in before}
        return rows, _faults(rows, seen)

    def tables(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for conv_id, block, last, turns, again in zip(*(c.to_pylist() for c in batch.columns)):
            rows, faults = judged(turns, again)
            out.append(_measured(rows, faults) | {"conv_id": conv_id, "block": block, "last": last, "t": block_table([(_initial(r["role"]), f) for r, f in zip(rows, faults)])})
        measured = [x for x in _COUNTS if x != "cost"]
        return _batch(out, {"conv_id": batch.schema.field(0).type} | _longs("block", *measured, *_EDGES) | {"last": pa.bool_(), "t": pa.list_(pa.list_(pa.int64()))})

    made = materialise(map_batches(known, tables, _schema(conv, "block", *(x for x in _COUNTS if x != "cost"), *_EDGES) + ", last boolean, t array<array<bigint>>"))
    bounds = materialise(_resolved(made.select("conv_id", "block", "last", "t"), conv)).select(F.col("conv_id").alias("c4"), F.col("block").alias("b4"), "entry", "leave")
    # what lies across a border: the last row and turn before a block that has rows
    order = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    across = made.select("*", F.last("last_initial", True).over(order).alias("i0"), F.last("last_turn", True).over(order).alias("t0"))
    joint = F.when(F.col("i0").isNull() | F.col("first_initial").isNull(), 0).when(F.concat("i0", "first_initial").isin("su", "ua", "au"), 0).otherwise(1)
    sums = across.groupBy("conv_id").agg(*(F.sum(x).alias(x) for x in ("n_rows", "blank", "duplicate", "truncated")), F.sum(F.col("illegal") + joint).alias("illegal"), F.sum(F.col("n_turns") - F.when(F.col("t0") == F.col("first_turn"), 1).otherwise(0)).alias("n_turns"), F.min("first_turn").alias("lo"), F.max("last_turn").alias("hi"))
    sums = sums.select(F.col("conv_id").alias("c5"), "n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns", F.when(F.col("lo").isNull(), 0).otherwise(F.col("hi") - F.col("lo") + 1 - F.col("n_turns")).alias("gaps"))

    def mended(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for conv_id, block, last, turns, again, entry, leave in zip(*(c.to_pylist() for c in batch.columns)):
            rows, faults = judged(turns, again)
            cost, audit, done = repaired([(_initial(r["role"]), f) for r, f in zip(rows, faults)], entry, leave)
            state, tail = leave, CLOSING[leave] if last else 0
            for _ in range(tail):
                state = INSERTED[state]
                done.append((None, state))
            out.append({"conv_id": conv_id, "part": block, "cost": cost + INSERT * tail, "audit": audit + "I" * tail, "repaired": _turns(rows, done)})
        return _batch(out, {"conv_id": batch.schema.field(0).type} | _longs("part", "cost") | {"audit": pa.string(), "repaired": pa.list_(pa.string())})

    ready = known.join(bounds, F.col("conv_id").eqNullSafe(F.col("c4")) & (F.col("block") == F.col("b4"))).select("conv_id", "block", "last", "turns", "again", "entry", "leave")
    texts = map_batches(ready, mended, _schema(conv, "part", "cost", audit="string", repaired="array<string>"))
    # a block's part tells what is its own; counts stand in the first part of a conversation
    out = texts.join(sums, F.col("conv_id").eqNullSafe(F.col("c5")) & (F.col("part") == 0), "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    return out.select("conv_id", "part", zero("gaps"), *(zero(x) for x in _COUNTS[:-1]), "cost", "audit", "repaired")


def repair_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: F.Column | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, gaps, n_rows, blank, duplicate, truncated, illegal, n_turns, cost, audit, repaired).

    ``repaired`` lists ``role:text`` of the repaired turns. A conversation is one
    row (part null), or a row a block, from part 0, whose numbers add up and
    whose audits and turns concatenate. Rows marked ``gone`` only name their conversation.
    """
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), (F.lit(False) if gone is None else gone).alias("gone"))
    conv = rows.schema["conv_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the driver sees a sample of the keys, so they are short; equal rows are dealt by a number of their own
    order = ["conv_id", "turn", "role", "lead", "digest", "own"]
    keyed = rows.withColumns({"lead": F.substring("text", 1, 64), "digest": F.xxhash64("text"), "own": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(parts, *order)
    schema = f"conv_id {conv.dataType.simpleString()}, part int, seq long, whole boolean, turns {_TURNS}"
    packed = written(dealt.sortWithinPartitions(*order).drop("lead", "digest", "own").mapInArrow(_packed(block), schema), "turns")
    alone = map_batches(packed.where("whole").select("conv_id", "turns"), _whole, _schema(conv, "gaps", *_COUNTS, audit="string", repaired="array<string>"))
    names = ["gaps", *_COUNTS, "audit", "repaired"]
    return alone.select("conv_id", F.lit(None).cast("long").alias("part"), *names).unionByName(_spread(packed.where("not whole"), conv).select("conv_id", "part", *names))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults set by crc32 of ``conv_id:turn``: (conv_id, turn, role, text, gone); dropped rows are ``gone``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of several parts, in order: numbers summed, audits joined, texts hashed as they pass."""
    key, numbers, audit, digest, empty = None, None, [], None, True

    def row(kinds):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], kinds[0]), *(pa.array([n], pa.int64()) for n in numbers), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    kinds = None
    for batch in batches:
        kinds = [batch.schema.field(0).type]
        for conv, _, *counts, said, turns in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (conv,):
                if key is not None:
                    yield row(kinds)
                key, numbers, audit, digest, empty = (conv,), [0] * 6, [], hashlib.sha256(), True
            numbers = [a + b for a, b in zip(numbers, counts)]
            audit.append(said)
            for t in turns:
                digest.update(t.encode() if empty else b"\n" + t.encode())
                empty = False
    if key is not None:
        yield row(kinds)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    mended = repair_turns(damaged(turns), gone=F.col("gone"))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    one = mended.where("part is null").select("conv_id", *names, "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))
    # SHA-256 passes over a conversation's text in order: it streams through, block by block
    many = mended.where("part is not null").select("conv_id", "part", *names, "audit", "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = mended.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{x} long" for x in names)
    return one.unionByName(many.mapInArrow(_digests, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string"))
