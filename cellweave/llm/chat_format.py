"""Operator 1, chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
by turns, ended by the assistant. States are the last role (0 start, 1 system,
2 user, 3 assistant). Each input turn is kept, relabelled, merged into the
turn before it, or preceded by an empty inserted turn; dynamic programming over
the automaton finds the cheapest repair, which is then rendered.

One turn is a 4 by 4 table of least costs between states, and tables compose
(minimum, plus). So long conversations are cut into blocks of ``BLOCK`` turns: tables
of blocks, and of groups of blocks, are composed upwards, the states at their
borders are fixed downwards, and every block is repaired on its own. Results
are minimal over the whole conversation. A conversation of up to BLOCK turns is
one row; a longer one is a row a block, whose ``rendered`` parts concatenate.

Defined cases: turns are ordered by turn (null first), role and a hash of the text; repeated
rows are turns of their own; a null or unknown role costs one relabelling; a null
text is empty; a null conv_id is one conversation; control marks in a text are
broken up; an empty table gives an empty result.

Scale: turns are sorted by range, so one conversation may span all tasks; its
turns are numbered from the counts by partition. The broadcast offsets have at most two
rows a partition. No group is larger than BLOCK turns or FAN tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import map_batches, materialise, small_batches, table

ROLES = ("", "system", "user", "assistant")
ALIASES = {"system": 1, "user": 2, "human": 2, "assistant": 3, "bot": 3, "gpt": 3, "model": 3}
#: States that may follow each state.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, INSERT = 1, 2, 3
BLOCK, FAN = 256, 512
NEVER = 1 << 40
OPEN, CLOSE, GLUE = "<|{}|>\n", "<|end|>\n", "\n\n"


def moves(state: int, role: int) -> list[tuple[int, int, str, int]]:
    """(cost, next state, kind, inserted role) of one turn, in the order in which ties are settled."""
    out = [(0 if x == role else RELABEL, x, "keep" if x == role else "relabel", 0) for x in NEXT[state]]
    if state:
        out.append((MERGE + (RELABEL if role != state else 0), state, "merge", 0))
    for between in NEXT[state]:
        out += [(INSERT + (0 if x == role else RELABEL), x, "insert" if x == role else "insert+relabel", between) for x in NEXT[between]]
    return sorted(out, key=lambda m: (m[0], ("keep", "merge", "relabel", "insert", "insert+relabel").index(m[2]), m[1], m[3]))


_MOVES = [[moves(s, r) for r in range(4)] for s in range(4)]
#: Cost of the empty turns that end a conversation in each state.
END = (0, 2 * INSERT, INSERT, 0)


def _table(role: int) -> np.ndarray:
    out = np.full((4, 4), NEVER, np.int64)
    for s in range(4):
        for cost, x, _, _ in _MOVES[s][role]:
            out[s, x] = min(out[s, x], cost)
    return out


_STEP = np.stack([_table(r) for r in range(4)])


def compose(tables: np.ndarray) -> np.ndarray:
    """The table of a sequence of tables, halved by each pass."""
    while len(tables) > 1:
        odd = tables[-1:] if len(tables) % 2 else tables[:0]
        a, b = tables[0 : len(tables) - len(odd) : 2], tables[1 : len(tables) : 2]
        tables = np.concatenate([np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), NEVER), odd])
    return tables[0]


def borders(tables: np.ndarray, entry: int, leave: int | None) -> list[int]:
    """States before each table and behind the last, on a cheapest way; ``leave`` None: the cheapest end."""
    cost = np.full(4, NEVER, np.int64)
    cost[entry] = 0
    seen = [cost]
    for t in tables:
        seen.append(np.minimum((seen[-1][:, None] + t).min(0), NEVER))
    state = int(np.argmin(seen[-1] + np.array(END))) if leave is None else leave
    out = [state]
    for t, before in zip(tables[::-1], seen[-2::-1]):
        state = int(np.argmin(before + t[:, state]))
        out.append(state)
    return out[::-1]


def repair(roles: list[int], entry: int = 0, leave: int | None = None) -> list[tuple[int, int, str, int]]:
    """The moves of a cheapest repair from ``entry`` to ``leave``."""
    states = borders(_STEP[np.array(roles, np.int64)] if roles else np.zeros((0, 4, 4), np.int64), entry, leave)
    return [next(m for m in _MOVES[a][r] if m[1] == b) for r, a, b in zip(roles, states, states[1:])]


def render(roles: list[int], texts: list[str], entry: int, leave: int | None, last: bool) -> tuple[str, dict[str, int]]:
    """The text of a block and what was done in it."""
    out, state = [], entry
    done = {"n_merged": 0, "n_relabelled": 0, "n_inserted": 0, "cost": 0}

    def turn(role: int, text: str) -> None:
        out.append((CLOSE if state else "") + OPEN.format(ROLES[role]) + text)

    for (cost, to, kind, between), role, text in zip(repair(roles, entry, leave), roles, texts):
        text = text.replace("<|", "< |")
        done["cost"] += cost
        if between:
            turn(between, "")
            state = between
            done["n_inserted"] += 1
        if kind == "merge":
            out.append(GLUE + text)
            done["n_merged"] += 1
        else:
            turn(to, text)
        done["n_relabelled"] += to != role
        state = to
    if last:
        done["cost"] += END[state]
        while state in (1, 2):
            turn(state + 1, "")
            state += 1
            done["n_inserted"] += 1
        out.append(CLOSE if state else "")
    return "".join(out), done


def _numbered(batches):
    """Turns of a sorted partition with the partition's number and their places in it, counted by conversation."""
    part, before, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column(0).to_pandas()
        values = ids.to_numpy(dtype=object, na_value=None)
        new = np.ones(len(values), bool)
        new[1:] = [a != b for a, b in zip(values[1:], values[:-1])]
        if len(values) and before is not None and values[0] == before[0]:
            new[0] = False
        at = np.arange(len(values))
        lead = np.maximum.accumulate(np.where(new, at, -1))
        place = np.where(lead < 0, at + count, at - lead)
        if len(values):
            before, count = (values[-1],), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(place.astype(np.int64))], names=[*batch.schema.names, "part", "place"])


def _tables(batch: pa.RecordBatch, column: str, single: bool) -> pa.RecordBatch:
    """Replace lists of roles, or of tables, by their composed table."""
    rows = batch.column(batch.schema.get_field_index(column)).to_pylist()
    made = [compose(_STEP[np.array(r, np.int64)] if single else np.array([x["m"] for x in r], np.int64).reshape(-1, 4, 4)).reshape(-1).tolist() for r in rows]
    keep = [x for x in batch.schema.names if x != column]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)) for x in keep] + [pa.array(made, pa.list_(pa.int64()))], names=[*keep, "m"])


def _resolve(blocks: DataFrame, conv: T.StructField) -> DataFrame:
    """(conv_id, block, entry, leave, last) from (conv_id, block, m); groups of FAN blocks at a time."""
    top = blocks.agg(F.max("block").alias("b")).first()["b"]
    grouped = materialise(blocks.groupBy("conv_id", F.expr(f"block div {FAN}").alias("outer")).agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("rows")))
    if top is None or top < FAN:
        bounds = grouped.select("conv_id", F.col("outer").alias("outer"), F.lit(0).alias("entry"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("last"))
    else:
        schema = T.StructType([conv, T.StructField("block", T.LongType()), T.StructField("m", T.ArrayType(T.LongType()))])
        outer = map_batches(grouped.select("conv_id", F.col("outer").alias("block"), "rows"), lambda b: _tables(b, "rows", False), schema)
        bounds = _resolve(materialise(outer), conv).withColumnRenamed("block", "outer").withColumn("leave", F.when(F.col("last"), F.lit(None).cast("int")).otherwise(F.col("leave")))
    b = bounds.select(F.col("conv_id").alias("c2"), F.col("outer").alias("o2"), "entry", "leave", "last")
    joined = grouped.join(b, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("outer") == F.col("o2"))).select("conv_id", "rows", "entry", "leave", "last")

    def fix(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows, entry, leave, last = (batch.column(i).to_pylist() for i in range(5))
        out = []
        for c, r, e, v, z in zip(ids, rows, entry, leave, last):
            states = borders(np.array([x["m"] for x in r], np.int64).reshape(-1, 4, 4), e, v)
            out += [(c, x["block"], states[i], states[i + 1], z and i == len(r) - 1) for i, x in enumerate(r)]
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.bool_())], names=["conv_id", "block", "entry", "leave", "last"])

    fields = [T.StructField("block", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("last", T.BooleanType())]
    return map_batches(joined, fix, T.StructType([conv, *fields]))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, n_merged, n_relabelled, n_inserted, cost, rendered)."""
    known = F.create_map(*[y for k, v in ALIASES.items() for y in (F.lit(k), F.lit(v))])
    code = F.coalesce(F.try_element_at(known, F.coalesce(F.lower(F.trim(F.col(role))), F.lit(""))), F.lit(0)).cast("int")
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), code.alias("code"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("conv_id"), F.col("turn"), F.col("code"), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("*", *(k.alias(f"k{i}") for i, k in enumerate(key[3:])))
    order = ["conv_id", "turn", "code", "k0", "k1"]
    conv = rows.schema["conv_id"]
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    numbered = materialise(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*rows.columns).mapInArrow(_numbered, schema))
    counts = numbered.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.collect_list(F.struct("part", "n")).alias("l")).where("parts > 1")
    each = spread.select(F.col("conv_id").alias("c3"), F.inline("l")).withColumn("ahead", F.sum("n").over(W.partitionBy("c3").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("c3", F.col("part").alias("p3"), F.coalesce("ahead", F.lit(0)).alias("ahead"))
    ranked = numbered.join(F.broadcast(each), F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("part") == F.col("p3")), "left").withColumn("rank", F.coalesce("ahead", F.lit(0)) + F.col("place"))
    ranked = ranked.select("conv_id", F.expr(f"rank div {block}").alias("block"), "rank", "code", "text")
    roles = ranked.groupBy("conv_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes"))
    blocks = materialise(map_batches(roles, lambda b: _tables(b, "codes", True), T.StructType([conv, T.StructField("block", T.LongType()), T.StructField("m", T.ArrayType(T.LongType()))])))
    bounds = _resolve(blocks, conv)
    b = bounds.select(F.col("conv_id").alias("c4"), F.col("block").alias("b4"), "entry", "leave", "last")
    ready = ranked.join(b, F.col("conv_id").eqNullSafe(F.col("c4")) & (F.col("block") == F.col("b4"))).drop("c4", "b4")

    names = ["conv_id", "part", "n_turns", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a partition in which each block's turns stand together, in order."""
        key: tuple | None = None
        roles: list[int] = []
        texts: list[str] = []

        def block_row() -> tuple:
            conv_id, part, entry, leave, last = key
            rendered, done = render(roles, texts, entry, leave, last)
            return conv_id, part, len(roles), done["n_merged"], done["n_relabelled"], done["n_inserted"], done["cost"], rendered

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        kind = None
        for b in batches:
            kind, out = b.schema.field(0).type, []
            for *k, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if tuple(k) != key:
                    if key is not None:
                        out.append(block_row())
                    key, roles, texts = tuple(k), [], []
                roles.append(role)
                texts.append(text)
            if out:
                yield batch(out)
        if key is not None:
            yield batch([block_row()])

    longs = [T.StructField(x, T.LongType()) for x in names[1:-1]]
    schema = T.StructType([conv, *longs, T.StructField("rendered", T.StringType())])
    small_batches(turns.sparkSession)
    grouped = ready.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "rank")
    return grouped.select("conv_id", "block", "entry", "leave", "last", "code", "text").mapInArrow(write, schema)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
