"""River networks as forests of downstream links: outlets, distances and upstream sums by pointer doubling, network ends, mouths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import materialise
from .contracts import ContractError, require_unique


def drained(segments: DataFrame, node: str, down: str, amounts: list[str], no_down: int | None = None) -> DataFrame:
    """(node, outlet, steps, status, down_<amount>, up_<amount>, up_count, direct_upstream) of every segment.

    A segment without a next one (null or ``no_down``) is an outlet; one whose next
    one is unknown ends the known network there (gap). ``down_`` sums an amount from the segment to before its
    outlet, ``up_`` over it and all that drains into it. Status: outlet, gap (the
    outlet's own status, carried up), or cycle (in one or draining into one: no outlet, no sums).

    In round k a segment knows its 2^k-th next one and what lies on the way; one
    that is 2^k steps below takes over the sums of those. So the rounds are logarithmic in the
    longest way, and each is a join and a sum on segments.
    """
    require_unique(segments, [node], "segments")
    names = [f"a{i}" for i in range(len(amounts))]
    n = segments.select(F.col(node).alias("node"), F.when(F.col(down) == (no_down if no_down is not None else F.lit(None)), None).otherwise(F.col(down)).alias("next"), *(F.coalesce(F.col(a), F.lit(0)).alias(x) for a, x in zip(amounts, names)))
    known = n.select(F.col("node").alias("known"))
    linked = n.join(known, F.col("next") == F.col("known"), "left")
    first = linked.select(
        "node",
        F.col("known").alias("to"),
        F.coalesce("known", "node").alias("end"),
        F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        (F.col("next").isNotNull() & F.col("known").isNull()).alias("gap"),
        *(F.col(x).alias(f"own_{x}") for x in names),
        *(F.when(F.col("known").isNotNull(), F.col(x)).otherwise(_nothing(F.col(x))).alias(f"d_{x}") for x in names),
        *(F.col(x).alias(f"u_{x}") for x in names),
        F.lit(1).cast("long").alias("u_n"),
    )
    held = materialise(first)
    gaps = held.where("gap").select(F.col("node").alias("g"))
    direct = held.where("to IS NOT NULL").groupBy("to").agg(F.count(F.lit(1)).alias("direct_upstream")).withColumnRenamed("to", "t")
    ups = [f"u_{x}" for x in names] + ["u_n"]
    rounds = max(1, held.count()).bit_length() + 1
    for _ in range(rounds):
        if held.where("to IS NOT NULL").isEmpty():
            break
        below = held.where("to IS NOT NULL").groupBy("to").agg(*(F.sum(u).alias(f"m_{u}") for u in ups)).withColumnRenamed("to", "t")
        ahead = held.select(F.col("node").alias("v"), F.col("to").alias("to2"), F.col("end").alias("end2"), F.col("steps").alias("steps2"), *(F.col(f"d_{x}").alias(f"d2_{x}") for x in names))
        j = held.join(ahead, F.col("to") == F.col("v"), "left").join(below, F.col("node") == F.col("t"), "left")
        some = F.col("v").isNotNull()
        held = materialise(
            j.select(
                "node",
                F.col("to2").alias("to"),
                F.when(some, F.col("end2")).otherwise(F.col("end")).alias("end"),
                (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
                *(f"own_{x}" for x in names),
                *((F.col(f"d_{x}") + F.when(some, F.col(f"d2_{x}")).otherwise(_nothing(F.col(f"d_{x}")))).alias(f"d_{x}") for x in names),
                *((F.col(u) + F.coalesce(F.col(f"m_{u}"), _nothing(F.col(u)))).alias(u) for u in ups),
            )
        )
    # who still has a next one after more steps than there are segments goes round
    loop = F.col("to").isNotNull()
    out = held.join(gaps, F.col("end") == F.col("g"), "left").join(direct, F.col("node") == F.col("t"), "left")
    keep = lambda c: F.when(~loop, c)
    return out.select(
        "node",
        keep(F.col("end")).alias("outlet"),
        keep(F.col("steps")).alias("steps"),
        F.when(loop, "cycle").when(F.col("g").isNotNull(), "gap").otherwise("outlet").alias("status"),
        *(keep(F.col(f"d_{x}")).alias(f"down_{a}") for a, x in zip(amounts, names)),
        *(keep(F.col(f"u_{x}")).alias(f"up_{a}") for a, x in zip(amounts, names)),
        keep(F.col("u_n")).alias("up_count"),
        F.coalesce("direct_upstream", F.lit(0)).alias("direct_upstream"),
    )


def _nothing(c):
    """Nothing of a column's kind."""
    return c - c


def tree_summaries(segments: DataFrame, drained_: DataFrame, node: str, length: str) -> DataFrame:
    """(outlet, segments, junctions, headwaters, length, status) of every tree; segments of cycles belong to none."""
    s = drained_.where("status <> 'cycle'").join(segments.select(F.col(node).alias("node"), F.col(length).alias("l")), "node")
    return s.groupBy("outlet").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("direct_upstream") >= 2).alias("junctions"), F.count_if(F.col("direct_upstream") == 0).alias("headwaters"), F.sum("l").alias("length"), F.first("status").alias("status"))


def network_ends(lines: DataFrame, flow: DataFrame, signature: list[str]) -> tuple[DataFrame, DataFrame]:
    """Unambiguous features with what the flow table says of their end, and the quarantined rows.

    ``lines``: row_id, feature_id and the ``signature`` columns; ``flow``: direction, from_id, to_id. Ids are compared
    trimmed, without braces, in lower case. A flow of direction 713 to 0 documents a network end, one of 709 to
    another feature a way downstream; one of 709 to 0 may be the border of an extract and says nothing; both
    kinds at once are a conflict. Rows of one id must have one signature (null equals null),
    or all are quarantined; equal ones become one, with its members listed.
    First: (feature_id, signature..., terminal, terminal_qc, members); second: rows of ``lines``.
    """
    clean = lambda c: F.lower(F.regexp_replace(F.trim(F.col(c)), r"^[{}]+|[{}]+$", ""))
    named = lines.withColumn("__id", clean("feature_id"))
    wrong = named.where(F.col("__id").isNull() | F.col("__id").isin("", "0")).limit(1)
    if not wrong.isEmpty():
        raise ContractError("a feature needs an id other than 0")
    require_unique(lines, ["row_id"], "lines")
    group = named.groupBy("__id").agg(F.count_distinct(F.struct(*signature)).alias("n"), F.min("row_id").alias("row_id"), F.to_json(F.array_sort(F.collect_list(F.col("row_id").cast("string")))).alias("members"))
    f = flow.select(clean("from_id").alias("o"), clean("to_id").alias("r"), F.col("direction").cast("int").alias("direction")).where("o IS NOT NULL AND o <> '0'")
    ends = f.groupBy("o").agg(F.max((F.col("direction") == 713) & (F.coalesce("r", F.lit("")) == "0")).alias("end"), F.max((F.col("direction") == 709) & (F.coalesce("r", F.lit("")) != "0")).alias("on"))
    sound = group.where("n = 1").join(named.drop("__id"), "row_id").join(ends, F.col("__id") == F.col("o"), "left")
    end, on = (F.coalesce(c, F.lit(False)) for c in ("end", "on"))
    qc = F.when(end & on, "conflicting_network_end_and_downstream_flow").when(end, "documented_network_end_713_to_zero").when(on, "documented_downstream_flow").otherwise("unknown_no_qualifying_flow_record")
    features = sound.select(F.col("__id").alias("feature_id"), *signature, F.when(end & ~on, 1).when(on & ~end, 0).alias("terminal"), qc.alias("terminal_qc"), "members")
    quarantine = named.join(group.where("n > 1").select("__id"), "__id", "left_semi").drop("__id")
    return features, quarantine


def mouths(local: DataFrame, coarse: DataFrame, distance: float) -> DataFrame:
    """(id, x, y, source): all mouths of the local inventory, and the coarse ones farther than ``distance`` from each of them."""
    tile = lambda c: F.floor(F.col(c) / distance)
    reach = F.sequence(F.lit(-1), F.lit(1))
    near = local.select(F.col("x").alias("lx"), F.col("y").alias("ly"), F.explode(F.transform(reach, lambda i: F.floor(F.col("x") / distance) + i)).alias("tx"), F.floor(F.col("y") / distance).alias("t0"))
    near = near.select("lx", "ly", "tx", F.explode(F.transform(reach, lambda i: F.col("t0") + i)).alias("ty"))
    c = coarse.withColumn("tx", tile("x")).withColumn("ty", tile("y")).alias("c")
    hit = (F.col("c.tx") == F.col("n.tx")) & (F.col("c.ty") == F.col("n.ty")) & (F.hypot(F.col("c.x") - F.col("n.lx"), F.col("c.y") - F.col("n.ly")) <= distance)
    rest = c.join(near.alias("n"), hit, "left_anti")
    return local.select("id", "x", "y", F.lit("local").alias("source")).union(rest.select("id", "x", "y", F.lit("coarse").alias("source")))
