"""River forests against walking down, network ends by their rules, outlines of pixels against counting."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import overlay, rivers
from cellweave.operators.contracts import ContractError


def walked(rows):
    down = {n: d for n, d, _ in rows}
    amount = {n: a or 0 for n, _, a in rows}
    up = {n: [0, 0] for n in down}
    out = {}
    for n in down:
        way, x = [], n
        while x in down and x not in way:
            way.append(x)
            x = down[x]
        loop = x in way
        if not loop:
            out[n] = (way[-1], len(way) - 1, "gap" if x not in (None, 0) else "outlet", sum(amount[w] for w in way[:-1]))
            for w in way:
                up[w][0] += amount[n]
                up[w][1] += 1
        else:
            out[n] = (None, None, "cycle", None)
    direct = {n: sum(d == n for d in down.values()) for n in down}
    return {n: (*v, *((up[n]) if v[2] != "cycle" else (None, None)), direct[n]) for n, v in out.items()}


def test_forests_equal_walking_down(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 9999]) if i < 6 or rng.random() < 0.03 else rng.randrange(1, i), rng.choice([None, 1, 2, 5])) for i in range(1, 300)]
    rows += [(400, 401, 1), (401, 402, 1), (402, 400, 1), (403, 400, 2), (404, 404, 1), (405, 403, 7)]
    df = spark.createDataFrame(rows, "id long, next long, km long")
    got = {r[0]: tuple(r)[1:] for r in rivers.drained(df, "id", "next", ["km"], no_down=0).select("node", "outlet", "steps", "status", "down_km", "up_km", "up_count", "direct_upstream").collect()}
    assert got == walked(rows)
    trees = {r["outlet"]: r for r in rivers.tree_summaries(df, rivers.drained(df, "id", "next", ["km"], no_down=0), "id", "km").collect()}
    assert sum(t["segments"] for t in trees.values()) == 299 and set(trees) == {v[0] for v in got.values() if v[0]}
    with pytest.raises(ContractError):
        rivers.drained(df.union(df.limit(1)), "id", "next", ["km"])


def test_a_chain_of_100_000_takes_few_rounds(spark):
    df = spark.range(1, 100_001).select(F.col("id"), (F.col("id") - 1).alias("next"), F.lit(1.5).alias("km"))
    out = rivers.drained(df, "id", "next", ["km"], no_down=0)
    last, first = (out.where(f"node = {n}").first() for n in (100_000, 1))
    assert (last["outlet"], last["steps"], last["up_count"]) == (1, 99_999, 1) and last["down_km"] == pytest.approx(1.5 * 99_999)
    assert (first["outlet"], first["steps"], first["up_count"], first["up_km"]) == (1, 0, 100_000, 150_000.0)


def test_network_ends_and_quarantine(spark):
    lines = spark.createDataFrame([(1, "{AB}", 5, "x"), (2, "ab ", 5, "x"), (3, "C", 5, None), (4, "c", 6, None), (5, "d", 1, None), (6, "e", 1, None), (7, "f", 1, None), (8, "F", 1, None)], "row_id long, feature_id string, ftype int, name string")
    flow = spark.createDataFrame([(713, "AB", "0"), (709, "d", "0"), (709, "e", "d"), (713, "e", "{0}"), (709, "f", "ab"), (709, "0", "d"), (709, None, "d")], "direction int, from_id string, to_id string")
    good, bad = rivers.network_ends(lines, flow, ["ftype", "name"])
    rows = {r["feature_id"]: (r["terminal"], r["terminal_qc"], r["members"]) for r in good.collect()}
    assert rows == {"ab": (1, "documented_network_end_713_to_zero", '["1","2"]'), "d": (None, "unknown_no_qualifying_flow_record", '["5"]'), "e": (None, "conflicting_network_end_and_downstream_flow", '["6"]'), "f": (0, "documented_downstream_flow", '["7","8"]')}
    assert sorted(r["row_id"] for r in bad.collect()) == [3, 4]
    with pytest.raises(ContractError):
        rivers.network_ends(lines.withColumn("feature_id", F.lit("0")), flow, ["ftype"])


def test_mouths_keep_coarse_ones_far_from_local_ones(spark):
    rng = random.Random(4)
    local = [(i, rng.uniform(0, 100), rng.uniform(-50, 50)) for i in range(40)]
    coarse = [(1000 + i, rng.uniform(0, 100), rng.uniform(-50, 50)) for i in range(200)]
    df = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["id"] for r in rivers.mouths(df(local), df(coarse), 7.0).collect()}
    assert got == {i for i, _, _ in local} | {i for i, x, y in coarse if all((x - a) ** 2 + (y - b) ** 2 > 49 for _, a, b in local)}


def test_outlines_of_pixels(spark):
    rng = random.Random(6)
    cells = {(r, c): rng.choice([None, "a", "a", "b"]) for r in range(15) for c in range(17)}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row long, col long, label string")
    made = overlay.polygonised(df.union(df), "label", 2.0).collect()
    for kind in "ab":
        mine = [r for r in made if r["label"] == kind]
        assert sum(r["area"] for r in mine) == 4 * sum(v == kind for v in cells.values())
        # outer rings are the components of pixels with common sides
        left, parts = {p for p, v in cells.items() if v == kind}, 0
        while left:
            parts, front = parts + 1, [left.pop()]
            while front:
                r, c = front.pop()
                for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if p in left:
                        left.remove(p)
                        front.append(p)
        assert sum(not r["hole"] for r in mine) == parts
        for r in mine:
            ring = [(p["x"], p["y"]) for p in r["ring"]]
            assert all((a[0] == b[0]) != (a[1] == b[1]) and (a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2]))
