"""Pfair mixing and chat repair against simulations and exhaustive search."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from cellweave.llm import chat_format, mixing


def edf(shares, period):
    """Slot by slot: the released block of the earliest deadline, of ties the first source."""
    done, out = [0] * len(shares), []
    for t in range(period):
        ready = [(-(-(done[i] + 1) * period // s), i) for i, s in enumerate(shares) if done[i] < s and done[i] * period // s <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def test_template_is_the_simulated_schedule(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 50), (None, 7), ("c", 333)], "source string, docs long")
    shared = mixing.shares(counts)
    s = sorted(shared.collect(), key=lambda r: r["idx"])
    assert sum(r["share"] for r in s) == s[0]["period"] == 1024
    slots = {r["slot"]: r["idx"] - 1 for r in mixing.template(shared).collect()}
    assert [slots[t] for t in range(1024)] == edf([r["share"] for r in s], 1024)


def test_no_source_is_a_block_off_its_target(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("element_at(array('a','b','c','a'), cast(id % 4 as int) + 1)").alias("source"))
    rows = mixing.mix(docs, weights).select("source", "mix_slot", "mix_block", "mix_share", "mix_on_target", "mix_position").collect()
    assert len({r["mix_position"] for r in rows}) == 3000
    blocks = {r["mix_slot"]: r for r in rows if r["mix_on_target"]}
    share = {r["source"]: r["mix_share"] / 1024 for r in rows}
    assert abs(share["a"] - 0.5) < 0.01 and abs(sum(share.values()) - 1) < 1e-9
    n = dict.fromkeys(share, 0)
    for t in sorted(blocks):
        n[blocks[t]["source"]] += 1
        assert all(abs(n[s] - (t + 1) * w) < 1 for s, w in share.items())
    assert sorted(blocks) == list(range(len(blocks)))


def test_mixing_on_odd_inputs(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and len({r["mix_position"] for r in rows}) == 10
    assert mixing.mix(none).count() == 0


def test_a_source_spread_over_buckets_is_ranked_without_gaps(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("hot").alias("source"))
    rows = mixing.mix(docs).where("source = 'hot'").groupBy("mix_block").count().collect()
    sizes = {r["mix_block"]: r["count"] for r in rows}
    assert sorted(sizes) == list(range(len(sizes))) and sum(v != 16 for v in sizes.values()) <= 1


def cheapest(roles):
    """Least cost by exhaustive recursion over the same moves, written apart from the operator."""
    follow = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
    end = {0: 0, 1: 6, 2: 3, 3: 0}

    @lru_cache(None)
    def best(i, state):
        if i == len(roles):
            return end[state]
        r, options = roles[i], []
        for x in follow[state]:
            options.append((0 if x == r else 2) + best(i + 1, x))
            for y in follow[x]:
                options.append(3 + (0 if y == r else 2) + best(i + 1, y))
        if state:
            options.append(1 + (0 if state == r else 2) + best(i + 1, state))
        return min(options)

    return best(0, 0)


def legal(rendered):
    import re

    roles = re.findall(r"<\|(system|user|assistant)\|>\n", rendered)
    body = roles[1:] if roles[:1] == ["system"] else roles
    return body == ["user", "assistant"] * (len(body) // 2) and len(body) % 2 == 0


def test_repairs_are_cheapest_and_legal():
    r = random.Random(9)
    for _ in range(300):
        roles = [r.randrange(4) for _ in range(r.randrange(1, 9))]
        text, done = chat_format.render(roles, [f"t{i}" for i in range(len(roles))], 0, None, True)
        assert done["cost"] == cheapest(tuple(roles)), roles
        assert legal(text), (roles, text)
        assert all(f"t{i}" in text for i in range(len(roles)))


@pytest.mark.parametrize("fan", [512, 3])
def test_long_conversations_are_repaired_in_blocks(spark, monkeypatch, fan):
    monkeypatch.setattr(chat_format, "FAN", fan)
    r = random.Random(3)
    rows, names = [], ["user", "assistant", "system", None, "tool"]
    for c, n in ((1, 200), (2, 5), (3, 41), (None, 7)):
        rows += [(c, i, r.choice(names), f"text {c} {i} <|end|>") for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat_format.format_chats(df, block=4).collect()
    for c in (1, 2, 3, None):
        parts = sorted((x for x in got if x["conv_id"] == c), key=lambda x: x["part"])
        mine = [x for x in rows if x[0] == c]
        assert [x["part"] for x in parts] == list(range(-(-len(mine) // 4)))
        assert sum(x["cost"] for x in parts) == cheapest(tuple({"user": 2, "assistant": 3, "system": 1}.get(x[2], 0) for x in mine))
        whole = "".join(x["rendered"] for x in parts)
        assert legal(whole) and all(f"text {c} {i} " in whole for i in range(len(mine)))


def test_chat_on_odd_inputs(spark):
    df = spark.createDataFrame([(1, None, None, None, 0), (1, None, None, None, 0), (2, 0, "USER ", "hi", 1)], "conv_id long, turn long, role string, text string, part long")
    got = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert got[2]["rendered"] == "<|user|>\nhi<|end|>\n<|assistant|>\n<|end|>\n" and got[2]["cost"] == 3
    assert got[1]["n_turns"] == 2 and legal(got[1]["rendered"])
    assert chat_format.format_chats(df.limit(0)).count() == 0
