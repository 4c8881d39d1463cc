"""Conversation structure repair against searches over whole audit strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from cellweave.llm import turn_repair

LEGAL = re.compile(r"(s?(ua)+)?")


def searched(rows):
    """Cheapest cost and least audit, with the turns, over states that carry whole strings."""
    best = {"": (0, "", ())}  # role initials so far, folded to the last one
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    named = {"u": "user", "a": "assistant"}

    def all_inserts(layer):
        # every number of insertions is a candidate of its own: ties are between audits of unlike length
        out = [(s, *v) for s, v in layer.items()]
        for s, v in layer.items():
            state, (cost, audit, turns) = s, v
            for _ in range(3):
                x = next(k for k in follow[state] if k in named)
                state, cost, audit, turns = follow[state][x], cost + 3, audit + "I", (*turns, (named[x], ""))
                out.append((state, cost, audit, turns))
        return out

    for role, text, fault in rows:
        layer = {}
        for state, cost, audit, turns in all_inserts(best):
            options = [(state, 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in follow[state]:
                    options.append((follow[state][role[0]], more, "K", ((role, text),)))
                options += [(follow[state][x], 3 + more, "R", ((named[x], text),)) for x in follow[state] if x in named]
            for to, c, e, t in options:
                found = (cost + c, audit + e, (*turns, *t))
                if to not in layer or found[:2] < layer[to][:2]:
                    layer[to] = found
        best = layer
    ends = [(c, a, t) for s, c, a, t in all_inserts(best) if s in ("", "a")]
    return min(ends, key=lambda x: x[:2])


def plain(turns):
    """The whole contract over (conv_id, turn, role, text) rows, in Python."""
    out = {}
    for conv in {r[0] for r in turns}:
        rows = []
        for c, t, role, text in turns:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in rows:
            s = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            judged.append((role, text, "blank" if not s else "duplicate" if (role, text) in seen else "" if s[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        numbers = {r[0] for r in rows if r[0] is not None}
        initials = [r[1][:1] for r in rows]
        cost, audit, made = searched(judged)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(sum(j[2] == x for j in judged) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        )
    return out


def made(rng, convs, longest):
    texts = ["Yes.", "No", "", "  ", "Why?\n", "Fine!", "x" * 70 + "1.", "x" * 70 + "2.", None, "é…"]
    return [(c, rng.choice([None, *range(t, t + 3)]) if rng.random() < 0.1 else t * 2, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.7 else f"text {rng.random()}.") for c in convs for t in range(rng.randrange(0, longest))]


@pytest.fixture
def answer(spark, monkeypatch):
    def run(rows):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        monkeypatch.setattr(turn_repair, "table", lambda *_: df)
        return {r[0]: tuple(r)[1:] for r in turn_repair.op11_turn_repair(spark, "").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}

    return run


def test_single_blocks_equal_search(answer):
    rows = made(random.Random(1), [None, *range(120)], 9)
    assert answer(rows) == plain(rows)


def test_many_blocks_equal_search(answer, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK", 3)
    monkeypatch.setattr(turn_repair.repair_turns, "__defaults__", ("conv_id", "turn", "role", "text", None, 3))
    monkeypatch.setattr(turn_repair, "FAN", 3)
    rows = made(random.Random(2), [None, 1, 2, 3, 4], 90) + made(random.Random(3), range(5, 40), 12)
    assert answer(rows) == plain(rows)


def test_audits_are_legal_and_least(spark):
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "x"]), str(i), rng.choice(["", "", "truncated", "blank"])) for i in range(rng.randrange(0, 8))]
        code = {"": 0, "blank": 1, "truncated": 3}
        cost, audit, turns = turn_repair.repaired([(turn_repair._initial(r), code[f]) for r, _, f in rows])
        want = searched(rows)
        assert (cost, audit) == want[:2]
        initials = "".join((rows[i][0] if to is None else turn_repair.ROLE[to])[0] for i, to in turns)
        assert LEGAL.fullmatch(initials)


def test_a_hot_conversation_in_one_turn_and_dropped_rows(answer):
    gone = [(c, 0, "user", "Hi.") for c in range(3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(7777, None, "user", "Same.")] * 700 + [(7777, t, "assistant", "Same.") for t in range(600)] + gone
    got = answer(rows)
    assert got == plain(rows)
    assert got[gone[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_other_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x"), (1, 1, "assistant", "Yes.", 6, "y")], "conv_id string, turn int, role string, text string, part int, gone string")
    rows = sorted(turn_repair.repair_turns(df).collect(), key=lambda r: r["part"] or 0)
    assert "".join(r["audit"] for r in rows) == "KK" and sum(r["cost"] for r in rows) == 0 and {r["conv_id"] for r in rows} == {"1"}
    assert [t for r in rows for t in r["repaired"]] == ["user:Hi.", "assistant:Yes."]
    assert turn_repair.repair_turns(df.limit(0)).count() == 0
