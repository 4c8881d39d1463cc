"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

from cellweave.llm import collocations

PIECES = "[.,;:!?\n\x0b\x0c\r]"


def plain(rows, max_n, least, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(PIECES, text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, max_n + 1):
                    if i + m <= len(w):
                        f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = [b for (x, q), b in found.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in inside):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def got(df, **how):
    return {tuple(r) for r in collocations.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_phrases_equal_plain_counting(spark):
    rng = random.Random(3)
    words = ["the", "The", "a", "b\x01c", "b\x00", "b", "é", "éa", "x\x7f", "of", "of\x02"]
    rows = [(rng.choice(["en", "fr", None, "a\x00b"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\r\n", ","]) for _ in range(rng.randrange(0, 120)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), ("de", " \t "), ("en", rows[0][1]), ("en", rows[0][1])]
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "lang string, text string, n long, score long")
    for max_n, least, top in ((3, 2, 2000), (2, 3, 5), (4, 2, 50)):
        assert got(df, max_n=max_n, least=least, top=top) == plain(rows, max_n, least, top)


def test_counts_do_not_depend_on_the_cut_into_runs_and_partitions(spark, monkeypatch):
    text = " ".join(f"w{i % 7} hot" for i in range(3000)) + ". tail hot"
    df = spark.createDataFrame([("en", text), ("en", text), ("und", text), (None, text)], "lang string, text string")
    monkeypatch.setattr(collocations, "RUN", 50)
    assert got(df.repartition(3)) == plain([tuple(r) for r in df.collect()], 3, 10, 2000)


def test_long_counts_pass_64_bits(spark):
    big = 10**12
    scored = spark.range(1).selectExpr(f"(cast(1000000 as decimal(38,0)) * cast({big} as decimal(38,0)) * cast({big} as decimal(38,0))) div (cast({big} as decimal(38,0)) * cast({2 * big} as decimal(38,0))) as s")
    assert scored.first()["s"] == 500000


def test_phrases_of_odd_tables(odd, none):
    tagged = odd.selectExpr("*", "source as lang")
    assert {r["lang"] for r in collocations.collocations(tagged, least=2).collect()} == {"b", "c"}
    assert collocations.collocations(none.selectExpr("*", "source as lang")).count() == 0
