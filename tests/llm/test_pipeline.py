"""The pipeline's stages in order, each against a plain version of what it decides."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from cellweave.llm import mixing  # noqa: E402
from tests.llm.test_text_operators import brute_decontamination, brute_groups, brute_words  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def plain_passages(docs, n=20):
    """Texts without the words of later windows and the blanks behind those; None where no word is left."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        spans = [m.span() for m in WORD.finditer(t or "")]
        words = [t[a:b] for a, b in spans]
        gone = set()
        for k in range(len(words) - n + 1):
            w = tuple(words[k : k + n])
            if w in seen:
                gone |= set(range(k, k + n))
            seen.add(w)
        ends = [a for a, _ in spans[1:]] + [len(t or "")]
        cut = [(a, e) for k, ((a, _), e) in enumerate(zip(spans, ends)) if k in gone]
        keep, at = [], 0
        for a, e in cut:
            keep.append(t[at:a])
            at = e
        out[i] = t if not gone else None if len(gone) == len(words) else "".join(keep) + t[at:]
    return out


def plain_leaks(docs, items, n=10):
    """Texts without benchmark words and the blanks behind a run of them; None where no word is left."""
    grams = set()
    for t in items:
        w = [x.lower() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
        grams |= {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    sizes, out = {len(g) for g in grams}, {}
    for i, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        spans = [m.span() for m in ALNUM.finditer(low)]
        words = [low[a:b] for a, b in spans]
        hit = {k + j for s in sizes for k in range(len(words) - s + 1) if tuple(words[k : k + s]) in grams for j in range(s)}
        keep, at, k = [], 0, 0
        while k < len(spans):
            if k not in hit:
                k += 1
                continue
            first = k
            while k + 1 < len(spans) and k + 1 in hit:
                k += 1
            keep.append(t[at : spans[first][0]])
            at = BLANK.match(t, spans[k][1]).end()
            k += 1
        out[i] = t if not hit else None if len(hit) == len(words) else "".join(keep) + t[at:]
    return out


def test_run_against_brute_force(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    from cellweave.llm import quality_rules

    kept = {r["doc_id"] for r in quality_rules.op9_quality_rules(spark, SF).where("kept").collect()}
    groups = brute_groups([(i, docs[i]["text"]) for i in sorted(kept)])
    kept = sorted(i for i in kept if groups[i][1] == i)
    texts = {i: t for i, t in plain_passages([(i, docs[i]["text"]) for i in kept]).items() if t is not None}
    texts = {i: t for i, t in plain_leaks(sorted(texts.items()), items).items() if t is not None}
    result = pipeline.run(spark, SF)
    out = {r["doc_id"]: r for r in result.collect()}
    assert {i: r["text"] for i, r in out.items()} == texts
    assert any(t != docs[i]["text"] for i, t in texts.items())
    assert all(r["n_chars"] == len(r["text"]) and r["source"] == docs[i]["source"] and r["lang"] == docs[i]["lang"] for i, r in out.items())
    assert sum(v[1] for v in brute_decontamination(list(texts.items()), [(0, t) for t in items]).values()) == 0
    con = duckdb.connect()
    con.register("documents", result.select("doc_id", "source").toPandas())
    found = con.execute(mixing.SQL)
    names = [d[0] for d in found.description]
    assert {r[names.index("doc_id")]: dict(zip(names, r)) for r in found.fetchall()} == {i: {c: r[c] for c in names} for i, r in out.items()}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "pfair_mixing"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


@pytest.fixture(scope="session")
def sound(odd):
    """The odd rows, the long texts among them of words that do not repeat."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.concat(F.lit("w"), (i * 7919 % 100003).cast("string"))), " ")
    return odd.withColumn("text", F.when(F.length("text") > 1000, F.concat(words, F.lit(" "), F.substring("text", -5, 5))).otherwise(F.col("text")))


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_odd_inputs(spark, sound, none, name):
    """Clashing names come back with the caller's values; nulls, repeats and empty tables pass."""
    stage, odd = dict(pipeline.STAGES)[name], sound
    own = [c for c in odd.columns if c not in ("text", "mix_slot")]  # mixing is the last stage and adds mix_slot
    given = {tuple(r[c] for c in own) for r in odd.collect()}
    rows = stage(spark, odd, SF).collect()
    assert rows and {tuple(r[c] for c in own) for r in rows} <= given
    if name == "quality_rules":
        assert {r["doc_id"] for r in rows} == {5, 6, 8, None}
    if name == "minhash_near_dedup":  # of 5, 5, 6, 8 and the row without id the rows of the smallest id stay, and the one without
        assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "4", "5", "5", "7", "None"]
    if name in ("benchmark_decontamination", "pfair_mixing"):
        assert len(rows) == 10
    assert stage(spark, none, SF).collect() == []


def test_repeated_and_null_rows_run_through(spark, sound, tmp_path):
    docs = sound.select("doc_id", "text", "source").unionByName(sound.select("doc_id", "text", "source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {5, None} and all(r["text"] for r in rows)
