"""Defined results of the text operators on odd inputs, and brute-force versions of what SQL cannot express."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, near_dedup, ordinal_quality, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity
from cellweave.llm import textkit as K

DATA = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_match_the_pattern():
    texts = ["a  b\tc", "", "é ü\x0bz", None, " x", "ends ", " one", "日本 語\r\nx"]
    data, offsets = K.string_buffers(pa.array(texts))
    w = K.split_words(data, offsets)
    got = [[data[a:b].tobytes().decode() for a, b, t in zip(w.start, w.end, w.text) if t == i] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(w.hashes().tolist())) == len({x for g in got for x in g})


def test_sliced_batches_and_long_texts_keep_their_words():
    texts = ["x y z", "q " * 900000, None, "last one"]
    column = pa.array(["drop me", *texts]).slice(1)
    data, offsets = K.string_buffers(column)
    counts = np.concatenate([K.split_words(d, o).counts() for _, _, d, o in K.pieces(data, offsets)])
    assert counts.tolist() == [3, 900000, 0, 2]


def test_quality_rules_on_odd_inputs(odd, none):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == 10
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[3]["n_words"] == 0 and got[3]["n_dup_lines"] == 0
    assert got[7]["word_chars"] == 10 and got[7]["base_failed"]
    assert quality_rules.quality_rules(none).count() == 0


def test_host_rate_is_shrunk_and_joined_back(spark):
    good = " ".join(f"plain{k}" for k in range(30))
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, "bad", "poor") for i in range(30)] + [(200, good, "poor")]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[0]["kept"] and not got[200]["kept"] and not got[200]["base_failed"]
    assert got[200]["host_docs"] == 31 and got[200]["host_failures"] == 30
    assert 0 < got[0]["host_rate"] < got[200]["host_rate"] < 1


def test_token_counts_splice_alike(odd, none):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("piece_bpe_32k.model"))
    t = token_counts.tokenizer(path)
    texts = ["plain words and more " * 60, "a" * 3000, "x  y   z " * 300, "é" * 500 + " " + "ü" * 500, "<s> </s> " * 90, "日本語 " * 200, "▁a ▁ b▁c " * 90, "a\t\n b" * 200, "", " ", " " * 700, "a" + " " * 600 + "b c d " * 50]
    for chunk, overlap in ((200, 16), (37, 3), (64, 1), (1 << 16, 1 << 9)):
        got, made = token_counts.count_spliced(t, [x.encode() for x in texts], chunk, overlap)
        assert got == t.count_all(texts) and (made > 20) == (chunk < 1000)
    rows = by_id(token_counts.token_counts(odd, path, chunk=300, overlap=8))
    assert rows[1]["n_tokens"] == 0 and rows[2]["n_bytes"] == 0
    assert rows[5]["n_tokens"] == t.count_all([rows[5]["text"]])[0]
    assert token_counts.token_counts(none, path).count() == 0


def test_token_counts_are_the_librarys_and_spliced(spark):
    public = pytest.importorskip("public_tokenizers")
    t = token_counts.tokenizer(str(public.path("piece_bpe_32k.model")))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    got, made = token_counts.count_spliced(t, [x.encode() for x in texts])
    assert made > 2000 and got == t.count_all(texts)
    huge = ["".join(texts[:1500])[: 3 << 20], "no-blank-" * 40000]
    got, made = token_counts.count_spliced(t, [x.encode() for x in huge])
    assert made > 400 and got == t.count_all(huge)


def test_token_counts_splice_texts_without_blanks():
    public = pytest.importorskip("public_tokenizers")
    t = token_counts.tokenizer(str(public.path("piece_bpe_32k.model")))
    rng = random.Random(9)
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=40000))
    ideographs = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(15000))
    lines = "".join("".join(rng.choices("etaoinshrdlu", k=50)) + "\n" for _ in range(800))
    code = "".join(rng.choice(["function(", "a=b;", "return", "{x:1}", "<s>", "</s>", "▁", "é", "\t"]) for _ in range(9000))
    texts = [base64, ideographs, lines, code, "a" * 30000 + "1" + "b" * 9000, "ab" * 12000]
    for chunk, overlap, upto in ((token_counts.CHUNK_BYTES, token_counts.OVERLAP_BYTES, None), (100, 8, 6000), (7, 1, 1500)):
        for text in (x[:upto] for x in texts):
            got, made = token_counts.count_spliced(t, [text.encode()], chunk, overlap)
            assert got == t.count_all([text])
            if len(set(text)) > 3:  # chunks stay short: a splice nearly every chunk
                assert made >= len(text.encode()) // (chunk + token_counts.NEAR) * 0.5


def test_token_counts_of_one_huge_text_take_little_at_once(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    t = token_counts.tokenizer(str(public.path("piece_bpe_32k.model")))
    line = "https://example.org/path?id=0123456789abcdefghijkl\n".encode()
    widest, whole = [0], t.starts
    monkeypatch.setattr(t, "starts", lambda raw, spans: (widest.append(max(b - a for a, b in spans)), whole(raw, spans))[1])
    (got,), made = token_counts.count_spliced(t, [line * 100000])
    monkeypatch.undo()
    assert made > 1000 and max(widest) < 3 * token_counts.CHUNK_BYTES
    one, two = t.count_all([line.decode(), (line * 2).decode()])
    assert got == one + (two - one) * 99999


def brute_decontamination(docs, items, n=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    grams = {}
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    for i, t in docs:
        w, hit, found = norm(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    hit |= set(range(k, k + size))
                    found |= grams[g]
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("set_windows", [1 << 20, 7])
def test_decontamination_against_brute_force(spark, set_windows):
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 9, 10, 14])))) for i in range(8)] + [(8, None), (8, "only Two")]
    docs = [(i, " ".join([*(r.choice(words).upper() for _ in range(8)), r.choice(items)[1] or "", *(r.choice(words) for _ in range(4))])) for i in range(30)] + [(30, None), (31, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(d, b, set_windows=set_windows).collect()
    want = brute_decontamination(docs, items)
    assert {x["doc_id"]: (x["n_words"], sum(x["hit_spans"][2::3]), x["hit_items"]) for x in got} == want
    clean = {x["doc_id"]: x["text"] for x in decontaminate.decontaminate(d, b).collect()}
    assert all(want[i][1] or clean[i] == t for i, t in docs)
    assert decontaminate.scan(d, b.limit(0)).where(F.size("hit_spans") > 0).count() == 0
    assert decontaminate.decontaminate(d, b, "documents").count() == sum(not v[1] for v in want.values())


def test_decontamination_on_odd_inputs(odd, none, spark):
    b = spark.createDataFrame([(None, "one two")], "item_id long, text string")
    got = decontaminate.scan(odd, b).collect()
    assert len(got) == 10 and {r["doc_id"]: r for r in got}[4]["hit_items"] == []
    assert decontaminate.decontaminate(odd, b).columns == odd.columns
    assert decontaminate.scan(none, b).count() == 0


def brute_groups(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(11)
    docs, i = [], 0
    for group in range(12):
        base = [f"g{group}w{r.randrange(400)}" for _ in range(r.choice([3, 30, 150]))]
        for _ in range(r.choice([1, 2, 40])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.02, 0.04]))):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            docs.append((i := i + 1, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_groups(docs)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_near_duplicates_inside_a_dense_region(spark):
    """Hundreds of texts share a template at about 0.67; planted pairs of 0.75 to 0.77 among them are all found."""
    rng = np.random.default_rng(5)
    length, group, changes, planted = 504, 1200, 10, 60
    template = [f"w{i}" for i in range(length)]
    slots = np.arange(4, length - 4, 5)
    texts = []
    for d in range(group):
        at = rng.choice(slots, changes, replace=False)
        own = {int(p): f"d{d}p{p}" for p in at}
        if d >= group - planted:  # shares three of its changes with the text so many before
            mate = texts[d - planted]
            taken = [int(p) for p in slots if mate[p] != template[p]][:3]
            free = [p for p in own if p not in taken and mate[p] == template[p]][: changes - 3]
            own = {p: mate[p] for p in taken} | {p: own[p] for p in free}
        texts.append([own.get(i, w) for i, w in enumerate(template)])
    order = rng.permutation(group)
    docs = [(int(order[d]), " ".join(t)) for d, t in enumerate(texts)]
    sets = {d: {hash(tuple(w[i : i + 5])) for w in [t.split()] for i in range(len(w) - 4)} for d, t in docs}
    code = {x: i for i, x in enumerate(sorted(set().union(*sets.values())))}
    has = np.zeros((group, len(code)), np.float32)
    for d, x in sets.items():
        has[d, [code[v] for v in x]] = 1
    common, n = (has @ has.T).astype(int), has.sum(1).astype(int)
    label = np.arange(group)
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(100 * common >= 75 * (n[:, None] + n - common), 1)))]
    for _ in range(group):
        before = label.copy()
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if (before == label).all():
            break
    assert len(links) >= planted and len(set(label.tolist())) > group // 2
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    wrong = [d for d in range(group) if got[d] != label[d]]
    assert not wrong, f"{len(wrong)} documents wrong"


@pytest.mark.parametrize("centres", [40, 500])
def test_near_duplicates_of_many_centres_of_one_template(spark, centres):
    """26 members at about 0.77 round each of many centres at about 0.75 of one text: no link is lost as the region grows."""
    rng = np.random.default_rng(centres)
    length, members = 200, 26
    template = np.arange(length)
    texts, centre_of = [], []
    for c in range(centres):
        own = template.copy()
        spots = rng.choice(length // 8, rng.integers(5, 7), replace=False) * 8 + 4
        own[spots] = 10**6 + 100 * c + np.arange(len(spots))
        for m in range(members):
            t = own.copy()
            if m:
                at = rng.choice(length // 8, rng.integers(4, 7), replace=False) * 8 + rng.integers(0, 8)
                t[at] = 10**8 + 1000 * len(texts) + np.arange(len(at))
            texts.append(t)
            centre_of.append(c)
    n = len(texts)
    words = np.array(texts)
    shingles = np.lib.stride_tricks.sliding_window_view(words, 5, axis=1)
    plain = (shingles == np.lib.stride_tricks.sliding_window_view(template, 5)[None]).all(2).astype(np.float32)
    size = shingles.shape[1]  # all words of a text differ, so are its shingles
    need = -(-75 * 2 * size // 175)
    label = np.arange(n)

    def join(i, j):
        a, b = label[i], label[j]
        if a != b:
            label[label == max(a, b)] = min(a, b)

    for a in range(0, n, 500):
        for i, j in zip(*np.nonzero(plain[a : a + 500] @ plain.T >= need)):
            if a + i < j:
                join(a + i, j)
    for c in range(centres):
        rows = np.arange(c * members, (c + 1) * members)
        for k, i in enumerate(rows):
            same = (shingles[i][None] == shingles[rows[k + 1 :]]).all(2).sum(1)
            for j in rows[k + 1 :][same >= need]:
                join(i, j)
    order = rng.permutation(n)
    docs = spark.createDataFrame([(int(order[d]), " ".join(map(str, t))) for d, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    least = {}
    for d in range(n):
        least[label[d]] = min(least.get(label[d], n), int(order[d]))
    wrong = [d for d in range(n) if got[int(order[d])] != least[label[d]]]
    assert len(least) > centres and not wrong, f"{len(wrong)} of {n} documents wrong, {len(least)} groups"


def test_near_duplicates_of_a_hot_shingle(spark, monkeypatch):
    """Postings dealt in cells give the same links."""
    monkeypatch.setattr(near_dedup, "CELL", 20)
    monkeypatch.setattr(near_dedup, "SIDE", 2)
    r = random.Random(12)
    docs = []
    for group in range(3):
        base = [f"w{i}" if i < 60 else f"g{group}w{i}" for i in range(100)]
        for _ in range(120):
            w = list(base)
            for _ in range(r.choice([1, 3, 5])):
                w[r.randrange(100)] = f"n{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_groups(docs)


def test_near_duplicates_at_other_thresholds(spark):
    r = random.Random(13)
    docs = []
    for group in range(20):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(6):
            w = list(base)
            for _ in range(r.choice([1, 2, 3, 4])):
                w[r.randrange(60)] = f"n{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (50, 90):
        got = near_dedup.near_duplicates(df, percent=percent).collect()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_groups(docs, percent)
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(df, percent=30)


def test_near_duplicates_on_odd_inputs(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and got[1]["n_shingles"] == 0 and got[1]["kept"] and got[2]["component_id"] == 2
    assert got[4]["n_shingles"] == 1 and got[6]["component_id"] == 5 and not got[6]["kept"]
    assert got[None]["component_id"] == 5
    assert near_dedup.near_duplicates(none).count() == 0


def brute_words(docs, n=20):
    seen, late = {}, set()
    for i, t in sorted(docs):
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in seen:
                late |= {(i, k + j) for j in range(n)}
            seen.setdefault(tuple(w[k : k + n]), (i, k))
    out = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        kept = [x for k, x in enumerate(w) if (i, k) not in late]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup_against_brute_force(spark):
    r = random.Random(2)
    pool = [[f"p{r.randrange(60)}" for _ in range(r.choice([19, 20, 21, 55]))] for _ in range(5)] + [["same"] * 70, ["x", "y"] * 30]
    docs = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(6)):
            w += r.choice(pool) if r.random() < 0.6 else [f"q{r.randrange(900)}" for _ in range(r.randrange(40))]
        docs.append((i, " ".join(w)))
    got = substring_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got.collect()} == brute_words(docs)


def test_recompression_names_equal_substrings_alike():
    r = random.Random(6)
    inner = [f"t{r.randrange(30)}" for _ in range(60)]
    found = []
    for side in ("left", "right"):
        text = " ".join([f"{side}{k}" for k in range(25)] + inner + [f"{side}{k}" for k in range(25)])
        w = K.split_words(*K.string_buffers(pa.array([text])))
        h = w.hashes()
        top = substring_dedup.rounds(w, h)[-1]
        inside = (top.low >= 25) & (top.high <= 85)
        found.append(top.name[inside].tolist())
        at = np.arange(25, 25 + 41)
        name, begin, end = substring_dedup.anchors(w, h, at)
        assert ((at <= begin) & (end <= at + substring_dedup.WINDOW)).all()
        found.append(np.stack([name.astype(object), begin - at, end - at]).tolist())
    assert found[0] == found[2] and len(found[0]) > 10
    assert found[1] == found[3]


def _window_columns(texts):
    w = substring_dedup.Windows(*K.string_buffers(pa.array(texts)))
    return w, substring_dedup.keys(w.name, w.at, w.begin, w.end, w.hashes)


def test_windows_are_known_by_their_symbols_and_verified_by_their_words(monkeypatch):
    """Without the symbols' names different windows share a key; the words still tell them apart."""
    r = random.Random(21)
    parts = [[f"t{r.randrange(6)}" for _ in range(30)] for _ in range(6)]
    texts = [" ".join(sum((r.choice(parts) for _ in range(5)), [])) for _ in range(40)]
    base = [f"b{i}" for i in range(22)]
    texts += [" ".join(f"v{v}" if i == k else x for i, x in enumerate(base)) for k in range(22) for v in range(30)]
    w, key = _window_columns(texts)
    content = [w.raw[w.start[i] : w.start[i + substring_dedup.WINDOW]].tobytes() for i in w.at.tolist()]
    assert len(set(key.tolist())) == len(set(content))
    first, late = {}, []
    for c, row, pos in zip(content, w.row.tolist(), w.pos.tolist()):
        late.append(first.setdefault(c, (row, pos)) != (row, pos))
    assert substring_dedup.later_ones(key, w.row, w.pos, w.at, w.raw, w.start).tolist() == late
    blind = substring_dedup.keys(np.zeros_like(w.name), w.at, w.begin, w.end, w.hashes)
    assert len(set(blind.tolist())) < len(set(content))
    same = np.zeros(len(key), np.uint64)
    for names in (blind, same):
        assert substring_dedup.later_ones(names, w.row, w.pos, w.at, w.raw, w.start).tolist() == late


def test_substring_dedup_with_hot_symbols(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_HOT", 2)
    monkeypatch.setattr(substring_dedup, "HOT", 1e-9)
    r = random.Random(22)
    docs = [(i, " ".join(f"p{r.randrange(3)}" for _ in range(r.randrange(60)))) for i in range(40)] + [(50 + i, "a b " * 30 + f"tail{i % 2} " * 20) for i in range(6)]
    got = substring_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got.collect()} == brute_words(docs)


def test_substring_dedup_on_odd_inputs(odd, none):
    rows = substring_dedup.digests(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and got[1]["n_words"] == 0 and got[None]["n_removed"] == 0 and got[6]["n_removed"] >= 3000
    assert substring_dedup.dedup(odd).columns == odd.columns
    assert substring_dedup.digests(none).count() == 0


def brute_bytes(docs, n=50):
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - n + 1):
            first[raw[k : k + n]] = min(i, first.get(raw[k : k + n], i))
    out = {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - n + 1):
            if first[raw[k : k + n]] < i:
                gone[k : k + n] = True
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark):
    r = random.Random(8)
    docs = []
    for alphabet in ("ab", "abcdefgh é"):
        pool = ["".join(r.choice(alphabet) for _ in range(r.choice([40, 49, 50, 51, 60, 200]))) for _ in range(6)] + ["z" * 120, "xy" * 70]
        for _ in range(40):
            docs.append((len(docs), "".join(r.choice(pool) if r.random() < 0.6 else "".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(r.randrange(6)))))
    got = suffix_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == brute_bytes(docs)


def test_suffix_dedup_does_not_trust_fingerprints(spark, monkeypatch):
    """Segments whose fingerprints collide are told apart by their bytes."""
    r = random.Random(31)
    pool = ["".join(r.choice("abcd") for _ in range(r.choice([55, 70]))) for _ in range(5)]
    docs = [(i, "".join(r.choice(pool) if r.random() < 0.5 else "".join(r.choice("abcd") for _ in range(60)) for _ in range(4))) for i in range(30)]
    texts = pa.array([t for _, t in docs])
    data, offsets = K.string_buffers(texts)
    start, count, gram, place, several = suffix_dedup.segments(data, offsets, np.zeros(0, np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    size = count + suffix_dedup.LENGTH - 1
    raw = suffix_dedup._gather(data, start, size)
    head = np.zeros(len(start), suffix_dedup._HEAD)
    head["gram"], head["doc"], head["pos"], head["count"], head["offset"], head["several"] = gram, row, start - offsets[row], count, place, several
    want = suffix_dedup.settle(head, raw)
    plain = suffix_dedup._prints

    def blind(*a):
        out = plain(*a)
        out[:, 1] = out[:, 4] = 5  # whole segments all look alike
        return out

    monkeypatch.setattr(suffix_dedup, "_prints", blind)
    got = suffix_dedup.settle(head, raw)
    assert len(want[0]) > 5 and all((x == y).all() for x, y in zip(want, got))
    late = suffix_dedup._same_later(gram, np.zeros(len(gram), np.uint64), head["doc"], data, start, size)
    seen = {}
    for i in np.lexsort((head["doc"], gram)):
        seen.setdefault((int(gram[i]), data[start[i] : start[i] + size[i]].tobytes()), int(head["doc"][i]))
    assert all(seen[(int(gram[i]), data[start[i] : start[i] + size[i]].tobytes())] < head["doc"][i] for i in np.flatnonzero(late))


def test_merged_transforms_are_sorted_with_their_prefixes():
    r = np.random.default_rng(3)
    for _ in range(10):
        strings = [r.integers(97, 99, r.integers(1, 30)).astype(np.uint8) for _ in range(r.integers(2, 12))]
        k = int(r.integers(1, len(strings)))
        transforms, suffixes = [], []
        for group in (strings[:k], strings[k:]):
            symbols, end = [], []
            for s in group:
                end += [len(symbols) + len(s)] * (len(s) + 1)
                symbols += [int(c) + 1 for c in s] + [0]
            x = suffix_dedup.Shard(np.array(symbols, np.uint16), np.array(end))
            transforms.append(x.bwt)
            suffixes += [tuple(symbols[i : end[i] + 1]) for i in x.suffix]
        order, lcp = suffix_dedup.merge(transforms, 8)
        got = [suffixes[i] for i in order]
        assert [g[:8] for g in got] == sorted(g[:8] for g in got)
        for a, b, n in zip(got, got[1:], lcp[1:].tolist()):
            if len(a) > 8 and len(b) > 8:
                same = next((q for q in range(8) if a[q] != b[q]), 8)
                assert n == same


@pytest.mark.parametrize("letters", [2, 60, 255])
def test_merging_by_several_symbols_is_merging_by_one(letters):
    r = np.random.default_rng(letters)
    for _ in range(15):
        transforms, held = [], []
        for _ in range(r.integers(1, 260 if letters == 2 else 5)):  # more shards than a byte counts, too
            symbols, end = [], []
            for _ in range(r.integers(1, 6)):
                s = [*(held[r.integers(len(held))] if held and r.random() < 0.5 else []), *(r.integers(1, letters + 1, r.integers(0, 30)).tolist())][-60:]
                held.append(s)
                end += [len(symbols) + len(s)] * (len(s) + 1)
                symbols += [*s, 0]
            x = suffix_dedup.Shard(np.array(symbols, np.uint16), np.array(end))
            content = [symbols[i : end[i] + 1] for i in range(len(symbols))]
            assert x.suffix.tolist() == sorted(range(len(symbols)), key=lambda i: (content[i], i))
            transforms.append(x.bwt)
        for depth in (1, 7, 50):
            order, lcp = suffix_dedup.merge(transforms, depth)
            for stride in (2, 6, 50):
                got, parts = suffix_dedup.merge(transforms, depth, stride)
                assert (got == order).all() and ((parts < depth) == (lcp < depth)).all()
    assert suffix_dedup.stride_of(100, 1 << 20)[0] == 6 and suffix_dedup.stride_of(257, 1 << 30)[0] == 3


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_of_any_type_and_ids_with_several_texts(spark, kind):
    """Rows of one id and different texts are documents of their own; nothing of one is cut from another."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(1, a), (1, b), (2, f"{a} {c}"), (2, b), (2, b), (3, f"{c} {b} tail")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, n long").withColumn("doc_id", F.col("doc_id").cast(kind))
    for module in (substring_dedup, suffix_dedup):
        got = {r["n"]: r["text"].strip() for r in module.dedup(df).collect()}
        assert got[0] == a and got[1] == b and got[2] == c and not got.get(3) and not got.get(4) and got[5] == "tail", got


def test_suffix_dedup_on_odd_inputs(odd, none):
    rows = suffix_dedup.digests(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and got[1]["n_bytes"] == 0 and got[None]["n_removed"] == 0 and got[6]["n_spans"] == 1
    assert suffix_dedup.dedup(odd).columns == odd.columns
    assert suffix_dedup.digests(none).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op3_toxicity(spark, DATA).join(labels, "doc_id").where("held_out")
    # a few labels rest on texts whose insults the data generator overwrote
    acc = got.select(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    recall = got.where("toxic = 1").select(F.avg("predicted")).first()[0]
    assert acc > 0.95 and recall > 0.8
    assert docs.count() == 10000


def test_toxicity_tolerates_gaps_and_inserted_letters(spark):
    r = random.Random(1)
    plain = lambda: " ".join(r.choice(["thorin", "ander", "essing", "ouen", "thation", "heres", "inonst", "erly"]) for _ in range(30))
    bad = ["moron", "worthless", "pathetic"]
    texts = [plain() for _ in range(200)] + [f"{plain()} {r.choice(bad)} {plain()}" for _ in range(200)]
    model = toxicity.train(pa.array(texts), np.array([0] * 200 + [1] * 200))
    probe = [plain(), f"{plain()} mor.on {plain()}", f"{plain()} wor-thless {plain()}", f"{plain()} patthetic {plain()}", ""]
    margin = model.worst(*K.string_buffers(pa.array(probe)))
    assert margin[0] < min(margin[1:4]) and margin[4] < min(margin[1:4])


def test_toxicity_of_a_text_is_its_own():
    """Neighbours, order and batch borders change no score; a small case equals the kernel's sum over all subsequences."""
    rng = np.random.default_rng(3)
    model = toxicity.Kernel()
    model.weights = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    texts = ["hello idi", "moron worthless", "zzzz", "", "a", "é" * 7, "x y " * 9, *("".join(rng.choice(list("abcde .é"), int(n))) for n in rng.integers(1, 90, 60))]
    alone = [model.worst(*K.string_buffers(pa.array([t])))[0] for t in texts]
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(texts))
        assert model.worst(*K.string_buffers(pa.array([texts[i] for i in order]))).tolist() == [alone[i] for i in order]

    def plain(text):
        c = [int(toxicity._CLASS[b]) for b in text.encode()]
        best = model.bias if not c else -np.inf
        for start in range(0, len(c), toxicity.STEP):
            total = 0.0
            for i in range(start, min(start + toxicity.WIDTH, len(c))):
                for p in toxicity.PATTERNS:
                    u = 0
                    for k in (i, *(i + x for x in p)):
                        u = u << 6 | (c[k] if k < len(c) else 0)
                    total += toxicity.LAMBDA ** (p[2] + 1) * float(model.weights[(u * 2654435769 & 0xFFFFFFFF) >> (32 - toxicity.BITS)])
            best = max(best, total / toxicity.NORM + model.bias)
        return best

    assert np.allclose(alone, [plain(t) for t in texts], atol=1e-4)


def test_toxicity_of_long_texts_is_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    model = toxicity.Kernel()
    model.weights = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    texts = ["".join(rng.choice(list("abcde ."), n)) for n in (5, 3000, 0, 801, 40)]
    whole = model.worst(*K.string_buffers(pa.array(texts)))
    monkeypatch.setattr(K, "CHUNK_BYTES", 202)
    assert model.worst(*K.string_buffers(pa.array(texts))).tolist() == whole.tolist()


def test_folded_weights_are_the_kernel_against_the_landmarks():
    """The decision of a passage equals the sum over landmarks of shared weighted subsequences."""
    texts = ["you are a moron", "plain words go", "m.o.r.o.n here", "nothing of it"]
    c = toxicity.Letters(*K.string_buffers(pa.array(texts)))
    text, start = c.starts()
    u, w = toxicity._features(c, start)
    beta = np.random.default_rng(1).normal(size=len(start))
    model = toxicity.Kernel()
    model.bias = 0.0
    np.add.at(model.weights, u, (beta[:, None] * w).astype(np.float32))
    maps = [dict() for _ in start]
    for m, x, y in zip(maps, u, w):
        for a, b in zip(x.tolist(), y.tolist()):
            m[a] = m.get(a, 0.0) + b
    want = [sum(b * sum(v * other.get(k, 0.0) for k, v in mine.items()) for b, other in zip(beta, maps)) for mine in maps]
    assert np.allclose(model.passages(c)[2], want, atol=1e-4)


def test_classifiers_on_odd_inputs(odd, none, spark):
    model = toxicity.train(pa.array(["good words here"] * 3), np.zeros(3, np.int64))
    assert toxicity.score(odd, model).count() == 10 and toxicity.score(none, model).count() == 0
    ordinal = ordinal_quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = ordinal_quality.score(odd, ordinal).collect()
    assert len(rows) == 10 and all(0 <= r["expected_grade"] <= 2 for r in rows)
    assert ordinal_quality.score(none, ordinal).count() == 0


def test_ordinal_scores_against_a_plain_sum():
    """f(text) is the sum of its features' weights over the root of their number; grades' probabilities add up; borders and order do not matter."""
    r = random.Random(41)
    texts = ["", "one", "a b a b a", *(" ".join(r.choice(["red", "green", "tree", "a", "é"]) for _ in range(r.randrange(1, 30))) for _ in range(20))]
    model = ordinal_quality.Ordinal()
    model.weights = np.random.default_rng(2).normal(size=len(model.weights))
    got = model.raw(ordinal_quality.features(*K.string_buffers(pa.array(texts))))

    def number(text):
        w = K.split_words(*K.string_buffers(pa.array([text])))
        h, t = w.hashes().tolist(), K.runs_hash(K._letters(1)[w.data], np.maximum(w.end - 3, w.start), w.end, 1).tolist()
        size, m, out = (w.end - w.start).tolist(), (1 << ordinal_quality.BITS) - 1, []
        mix = lambda x: int(K.mix(np.array([x], np.uint64))[0])
        for i, x in enumerate(h):
            after = h[i + 1] if i + 1 < len(h) else 0
            seen = int(np.log2(h[:i].count(x) + 1))
            out += [x & m, (t[i] & m) + m + 1, (mix(x ^ (after * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & m) + 2 * (m + 1), (mix(seen << 8 | min(size[i], 15)) & m) + 3 * (m + 1)]
        return sum(model.weights[k] for k in out) / max(1, len(out)) ** 0.5

    assert np.allclose(got, [number(t) for t in texts])
    tails = model.tails(got)
    assert (tails[:, :-1] >= tails[:, 1:]).all() and np.allclose(tails[:, 0], 1 / (1 + np.exp(model.thresholds[0] - got)))
    assert got[0] == 0


def test_ordinal_grades_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = ordinal_quality.op10_ordinal_quality(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    good = np.mean([r["kept"] for r in got if r["quality"] == 1])
    poor = np.mean([r["kept"] for r in got if r["quality"] == 0])
    assert good > 0.98 and poor < 0.15
    assert all(r["p_grade_1_up"] >= r["p_grade_2_up"] for r in got)
