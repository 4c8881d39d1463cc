"""Operator 8, benchmark decontamination by a broadcast set of n-grams.

Benchmark texts are normalised (A-Z lower-cased, words of letters and digits)
and cut into windows of ten words; the set of window fingerprints is broadcast
and every document's windows are looked up in it. A hit is verified word by
word. Hits become spans of words to cut, or documents to drop.

The broadcast is bounded: at most ``SET_WINDOWS`` windows are held at once. A
larger benchmark is cut by fingerprint into sets; each is looked up in a pass of
its own that writes its hits alone, and the hits are joined at the end.

Defined cases: a null or empty document has no words and no hits; a benchmark
item without words has no window; one of fewer than ten words is one window;
an item without id hits words but is in no list of items; repeated rows give
repeated results; empty tables on either side give no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import derived, fresh, map_batches, materialise, recounted, rewritten, table
from .touched import split

#: Words of a window; windows in one broadcast set.
WINDOW, SET_WINDOWS = 10, 1 << 18

_GRAMS = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("item", T.StringType())])


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(width, print, words, item): each distinct window of each item; words joined by one blank."""

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        data, offsets = K.string_buffers(batch.column(1))
        rows = []
        for a, _, d, o in K.pieces(data, offsets):
            d = K.LOWER[d]
            w = K.split_words(d, o, K.NOT_ALNUM)
            h = w.hashes()
            full, hf = K.windows(w, h, window)
            short, hs = K.short_texts(w, h, window)
            sizes = w.counts()
            spans = [(i, i + window, x) for i, x in zip(full.tolist(), hf.tolist())] + [(int(w.first[t]), int(w.first[t] + sizes[t]), x) for t, x in zip(short.tolist(), hs.tolist())]
            raw, s, e = d.tobytes(), w.start.tolist(), w.end.tolist()
            rows += [(j - i, x, b" ".join(raw[s[k] : e[k]] for k in range(i, j)), ids[a + int(w.text[i])]) for i, j, x in spans]
        width, prints, words, items = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(width, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(words, pa.binary()), pa.array(items, pa.string())], names=_GRAMS.fieldNames())

    return map_batches(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")), grams, _GRAMS).distinct()


class GramSet:
    """A bounded set of windows, as sorted fingerprints with the words and items behind each."""

    def __init__(self, rows: pa.Table):
        self.prints: dict[int, np.ndarray] = {}
        self.behind: dict[tuple[int, int], dict[bytes, list[str]]] = {}
        for width, x, words, item in zip(*(rows.column(c).to_pylist() for c in _GRAMS.fieldNames())):
            key = (width, x & 0xFFFFFFFFFFFFFFFF)
            items = self.behind.setdefault(key, {}).setdefault(words, [])
            if item is not None:
                items.append(item)
        for width in {k[0] for k in self.behind}:
            self.prints[width] = np.sort(np.array([k[1] for k in self.behind if k[0] == width], np.uint64))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, list[tuple[int, int, list[str]]]]:
        """The words of a run of texts and the verified hits: (first word, width, items)."""
        w = K.split_words(data, offsets, K.NOT_ALNUM)
        h = w.hashes()
        hits, raw = [], None
        for width, prints in self.prints.items():
            at, x = K.windows(w, h, width)
            near = np.searchsorted(prints, x)
            near[near == len(prints)] = 0
            found = np.flatnonzero(prints[near] == x)
            if not len(found):
                continue
            raw = data.tobytes() if raw is None else raw
            for i, key in zip(at[found].tolist(), x[found].tolist()):
                words = b" ".join(raw[a:b] for a, b in zip(w.start[i : i + width].tolist(), w.end[i : i + width].tolist()))
                if (items := self.behind[(width, key)].get(words)) is not None:
                    hits.append((i, width, items))
        return w, hits


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.StringType()))])


def _flat(found: set[int]) -> list[int]:
    """Numbers as [first, how many, ...]."""
    run, out = sorted(found), []
    for k, x in enumerate(run):
        if k and x == run[k - 1] + 1:
            out[-1] += 1
        else:
            out += [x, 1]
    return out


def _borders(w: K.Words, o: np.ndarray, t: int, runs: list[int]) -> list[int]:
    """Runs of words [first, words, ...] of text ``t`` as byte borders [from, to, words, ...]."""
    out, at = [], int(w.first[t])
    for a, n in zip(runs[::2], runs[1::2]):
        out += [int(w.start[at + a] - o[t]), int(w.end[at + a + n - 1] - o[t]), n]
    return out


def _hits(grams: GramSet, column: pa.Array) -> dict[str, pa.Array]:
    """``n_words``, ``hit_spans`` and ``hit_items`` of every text of a batch."""
    data, offsets = K.string_buffers(column)
    words, spans, items = np.zeros(len(column), np.int64), [], []
    for a, b, d, o in K.pieces(data, offsets):
        w, hits = grams.scan(K.LOWER[d], o)
        words[a:b] = w.counts()
        by_text: dict[int, tuple[set[int], set[str]]] = {}
        for i, width, found in hits:
            t = int(w.text[i])
            mine = by_text.setdefault(t, (set(), set()))
            mine[0].update(range(i - int(w.first[t]), i - int(w.first[t]) + width))
            mine[1].update(found)
        for t in range(b - a):
            hit, found = by_text.get(t, ((), ()))
            spans.append(_borders(w, o, t, _flat(hit)))
            items.append(sorted(found))
    return {"n_words": pa.array(words), "hit_spans": pa.array(spans, pa.list_(pa.int64())), "hit_items": pa.array(items, pa.list_(pa.string()))}


def _looked_up(docs: DataFrame, grams: GramSet, text: str) -> tuple[DataFrame, str]:
    shared = docs.sparkSession.sparkContext.broadcast(grams)
    return derived(docs, lambda column: _hits(shared.value, column), _FOUND, text)


def found_in(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text", window: int = WINDOW, set_windows: int = SET_WINDOWS) -> tuple[DataFrame, str]:
    """``docs`` with a struct of ``n_words``, ``hit_spans`` (byte borders [from, to, words, ...] of merged hit words) and ``hit_items``, and that column's name.

    One set: one map. Several sets: each is broadcast alone, its hits (rows of
    the texts that have any, keyed by a digest of the text) are written, and the
    hits of all sets are joined to the few texts that have some.
    """
    grams = benchmark_windows(benchmark, item, bench_text, window)
    sets = -(-max(1, grams.count()) // set_windows)
    if sets == 1:
        return _looked_up(docs, GramSet(grams.toArrow()), text)
    grams = materialise(grams)
    one, column = docs.select(F.col(f"`{text}`").alias("text")), F.col(f"`{text}`")
    hits = None
    for k in range(sets):
        looked, name = _looked_up(one, GramSet(grams.where(F.pmod("print", F.lit(sets)) == k).toArrow()), "text")
        some = looked.where(F.size(f"{name}.hit_spans") > 0).select(F.xxhash64("text").alias("id"), F.md5("text").alias("digest"), f"{name}.hit_spans", f"{name}.hit_items")
        some = materialise(some)  # one set at a time: the next is broadcast when this one's pass is over
        hits = some if hits is None else hits.union(some)
    merged = hits.groupBy("id", "digest").agg(F.flatten(F.collect_set("hit_spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_items")))).alias("hit_items"))
    merged = materialise(merged)
    key, digest, name = (fresh(x, docs.columns) for x in ("__cw_id", "__cw_digest", "__cw_found"))
    merged = merged.select(F.col("id").alias(key), F.col("digest").alias(digest), F.struct("spans", "hit_items").alias(name))
    keyed = docs.withColumn(key, F.xxhash64(column))
    touched, free = split(keyed, key, merged.select(F.col(key).alias("id")))
    joined = touched.withColumn(digest, F.md5(column)).join(merged, [key, digest], "left").select(*(F.col(f"`{x}`") for x in docs.columns), name)
    whole = joined.unionByName(free.drop(key).withColumn(name, F.lit(None).cast(merged.schema[name].dataType)))

    def counted(texts: pa.Array, known: pa.Array) -> dict[str, pa.Array]:
        data, offsets = K.string_buffers(texts)
        n, spans, rows = [], [], known.to_pylist()
        for a, b, d, o in K.pieces(data, offsets):
            w = K.split_words(d, o, K.NOT_ALNUM)
            n += w.counts().tolist()
            for t, x in enumerate(rows[a:b]):
                hit: set[int] = set()
                for begin, size in zip(x["spans"][::3], x["spans"][2::3]) if x else ():
                    first = int(np.searchsorted(w.start, begin + o[t]) - w.first[t])
                    hit.update(range(first, first + size))
                spans.append(_borders(w, o, t, _flat(hit)))
        return {"n_words": pa.array(n, pa.int64()), "hit_spans": pa.array(spans, pa.list_(pa.int64())), "hit_items": pa.array([x["hit_items"] if x else [] for x in rows], pa.list_(pa.string()))}

    out, made = derived(whole, counted, _FOUND, text, name)
    return out.drop(name), made


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (byte borders [from, to, words, ...] of merged hit words) and ``hit_items``; input columns of these names are replaced."""
    found, name = found_in(docs, benchmark, text, **how)
    return found.select(*(F.col(f"`{x}`") for x in docs.columns if x not in _FOUND.fieldNames()), f"{name}.*")


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without their hit words and the blanks behind those."""
    spans = spans.to_pylist()
    if not any(spans):
        return texts
    out = texts.to_pylist()
    for i, s in enumerate(spans):
        if s:
            raw, kept, pos = out[i].encode(), [], 0
            for a, b in zip(s[::3], s[1::3]):
                kept.append(raw[pos:a])
                pos = b
                while pos < len(raw) and K.SPACE[raw[pos]]:
                    pos += 1
            out[i] = (b"".join(kept) + raw[pos:]).decode()
    return pa.array(out, texts.type)


def _n_hit(spans: str) -> F.Column:
    """How many words the spans cover."""
    return F.aggregate(F.filter(spans, lambda _, i: i % 3 == 2), F.lit(0).cast("long"), lambda a, b: a + b)


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: str = "spans", text: str = "text", empty: bool = True) -> DataFrame:
    """``docs`` without benchmark passages: ``how`` is spans (cut them) or documents (drop the texts that hold one).

    With ``empty`` false a document of which no word is left goes too. All columns
    but the text come back as they are.
    """
    found, name = found_in(docs, benchmark, text)
    if how != "spans":
        return found.filter(F.size(f"{name}.hit_spans") == 0).drop(name)
    hit = _n_hit(f"{name}.hit_spans")
    left = found if empty else found.filter((hit == 0) | (hit < F.col(f"{name}.n_words")))
    spans = fresh("__cw_spans", left.columns)
    return rewritten(left.withColumn(spans, F.col(f"{name}.hit_spans")), text, _without, spans).drop(name, spans)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with benchmark passages cut out; one with nothing else left goes."""
    return recounted(decontaminate(docs, table(spark, sf_dir, "benchmark"), empty=False))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", _n_hit("hit_spans").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i+9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT k FROM grams),
wins AS (
  SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, widths WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, wins.k, item_id FROM wins JOIN grams USING (k, g)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
