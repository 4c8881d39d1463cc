"""Operator 12, phrase collocation mining by suffix-sigma.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into
words ``[^\\x20\\x09]+``. Every word starts one suffix: up to ``max_n`` words of its
piece. Suffixes are dealt by language and first word, sorted in descending
order, and one stack of open prefixes counts the phrases of every length in one
pass: a phrase is done when the next suffix no longer starts with it. Only then
are the parts of a candidate joined to it by (language, phrase).

Defined cases: a null text has no words, a null language is ``und``, a text without
words adds nothing, repeated rows count again, an empty table gives an empty
result, other columns are not read.

Scale: equal suffixes of a batch are counted before the shuffle. A frequent
first word is dealt over ``SALT`` places by its second word, so counts of one word
are partial and summed afterwards, and those of longer phrases are whole. The
sort is Spark's and spills; a task holds one batch and ``max_n`` open prefixes.
The best phrases of a language are found by bucket first. Arithmetic is decimal
of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import map_batches, small_batches, table, written
from .textkit import LOWER, string_buffers

PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True

MAX_N, LEAST, TOP = 3, 10, 2000
#: Places of one first word in the shuffle; buckets of a language in the ranking.
SALT, BUCKETS = 32, 64
#: Suffixes numbered and counted at once.
RUN = 1 << 18


def _escaped(c: F.Column) -> F.Column:
    """Text without NUL, in the same order: NUL ends words in a key, so that a phrase sorts right before its longer ones."""
    return F.replace(F.replace(c, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))


def _plain(c: F.Column) -> F.Column:
    return F.replace(F.replace(c, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one behind the other, and where each span ends."""
    end = np.cumsum(length)
    at = np.repeat(start - (end - length), length)
    at += np.arange(len(at))
    return data[at], end


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """One integer a row, in the order of the columns of small non-negative numbers."""
    out, size = columns[0].astype(np.int64), int(columns[0].max()) + 1
    for c in columns[1:]:
        more = int(c.max()) + 1
        if size * more >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].reshape(-1)
            size = int(out.max()) + 1
        out, size = out * more + c, size * more
    return out


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number from 1 for each distinct span."""
    flat, ends = _gather(data, start, end - start)
    spans = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat)])
    return spans.dictionary_encode().indices.to_numpy() + 1


def suffixes(max_n: int):
    """Function from a batch of (lang, text) to a batch of (key, n): language and words, each pair parted by NUL, with the count in the batch."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column(0).dictionary_encode()
        data, offsets = string_buffers(batch.column(1))
        names = [x.encode() + b"\0" for x in langs.dictionary.to_pylist()]
        keys, counts = [], []
        if len(data):
            data = LOWER[data]
            ends = PIECE_ENDS[data]
            inside = ~(ends | BLANK[data])
            borders = offsets[(offsets > 0) & (offsets < len(data))]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            first[borders] = inside[borders]
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            last[borders - 1] = inside[borders - 1]
            start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            text = np.searchsorted(offsets, start, "right") - 1
            piece = np.cumsum(ends)[start] if len(start) else start
            lang = langs.indices.to_numpy()[text] if len(start) else text
            # words of one piece follow each other; the last one before each border ends it
            over = np.append((text[1:] != text[:-1]) | (piece[1:] != piece[:-1]), True) if len(start) else np.zeros(0, bool)
            stop = np.flatnonzero(over)
            left = stop[np.searchsorted(stop, np.arange(len(start)))] - np.arange(len(start)) + 1 if len(start) else start
            for a in range(0, len(start), RUN):
                z = min(a + RUN + max_n - 1, len(start))
                own = min(RUN, len(start) - a)
                number = np.append(_numbers(data, start[a:z], end[a:z]), np.zeros(max_n, np.int64))
                size = np.minimum(left[a : a + own], max_n)
                code = _packed([lang[a : a + own], *(np.where(size > d, number[d : d + own], 0) for d in range(max_n))])
                _, at, n = np.unique(code, return_index=True, return_counts=True)
                spans = np.repeat(np.arange(a, a + own)[at], size[at])
                spans += np.arange(len(spans)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
                # words with one NUL between them: the byte behind a word becomes it
                words, ends_at = _gather(np.append(data, np.uint8(0)), start[spans], end[spans] - start[spans] + 1)
                words[ends_at - 1] = 0
                word_end = ends_at[np.cumsum(size[at]) - 1]
                word_start = np.append(0, word_end[:-1])
                lead = np.frombuffer(b"".join(names), np.uint8)
                lead_len = np.array([len(x) for x in names], np.int64)
                lead_at = np.cumsum(lead_len) - lead_len
                which = lang[a : a + own][at]
                s = np.stack([lead_at[which], word_start + len(lead)], 1).reshape(-1)
                w = np.stack([lead_len[which], word_end - 1 - word_start], 1).reshape(-1)
                flat, out_end = _gather(np.concatenate([lead, words]), s, w)
                out = np.append(0, out_end[1::2]).astype(np.int32)
                keys.append(pa.Array.from_buffers(pa.utf8(), len(at), [None, pa.py_buffer(out), pa.py_buffer(flat)]))
                counts.append(n)
        return pa.RecordBatch.from_arrays([pa.chunked_array(keys, pa.utf8()).combine_chunks(), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], names=["key", "n"])

    return fn


def stack(max_n: int, least: int):
    """Function over the sorted batches (key, n) of a task: (key of a phrase, words, n); single words whatever their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, open_counts = b"", np.zeros(max_n, np.int64)  # the last suffix, and the counts of its prefixes so far

        def closed(data, lo, prefix, start, total, words):
            """Phrases that end here: the first ``prefix`` bytes of the rows ``start``."""
            keep = total >= (1 if words == 1 else least)
            flat, ends = _gather(data, lo[start[keep]], prefix[start[keep]])
            key = pa.Array.from_buffers(pa.utf8(), int(keep.sum()), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat)])
            return pa.RecordBatch.from_arrays([key, pa.array(np.full(len(key), words, np.int32)), pa.array(total[keep], pa.int64())], names=["key", "words", "n"])

        def step(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            """Rows of which the first is the stack's top with nothing counted; ``last``: nothing stays open."""
            nonlocal top, open_counts
            rows = len(lo)
            # bytes that a row shares with the row before
            reach = np.minimum(hi[1:] - lo[1:], hi[:-1] - lo[:-1])
            stop = np.cumsum(reach)
            at = np.arange(int(stop[-1]) if rows > 1 else 0) - np.repeat(stop - reach, reach)
            differ = np.flatnonzero(data[np.repeat(lo[1:], reach) + at] != data[np.repeat(lo[:-1], reach) + at])
            found = np.searchsorted(differ, stop - reach)
            hit = np.append(differ, np.iinfo(np.int64).max)[found]
            shared = np.append(0, np.where(hit < stop, hit - (stop - reach), reach))
            # where the prefixes of 1, 2, ... words end
            nul = np.flatnonzero(data == 0)
            before = np.searchsorted(nul, lo)
            parts = np.searchsorted(nul, hi) - before
            counts = np.zeros(max_n, np.int64)
            for d in range(1, max_n + 1):
                has = parts >= d
                bound = np.append(nul, 0)[np.minimum(before + d, len(nul))]
                prefix = np.where(parts > d, bound, hi) - lo
                same = np.zeros(rows, bool)
                same[1:] = has[1:] & has[:-1] & (prefix[1:] == prefix[:-1]) & (shared[1:] >= prefix[1:])
                begin = np.flatnonzero(~same)
                total = np.add.reduceat(n, begin)
                total[0] += open_counts[d - 1]
                if not last:
                    counts[d - 1] = total[-1]
                    begin, total = begin[:-1], total[:-1]
                full = has[begin]
                if full.any():
                    yield closed(data, lo, prefix, begin[full], total[full], d)
            open_counts = counts
            top = bytes(data[lo[-1] : hi[-1]])

        def led(data: np.ndarray, offsets: np.ndarray, n: np.ndarray):
            lead = np.frombuffer(top, np.uint8)
            edge = np.append(0, offsets + len(lead))
            return np.concatenate([lead, data]), edge[:-1], edge[1:], np.append(0, n)

        for batch in batches:
            if batch.num_rows:
                data, offsets = string_buffers(batch.column(0))
                yield from step(*led(data, offsets, batch.column(1).to_numpy()), False)
        if top:
            yield from step(*led(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)), True)

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): counts of all single words, and of phrases of 2 to ``max_n`` words found ``least`` times.

    Words of a phrase are parted by NUL, and escaped.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(_escaped(F.coalesce(F.col(lang).cast("string"), F.lit("und"))).alias("lang"), _escaped(F.col(text)).alias("text"))
    keyed = map_batches(rows, suffixes(max_n), "key string, n long")
    second = F.element_at(F.split(F.concat("key", F.lit("\x00\x00")), "\x00", 4), 3)
    dealt = keyed.repartition(F.substring_index("key", "\x00", 2), F.pmod(F.hash(second), F.lit(SALT))).sortWithinPartitions(F.col("key").desc())
    found = dealt.mapInArrow(stack(max_n, least), "key string, words int, n long")
    split = found.select(F.substring_index("key", "\x00", 1).alias("lang"), F.expr("substring(key, instr(key, '\\u0000') + 1)").alias("phrase"), "words", "n")
    return split.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of a language that no frequent longer one explains."""
    counts = written(phrase_counts(docs, text, lang, max_n, least), "phrases")
    all_words = counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= least)
    candidates = often.where("words > 1").select("lang", "phrase", "words", F.split("phrase", "\x00").alias("w"), F.col("n").alias("a"))
    part = lambda at, size: F.array_join(F.slice("w", at, size), "\x00")
    # phrases inside longer ones
    inner = candidates.where("words > 2").select("lang", "w", "a", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(i, m))))")).alias("s"))
    covers = inner.groupBy("lang", part(F.col("s.i"), F.col("s.m")).alias("phrase")).agg(F.max("a").alias("cover"))
    free = candidates.join(covers, ["lang", "phrase"], "left").where("cover is null or 100 * cover < 50 * a")
    # parts are at least as frequent as the phrase, so they are among the counted ones
    cuts = free.select("lang", "phrase", "w", "words", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    head, tail = (often.select("lang", F.col("phrase").alias(x), F.col("n").alias(y)) for x, y in (("head", "l"), ("tail", "r")))
    big = lambda c: f"cast({c} as decimal(38,0))"
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("score", F.expr(f"(cast(1000000 as decimal(38,0)) * {big('a')} * {big('a')}) div ({big('l')} * {big('r')})"))
    least_cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    plain = least_cut.select("lang", _plain(F.replace("phrase", F.lit("\x00"), F.lit(" "))).alias("phrase"), "a", "c.l", "c.r", "c.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = plain.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = best.join(all_words, "lang")
    return out.select(_plain(F.col("lang")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH base AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\f\r]')) AS p FROM base)
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS n
  FROM places, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
), cand AS (
  SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND n >= 10
), covers AS (
  SELECT lang, phrase, max(a) AS cover FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cand WHERE m = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE m = 3) GROUP BY ALL
), free AS (
  SELECT c.* FROM cand c LEFT JOIN covers v ON c.m = 2 AND c.lang = v.lang AND c.phrase = v.phrase WHERE v.cover IS NULL OR 100 * v.cover < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
  FROM free, (SELECT unnest([1, 2]) AS k) WHERE k < m
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.n AS l, t.n AS r, ((1000000::HUGEINT * c.a * c.a) // (h.n::HUGEINT * t.n))::BIGINT AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head JOIN grams t ON t.lang = c.lang AND t.phrase = c.tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
"""
