"""Operator 9, host-level quality rules.

Every text gets counts and a base verdict; failures of the soft rules are summed
by host (``source``), host rates are shrunk towards an empirical beta prior that
is fitted on all hosts by moments, and the host verdict is joined back.

Defined cases: a null or empty text has no words, all counts 0, and fails the
base rule; a null source is a host of its own; repeated rows count once each;
an empty table gives an empty result. Extra columns pass through; in
``quality_rules`` one that has the name of an added column is replaced, the pipeline
stage hands all of them back as they are.

Scale: host sums are partial before the shuffle (a host of any size sends one
row a task); the texts are never shuffled. The host table is joined as Spark finds it: broadcast
if its measured size is under the session's threshold, else sorted with skewed
hosts split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import derived, fresh, materialise, table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Words of the windows whose repetition counts.
REPEAT_WORDS = 8

BASE = T.StructType([T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])


@dataclass(frozen=True)
class Rules:
    """Thresholds. The base rule is fixed by its users; the others are the method's."""

    min_words: int = 20
    repeat_percent: int = 30
    #: Soft rules: symbols per 100 words, repeated lines per 100 lines, mean word length.
    symbol_percent: int = 50
    dup_line_percent: int = 30
    min_word_chars: int = 2
    max_word_chars: int = 20
    #: A host at this shrunken failure rate loses every document; at the lower one those that fail a soft rule.
    host_condemned: float = 0.6
    host_suspect: float = 0.25


def _equal_to_earlier(key: np.ndarray) -> np.ndarray:
    """Values that occur at least twice."""
    s = np.sort(key)
    return np.unique(s[1:][s[1:] == s[:-1]])


def _own(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Fingerprints that also tell texts apart."""
    return K.mix(hashes ^ (text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def base_counts(column: pa.Array) -> dict[str, pa.Array]:
    """The counts of every text of a batch."""
    data, offsets = K.string_buffers(column)
    out = {x: np.zeros(len(column), np.int64) for x in BASE.fieldNames()}
    for a, b, d, o in K.pieces(data, offsets):
        w = K.split_words(d, o)
        out["n_words"][a:b] = w.counts()
        starts_char = (d & 0xC0) != 0x80
        out["word_chars"][a:b] = K.per_text_sum(starts_char & ~K.SPACE[d], o)
        out["n_symbols"][a:b] = K.per_text_sum(SYMBOLS[d], o)
        newline = np.flatnonzero(d == 0x0A)
        begin = np.concatenate([o[:-1], newline + 1])
        begin.sort()
        finish = np.concatenate([newline, o[1:]])
        finish.sort()
        has_word = np.searchsorted(w.start, begin) < np.searchsorted(w.start, finish)
        begin, finish = begin[has_word], finish[has_word]
        text = np.searchsorted(o, begin, "right") - 1
        lines = np.bincount(text, minlength=b - a)
        key = _own(K.runs_hash(K._letters(0)[d], begin, finish, 0), text)
        _, at = np.unique(key, return_index=True)
        out["n_lines"][a:b] = lines
        out["n_dup_lines"][a:b] = lines - np.bincount(text[at], minlength=b - a)
        if len(w.start) >= REPEAT_WORDS:
            at, h = K.windows(w, w.hashes(), REPEAT_WORDS)
            key = _own(h, w.text[at])
            twice = _equal_to_earlier(key)
            if len(twice):
                hit = K.covered(len(w.start), at[np.isin(key, twice)], REPEAT_WORDS)
                out["n_repeat_words"][a:b] = K.per_text_sum(hit, w.first)
    return {k: pa.array(v) for k, v in out.items()}


def _failures(r: Rules, counts: str = "") -> tuple[F.Column, F.Column]:
    """Base and soft failure by the counts, which are columns or fields of the struct ``counts``."""
    words, chars, symbols, dup_lines, repeats, lines = (F.col(f"{counts}.{x}" if counts else x) for x in BASE.fieldNames())
    base = (words < r.min_words) | (100 * repeats > r.repeat_percent * words)
    soft = (100 * symbols > r.symbol_percent * words) | (100 * dup_lines > r.dup_line_percent * lines) | (chars < r.min_word_chars * words) | (chars > r.max_word_chars * words)
    return base, soft


def host_rates(counted: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """(host, host_docs, host_failures, host_rate): the share of a host's documents that fail any rule, shrunk.

    The beta prior has the mean m of all documents and the strength that matches
    the document-weighted variance v of the host rates: m(1-m)/v - 1, held
    between 1 and 10,000.
    """
    base, soft = _failures(rules)
    by_host = counted.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.when(base | soft, 1).otherwise(0)).alias("host_failures"))
    n, f = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    totals = by_host.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff")).select(
        (F.col("f") / F.col("n")).alias("prior_mean"), (F.col("ff") / F.col("n") - F.pow(F.col("f") / F.col("n"), F.lit(2))).alias("prior_var")
    )
    m, v = F.col("prior_mean"), F.col("prior_var")
    strength = F.when(v <= 1e-12, 10000.0).otherwise(F.least(F.lit(10000.0), F.greatest(F.lit(1.0), m * (1 - m) / v - 1)))
    one = totals.select(m, strength.alias("prior_strength"))  # one row
    return by_host.join(F.broadcast(one), how="inner", on=F.lit(True)).select("host", "host_docs", "host_failures", ((f + m * F.col("prior_strength")) / (n + F.col("prior_strength"))).alias("host_rate"))


def _judged(docs: DataFrame, text: str, host: str, rules: Rules, counts: str | None = None) -> tuple[DataFrame, str, str]:
    """``docs`` with the struct of counts and one of verdicts in columns of fresh names.

    ``counts`` names a struct of counts that ``docs`` has already; without it the
    texts are counted twice (for the hosts and for the rows), so that no text is
    written or shuffled.
    """
    figures = docs
    if counts is None:
        figures, counts_of = derived(docs.select(*dict.fromkeys((text, host))), base_counts, BASE, text)
        docs, counts = derived(docs, base_counts, BASE, text)
    else:
        counts_of = counts
    hosts = host_rates(figures.select(F.col(f"`{host}`").alias("host"), f"{counts_of}.*"), "host", rules)
    key, figure = fresh("__cw_host", docs.columns), fresh("__cw_rate", docs.columns)
    hosts = hosts.select(F.col("host").alias(key), F.struct("host_docs", "host_failures", "host_rate").alias(figure))
    base, soft = _failures(rules, counts)
    joined = docs.join(hosts, F.col(f"`{host}`").eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.col(f"{figure}.host_rate")
    rejected = base | (rate >= rules.host_condemned) | (soft & (rate >= rules.host_suspect))
    verdict = fresh("__cw_verdict", docs.columns)
    made = F.struct(base.alias("base_failed"), soft.alias("soft_failed"), *(F.col(f"{figure}.{x}") for x in ("host_docs", "host_failures", "host_rate")), (~rejected).alias("kept"))
    return joined.withColumn(verdict, made).drop(figure), counts, verdict


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``soft_failed``, the host's figures and ``kept``.

    The counts are written once, without the texts; hosts and rows are judged by them.
    """
    added = [*BASE.fieldNames(), "base_failed", "soft_failed", "host_docs", "host_failures", "host_rate", "kept"]
    own = [x for x in docs.columns if x not in added]
    out, counts, verdict = _judged(docs, text, host, rules)
    return out.select(*(F.col(f"`{x}`") for x in own), f"{counts}.*", f"{verdict}.*")


def verdicts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``quality_rules`` without the texts: every text is counted once, and the few numbers of each row are written."""
    counted, counts = derived(docs.select(*dict.fromkeys((*keys, host, text))), base_counts, BASE, text)
    thin = materialise(counted.select(*dict.fromkeys((*keys, host)), counts))
    out, counts, verdict = _judged(thin, text, host, rules, counts)
    return out.select(*keys, f"{counts}.*", f"{verdict}.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with their own columns as they are."""
    out, _, verdict = _judged(docs, "text", "source", Rules())
    return out.filter(f"{verdict}.kept").select(*(F.col(f"`{x}`") for x in docs.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failures")


SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, list_aggregate(w[i:i+7], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         (100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS soft_failed
  FROM base),
hosts AS (SELECT source, count(*)::BIGINT AS host_docs, sum(CASE WHEN base_failed OR soft_failed THEN 1 ELSE 0 END)::BIGINT AS host_failures FROM judged GROUP BY source),
moments AS (SELECT sum(host_failures) / sum(host_docs)::DOUBLE AS m, sum(host_failures * host_failures / host_docs::DOUBLE) / sum(host_docs) - power(sum(host_failures) / sum(host_docs)::DOUBLE, 2) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v <= 1e-12 THEN 10000.0 ELSE least(10000.0, greatest(1.0, m * (1 - m) / v - 1)) END AS s FROM moments),
rates AS (SELECT source, host_docs, host_failures, (host_failures + m * s) / (host_docs + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR rate >= 0.6 OR (soft_failed AND rate >= 0.25)) AS kept, host_docs, host_failures
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""
