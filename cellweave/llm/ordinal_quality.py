"""Operator 10, quality by ordinal cumulative-link regression.

P(grade <= k) = logistic(threshold_k - f(text)) with one weight vector f over
hashed words, word endings, pairs of words and repetitions, and strictly ordered thresholds. Grades come from
the labels: 0 poor, 1 good but toxic, 2 good and clean. The expected grade and
the probability of at least a given grade select documents.

Learning takes a bounded sample of labelled rows (``PER_GRADE`` a grade, whole
texts of up to ``MAX_CHARS``), never the held-out third; scoring covers every
whole text in one map without a shuffle; the broadcast model has a fixed size.

Defined cases: a null or empty text has f = 0 and so the thresholds' own
probabilities; repeated rows score alike; without labelled rows every text has
the same score; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import add_columns, table
from .labelled import held_out, sample

GRADES = 3
PER_GRADE, MAX_CHARS, BITS, ENDING = 1500, 20000, 16, 3
#: Kinds of features, each with weights of its own.
KINDS = 4
EPOCHS, RATE, DECAY = 150, 0.5, 1e-4


def earlier(keys: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1]) if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - (np.flatnonzero(new)[np.cumsum(new) - 1] if len(keys) else 0)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, border of each text's, weight of each text's): for every word its hash, that of its last bytes, of it and the next word, and of its length with how often (in powers of two) it came before in the text."""
    w = K.split_words(data, offsets)
    words, size = w.hashes(), w.end - w.start
    tail = K.runs_hash(K._letters(1)[data], np.maximum(w.end - ENDING, w.start), w.end, 1)
    after = np.zeros(len(words), np.uint64)
    after[:-1] = np.where(w.text[1:] == w.text[:-1], words[1:], 0)
    pair = K.mix(words ^ (after * np.uint64(0x9E3779B97F4A7C15)))
    before = earlier(K.mix(words ^ (w.text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))))
    again = K.mix((np.log2(before + 1).astype(np.uint64) << np.uint64(8)) | np.minimum(size, 15).astype(np.uint64))
    m = np.uint64((1 << BITS) - 1)
    kinds = [(x & m) + np.uint64(k << BITS) for k, x in enumerate((words, tail, pair, again))]
    border = KINDS * w.first
    return np.stack(kinds, 1).reshape(-1).astype(np.int64), border, 1.0 / np.sqrt(np.maximum(np.diff(border), 1))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self) -> None:
        self.weights = np.zeros(KINDS << BITS)
        self.thresholds = np.linspace(-1.0, 1.0, GRADES - 1)

    def raw(self, f: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        at, border, scale = f
        total = np.concatenate([[0.0], np.cumsum(self.weights[at])])
        return (total[border[1:]] - total[border[:-1]]) * scale

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def fit(self, texts: pa.Array, grade: np.ndarray) -> "Ordinal":
        """Full-batch adaptive gradient ascent on the balanced log-likelihood."""
        if not len(grade):
            return self
        # some texts at a time, so that a pass over the sample holds small temporaries only
        parts = [(a, b, *features(d, o)) for a, b, d, o in K.pieces(*K.string_buffers(texts))]
        parts = [(a, b, at.astype(np.int32), border, scale) for a, b, at, border, scale in parts]
        n_of = np.bincount(grade, minlength=GRADES)
        weight = (len(grade) / (np.count_nonzero(n_of) * np.maximum(n_of, 1)))[grade]
        gaps = np.log(np.diff(self.thresholds))
        low, square = self.thresholds[0], np.full(len(self.weights), 1e-8)
        square_t = np.full(GRADES - 1, 1e-8)
        for _ in range(EPOCHS):
            self.thresholds = np.concatenate([[low], low + np.cumsum(np.exp(gaps))])
            score = np.concatenate([self.raw(x[2:]) for x in parts])
            above = np.concatenate([np.ones((len(grade), 1)), self.tails(score), np.zeros((len(grade), 1))], 1)
            upper, lower = above[np.arange(len(grade)), grade], above[np.arange(len(grade)), grade + 1]
            slope_u, slope_l = upper * (1 - upper), lower * (1 - lower)
            p = np.maximum(upper - lower, 1e-9)
            d_score = weight * (slope_u - slope_l) / p / len(grade)
            grad = -DECAY * self.weights
            for a, b, at, border, scale in parts:
                grad += np.bincount(at, np.repeat(d_score[a:b] * scale, np.diff(border)), len(self.weights))
            square += grad * grad
            self.weights += RATE * grad / np.sqrt(square)
            d_t = np.zeros(GRADES - 1)
            for k in range(GRADES - 1):  # threshold k is the lower border of grade k + 1 and the upper one of grade k
                d_t[k] = np.sum((weight / p / len(grade)) * (np.where(grade == k, slope_l, 0) - np.where(grade == k + 1, slope_u, 0)))
            step = np.concatenate([[d_t.sum()], np.cumsum(d_t[::-1])[::-1][1:] * np.exp(gaps)])
            square_t += step * step
            step = RATE * step / np.sqrt(square_t)
            low, gaps = low + step[0], np.clip(gaps + step[1:], -6, 3)
        self.thresholds = np.concatenate([[low], low + np.cumsum(np.exp(gaps))])
        return self


_SCORES = T.StructType([T.StructField("expected_grade", T.DoubleType()), *(T.StructField(f"p_grade_{k}_up", T.DoubleType()) for k in range(1, GRADES))])


def grade_of(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    """0 poor, 1 good but toxic, 2 good; null where quality is not known."""
    return F.when(F.col(quality) == 0, 0).when((F.col(quality) == 1) & (F.coalesce(F.col(toxic), F.lit(0)) == 1), 1).when(F.col(quality) == 1, 2)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Ordinal:
    rows = sample(docs, labels, grade_of(), range(GRADES), PER_GRADE, MAX_CHARS, doc_id, text).toArrow()
    return Ordinal().fit(rows.column("text").combine_chunks(), rows.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and the tail probabilities; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(column: pa.Array) -> dict[str, pa.Array]:
        data, offsets = K.string_buffers(column)
        tails = np.zeros((len(column), GRADES - 1))
        for a, b, d, o in K.pieces(data, offsets):
            tails[a:b] = shared.value.tails(shared.value.raw(features(d, o)))
        if not len(data):
            tails[:] = shared.value.tails(np.zeros(len(column)))
        return {"expected_grade": pa.array(tails.sum(1))} | {f"p_grade_{k + 1}_up": pa.array(tails[:, k]) for k in range(GRADES - 1)}

    return add_columns(docs, text, scores, _SCORES)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), *_SCORES.fieldNames(), (F.col("p_grade_1_up") >= 0.5).alias("kept"))
