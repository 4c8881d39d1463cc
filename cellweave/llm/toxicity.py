"""Operator 3, toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two short passages counts the character subsequences of four
letters that they share, each weighted by LAMBDA to the length it spans, up to
a span of ``SPAN``: an insult still shares most of its subsequences when letters
are dropped, gaps opened or characters put in between. Passages are windows of
``WIDTH`` bytes, four bytes apart; a text scores as its worst passage.

Labels mark whole texts, so training is by multiple instances: of every toxic
text the passages that score highest are its positive examples, clean texts
give random and then their highest-scoring passages. ``LANDMARKS`` of these
passages span the Nystroem feature space K_mm^(-1/2) k(., landmarks), where a
linear SVM is trained. Since k(s, t) is a sum over subsequences, the decision
function sum_m beta_m k(s, t_m) folds into one weight a subsequence, which is
what is broadcast (2**20 numbers; subsequences are hashed) and summed along each text.

Learning takes a bounded sample of labelled rows (``PER_CLASS`` a class, whole
texts of up to ``MAX_CHARS``), never the held-out third; ids, languages and
sources are not inputs. Scoring is one map over all whole texts, no shuffle.

A score is a function of the text alone: texts are laid out apart, sums run in
a fixed order, and a text longer than a part is scored in overlapping parts.

Defined cases: null and empty texts score as the empty passage (near 0);
repeated rows score alike, whatever stands beside them; without rows of both labels every text scores 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import add_columns, table
from .labelled import held_out, sample

PER_CLASS, MAX_CHARS = 1500, 20000
WIDTH, STEP, LAMBDA, SPAN, BITS = 16, 4, 0.7, 7, 20
#: Places of the later letters behind the first: all subsequences of four that span at most SPAN.
PATTERNS = tuple(sorted(combinations(range(1, SPAN), 3), key=lambda x: (x[-1], x)))
LANDMARKS, ROUNDS, PENALTY = 320, 4, 1e-4
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = int(K.LOWER[_b])
    if ord("a") <= _c <= ord("z"):
        _CLASS[_b] = 1 + _c - ord("a")
    elif ord("0") <= _c <= ord("9"):
        _CLASS[_b] = 27
    elif K.SPACE[_b] or _c == 0:
        _CLASS[_b] = 0
    elif _c < 0x80:
        _CLASS[_b] = 28
    elif _c >= 0xC0:
        _CLASS[_b] = 29 + (_c & 1)
    else:  # bytes that follow in a character, apart for accented letters
        _CLASS[_b] = 31 + (_c & 31)


class Letters:
    """Letter classes 0..62 of a run of texts, each text alone.

    Every text is laid out from a multiple of STEP and followed by blanks enough
    that no subsequence or passage that starts in it reaches the next one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        room = -(-size // STEP) * STEP + WIDTH + SPAN + (-(WIDTH + SPAN)) % STEP
        self.first = np.cumsum(room) - room
        self.size = size
        place = np.arange(len(data)) + np.repeat(self.first - offsets[:-1], size)
        self.classes = np.zeros(int(room.sum()) + SPAN - 1, np.uint8)
        self.classes[place] = _CLASS[data]
        self.inside = np.zeros(int(room.sum()), bool)
        self.inside[place] = True

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of every passage: each STEP bytes, one at least for a text with bytes."""
        count = -(-self.size // STEP)
        text = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        return text, self.first[text] + within * STEP


def subsequences(c: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For each pattern its weight and the (hashed) subsequence that starts at each place."""
    n = len(c) - SPAN + 1
    c = c.astype(np.uint32)
    first = c[:n] << np.uint32(18)
    for p in PATTERNS:
        u = first | (c[p[0] : p[0] + n] << np.uint32(12))
        u |= c[p[1] : p[1] + n] << np.uint32(6)
        u |= c[p[2] : p[2] + n]
        u *= np.uint32(2654435769)
        u >>= np.uint32(32 - BITS)
        yield LAMBDA ** (p[2] + 1), u


#: Of a passage: the square root of the summed squares if no subsequence came twice; the same for every passage.
NORM = float(np.sqrt(WIDTH * sum(LAMBDA ** (2 * (p[2] + 1)) for p in PATTERNS)))


class Kernel:
    """Folded weights, and the map from a margin to a probability."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << BITS, np.float32)
        self.slope, self.shift, self.bias = 1.0, -20.0, 0.0

    def passages(self, c: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, margin) of every passage: sums of its own places in a fixed order, so neighbours do not matter."""
        text, start = c.starts()
        each = np.zeros(len(c.inside), np.float32)
        for w, u in subsequences(c.classes):
            each += np.float32(w) * self.weights[u]
        each[~c.inside] = 0
        parts = each.reshape(-1, STEP).sum(1, dtype=np.float64)
        at = start // STEP
        return text, start, sum(parts[at + k] for k in range(WIDTH // STEP)) / NORM + self.bias

    def all_passages(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``passages`` of texts laid out together, piece by piece: temporaries stay small."""
        found, base = [], 0
        for a, _, d, o in K.pieces(data, offsets):
            c = Letters(d, o)
            t, s, m = self.passages(c)
            found.append((t.astype(np.int32) + a, (s + base).astype(np.int32), m.astype(np.float32)))
            base += len(c.inside)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest margin of each text; the bias for one without bytes. Long texts go in overlapping parts."""
        out = np.full(len(offsets) - 1, -np.inf)
        for text, d, o, own in K.parts(data, offsets, K.CHUNK_BYTES // 2, STEP, WIDTH + SPAN):
            t, start, margin = self.passages(Letters(d, o))
            if len(text) == 1:
                t, margin = t[start < own], margin[start < own]
            if len(t):
                first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                at = text[t[first]]
                out[at] = np.maximum(out[at], np.maximum.reduceat(margin, first))
        out[np.diff(offsets) == 0] = self.bias
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(self.slope * margin + self.shift), -40, 40)))


def _features(c: Letters, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequences, weights) of passages, one row each; what starts past its text's end has weight 0."""
    places = start[:, None] + np.arange(WIDTH + SPAN - 1)[None, :]
    around = c.classes[places]
    inside = c.inside[places[:, :WIDTH]]
    rows, width = around.shape
    cols = [(u.reshape(-1), w) for w, u in subsequences(around.reshape(-1))]  # the last places of a row reach into the next and are cut off
    found = [(np.append(u, np.zeros(rows * width - len(u), u.dtype)).reshape(rows, width)[:, :WIDTH], w) for u, w in cols]
    return np.concatenate([u for u, _ in found], 1), np.concatenate([np.where(inside, w, 0.0) for _, w in found], 1).astype(np.float32) / NORM


def _top(text: np.ndarray, margin: np.ndarray, chosen: np.ndarray, per_text: int) -> np.ndarray:
    """Numbers of the ``per_text`` highest passages of each chosen text, no two overlapping."""
    rows = np.flatnonzero(chosen[text])
    if not len(rows):
        return rows
    t, m = text[rows], margin[rows].copy()
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    sizes = np.diff(np.append(first, len(t)))
    out = []
    for _ in range(per_text):
        at = np.flatnonzero((m == np.repeat(np.maximum.reduceat(m, first), sizes)) & (m > -np.inf))
        at = at[np.unique(t[at], return_index=True)[1]]
        out.append(at)
        for k in range(1 - WIDTH // STEP, WIDTH // STEP):
            near = np.clip(at + k, 0, len(t) - 1)
            m[near[t[near] == t[at]]] = -np.inf
    return rows[np.sort(np.concatenate(out))]


def train(texts: pa.Array, toxic: np.ndarray) -> Kernel:
    model = Kernel()
    if len(np.unique(toxic)) < 2:
        return model
    rng = np.random.default_rng(20011)
    data, offsets = K.string_buffers(texts)
    c = Letters(data, offsets)
    bad = toxic == 1
    # a first ranking: how much more often a subsequence is in toxic texts than in clean ones
    seen = np.zeros((2, 1 << BITS), np.int64)
    for a, _, d, o in K.pieces(data, offsets):
        mine = Letters(d, o)
        owner = np.repeat(np.arange(len(o) - 1, dtype=np.int64), np.diff(o)) << BITS
        for _, u in islice(subsequences(mine.classes), 3):
            pairs = np.unique(owner | u[mine.inside])
            for k in (0, 1):
                seen[k] += np.bincount(pairs[toxic[a + (pairs >> BITS)] == k] & ((1 << BITS) - 1), minlength=1 << BITS)
    rate = (seen + 0.5) / (3 * np.array([[np.sum(~bad)], [np.sum(bad)]]) + 1)
    odds = np.log(rate[1] / rate[0])
    odds[seen.sum(0) < 8] = 0
    model.weights = np.clip(odds, -2, 2).astype(np.float32)
    positives: np.ndarray = np.zeros(0, np.int64)
    negatives: np.ndarray = np.zeros(0, np.int64)
    for step in range(ROUNDS):
        text, start, margin = model.all_passages(data, offsets)
        good = np.flatnonzero(bad[text])
        if not len(good):
            return model
        positives = _top(text, margin, bad, 1 if step == 0 else 2)
        if step:
            # a second passage counts if the model takes it for toxic; a text without any such passage
            # (its label rests on something else) counts no more once the model has settled
            best = np.full(len(toxic), -np.inf)
            np.maximum.at(best, text[positives], margin[positives])
            lead = margin[positives] == best[text[positives]]
            positives = positives[(margin[positives] >= 0.5) | (lead & (margin[positives] >= (-np.inf if step == 1 else -0.25)))]
            if not len(positives):
                break
        clean = np.flatnonzero(~bad[text])
        fresh = np.concatenate([_top(text, margin, ~bad, 2), rng.choice(clean, min(2000, len(clean)), replace=False)])
        negatives = np.unique(np.concatenate([negatives, fresh]))
        marks = np.concatenate([rng.choice(positives, min(LANDMARKS * 3 // 4, len(positives)), replace=False), rng.choice(negatives, min(LANDMARKS // 4, len(negatives)), replace=False)])
        lu, lw = _features(c, start[marks])
        used, slot = np.unique(lu, return_inverse=True)
        slot = slot.reshape(lu.shape)
        table_ = np.zeros((len(used) + 1, len(marks)), np.float32)
        np.add.at(table_, (slot, np.arange(len(marks))[:, None]), lw)

        def against(rows: np.ndarray) -> np.ndarray:
            """Kernel values of passages against the landmarks."""
            out = np.empty((len(rows), table_.shape[1]), np.float32)  # noqa: B023
            for a in range(0, len(rows), 256):
                u, w = _features(c, start[rows[a : a + 256]])  # noqa: B023
                at = np.searchsorted(used, u)  # noqa: B023
                at[(at == len(used)) | (used[np.minimum(at, len(used) - 1)] != u)] = len(used)  # noqa: B023
                out[a : a + 256] = np.einsum("nkm,nk->nm", table_[at], w, optimize=True)  # noqa: B023
            return out

        value, vector = np.linalg.eigh(against(marks).astype(np.float64))
        keep = value > 1e-6 * value[-1]
        root = vector[:, keep] / np.sqrt(value[keep])
        z = np.concatenate([against(positives), against(negatives)]) @ root
        y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
        weight = np.where(y > 0, 0.5 / len(positives), 0.5 / len(negatives))
        v = np.zeros(z.shape[1] + 1)
        z1 = np.concatenate([z, np.ones((len(z), 1))], 1)
        ridge = np.append(np.full(z.shape[1], PENALTY), 1e-9)
        active = np.ones(len(y), bool)
        for _ in range(30):  # squared hinge, Newton steps over the rows inside the margin
            part = z1[active] * weight[active, None]
            v = np.linalg.solve(part.T @ z1[active] + np.diag(ridge), part.T @ y[active])
            now = y * (z1 @ v) < 1
            if (now == active).all():
                break
            active = now
        v, bias = v[:-1], float(v[-1])
        folded = table_[:-1].astype(np.float64) @ (root @ v)
        model.weights = np.zeros(1 << BITS, np.float32)
        model.weights[used] = folded
        model.bias = bias
    margin = model.worst(data, offsets)
    # Platt's map on the texts' worst passages, with his smoothed targets
    hits, misses = bad.sum(), (~bad).sum()
    target = np.where(bad, (hits + 1) / (hits + 2), 1 / (misses + 2))
    weight = np.where(bad, 0.25 / hits, 0.75 / misses)
    a, b = 4.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, h = weight * (target - p), np.maximum(weight * p * (1 - p), 1e-12)
        hess = np.array([[np.sum(h * margin * margin) + 1e-4, np.sum(h * margin)], [np.sum(h * margin), np.sum(h) + 1e-4]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, [np.sum(d * margin) - 1e-4 * a, np.sum(d)])
    model.slope, model.shift = float(a), float(b)
    return model


_SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Kernel:
    rows = sample(docs, labels, F.when(F.col("toxic").isin(0, 1), F.col("toxic")), range(2), PER_CLASS, MAX_CHARS, doc_id, text).toArrow()
    return train(rows.column("text").combine_chunks(), rows.column("grade").to_numpy())


def score(docs: DataFrame, model: Kernel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(column: pa.Array) -> dict[str, pa.Array]:
        return {"score": pa.array(shared.value.probability(shared.value.worst(*K.string_buffers(column))))}

    return add_columns(docs, text, scores, _SCORE)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
