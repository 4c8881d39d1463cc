"""Operator 6, repeated passages of words by recompression.

Rounds of recompression name runs (x x x) and pairs (x y) of tokens. A name is a
mix of the names that it stands for, so every task gives equal content the same name with
no dictionary to agree on. A token is of the left or the right class by its
name, and a left one directly before a right one is a pair; so what becomes of
a token depends on its neighbours only, and equal substrings get the same
symbols but near their ends. With every symbol go the words that it covers and the borders
of the words that its naming depends on.

A window of twenty words is assigned to one symbol of the highest round that
depends on words of the window alone (the least in an order of the names, the
first of equals), hence equal windows to the same symbol at the same place.

* Naming round: Spark counts the names to which windows are assigned over all
  documents. A window whose symbol occurs once is unique; the names that occur
  more often come back as a filter of bounded size (an error of it costs time only).
* Meeting round: windows of shared symbols travel to the symbol's bucket with
  their words. There two windows match if they agree in the symbol, in its place
  and in the words on either side of it; the symbol stands for the words that it covers.
  Every match is verified word by word on the text itself, and windows
  that a name put together wrongly are told apart by their words.

The earliest occurrence (doc_id, start) of a window stays; words covered by a
later one are removed. Windows are judged on the input.

Defined cases: null and empty texts, and texts under twenty words, have no
windows; a document without id keeps its words and removes none of others';
rows that repeat doc_id and text count as one document, rows that
share a doc_id but not the text as documents of their own, in the order of a
digest of the text; ids may be of any type that has an order; empty tables give
empty results.

Scale: equal windows of one batch meet there, so a passage in a third of all
documents sends one copy a batch. The number of buckets follows from the bytes of the
texts. Names that come more often than once in 1/HOT bytes of text (so a bounded
number of them) are chosen last, and windows that have no other are dealt by
their whole content. Texts without removals are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import derived, map_batches, materialise, recounted, rewritten, slices, small_batches, table
from .touched import keyed, with_runs

WINDOW, ROUNDS = 20, 3
#: Bytes of text packed at once, and looked at together.
PART, CHUNK = 2 << 20, 1 << 18
#: Bytes of text for each bucket of windows, and of names; names that a task holds before it sends them.
BUCKET_BYTES, NAMING_BYTES, NAMES_HELD = 2 << 20, 16 << 20, 1 << 19
#: A name is hot if it comes more often than once in so many bytes of text, and the least count of one.
HOT, LEAST_HOT = 1 / 100_000, 64
#: Size of the filter of shared names: two to these powers bits, half a bit a byte of text in between (4 MB at most).
FILTER_BITS = (16, 25)

_FAR = np.int64(1) << 40
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_HALF = np.uint64(1) << np.uint64(63)
_ZSTD = pa.Codec("zstd", compression_level=3)


def _name(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    return K.mix(x * np.uint64(0x9E3779B97F4A7C15) + K.mix(y ^ np.uint64(salt)))


class Symbols:
    """Symbols of one round, in order: name, text, words covered (begin, end), borders of the words depended on (low, high)."""

    def __init__(self, name: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.text, self.begin, self.end, self.low, self.high = name, text, begin, end, low, high

    def widened(self) -> tuple[np.ndarray, np.ndarray]:
        """Borders that take in both neighbours; past a text's end nothing is known."""
        low, high = np.full(len(self.name), -_FAR), np.full(len(self.name), _FAR)
        same = self.text[1:] == self.text[:-1]
        low[1:][same] = self.low[:-1][same]
        high[:-1][same] = self.high[1:][same]
        return low, high

    def runs(self, salt: int) -> "Symbols":
        """Each maximal run of one name becomes a symbol."""
        n = len(self.name)
        low, high = self.widened()
        first = np.ones(n, bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        at = np.flatnonzero(first)
        last = np.append(at[1:], n) - 1
        length = last - at + 1
        name = np.where(length > 1, _name(self.name[at], length.astype(np.uint64), salt), self.name[at])
        return Symbols(name, self.text[at], self.begin[at], self.end[last], low[at], high[last])

    def pairs(self, salt: int) -> "Symbols":
        """Each left-class symbol directly before a right-class one is joined with it."""
        n = len(self.name)
        right = (K.mix(self.name ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
        starts = np.zeros(n, bool)
        starts[:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        second = np.zeros(n, bool)
        second[1:] = starts[:-1]
        low, high = self.widened()
        # a pair stands whatever is beside it; one left single depends on the neighbour it did not join
        low = np.where(starts | ~right, self.low, low)
        high = np.where(second | right, self.high, high)
        at = np.flatnonzero(~second)
        end = at + starts[at]
        name = np.where(starts[at], _name(self.name[at], self.name[end], salt), self.name[at])
        return Symbols(name, self.text[at], self.begin[at], self.end[end], low[at], high[end])


def rounds(words: K.Words, hashes: np.ndarray) -> list[Symbols]:
    """Symbols of round 0 (the words) to ROUNDS."""
    at = np.arange(len(hashes), dtype=np.int64)
    out = [Symbols(hashes, words.text, at, at + 1, at, at + 1)]
    for r in range(ROUNDS):
        out.append(out[-1].runs(977 * r + 1).pairs(977 * r + 2))
    return out


def _least(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the first least of rank[a:b] for each non-empty range, by doubling."""
    out = np.empty(len(a), np.int64)
    level = np.log2(b - a).astype(np.int64)
    row = np.arange(len(rank))
    for k in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level == k)
        x, y = row[a[here]], row[b[here] - (1 << k)]
        out[here] = np.where(rank[y] < rank[x], y, x)
        step = 1 << k
        if len(row) > step:
            x, y = row[:-step], row[step:]
            row = np.where(rank[y] < rank[x], y, x)
    return out


def anchors(words: K.Words, hashes: np.ndarray, at: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, end) of the symbol that each window (first word) is assigned to; ``hot`` names (sorted) come last."""
    name, begin, end = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    spare = np.zeros(len(at), bool)  # has a hot one only, so far
    todo = np.ones(len(at), bool)
    for r, s in reversed(list(enumerate(rounds(words, hashes)))) if len(at) else ():
        known = K.mix(s.name ^ np.uint64(0x5851F42D4C957F2D + r))
        rank = known >> np.uint64(1)
        if hot is not None and len(hot):
            near = np.minimum(np.searchsorted(hot, known), len(hot) - 1)
            rank = np.where(hot[near] == known, rank | _HALF, rank)
        # a symbol's borders grow along the text; one that depends on a text's end is no window's
        low = np.maximum.accumulate(np.where(s.low < 0, 0, s.low))
        high = np.minimum.accumulate(s.high[::-1])[::-1]
        rank = np.where((s.low < 0) | (s.high >= _FAR), _LAST, rank)
        i = np.flatnonzero(todo)
        a = np.searchsorted(low, at[i], "left")
        b = np.searchsorted(high, at[i] + WINDOW, "right")
        i, a, b = i[b > a], a[b > a], b[b > a]
        if not len(i):
            continue
        got = _least(rank, a, b)
        fit = (rank[got] != _LAST) & ((rank[got] < _HALF) | ~spare[i])
        i, got = i[fit], got[fit]
        name[i], begin[i], end[i] = known[got], s.begin[got], s.end[got]
        spare[i] = rank[got] >= _HALF
        todo[i[~spare[i]]] = False
    return name, begin, end


class Windows:
    """All windows of a run of texts: row, first word, assigned symbol and its words; and the words joined by one blank.

    Windows whose symbol is ``hot`` are assigned to their next one, if they have one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None = None, words: bool = True):
        w = K.split_words(data, offsets)
        h = w.hashes()
        n = len(h)
        at = np.flatnonzero(w.text[: n - WINDOW + 1] == w.text[WINDOW - 1 :]) if n >= WINDOW else np.zeros(0, np.int64)
        self.at, self.row, self.hashes = at, w.text[at], h
        self.pos = at - w.first[self.row]
        self.name, self.begin, self.end = anchors(w, h, at)
        self.first = self.name  # the choice without regard to hot names
        if hot is not None and len(hot) and (crowded := np.flatnonzero(np.isin(self.name, hot))).size:
            self.name = self.name.copy()
            self.name[crowded], self.begin[crowded], self.end[crowded] = anchors(w, h, at[crowded], hot)
        if not words:
            return
        size = w.end - w.start
        self.start = np.zeros(n + 1, np.int64)
        np.cumsum(size + 1, out=self.start[1:])
        self.raw = np.full(int(self.start[-1]), 0x20, np.uint8)
        inside = np.ones(len(self.raw), bool)
        inside[self.start[1:] - 1] = False
        self.raw[inside] = data[np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def keys(name: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What a window is known by: its symbol, the symbol's place, and the words before and behind it (numbers of words)."""
    before, behind = K.runs_hash(hashes, at, begin, 0), K.runs_hash(hashes, end, at + WINDOW, 1)
    return K.mix(name ^ K.mix(before ^ K.mix(behind + ((begin - at) * 64 + (end - begin)).astype(np.uint64))))


def _bytes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def later_ones(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, at: np.ndarray, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal one of smaller (doc, pos).

    ``key`` puts windows together; ``at`` is a window's first word, ``raw`` and
    ``start`` the words joined by one blank. Every match is verified on ``raw``.
    """
    out = np.zeros(len(key), bool)
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return out
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    rows = np.flatnonzero(twice[near] == key)
    order = rows[np.lexsort((pos[rows], doc[rows], key[rows]))]
    new = np.append(True, key[order][1:] != key[order][:-1])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = _verified(order, lead, at, raw, start)
    wrong = np.isin(key[order], key[order][~same])
    good = ~wrong & ((doc[order] != doc[lead]) | (pos[order] != pos[lead]))
    out[order[good]] = True
    first: dict[tuple[int, bytes], tuple[int, int]] = {}
    for i in order[wrong].tolist():  # a key that stands for several contents: by the words, in the order of (doc, pos)
        words = (int(key[i]), raw[start[at[i]] : start[at[i] + WINDOW]].tobytes())
        mine = (int(doc[i]), int(pos[i]))
        out[i] = first.setdefault(words, mine) != mine
    return out


def _verified(one: np.ndarray, two: np.ndarray, at: np.ndarray, raw: np.ndarray, start: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """Whether the windows ``one`` and ``two`` have the same words; matches in a row are compared once."""
    same = np.ones(len(one), bool)
    rows = np.flatnonzero(one != two)
    rows = rows[np.argsort(at[one[rows]], kind="stable")]
    a, b = at[one[rows]], at[two[rows]]
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1))) if len(rows) else np.zeros(0, np.int64)
    length = np.diff(np.append(cut, len(rows)))
    fits = np.zeros(len(cut), bool)
    size = start[a[cut] + length + WINDOW - 1] - start[a[cut]]
    other = start[b[cut] + length + WINDOW - 1] - start[b[cut]]
    equal = np.flatnonzero(size == other)
    part = (np.cumsum(size[equal]) - 1) // chunk
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(equal) else np.zeros(0, np.int64)
    for x, y in zip(edge.tolist(), np.append(edge[1:], len(equal)).tolist()):
        e = equal[x:y]
        differ = _bytes(raw, start[a[cut[e]]], size[e]) != _bytes(raw, start[b[cut[e]]], size[e])
        fits[e] = np.add.reduceat(differ, np.cumsum(size[e]) - size[e]) == 0
    for k in np.flatnonzero(~fits).tolist():  # some window of the row differs: each by itself
        for i in range(cut[k], cut[k] + length[k]):
            x, y = a[i], b[i]
            same[rows[i]] = raw[start[x] : start[x + WINDOW]].tobytes() == raw[start[y] : start[y + WINDOW]].tobytes()
    return same


def _runs(doc: np.ndarray, pos: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(id, [first, windows, ...]) rows from windows sorted by (doc, pos)."""
    if not len(doc):
        return pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))
    cut = np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1))
    at = np.flatnonzero(cut)
    length = np.diff(np.append(at, len(doc)))
    owner = doc[at]
    flat = np.stack([pos[at].astype(np.int64), length], 1).reshape(-1)
    new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return pa.array(owner[new]), pa.ListArray.from_arrays(pa.array((2 * np.append(new, len(owner))).astype(np.int32)), pa.array(flat))


_PACKED = "bucket int, segments binary, words binary, size bigint"
#: ``count`` windows from word ``pos`` on that are assigned to the symbol of ``length`` words that begins ``place`` words from ``pos``.
_SEGMENT = np.dtype([("name", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("count", "<i4"), ("place", "<i4"), ("length", "<i4")])


def _squeezed(seg: np.ndarray) -> bytes:
    """Segments by column, compressed: the columns but the name are small or alike from row to row."""
    columns = [seg["name"], np.diff(seg["doc"], prepend=0), seg["pos"], seg["count"], seg["place"], seg["length"]]
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(seg), -1).T.tobytes() for c in columns]
    return len(seg).to_bytes(4, "little") + _ZSTD.compress(b"".join(planes), asbytes=True)


def _spread(raw: bytes) -> np.ndarray:
    """Segments as they were before ``_squeezed``."""
    n, at = int.from_bytes(raw[:4], "little"), 0
    data = np.frombuffer(pa.decompress(raw[4:], n * _SEGMENT.itemsize, "zstd", asbytes=True), np.uint8)
    seg = np.zeros(n, _SEGMENT)
    for name in _SEGMENT.names:
        kind = _SEGMENT[name]
        column = np.ascontiguousarray(data[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).reshape(n)
        seg[name] = np.cumsum(column) if name == "doc" else column
        at += n * kind.itemsize
    return seg


def _settled(doc: np.ndarray, pos: np.ndarray, buckets: int) -> tuple[int, bytes, bytes, int]:
    """A row of windows that are known to be later ones; it goes to a negative bucket."""
    order = np.lexsort((pos, doc))
    d, p = doc[order], pos[order]
    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)))
    seg = np.zeros(len(cut), _SEGMENT)
    seg["doc"], seg["pos"], seg["count"] = d[cut], p[cut], np.diff(np.append(cut, len(d)))
    return -1 - int(seg["doc"][0] % buckets), _squeezed(seg), b"", 0


def pack(batch: pa.RecordBatch, buckets: int, hot: np.ndarray, shared: "Shared") -> pa.RecordBatch:
    """One row a bucket: segments and their words. Only windows of ``shared`` symbols travel; negative buckets hold what is later within the batch."""
    ids = batch.column(0)
    known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    data, offsets = K.string_buffers(batch.column(1))
    out, parts = [], []
    for first, _, d, o in K.pieces(data, offsets, CHUNK):
        w = Windows(d, o, hot)
        keep = known[w.row + first] & shared.passes(w.first)
        at, row, pos, name, begin, end = (x[keep] for x in (w.at, w.row, w.pos, w.name, w.begin, w.end))
        if not len(at):
            continue
        doc = ids[row + first]
        key = keys(name, at, begin, end, w.hashes)
        late = later_ones(key, doc, pos, at, w.raw, w.start)
        if late.any():
            out.append(_settled(doc[late], pos[late], buckets))
        at, row, pos, name, begin, end, doc, key = (x[~late] for x in (at, row, pos, name, begin, end, doc, key))
        if not len(at):
            continue
        route = name
        if len(hot):
            near = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
            route = np.where(hot[near] == name, key, name)
        cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]) | (route[1:] != route[:-1])))
        seg = np.zeros(len(cut), _SEGMENT)
        seg["name"], seg["doc"], seg["pos"], seg["count"] = name[cut], doc[cut], pos[cut], np.diff(np.append(cut, len(at)))
        seg["place"], seg["length"] = (begin - at)[cut], (end - begin)[cut]
        begins = w.start[at[cut]]
        size = w.start[at[cut] + seg["count"] + WINDOW - 1] - begins
        parts.append((seg, ((K.mix(route[cut]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32), size, _bytes(w.raw, begins, size)))
    if parts:
        seg, bucket, size, raw = (np.concatenate(x) for x in zip(*parts))
        begins = np.cumsum(size) - size
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()):
            rows = order[a:b]
            words = _bytes(raw, begins[rows], size[rows])
            out.append((int(bucket[rows[0]]), _squeezed(seg[rows]), _ZSTD.compress(words.tobytes(), asbytes=True), len(words)))
    b, s, p, n = zip(*out) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(s, pa.binary()), pa.array(p, pa.binary()), pa.array(n, pa.int64())], names=["bucket", "segments", "words", "size"])


def _word_hashes(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Fingerprints of words joined by one blank, some at a time."""
    out = np.empty(len(start) - 1, np.uint64)
    for a, b, d, o in K.pieces(raw, start):
        out[a:b] = K.runs_hash(K._letters(0)[d], o[:-1], o[1:] - 1, 0)
    return out


def _settle(group: pa.Table) -> pa.Table:
    """The windows of a bucket that have an earlier equal one, as runs by document."""
    seg = np.concatenate([_spread(x) for x in group.column("segments").to_pylist()])
    count = seg["count"].astype(np.int64)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    doc, pos = np.repeat(seg["doc"], count), np.repeat(seg["pos"].astype(np.int64), count) + within
    if group.column("bucket")[0].as_py() >= 0:
        raw = np.frombuffer(b"".join(pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(group.column("words").to_pylist(), group.column("size").to_pylist())), np.uint8)
        start = np.append(0, np.flatnonzero(raw == 0x20) + 1)
        own = count + WINDOW - 1
        first = np.repeat(np.cumsum(own) - own, count)
        at, begin = first + within, first + np.repeat(seg["place"].astype(np.int64), count)
        key = keys(np.repeat(seg["name"], count), at, begin, begin + np.repeat(seg["length"].astype(np.int64), count), _word_hashes(raw, start))
        late = later_ones(key, doc, pos, at, raw, start)
        doc, pos = doc[late], pos[late]
    order = np.lexsort((pos, doc))
    ids, runs = _runs(doc[order], pos[order])
    return pa.table({"id": ids, "runs": runs})


def _names(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """Per task, a row a bucket: the distinct names to which windows are assigned, and how often; a bucket holds a range of slots."""
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        name, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (_slots(name) >> np.uint64(shift)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        name, n, bucket = name[order], np.minimum(n[order], 0xFFFFFFFF).astype(np.uint32), bucket[order]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        cuts = list(zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist()))
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array([name[x:y].tobytes() for x, y in cuts], pa.binary()), pa.array([n[x:y].tobytes() for x, y in cuts], pa.binary())], names=["bucket", "names", "counts"])

    for batch in batches:
        for part in slices(batch, 0, PART):
            for _, _, d, o in K.pieces(*K.string_buffers(part.column(0)), CHUNK):
                w = Windows(d, o, words=False)
                if len(w.at):
                    held.append(w.name[np.append(True, (w.begin[1:] != w.begin[:-1]) | (w.name[1:] != w.name[:-1]))])
        if sum(map(len, held)) > NAMES_HELD:
            yield counted()
            held.clear()
    if held:
        yield counted()


def _slots(name: np.ndarray) -> np.ndarray:
    """32 bits of every name; the filter takes the first of them."""
    return K.mix(name) >> np.uint64(32)


def shared_names(docs: DataFrame, size: int) -> tuple["Shared", np.ndarray]:
    """The naming round over texts of ``size`` bytes: a filter of the names to which windows of several places are assigned, and the hot ones, sorted."""
    bits = FILTER_BITS[0]
    while bits < FILTER_BITS[1] and 1 << bits < size // 2:
        bits += 1
    spread = 6
    while spread < bits - 6 and NAMING_BYTES << spread < size:
        spread += 1
    shift, limit = 32 - spread, max(LEAST_HOT, int(HOT * size))

    def meet(group: pa.Table) -> pa.Table:
        name, at = np.unique(np.frombuffer(b"".join(group.column("names").to_pylist()), np.uint64), return_inverse=True)
        n = np.bincount(at, np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32), len(name))
        inner = (_slots(name[n > 1]) >> np.uint64(32 - bits)) & np.uint64((1 << (bits - spread)) - 1)
        block = np.zeros(1 << (bits - spread - 3), np.uint8)
        np.bitwise_or.at(block, (inner >> np.uint64(3)).astype(np.int64), np.uint8(1) << (inner & np.uint64(7)).astype(np.uint8))
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "block": pa.array([block.tobytes()], pa.binary()), "hot": pa.array([name[n > limit].tobytes()], pa.binary())})

    small_batches(docs.sparkSession)
    named = docs.where("id IS NOT NULL").select("text").mapInArrow(lambda batches: _names(batches, shift), "bucket int, names binary, counts binary")
    found = named.groupBy("bucket").applyInArrow(meet, "bucket int, block binary, hot binary").toArrow().to_pylist()  # the filter and at most 1/HOT names
    words = np.zeros((1 << spread, 1 << (bits - spread - 3)), np.uint8)
    for row in found:
        words[row["bucket"]] = np.frombuffer(row["block"], np.uint8)
    return Shared(bits, words.reshape(-1)), np.sort(np.frombuffer(b"".join(row["hot"] for row in found), np.uint64))


class Shared:
    """A one-hash filter of names: no false negatives."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def passes(self, name: np.ndarray) -> np.ndarray:
        bit = _slots(name) >> np.uint64(32 - self.bits)
        return ((self.words[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, runs): for each document with later windows, [first window, number of windows, ...]; checkpointed."""
    thin = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession
    size = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    shared = spark.sparkContext.broadcast(shared_names(thin, size))
    packed = map_batches(thin, lambda batch: pack(batch, buckets, shared.value[1], shared.value[0]), _PACKED, ("text", PART))
    return materialise(packed.groupBy("bucket").applyInArrow(_settle, "id bigint, runs array<bigint>"))


def _mask(n: int, runs: list[int] | None) -> np.ndarray:
    """Which of n words are covered."""
    out = np.zeros(n, bool)
    for a, c in zip(runs[::2], runs[1::2]) if runs else ():
        out[a : a + c + WINDOW - 1] = True
    return out


def _cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """The texts without the words of their runs and the blanks behind those; null where nothing is left."""
    runs = runs.to_pylist()
    if not any(runs):
        return texts
    out = texts.to_pylist()
    for i, r in enumerate(runs):
        if not r or out[i] is None:
            continue
        raw = np.frombuffer(out[i].encode(), np.uint8)
        w = K.split_words(raw, np.array([0, len(raw)], np.int64))
        gone = _mask(len(w.start), r)
        step = np.zeros(len(raw) + 1, np.int64)
        step[w.start[gone]] += 1
        step[np.append(w.start[1:], len(raw))[gone]] -= 1
        out[i] = None if gone.all() else raw[np.cumsum(step[:-1]) == 0].tobytes().decode()
    return pa.array(out, texts.type)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words, and the blanks behind them, cut out of ``text``; documents of which nothing is left go."""
    own, key = keyed(docs, doc_id, text)
    marked, name = with_runs(own, key, repeated_runs(own, key, text))
    cut = rewritten(marked, text, _cut, name)
    return cut.filter(F.col(f"`{text}`").isNotNull() | F.col(name).isNull()).select(*(F.col(f"`{x}`") for x in docs.columns))


_DIGESTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    own, key = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    marked, name = with_runs(own, key, repeated_runs(own, key, "text"))

    def sums(texts: pa.Array, runs: pa.Array) -> dict[str, pa.Array]:
        n, gone, sha = [], [], []
        for t, r in zip(texts.to_pylist(), runs.to_pylist()):
            words = [] if t is None else t.encode().split()
            n.append(len(words))
            mask = _mask(len(words), r) if r else None
            gone.append(0 if mask is None else int(mask.sum()))
            sha.append(hashlib.sha256(b" ".join(words if mask is None else [x for x, m in zip(words, mask.tolist()) if not m])).hexdigest())
        return {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}

    out, made = derived(marked, sums, _DIGESTS, "text", name)
    return out.select("doc_id", f"{made}.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without their repeated passages."""
    return recounted(dedup(docs))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, (SELECT unnest(range(0, 20)) AS k)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
