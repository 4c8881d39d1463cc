"""Operator 5, repeated byte strings by merging shard Burrows-Wheeler transforms.

Every 50-byte string is assigned to one of its own 12-byte grams (that of
least fingerprint), so equal strings meet in the gram's bucket; neighbouring
strings of one gram travel together as a segment. In a bucket, equal segments
collapse; distinct segments of a gram that agree for 19 more bytes on one side of it
(two that share a string must) are cut into shards. Each shard gets its suffix array and Burrows-Wheeler
transform on its own. The transforms are then merged without sorting suffixes again: an
interleave of the shards is refined (each pass deals the current order out by the
symbols that precede, stably: as many at once as fit in a word), and the places where
blocks first part give the longest common prefixes. After fifty symbols a block
is a repeated interval: all places of one 50-byte string. The smallest
document of the interval keeps it; every other document loses the bytes.

Defined cases: null and empty texts, and texts under 50 bytes, have no strings;
repeats inside one document do not count; a document without id keeps its bytes
and removes none of others'; rows that repeat doc_id and text count as one document, rows
that share a doc_id but not the text as documents of their own, in the order of
a digest of the text; ids may be of any type that has an order;
empty tables give empty results.

Scale: equal segments of one batch collapse before the shuffle, so a passage in
a third of all documents sends one row a batch. Segments travel compressed.
Grams that a bounded sample shows to be frequent are chosen last (this changes the
routing only, alike for equal strings). Texts without removals are not shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import derived, gathered, map_batches, materialise, release, rewritten, small_batches, table
from .touched import keyed, with_runs

LENGTH, GRAM = 50, 12
#: Windows of one segment at most; buckets for each shuffle partition.
SEGMENT, BUCKETS = 40, 4
#: Bytes of text packed at once, and looked at together.
PART, CHUNK = 8 << 20, 1 << 18
_ZSTD = pa.Codec("zstd", compression_level=3)
#: Documents sampled for frequent grams, and the share of segments that makes one frequent.
SAMPLE_DOCS, FREQUENT = 4000, 1 / 2000
#: Bytes of a shard.
SHARD = 1 << 15

_HEAD = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("count", "u1"), ("offset", "u1"), ("several", "?")])
#: Bytes beside the gram that two segments must share on one side at least to share a string.
BESIDE = (LENGTH - GRAM) // 2
_LAST = np.uint64(1 << 63)


def _rolling(best: np.ufunc, values: np.ndarray, span: int) -> np.ndarray:
    """The least or greatest of each ``span`` neighbours, by doubling."""
    out, width = values, 1
    while 2 * width <= span:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(out) - (span - width)], out[span - width :]) if span > width else out


def segments(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first byte, strings, gram, its place in the segment, whether it comes there again) of each run of strings that share their chosen gram."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, np.zeros(0, np.uint64), none.astype(np.uint8), none.astype(bool)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(K._letters(0)[data] * K.powers(0, n), out=total[1:])
    grams = K.mix((total[GRAM:] - total[:-GRAM]) * K.powers(0, n - GRAM + 1, True)) >> np.uint64(1)
    if len(frequent):
        near = np.searchsorted(frequent, grams)
        near[near == len(frequent)] = 0
        grams = np.where(frequent[near] == grams, grams | _LAST, grams)
    span = LENGTH - GRAM + 1
    least = _rolling(np.minimum, grams, span)
    valid = np.zeros(len(least) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    valid[offsets[long]] += 1
    valid[offsets[long + 1] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(at):
        return none, none, np.zeros(0, np.uint64), none.astype(np.uint8), none.astype(bool)
    g = least[at]
    new = np.append(True, (at[1:] != at[:-1] + 1) | (g[1:] != g[:-1]))
    lead = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(lead, np.diff(np.append(lead, len(at))))
    lead = np.flatnonzero(within % SEGMENT == 0)
    start, count, gram = at[lead], np.diff(np.append(lead, len(at))), g[lead]
    # places of grams that are the least of some string: among them, the first in each segment with its gram
    none = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(_rolling(np.maximum, np.concatenate([none, least, none]), span) == grams)
    place, times = np.full(len(start), 255, np.uint8), np.zeros(len(start), np.uint8)
    rows, end = np.arange(len(start)), start + count + span - 1
    i = np.searchsorted(chosen, start)
    while len(rows):
        inside = i < len(chosen)
        inside[inside] = chosen[i[inside]] < end[rows[inside]]
        rows, i = rows[inside], i[inside]
        hit = rows[grams[chosen[i]] == gram[rows]]
        at = chosen[i[grams[chosen[i]] == gram[rows]]] - start[hit]
        place[hit] = np.minimum(place[hit], at.astype(np.uint8))
        times[hit] += 1
        i = i + 1
    return start, count, gram, place, times > 1


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all segments, one behind the other."""
    before = np.cumsum(size) - size
    return data[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def _same_bytes(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """Whether the runs of ``size`` bytes at ``one`` and ``two`` are equal, some at a time."""
    out = np.ones(len(one), bool)
    part = (np.cumsum(size) - 1) // chunk
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(one) else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(one)).tolist()):
        n = size[a:b]
        differ = _gather(data, one[a:b], n) != _gather(data, two[a:b], n)
        if differ.any():
            out[a:b] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
    return out


def _same_later(gram: np.ndarray, prints: np.ndarray, doc: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which segments have an equal one in a smaller document: found by fingerprint, verified byte by byte."""
    out = np.zeros(len(gram), bool)
    key = K.mix(gram ^ (prints << np.uint64(1)))
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        rows = np.flatnonzero(np.isin(key, twice))
        order = rows[np.lexsort((doc[rows], prints[rows], gram[rows]))]
        new = np.append(True, (gram[order][1:] != gram[order][:-1]) | (prints[order][1:] != prints[order][:-1]))
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = (doc[order] != doc[lead]) & (size[order] == size[lead])
        order, lead = order[later], lead[later]
        out[order] = _same_bytes(data, start[order], start[lead], size[order])
    return out


def _planes(values: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on: they compress better so."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)


def _squeezed(head: np.ndarray) -> bytes:
    """Heads by column, compressed; the gram is in the segment's bytes and stays out."""
    columns = [_planes(np.diff(head["doc"], prepend=0)), _planes(np.diff(head["pos"], prepend=np.int32(0))), head["count"].tobytes(), head["offset"].tobytes(), head["several"].tobytes()]
    return len(head).to_bytes(4, "little") + _ZSTD.compress(b"".join(columns), asbytes=True)


def _spread(raw: bytes) -> np.ndarray:
    """Heads as they were, but for the gram."""
    n = int.from_bytes(raw[:4], "little")
    data = pa.decompress(raw[4:], n * 15, "zstd", asbytes=True)
    head = np.zeros(n, _HEAD)
    head["doc"] = np.cumsum(_from_planes(data, np.int64, n, 0))
    head["pos"] = np.cumsum(_from_planes(data, np.int32, n, 8 * n))
    for k, c in enumerate(("count", "offset", "several")):
        head[c] = np.frombuffer(data, np.uint8, n, (12 + k) * n)
    return head


def pack(batch: pa.RecordBatch, buckets: int, frequent: np.ndarray) -> pa.RecordBatch:
    """One row a bucket: heads and compressed bytes of its segments; negative buckets hold what is settled within the batch."""
    ids = batch.column(0)
    doc_of = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    data, offsets = K.string_buffers(batch.column(1))
    parts = []
    for a, _, d, o in K.pieces(data, offsets, CHUNK):
        s, c, g, p, m = segments(d, o, frequent)
        parts.append((s + offsets[a], c, g, p, m, K.runs_hash(K._letters(1)[d], s, s + c + LENGTH - 1, 1)))
    start, count, gram, place, several, prints_ = (np.concatenate(x) for x in zip(*parts))
    row = np.searchsorted(offsets, start, "right") - 1
    keep = known[row]
    start, count, gram, prints_, row = start[keep], count[keep], gram[keep], prints_[keep], row[keep]
    head = np.zeros(len(start), _HEAD)
    head["gram"], head["doc"], head["pos"], head["count"], head["offset"], head["several"] = gram, doc_of[row], start - offsets[row], count, place[keep], several[keep]
    late = _same_later(gram, prints_, head["doc"], data, start, count + LENGTH - 1)
    out = []
    if late.any():
        settled = head[late]
        out.append((-1 - int(settled["doc"][0] % buckets), _squeezed(settled), b"", 0))
    head, start, count = head[~late], start[~late], count[~late]
    bucket = ((head["gram"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()):
        rows = order[a:b]
        raw = _gather(data, start[rows], count[rows] + LENGTH - 1)
        out.append((int(bucket[rows[0]]), _squeezed(head[rows]), _ZSTD.compress(raw.tobytes(), asbytes=True), len(raw)))
    b, h, r, n = zip(*out) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(h, pa.binary()), pa.array(r, pa.binary()), pa.array(n, pa.int64())], names=["bucket", "heads", "raw", "size"])


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of numbers of so many bits, the same for equal ones, and their order, equal ones by place."""
    n = len(key)
    shift = n.bit_length()
    if bits + shift <= 63:  # number and place in one word
        word = np.sort(key << shift | np.arange(n))
        order, key = word & ((1 << shift) - 1), word >> shift
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1])[:n]) - 1
    return rank, order


class Shard:
    """A collection of strings with its suffix array and Burrows-Wheeler transform.

    Symbols are bytes plus one; 0 ends every string. Suffixes of equal content keep the order of their strings.
    """

    def __init__(self, symbols: np.ndarray, end: np.ndarray):
        """``end``: for every place, that of its string's terminator."""
        n = len(symbols)
        at = np.arange(n)
        room = end - at + 1  # symbols up to and with the terminator
        bits = max(1, int(symbols.max(initial=0)).bit_length())
        depth, longest = min(7, max(1, (63 - n.bit_length()) // bits)), int(room.max(initial=0))
        key = np.zeros(n, np.int64)
        padded = np.concatenate([symbols, np.zeros(depth, symbols.dtype)]).astype(np.int64)
        for k in range(depth):
            key = (key << bits) | np.where(room > k, padded[k : k + n], 0)
        rank, self.suffix = _ranked(key, depth * bits)
        while depth < longest:
            ahead = np.where(room > depth, rank[np.minimum(at + depth, n - 1)] + 1, 0)
            rank, self.suffix = _ranked(rank * (n + 1) + ahead, 2 * n.bit_length())
            depth *= 2
        before = symbols[np.maximum(self.suffix - 1, 0)].copy()
        before[self.suffix == 0] = 0
        self.bwt = before


def _before(bwt: np.ndarray, span: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a transform the ``span`` symbols before its suffix, as one number, and the row of the suffix that begins with them."""
    symbol = bwt.astype(np.int64)
    back = np.empty(len(bwt), np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    key, row, done = symbol, back, 1
    for step in bin(span)[3:]:  # twice as far, and one symbol more where the binary digit says so
        key, row, done = key | key[row] << done * bits, row[row], 2 * done
        if step == "1":
            key, row, done = key | symbol[row] << done * bits, back[row], done + 1
    return key, row


def stride_of(symbols: int, places: int) -> tuple[int, int]:
    """(symbols that one pass of a merge may deal by, bits of a symbol): they share a word of 63 bits with the place."""
    bits = max(1, (symbols - 1).bit_length())
    return max(1, (63 - max(1, (places - 1).bit_length())) // bits), bits


def merge(shards: list[np.ndarray], depth: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Merge Burrows-Wheeler transforms: (order, lcp).

    ``order`` lists places of the concatenated transforms so that suffixes are
    sorted by their first ``depth`` symbols; lcp[i] is the common prefix of the
    suffixes i - 1 and i, or ``depth`` where it is not shorter. One pass deals by up to
    ``stride`` symbols, as that many passes by one would; prefixes are then rounded down to what earlier passes had compared.
    """
    symbols = np.concatenate(shards)
    n = len(symbols)
    seen = np.bincount(symbols) > 0
    found, symbols = np.flatnonzero(seen), (np.cumsum(seen) - 1)[symbols]
    most, bits = stride_of(len(found), n)
    stride = min(stride, most, depth)
    edge = np.cumsum([0, *(len(x) for x in shards)]).tolist()
    symbols = symbols.astype(np.uint16)
    shift = max(1, (n - 1).bit_length())
    mask = (1 << shift) - 1
    order, block = np.arange(n), np.zeros(n, np.int32)
    key, back = np.empty(n, np.int64), np.empty(n, np.int64)
    lcp = np.full(n, depth, np.int16)
    if n:
        lcp[0] = 0
    length, span = 0, 0
    while length < depth:
        step = (depth - 1) % stride + 1 if not length else stride  # what is left over comes first
        if step != span:
            for a, b in zip(edge, edge[1:]):
                key[a:b], back[a:b] = _before(symbols[a:b], step, bits)
                back[a:b] += a
            key <<= shift
            span = step
        dealt = key[order]
        dealt |= np.arange(n)
        dealt.sort()  # by the symbols before, then by place
        s = dealt >> shift
        dealt &= mask
        parted = block[dealt]
        new = np.zeros(n, bool)
        new[1:] = (s[1:] != s[:-1]) | (parted[1:] != parted[:-1])
        lcp[new & (lcp == depth)] = length
        del s, parted
        block = np.cumsum(new, dtype=np.int32)
        order = back[order[dealt]]  # each shard's suffixes stay in its own order
        length += step
    return order, lcp


def _owners(raw: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every string (segment by segment) the smallest document that holds it; ``owner`` is each segment's smallest."""
    count = size - LENGTH + 1
    first = np.cumsum(count) - count
    out = np.repeat(owner, count)
    room = size + 1
    place = np.cumsum(room) - room
    n = int(room.sum())
    symbols = np.zeros(n, np.uint16)
    inner = np.ones(n, bool)
    inner[place + size] = False
    symbols[inner] = _gather(raw, at, size).astype(np.uint16) + 1
    segment = np.repeat(np.arange(len(size)), room)
    end = (place + size)[segment]
    lead = np.searchsorted(place, np.arange(0, n, SHARD))
    cut = np.unique(place[lead[lead < len(place)]])
    cut = np.append(cut, n)
    if len(cut) == 2 and len(place) > 1:  # two shards at least
        cut = np.array([0, place[len(place) // 2], n])
    shards, suffixes = [], []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        x = Shard(symbols[a:b], end[a:b] - a)
        shards.append(x.bwt)
        suffixes.append(x.suffix + a)
    order, lcp = merge(shards, LENGTH, LENGTH)
    where = np.concatenate(suffixes)[order]
    whole = end[where] - where >= LENGTH
    interval = np.cumsum(lcp < LENGTH)[whole]
    where = where[whole]
    if not len(where):
        return out
    lead = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    least = np.minimum.reduceat(owner[segment[where]], lead)
    got = np.repeat(least, np.diff(np.append(lead, len(where))))
    s = segment[where]
    out[first[s] + where - place[s]] = got
    return out


def _shared(value: np.ndarray, group: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Which rows have another row of the same value in their group."""
    out = np.zeros(len(value), bool)
    rows = np.flatnonzero(there)
    order = rows[np.lexsort((value[rows], group[rows]))]
    same = (value[order][1:] == value[order][:-1]) & (group[order][1:] == group[order][:-1])
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _prints(raw: np.ndarray, at: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Columns of fingerprints of every segment: its gram, itself twice, and the gram with BESIDE bytes before and behind."""
    out = np.empty((len(at), 5), np.uint64)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK)))
        a, n = at[lo:hi] - at[lo], size[lo:hi]
        data = raw[at[lo] : at[lo] + a[-1] + n[-1]]
        o = a + offset[lo:hi]
        left, right = np.maximum(o - BESIDE, a), np.minimum(o + GRAM + BESIDE, a + n)
        starts, ends = np.concatenate([o, a, left, o]), np.concatenate([o + GRAM, a + n, o + GRAM, right])
        out[lo:hi, :4] = K.runs_hash(K._letters(0)[data], starts, ends, 0).reshape(4, -1).T
        out[lo:hi, 4] = K.runs_hash(K._letters(1)[data], a, a + n, 1)
        lo = hi
    return out


def settle(head: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first byte, strings) of the runs of strings that a smaller document holds too."""
    none = np.zeros(0, np.int64)
    size = head["count"].astype(np.int64) + LENGTH - 1
    at = np.cumsum(size) - size
    gram, whole, left_print, right_print, again = _prints(raw, at, size, head["offset"].astype(np.int64)).T
    order = np.lexsort((head["doc"], gram))
    g, d = gram[order], head["doc"][order]
    lead = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else none
    last = np.append(lead[1:], len(g)) - 1
    rows = order[np.repeat(d[lead] != d[last], last - lead + 1)]  # only grams of several documents
    if not len(rows):
        return none, none, none
    a, b = whole[rows], again[rows]
    by = np.lexsort((head["doc"][rows], b, a, gram[rows]))
    rows, a, b = rows[by], a[by], b[by]
    new = np.append(True, (gram[rows][1:] != gram[rows][:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    # equal fingerprints are verified byte by byte; one that differs is a content of its own
    lead = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    follow = np.flatnonzero(~new)
    same = size[rows[follow]] == size[lead[follow]]
    same[same] = _same_bytes(raw, at[rows[follow[same]]], at[lead[follow[same]]], size[rows[follow[same]]])
    if not same.all():
        own = np.cumsum(new)
        own[follow[~same]] = own[-1] + 1 + np.arange(int((~same).sum()))
        by = np.lexsort((head["doc"][rows], own, gram[rows]))
        rows, own = rows[by], own[by]
        new = np.append(True, own[1:] != own[:-1])
    content, lead = np.cumsum(new) - 1, np.flatnonzero(new)
    one = rows[lead]  # of each content, the row of the smallest document
    owner = head["doc"][one]
    several_docs = head["doc"][rows[np.append(lead[1:], len(rows)) - 1]] != owner
    # a string that two contents share reaches BESIDE bytes beyond the gram on one side at least
    o, og = head["offset"][one].astype(np.int64), gram[one]
    group = np.cumsum(np.append(True, og[1:] != og[:-1])) - 1
    left, right = o >= BESIDE, o + GRAM + BESIDE <= size[one]
    free = np.bincount(group, head["several"][one]) > 0  # the gram comes twice in a segment: no place to compare at
    match = (_shared(left_print[one], group, left) | _shared(right_print[one], group, right) | free[group]) & (np.bincount(group)[group] > 1)
    live = match | several_docs
    rows, content = rows[live[content]], content[live[content]]
    if not len(rows):
        return none, none, none
    count = np.where(live, head["count"][one].astype(np.int64), 0)
    first = np.cumsum(count) - count
    owners = np.repeat(owner, count)
    pick = np.flatnonzero(match)
    if len(pick):
        k = count[pick]
        owners[np.repeat(first[pick] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))] = _owners(raw, at[one[pick]], size[one[pick]], owner[pick])
    # each row against its content's strings
    k = head["count"][rows].astype(np.int64)
    begin = np.cumsum(k) - k
    which = np.repeat(first[content] - begin, k) + np.arange(int(k.sum()))
    doc = np.repeat(head["doc"][rows], k)
    late = doc > owners[which]
    pos = np.repeat(head["pos"][rows].astype(np.int64) - begin, k) + np.arange(int(k.sum()))
    doc, pos = doc[late], pos[late]
    by = np.lexsort((pos, doc))
    doc, pos = doc[by], pos[by]
    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1))) if len(doc) else none
    return doc[cut], pos[cut], np.diff(np.append(cut, len(doc)))


def _settle(group: pa.Table) -> pa.Table:
    head = np.concatenate([_spread(x) for x in group.column("heads").to_pylist()])
    if group.column("bucket")[0].as_py() < 0:
        doc, pos, count = head["doc"], head["pos"].astype(np.int64), head["count"].astype(np.int64)
        order = np.lexsort((pos, doc))
        doc, pos, count = doc[order], pos[order], count[order]
    else:
        parts = [pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(group.column("raw").to_pylist(), group.column("size").to_pylist())]
        doc, pos, count = settle(head, np.frombuffer(b"".join(parts), np.uint8))
    new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    flat = np.stack([pos, count], 1).reshape(-1).astype(np.int64)
    runs = pa.ListArray.from_arrays(pa.array((2 * np.append(new, len(doc))).astype(np.int32)), pa.array(flat))
    return pa.table({"id": pa.array(np.asarray(doc[new], np.int64)), "runs": runs})


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Grams chosen for more than a FREQUENT share of the segments of a bounded sample of documents."""
    n = docs.count()
    if not n:
        return np.zeros(0, np.uint64)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = np.zeros(0, np.uint64)
        g = np.concatenate([segments(d, o, none)[2] for _, _, d, o in K.pieces(*K.string_buffers(batch.column(0)), CHUNK)])
        s, c = np.unique(g, return_counts=True)
        top = c > max(1, FREQUENT / 8 * len(g))
        return pa.RecordBatch.from_arrays([pa.array(np.append(s[top].view(np.int64), -1)), pa.array(np.append(c[top], 0)), pa.array(np.append(np.zeros(int(top.sum()), np.int64), len(g)))], names=["gram", "n", "all"])

    drawn = docs.sample(min(1.0, SAMPLE_DOCS / n), 7).select("text")
    counted = map_batches(drawn, count, "gram bigint, n bigint, all bigint", ("text", PART)).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    rows = counted.orderBy(F.desc("all"), F.desc("n")).limit(int(1 / FREQUENT) + 1).toArrow()
    n, s = rows.column("n").to_numpy(), rows.column("gram").to_numpy()
    return np.sort(s[n > FREQUENT * max(1, int(np.sum(rows.column("all").to_numpy())))].view(np.uint64))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, runs): for each document that loses bytes, [first byte, number of strings, ...]; checkpointed."""
    thin = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(frequent_grams(thin))
    small_batches(spark)
    packed = thin.mapInArrow(lambda batches: (pack(x, buckets, shared.value) for x in gathered(batches, 1, PART)), "bucket int, heads binary, raw binary, size bigint")
    runs = materialise(packed.groupBy("bucket").applyInArrow(_settle, "id bigint, runs array<bigint>"))
    del packed
    release()
    return runs


def _mask(n: int, runs: list[int] | None) -> np.ndarray:
    """Which of n bytes are covered."""
    step = np.zeros(n + 1, np.int64)
    if runs:
        r = np.array(runs, np.int64).reshape(-1, 2)
        np.add.at(step, r[:, 0], 1)
        np.add.at(step, r[:, 0] + r[:, 1] + LENGTH - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """The texts without the bytes of their runs; characters that lose only some of their bytes go whole."""
    runs = runs.to_pylist()
    if not any(runs):
        return texts
    out = texts.to_pylist()
    for i, r in enumerate(runs):
        if r and out[i]:
            raw = np.frombuffer(out[i].encode(), np.uint8)
            out[i] = raw[~_mask(len(raw), r)].tobytes().decode("utf-8", "ignore")
    return pa.array(out, texts.type)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; characters that lose only some of their bytes go whole."""
    own, key = keyed(docs, doc_id, text)
    marked, name = with_runs(own, key, repeated_runs(own, key, text))
    return rewritten(marked, text, _cut, name).select(*(F.col(f"`{x}`") for x in docs.columns))


_DIGESTS = T.StructType([*(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    own, key = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    marked, name = with_runs(own, key, repeated_runs(own, key, "text"))

    def sums(texts: pa.Array, runs: pa.Array) -> dict[str, pa.Array]:
        rows = []
        for t, r in zip(texts.to_pylist(), runs.to_pylist()):
            raw = b"" if t is None else t.encode()
            if not r:
                rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            mask = _mask(len(raw), r)
            spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
            rows.append((len(raw), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest()))
        return {f.name: pa.array(x, pa.string() if f.name == "kept_sha256" else pa.int64()) for f, x in zip(_DIGESTS.fields, zip(*rows))}

    out, made = derived(marked, sums, _DIGESTS, "text", name)
    return out.select("doc_id", f"{made}.*")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM wins) WHERE doc_id > m),
runs AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM late),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM runs)
  GROUP BY doc_id, s),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM spans),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k,
         sum(b - a) AS n, count(*) AS c FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
