"""Operator 4, MinHash near-duplicate groups with an LSH forest.

Texts are sets of five-word shingles. Equal sets collapse to one node (by a
128-bit digest, summed before the shuffle), so that copies cost one row. Every
node has 120 min-hashes; the forest is ``TREES`` orders of the nodes, each
sorted by twelve of them in a row. In each order a node's candidates are its
neighbours of longest common prefix, and the depth adapts to the region: where
at most ``SIDE`` rows on either side share the least prefix, a node is held
against every one of them; where more do, against the nearest ones, which share
the deepest prefixes there, and the region counts as dense. Four bits of every
hash travel along, so that only pairs whose estimated similarity may reach the
threshold become candidates; those are confirmed on full sets. Confirmed links
give components.

What a dense region leaves unseen is settled exactly, among the nodes of dense regions
alone: two sets that reach the threshold share one of their rarest shingles, so
nodes of different components meet by these (postings with the place among
a node's shingles in order of rarity, which bounds how many two sets can
share), and the pairs that meet are confirmed on full sets like any others. The
order of rarity comes from counts in a table of fixed size; any order gives the same links.

Defined cases: null and empty texts have no shingles, are linked with nothing
and stand for themselves; texts with fewer than five words are one shingle;
rows that repeat a doc_id with the same text stand or fall together; a null doc_id is ignored
when a group looks for its smallest; an empty table gives an empty result. The
threshold may be 50 to 100 percent.

Scale: an order is range-partitioned, so a hot region is spread over tasks; a
border between two tasks hides neighbours in one order only. Postings travel
packed, in as many buckets as their measured number needs; a shingle with more
than ``CELL`` postings is dealt in cells, its commonest component's nodes against
the others', and drops out if it has one component only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import textkit as K
from .common import compact, map_batches, materialise, release, small_batches, table
from .components import components, merged
from .touched import id_filter, passes, without

SHINGLE, HASHES, TREES, STRIDE, DEPTH = 5, 120, 24, 5, 12
#: Rows on either side that a node is held against; candidates that a node of a dense region keeps in an order.
SIDE, KEEP = 12, 4
#: Counts of shingles; postings of a bucket, of a cell; shingles at most that are dealt in cells.
SLOTS, BLOCKS, BUCKET, CELL, MAX_HOT = 1 << 18, 16, 1 << 17, 8192, 1 << 16

_rng = np.random.default_rng(40961)
_MULT = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_SAME = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)

_SIGNED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("bits", T.BinaryType())])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle fingerprints, border of each text's): distinct within a text, in order of first occurrence."""
    w = K.split_words(K.LOWER[data], offsets)
    h = w.hashes()
    at, full = K.windows(w, h, SHINGLE)
    short, whole = K.short_texts(w, h, SHINGLE)
    text = np.concatenate([w.text[at], short])
    prints = np.concatenate([full, whole])
    if len(short):
        order = np.argsort(text, kind="stable")
        text, prints = text[order], prints[order]
    _, keep = np.unique(K.mix(prints ^ (text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))), return_index=True)
    keep.sort()
    text, prints = text[keep], prints[keep]
    return prints, np.searchsorted(text, np.arange(len(offsets)))


def _fixed(a: np.ndarray, present: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column; null where not present."""
    width = a.shape[1]
    sizes = np.where(present, width, 0)
    offsets = np.zeros(len(present) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(present), [pa.array(present).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(a[present]).tobytes())])


def _digests(prints: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two order-free sums of mixed fingerprints per non-empty text."""
    return np.stack([np.add.reduceat(K.mix(prints), first), np.add.reduceat(K.mix(prints ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)], 1)


def signatures(column: pa.Array) -> list[pa.Array]:
    data, offsets = K.string_buffers(column)
    n = len(column)
    size, node = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
    hashes, bits = np.zeros((n, HASHES), np.uint16), np.zeros((n, HASHES // 2), np.uint8)
    for a, b, d, o in K.pieces(data, offsets, K.CHUNK_BYTES // 2):
        prints, border = shingle_sets(d, o)
        count = np.diff(border)
        size[a:b] = count
        some = np.flatnonzero(count)
        if not len(some):
            continue
        first = border[some]
        node[a + some] = _digests(prints, first)
        least = np.empty((len(some), HASHES), np.uint16)
        for p in range(HASHES):
            least[:, p] = np.minimum.reduceat((((prints ^ _XOR[p]) * _MULT[p]) >> np.uint64(32)).astype(np.uint32), first)
        hashes[a + some] = least
        bits[a + some] = (least[:, ::2] & 15) | ((least[:, 1::2] & 15) << 4)
    present = size > 0
    ring = np.concatenate([hashes, hashes[:, :DEPTH]], 1).view(np.uint8)
    return [pa.array(size), _fixed(node.view(np.uint8), present), _fixed(ring, present), _fixed(bits, present)]


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _SAME[x ^ y].sum(-1, dtype=np.int16)


@dataclass(frozen=True)
class Threshold:
    """What follows from a least similarity."""

    percent: int = 75

    def __post_init__(self) -> None:
        if not 50 <= self.percent <= 100:
            raise ValueError("percent must be between 50 and 100")

    @property
    def prefix(self) -> int:
        """Equal hashes that a pair shares in one of the orders, but for one pair in ten millions."""
        return 2 if self.percent >= 75 else 1

    @property
    def agree(self) -> int:
        """Agreeing four-bit hashes below which the similarity is out of reach: those expected, less 4.5 deviations."""
        p = self.percent / 100 + (1 - self.percent / 100) / 16
        return int(HASHES * p - 4.5 * np.sqrt(HASHES * p * (1 - p)))

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shingles that sets of these sizes must share."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def sizes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def prefixes(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Common prefix, in hashes, of every row with the one before it in its order."""
    out = np.zeros(len(tree), np.int64)
    out[1:] = np.logical_and.accumulate(key[1:] == key[:-1], axis=1).sum(1)
    out[1:][tree[1:] != tree[:-1]] = 0
    return out


def neighbours(lcp: np.ndarray, least: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Pairs (rows, distance) of up to SIDE rows apart that share a prefix, and the rows of dense regions."""
    region = np.cumsum(lcp < least)
    size = np.bincount(region)
    out = []
    for s in range(1, SIDE + 1):
        i = np.flatnonzero(region[s:] == region[:-s])
        if not len(i):
            break
        out.append((i, s))
    return out, size[region] > SIDE + 1


def _candidates(batches: Iterator[pa.RecordBatch], limit: Threshold) -> Iterator[pa.RecordBatch]:
    """Per sorted partition of the orders: candidate pairs; and, without a partner, the nodes of dense regions."""
    kept: pa.Table | None = None
    for batch in batches:
        here = pa.Table.from_batches([batch])
        carried = 0 if kept is None else kept.num_rows
        rows = here if kept is None else pa.concat_tables([kept, here]).combine_chunks()
        n = rows.num_rows
        kept = rows.slice(max(0, n - SIDE - 1))
        bits, node, size = _matrix(rows.column("bits"), HASHES // 2), _matrix(rows.column("node"), 16), rows.column("n_shingles").to_numpy()
        lcp = prefixes(rows.column("tree").to_numpy(), _matrix(rows.column("key"), 2 * DEPTH).view(np.uint16))
        near, dense = neighbours(lcp, limit.prefix)
        left, right, score = [], [], []
        best, mate = np.full((n, KEEP), -1, np.int16), np.zeros((n, KEEP), np.int64)

        def offer(i: np.ndarray, j: np.ndarray, agree: np.ndarray) -> None:
            """Row i may take j as one of its KEEP partners (each i at most once a call)."""
            for k in range(KEEP):
                better = agree > best[i, k]  # noqa: B023
                a, m = best[i, k].copy(), mate[i, k].copy()  # noqa: B023
                best[i[better], k], mate[i[better], k] = agree[better], j[better]  # noqa: B023
                agree, j = np.where(better, a, agree), np.where(better, m, j)

        for i, s in near:
            i = i[i + s >= carried]
            i = i[limit.sizes(size[i], size[i + s])]
            agree = _agree(bits[i], bits[i + s])
            i, agree = i[agree >= limit.agree], agree[agree >= limit.agree]
            crowded = dense[i]
            left.append(i[~crowded])
            right.append(i[~crowded] + s)
            score.append(agree[~crowded])
            offer(i[crowded], i[crowded] + s, agree[crowded])
            offer(i[crowded] + s, i[crowded], agree[crowded])
        i, k = np.nonzero(best >= 0)
        x = np.concatenate([*left, i]).astype(np.int64)
        y = np.concatenate([*right, mate[i, k]]).astype(np.int64)
        agree = np.concatenate([*score, best[i, k]]).astype(np.int32)
        halves = node.view(">u8")
        swap = (halves[x, 0] > halves[y, 0]) | ((halves[x, 0] == halves[y, 0]) & (halves[x, 1] > halves[y, 1]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        alone = np.flatnonzero(dense)
        x, agree = np.append(x, alone), np.append(agree, np.zeros(len(alone), np.int32))
        there = np.ones(len(x), bool)
        there[len(y) :] = False
        y = np.append(y, alone)
        yield pa.RecordBatch.from_arrays([_fixed(node[x], np.ones(len(x), bool)), _fixed(node[y], there), pa.array(agree)], names=["a", "b", "agree"])


def candidates(nodes: DataFrame, limit: Threshold) -> DataFrame:
    """(a, b, agree): pairs of nodes, smaller key first, that some order brings together; b is null for a node of a dense region."""
    trees = nodes.select("node", "bits", F.col("n_shingles").cast("int").alias("n_shingles"), "hashes", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = trees.select("tree", F.expr(f"substring(hashes, tree * {2 * STRIDE} + 1, {2 * DEPTH})").alias("key"), "node", "bits", "n_shingles")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return ordered.mapInArrow(lambda batches: _candidates(batches, limit), "a binary, b binary, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, shingles): full sets of the texts whose id is in ``wanted`` (column id) and, by the filter's error, a few more."""
    m, words = id_filter(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        chosen = batch.column(1).filter(pa.array(passes(batch.column(0), m, shared.value)))
        data, offsets = K.string_buffers(chosen)
        nodes, sets = [], []
        for _, _, d, o in K.pieces(data, offsets):
            prints, border = shingle_sets(d, o)
            some = np.flatnonzero(np.diff(border))
            if not len(some):
                continue
            nodes += [x.tobytes() for x in _digests(prints, border[some])]
            sets.append(pa.ListArray.from_arrays(pa.array(np.append(border[some], len(prints)).astype(np.int32)), pa.array(prints.view(np.int64))))
        sets = pa.concat_arrays(sets) if sets else pa.array([], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), sets], names=["node", "shingles"])

    return map_batches(docs.select(_long_id(docs, doc_id).alias("id"), F.col(f"`{text}`").alias("text")), cut, "node binary, shingles array<bigint>")


def _long_id(docs: DataFrame, doc_id: str) -> F.Column:
    """An id as a long for filters; a null one counts as 0."""
    own = F.col(f"`{doc_id}`")
    return F.coalesce(own.cast("long") if isinstance(docs.schema[doc_id].dataType, T.IntegralType) else F.xxhash64(own), F.lit(0).cast("long"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets have 100 * intersection >= percent * union."""
    one = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return two.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that still join different components."""
    left, right = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    named = pairs.join(left, "a", "left").join(right, "b", "left")
    return named.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


_POSTING = np.dtype([("cell", "<u8"), ("node", "<u8", 2), ("label", "<i8"), ("size", "<i4"), ("place", "<i4"), ("side", "u1")])
_PACKED = "bucket int, postings binary"


def _slot(prints: np.ndarray) -> np.ndarray:
    return (K.mix(prints) & np.uint64(SLOTS - 1)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often each of SLOTS hashed shingles is in a set; counted by task, then summed in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount(_slot(batch.column(0).flatten().to_numpy().view(np.uint64)), minlength=SLOTS)
        if total.any():
            salt = int(total.sum() % 61)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in total.reshape(BLOCKS, -1)], pa.binary())], names=["block", "salt", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("n").to_pylist())
        return pa.table({"block": group.column("block").slice(0, 1), "salt": pa.array([0], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, salt int, n binary"
    summed = sets.select("shingles").mapInArrow(count, schema).groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    out = np.zeros((BLOCKS, SLOTS // BLOCKS), np.int64)
    for row in summed.toArrow().to_pylist():
        out[row["block"]] = np.frombuffer(row["n"], np.int64)
    return out.reshape(-1)


def postings(batch: pa.RecordBatch, counts: np.ndarray, limit: Threshold) -> np.ndarray:
    """The rarest shingles of every set (node, lab, shingles), as many as it must share one of."""
    lists = batch.column(2)
    prints, n = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((prints, counts[_slot(prints)], owner))
    place = np.arange(len(prints)) - np.repeat(np.cumsum(n) - n, n)
    # of a set of n shingles, n - ceil(n * percent / 100) + 1 meet every set that is similar enough
    first = place < (n + (-limit.percent * n // 100) + 1)[owner]
    rows = owner[first]
    out = np.zeros(len(rows), _POSTING)
    out["cell"], out["place"], out["size"] = prints[order][first], place[first], n[rows]
    out["node"] = _matrix(batch.column(0), 16).view(np.uint64)[rows]
    out["label"] = batch.column(1).to_numpy()[rows]
    return out


def _dealt(rows: np.ndarray, hot: dict[str, np.ndarray]) -> np.ndarray:
    """Postings of hot shingles, a copy for every cell of theirs; the others as they are."""
    if not len(hot["cell"]):
        return rows
    near = np.minimum(np.searchsorted(hot["cell"], rows["cell"]), len(hot["cell"]) - 1)
    is_hot = hot["cell"][near] == rows["cell"]
    out, rows, near = [rows[~is_hot]], rows[is_hot], near[is_hot]
    several = hot["rest"][near] > 0
    rows, near = rows[several], near[several]
    top = rows["label"] == hot["label"][near]
    a, b = (np.maximum(1, -(-hot[x][near] // CELL)) for x in ("most", "rest"))
    salt = K.mix(rows["node"][:, 0] ^ rows["node"][:, 1])
    own_a, own_b = (salt % a.astype(np.uint64)).astype(np.int64), (salt % b.astype(np.uint64)).astype(np.int64)

    def copies(chosen: np.ndarray, times: np.ndarray, side: int, kind: int, at) -> None:
        k = times[chosen]
        if len(chosen):
            copy = np.repeat(rows[chosen], k)
            turn = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            x, y = at(np.repeat(chosen, k), turn)
            copy["cell"] = K.mix(copy["cell"] ^ K.mix((x.astype(np.uint64) << np.uint64(32)) | (y.astype(np.uint64) << np.uint64(1)) | np.uint64(kind)))
            copy["side"] = side
            out.append(copy)

    copies(np.flatnonzero(top), b, 1, 0, lambda i, t: (own_a[i], t))
    copies(np.flatnonzero(~top), a, 2, 0, lambda i, t: (t, own_b[i]))
    copies(np.flatnonzero(~top), b, 0, 1, lambda i, t: (np.minimum(own_b[i], t), np.maximum(own_b[i], t)))
    return np.concatenate(out)


def _pack(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (K.mix(rows["cell"]) >> np.uint64(24)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(order))
    return pa.RecordBatch.from_arrays([pa.array(bucket[order[edge]].astype(np.int32)), pa.array([rows[order[a:b]].tobytes() for a, b in zip(edge.tolist(), ends.tolist())], pa.binary())], names=["bucket", "postings"])


def meeting(rows: np.ndarray, limit: Threshold) -> np.ndarray:
    """(smaller node, larger node), as bytes of 32, of the postings of a cell whose components differ and whose places leave enough shingles to share."""
    rows = rows[np.argsort(rows["cell"], kind="stable")]
    lead = np.flatnonzero(np.append(True, rows["cell"][1:] != rows["cell"][:-1])) if len(rows) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(rows["label"], lead) != np.maximum.reduceat(rows["label"], lead) if len(rows) else np.zeros(0, bool)
    rows = rows[np.repeat(many, np.diff(np.append(lead, len(rows))))]
    lead = np.flatnonzero(np.append(True, rows["cell"][1:] != rows["cell"][:-1])) if len(rows) else np.zeros(0, np.int64)
    length = np.diff(np.append(lead, len(rows)))
    label, size, place, side = (rows[x] for x in ("label", "size", "place", "side"))
    size, place = size.astype(np.int64), place.astype(np.int64)
    found = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        fit = (label[i] != label[j]) & ((side[i] == 0) | (side[i] != side[j])) & limit.sizes(size[i], size[j])
        i, j = i[fit], j[fit]
        need = limit.overlap(size[i], size[j])
        fit = (place[i] + need <= size[i]) & (place[j] + need <= size[j])
        found.append(np.stack([i[fit], j[fit]], 1))

    short = np.repeat(length <= 64, length)
    cell = np.repeat(np.arange(len(lead)), length)
    for s in range(1, 64):
        i = np.flatnonzero((cell[s:] == cell[:-s]) & short[s:])
        if not len(i):
            break
        keep(i, i + s)
    for a, n in zip(lead[length > 64].tolist(), length[length > 64].tolist()):
        step = max(1, (1 << 20) // n)
        for x in range(a, a + n, step):
            i, j = np.arange(x, min(a + n, x + step)), np.arange(x, a + n)
            i, j = np.repeat(i, len(j)), np.tile(j, len(i))
            keep(i[i < j], j[i < j])
    at = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    halves = np.ascontiguousarray(rows["node"]).view(np.uint8).reshape(-1, 16).view(">u8")
    x, y = at[:, 0], at[:, 1]
    swap = (halves[x, 0] > halves[y, 0]) | ((halves[x, 0] == halves[y, 0]) & (halves[x, 1] > halves[y, 1]))
    both = np.ascontiguousarray(np.concatenate([rows["node"][np.where(swap, y, x)], rows["node"][np.where(swap, x, y)]], 1))
    return np.unique(both.view("V32").reshape(-1)) if len(both) else np.zeros(0, "V32")


def unseen_pairs(sets: DataFrame, labels: DataFrame, limit: Threshold) -> DataFrame:
    """(a, b): every pair of these sets that may reach the threshold and joins different components."""
    spark = sets.sparkSession
    small_batches(spark)
    counts = shingle_counts(sets)
    shared = spark.sparkContext.broadcast(counts)
    named = sets.join(labels, "node", "left").select("node", F.xxhash64(F.coalesce("label", "node")).alias("lab"), "shingles")
    hot = {x: np.zeros(0, np.int64) for x in ("cell", "label", "most", "rest")}
    limit_of_cold = max(CELL, int(counts.sum()) // MAX_HOT)
    if int(counts.max(initial=0)) > limit_of_cold:

        def heads(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = postings(batch, shared.value, limit)
            rows = rows[shared.value[_slot(rows["cell"])] > limit_of_cold]
            key, n = np.unique(np.stack([rows["cell"].view(np.int64), rows["label"]], 1), axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(n)], names=["cell", "label", "n"])

        by_label = map_batches(named, heads, "cell bigint, label bigint, n bigint").groupBy("cell", "label").agg(F.sum("n").alias("n"))
        rows = by_label.groupBy("cell").agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("most"), F.sum("n").alias("n")).where(F.col("n") > limit_of_cold).toArrow()  # MAX_HOT at most
        cell = rows.column("cell").to_numpy().view(np.uint64)
        order = np.argsort(cell)
        hot = {"cell": cell[order], "label": rows.column("label").to_numpy()[order], "most": rows.column("most").to_numpy()[order], "rest": (rows.column("n").to_numpy() - rows.column("most").to_numpy())[order]}
    cells = spark.sparkContext.broadcast(hot)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // (4 * BUCKET) + 1)
    packed = map_batches(named, lambda batch: _pack(_dealt(postings(batch, shared.value, limit), cells.value), buckets), _PACKED)

    def meet(group: pa.Table) -> pa.Table:
        both = meeting(np.frombuffer(b"".join(group.column("postings").to_pylist()), _POSTING), limit)
        raw = np.frombuffer(both.tobytes(), np.uint8).reshape(-1, 2, 16)
        there = np.ones(len(raw), bool)
        return pa.table({"a": _fixed(raw[:, 0], there), "b": _fixed(raw[:, 1], there)})

    return packed.groupBy("bucket").applyInArrow(meet, "a binary, b binary").distinct()


def likely(pairs: DataFrame, nodes: DataFrame, limit: Threshold) -> DataFrame:
    """Those pairs whose estimate may reach the threshold."""

    def judged(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_agree(_matrix(a, HASHES // 2), _matrix(b, HASHES // 2)) >= limit.agree)

    left, right = (nodes.select(F.col("node").alias(x), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").where(F.arrow_udf(judged, "boolean")("bits_a", "bits_b")).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    limit = Threshold(percent)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *signatures(batch.column(1))], names=["doc_id", *_SIGNED.fieldNames()])

    signed = materialise(map_batches(source, sign, T.StructType([source.schema["doc_id"], *_SIGNED.fields])))
    nodes = materialise(signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("hashes").alias("hashes"), F.first("bits").alias("bits")))
    offered = compact(candidates(nodes, limit))
    pairs, crowded = offered.where("b IS NOT NULL"), offered.where("b IS NULL").select(F.col("a").alias("node"))
    touched = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded).distinct()
    wanted = nodes.join(touched, "node", "left_semi").select(_long_id(source, "doc_id").alias("id"))
    sets = materialise(full_sets(source, wanted, "doc_id", "text").join(touched, "node", "left_semi").dropDuplicates(["node"]))
    # first each node's two likeliest links; most groups are whole after that
    ends = pairs.select(F.col("a").alias("u"), "a", "b", "agree").union(pairs.select("b", "a", "b", "agree"))
    top = ends.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(F.desc("agree"), "a", "b"))).where("rank <= 2").select("a", "b").distinct()
    top = compact(top)
    labels = components(compact(confirm(top, sets, percent)))
    release()
    left = compact(across(pairs.join(top, ["a", "b"], "left_anti"), labels))
    labels = merged(labels, compact(confirm(left, sets, percent)))
    release()
    if not crowded.isEmpty():
        dense = sets.join(crowded, "node", "left_semi")
        unseen = compact(likely(unseen_pairs(dense, labels, limit), nodes, limit))
        labels = merged(labels, compact(confirm(unseen, sets, percent)))
    grouped = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_node = grouped.join(least, "label").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays."""
    return without(docs, "doc_id", near_duplicates(docs).where("NOT kept").select("doc_id"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a AS u, a AS v FROM links UNION SELECT u, b FROM reach JOIN links ON v = a),
comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON u = w.doc_id
"""
