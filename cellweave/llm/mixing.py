"""Operator 2, mixing sources to target weights by Pfair scheduling. Native: DataFrame and SQL functions only.

Target weights become whole shares of a period of W slots (largest remainders,
at least one each), so weights are exact fractions s/W. The documents of a
source, in the order of a hash, form blocks; block j (from 0) of a source is
released at floor(j * W / s) and due at ceil((j + 1) * W / s). Earliest deadline
first then gives every slot to one released block, which keeps each source
less than one block from its target at every slot. The schedule repeats after
W slots, because all sources are exactly on target there; so one period is
simulated (a fold over W slots in SQL) and every block finds its slot from the
period it lies in: slot = (j div s) * W + template slot.

Nothing is dropped or repeated: each document appears once. When a source has
no block left its slots stay empty; ``on_target`` marks the documents before
the first such slot, which follow the weights.

Defined cases: a null source is a source of its own; null ids hash as the empty
text; repeated rows take neighbouring places; an empty table gives an empty
result; more than ``MAX_SOURCES`` sources is an error.

Scale: the place of a document in its source is counted by hash bucket (partial
counts, then a running sum over at most ``MAX_BUCKETS`` buckets a source), so a
source of any size is ranked in parallel. The tables broadcast hold at most
MAX_SOURCES and 8 * MAX_SOURCES rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

PERIOD, BLOCK_DOCS, EXPONENT = 1024, 16, 0.5
MAX_SOURCES, BUCKET_ROWS, MAX_BUCKETS = 4096, 1024, 65536


def shares(counts: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, period: int = PERIOD) -> DataFrame:
    """(source, docs, idx, period, share): whole shares that sum to the period.

    ``weights`` names target weights; a source it lacks gets weight 0 and so one
    share. Without it, the weight is the number of documents to the ``exponent``.
    """
    weight = F.pow(F.col("docs").cast("double"), F.lit(exponent))
    if weights is not None:
        pairs = [y for k, v in weights.items() for y in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("source", F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
    everything = W.partitionBy(F.lit(0))  # one row per source: bounded by MAX_SOURCES
    sized = counts.select("source", "docs", weight.alias("weight")).select(
        "*", F.sum("weight").over(everything).alias("total"), F.count(F.lit(1)).over(everything).alias("k"), F.row_number().over(everything.orderBy(F.asc_nulls_first("source"))).cast("long").alias("idx")
    )
    bounded = sized.where(F.expr(f"assert_true(k <= {MAX_SOURCES}, 'more sources than MAX_SOURCES') IS NULL"))
    width = F.greatest(F.lit(period), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("k") * 8.0))).cast("long")).cast("long")
    ideal = F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(1.0 / F.col("k")) * (F.col("period") - F.col("k"))
    based = bounded.withColumn("period", width).withColumn("ideal", ideal).withColumn("least", F.floor("ideal") + 1)
    left = based.withColumn("left", F.col("period") - F.sum("least").over(everything)).withColumn("turn", F.row_number().over(everything.orderBy(F.desc(F.col("ideal") - F.floor("ideal")), "idx")))
    return left.select("source", "docs", "idx", "period", (F.col("least") + F.when(F.col("turn") <= F.col("left"), 1).otherwise(0)).alias("share"))


def template(shared: DataFrame) -> DataFrame:
    """(idx, nth, slot): the slots of one period, by earliest deadline among the released."""
    row = shared.groupBy("period").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "share"))), lambda x: x["share"]).alias("s"))
    code = 1 << 20
    pick = f"""cast(array_min(transform(s, (x, i) -> if(a.done[i] < x AND (a.done[i] * period) div x <= t,
        (((a.done[i] + 1) * period + x - 1) div x) * {code} + i, cast(null as bigint)))) % {code} as int)"""
    simulated = row.select(
        F.expr(
            f"""aggregate(sequence(0L, period - 1), named_struct('done', transform(s, x -> 0L), 'picks', cast(array() as array<int>), 'pick', 0),
            (b, t) -> transform(array(named_struct('done', b.done, 'picks', b.picks, 'pick', {pick.replace("a.done", "b.done")})),
              c -> named_struct('done', transform(c.done, (d, i) -> d + if(i = c.pick, 1L, 0L)), 'picks', concat(c.picks, array(c.pick)), 'pick', c.pick))[0],
            b -> b.picks)"""
        ).alias("picks")
    )
    slots = simulated.select(F.posexplode("picks").alias("slot", "i")).select((F.col("i") + 1).cast("long").alias("idx"), F.col("slot").cast("long").alias("slot"))
    return slots.withColumn("nth", (F.row_number().over(W.partitionBy("idx").orderBy("slot")) - 1).cast("long"))


def _key(source: str) -> F.Column:
    """A source as text that is never null, so that counting, ranking and joining share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", block_docs: int = BLOCK_DOCS, exponent: float = EXPONENT, period: int = PERIOD) -> DataFrame:
    """``docs`` with ``mix_share``, ``mix_block``, ``mix_slot``, ``mix_position`` and ``mix_on_target``.

    Reading in the order of ``mix_position`` gives the interleaved corpus.
    """
    added = ("mix_share", "mix_block", "mix_slot", "mix_position", "mix_on_target")
    docs = docs.drop(*(x for x in added if x not in (source, doc_id)))
    # the row travels as one value, so that no name of its columns can clash
    hashed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__cw_row"), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("__cw_h"), _key(source).alias("__cw_s"))
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("docs"))
    shared = shares(counts, weights, exponent, period)
    total = counts.agg(F.least(F.lit(MAX_BUCKETS), F.greatest(F.lit(1), F.ceil(F.sum("docs") / BUCKET_ROWS))).cast("long").alias("__cw_n"))
    spread = hashed.join(F.broadcast(total), F.lit(True), "inner")
    bucketed = spread.withColumn("__cw_b", F.expr("(cast(conv(substr(__cw_h, 1, 8), 16, 10) as bigint) * __cw_n) div 4294967296L"))
    thin = docs.select(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("__cw_h"), _key(source).alias("__cw_s")).join(F.broadcast(total), F.lit(True), "inner")
    sizes = thin.withColumn("__cw_b", F.expr("(cast(conv(substr(__cw_h, 1, 8), 16, 10) as bigint) * __cw_n) div 4294967296L")).groupBy("__cw_s", "__cw_b").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("__cw_s").alias("__cw_s2"), F.col("__cw_b").alias("__cw_b2"), (F.sum("n").over(W.partitionBy("__cw_s").orderBy("__cw_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("__cw_before"))
    ranked = bucketed.withColumn("__cw_rn", F.row_number().over(W.partitionBy("__cw_s", "__cw_b").orderBy("__cw_h", F.col("__cw_row")[doc_id])))
    placed = ranked.join(before, (F.col("__cw_s") == F.col("__cw_s2")) & (F.col("__cw_b") == F.col("__cw_b2"))).withColumn("__cw_rank", F.col("__cw_before") + F.col("__cw_rn") - 1)
    slots = template(shared)
    # the first block that a source lacks ends the part that is on target
    lacks = shared.withColumn("blocks", F.expr(f"(docs + {block_docs - 1}) div {block_docs}")).withColumn("nth", F.expr("blocks % share"))
    horizon = lacks.join(slots, ["idx", "nth"]).agg(F.min(F.expr("(blocks div share) * period + slot")).alias("__cw_end"))
    sources = F.broadcast(shared.select(_key("source").alias("__cw_s3"), F.col("idx").alias("__cw_idx"), F.col("period").alias("__cw_period"), F.col("share").alias("mix_share")))
    timed = placed.join(sources, F.col("__cw_s") == F.col("__cw_s3")).withColumn("mix_block", F.expr(f"__cw_rank div {block_docs}")).withColumn("__cw_nth", F.expr("mix_block % mix_share"))
    tpl = F.broadcast(slots.select(F.col("idx").alias("__cw_idx2"), F.col("nth").alias("__cw_nth2"), F.col("slot").alias("__cw_slot")))
    out = timed.join(tpl, (F.col("__cw_idx") == F.col("__cw_idx2")) & (F.col("__cw_nth") == F.col("__cw_nth2"))).join(F.broadcast(horizon), F.lit(True), "inner")
    out = out.withColumn("mix_slot", F.expr("(mix_block div mix_share) * __cw_period + __cw_slot"))
    return out.withColumn("mix_position", F.col("mix_slot") * block_docs + F.col("__cw_rank") % block_docs).withColumn("mix_on_target", F.col("mix_slot") < F.col("__cw_end")).select("__cw_row.*", *added)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its place in the mixed corpus."""
    return mix(docs)


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
w AS (SELECT *, pow(docs::DOUBLE, 0.5) AS weight, sum(pow(docs::DOUBLE, 0.5)) OVER () AS total, count(*) OVER () AS k,
        row_number() OVER (ORDER BY source NULLS FIRST) AS idx FROM counts),
p AS (SELECT *, greatest(1024, pow(2, ceil(log2(k * 8.0))))::BIGINT AS period FROM w),
ideal AS (SELECT *, weight / total * (period - k) AS ideal FROM p),
least_ AS (SELECT *, (floor(ideal) + 1)::BIGINT AS lo FROM ideal),
turns AS (SELECT *, period - sum(lo) OVER () AS left_, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, idx) AS turn FROM least_),
shared AS (SELECT source, docs, idx, period, lo + CASE WHEN turn <= left_ THEN 1 ELSE 0 END AS share FROM turns),
arr AS (SELECT period, list(share ORDER BY idx) AS s FROM shared GROUP BY period),
sim AS (
  SELECT 0::BIGINT AS t, list_transform(s, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS pick FROM arr
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, list_min(list_transform(s, lambda x, i: CASE WHEN done[i] < x AND (done[i] * period) // x <= t
               THEN (((done[i] + 1) * period + x - 1) // x) * 1048576 + i END)) % 1048576 AS p
        FROM sim, arr WHERE t < period)),
slots AS (SELECT pick AS idx, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM sim WHERE pick IS NOT NULL),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM documents),
horizon AS (
  SELECT min(((docs + 15) // 16) // share * period + slot) AS h FROM shared JOIN slots ON slots.idx = shared.idx AND nth = ((docs + 15) // 16) % share)
SELECT doc_id, ranked.source, share::BIGINT AS mix_share, (r // 16)::BIGINT AS mix_block,
       ((r // 16) // share * period + slot)::BIGINT AS mix_slot, (((r // 16) // share * period + slot) * 16 + r % 16)::BIGINT AS mix_position,
       (r // 16) // share * period + slot < h AS mix_on_target
FROM ranked JOIN shared ON ranked.source IS NOT DISTINCT FROM shared.source JOIN slots ON slots.idx = shared.idx AND nth = (r // 16) % share, horizon
"""
