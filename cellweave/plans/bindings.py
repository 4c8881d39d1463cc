"""Queries over the driver's tables: each binds one operator, beside the SQL that checks it.

Bindings: customers are cells (parent: nation, weight: balance), line items are
samples, orders are dated evidence, suppliers are nodes of a lattice, parts are
points or tree nodes, events are dated rows, embeddings give ray vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, contracts, focal, graph, intervals, nearest, rollup, sequence, summary, temporal, vectors

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def queries() -> dict[str, Query]:
    from . import bindings_cells, bindings_evidence, bindings_labels, bindings_more, bindings_network, bindings_overlay, bindings_paths, bindings_rivers, bindings_space, bindings_terrain, bindings_tiles  # noqa: F401

    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    from . import bindings_cells, bindings_evidence, bindings_labels, bindings_more, bindings_network, bindings_overlay, bindings_paths, bindings_rivers, bindings_space, bindings_terrain, bindings_tiles  # noqa: F401

    return dict(_ORACLES)


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded alike in both engines; -0.0 becomes 0.0."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


# --- inputs -------------------------------------------------------------------


def samples(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("cell"), (F.col("l_extendedprice") - 50000).alias("elevation"), F.when(F.col("l_quantity") % 7 != 0, F.col("l_returnflag")).alias("code"), F.col("l_partkey").alias("pixel"), "l_quantity")


SAMPLES = "samples AS (SELECT l_suppkey AS cell, l_extendedprice - 50000 AS elevation, CASE WHEN l_quantity % 7 <> 0 THEN l_returnflag END AS code, l_partkey AS pixel, l_quantity FROM lineitem)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("parent"), F.col("c_acctbal").alias("weight"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 100).alias("value"), F.col("c_mktsegment").alias("segment"))


CELLS = "cells AS (SELECT c_custkey AS cell, c_nationkey AS parent, c_acctbal AS weight, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 100 END AS value, c_mktsegment AS segment FROM customer)"


def evidence(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("record"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") != "O").alias("present"), F.substring("o_orderpriority", 1, 1).alias("priority"), "o_orderdate", "o_totalprice", "o_orderstatus")


EVIDENCE = "evidence AS (SELECT o_custkey AS cell, o_orderkey AS record, year(o_orderdate)::INT AS year, o_orderstatus <> 'O' AS present, substr(o_orderpriority, 1, 1) AS priority, o_orderdate, o_totalprice, o_orderstatus FROM orders)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").cast("long").alias("x0"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("x1"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("dataset"), F.year("l_shipdate").alias("year"), F.col("l_discount").alias("fraction"))


SPANS = "spans AS (SELECT l_suppkey AS cell, l_partkey::BIGINT AS x0, (l_partkey + l_quantity)::BIGINT AS x1, l_returnflag AS label, l_linestatus AS dataset, year(l_shipdate)::INT AS year, l_discount AS fraction FROM lineitem)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select((F.col("s_suppkey") - 1).alias("node"))


def lattice(spark: SparkSession, d: str) -> DataFrame:
    """Six-neighbour lattice of rows of ten, one edge in five impassable, whole lengths."""
    n = nodes(spark, d)
    step = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, 0), (1, -1))))
    e = n.select(F.col("node").alias("src"), F.inline(step)).where(((F.col("src") % 10) + F.col("dc")).between(0, 9)).withColumn("dst", F.col("src") + F.col("dr") * 10 + F.col("dc"))
    e = e.where((F.col("src") * 7 + F.col("dst") * 13) % 5 != 0).withColumn("w", (100 + (F.col("src") * 31 + F.col("dst") * 17) % 50).cast("long"))
    return e.join(n.select(F.col("node").alias("dst")), "dst").select("src", "dst", "w")


NODES = "nodes AS (SELECT s_suppkey - 1 AS node FROM supplier)"
LATTICE = NODES + """,
edges AS (
  SELECT src, dst, 100 + (src * 31 + dst * 17) % 50 AS w FROM (
    SELECT node AS src, node + dr * 10 + dc AS dst FROM nodes, (VALUES (0, 1), (1, 0), (1, -1)) AS s(dr, dc) WHERE node % 10 + dc BETWEEN 0 AND 9) e
  WHERE (src * 7 + dst * 13) % 5 <> 0 AND dst IN (SELECT node FROM nodes)),
arcs AS (SELECT src, dst, w FROM edges UNION SELECT dst, src, w FROM edges)"""


def _hops(h: int) -> str:
    """SQL of the hop-bounded neighbourhoods, as CTEs hood0..hoodH and hood."""
    out = [LATTICE, "hood0 AS (SELECT node AS src, node AS dst, 0 AS hops, 0::BIGINT AS dist FROM nodes)"]
    for k in range(1, h + 1):
        before = " UNION ALL ".join(f"SELECT src, dst FROM hood{i}" for i in range(k))
        out.append(f"hood{k} AS (SELECT f.src, a.dst, {k} AS hops, min(f.dist + a.w)::BIGINT AS dist FROM hood{k - 1} f JOIN arcs a ON a.src = f.dst WHERE (f.src, a.dst) NOT IN ({before}) GROUP BY 1, 2)")
    out.append("hood AS (" + " UNION ALL ".join(f"SELECT * FROM hood{i}" for i in range(h + 1)) + ")")
    return ",\n".join(out)


def values(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("node", ((F.col("node") * 37) % 101).cast("double").alias("z"))


VALUES = "vals AS (SELECT node, ((node * 37) % 101)::DOUBLE AS z FROM nodes)"


def points(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919) % 10007).cast("double").alias("x"), ((F.col("p_partkey") * 104729) % 10009).cast("double").alias("y"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 3).alias("class"))


POINTS = "points AS (SELECT p_partkey AS id, ((p_partkey * 7919) % 10007)::DOUBLE AS x, ((p_partkey * 104729) % 10009)::DOUBLE AS y, p_size AS priority, p_partkey % 3 AS class FROM part)"


def mouths(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 3571) % 10007).cast("double").alias("x"), ((F.col("s_suppkey") * 2903) % 10009).cast("double").alias("y"), (1.0 + F.col("s_suppkey") % 4).alias("weight"))


MOUTHS = "mouths AS (SELECT s_suppkey AS id, ((s_suppkey * 3571) % 10007)::DOUBLE AS x, ((s_suppkey * 2903) % 10009)::DOUBLE AS y, 1.0::DOUBLE + s_suppkey % 4 AS weight FROM supplier)"

_BANDS_SQL = ", ".join(f"round(avg(CASE WHEN depth >= {lo}{'' if hi is None else f' AND depth < {hi}'} THEN 1.0::DOUBLE WHEN depth IS NOT NULL THEN 0 END), 6) AS frac_band_{lo}_{hi if hi is not None else 'up'}" for lo, hi in ((0, 10000), (10000, 20000), (20000, 30000), (30000, None)))

# --- samples ------------------------------------------------------------------


@query(f"""WITH {SAMPLES}, s AS (SELECT cell, CASE WHEN elevation < 0 THEN -elevation END AS depth FROM samples),
m AS (SELECT cell, count(depth) AS n, round(avg(depth), 6) AS mean, round(median(depth), 6) AS median, round(min(depth), 6) AS min, round(max(depth), 6) AS max, round(stddev_pop(depth), 6) AS std,
 round(max(depth) - min(depth), 6) AS range, round(quantile_cont(depth, 0.1), 6) AS q10, round(quantile_cont(depth, 0.25), 6) AS q25, round(quantile_cont(depth, 0.75), 6) AS q75, round(quantile_cont(depth, 0.9), 6) AS q90, {_BANDS_SQL} FROM s GROUP BY cell)
SELECT s_suppkey AS cell, coalesce(n, 0)::BIGINT AS n, m.* EXCLUDE (cell, n) FROM supplier LEFT JOIN m ON cell = s_suppkey""")
def pixel_cell_summary(spark, d):
    s = samples(spark, d).withColumn("depth", summary.depth("elevation"))
    support = read(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"))
    return rounded(summary.cell_summary(s, support, "cell", "depth", ((0, 10000), (10000, 20000), (20000, 30000), (30000, None))))


@query(f"""WITH {SAMPLES}, s AS (SELECT *, CASE WHEN elevation < 0 THEN -elevation END AS depth FROM samples),
a AS (SELECT cell, count(depth) AS n, count(CASE WHEN depth IS NOT NULL THEN code END) AS known, count(CASE WHEN depth IS NOT NULL AND code = 'A' THEN 1 END) AS a, count(CASE WHEN depth IS NOT NULL AND code = 'N' THEN 1 END) AS b, count(CASE WHEN depth IS NOT NULL AND code = 'R' THEN 1 END) AS c FROM s GROUP BY cell)
SELECT cell, n, known, CASE WHEN n > 0 THEN a END AS "n_A", CASE WHEN n > 0 THEN b END AS "n_N", CASE WHEN n > 0 THEN c END AS "n_R", round((a + c) / nullif(known, 0)::DOUBLE, 6) AS direct_frac,
CASE WHEN n = 0 THEN 'no_samples' WHEN known = 0 THEN 'no_code' WHEN known < n THEN 'partial' ELSE 'complete' END AS status FROM a""")
def categorical_pixel_counts(spark, d):
    s = samples(spark, d).withColumn("depth", summary.depth("elevation"))
    return rounded(summary.code_summary(s, "cell", "code", ["A", "N", "R"], ["A", "R"], "depth"))


@query(f"WITH {SAMPLES} SELECT cell, count(*) AS expected, count(CASE WHEN elevation < 0 THEN 1 END) AS marine, count(CASE WHEN elevation >= 0 THEN 1 END) AS land, count(CASE WHEN elevation IS NULL THEN 1 END) AS nodata FROM samples GROUP BY cell")
def pixel_coverage(spark, d):
    return summary.coverage(samples(spark, d), "cell", "elevation")


@query("SELECT l_suppkey AS cell, round(avg(l_discount), 6) AS slope_mean, round(quantile_cont(l_discount, 0.9), 6) AS slope_q90 FROM lineitem GROUP BY 1")
def native_slope_summary(spark, d):
    li = read(spark, d, "lineitem")
    return rounded(li.groupBy(F.col("l_suppkey").alias("cell")).agg(F.avg("l_discount").alias("slope_mean"), F.percentile("l_discount", F.lit(0.9)).alias("slope_q90")))


@query(f"WITH {SAMPLES} SELECT cell, " + ", ".join(f"round(avg(CASE WHEN code = '{c}' THEN 1.0::DOUBLE ELSE 0 END), 6) AS \"share_{c}\"" for c in "ANR") + " FROM samples GROUP BY cell")
def class_proportions(spark, d):
    return rounded(summary.class_shares(samples(spark, d), ["cell"], "code", ["A", "N", "R"]))


@query(f"""WITH {CELLS}, a AS (SELECT parent, count(*) AS n, count(value) AS value, count(segment) AS segment FROM cells GROUP BY parent)
SELECT parent, 'value' AS "column", value AS n_known, value = n AS all_known FROM a UNION ALL SELECT parent, 'segment', segment, segment = n FROM a""")
def availability_audit(spark, d):
    return summary.availability(cells(spark, d), "parent", ["value", "segment"])


@query("""WITH a AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1), ra AS (SELECT l_quantity, sum(n) OVER (ORDER BY l_quantity) - n + (n + 1) / 2.0::DOUBLE AS r FROM a),
b AS (SELECT l_extendedprice, count(*) AS n FROM lineitem GROUP BY 1), rb AS (SELECT l_extendedprice, sum(n) OVER (ORDER BY l_extendedprice) - n + (n + 1) / 2.0::DOUBLE AS r FROM b)
SELECT count(*) AS n, round(corr(ra.r, rb.r), 6) AS rho FROM lineitem JOIN ra USING (l_quantity) JOIN rb USING (l_extendedprice)""")
def spearman_audit(spark, d):
    return rounded(summary.spearman(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


# --- rollups ------------------------------------------------------------------


@query(f"""WITH {CELLS} SELECT parent, round(sum(CASE WHEN value IS NOT NULL AND weight > 0 THEN value * weight END) / sum(CASE WHEN value IS NOT NULL AND weight > 0 THEN weight END), 6) AS value,
round(sum(weight), 6) AS weight, max(segment) AS segment, count(cell) AS cell FROM cells GROUP BY parent""")
def parent_rollup(spark, d):
    return rounded(rollup.parent_rollup(cells(spark, d), "parent", {"value": "wmean_any", "weight": "sum", "segment": "max", "cell": "count"}, "weight"))


@query(f"""WITH {CELLS} SELECT parent, round(CASE WHEN count(value) = count(*) THEN sum(CASE WHEN weight > 0 THEN value * weight END) / sum(CASE WHEN weight > 0 THEN weight END) END, 6) AS strict_mean, round(sum(CASE WHEN value IS NOT NULL AND weight > 0 THEN value * weight END) / sum(CASE WHEN value IS NOT NULL AND weight > 0 THEN weight END), 6) AS known_mean FROM
(SELECT parent * 10 + cell % 10 AS parent, value, weight FROM cells) GROUP BY parent""")
def reef_parent_gates(spark, d):
    c = cells(spark, d).withColumn("parent", F.col("parent") * 10 + (F.col("cell") % 10).cast("int"))
    return rounded(c.groupBy("parent").agg(rollup.weighted_mean("value", "weight", True).alias("strict_mean"), rollup.weighted_mean("value", "weight").alias("known_mean")).withColumn("parent", F.col("parent").cast("long")))


@query(f"""WITH {CELLS} SELECT parent, cell, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY value ASC NULLS LAST, weight ASC NULLS LAST, cell) AS r FROM cells) WHERE r = 1""")
def barrier_parent_selection(spark, d):
    return rounded(rollup.best_child(cells(spark, d), "parent", [F.col("value"), F.col("weight")], "cell").select("parent", "cell", "value"))


@query("""WITH e AS (SELECT l_suppkey AS cell, l_shipmode_ AS dataset, sum(l_discount * l_quantity) AS w, sum(l_quantity) AS s FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1, 2),
r AS (SELECT cell, round(w / s, 9) AS share, dataset, row_number() OVER (PARTITION BY cell ORDER BY round(w / s, 9) DESC, dataset DESC) AS k FROM e WHERE s > 0)
SELECT cell, round(share, 6) AS share, dataset FROM r WHERE k = 1""")
def max_dataset_selection(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.concat("l_returnflag", "l_linestatus").alias("dataset"), (F.col("l_discount") * F.col("l_quantity")).alias("w0"), F.col("l_quantity").alias("s0"))
    return rounded(rollup.best_dataset(li, ["cell"], "dataset", "w0", "s0"))


@query("""SELECT c_nationkey AS parent, string_agg(DISTINCT t, '|' ORDER BY t) AS tokens FROM (SELECT c_nationkey, unnest(string_split(c_mktsegment || '|' || chr((65 + c_custkey % 3)::INT), '|')) AS t FROM customer) GROUP BY 1""")
def token_union(spark, d):
    c = read(spark, d, "customer").select("c_nationkey", F.concat_ws("|", "c_mktsegment", F.chr(65 + F.col("c_custkey") % 3)).alias("t"))
    return c.groupBy(F.col("c_nationkey").alias("parent")).agg(rollup.tokens("t").alias("tokens"))


@query(f"""WITH {CELLS}, b AS (SELECT parent * 100 + cell % 100 AS g, value / 100 AS ratio, CASE WHEN segment < 'C' THEN 'a' ELSE 'b' END AS basis, 1.0 + cell % 4 AS years FROM cells)
SELECT g AS parent, round(CASE WHEN count(DISTINCT basis) = 1 THEN sum(CASE WHEN ratio IS NOT NULL THEN ratio * years END) / sum(CASE WHEN ratio IS NOT NULL THEN years END) END, 6) AS persistence, string_agg(DISTINCT basis, '|' ORDER BY basis) AS basis FROM b GROUP BY g""")
def persistence_rollup(spark, d):
    c = cells(spark, d).select((F.col("parent") * 100 + F.col("cell") % 100).alias("parent"), (F.col("value") / 100).alias("ratio"), F.when(F.col("segment") < "C", "a").otherwise("b").alias("basis"), (1.0 + F.col("cell") % 4).alias("years"))
    return rounded(rollup.persistence(c, "parent", "ratio", "basis", "years"))


@query(f"""WITH {EVIDENCE}, a AS (SELECT cell, sum(CASE WHEN present THEN o_totalprice ELSE 0 END) AS p, sum(CASE WHEN NOT present THEN o_totalprice ELSE 0 END) AS q, sum(o_totalprice) AS t FROM evidence GROUP BY cell)
SELECT cell, CASE WHEN p > 1e-9 AND q > 1e-9 THEN 'mixed_partial' WHEN p > t - 1e-6 THEN 'present' WHEN p > 1e-9 THEN 'partial_present' WHEN q > t - 1e-6 THEN 'absent' WHEN q > 1e-9 THEN 'partial_absent' ELSE 'unknown' END AS state FROM a""")
def parent_observation_state(spark, d):
    e = evidence(spark, d).groupBy("cell").agg(F.sum(F.when(F.col("present"), F.col("o_totalprice")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("present"), F.col("o_totalprice")).otherwise(0)).alias("q"), F.sum("o_totalprice").alias("t"))
    return e.select("cell", rollup.observation_state("p", "q", "t", 1e-6).alias("state"))


@query("""WITH s AS (SELECT l_suppkey AS cell, avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END) AS b, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS c FROM lineitem GROUP BY 1)
SELECT cell, round(-(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c) ELSE 0 END) / ln(3), 6) AS entropy FROM s WHERE abs(a + b + c - 1) <= 1e-3""")
def substrate_entropy(spark, d):
    s = summary.class_shares(read(spark, d, "lineitem").withColumnRenamed("l_suppkey", "cell"), ["cell"], "l_returnflag", ["A", "N", "R"])
    return rounded(s.select("cell", rollup.entropy(["share_A", "share_N", "share_R"]).alias("entropy")))


@query(f"""WITH {CELLS}, s AS (SELECT cell, CASE WHEN cell % 3 <> 0 THEN (cell % 11) / 10.0::DOUBLE END AS a, CASE WHEN cell % 4 <> 0 THEN (cell % 7) / 7.0::DOUBLE END AS b, CASE WHEN cell % 6 <> 0 THEN (cell % 13) / 13.0::DOUBLE END AS c FROM cells)
SELECT cell, round(CASE WHEN a IS NOT NULL THEN (coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / (0.5 + CASE WHEN b IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN c IS NOT NULL THEN 0.2 ELSE 0 END) END, 6) AS suitability FROM s""")
def available_evidence_score(spark, d):
    c = F.col("cell")
    s = cells(spark, d).select("cell", F.when(c % 3 != 0, (c % 11) / 10.0).alias("a"), F.when(c % 4 != 0, (c % 7) / 7.0).alias("b"), F.when(c % 6 != 0, (c % 13) / 13.0).alias("c"))
    return rounded(s.select("cell", rollup.available_score({"a": 0.5, "b": 0.3, "c": 0.2}, "a").alias("suitability")))


@query("""WITH m AS (SELECT o_custkey AS cell, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS barrier, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS partial, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS d, max(year(o_orderdate))::INT AS y FROM orders GROUP BY 1)
SELECT c_custkey AS cell, nullif(barrier, 0) AS barriers, nullif(partial, 0) AS partials, round(d, 6) AS nearest, y AS last_year, CASE WHEN n IS NULL THEN 'NO_MAPPED_RECORDS' WHEN barrier = 0 THEN 'PASSABLE' ELSE 'BARRIER' END AS state FROM customer LEFT JOIN m ON cell = c_custkey""")
def mouth_barrier_summary(spark, d):
    o, st = read(spark, d, "orders"), F.col("o_orderstatus")
    m = o.groupBy(F.col("o_custkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count_if(st == "F").alias("b"), F.count_if(st == "P").alias("p"), F.min(F.when(st == "F", F.col("o_totalprice"))).alias("nearest"), F.max(F.year("o_orderdate")).alias("last_year"))
    j = read(spark, d, "customer").select(F.col("c_custkey").alias("cell")).join(m, "cell", "left")
    state = F.when(F.col("n").isNull(), "NO_MAPPED_RECORDS").when(F.col("b") == 0, "PASSABLE").otherwise("BARRIER")
    return rounded(j.select("cell", F.nullif("b", F.lit(0)).alias("barriers"), F.nullif("p", F.lit(0)).alias("partials"), "nearest", "last_year", state.alias("state")))


# --- time ---------------------------------------------------------------------


@query(f"""WITH {EVIDENCE}, a AS (SELECT cell, count(DISTINCT year) AS surveyed_years, count(DISTINCT CASE WHEN present THEN year END) AS observed_years, min(CASE WHEN present THEN year END) AS first_year, max(CASE WHEN present THEN year END) AS last_year, max(year * 2 + CASE WHEN present THEN 0 ELSE 1 END) AS t, bool_or(NOT present) AS ab FROM evidence GROUP BY cell)
SELECT cell, surveyed_years, observed_years, first_year, last_year, 2000 - last_year AS recency, last_year BETWEEN 1996 AND 2000 AS recent, round(CASE WHEN ab THEN observed_years / surveyed_years::DOUBLE END, 6) AS persistence, CASE WHEN t % 2 = 1 THEN 'absent' ELSE 'present' END AS latest_state FROM a""")
def evidence_summary(spark, d):
    return rounded(temporal.evidence_summary(evidence(spark, d), "cell", "year", "present", 2000))


@query(f"WITH {EVIDENCE} SELECT record, cell, make_date(year, 1, 1) AS label FROM evidence WHERE year <= 1997")
def as_of_and_annual_labels(spark, d):
    e = evidence(spark, d).withColumn("available", F.col("year"))
    return temporal.as_of(e, 1997, "year", "available").select("record", "cell", temporal.annual_label("year").alias("label"))


@query("""SELECT DISTINCT s, e FROM (SELECT date_trunc('week', ts)::DATE AS s, date_trunc('week', ts)::DATE + 7 AS e FROM events) WHERE e > DATE '2024-01-08' AND s < DATE '2024-01-22'""")
def composite_periods(spark, d):
    p = read(spark, d, "events").select(F.to_date(F.date_trunc("week", "ts")).alias("s")).distinct().withColumn("e", F.date_add("s", 7))
    return p.where(temporal.overlaps(F.col("s"), F.col("e"), "2024-01-08", "2024-01-22")).select("s", "e")


@query("""WITH p AS (SELECT DISTINCT event_type, year(ts)::INT AS y, month(ts)::INT AS m, ts::DATE AS day FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09')
SELECT event_type, y, m, day, count(*) AS n, round(sum(value), 6) AS total FROM events JOIN p USING (event_type) WHERE ts::DATE = day GROUP BY ALL""")
def daily_history(spark, d):
    e = read(spark, d, "events").where((F.col("ts") >= F.to_timestamp(F.lit("2024-01-05"))) & (F.col("ts") < F.to_timestamp(F.lit("2024-01-09"))))
    return rounded(e.groupBy("event_type", F.year("ts").alias("y"), F.month("ts").alias("m"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query(f"""WITH {EVIDENCE}, y AS (SELECT DISTINCT year FROM evidence), m AS (SELECT cell, year, count(*) AS n FROM evidence GROUP BY 1, 2)
SELECT c_custkey AS cell, y.year, m.n FROM customer CROSS JOIN y LEFT JOIN m ON m.cell = c_custkey AND m.year = y.year""")
def annual_footprints(spark, d):
    e = evidence(spark, d)
    made = e.groupBy("cell", "year").agg(F.count(F.lit(1)).alias("n"))
    return temporal.skeleton(read(spark, d, "customer").select(F.col("c_custkey").alias("cell")), e.select("year").distinct(), made, ["cell", "year"])


@query("SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'early' WHEN ts < TIMESTAMP '2024-01-21' THEN 'middle' ELSE 'late' END AS era, count(*) AS n FROM events GROUP BY 1, 2")
def processing_eras(spark, d):
    t = F.col("ts")
    era = F.when(t < F.to_timestamp(F.lit("2024-01-11")), "early").when(t < F.to_timestamp(F.lit("2024-01-21")), "middle").otherwise("late")
    return read(spark, d, "events").groupBy("event_type", era.alias("era")).agg(F.count(F.lit(1)).alias("n"))


# --- intervals ----------------------------------------------------------------

_MERGED = """r AS (SELECT {keys}, x0, x1, max(x1) OVER (PARTITION BY {keys} ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE x1 > x0),
i AS (SELECT {keys}, x0, x1, sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM r),
u AS (SELECT {keys}, g, max(x1) - min(x0) AS len FROM i GROUP BY {keys}, g)"""


@query(f"WITH {SPANS}, {_MERGED.format(keys='cell, label')} SELECT cell, label, sum(len)::BIGINT AS length FROM u GROUP BY cell, label")
def line_union_length(spark, d):
    return intervals.union_length(spans(spark, d), ["cell", "label"], "x0", "x1")


@query(f"""WITH {SPANS}, {_MERGED.format(keys='cell, label')}, c AS (SELECT cell, sum(CASE WHEN label = 'A' THEN len END)::BIGINT AS "len_A", sum(CASE WHEN label = 'N' THEN len END)::BIGINT AS "len_N", sum(CASE WHEN label = 'R' THEN len END)::BIGINT AS "len_R", sum(len)::BIGINT AS al FROM u GROUP BY cell),
r2 AS (SELECT cell, x0, x1, max(x1) OVER (PARTITION BY cell ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE x1 > x0), i2 AS (SELECT cell, x0, x1, sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM r2),
t AS (SELECT cell, sum(len)::BIGINT AS mapped_len FROM (SELECT cell, g, max(x1) - min(x0) AS len FROM i2 GROUP BY cell, g) GROUP BY cell)
SELECT cell, mapped_len, "len_A", "len_N", "len_R", al - mapped_len AS overlap_len FROM t JOIN c USING (cell)""")
def shoreline_class_lengths(spark, d):
    return intervals.class_lengths(spans(spark, d), "cell", "x0", "x1", "label", ["A", "N", "R"])


_PIECES = """ends AS (SELECT DISTINCT cell, x FROM (SELECT cell, x0 AS x FROM sub UNION ALL SELECT cell, x1 FROM sub)),
p AS (SELECT cell, x AS a, lead(x) OVER (PARTITION BY cell ORDER BY x) AS b FROM ends)"""


def _dense(spark, d):
    """Spans of pixels (cell: part) so that a cell has some tens of records."""
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("cell"), F.col("l_linenumber").cast("long").alias("x0"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("x1"), F.year("l_shipdate").alias("year"), F.col("l_tax").alias("priority"), (F.col("l_returnflag") == "N").alias("absent"), F.col("l_discount").alias("fraction"))


_DENSE = "sub AS (SELECT l_partkey AS cell, l_linenumber::BIGINT AS x0, (l_linenumber + l_quantity)::BIGINT AS x1, year(l_shipdate)::INT AS year, l_tax AS priority, l_returnflag = 'N' AS absent, l_discount AS fraction FROM lineitem)"


@query(f"""WITH {_DENSE}, {_PIECES},
t AS (SELECT p.cell, a, b, max(struct_pack(y := year, q := priority, z := CASE WHEN absent THEN 1 ELSE 0 END)) AS m FROM p JOIN sub ON sub.cell = p.cell AND x0 <= a AND x1 >= b WHERE b IS NOT NULL GROUP BY 1, 2, 3)
SELECT cell, sum(CASE WHEN m.z = 0 THEN b - a ELSE 0 END)::BIGINT AS present_len, sum(CASE WHEN m.z = 1 THEN b - a ELSE 0 END)::BIGINT AS absent_len FROM t GROUP BY cell""")
def latest_evidence_overlay(spark, d):
    return intervals.latest_evidence(_dense(spark, d), ["cell"], "x0", "x1", "year", "priority", "absent")


@query(f"""WITH {_DENSE}, {_PIECES}, t AS (SELECT p.cell, a, b, max(fraction) AS f FROM p JOIN sub ON sub.cell = p.cell AND x0 <= a AND x1 >= b WHERE b IS NOT NULL GROUP BY 1, 2, 3)
SELECT cell, round(sum((b - a) * f), 6) AS weighted_len, round(sum(b - a)::DOUBLE, 6) AS surveyed_len, round(sum((b - a) * f) / sum(b - a), 6) AS fraction FROM t GROUP BY cell""")
def armoring_estimate(spark, d):
    return rounded(intervals.claimed_fraction(_dense(spark, d), ["cell"], "x0", "x1", "fraction"))


@query(f"""WITH {SPANS}, {_MERGED.format(keys='cell, label')}, c AS (SELECT cell, sum(CASE WHEN label = 'A' THEN len END) AS a, sum(CASE WHEN label = 'N' THEN len END) AS n, sum(CASE WHEN label = 'R' THEN len END) AS r, sum(len) AS al FROM u GROUP BY cell),
r2 AS (SELECT cell, x0, x1, max(x1) OVER (PARTITION BY cell ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE x1 > x0), i2 AS (SELECT cell, x0, x1, sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM r2),
t AS (SELECT cell, sum(len)::BIGINT AS mapped_len FROM (SELECT cell, g, max(x1) - min(x0) AS len FROM i2 GROUP BY cell, g) GROUP BY cell)
SELECT cell, mapped_len, al - mapped_len > greatest(1, mapped_len * 1e-8) AS withheld, {", ".join(f'round(CASE WHEN al - mapped_len <= greatest(1, mapped_len * 1e-8) THEN coalesce({c} / mapped_len::DOUBLE, 0) END, 6) AS "share_{c.upper()}"' for c in "anr")} FROM t JOIN c USING (cell)""")
def areal_fractions_with_conflict(spark, d):
    return rounded(intervals.areal_shares(spans(spark, d), "cell", "x0", "x1", "label", ["A", "N", "R"]))


# --- graph --------------------------------------------------------------------


@query(f"WITH {_hops(4)} SELECT * FROM hood")
def hop_neighbourhoods(spark, d):
    return graph.neighbourhoods(nodes(spark, d), lattice(spark, d), 4)


@query(f"""WITH RECURSIVE {LATTICE}, reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT a, dst FROM reach JOIN arcs ON src = b)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def connected_components(spark, d):
    return graph.components(nodes(spark, d), lattice(spark, d))


def _relax(rounds: int, seeds: str, group: str, limit: str = "") -> str:
    out = [LATTICE, f"d0 AS ({seeds})"]
    for k in range(1, rounds + 1):
        out.append(f"d{k} AS MATERIALIZED (SELECT {group}, min(v) AS v FROM (SELECT {group}, v FROM d{k - 1} UNION ALL SELECT {group.replace('node', 'a.dst AS node')}, v + a.w * 1000000 FROM d{k - 1} JOIN arcs a ON a.src = node {limit}) GROUP BY {group})")
    return ",\n".join(out)


@query(f"WITH {_relax(40, 'SELECT node, node AS v FROM nodes WHERE node % 17 = 3', 'node')} SELECT nodes.node, v // 1000000 AS dist, v % 1000000 AS owner FROM nodes LEFT JOIN d40 USING (node)")
def nearest_source_owner(spark, d):
    seeds = nodes(spark, d).where("node % 17 = 3").select("node", F.col("node").alias("owner"))
    return graph.nearest_owner(nodes(spark, d), lattice(spark, d), seeds)


_WITHIN = _relax(4, "SELECT node AS object, node, 0::BIGINT AS v FROM nodes", "object, node", "AND v + a.w * 1000000 <= 400 * 1000000")


@query(f"WITH {_WITHIN} SELECT object AS node, coalesce(sum(CASE WHEN node % 4 <> 0 THEN node % 9 END), 0)::BIGINT AS total FROM d4 GROUP BY object")
def network_radius_sum(spark, d):
    v = nodes(spark, d).select("node", (F.col("node") % 9).alias("value"), (F.col("node") % 4 != 0).alias("eligible"))
    return graph.radius_sum(nodes(spark, d), lattice(spark, d), v, 400)


_OUTLETS = "SELECT node AS object, node, 0::BIGINT AS v FROM nodes WHERE node % 23 = 5"


@query(f"""WITH RECURSIVE {_relax(4, _OUTLETS, 'object, node', 'AND v + a.w * 1000000 <= 400 * 1000000')}, reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT a, dst FROM reach JOIN arcs ON src = b), comp AS (SELECT a AS node, min(b) AS c FROM reach GROUP BY a)
SELECT o.node AS object, n.node, v // 1000000 AS dist, CASE WHEN v IS NOT NULL THEN 'reachable' WHEN x.c <> y.c THEN 'disconnected' ELSE 'search_limited' END AS status
FROM nodes n CROSS JOIN (SELECT node FROM nodes WHERE node % 23 = 5) o LEFT JOIN d4 ON d4.object = o.node AND d4.node = n.node JOIN comp x ON x.node = n.node JOIN comp y ON y.node = o.node""")
def outlet_relationships(spark, d):
    n, e = nodes(spark, d), lattice(spark, d)
    outlets = n.where("node % 23 = 5").select(F.col("node").alias("object"), "node")
    return graph.relationships(n, outlets, e, graph.components(n, e), 400)


@query("""SELECT p_partkey AS node, coalesce(c, 0) AS upstream, q.k IS NULL AND p_partkey > 1 AS gap FROM part p LEFT JOIN (SELECT p_partkey // 2 AS dn, count(*) AS c FROM part WHERE p_partkey > 1 GROUP BY 1) u ON u.dn = p_partkey LEFT JOIN (SELECT p_partkey AS k FROM part) q ON q.k = p.p_partkey // 2""")
def river_topology(spark, d):
    t = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).alias("down"))
    return graph.topology(t, "k", "down")


@query(f"""WITH RECURSIVE {LATTICE}, lab AS (SELECT node, (node // 3) % 4 AS label FROM nodes), same AS (SELECT a.src, a.dst FROM arcs a JOIN lab x ON x.node = a.src JOIN lab y ON y.node = a.dst WHERE x.label = y.label),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT a, dst FROM reach JOIN same ON src = b), comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a), size AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)
SELECT node, component, size FROM comp JOIN size USING (component)""")
def same_label_components(spark, d):
    n, e = nodes(spark, d), lattice(spark, d)
    lab = n.select("node", F.expr("(node div 3) % 4").alias("label"))
    same = e.join(lab.select(F.col("node").alias("src"), F.col("label").alias("l1")), "src").join(lab.select(F.col("node").alias("dst"), F.col("label").alias("l2")), "dst").where("l1 = l2")
    c = graph.components(n, same.select("src", "dst", "w"))
    return c.join(c.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")


# --- windows ------------------------------------------------------------------


@query(f"WITH {_hops(2)}, {VALUES} SELECT hood.src AS node, round(any_value(f.z) - avg(v.z), 6) AS anomaly FROM hood JOIN vals v ON v.node = hood.dst JOIN vals f ON f.node = hood.src WHERE hops BETWEEN 1 AND 2 GROUP BY 1")
def focal_anomaly(spark, d):
    return rounded(focal.anomaly(graph.neighbourhoods(nodes(spark, d), lattice(spark, d), 2), values(spark, d), 2))


@query(f"""WITH {_hops(2)}, {VALUES}, w AS (SELECT hood.src, hops, v.z, f.z AS fz FROM hood JOIN vals v ON v.node = hood.dst JOIN vals f ON f.node = hood.src),
a AS (SELECT src, any_value(fz) AS fz, count(CASE WHEN hops > 0 THEN 1 END) AS n, avg(CASE WHEN hops > 0 THEN z END) - any_value(fz) AS tpi, stddev_pop(z) AS std, max(z) - min(z) AS range, max(abs(z - fz)) AS relief, avg(CASE WHEN hops > 0 THEN abs(z - fz) END) AS ruggedness, median(z) AS m FROM w GROUP BY src),
q AS (SELECT w.src, median(abs(z - m)) AS mad FROM w JOIN a USING (src) GROUP BY 1)
SELECT src AS node, n, round(tpi, 6) AS tpi, round(CASE WHEN std > 1e-9 THEN tpi / std WHEN abs(tpi) <= 1e-9 THEN 0.0 END, 6) AS tpi_z, round(std, 6) AS std, round(range, 6) AS range, round(relief, 6) AS relief, round(ruggedness, 6) AS ruggedness, round(mad, 6) AS mad FROM a JOIN q USING (src)""")
def ring_statistics(spark, d):
    return rounded(focal.ring_statistics(graph.neighbourhoods(nodes(spark, d), lattice(spark, d), 2), values(spark, d), 2))


@query(f"""WITH {_hops(1)}, {VALUES}, w AS (SELECT src, z - avg(z) OVER s AS z, x - avg(x) OVER s AS x, y - avg(y) OVER s AS y FROM (SELECT hood.src, v.z, (dst % 10)::DOUBLE AS x, (dst // 10)::DOUBLE AS y FROM hood JOIN vals v ON v.node = dst) WINDOW s AS (PARTITION BY src)),
q AS (SELECT src, count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * z) AS xz, sum(y * z) AS yz FROM w GROUP BY src),
g AS (SELECT src, CASE WHEN n > 3 AND xx * yy - xy * xy > 1e-12 THEN (xz * yy - yz * xy) / (xx * yy - xy * xy) END AS gx, CASE WHEN n > 3 AND xx * yy - xy * xy > 1e-12 THEN (yz * xx - xz * xy) / (xx * yy - xy * xy) END AS gy FROM q)
SELECT src AS node, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope, round(CASE WHEN sqrt(gx * gx + gy * gy) > 1e-12 THEN CASE WHEN degrees(atan2(gx, gy)) < 0 THEN degrees(atan2(gx, gy)) + 360 ELSE degrees(atan2(gx, gy)) END END, 6) AS aspect, round(gx, 6) AS gx, round(gy, 6) AS gy FROM g""")
def plane_slope_aspect(spark, d):
    v = values(spark, d).withColumns({"x": (F.col("node") % 10).cast("double"), "y": F.expr("cast(node div 10 as double)")})
    return rounded(focal.plane(graph.neighbourhoods(nodes(spark, d), lattice(spark, d), 1), v, 1))


# --- nearest ------------------------------------------------------------------

_NEAR = """near AS (SELECT p.id, m.id AS other, sqrt((p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y)) AS dist, weight FROM points p JOIN mouths m ON abs(p.x - m.x) <= {r} AND abs(p.y - m.y) <= {r})"""


@query(f"""WITH {POINTS}, {MOUTHS}, {_NEAR.format(r=800)}, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM near WHERE dist <= 800) SELECT points.id, b.other, round(b.dist, 6) AS dist FROM points LEFT JOIN b ON b.id = points.id AND k = 1""")
def nearest_with_limit(spark, d):
    return rounded(nearest.nearest(points(spark, d), mouths(spark, d), 800.0))


@query(f"""WITH {POINTS}, {MOUTHS}, {_NEAR.format(r=1500)}, b AS (SELECT id, other, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other)::INT AS rank FROM near WHERE dist <= 1500) SELECT id, other, round(dist, 6) AS dist, rank FROM b WHERE rank <= 4""")
def k_nearest_candidates(spark, d):
    return rounded(nearest.k_nearest(points(spark, d), mouths(spark, d), 1500.0, 4))


@query(f"""WITH {POINTS}, {MOUTHS}, {_NEAR.format(r=1000)} SELECT points.id, round(coalesce(t, 0), 6) AS total FROM points LEFT JOIN (SELECT id, sum(weight * exp(-dist / 250.0)) AS t FROM near WHERE dist <= 1000 GROUP BY id) USING (id)""")
def mouth_pressure_kernel(spark, d):
    return rounded(nearest.kernel_sum(points(spark, d), mouths(spark, d), 1000.0, 250.0))


@query(f"""WITH {POINTS}, b AS (SELECT a.id, c.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY c.priority DESC, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)), c.id) AS k FROM points a JOIN points c ON a.class = c.class AND c.priority > a.priority AND abs(a.x - c.x) <= 200 AND abs(a.y - c.y) <= 200 WHERE sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) <= 200)
SELECT points.id, coalesce(b.other, points.id) AS canonical FROM points LEFT JOIN b ON b.id = points.id AND k = 1""")
def priority_duplicates(spark, d):
    return nearest.duplicates(points(spark, d), 200.0)


# --- vectors, rules, lines ----------------------------------------------------

_RAYS = "rays AS (SELECT vec_id, list_transform(range(1, 17), lambda i: abs(embedding[i])::DOUBLE * 20000) AS r FROM embeddings), ax AS (SELECT vec_id, r, list_transform(range(1, 9), lambda i: r[i] + r[i + 8]) AS a FROM rays)"


@query(f"""WITH {_RAYS} SELECT vec_id, round(list_min(a), 4) AS width_min, round(list_avg(a), 4) AS width_mean, round(list_stddev_pop(a), 4) AS width_std, (list_position(a, list_min(a)) - 1)::INT AS narrow_bearing, round(list_avg(r), 4) AS fetch_mean, round(list_max(r), 4) AS fetch_max,
round(least(1, list_avg(r) / 10000), 4) AS openness, round(1 - least(1, list_avg(r) / 10000), 4) AS enclosure, round(least(1, greatest(0, list_max(r) / 10000 - least(1, list_avg(r) / 10000))), 4) AS embayment, round(len(list_filter(r, lambda x: x >= 9000)) * 22.5::DOUBLE, 4) AS aperture, round(len(list_filter(r, lambda x: x >= 10000)) / 16.0::DOUBLE, 4) AS censored FROM ax""")
def sixteen_bearing_metrics(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda x: F.abs(x).cast("double") * 20000).alias("r"))
    return rounded(e.select("vec_id", *(c.alias(k) for k, c in vectors.ray_metrics("r", 16, 10000.0).items())), 4)


@query("""WITH a AS (SELECT l_suppkey AS cell, avg(sin(radians(l_quantity * 7.0::DOUBLE))) AS s, avg(cos(radians(l_quantity * 7.0::DOUBLE))) AS c FROM lineitem GROUP BY 1)
SELECT cell, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 6) AS direction, round(sqrt(s * s + c * c), 6) AS resultant FROM a""")
def circular_aspect(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.col("l_quantity") * 7.0).alias("a"))
    turn, length = vectors.circular_mean("a")
    return rounded(li.groupBy("cell").agg(turn.alias("direction"), length.alias("resultant")))


@query("""WITH p AS (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS z, (p_retailprice % 50) AS s FROM part),
q AS (SELECT id, least(1, greatest(0, (z - 1) / 3)) * 0.6 + least(1, greatest(0, (s - 5) / 20)) * 0.4 AS ridge, ((1 - least(1, greatest(0, (z - 1) / 3))) * 0.7 + least(1, greatest(0, (s - 10) / 30)) * 0.3) AS basin, (1 - least(1, greatest(0, (s - 5) / 20))) * 1.0 AS flat FROM p),
l AS (SELECT id, list_sort([struct_pack(s := ridge, p := 0, n := 'ridge'), struct_pack(s := basin, p := -1, n := 'basin'), struct_pack(s := flat, p := -2, n := 'flat')], 'DESC') AS o FROM q)
SELECT id, CASE WHEN o[1].s > 0 THEN o[1].n END AS label, round(o[1].s, 6) AS top, round(CASE WHEN o[1].s > 0 THEN least(1, greatest(0, 0.55 * o[1].s + 0.45 * greatest(0, o[1].s - o[2].s))) ELSE 0 END, 6) AS confidence FROM l""")
def geomorphic_labels(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10.0).alias("z"), (F.col("p_retailprice") % 50).alias("s"))
    z, s = F.col("z"), F.col("s")
    label, top, conf = classify.best_label([
        ("ridge", classify.score([(0.6, classify.rise(z, 1, 4)), (0.4, classify.rise(s, 5, 25))])),
        ("basin", classify.score([(0.7, classify.fall(z, 1, 4)), (0.3, classify.rise(s, 10, 40))])),
        ("flat", classify.score([(1.0, classify.fall(s, 5, 25))])),
    ])
    return rounded(p.select("id", label.alias("label"), top.alias("top"), conf.alias("confidence")))


@query("""SELECT p_partkey AS id, CASE WHEN p_size IS NULL THEN 'NO_SIZE' WHEN p_size < 5 THEN 'TOO_SMALL' WHEN p_retailprice > 1800 THEN 'TOO_DEAR' END AS reason, nullif(trim(p_type), '') AS kind,
CASE WHEN lower(p_type) LIKE '%culvert%' OR p_type LIKE '%TIN%' THEN 'culvert' WHEN regexp_matches(p_type, '\\bSTEEL\\b') THEN 'dam' ELSE 'natural' END AS barrier, regexp_replace(regexp_replace('F_RING_' || p_size || '_' || p_size || 'KM', '_RING_[0-9]+', '_SCALE'), '_[0-9]+KM', '_SCALE') AS scale FROM part""")
def reason_and_code_rules(spark, d):
    t = F.col("p_type")
    barrier = F.when(F.lower(t).contains("culvert") | t.contains("TIN"), "culvert").when(t.rlike(r"\bSTEEL\b"), "dam").otherwise("natural")
    p = read(spark, d, "part").withColumn("name", F.concat(F.lit("F_RING_"), "p_size", F.lit("_"), "p_size", F.lit("KM")))
    reason = classify.first_reason([("NO_SIZE", F.col("p_size").isNull()), ("TOO_SMALL", F.col("p_size") < 5), ("TOO_DEAR", F.col("p_retailprice") > 1800)])
    return p.select(F.col("p_partkey").alias("id"), reason.alias("reason"), classify.text_or_null("p_type").alias("kind"), barrier.alias("barrier"), classify.scale_group("name").alias("scale"))


_LINES = "lines AS (SELECT o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT * 20 AS pos, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 60)::DOUBLE END AS depth FROM orders)"


def _lines(spark, d):
    from pyspark.sql import Window as W

    return read(spark, d, "orders").select(F.col("o_custkey").alias("line"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) * 20).alias("pos"), F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_orderkey") % 60).cast("double")).alias("depth"))


@query(f"""WITH {_LINES}, p AS (SELECT line, pos, depth AS a, lead(depth) OVER w AS b, lead(pos) OVER w - pos AS l, lead(pos) OVER w AS np FROM lines WINDOW w AS (PARTITION BY line ORDER BY pos)),
q AS (SELECT line, pos, a IS NOT NULL AND b IS NOT NULL AS ok, a >= 25 AND b >= 25 AS deep, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN l * (a + b) / 2 END AS area, CASE WHEN a >= 25 AND b >= 25 THEN l WHEN a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) >= 25 THEN l * (greatest(a, b) - 25) / (greatest(a, b) - least(a, b)) ELSE 0 END AS wd, l FROM p WHERE np IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN coalesce(deep, false) AND ok THEN 0 ELSE 1 END) OVER (PARTITION BY line ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM q),
lr AS (SELECT line, max(s) AS longest FROM (SELECT line, g, sum(CASE WHEN coalesce(deep, false) AND ok THEN l ELSE 0 END) AS s FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT line, round(sum(area), 6) AS valid_area, round(CASE WHEN bool_and(ok) THEN sum(area) END, 6) AS area, round(sum(wd), 6) AS deep_width, round(any_value(longest)::DOUBLE, 6) AS longest_run FROM r JOIN lr USING (line) GROUP BY line""")
def passage_section(spark, d):
    return rounded(sequence.section(_lines(spark, d), "line", "pos", "depth", 25.0))


@query(f"""WITH {_LINES}, p AS (SELECT *, lag(depth) OVER w AS pd, lag(pos) OVER w AS pp FROM lines WINDOW w AS (PARTITION BY line ORDER BY pos)),
q AS (SELECT line, min(CASE WHEN depth IS NULL THEN pos END) AS gap, min(CASE WHEN depth >= 40 THEN pos END) AS hp, min_by(CASE WHEN pd IS NULL THEN pos ELSE pp + coalesce((40 - pd) / nullif(depth - pd, 0), 0) * (pos - pp) END, pos) FILTER (WHERE depth >= 40) AS hit_at FROM p GROUP BY line)
SELECT line, round(CASE WHEN gap IS NULL OR gap >= hp THEN hit_at::DOUBLE END, 6) AS "at", CASE WHEN gap IS NOT NULL AND (hp IS NULL OR gap < hp) THEN 'stopped' WHEN hp IS NULL THEN 'not_reached' ELSE 'crossed' END AS status FROM q""")
def first_threshold_crossing(spark, d):
    return rounded(sequence.first_crossing(_lines(spark, d), "line", "pos", "depth", 40.0))


@query(f"WITH {_LINES}, p AS (SELECT *, lag(depth) OVER w AS a, lead(depth) OVER w AS b FROM lines WINDOW w AS (PARTITION BY line ORDER BY pos)) SELECT line, pos, depth FROM p WHERE a - depth >= 5 AND b - depth >= 5")
def sill_local_minima(spark, d):
    return sequence.local_minima(_lines(spark, d), "line", "pos", "depth", 5.0)


@query(f"WITH {_LINES}, p AS (SELECT line, sqrt((lead(pos) OVER w - pos) * (lead(pos) OVER w - pos) + (lead(depth) OVER w - depth) * (lead(depth) OVER w - depth)) AS c FROM lines WINDOW w AS (PARTITION BY line ORDER BY pos)) SELECT line, round(avg(20 / c), 6) AS sinuosity FROM p WHERE c > 0 GROUP BY line")
def local_sinuosity(spark, d):
    return rounded(sequence.sinuosity(_lines(spark, d), "line", "pos", "pos", "depth", 20.0))


# --- contracts and delivery ---------------------------------------------------


@query(f"""WITH {CELLS}, s AS (SELECT cell FROM cells WHERE cell % 3 <> 0), t AS (SELECT DISTINCT o_custkey AS cell FROM orders)
SELECT cell, 'missing' AS side FROM s ANTI JOIN t USING (cell) UNION ALL SELECT cell, 'unexpected' FROM t ANTI JOIN s USING (cell)""")
def support_mismatch_report(spark, d):
    t = read(spark, d, "orders").select(F.col("o_custkey").alias("cell"))
    return contracts.support_report(t, cells(spark, d).where("cell % 3 <> 0"), ["cell"])


@query(f"""WITH {CELLS} SELECT count(*) AS n_rows, 0::BIGINT AS n_null_keys, count(*) - count(DISTINCT cell) AS n_repeated, count(CASE WHEN value / 50 < 0 OR value / 50 > 1 THEN 1 END) AS share_out, 0::BIGINT AS weight_nonfinite FROM cells""")
def product_audit(spark, d):
    return contracts.audit(cells(spark, d).withColumn("share", F.col("value") / 50), ["cell"], ["share"], ["weight"])


@query("SELECT sha256(string_agg(DISTINCT c_custkey::VARCHAR, chr(10) ORDER BY c_custkey::VARCHAR)) AS key_hash FROM customer")
def key_set_hash(spark, d):
    return contracts.key_hash(read(spark, d, "customer"), "c_custkey")


@query("SELECT count(CASE WHEN b.k IS NULL THEN 1 END) AS only_left, count(CASE WHEN a.k IS NULL THEN 1 END) AS only_right, count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND abs(a.v - b.v) > 0.5 THEN 1 END) AS n_differ FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 7 <> 0) a FULL JOIN (SELECT c_custkey AS k, c_acctbal + (c_custkey % 3) * 0.4 AS v FROM customer WHERE c_custkey % 11 <> 0) b ON a.k = b.k")
def table_parity(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return contracts.parity(c.where("k % 7 <> 0"), c.where("k % 11 <> 0").withColumn("v", F.col("v") + (F.col("k") % 3) * 0.4), ["k"], "v", 0.5)
