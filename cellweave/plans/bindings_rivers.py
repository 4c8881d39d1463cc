"""Bindings of river forests, network ends, mouths and outlines of pixels: parts are segments, line items flow records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlay, rivers
from .bindings import query, read, rounded


def _segments(spark, d):
    """Parts that drain to the one at two thirds of their number; a few drain to unknown ones."""
    p = read(spark, d, "part")
    k = F.col("p_partkey") + 1
    down = F.when(k % 97 == 5, -k).otherwise(F.expr("(p_partkey + 1) * 2 div 3"))
    return p.select(k.alias("id"), down.alias("next"), F.col("p_size").alias("km"))


_SEGMENTS = """s AS (SELECT p_partkey + 1 AS id, CASE WHEN (p_partkey + 1) % 97 = 5 THEN -p_partkey - 1 ELSE (p_partkey + 1) * 2 // 3 END AS next, p_size AS km FROM part)"""
_WALK = f"""{_SEGMENTS}, way AS (
  SELECT id AS node, id AS spot, next, km, 0 AS steps, 0::BIGINT AS down_km FROM s
  UNION ALL SELECT w.node, s.id, s.next, s.km, w.steps + 1, w.down_km + w.km FROM way w JOIN s ON s.id = w.next),
ends AS (SELECT w.* FROM way w LEFT JOIN s z ON z.id = w.next WHERE z.id IS NULL),
ups AS (SELECT spot AS node, count(*) AS up_count, sum(s.km)::BIGINT AS up_km FROM way JOIN s ON s.id = way.node GROUP BY spot),
direct AS (SELECT next AS node, count(*) AS n FROM s GROUP BY next)"""


@query(f"""WITH RECURSIVE {_WALK}
SELECT e.node, e.spot AS outlet, e.steps::BIGINT AS steps, CASE WHEN e.next = 0 THEN 'outlet' ELSE 'gap' END AS status, e.down_km, up_km, up_count, coalesce(n, 0) AS direct_upstream
FROM ends e JOIN ups USING (node) LEFT JOIN direct ON direct.node = e.node""")
def river_outlets(spark, d):
    """Every segment's outlet, steps and kilometres to it, and what drains into it."""
    return rivers.drained(_segments(spark, d), "id", "next", ["km"], no_down=0)


@query(f"""WITH RECURSIVE {_WALK}
SELECT e.spot AS outlet, count(*) AS segments, count(*) FILTER (WHERE n >= 2) AS junctions, count(*) FILTER (WHERE n IS NULL) AS headwaters, sum(s.km)::BIGINT AS length, CASE WHEN min(e.next) = 0 THEN 'outlet' ELSE 'gap' END AS status
FROM ends e JOIN s ON s.id = e.node LEFT JOIN direct ON direct.node = e.node GROUP BY e.spot""")
def river_trees(spark, d):
    s = _segments(spark, d)
    return rivers.tree_summaries(s, rivers.drained(s, "id", "next", ["km"], no_down=0), "id", "km")


@query("""WITH f AS (SELECT CASE WHEN l_returnflag = 'A' THEN 713 ELSE 709 END AS direction, l_partkey::VARCHAR AS o, CASE WHEN l_linenumber % 3 = 0 THEN '0' ELSE l_suppkey::VARCHAR END AS r FROM lineitem WHERE l_quantity > 40),
e AS (SELECT o, bool_or(direction = 713 AND r = '0') AS fin, bool_or(direction = 709 AND r <> '0') AS onward FROM f GROUP BY o),
l AS (SELECT o_orderkey AS row_id, (o_custkey // 3 * 2)::VARCHAR AS id, o_orderstatus AS status FROM orders WHERE o_custkey >= 3),
g AS (SELECT id, count(DISTINCT status) AS n, count(*) AS members, min(status) AS status FROM l GROUP BY id)
SELECT id AS feature_id, status, CASE WHEN fin AND NOT onward THEN 1 WHEN onward AND NOT fin THEN 0 END AS terminal, members,
  CASE WHEN n > 1 THEN 'quarantined' WHEN fin AND onward THEN 'conflicting_network_end_and_downstream_flow' WHEN fin THEN 'documented_network_end_713_to_zero' WHEN onward THEN 'documented_downstream_flow' ELSE 'unknown_no_qualifying_flow_record' END AS terminal_qc
FROM (SELECT id, n, members, CASE WHEN n = 1 THEN status END AS status, CASE WHEN n = 1 THEN fin END AS fin, CASE WHEN n = 1 THEN onward END AS onward FROM g LEFT JOIN e ON e.o = g.id)""")
def network_ends(spark, d):
    """Orders as source rows of features with braces around their ids, line items as the flow table; quarantined ids are counted too."""
    o = read(spark, d, "orders").where("o_custkey >= 3")
    lines = o.select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("{"), F.expr("o_custkey div 3 * 2").cast("string"), F.lit("} ")).alias("feature_id"), F.col("o_orderstatus").alias("status"))
    li = read(spark, d, "lineitem").where("l_quantity > 40")
    flow = li.select(F.when(F.col("l_returnflag") == "A", 713).otherwise(709).alias("direction"), F.concat(F.lit(" {"), F.col("l_partkey").cast("string"), F.lit("}")).alias("from_id"), F.when(F.col("l_linenumber") % 3 == 0, "0").otherwise(F.col("l_suppkey").cast("string")).alias("to_id"))
    good, bad = rivers.network_ends(lines, flow, ["status"])
    good = good.select("feature_id", "status", "terminal", F.size(F.from_json("members", "array<string>")).cast("long").alias("members"), "terminal_qc")
    held = bad.groupBy(F.regexp_replace(F.trim("feature_id"), "[{}]", "").alias("feature_id")).agg(F.count(F.lit(1)).alias("members"))
    return good.unionByName(held.select("feature_id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("terminal"), "members", F.lit("quarantined").alias("terminal_qc")))


@query("""WITH l AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 1009)::DOUBLE AS x, ((s_suppkey * 104729) % 1013)::DOUBLE AS y FROM supplier),
c AS (SELECT p_partkey AS id, ((p_partkey * 3571) % 1009)::DOUBLE AS x, ((p_partkey * 2903) % 1013)::DOUBLE AS y FROM part)
SELECT *, 'local' AS source FROM l UNION ALL SELECT *, 'coarse' FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE (l.x - c.x) ** 2 + (l.y - c.y) ** 2 <= 400)""")
def deduplicated_mouths(spark, d):
    at = lambda t, k, a, b: read(spark, d, t).select(F.col(k).alias("id"), ((F.col(k) * a) % 1009).cast("double").alias("x"), ((F.col(k) * b) % 1013).cast("double").alias("y"))
    return rivers.mouths(at("supplier", "s_suppkey", 7919, 104729), at("part", "p_partkey", 3571, 2903), 20.0)


@query("""WITH p AS (SELECT (p_partkey - 1) // 40 AS row, (p_partkey - 1) % 40 AS col, CASE WHEN p_size % 4 <> 0 THEN p_size % 3 END AS label FROM part),
sides AS (SELECT label, row, col, count(*) AS n FROM (SELECT label, unnest([row, row + 1, row, row]) AS row, unnest([col, col, col, col + 1]) AS col, unnest([0, 0, 1, 1]) AS up FROM p WHERE label IS NOT NULL) GROUP BY label, row, col, up HAVING count(*) = 1),
area AS (SELECT label, count(*)::DOUBLE AS area FROM p WHERE label IS NOT NULL GROUP BY label)
SELECT a.label, area, (SELECT count(*) FROM sides WHERE sides.label = a.label)::DOUBLE AS perimeter FROM area a""")
def polygonised_outlines(spark, d):
    """Outlines of pixels by label: the area within all rings of a label, and their length."""
    p = read(spark, d, "part")
    pixels = p.select(F.expr("(p_partkey - 1) div 40").alias("row"), ((F.col("p_partkey") - 1) % 40).alias("col"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 3).alias("label"))
    length = F.expr("aggregate(transform(sequence(0, size(ring) - 1), i -> hypot(ring[(i + 1) % size(ring)].x - ring[i].x, ring[(i + 1) % size(ring)].y - ring[i].y)), 0.0D, (a, b) -> a + b)")
    return rounded(overlay.polygonised(pixels, "label").groupBy("label").agg(F.sum("area").alias("area"), F.sum(length).alias("perimeter")))
