"""Bindings of selections, interval and as-of joins, rays, gates and small validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import graph
from ..sources import cells as cell_ids
from .bindings import LATTICE, NODES, _relax, lattice, nodes, query, read, rounded


@query("""SELECT o_orderkey AS record, 'kelp_' || lower(substr(o_orderpriority, 1, 1)) AS dataset, round(o_totalprice / 300000, 6) AS share FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3') AND o_orderstatus <> 'P' AND o_custkey % 3 <> 0 AND o_totalprice / 300000 <= 1 AND o_totalprice > 0 AND coalesce(o_orderstatus = 'F', false)""")
def eligible_extents(spark, d):
    o = read(spark, d, "orders")
    made = o.select(F.col("o_orderkey").alias("record"), F.concat(F.lit("kelp_"), F.lower(F.substring("o_orderpriority", 1, 1))).alias("dataset"), F.when(F.col("o_orderstatus") == "P", "inferred").otherwise("observed").alias("state"), (F.col("o_orderstatus") == "F").alias("present"), F.when(F.col("o_custkey") % 3 == 0, "line").otherwise("polygon").alias("kind"), (F.col("o_totalprice") / 300000).alias("share"))
    return rounded(ev.eligible_extents(made, "^kelp_[123]$").select("record", "dataset", "share"))


@query("""WITH t AS (SELECT c_custkey AS cell FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT -c_custkey FROM customer WHERE c_acctbal > 9000),
n AS (SELECT cell, count(*) AS n FROM t GROUP BY cell) SELECT coalesce(c_custkey, cell) AS cell, CASE WHEN n IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'outside' ELSE 'repeated' END AS fault FROM customer FULL JOIN n ON cell = c_custkey WHERE n IS NULL OR c_custkey IS NULL OR n > 1""")
def role_support_faults(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "cell")
    t = c.where("c_mktsegment <> 'BUILDING'").select("cell").union(c.where("c_mktsegment = 'MACHINERY'").select("cell")).union(c.where("c_acctbal > 9000").select(-F.col("cell")))
    return ev.consumed(t, c.select("cell"), ["cell"])


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 1.5 WHEN s_suppkey % 8 = 0 THEN s_suppkey * 2.5 ELSE s_suppkey * 3.5 END::DOUBLE AS x, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 0.5 WHEN s_suppkey % 8 = 0 THEN s_suppkey * 0.25 ELSE s_suppkey * 0.75 END::DOUBLE AS y,
CASE WHEN s_suppkey % 4 <> 0 THEN 'focal' WHEN s_suppkey % 8 = 0 THEN 'connector' ELSE 'centre' END AS origin FROM supplier""")
def ray_origin_selection(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(k.alias("id"), F.when(k % 4 != 0, k * 1.5).alias("px"), F.when(k % 4 != 0, k * 0.5).alias("py"), F.when(k % 8 == 0, k * 2.5).alias("tx"), (k * 0.25).alias("ty"), (k * 3.5).alias("cx"), (k * 0.75).alias("cy"))
    return ev.ray_origins(s)


@query("""WITH l AS (SELECT l_suppkey AS parent, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS rock, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS sand, l_quantity AS mapped FROM lineitem), s AS (SELECT parent, sum(rock) AS rock, sum(sand) AS sand, sum(mapped) AS mapped FROM l GROUP BY parent)
SELECT parent, round(rock::DOUBLE, 6) AS rock, round(sand::DOUBLE, 6) AS sand, round(mapped::DOUBLE, 6) AS mapped, round(rock / mapped, 6) AS rock_share, round(sand / mapped, 6) AS sand_share FROM s""")
def parent_shoreline_lengths(spark, d):
    q = F.col("l_quantity").cast("double")
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("parent"), F.when(F.col("l_returnflag") == "A", q).alias("rock"), F.when(F.col("l_returnflag") == "R", q).alias("sand"), q.alias("mapped"))
    return rounded(ev.parent_lengths(li, "parent", ["rock", "sand"], "mapped"))


@query("""WITH p AS (SELECT l_suppkey AS cell, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1), f AS (SELECT s_suppkey AS cell, s_acctbal / 10 AS a FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(p.cell, f.cell) AS cell, coalesce(n, 0) AS n_positive, round(coalesce(n, 0) * 2.0::DOUBLE, 6) AS pixel_area, round(a, 6) AS footprint_area, coalesce(n, 0) * 2.0 <= coalesce(a, 0) + 2.0 AS within FROM p FULL JOIN f USING (cell)""")
def positive_pixels_in_footprint(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.col("l_discount") - 0.05).alias("value")).withColumn("value", F.round("value", 6))
    f = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("cell"), (F.col("s_acctbal") / 10).alias("footprint_area"))
    return rounded(ev.positive_pixels(p, f, "cell", 2.0))


@query("""SELECT o_custkey AS cell, 'orders' AS source, year(o_orderdate)::INT AS start, (year(o_orderdate) + 1)::INT AS "end", o_orderstatus AS state, NULL::BIGINT AS line FROM orders UNION ALL SELECT l_suppkey, 'items', year(l_shipdate)::INT, (year(l_shipdate) + 2)::INT, NULL, l_linenumber FROM lineitem""")
def combined_composites(spark, d):
    y, z = F.year("o_orderdate"), F.year("l_shipdate")
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("cell"), y.alias("start"), (y + 1).alias("end"), F.col("o_orderstatus").alias("state"))
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), z.alias("start"), (z + 2).alias("end"), F.col("l_linenumber").cast("long").alias("line"))
    return ev.combined({"orders": o, "items": li}, ["cell"]).select("cell", "source", "start", "end", "state", "line")


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS cell, datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS s FROM orders), b AS (SELECT event_id AS id, user_id AS cell, (event_id * 37) % 2500 AS s FROM events)
SELECT a.cell, a.id AS request, b.id AS period FROM a JOIN b ON a.cell = b.cell AND a.s < b.s + 120 AND b.s < a.s + 90""")
def interval_overlap_join(spark, d):
    s = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("id"), s.alias("start"), (s + 90).alias("end"))
    t = (F.col("event_id") * 37) % 2500
    b = read(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("event_id").alias("id"), t.alias("start"), (t + 120).alias("end"))
    return ev.overlapping(a, b, ["cell"], 120)


@query("""WITH r AS (SELECT user_id AS cell, (event_id * 37) % 2500 AS at, max(value) AS v FROM events GROUP BY 1, 2), l AS (SELECT o_orderkey AS id, o_custkey AS cell, datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS at FROM orders)
SELECT l.id, l.cell, l.at, round(r.v, 6) AS value FROM l ASOF LEFT JOIN r ON l.cell = r.cell AND l.at >= r.at""")
def as_of_join(spark, d):
    left = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cell"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("at"))
    right = read(spark, d, "events").select(F.col("user_id").alias("cell"), ((F.col("event_id") * 37) % 2500).alias("at"), "value")
    return rounded(ev.as_of(left, right, "cell", "at", "value"))


_REACH = _relax(4, "SELECT node AS object, node, 0::BIGINT AS v FROM nodes", "object, node", "AND v + a.w * 1000000 <= 400 * 1000000")


@query(f"""WITH {_REACH}, s AS (SELECT p_partkey % 100 AS node, sum(greatest(1, coalesce(CASE WHEN p_size % 4 <> 0 THEN p_size % 3 END, 1))) AS n FROM part GROUP BY 1)
SELECT object AS node, coalesce(sum(n), 0)::BIGINT AS structures, round(count(*) * 2.5::DOUBLE, 6) AS area_km2, round(coalesce(sum(n), 0) / (count(*) * 2.5::DOUBLE), 6) AS density FROM d4 LEFT JOIN s ON s.node = d4.node GROUP BY object""")
def structure_density_in_reach(spark, d):
    within = graph.distances(lattice(spark, d), nodes(spark, d).select(F.col("node").alias("object"), "node"), 400)
    s = read(spark, d, "part").select((F.col("p_partkey") % 100).alias("node"), F.when(F.col("p_size") % 4 != 0, (F.col("p_size") % 3)).alias("count"))
    return rounded(ev.structure_density(within, s, 2.5))


@query(f"""WITH {_REACH}, b AS (SELECT n.node, o.node AS object, v // 1000000 AS way, 120.0::DOUBLE * greatest(abs(n.node % 10 - o.node % 10), abs(n.node // 10 - o.node // 10)) AS straight FROM nodes n JOIN nodes o ON abs(n.node - o.node) <= 21 LEFT JOIN d4 ON d4.object = o.node AND d4.node = n.node)
SELECT node, object, round(CASE WHEN way IS NOT NULL THEN greatest(way::DOUBLE, straight) END, 6) AS bounded, round(CASE WHEN way >= straight - 1e-6 THEN greatest(1.0, way / greatest(straight, 50)) END, 6) AS ratio, CASE WHEN way IS NULL THEN 'unreachable' WHEN way < straight - 1e-6 THEN 'metric_inconsistency' ELSE 'reachable' END AS status FROM b""")
def network_against_straight_line(spark, d):
    n = nodes(spark, d)
    # pairs of nodes at most two rows apart: each node names the places around it
    near = n.select("node", F.explode(F.sequence(F.col("node") - 21, F.col("node") + 21)).alias("object")).join(n.select(F.col("node").alias("object")), "object")
    within = graph.distances(lattice(spark, d), n.select(F.col("node").alias("object"), "node"), 400)
    straight = F.expr("120.0D * greatest(abs(node % 10 - object % 10), abs(node div 10 - object div 10))")
    j = near.join(within, ["object", "node"], "left").withColumn("straight", straight)
    return rounded(j.select("node", "object", ev.bounded_distance(F.col("dist"), F.col("straight")).alias("bounded"), ev.detour_status(F.col("dist"), F.col("straight"), 50.0).alias("x")).select("node", "object", "bounded", "x.*"))


@query("""WITH wet AS (SELECT (p_partkey - 1) // 40 AS row, (p_partkey - 1) % 40 AS col FROM part WHERE round(p_retailprice * 100)::BIGINT % 7 < 5), o AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 40 + 0.5) * 10 AS x, (s_suppkey * 3 % 50 + 0.5) * 10 AS y FROM supplier),
t AS (SELECT id, b AS bearing, k, floor(round(x + k * 5.0::DOUBLE * sin(radians(b * 22.5::DOUBLE)), 6) / 10)::BIGINT AS col, floor(round(y + k * 5.0::DOUBLE * cos(radians(b * 22.5::DOUBLE)), 6) / 10)::BIGINT AS row FROM o, (SELECT unnest(range(0, 16)) AS b), (SELECT unnest(range(1, 21)) AS k)),
f AS (SELECT id, bearing, min(CASE WHEN wet.row IS NULL THEN k END) AS dry FROM t LEFT JOIN wet USING (row, col) GROUP BY 1, 2)
SELECT id, bearing::INT AS bearing, (coalesce(dry, 21) - 1) * 5.0::DOUBLE AS distance, dry IS NULL AS censored FROM f""")
def ray_distances(spark, d):
    k = F.col("p_partkey") - 1
    wet = read(spark, d, "part").where("cast(round(p_retailprice * 100) AS bigint) % 7 < 5").select(F.expr("(p_partkey - 1) div 40").alias("row"), (k % 40).alias("col"))
    s = F.col("s_suppkey")
    o = read(spark, d, "supplier").select(s.alias("id"), ((s * 7 % 40 + 0.5) * 10).cast("double").alias("x"), ((s * 3 % 50 + 0.5) * 10).cast("double").alias("y"))
    return ev.rays(o, wet, 16, 5.0, 20, 10.0)


@query("""WITH p AS (SELECT l_suppkey AS cell, CASE WHEN l_linenumber = 7 THEN 255.0 WHEN l_quantity > 40 THEN NULL ELSE l_quantity * 3 END AS v FROM lineitem),
n AS (SELECT cell, count(*) AS n, count(*) FILTER (WHERE v IS NULL OR v = 255) AS n_nodata, count(*) FILTER (WHERE v <> 255 AND NOT v BETWEEN 0 AND 100) AS n_outside FROM p GROUP BY cell)
SELECT cell, n, n_nodata, n_outside, round((n - n_nodata - n_outside) / n::DOUBLE, 6) AS valid_share FROM n""")
def raster_percentage_faults(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.when(F.col("l_linenumber") == 7, 255.0).when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("double") * 3).alias("v"))
    return rounded(ev.percentage_faults(p, "cell", "v", 255.0))


@query("""SELECT c_custkey AS cell, CASE WHEN s IS NOT NULL THEN true END AS positive, s AS sources FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT substr(o_orderpriority, 1, 1), '|' ORDER BY substr(o_orderpriority, 1, 1)) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def mapped_positive_evidence(spark, d):
    r = read(spark, d, "orders").select(F.col("o_custkey").alias("cell"), (F.col("o_orderstatus") == "F").alias("present"), F.substring("o_orderpriority", 1, 1).alias("source"))
    return ev.mapped_positive(r, read(spark, d, "customer").select(F.col("c_custkey").alias("cell")), "cell")


@query("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 <> 0 THEN p_size - 10.0::DOUBLE END AS v, ['MLLW', 'MSL', 'unlisted', NULL][p_partkey % 4 + 1] AS datum FROM part), m AS (SELECT *, v + CASE datum WHEN 'MLLW' THEN 0.0 WHEN 'MSL' THEN 1.5 END AS moved FROM t),
r AS (SELECT *, CASE WHEN v IS NULL THEN 'depth_unavailable' WHEN datum IS NULL THEN 'datum_unknown' WHEN moved IS NULL THEN 'datum_not_convertible' WHEN moved < 0 THEN 'above_datum' ELSE 'accepted' END AS reason FROM m) SELECT id, round(CASE WHEN reason = 'accepted' THEN moved END, 6) AS depth, reason FROM r""")
def datum_gate(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") - 10.0).alias("v"), F.element_at(F.array(F.lit("MLLW"), F.lit("MSL"), F.lit("unlisted"), F.lit(None)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("datum"))
    return rounded(p.select("id", ev.datum_gate(F.col("v"), F.col("datum"), {"MLLW": 0.0, "MSL": 1.5}).alias("x")).select("id", "x.*"))


@query("""WITH r AS (SELECT o_custkey AS basin, o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS flow FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY flow DESC NULLS LAST, id)::INT AS rank FROM r) SELECT basin, id, round(flow, 6) AS flow, rank FROM k WHERE rank <= 3""")
def outlet_inventory(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("basin"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("flow"))
    return rounded(ev.outlet_inventory(o, 3))


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"k": ' || (event_id % 9) || '}' WHEN 1 THEN '{"k": "word", "name": "a"}' WHEN 2 THEN '{"name": "b"}' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{"k": 1, "other": true}' ELSE NULL END AS j FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'type:k' WHEN 2 THEN 'missing:k' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'unknown_field' ELSE 'not_an_object' END AS fault FROM t""")
def json_schema_faults(spark, d):
    m = F.col("event_id") % 6
    j = F.when(m == 0, F.concat(F.lit('{"k": '), (F.col("event_id") % 9).cast("string"), F.lit("}"))).when(m == 1, '{"k": "word", "name": "a"}').when(m == 2, '{"name": "b"}').when(m == 3, "[1, 2]").when(m == 4, '{"k": 1, "other": true}')
    return ev.json_faults(read(spark, d, "events").select("event_id", j.alias("j")), "j", {"k": "bigint", "name": "string?"}).select("event_id", "fault")


@query("""WITH b AS (SELECT o_orderkey AS section, o_orderkey % 113 AS x, o_orderkey % 127 AS y FROM orders), t AS (SELECT section, x::DOUBLE AS lx, y::DOUBLE AS ly, CASE WHEN section % 5 <> 0 THEN (x + section % 60)::DOUBLE END AS rx, (y + section % 45)::DOUBLE AS ry FROM b),
w AS (SELECT *, sqrt((lx - rx) ** 2 + (ly - ry) ** 2) AS w FROM t) SELECT section, round(CASE WHEN w <= 50 THEN w END, 6) AS width, round(CASE WHEN w <= 50 THEN (lx + rx) / 2 END, 6) AS mx, round(CASE WHEN w <= 50 THEN (ly + ry) / 2 END, 6) AS my, CASE WHEN rx IS NULL THEN 'one_bank' WHEN w > 50 THEN 'too_wide' ELSE 'bounded' END AS status FROM w""")
def bank_sections(spark, d):
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(k.alias("section"), (k % 113).cast("double").alias("x"), (k % 127).cast("double").alias("y"))
    left = o.withColumn("side", F.lit("L"))
    right = o.where("section % 5 <> 0").select("section", (F.col("x") + F.col("section") % 60).alias("x"), (F.col("y") + F.col("section") % 45).alias("y"), F.lit("R").alias("side"))
    return rounded(ev.bank_sections(left.unionByName(right), 50.0))


@query("""WITH b AS (SELECT s_suppkey AS id, s_suppkey % 122 AS base FROM supplier), p AS (SELECT id, base, base IN (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117) AS pent FROM b),
d AS (SELECT id, base, d1, d2 FROM p, (SELECT unnest(range(0, 7)) AS d1), (SELECT unnest(range(0, 7)) AS d2) WHERE NOT (pent AND d1 = 1) AND NOT (pent AND d1 = 0 AND d2 = 1))
SELECT id, lower(to_hex((1::UBIGINT << 59) | (2::UBIGINT << 52) | (base::UBIGINT << 45) | (d1::UBIGINT << 42) | (d2::UBIGINT << 39) | ((1::UBIGINT << 39) - 1))) AS child FROM d""")
def cell_children(spark, d):
    base = F.col("s_suppkey") % 122
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(1 << 59).bitwiseOR(F.shiftleft(base, 45)).bitwiseOR(F.lit((1 << 45) - 1)).alias("cell"))
    return cell_ids.children(s, "cell", 2).select("id", cell_ids.to_text(F.col("child")).alias("child"))
