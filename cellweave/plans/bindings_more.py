"""Further bindings: grids, ids, text, delivery, derived windows and searches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import contracts, fits, focal, graph, intervals, nearest
from ..sources import cells as cell_ids
from ..sources import rasters
from . import delivery, history
from .bindings import (
    _LINES,
    _MERGED,
    _RAYS,
    CELLS,
    EVIDENCE,
    LATTICE,
    MOUTHS,
    POINTS,
    SPANS,
    VALUES,
    _hops,
    _lines,
    _relax,
    cells,
    evidence,
    lattice,
    mouths,
    nodes,
    points,
    query,
    read,
    rounded,
    spans,
    values,
)

# --- grids --------------------------------------------------------------------


def _grid(spark, d):
    """Parts as pixels of a grid of forty columns, one in eleven missing."""
    k = F.col("p_partkey") - 1
    return read(spark, d, "part").where(k % 11 != 7).select(F.expr("(p_partkey - 1) div 40").alias("row"), (k % 40).alias("col"), F.col("p_retailprice").alias("value"))


_GRID = "grid AS (SELECT (p_partkey - 1) // 40 AS row, (p_partkey - 1) % 40 AS col, p_retailprice AS value FROM part WHERE (p_partkey - 1) % 11 <> 7)"


@query(f"""WITH {_GRID} SELECT g.row, g.col, round(degrees(atan(sqrt(power((e.value - w.value) / 60.0::DOUBLE, 2) + power((s.value - n.value) / 50.0::DOUBLE, 2)))), 6) AS slope FROM grid g
LEFT JOIN grid s ON s.row = g.row + 1 AND s.col = g.col LEFT JOIN grid n ON n.row = g.row - 1 AND n.col = g.col LEFT JOIN grid e ON e.row = g.row AND e.col = g.col + 1 LEFT JOIN grid w ON w.row = g.row AND w.col = g.col - 1""")
def raster_gradient_with_halo(spark, d):
    return rounded(rasters.gradient(_grid(spark, d), 25.0, 30.0))


@query(f"""WITH {_GRID}, p AS (SELECT s_suppkey AS id, (s_suppkey % 40) / 1.7::DOUBLE AS r, (s_suppkey % 37) / 1.3::DOUBLE AS c FROM supplier),
f AS (SELECT id, floor(r)::BIGINT + a AS row, floor(c)::BIGINT + b AS col, (CASE WHEN a = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE WHEN b = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS wt FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS q(a, b))
SELECT id, round(CASE WHEN sum(CASE WHEN value IS NOT NULL THEN wt END) > 0 THEN sum(wt * value) / sum(CASE WHEN value IS NOT NULL THEN wt END) END, 6) AS value FROM f LEFT JOIN grid USING (row, col) GROUP BY id""")
def bilinear_point_sample(spark, d):
    p = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 40) / 1.7).alias("r"), ((F.col("s_suppkey") % 37) / 1.3).alias("c"))
    return rounded(rasters.bilinear(p, _grid(spark, d)))


@query(f"""WITH {_GRID}, e AS (SELECT g.row, g.col, g.value, 0 AS side, o.value AS other FROM grid g JOIN grid o ON o.row = g.row AND o.col = g.col + 1 UNION ALL SELECT g.row, g.col, g.value, 1, o.value FROM grid g JOIN grid o ON o.row = g.row + 1 AND o.col = g.col)
SELECT row, col, side, round((915.5 - value) / (other - value), 6) AS at FROM e WHERE (value < 915.5) <> (other < 915.5)""")
def isobath_crossings(spark, d):
    return rounded(rasters.crossings(_grid(spark, d), 915.5))


@query(f"""WITH {_GRID}, h AS (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM grid WHERE value > 0) SELECT row, min(col) AS start, max(col) AS "end" FROM h GROUP BY row, g""")
def polygonised_pixel_runs(spark, d):
    return rasters.row_runs(_grid(spark, d))


# --- ids, text, maps ----------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey, 576460752303423488 + 9 * 4503599627370496 + (c_custkey % 120) * 35184372088832 + ((c_custkey * 2654435761) % 134217728) * 262144 + 262143 AS cell FROM customer)
SELECT c_custkey, lower(to_hex(cell)) AS id, ((cell >> 52) & 15)::INT AS res, lower(to_hex((cell & ~(15::BIGINT << 52)) | (5::BIGINT << 52) | ((1::BIGINT << 30) - 1))) AS parent FROM c""")
def cell_id_parents(spark, d):
    k = F.col("c_custkey")
    cell = F.lit(576460752303423488).bitwiseOR(F.lit(9 << 52)).bitwiseOR(F.shiftleft(k % 120, 45)).bitwiseOR(F.shiftleft((k * 2654435761) % 134217728, 18)).bitwiseOR(F.lit(262143))
    text = read(spark, d, "customer").select("c_custkey", cell_ids.to_text(cell).alias("id"))
    back = cell_ids.to_long("id")
    return text.select("c_custkey", "id", cell_ids.resolution(back).alias("res"), cell_ids.to_text(cell_ids.parent(back, 5)).alias("parent"))


@query("""SELECT s_suppkey AS id, round(2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians((49 - (48 + s_suppkey % 10 / 10.0::DOUBLE))) / 2), 2) + cos(radians(48 + s_suppkey % 10 / 10.0::DOUBLE)) * cos(radians(49)) * power(sin(radians(-123 - (-124 + s_suppkey % 7 / 7.0::DOUBLE)) / 2), 2)))), 3) AS metres FROM supplier""")
def haversine_distance(spark, d):
    k = F.col("s_suppkey")
    return rounded(read(spark, d, "supplier").select(k.alias("id"), cell_ids.haversine_m(48 + k % 10 / 10.0, -124 + k % 7 / 7.0, F.lit(49.0), F.lit(-123.0)).alias("metres")), 3)


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, substr(sha1(event_type || ':' || user_id::VARCHAR), 1, 16) AS source_id, sha256(coalesce(props, '')) AS digest FROM events""")
def json_and_hash_ids(spark, d):
    e = read(spark, d, "events")
    k = F.from_json("props", "k bigint")["k"]
    return e.select("event_id", k.alias("k"), F.substring(F.sha1(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).cast("binary")), 1, 16).alias("source_id"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("digest"))


@query("""SELECT p_partkey AS id, list_sort(list_filter([CASE WHEN p_type LIKE '%STEEL%' THEN 'dock' END, CASE WHEN p_size > 25 THEN 'marina' END, CASE WHEN p_brand LIKE '%1%' THEN 'buoy' END], lambda x: x IS NOT NULL)) AS classes FROM part""")
def tag_classifier(spark, d):
    made = F.array(F.when(F.col("p_type").contains("STEEL"), "dock"), F.when(F.col("p_size") > 25, "marina"), F.when(F.col("p_brand").contains("1"), "buoy"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_sort(F.array_compact(made)).alias("classes"))


@query("""SELECT o_orderkey AS id, CASE WHEN upper(trim(o_orderpriority)) LIKE '1%' THEN 'barrier' WHEN lower(o_orderpriority) LIKE '%high%' THEN 'potential' WHEN o_orderpriority LIKE '%SPEC%' THEN 'unknown' ELSE 'passable' END AS status, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.0 WHEN '2' THEN 0.33 WHEN '3' THEN 0.67 ELSE 1.0 END::DOUBLE AS fraction FROM orders""")
def passage_status_normaliser(spark, d):
    p = F.col("o_orderpriority")
    status = F.when(F.upper(F.trim(p)).startswith("1"), "barrier").when(F.lower(p).contains("high"), "potential").when(p.contains("SPEC"), "unknown").otherwise("passable")
    code = F.create_map(F.lit("1"), F.lit(0.0), F.lit("2"), F.lit(0.33), F.lit("3"), F.lit(0.67))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.coalesce(F.try_element_at(code, F.substring(p, 1, 1)), F.lit(1.0)).alias("fraction"))


@query("""SELECT n_name AS name, count(*) AS matches FROM nation JOIN (SELECT upper(trim(n_name)) AS k, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) x ON x.k = upper(trim(n_name)) GROUP BY 1""")
def name_alias_join(spark, d):
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    sites = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.upper(F.trim("n_name")).alias("k"))
    return n.withColumn("k", F.upper(F.trim("n_name"))).join(sites, "k").groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("matches"))


# --- delivery -----------------------------------------------------------------


@query(f"""WITH {CELLS}, {EVIDENCE}, e AS (SELECT cell, count(*) AS n FROM evidence GROUP BY cell)
SELECT cells.cell, round(value, 6) AS physical__value, coalesce(n, 0) AS evidence__n FROM cells LEFT JOIN e USING (cell)""")
def delivery_assembly(spark, d):
    c = cells(spark, d)
    support = c.select("cell")
    e = support.join(evidence(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rounded(delivery.assemble(support, {"physical": c.select("cell", "value"), "evidence": e}, ["cell"]))


@query("""SELECT c_custkey AS cell, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_acctbal > 0 THEN 1 ELSE 0 END::BIGINT AS present, round(c_acctbal, 6) AS amount FROM customer""")
def public_metric_projection(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") > 0).alias("present"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("name_QC"), F.lit(1).alias("depth_SOURCE"), F.lit(1).alias("STATUS_CODE"), F.lit(2).alias("mean_confidence"), F.lit(3).alias("SITE_RECORD_COUNT"), F.lit(4.0).alias("SURVEY_METHOD_KIND"))
    return rounded(delivery.public_metrics(c, ["cell"]))


@query("""SELECT c_custkey AS cell, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal > 0 END, false) AS present, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal > 0 END AS "present_SOURCE_NULLABLE" FROM customer""")
def public_presence_policy(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") > 0).alias("present"))
    return delivery.presence(c, ["present"])


@query("""SELECT p_partkey AS id, CASE WHEN p_type LIKE '%TIN%' THEN 'support' WHEN p_size > 40 THEN 'role' WHEN p_brand = 'Brand#11' THEN 'duplicate' END AS exclusion FROM part""")
def feature_eligibility(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_size", "p_brand")
    return delivery.eligible(p, [("support", "p_type LIKE '%TIN%'"), ("role", "p_size > 40"), ("duplicate", "p_brand = 'Brand#11'")], "id").select("id", "exclusion")


@query(f"""WITH {EVIDENCE} SELECT cell, max(CASE WHEN o_orderstatus = 'F' THEN record END) AS "last_F", max(CASE WHEN o_orderstatus = 'P' THEN record END) AS "last_P" FROM evidence GROUP BY cell""")
def pivot_selected_objects(spark, d):
    long = evidence(spark, d).groupBy("cell", "o_orderstatus").agg(F.max("record").alias("record"))
    return delivery.pivoted(long, ["cell"], "o_orderstatus", "record", ["F", "P"], "last")


@query("""SELECT o_custkey AS cell, o_orderkey AS record, 'orders' AS source, NULL::VARCHAR AS kind FROM orders UNION ALL SELECT l_suppkey, l_orderkey, 'items', l_returnflag FROM lineitem""")
def normalised_union(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("record"), F.lit("orders").alias("source"))
    b = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_orderkey").alias("record"), F.lit("items").alias("source"), F.col("l_returnflag").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT o_custkey AS cell, o_orderkey AS record, 'orders' AS source, NULL::VARCHAR AS kind FROM orders UNION ALL SELECT l_suppkey, l_orderkey, 'items', l_returnflag FROM lineitem""")
def whole_normalised_union(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("record"), F.lit("orders").alias("source"))
    b = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_orderkey").alias("record"), F.lit("items").alias("source"), F.col("l_returnflag").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"""WITH {EVIDENCE} SELECT cell, record, year, priority FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY priority, year DESC, record) AS r FROM evidence) WHERE r = 1""")
def rank_keep_first(spark, d):
    w = W.partitionBy("cell").orderBy("priority", F.desc("year"), "record")
    return evidence(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("cell", "record", "year", "priority")


@query("""SELECT vec_id, round(list_sort(list_transform(range(1, 17), lambda i: embedding[i]::DOUBLE), 'DESC')[1], 6) AS top, round(list_sort(list_transform(range(1, 17), lambda i: embedding[i]::DOUBLE), 'DESC')[2], 6) AS second FROM embeddings""")
def second_best_margin(spark, d):
    order = F.sort_array(F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")), asc=False)
    return rounded(read(spark, d, "embeddings").select("vec_id", F.element_at(order, 1).alias("top"), F.element_at(order, 2).alias("second")))


@query(f"""WITH {EVIDENCE}, s AS (SELECT cell, o_orderstatus, sum(o_totalprice) AS t FROM evidence GROUP BY 1, 2) SELECT cell, o_orderstatus AS best, round(t, 4) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(t, 4) DESC, o_orderstatus DESC) AS r FROM s) WHERE r = 1""")
def combined_estimates_maximum(spark, d):
    s = evidence(spark, d).groupBy("cell", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 4).alias("t"))
    return s.groupBy("cell").agg(F.max(F.struct("t", "o_orderstatus")).alias("m")).select("cell", F.col("m.o_orderstatus").alias("best"), F.col("m.t").alias("amount"))


@query(f"""WITH {CELLS}, c AS (SELECT cell, parent, value / nullif(weight, 0) AS ratio, least(1, greatest(0, value / 100)) AS share, value IS NOT NULL AS known FROM cells) SELECT cell, round(ratio, 6) AS ratio, round(CASE WHEN known THEN share END, 6) AS share, known FROM c""")
def safe_divide_and_clip(spark, d):
    v, w = F.col("value"), F.col("weight")
    c = cells(spark, d).select("cell", (v / F.nullif(w, F.lit(0.0))).alias("ratio"), F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / 100))).alias("share"))
    return rounded(c.select("cell", "ratio", "share", F.col("share").isNotNull().alias("known")))


# --- derived windows ----------------------------------------------------------


@query(f"""WITH {_hops(1)}, lab AS (SELECT node, (node * 5) % 4 AS label FROM nodes), near AS (SELECT hood.src, x.label AS near, y.label FROM hood JOIN lab x ON x.node = hood.dst JOIN lab y ON y.node = hood.src WHERE hops = 1 AND y.node % 3 = 0 AND x.label <> y.label),
v AS (SELECT src, near, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, near) AS r FROM near GROUP BY 1, 2) SELECT node, coalesce(v.near, lab.label) AS label FROM lab LEFT JOIN v ON v.src = node AND r = 1""")
def majority_relabel_pass(spark, d):
    lab = nodes(spark, d).select("node", ((F.col("node") * 5) % 4).alias("label"))
    sizes = lab.select("node", F.when(F.col("node") % 3 == 0, 1).otherwise(9).alias("size"))
    return focal.majority_relabel(lab, graph.mirrored(lattice(spark, d)), sizes, 5)


@query(f"""WITH {_hops(3)}, {VALUES} SELECT hood.src AS node, round(least(1, greatest(0, 1 - any_value(f.z) / nullif(median(v.z), 0))), 6) AS constriction, count(*) AS n FROM hood JOIN vals v ON v.node = hood.dst JOIN vals f ON f.node = hood.src WHERE hops <= 3 GROUP BY 1""")
def constriction_index(spark, d):
    w = focal.windows(graph.neighbourhoods(nodes(spark, d), lattice(spark, d), 3), values(spark, d), 3, True)
    g = w.groupBy(F.col("src").alias("node")).agg(F.first("focal").alias("f"), F.median("z").alias("m"), F.count(F.lit(1)).alias("n"))
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("f") / F.nullif("m", F.lit(0.0))))
    return rounded(g.select("node", F.when(F.col("m") != 0, c).otherwise(0.0).alias("constriction"), "n"))


@query(f"""WITH {_hops(2)}, {VALUES}, w AS (SELECT hood.src, v.z, f.z AS fz, (dst % 10 - hood.src % 10)::DOUBLE AS x, (dst // 10 - hood.src // 10)::DOUBLE AS y FROM hood JOIN vals v ON v.node = dst JOIN vals f ON f.node = hood.src WHERE hops > 0),
s AS (SELECT src, floor(round(CASE WHEN degrees(atan2(x, y)) < 0 THEN degrees(atan2(x, y)) + 360 ELSE degrees(atan2(x, y)) END, 6) / 30)::INT % 12 AS sec, max(degrees(atan((z - fz) / sqrt(x * x + y * y)))) AS up, max(-degrees(atan((z - fz) / sqrt(x * x + y * y)))) AS down FROM w GROUP BY 1, 2)
SELECT src AS node, round(90 - avg(up), 6) AS positive, round(90 - avg(down), 6) AS negative, count(*) AS sectors FROM s GROUP BY src""")
def sectoral_openness(spark, d):
    w = focal.windows(graph.neighbourhoods(nodes(spark, d), lattice(spark, d), 2), values(spark, d), 2)
    x, y = (F.col("dst") % 10 - F.col("src") % 10).cast("double"), F.expr("cast(dst div 10 - src div 10 as double)")
    turn = F.degrees(F.atan2(x, y))
    sector = F.floor(F.round(F.when(turn < 0, turn + 360).otherwise(turn), 6) / 30) % 12
    rise = F.degrees(F.atan((F.col("z") - F.col("focal")) / F.sqrt(x * x + y * y)))
    s = w.groupBy("src", sector.alias("sec")).agg(F.max(rise).alias("up"), F.max(-rise).alias("down"))
    return rounded(s.groupBy(F.col("src").alias("node")).agg((90 - F.avg("up")).alias("positive"), (90 - F.avg("down")).alias("negative"), F.count(F.lit(1)).alias("sectors")))


@query(f"""WITH {_hops(2)}, {VALUES}, m AS (SELECT hood.src, sum(v.z * x * x) AS xx, sum(v.z * x * y) AS xy, sum(v.z * y * y) AS yy FROM (SELECT *, (dst % 10 - src % 10)::DOUBLE AS x, (dst // 10 - src // 10)::DOUBLE AS y FROM hood WHERE hops > 0) hood JOIN vals v ON v.node = hood.dst GROUP BY 1)
SELECT src AS node, round(sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / greatest(xx + yy, 1e-12), 6) AS anisotropy FROM m""")
def depth_anisotropy(spark, d):
    w = focal.windows(graph.neighbourhoods(nodes(spark, d), lattice(spark, d), 2), values(spark, d), 2)
    x, y, z = (F.col("dst") % 10 - F.col("src") % 10).cast("double"), F.expr("cast(dst div 10 - src div 10 as double)"), F.col("z")
    m = w.groupBy(F.col("src").alias("node")).agg(F.sum(z * x * x).alias("xx"), F.sum(z * x * y).alias("xy"), F.sum(z * y * y).alias("yy"))
    return rounded(m.select("node", (F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + 4 * F.col("xy") * F.col("xy")) / F.greatest(F.col("xx") + F.col("yy"), F.lit(1e-12))).alias("anisotropy")))


@query(f"""WITH {LATTICE}, {VALUES}, ax AS (SELECT node, z / 100 AS axis FROM vals WHERE z / 100 >= 0.52) SELECT a.src AS node, round(max(0.7 * (0.45 + 0.30 * CASE WHEN v.z < ax.axis * 100 THEN 1 ELSE 0 END + 0.25 * v.z / 101)), 6) AS rim FROM arcs a JOIN ax ON ax.node = a.dst JOIN vals v ON v.node = a.src GROUP BY 1""")
def canyon_rim_propagation(spark, d):
    v = values(spark, d)
    ax = v.where("z / 100 >= 0.52").select(F.col("node").alias("dst"), F.col("z").alias("axis"))
    j = graph.mirrored(lattice(spark, d)).join(ax, "dst").join(v.select(F.col("node").alias("src"), "z"), "src")
    return rounded(j.groupBy(F.col("src").alias("node")).agg(F.max(0.7 * (0.45 + 0.30 * F.when(F.col("z") < F.col("axis"), 1.0).otherwise(0.0) + 0.25 * F.col("z") / 101)).alias("rim")))


@query(f"""WITH {_hops(1)}, {VALUES}, w AS (SELECT hood.src, any_value(f.z) AS fz, median(v.z) AS m, count(*) AS n FROM hood JOIN vals v ON v.node = hood.dst JOIN vals f ON f.node = hood.src WHERE hops = 1 GROUP BY 1) SELECT src AS node, round(m - fz, 6) AS relief FROM w WHERE m - fz >= 10 AND n >= 3""")
def sill_candidates(spark, d):
    w = focal.windows(graph.neighbourhoods(nodes(spark, d), lattice(spark, d), 1), values(spark, d), 1)
    g = w.groupBy(F.col("src").alias("node")).agg((F.median("z") - F.first("focal")).alias("relief"), F.count(F.lit(1)).alias("n"))
    return rounded(g.where("relief >= 10 AND n >= 3").select("node", "relief"))


@query(f"""WITH {POINTS}, {MOUTHS}, p AS (SELECT points.id, (m.id % 3) AS label, min(sqrt((points.x - m.x) * (points.x - m.x) + (points.y - m.y) * (points.y - m.y))) AS dist FROM points JOIN mouths m ON abs(points.x - m.x) <= 1200 AND abs(points.y - m.y) <= 1200 WHERE sqrt((points.x - m.x) * (points.x - m.x) + (points.y - m.y) * (points.y - m.y)) <= 1200 GROUP BY 1, 2)
SELECT id, round(max(CASE WHEN label = 0 THEN dist END), 6) AS d_0, round(max(CASE WHEN label = 1 THEN dist END), 6) AS d_1, round(max(CASE WHEN label = 2 THEN dist END), 6) AS d_2 FROM p GROUP BY id""")
def nearest_label_distances(spark, d):
    m = mouths(spark, d).withColumn("label", F.col("id") % 3)
    return rounded(nearest.by_label(points(spark, d), m, 1200.0, "label", [0, 1, 2]))


@query(f"""WITH {MOUTHS}, s AS (SELECT n_nationkey AS seg, (n_nationkey * 400)::DOUBLE AS ax, (n_nationkey * 370 % 9000)::DOUBLE AS ay, (n_nationkey * 400 + 300)::DOUBLE AS bx, ((n_nationkey * 370 + 500) % 9000)::DOUBLE AS by_ FROM nation),
q AS (SELECT id, seg, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t, x, y, ax, ay, bx, by_ FROM mouths, s),
r AS (SELECT id, seg, t, sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * (by_ - ay), 2)) AS off FROM q), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(off, 6), seg) AS k FROM r)
SELECT id, seg, round(t, 6) AS along, round(off, 6) AS off FROM o WHERE k = 1""")
def nearest_line_projection(spark, d):
    # the line table is a fixed list of nations (25 rows), so the product is linear in the points
    k = F.col("n_nationkey")
    s = read(spark, d, "nation").select(k.alias("seg"), (k * 400).cast("double").alias("ax"), (k * 370 % 9000).cast("double").alias("ay"), (k * 400 + 300).cast("double").alias("bx"), ((k * 370 + 500) % 9000).cast("double").alias("by_"))
    q = mouths(spark, d).crossJoin(s)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    q = q.withColumn("t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy))))
    off = F.sqrt(F.pow(F.col("x") - F.col("ax") - F.col("t") * dx, F.lit(2)) + F.pow(F.col("y") - F.col("ay") - F.col("t") * dy, F.lit(2)))
    best = q.withColumn("off", off).groupBy("id").agg(F.min(F.struct(F.round("off", 6).alias("off"), "seg", "t")).alias("b"))
    return rounded(best.select("id", F.col("b.seg").alias("seg"), F.col("b.t").alias("along"), F.col("b.off").alias("off")))


# --- searches -----------------------------------------------------------------


@query(f"""WITH {_relax(5, "SELECT node AS object, node, 0::BIGINT AS v FROM nodes WHERE node % 23 = 5", "object, node", "AND v + a.w * 1000000 <= 500 * 1000000")}
SELECT object, node, v // 1000000 AS dist, greatest(0, v // 1000000 - 90 * (abs(node % 10 - object % 10) + abs(node // 10 - object // 10))) AS detour FROM d5""")
def bounded_search_detour(spark, d):
    objects = nodes(spark, d).where("node % 23 = 5").select(F.col("node").alias("object"), "node")
    x = graph.distances(lattice(spark, d), objects, 500)
    straight = F.expr("90 * (abs(node % 10 - object % 10) + abs(node div 10 - object div 10))")
    return x.select("object", "node", "dist", F.greatest(F.lit(0), F.col("dist") - straight).cast("long").alias("detour"))


_CUT = LATTICE.replace("(src * 7 + dst * 13) % 5 <> 0", "(src * 7 + dst * 13) % 5 <> 0 AND NOT (src < 50 AND dst >= 50)")


@query(f"""WITH RECURSIVE {_CUT}, reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT a, dst FROM reach JOIN arcs ON src = b) SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def components_after_edge_removal(spark, d):
    cut = lattice(spark, d).where("NOT (src < 50 AND dst >= 50)")
    return graph.components(nodes(spark, d), cut)


@query(f"""WITH {LATTICE} SELECT nodes.node, count(dst) AS degree, coalesce(sum(w), 0)::BIGINT AS length, CASE WHEN count(dst) = 0 THEN 'ISOLATED' WHEN count(dst) = 1 THEN 'TERMINAL' END AS reason FROM nodes LEFT JOIN arcs ON src = node GROUP BY 1""")
def node_degrees_with_reason(spark, d):
    e = graph.mirrored(lattice(spark, d)).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("length"))
    j = nodes(spark, d).join(e, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("length", F.lit(0)).alias("length"))
    return j.withColumn("reason", F.when(F.col("degree") == 0, "ISOLATED").when(F.col("degree") == 1, "TERMINAL"))


@query("""WITH t AS (SELECT p_partkey AS k, p_partkey // 2 AS down, p_size, p_partkey % 25 AS basin FROM part), u AS (SELECT down, count(*) AS c FROM t GROUP BY 1)
SELECT basin, count(*) AS segments, count(CASE WHEN c >= 2 THEN 1 END) AS junctions, count(CASE WHEN c IS NULL THEN 1 END) AS headwaters, sum(p_size)::BIGINT AS length FROM t LEFT JOIN u ON u.down = t.k GROUP BY basin""")
def basin_network_summary(spark, d):
    t = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 2").alias("down"), "p_size", (F.col("p_partkey") % 25).alias("basin"))
    u = t.groupBy(F.col("down").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    return t.join(u, F.col("k") == F.col("n"), "left").groupBy("basin").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("c") >= 2).alias("junctions"), F.count_if(F.col("c").isNull()).alias("headwaters"), F.sum("p_size").alias("length"))


@query(f"""WITH {SPANS}, {_MERGED.format(keys='cell, year')}, m AS (SELECT cell, year, sum(len)::BIGINT AS length FROM u GROUP BY 1, 2), n AS (SELECT cell, count(DISTINCT year) AS years FROM spans GROUP BY 1),
r2 AS (SELECT cell, x0, x1, max(x1) OVER (PARTITION BY cell ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE x1 > x0), i2 AS (SELECT cell, x0, x1, sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM r2), t AS (SELECT cell, sum(len)::BIGINT AS l FROM (SELECT cell, g, max(x1) - min(x0) AS len FROM i2 GROUP BY cell, g) GROUP BY cell)
SELECT cell, years, max(length) AS largest_year, CASE WHEN any_value(years) = 1 THEN any_value(l) END AS compatible_union, any_value(l) AS all_time FROM m JOIN n USING (cell) JOIN t USING (cell) GROUP BY cell, years""")
def mosaic_compatible_union(spark, d):
    s = spans(spark, d)
    by_year = intervals.union_length(s, ["cell", "year"], "x0", "x1").groupBy("cell").agg(F.max("length").alias("largest_year"), F.count(F.lit(1)).alias("years"))
    total = intervals.union_length(s, ["cell"], "x0", "x1", "all_time")
    return by_year.join(total, "cell").select("cell", "years", "largest_year", F.when(F.col("years") == 1, F.col("all_time")).alias("compatible_union"), "all_time")


@query(f"""WITH {_LINES}, c AS (SELECT line, pos, depth, sum(coalesce(depth, 0)) OVER (PARTITION BY line ORDER BY pos ROWS UNBOUNDED PRECEDING) AS along FROM lines) SELECT line, pos, round(along, 6) AS along FROM c WHERE floor(along / 100) > floor((along - coalesce(depth, 0)) / 100)""")
def cumulative_length_stations(spark, d):
    w = W.partitionBy("line").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    step = F.coalesce("depth", F.lit(0.0))
    c = _lines(spark, d).withColumn("along", F.sum(step).over(w)).withColumn("step", step)
    return rounded(c.where(F.floor(F.col("along") / 100) > F.floor((F.col("along") - F.col("step")) / 100)).select("line", "pos", "along"))


@query(f"""WITH {_LINES}, p AS (SELECT line, radians(depth * 3) AS th, 1.0 + pos % 3 AS w FROM lines WHERE depth IS NOT NULL), a AS (SELECT line, sum(w * sin(2 * th)) AS s, sum(w * cos(2 * th)) AS c, sum(w) AS w FROM p GROUP BY line)
SELECT line, round(degrees(atan2(s, c)) / 2, 6) AS axis, round(sqrt(s * s + c * c) / w, 6) AS concentration FROM a WHERE sqrt(s * s + c * c) / w > 0.001""")
def axial_orientation(spark, d):
    th, w = F.radians(F.col("depth") * 3), 1.0 + F.col("pos") % 3
    a = _lines(spark, d).where("depth IS NOT NULL").groupBy("line").agg(F.sum(w * F.sin(2 * th)).alias("s"), F.sum(w * F.cos(2 * th)).alias("c"), F.sum(w).alias("w"))
    length = F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("w")
    return rounded(a.where(length > 0.001).select("line", (F.degrees(F.atan2("s", "c")) / 2).alias("axis"), length.alias("concentration")))


@query(f"""WITH {_RAYS}, st AS (SELECT vec_id, unnest(range(1, 17)) AS i, unnest(r) AS v FROM rays) SELECT vec_id, coalesce(min(CASE WHEN v < 1000 THEN i END) - 1, 16)::INT AS last_wet, min(CASE WHEN v < 1000 THEN i END) IS NULL AS censored FROM st GROUP BY 1""")
def ray_first_exit(spark, d):
    r = F.transform(F.slice("embedding", 1, 16), lambda x: F.abs(x).cast("double") * 20000)
    st = read(spark, d, "embeddings").select("vec_id", F.posexplode(r).alias("i", "v"))
    g = st.groupBy("vec_id").agg(F.min(F.when(F.col("v") < 1000, F.col("i"))).alias("dry"))
    return g.select("vec_id", F.coalesce("dry", F.lit(16)).cast("int").alias("last_wet"), F.col("dry").isNull().alias("censored"))


@query("""SELECT l_suppkey AS cell, count(*) AS n, sum(greatest(1, l_linenumber))::BIGINT AS structures, round(sum(greatest(1, l_linenumber)) / 78.5398::DOUBLE, 6) AS density, max(l_linenumber) AS confidence, bool_or(l_quantity > 49) AS unmapped FROM lineitem GROUP BY 1""")
def structure_density(spark, d):
    li = read(spark, d, "lineitem")
    s = F.sum(F.greatest(F.lit(1), F.col("l_linenumber")))
    return rounded(li.groupBy(F.col("l_suppkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"), s.alias("structures"), (s / 78.5398).alias("density"), F.max("l_linenumber").alias("confidence"), F.bool_or(F.col("l_quantity") > 49).alias("unmapped")))


@query(f"""WITH {CELLS} SELECT c.cell, c.parent, n.n_name AS name, r.r_name AS region FROM cells c LEFT JOIN nation n ON n.n_nationkey = c.parent LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def checked_lookup_join(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("parent"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("rk"))
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region"))
    one = contracts.checked_join(cells(spark, d).select("cell", "parent"), n, ["parent"], validate="many_to_one")
    return contracts.checked_join(one, r, ["rk"], validate="many_to_one").select("cell", "parent", "name", "region")


@query(f"""WITH {CELLS} SELECT parent, count(CASE WHEN value IS NOT NULL AND value > 50 THEN 1 END) AS rich, round(CASE WHEN count(value) = count(*) THEN avg(value) END, 6) AS composite, round(avg(coalesce(value, 0)) / 4, 6) AS confidence FROM cells GROUP BY parent""")
def richness_and_confidence(spark, d):
    v = F.col("value")
    g = cells(spark, d).groupBy("parent").agg(F.count_if(v > 50).alias("rich"), F.when(F.count(v) == F.count(F.lit(1)), F.avg(v)).alias("composite"), (F.avg(F.coalesce(v, F.lit(0.0))) / 4).alias("confidence"))
    return rounded(g)


@query(f"""WITH {CELLS}, k AS (SELECT parent, value, weight, cell FROM cells WHERE parent IN (SELECT parent FROM cells WHERE cell % 50 = 1)) SELECT parent, count(*) AS children, round(sum(weight), 6) AS area FROM k GROUP BY parent""")
def parent_support_of_selection(spark, d):
    c = cells(spark, d)
    chosen = c.where("cell % 50 = 1").select("parent").distinct()
    return rounded(c.join(chosen, "parent", "left_semi").groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.sum("weight").alias("area")))


@query("""SELECT s_suppkey AS cell, NULL::DOUBLE AS hardness, NULL::DOUBLE AS consolidated, round(s_acctbal, 6) AS rock_score, 0 AS confidence FROM supplier""")
def bottom_hardness(spark, d):
    s = read(spark, d, "supplier")
    return rounded(s.select(F.col("s_suppkey").alias("cell"), F.lit(None).cast("double").alias("hardness"), F.lit(None).cast("double").alias("consolidated"), F.col("s_acctbal").alias("rock_score"), F.lit(0).alias("confidence")))


@query("""SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0) AND event_type IN ('click', 'view') AND value BETWEEN 10 AND 60""")
def membership_filter_scan(spark, d):
    c = read(spark, d, "customer").where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("user_id"))
    e = read(spark, d, "events").where(F.col("event_type").isin("click", "view") & F.col("value").between(10, 60))
    return e.join(c, "user_id", "left_semi").select("event_id", "user_id", "value")


# --- leaves and audits --------------------------------------------------------


@query(None)
def canonical_records_with_lineage(spark, d):
    return fits.canonical_records(points(spark, d), 150.0, ["class"])


@query("""WITH t AS (SELECT user_id, ts::DATE AS date, sum(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, date, round(v, 6) AS v FROM t WHERE date + 7 > DATE '2024-01-10' AND date < DATE '2024-01-12'""")
def composite_history_selection(spark, d):
    t = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.sum("value").alias("v"))
    return rounded(history.select_history(t, "2024-01-10", "2024-01-12", "composite", 7))


@query("""SELECT 'days' AS area, count(DISTINCT ts::DATE) AS periods, count(*) AS rows, min(ts::DATE) AS first, max(ts::DATE) AS last, count(DISTINCT user_id) AS cells FROM events""")
def history_coverage_report(spark, d):
    return history.coverage({"days": read(spark, d, "events").withColumn("date", F.to_date("ts"))}, ["user_id"])


@query("""SELECT 'orders' AS product, 'support' AS rule, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders) FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey WHERE o_custkey IS NULL OR c_custkey IS NULL HAVING count(*) > 0
UNION ALL SELECT 'orders', 'repeated_or_null_key', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""")
def release_audit_faults(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("cell"), "o_totalprice")
    return history.release_audit({"orders": o}, cells(spark, d).where("cell % 2 = 0").select("cell"), ["cell"])


@query("""SELECT s_suppkey::VARCHAR AS record, 'supplier' AS dataset, s_acctbal AS amount, NULL::INT AS year FROM supplier UNION ALL SELECT o_orderkey::VARCHAR, 'order', o_totalprice, year(o_orderdate)::INT FROM orders""")
def source_normalisers(spark, d):
    schema = [("record", "string"), ("dataset", "string"), ("amount", "double"), ("year", "int")]
    a = history.normalised(read(spark, d, "supplier"), {"record": "s_suppkey", "amount": "s_acctbal"}, {"dataset": "supplier"}, schema)
    b = history.normalised(read(spark, d, "orders"), {"record": "o_orderkey", "amount": "o_totalprice", "year": "year(o_orderdate)"}, {"dataset": "order"}, schema)
    return a.unionByName(b)


@query("""WITH t AS (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS a, embedding[2]::DOUBLE * 1000 AS b FROM embeddings) SELECT vec_id, round(greatest(a, b), 6) AS bounded, round(greatest(1, greatest(a, b) / greatest(abs(b), 50)), 6) AS ratio, a < b AS inconsistent FROM t""")
def straight_line_bound(spark, d):
    t = read(spark, d, "embeddings").select("vec_id", (F.element_at("embedding", 1).cast("double") * 1000).alias("a"), (F.element_at("embedding", 2).cast("double") * 1000).alias("b"))
    top = F.greatest("a", "b")
    return rounded(t.select("vec_id", top.alias("bounded"), F.greatest(F.lit(1.0), top / F.greatest(F.abs("b"), F.lit(50.0))).alias("ratio"), (F.col("a") < F.col("b")).alias("inconsistent")))
