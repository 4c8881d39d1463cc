"""Bindings of the terrain operators over the lattice of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import focal, graph, summary, terrain
from ..sources import rasters
from .bindings import LATTICE, VALUES, _hops, lattice, nodes, query, read, rounded, values
from .bindings_more import _GRID, _grid


def _placed(spark, d):
    return values(spark, d).withColumns({"x": (F.col("node") % 10).cast("double"), "y": F.expr("cast(node div 10 as double)")})


def _hood(spark, d, hops):
    return graph.neighbourhoods(nodes(spark, d), lattice(spark, d), hops)


_WINDOW = """win AS (SELECT hood.src, hops, -v.z AS z, (dst % 10 - src % 10)::DOUBLE AS x, (dst // 10 - src // 10)::DOUBLE AS y FROM hood JOIN vals v ON v.node = dst)"""


def _elimination() -> str:
    """SQL of the six-term fit: moments, then one pivot a step, then substitution."""
    t = terrain.TERMS
    power = lambda p: " * ".join(["1.0::DOUBLE"] + ["x"] * p[0] + ["y"] * p[1])
    cells = [(i, j) for i in range(6) for j in range(i, 6)]
    first = ", ".join([f"sum({power(t[i])} * {power(t[j])}) / pow(u, {sum(t[i]) + sum(t[j])}) AS a{i}_{j}" for i, j in cells] + [f"sum(z * {power(t[i])}) / pow(u, {sum(t[i])}) AS b{i}" for i in range(6)])
    out = [
        "units AS (SELECT src, CASE WHEN count(*) > 5 THEN avg(CASE WHEN x <> 0 OR y <> 0 THEN sqrt(x * x + y * y) END) END AS u FROM win GROUP BY src)",
        f"e0 AS (SELECT src, u, {first} FROM win JOIN units USING (src) GROUP BY src, u)",
    ]
    for k in range(6):
        pivot = f"(CASE WHEN a{k}_{k} > 1e-10 * d{k} THEN a{k}_{k} END)"
        kept = ["src", "u"] + [f"a{i}_{j}" for i, j in cells if i <= k and (i, j) != (k, k)] + [f"b{i}" for i in range(k + 1)] + [f"{pivot} AS a{k}_{k}"]
        new = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / {pivot} AS a{i}_{j}" for i, j in cells if i > k] + [f"b{i} - a{k}_{i} * b{k} / {pivot} AS b{i}" for i in range(k + 1, 6)]
        held = [f"a{i}_{i} AS d{i}" for i in range(6)] if k == 0 else [f"d{i}" for i in range(6)]
        source = f"(SELECT *, {', '.join(held)} FROM e0)" if k == 0 else f"e{k}"
        out.append(f"e{k + 1} AS (SELECT {', '.join(kept + new + [f'd{i}' for i in range(6)])} FROM {source})")
    solved = "e6"
    for k in reversed(range(6)):
        rest = " + ".join(["0.0"] + [f"a{k}_{j} * s{j}" for j in range(k + 1, 6)])
        solved = f"(SELECT *, (b{k} - ({rest})) / a{k}_{k} AS s{k} FROM {solved})"
    out.append(f"fit AS (SELECT src AS node, 2 * s0 / (u * u) AS r, s1 / (u * u) AS s, 2 * s2 / (u * u) AS t, s3 / u AS p, s4 / u AS q FROM {solved})")
    return ",\n".join(out)


@query(f"""WITH {_hops(2)}, {VALUES}, {_WINDOW}, {_elimination()}, f AS (SELECT *, p * p + q * q AS g, r * p * p + 2 * s * p * q + t * q * q AS down, r * q * q - 2 * s * p * q + t * p * p AS level FROM fit)
SELECT node, round(r + t, 6) AS laplacian, round(-(r + t), 6) AS general, round(CASE WHEN g > 1e-18 THEN -down / (g * pow(1 + g, 1.5)) END, 6) AS profile, round(CASE WHEN g > 1e-18 THEN -level / pow(g, 1.5) END, 6) AS plan, round(CASE WHEN g > 1e-18 THEN -level / (g * sqrt(1 + g)) END, 6) AS tangential FROM f""")
def quadratic_curvature(spark, d):
    return rounded(terrain.curvature(_hood(spark, d, 2), _placed(spark, d), 2))


@query(f"""WITH {_hops(1)}, {VALUES}, {_WINDOW}, c AS (SELECT src, z - avg(z) OVER w AS z, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM win WINDOW w AS (PARTITION BY src)),
g AS (SELECT src, CASE WHEN count(*) > 3 AND sum(x * x) * sum(y * y) - sum(x * y) ** 2 > 1e-12 THEN (sum(x * z) * sum(y * y) - sum(y * z) * sum(x * y)) / (sum(x * x) * sum(y * y) - sum(x * y) ** 2) END AS gx,
 CASE WHEN count(*) > 3 AND sum(x * x) * sum(y * y) - sum(x * y) ** 2 > 1e-12 THEN (sum(y * z) * sum(x * x) - sum(x * z) * sum(x * y)) / (sum(x * x) * sum(y * y) - sum(x * y) ** 2) END AS gy FROM c GROUP BY src)
SELECT src AS node, round(avg(abs(z - gx * x - gy * y)), 6) AS roughness FROM c JOIN g USING (src) GROUP BY src""")
def detrended_roughness(spark, d):
    return rounded(terrain.roughness(_hood(spark, d, 1), _placed(spark, d), 1))


def _slopes(spark, d):
    n = F.col("node")
    return nodes(spark, d).select("node", F.when(n % 9 != 4, ((n * 53) % 40).cast("double")).alias("slope"), F.when((n * 53) % 40 > 0, ((n * 71) % 360).cast("double")).alias("aspect"))


_SLOPES = "slopes AS (SELECT node, CASE WHEN node % 9 <> 4 THEN ((node * 53) % 40)::DOUBLE END AS slope, CASE WHEN (node * 53) % 40 > 0 THEN ((node * 71) % 360)::DOUBLE END AS aspect FROM nodes)"


@query(f"""WITH {_hops(2)}, {_SLOPES}, n AS (SELECT node, radians(slope) AS a, radians(CASE WHEN slope > 1e-12 THEN coalesce(aspect, 0) ELSE 0 END) AS b FROM slopes WHERE slope IS NOT NULL)
SELECT src AS node, round(greatest(0.0, least(1.0, 1 - sqrt(avg(sin(a) * sin(b)) ** 2 + avg(sin(a) * cos(b)) ** 2 + avg(cos(a)) ** 2))), 6) AS vrm FROM hood JOIN n ON n.node = dst WHERE hops <= 2 GROUP BY src""")
def vector_ruggedness(spark, d):
    return rounded(terrain.vector_ruggedness(_hood(spark, d, 2), _slopes(spark, d), 2))


@query(f"WITH {_hops(2)}, {_SLOPES} SELECT src AS node, round(avg(slope), 6) AS slope_mean, round(quantile_cont(slope, 0.9), 6) AS slope_q90 FROM hood JOIN slopes ON node = dst WHERE slope IS NOT NULL GROUP BY src")
def ring_slope_statistics(spark, d):
    return rounded(terrain.slope_statistics(_hood(spark, d, 2), _slopes(spark, d), 2))


def _ring(h):
    return f"""a{h} AS (SELECT hood.src, avg(CASE WHEN hops > 0 THEN v.z END) - any_value(f.z) AS tpi, stddev_pop(v.z) AS std FROM hood JOIN vals v ON v.node = hood.dst JOIN vals f ON f.node = hood.src WHERE hops <= {h} GROUP BY hood.src)"""


_Z = "CASE WHEN std > 1e-9 THEN tpi / std WHEN abs(tpi) <= 1e-9 THEN 0.0 END"


@query(f"""WITH {_hops(2)}, {VALUES}, {_ring(1)}, {_ring(2)}, s AS (SELECT src, a1.tpi AS bend, CASE WHEN a1.std > 1e-9 THEN a1.tpi / a1.std WHEN abs(a1.tpi) <= 1e-9 THEN 0.0 END AS z1, CASE WHEN a2.std > 1e-9 THEN a2.tpi / a2.std WHEN abs(a2.tpi) <= 1e-9 THEN 0.0 END AS z2 FROM a1 JOIN a2 USING (src)),
x AS (SELECT src, bend, greatest(z1, z2) AS high, least(z1, z2) AS low FROM s)
SELECT src AS node, round(CASE WHEN high IS NOT NULL THEN least(1.0, greatest(0.0, high / 3)) END, 6) AS ridge, round(CASE WHEN low IS NOT NULL THEN least(1.0, greatest(0.0, -low / 3)) END, 6) AS valley,
 round(CASE WHEN bend IS NOT NULL THEN least(1.0, greatest(0.0, bend / 50)) END, 6) AS convexity, round(CASE WHEN bend IS NOT NULL THEN least(1.0, greatest(0.0, -bend / 50)) END, 6) AS concavity FROM x""")
def ridge_valley_indices(spark, d):
    hood, v = _hood(spark, d, 2), values(spark, d)
    one, two = (focal.ring_statistics(hood, v, h).select("node", F.col("tpi").alias(f"t{h}"), F.col("tpi_z").alias(f"z{h}")) for h in (1, 2))
    return rounded(terrain.shape_indices(one.join(two, "node"), ["z1", "z2"], "t1", 50.0))


@query(f"""WITH {_hops(1)}, {VALUES}, {_ring(1)} SELECT src AS node, round({_Z}, 6) AS tpi_z, CASE WHEN tpi IS NULL OR std IS NULL THEN 'no_neighbours' WHEN std > 1e-9 THEN 'ok' WHEN abs(tpi) <= 1e-9 THEN 'flat' ELSE 'no_spread' END AS quality FROM a1""")
def terrain_position_quality(spark, d):
    r = focal.ring_statistics(_hood(spark, d, 1), values(spark, d), 1)
    return rounded(r.select("node", "tpi_z", terrain.position_quality(F.col("tpi"), F.col("std")).alias("quality")))


@query(f"""WITH {_hops(3)}, n AS (SELECT src, count(*) AS n_cells FROM hood GROUP BY src), i AS (SELECT h.src, count(*) AS inner_ FROM hood h JOIN arcs a ON a.src = h.dst JOIN hood k ON k.src = h.src AND k.dst = a.dst GROUP BY h.src),
p AS (SELECT src, n_cells, n_cells * 10.0::DOUBLE AS area, (6 * n_cells - coalesce(inner_, 0)) * 2.0::DOUBLE AS perimeter FROM n LEFT JOIN i USING (src))
SELECT src AS node, n_cells, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(CASE WHEN perimeter > 0 THEN least(1.0, 4 * pi() * area / (perimeter * perimeter)) END, 6) AS compactness FROM p""")
def local_water_space(spark, d):
    return rounded(terrain.water_space(_hood(spark, d, 3), graph.mirrored(lattice(spark, d)), 3, 10.0, 2.0))


@query("""WITH s AS (SELECT o_custkey AS line, o_orderkey AS pos, (o_orderkey % 97)::DOUBLE AS x, (o_orderkey % 89)::DOUBLE AS y FROM orders),
d AS (SELECT line, pos, x - lag(x) OVER w AS ix, y - lag(y) OVER w AS iy, lead(x) OVER w - x AS ox, lead(y) OVER w - y AS oy FROM s WINDOW w AS (PARTITION BY line ORDER BY pos))
SELECT line, pos, round(degrees(atan2(ix * oy - iy * ox, ix * ox + iy * oy)), 6) AS turn FROM d WHERE degrees(atan2(ix * oy - iy * ox, ix * ox + iy * oy)) >= 60""")
def headland_candidates(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y"))
    return rounded(terrain.headlands(o, 60.0))


@query(f"""WITH {_GRID}, s AS (SELECT g.row, g.col, degrees(atan(sqrt(power((e.value - w.value) / 60.0::DOUBLE, 2) + power((s.value - n.value) / 50.0::DOUBLE, 2)))) AS slope FROM grid g
 LEFT JOIN grid s ON s.row = g.row + 1 AND s.col = g.col LEFT JOIN grid n ON n.row = g.row - 1 AND n.col = g.col LEFT JOIN grid e ON e.row = g.row AND e.col = g.col + 1 LEFT JOIN grid w ON w.row = g.row AND w.col = g.col - 1)
SELECT (row // 4) * 10 + col // 4 AS cell, count(slope) AS n, round(avg(slope), 6) AS slope_mean, round(quantile_cont(slope, 0.9), 6) AS slope_q90 FROM s GROUP BY 1""")
def raster_slope_by_cell(spark, d):
    g = rasters.gradient(_grid(spark, d), 25.0, 30.0).withColumn("cell", F.expr("(row div 4) * 10 + col div 4"))
    return rounded(summary.slope_summary(g, "cell", "slope"))
