"""Bindings of the rule tables: texts and codes are made from keys so that every rule is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels
from .bindings import query, read


def _pick(values: tuple, key: str) -> F.Column:
    """One of some texts by a key; null stands for a missing one."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _choose(values: tuple, key: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


_MADE = ("seawall", " Pier ", "QUAY", "groyne", "tower", "breakwater", "causeway", "jetty", None)
_SEA = ("harbour", "marine_farm", "shoreline_construction", "buoy", None, "dredged_area", "artificial_reef")
_CATEGORY = ("wharf;pier", "sea wall, jetty", "", "breakwater; groyne ,other", None)


@query(f"""WITH t AS (SELECT p_partkey AS id, lower(trim({_choose(_MADE, 'p_partkey')})) AS m, lower(trim({_choose(_SEA, 'p_size')})) AS s, {_choose(_CATEGORY, 'p_partkey')} AS c, p_size % 11 = 3 AS farm FROM part),
m AS (SELECT id, CASE m WHEN 'seawall' THEN 'seawall' WHEN 'pier' THEN 'pier' WHEN 'quay' THEN 'port' WHEN 'groyne' THEN 'jetty' WHEN 'jetty' THEN 'jetty' WHEN 'breakwater' THEN 'breakwater' WHEN 'causeway' THEN 'causeway' END AS x FROM t
 UNION SELECT id, CASE s WHEN 'harbour' THEN 'port' WHEN 'marine_farm' THEN 'aquaculture' WHEN 'dredged_area' THEN 'dredged_channel' WHEN 'artificial_reef' THEN 'artificial_reef' END FROM t UNION SELECT id, CASE WHEN farm THEN 'aquaculture' END FROM t
 UNION SELECT id, CASE replace(trim(y), ' ', '_') WHEN 'breakwater' THEN 'breakwater' WHEN 'groyne' THEN 'jetty' WHEN 'jetty' THEN 'jetty' WHEN 'pier' THEN 'pier' WHEN 'wharf' THEN 'pier' WHEN 'seawall' THEN 'seawall' END FROM (SELECT id, unnest(string_split_regex(lower(coalesce(c, '')), '[;,]')) AS y FROM t WHERE s = 'shoreline_construction'))
SELECT t.id, coalesce(string_agg(x, '|' ORDER BY x), '') AS classes FROM t LEFT JOIN m ON m.id = t.id AND x IS NOT NULL GROUP BY t.id""")
def tag_ontology(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), _pick(_MADE, "p_partkey").alias("m"), _pick(_SEA, "p_size").alias("s"), _pick(_CATEGORY, "p_partkey").alias("c"), (F.col("p_size") % 11 == 3).alias("farm"))
    entries = F.array_compact(F.array(*(F.when(F.col(v).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(v).alias("value"))) for k, v in (("man_made", "m"), ("seamark:type", "s"), ("seamark:shoreline_construction:category", "c"))), F.when(F.col("farm"), F.struct(F.lit("aquaculture").alias("key"), F.lit("yes").alias("value")))))
    return p.select("id", F.array_join(labels.tag_classes(F.map_from_entries(entries)), "|").alias("classes"))


_TOLD = ("Passable - no barrier", "Potential barrier", "PARTIAL barrier", " Barrier ", "no barrier seen", None, "unknown", "nan")


@query(f"""WITH t AS (SELECT o_orderkey AS id, x AS t FROM (SELECT o_orderkey, lower(trim(coalesce({_choose(_TOLD, 'o_orderkey')}, ''))) AS x FROM orders)),
s AS (SELECT id, CASE WHEN contains(t, 'passable') AND contains(t, 'no barrier') THEN 'PASSABLE' WHEN contains(t, 'potential') THEN 'POTENTIAL_BARRIER' WHEN contains(t, 'partial') THEN 'PARTIAL' WHEN contains(t, 'barrier') AND NOT contains(t, 'no barrier') THEN 'BLOCKED' ELSE 'UNKNOWN' END AS status FROM t)
SELECT id, status, CASE status WHEN 'PASSABLE' THEN 1.0::DOUBLE WHEN 'BLOCKED' THEN 0.0 END AS share FROM s""")
def described_passage(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _pick(_TOLD, "o_orderkey").alias("t"))
    return o.select("id", labels.described_passage(F.col("t")).alias("x")).select("id", "x.*")


_STATUS, _PERCENT = ("20.0", "10", "No", "barrier", None, "99", "Yes", "not a barrier"), ("10", "20.0", None, "67%", "100%", "0%", "40", "5", "text", None, None)


@query(f"""WITH t AS (SELECT o_orderkey AS id, lower(trim(coalesce({_choose(_STATUS, 'o_orderkey')}, ''))) AS s, lower(trim(coalesce({_choose(_PERCENT, 'o_custkey')}, ''))) AS p FROM orders),
c AS (SELECT id, CASE s WHEN '20.0' THEN '20' ELSE s END AS s, CASE p WHEN '20.0' THEN '20' ELSE p END AS p FROM t),
f AS (SELECT id, s, CASE p WHEN '10' THEN 0.0::DOUBLE WHEN '20' THEN 0.33 WHEN '30' THEN 0.67 WHEN '40' THEN 1.0 WHEN '0%' THEN 0.0 WHEN '33%' THEN 0.33 WHEN '67%' THEN 0.67 WHEN '100%' THEN 1.0 END AS f FROM c),
r AS (SELECT id, f, CASE WHEN f = 1.0 OR s IN ('20', 'no', 'not a barrier', 'no barrier') THEN 'PASSABLE' WHEN f IN (0.33, 0.67) THEN 'PARTIAL' WHEN f = 0.0 OR s IN ('10', 'yes', 'barrier') THEN 'BLOCKED' ELSE 'UNKNOWN' END AS status FROM f)
SELECT id, status, CASE status WHEN 'PASSABLE' THEN 1.0::DOUBLE WHEN 'PARTIAL' THEN f WHEN 'BLOCKED' THEN 0.0 END AS share FROM r""")
def coded_passage(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _pick(_STATUS, "o_orderkey").alias("s"), _pick(_PERCENT, "o_custkey").alias("p"))
    return o.select("id", labels.coded_passage(F.col("s"), F.col("p")).alias("x")).select("id", "x.*")


_KINDS = ("Box Culvert", " CV ", "Tide Gate at mouth", "floodbox", "Old falls", "Waterfall", "cascade", "beaver dam", "Dam", "natural obstacle", "fallsview bridge", None, "weir")


@query(f"""WITH t AS (SELECT p_partkey AS id, lower(trim(coalesce({_choose(_KINDS, 'p_partkey')}, ''))) AS t FROM part)
SELECT id, CASE WHEN contains(t, 'culvert') OR t = 'cv' THEN 'CULVERT' WHEN regexp_matches(t, 'tide gate|tidal gate|floodbox') THEN 'TIDE_GATE' WHEN regexp_matches(t, 'waterfall|\\bfalls?\\b|cascade') THEN 'WATERFALL' WHEN contains(t, 'beaver dam') THEN 'NATURAL_BARRIER'
 WHEN contains(t, 'dam') THEN 'DAM' WHEN regexp_matches(t, 'natural (barrier|obstacle)') THEN 'NATURAL_BARRIER' ELSE 'OTHER_CROSSING' END AS type FROM t""")
def barrier_types(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), _pick(_KINDS, "p_partkey").alias("t"))
    return p.select("id", labels.barrier_type(F.col("t")).alias("type"))


_SETS, _FEATURES, _CODES = ("US_NHD_HR_LEGACY", "HYDRORIVERS_V10", "BC_FWA_STREAM_NETWORK", "US_NHD_SMALL_SCALE"), ("Stream/River", "460", "CanalDitch", "558", None, "StreamRiver", "460.0"), ("46006", "46003", "46007", "33600", None)


@query(f"""WITH t AS (SELECT p_partkey AS id, {_choose(_SETS, 'p_partkey')} AS ds, {_choose(_FEATURES, 'p_size')} AS f, {_choose(_CODES, 'p_partkey')} AS c FROM part)
SELECT id, CASE WHEN ds LIKE 'US_NHD%' AND (replace(replace(lower(f), '/', ''), ' ', '') = 'streamriver' OR try_cast(f AS DOUBLE)::INT = 460) THEN 'natural_channel' WHEN ds LIKE 'US_NHD%' AND f = 'CanalDitch' THEN 'artificial_channel' WHEN ds = 'HYDRORIVERS_V10' THEN 'natural_channel' ELSE 'unknown' END AS source_type,
 CASE WHEN ds LIKE 'US_NHD%' THEN CASE c WHEN '46006' THEN 'perennial' WHEN '46003' THEN 'intermittent' WHEN '46007' THEN 'ephemeral' ELSE 'unknown' END ELSE 'unknown' END AS permanence FROM t""")
def source_classes(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), _pick(_SETS, "p_partkey").alias("ds"), _pick(_FEATURES, "p_size").alias("f"), _pick(_CODES, "p_partkey").alias("c"))
    return p.select("id", labels.source_class(F.col("ds"), F.col("f"), F.col("c")).alias("x")).select("id", "x.*")


@query("""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS depth, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 100)::DOUBLE - 4 END AS slope, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 50)::DOUBLE / 10 - 2.5 END AS z,
 c_custkey % 17 <> 0 AS marine, CASE WHEN c_custkey % 19 <> 0 THEN c_custkey % 23 <> 0 END AS context, CASE WHEN c_custkey % 29 = 0 THEN 'bad' END AS qc FROM customer),
r AS (SELECT *, CASE WHEN depth IS NULL THEN 'depth_unavailable' WHEN depth < 0 THEN 'invalid_positive_down_depth' WHEN NOT marine THEN 'native_marine_depth_not_present' WHEN slope IS NULL THEN 'native_slope_unavailable' WHEN slope < 0 OR slope > 90 THEN 'invalid_native_slope_degrees'
 WHEN z IS NULL THEN 'terrain_position_unavailable' WHEN qc IS NOT NULL THEN 'terrain_position_qc_ineligible' WHEN NOT coalesce(context, false) THEN 'incomplete_four_hop_context' ELSE 'eligible_proxy' END AS reason FROM t)
SELECT id, CASE WHEN reason = 'eligible_proxy' THEN CASE WHEN z >= 1 THEN 'ELEVATED_TERRAIN_PROXY' WHEN z <= -1 THEN 'DEPRESSED_TERRAIN_PROXY' WHEN slope >= 15 THEN 'STEEP_NEUTRAL_TERRAIN_PROXY' WHEN slope <= 5 THEN 'LOW_SLOPE_NEUTRAL_TERRAIN_PROXY' ELSE 'INTERMEDIATE_NEUTRAL_TERRAIN_PROXY' END END AS form, reason FROM r""")
def terrain_forms(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select(
        k.alias("id"), F.when(k % 13 != 0, F.col("c_acctbal")).alias("depth"), F.when(k % 11 != 0, (k % 100).cast("double") - 4).alias("slope"), F.when(k % 7 != 0, (k % 50).cast("double") / 10 - 2.5).alias("z"),
        (k % 17 != 0).alias("marine"), F.when(k % 19 != 0, k % 23 != 0).alias("context"), F.when(k % 29 == 0, "bad").alias("qc"),
    )
    return c.select("id", labels.terrain_form(*(F.col(x) for x in ("depth", "slope", "z", "marine", "context", "qc"))).alias("x")).select("id", "x.*")


_NAMES = ("TOTAL_AREA_M2", "distance_to_shore_M", "REACH_KM", "MEAN_SLOPE_DEG", "COVER_FRAC", "SITE_COUNT", "LAST_YEAR", "label", "MAX_RATIO", "AREA_KM2")


@query(f"""WITH t AS (SELECT p_partkey AS id, {_choose(_NAMES, 'p_partkey')} AS n, (p_partkey % 40) * 0.25 - 2 AS v FROM part), w AS (SELECT *, trim(regexp_replace(lower(n), '_+', ' ', 'g')) AS w FROM t)
SELECT id, upper(substr(w, 1, 1)) || substr(w, 2) AS label, CASE WHEN upper(n) LIKE '%\\_FRACTION' ESCAPE '\\' THEN 'fraction' WHEN upper(n) LIKE '%\\_RATIO' ESCAPE '\\' THEN 'ratio' WHEN upper(n) LIKE '%\\_COUNT' ESCAPE '\\' THEN 'count' WHEN upper(n) LIKE '%\\_YEAR' ESCAPE '\\' THEN 'year' WHEN upper(n) LIKE '%\\_FRAC' ESCAPE '\\' THEN 'fraction'
 WHEN upper(n) LIKE '%\\_KM2' ESCAPE '\\' THEN 'km2' WHEN upper(n) LIKE '%\\_DEG' ESCAPE '\\' THEN 'degree' WHEN upper(n) LIKE '%\\_M2' ESCAPE '\\' THEN 'm2' WHEN upper(n) LIKE '%\\_KM' ESCAPE '\\' THEN 'km' WHEN upper(n) LIKE '%\\_M' ESCAPE '\\' THEN 'm' END AS unit,
 replace(CASE WHEN v = floor(v) THEN v::INT::VARCHAR ELSE rtrim(v::DECIMAL(9, 2)::VARCHAR, '0') END, '.', '_') AS token FROM w""")
def column_labels(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), _pick(_NAMES, "p_partkey").alias("n"), ((F.col("p_partkey") % 40) * 0.25 - 2).alias("v"))
    return p.select("id", labels.human_label(F.col("n")).alias("label"), labels.unit_of(F.col("n")).alias("unit"), labels.number_token(F.col("v")).alias("token"))
