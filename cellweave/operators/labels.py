"""Rule tables that turn source codes and texts into classes, as column expressions.

The word lists, codes and thresholds are fixed values of the data model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag key, tag value, feature class.
TAG_CLASSES = (
    ("man_made", "seawall", "seawall"),
    ("man_made", "breakwater", "breakwater"),
    ("man_made", "groyne", "jetty"),
    ("man_made", "jetty", "jetty"),
    ("man_made", "pier", "pier"),
    ("man_made", "causeway", "causeway"),
    ("man_made", "quay", "port"),
    ("amenity", "ferry_terminal", "ferry_terminal"),
    ("leisure", "marina", "marina"),
    ("industrial", "port", "port"),
    ("harbour", "yes", "port"),
    ("landuse", "aquaculture", "aquaculture"),
    ("seamark:type", "causeway", "causeway"),
    ("seamark:type", "dredged_area", "dredged_channel"),
    ("seamark:type", "dumping_ground", "disposal_site"),
    ("seamark:type", "artificial_reef", "artificial_reef"),
    ("seamark:type", "marine_farm", "aquaculture"),
    ("seamark:type", "harbour", "port"),
)
#: Tags whose presence alone names a class, and categories of a shoreline construction.
TAG_PRESENT = (("aquaculture", "aquaculture"),)
CONSTRUCTION_CLASSES = {"breakwater": "breakwater", "groyne": "jetty", "jetty": "jetty", "pier": "pier", "wharf": "pier", "seawall": "seawall"}
#: Terrain-form names and thresholds (position, steep slope, gentle slope in degrees).
FORMS = ("ELEVATED_TERRAIN_PROXY", "DEPRESSED_TERRAIN_PROXY", "STEEP_NEUTRAL_TERRAIN_PROXY", "LOW_SLOPE_NEUTRAL_TERRAIN_PROXY", "INTERMEDIATE_NEUTRAL_TERRAIN_PROXY")
POSITION, STEEP, GENTLE = 1.0, 15.0, 5.0
#: Permanence by feature code.
PERMANENCE = {"46006": "perennial", "46003": "intermittent", "46007": "ephemeral"}
#: Share passed by coded percentage.
PASSED = {"10": 0.0, "20": 0.33, "30": 0.67, "40": 1.0, "0%": 0.0, "33%": 0.33, "67%": 0.67, "100%": 1.0}


def cleaned(c: Column) -> Column:
    """Lower-case trimmed text; null becomes the empty text."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def _lookup(values: dict, key: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.try_element_at(pairs, key)


def tag_classes(tags: Column) -> Column:
    """Sorted distinct classes of a map of tags."""
    known = F.transform_values(tags, lambda _, v: F.lower(F.trim(v)))
    by_value = [F.when(F.try_element_at(known, F.lit(k)) == v, F.lit(c)) for k, v, c in TAG_CLASSES]
    by_key = [F.when(F.array_contains(F.map_keys(known), k), F.lit(c)) for k, c in TAG_PRESENT]
    parts = F.when(F.try_element_at(known, F.lit("seamark:type")) == "shoreline_construction", F.split(F.coalesce(F.try_element_at(known, F.lit("seamark:shoreline_construction:category")), F.lit("")), "[;,]"))
    built = F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: _lookup(CONSTRUCTION_CLASSES, F.replace(F.trim(x), F.lit(" "), F.lit("_"))))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*by_value, *by_key), built))))


def described_passage(text: Column) -> Column:
    """struct(status, share) of a described barrier: the first rule that holds."""
    t = cleaned(text)
    free = t.contains("no barrier")
    rules = [(t.contains("passable") & free, "PASSABLE", 1.0), (t.contains("potential"), "POTENTIAL_BARRIER", None), (t.contains("partial"), "PARTIAL", None), (t.contains("barrier") & ~free, "BLOCKED", 0.0)]
    return _first(rules, F.struct(F.lit("UNKNOWN").alias("status"), F.lit(None).cast("double").alias("share")))


def _first(rules: list, otherwise: Column) -> Column:
    made = [(c, F.struct(F.lit(s).alias("status"), (x if isinstance(x, Column) else F.lit(x).cast("double")).alias("share"))) for c, s, x in rules]
    return reduce(lambda a, b: a.when(*b), made[1:], F.when(*made[0])).otherwise(otherwise)


def coded_passage(status: Column, percent: Column) -> Column:
    """struct(status, share) of coded assessment fields; numbers may be written as decimals."""

    def code(c: Column) -> Column:
        t = cleaned(c)
        return F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), t.try_cast("double").cast("long").cast("string")).otherwise(t)

    s, share = code(status), _lookup(PASSED, code(percent))
    rules = [
        (F.coalesce(share == 1.0, F.lit(False)) | s.isin("20", "no", "not a barrier", "no barrier"), "PASSABLE", 1.0),
        (F.coalesce(share.isin(0.33, 0.67), F.lit(False)), "PARTIAL", share),
        (F.coalesce(share == 0.0, F.lit(False)) | s.isin("10", "yes", "barrier"), "BLOCKED", 0.0),
    ]
    return _first(rules, F.struct(F.lit("UNKNOWN").alias("status"), F.lit(None).cast("double").alias("share")))


def barrier_type(text: Column, otherwise: str = "OTHER_CROSSING") -> Column:
    """Type of a barrier by the words of its description, in fixed precedence."""
    t = cleaned(text)
    return (
        F.when(t.contains("culvert") | (t == "cv"), "CULVERT")
        .when(t.rlike("tide gate|tidal gate|floodbox"), "TIDE_GATE")
        .when(t.rlike(r"waterfall|\bfalls?\b|cascade"), "WATERFALL")
        .when(t.contains("beaver dam"), "NATURAL_BARRIER")
        .when(t.contains("dam"), "DAM")
        .when(t.rlike("natural (barrier|obstacle)"), "NATURAL_BARRIER")
        .otherwise(otherwise)
    )


def source_class(dataset: Column, feature: Column, code: Column) -> Column:
    """struct(source_type, permanence) of a river segment: documented codes only, the rest unknown."""
    hydro = dataset.isin("US_NHD_SMALL_SCALE", "US_NHD_HR_LEGACY")
    plain = F.regexp_replace(cleaned(feature), "[/ ]", "")
    kind = F.when(hydro & (plain.isin("streamriver") | (plain.try_cast("double").cast("int") == 460)), "natural_channel").when(hydro & (F.trim(feature) == "CanalDitch"), "artificial_channel").when(dataset == "HYDRORIVERS_V10", "natural_channel").otherwise("unknown")
    return F.struct(kind.alias("source_type"), F.coalesce(F.when(hydro, _lookup(PERMANENCE, F.trim(code))), F.lit("unknown")).alias("permanence"))


def terrain_form(depth: Column, slope: Column, position: Column, marine: Column, context: Column, quality: Column) -> Column:
    """struct(form, reason): the first reason that makes a cell ineligible, else its form by position and slope."""

    def known(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    checks = (
        (~known(depth), "depth_unavailable"),
        (depth < 0, "invalid_positive_down_depth"),
        (~F.coalesce(marine, F.lit(False)), "native_marine_depth_not_present"),
        (~known(slope), "native_slope_unavailable"),
        ((slope < 0) | (slope > 90), "invalid_native_slope_degrees"),
        (~known(position), "terrain_position_unavailable"),
        (quality.isNotNull(), "terrain_position_qc_ineligible"),
        (~F.coalesce(context, F.lit(False)), "incomplete_four_hop_context"),
    )
    reason = F.coalesce(*(F.when(c, name) for c, name in checks), F.lit("eligible_proxy"))
    form = F.when(position >= POSITION, FORMS[0]).when(position <= -POSITION, FORMS[1]).when(slope >= STEEP, FORMS[2]).when(slope <= GENTLE, FORMS[3]).otherwise(FORMS[4])
    return F.struct(F.when(reason == "eligible_proxy", form).alias("form"), reason.alias("reason"))


def number_token(text: Column) -> Column:
    """A number as part of a column's name: no trailing zeros, the point written as an underscore."""
    return F.replace(F.call_function("format_number", text.cast("double"), F.lit("0.##########")), F.lit("."), F.lit("_"))


#: Unit by the ending of a column's name.
UNITS = (("_M2", "m2"), ("_KM2", "km2"), ("_KM", "km"), ("_DEG", "degree"), ("_FRAC", "fraction"), ("_FRACTION", "fraction"), ("_RATIO", "ratio"), ("_COUNT", "count"), ("_YEAR", "year"), ("_M", "m"))


def human_label(name: Column) -> Column:
    """A column's name as words: underscores as blanks, the first letter a capital."""
    words = F.trim(F.regexp_replace(F.lower(name), "_+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def unit_of(name: Column) -> Column:
    """The unit that a column's name ends in, the longest first; null where it names none."""
    rules = sorted(UNITS, key=lambda x: -len(x[0]))
    return reduce(lambda a, b: a.when(F.upper(name).endswith(b[0]), b[1]), rules[1:], F.when(F.upper(name).endswith(rules[0][0]), rules[0][1]))
