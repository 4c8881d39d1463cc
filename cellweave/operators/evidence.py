"""Selections, memberships, interval and as-of joins, rollups and gates over cell evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .contracts import ContractError


def eligible_extents(inventory: DataFrame, datasets: str) -> DataFrame:
    """Records of the datasets (a pattern) that were observed, are present, have area and a share in (0, 1]."""
    return inventory.where(F.col("dataset").rlike(datasets) & (F.col("state") == "observed") & F.coalesce("present", F.lit(False)) & (F.col("kind") == "polygon") & (F.col("share") > 0) & (F.col("share") <= 1))


def consumed(df: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fault): what keeps a table from serving a role's cells: a cell without a row, a row outside, a repeated key; empty if it serves."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = membership.select(*keys, F.lit(True).alias("member")).join(counted, keys, "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("member").isNull(), "outside").when(F.col("n") > 1, "repeated")
    return both.select(*keys, fault.alias("fault")).where("fault IS NOT NULL")


def applied(df: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the columns that the catalog (name, exclusion) leaves in; a listed column that is not there is an error."""
    chosen = [r["name"] for r in catalog.where("exclusion IS NULL").orderBy("name").collect()]  # column names, not data
    gone = [c for c in chosen if c not in df.columns]
    if gone:
        raise ContractError(f"eligible columns are missing: {gone[:5]}")
    return df.select(*keys, *(c for c in chosen if c not in keys))


def ray_origins(cells: DataFrame) -> DataFrame:
    """(id, x, y, origin): a cell's own point in water, else its connector's target, else its centre."""
    origin = F.when(F.col("px").isNotNull() & F.col("py").isNotNull(), "focal").when(F.col("tx").isNotNull() & F.col("ty").isNotNull(), "connector").otherwise("centre")
    pick = lambda a, b, c: F.when(origin == "focal", F.col(a)).when(origin == "connector", F.col(b)).otherwise(F.col(c))
    return cells.select("id", pick("px", "tx", "cx").alias("x"), pick("py", "ty", "cy").alias("y"), origin.alias("origin"))


def parent_lengths(children: DataFrame, parent: str, parts: list[str], total: str) -> DataFrame:
    """Sums by parent, null where no child knows, and shares recomputed from the sums."""
    s = children.groupBy(parent).agg(*(F.sum(c).alias(c) for c in (*parts, total)))
    return s.select(parent, *parts, total, *(F.when(F.col(total) > 0, F.col(c) / F.col(total)).alias(f"{c}_share") for c in parts))


def positive_pixels(pixels: DataFrame, footprints: DataFrame, cell: str, pixel_area: float) -> DataFrame:
    """(cell, n_positive, pixel_area, footprint_area, within): centres counted against the mapped area that should hold them."""
    p = pixels.where("value > 0").groupBy(cell).agg(F.count(F.lit(1)).alias("n_positive"))
    j = p.join(footprints.select(cell, "footprint_area"), cell, "full").withColumn("n_positive", F.coalesce("n_positive", F.lit(0)))
    area = F.col("n_positive") * pixel_area
    return j.select(cell, "n_positive", area.alias("pixel_area"), "footprint_area", (area <= F.coalesce("footprint_area", F.lit(0.0)) + pixel_area).alias("within"))


def combined(composites: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Composites one below the other with their source, each with its own interval [start, end); an interval without length is an error."""
    out = None
    for name, df in sorted(composites.items()):
        part = df.where(F.assert_true(F.col("start") < F.col("end"), F.lit("an interval must have length")).isNull()).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(*keys, "source", "start", "end", *(c for c in out.columns if c not in (*keys, "source", "start", "end")))


def overlapping(requests: DataFrame, periods: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(request, period, keys): half-open spans of the same key that overlap; both sides (id, start, end as numbers) meet by slots of ``width``."""

    def slotted(df: DataFrame, side: str) -> DataFrame:
        named = df.where("start < end").select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in ("id", "start", "end")))
        return named.withColumn("slot", F.explode(F.sequence(F.floor(F.col(f"{side}_start") / width), F.floor((F.col(f"{side}_end") - 1) / width))))

    both = slotted(requests, "a").join(slotted(periods, "b"), [*keys, "slot"]).where("a_start < b_end AND b_start < a_end")
    # a pair is taken in the first slot that both spans meet
    return both.where(F.col("slot") == F.floor(F.greatest("a_start", "b_start") / width)).select(*keys, F.col("a_id").alias("request"), F.col("b_id").alias("period"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` (id, key, at) with the latest ``value`` of ``right`` (key, at, value) at or before: one sort of both, no product."""
    order = W.partitionBy(key).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    kind = right.schema[value].dataType
    every = left.select(key, at, "id", F.lit(1).alias("__side"), F.lit(None).cast(kind).alias(value)).unionByName(right.groupBy(key, at).agg(F.max(value).alias(value)).withColumns({"id": F.lit(None).cast(left.schema["id"].dataType), "__side": F.lit(0)}))
    return every.withColumn("found", F.last(value, ignorenulls=True).over(order)).where("__side = 1").select("id", key, at, F.col("found").alias(value))


def structure_density(within: DataFrame, structures: DataFrame, cell_km2: float) -> DataFrame:
    """(node, structures, area_km2, density): structures of the cells in reach (object, node), at least one for each record, over the reachable area."""
    counts = structures.groupBy("node").agg(F.sum(F.greatest(F.lit(1), F.coalesce("count", F.lit(1)))).alias("n"))
    j = within.join(counts, "node", "left").groupBy(F.col("object").alias("node")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("structures"), (F.count(F.lit(1)) * cell_km2).alias("area_km2"))
    return j.withColumn("density", F.col("structures") / F.col("area_km2"))


def bounded_distance(network: Column, straight: Column) -> Column:
    """A way through the network is never shorter than the straight line."""
    return F.when(network.isNotNull(), F.greatest(network.cast("double"), straight))


def detour_status(network: Column, straight: Column, floor: float) -> Column:
    """struct(ratio, status): the way over the straight line, at least 1; a shorter way is inconsistent."""
    ratio = F.greatest(F.lit(1.0), network / F.greatest(straight, F.lit(floor)))
    status = F.when(network.isNull(), "unreachable").when(network < straight - 1e-6, "metric_inconsistency").otherwise("reachable")
    return F.struct(F.when(status == "reachable", ratio).alias("ratio"), status.alias("status"))


def rays(origins: DataFrame, wet: DataFrame, bearings: int, step: float, stations: int, pixel: float) -> DataFrame:
    """(id, bearing, distance, censored): along each bearing the last station before the first one that is not in a wet pixel (row, col)."""
    angle = F.col("bearing") * (360.0 / bearings)
    every = origins.withColumn("bearing", F.explode(F.sequence(F.lit(0), F.lit(bearings - 1)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(stations))))
    at = every.withColumn("col", F.floor(F.round(F.col("x") + F.col("k") * step * F.sin(F.radians(angle)), 6) / pixel)).withColumn("row", F.floor(F.round(F.col("y") + F.col("k") * step * F.cos(F.radians(angle)), 6) / pixel))
    tested = at.join(wet.select("row", "col", F.lit(True).alias("wet")), ["row", "col"], "left")
    first = tested.groupBy("id", "bearing").agg(F.min(F.when(F.col("wet").isNull(), F.col("k"))).alias("dry"))
    return first.select("id", "bearing", ((F.coalesce("dry", F.lit(stations + 1)) - 1) * step).alias("distance"), F.col("dry").isNull().alias("censored"))


def percentage_faults(pixels: DataFrame, cell: str, value: str, nodata: float) -> DataFrame:
    """(cell, n, n_nodata, n_outside, valid_share): a percentage raster may hold 0..100 and its nodata value."""
    v = F.col(value)
    none = v.isNull() | F.isnan(v) | (v == nodata)
    counted = pixels.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.count_if(none).alias("n_nodata"), F.count_if(~none & ~v.between(0, 100)).alias("n_outside"))
    return counted.withColumn("valid_share", (F.col("n") - F.col("n_nodata") - F.col("n_outside")) / F.col("n"))


def mapped_positive(records: DataFrame, support: DataFrame, cell: str) -> DataFrame:
    """(cell, positive, sources): true where any record is positive; without one it is unknown, never false."""
    hit = records.where("present").groupBy(cell).agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
    return support.select(cell).join(hit, cell, "left").select(cell, F.when(F.col("sources").isNotNull(), True).alias("positive"), "sources")


def datum_gate(depth: Column, datum: Column, offsets: dict[str, float]) -> Column:
    """struct(depth, reason): a depth on the common datum, if its own is known and the result is not above water."""
    table = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))
    moved = depth + F.try_element_at(table, datum)
    reason = F.when(depth.isNull(), "depth_unavailable").when(datum.isNull(), "datum_unknown").when(moved.isNull(), "datum_not_convertible").when(moved < 0, "above_datum").otherwise("accepted")
    return F.struct(F.when(reason == "accepted", moved).alias("depth"), reason.alias("reason"))


def outlet_inventory(mouths: DataFrame, per_basin: int) -> DataFrame:
    """The largest outlets of every basin (basin, id, flow), by flow and id, with their rank."""
    ranked = mouths.withColumn("rank", F.row_number().over(W.partitionBy("basin").orderBy(F.desc_nulls_last("flow"), "id")))
    return ranked.where(F.col("rank") <= per_basin).select("basin", "id", "flow", "rank")


def json_faults(df: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """``df`` with ``fault``: not_an_object, missing:<field>, type:<field> or unknown_field by a small schema (field: bigint, double, boolean or string; ? behind it: optional); null where it holds."""
    keys = F.json_object_keys(F.col(text))
    tests = [F.when(keys.isNull(), "not_an_object")]
    for name, kind in sorted(fields.items()):
        raw, there = F.get_json_object(text, f"$.{name}"), F.array_contains(keys, name)
        if not kind.endswith("?"):
            tests.append(F.when(~there, f"missing:{name}"))
        if kind.rstrip("?") != "string":
            tests.append(F.when(there & raw.isNotNull() & raw.try_cast(kind.rstrip("?")).isNull(), f"type:{name}"))
    tests.append(F.when(F.size(F.array_except(keys, F.array(*map(F.lit, sorted(fields))))) > 0, "unknown_field"))
    return df.withColumn("fault", F.coalesce(*tests))


def compacted(df: DataFrame, keys: list[str]) -> tuple[DataFrame, dict]:
    """(narrow table, constants): columns with one value over all rows move out of the table; ``expanded`` puts them back."""
    others = [c for c in df.columns if c not in keys]
    row = df.agg(*(F.count_distinct(c).alias(f"n_{i}") for i, c in enumerate(others)), *(F.count_if(F.col(c).isNull()).alias(f"z_{i}") for i, c in enumerate(others)), *(F.max(c).alias(f"v_{i}") for i, c in enumerate(others))).first()
    single = [i for i in range(len(others)) if (row[f"n_{i}"] == 1 and row[f"z_{i}"] == 0) or row[f"n_{i}"] == 0]
    constants = {"order": df.columns, "values": {others[i]: row[f"v_{i}"] for i in single}, "types": {others[i]: df.schema[others[i]].dataType.simpleString() for i in single}}
    return df.drop(*(others[i] for i in single)), constants


def expanded(df: DataFrame, constants: dict) -> DataFrame:
    """The table as it was before ``compacted``."""
    out = df.withColumns({c: F.lit(v).cast(constants["types"][c]) for c, v in constants["values"].items()}) if constants["values"] else df
    return out.select(*constants["order"])


def omitted(df: DataFrame, reviewed: list[str], keys: list[str]) -> DataFrame:
    """``df`` without the reviewed fields; a key or an unknown field among them is an error."""
    wrong = [c for c in reviewed if c in keys or c not in df.columns]
    if wrong:
        raise ContractError(f"fields cannot be left out: {wrong[:5]}")
    return df.drop(*reviewed)


def within_budget(df: DataFrame, rows: int, name: str = "table") -> DataFrame:
    """``df``, if it has at most so many rows; otherwise an error that names both numbers."""
    n = df.limit(rows + 1).count()
    if n > rows:
        raise ContractError(f"{name}: more than {rows} rows")
    return df


def bank_sections(banks: DataFrame, limit: float) -> DataFrame:
    """(section, width, mx, my, status): the two banks of a section (section, side L or R, x, y), its width and middle; open where a bank lacks or the sides are too far apart."""
    s = banks.groupBy("section").agg(*(F.min(F.when(F.col("side") == side, F.struct("x", "y"))).alias(side) for side in "LR"))
    width = F.hypot(F.col("L.x") - F.col("R.x"), F.col("L.y") - F.col("R.y"))
    status = F.when(F.col("L").isNull() | F.col("R").isNull(), "one_bank").when(width > limit, "too_wide").otherwise("bounded")
    ok = status == "bounded"
    return s.select("section", F.when(ok, width).alias("width"), F.when(ok, (F.col("L.x") + F.col("R.x")) / 2).alias("mx"), F.when(ok, (F.col("L.y") + F.col("R.y")) / 2).alias("my"), status.alias("status"))


def keys_in_order(df: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in the order of a membership's positions (keys, position)."""
    return df.join(membership.select(*keys, "position"), keys).orderBy("position").drop("position")


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the schema's columns and types; a value that does not fit is an error."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
