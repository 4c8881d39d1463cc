"""Vector and grid files as tables: GeoJSON and well-known text as rings, text grids as pixels, pins of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature, properties, kind, part, ring_no, ring): a row a ring of polygons and multipolygons, a row a line of the line types, a row a point.

    Files are feature collections, each parsed by one task. A ring's closing point is left out. Features without geometry keep a row without a ring.
    """
    schema = "struct<features: array<struct<properties: string, geometry: struct<type: string, coordinates: string>>>>"
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("c"))
    features = files.select("file", F.posexplode("c.features").alias("feature", "f")).select("file", "feature", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("text"))
    deep = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Point": "array<double>"}
    wrap = {"Polygon": lambda c: F.array(c), "MultiPolygon": lambda c: c, "LineString": lambda c: F.array(F.array(c)), "MultiLineString": lambda c: F.array(c), "Point": lambda c: F.array(F.array(F.array(c)))}
    parts = F.coalesce(*(F.when(F.col("kind") == k, wrap[k](F.from_json("text", t))) for k, t in deep.items()))
    rings = features.withColumn("parts", parts).select("file", "feature", "properties", "kind", F.posexplode_outer("parts").alias("part", "rings")).select("file", "feature", "properties", "kind", "part", F.posexplode_outer("rings").alias("ring_no", "points"))
    return rings.select("file", "feature", "properties", "kind", "part", "ring_no", _open(F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("ring"))


def _open(ring: Column) -> Column:
    """A ring without its repeated last point."""
    closed = (F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def wkt_rings(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with (ring_no, ring) for every ring of a POLYGON or MULTIPOLYGON text."""
    rings = F.regexp_extract_all(F.col(text), F.lit(r"\(([^()]+)\)"), 1)
    kept = [c for c in df.columns if c != text]
    one = df.select(*kept, F.posexplode(rings).alias("ring_no", "__t"))
    points = F.transform(F.split("__t", r"\s*,\s*"), lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), 0).cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("y")))
    return one.select(*kept, "ring_no", _open(points).alias("ring"))


def text_grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, value, x, y): the pixels of grids in text form (ncols, nrows, xllcorner, yllcorner, cellsize, NODATA_value, then rows from the top).

    A file is read by one task; nodata becomes null, x and y are pixel centres.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\r?\n").alias("lines"))
    head = F.map_from_entries(F.transform(F.filter("lines", lambda s: s.rlike("^[A-Za-z]")), lambda s: F.struct(F.lower(F.split(s, r"\s+")[0]), F.split(s, r"\s+")[1])))
    rows = whole.select("file", head.alias("h"), F.posexplode(F.filter("lines", lambda s: s.rlike("^[ \t]*[-+.0-9]"))).alias("row", "line"))
    pixels = rows.select("file", "h", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    number = lambda k: F.try_element_at(F.col("h"), F.lit(k)).cast("double")
    value = F.col("v").cast("double")
    return pixels.select(
        "file", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.when(~value.eqNullSafe(number("nodata_value")), value).alias("value"),
        (number("xllcorner") + (F.col("col") + 0.5) * number("cellsize")).alias("x"), (number("yllcorner") + (number("nrows") - F.col("row") - 0.5) * number("cellsize")).alias("y"),
    )


def pin_faults(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """(name, fault): source files whose digest is not the pinned one (name, sha256), that lack, or that no pin names."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    both = pins.select("name", "sha256").join(found, "name", "full")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "not_pinned").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("name", fault.alias("fault")).where("fault IS NOT NULL")
