"""Operators whose results are tables and errors rather than a query's rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import evidence, polygons, terrain
from cellweave.operators.contracts import ContractError


def test_compacted_tables_come_back(spark):
    df = spark.createDataFrame([(i, "all", None, i % 2, 1.5) for i in range(6)], "id long, kind string, gone string, v int, w double")
    slim, constants = evidence.compacted(df, ["id"])
    assert slim.columns == ["id", "v"]
    back = evidence.expanded(slim, constants)
    assert back.columns == df.columns and back.dtypes == df.dtypes
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


def test_chosen_and_omitted_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int")
    catalog = spark.createDataFrame([("a", None), ("b", "support")], "name string, exclusion string")
    assert evidence.applied(df, catalog, ["k"]).columns == ["k", "a"]
    assert evidence.omitted(df, ["b"], ["k"]).columns == ["k", "a"]
    with pytest.raises(ContractError):
        evidence.applied(df.drop("a"), catalog, ["k"])
    for wrong in ("k", "z"):
        with pytest.raises(ContractError):
            evidence.omitted(df, [wrong], ["k"])


def test_budgets_are_hard_limits(spark):
    assert evidence.within_budget(spark.range(5), 5).count() == 5
    with pytest.raises(ContractError):
        evidence.within_budget(spark.range(6), 5)


def test_intervals_without_length_are_refused(spark):
    good = spark.createDataFrame([(1, 2, 3)], "cell int, start int, end int")
    assert evidence.combined({"a": good, "b": good}, ["cell"]).count() == 2
    with pytest.raises(Exception, match="length"):
        evidence.combined({"a": spark.createDataFrame([(1, 3, 3)], "cell int, start int, end int")}, ["cell"]).collect()


def test_curvature_of_known_surfaces(spark):
    """A paraboloid's second derivatives come back exactly; a plane has none; five cells in a line give nothing."""
    side = range(-2, 3)
    cells = [(10 * (x + 2) + y + 2, x * 100.0, y * 100.0) for x in side for y in side]
    hood = spark.createDataFrame([(22, n, 0 if n == 22 else 1) for n, _, _ in cells], "src long, dst long, hops int")
    bowl = [(n, -(0.002 * x * x - 0.001 * x * y + 0.003 * y * y + 0.2 * x - 0.1 * y + 7), x, y) for n, x, y in cells]
    got = terrain.curvature(hood, spark.createDataFrame(bowl, "node long, z double, x double, y double"), 1).first()
    p, q, r, s, t = 0.2, -0.1, 0.004, -0.001, 0.006
    g = p * p + q * q
    assert np.isclose(got["laplacian"], r + t) and np.isclose(got["general"], -r - t)
    assert np.isclose(got["profile"], -(r * p * p + 2 * s * p * q + t * q * q) / (g * (1 + g) ** 1.5))
    assert np.isclose(got["plan"], -(r * q * q - 2 * s * p * q + t * p * p) / g**1.5)
    flat = terrain.curvature(hood, spark.createDataFrame([(n, 5.0, x, y) for n, x, y in cells], "node long, z double, x double, y double"), 1).first()
    assert abs(flat["laplacian"]) < 1e-12 and flat["plan"] is None
    line = hood.where(F.col("dst") % 10 == 2)
    assert terrain.curvature(line, spark.createDataFrame(bowl, "node long, z double, x double, y double"), 1).first()["laplacian"] is None


def test_union_area_of_squares(spark):
    """Two squares that overlap by a quarter, one with a hole: areas by hand."""
    ring = lambda x, y, s: [(float(x), float(y)), (x + float(s), float(y)), (x + float(s), y + float(s)), (float(x), y + float(s))]
    rows = [("k", 1, ring(0, 0, 4)), ("k", 2, ring(2, 2, 4)), ("k", 1, ring(0.5, 0.5, 1))]
    r = spark.createDataFrame(rows, "cell string, poly int, ring array<struct<x:double,y:double>>")
    for band in (1.0, 3.0, 100.0):
        got = polygons.union_area(polygons.edges(r), ["cell"], band).first()
        assert np.isclose(got["union_area"], 16 + 16 - 4 - 1) and np.isclose(got["overlap_area"], 4) and np.isclose(got["total_area"], 31)
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 0.0, 2.0), (4, 9.0, 9.0), (5, 0.25, 0.25)], "point int, x double, y double")
    found = {(x["point"], x["poly"]): x["boundary"] for x in polygons.covering(points, polygons.edges(r), 2.0).collect()}
    assert found == {(2, 1): False, (2, 2): False, (3, 1): True, (5, 1): False}
    assert {x["point"]: x["status"] for x in polygons.assign(points, polygons.edges(r), 2.0).collect()} == {1: "unassigned", 2: "ambiguous", 3: "assigned", 4: "unassigned", 5: "assigned"}


def test_families_are_published_together(spark, tmp_path):
    from cellweave.sources import files, publish

    root = str(tmp_path)
    a, b = spark.range(3), spark.range(5)
    assert publish.publish({"a": a, "b": b}, root) == ["a", "b"]

    def refuse(name, df):
        if name == "b":
            raise ContractError("not this one")

    with pytest.raises(ContractError):
        publish.publish({"a": spark.range(7), "b": spark.range(7)}, root, refuse)
    assert spark.read.parquet(f"{root}/a").count() == 3 and files.Store(root).names() == ["a", "b"]
    store = files.Store(root)
    spark.range(9).write.parquet(f"{root}/.staged-x-a")
    store.replace(publish.JOURNAL, '{"state": "renaming", "tables": {"a": ".staged-x-a"}}')
    assert publish.recover(store) == "finished" and spark.read.parquet(f"{root}/a").count() == 9
    with publish.writer(store), pytest.raises(ContractError):
        publish.publish({"a": a}, root)
    audit = spark.createDataFrame([(4, 0, 1)], "n_rows long, n_null_keys long, n_repeated long")
    with pytest.raises(ContractError):
        publish.promote(root, "b", "a", audit)
    publish.promote(root, "b", "a", audit.withColumn("n_repeated", F.lit(0)))
    assert spark.read.parquet(f"{root}/a").count() == 5 and store.names() == ["a"]


def test_vector_and_grid_files(spark, tmp_path):
    import hashlib

    from cellweave.sources import vector

    square = "[[0,0],[4,0],[4,4],[0,4],[0,0]]"
    text = f'{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"n":1}},"geometry":{{"type":"Polygon","coordinates":[{square},[[1,1],[2,1],[2,2],[1,1]]]}}}},{{"type":"Feature","properties":null,"geometry":{{"type":"MultiPolygon","coordinates":[[{square}],[{square}]]}}}},{{"type":"Feature","properties":{{}},"geometry":{{"type":"Point","coordinates":[7,8]}}}},{{"type":"Feature","properties":{{}},"geometry":null}}]}}'
    (tmp_path / "a.geojson").write_text(text)
    got = vector.geojson(spark, str(tmp_path / "a.geojson")).orderBy("feature", "part", "ring_no").collect()
    assert [(r["feature"], r["kind"], r["part"], r["ring_no"], r["ring"] and len(r["ring"])) for r in got] == [(0, "Polygon", 0, 0, 4), (0, "Polygon", 0, 1, 3), (1, "MultiPolygon", 0, 0, 4), (1, "MultiPolygon", 1, 0, 4), (2, "Point", 0, 0, 1), (3, None, None, None, None)]
    shape = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))")], "poly int, wkt string")
    e = polygons.edges(vector.wkt_rings(shape, "wkt"))
    assert np.isclose(polygons.union_area(e.select("poly", F.lit(0).alias("cell"), *polygons.EDGE), ["cell"], 10.0).first()["union_area"], 15.5)
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9\n1 2 -9\n4 5 6\n")
    g = {(r["row"], r["col"]): (r["value"], r["x"], r["y"]) for r in vector.text_grid(spark, str(tmp_path / "g.asc")).collect()}
    assert g[0, 0] == (1.0, 12.5, 27.5) and g[0, 2][0] is None and g[1, 2] == (6.0, 22.5, 22.5) and len(g) == 6
    pins = spark.createDataFrame([("g.asc", "0" * 64), ("a.geojson", hashlib.sha256(text.encode()).hexdigest()), ("gone", "1")], "name string, sha256 string")
    faults = {r["name"]: r["fault"] for r in vector.pin_faults(spark, f"{tmp_path}/*.*", pins).collect()}
    assert faults == {"g.asc": "changed", "gone": "missing"}


def test_catalogs_and_preflight(spark, tmp_path):
    from cellweave.plans import delivery, stages

    df = spark.createDataFrame([(1, 2.0, None), (2, None, None)], "id long, DEPTH_M double, SITE_COUNT int")
    got = {r["name"]: r for r in delivery.feature_catalog(df, ["id"]).collect()}
    assert got["DEPTH_M"]["unit"] == "m" and got["DEPTH_M"]["label"] == "Depth m" and got["DEPTH_M"]["known_share"] == 0.5 and got["SITE_COUNT"]["known_share"] == 0
    df.write.parquet(f"{tmp_path}/t")
    assert stages.preflight(spark, {"t": (f"{tmp_path}/t", {"id": "bigint"})}) == []
    assert len(stages.preflight(spark, {"t": (f"{tmp_path}/t", {"id": "int", "x": "int"}), "u": (f"{tmp_path}/u", {})})) == 3


def test_minimum_mapping_unit_against_a_plain_version(spark):
    import random

    from cellweave.operators import focal

    r = random.Random(5)
    n, labels = 48, {}
    edges = [(i, i + 1) for i in range(n - 1) if (i + 1) % 8] + [(i, i + 8) for i in range(n - 8)]
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
    labels = {i: r.choice("aab") if i % 5 else r.choice("cd") for i in range(n)}
    scores = {(i, x): r.choice([0.0, 0.3, 0.7, 0.9]) for i in range(n) for x in "abcd"}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = focal.minimum_mapping_unit(df(list(labels.items()), "node long, label string"), df([(a, b, 1) for a, b in edges], "src long, dst long, w long"), df([(i, x, v) for (i, x), v in scores.items()], "node long, label string, score double"), 3)
    for _ in range(3):
        size = {}
        for i in range(n):
            seen, todo = {i}, [i]
            while todo:
                for k in near[todo.pop()]:
                    if k not in seen and labels[k] == labels[i]:
                        seen.add(k)
                        todo.append(k)
            size[i] = len(seen)
        after = dict(labels)
        for i in range(n):
            if size[i] < 3:
                votes = {}
                for k in near[i]:
                    if labels[k] != labels[i] and scores[i, labels[k]] > 0:
                        votes[labels[k]] = votes.get(labels[k], 0) + 1
                if votes:
                    after[i] = min(votes, key=lambda x: (-votes[x], -scores[i, x], x))
        labels = after
    assert {x["node"]: x["label"] for x in got.collect()} == labels


def _streamed(spark, folder, name, schema, build, mode):
    """The rows that a streaming query gives for two files, one after the other."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windows_drop_rows_behind_the_watermark(spark, tmp_path):
    from cellweave.streaming import evidence as live

    schema = "ts timestamp, cell long, v long"
    at = lambda day, hour=0: F.lit(f"2024-01-{day:02d} {hour:02d}:00:00").cast("timestamp")
    first = spark.range(1).select(F.explode(F.array(F.struct(at(1, 3).alias("ts"), F.lit(7).cast("long").alias("cell"), F.lit(2).cast("long").alias("v")), F.struct(at(1, 9).alias("ts"), F.lit(7).cast("long").alias("cell"), F.lit(3).cast("long").alias("v")), F.struct(at(9).alias("ts"), F.lit(8).cast("long").alias("cell"), F.lit(1).cast("long").alias("v")))).alias("r")).select("r.*")
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = _streamed(spark, tmp_path, "windowed_days", schema, lambda s: live.windowed(s, "ts", ["cell"], "v"), "append")
    assert [(r["cell"], r["n"], r["total"]) for r in got.collect()] == [(7, 2, 5)]  # the ninth day is still open


def test_first_row_of_each_key_in_a_stream(spark, tmp_path):
    from cellweave.streaming import evidence as live

    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 2)]
    spark.createDataFrame(rows, "t string, cell long").select(F.col("t").cast("timestamp").alias("ts"), "cell").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = _streamed(spark, tmp_path, "first_rows", "ts timestamp, cell long", lambda s: live.unique(s, "ts", ["cell"]), "append")
    assert sorted(r["cell"] for r in got.collect()) == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    import json

    from cellweave import cli
    from cellweave.sources import areas

    (tmp_path / "stages.json").write_text(json.dumps({"a": [], "b": ["a"], "c": ["b"]}))
    assert cli.main(["plan", str(tmp_path / "stages.json"), "--only", "b"]) == 0
    assert capsys.readouterr().out.split() == ["a", "b"]
    root = f"{tmp_path}/areas"
    areas.write_areas({"south-bay": spark.createDataFrame([("8f0", 8, 1.5)], "H3_INDEX string, H3_RESOLUTION int, DEPTH_M double")}, root)
    assert cli.main(["list", root]) == 0 and capsys.readouterr().out.split() == ["south-bay"]
    assert cli.main(["inspect", root, "south-bay"]) == 0 and json.loads(capsys.readouterr().out)["rows"] == 1
    assert cli.main(["export", root, "south-bay", f"{tmp_path}/out"]) == 0 and spark.read.parquet(f"{tmp_path}/out").count() == 1
    with pytest.raises(ContractError):
        (tmp_path / "areas" / "stray.parquet").mkdir()
        areas.check_catalog(root)


def test_canonical_records_against_the_plain_order(spark):
    import random

    from cellweave.operators import fits

    r = random.Random(17)
    rows = [(i, r.uniform(0, 60), r.uniform(0, 60), r.randrange(3), r.choice([0.1, 0.9]), r.choice("ab")) for i in range(150)]
    got = fits.canonical_records(spark.createDataFrame(rows, "id long, x double, y double, priority int, confidence double, kind string"), 5.0, ["kind"])
    kept, want = [], {}
    for i, x, y, _, _, k in sorted(rows, key=lambda v: (-v[3], -v[4], v[0])):
        near = [((x - a) ** 2 + (y - b) ** 2, o) for a, b, o, c in kept if c == k and (x - a) ** 2 + (y - b) ** 2 <= 25]
        want[i] = min(near)[1] if near else i
        if not near:
            kept.append((x, y, i, k))
    assert {v["id"]: v["canonical"] for v in got.collect()} == want and 0 < sum(i != c for i, c in want.items()) < 150
    assert all((v["relation"] == fits.CANONICAL) == (v["id"] == v["canonical"]) for v in got.collect())
