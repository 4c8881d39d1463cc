"""Operators on small literal fixtures: null rules, ties, order of rows."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators import contracts, graph, intervals, nearest, rollup, sequence, summary, temporal
from cellweave.plans import delivery, stages
from cellweave.sources import areas


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_radius_sums_count_connectors_and_lone_nodes(spark):
    nodes = spark.createDataFrame([(n,) for n in ("a", "b", "t", "x")], "node string")
    edges = spark.createDataFrame([("a", "b", 1000), ("t", "b", 200)], "src string, dst string, w long")
    values = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("t", 4, True), ("x", 8, True)], "node string, value long, eligible boolean")
    assert rows(graph.radius_sum(nodes, edges, values, 1100), "node", "total") == [("a", 3), ("b", 7), ("t", 6), ("x", 8)]
    none = values.withColumn("eligible", F.col("node") != "b")
    assert rows(graph.radius_sum(nodes, edges, none, 1100), "node", "total") == [("a", 1), ("b", 5), ("t", 4), ("x", 8)]
    assert dict(rows(graph.radius_sum(nodes, edges, values, 1300), "node", "total"))["a"] == 7


def test_relationships_have_a_row_and_a_status_for_every_pair(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b", 100), ("b", "c", 100)], "src string, dst string, w long")
    outlets = spark.createDataFrame([("one", "a"), ("two", "b"), ("island", "d")], "object string, node string")
    parts = graph.components(nodes, edges)
    got = graph.relationships(nodes, outlets, edges, parts, 150).collect()
    status = {(r["object"], r["node"]): r["status"] for r in got}
    assert len(got) == 15 and status["one", "c"] == "search_limited" and status["one", "d"] == "disconnected" and status["two", "c"] == "reachable"


def test_whole_union_keeps_every_row_of_both_tables(spark):
    from cellweave.plans import bindings

    d = "/root/testdata/sf0.001"
    got = dict(rows(bindings.queries()["whole_normalised_union"](spark, d).groupBy("source").count(), "source", "count"))
    assert got == {"orders": spark.read.parquet(f"{d}/orders.parquet").count(), "items": spark.read.parquet(f"{d}/lineitem.parquet").count()}


def test_nearest_owner_raises_when_rounds_run_out(spark):
    nodes = spark.createDataFrame([(n,) for n in range(6)], "node long")
    edges = spark.createDataFrame([(n, n + 1, 1) for n in range(5)], "src long, dst long, w long")
    seeds = spark.createDataFrame([(0, 7)], "node long, owner long")
    with pytest.raises(RuntimeError):
        graph.nearest_owner(nodes, edges, seeds, max_rounds=3)


def test_nearest_owner_breaks_ties_by_the_smaller_owner(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    edges = spark.createDataFrame([(0, 1, 5), (1, 2, 5), (2, 3, 10)], "src long, dst long, w long")
    seeds = spark.createDataFrame([(0, 7), (3, 2)], "node long, owner long")
    assert rows(graph.nearest_owner(nodes, edges, seeds).fillna(-1), "node", "dist", "owner") == [(0, 0, 7), (1, 5, 7), (2, 10, 2), (3, 0, 2), (4, -1, -1)]


def test_union_lengths_count_overlaps_once_in_any_order(spark):
    data = [("c", 0, 10, "ROCKY"), ("c", 5, 15, "SANDY"), ("c", 8, 12, "ROCKY"), ("c", 8, 12, "ROCKY")]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "cell string, x0 long, x1 long, label string")
        r = intervals.class_lengths(df, "cell", "x0", "x1", "label", ["ROCKY", "SANDY"]).first()
        assert (r["mapped_len"], r["len_ROCKY"], r["len_SANDY"], r["overlap_len"]) == (15, 12, 10, 7)


def test_latest_evidence_wins_and_absence_wins_ties(spark):
    df = spark.createDataFrame([("c", 0, 10, 2019, 1, False), ("c", 5, 15, 2020, 1, True), ("c", 5, 8, 2020, 1, False)], "cell string, x0 long, x1 long, year int, priority int, absent boolean")
    r = intervals.latest_evidence(df, ["cell"], "x0", "x1", "year", "priority", "absent").first()
    assert (r["present_len"], r["absent_len"]) == (5, 10)


def test_barrier_parent_is_the_nearest_child(spark):
    df = spark.createDataFrame([("p", "child-a", 900.0, 2), ("p", "child-b", 100.0, 7), ("p", "child-c", None, 9)], "parent string, cell string, distance double, n int")
    assert rows(rollup.best_child(df, "parent", [F.col("distance")], "cell"), "cell", "n") == [("child-b", 7)]


def test_weighted_mean_ignores_unknowns_and_weights_of_no_use(spark):
    df = spark.createDataFrame([(1, 4.0, 1.0), (1, 8.0, 3.0), (1, None, 5.0), (1, 9.0, -1.0), (2, None, 1.0)], "g int, v double, w double")
    got = df.groupBy("g").agg(rollup.weighted_mean("v", "w").alias("any"), rollup.weighted_mean("v", "w", True).alias("all"))
    assert {r["g"]: (r["any"], r["all"]) for r in got.collect()} == {1: (7.0, None), 2: (None, None)}


@pytest.mark.parametrize(("depths", "area", "width", "run"), [([50.0] * 11, 10000.0, 200.0, 200.0), ([max(0.0, 50 * (1 - abs(x - 100) / 100)) for x in range(0, 201, 20)], 5000.0, 100.0, 80.0), ([50.0] * 5 + [None] + [50.0] * 5, None, 160.0, 80.0)])
def test_passage_sections(spark, depths, area, width, run):
    df = spark.createDataFrame([("p", 20 * i, d) for i, d in enumerate(depths)], "passage string, pos long, depth double")
    r = sequence.section(df, "passage", "pos", "depth", 25.0).first()
    assert (r["area"], r["deep_width"], r["longest_run"]) == (area, width, run)


def test_codes_of_samples(spark):
    df = spark.createDataFrame([("a", 20.0, c) for c in (11, 40, 71, None)] + [("b", None, 11)], "cell string, depth double, code int")
    got = {r["cell"]: r for r in summary.code_summary(df, "cell", "code", [11, 40, 71], [11], "depth").collect()}
    assert (got["a"]["n"], got["a"]["known"], got["a"]["n_40"], got["a"]["status"]) == (4, 3, 1, "partial")
    assert abs(got["a"]["direct_frac"] - 1 / 3) < 1e-12
    assert got["b"]["n_11"] is None and got["b"]["direct_frac"] is None and got["b"]["status"] == "no_samples"


def test_contracts_reject_repeated_keys_and_wrong_support(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(a, a, ["k"])
    b = spark.createDataFrame([(1, float("nan")), (2, 0.0)], "k int, v double")
    assert rows(contracts.nan_to_null(b).where("v IS NULL"), "k") == [(1,)]
    with pytest.raises(contracts.ContractError):
        contracts.require_support(b, spark.createDataFrame([(1,)], "k int"), ["k"])


def test_priority_duplicates_keep_lineage(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 100, 1), (2, 30.0, 0.0, 60, 1), (3, 9000.0, 0.0, 60, 1)], "id long, x double, y double, priority int, class int")
    assert rows(nearest.duplicates(df, 100.0), "id", "canonical") == [(1, 1), (2, 1), (3, 3)]


def test_matrix_assembly_aligns_by_key(spark):
    support = spark.createDataFrame([("a", 0.0), ("b", 10.0)], "cell string, area double")
    depth = spark.createDataFrame([("b", 12.0), ("a", None)], "cell string, depth double")
    out = delivery.assemble(support.select("cell"), {"support": support, "bathymetry": depth}, ["cell"]).collect()
    assert [tuple(r) for r in out] == [("a", 0.0, None), ("b", 10.0, 12.0)]


def test_area_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", 6, 1.0, None), ("c2", 8, float("nan"), 2.0)], "H3_INDEX string, H3_RESOLUTION int, a double, b double")
    areas.write_areas({"north-coast": df}, str(tmp_path), unavailable=("b",))
    assert areas.list_areas(str(tmp_path)) == ["north-coast"]
    assert areas.read_area(spark, str(tmp_path), "north-coast", 6).columns == ["H3_INDEX", "H3_RESOLUTION", "a"]
    assert areas.read_area(spark, str(tmp_path), "north-coast", 8).first()["a"] is None
    with pytest.raises(contracts.ContractError):
        areas.read_area(spark, str(tmp_path), "north-coast")
    with pytest.raises(contracts.ContractError):
        areas.write_areas({"Bad Name": df}, str(tmp_path))


def test_evidence_by_year(spark):
    df = spark.createDataFrame([(1, 2018, True), (1, 2020, True), (1, 2020, False), (2, 2019, True)], "cell int, year int, present boolean")
    got = {r["cell"]: r for r in temporal.evidence_summary(df, "cell", "year", "present", 2021).collect()}
    assert got[1]["latest_state"] == "absent" and got[1]["persistence"] == 1.0 and got[1]["recency"] == 1
    assert got[2]["persistence"] is None and got[2]["latest_state"] == "present"


def test_stage_plans():
    dag = {"a": [], "b": ["a"], "c": ["b"], "d": ["a"]}
    assert stages.plan(dag, only=["c"]) == ["a", "b", "c"]
    assert stages.plan(dag, optional={"d"}) == ["a", "b", "c"]
    with pytest.raises(stages.PlanError):
        stages.plan({"a": ["b"], "b": ["a"]})
    done, ran = {}, []
    runners = {k: (lambda c, k=k: ran.append(k)) for k in dag}
    assert set(stages.run(stages.plan(dag), dag, runners, {}, done).values()) == {"ran"}
    assert set(stages.run(stages.plan(dag), dag, runners, {}, done).values()) == {"reused"}
    runners["b"] = lambda c: 1 / 0
    states = stages.run(stages.plan(dag), dag, runners, {"b": {"x": 1}}, done)
    assert states == {"a": "reused", "b": "failed", "c": "blocked", "d": "reused"}
    assert stages.resolved({"a": {"b": 3}, "c": "${a.b}", "d": "x${a.b}"}) == {"a": {"b": 3}, "c": 3, "d": "x3"}
    with pytest.raises(stages.PlanError):
        stages.resolved({"a": "${b}", "b": "${a}"})


def test_streaming_latest_evidence(spark, tmp_path):
    from cellweave.streaming import evidence

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 2019, "p"), (1, 2020, "q"), (2, 2018, "p")], "cell long, year int, state string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("cell long, year int, state string").parquet(src)
    q = evidence.latest(stream, "cell", "year", "state").writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("latest"), "cell", "year", "state") == [(1, 2020, "q"), (2, 2018, "p")]
