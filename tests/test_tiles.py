"""TIFF files as tables: windows, halos, chosen blocks, byte orders, refusals."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.sources import rasters, tiles


def grid(spark, rows, cols):
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("row"), (F.col("id") % cols).alias("col"), F.when(F.col("id") % 11 != 7, (F.col("id") * 37 % 101).cast("double")).alias("value"))


@pytest.fixture(scope="module")
def one(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("one"))
    made = tiles.write_tiles(grid(spark, 70, 23), folder, tile=128, strip_rows=4).collect()
    assert [r["pixels"] for r in made] == [70 * 23 - len(range(7, 70 * 23, 11))]
    return folder


def big_endian(values, tile, predictor, magic=42):
    """A tiled file of 16-bit integers, deflated, most significant byte first."""
    high, wide = -(-values.shape[0] // tile) * tile, -(-values.shape[1] // tile) * tile
    padded = np.zeros((high, wide), np.int64)
    padded[: values.shape[0], : values.shape[1]] = values
    blocks = []
    for i in range(0, high, tile):
        for j in range(0, wide, tile):
            b = padded[i : i + tile, j : j + tile].astype(">i2")
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((tile, 1), ">i2")).astype(">i2")
            blocks.append(zlib.compress(b.tobytes()))
    head = 8 if magic == 42 else 16
    offsets = [head + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    long, pad, kind = ("I", 4, 4) if magic == 42 else ("Q", 8, 16)
    entries = [(256, 3, [values.shape[1]]), (257, 3, [values.shape[0]]), (258, 3, [16]), (259, 3, [8]), (277, 3, [1]), (317, 3, [predictor]), (322, 3, [tile]), (323, 3, [tile]), (324, kind, offsets), (325, kind, [len(b) for b in blocks]), (339, 3, [2]), (42113, 2, [b"-1\0"])]
    body = b"".join(blocks)
    at = head + len(body)
    behind_at = at + struct.calcsize(">H" if magic == 42 else ">Q") + len(entries) * (12 if magic == 42 else 20) + pad
    directory, behind = struct.pack(">H" if magic == 42 else ">Q", len(entries)), b""
    for tag, k, v in entries:
        raw = v[0] if k == 2 else struct.pack(f">{len(v)}{tiles.FIELDS[k][0]}", *v)
        n = len(raw) if k == 2 else len(v)
        if len(raw) > pad:
            behind, raw = behind + raw, struct.pack(f">{long}", behind_at + len(behind))
        directory += struct.pack(f">HH{long}", tag, k, n) + raw.ljust(pad, b"\0")
    lead = struct.pack(">2sHI", b"MM", 42, at) if magic == 42 else struct.pack(">2sHHHQ", b"MM", 43, 8, 0, at)
    return lead + body + directory + b"\0" * pad + behind


def rows_of(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_pixels_are_those_written(spark, one):
    got = rows_of(tiles.tiff(spark, one, pixels=100))
    assert got == rows_of(grid(spark, 70, 23))
    r = tiles.tiff(spark, one).where("row = 3 and col = 5").first()
    assert (r["x"], r["y"]) == (5.5, -3.5)


@pytest.mark.parametrize("pixels", [1, 300, 1 << 20])
def test_halo_gives_the_self_joins_gradient(spark, one, pixels):
    p = tiles.tiff(spark, one, halo=True, pixels=pixels)
    gy, gx = (F.col("south") - F.col("north")) / 50.0, (F.col("east") - F.col("west")) / 60.0
    flat = p.select("row", "col", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("value"))
    assert "Exchange" not in flat._jdf.queryExecution().executedPlan().toString()
    want = rasters.gradient(grid(spark, 70, 23), 25.0, 30.0).withColumnRenamed("slope", "value")
    assert rows_of(flat) == pytest.approx(rows_of(want))


def test_bounds_choose_rectangles(spark, one):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        every = tiles.tiff(spark, one, pixels=92).rdd.getNumPartitions()
        for condition, most in (("row >= 60", 3), ("row = 9", 1), ("y < -30 and y > -40", 4), ("row in (4, 9)", 2), ("col > 50", 1)):
            some = tiles.tiff(spark, one, pixels=92).where(condition)
            assert some.rdd.getNumPartitions() <= most < every == 18
            assert rows_of(some) == rows_of(tiles.tiff(spark, one).where(condition).select("*"))
        assert tiles.tiff(spark, one, pixels=92).where("row >= 60").count() == 230
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("predictor,magic", [(1, 42), (2, 42), (2, 43)])
def test_tiled_files_of_the_other_byte_order(spark, tmp_path, predictor, magic):
    values = np.random.default_rng(3).integers(-1, 3000, (37, 50))
    (tmp_path / "a.tif").write_bytes(big_endian(values, 16, predictor, magic))
    want = {(i, j): None if values[i, j] == -1 else float(values[i, j]) for i in range(37) for j in range(50)}
    assert rows_of(tiles.tiff(spark, str(tmp_path), pixels=500)) == want
    halo = tiles.tiff(spark, str(tmp_path / "a.tif"), halo=True, pixels=1).where("row = 16 and col = 31").first()
    assert [halo[k] for k in ("north", "south", "west", "east")] == [want[15, 31], want[17, 31], want[16, 30], want[16, 32]]


def test_blocks_that_meet_boxes(spark, tmp_path):
    folder = str(tmp_path / "many")
    tiles.write_tiles(grid(spark, 70, 90), folder, tile=32, strip_rows=8).collect()
    index = tiles.block_index(spark, folder)
    assert index.count() == 3 * (4 + 4 + 1)
    boxes = spark.createDataFrame([(1.2, 3.4, -20.5, -2.0), (64.0, 64.0, -70.0, -69.5), (500.0, 501.0, 0.0, 1.0)], "x_low double, x_high double, y_low double, y_high double")
    chosen = tiles.blocks_that_meet(index, boxes, 10.0)
    want = [r for r in index.collect() if any(r.x_low <= b.x_high and b.x_low <= r.x_high and r.y_low <= b.y_high and b.y_low <= r.y_high for b in boxes.collect())]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, want)) and len(want) == 5
    got = {(r["x"], r["y"]): r["value"] for r in tiles.pixels_of_blocks(chosen).collect()}
    every = {(r["x"], r["y"]): r["value"] for r in tiles.tiff(spark, folder).collect()}
    inside = {k: v for k, v in every.items() if any(w.x_low < k[0] < w.x_high and w.y_low < k[1] < w.y_high for w in want)}
    assert got == inside and len(every) == 70 * 90


def test_nothing_and_refusals(spark, tmp_path):
    empty = tmp_path / "empty"
    tiles.write_tiles(grid(spark, 0, 5), str(empty), 8, 2).collect()
    assert tiles.tiff(spark, str(empty)).count() == 0 and tiles.block_index(spark, str(empty)).count() == 0
    (tmp_path / "text.tif").write_bytes(b"no raster at all")
    with pytest.raises(ValueError, match="no TIFF"):
        tiles.Raster(str(tmp_path / "text.tif"))
    with pytest.raises(FileNotFoundError):
        tiles.files(str(tmp_path / "nowhere"))
