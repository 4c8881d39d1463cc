"""Binary rasters as tables: TIFF files read block by block.

``tiff`` is a Spark data source whose partitions are rectangles of a file's strips or tiles; bounds on
``row``, ``col``, ``x`` and ``y`` choose the rectangles before any pixel is read. With the option ``halo`` a
pixel carries its four neighbours, read one pixel beyond the rectangle, so windows need no join.
``block_index`` and ``pixels_of_blocks`` read the blocks that a join has chosen.

One band, classic or big files of either byte order, plain or deflated, with or without horizontal
differencing; others raise. Nodata and NaN become null. Pixels beyond a file have no neighbour there.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

#: Pixels that a partition aims at, and of an Arrow batch.
PIXELS, BATCH = 1 << 20, 1 << 16

PIXEL = "file string, row long, col long, value double, x double, y double"
HALO = "north double, south double, west double, east double"

# Fixed values of the file format: tags, field types (code, bytes), sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIE, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 16: ("Q", 8)}
KINDS = {1: "u", 2: "i", 3: "f"}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path if ":/" in path else f"file://{path}"))


def files(path: str) -> list[str]:
    """The TIFF files at or under a path, in the order of their names."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    under = store.get_file_info(fs.FileSelector(at, recursive=True))
    return [f"{path.rstrip('/')}/{x.path[len(at.rstrip('/')) + 1 :]}" for x in sorted(under, key=lambda x: x.path) if x.is_file and re.search(r"\.tiff?$", x.path, re.I)]


class Raster:
    """A file's header, and its windows."""

    def __init__(self, path: str):
        self.path = path
        store, at = _store(path)
        self.file = store.open_input_file(at)
        head = self.file.read_at(16, 0)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        magic = struct.unpack(f"{self.order or '<'}H", head[2:4])[0]
        if not self.order or magic not in (42, 43):
            raise ValueError(f"{path}: no TIFF file")
        big = magic == 43
        tags = self._directory(struct.unpack(f"{self.order}{'Q' if big else 'I'}", head[8:16] if big else head[4:8])[0], big)
        one = lambda tag, default: tags.get(tag, [default])[0]
        self.width, self.height = one(WIDTH, 0), one(HEIGHT, 0)
        self.deflated, self.predictor = one(COMPRESSION, 1) in (8, 32946), one(PREDICTOR, 1)
        kind, bits = KINDS.get(one(FORMAT, 1)), one(BITS, 1)
        if one(SAMPLES, 1) != 1 or kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits < 32):
            raise ValueError(f"{path}: not one band of whole bytes")
        if not self.deflated and one(COMPRESSION, 1) != 1 or self.predictor not in (1, 2) or (self.predictor == 2 and kind == "f"):
            raise ValueError(f"{path}: compression {one(COMPRESSION, 1)} with predictor {self.predictor} is not read")
        self.type = np.dtype(f"{self.order}{kind}{bits // 8}")
        tiled = TILES in tags
        self.block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, self.height), self.height) or 1, self.width)
        self.tiled, self.offsets, self.sizes = tiled, tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES]
        scale, tie = tags.get(SCALE, (1.0, 1.0)), tags.get(TIE, (0.0,) * 6)
        # centre of pixel (0, 0), and steps
        self.dx, self.dy = scale[0], -scale[1]
        self.x0, self.y0 = tie[3] + (0.5 - tie[0]) * self.dx, tie[4] + (0.5 - tie[1]) * self.dy
        nodata = tags.get(NODATA)
        self.nodata = float(nodata[0].rstrip(b"\0 ")) if nodata else None

    def _directory(self, at: int, big: bool) -> dict[int, tuple]:
        long, step, inline = ("Q", 20, 8) if big else ("I", 12, 4)
        lead = 8 if big else 2
        n = struct.unpack(f"{self.order}{'Q' if big else 'H'}", self.file.read_at(lead, at))[0]
        raw, tags = self.file.read_at(n * step, at + lead), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{self.order}HH{long}", raw, k * step)
            if kind not in FIELDS:
                continue
            code, size = FIELDS[kind]
            value = raw[(k + 1) * step - inline : (k + 1) * step]
            if count * size > inline:
                value = self.file.read_at(count * size, struct.unpack(f"{self.order}{long}", value)[0])
            tags[tag] = struct.unpack_from(f"{self.order}{count}{code}", value)
        return tags

    def rectangles(self, pixels: int = PIXELS) -> Iterator[tuple[int, int, int, int]]:
        """(row, row behind, col, col behind) of rectangles of whole blocks, each of about so many pixels, at least one block."""
        high, wide = self.block
        across = max(1, pixels // (high * wide))
        w = wide * min(-(-self.width // wide), across)
        h = high * max(1, pixels // (high * w))
        for r in range(0, self.height, h):
            for c in range(0, self.width, w):
                yield r, min(r + h, self.height), c, min(c + w, self.width)

    def _block(self, i: int, j: int) -> np.ndarray:
        high, wide = self.block
        k = i * -(-self.width // wide) + j
        if not self.sizes[k]:  # a block that was never written
            return np.full((high, wide), np.nan if self.nodata is None else self.nodata)
        raw = self.file.read_at(self.sizes[k], self.offsets[k])
        values = np.frombuffer(zlib.decompress(raw) if self.deflated else raw, self.type)
        values = values[: values.size // wide * wide].reshape(-1, wide)
        return np.cumsum(values, axis=1, dtype=self.type) if self.predictor == 2 else values

    def window(self, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """Values of rows r0..r1 and columns c0..c1 as doubles; NaN beyond the file and where there are none."""
        out = np.full((r1 - r0, c1 - c0), np.nan)
        high, wide = self.block
        a, b, c, d = max(r0, 0), min(r1, self.height), max(c0, 0), min(c1, self.width)
        for i in range(a // high, -(-b // high)):
            for j in range(c // wide, -(-d // wide)):
                block = self._block(i, j)
                top, left = max(a, i * high), max(c, j * wide)
                part = block[top - i * high : b - i * high, left - j * wide : d - j * wide]
                out[top - r0 : top - r0 + part.shape[0], left - c0 : left - c0 + part.shape[1]] = part
        if self.nodata is not None:
            out[out == self.nodata] = np.nan
        return out

    def batches(self, r0: int, r1: int, c0: int, c1: int, halo: bool) -> Iterator[pa.RecordBatch]:
        """The pixels of a rectangle, a few rows of it at once."""
        seen = self.window(r0 - halo, r1 + halo, c0 - halo, c1 + halo)
        inner = lambda dr, dc, a, b: seen[halo + a + dr : halo + b + dr, halo + dc : halo + dc + c1 - c0].ravel()
        step = max(1, BATCH // max(1, c1 - c0))
        for a in range(0, r1 - r0, step):
            b = min(a + step, r1 - r0)
            rows, cols = np.repeat(np.arange(r0 + a, r0 + b), c1 - c0), np.tile(np.arange(c0, c1), b - a)
            number = lambda v: pa.array(v, pa.float64(), from_pandas=True)
            made = {"file": pa.array([self.path] * len(rows)), "row": pa.array(rows, pa.int64()), "col": pa.array(cols, pa.int64()), "value": number(inner(0, 0, a, b))}
            made |= {"x": number(self.x0 + cols * self.dx), "y": number(self.y0 + rows * self.dy)}
            if halo:
                made |= {k: number(inner(dr, dc, a, b)) for k, dr, dc in (("north", -1, 0), ("south", 1, 0), ("west", 0, -1), ("east", 0, 1))}
            yield pa.RecordBatch.from_pydict(made)


class Rectangle(D.InputPartition):
    def __init__(self, path: str, window: tuple[int, int, int, int]):
        self.path, self.window = path, window


class TiffReader(D.DataSourceReader):
    """A partition a rectangle; ``bounds`` on columns leave out those that cannot hold a row."""

    def __init__(self, path: str, halo: bool, pixels: int):
        self.path, self.halo, self.pixels = path, halo, pixels
        self.bounds = {k: (-np.inf, np.inf) for k in ("row", "col", "x", "y")}

    def _chosen(self, path: str) -> list[Rectangle]:
        r, out = Raster(path), []
        for w in r.rectangles(self.pixels):
            spans = {"row": (w[0], w[1] - 1), "col": (w[2], w[3] - 1), "x": sorted((r.x0 + w[2] * r.dx, r.x0 + (w[3] - 1) * r.dx)), "y": sorted((r.y0 + w[0] * r.dy, r.y0 + (w[1] - 1) * r.dy))}
            if all(spans[k][0] <= high and low <= spans[k][1] for k, (low, high) in self.bounds.items()):
                out.append(Rectangle(path, w))
        return out

    def partitions(self):
        with ThreadPoolExecutor(16) as pool:  # headers only
            return [x for chosen in pool.map(self._chosen, files(self.path)) for x in chosen]

    def read(self, partition):
        if partition is not None:
            yield from Raster(partition.path).batches(*partition.window, self.halo)


class BoundedReader(TiffReader):
    """The same, with the bounds that a query sets; Spark applies the filters themselves again."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.bounds:
                low, high = self.bounds[name]
                if isinstance(f, (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual)):
                    low = max(low, f.value)
                if isinstance(f, (D.EqualTo, D.LessThan, D.LessThanOrEqual)):
                    high = min(high, f.value)
                if isinstance(f, D.In) and f.value:
                    low, high = max(low, min(f.value)), min(high, max(f.value))
                self.bounds[name] = (low, high)
            yield f


class TiffSource(D.DataSource):
    """Options: ``path`` (a file or a folder), ``halo`` (true: with neighbours), ``pixels`` (of a partition), ``bounds`` (true: filters choose rectangles, where the session hands them to Python)."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def _halo(self) -> bool:
        return self.options.get("halo", "false").lower() == "true"

    def schema(self) -> str:
        return f"{PIXEL}, {HALO}" if self._halo() else PIXEL

    def reader(self, schema) -> TiffReader:
        made = BoundedReader if self.options.get("bounds", "false").lower() == "true" else TiffReader
        return made(self.options["path"], self._halo(), int(self.options.get("pixels", PIXELS)))


def tiff(spark: SparkSession, path: str, halo: bool = False, pixels: int = PIXELS) -> DataFrame:
    """(file, row, col, value, x, y), with ``halo`` also (north, south, west, east).

    Bounds reach the choice of rectangles where the session sets
    ``spark.sql.python.filterPushdown.enabled``; without it the rows are the same.
    """
    spark.dataSource.register(TiffSource)
    bounds = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("tiff").option("bounds", bounds).option("halo", str(halo).lower()).option("pixels", str(pixels)).load(path)


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, r0, r1, c0, c1, x_low, x_high, y_low, y_high): one row a block of every file, headers read by tasks; extents reach the pixels' edges."""
    names = files(path)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                r = Raster(name)
                w = np.array(list(r.rectangles(1)), np.int64).reshape(-1, 4)
                x, y = np.sort(r.x0 + (w[:, 2:] - 0.5) * r.dx, axis=1), np.sort(r.y0 + (w[:, :2] - 0.5) * r.dy, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(w)), *(pa.array(w[:, k]) for k in range(4)), *(pa.array(v[:, k]) for v in (x, y) for k in (0, 1))], names="file r0 r1 c0 c1 x_low x_high y_low y_high".split())

    listed = spark.createDataFrame([(x,) for x in names], "file string").repartition(max(1, min(len(names), 1024)))
    return listed.mapInArrow(index, "file string, r0 long, r1 long, c0 long, c1 long, x_low double, x_high double, y_low double, y_high double")


def blocks_that_meet(blocks: DataFrame, boxes: DataFrame, step: float) -> DataFrame:
    """The blocks whose extent meets a box (x_low, x_high, y_low, y_high), each once; they meet on a lattice of ``step``."""

    def spread(df: DataFrame) -> DataFrame:
        along = lambda k: F.explode(F.sequence(F.floor(F.col(f"{k}_low") / step), F.floor(F.col(f"{k}_high") / step)))
        return df.withColumn("__i", along("x")).withColumn("__j", along("y"))

    b = spread(boxes.select("x_low", "x_high", "y_low", "y_high")).alias("b")
    a = spread(blocks).alias("a")
    meets = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("__i", "__j")]
    meets += [(F.col(f"a.{k}_low") <= F.col(f"b.{k}_high")) & (F.col(f"b.{k}_low") <= F.col(f"a.{k}_high")) for k in ("x", "y")]
    on = meets[0] & meets[1] & meets[2] & meets[3]
    return a.join(b, on, "left_semi").select(*(F.col(f"a.{c}") for c in blocks.columns)).distinct()


def pixels_of_blocks(blocks: DataFrame, halo: bool = False) -> DataFrame:
    """The pixels of chosen blocks (file, r0, r1, c0, c1), blocks spread over the tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, raster = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, raster = row["file"], Raster(row["file"])
                yield from raster.batches(row["r0"], row["r1"], row["c0"], row["c1"], halo)

    spread = blocks.select("file", "r0", "r1", "c0", "c1").repartition("file", "r0", "c0").sortWithinPartitions("file", "r0", "c0")
    return spread.mapInArrow(read, f"{PIXEL}, {HALO}" if halo else PIXEL)


def _encoded(values: np.ndarray, strip_rows: int, x: float, y: float, size: float, nodata: float) -> bytes:
    """A deflated file of strips of doubles whose upper left corner is (x, y)."""
    strips = [zlib.compress(values[a : a + strip_rows].astype("<f8").tobytes()) for a in range(0, len(values), strip_rows)]
    sizes = [len(s) for s in strips]
    entries = [
        (WIDTH, 4, [values.shape[1]]), (HEIGHT, 4, [len(values)]), (BITS, 3, [64]), (COMPRESSION, 3, [8]), (STRIPS, 4, [8 + sum(sizes[:k]) for k in range(len(sizes))]), (SAMPLES, 3, [1]),
        (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, sizes), (FORMAT, 3, [3]), (SCALE, 12, [size, size, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, x, y, 0.0]), (NODATA, 2, [f"{nodata!r}\0".encode()]),
    ]
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    at, behind, directory = 8 + len(body), b"", struct.pack("<H", len(entries))
    for tag, kind, value in entries:
        code, count = FIELDS[kind][0], len(value[0]) if kind == 2 else len(value)
        raw = struct.pack(f"<{count}{code}", *value)
        if len(raw) > 4:
            place = at + 2 + 12 * len(entries) + 4 + len(behind)
            behind += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", place)
        directory += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + body + directory + struct.pack("<I", 0) + behind


def write_tiles(grid: DataFrame, folder: str, tile: int, strip_rows: int, size: float = 1.0, nodata: float = -9999.0) -> DataFrame:
    """Write (row, col, value) as a TIFF file a tile of ``tile`` x ``tile`` pixels; returns (file, pixels) of what was written.

    Pixel (row, col) has its centre at ((col + 0.5) * size, -(row + 0.5) * size). A task holds one tile; pixels
    that lack are nodata. A tile written again is the same file. Repeated pixels keep the greatest value.
    """

    def write(table: pa.Table) -> pa.Table:
        rows, cols = table["row"].to_numpy(), table["col"].to_numpy()
        i, j = int(rows[0] // tile), int(cols[0] // tile)
        rows, cols, seen = rows - i * tile, cols - j * tile, table["value"].to_numpy()
        values = np.full((int(rows.max()) + 1, int(cols.max()) + 1), -np.inf)
        np.maximum.at(values, (rows, cols), np.where(np.isnan(seen), -np.inf, seen))
        values[values == -np.inf] = nodata
        path = f"{folder}/tile_{i}_{j}.tif"
        store, at = _store(path)
        with store.open_output_stream(at) as out:
            out.write(_encoded(values, strip_rows, j * tile * size, -i * tile * size, size, nodata))
        return pa.table({"file": [path], "pixels": [int((values != nodata).sum())]})

    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    long = grid.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    return long.groupBy(F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)).applyInArrow(write, "file string, pixels long")
