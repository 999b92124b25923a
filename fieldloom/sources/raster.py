"""Scans of gridded files: raw 8-bit rasters, classic NetCDF, generated grids, point tables, URI lists.

Files come through Spark's ``binaryFile`` reader, so any file system that Spark reads will do;
each file is one row, decoded in Arrow batches into the tiles layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.model import TILES
from fieldloom.sources.netcdf import NETCDF_NAMES, ClassicFile

# Names that latitude, longitude and time axes go by. An "x" is a latitude and a "y" a longitude.
LATITUDES = ["x", "rlat", "rlats", "lat", "lats", "rows", "nlat", "latitude", "latitudes"]
LONGITUDES = ["y", "rlon", "rlons", "lon", "lons", "cols", "nlon", "longitude", "longitudes"]
TIMES = ["time", "times", "date", "dates", "julian"]
# The grid of a full 8-bit raster and its axes.
RASTER_SHAPE, RASTER_OFFSET = (9896, 3298), 75.0
RASTER_LON, RASTER_LAT = (0.0182, 0.036378335), (59.982, -0.036383683)
#: Cells and tiles of a batch, unless one tile has more cells.
BATCH_CELLS, BATCH_TILES = 1 << 18, 1024


def files(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load([path] if isinstance(path, str) else list(path))


def uri_list(spark: SparkSession, path: str) -> list[str]:
    """URIs of a text file, one a line; an input list, held by the driver as any list of paths is."""
    return [r.value.strip() for r in spark.read.text(path).where("trim(value) != ''").collect()]


def tile_rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {
        "dataset": pa.string(), "variable": pa.string(), "frame": pa.int64(), "dtype": pa.string(), "origin": pa.list_(pa.int32()), "shape": pa.list_(pa.int32()),
        "data": pa.list_(pa.float64()), "dims": pa.list_(pa.struct([("name", pa.string()), ("len", pa.int32())])), "attrs": pa.map_(pa.string(), pa.string()),
    }
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], [*kinds])


def batched(tiles: Iterable[dict], most_cells: int = BATCH_CELLS) -> Iterator[pa.RecordBatch]:
    """Tiles in batches: each batch costs Spark some milliseconds, however small it is."""
    rows, cells = [], 0
    for row in tiles:
        if rows and (cells + row["data"].size > most_cells or len(rows) >= BATCH_TILES):
            yield tile_rows(rows)
            rows, cells = [], 0
        rows.append(row)
        cells += row["data"].size
    if rows:
        yield tile_rows(rows)


def tile(dataset: str, variable: str, data: np.ndarray, dims: Sequence[str], dtype: str = "double", attrs: dict[str, str] | None = None, frame: int | None = None, origin: Sequence[int] | None = None) -> dict:
    shape = [1] * (2 - data.ndim) + list(data.shape)
    named = [{"name": n, "len": int(k)} for n, k in zip(dims, data.shape, strict=True)]
    return {"dataset": dataset, "variable": variable, "frame": frame, "dtype": dtype, "origin": [0] * (len(shape) - len(origin or [])) + list(origin or []), "shape": shape, "data": np.asarray(data, np.float64).ravel(), "dims": named, "attrs": list((attrs or {}).items())}


def read_raster(spark: SparkSession, path: str | Sequence[str], shape: tuple[int, int] = RASTER_SHAPE, offset: float = RASTER_OFFSET, variable: str = "TMP", **options) -> DataFrame:
    """Raw unsigned bytes, one or more grids to a file, each plus ``offset``; further bytes are ignored."""
    n = shape[0] * shape[1]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = np.frombuffer(content, np.uint8)
                for k in range(len(whole) // n):
                    grid = whole[k * n : (k + 1) * n].reshape(shape) + offset
                    yield tile(name, variable, grid, ("rows", "cols"), attrs={"SOURCE": name}, frame=k)

    return files(spark, path, **options).select("path", "content").mapInArrow(lambda batches: batched(decoded(batches)), TILES)


def raster_axes(spark: SparkSession, shape: tuple[int, int] = RASTER_SHAPE) -> tuple[DataFrame, DataFrame]:
    """``i, lat`` and ``i, lon``: the axes of the full raster."""
    lat = spark.range(shape[1]).select(F.col("id").cast("int").alias("i"), (F.col("id") * RASTER_LAT[1] + RASTER_LAT[0]).alias("lat"))
    lon = spark.range(shape[0]).select(F.col("id").cast("int").alias("i"), (F.col("id") * RASTER_LON[1] + RASTER_LON[0]).alias("lon"))
    return lat, lon


def read_netcdf(spark: SparkSession, path: str | Sequence[str], variables: Sequence[str] = (), nan_missing: bool = False, **options) -> DataFrame:
    """Variables of classic NetCDF files, all numeric ones if none are named. ``nan_missing`` turns the
    fill value into NaN."""
    wanted = set(variables)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = ClassicFile(content)
                for v in f.numeric():
                    if wanted and v not in wanted:
                        continue
                    _, attrs, kind, _, _ = f.variables[v]
                    data = f.read(v).astype(np.float64)
                    fill = attrs.get("_FillValue", attrs.get("missing_value"))
                    if nan_missing and fill not in (None, ""):
                        data = np.where(data == float(fill), np.nan, data)
                    yield tile(name, v, data, f.dim_names(v), NETCDF_NAMES[kind], {**f.attrs, **attrs, "SOURCE": name})

    return files(spark, path, **options).select("path", "content").mapInArrow(lambda batches: batched(decoded(batches)), TILES)


def random_dataset(spark: SparkSession, name: str, variables: dict[str, Sequence[int]], attrs: dict[str, str] | None = None) -> DataFrame:
    """A dataset of variables of uniform numbers from 0 to 300, fixed by their names; dimensions are called
    after the variable with _u, _v, ... _z."""
    rows = spark.createDataFrame([(v, [int(k) for k in shape]) for v, shape in variables.items()], "variable string, shape array<int>")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, shape in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.random.default_rng(list(v.encode())).random(shape) * 300.0
                yield tile_rows([tile(name, v, data, [f"{v}_{x}" for x, _ in zip("uvwxyz", shape, strict=False)], attrs=attrs)])

    return rows.mapInArrow(made, TILES)


def random_grids(spark: SparkSession, uris: Sequence[str], shape: tuple[int, int] = (20, 20), variable: str = "randVar", discs: Sequence[float] = (340.0, 7000.0, 24000.0), radius: float = 3.0) -> DataFrame:
    """Grids of three discs at random places, fixed by the URI."""
    rows = spark.createDataFrame([(u,) for u in uris], "uri string")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.indices(shape)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rng = np.random.default_rng(list(uri.encode()))
                grid = np.zeros(shape)
                for scale in discs:
                    a, b = rng.integers(0, shape[0]), rng.integers(0, shape[1])
                    inside = (i - a) ** 2 + (j - b) ** 2 <= radius**2
                    grid = np.where(inside, rng.random(shape) * scale, grid)
                yield tile_rows([tile(uri, variable, grid, ("rows", "cols"), attrs={"SOURCE": uri})])

    return rows.mapInArrow(made, TILES)


def read_strikes(spark: SparkSession, path: str) -> DataFrame:
    """Point table ``time, lat, lon, res_fit, num_stations`` from lines of date, time, lat, lon, fit and
    stations; lines without a comma are skipped."""
    parts = F.split("value", ",")
    lines = spark.read.text(path).where(F.contains("value", F.lit(",")))
    field = [F.trim(F.get(parts, F.lit(k))) for k in range(6)]
    return lines.select(
        F.concat_ws(" ", field[0], F.substring_index(field[1], ".", 1)).alias("time"), field[2].cast("double").alias("lat"), field[3].cast("double").alias("lon"), field[4].cast("double").alias("res_fit"), field[5].cast("int").alias("num_stations")
    )


def read_custom(spark: SparkSession, uris: Sequence[str], variables: Sequence[str], loader: Callable[[str, str], tuple[np.ndarray, Sequence[int]]], partitioner: Callable[[list[str]], list[list[str]]] | None = None) -> DataFrame:
    """Tiles of any kind of file: ``loader(uri, variable)`` gives the numbers and the shape, and ``partitioner`` the
    groups of URIs that tasks take, one each if there is none. Nothing is loaded before it is wanted."""
    groups = partitioner(list(uris)) if partitioner else [[u] for u in uris]
    rows = spark.createDataFrame([(k, u) for k, group in enumerate(groups) for u in group], "k int, uri string").repartitionById(max(1, len(groups)), "k")

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(1).to_pylist():
                for variable in variables:
                    data, shape = loader(uri, variable)
                    grid = np.asarray(data, np.float64).reshape(list(shape))
                    yield tile_rows([tile(uri, variable, grid, [f"{variable}_{k}" for k in range(grid.ndim)], attrs={"SOURCE": uri})])

    return rows.mapInArrow(loaded, TILES)


def by_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files of all folders below ``path`` with their folder, one partition to a folder's hash."""
    found = files(spark, path, recursive=True, **options)
    return found.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).repartition("folder")


def uri_groups(uris: DataFrame, size: int, uri: str = "uri") -> DataFrame:
    """``group`` of each URI: ``size`` of them to a group, in order. 1 puts each into its own."""
    from pyspark.sql import Window

    return uris.withColumn("group", F.floor((F.row_number().over(Window.orderBy(uri)) - 1) / size).cast("long"))


def grouped_uris(uris: Sequence[str], partitions: int) -> list[list[str]]:
    """URIs in groups of (n + partitions) / partitions, as a source's partitions."""
    size = max(1, (len(uris) + partitions) // max(1, partitions))
    return [list(uris[i : i + size]) for i in range(0, len(uris), size)]
