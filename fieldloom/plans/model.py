"""The two layouts of gridded data.

``tiles``: one row per array (``dataset, variable, frame, dtype, origin, shape, data, dims,
attrs``), row-major doubles; for element-wise work. ``cells``: one row per cell (``dataset,
variable, frame, i0, i1, ..., value``); for axes, windows and joins. A cell that is absent is
background (0.0) when cells become tiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILES = (
    "dataset string, variable string, frame bigint, dtype string, origin array<int>, shape array<int>, data array<double>, "
    "dims array<struct<name:string,len:int>>, attrs map<string,string>"
)
KEY = ("dataset", "variable", "frame")


def strides(shape: Sequence[int]) -> list[int]:
    return [reduce(lambda a, b: a * b, shape[k + 1 :], 1) for k in range(len(shape))]


def promoted(shape: Sequence[int]) -> list[int]:
    """Rank 0 is 1 x 1 and rank 1 is 1 x n."""
    return [1] * (2 - len(shape)) + list(shape)


def linear_index(names: Sequence[str], shape: Sequence[int]) -> Column:
    return sum((F.col(n) * s for n, s in zip(names, strides(shape), strict=True)), F.lit(0))


def axes(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def to_cells(tiles: DataFrame, rank: int = 2, keys: Sequence[str] = KEY) -> DataFrame:
    """Cells of tiles of one rank; indices count from the tile's origin."""
    long = tiles.select(*keys, "shape", "origin", F.posexplode("data").alias("at", "value"))
    out, rest = long, F.col("at")
    for k in range(rank):
        stride = reduce(lambda a, b: a * b, [F.element_at("shape", m + 1) for m in range(k + 1, rank)], F.lit(1))
        out = out.withColumn(f"i{k}", (F.floor(rest / stride) + F.coalesce(F.get("origin", F.lit(k)), F.lit(0))).cast("int"))
        rest = rest % stride
    return out.select(*keys, *axes(rank), "value")


def to_tiles(cells: DataFrame, shape: Sequence[int], keys: Sequence[str] = KEY, fill: float = 0.0) -> DataFrame:
    """Tiles of one shape; absent cells get ``fill``. The cells of a tile meet in one row, so tiles are
    meant to be of bounded size (``operators.shape.split_tiles`` cuts larger grids)."""
    n = reduce(lambda a, b: a * b, shape, 1)
    found = F.map_from_entries(F.collect_list(F.struct(linear_index(axes(len(shape)), shape).cast("int").alias("k"), F.col("value").alias("v"))))
    data = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at("found", k), F.lit(fill)))
    tiles = cells.groupBy(*keys).agg(found.alias("found"))
    return tiles.select(*keys, F.array(*[F.lit(int(s)) for s in shape]).alias("shape"), F.array(*[F.lit(0)] * len(shape)).alias("origin"), data.alias("data"))


def densify(cells: DataFrame, shape: Sequence[int], keys: Sequence[str] = KEY, fill: float = 0.0) -> DataFrame:
    """Every cell of every frame that has one; absent ones at ``fill``. The full grid is made by exploding
    the axes on each frame's row, not by a join of tables."""
    frames = cells.select(*keys).distinct()
    for name, n in zip(axes(len(shape)), shape, strict=True):
        frames = frames.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return frames.join(cells, [*keys, *axes(len(shape))], "left").withColumn("value", F.coalesce("value", F.lit(fill)))
