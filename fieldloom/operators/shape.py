"""Shape operators: reshape, slice, broadcast, stack, tile. Over cells they relabel indices and need no
shuffle; over tiles they rearrange the array column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.plans.model import axes, linear_index, strides


def reshape(cells: DataFrame, old: Sequence[int], new: Sequence[int]) -> DataFrame:
    """Row-major relabelling."""
    if reduce(lambda a, b: a * b, old, 1) != reduce(lambda a, b: a * b, new, 1):
        raise ValueError(f"{list(old)} and {list(new)} differ in size")
    at = linear_index(axes(len(old)), old)
    fresh = [F.floor(at / s).cast("int") % n for s, n in zip(strides(new), new, strict=True)]
    keep = [c for c in cells.columns if c not in axes(len(old))]
    return cells.select(*[c for c in keep if c != "value"], *[f.cast("int").alias(a) for f, a in zip(fresh, axes(len(new)), strict=True)], "value")


def slice_cells(cells: DataFrame, *ranges: tuple[int, int]) -> DataFrame:
    """Half-open ranges of the leading axes, indices counted from each range's start."""
    for k, (a, b) in enumerate(ranges):
        cells = cells.where((F.col(f"i{k}") >= a) & (F.col(f"i{k}") < b))
    return cells.withColumns({f"i{k}": F.col(f"i{k}") - a for k, (a, _) in enumerate(ranges)})


def take_index(cells: DataFrame, index: int, rank: int) -> DataFrame:
    """Drops the leading axis at ``index``."""
    found = cells.where(F.col("i0") == index).drop("i0")
    return found.withColumnsRenamed({f"i{k}": f"i{k - 1}" for k in range(1, rank)})


def element(data: str, shape: Sequence[int], *index: int) -> Column:
    """One element of a tile."""
    return F.element_at(data, sum(i * s for i, s in zip(index, strides(shape), strict=True)) + 1)


def slice_tiles(tiles: DataFrame, shape: Sequence[int], *ranges: tuple[int, int]) -> DataFrame:
    """The same over 2-d tiles, as ``slice`` of each row."""
    (r0, r1), (c0, c1) = [*ranges, *[(0, n) for n in shape[len(ranges) :]]]
    rows = F.transform(F.sequence(F.lit(r0), F.lit(r1 - 1)), lambda r: F.slice("data", r * shape[1] + c0 + 1, c1 - c0))
    return tiles.withColumns({"data": F.flatten(rows), "shape": F.array(F.lit(r1 - r0), F.lit(c1 - c0))})


def broadcast_cells(cells: DataFrame, n: int, rank: int) -> DataFrame:
    """Repeats along a new leading axis of ``n``."""
    moved = cells.withColumnsRenamed({f"i{k}": f"i{k + 1}" for k in reversed(range(rank))})
    return moved.withColumn("i0", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def stack_tiles(tiles: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Tiles of each group, in ``order``, as one array with a new leading axis."""
    rows = F.array_sort(F.collect_list(F.struct(order, "data", "shape")))
    stacked = tiles.groupBy(*by).agg(rows.alias("rows"))
    data = F.flatten(F.transform("rows", lambda r: r["data"]))
    shape = F.concat(F.array(F.size("rows")), F.get("rows", F.lit(0))["shape"])
    return stacked.select(*by, shape.alias("shape"), data.alias("data"))


def split_tiles(cells: DataFrame, shape: Sequence[int], tile: Sequence[int] = ()) -> DataFrame:
    """Adds the tile's number on each axis (``t0, t1, ...``) and its indices within; a remainder at the
    end of an axis is dropped, an empty tile shape is the whole, fewer lengths are leading axes."""
    lengths = [*tile, *shape[len(tile) :]]
    if any(t < 1 or t > n for t, n in zip(lengths, shape, strict=True)):
        raise ValueError(f"tiles of {lengths} don't fit into {list(shape)}")
    for k, (t, n) in enumerate(zip(lengths, shape, strict=True)):
        cells = cells.where(F.col(f"i{k}") < n // t * t)
    numbers = {f"t{k}": F.floor(F.col(f"i{k}") / t).cast("int") for k, t in enumerate(lengths)}
    return cells.withColumns(numbers).withColumns({f"i{k}": F.col(f"i{k}") % t for k, t in enumerate(lengths)})


def stack_cells(tiled: DataFrame, key: str = "frame", rank: int = 2) -> DataFrame:
    """From tiles by time to stacks by tile: the key's rank becomes the new leading axis ``i0``. Ranks
    come from the distinct keys, a small table."""
    ranks = tiled.select(key).distinct().withColumn("__rank", F.row_number().over(Window.orderBy(key)) - 1)
    moved = tiled.join(ranks, key).withColumnsRenamed({f"i{k}": f"i{k + 1}" for k in reversed(range(rank))})
    return moved.withColumn("i0", F.col("__rank").cast("int")).drop("__rank")


def by_space(cells: DataFrame, shape: Sequence[int], tile: Sequence[int], key: str = "frame") -> DataFrame:
    """From time-partitioned to space-partitioned: each tile's series in one partition, in key order."""
    tiled = split_tiles(cells, shape, tile)
    names = [f"t{k}" for k in range(len(shape))]
    return tiled.repartition(*names).sortWithinPartitions(*names, key, *axes(len(shape)))


def monthly_to_annual(cells: DataFrame) -> DataFrame:
    """Leading axis of months to ``(year, month)``."""
    return cells.withColumns({"year": F.floor(F.col("i0") / 12).cast("int"), "month": (F.col("i0") % 12).cast("int")}).drop("i0")


def normalize_longitudes(cells: DataFrame, lon: str = "lon") -> DataFrame:
    """[0, 360) to [-180, 180); where all are above 180, all are shifted."""
    shifted = F.when(F.col(lon) >= 180, F.col(lon) - 360).otherwise(F.col(lon))
    return cells.withColumn(lon, shifted)


def ascending_axis(cells: DataFrame, name: str, index: str) -> DataFrame:
    """Renumbers an axis so that its coordinate ascends; the coordinates are a small table. Reading it
    raises if the coordinates neither ascend nor descend with the index."""
    axis = cells.select(name, index).distinct()
    by_name = Window.orderBy(name, index)
    axis = axis.select(name, F.col(index).alias("__old"), (F.row_number().over(by_name).cast("int") - 1).alias(index), (F.col(index) - F.lag(index).over(by_name)).alias("__step"))
    turns = axis.agg((F.count_if(F.col("__step") <= 0) * F.count_if(F.col("__step") >= 0)).alias("__turns"))
    axis = axis.drop("__step").join(F.broadcast(turns))  # one row
    order = axis.select(name, F.when(F.col("__turns") == 0, F.col(index)).otherwise(F.raise_error(F.lit(f"the axis {name} is not sorted")).cast("int")).alias(index))
    return cells.drop(index).join(order, name)


def normalize_axes(cells: DataFrame, lat: str = "lat", lon: str = "lon", rows: str = "i0", cols: str = "i1") -> DataFrame:
    """Ascending latitudes, longitudes in [-180, 180), indices to match."""
    cells = ascending_axis(cells, lat, rows)
    cells = normalize_longitudes(ascending_axis(cells, lon, cols), lon)
    order = F.row_number().over(Window.orderBy(lon)).cast("int") - 1
    return cells.drop(cols).join(cells.select(lon).distinct().withColumn(cols, order), lon)

