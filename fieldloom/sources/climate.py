"""Climate files: axes found by their names, decoded times, series of files, lists of edges as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.dates import decode_time
from fieldloom.plans.model import to_cells
from fieldloom.sources.grids import read_datasets, variable_names
from fieldloom.sources.raster import LATITUDES, LONGITUDES, TIMES


def axis_name(variables: dict[str, Sequence[str]], of: str, known: Sequence[str]) -> str:
    """The variable that is an axis of the variable ``of``, given the dimensions of all: the only one-dimensional
    variable along the dimension that goes by a known name, else the only variable that does."""
    dims = [d for d in variables[of] if d.lower() in known]
    if len(dims) == 1:
        along = [v for v, own in variables.items() if list(own) == dims]
        if len(along) == 1:
            return along[0]
    named = [v for v in variables if v.lower() in known]
    if len(named) == 1:
        return named[0]
    raise ValueError(f"no single variable of {sorted(variables)} is one of {list(known)}")


def load_grid(
    spark: SparkSession, path: str, variable: str, elevation: int = 0, lat_name: str | None = None, lon_name: str | None = None, time_name: str | None = None, nan_missing: bool = False, **options: str
) -> DataFrame:
    """``dataset, time, lat, lon, i0, i1, i2, value`` of a variable of time, latitude and longitude in any
    order, at one level if it has a fourth dimension. ``i0, i1, i2`` are the places on the three axes.
    The first dataset by name tells the axes' names, as all are taken to share them."""
    names = variable_names(spark, path, **options)
    first = names.agg(F.min("dataset")).first()[0]
    if first is None:
        raise ValueError(f"no dataset at {path}")
    told = {r.variable: [d.name for d in r.dims] for r in names.where(F.col("dataset") == first).collect()}  # a row a variable of one file
    if variable not in told:
        raise ValueError(f"{first} has no variable {variable}")
    lat, lon, time = (given or axis_name(told, variable, known) for given, known in ((lat_name, LATITUDES), (lon_name, LONGITUDES), (time_name, TIMES)))
    dims = told[variable]
    place = {a: dims.index(told[a][0]) for a in (lat, lon, time)}
    tiles = read_datasets(spark, path, [variable, lat, lon, time], nan_missing=nan_missing, **options)
    cells = to_cells(tiles.where(F.col("variable") == variable), len(dims), ["dataset"])
    for k in set(range(len(dims))) - set(place.values()):
        cells = cells.where(F.col(f"i{k}") == elevation)
    cells = cells.select("dataset", *[F.col(f"i{place[a]}").alias(n) for a, n in ((time, "i0"), (lat, "i1"), (lon, "i2"))], "value")
    for axis, index, name in ((time, "i0", "time"), (lat, "i1", "lat"), (lon, "i2", "lon")):
        values = tiles.where(F.col("variable") == axis).select("dataset", F.try_element_at("attrs", F.lit("units")).alias("units"), F.posexplode("data").alias(index, name))
        if axis == time:
            values = values.withColumn(name, decode_time(F.col(name), F.col("units")))
        cells = cells.join(values.drop("units"), ["dataset", index])
    return cells.select("dataset", "time", "lat", "lon", "i0", "i1", "i2", "value")


def load_series(spark: SparkSession, path: str, variable: str, pattern: str = "", time_dim: str | None = None, **options: str) -> DataFrame:
    """``frame, i1, i2, ..., value`` of files that follow on each other along their leading axis, in the order
    of their names: ``frame`` counts through all of them."""
    if pattern:
        options["pattern"] = pattern
    heads = variable_names(spark, path, **options).where(F.col("variable") == variable)
    lengths = heads.select("dataset", F.get("dims", F.lit(0))["len"].alias("n"), F.size("dims").alias("rank"))
    base = lengths.select("dataset", (F.sum("n").over(Window.orderBy("dataset")) - F.col("n")).alias("base"))  # a row a file
    found = lengths.agg(F.min("rank"), F.max("rank")).first()
    if found[0] is None or found[0] != found[1]:
        raise ValueError(f"{variable} is missing or has no one number of dimensions")
    cells = to_cells(read_datasets(spark, path, [variable], **options), found[0], ["dataset"])
    joined = cells.join(base, "dataset").withColumn("frame", (F.col("base") + F.col("i0")).cast("long"))
    return joined.select("frame", *[f"i{k}" for k in range(1, found[0])], "value")


def load_subgraphs(spark: SparkSession, path: str) -> DataFrame:
    """``subgraph, src_frame, src_label, dst_frame, dst_label`` from lines ``Set(a:b,c:d, ...)``; a subgraph is
    named by its line's hash."""
    edge = r"(\d+):(\d+),(\d+):(\d+)"
    lines = spark.read.text(path).select(F.xxhash64("value").alias("subgraph"), F.explode(F.regexp_extract_all("value", F.lit(edge), 0)).alias("e"))
    return lines.select("subgraph", *edge_columns("e", edge))


def load_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """``src_frame, src_label, dst_frame, dst_label`` from text of ``((f,c),(f,c)), ...``, or with colons."""
    edge = r"\(\((\d+)[,:](\d+)\),\s*\((\d+)[,:](\d+)\)\)"
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(edge), 0)).alias("e")).select(*edge_columns("e", edge))


def edge_columns(text: str, pattern: str) -> list:
    kinds = (("src_frame", "long"), ("src_label", "int"), ("dst_frame", "long"), ("dst_label", "int"))
    return [F.regexp_extract(text, pattern, k + 1).cast(t).alias(n) for k, (n, t) in enumerate(kinds)]
