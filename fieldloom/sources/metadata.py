"""Variables and attributes of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variable(tiles: DataFrame, name: str) -> DataFrame:
    return tiles.where(F.col("variable") == name)


def insert_variables(tiles: DataFrame, new: DataFrame) -> DataFrame:
    """Adds variables, in place of those of the same dataset and name."""
    kept = tiles.join(new.select("dataset", "variable").distinct(), ["dataset", "variable"], "left_anti")
    return kept.select(*tiles.columns).unionByName(new.select(*tiles.columns))


def upsert(attrs: str, new: dict[str, str]) -> Column:
    """The map with ``new`` entries in place of any of the same keys."""
    fresh = F.create_map(*[F.lit(x) for pair in new.items() for x in pair])
    return F.map_concat(F.map_filter(attrs, lambda k, _: ~k.isin(*new)), fresh)


def attribute(attrs: str, name: str) -> Column:
    """Raises where the attribute is missing."""
    value = F.try_element_at(attrs, F.lit(name))
    return F.coalesce(value, F.raise_error(F.lit(f"no attribute {name}")).cast("string"))


def dimension(dims: str, name: str) -> Column:
    value = F.try_element_at(F.map_from_entries(dims), F.lit(name))
    return F.coalesce(value, F.raise_error(F.lit(f"no dimension {name}")).cast("int"))


def global_dimensions(tiles: DataFrame) -> DataFrame:
    """Distinct ``dataset, name, len``."""
    return tiles.select("dataset", F.explode("dims").alias("d")).select("dataset", "d.name", "d.len").distinct()


def rendering(name: str = "variable", dtype: str = "dtype", dims: str = "dims", attrs: str = "attrs", shape: str = "shape") -> Column:
    """``type name(dims)``, a line for each attribute in order, and the shape."""
    names = F.concat_ws(", ", F.transform(dims, lambda d: d["name"]))
    lines = F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(F.lit("\t"), e["key"], F.lit(": "), e["value"], F.lit("\n")))
    sizes = F.concat_ws(", ", F.transform(shape, lambda n: n.cast("string")))
    return F.concat(F.col(dtype), F.lit(" "), F.col(name), F.lit("("), names, F.lit(")\n"), F.array_join(lines, ""), F.lit("current shape = ("), sizes, F.lit(")\n"))


def dataset_renderings(tiles: DataFrame, attrs: dict[str, str] | None = None) -> DataFrame:
    """``dataset, rendering``: name, attributes, dimensions with sizes, and variables with their dimensions,
    in the order of their names. A dataset's variables meet in one row, without their data."""
    named = F.struct("variable", F.concat(F.col("dtype"), F.lit(" "), F.col("variable"), F.lit("("), F.concat_ws(", ", F.transform("dims", lambda d: d["name"])), F.lit(")")).alias("text"), "dims")
    found = tiles.groupBy("dataset").agg(F.array_sort(F.collect_set(named)).alias("v"))
    sizes = F.transform(F.array_distinct(F.flatten(F.col("v.dims"))), lambda d: F.concat(d["name"], F.lit("("), d["len"].cast("string"), F.lit(")")))
    lines = "".join(f"\t{k}: {v}\n" for k, v in (attrs or {}).items())
    body = F.concat(F.col("dataset"), F.lit("\nroot group ...\n" + lines + "\tdimensions(sizes): ("), F.concat_ws(", ", sizes), F.lit(")\n\tvariables: ("), F.concat_ws(", ", F.col("v.text")), F.lit(")\n"))
    return found.select("dataset", body.alias("rendering"))


def sample_axes(tiles: DataFrame, lat: str, lon: str) -> tuple[DataFrame, DataFrame]:
    """``i, lat`` and ``i, lon`` of one dataset, the first by name, as all are taken to share their axes."""
    first = tiles.agg(F.min("dataset").alias("__first"))
    one = tiles.join(F.broadcast(first), F.col("dataset") == F.col("__first"))  # one row
    axis = {n: one.where(F.col("variable") == v).select(F.posexplode("data").alias("i", n)) for n, v in (("lat", lat), ("lon", lon))}
    return axis["lat"], axis["lon"]
