"""Sinks: partitioned tiles, files of features, node and edge records, viewer documents, arrays for notebooks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.tables import save
from fieldloom.sources.grids import write_datasets


def write_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder for each dataset and variable, so that scans of some read only those."""
    tiles.write.mode(mode).partitionBy("dataset", "variable").parquet(path)


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record a line."""
    rows.write.mode(mode).json(path)


def edge_text() -> Column:
    return F.format_string("((%d:%d), (%d:%d))", "src_frame", "src_label", "dst_frame", "dst_label")


def subgraph_lines(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``value``: a line ``Set(a:b,c:d, ...)`` of the edges of each subgraph, in order. A line holds a subgraph."""
    of = members.select(F.col("frame").alias("src_frame"), F.col("label").alias("src_label"), "subgraph")
    text = F.format_string("%d:%d,%d:%d", "src_frame", "src_label", "dst_frame", "dst_label")
    rows = edges.join(of, ["src_frame", "src_label"]).groupBy("subgraph").agg(F.array_sort(F.collect_list(F.struct("src_frame", "src_label", "dst_frame", "dst_label", text.alias("t")))).alias("e"))
    return rows.select(F.concat(F.lit("Set("), F.concat_ws(", ", F.col("e.t")), F.lit(")")).alias("value"))


def node_cells(labelled: DataFrame, nodes: DataFrame, tight: bool = True) -> DataFrame:
    """Cells of each feature and the name that its file goes by, with indices from its box if ``tight``."""
    boxed = labelled.join(nodes.select("frame", "label", "row_min", "row_max", "col_min", "col_max"), ["frame", "label"])
    name = F.format_string("F%dCE%d_%d_%d_%d_%d", "frame", "label", "row_min", "row_max", "col_min", "col_max")
    row, col = (F.col("i0") - F.col("row_min"), F.col("i1") - F.col("col_min")) if tight else (F.col("i0"), F.col("i1"))
    return boxed.select(name.alias("dataset"), "frame", "label", row.alias("i0"), col.alias("i1"), "value", "row_min", "row_max", "col_min", "col_max")


def write_nodes(labelled: DataFrame, nodes: DataFrame, lat: DataFrame, lon: DataFrame, path: str) -> None:
    """A NetCDF file for each feature: its box as whole numbers, 0 outside it, with the box's latitudes and
    longitudes (``i, lat`` and ``i, lon``)."""
    cells = node_cells(labelled, nodes)
    height, width = F.col("row_max") - F.col("row_min") + 1, F.col("col_max") - F.col("col_min") + 1
    grids = cells.groupBy("dataset", "frame", "row_min", "col_min", height.alias("h"), width.alias("w")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i0") * width + F.col("i1")).alias("k"), F.col("value").alias("v")))).alias("found"))
    data = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda k: F.coalesce(F.element_at("found", k), F.lit(0.0)))

    def named(*dims: str) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("int").alias("len")) for n, c in zip(dims[::2], dims[1::2], strict=True)])

    def tiles(rows: DataFrame, variable: str, dtype: str, shape: Column, dims: Column, attrs: Column) -> DataFrame:
        zero = F.transform(shape, lambda _: F.lit(0))
        return rows.select("dataset", F.lit(variable).alias("variable"), F.col("frame").cast("long"), F.lit(dtype).alias("dtype"), zero.alias("origin"), shape.alias("shape"), "data", dims.alias("dims"), attrs.alias("attrs"))

    none = F.create_map().cast("map<string,string>")
    grids = save(grids.withColumn("data", data).drop("found"), "node-grids")
    out = tiles(grids, "CE brightness temperature", "int", F.array(F.col("h").cast("int"), F.col("w").cast("int")), named("latitudes", "h", "longitudes", "w"), F.create_map(F.lit("units"), F.lit("K")))
    for axis, variable, dim, begin, n in ((lat, "lat", "latitudes", "row_min", "h"), (lon, "lon", "longitudes", "col_min", "w")):
        at = grids.select("dataset", "frame", begin, n, F.explode(F.sequence(F.col(begin), F.col(begin) + F.col(n) - 1)).alias("i"))
        values = at.join(axis, "i").groupBy("dataset", "frame", n).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", variable))), lambda s: s[variable]).alias("data"))
        out = out.unionByName(tiles(values, variable, "double", F.array(F.col(n).cast("int")), named(dim, n), none))
    write_datasets(out, path)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``number`` from 0 in the order of columns: a sort, and the counts of its partitions, one row each."""
    from pyspark.sql import Window

    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = save(rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    counts = ordered.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    base = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"))
    return ordered.join(F.broadcast(base), part == F.col("__p")).withColumn("number", F.col("__base") + place).drop("__m", "__p", "__base")


def viewer_nodes(edges: DataFrame, dates: DataFrame) -> DataFrame:
    """``json`` of each node that an edge has: its id as ``(frame,label)`` and ``date:label`` as label.
    ``dates`` are ``frame, date``."""
    ends = [edges.select(F.col(f"{e}_frame").alias("frame"), F.col(f"{e}_label").alias("label")) for e in ("src", "dst")]
    nodes = ends[0].union(ends[1]).distinct().join(dates, "frame")
    return nodes.select(F.to_json(F.struct(node_id("frame", "label").alias("id"), F.concat(F.col("date"), F.lit(":"), F.col("label").cast("string")).alias("label"))).alias("json"))


def node_id(frame: str, label: str) -> Column:
    return F.format_string("(%s,%s)", F.col(frame).cast("string"), F.col(label).cast("string"))


def viewer_edges(edges: DataFrame) -> DataFrame:
    """``json`` of each edge: a number from 0, and its ends' ids."""
    rows = numbered(edges, "src_frame", "src_label", "dst_frame", "dst_label")
    return rows.select(F.to_json(F.struct(F.col("number").alias("id"), node_id("src_frame", "src_label").alias("source"), node_id("dst_frame", "dst_label").alias("target"))).alias("json"))


def array_rows(tiles: DataFrame, variable: str, name: str = "dataset") -> DataFrame:
    """``bytes, shape, id`` of one variable: its numbers as big-endian doubles."""

    def packed(batches):
        for batch in batches:
            raw = [np.array(d, ">f8").tobytes() for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column(1), batch.column(2)], ["bytes", "shape", "id"])

    rows = tiles.where(F.col("variable") == variable).select("data", "shape", F.col(name).cast("string").alias("id"))
    return rows.mapInArrow(packed, "bytes binary, shape array<int>, id string")


def arrays(tiles: DataFrame, variable: str, most_cells: int = 1 << 26) -> pa.Table:
    """``dataset, shape, data`` of one variable for a notebook; raises if there are over ``most_cells`` cells."""
    rows = tiles.where(F.col("variable") == variable).select("dataset", "shape", "data")
    n = rows.agg(F.coalesce(F.sum(F.size("data").cast("long")), F.lit(0))).first()[0]
    if n > most_cells:
        raise ValueError(f"{n} cells are too many for one machine; write them, or take fewer")
    return rows.toArrow()
