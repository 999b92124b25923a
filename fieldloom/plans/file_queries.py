"""Queries that write files and read them again: sources and sinks against the tables they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import dates
from fieldloom.operators import tracking as tr
from fieldloom.plans.model import to_cells
from fieldloom.plans.queries import EDGES, EMB, EVT, FULL, GRID, MEMBERS, NODES, emb, evt, full, hot, query, read, saved_hot, six
from fieldloom.plans.tables import new_path, save
from fieldloom.sources import climate, grids, metadata, raster, sinks

VARIABLES = "n as (select 'grid_' || label as dataset, 'v' || vec_id as variable, pos, round(value, 6) + 0.0 as value from emb)"


def named(*dims: tuple[str, int | Column]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), (k if isinstance(k, Column) else F.lit(k)).cast("int").alias("len")) for n, k in dims])


def as_tiles(rows: DataFrame, dataset: Column, variable: Column, dims: Column, dtype: str = "double", attrs: dict[str, str] | None = None, frame: Column | None = None) -> DataFrame:
    """Rows with ``data`` as tiles of their own shape."""
    pairs = [F.lit(x) for p in (attrs or {}).items() for x in p]
    shape = F.transform(dims, lambda d: d["len"])
    return rows.select(
        dataset.alias("dataset"), variable.alias("variable"), (F.lit(None) if frame is None else frame).cast("long").alias("frame"), F.lit(dtype).alias("dtype"), F.transform(shape, lambda _: F.lit(0)).alias("origin"),
        shape.alias("shape"), "data", dims.alias("dims"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("attrs"),
    )


def emb_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset for each label, a variable for each vector."""
    name = F.concat(F.lit("grid_"), F.col("label").cast("string"))
    return as_tiles(emb(spark, sf_dir), name, F.concat(F.lit("v"), F.col("vec_id").cast("string")), named(("rows", 8), ("cols", 8)), "float", {"units": "K"})


def emb_files(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "grid-files")
    grids.write_datasets(emb_tiles(spark, sf_dir), path)
    return path


def base_name(column: str = "dataset") -> Column:
    return F.regexp_extract(F.substring_index(column, "/", -1), r"^([^/]+?)(?:\.nc|\.bin)?$", 1)


def values(tiles: DataFrame) -> DataFrame:
    """Cells by their place; names are taken from paths before, once a tile."""
    named = tiles.select(base_name().alias("dataset"), "variable", "data")
    return named.select("dataset", "variable", F.posexplode("data").alias("pos", "value")).select("dataset", "variable", "pos", six())


@query(f"with {EMB}, {VARIABLES} select * from n")
def netcdf_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each dataset, read at random access from a folder."""
    return values(grids.read_datasets(spark, emb_files(spark, sf_dir), partitions=4))


@query(f"with {EMB}, {VARIABLES} select * from n")
def netcdf_whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as bytes through Spark's own file reader."""
    return values(raster.read_netcdf(spark, emb_files(spark, sf_dir)))


def listed(spark: SparkSession, uris: list[str]) -> str:
    """A text file of URIs."""
    from fieldloom.plans.tables import write_text

    path = f"{new_path(spark, 'uris')}.txt"
    write_text(spark, path, "\n".join(uris) + "\n\n")
    return path


@query(f"with {EMB}, {VARIABLES} select * from n")
def netcdf_uri_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files by a text file that lists them."""
    from fieldloom.sources.access import listed as files

    return values(grids.read_datasets(spark, listed(spark, files(emb_files(spark, sf_dir)))))


@query(f"with {EMB}, {VARIABLES} select dataset, variable, cast((pos // 8 - 2) // 2 * 3 + pos % 8 - 1 as int) as pos, value from n where pos // 8 in (2, 4, 6) and pos % 8 >= 1 and pos % 8 < 4")
def netcdf_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 2, 4, 6 and columns 1 to 3 of every variable, by a constraint in the URI."""
    path = emb_files(spark, sf_dir)
    names = grids.variable_names(spark, path).groupBy("dataset").agg(F.array_sort(F.collect_list("variable")).alias("v")).collect()
    return values(grids.read_datasets(spark, listed(spark, [f"{r.dataset}?{','.join(dates.dap_constraint(v, (2, 2, 6), (1, 3)) for v in r.v)}" for r in names])))


@query("select 'grid_' || label as dataset, 'v' || vec_id as variable, 'float' as dtype, 'rows=8,cols=8' as dims, 'K' as units, cast(8 as int) as cols from embeddings")
def netcdf_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, types, dimensions and attributes from the headers alone."""
    found = grids.variable_names(spark, emb_files(spark, sf_dir))
    dims = F.concat_ws(",", F.transform("dims", lambda d: F.concat(d["name"], F.lit("="), d["len"].cast("string"))))
    return found.select(base_name().alias("dataset"), "variable", "dtype", dims.alias("dims"), metadata.attribute("attrs", "units").alias("units"), metadata.dimension("dims", "cols").alias("cols"))


@query(f"with {EMB}, {VARIABLES} select dataset, variable, cast(pos as int) as pos, value from n")
def tiles_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as Parquet, a folder for each dataset and variable."""
    path = new_path(spark, "tiles")
    tiles = emb_tiles(spark, sf_dir).withColumn("attrs", F.create_map(F.lit("name"), F.col("variable")))
    sinks.write_tiles(tiles.withColumn("variable", F.concat(F.lit("w"), F.pmod(F.xxhash64("variable"), F.lit(3)).cast("string"))), path)
    rows = spark.read.parquet(path)
    return rows.select("dataset", metadata.attribute("attrs", "name").alias("variable"), F.posexplode("data").alias("pos", "value")).select("dataset", "variable", "pos", six())


# rasters ---------------------------------------------------------------------------------------

BYTES = f"{FULL}, rounded as (select frame, i0, i1, least(greatest(round_even(value, 0), 0), 255) as b from full_)"


def raster_files(spark: SparkSession, sf_dir: str, path: str, rows: Column | None = None) -> str:
    """A raw file for each day, of the grid's values rounded to bytes."""
    cells = full(spark, sf_dir)
    data = F.transform(F.array_sort(F.collect_list(F.struct("i0", "i1", "value"))), lambda s: F.least(F.greatest(F.bround(s["value"], 0), F.lit(0.0)), F.lit(255.0)) + 75.0)
    days = (cells if rows is None else cells.where(rows)).groupBy("frame").agg(data.alias("data"))
    tiles = as_tiles(days, F.concat(F.lit("day_"), F.col("frame").cast("string")), F.lit("TMP"), named(("rows", GRID[0]), ("cols", GRID[1])), frame=F.lit(0))
    grids.write_datasets(tiles, path, "raster")
    return path


def raster_cells(tiles: DataFrame) -> DataFrame:
    days = tiles.where("variable = 'TMP'").withColumn("day", dates.frame_of_name(base_name(), 1))
    return to_cells(days, 2, ["day"]).select("day", "i0", "i1", six())


@query(f"with {BYTES} select frame as day, i0, i1, b + 75.0 as value from rounded")
def raster_files_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = raster_files(spark, sf_dir, new_path(spark, "rasters"))
    return raster_cells(raster.read_raster(spark, path, GRID))


@query(f"with {BYTES} select frame as day, i0, i1, b + 75.0 as value from rounded")
def raster_files_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = raster_files(spark, sf_dir, new_path(spark, "rasters"))
    return raster_cells(grids.read_datasets(spark, path, kind="raster", shape=f"{GRID[0]},{GRID[1]}"))


@query(f"with {EVT} select case when frame % 2 = 0 then 'even' else 'odd' end as folder, count(*) as files, cast(1 as bigint) as partitions from (select distinct frame from evt) group by all")
def raster_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two folders, each folder's in one partition."""
    path = new_path(spark, "folders")
    raster_files(spark, sf_dir, f"{path}/even", F.col("frame") % 2 == 0)
    raster_files(spark, sf_dir, f"{path}/odd", F.col("frame") % 2 == 1)
    found = raster.by_folder(spark, path, pattern="*.bin").select("folder", "path", F.spark_partition_id().alias("part"))
    return found.groupBy("folder").agg(F.count("*").alias("files"), F.countDistinct("part").alias("partitions"))


@query("select 'lat' as axis, cast(range as int) as i, round(cast(59.982 as double) - range * cast(0.036383683 as double), 6) as value from range(3298) union all select 'lon', cast(range as int), round(cast(0.0182 as double) + range * cast(0.036378335 as double), 6) from range(9896)")
def raster_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = raster.raster_axes(spark)
    return lat.select(F.lit("lat").alias("axis"), "i", F.round("lat", 6).alias("value")).unionByName(lon.select(F.lit("lon").alias("axis"), "i", F.round("lon", 6).alias("value")))


@query("select 'u' || r_regionkey as uri, cast(400 as bigint) as cells, true as in_range, true as disc_sized, true as again from region")
def random_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made grids keep to their discs and values and are the same each time."""
    uris = [f"u{r.r_regionkey}" for r in read(spark, sf_dir, "region").select("r_regionkey").collect()]  # five regions
    made = [raster.random_grids(spark, uris).select("dataset", F.posexplode("data").alias("pos", "value")) for _ in range(2)]
    both = made[0].join(made[1].withColumnRenamed("value", "other"), ["dataset", "pos"])
    rows = both.groupBy(F.col("dataset").alias("uri")).agg(F.count("*").alias("cells"), F.min((F.col("value") >= 0) & (F.col("value") <= 24000)).alias("in_range"), F.count_if(F.col("value") > 0).alias("n"), F.min(F.col("value") == F.col("other")).alias("again"))
    return rows.select("uri", "cells", "in_range", F.col("n").between(1, 87).alias("disc_sized"), "again")


@query("select 'made' as dataset, 'r' || r_regionkey as variable, 'r' || r_regionkey || '_u=' || (r_regionkey + 2) || ',r' || r_regionkey || '_v=5' as dims, cast((r_regionkey + 2) * 5 as bigint) as cells, true as in_range from region")
def random_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = {f"r{r.r_regionkey}": (r.r_regionkey + 2, 5) for r in read(spark, sf_dir, "region").select("r_regionkey").collect()}  # five regions
    made = raster.random_dataset(spark, "made", shapes)
    dims = F.concat_ws(",", F.transform("dims", lambda d: F.concat(d["name"], F.lit("="), d["len"].cast("string"))))
    return made.select("dataset", "variable", dims.alias("dims"), F.size("data").cast("long").alias("cells"), F.forall("data", lambda x: (x >= 0) & (x < 300)).alias("in_range"))


# points, series, climate files -----------------------------------------------------------------


@query("select strftime(ts, '%Y/%m/%d %H:%M:%S') as time, cast(user_id % 90 as double) as lat, -cast(event_id % 180 as double) as lon, cast(user_id % 7 as double) as res_fit, cast(5 as int) as num_stations, count(*) as n from events group by all")
def strike_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of strikes, with a line that isn't one."""
    rows = read(spark, sf_dir, "events")
    line = F.format_string("%s,%s.313426, %d, -%d, %d,  5", F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "HH:mm:ss"), F.col("user_id") % 90, F.col("event_id") % 180, F.col("user_id") % 7)
    path = new_path(spark, "strikes")
    rows.select(line.alias("value")).union(spark.sql("select 'no strikes'")).write.text(path)
    found = raster.read_strikes(spark, path)
    return found.withColumn("lon", F.col("lon") + 0.0).groupBy("time", "lat", "lon", "res_fit", "num_stations").agg(F.count("*").alias("n"))


def day_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset for each day: the dense grid as (hour, row), with its axes in files of the climate sort."""
    cells = full(spark, sf_dir)
    data = F.transform(F.array_sort(F.collect_list(F.struct("i1", "i0", "value"))), lambda s: s["value"])
    days = save(cells.groupBy("frame").agg(data.alias("data")), "days")
    name = F.concat(F.lit("pr_"), F.col("frame").cast("string"))
    grid = as_tiles(days, name, F.lit("pr"), named(("time", 24), ("lat", 16), ("lon", 1)), attrs={"units": "mm"})
    out = grid
    since = F.concat(F.lit("hours since "), F.concat_ws("-", F.substring(F.col("frame").cast("string"), 1, 4), F.substring(F.col("frame").cast("string"), 5, 2), F.substring(F.col("frame").cast("string"), 7, 2)), F.lit(" 00:00:00"))
    for axis, n, value in (("time", 24, lambda k: k.cast("double")), ("lat", 16, lambda k: 40.0 - k * 2.5), ("lon", 1, lambda k: k * 1.0 + 250.0)):
        rows = days.select("frame", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value).alias("data"))
        tiles = as_tiles(rows, name, F.lit(axis), named((axis, n)))
        if axis == "time":
            tiles = as_tiles(rows.withColumn("since", since), name, F.lit(axis), named((axis, n))).join(rows.select(name.alias("dataset"), since.alias("since")), "dataset").withColumn("attrs", F.create_map(F.lit("units"), F.col("since"))).drop("since")
        out = out.unionByName(tiles.select(*grid.columns))
    return out


@query(f"with {FULL} select cast(24 * (dense_rank() over (order by frame) - 1) + i1 as bigint) as frame, i0, value from full_")
def series_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a day each as one series of hours."""
    path = new_path(spark, "series")
    grids.write_datasets(day_hours(spark, sf_dir), path)
    return climate.load_series(spark, path, "pr", pattern=r"pr_\d+\.nc$", partitions="8").select("frame", F.col("i1").alias("i0"), "value")


@query(f"with {FULL} select strptime(cast(frame as varchar), '%Y%m%d') + to_hours(i1) as time, 40.0 - i0 * 2.5 as lat, 250.0 as lon, value from full_")
def climate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes found by their names, times decoded by their units."""
    path = new_path(spark, "climate")
    grids.write_datasets(day_hours(spark, sf_dir), path)
    cells = climate.load_grid(spark, path, "pr", partitions="8")
    return cells.select(F.col("time").cast("timestamp_ntz").alias("time"), F.round("lat", 6).alias("lat"), "lon", "value")


# features --------------------------------------------------------------------------------------


def grid_axes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    lat = spark.range(GRID[0]).select(F.col("id").cast("int").alias("i"), (40.0 - F.col("id") * 2.5).alias("lat"))
    lon = spark.range(GRID[1]).select(F.col("id").cast("int").alias("i"), (F.col("id") * 3.0 - 20.0).alias("lon"))
    return lat, lon


BOXES = f"{NODES}, boxes as (select 'F' || frame || 'CE' || label || '_' || row_min || '_' || row_max || '_' || col_min || '_' || col_max as dataset, * from nodes)"


@query(
    f"with {BOXES} select dataset, cast(r.range as int) as i0, cast(c.range as int) as i1, cast(trunc(coalesce(l.value, 0.0)) as double) as value, 40.0 - (row_min + r.range) * 2.5 as lat, (col_min + c.range) * 3.0 - 20.0 as lon "
    "from boxes b cross join range(16) r cross join range(24) c left join lab l on l.frame = b.frame and l.label = b.label and l.i0 = b.row_min + r.range and l.i1 = b.col_min + c.range where r.range <= row_max - row_min and c.range <= col_max - col_min"
)
def node_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NetCDF file for each feature, with its axes."""
    path = new_path(spark, "nodes")
    labelled = saved_hot(spark, sf_dir)
    sinks.write_nodes(labelled, tr.node_stats(labelled), *grid_axes(spark), path)
    tiles = grids.read_datasets(spark, path, partitions=16).withColumn("dataset", base_name())
    cells = to_cells(tiles.where("variable = 'CE brightness temperature'"), 2, ["dataset"])
    for variable, index in (("lat", "i0"), ("lon", "i1")):
        cells = cells.join(tiles.where(F.col("variable") == variable).select("dataset", F.posexplode("data").alias(index, variable)), ["dataset", index])
    return cells.select("dataset", "i0", "i1", "value", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"with {EDGES} select '((' || src_frame || ':' || src_label || '), (' || dst_frame || ':' || dst_label || '))' as value, src_frame, src_label, dst_frame, dst_label from edges")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as text, written and read again."""
    path = new_path(spark, "edges")
    tr.overlap_edges(hot(spark, sf_dir)).select(sinks.edge_text().alias("value")).write.text(path)
    found = climate.load_edge_list(spark, path)
    return found.select(sinks.edge_text().alias("value"), *found.columns)


@query(f"with {MEMBERS} select e.src_frame, e.src_label, e.dst_frame, e.dst_label, min(s.frame * 2147483648 + s.label) as subgraph from edges e join members s on s.subgraph = (select m.subgraph from members m where m.frame = e.src_frame and m.label = e.src_label) group by all")
def subgraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgraphs as lines of text, read again and named by their first node."""
    path = new_path(spark, "subgraphs")
    edges = save(tr.overlap_edges(hot(spark, sf_dir)), "edges")
    sinks.subgraph_lines(edges, tr.subgraphs(edges, 1)).write.text(path)
    found = climate.load_subgraphs(spark, path)
    first = found.groupBy("subgraph").agg(F.min(tr.node_number("src_frame", "src_label")).alias("first"))
    return found.join(first, "subgraph").select("src_frame", "src_label", "dst_frame", "dst_label", F.col("first").alias("subgraph"))


@query(f"with {NODES} select frame, label, area, row_min, row_max, col_min, col_max, min_temp, max_temp, round(avg_temp, 6) + 0.0 as avg_temp from nodes")
def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as JSON, one a line, written and read again."""
    path = new_path(spark, "node-records")
    nodes = tr.node_stats(hot(spark, sf_dir)).withColumn("avg_temp", six("avg_temp"))
    sinks.write_json(nodes, path)
    return spark.read.schema(nodes.schema).json(path)


@query(
    f"with {EDGES}, ends as (select src_frame as frame, src_label as label from edges union select dst_frame, dst_label from edges), e as (select *, row_number() over (order by src_frame, src_label, dst_frame, dst_label) - 1 as n from edges) "
    "select 'node' as kind, '(' || frame || ',' || label || ')' as id, 'd' || frame || ':' || label as label, null as target from ends union all "
    "select 'edge', cast(n as varchar), '(' || src_frame || ',' || src_label || ')', '(' || dst_frame || ',' || dst_label || ')' from e"
)
def viewer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The viewer's documents, taken apart again."""
    edges = save(tr.overlap_edges(hot(spark, sf_dir)), "edges")
    days = evt(spark, sf_dir).select("frame").distinct().withColumn("date", F.concat(F.lit("d"), F.col("frame").cast("string")))
    nodes, lines = sinks.viewer_nodes(edges, days), sinks.viewer_edges(edges)
    of_nodes = nodes.select(F.lit("node").alias("kind"), F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.label").alias("label"), F.lit(None).cast("string").alias("target"))
    return of_nodes.unionByName(lines.select(F.lit("edge").alias("kind"), F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.source").alias("label"), F.get_json_object("json", "$.target").alias("target")))


@query("select cast(vec_id as varchar) as id, '8,8' as shape, cast(512 as int) as n, 'v' || vec_id as variable from embeddings")
def notebook_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big-endian bytes of each array with its shape and name."""
    tiles = emb_tiles(spark, sf_dir).withColumns({"name": F.col("variable"), "variable": F.lit("v")})
    rows = sinks.array_rows(tiles, "v", "name")
    return rows.select(F.substring("id", 2, 20).alias("id"), F.concat_ws(",", F.col("shape").cast("array<string>")).alias("shape"), F.length("bytes").alias("n"), F.col("id").alias("variable"))


@query("select 'uri' || r_regionkey as dataset, v.name as variable, cast(p.range as int) as pos, cast(r_regionkey * 100 + p.range + case v.name when 'b' then 0.5 else 0 end as double) as value, cast(2 as bigint) as largest from region, (values ('a'), ('b')) v(name), range(6) p")
def custom_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loader and a partitioner of one's own: two URIs to a task."""
    import numpy as np

    uris = [f"uri{r.r_regionkey}" for r in read(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five regions

    def loader(uri: str, variable: str) -> tuple:
        return np.arange(6) + int(uri[3:]) * 100 + (0.5 if variable == "b" else 0.0), (2, 3)

    tiles = raster.read_custom(spark, uris, ["a", "b"], loader, lambda found: raster.grouped_uris(found, 3)).withColumn("part", F.spark_partition_id())
    tiles = save(tiles, "custom")
    most = tiles.groupBy("part").agg(F.countDistinct("dataset").alias("n")).agg(F.max("n").alias("largest"))
    return tiles.select("dataset", "variable", F.posexplode("data").alias("pos", "value")).join(F.broadcast(most))  # one row


@query(f"with {MEMBERS}, n as (select distinct subgraph, frame || ':' || label as node from members) select subgraph, string_agg(node, ' ' order by node) as nodes from n group by subgraph")
def ordered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = save(tr.overlap_edges(hot(spark, sf_dir)), "edges")
    return tr.ordered_nodes(edges, tr.subgraphs(edges, 1)).select("subgraph", F.concat_ws(" ", "nodes").alias("nodes"))
