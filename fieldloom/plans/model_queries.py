"""Queries for names, metadata, axes, dates, and the remaining operators on grids and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import dates
from fieldloom.functions.floats import close
from fieldloom.operators import elementwise as ew
from fieldloom.operators import shape as sh
from fieldloom.operators import stats as st
from fieldloom.operators import tracking as tr
from fieldloom.plans.file_queries import emb_tiles, grid_axes, named
from fieldloom.plans.queries import EDGES, EMB, EVT, FULL, GRID, LI, NODES, emb, emb_cells, evt, full, hot, li_months, query, read, saved_hot, six, total_of
from fieldloom.sources import metadata, raster

# cells -----------------------------------------------------------------------------------------


def cell_arithmetic(op: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = emb_cells(spark, sf_dir).drop("label")
        return ew.cells_op(cells, cells.withColumn("vec_id", F.col("vec_id") - 1), op, ["vec_id", "i0", "i1"]).select("vec_id", "i0", "i1", six())

    run.__name__ = {"+": "add", "-": "sub", "*": "mul", "/": "div"}[op] + "_cells"
    query(f"with {EMB} select a.vec_id, cast(a.pos // 8 as int) as i0, cast(a.pos % 8 as int) as i1, round(a.value {op} b.value, 6) + 0.0 as value from emb a join emb b on b.vec_id = a.vec_id + 1 and b.pos = a.pos")(run)


for _op in "+-*/":
    cell_arithmetic(_op)


@query(f"with {EVT} select frame, i0, i1, case when i0 = 0 then case when value > 0 then 'Infinity' when value < 0 then '-Infinity' else 'NaN' end else cast(round(value / i0, 3) as varchar) end as value from evt where i0 = 0 union all select frame, i0, i1, 'finite' from evt where i0 > 0")
def divide_by_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division by zero gives infinities and NaN, not an error."""
    cells = evt(spark, sf_dir)
    by = cells.withColumn("value", F.col("i0").cast("double"))
    found = ew.cells_op(cells, by, "/", ["frame", "i0", "i1"])
    text = F.when(F.isnan("value") | (F.abs("value") == float("inf")), F.col("value").cast("string")).otherwise("finite")
    return found.select("frame", "i0", "i1", text.alias("value"))


@query("select vec_id, cast(k.range as int) as pos, 0.0 as value from embeddings, range(12) k")
def zeros_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb(spark, sf_dir).select("vec_id", F.posexplode(ew.zeros(12)).alias("pos", "value"))


@query(f"with {EMB} select vec_id, cast(4 as int) as n, true as same, abs(a.value - b.value) <= 1e-3 as near from emb a join emb b using (vec_id) where a.pos = 0 and b.pos = 1")
def near_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symmetric tolerance: a value is near itself, and two are near if they differ by little."""
    x, y = F.get("data", F.lit(0)), F.get("data", F.lit(1))
    return emb(spark, sf_dir).select("vec_id", F.lit(4).alias("n"), close(x, x).alias("same"), close(x, y, 0.0, 1e-3).alias("near"))


@query(f"with {EVT} select frame, sum(value) <= 1e-9 as is_zero from evt group by frame")
def is_zero_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.is_zero(evt(spark, sf_dir), ["frame"], shortcut=True)


@query(f"with {LI} select frame, i0, i1, round(value - sum(value) over (partition by frame % 12, i0, i1) / 7, 6) + 0.0 as value from li")
def anomaly_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum is divided by a number of years, not by the group's size."""
    return st.anomaly(li_months(spark, sf_dir), ["month"], ["i0", "i1"], divisor=7).select("frame", "i0", "i1", six())


@query(f"with {FULL} select frame, i0, round(avg(value), 6) + 0.0 as value from full_ group by all")
def day_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.day_mean(full(spark, sf_dir), ["i0"], "frame").select("frame", "i0", six())


@query(f"with {FULL}, v as (select *, count(*) filter (value <> 0) over w as n, sum(case when value <> 0 then value else 0 end) over w as s from full_ window w as (partition by frame, i0 // 4, i1 // 4)) select frame, cast(i0 // 4 as int) as i0, cast(i1 // 4 as int) as i1, round(any_value(case when n > 0 then s / n else 0 end), 6) + 0.0 as value from v group by frame, i0 // 4, i1 // 4")
def block_mean_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.block_mean(full(spark, sf_dir), GRID, (4, 4), ["frame"], invalid=0.0, strict=True).select("frame", "i0", "i1", six())


# axes ------------------------------------------------------------------------------------------


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense grid with descending latitudes, longitudes from 5 on, and days as times."""
    time = F.to_timestamp(F.col("frame").cast("string"), "yyyyMMdd").cast("timestamp_ntz")
    return full(spark, sf_dir).select(time.alias("time"), (40.0 - F.col("i0") * 2.5).alias("lat"), (F.col("i1") * 15.0 + 5.0).alias("lon"), "i0", "i1", "value")


LOCATED = f"{FULL}, loc as (select strptime(cast(frame as varchar), '%Y%m%d') as time, 40.0 - i0 * 2.5 as lat, i1 * 15.0 + 5.0 as lon, i0, i1, value from full_)"


@query(f"with {LOCATED} select time, cast(lat as double) as lat, cast(case when lon >= 180 then lon - 360 else lon end as double) as lon, cast(15 - i0 as int) as i0, cast(case when lon >= 180 then i1 - 12 else i1 + 12 end as int) as i1, value from loc")
def normalized_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.normalize_axes(located(spark, sf_dir)).select("time", "lat", "lon", "i0", "i1", "value")


@query("select s_suppkey, cast((s_suppkey * 7) % 150 + 200 - 360 as double) as lon from supplier")
def longitudes_above_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All above 180: all are shifted."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7) % 150 + 200).cast("double").alias("lon"))
    return sh.normalize_longitudes(rows)


@query("select 2.5 as lat_step, 15.0 as lon_step, 'daily' as time_class")
def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.resolutions(located(spark, sf_dir))


@query("select event_id, case when event_id % 500 = 0 and event_id % 7 < 3 then 'minutely' when event_id % 500 = 0 then 'hourly' when event_id % 500 = 1 then 'daily' when event_id % 500 <= 31 then 'monthly' else 'yearly' end as name from events")
def time_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, seconds = F.col("event_id") % 500, F.when(F.col("event_id") % 7 < 3, 60).otherwise(3600)
    return read(spark, sf_dir, "events").select("event_id", st.time_class(days, seconds).alias("name"))


@query(f"with {FULL} select frame as time, i0 as lat, i1 as lon, value from full_")
def checked_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that pass the check of their shape."""
    cells = full(spark, sf_dir).withColumnsRenamed({"frame": "time", "i0": "lat", "i1": "lon"})
    axes = [cells.select(F.col("time").alias("value")).distinct(), spark.range(GRID[0]).select(F.col("id").alias("value")), spark.range(GRID[1]).select(F.col("id").alias("value"))]
    return st.checked_shape(cells, *axes)


@query(f"with {LOCATED} select time, cast(lat as double) as lat, cast(lon as double) as lon, value from loc where lat between 10 and 30 and lon between 20 and 100")
def bounded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = located(spark, sf_dir)
    return st.Bounds(10, 30, 20, 100).within(cells.where("lon <= 180")).select("time", "lat", "lon", "value")


@query("select cast(range as int) as i, 40.0 - range * 2.5 as lat, cast(null as double) as lon from range(16) union all select cast(range as int), null, range * 3.0 - 20.0 from range(24)")
def sampled_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of one of many datasets that share them."""
    days = evt(spark, sf_dir).select(F.col("frame").cast("string").alias("dataset")).distinct()

    def axis(name: str, rows: DataFrame) -> DataFrame:
        one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", name))), lambda s: s[name]).alias("data"))
        return days.withColumn("variable", F.lit(name)).join(F.broadcast(one))  # one row

    lat, lon = grid_axes(spark)
    rows = axis("lat", lat).unionByName(axis("lon", lon))
    lats, lons = metadata.sample_axes(rows, "lat", "lon")
    return lats.withColumn("lon", F.lit(None).cast("double")).unionByName(lons.withColumn("lat", F.lit(None).cast("double")))


# variables, names ------------------------------------------------------------------------------


@query(f"with {EMB} select label, 'v' || vec_id as variable, pos, round(value * case when vec_id % 2 = 0 then 2.0 else 1.0 end, 6) + 0.0 as value from emb union all select label, 'w' || vec_id, pos, round(value * 2.0, 6) + 0.0 from emb where vec_id % 2 = 1")
def inserted_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubled variables in place of those of the same name, and beside them under a new one."""
    tiles = emb_tiles(spark, sf_dir)
    even = F.substring("variable", 2, 20).cast("long") % 2 == 0
    twice = tiles.withColumn("data", ew.Steps().scalar("*", 2.0).on_array("data"))
    new = twice.withColumn("variable", F.when(even, F.col("variable")).otherwise(F.concat(F.lit("w"), F.substring("variable", 2, 20))))
    rows = metadata.insert_variables(tiles, new)
    return rows.select(F.substring("dataset", 6, 9).cast("int").alias("label"), "variable", F.posexplode("data").alias("pos", "value")).select("label", "variable", "pos", six())


@query("select 'grid_' || label as dataset, 'v' || vec_id as variable, cast(64 as int) as n from embeddings where vec_id = (select min(vec_id) from embeddings)")
def one_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "embeddings").agg(F.min("vec_id")).first()[0]
    return metadata.variable(emb_tiles(spark, sf_dir), f"v{first}").select("dataset", "variable", F.size("data").alias("n"))


@query("select vec_id, 'float v' || vec_id || '(rows, cols)' || chr(10) || chr(9) || 'units: K' || chr(10) || 'current shape = (8, 8)' || chr(10) as rendering from embeddings")
def variable_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_tiles(spark, sf_dir).select(F.substring("variable", 2, 20).cast("long").alias("vec_id"), metadata.rendering().alias("rendering"))


@query(
    "select 'grid_' || label as dataset, 'grid_' || label || chr(10) || 'root group ...' || chr(10) || chr(9) || 'title: t' || chr(10) || chr(9) || 'dimensions(sizes): (rows(8), cols(8))' || chr(10) || chr(9) || 'variables: (' || "
    "string_agg('float v' || vec_id || '(rows, cols)', ', ' order by 'v' || vec_id) || ')' || chr(10) as rendering from embeddings group by label"
)
def dataset_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.dataset_renderings(emb_tiles(spark, sf_dir), {"title": "t"})


@query(
    "select p_partkey, n.op, case n.op when '+' then '(' || p_name || ' + ' || p_brand || ')' when '-' then '(' || p_name || ' - ' || p_brand || ')' when '*' then '(' || p_name || ' * 5.0)' when '/' then '(' || p_name || ' / 5.0)' when '**' then '(' || p_name || ' ** ' || p_brand || ')' "
    "when '<' then '(' || p_name || ' < 241.0)' when '>' then '(' || p_name || ' > 241.0)' when '<=' then '(' || p_name || ' <= 241.0)' when '>=' then '(' || p_name || ' >= 241.0)' when ':=' then '(' || p_name || ' := 241.0)' when '!=' then '(' || p_name || ' != 241.0)' "
    "when '+=' then '(' || p_name || ' += ' || p_brand || ')' when '-=' then '(' || p_name || ' -= 5.0)' when '*=' then '(' || p_name || ' *= 5.0)' when '/=' then '(' || p_name || ' /= ' || p_brand || ')' "
    "when 'maskf' then 'maskf(' || p_name || ',100.0)' when 'mean' then 'mean(' || p_name || ',List(0, 1))' when 'std' then 'std(' || p_name || ',List(0))' when 'skew' then 'skew(' || p_name || ',List(0))' when 'detrend' then 'detrend(' || p_name || ',List(0))' "
    "when 'broadcast' then 'broadcast(' || p_name || ',List(3, 4, 4))' when 'block' then 'reduceResolution(' || p_name || ',(2,2))' when 'rect' then 'reduceResolution(' || p_name || ',(3,2))' when 'slice' then p_name || '[2:3,1:4]' end as name "
    "from part, (select unnest(['+', '-', '*', '/', '**', '<', '>', '<=', '>=', ':=', '!=', '+=', '-=', '*=', '/=', 'maskf', 'mean', 'std', 'skew', 'detrend', 'broadcast', 'block', 'rect', 'slice']) as op) n"
)
def lineage_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form that a derived variable's name can take."""
    name, brand = F.col("p_name"), F.col("p_brand")
    with_names, with_numbers = ("+", "-", "**", "+=", "/="), ("*", "/", "-=", "*=")
    forms = {op: ew.binary_name(name, op, brand) for op in with_names} | {op: ew.binary_name(name, op, 5.0) for op in with_numbers} | {op: ew.binary_name(name, op, 241.0) for op in ("<", ">", "<=", ">=", ":=", "!=")}
    forms |= {"maskf": ew.mask_name(name, 100.0), "mean": ew.axis_call_name("mean", name, (0, 1)), "broadcast": ew.axis_call_name("broadcast", name, (3, 4, 4)), "block": ew.block_name(name, 2), "rect": ew.block_name(name, 3, 2), "slice": ew.slice_name(name, [(2, 3), (1, 4)])}
    forms |= {op: ew.axis_call_name(op, name, (0,)) for op in ("std", "skew", "detrend")}
    pairs = F.array(*[F.struct(F.lit(op).alias("op"), n.alias("name")) for op, n in forms.items()])
    return read(spark, sf_dir, "part").select("p_partkey", F.inline(pairs))


@query(f"with {EMB} select '(v' || vec_id || ' * 2.0)' as variable, 'grid_' || label as dataset, pos, round(value * 2.0, 6) + 0.0 as value from emb")
def named_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation with its result's name."""
    tiles = ew.named_op(ew.scalar_op(emb_tiles(spark, sf_dir), "*", 2.0), "*", 2.0)
    return tiles.select("variable", "dataset", F.posexplode("data").alias("pos", "value")).select("variable", "dataset", "pos", six())


@query("select event_id, cast(strftime(ts, '%Y%m%d%H') as bigint) as frame, strftime(ts, '%Y%m%d') || '00' as accumulated from events")
def frames_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame numbers from file names."""
    stamp = F.date_format("ts", "yyyyMMddHH")
    merged, dotted = F.concat(F.lit("merg_"), stamp, F.lit("_4km-pixel.nc")), F.concat(F.lit("3B42."), F.date_format("ts", "yyyyMMdd"), F.lit(".00.7.HDF"))
    return read(spark, sf_dir, "events").select("event_id", dates.frame_of_name(merged).alias("frame"), dates.accumulation_frame(dotted).alias("accumulated"))


# dates and links -------------------------------------------------------------------------------


@query("select event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') as time from events")
def strike_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", dates.strike_time(F.date_format("ts", "yyyy/MM/dd"), F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(".313426"))).alias("time"))


@query(
    "select 'http://h/' || lpad(cast(year(ts - interval 3 hours) as varchar), 4, '0') || '/' || lpad(cast(dayofyear(ts - interval 3 hours) as varchar), 3, '0') || '/3B42.' || strftime(ts, '%Y%m%d.%H') || '.7' || case when year(ts) < 2011 then 'A' else '' end || '.HDF?p[0:1:1439][0:1:399]' as link "
    "from generate_series(timestamp '2010-12-30 03:00:00', timestamp '2011-01-03 00:00:00', interval 3 hours) g(ts)"
)
def reading_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = dates.reading_links(dates.three_hourly(spark, "2010-12-30 03:00:00", "2011-01-03 00:00:00"), "http://h/")
    return links.select(F.concat("link", F.lit("?" + dates.dap_constraint("p", (0, 1439), (0, 399)))).alias("link"))


@query(
    "select 'http://h/' || case when dayofyear(d) = 1 then year(d) - 1 else year(d) end || '/' || lpad(cast(dayofyear(d - interval 1 day) as varchar), 3, '0') || '/3B42_daily.' || strftime(d, '%Y.%m.%d') || '.7.bin' as link "
    "from generate_series(timestamp '2007-12-30', timestamp '2008-03-02', interval 1 day) g(d)"
)
def daily_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.daily_links(spark, "2007-12-30", "2008-03-02", "http://h")


@query("select cast(timestamp '2008-02-27' + to_days(cast(range as int)) as date) as day from range(400)")
def sequential_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.dates_between(spark, "2008-02-27", 400)


@query("select event_id, case event_id % 8 when 7 then null when 2 then date_trunc('minute', ts) when 4 then date_trunc('hour', ts) when 5 then date_trunc('day', ts) when 6 then date_trunc('day', ts) else date_trunc('second', ts) end as ts from events")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in several formats, and what isn't one."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyyMMdd HH:mm:ss", "yyyy-MM-dd HH", "yyyy:MM:dd", "yyyyMMdd"]
    text = F.lit("no date")
    for k, form in enumerate(forms):
        text = F.when(F.col("event_id") % 8 == k, F.date_format("ts", form)).otherwise(text)
    return read(spark, sf_dir, "events").select("event_id", dates.parse_any(text).cast("timestamp_ntz").alias("ts"))


@query("select event_id, timestamp '2000-01-31 06:00:00' + to_seconds(event_id) as s, timestamp '2000-01-31 06:00:00' + to_minutes(event_id) as m, timestamp '2000-01-31 06:00:00' + to_days(cast(event_id as int)) as d, cast(timestamp '2000-01-31 06:00:00' + to_years(cast(event_id % 300 as int)) as timestamp) as y from events")
def decode_cf_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    def at(unit: str, value=F.col("event_id")):
        return dates.decode_time(value, F.lit(f"{unit} since 2000-01-31 06:00:00")).cast("timestamp_ntz")

    return read(spark, sf_dir, "events").select("event_id", at("seconds").alias("s"), at("minutes").alias("m"), at("days").alias("d"), at("years", F.col("event_id") % 300).alias("y"))


@query("select page_id, cast(row_number() over (order by url, page_id) - 1 as bigint) // 7 as grp from pages")
def grouped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven URIs to a partition, in order."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.struct("url", "page_id").alias("uri"))
    return raster.uri_groups(pages, 7).select("page_id", F.col("group").alias("grp"))


@query("select year(o_orderdate) || '' as grp, count(*) as n from orders group by all")
def url_group_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("http://h/3B42."), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".00.HDF"))
    return read(spark, sf_dir, "orders").groupBy(dates.url_group(url, 4, "3B42\\.").alias("grp")).agg(F.count("*").alias("n"))


# features --------------------------------------------------------------------------------------


@query(f"with {NODES} select frame || ':' || label as id, 40.0 - row_min * 2.5 as lat_min, 40.0 - row_max * 2.5 as lat_max, col_min * 3.0 - 20.0 as lon_min, col_max * 3.0 - 20.0 as lon_max, 40.0 - (row_min + row_max) * 1.25 as center_lat, (col_min + col_max) * 1.5 - 20.0 as center_lon from nodes")
def node_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tr.with_axes(tr.node_stats(hot(spark, sf_dir)), *grid_axes(spark))
    names = ("lat_min", "lat_max", "lon_min", "lon_max", "center_lat", "center_lon")
    return nodes.select(tr.node_key("frame", "label").alias("id"), *[six(n) for n in names])


@query(f"with {EDGES} select frame, label from (select src_frame as frame, src_label as label from edges union select dst_frame, dst_label from edges)")
def overlapping_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = saved_hot(spark, sf_dir)
    return tr.overlapping(tr.overlap_edges(labelled), tr.node_stats(labelled)).select("frame", "label")


STRUCK = "strikes as (select strftime(ts, '%Y/%m/%d 00:00:00') as time, cast(40.0 - (user_id % 16) * 2.5 - 0.5 as double) as lat, cast(hour(ts) * 3.0 - 19.0 as double) as lon, cast(strftime(ts, '%Y%m%d') as bigint) as day from events)"


@query(
    f"with {NODES}, {STRUCK}, hits as (select n.frame, n.label, count(s.day) as n, round(coalesce(sum(s.lat), -999.0), 6) + 0.0 as lats, round(coalesce(sum(s.lon), -999.0), 6) + 0.0 as lons from nodes n left join strikes s on s.day = n.frame and s.lat < 40.0 - n.row_min * 2.5 and s.lat > 40.0 - n.row_max * 2.5 and s.lon > n.col_min * 3.0 - 20.0 and s.lon < n.col_max * 3.0 - 20.0 group by all) "
    "select frame * 100 as frame, label, greatest(n, 1) as places, lats, lons from hits"
)
def strikes_on_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strikes of each feature's hour within its box; one mark where there are none."""
    nodes = tr.with_axes(tr.node_stats(hot(spark, sf_dir)).withColumn("frame", F.col("frame") * 100), *grid_axes(spark))
    rows = read(spark, sf_dir, "events")
    strikes = rows.select(F.date_format("ts", "yyyy/MM/dd 00:00:00").alias("time"), (39.5 - (F.col("user_id") % 16) * 2.5).alias("lat"), (F.hour("ts") * 3.0 - 19.0).alias("lon"))
    found = tr.strikes_on_nodes(nodes, strikes)
    found = found.select("frame", "label", F.size("lightning").cast("long").alias("places"), total_of("lightning", "lat").alias("lats"), total_of("lightning", "lon").alias("lons"))
    return found.select("frame", "label", "places", six("lats"), six("lons"))


@query("select r_regionkey as dataset, 'rows' as name, cast(8 as int) as len from region union all select r_regionkey, 'cols', 8 from region")
def dimensions_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and renamed variables keep their dimensions, which are listed once."""
    rows = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("dataset"), F.lit("a").alias("variable"), named(("rows", 8), ("cols", 8)).alias("dims"))
    return metadata.global_dimensions(rows.unionByName(rows.withColumn("variable", F.lit("b"))))
