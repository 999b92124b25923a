"""Queries over the driver's tables, one or more for each operator, and the same in SQL.

Grids: ``events`` by day, user and hour (largest value); ``embeddings`` as 8 x 8 tiles; ``lineitem``
by month, supplier and line (mean quantity). Tables are read whole; only the yearly climatology and
the reshape to years leave out years without all twelve months, which they can't have. Numbers are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import dates
from fieldloom.operators import elementwise as ew
from fieldloom.operators import shape as sh
from fieldloom.operators import stats as st
from fieldloom.operators import tracking as tr
from fieldloom.plans.model import densify, to_cells, to_tiles
from fieldloom.plans.tables import save
from fieldloom.sources import metadata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GRID = (16, 24)
HOT = 60.0

EVT = "evt as (select cast(strftime(ts, '%Y%m%d') as bigint) as frame, cast(user_id % 16 as int) as i0, cast(hour(ts) as int) as i1, max(value) as value from events group by all)"
EMB = "emb as (select vec_id, label, cast(p - 1 as int) as pos, cast(embedding[p] as double) as value from (select *, unnest(range(1, 65)) as p from embeddings))"
LI = (
    "li as (select cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as int) as frame, cast(l_suppkey % 10 as int) as i0, cast(l_linenumber as int) as i1, avg(l_quantity) as value "
    "from lineitem group by all)"
)
WHOLE = f"{LI}, whole as (select * from li where frame // 12 in (select frame // 12 from li group by 1 having count(distinct frame % 12) = 12))"
FULL = f"{EVT}, full_ as (select f.frame, cast(r.range as int) as i0, cast(c.range as int) as i1, coalesce(evt.value, 0.0) as value from (select distinct frame from evt) f cross join range(16) r cross join range(24) c left join evt on evt.frame = f.frame and evt.i0 = r.range and evt.i1 = c.range)"
LABELLED = f"""recursive {EVT}, hot as (select * from evt where value >= {HOT}),
reach(frame, i0, i1, k) as (select frame, i0, i1, i0 * 24 + i1 from hot union
  select n.frame, n.i0, n.i1, reach.k from reach join hot n on n.frame = reach.frame and abs(n.i0 - reach.i0) + abs(n.i1 - reach.i1) = 1),
lab as (select frame, i0, i1, cast(dense_rank() over (partition by frame order by k) as int) as label, value from (select frame, i0, i1, min(k) as k from reach group by all) join hot using (frame, i0, i1))"""
NEXT = "nxt as (select frame as src_frame, lead(frame) over (order by frame) as dst_frame from (select distinct frame from lab))"
EDGES = f"{LABELLED}, {NEXT}, edges as (select s.frame as src_frame, s.label as src_label, d.frame as dst_frame, d.label as dst_label, count(*) as area_overlap from lab s join nxt on nxt.src_frame = s.frame join lab d on d.frame = nxt.dst_frame and d.i0 = s.i0 and d.i1 = s.i1 group by all)"
NODES = f"{EDGES}, nodes as (select frame, label, count(*) as area, min(i0) as row_min, max(i0) as row_max, min(i1) as col_min, max(i1) as col_max, min(value) as min_temp, greatest(0.0, max(value)) as max_temp, avg(value) as avg_temp from lab group by frame, label)"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.date_format("ts", "yyyyMMdd").cast("bigint")
    rows = read(spark, sf_dir, "events").select(frame.alias("frame"), (F.col("user_id") % 16).cast("int").alias("i0"), F.hour("ts").alias("i1"), "value")
    return rows.groupBy("frame", "i0", "i1").agg(F.max("value").alias("value"))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(evt(spark, sf_dir), GRID, ["frame"])


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", F.array(F.lit(8), F.lit(8)).alias("shape"), F.array(F.lit(0), F.lit(0)).alias("origin"), F.col("embedding").cast("array<double>").alias("data"))


def emb_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(emb(spark, sf_dir), 2, ["vec_id", "label"])


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    frame = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    return rows.groupBy(frame.alias("frame"), (F.col("l_suppkey") % 10).cast("int").alias("i0"), F.col("l_linenumber").cast("int").alias("i1")).agg(F.avg("l_quantity").alias("value"))


def li_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li(spark, sf_dir).withColumns({"year": F.floor(F.col("frame") / 12).cast("int"), "month": F.pmod("frame", F.lit(12)).cast("int")})


def hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.label_frames(ew.drop_cells(evt(spark, sf_dir), ">=", HOT), GRID[1])


def saved_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once for queries that read it several times."""
    return save(hot(spark, sf_dir), "labelled")


def six(name: str = "value") -> Column:
    """Rounded; a negative zero becomes zero."""
    return (F.round(name, 6) + F.lit(0.0)).alias(name)


def total_of(places: str, field: str) -> Column:
    """Sum of a field of an array of structs."""
    return F.aggregate(F.transform(places, lambda x: x[field]), F.lit(0.0), lambda a, x: a + x)


def tiles_out(tiles: DataFrame) -> DataFrame:
    return tiles.select("vec_id", F.posexplode("data").alias("pos", "value")).select("vec_id", "pos", six())


# masks -----------------------------------------------------------------------------------------


def mask_query(name: str, op: str, sql_op: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ew.mask_cells(evt(spark, sf_dir), op, HOT).select("frame", "i0", "i1", six())

    run.__name__ = name
    query(f"with {EVT} select frame, i0, i1, round(case when value {sql_op} {HOT} then value else 0.0 end, 6) + 0.0 as value from evt")(run)


for _name, _op, _sql in (("mask_lt", "<", "<"), ("mask_gt", ">", ">"), ("mask_le", "<=", "<="), ("mask_ge", ">=", ">="), ("mask_eq", "==", "="), ("mask_ne", "!=", "<>")):
    mask_query(_name, _op, _sql)


@query(f"with {EMB} select vec_id, pos, round(case when value < -0.1 or value > 0.1 then value else 100.0 end, 6) + 0.0 as value from emb")
def mask_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = emb(spark, sf_dir)
    return tiles_out(tiles.withColumn("data", ew.Steps().with_mask(100.0).mask(lambda x: (x < -0.1) | (x > 0.1)).on_array("data")))


# arithmetic ------------------------------------------------------------------------------------


def arithmetic_queries(name: str, op: str) -> None:
    def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
        tiles = emb(spark, sf_dir)
        return tiles_out(ew.array_op(tiles, tiles.withColumn("vec_id", F.col("vec_id") - 1), op, ["vec_id"]))

    def scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
        tiles = emb(spark, sf_dir)
        return tiles_out(tiles.withColumn("data", ew.Steps().scalar(op, 2.5).on_array("data")))

    arrays.__name__, scalar.__name__ = f"{name}_arrays", f"{name}_scalar"
    query(f"with {EMB} select a.vec_id, a.pos, round(a.value {op} b.value, 6) + 0.0 as value from emb a join emb b on b.vec_id = a.vec_id + 1 and b.pos = a.pos")(arrays)
    query(f"with {EMB} select vec_id, pos, round(value {op} 2.5, 6) + 0.0 as value from emb")(scalar)


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    arithmetic_queries(_name, _op)


@query(f"with {EMB} select vec_id, pos, round((value * 2.0 + 1.0) / 3.0, 6) + 0.0 as value from emb")
def fused_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ew.Steps().scalar("*", 2.0).scalar("+", 1.0).scalar("/", 3.0)
    return tiles_out(emb(spark, sf_dir).withColumn("data", steps.on_array("data")))


@query(f"with {EMB} select vec_id, pos, round(value * value, 6) + 0.0 as value from emb")
def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_out(ew.map_elements(emb(spark, sf_dir), lambda x: x * x))


@query(
    f"with {EMB}, c as (select vec_id, pos // 8 as i0, pos % 8 as i1, value from emb) select l.vec_id, cast(l.i0 as int) as i0, cast(r.i1 as int) as i1, round(sum(l.value * r.value), 6) + 0.0 as value "
    "from c l join c r on r.vec_id = l.vec_id and r.i0 = l.i1 group by all"
)
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = emb_cells(spark, sf_dir).drop("label")
    return ew.matmul(cells, cells, ["vec_id"]).select("vec_id", "i0", "i1", six())


@query(f"with {EMB} select vec_id, cast(pos // 8 as int) as i0, cast(pos % 8 as int) as i1, round(case when pos // 8 = 0 then 3.0 else value end, 6) + 0.0 as value from emb")
def assign_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = emb_cells(spark, sf_dir).drop("label")
    return ew.assign(cells, cells.where("i0 = 0").withColumn("value", F.lit(3.0)), ["vec_id", "i0", "i1"]).select("vec_id", "i0", "i1", six())


@query(f"with {EMB} select vec_id, cast(pos // 8 as int) as i0, cast(pos % 8 as int) as i1, round(case when pos = 19 then -1.0 else value end, 6) + 0.0 as value from emb")
def put_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ew.put(emb_cells(spark, sf_dir), -1.0, i0=2, i1=3).select("vec_id", "i0", "i1", six())


# shape -----------------------------------------------------------------------------------------


@query(f"with {EMB} select vec_id, cast(pos // 8 - 2 as int) as i0, cast(pos % 8 - 1 as int) as i1, round(value, 6) + 0.0 as value from emb where pos // 8 >= 2 and pos // 8 < 5 and pos % 8 >= 1 and pos % 8 < 4")
def slice_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.slice_cells(emb_cells(spark, sf_dir), (2, 5), (1, 4)).select("vec_id", "i0", "i1", six())


@query(f"with {EMB} select vec_id, cast((pos // 8 - 2) * 3 + pos % 8 - 1 as int) as pos, round(value, 6) + 0.0 as value from emb where pos // 8 >= 2 and pos // 8 < 5 and pos % 8 >= 1 and pos % 8 < 4")
def slice_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_out(sh.slice_tiles(emb(spark, sf_dir), (8, 8), (2, 5), (1, 4)))


@query(f"with {EMB} select vec_id, cast(pos % 8 as int) as i0, round(value, 6) + 0.0 as value from emb where pos // 8 = 3")
def slice_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.take_index(emb_cells(spark, sf_dir), 3, 2).select("vec_id", "i0", six())


@query("select vec_id, round(cast(embedding[8 * 2 + 3 + 1] as double), 6) + 0.0 as value from embeddings")
def element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb(spark, sf_dir).select("vec_id", sh.element("data", (8, 8), 2, 3).alias("value")).select("vec_id", six())


@query(f"with {EMB} select vec_id, cast(pos // 4 as int) as i0, cast(pos % 4 as int) as i1, round(value, 6) + 0.0 as value from emb")
def reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.reshape(emb_cells(spark, sf_dir), (8, 8), (16, 4)).select("vec_id", "i0", "i1", six())


@query(f"with {EMB} select vec_id, cast(k.range as int) as i0, cast(pos // 8 as int) as i1, cast(pos % 8 as int) as i2, round(value, 6) + 0.0 as value from emb, range(3) k")
def broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.broadcast_cells(emb_cells(spark, sf_dir), 3, 2).select("vec_id", "i0", "i1", "i2", six())


@query(f"with {EVT} select frame, cast(i0 // 4 as int) as t0, cast(i1 // 7 as int) as t1, cast(i0 % 4 as int) as i0, cast(i1 % 7 as int) as i1, value from evt where i1 < 21")
def split_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.split_tiles(evt(spark, sf_dir), GRID, (4, 7)).select("frame", "t0", "t1", "i0", "i1", "value")


@query(f"with {EVT} select cast(dense_rank() over (order by frame) - 1 as int) as i0, cast(i0 // 4 as int) as t0, cast(i1 // 6 as int) as t1, cast(i0 % 4 as int) as i1, cast(i1 % 6 as int) as i2, value from evt")
def stack_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.stack_cells(sh.split_tiles(evt(spark, sf_dir), GRID, (4, 6))).select("i0", "t0", "t1", "i1", "i2", "value")


@query(f"with {EVT} select cast(i0 // 4 as int) as t0, cast(i1 // 6 as int) as t1, frame, cast(i0 % 4 as int) as i0, cast(i1 % 6 as int) as i1, value, cast(1 as bigint) as partitions, true as in_order from evt")
def repartition_by_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of partitions that hold the cell's tile, and whether the cell comes after those before it."""
    tiled = save(sh.by_space(evt(spark, sf_dir), GRID, (4, 6)).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "by-space")
    parts = tiled.groupBy("t0", "t1").agg(F.countDistinct("part").alias("partitions"))
    before = F.lag("place").over(Window.partitionBy("t0", "t1").orderBy("frame", "i0", "i1"))
    rows = tiled.withColumn("in_order", F.coalesce(before < F.col("place"), F.lit(True))).join(parts, ["t0", "t1"])
    return rows.select("t0", "t1", "frame", "i0", "i1", "value", "partitions", "in_order")


@query(f"with {EMB}, r as (select *, dense_rank() over (partition by label order by vec_id) - 1 as k, (select count(*) from embeddings e where e.label = emb.label) as n from emb) select label, cast(n as int) as n, cast(k * 64 + pos as int) as at, round(value, 6) + 0.0 as value from r")
def stack_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = sh.stack_tiles(emb(spark, sf_dir), ["label"], "vec_id")
    return stacked.select("label", F.get("shape", F.lit(0)).alias("n"), F.posexplode("data").alias("at", "value")).select("label", "n", "at", six())


@query(f"with {WHOLE} select cast(frame // 12 as int) as year, cast(frame % 12 as int) as month, i0 as i1, i1 as i2, round(value, 6) + 0.0 as value from whole")
def monthly_to_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = st.whole_years(li_months(spark, sf_dir)).drop("year", "month").withColumnsRenamed({"i1": "i2", "i0": "i1", "frame": "i0"})
    return sh.monthly_to_annual(months).select("year", "month", "i1", "i2", six())


@query("select s_suppkey, cast(case when (s_suppkey * 7) % 360 >= 180 then (s_suppkey * 7) % 360 - 360 else (s_suppkey * 7) % 360 end as double) as lon from supplier")
def normalize_longitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7) % 360).cast("double").alias("lon"))
    return sh.normalize_longitudes(rows)


@query(f"with {FULL} select frame, cast(i0 * 24 + i1 as int) as pos, value from full_")
def cells_to_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_tiles(evt(spark, sf_dir), GRID, ["frame"]).select("frame", F.posexplode("data").alias("pos", "value"))


# statistics ------------------------------------------------------------------------------------

SKEW = "avg(power((value - m) / nullif(s, 0), 3))"


@query(
    f"with {EMB}, m as (select *, avg(value) over (partition by label, pos) as m, stddev_samp(value) over (partition by label, pos) as s from emb) "
    f"select label, cast(pos // 8 as int) as i0, cast(pos % 8 as int) as i1, round(sum(value), 6) + 0.0 as total, round(avg(value), 6) + 0.0 as mean, round(any_value(s), 6) + 0.0 as std, round({SKEW}, 6) + 0.0 as skew, "
    "round(min(value), 6) + 0.0 as least, round(max(value), 6) + 0.0 as greatest from m group by all"
)
def axis_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("total", "mean", "std", "skew", "least", "greatest")
    return st.axis_stats(emb_cells(spark, sf_dir), ["label", "i0", "i1"]).select("label", "i0", "i1", *[six(n) for n in names])


@query(f"with {FULL} select frame, cast(i0 // 4 as int) as i0, cast(i1 // 4 as int) as i1, round(avg(case when value >= 60.0 then value else 0.0 end), 6) + 0.0 as value from full_ group by all")
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = ew.mask_cells(full(spark, sf_dir), ">=", HOT)
    return st.block_mean(masked, GRID, (4, 4), ["frame"]).select("frame", "i0", "i1", six())


@query(
    f"with {FULL} select frame, cast(i0 // 5 as int) as i0, cast(i1 // 7 as int) as i1, round(case when count(*) filter (value <> 0) > 0 then sum(value) / count(*) filter (value <> 0) else 0 end, 6) + 0.0 as value "
    "from full_ where i0 < 15 and i1 < 21 group by all"
)
def block_mean_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.block_mean(full(spark, sf_dir), GRID, (5, 7), ["frame"], invalid=0.0).select("frame", "i0", "i1", six())


@query(
    f"with {LI}, t as (select *, cast(row_number() over (partition by i0, i1 order by frame) as double) as t from li), "
    "f as (select i0, i1, regr_slope(value, t) as b, regr_intercept(value, t) as a from t group by all having count(*) > 1) "
    "select frame, i0, i1, round(value - (a + b * t), 6) + 0.0 as value from t join f using (i0, i1) union all select frame, i0, i1, 0.0 from li where (i0, i1) in (select (i0, i1) from li group by i0, i1 having count(*) = 1)"
)
def detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.detrend(li(spark, sf_dir), ["i0", "i1"], "frame").select("frame", "i0", "i1", six())


@query(f"with {LI} select frame, i0, i1, round(value - avg(value) over (partition by frame % 12, i0, i1), 6) + 0.0 as value from li")
def anomaly_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.anomaly(li_months(spark, sf_dir), ["month"], ["i0", "i1"]).select("frame", "i0", "i1", six())


@query(
    f"with {LI}, e as (select min(value) as lo, max(value) as hi, (max(value) - min(value)) / 10 as w from li), b as (select i0, i1, cast(greatest(ceil((value - lo) / w) - 1, 0) as int) as bin from li, e), "
    "c as (select i0, i1, bin, count(*) as n from b group by all) select i0, i1, bin, n, round(n / sum(n) over (partition by i0, i1), 6) + 0.0 as share from c where bin < 10"
)
def histogram_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.histogram(li(spark, sf_dir), ["i0", "i1"]).select("i0", "i1", "bin", "n", six("share"))


@query(f"with {WHOLE}, y as (select frame // 12 as year, i0, i1, avg(value) as value from whole group by all) select i0, i1, round(avg(value), 6) + 0.0 as value from y group by all")
def climatology_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.climatology_year(st.whole_years(li_months(spark, sf_dir)), ["i0", "i1"])[1].select("i0", "i1", six())


@query(
    f"with {LI}, s as (select frame // 12 + case when frame % 12 >= 10 then 1 else 0 end as season, i0, i1, value from li where frame % 12 >= 10 or frame % 12 <= 1), "
    "y as (select season, i0, i1, avg(value) as value from s where season > (select min(frame // 12) from li) and season <= (select max(frame // 12) from li) group by all) select i0, i1, round(avg(value), 6) + 0.0 as value from y group by all"
)
def climatology_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.climatology_season(li_months(spark, sf_dir), 10, 1, ["i0", "i1"])[1].select("i0", "i1", six())


@query(f"with {LI} select cast(frame % 12 as int) as month, i0, i1, round(avg(value), 6) + 0.0 as value from li group by all")
def climatology_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.climatology_month(li_months(spark, sf_dir), ["i0", "i1"]).select("month", "i0", "i1", six())


@query("select cast(strftime(o_orderdate, '%Y%m%d') as bigint) as frame, round(avg(o_totalprice), 6) + 0.0 as value from orders group by all")
def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").cast("bigint").alias("frame"), F.col("o_totalprice").alias("value"))
    return st.time_series(rows).select("frame", six())


@query(f"with {FULL}, n as (select frame, i0, i1, value * 3 as v, lead(value * 3) over (partition by i0, i1 order by frame) as nx from full_) select frame, i0, i1, round(v + nx, 6) + 0.0 as value from n where nx is not null")
def accumulate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.accumulate(full(spark, sf_dir), ["i0", "i1"], "frame").select("frame", "i0", "i1", six())


@query(f"with {EVT} select frame, sum(value * value) <= 1e-9 as is_zero from evt group by frame")
def is_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.is_zero(evt(spark, sf_dir), ["frame"])


@query(f"with {LI} select frame, i0, i1, round(value / stddev_pop(value) over (partition by frame), 6) + 0.0 as value from li")
def whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.whiten(li(spark, sf_dir), ["frame"]).select("frame", "i0", "i1", six())


@query(f"with {EVT} select cast(min(i0) as int) as lat_min, cast(max(i0) as int) as lat_max, cast(min(i1) as int) as lon_min, cast(max(i1) as int) as lon_max, min(frame) as time_min, max(frame) as time_max from evt")
def grid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.bounds(evt(spark, sf_dir).withColumnsRenamed({"i0": "lat", "i1": "lon", "frame": "time"}))


@query(f"with {LI}, m as (select *, avg(value) over (partition by i0, i1) as m, stddev_samp(value) over (partition by i0, i1) as s from li) select i0, i1, round(any_value(s), 6) + 0.0 as std, round({SKEW}, 6) + 0.0 as skew from m group by all having any_value(s) > 0")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.moments(li(spark, sf_dir), ["i0", "i1"]).select("i0", "i1", six("std"), six("skew"))


@query(None)
def kmeans_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.pdf_kmeans(li(spark, sf_dir), ["i0", "i1"])


@query(None)
def kmeans_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.moments_kmeans(li(spark, sf_dir), ["i0", "i1"], k=5)


# frames and features ---------------------------------------------------------------------------


@query(f"with {EVT} select frame as src_frame, nx as dst_frame from (select frame, lead(frame) over (order by frame) as nx from (select distinct frame from evt)) where nx is not null")
def pair_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.pair_frames(evt(spark, sf_dir))


@query(f"with {LABELLED} select frame, i0, i1, value, label from lab")
def label_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot(spark, sf_dir)


@query(f"with {LABELLED} select frame, i0, i1, value, label from lab")
def label_components_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.label_cells(ew.drop_cells(evt(spark, sf_dir), ">=", HOT), GRID[1])


@query(f"with {LABELLED} select frame, i0, i1, value, label from lab")
def label_components_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.label_tiles(ew.drop_cells(evt(spark, sf_dir), ">=", HOT), *GRID, tile=(5, 7)).select("frame", "i0", "i1", "value", "label")


@query(f"with {EDGES} select * from edges")
def overlap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.overlap_edges(hot(spark, sf_dir))


@query(f"with {NODES} select frame, label, area, row_min, row_max, col_min, col_max, min_temp, max_temp, round(avg_temp, 6) + 0.0 as avg_temp from nodes")
def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tr.node_stats(hot(spark, sf_dir))
    return nodes.withColumn("avg_temp", six("avg_temp"))


@query(
    f"with {LABELLED}, e as (select frame, label, ceil(min(value)) as lo, floor(greatest(0.0, max(value))) as hi from lab group by all), "
    "t as (select e.*, coalesce((select min(k) from range(cast(lo as bigint), cast(greatest(lo, hi) as bigint) + 1) r(k) where k >= hi or (select count(*) from lab l where l.frame = e.frame and l.label = e.label and l.value <= k) >= 3), cast(lo as bigint)) as k from e) "
    "select frame, label, cast(t.k as bigint) as min_area_temp, count(*) filter (value <= t.k) as min_area, count(*) filter (value >= t.hi) as max_temp_area, count(*) filter (value <= 80.0) as temp210_area from lab join t using (frame, label) group by frame, label, t.k"
)
def node_temp_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.node_areas(hot(spark, sf_dir), 3, 80.0)


WEIGHTED = (
    f"{NODES}, good as (select * from nodes where area >= 3 or min_temp / nullif(max_temp, 0) < 0.9), "
    "weighted as (select e.src_frame, e.src_label, e.dst_frame, e.dst_label, e.area_overlap, case when greatest(area_overlap / s.area, area_overlap / d.area) >= 0.66 then 1.0 when greatest(area_overlap / s.area, area_overlap / d.area) >= 0.5 then 2.0 when area_overlap >= 3 then 3.0 end as weight "
    "from edges e join good s on s.frame = e.src_frame and s.label = e.src_label join good d on d.frame = e.dst_frame and d.label = e.dst_label)"
)


def weighted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labelled = saved_hot(spark, sf_dir)
    return labelled, tr.weighted_edges(tr.overlap_edges(labelled), tr.node_stats(labelled), min_area=3, node_min_area=3)


@query(f"with {WEIGHTED} select src_frame, src_label, dst_frame, dst_label, area_overlap, cast(weight as double) as weight from weighted where weight is not null")
def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(spark, sf_dir)[1]


PATHS = (
    f"{EDGES}, both_ways as (select src_frame * 2147483648 + src_label as a, dst_frame * 2147483648 + dst_label as b from edges), sym as (select a, b from both_ways union select b, a from both_ways), "
    "conn(node, c) as (select a, a from sym union select sym.b, conn.c from conn join sym on sym.a = conn.node where conn.c < sym.b), comp as (select node, min(c) as component from conn group by node), "
    "walk(node, n) as (select a, 0 from both_ways union select b, n + 1 from walk join both_ways on a = node), longest as (select component, max(n) as length from comp join walk using (node) group by component)"
)


@query(f"with {PATHS} select node // 2147483648 as frame, cast(node % 2147483648 as int) as label, component as subgraph, cast(length as bigint) as length from comp join longest using (component) where length >= 2")
def subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.subgraphs(tr.overlap_edges(hot(spark, sf_dir)), 2)


@query(f"with {LABELLED} select frame, label from lab group by all having count(*) filter (value <= 90.0) >= 2 and count(*) filter (value <= 110.0) >= 3")
def potential_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.potential_nodes(hot(spark, sf_dir), 2, 3, 90.0, 110.0)


COMPLEXES = (
    f"{PATHS}, pot as (select frame * 2147483648 + label as node from lab group by frame, label having count(*) filter (value <= 90.0) >= 2 and count(*) filter (value <= 110.0) >= 3), "
    "pe as (select a, b from both_ways where a in (select node from pot) and b in (select node from pot)), ps as (select a, b from pe union select b, a from pe), "
    "pc(node, c) as (select a, a from ps union select ps.b, pc.c from pc join ps on ps.a = pc.node where pc.c < ps.b), pcomp as (select node, min(c) as complex from pc group by node)"
)


@query(f"with {COMPLEXES} select component as subgraph, complex, node // 2147483648 as frame, cast(node % 2147483648 as int) as label from pcomp join comp using (node)")
def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of two nodes or more; as no chain is too long, any edge between potential nodes is in one."""
    labelled = saved_hot(spark, sf_dir)
    edges = tr.overlap_edges(labelled)
    return tr.complexes(edges, tr.subgraphs(edges, 1), tr.potential_nodes(labelled, 2, 3, 90.0, 110.0), 2, 1000)


MEMBERS = f"{PATHS}, members as (select node // 2147483648 as frame, cast(node % 2147483648 as int) as label, component as subgraph from comp join longest using (component) where length >= 1)"


@query(f"with {MEMBERS}, d as (select subgraph, frame, label, count(*) as area from members join lab using (frame, label) group by all) select subgraph, frame, cast(sum(area) as bigint) as area, string_agg(cast(label as varchar), ',' order by label) as nodes from d group by subgraph, frame")
def frame_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = saved_hot(spark, sf_dir)
    found = tr.frame_areas(tr.subgraphs(tr.overlap_edges(labelled), 1), tr.node_stats(labelled))
    return found.select("subgraph", "frame", "area", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"))


@query(f"with {MEMBERS}, per as (select subgraph, frame, label, count(*) filter (value <= 80.0) / count(*) as f from members join lab using (frame, label) group by all) select subgraph, frame, round(sum(f), 6) + 0.0 as fraction from per group by all")
def frame_cold_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = saved_hot(spark, sf_dir)
    return tr.frame_cold_fraction(tr.subgraphs(tr.overlap_edges(labelled), 1), tr.node_areas(labelled, 3, 80.0), tr.node_stats(labelled)).select("subgraph", "frame", six("fraction"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = saved_hot(spark, sf_dir)
    members, nodes = tr.subgraphs(tr.overlap_edges(labelled), 1), tr.node_stats(labelled)
    areas = tr.frame_areas(members, nodes).drop("nodes").join(tr.frame_cold_fraction(members, tr.node_areas(labelled, 3, 80.0), nodes), ["subgraph", "frame"])
    return tr.life_stages(areas.withColumn("fraction", F.round("fraction", 9)), cutoff=4.0)


LARGE = "case when q.fraction >= 0.1 then 'M' else 'D' end"
STAGES = (
    f"{MEMBERS}, per as (select subgraph, frame, label, count(*) as area, count(*) filter (value <= 80.0) / count(*) as f from members join lab using (frame, label) group by all), "
    "seq as (select subgraph, frame, cast(sum(area) as double) as area, round(sum(f), 9) as fraction from per group by subgraph, frame), "
    "q0 as (select *, row_number() over w as rn, count(*) over (partition by subgraph) as n, lead(fraction) over w as nf, lag(fraction) over w as pf from seq window w as (partition by subgraph order by frame)), "
    f"st(subgraph, frame, area, fraction, rn, stage) as (select subgraph, frame, area, fraction, rn, case when n > 1 and area >= 4 then {LARGE} else 'I' end from q0 q where rn = 1 union all "
    f"select q.subgraph, q.frame, q.area, q.fraction, q.rn, case when q.rn < q.n then case when q.area >= 4 then {LARGE} when st.stage in ('D', 'reI') then case when q.fraction > q.nf or (q.fraction = 0 and q.nf = 0) then 'D' else 'reI' end else 'I' end "
    "when st.stage in ('I', 'D') then case when q.area >= 4 and q.fraction >= 0.1 then 'M' else st.stage end "
    "when st.stage = 'reI' then case when q.area >= 4 and q.fraction >= 0.1 then 'M' when q.fraction >= q.pf then 'reI' else 'D' end "
    "else case when q.area <= 4 and q.fraction < 0.1 then 'D' else 'M' end end from st join q0 q on q.subgraph = st.subgraph and q.rn = st.rn + 1)"
)


@query(f"with {STAGES} select subgraph, frame, area, round(fraction, 6) + 0.0 as fraction, stage from st")
def dev_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir).select("subgraph", "frame", "area", six("fraction"), "stage")


@query(
    f"with {STAGES}, m as (select subgraph, rn - row_number() over (partition by subgraph order by rn) as island from st where rn > 1 and stage = 'M'), "
    "i as (select subgraph, island, count(*) as n from m group by all) select subgraph, max(n) as longest from i where n >= 1 group by subgraph"
)
def mature_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.mature_runs(staged(spark, sf_dir), 1)


@query(
    f"with {EDGES}, i as (select *, dense_rank() over (order by src_frame) - 1 as index from edges) select src_frame, src_label, dst_frame, dst_label, cast(index as bigint) as index, cast(least(greatest(ceil(index / 8), 1), 4) as int) as bucket from i"
)
def frame_rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = tr.edge_index(tr.overlap_edges(hot(spark, sf_dir)))
    return ranked.select("src_frame", "src_label", "dst_frame", "dst_label", "index", tr.bucket(F.col("index"), 8, 4).alias("bucket"))


@query(
    f"with {NODES}, pts as (select cast(strftime(ts, '%Y%m%d') as bigint) as frame, cast(user_id % 16 as double) + 0.5 as lat, hour(ts) + minute(ts) / 60.0 as lon from events) "
    "select n.frame, n.label, count(p.frame) as hits, round(coalesce(sum(p.lat), 0), 6) + 0.0 as lats, round(coalesce(sum(p.lon), 0), 6) + 0.0 as lons, round(coalesce(min(p.lon), 0), 6) + 0.0 as first from nodes n left join pts p on p.frame = n.frame and p.lat > n.row_min and p.lat < n.row_max + 1 and p.lon > n.col_min and p.lon < n.col_max + 1 group by all"
)
def points_in_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tr.node_stats(hot(spark, sf_dir))
    ends = {"lat_min": "row_min", "lat_max": "row_max", "lon_min": "col_min", "lon_max": "col_max"}
    boxes = nodes.select("frame", "label", *[(F.col(c).cast("double") + (1 if n.endswith("max") else 0)).alias(n) for n, c in ends.items()])
    rows = read(spark, sf_dir, "events")
    points = rows.select(F.date_format("ts", "yyyyMMdd").cast("bigint").alias("frame"), ((F.col("user_id") % 16).cast("double") + 0.5).alias("lat"), (F.hour("ts") + F.minute("ts") / 60.0).alias("lon"))
    found = tr.points_in_boxes(points, boxes, "frame")
    sums = {n: total_of("locations", c) for n, c in (("lats", "lat"), ("lons", "lon"))}
    first = F.coalesce(F.array_min(F.transform("locations", lambda x: x["lon"])), F.lit(0.0))
    found = found.select("frame", "label", F.size("locations").cast("long").alias("hits"), *[c.alias(n) for n, c in sums.items()], first.alias("first"))
    return found.select("frame", "label", "hits", six("lats"), six("lons"), six("first"))


@query(f"with {EDGES}, pairs as (select src_frame * 2147483648 + src_label as a, dst_frame * 2147483648 + dst_label as b from edges), r(src, dst) as (select a, b from pairs union select r.src, p.b from r join pairs p on p.a = r.dst) select src, dst from r")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tr.overlap_edges(hot(spark, sf_dir))
    return tr.reachable(edges.select(tr.node_number("src_frame", "src_label").alias("a"), tr.node_number("dst_frame", "dst_label").alias("b")))


# names, attributes, dates ----------------------------------------------------------------------


@query("select p_partkey, '(' || p_name || ' + ' || p_brand || ')' as sum_name, 'mean(' || p_name || ',List(0))' as mean_name, p_name || '[2:3,1:4]' as slice_name from part")
def lineage_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    return rows.select(
        "p_partkey", ew.binary_name(F.col("p_name"), "+", F.col("p_brand")).alias("sum_name"), ew.call_name("mean", F.col("p_name"), "List(0)").alias("mean_name"), ew.slice_name(F.col("p_name"), [(2, 3), (1, 4)]).alias("slice_name")
    )


@query("select n_nationkey, 'K' as units, n_name as name, 'new' as kind from nation")
def attr_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").withColumn("attrs", F.create_map(F.lit("name"), F.col("n_name"), F.lit("kind"), F.lit("old")))
    rows = rows.withColumn("attrs", metadata.upsert("attrs", {"kind": "new", "units": "K"}))
    return rows.select("n_nationkey", *[metadata.attribute("attrs", n).alias(n) for n in ("units", "name", "kind")])


@query("select distinct 'd' || r_regionkey as dataset, n as name, cast(l as int) as len from region, (values ('rows', 8), ('cols', 8)) v(n, l)")
def global_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(8).alias("len")) for n in ("rows", "cols")])
    rows = read(spark, sf_dir, "region").select(F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("dataset"), dims.alias("dims"))
    return metadata.global_dimensions(rows.union(rows))


@query("select e.event_id, timestamp '2000-01-01' + to_hours(cast(e.event_id as bigint)) as at_hours, cast(timestamp '2000-01-01' + to_months(cast(e.event_id % 500 as int)) as timestamp) as at_months from events e")
def decode_cf_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id")
    hours, months = dates.decode_time(F.col("event_id"), F.lit("hours since 2000-01-01 00:00:00")), dates.decode_time(F.col("event_id") % 500, F.lit("months since 2000-01-01"))
    return rows.select("event_id", hours.cast("timestamp_ntz").alias("at_hours"), months.cast("timestamp_ntz").alias("at_months"))


@query(
    "select ts, cast(dayofyear(ts) as int) as day, cast(hour(ts) as int) as hour, cast(dayofyear(ts - interval 3 hours) as int) as folder, strftime(ts, '%Y%m%d.%H') as stamp from generate_series(timestamp '2010-12-31 03:00:00', timestamp '2011-01-03 00:00:00', interval 3 hours) g(ts)"
)
def url_series_3h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.three_hourly(spark, "2010-12-31 03:00:00", "2011-01-03 00:00:00")


@query("select substring(regexp_replace(split_part(url, '/', -1), '^p', ''), 1, 4) as grp, count(*) as n from pages group by all")
def url_group_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(dates.url_group(F.col("url"), 4, "p").alias("grp")).agg(F.count("*").alias("n"))


@query(f"with {EVT} select cast(dense_rank() over (order by frame) as bigint) as rank, frame from (select distinct frame from evt)")
def frame_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.frame_ranks(evt(spark, sf_dir)).select("rank", "frame")


@query("select event_id, cast(strftime(ts, '%Y/%m/%d %H:00:00') as varchar) as strike from events")
def frame_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", dates.frame_hour(F.date_format("ts", "yyyyMMddHH").cast("long")).alias("strike"))


