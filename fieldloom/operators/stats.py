"""Statistics over axes, blocks, months and frames. All are aggregates with map-side partials, or
windows that are partitioned by cell."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.floats import COMPARE, divide
from fieldloom.plans.tables import save


def skew(value: str | Column) -> Column:
    """Mean cube of deviations over the cube of the sample deviation."""
    n = F.count(value).cast("double")
    return F.skewness(value) * F.pow((n - 1) / n, F.lit(1.5))


def axis_stats(cells: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Sum, mean, sample deviation, skew, least and greatest over all axes but ``by``."""
    number = F.when(~F.isnan(value), F.col(value))
    return cells.groupBy(*by).agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), skew(value).alias("skew"), F.min(number).alias("least"), F.max(number).alias("greatest")
    )


def is_zero(cells: DataFrame, by: Sequence[str], shortcut: bool = False) -> DataFrame:
    """Whether the sum of squares (``shortcut``: the sum) is at most 1e-9."""
    x = F.col("value") if shortcut else F.col("value") * F.col("value")
    return cells.groupBy(*by).agg((F.sum(x) <= 1e-9).alias("is_zero"))


def whiten(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values over their population deviation, not centred."""
    return cells.withColumn("value", divide(F.col("value"), F.stddev_pop("value").over(Window.partitionBy(*by))))


def detrend(cells: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Residual of the least-squares line over the rank in ``order`` (1, 2, ...) of each cell's series."""
    series = Window.partitionBy(*by)
    ranked = cells.withColumn("t", F.row_number().over(series.orderBy(order)).cast("double"))
    fitted = F.regr_intercept("value", "t").over(series) + F.regr_slope("value", "t").over(series) * F.col("t")
    return ranked.withColumn("value", F.col("value") - F.when(F.count("*").over(series) > 1, fitted).otherwise(F.col("value"))).drop("t")


def block_mean(cells: DataFrame, shape: Sequence[int], block: Sequence[int], keys: Sequence[str], invalid: float | None = None, strict: bool = False) -> DataFrame:
    """Means of blocks; partial blocks at the ends are dropped. Cells equal to ``invalid`` don't count,
    but are in the sum unless ``strict``; a block without valid cells is 0."""
    valid = F.lit(True) if invalid is None else COMPARE["!="](F.col("value"), invalid)
    (rows, cols), (r, c) = shape, block
    whole = cells.where((F.col("i0") < rows // r * r) & (F.col("i1") < cols // c * c))
    total = F.sum(F.when(valid, F.col("value")).otherwise(0.0)) if strict else F.sum("value")
    count = F.count_if(valid)
    at = [F.floor(F.col("i0") / r).cast("int").alias("i0"), F.floor(F.col("i1") / c).cast("int").alias("i1")]
    return whole.groupBy(*keys, *at).agg(F.when(count > 0, total / F.greatest(count, F.lit(1))).otherwise(0.0).alias("value"))


def anomaly(cells: DataFrame, slot: Sequence[str], cell: Sequence[str], divisor: int | None = None) -> DataFrame:
    """Value less its slot's mean; with ``divisor`` the sum is divided by that number of years."""
    w = Window.partitionBy(*slot, *cell)
    mean = F.avg("value").over(w) if divisor is None else F.sum("value").over(w) / divisor
    return cells.withColumn("value", F.col("value") - mean)


def bin_number(value: Column, low: Column, width: Column, bins: int) -> Column:
    """Bins are closed at both ends and the first match wins, so an edge is in the lower bin. Values
    outside have none."""
    k = F.greatest(F.ceil(divide(value - low, width)) - 1, F.lit(0)).cast("int")
    return F.when(width == 0, F.when(value == low, 0)).when((value >= low) & (k < bins), k)


def histogram(cells: DataFrame, by: Sequence[str], bins: int = 10, divisor: int | None = None) -> DataFrame:
    """Share of each bin between the least and greatest value of all, per ``by``; ``divisor`` in place of
    the group's size if given."""
    ends = cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    with_ends = cells.join(F.broadcast(ends))  # one row
    binned = with_ends.withColumn("bin", bin_number(F.col("value"), F.col("lo"), (F.col("hi") - F.col("lo")) / bins, bins))
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy(*by)) if divisor is None else F.lit(divisor)
    return counts.where("bin is not null").select(*by, "bin", F.col("n"), (F.col("n") / size).alias("share"))


def whole_years(cells: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """The cells of years in which all twelve months occur; years are a small table."""
    years = cells.groupBy(year).agg(F.countDistinct(month).alias("months")).where("months = 12").select(year)
    return cells.join(F.broadcast(years), year, "left_semi")


def climatology_year(cells: DataFrame, by: Sequence[str] = (), year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Annual means, and their mean."""
    annual = cells.groupBy(year, *by).agg(F.avg("value").alias("value"))
    return annual, annual.groupBy(*by).agg(F.avg("value").alias("value"))


def climatology_season(cells: DataFrame, first: int, last: int, by: Sequence[str] = (), year: str = "year", month: str = "month") -> tuple[DataFrame, DataFrame]:
    """Means of the months ``first`` to ``last`` of each season, and their mean. A season that wraps
    belongs to the year in which it ends; the first, partial one is dropped, as is the last."""
    y, m = F.col(year), F.col(month)
    if first <= last:
        rows = cells.where(m.between(first, last)).withColumn("season", y)
    else:
        rows = cells.where((m >= first) | (m <= last)).withColumn("season", y + (m >= first).cast("int"))
        ends = cells.agg(F.min(y).alias("y0"), F.max(y).alias("y1"))
        rows = rows.join(F.broadcast(ends)).where("season > y0 and season <= y1").drop("y0", "y1")
    seasons = rows.groupBy("season", *by).agg(F.avg("value").alias("value"))
    return seasons, seasons.groupBy(*by).agg(F.avg("value").alias("value"))


def climatology_month(cells: DataFrame, by: Sequence[str] = (), month: str = "month") -> DataFrame:
    return cells.groupBy(month, *by).agg(F.avg("value").alias("value"))


def time_series(cells: DataFrame, time: str = "frame") -> DataFrame:
    """Spatial mean of each time step."""
    return cells.groupBy(time).agg(F.avg("value").alias("value"))


def accumulate(cells: DataFrame, by: Sequence[str], order: str, hours: float = 3.0) -> DataFrame:
    """Rates to amounts over ``hours``, and the sum with the next step's (absent for the last)."""
    w = Window.partitionBy(*by).orderBy(order)
    amount = cells.withColumn("value", F.col("value") * hours)
    return amount.withColumn("next", F.lead("value").over(w)).where("next is not null").withColumn("value", F.col("value") + F.col("next")).drop("next")


def day_mean(cells: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """Mean over the hours of each day."""
    return cells.groupBy(day, *by).agg(F.avg("value").alias("value"))


def bounds(cells: DataFrame, lat: str = "lat", lon: str = "lon", time: str = "time") -> DataFrame:
    """Spatial and temporal limits."""
    return cells.agg(*[f(c).alias(f"{c}_{n}") for c in (lat, lon, time) for n, f in (("min", F.min), ("max", F.max))])


def resolution(cells: DataFrame, column: str) -> DataFrame:
    """First difference of the sorted distinct coordinates."""
    two = cells.select(column).distinct().orderBy(column).limit(2)
    return two.agg((F.max(column) - F.min(column)).alias("step"))


def time_class(days: Column, seconds: Column) -> Column:
    """Name of a time step: minutely, hourly, daily, monthly or yearly."""
    return F.when((days == 0) & (seconds < 3600), "minutely").when(days == 0, "hourly").when(days == 1, "daily").when(days <= 31, "monthly").otherwise("yearly")


def resolutions(cells: DataFrame, lat: str = "lat", lon: str = "lon", time: str = "time") -> DataFrame:
    """``lat_step, lon_step, time_class``: first differences of the axes, and the name of the time step."""
    steps = resolution(cells, lat).select(F.col("step").alias("lat_step")).join(F.broadcast(resolution(cells, lon).select(F.col("step").alias("lon_step"))))  # one row each
    two = cells.select(F.col(time).alias("t")).distinct().orderBy("t").limit(2)
    seconds = F.timestamp_diff("SECOND", F.min("t"), F.max("t"))
    named = two.agg(seconds.alias("s")).select(time_class(F.floor(F.col("s") / 86400), F.col("s") % 86400).alias("time_class"))
    return steps.join(F.broadcast(named))


def checked_shape(cells: DataFrame, times: DataFrame, lats: DataFrame, lons: DataFrame, time: str = "time", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The cells; reading them raises unless every axis (``value``, ascending or descending, no value twice)
    is whole and each of its places has as many cells as the other axes have places."""
    sizes = [a.agg(F.count("*").alias(f"{n}_n"), F.countDistinct("value").alias(f"{n}_d")) for n, a in ((time, times), (lat, lats), (lon, lons))]
    found = cells.agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"{c}_found") for c in (time, lat, lon)])
    for size in sizes:
        found = found.join(F.broadcast(size))  # one row
    product = F.col(f"{time}_n") * F.col(f"{lat}_n") * F.col(f"{lon}_n")
    whole = F.lit(True)
    for c in (time, lat, lon):
        whole &= (F.col(f"{c}_n") == F.col(f"{c}_d")) & (F.col(f"{c}_found") == F.col(f"{c}_n"))
    told = F.format_string("values must be of shape (%d, %d, %d) but there are %d of (%d, %d, %d)", f"{time}_n", f"{lat}_n", f"{lon}_n", "n", f"{time}_found", f"{lat}_found", f"{lon}_found")
    one = found.select(F.when(whole & (F.col("n") == product), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")).alias("__ok"))
    return cells.join(F.broadcast(one)).where("__ok").drop("__ok")


@dataclass(frozen=True)
class Bounds:
    """A box in space and time as a filter; limits are checked when it is made."""

    lat_min: float = -90.0
    lat_max: float = 90.0
    lon_min: float = -180.0
    lon_max: float = 180.0
    start: object = None
    end: object = None

    def __post_init__(self) -> None:
        if not -90 <= self.lat_min < self.lat_max <= 90:
            raise ValueError(f"latitudes {self.lat_min} to {self.lat_max}")
        if not -180 <= self.lon_min < self.lon_max <= 180:
            raise ValueError(f"longitudes {self.lon_min} to {self.lon_max}")
        if self.start is not None and self.end is not None and not self.start < self.end:
            raise ValueError(f"times {self.start} to {self.end}")

    def within(self, cells: DataFrame, lat: str = "lat", lon: str = "lon", time: str = "time") -> DataFrame:
        test = F.col(lat).between(self.lat_min, self.lat_max) & F.col(lon).between(self.lon_min, self.lon_max)
        for edge, keep in ((self.start, lambda e: F.col(time) >= F.lit(e)), (self.end, lambda e: F.col(time) <= F.lit(e))):
            test = test if edge is None else test & keep(edge)
        return cells.where(test)


def moments(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, std, skew`` of each cell's series, where both are numbers."""
    found = cells.groupBy(*by).agg(F.stddev_samp("value").alias("std"), skew("value").alias("skew"))
    return found.where("std is not null and skew is not null and not isnan(std) and not isnan(skew)")


def clustered(points: DataFrame, columns: Sequence[str], k: int, iterations: int, seed: int) -> DataFrame:
    """``points`` with the ``cluster`` of each row's ``columns`` by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = save(points, "kmeans-points")  # read once a round
    assembled = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)
    model = KMeans(k=k, maxIter=iterations, seed=seed).fit(assembled)
    return model.transform(assembled).select(*points.columns, F.col("prediction").alias("cluster"))


def pdf_kmeans(cells: DataFrame, by: Sequence[str], bins: int = 10, k: int = 3, iterations: int = 10, seed: int = 0) -> DataFrame:
    """Clusters of cells by the shares of their histogram's bins: ``by, p0, p1, ..., cluster``."""
    shares = histogram(cells, by, bins)
    wide = shares.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("share"))), F.lit(0.0)).alias(f"p{b}") for b in range(bins)])
    return clustered(wide, [f"p{b}" for b in range(bins)], k, iterations, seed)


def moments_kmeans(cells: DataFrame, by: Sequence[str], k: int = 5, iterations: int = 300, seed: int = 0) -> DataFrame:
    """Clusters of cells by deviation and skew of their series."""
    return clustered(moments(cells, by), ["std", "skew"], k, iterations, seed)
