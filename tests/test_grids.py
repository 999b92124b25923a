import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldloom.functions.floats import COMPARE, divide
from fieldloom.operators import elementwise as ew
from fieldloom.operators import shape as sh
from fieldloom.operators import stats as st
from fieldloom.operators import tracking as tr
from fieldloom.plans import components as component_rounds
from fieldloom.plans import file_queries
from fieldloom.plans import queries as grids
from fieldloom.plans.components import components
from fieldloom.plans.model import TILES
from fieldloom.sources import climate, metadata, netcdf, raster, sinks
from fieldloom.sources import grids as gridfiles
from fieldloom.streaming import frames
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(grids.SQL))
def test_against_sql(spark, con, name):
    assert compare(grids.QUERIES[name](spark, SF), grids.SQL[name], con) is None


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def cells(spark, rows):
    return spark.createDataFrame([(0, i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "frame long, i0 int, i1 int, value double")


def grid(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i0, r.i1] = r.value
    return out


# A grid of 6 x 5 and how many of its cells pass each test with 241.
RAND = [[240, 241, 240, 241, 241], [230, 231, 240, 222, 241], [242, 243, 244, 241, 232], [240, 241, 230, 231, 241], [240, 241, 240, 242, 241], [242, 243, 244, 241, 242]]


@pytest.mark.parametrize(("op", "n"), [(">", 8), (">=", 18), ("==", 10), ("!=", 20), ("<", 12), ("<=", 22)])
def test_mask_counts(spark, op, n):
    assert ew.mask_cells(cells(spark, RAND), op, 241).where("value != 0").count() == n


def test_masks_on_nan(spark):
    row = spark.range(1).selectExpr("double('NaN') as x")
    got = row.select(*[f(row.x, 5.0).alias(k) for k, f in COMPARE.items()], divide(row.x, 0.0).alias("d"), divide(1.0, 0.0).alias("inf"), divide(-1.0, 0.0).alias("ninf")).first()
    assert [got[k] for k in COMPARE] == [False, False, False, False, False, True]
    assert np.isnan(got.d) and got.inf == np.inf and got.ninf == -np.inf


def test_rectangle_means(spark):
    # The grid and its means.
    data = cells(spark, [[1, 1, 0, 2], [1, 1, 0, 2], [1, 1, 1, 0], [0, 0, 0, 0], [3, 0, 4, 0]])
    for block, want in {(5, 1): [[1.2, 0.6, 1.0, 0.8]], (5, 2): [[0.9, 0.9]], (1, 4): [[1], [1], [0.75], [0], [1.75]], (3, 3): [[0.7777778]]}.items():
        assert np.allclose(grid(st.block_mean(data, (5, 4), block, ["frame"]), np.shape(want)), want)


def test_labels(spark):
    # The grid and its labels.
    want = [[1, 1, 0, 2], [1, 1, 0, 2], [1, 1, 1, 0], [0, 0, 0, 0], [3, 0, 4, 0]]
    data = cells(spark, [[1, 2, 0, 4], [5, 6, 0, 8], [43.9, 23, 1, 0], [0, 0, 0, 0], [1, 0, 1, 0]])
    for f in (tr.label_frames, tr.label_cells):
        found = f(data, 4).select("i0", "i1", "label").withColumnRenamed("label", "value")
        assert (grid(found, (5, 4)) == want).all()
    for tile in ((2, 2), (3, 1), (5, 4), (9, 9)):
        found = tr.label_tiles(data, 5, 4, tile).select("i0", "i1", "label").withColumnRenamed("label", "value")
        assert (grid(found, (5, 4)) == want).all()


def test_series_statistics(spark):
    # The cube, and its first residuals.
    values = [1, 2, 4, 6, 54, 333, 2, 12, 4, 5, 7, 8, 3, 4, 2, 23, 45, 32, 33, 879, 34, 22, 34, 54, 55, 66, 23]
    rows = [(k // 9, k % 9 // 3, k % 3, float(v)) for k, v in enumerate(values)]
    cube = spark.createDataFrame(rows, "i0 int, i1 int, i2 int, value double")
    got = {(r.i0, r.i1, r.i2): r.value for r in st.detrend(cube, ["i1", "i2"], "i0").collect()}
    want = [4, 144.5, 3.67, 3.67, 13.33, 63.83, 1.83, -2, -6.17, -8, -289, -7.33]
    assert [round(got[k // 9, k % 9 // 3, k % 3], 2) + 0.0 for k in range(12)] == want
    ramp = spark.createDataFrame([(k // 9, k % 9, float(k)) for k in range(27)], "i0 int, i1 int, value double")
    assert all(r.std == 9 and abs(r.skew) < 1e-12 for r in st.axis_stats(ramp, ["i1"]).collect())


def test_tiles_must_fit(spark):
    with pytest.raises(ValueError):
        sh.split_tiles(cells(spark, RAND), (6, 5), (7, 2))


@pytest.mark.parametrize("sent", [500_000, 10])
def test_components_against_union_find(spark, monkeypatch, sent):
    monkeypatch.setattr(component_rounds, "SENT_EDGES", sent)
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_stages():
    big, small = 3000.0, 10.0
    assert tr.stages([small, big, big, small, small, big], [0, 0.2, 0.05, 0.0, 0.0, 0.3]) == ["I", "M", "D", "D", "reI", "M"]
    assert tr.stages([small], [0.0]) == ["I"]
    # the last of a system that starts again: mature if large and cold, else by whether the cold share fell
    assert tr.stages([big, small, big], [0.05, 0.0, 0.05]) == ["D", "reI", "reI"]
    assert tr.stages([big, small, small, small], [0.05, 0.02, 0.03, 0.01]) == ["D", "reI", "D", "D"]
    assert tr.stages([big, small, small], [0.05, 0.02, 0.01])[2] == "D"
    assert tr.stages([big, small, small], [0.05, 0.02, 0.02]) == ["D", "reI", "reI"]
    assert tr.stages([big, big, small], [0.2, 0.2, 0.05]) == ["M", "M", "D"]
    assert tr.stages([big, big, small], [0.2, 0.2, 0.2]) == ["M", "M", "M"]


def test_node_numbers(spark):
    rows = spark.createDataFrame([(2006091123, 2_000_000_000), (2006091200, 1), (1, 0)], "f long, l long")
    got = [r.n for r in rows.select(tr.node_number("f", "l").alias("n")).collect()]
    assert got[0] < got[1] and [(n // tr.LABELS, n % tr.LABELS) for n in got] == [(2006091123, 2_000_000_000), (2006091200, 1), (1, 0)]
    with pytest.raises(Exception, match="too large"):
        rows.select(tr.node_number("f", "f") + F.col("f")).union(spark.createDataFrame([(200609112300,)], "f long").select(tr.node_number("f", "f"))).collect()


def chains_of(edges, potential, low, high):
    """Complexes by listing every path of potential nodes to an end, and merging those that share a node."""
    after = {}
    for a, b in edges:
        if a in potential and b in potential:
            after.setdefault(a, []).append(b)

    def paths(v):
        return [[v, *p] for w in after.get(v, []) for p in paths(w)] or [[v]]

    merged = []
    for v in potential:
        for path in paths(v):
            if low <= len(path) <= high:
                touched = [m for m in merged if m & set(path)]
                merged = [m for m in merged if not m & set(path)] + [set(path).union(*touched)]
    return sorted(sorted(m) for m in merged)


@pytest.mark.parametrize(("low", "high"), [(2, 24), (3, 4), (5, 6)])
def test_complexes_against_all_paths(spark, low, high):
    rng = np.random.default_rng(low)
    nodes = [(f, n) for f in range(8) for n in range(1, 5)]
    edges = sorted({((f, int(a)), (f + 1, int(b))) for f in range(7) for a, b in rng.integers(1, 5, (4, 2))})
    potential = {n for n in nodes if rng.random() < 0.8}
    table = spark.createDataFrame([(*a, *b) for a, b in edges], "src_frame long, src_label int, dst_frame long, dst_label int")
    found = tr.complexes(table, tr.subgraphs(table, 1), spark.createDataFrame(sorted(potential), "frame long, label int"), low, high).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.complex, []).append((r.frame, r.label))
    ends = {x for e in edges for x in e}
    assert sorted(sorted(g) for g in groups.values()) == chains_of(edges, potential & ends, low, high)


def test_longest_paths_and_reach(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (5, 4), (6, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.length for r in tr.longest_paths(table).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 0, 7: 1}
    assert sorted(tuple(r) for r in tr.reachable(table).collect()) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 4), (6, 7)]


@pytest.mark.parametrize(("name", "columns"), [("kmeans_moments", ["std", "skew"]), ("kmeans_pdf", [f"p{b}" for b in range(10)])])
def test_clusters_are_settled(spark, name, columns):
    """Every row is nearest to the mean of its own cluster."""
    rows = grids.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    x, own = np.array([[r[c] for c in columns] for r in rows]), np.array([r.cluster for r in rows])
    means = np.array([x[own == k].mean(axis=0) for k in sorted(set(own))])
    nearest = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert len(rows) == 70 and (nearest == np.searchsorted(sorted(set(own)), own)).mean() > 0.97
    if name == "kmeans_moments":
        want = {(r.i0, r.i1): (r["std"], r["skew"]) for r in grids.QUERIES["moments"](spark, "/root/testdata/sf0.01").collect()}
        assert all(abs(r["std"] - want[r.i0, r.i1][0]) < 1e-5 and abs(r["skew"] - want[r.i0, r.i1][1]) < 1e-5 for r in rows)
    else:
        assert all(abs(sum(r[c] for c in columns) - 1) < 1e-9 for r in rows)


def test_shapes_bounds_and_axes_are_checked(spark):
    data = [(t, la, lo, 1.0) for t in range(2) for la in range(3) for lo in range(2)]
    def axis(n):
        return spark.range(n).withColumnRenamed("id", "value")

    def table(rows):
        return spark.createDataFrame(rows, "time long, lat long, lon long, value double")

    assert st.checked_shape(table(data), axis(2), axis(3), axis(2)).count() == 12
    for rows, n in ((data[:-1], 3), (data, 4), (data + data[:1], 3)):
        with pytest.raises(Exception, match="must be of shape"):
            st.checked_shape(table(rows), axis(2), axis(n), axis(2)).collect()
    for bad in ({"lat_min": -91}, {"lat_min": 5, "lat_max": 5}, {"lon_max": 200}, {"start": 2, "end": 1}):
        with pytest.raises(ValueError):
            st.Bounds(**bad)
    assert st.Bounds(0, 1, 0, 0.5, 1, 1.5).within(table(data)).count() == 2
    down = spark.createDataFrame([(10.0, 0, 1.0), (5.0, 1, 2.0), (0.0, 2, 3.0)], "lat double, i0 int, value double")
    assert [(r.lat, r.i0) for r in sh.ascending_axis(down, "lat", "i0").orderBy("i0").collect()] == [(0.0, 0), (5.0, 1), (10.0, 2)]
    with pytest.raises(Exception, match="not sorted"):
        sh.ascending_axis(down.withColumn("i0", (F.col("i0") * 2) % 3), "lat", "i0").collect()


# How a variable, a scalar and a dataset are shown.
SHOWN = "float tas(time, lat, lon)\n\t_FillValue: 1.0E20\n\tcoordinates: height\n\tunits: K\ncurrent shape = (1, 128, 256)\n"
SCALAR = "Double64 scalar()\ncurrent shape = (1, 1)\n"
DATASET = "nc_3B42_daily.2008.01.02.7.bin.nc\nroot group ...\n\tFF_GLOBAL.Server: DODS FreeFrom based on FFND release 4.2.3\n\t_CoordSysBuilder: ucar.nc2.dataset.conv.DefaultConvention\n\tdimensions(sizes): (rows(400), cols(1440))\n\tvariables: (float data(rows, cols))\n"


def test_renderings(spark):
    kind = "dataset string, variable string, dtype string, shape array<int>, dims array<struct<name:string,len:int>>, attrs map<string,string>"
    rows = [
        ("d", "tas", "float", [1, 128, 256], [("time", 1), ("lat", 128), ("lon", 256)], {"units": "K", "coordinates": "height", "_FillValue": "1.0E20"}),
        ("d", "scalar", "Double64", [1, 1], [], {}),
        ("nc_3B42_daily.2008.01.02.7.bin.nc", "data", "float", [400, 1440], [("rows", 400), ("cols", 1440)], {}),
    ]
    tiles = spark.createDataFrame(rows, kind)
    shown = {r.variable: r.s for r in tiles.select("variable", metadata.rendering().alias("s")).collect()}
    assert shown["tas"] == SHOWN and shown["scalar"] == SCALAR
    attrs = {"FF_GLOBAL.Server": "DODS FreeFrom based on FFND release 4.2.3", "_CoordSysBuilder": "ucar.nc2.dataset.conv.DefaultConvention"}
    assert metadata.dataset_renderings(tiles.where("variable = 'data'"), attrs).first().rendering == DATASET
    with pytest.raises(Exception, match="no dimension"):
        tiles.select(metadata.dimension("dims", "depth")).collect()
    with pytest.raises(ValueError):
        ew.binary_name(F.lit("a"), "%", F.lit("b"))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = np.arange(24, dtype=np.uint8)
    (tmp_path / "in" / "a.bin").write_bytes(raw.tobytes() + b"\1")
    for got in (raster.read_raster(spark, str(tmp_path / "in"), (3, 4)), gridfiles.read_datasets(spark, str(tmp_path / "in"), kind="raster", shape="3,4")):
        assert [r.data for r in got.orderBy("frame").collect()] == [(raw[:12] + 75.0).tolist(), (raw[12:] + 75.0).tolist()]
    data = np.arange(12.0).reshape(3, 4)
    (tmp_path / "nc").mkdir()
    content = netcdf.encoded({"t": (("rows", "cols"), data, {"units": "K", "_FillValue": "5.0"}), "s": (("cols",), data[0], {}, "short"), "one": ((), np.array(7.5), {}, "float")}, {"title": "grid"})
    (tmp_path / "nc" / "x.nc").write_bytes(content)
    for found in (raster.read_netcdf(spark, str(tmp_path / "nc")), gridfiles.read_datasets(spark, str(tmp_path / "nc"))):
        rows = {r.variable: r for r in found.collect()}
        assert rows["t"].data == data.ravel().tolist() and rows["t"].shape == [3, 4] and rows["s"].shape == [1, 4] and rows["s"].dtype == "short"
        assert rows["t"].attrs["title"] == "grid" and [d.name for d in rows["t"].dims] == ["rows", "cols"] and rows["one"].data == [7.5]
    missing = gridfiles.read_datasets(spark, str(tmp_path / "nc"), ["t"], nan_missing=True).first().data
    assert np.isnan(missing[5]) and np.isnan(missing).sum() == 1
    with pytest.raises(Exception, match="no variable"):
        gridfiles.read_datasets(spark, str(tmp_path / "nc"), ["absent"]).collect()
    f = netcdf.ClassicFile(content)
    assert f.read("t", [(1, 3, 1), (0, 4, 2)]).tolist() == data[1:3, ::2].tolist() and f.shape("s") == [4]
    assert gridfiles.constrained("a.nc?t[1:1:2][0:2:3],s,u[3]") == ("a.nc", {"t": [(1, 3, 1), (0, 4, 2)], "s": [], "u": [(3, 4, 1)]})
    with pytest.raises(ValueError):
        netcdf.ClassicFile(b"HDF5....")
    (tmp_path / "p.loc").write_text("2006/09/11,00:00:00.313426, -6.0588,-178.6010, 28.2,  5\nnone\n")
    strike = raster.read_strikes(spark, str(tmp_path / "p.loc")).collect()
    assert [tuple(r) for r in strike] == [("2006/09/11 00:00:00", -6.0588, -178.601, 28.2, 5)]
    assert raster.random_grids(spark, ["u", "v"]).count() == 2
    assert [len(g) for g in raster.grouped_uris(list("abcdefg"), 3)] == [3, 3, 1]


def test_large_variables_come_in_slabs(spark, tmp_path, monkeypatch):
    data = np.arange(60.0).reshape(10, 6)
    (tmp_path / "x.nc").write_bytes(netcdf.encoded({"t": (("time", "cols"), data)}))
    monkeypatch.setattr(gridfiles, "SLAB_CELLS", 18)
    reader = gridfiles.GridReader({"path": str(tmp_path)})
    parts = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.column("origin").to_pylist()[0] for b in parts] == [[0, 0], [3, 0], [6, 0], [9, 0]]
    assert sum((b.column("data").to_pylist()[0] for b in parts), []) == data.ravel().tolist()
    rows = [r for b in parts for r in b.to_pylist()]
    again = netcdf.ClassicFile(gridfiles.as_netcdf([{**r, "attrs": dict(r["attrs"])} for r in rows]))
    assert again.read("t").tolist() == data.tolist()


def test_names_are_taken_once_a_tile(spark, tmp_path):
    """A name from a path costs more than a cell does; it must not be taken again for each cell."""
    (tmp_path / "day_3_a.nc.nc").write_bytes(netcdf.encoded({"TMP": (("x", "y"), np.arange(4.0).reshape(2, 2))}))
    tiles = gridfiles.read_datasets(spark, str(tmp_path))
    for cells in (file_queries.values(tiles), file_queries.raster_cells(tiles)):
        plan = cells._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" in plan and "regexp" not in plan[: plan.index("Generate")]
    assert {r.dataset for r in file_queries.values(tiles).collect()} == {"day_3_a.nc"}
    assert [(r.day, r.value) for r in file_queries.raster_cells(tiles).orderBy("value").collect()] == [(3, float(k)) for k in range(4)]


def test_names_of_paths(spark):
    paths = ["/a/b/grid_1.nc", "file:///a.nc/x.bin", "x", "/a/.nc", "/a/b.nc.bin", "/a/", "b.nc?t", ".nc.nc", ""]
    rows = spark.createDataFrame([(p,) for p in paths], "dataset string").select(file_queries.base_name().alias("got"), F.regexp_extract("dataset", r"([^/]+?)(?:\.nc|\.bin)?$", 1).alias("want"))
    assert all(r.got == r.want for r in rows.collect())


def test_small_variables_come_together(tmp_path, monkeypatch):
    n = raster.BATCH_TILES + 500
    grid = np.arange(6.0).reshape(2, 3)
    attrs = [{}, {"units": "K"}, {"units": "mm", "long": "x" * 9}]
    told = {f"v{k}": (("x", "y") if k % 7 else ("y",), grid + k if k % 7 else grid[0] + k, attrs[k * k % 3], ("float", "double", "short")[k % 3]) for k in range(n)}
    (tmp_path / "x.nc").write_bytes(netcdf.encoded(told))
    batches = list(gridfiles.GridReader({"path": str(tmp_path)}).read(gridfiles.Uris((str(tmp_path / "x.nc"),))))
    assert [b.num_rows for b in batches] == [raster.BATCH_TILES, 500]
    for k, row in enumerate(r for b in batches for r in b.to_pylist()):
        assert row["variable"] == f"v{k}" and row["data"] == told[f"v{k}"][1].ravel().tolist() and row["dtype"] == told[f"v{k}"][3] and {**dict(row["attrs"]), **told[f"v{k}"][2]} == dict(row["attrs"])
    whole = netcdf.encoded(told)
    with pytest.raises(ValueError):
        netcdf.ClassicFile(whole[:300])


def test_large_files_are_shared(tmp_path, monkeypatch):
    grid = np.arange(60.0).reshape(10, 6)
    for name in ("a", "b"):
        (tmp_path / f"{name}.nc").write_bytes(netcdf.encoded({"t": (("x", "y"), grid), **{f"v{k}": (("y",), grid[0] + k) for k in range(40)}, "one": ((), np.array(7.5))}))
    (tmp_path / "c.txt").write_text(f"{tmp_path}/a.nc?t[1:2:9][0:3],v1,v39\n{tmp_path}/b.nc\n")
    (tmp_path / "r.bin").write_bytes(bytes(range(60)))
    monkeypatch.setattr(gridfiles, "SLAB_CELLS", 18)
    files = {"path": str(tmp_path), "pattern": r"\.nc$", "partitions": "1"}
    for options in (files, {**files, "metadata": "true"}, {"path": str(tmp_path / "c.txt")}, {"path": str(tmp_path / "r.bin"), "kind": "raster", "shape": "5,6"}):
        reader, found = gridfiles.GridReader(options), []
        for most in (1 << 20, 16):  # bytes of a share
            monkeypatch.setattr(gridfiles, "SHARE_BYTES", most)
            parts = reader.partitions()
            assert len(parts) == len({p.uris for p in parts}) if most > 16 else max(p.share[1] for p in parts) > 1
            shares = [[r for b in reader.read(p) for r in b.to_pylist()] for p in parts]
            assert most > 16 or sum(map(bool, shares)) > 2
            found.append(sorted((r for rows in shares for r in rows), key=lambda r: (r["dataset"], r["variable"], r["frame"] or 0, r["origin"])))
        assert found[0] == found[1] and len(found[0]) > 3


def test_numbers_are_written_as_they_are(spark, tmp_path):
    """Null numbers, slices of batches and several types, through the sink and back."""
    rows = [(f"d{k % 3}", f"v{k}", None, "double", [0, 0], [1, 2], [float(k), None if k % 5 == 0 else 0.5], [("x", 1), ("y", 2)], {"k": str(k)}) for k in range(60)]
    gridfiles.write_datasets(spark.createDataFrame(rows, TILES), str(tmp_path / "out"))
    got = {r.variable: r for r in gridfiles.read_datasets(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 60
    for k in range(60):
        assert got[f"v{k}"].data[0] == k and (np.isnan(got[f"v{k}"].data[1]) if k % 5 == 0 else got[f"v{k}"].data[1] == 0.5) and got[f"v{k}"].attrs["k"] == str(k)


def test_filters_reach_the_scan(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.nc").write_bytes(netcdf.encoded({"t": (("x",), np.arange(3.0)), "u": (("x",), np.arange(3.0))}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = gridfiles.read_datasets(spark, str(tmp_path)).where("variable = 'u'")
        assert {r.variable for r in found.collect()} == {"u"} and found.count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = gridfiles.FilteredGridReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("variable",), "u"), EqualTo(("dataset",), str(tmp_path / "a.nc")), GreaterThan(("frame",), 3)]))
    assert len(left) == 1 and [p.uris for p in reader.partitions()] == [(str(tmp_path / "a.nc"),)]
    assert [b.column("variable").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [["u"]]


def test_http_with_a_login(spark):
    import http.server
    import threading

    content = netcdf.encoded({"t": (("x", "y"), np.arange(12.0).reshape(3, 4))})

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            ok = self.headers.get("Authorization") == "Basic dTpw" and self.path == "/t.nc"
            self.send_response(200 if ok else 401)
            self.end_headers()
            self.wfile.write(content if ok else b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        uri = f"http://127.0.0.1:{server.server_port}/t.nc?t[1:2][0:3:3]"
        assert gridfiles.read_datasets(spark, uri, user="u", password="p").first().data == [4.0, 7.0, 8.0, 11.0]
        with pytest.raises(Exception, match="401"):
            gridfiles.read_datasets(spark, uri).collect()
    finally:
        server.shutdown()


def test_axis_names():
    told = {"pr": ["time", "lev", "rlat", "rlon"], "time": ["time"], "lat": ["rlat"], "rlon": ["rlon"], "lev": ["lev"]}
    assert [climate.axis_name(told, "pr", known) for known in (raster.TIMES, raster.LATITUDES, raster.LONGITUDES)] == ["time", "lat", "rlon"]
    with pytest.raises(ValueError):
        climate.axis_name({"pr": ["a", "b"], "c": ["a"]}, "pr", raster.TIMES)


def test_levels_are_stripped(spark, tmp_path):
    data = np.arange(48.0).reshape(2, 3, 2, 4)
    axes = {"time": (("time",), [0, 1], {"units": "days since 2000-02-28"}), "lat": (("lat",), [10.0, 0.0]), "lon": (("lon",), [0.0, 1.0, 2.0, 3.0]), "lev": (("lev",), [1.0, 2.0, 3.0])}
    (tmp_path / "x.nc").write_bytes(netcdf.encoded({"pr": (("time", "lev", "lat", "lon"), data), **axes}))
    got = {(str(r.time), r.lat, r.lon): r.value for r in climate.load_grid(spark, str(tmp_path / "x.nc"), "pr", elevation=2).collect()}
    assert got == {(f"2000-02-{28 + t} 00:00:00", [10.0, 0.0][i], float(j)): data[t, 2, i, j] for t in range(2) for i in range(2) for j in range(4)}


def test_notebook_arrays(spark):
    rows = spark.createDataFrame([("d", "t", [1.5, -2.0], [1, 2]), ("e", "u", [0.0], [1, 1])], "dataset string, variable string, data array<double>, shape array<int>")
    one = sinks.array_rows(rows, "t").first()
    assert np.frombuffer(one["bytes"], ">f8").tolist() == [1.5, -2.0] and (one["shape"], one["id"]) == ([1, 2], "d")
    assert sinks.arrays(rows, "t").to_pylist() == [{"dataset": "d", "shape": [1, 2], "data": [1.5, -2.0]}]
    with pytest.raises(ValueError):
        sinks.arrays(rows, "t", most_cells=1)


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(str(tmp_path / "in"))
    out = frames.frames(stream, F.col("user_id") % 16, F.hour("ts"), late="60 days")
    out.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = {(r.frame, r.i0, r.i1): r.value for r in grids.evt(spark, SF).collect()}
    assert {(int(r.start.strftime("%Y%m%d")), r.i0, r.i1): r.value for r in spark.table("daily").collect()} == want
    for k, rows in enumerate([[("a", 1), ("b", 5), ("a", 2)], [("a", 7), ("a", 4), ("b", 3)], [("b", 9)]]):
        spark.createDataFrame(rows, "dataset string, frame long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"f/{k}"))
    stream = spark.readStream.schema("dataset string, frame long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "f"))
    frames.pairs(stream).writeStream.format("memory").queryName("paired").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("paired").collect()) == [("a", 1, 2), ("a", 2, 4), ("a", 4, 7), ("b", 5, 9)]
