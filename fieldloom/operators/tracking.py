"""Feature tracking: pair frames, label connected cells, link overlapping features, follow them.

Only foreground cells are ever shuffled. Labels have three forms that agree: ``label_frames`` runs a
union-find on each frame's cells in one pass over Arrow groups (frames are independent),
``label_tiles`` does so tile by tile and joins what touches, for frames too large for one task (from
some ten million cells), and ``label_cells`` is plain DataFrame rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.dates import frame_hour
from fieldloom.plans.components import components
from fieldloom.plans.tables import remove, save

FRAME = ("frame",)


def frame_ranks(rows: DataFrame, frame: str = "frame") -> DataFrame:
    """``frame, rank`` from 1, over the distinct frames (a small table)."""
    return rows.select(frame).distinct().withColumn("rank", F.row_number().over(Window.orderBy(frame)).cast("long"))


def pair_frames(rows: DataFrame, frame: str = "frame") -> DataFrame:
    """``src_frame, dst_frame`` of neighbours in order; gaps are bridged."""
    w = Window.orderBy(frame)
    frames = rows.select(frame).distinct()
    return frames.select(F.col(frame).alias("src_frame"), F.lead(frame).over(w).alias("dst_frame")).where("dst_frame is not null")


def label_frames(cells: DataFrame, columns: int, keys: Sequence[str] = FRAME) -> DataFrame:
    """``keys, i0, i1, value, label``: 4-connected components of cells that aren't 0.0, numbered from 1
    in row-major order of their first cell. ``columns``: width of the grid."""
    kept = cells.where("value != 0.0 or isnan(value)").select(*keys, F.col("i0").cast("int"), F.col("i1").cast("int"), F.col("value").cast("double"))

    def labelled(group: pa.Table) -> pa.Table:
        at = group.column("i0").to_numpy().astype(np.int64) * columns + group.column("i1").to_numpy()
        order = np.argsort(at)
        at = at[order]
        n = len(at)
        root = np.arange(n)
        pairs = []
        for step in (1, columns):
            found = np.searchsorted(at, at + step)
            ok = (found < n) & (at[np.minimum(found, n - 1)] == at + step)
            if step == 1:
                ok &= (at + 1) % columns != 0
            pairs.append((np.flatnonzero(ok), found[ok]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all():
                break
        label = np.empty(n, np.int32)
        label[order] = np.unique(root, return_inverse=True)[1] + 1
        return group.append_column("label", pa.array(label, pa.int32()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.groupBy(*keys).applyInArrow(labelled, f"{kinds}, label int")


def ranked_roots(rooted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``label`` in place of ``root``: its rank among the frame's roots, a row each."""
    roots = rooted.select(*keys, "root").distinct()
    ranks = roots.withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("root")).cast("int"))
    return rooted.join(ranks, [*keys, "root"]).drop("root")


def label_tiles(cells: DataFrame, rows: int, columns: int, tile: tuple[int, int] = (512, 512)) -> DataFrame:
    """The same for frames too large for one task: cells are labelled tile by tile, and components that touch
    at the tiles' borders are joined. Only one cell of each component, and border cells, are shuffled again."""
    of_tile = [F.floor(F.col(f"i{k}") / n).cast("int").alias(f"t{k}") for k, n in enumerate(tile)]
    frames = frame_ranks(cells).select("frame", (F.col("rank") - 1).alias("__frame"))
    kept = cells.where("value != 0.0 or isnan(value)").select("frame", "i0", "i1", "value", *of_tile)
    at = F.col("i0").cast("long") * columns + F.col("i1")
    local = label_frames(kept, columns, ("frame", "t0", "t1"))
    first = local.groupBy("frame", "t0", "t1", "label").agg(F.min(at).alias("root"))
    local = local.join(first, ["frame", "t0", "t1", "label"]).join(F.broadcast(frames), "frame")  # a row a frame
    local = save(local.select("frame", "i0", "i1", "value", (F.col("__frame") * (rows * columns) + F.col("root")).alias("root")), "label-tiles")
    row, col = F.col("i0"), F.col("i1")
    ends = [local.where(e).select("frame", (row + a).alias("i0"), (col + b).alias("i1"), F.col("root").alias("a")) for e, a, b in ((row % tile[0] == tile[0] - 1, 1, 0), (col % tile[1] == tile[1] - 1, 0, 1))]
    begins = local.where((row % tile[0] == 0) | (col % tile[1] == 0)).select("frame", "i0", "i1", F.col("root").alias("b"))
    touching = ends[0].unionByName(ends[1].where(col < columns)).join(begins, ["frame", "i0", "i1"]).select("a", "b").distinct()
    joined = components(touching)
    rooted = local.join(joined.withColumnRenamed("node", "root"), "root", "left").withColumn("root", F.coalesce("component", "root"))
    return ranked_roots(rooted.select("frame", "i0", "i1", "value", "root"), FRAME)


def label_cells(cells: DataFrame, columns: int, keys: Sequence[str] = FRAME) -> DataFrame:
    """The same by rounds of least-number propagation with shortcuts, without Python."""
    kept = cells.where("value != 0.0 or isnan(value)").select(*keys, "i0", "i1", "value", (F.col("i0") * columns + F.col("i1")).cast("long").alias("at"))
    kept = save(kept, "label-cells")
    now, changed = save(kept.select(*keys, "i0", "i1", "at", F.col("at").alias("root")), "label-roots"), 1
    while changed:
        steps = F.explode(F.array(*[F.struct((F.col("i0") + a).alias("i0"), (F.col("i1") + b).alias("i1")) for a, b in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))]))
        told = now.select(*keys, steps.alias("p"), "root").select(*keys, "p.i0", "p.i1", "root").groupBy(*keys, "i0", "i1").agg(F.min("root").alias("low"))
        low = now.join(told, [*keys, "i0", "i1"])
        short = now.select(*keys, F.col("at").alias("low"), F.col("root").alias("shorter"))
        fresh = save(low.join(short, [*keys, "low"]).select(*keys, "i0", "i1", "at", "root", F.least("low", "shorter").alias("new")), "label-roots")
        changed = fresh.where("new != root").count()
        remove(now)
        now = fresh.select(*keys, "i0", "i1", "at", F.col("new").alias("root"))
    labels = ranked_roots(now.select(*keys, "i0", "i1", "root"), keys)
    return kept.drop("at").join(labels, [*keys, "i0", "i1"])


def overlap_edges(labelled: DataFrame) -> DataFrame:
    """``src_frame, src_label, dst_frame, dst_label, area_overlap`` between neighbouring frames. Each
    cell carries its frame's successor, so this is one equi-join on frame and place."""
    pairs = pair_frames(labelled)
    src = labelled.join(pairs, F.col("frame") == F.col("src_frame")).select("src_frame", F.col("label").alias("src_label"), "dst_frame", "i0", "i1")
    dst = labelled.select(F.col("frame").alias("dst_frame"), F.col("label").alias("dst_label"), "i0", "i1")
    return src.join(dst, ["dst_frame", "i0", "i1"]).groupBy("src_frame", "src_label", "dst_frame", "dst_label").agg(F.count("*").alias("area_overlap"))


def node_stats(labelled: DataFrame) -> DataFrame:
    """One row per feature: area, box, least, greatest (0 at least) and mean value."""
    return labelled.groupBy("frame", "label").agg(
        F.count("*").alias("area"), F.min("i0").alias("row_min"), F.max("i0").alias("row_max"), F.min("i1").alias("col_min"), F.max("i1").alias("col_max"),
        F.min("value").alias("min_temp"), F.greatest(F.lit(0.0), F.max("value")).alias("max_temp"), F.avg("value").alias("avg_temp"),
    )


def node_areas(labelled: DataFrame, area_box: int, cold: float = 210.0) -> DataFrame:
    """Coldest whole degree by which ``area_box`` cells are reached and that number of cells, cells at
    the floor of the maximum and above, and cells at ``cold`` or below.

    The threshold starts at the ceiling of the minimum and rises by 1 until enough cells are at or
    below it or it reaches the floor of the maximum: the smallest whole number with that, found
    by a running count over each feature's degrees.
    """
    degrees = labelled.groupBy("frame", "label", F.ceil("value").alias("up"), F.floor("value").alias("down")).agg(F.count("*").alias("n"), F.count_if(F.col("value") <= cold).alias("cold"), F.max("value").alias("top"))
    of = Window.partitionBy("frame", "label")  # a row for each whole degree, not for each cell
    rows = degrees.withColumns({"lo": F.min("up").over(of), "hi": F.floor(F.greatest(F.lit(0.0), F.max("top").over(of)))})
    rows = rows.withColumn("reached", F.sum("n").over(of.orderBy("up").rangeBetween(Window.unboundedPreceding, 0)))
    step = F.min(F.when(F.col("reached") >= area_box, F.col("up"))).over(of)
    rows = rows.withColumn("at", F.greatest(F.col("lo"), F.least(F.coalesce(step, F.col("hi")), F.col("hi"))))

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")

    return rows.groupBy("frame", "label").agg(
        F.max("at").cast("long").alias("min_area_temp"), total(F.col("up") <= F.col("at")).alias("min_area"), total(F.col("down") >= F.col("hi")).alias("max_temp_area"), F.sum("cold").alias("temp210_area")
    )


def weighted_edges(edges: DataFrame, nodes: DataFrame, max_overlap: float = 0.66, min_overlap: float = 0.5, fraction: float = 0.9, min_area: int = 625, node_min_area: int = 150) -> DataFrame:
    """Edges between features that count, by how much they overlap: weight 1 from ``max_overlap`` of the
    smaller area on, 2 from ``min_overlap``, 3 from ``min_area`` cells; others are dropped. A feature
    counts if it is large enough or its least is below ``fraction`` of its greatest value."""
    counts = (F.col("area") >= node_min_area) | (F.when(F.col("max_temp") != 0, F.col("min_temp") / F.col("max_temp")) < fraction)
    good = nodes.where(counts).select("frame", "label", "area")
    src = good.select(F.col("frame").alias("src_frame"), F.col("label").alias("src_label"), F.col("area").alias("src_area"))
    dst = good.select(F.col("frame").alias("dst_frame"), F.col("label").alias("dst_label"), F.col("area").alias("dst_area"))
    both = edges.join(src, ["src_frame", "src_label"]).join(dst, ["dst_frame", "dst_label"])
    share = F.greatest(F.col("area_overlap") / F.col("src_area"), F.col("area_overlap") / F.col("dst_area"))
    weight = F.when(share >= max_overlap, 1.0).when(share >= min_overlap, 2.0).when(F.col("area_overlap") >= min_area, 3.0)
    return both.withColumn("weight", weight).where("weight is not null").select("src_frame", "src_label", "dst_frame", "dst_label", "area_overlap", "weight")


def with_axes(nodes: DataFrame, lat: DataFrame, lon: DataFrame) -> DataFrame:
    """Coordinates at the box's ends and centre; ``lat`` is ``(i, lat)``, ``lon`` is ``(i, lon)``. The
    latitude "min" is the one at the first row, also where the axis descends."""
    for name, axis, coordinate in (("row", lat, "lat"), ("col", lon, "lon")):
        for end in ("min", "max"):
            nodes = nodes.join(axis.select(F.col("i").alias(f"{name}_{end}"), F.col(coordinate).alias(f"{coordinate}_{end}")), f"{name}_{end}")
        nodes = nodes.withColumn(f"center_{coordinate}", (F.col(f"{coordinate}_min") + F.col(f"{coordinate}_max")) / 2)
    return nodes


def node_key(frame: str, label: str) -> Column:
    return F.concat_ws(":", F.col(frame).cast("string"), F.col(label).cast("string"))


#: A node as one number, frames first, so that the smallest is the earliest.
LABELS = 1 << 31


def node_number(frame: str, label: str) -> Column:
    """Frames of up to ten digits (yyyyMMddHH) and any label; raises on a frame beyond that, so that no
    two nodes have one number."""
    f, n = F.col(frame).cast("long"), F.col(label).cast("long")
    fits = f.between(0, LABELS * 2 - 1) & n.between(0, LABELS - 1)
    return F.when(fits, f * LABELS + n).otherwise(F.raise_error(F.lit("a frame or label is too large to number nodes; number the frames first")).cast("long"))


def subgraphs(edges: DataFrame, min_length: int = 4) -> DataFrame:
    """``frame, label, subgraph, length`` of the features in weakly connected components whose longest
    directed path has ``min_length`` edges or more. A subgraph is named by its earliest node."""
    pairs = edges.select(node_number("src_frame", "src_label").alias("a"), node_number("dst_frame", "dst_label").alias("b"))
    joined = components(pairs)
    longest = save(joined.join(longest_paths(pairs), "node", "left").groupBy("component").agg(F.coalesce(F.max("length"), F.lit(0)).alias("length")), "longest")
    kept = joined.join(longest.where(F.col("length") >= min_length), "component")
    return kept.select(F.floor(F.col("node") / LABELS).cast("long").alias("frame"), (F.col("node") % LABELS).cast("int").alias("label"), F.col("component").alias("subgraph"), F.col("length").cast("long").alias("length"))


def longest_paths(pairs: DataFrame) -> DataFrame:
    """``node, length``: edges on the longest path that ends at the node. Edges lead forward in time, so
    rounds end after as many as the longest path has. A round reads and writes only the nodes that
    some path of its length ends at."""
    pairs = save(pairs.select("a", "b").distinct(), "paths-edges")
    now = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    rounds, step = [], 0
    while True:
        now = save(now.withColumn("length", F.lit(step)), "paths-step")
        if now.isEmpty():
            break
        rounds.append(now)
        now, step = now.join(pairs, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct(), step + 1
    found = rounds[0] if rounds else now
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found.groupBy("node").agg(F.max("length").alias("length"))


def reachable(pairs: DataFrame) -> DataFrame:
    """``src, dst`` of every node and each that can be reached from it. A round writes only what it adds."""
    pairs = save(pairs.select("a", "b").distinct(), "reach-edges")
    now = fresh = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    while True:
        further = fresh.join(pairs, F.col("dst") == F.col("a")).select("src", F.col("b").alias("dst")).distinct()
        fresh = save(further.join(now, ["src", "dst"], "left_anti"), "reach-step")
        if fresh.isEmpty():
            return now
        now = now.unionByName(fresh)


def potential_nodes(labelled: DataFrame, area_a: int = 1875, area_b: int = 5000, temp_a: float = 213.0, temp_b: float = 233.0) -> DataFrame:
    """Features with ``area_a`` cells at ``temp_a`` or below and ``area_b`` at ``temp_b`` or below."""
    counts = labelled.groupBy("frame", "label").agg(F.count_if(F.col("value") <= temp_a).alias("a"), F.count_if(F.col("value") <= temp_b).alias("b"))
    return counts.where((F.col("a") >= area_a) & (F.col("b") >= area_b)).select("frame", "label")


def complexes(edges: DataFrame, members: DataFrame, potential: DataFrame, min_length: int = 5, max_length: int = 24) -> DataFrame:
    """``subgraph, complex, frame, label``: chains of potential features of ``min_length`` to
    ``max_length`` nodes, those that share a node being one complex.

    A node's chains are those of its successors with itself before, or itself alone. Chains that
    share nodes are merged as connected components, so the outcome doesn't depend on order.
    A node is in a chain of such length iff the longest chain of potential nodes through it, cut
    at any end, has one; as every node of a chain starts a chain, runs are followed backwards.
    """
    good = potential.select(node_number("frame", "label").alias("node"))
    pairs = edges.select(node_number("src_frame", "src_label").alias("a"), node_number("dst_frame", "dst_label").alias("b"))
    pairs = pairs.join(good.withColumnRenamed("node", "a"), "a").join(good.withColumnRenamed("node", "b"), "b")
    of = members.select(node_number("frame", "label").alias("node"), "subgraph").join(good, "node")
    kinds = "subgraph long, complex long, node long"

    def chains(nodes: pa.Table, arcs: pa.Table) -> pa.Table:
        after: dict[int, list[int]] = {}
        for a, b in zip(arcs.column("a").to_pylist(), arcs.column("b").to_pylist(), strict=True):
            after.setdefault(a, []).append(b)
        names = sorted(nodes.column("node").to_pylist(), reverse=True)
        group: dict[int, int] = {}
        # lengths of chains that start at a node and run to an end; a set of possible lengths
        lengths: dict[int, set[int]] = {}
        for v in names:
            lengths[v] = {m + 1 for w in after.get(v, []) for m in lengths.get(w, ())} or {1}
        root = {v: v for v in names}

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        wanted: dict[int, set[int]] = {v: {m for m in lengths[v] if min_length <= m <= max_length} for v in names}
        for v in reversed(names):
            for m in wanted[v]:
                group[v] = v
                for w in after.get(v, []):
                    if m - 1 in lengths.get(w, ()) and m > 1:
                        wanted[w].add(m - 1)
                        root[max(find(v), find(w))] = min(find(v), find(w))
        out = [(nodes.column("subgraph")[0].as_py(), find(v), v) for v in sorted(group)] if nodes.num_rows else []
        return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(("subgraph", "complex", "node"))})

    inside = pairs.join(of.withColumnRenamed("node", "a"), "a").select("subgraph", "a", "b")
    found = of.groupBy("subgraph").cogroup(inside.withColumnRenamed("subgraph", "of_subgraph").groupBy("of_subgraph")).applyInArrow(chains, kinds)
    return found.select("subgraph", "complex", F.floor(F.col("node") / LABELS).cast("long").alias("frame"), (F.col("node") % LABELS).cast("int").alias("label"))


def frame_areas(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``subgraph, frame, area, nodes``: total area and sorted labels per subgraph and frame."""
    return members.select("subgraph", "frame", "label").join(nodes, ["frame", "label"]).groupBy("subgraph", "frame").agg(F.sum("area").alias("area"), F.array_sort(F.collect_list("label")).alias("nodes"))


def frame_cold_fraction(members: DataFrame, areas: DataFrame, nodes: DataFrame) -> DataFrame:
    """``subgraph, frame, fraction``: sum over features of their cold share."""
    rows = members.select("subgraph", "frame", "label").join(nodes.select("frame", "label", "area"), ["frame", "label"]).join(areas.select("frame", "label", "temp210_area"), ["frame", "label"])
    return rows.groupBy("subgraph", "frame").agg(F.sum(F.col("temp210_area") / F.col("area")).alias("fraction"))


def stages(areas: list[float], cold: list[float], cutoff: float = 1875.0, share: float = 0.1) -> list[str]:
    """Life stages of one system's frames: I (initial), M (mature), D (decaying), reI (again initial)."""
    out: list[str] = []
    n = len(areas)
    if n == 1:
        return ["I"]
    for i in range(n):
        before, large = out[-1] if out else "", areas[i] >= cutoff
        full = "M" if cold[i] >= share else "D"
        if i < n - 1:
            if large:
                out.append(full)
            elif before in ("D", "reI"):
                fading = cold[i] > cold[i + 1] or cold[i] == cold[i + 1] == 0
                out.append("D" if fading else "reI")
            else:
                out.append("I")
        elif before == "I":
            out.append("M" if large and cold[i] >= share else "I")
        elif before == "D":
            out.append("M" if large and cold[i] >= share else "D")
        elif before == "reI":
            out.append("M" if large and cold[i] >= share else "reI" if cold[i] >= cold[i - 1] else "D")
        else:
            out.append("D" if areas[i] <= cutoff and cold[i] < share else "M")
    return out


def life_stages(frames: DataFrame, cutoff: float = 1875.0, share: float = 0.1) -> DataFrame:
    """``subgraph, frame, area, fraction, stage``; each stage depends on the one before, so a subgraph's
    frames (a row each) are walked in order."""

    def walked(group: pa.Table) -> pa.Table:
        group = group.sort_by("frame")
        found = stages(group.column("area").to_pylist(), group.column("fraction").to_pylist(), cutoff, share)
        return group.append_column("stage", pa.array(found, pa.string()))

    rows = frames.select(F.col("subgraph").cast("long"), F.col("frame").cast("long"), F.col("area").cast("double"), F.col("fraction").cast("double"))
    return rows.groupBy("subgraph").applyInArrow(walked, "subgraph long, frame long, area double, fraction double, stage string")


def mature_runs(staged: DataFrame, least: int = 3, stage: str = "M") -> DataFrame:
    """``subgraph, longest`` of subgraphs with ``least`` mature frames in a row, the first frame left out of account."""
    w = Window.partitionBy("subgraph").orderBy("frame")
    ranked = staged.withColumn("at", F.row_number().over(w)).where(F.col("at") > 1).where(F.col("stage") == stage)
    islands = ranked.withColumn("island", F.col("at") - F.row_number().over(w))
    return islands.groupBy("subgraph", "island").agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy("subgraph").agg(F.max("n").alias("longest"))


def edge_index(edges: DataFrame) -> DataFrame:
    """Adds ``index``: the rank of the source frame from 0, by a join with the distinct frames."""
    ranks = frame_ranks(edges.select(F.col("src_frame").alias("frame"))).select(F.col("frame").alias("src_frame"), (F.col("rank") - 1).alias("index"))
    return edges.join(ranks, "src_frame")


def bucket(index: Column, size: int, buckets: int) -> Column:
    """The smallest bucket whose end, ``size`` times its number, the index doesn't exceed; the last at most."""
    if size == 0:
        return F.when(index == 0, 1).otherwise(buckets)
    return F.least(F.greatest(F.ceil(index / size), F.lit(1)), F.lit(buckets)).cast("int")


def strikes_on_nodes(nodes: DataFrame, strikes: DataFrame, width: float = 5.0) -> DataFrame:
    """Features with the ``strikes`` (``time, lat, lon``) of their hour strictly inside their box as
    ``lightning``; the one location (-999, -999) where there are none. One join for all features.
    ``nodes`` have ``frame`` (yyyyMMddHH, or with minutes) and coordinates as from ``with_axes``;
    a strike's time is ``yyyy/MM/dd HH:mm:ss``. Descending axes make "min" the greater end; the
    box is between its ends either way."""
    ends = {f"{c}_{n}": f(f"{c}_min", f"{c}_max") for c in ("lat", "lon") for n, f in (("min", F.least), ("max", F.greatest))}
    boxes = nodes.select("frame", "label", frame_hour(F.col("frame")).alias("time"), *[e.alias(n) for n, e in ends.items()])
    found = points_in_boxes(strikes, boxes, "time", width).select("frame", "label", "locations")
    none = F.array(F.struct(F.lit(-999.0).alias("lat"), F.lit(-999.0).alias("lon")))
    return nodes.join(found, ["frame", "label"]).withColumn("lightning", F.when(F.size("locations") > 0, F.col("locations")).otherwise(none)).drop("locations")


def ordered_nodes(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``subgraph, nodes``: the distinct keys of each subgraph's nodes, sorted as text. A row holds a subgraph."""
    of = members.select(F.col("frame").alias("src_frame"), F.col("label").alias("src_label"), "subgraph")
    ends = F.array(node_key("src_frame", "src_label"), node_key("dst_frame", "dst_label"))
    return edges.join(of, ["src_frame", "src_label"]).select("subgraph", F.explode(ends).alias("node")).groupBy("subgraph").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def overlapping(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The features that share a cell with one of a neighbouring frame."""
    ends = edges.select(F.col("src_frame").alias("frame"), F.col("src_label").alias("label")).unionByName(edges.select(F.col("dst_frame").alias("frame"), F.col("dst_label").alias("label")))
    return nodes.join(ends, ["frame", "label"], "left_semi")


def points_in_boxes(points: DataFrame, boxes: DataFrame, time: str = "time", width: float = 5.0) -> DataFrame:
    """``boxes`` with the ``points`` strictly inside at the same time: ``locations`` is their sorted
    (lat, lon), empty where there are none. One axis is cut into bins of ``width``, so that this is
    a hash join on time and bin, each box in the bins that it touches."""
    keyed = boxes.withColumn("__box", F.xxhash64(*boxes.columns))
    bins = F.explode(F.sequence(F.floor(F.col("lat_min") / width), F.floor(F.greatest("lat_min", "lat_max") / width)))
    spread = keyed.select("__box", time, "lat_min", "lat_max", "lon_min", "lon_max", bins.alias("__bin"))
    near = points.select(time, "lat", "lon", F.floor(F.col("lat") / width).alias("__bin"))
    inside = spread.join(near, [time, "__bin"]).where("lat > lat_min and lat < lat_max and lon > lon_min and lon < lon_max")
    found = inside.groupBy("__box").agg(F.array_sort(F.collect_list(F.struct("lat", "lon"))).alias("locations"))
    empty = F.array().cast("array<struct<lat:double,lon:double>>")
    return keyed.join(found, "__box", "left").withColumn("locations", F.coalesce("locations", empty)).drop("__box")
