"""Operator 9: near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centres are fitted on a bounded sample (``sample_rows`` vectors, those of least id hash); every
vector is then assigned to its nearest cell. It also visits every cell whose border (the plane
between the two centres) is within sqrt((1 - threshold) / 2): two vectors at the threshold are
twice that apart, so of any linked pair that a border separates at least one visits the other's
cell, and none is missed. Where both visit, the pair counts in the higher-numbered cell only.

How many cells there are is chosen by cost: the sample tells how many cells a vector visits,
which gives the rows sent and the products taken. Vectors that lie near few borders get many
small cells; vectors without structure are near most borders, so they get few.

Equal vectors of an Arrow batch go on as one with their number, so a hot vector is a row for
each batch. Cells and visitors are cut into blocks of about ``block_rows`` rows and every two
blocks that must meet are one group: products in single precision, less a margin wider than
their rounding, find candidates, which are computed again in double precision. Only counts of
links and a spanning forest leave, never pairs. So neither a large cell nor a large group of
near copies is held by one task.

Vectors of another length than the most common one are compared among their own length, in
blocks without cells. One representative of each component, that of its smallest id, is kept.

Cost: vectors without structure need about all pairs, n * n / 2 products, however they are cut;
beyond ``most_cells`` cells the products a row grow with the rows of a cell.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors
without an id, are linked with nothing; rows that repeat an id are not linked with each other
and their links are added up; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import save
from fieldloom.plans.components import components

#: Added to distances from borders, more than their rounding; a visit too many changes no result.
SLACK = 1e-6
#: Taken from the threshold in single precision, more than the rounding of products of unit vectors.
LOOSE = 1e-4
#: Most rows that the cells' visitors come in at a time, and rows of a block multiplied at a time.
COPIES, STEP = 1 << 16, 128
#: Products that take about as long as sending a row.
PRODUCTS = 3000


def matrix(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of usable vectors of a length, and those vectors."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == length)
    flat = vectors.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), length)  # nulls become NaN
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[ok], np.ascontiguousarray(x[ok])


def units(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres by spherical k-means, from spread-out starting rows."""
    rng = np.random.default_rng(9)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        some, first = np.unique(own[order], return_index=True)
        sums = np.zeros_like(centres)
        sums[some] = np.add.reduceat(x[order], first, axis=0)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


class Cells:
    """Centres, and which cells a vector visits."""

    def __init__(self, centres: np.ndarray, threshold: float):
        self.centres, self.margin = centres, np.sqrt(max(0.0, 1 - threshold) / 2) + SLACK
        self.apart = np.sqrt(2 * np.maximum(1 - centres @ centres.T, 1e-12))
        self.number = np.arange(len(centres))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home of each vector, and for each cell whether it is visited."""
        near = x @ self.centres.T
        home = near.argmax(axis=1)
        own = near[np.arange(len(x)), home]
        return home, (own[:, None] - near <= self.margin * self.apart[home] + SLACK) & (self.number[None, :] != home[:, None])


def choose_cells(x: np.ndarray, n: int, threshold: float, block_rows: int, most_cells: int) -> Cells:
    """Cells of least cost for ``n`` vectors like the sample ``x``, in sendings of a row: copies sent for
    each pair of blocks, and products."""
    best, least_cost, cells = None, np.inf, 1 if n < 2000 else 4
    while best is None or cells <= min(most_cells, n // 100, len(x) // 5):
        found = Cells(fit_cells(x, cells), threshold)
        visits = np.mean([found.of(x[at : at + 1000])[1].sum(axis=1).mean() for at in range(0, min(len(x), 4000), 1000)])
        homes = n / cells
        blocks = 1 + homes / block_rows, visits and 1 + homes * visits / block_rows
        cost = blocks[0] + blocks[1] + visits * blocks[0] + homes * (0.5 + visits) / PRODUCTS
        if cost < least_cost:
            best, least_cost = found, cost
        elif cost > 2 * least_cost:
            break
        cells *= 4
    return best


class Forest:
    """Components of rows, each named by its first row in the order of ids."""

    def __init__(self, ids: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.rank = np.empty(len(ids), np.int64)
        self.rank[self.order] = np.arange(len(ids))
        self.label, self.ids = np.arange(len(ids)), ids

    def join(self, row: int, others: np.ndarray) -> None:
        ranks = np.append(self.rank[others], self.rank[row])
        labels = np.unique(self.label[ranks])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        tied = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.ids[self.order[tied]], self.ids[self.order[self.label[tied]]]


def links_of(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float, elsewhere: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Links between the rows ``first`` and ``second`` (indices; equal if a block meets itself): ``(rows
    with links, weights of their links, forest ends, forest ends)``. ``elsewhere`` has a cell of each first row,
    and for each second row whether pairs with that cell's rows are taken there."""
    same = len(first) == len(second) and (first == second).all()
    counts, forest, single = np.zeros(len(ids)), Forest(ids), x.astype(np.float32)
    right = single[second].T.copy()
    for at in range(0, len(first), STEP):
        rows = first[at : at + STEP]
        i, j = np.nonzero(single[rows] @ right >= threshold - LOOSE)
        a, b = rows[i], second[j]
        ok = ids[a] != ids[b]
        if same:
            ok &= at + i < j
        if elsewhere is not None:
            ok &= ~elsewhere[1][j, elsewhere[0][at + i]]
        a, b = a[ok], b[ok]
        keep = np.concatenate([np.einsum("ij,ij->i", x[a[s : s + COPIES]], x[b[s : s + COPIES]]) >= threshold for s in range(0, len(a), COPIES)] or [np.zeros(0, bool)])
        a, b = a[keep], b[keep]
        counts += np.bincount(a, weight[b], minlength=len(ids)) + np.bincount(b, weight[a], minlength=len(ids))
        for row, k in zip(*np.unique(a, return_index=True), strict=True):  # a ascends
            forest.join(row, b[k : np.searchsorted(a, row, side="right")])
    some = np.flatnonzero(counts)
    return ids[some], counts[some].astype(np.int64), *forest.edges()


def near_vectors(
    table: DataFrame, threshold: float = 0.9, most_cells: int = 4096, sample_rows: int = 20_000, block_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: links at cosine ``threshold`` or more, the smallest id
    reachable over links, and whether it is the row's own. ``cells``: their number, if it isn't to be chosen."""
    kind = table.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    table = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    usable = table.where("vec_id is not null and v is not null")
    picked = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
    sizes = pc.list_value_length(picked).to_numpy(zero_copy_only=False)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    sample = units(matrix(picked, dim)[1]) if dim else np.zeros((0, 0))
    n, ids = usable.agg(F.count("*"), F.countDistinct("vec_id")).first()
    alone = n > ids  # an id repeats: equal vectors aren't made one, as some may be of one id
    if not len(sample):
        grid = Cells(np.ones((1, max(1, dim))), threshold)
    elif cells:
        grid = Cells(fit_cells(sample, cells), threshold)
    else:
        grid = choose_cells(sample, n, threshold, block_rows, most_cells)
    width = len(grid.centres)
    numbers = pa.float32() if kind == "array<float>" else pa.float64()

    def rows_of(ids, cell, guest, x, weight, home, higher) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), numbers))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cell, pa.int64()), pa.array(guest, pa.bool_()), lists, pa.array(weight, pa.int64()), pa.array(home, pa.int32()), pa.array(higher, pa.binary()), pa.nulls(len(x), pa.int64())], NAMES)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_length = pc.list_value_length(batch.column(1))
            for length in pc.unique(of_length.drop_null()).to_pylist():
                rows, x = matrix(batch.column(1), length) if length else (np.zeros(0, np.int64), np.zeros((0, 0)))
                if not len(rows):
                    continue
                ids = batch.column(0).take(pa.array(rows)).to_numpy()
                weight = np.ones(len(rows), np.int64)
                if not alone:
                    order = np.argsort(ids, kind="stable")
                    ids, x = ids[order], x[order] + 0  # -0 is 0
                    _, first, back, count = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True, return_counts=True)
                    more = np.flatnonzero(first[back] != np.arange(len(ids)))
                    if len(more):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[more]), *[pa.nulls(len(more), t) for t in (pa.int64(), pa.bool_(), pa.list_(numbers), pa.int64(), pa.int32(), pa.binary())], pa.array(ids[first[back[more]]])], NAMES)
                    ids, x, weight = ids[first], x[first], count
                if length != dim:
                    yield rows_of(ids, np.full(len(ids), -length), np.zeros(len(ids), bool), x, weight, np.zeros(len(ids), np.int32), [b""] * len(ids))
                    continue
                for begin in range(0, len(ids), max(1, COPIES // width)):
                    part = slice(begin, begin + max(1, COPIES // width))
                    home, guest = grid.of(units(x[part]))
                    bits = [b.tobytes() for b in np.packbits(guest & (grid.number[None, :] > home[:, None]), axis=1)]
                    i, cell = np.nonzero(guest)
                    at = np.concatenate((np.arange(len(home)), i))
                    yield rows_of(ids[part][at], np.concatenate((home, cell)), np.arange(len(at)) >= len(home), x[part][at], weight[part][at], home[at], [*bits, *[b""] * len(i)])

    kinds = f"vec_id long, cell long, guest boolean, v {kind}, weight long, home int, higher binary, same_as long"
    placed = save(usable.mapInArrow(assigned, kinds), "vectors-placed")
    copies = placed.where("same_as is not null").select("vec_id", "same_as")
    placed = placed.where("same_as is null")
    count = {g: F.coalesce(F.count_if(F.col("guest") == F.lit(g)), F.lit(0)) for g in (False, True)}
    parts = placed.groupBy("cell").agg(F.ceil(count[False] / block_rows).cast("int").alias("homes"), F.ceil(count[True] / block_rows).cast("int").alias("guests"))
    few = parts.limit(2 * most_cells + 1).count() <= 2 * most_cells  # lengths other than the common one are cells too
    placed = placed.join(F.broadcast(parts) if few else parts, "cell")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int"))
    other = F.sequence(F.lit(0), F.greatest(F.col("homes"), F.lit(1)) - 1)
    none = F.array().cast("array<struct<p:int,q:int>>")
    of_home = F.concat(
        F.transform(other, lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q"))),
        F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("guests") - 1, F.lit(0))), lambda g: F.struct((-g - 1).alias("p"), F.col("block").alias("q")))).otherwise(none),
    )
    of_guest = F.when(F.col("homes") > 0, F.transform(other, lambda o: F.struct((-F.col("block") - 1).alias("p"), o.alias("q")))).otherwise(none)
    kept = ["vec_id", "cell", "guest", "block", "v", "weight", "home", "higher"]
    meets = placed.select(*kept, F.explode(F.when(F.col("guest"), of_guest).otherwise(of_home)).alias("pair")).select(*kept, "pair.p", "pair.q")

    def compared(group: pa.Table) -> pa.Table:
        p, q, cell = (group.column(c)[0].as_py() for c in ("p", "q", "cell"))
        ids = group.column("vec_id").to_numpy()
        x = units(group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
        guest, block = group.column("guest").to_numpy(), group.column("block").to_numpy()
        first, second = np.flatnonzero(guest if p < 0 else block == p), np.flatnonzero(~guest if p < 0 else block == q)
        elsewhere = None
        if p < 0 and len(first) and len(second):
            bits = np.frombuffer(b"".join(group.column("higher").take(pa.array(second)).to_pylist()), np.uint8).reshape(len(second), -1)
            elsewhere = group.column("home").to_numpy()[first], np.unpackbits(bits, axis=1, count=width).astype(bool)
        some, counts, a, b = links_of(ids, x, group.column("weight").to_numpy(), first, second, threshold, elsewhere)
        pad = [None] * len(a)
        return pa.table({"id": pa.array([*some, *a], pa.int64()), "links": pa.array([*counts, *pad], pa.int64()), "root": pa.array([*[None] * len(some), *b], pa.int64())})

    found = save(meets.groupBy("cell", "p", "q").applyInArrow(compared, "id long, links long, root long"), "vectors-links")
    counts = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    group = copies.groupBy("same_as").agg(F.count("*").alias("more"))
    nodes = save(counts.join(group, counts["id"] == group["same_as"], "full").select(F.coalesce("id", "same_as").alias("id"), (F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links")), "vectors-counts")
    of_copies = copies.join(nodes, copies["same_as"] == nodes["id"]).select("vec_id", "links")
    links = nodes.select(F.col("id").alias("vec_id"), "links").unionByName(of_copies)
    joined = components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(copies.select(F.col("vec_id").alias("a"), F.col("same_as").alias("b"))))
    rows = table.select("vec_id").join(links, "vec_id", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


NAMES = ["vec_id", "cell", "guest", "v", "weight", "home", "higher", "same_as"]
