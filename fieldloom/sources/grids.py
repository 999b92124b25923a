"""The source and sink ``grid``: NetCDF and raw rasters as tiles, one partition to a group of URIs.

Files are opened at random access inside the tasks; only the header, and of the wanted variables
the wanted rows, are read. Large variables come as slabs of their leading axis, one tile each,
with the slab's place as origin; small ones come many to a batch. Large files are shared by several
tasks, each with its part of the variables and slabs. Filters on ``variable`` and ``dataset`` reach the scan if
``spark.sql.python.filterPushdown.enabled`` is set and ``read_datasets`` makes the scan; the option ``variables`` always does.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from fieldloom.plans.model import TILES
from fieldloom.sources import access
from fieldloom.sources.netcdf import NETCDF_NAMES, ClassicFile, encoded
from fieldloom.sources.raster import BATCH_CELLS, RASTER_OFFSET, RASTER_SHAPE, batched, grouped_uris, tile

#: Cells of a slab.
SLAB_CELLS = 4 << 20
#: Bytes of a file to a task, and tasks to a file at most, as each of them reads the file's header. Sizes of listed files are asked for only if there are not more than so many.
SHARE_BYTES, MOST_SHARES, MOST_ASKED = 8 << 20, 8, 1000


@dataclass
class Uris(InputPartition):
    """Whole files, or one share of a file: its number and how many there are."""

    uris: tuple[str, ...]
    share: tuple[int, int] = (0, 1)


def of_share(pieces: Iterable[tuple[int, tuple]], share: tuple[int, int]) -> Iterator[tuple]:
    """The pieces, each with its weight, that begin in a share of the whole weight."""
    pieces = list(pieces) if share[1] > 1 else pieces
    total = max(1, sum(weight for weight, _ in pieces)) if share[1] > 1 else 1
    before = 0
    for weight, piece in pieces:
        if share[1] == 1 or min(before * share[1] // total, share[1] - 1) == share[0]:
            yield piece
        before += weight


def constrained(uri: str) -> tuple[str, dict[str, list[tuple[int, int, int]]]]:
    """A URI without its constraint, and the ranges of each variable that the constraint names, ends
    exclusive. As ``file?a[0:1:3][2:4],b``: begin, step and last, or begin and last, or one place."""
    name, _, constraint = uri.partition("?")
    wanted = {}
    for part in filter(None, constraint.split(",")):
        variable, _, rest = part.partition("[")
        wanted[variable] = []
        for found in re.findall(r"\[([^\]]*)\]", "[" + rest if rest else ""):
            numbers = [int(x) for x in found.split(":")]
            low, step, last = (numbers[0], 1, numbers[0]) if len(numbers) == 1 else (numbers[0], 1, numbers[1]) if len(numbers) == 2 else numbers
            wanted[variable].append((low, last + 1, step))
    return name, wanted


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.names = [v for v in options.get("variables", "").split(",") if v]
        self.only: dict[str, set[str]] = {}

    def uris(self) -> list[str]:
        """A path that ends in .txt lists URIs, any other is a file or a folder."""
        path = self.options["path"]
        found = access.lines(path, self.options) if path.partition("?")[0].endswith(".txt") else [path] if "?" in path else access.listed(path, self.options.get("recursive", "false") == "true")
        pattern = self.options.get("pattern")
        return [u for u in found if not pattern or re.search(pattern, u)]

    def partitions(self) -> Sequence[InputPartition]:
        """Groups of URIs; what is large in a group is dealt out further."""
        uris = [u for u in self.uris() if "dataset" not in self.only or u.partition("?")[0] in self.only["dataset"]]
        sizes = access.sizes([u.partition("?")[0] for u in uris]) if len(uris) <= MOST_ASKED else {}
        found = []
        for group in grouped_uris(uris, int(self.options.get("partitions", len(uris) or 1))):
            shares = {u: min(MOST_SHARES, -(-sizes.get(u.partition("?")[0], 0) // SHARE_BYTES)) for u in group}
            whole = tuple(u for u in group if shares[u] <= 1)
            found += [Uris(whole)] if whole else []
            found += [Uris((u,), (k, shares[u])) for u in group if shares[u] > 1 for k in range(shares[u])]
        return found or [Uris(())]

    def read(self, partition: Uris) -> Iterator[pa.RecordBatch]:
        yield from batched(self.tiles(partition), min(SLAB_CELLS, BATCH_CELLS))

    def tiles(self, partition: Uris) -> Iterator[dict]:
        for uri in partition.uris:
            name, wanted = constrained(uri)
            with access.open_uri(name, self.options) as f:
                yield from self.rasters(name, f, partition.share) if self.options.get("kind") == "raster" else self.variables(name, ClassicFile(f), wanted, partition.share)

    def rasters(self, uri: str, f, share: tuple[int, int]) -> Iterator[dict]:
        shape = tuple(int(x) for x in self.options.get("shape", f"{RASTER_SHAPE[0]},{RASTER_SHAPE[1]}").split(","))
        variable, offset = self.options.get("variable", "TMP"), float(self.options.get("offset", RASTER_OFFSET))
        if "variable" in self.only and variable not in self.only["variable"]:
            return
        step = max(1, SLAB_CELLS // shape[1])
        n = f.seek(0, 2) // (shape[0] * shape[1])
        pieces = ((min(step, shape[0] - low), (frame, low)) for frame in range(n) for low in range(0, shape[0], step))
        for frame, low in of_share(pieces, share):
            rows = min(step, shape[0] - low)
            f.seek((frame * shape[0] + low) * shape[1])
            grid = np.frombuffer(f.read(rows * shape[1]), np.uint8).reshape(rows, shape[1]) + offset
            yield tile(uri, variable, grid, ("rows", "cols"), attrs={"SOURCE": uri}, frame=frame, origin=[low, 0])

    def variables(self, uri: str, f: ClassicFile, wanted: dict, share: tuple[int, int]) -> Iterator[dict]:
        names = list(wanted) or self.names or f.numeric()
        missing = [v for v in names if v not in f.variables]
        if missing:
            raise ValueError(f"{uri} has no variable {missing[0]}")
        headers, nans = self.options.get("metadata") == "true", self.options.get("nanmissing") == "true"

        def pieces() -> Iterator[tuple[int, tuple]]:
            """Variables and their slabs, in order, with the cells that are read for them."""
            for v in names:
                if "variable" in self.only and v not in self.only["variable"]:
                    continue
                shape, ranges = f.shape(v), wanted.get(v, [])
                if headers:
                    yield 1, (v, shape, 0, ())
                    continue
                low, high, step = (ranges[0] if ranges else (0, shape[0], 1)) if shape else (0, 1, 1)
                count = max(1, len(range(low, min(high, shape[0]) if shape else 1, step)))
                width = math.prod(shape[1:])
                slab = max(1, SLAB_CELLS // max(1, width)) if len(shape) > 1 else count
                for k in range(0, count, slab):
                    part = (low + k * step, min(high, low + (k + slab) * step), step)
                    yield width * min(slab, count - k), (v, shape, k, (part, *ranges[1:]) if shape else ())

        for v, shape, k, ranges in of_share(pieces(), share):
            attrs, kind = f.variables[v][1], NETCDF_NAMES[f.variables[v][2]]
            own = {**f.attrs, **attrs, "SOURCE": uri}
            dims = f.dim_names(v)
            if headers:
                yield {**tile(uri, v, np.zeros(0), ("none",), kind, own), "shape": shape, "origin": [0] * len(shape), "dims": [{"name": n, "len": k} for n, k in zip(dims, shape, strict=True)]}
                continue
            data = f.read(v, ranges).astype(np.float64)
            fill = attrs.get("_FillValue", attrs.get("missing_value"))
            if nans and fill not in (None, ""):
                data = np.where(data == float(fill), np.nan, data)
            yield tile(uri, v, data, dims, kind, own, origin=[k] + [0] * (data.ndim - 1) if data.ndim > 1 else None)


class FilteredGridReader(GridReader):
    """The same in sessions that push filters down."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("variable",), ("dataset",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.only[name] = self.only[name] & values if name in self.only else values
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class GridWriter(DataSourceArrowWriter):
    """A file for each dataset. Rows of a dataset come one after the other, as ``write_datasets`` sees to.
    Tasks write beside the folder's files; the commit moves them there."""

    def __init__(self, options: dict[str, str]):
        self.options, self.beside = options, f"_grid-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = access.file_system(self.options["path"])
        attempt, moves, rows, dataset = uuid.uuid4().hex, [], [], None
        files.create_dir(f"{folder}/{self.beside}", recursive=True)

        def flush() -> None:
            if rows:
                name = file_name(dataset, self.options.get("kind", "netcdf"))
                beside = f"{folder}/{self.beside}/{attempt}-{len(moves)}"
                with files.open_output_stream(beside) as f:
                    f.write(as_raster(rows, float(self.options.get("offset", RASTER_OFFSET))) if self.options.get("kind") == "raster" else as_netcdf(rows))
                moves.append((beside, f"{folder}/{name}"))

        for batch in iterator:
            for row in rows_of(batch):
                if row["dataset"] != dataset:
                    flush()
                    rows, dataset = [], row["dataset"]
                rows.append(row)
        flush()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = access.file_system(self.options["path"])
        for message in messages:
            for beside, place in message.moves if message else []:
                files.move(beside, place)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = access.file_system(self.options["path"])
        if files.get_file_info(f"{folder}/{self.beside}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.beside}")


class GridSource(DataSource):
    """Options: ``path`` (a file, a folder, or a .txt list of URIs, each with a constraint if wanted), ``kind``
    (netcdf or raster), ``variables``, ``pattern``, ``recursive``, ``partitions``, ``nanmissing``, ``metadata``
    (variables without their data), ``shape``, ``offset``, ``variable`` (rasters), ``user``, ``password``."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> GridReader:
        return (FilteredGridReader if self.options.get("pushdown") == "true" else GridReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GridWriter:
        return GridWriter(dict(self.options))


def file_name(dataset: str, kind: str) -> str:
    end = ".nc" if kind == "netcdf" else ".bin"
    name = re.sub(r"[^A-Za-z0-9._-]+", "_", dataset.split("://")[-1]).strip("_")
    return name if name.endswith(end) else name + end


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, with numbers as arrays and not as lists of objects."""
    data = batch.column("data")
    flat, ends = data.values.to_numpy(zero_copy_only=False), data.offsets.to_numpy()
    for k, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
        yield row | {"data": flat[ends[k] : ends[k + 1]].copy() if data[k].is_valid else None}


def array_of(row: dict) -> np.ndarray:
    data = np.asarray(row["data"], np.float64)
    dims = row["dims"]
    return data.reshape([d["len"] for d in dims]) if len(dims) and data.size == np.prod([d["len"] for d in dims]) else data.reshape(row["shape"])


def as_netcdf(rows: list[dict]) -> bytes:
    """A dataset's variables; slabs of one variable are put together in the order of their origins. Attributes
    that all variables have alike are the dataset's."""
    slabs: dict[str, list[dict]] = {}
    for row in rows:
        slabs.setdefault(row["variable"], []).append(row)
    every = [dict(r["attrs"] or []) for r in rows]
    shared = {k: v for k, v in every[0].items() if len(slabs) > 1 and all(a.get(k) == v for a in every)}
    out = {}
    for name, parts in slabs.items():
        parts.sort(key=lambda r: r["origin"] or [])
        data = np.concatenate([array_of(r) for r in parts]) if len(parts) > 1 else array_of(parts[0])
        dims = [d["name"] for d in parts[0]["dims"]]
        dims = dims if len(dims) == data.ndim else [f"{name}_{k}" for k in range(data.ndim)]
        out[name] = (dims, data, {k: v for k, v in dict(parts[0]["attrs"] or []).items() if k not in shared}, parts[0]["dtype"])
    return encoded(out, shared)


def as_raster(rows: list[dict], offset: float) -> bytes:
    rows.sort(key=lambda r: (r["frame"] or 0, r["origin"] or []))
    return b"".join((np.array(r["data"]) - offset).round().clip(0, 255).astype(np.uint8).tobytes() for r in rows)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(GridSource)
    return spark


def read_datasets(spark: SparkSession, path: str, variables: Sequence[str] = (), partitions: int | None = None, nan_missing: bool = False, **options: str) -> DataFrame:
    """Tiles of all datasets at ``path``: a folder, a file, or a text file that lists URIs."""
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = registered(spark).read.format("grid").options(path=path, variables=",".join(variables), nanmissing=str(nan_missing).lower(), pushdown=pushdown, **options)
    return (reader if partitions is None else reader.option("partitions", partitions)).load()


def variable_names(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``dataset, variable, dtype, dims, attrs`` of the datasets at ``path``, from their headers."""
    return read_datasets(spark, path, metadata="true", **options).select("dataset", "variable", "dtype", "dims", "attrs")


def write_datasets(tiles: DataFrame, path: str, kind: str = "netcdf", **options: str) -> None:
    """A file for each dataset in the folder ``path``; a dataset's tiles meet in one task."""
    registered(tiles.sparkSession)
    rows = tiles.select("dataset", "variable", "frame", "dtype", "origin", "shape", "data", "dims", "attrs")
    rows.repartition("dataset").sortWithinPartitions("dataset", "variable", "frame", "origin").write.format("grid").options(path=path, kind=kind, **options).mode("append").save()
