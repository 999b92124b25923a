"""Classic NetCDF files: decoding by seeks, encoding. Types, tags and layout are those of the format."""

from __future__ import annotations

import io
import struct
from collections.abc import Mapping, Sequence

import numpy as np

from fieldloom.functions.floats import number_text

# Types of a classic NetCDF file by number, and what variables of them are called.
NETCDF_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
NETCDF_NAMES = {1: "byte", 2: "char", 3: "short", 4: "int", 5: "float", 6: "double"}
# Names of types that are written as another.
WRITTEN_AS = {"byte": 1, "short": 3, "int": 4, "float": 5, "double": 6, "Double64": 6, "long": 6}
#: Bytes from which offsets need 64 bits.
WIDE = 2**31 - 1
#: Bytes that are read at once of a header and of small variables, which lie side by side.
BLOCK = 1 << 16


class ClassicFile:
    """A classic NetCDF file (CDF-1, CDF-2): dimensions, attributes and variables. Of a file, only the
    header is read; variables are read by seeks, small ones a block at a time."""

    def __init__(self, source):
        self.file = io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
        self.file.seek(0)
        self.block, self.place = b"", 0  # of the header, later of the variables
        self.kept: list[bytes] | None = None  # what is taken of the header, where that is wanted
        head = self.taken(4)
        if head[:3] != b"CDF" or head[3:] not in (b"\x01", b"\x02"):
            raise ValueError("not a classic NetCDF file")
        self.wide = head[3] == 2
        self.records = self.number()
        self.dims = [(self.name(), self.number()) for _ in range(self.tagged())]
        self.attrs = self.attributes()
        self.variables = {}
        begins = struct.Struct(">q" if self.wide else ">i")
        told, raw = (), b""  # what is told of the last variable; of many, the next one's is often the same to the byte
        for _ in range(self.tagged()):
            name = self.name()
            if not (raw and self.ahead(len(raw)) and self.block.startswith(raw, self.place)):
                self.kept = []
                told = ([self.number() for _ in range(self.number())], self.attributes(), self.number(), self.number())
                raw, self.kept = b"".join(self.kept), None
            else:
                self.place += len(raw)
            self.variables[name] = (*told, begins.unpack(self.taken(begins.size))[0])
        self.block, self.place = b"", 0

    def ahead(self, n: int) -> bool:
        """Whether ``n`` bytes more are there, and in the block."""
        if self.place + n > len(self.block):
            self.block, self.place = self.block[self.place :] + self.file.read(max(n, BLOCK)), 0
        return self.place + n <= len(self.block)

    def taken(self, n: int) -> bytes:
        if not self.ahead(n):
            raise ValueError("the header of a NetCDF file is cut short")
        found = self.block[self.place : self.place + n]
        self.place += n
        if self.kept is not None:
            self.kept.append(found)
        return found

    def number(self) -> int:
        return struct.unpack(">i", self.taken(4))[0]

    def tagged(self) -> int:
        self.number()
        return self.number()

    def padded(self, n: int) -> bytes:
        return self.taken(-(-n // 4) * 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode("utf-8")

    def attributes(self) -> dict[str, str]:
        """Text, or the first of the numbers as text."""
        out = {}
        for _ in range(self.tagged()):
            name, kind, n = self.name(), self.number(), self.number()
            raw = self.padded(n * np.dtype(NETCDF_TYPES[kind]).itemsize)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else number_text(np.frombuffer(raw, NETCDF_TYPES[kind])[0]) if n else ""
        return out

    def shape(self, name: str) -> list[int]:
        ids = self.variables[name][0]
        sizes = [self.dims[i][1] for i in ids]
        return [self.records, *sizes[1:]] if ids and sizes[0] == 0 else sizes

    def dim_names(self, name: str) -> list[str]:
        return [self.dims[i][0] for i in self.variables[name][0]]

    def numeric(self) -> list[str]:
        return [n for n, v in self.variables.items() if v[2] != 2]

    def at(self, begin: int, dtype: np.dtype, n: int) -> np.ndarray:
        size = n * dtype.itemsize
        if size >= BLOCK:
            self.file.seek(begin)
            return np.frombuffer(self.file.read(size), dtype, n)
        if not self.place <= begin <= begin + size <= self.place + len(self.block):
            self.file.seek(begin)
            self.block, self.place = self.file.read(BLOCK), begin
        return np.frombuffer(self.block, dtype, n, begin - self.place)

    def read(self, name: str, ranges: Sequence[tuple[int, int, int]] = ()) -> np.ndarray:
        """A variable, or ``(begin, end, step)`` ranges of its leading axes; only the rows of the first
        axis's range are read."""
        ids, _, kind, size, begin = self.variables[name]
        dtype, shape = np.dtype(NETCDF_TYPES[kind]), self.shape(name)
        if not ids:
            return self.at(begin, dtype, 1).reshape(())
        (low, high, step), rest = ranges[0] if ranges else (0, shape[0], 1), ranges[1:]
        low, high = max(0, low), min(shape[0], high)
        n = int(np.prod(shape[1:], dtype=np.int64))
        if self.dims[ids[0]][1] == 0:  # the record dimension: one slab every record
            slabs = [v[3] for v in self.variables.values() if v[0] and self.dims[v[0][0]][1] == 0]
            apart = n * dtype.itemsize if len(slabs) == 1 else sum(slabs)
            rows = [self.at(begin + k * apart, dtype, n) for k in range(low, high, step)]
            found = np.array(rows, dtype).reshape([len(rows), *shape[1:]])
        else:
            found = self.at(begin + low * n * dtype.itemsize, dtype, max(0, high - low) * n).reshape([max(0, high - low), *shape[1:]])[::step]
        return found[(slice(None), *[slice(a, b, c) for a, b, c in rest])]


def encoded(variables: Mapping[str, tuple], attrs: Mapping[str, str] | None = None) -> bytes:
    """A classic NetCDF file of ``name: (dimension names, array[, attributes[, type's name]])``; dimensions of one
    name are shared, and must have one length. Types are double unless named."""
    variables = {n: (tuple(v[0]), np.asarray(v[1]), dict(v[2]) if len(v) > 2 else {}, WRITTEN_AS.get(v[3], 6) if len(v) > 3 else 6) for n, v in variables.items()}

    def text(s: str) -> bytes:
        raw = s.encode("utf-8")
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def texts(found: Mapping[str, str]) -> bytes:
        return listed(12, [text(k) + struct.pack(">i", 2) + text(v) for k, v in found.items()])

    dims: dict[str, int] = {}
    for names, data, *_ in variables.values():
        for n, k in zip(names, data.shape, strict=True):
            if dims.setdefault(n, k) != k:
                raise ValueError(f"dimension {n} has two lengths")
    order = {n: k for k, n in enumerate(dims)}
    blocks = {}
    for name, (_, data, _, kind) in variables.items():
        raw = data.astype(NETCDF_TYPES[kind]).tobytes()
        blocks[name] = raw + b"\0" * (-len(raw) % 4)
    wide = sum(map(len, blocks.values())) + 1_000_000 > WIDE
    head = b"CDF" + (b"\x02" if wide else b"\x01") + struct.pack(">i", 0) + listed(10, [text(n) + struct.pack(">i", k) for n, k in dims.items()]) + texts(attrs or {})

    def described(begins: list[int]) -> bytes:
        items = []
        for (name, (names, _, own, kind)), begin in zip(variables.items(), begins, strict=True):
            size = min(len(blocks[name]), WIDE)
            items.append(text(name) + struct.pack(f">{1 + len(names)}i", len(names), *(order[x] for x in names)) + texts(own) + struct.pack(">ii", kind, size) + struct.pack(">q" if wide else ">i", begin))
        return listed(11, items)

    at, begins = len(head) + len(described([0] * len(variables))), []
    for raw in blocks.values():
        begins.append(at)
        at += len(raw)
    return head + described(begins) + b"".join(blocks.values())
