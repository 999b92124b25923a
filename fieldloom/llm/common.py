"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.tables import new_path, remove, save, shared_dir  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of text that one vectorised step handles at a time.
STEP_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES, sizes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice holds about ``limit`` bytes of text (one row at least); ``sizes``
    has the rows' bytes where the column's own are not meant."""
    if sizes is None:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def words_of(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words of each text: ``(offsets, codes, distinct)``; the words of row ``i`` are
    ``distinct[c] for c in codes[offsets[i]:offsets[i+1]]``. Null texts have none."""
    text = pc.fill_null(text.cast(pa.large_string()), "").take(pa.array(np.arange(len(text))))  # a slice, copied: kernels below misread offsets
    if lower:
        text = pc.ascii_lower(text)
    parts = pc.ascii_split_whitespace(text)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_pylist()
    if "" in distinct:  # from white space at either end
        keep = codes != distinct.index("")
        before = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
        offsets, codes = before[offsets], codes[keep]
    return offsets, codes, distinct


@functools.cache
def trimmer() -> Callable[[int], int]:
    """The C library's function that gives free memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, and after it the worker, which serves the next tasks too, gives its free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trimmer()(0)

    return run


def hashes_of(distinct: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chained(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries of ``h``."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for factor, k in zip(odd_numbers(seed, n), range(n), strict=True):
        out += h[k : len(h) - n + 1 + k] * factor
    return mixed(out)


def repeat_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether an id is null or occurs in several rows."""
    return docs.groupBy(id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).count() > 0


def numbered(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """Rows with a whole number ``name``: the id where that is unique, else a number for each id and text,
    ascending with the id (null first) and the text's hash; and whether several rows may have the same."""
    if not repeat_ids(docs, id_col):
        return docs.withColumn(name, F.col(id_col).cast("long")), False
    docs = docs.withColumn("__t", F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")))
    keys = docs.select(F.col(id_col).alias("__d"), F.col("__t").alias("__u")).distinct().orderBy(F.col("__d").asc_nulls_first(), "__u")
    order = save(keys.withColumn(name, F.monotonically_increasing_id()), "numbered-ids")  # ascends through the sorted partitions
    return docs.join(order, docs[id_col].eqNullSafe(order["__d"]) & (docs["__t"] == order["__u"])).drop("__d", "__t", "__u"), True
