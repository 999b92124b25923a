"""Element-wise arithmetic and masks over tiles and cells, with the names that derived variables get.

Steps on one array are composed before a single ``transform`` is emitted (``Steps``), as Spark
would run consecutive ones one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.floats import ARITHMETIC, COMPARE, as_column, number_text


@dataclass(frozen=True)
class Steps:
    """A chain of steps on each element of an array column.

    ``mask_value`` is what failing elements become; as every result is a new array, it holds for
    this chain only.
    """

    step: Callable[[Column], Column] | None = None
    mask_value: float = 0.0

    def then(self, f: Callable[[Column], Column]) -> Steps:
        before = self.step
        return Steps(f if before is None else (lambda x: f(before(x))), self.mask_value)

    def with_mask(self, value: float) -> Steps:
        return Steps(self.step, value)

    def scalar(self, op: str, s: float) -> Steps:
        return self.then(lambda x: ARITHMETIC[op](x, s))

    def keep(self, op: str, s: float) -> Steps:
        return self.mask(lambda x: COMPARE[op](x, s))

    def mask(self, test: Callable[[Column], Column], value: float | None = None) -> Steps:
        fill = F.lit(float(self.mask_value if value is None else value))
        return self.then(lambda x: F.when(test(x), x).otherwise(fill))

    def on_array(self, data: str | Column) -> Column:
        return F.col(data) if self.step is None and isinstance(data, str) else F.transform(data, self.step or (lambda x: x))

    def on_value(self, value: str | Column) -> Column:
        x = F.col(value) if isinstance(value, str) else value
        return x if self.step is None else self.step(x)


def scalar_op(tiles: DataFrame, op: str, s: float, data: str = "data") -> DataFrame:
    """``array op number``, shape and metadata kept."""
    return tiles.withColumn(data, Steps().scalar(op, s).on_array(data))


def array_op(left: DataFrame, right: DataFrame, op: str, on: Sequence[str], data: str = "data") -> DataFrame:
    """``array op array`` of tiles that agree on ``on``; names and metadata are the left's. Shapes must be
    equal: no broadcasting is implied."""
    other = right.select(*on, F.col(data).alias("__other"), F.col("shape").alias("__shape"))
    both = left.join(other, list(on))
    same = F.assert_true(F.col("shape") == F.col("__shape"), F.lit("arrays of different shape"))
    value = F.zip_with(data, "__other", lambda x, y: ARITHMETIC[op](x, y))
    return both.withColumn(data, F.when(same.isNull(), value)).drop("__other", "__shape")


def cells_op(left: DataFrame, right: DataFrame, op: str, on: Sequence[str]) -> DataFrame:
    """The same over cells, as an equi-join on the indices."""
    other = right.select(*on, F.col("value").alias("__other"))
    return left.join(other, list(on)).withColumn("value", ARITHMETIC[op](F.col("value"), F.col("__other"))).drop("__other")


def mask_cells(cells: DataFrame, op: str, s: float, mask_value: float = 0.0) -> DataFrame:
    """Keeps the shape: cells that fail become ``mask_value``."""
    return cells.withColumn("value", Steps(mask_value=mask_value).keep(op, s).on_value("value"))


def drop_cells(cells: DataFrame, op: str, s: float) -> DataFrame:
    """The sparse form of a mask: cells that fail are absent."""
    return cells.where(COMPARE[op](F.col("value"), s))


def map_elements(tiles: DataFrame, f: Callable[[Column], Column], data: str = "data") -> DataFrame:
    return tiles.withColumn(data, Steps().then(f).on_array(data))


def assign(cells: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Overwrites the cells that ``new`` has."""
    other = new.select(*on, F.col("value").alias("__new"), F.lit(True).alias("__has"))
    return cells.join(other, list(on), "left").withColumn("value", F.when(F.col("__has"), F.col("__new")).otherwise(F.col("value"))).drop("__new", "__has")


def put(cells: DataFrame, value: float, **index: int) -> DataFrame:
    """Sets one cell of every frame, as ``put(cells, 1.0, i0=2, i1=3)``."""
    here = F.lit(True)
    for name, k in index.items():
        here &= F.col(name) == k
    return cells.withColumn("value", F.when(here, as_column(value)).otherwise(F.col("value")))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def matmul(left: DataFrame, right: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Matrix product of 2-d cells: ``on, i0, i1, value``; absent cells count as 0."""
    l = left.select(*on, "i0", F.col("i1").alias("k"), F.col("value").alias("l"))  # noqa: E741
    r = right.select(*on, F.col("i0").alias("k"), "i1", F.col("value").alias("r"))
    return l.join(r, [*on, "k"]).groupBy(*on, "i0", "i1").agg(F.sum(F.col("l") * F.col("r")).alias("value"))


# Binary operations that name a derived variable; those with "=" at the end rename in place.
OPERATION_NAMES = {"+", "-", "*", "/", "**", "<", ">", "<=", ">=", ":=", "!=", "+=", "-=", "*=", "/="}


def named(x: Column | float) -> Column:
    """A variable's name, or a number as it is printed in names: ``5.0``."""
    return x if isinstance(x, Column) else F.lit(number_text(float(x)))


def binary_name(left: Column, op: str, right: Column | float) -> Column:
    """Name of a derived variable, as ``(left + right)`` or ``(left <= 5.0)``."""
    if op not in OPERATION_NAMES:
        raise ValueError(f"unknown operation {op}")
    return F.concat(F.lit("("), left, F.lit(f" {op} "), named(right), F.lit(")"))


def call_name(op: str, name: Column, *params: str) -> Column:
    """As ``mean(left,List(0))`` or ``reduceResolution(left,(2,2))``."""
    return F.concat(F.lit(f"{op}("), name, F.lit("".join(f",{p}" for p in params) + ")"))


def axis_call_name(op: str, name: Column, axes: Sequence[int]) -> Column:
    """Of a statistic over axes, or a broadcast to a shape: ``std(left,List(0, 1))``."""
    return call_name(op, name, "List(" + ", ".join(map(str, axes)) + ")")


def block_name(name: Column, rows: int, cols: int | None = None) -> Column:
    """Of both block means."""
    return call_name("reduceResolution", name, f"({rows},{rows if cols is None else cols})")


def mask_name(name: Column, mask_value: float = 0.0) -> Column:
    """Of a mask by any test."""
    return call_name("maskf", name, number_text(float(mask_value)))


def slice_name(name: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    return F.concat(name, F.lit("[" + ",".join(f"{a}:{b}" for a, b in ranges) + "]"))


def named_op(tiles: DataFrame, op: str, right: Column | float, variable: str = "variable") -> DataFrame:
    """The tiles under the name of the operation's result; dimensions and attributes stay."""
    return tiles.withColumn(variable, binary_name(F.col(variable), op, right))
