"""Grids that nothing stores: functions of the index, constants, lists and tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shape as sh
from ..grid import Grid


def cells(spark: SparkSession, extent: int | Sequence[int]) -> DataFrame:
    """A row an index: (i0, .., pos), generated in parallel."""
    ext = sh.shape(extent)
    rows = spark.range(sh.size(ext)).withColumnRenamed("id", "pos")
    return rows.select(*[c.alias(f"i{k}") for k, c in enumerate(sh.index_columns(ext, F.col("pos")))], "pos")


def from_function(spark: SparkSession, extent: int | Sequence[int], f: Callable[..., Column]) -> Grid:
    """The grid of ``f(i0, ..)``."""
    ext = sh.shape(extent)
    return Grid(cells(spark, ext), ext, f(*[F.col(f"i{k}") for k in range(len(ext))]))


def from_linear_function(spark: SparkSession, extent: int | Sequence[int], f: Callable[[Column], Column]) -> Grid:
    """The grid of ``f(row-major offset)``."""
    ext = sh.shape(extent)
    return Grid(cells(spark, ext), ext, f(F.col("pos")))


def const(spark: SparkSession, extent: int | Sequence[int], value) -> Grid:
    """A constant grid; linear and shaped constants are the same here."""
    ext = sh.shape(extent)
    return Grid(cells(spark, ext), ext, F.lit(value))


linear_const = shaped_const = const


def new(spark: SparkSession, extent: int | Sequence[int], kind: str = "double", checked: bool = False) -> Grid:
    """Cells without a value; in checked mode reading one raises."""
    ext = sh.shape(extent)
    none = F.lit(None).cast(kind)
    if checked:
        # The condition hangs on the row, so nothing is raised before a row is read.
        none = F.when(F.col("pos") >= 0, F.raise_error(F.lit("uninitialized element")).cast(kind)).otherwise(none)
    return Grid(cells(spark, ext), ext, none, checked)


def new_empty(spark: SparkSession, extent: int | Sequence[int], kind: str = "bigint") -> Grid:
    """Zeros of an integral type."""
    ext = sh.shape(extent)
    return Grid(cells(spark, ext), ext, F.lit(0).cast(kind))


def from_list(spark: SparkSession, extent: int | Sequence[int], values: Sequence, kind: str) -> Grid:
    """A grid of driver-side values in row-major order; their number must be the extent's size."""
    ext = sh.shape(extent)
    if len(values) != sh.size(ext):
        raise ValueError(f"{len(values)} values do not fill the extent {ext}")
    rows = [(*sh.from_linear(ext, k), v) for k, v in enumerate(values)]
    schema = ", ".join([f"i{k} bigint" for k in range(len(ext))] + [f"v {kind}"])
    return Grid(spark.createDataFrame(rows, schema), ext)


def from_table(df: DataFrame, extent: int | Sequence[int], index: Sequence[Column], value: Column, fill=None) -> Grid:
    """A table as a grid: a row a cell by ``index``. With ``fill``, cells without a row get it.

    Without ``fill`` the table has to be dense; no job checks that.
    """
    ext = sh.shape(extent)
    names = [f"i{k}" for k in range(len(ext))]
    rows = df.select(*[c.cast("long").alias(n) for c, n in zip(index, names, strict=True)], value.alias("v"))
    if fill is None:
        return Grid(rows, ext)
    every = cells(df.sparkSession, ext).drop("pos")
    return Grid(every.join(rows, names, "left"), ext, F.coalesce("v", F.lit(fill)))


def counted(df: DataFrame, extent: int | Sequence[int], index: Sequence[Column]) -> Grid:
    """The dense grid of row counts by an index."""
    ext = sh.shape(extent)
    keyed = df.select(*[c.cast("long").alias(f"k{k}") for k, c in enumerate(index)])
    keys = [f"k{k}" for k in range(len(ext))]
    sums = keyed.groupBy(*keys).agg(F.count("*").alias("n"))
    return from_table(sums, ext, [F.col(k) for k in keys], F.col("n"), 0)


def from_packed(df: DataFrame, extent: int | Sequence[int], index: Sequence[Column], values: Column) -> Grid:
    """A table whose rows hold the innermost axis as an array.

    A row has as many cells as the extent says: those beyond the end of its array, or without one, are NULL.
    """
    ext = sh.shape(extent)
    filled = F.transform(F.array_repeat(F.lit(0), ext[-1]), lambda _, k: F.get(values, k))
    values = F.when(F.size(values) == ext[-1], values).otherwise(filled)
    names = [f"i{k}" for k in range(len(ext) - 1)]
    last = f"i{len(ext) - 1}"
    rows = df.select(*[c.cast("long").alias(n) for c, n in zip(index, names, strict=True)], F.posexplode(values).alias(last, "v"))
    return Grid(rows.withColumn(last, F.col(last).cast("long")), ext)


def from_slices(grids: Sequence[Grid]) -> Grid:
    """Grids of one extent as a grid of vectors."""
    from ..grid import zipped

    return zipped(lambda *vs: F.array(*vs), grids, strict=True)


def packed(grid: Grid) -> DataFrame:
    """Rows (i0, .., vs): the innermost axis as an array in order."""
    last, outer = grid.names[-1], grid.names[:-1]
    pair = F.struct(F.col(last).alias("k"), F.col("v"))
    rows = grid.df.groupBy(*outer).agg(F.array_sort(F.collect_list(pair)).alias("vs"))
    return rows.select(*outer, F.transform("vs", lambda p: p["v"]).alias("vs"))
