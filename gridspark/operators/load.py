"""Loads: evaluating a grid into another, whole, in a range or by component.

Nothing is updated in place. A load gives the target with the loaded cells replaced, over the
extent that source and target share; :meth:`gridspark.grid.Grid.compute` evaluates it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shape as sh
from ..grid import Grid, same_base
from ..shape import Shape


def entire(*grids: Grid) -> Shape:
    """The range that all grids share."""
    return sh.intersect([g.extent for g in grids])


def load(source: Grid, target: Grid) -> Grid:
    """``target`` with the source's cells."""
    return range_load(source, target, sh.zero(source.rank), entire(source, target))


def range_load(source: Grid, target: Grid, start: Shape, end: Shape) -> Grid:
    """``target`` with the source's cells in ``start <= index < end``; only those are computed."""
    low, high = sh.intersect_blocks([(start, end), (sh.zero(source.rank), entire(source, target))])
    if source.checked and (low, high) != (tuple(start), tuple(end)):
        raise IndexError(f"the range {start}..{end} is out of extent {entire(source, target)}")
    if same_base([source, target]):
        return target.with_value(F.when(sh.inside_column((low, high), target.index), source.value).otherwise(target.value))
    inside = source.df.where(sh.inside_column((low, high), source.index))
    if (low, high) == (sh.zero(target.rank), target.extent):
        return Grid(inside, target.extent, "v", target.checked)
    return target.write(inside)


def load_slices(source: Grid, target: Grid, n: int, start: Shape | None = None, end: Shape | None = None) -> Grid:
    """The same component by component, in one plan."""
    got = [range_load(s, t, start or sh.zero(source.rank), end or entire(source, target)) for s, t in zip(source.slices(n), target.slices(n), strict=True)]
    if same_base(got):
        return got[0].with_value(F.array(*[g.value for g in got]))
    return range_load(source, target, start or sh.zero(source.rank), end or entire(source, target))


def each_cell(g: Grid, f: Callable[[Sequence], None]) -> None:
    """Runs ``f`` on the rows of each partition, on the executors: a sink with an effect of its own."""
    g.df.foreachPartition(f)


def save(g: Grid, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Writes the rows (i0, .., v)."""
    g.df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(path)


def restore(spark, path: str, extent: Sequence[int], fmt: str = "parquet") -> Grid:
    """A grid of saved rows."""
    return Grid(spark.read.format(fmt).load(path), sh.shape(extent))


def partitions(g: Grid, n: int) -> DataFrame:
    """The rows dealt into ``n`` ranges of the outermost axis."""
    return g.df.repartitionByRange(n, "i0")


load_p = load_s = load
range_load_p = range_load_s = range_load
load_slices_p = load_slices_s = range_load_slices_p = range_load_slices_s = load_slices
