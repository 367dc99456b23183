"""Walks: ordered and parallel folds, range and component folds, histograms and inner reductions.

A fold with an arbitrary function needs its cells in order, so :func:`reduce_l` and its kin
bring the walked range to one row; they are for ranges that fit one task. Folds with an
associative join run over blocks of bounded size whose states are merged in a tree
(:func:`walk_p`), and known monoids are plain aggregates (:func:`walk`). Inner reductions are one group a line.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shape as sh
from ..grid import Grid
from ..shape import Shape

Step = Callable[..., Column]

#: Cells that a parallel fold goes over in one array, and states that are merged together.
BLOCK, FAN = 4096, 256


def _range(g: Grid, start: Shape | None, end: Shape | None) -> DataFrame:
    rows = g.df
    if start is None and end is None:
        return rows
    block = (start or sh.zero(g.rank), end or g.extent)
    return rows.where(sh.inside_column(block, g.index))


def _ordered(g: Grid, by: Sequence[str]) -> Column:
    return F.array_sort(F.collect_list(F.struct(*[F.col(n) for n in by], F.col("v"))))


def _fold(cells: Column, zero: Column, f: Step, by: Sequence[str], indexed: bool, left: bool) -> Column:
    def step(acc: Column, c: Column) -> Column:
        at = [c[n] for n in by] if indexed else []
        return f(acc, *at, c["v"]) if left else f(*at, c["v"], acc)

    return F.aggregate(cells if left else F.reverse(cells), zero, step)


def reduce_l(f: Step, zero: Column, g: Grid, start: Shape | None = None, end: Shape | None = None, indexed: bool = False) -> DataFrame:
    """One row (r): the left fold ``f(.. f(f(zero, c0), c1) .., cn)`` in row-major order; ``indexed``: ``f(acc, i0, .., c)``."""
    return _range(g, start, end).agg(_fold(_ordered(g, g.names), zero, f, g.names, indexed, True).alias("r"))


def reduce_r(f: Step, zero: Column, g: Grid, start: Shape | None = None, end: Shape | None = None, indexed: bool = False) -> DataFrame:
    """One row (r): the right fold ``f(c0, f(c1, .. f(cn, zero)))``."""
    return _range(g, start, end).agg(_fold(_ordered(g, g.names), zero, f, g.names, indexed, False).alias("r"))


def ireduce_l(f: Step, zero: Column, g: Grid, start: Shape | None = None, end: Shape | None = None) -> DataFrame:
    return reduce_l(f, zero, g, start, end, True)


def ireduce_r(f: Step, zero: Column, g: Grid, start: Shape | None = None, end: Shape | None = None) -> DataFrame:
    return reduce_r(f, zero, g, start, end, True)


def walk(g: Grid, start: Shape | None = None, end: Shape | None = None, **aggs: Column | Callable[..., Column]) -> DataFrame:
    """One row of aggregates over ``v`` and the index, whole or in a range; the range reaches the scan."""
    return _range(g, start, end).agg(*[a.alias(n) for n, a in aggs.items()])


def _merged(states: DataFrame, zero: Column, join: Step) -> Column:
    return F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", "s"))), zero, lambda a, c: join(a, c["s"]))


def walk_p(step: Step, zero: Column, join: Step, g: Grid, chunks: int | None = None, start: Shape | None = None, end: Shape | None = None, indexed: bool = False) -> DataFrame:
    """One row (r): a fold of blocks in row-major order whose states ``join``, which is associative, merges in order.

    ``zero`` must be neutral for ``join``. A block has at most ``BLOCK`` cells, or fewer so that
    there are ``chunks``; states are merged ``FAN`` at a time, so no array is longer than either.
    """
    size = sh.size(g.extent)
    each = max(1, min(BLOCK, -(-size // chunks) if chunks else BLOCK))
    rows = _range(g, start, end).withColumn("chunk", F.floor(sh.linear_column(g.extent, g.index) / each))
    states, n = rows.groupBy("chunk").agg(_fold(_ordered(g, g.names), zero, step, g.names, indexed, True).alias("s")), -(-size // each)
    while n > FAN:
        states = states.withColumn("up", F.floor(F.col("chunk") / FAN)).groupBy("up").agg(_merged(states, zero, join).alias("s")).withColumnRenamed("up", "chunk")
        n = -(-n // FAN)
    return states.agg(_merged(states, zero, join).alias("r"))


def iwalk_p(step: Step, zero: Column, join: Step, g: Grid, chunks: int | None = None, start: Shape | None = None, end: Shape | None = None) -> DataFrame:
    """:func:`walk_p` with a step that takes the index: ``step(acc, i0, .., c)``."""
    return walk_p(step, zero, join, g, chunks, start, end, True)


def walk_slices(g: Grid, n: int, agg: Callable[[Column], Column], start: Shape | None = None, end: Shape | None = None) -> DataFrame:
    """One row (r0, ..): the aggregate of each component, all in one pass."""
    return _range(g, start, end).agg(*[agg(F.col("v").getItem(k)).alias(f"r{k}") for k in range(n)])


def _each(step: Step, zero: Column, n: int) -> tuple[Step, Column]:
    """A step and a start for all components of vectors at once."""
    return lambda acc, *at: F.array(*[step(acc.getItem(k), *at[:-1], at[-1].getItem(k)) for k in range(n)]), F.array(*[zero] * n)


def _components(one: DataFrame, n: int) -> DataFrame:
    return one.select(*[F.col("r").getItem(k).alias(f"r{k}") for k in range(n)])


def walk_slices_separate(step: Step, zero: Column, g: Grid, n: int, start: Shape | None = None, end: Shape | None = None, indexed: bool = False) -> DataFrame:
    """One row (r0, ..): the ordered left fold of each component; ``indexed``: ``step(acc, i0, .., c)``."""
    f, zeros = _each(step, zero, n)
    return _components(reduce_l(f, zeros, g, start, end, indexed), n)


def walk_slices_separate_p(step: Step, zero: Column, join: Step, g: Grid, n: int, chunks: int | None = None, start: Shape | None = None, end: Shape | None = None, indexed: bool = False) -> DataFrame:
    """One row (r0, ..): :func:`walk_p` of each component, all in one pass."""
    f, zeros = _each(step, zero, n)
    both = lambda a, b: F.array(*[join(a.getItem(k), b.getItem(k)) for k in range(n)])
    return _components(walk_p(f, zeros, both, g, chunks, start, end, indexed), n)


def iwalk_slices_separate(step: Step, zero: Column, g: Grid, n: int, start: Shape | None = None, end: Shape | None = None) -> DataFrame:
    return walk_slices_separate(step, zero, g, n, start, end, True)


def iwalk_slices_separate_p(step: Step, zero: Column, join: Step, g: Grid, n: int, chunks: int | None = None, start: Shape | None = None, end: Shape | None = None) -> DataFrame:
    return walk_slices_separate_p(step, zero, join, g, n, chunks, start, end, True)


def mutate(g: Grid, bucket: Callable[..., Column], size: int, weight: Column | None = None, start: Shape | None = None, end: Shape | None = None) -> Grid:
    """A fold into a mutable rank-one array of counters: ``bucket(i0, .., v)`` is the cell that grows.

    Counters are pre-aggregated before the shuffle, so a crowded bucket is no hot key.
    """
    from ..sources.generate import from_table

    rows = _range(g, start, end).select(bucket(*g.index, F.col("v")).cast("long").alias("b"), (weight if weight is not None else F.lit(1)).alias("w"))
    sums = rows.groupBy("b").agg(F.sum("w").alias("n"))
    return from_table(sums, size, [F.col("b")], F.col("n"), 0)


def scan(g: Grid) -> Grid:
    """The inclusive running sum of a rank-one grid.

    Sums of ranges of ``BAND`` cells run over ranges, then cells run within their range, so no
    task sorts more than a range or the list of ranges.
    """
    if g.rank != 1:
        raise ValueError("a running sum takes a grid of rank one")
    rows = g.df.withColumn("band", F.floor(F.col("i0") / BAND))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("band").agg(F.sum("v").alias("s")).withColumn("base", F.sum("s").over(before)).drop("s")
    own = Window.partitionBy("band").orderBy("i0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("run", F.sum("v").over(own)).join(sums, "band")
    return Grid(out.select("i0", (F.col("run") + F.coalesce("base", F.lit(0))).alias("v")), g.extent)


BAND = 1 << 16


def wide_sum(v: Column) -> Column:
    """The sum of whole numbers of which parts may pass 64 bits; only a whole sum that does is an overflow.

    High and low halves are summed apart, which holds for up to 2^31 values.
    """
    low = F.lit(0xFFFFFFFF)
    hi, lo = F.sum(F.shiftright(v, 32)), F.sum(v.bitwiseAND(low))
    return (hi + F.shiftright(lo, 32)) * F.lit(1 << 32) + lo.bitwiseAND(low)


def reduce_inner(agg: Callable[[Column], Column], g: Grid) -> Grid:
    """Reduces the innermost axis with an aggregate of ``v`` (and the index columns).

    The documented meaning, for every rank: line by line.
    """
    outer = g.names[:-1]
    return Grid(g.df.groupBy(*outer).agg(agg(F.col("v")).alias("v")), sh.lower(g.extent))


def fold_inner(f: Step, zero: Column | Callable[..., Column], g: Grid, indexed: bool = False, left: bool = True) -> Grid:
    """Reduces the innermost axis by an ordered fold; ``zero`` may be a function of the outer index."""
    outer, last = g.names[:-1], g.names[-1:]
    rows = g.df.groupBy(*outer).agg(_ordered(g, last).alias("cells"))
    start = zero(*[F.col(n) for n in outer]) if callable(zero) else zero
    return Grid(rows.select(*outer, _fold(F.col("cells"), start, f, last, indexed, left).alias("v")), sh.lower(g.extent))


iwalk = range_walk = walk
range_walk_p = walk_p
range_walk_slices_separate, range_walk_slices_separate_p = walk_slices_separate, walk_slices_separate_p
imutate = mutate
ireduce_inner = reduce_inner
reduce_left_m, reduce_right_m = reduce_l, reduce_r
