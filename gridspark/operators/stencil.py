"""Static stencils: for each cell a fixed window of neighbours and a reduction.

A kernel is read from text or given as taps; zero taps are dropped and taps of one need no
product. It is a correlation: the kernel is not flipped, and a kernel of n covers offsets
``-(n - 1) // 2 .. n // 2``.

Neighbours come from windows over one axis at a time: along a line of the innermost axis the
rows of one outer index are sorted together, and across lines those of one inner index, so a
task holds a line, never the grid. A rank-one grid is one line, so it is cut into bands of
``BAND`` cells that carry copies of their neighbours' rims. Several kernels over one grid share
the windows. A range is evaluated from the cells it needs only (:func:`convolve` with ``block``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shape as sh
from ..grid import Grid, _fresh
from ..shape import Block

BAND = 1 << 16

#: (offset along axis 0, offset along axis 1) -> coefficient; rank one uses the second alone.
Taps = dict[tuple[int, int], float]
#: Border: the value for an offset cell outside the grid, from the index columns outside and the clamped value.
Border = Callable[..., Column]


def offsets(n: int) -> tuple[int, int]:
    """First and last offset of a kernel of ``n`` cells."""
    return -((n - 1) // 2), n // 2


@dataclass(frozen=True)
class Stencil:
    """Taps, and how they are put together: ``step(acc, coefficient, value)`` from ``zero``; without a step, the weighted sum."""

    rank: int
    extent: tuple[int, int]
    taps: tuple[tuple[tuple[int, int], float], ...]
    step: Callable[[Column, float, Column], Column] | None = None
    zero: Column | None = None

    def reduce(self, at: Callable[[int, int], Column]) -> Column:
        if self.step is not None:
            out = self.zero
            for (dy, dx), c in self.taps:
                out = self.step(out, c, at(dy, dx))
            return out
        out = None
        for (dy, dx), c in self.taps:
            v = at(dy, dx)
            if out is None:
                out = v if c == 1 else -v if c == -1 else v * F.lit(c)
            else:
                out = out + v if c == 1 else out - v if c == -1 else out + v * F.lit(c)
        return F.lit(0) if out is None else out


def _taps(rows: Sequence[Sequence[float]], keep_zeros: bool = False) -> tuple:
    (y0, _), (x0, _) = offsets(len(rows)), offsets(len(rows[0]))
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("a kernel's rows have one length")
    return tuple(((y0 + y, x0 + x), c) for y, row in enumerate(rows) for x, c in enumerate(row) if c != 0 or keep_zeros)


def dim1(text: str | Sequence[float], step=None, zero=None) -> Stencil:
    """A rank-one kernel: "1 4 6 4 1", or numbers."""
    row = [int(x) for x in text.split()] if isinstance(text, str) else list(text)
    return Stencil(1, (1, len(row)), _taps([row], step is not None), step, zero)


def dim2(text: str | Sequence[Sequence[float]], step=None, zero=None) -> Stencil:
    """A rank-two kernel: a line of numbers a row (blank lines and ``|`` are skipped), or rows."""
    rows = [[int(x) for x in line.split()] for line in text.replace("|", "\n").splitlines() if line.strip()] if isinstance(text, str) else [list(r) for r in text]
    return Stencil(2, (len(rows), len(rows[0])), _taps(rows, step is not None), step, zero)


def _shifted(rows: DataFrame, axis: str, line: Sequence[str], size: int, wanted: dict[str, set[int]], names: dict[tuple[str, int], str]) -> DataFrame:
    """Adds, for each column, the values at offsets along an axis, clamped to the first and last cell of the line."""
    by = Window.partitionBy(*line).orderBy(axis)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.col(axis)
    out = {}
    for col, ds in wanted.items():
        for d in sorted(ds):
            if d == 0:
                out[names[col, d]] = F.col(col)
            elif d < 0:
                out[names[col, d]] = F.when(at + d >= 0, F.lag(col, -d).over(by)).otherwise(F.first(col).over(whole))
            else:
                out[names[col, d]] = F.when(at + d < size, F.lead(col, d).over(by)).otherwise(F.last(col).over(whole))
    return rows.withColumns(out)


def convolve(stencils: Sequence[Stencil], g: Grid, f: Callable[..., Column] | None = None, border: Border | None = None, block: Block | None = None) -> Grid:
    """The stencils' values at each cell, put together by ``f`` (one stencil: its value).

    Outside the grid the nearest cell counts, or ``border(outside index .., nearest value)``.
    With ``block`` only its cells are given, at their own indices, from the cells around it; the
    extent, and so the clamping, stays the grid's.
    """
    if any(s.rank != g.rank for s in stencils):
        raise ValueError("a stencil and its grid have one rank")
    f = f or (lambda *vs: vs[0])
    taps = {t for s in stencils for t, _ in s.taps} | {(0, 0)}
    rows, value = g.own()
    if block is not None:
        # Halo: what the block's cells reach, clamped to the grid.
        reach = [(min(t[a] for t in taps), max(t[a] for t in taps)) for a in ((1,) if g.rank == 1 else (0, 1))]
        low = tuple(max(0, min(s + r[0], n - 1)) for s, r, n in zip(block[0], reach, g.extent, strict=True))
        high = tuple(min(n, max(e + r[1], 1)) for e, r, n in zip(block[1], reach, g.extent, strict=True))
        rows = rows.where(sh.inside_column((low, high), g.index))
    names: dict[tuple[str, int], str] = {}
    last, width = g.names[-1], g.extent[-1]
    xs = {dx for _, dx in taps}
    for dx in xs:
        names[value, dx] = f"{value}_x{dx - min(xs)}"
    if g.rank == 1:
        reach = max(map(abs, xs))
        if width > BAND:
            # A band's own cells, and copies of cells that lie within reach of the next band.
            near = F.array_distinct(F.array(*[F.floor((F.col(last) + d) / BAND) for d in (-reach, 0, reach)]))
            rows = rows.withColumn("band", F.explode(near))
            rows = _shifted(rows, last, ["band"], width, {value: xs}, names).where(F.floor(F.col(last) / BAND) == F.col("band"))
        else:
            rows = _shifted(rows.withColumn("band", F.lit(0)), last, ["band"], width, {value: xs}, names)
        got = {(0, dx): names[value, dx] for dx in xs}
    else:
        outer = g.names[0]
        rows = _shifted(rows, last, [outer], width, {value: xs}, names)
        wanted = {names[value, dx]: {dy for dy, x in taps if x == dx} for dx in xs}
        for col, ys in wanted.items():
            for dy in ys:
                names[col, dy] = f"{col}_y{dy}".replace("-", "m")
        if any(dy for ys in wanted.values() for dy in ys):
            rows = _shifted(rows, outer, [last], g.extent[0], wanted, names)
        else:
            names |= {(col, 0): col for col in wanted}
        got = {(dy, dx): names[names[value, dx], dy] for dy, dx in taps}

    def at(dy: int, dx: int) -> Column:
        v = F.col(got[dy, dx])
        if border is None or (dy, dx) == (0, 0):
            return v
        index = [F.col(last) + dx] if g.rank == 1 else [F.col(g.names[0]) + dy, F.col(last) + dx]
        return F.when(sh.inside_column((sh.zero(g.rank), g.extent), index), v).otherwise(border(*index, v))

    if block is not None:
        rows = rows.where(sh.inside_column(block, g.index))
    out, kept = f(*[s.reduce(at) for s in stencils]), f"c_{next(_fresh)}"
    return Grid(rows.select(*g.names, out.alias(kept)), g.extent, kept, g.checked)


def center(stencil: Stencil, extent: Sequence[int]) -> Block:
    """The cells whose window lies within the grid."""
    spans = [offsets(n) for n in (stencil.extent[-1:] if stencil.rank == 1 else stencil.extent)]
    return tuple(-a for a, _ in spans), tuple(max(-a, n - b) for (a, b), n in zip(spans, extent, strict=True))


def just_center(stencil: Stencil, g: Grid) -> Grid:
    """The stencil on the cells whose window lies within the grid, re-based to zero."""
    low, high = center(stencil, g.extent)
    got = convolve([stencil], g, block=(low, high))
    rows, name = got.own()
    moved = rows.select(*[(F.col(n) - s).alias(n) for n, s in zip(g.names, low, strict=True)], name)
    return Grid(moved, tuple(e - s for s, e in zip(low, high, strict=True)), name, g.checked)


def convolve_slices(stencil: Stencil, n: int, g: Grid, f: Callable[[Column], Column] = lambda c: c) -> Grid:
    """The stencil on every component of a grid of vectors, in the same windows."""
    parts = lambda v: F.array(*[v.getItem(k) for k in range(n)])
    taps = [Stencil(stencil.rank, stencil.extent, ((t, 1),)) for t, _ in stencil.taps]
    weights = [c for _, c in stencil.taps]

    def put(*vs: Column) -> Column:
        out = []
        for k in range(n):
            acc = None
            for v, c in zip(vs, weights, strict=True):
                x = v.getItem(k) if c == 1 else v.getItem(k) * F.lit(c)
                acc = x if acc is None else acc + x
            out.append(f(acc))
        return F.array(*out)

    return convolve(taps, g.with_value(parts(g.value)), put)


def convolve_by_joins(stencil: Stencil, g: Grid) -> Grid:
    """The same by one gather a tap and a sum: for grids whose lines are too long to sort; linear kernels only.

    Each cell is sent, weighted, to the cells that read it (the rim cells to all that are clamped
    to them), and the parts are summed, pre-aggregated before the shuffle.
    """
    if stencil.step is not None:
        raise ValueError("only weighted sums can be taken apart")
    axes = [0, 1] if g.rank == 2 else [1]
    reach = [offsets(stencil.extent[a]) for a in axes]
    rows, name = g.own()

    def readers(axis: int, at: Column, n: int) -> Column:
        low, high = reach[axis]
        near = F.sequence(F.greatest(F.lit(0), at - high), F.least(F.lit(n - 1), at - low))
        return near

    table = {t: c for t, c in stencil.taps}
    out = rows
    for k, n in enumerate(g.extent):
        out = out.withColumn(f"o{k}", F.explode(readers(k, F.col(g.names[k]), n)))
    weight = F.lit(0.0)
    for t, c in table.items():
        hit = F.lit(True)
        for k, (a, n) in enumerate(zip(axes, g.extent, strict=True)):
            hit = hit & (F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(f"o{k}") + t[a])) == F.col(g.names[k]))
        weight = weight + F.when(hit, F.lit(float(c))).otherwise(0.0)
    sums = out.groupBy(*[f"o{k}" for k in range(g.rank)]).agg(F.sum(F.col(name) * weight).alias("v"))
    return Grid(sums.select(*[F.col(f"o{k}").alias(n) for k, n in enumerate(g.names)], "v"), g.extent)
