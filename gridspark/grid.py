"""A dense rectangular array as a lazy DataFrame.

A :class:`Grid` is a base DataFrame with index columns ``i0[, i1[, i2]]`` and a value, an
expression over the base. Maps and zips of grids with one base only compose expressions, so they
become one projection, and nothing runs before :meth:`Grid.compute` or an action on ``df``.
Cells are rows; the extent is known on the driver. The array is dense: a row for every index.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shape as sh
from .shape import Shape

_fresh = itertools.count()


class Grid:
    def __init__(self, base: DataFrame, extent: Shape, value: Column | str = "v", checked: bool = False):
        self.base, self.extent, self.checked = base, sh.shape(extent), checked
        self.value = F.col(value) if isinstance(value, str) else value

    @property
    def rank(self) -> int:
        return len(self.extent)

    @property
    def names(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    @property
    def index(self) -> list[Column]:
        return [F.col(n) for n in self.names]

    @property
    def df(self) -> DataFrame:
        """Rows (i0, .., v)."""
        return self.base.select(*self.names, self.value.alias("v"))

    @property
    def spark(self):
        return self.base.sparkSession

    def with_value(self, value: Column) -> Grid:
        return Grid(self.base, self.extent, value, self.checked)

    def renamed(self, name: str) -> DataFrame:
        return self.base.select(*self.names, self.value.alias(name))

    def own(self, prefix: str = "v") -> tuple[DataFrame, str]:
        """The rows with the value under a name that no other grid uses."""
        name = f"{prefix}_{next(_fresh)}"
        return self.renamed(name), name

    def settled(self) -> Grid:
        """The same grid over its own (i0, .., v) rows."""
        return Grid(self.df, self.extent, "v", self.checked)

    def check(self) -> Grid:
        """Checked mode: reads and writes outside the extent raise, and so do cells without a value."""
        return Grid(self.base, self.extent, self.value, True)

    # Point access

    def _must_hold(self, index: Shape) -> None:
        if self.checked and not sh.inside_block((sh.zero(self.rank), self.extent), index):
            raise IndexError(f"index {index} is out of extent {self.extent}")

    def at(self, *index: int) -> DataFrame:
        """The row of one cell; the index reaches the scan as a filter."""
        self._must_hold(index)
        return self.df.where(sh.inside_column((index, tuple(x + 1 for x in index)), self.index))

    def at_linear(self, pos: int) -> DataFrame:
        if self.checked and not 0 <= pos < sh.size(self.extent):
            raise IndexError(f"offset {pos} is out of extent {self.extent}")
        return self.at(*sh.from_linear(self.extent, pos))

    def read(self, *index: int) -> Any:
        """The value of one cell, on the driver."""
        row = self.at(*index).first()
        if row is None:
            raise IndexError(f"index {index} is out of extent {self.extent}")
        return row["v"]

    def write(self, updates: DataFrame) -> Grid:
        """The array with the cells of ``updates`` (i0, .., v) replaced; others keep their value."""
        held, name = updates.select(*self.names, F.col("v").alias("new")), f"old_{next(_fresh)}"
        if self.checked:
            out = F.lit(False)
            for n, x in zip(self.extent, self.index, strict=True):
                out = out | (x < 0) | (x >= n)
            held = held.withColumn("new", F.when(out, F.raise_error(F.lit(f"a write is out of extent {self.extent}"))).otherwise(F.col("new")))
        marked = held.withColumn("hit", F.lit(True))
        base = self.renamed(name).join(marked, self.names, "left")
        return Grid(base, self.extent, F.when(F.col("hit"), F.col("new")).otherwise(F.col(name)), self.checked)

    def write_linear(self, updates: DataFrame) -> Grid:
        """:meth:`write` for updates (pos, v) by row-major offset."""
        placed = updates.select(*[c.alias(n) for c, n in zip(sh.index_columns(self.extent, F.col("pos")), self.names, strict=True)], "v")
        return self.write(placed)

    def linear(self) -> DataFrame:
        """Rows (pos, v) by row-major offset."""
        return self.base.select(sh.linear_column(self.extent, self.index).alias("pos"), self.value.alias("v"))

    def to_list(self) -> list:
        """Values in row-major order, on the driver."""
        return [r["v"] for r in self.df.orderBy(*self.names).collect()]

    def to_arrow(self):
        """Rows as an Arrow table, on the driver."""
        return self.df.orderBy(*self.names).toArrow()

    # Evaluation

    def compute(self, how: str = "persist", path: str | None = None, fmt: str = "parquet") -> Grid:
        """Evaluates the grid: ``persist`` in executors' memory and disk, ``checkpoint`` to
        ``spark.checkpoint.dir`` (lineage ends, any executor may be lost), or ``write`` to ``path``."""
        if how == "persist":
            rows = self.df.persist()
            rows.count()
        elif how == "checkpoint":
            rows = self.df.checkpoint()
        elif how == "write" and path:
            self.df.write.mode("overwrite").format(fmt).save(path)
            rows = self.spark.read.format(fmt).load(path)
        else:
            raise ValueError("how is persist, checkpoint, or write with a path")
        return Grid(rows, self.extent, "v", self.checked)

    def force(self) -> Grid:
        return self.compute()

    def touch(self) -> None:
        """Nothing: the JVM keeps what is referenced."""

    def freeze(self) -> Grid:
        return self

    def thaw(self) -> Grid:
        return self

    def delay(self) -> Grid:
        return self

    # Vectors

    def slices(self, n: int) -> list[Grid]:
        """A grid a component; all share the base, so unused ones are pruned."""
        return [self.with_value(self.value.getItem(k)) for k in range(n)]

    def view(self, name: str) -> None:
        """Registers the rows for SQL."""
        self.df.createOrReplaceTempView(name)


def same_base(grids: Sequence[Grid]) -> bool:
    return all(g.base is grids[0].base for g in grids)


def aligned(grids: Sequence[Grid], strict: bool = False) -> tuple[DataFrame, Shape, list[Column]]:
    """One base for several grids, the common extent, and each grid's value over that base.

    Grids with one base need no join; others are joined on the index, which also cuts them to
    the common extent.
    """
    extent = sh.intersect([g.extent for g in grids])
    if strict and any(g.extent != extent for g in grids):
        raise ValueError(f"extents differ: {[g.extent for g in grids]}")
    if same_base(grids):
        return grids[0].base, extent, [g.value for g in grids]
    groups: list[list[int]] = []
    for k, g in enumerate(grids):
        group = next((x for x in groups if grids[x[0]].base is g.base), None)
        groups.append([k]) if group is None else group.append(k)
    values: list[Column] = [F.lit(None)] * len(grids)
    base = None
    for group in groups:
        names = [f"z_{next(_fresh)}" for _ in group]
        first = grids[group[0]]
        rows = first.base.select(*first.names, *[grids[k].value.alias(n) for k, n in zip(group, names, strict=True)])
        if first.extent != extent:
            rows = rows.where(sh.inside_column((sh.zero(len(extent)), extent), first.index))
        base = rows if base is None else base.join(rows, first.names)
        for k, n in zip(group, names, strict=True):
            values[k] = F.col(n)
    return base, extent, values


def zipped(f: Callable[..., Column], grids: Sequence[Grid], strict: bool = False) -> Grid:
    base, extent, values = aligned(grids, strict)
    return Grid(base, extent, f(*values), any(g.checked for g in grids))
