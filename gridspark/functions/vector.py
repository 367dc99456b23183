"""Fixed vectors: arrays whose length is known on the driver, unrolled into expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(*parts) -> Column:
    """A vector literal of columns or values."""
    return F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it.

    Composed expressions are trees, so a function that names its argument several times doubles
    them at every step without this.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def named(*parts: Column) -> Column:
    """The same as a struct with fields c0, c1, ..; compared field by field."""
    return F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)])


def zeros(n: int, like: str = "double") -> Column:
    return F.array_repeat(F.lit(0).cast(like), n)


def sel(v: Column, i: int) -> Column:
    return v.getItem(i)


def parts(v: Column, n: int) -> list[Column]:
    return [v.getItem(i) for i in range(n)]


def vmap(f: Callable[[Column], Column], v: Column) -> Column:
    return F.transform(v, f)


def vzip(f: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    return F.zip_with(a, b, f)


def apply(fs: Sequence[Callable[[Column], Column]], v: Column) -> Column:
    """Each function on its own component."""
    return F.array(*[f(v.getItem(i)) for i, f in enumerate(fs)])


def vsum(v: Column, n: int) -> Column:
    return reduce(lambda a, b: a + b, parts(v, n))


def generate(n: int, f: Callable[[int], Column]) -> Column:
    return F.array(*[f(i) for i in range(n)])


def ifoldl(index: Any, step: Callable[[Any], Any], f: Callable[[Any, Any, Column], Any], start: Any, v: Column, n: int) -> Any:
    """A left fold over components with a running index of the caller's own; unrolled on the driver."""
    for x in parts(v, n):
        start = f(start, index, x)
        index = step(index)
    return start
