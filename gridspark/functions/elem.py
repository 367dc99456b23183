"""Scalar functions on elements: order, clamping, unsigned wrap-around and the byte scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unsigned integers as the Spark type that holds them, and the mask that wraps a value into them.
UNSIGNED = {"word8": ("smallint", 0xFF), "word16": ("int", 0xFFFF), "word32": ("bigint", 0xFFFFFFFF)}


def min_m(a: Column, b: Column) -> Column:
    return F.least(a, b)


def max_m(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def clamp(low, high, x: Column) -> Column:
    """``x`` held to low..high; the upper bound is tested first, so NaN becomes ``high``."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def wrap(x: Column, kind: str = "word8") -> Column:
    """An integer modulo the range of an unsigned type."""
    name, mask = UNSIGNED[kind]
    return x.cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")).cast(name)


def truncate(x: Column) -> Column:
    """Toward zero, as an integer."""
    return x.cast("bigint")


def to_byte(x: Column) -> Column:
    """Toward zero, then modulo 256."""
    return wrap(truncate(x))


def normalize_byte(x: Column) -> Column:
    return x.cast("double") / 255.0


def normalized_to_byte(x: Column) -> Column:
    return to_byte(x * 255.0)
