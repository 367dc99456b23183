"""Extents and index arithmetic: row-major, zero-based, half-open blocks, rank one to three."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

Shape = tuple[int, ...]
Block = tuple[Shape, Shape]


def shape(extent: int | Sequence[int]) -> Shape:
    """An extent as a tuple of rank one to three; no axis may be negative."""
    got = (extent,) if isinstance(extent, int) else tuple(int(x) for x in extent)
    if not 1 <= len(got) <= 3 or min(got) < 0:
        raise ValueError(f"an extent has one to three axes, none negative: {extent}")
    return got


def zero(rank: int) -> Shape:
    return (0,) * rank


def size(extent: Shape) -> int:
    return prod(extent)


def inc(index: Shape) -> Shape:
    """The next index along the innermost axis."""
    return (*index[:-1], index[-1] + 1)


def plus(a: Shape, b: Shape) -> Shape:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def minus(a: Shape, b: Shape) -> Shape:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def offset(start: Shape, end: Shape) -> Shape:
    """What leads from ``start`` to ``end``."""
    return minus(end, start)


def from_linear(extent: Shape, pos: int) -> Shape:
    """The index at a row-major offset."""
    out = []
    for n in reversed(extent[1:]):
        pos, x = divmod(pos, n)
        out.append(x)
    return (pos, *reversed(out))


def to_linear(extent: Shape, index: Shape) -> int:
    """The row-major offset of an index."""
    pos = 0
    for n, x in zip(extent, index, strict=True):
        pos = pos * n + x
    return pos


def linear_column(extent: Shape, index: Sequence[Column]) -> Column:
    """:func:`to_linear` over index columns."""
    pos = index[0]
    for n, x in zip(extent[1:], index[1:], strict=True):
        pos = pos * F.lit(n) + x
    return pos


def index_columns(extent: Shape, pos: Column) -> list[Column]:
    """:func:`from_linear` over an offset column."""
    out = []
    for n in reversed(extent[1:]):
        out.append((pos % F.lit(n)).cast("long"))
        pos = F.floor(pos / F.lit(n)).cast("long") if n else pos
    return [pos.cast("long"), *reversed(out)]


def intersect(extents: Sequence[Shape]) -> Shape:
    """The largest extent within all."""
    return tuple(min(axis) for axis in zip(*extents, strict=True))


def complement(extents: Sequence[Shape]) -> Shape:
    """The smallest extent around all."""
    return tuple(max(axis) for axis in zip(*extents, strict=True))


def intersect_blocks(blocks: Sequence[Block]) -> Block:
    starts, ends = zip(*blocks, strict=True)
    return complement(starts), intersect(ends)


def block_size(block: Block) -> int:
    return prod(max(0, e - s) for s, e in zip(*block, strict=True))


def inside_block(block: Block, index: Shape) -> bool:
    return all(s <= x < e for s, x, e in zip(block[0], index, block[1], strict=True))


def inside_column(block: Block, index: Sequence[Column]) -> Column:
    """:func:`inside_block` as a predicate that can be pushed into a scan."""
    out = F.lit(True)
    for s, x, e in zip(block[0], index, block[1], strict=True):
        out = out & (x >= s) & (x < e)
    return out


def split_points(chunks: int, start: int, end: int) -> list[int]:
    """Bounds of even chunks; the first ones are longer, and with fewer cells than chunks the last ones are empty."""
    n = max(0, end - start)
    if n < chunks:
        return [start + min(i, n) for i in range(chunks + 1)]
    each, rest = divmod(n, chunks)
    return [start + i * each + min(i, rest) for i in range(chunks + 1)]


def even_chunks(values: Sequence, chunks: int) -> list[list]:
    at = split_points(chunks, 0, len(values))
    return [list(values[a:b]) for a, b in zip(at, at[1:], strict=False)]


def chunk_range(chunks: int, start: Shape, end: Shape) -> list[Block]:
    """A block cut into even chunks along its outermost axis."""
    at = split_points(chunks, start[0], end[0])
    return [((a, *start[1:]), (b, *end[1:])) for a, b in zip(at, at[1:], strict=False)]


def clip_block(outer: Block, inner: Block) -> list[Block]:
    """The blocks of ``outer`` around ``inner``: two in rank one; four in rank two, each running on to the next corner."""
    (start, end), (low, high) = outer, inner
    if len(start) == 1:
        return [(start, low), (high, end)]
    if len(start) == 2:
        (ys, xs), (ye, xe), (yl, xl), (yh, xh) = start, end, low, high
        return [((ys, xl), (yl, xe)), ((yl, xh), (ye, xe)), ((yh, xs), (ye, xh)), ((ys, xs), (yh, xl))]
    raise ValueError("blocks are clipped in rank one and two")


def lower(extent: Shape) -> Shape:
    """The extent without its innermost axis."""
    return extent[:-1]


def inner(extent: Shape) -> int:
    return extent[-1]


def combine(outer: Shape, last: int) -> Shape:
    return (*outer, last)
