"""Element-wise flow: maps, zips, products, component-wise variants and gathers.

Every operator takes Python functions from columns to columns. Variants that differ in the
reference model only by effects or injectivity are one function here, with aliases.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shape as sh
from ..grid import Grid, aligned, zipped
from ..sources.generate import cells

Fn = Callable[..., Column]

#: Cells of the second array, and pairs, that a task of a large product goes over.
TILE, PAIRS = 128, 1 << 24


def dmap(f: Fn, g: Grid) -> Grid:
    """``f`` of each element; composes into the projection, no job and no copy."""
    return g.with_value(f(g.value))


def imap(f: Fn, g: Grid) -> Grid:
    """``f(i0, .., element)``."""
    return g.with_value(f(*g.index, g.value))


def lookup(g: Grid, key: Fn, table: Grid, f: Fn) -> Grid:
    """A map whose function reads another, rank-one grid: ``f(element, table[key(element)])``.

    Spark broadcasts the table if its size is under the session's threshold and shuffles beyond it.
    """
    left, name = g.own()
    right = table.renamed("__found").withColumnRenamed("i0", "__at")
    both = left.join(right, key(F.col(name)).cast("long") == F.col("__at"), "left").drop("__at")
    return Grid(both, g.extent, f(F.col(name), F.col("__found")), g.checked)


def map_elems(f: Fn, g: Grid) -> Grid:
    """``f`` of every component of every vector."""
    return g.with_value(F.transform(g.value, f))


def dmap_elems(fs: Sequence[Fn], g: Grid) -> Grid:
    """A function a component."""
    return g.with_value(F.array(*[f(g.value.getItem(k)) for k, f in enumerate(fs)]))


def zip_elems(f: Fn, n: int, g: Grid) -> Grid:
    """``f(c0, .., cn-1)`` of each vector: vector to scalar."""
    return g.with_value(f(*[g.value.getItem(k) for k in range(n)]))


def dzip(f: Fn, *grids: Grid, strict: bool = False) -> Grid:
    """``f`` of the elements at one index; the extent is the common one (``strict``: all must agree)."""
    return zipped(f, grids, strict)


def izip(f: Fn, *grids: Grid, strict: bool = False) -> Grid:
    """:func:`dzip` with the index first."""
    base, extent, values = aligned(grids, strict)
    return Grid(base, extent, f(*[F.col(n) for n in grids[0].names], *values), any(g.checked for g in grids))


def dzip_elems(fs: Sequence[Fn], *grids: Grid) -> Grid:
    """Function k on component k of every grid; there may be fewer functions than components."""
    return dzip(lambda *vs: F.array(*[f(*[v.getItem(k) for v in vs]) for k, f in enumerate(fs)]), *grids)


def cart_product2(f: Fn, a: Grid, b: Grid) -> Grid:
    """The rank-two grid of ``f(a[i], b[j])``. Its result has a row a pair: the operator is a product by definition."""
    return icart_product2(lambda i, j, x, y: f(x, y), a, b)


def icart_product2(f: Fn, a: Grid, b: Grid) -> Grid:
    """:func:`cart_product2` with the indices first.

    A product of more than ``PAIRS`` is dealt out in tiles, a task each, whatever files its arrays
    come from. A tile's cells are neighbours by value, and it goes over the same few of ``b`` for
    each of ``a``: the pairs are the same, but files of them repeat themselves and pack better.
    """
    _only_rank_one(a, b)
    left, x = a.own()
    right, y = b.own()
    right = right.withColumnRenamed("i0", "i1")
    if a.extent[0] * b.extent[0] > PAIRS:
        left = _dealt(left, -(-a.extent[0] * TILE // PAIRS), x, "i0")
        right = _dealt(right, -(-b.extent[0] // TILE), y, "i1").hint("shuffle_replicate_nl")
    both = left.crossJoin(right)
    return Grid(both, (*a.extent, *b.extent), f(F.col("i0"), F.col("i1"), F.col(x), F.col(y)))


def cart_product3(f: Fn, a: Grid, b: Grid, c: Grid) -> Grid:
    """The rank-three grid of ``f(a[i], b[j], c[k])``."""
    return icart_product3(lambda i, j, k, x, y, z: f(x, y, z), a, b, c)


def icart_product3(f: Fn, a: Grid, b: Grid, c: Grid) -> Grid:
    """:func:`cart_product3` with the indices first."""
    _only_rank_one(a, b, c)
    left, x = a.own()
    mid, y = b.own()
    right, z = c.own()
    both = left.crossJoin(mid.withColumnRenamed("i0", "i1")).crossJoin(right.withColumnRenamed("i0", "i2"))
    return Grid(both, (*a.extent, *b.extent, *c.extent), f(*[F.col(n) for n in ("i0", "i1", "i2", x, y, z)]))


def _dealt(rows: DataFrame, n: int, value: str, index: str) -> DataFrame:
    """The rows in ``n`` parts of about one size, by value where values have an order."""
    kind = rows.schema[value].dataType.simpleString()
    return rows.repartitionByRange(n, *[value] * ("map<" not in kind and "variant" not in kind), index)


def _only_rank_one(*grids: Grid) -> None:
    if any(g.rank != 1 for g in grids):
        raise ValueError("products take grids of rank one")


def reindex(g: Grid, extent: Sequence[int], to: Callable[..., Sequence[Column]]) -> Grid:
    """A gather that moves each source cell to at most one place: ``to(i0, ..)`` gives its index.

    Transposes, shifts, flips and crops need no join; cells moved outside are dropped.
    """
    ext = sh.shape(extent)
    rows, name = g.own()
    moved = rows.select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(to(*g.index))], name)
    return Grid(moved.where(sh.inside_column((sh.zero(len(ext)), ext), [F.col(f"i{k}") for k in range(len(ext))])), ext, name, g.checked)


def traverse(extent: Sequence[int], sources: Sequence[Callable[..., Sequence[Column]]], f: Fn, g: Grid) -> Grid:
    """The general gather: cell ``i`` of the new extent is ``f(i0, .., values)`` of the source at each of ``sources(i0, ..)``.

    A source index outside the old extent reads NULL. One equi-join a source.
    """
    ext = sh.shape(extent)
    out = cells(g.spark, ext).drop("pos")
    names = [f"i{k}" for k in range(len(ext))]
    values = []
    for source in sources:
        rows, name = g.own("t")
        keys = [f"{name}_k{k}" for k in range(g.rank)]
        for old, key in zip(g.names, keys, strict=True):
            rows = rows.withColumnRenamed(old, key)
        wanted = source(*[F.col(n) for n in names])
        match = F.lit(True)
        for c, key in zip(wanted, keys, strict=True):
            match = match & (c.cast("long") == F.col(key))
        out = out.join(rows, match, "left").drop(*keys)
        values.append(F.col(name))
    return Grid(out, ext, f(*[F.col(n) for n in names], *values))


def map_slices(f: Callable[[Grid], Grid], n: int, g: Grid) -> Grid:
    """A whole-grid transform of each component; results are put together again."""
    from ..sources.generate import from_slices

    return from_slices([f(s) for s in g.slices(n)])


def convert(g: Grid, n: int, names: Sequence[str]) -> Grid:
    """Vectors as structs with the given field names."""
    return g.with_value(F.struct(*[g.value.getItem(k).alias(names[k]) for k in range(n)]))


fmap = fmap_m = dmap_m = dmap
fimap = fimap_m = imap_m = imap
map_elems_m = map_elems
fmap_elems = fmap_elems_m = dmap_elems_m = dmap_elems
fzip2 = fzip2_m = fzip3 = fzip3_m = fzip = fzip_m = dzip2 = dzip2_m = dzip3 = dzip3_m = dzip_m = dzip_with = dzip_with3 = dzip
fizip2 = fizip2_m = fizip3 = fizip3_m = fizip = fizip_m = izip2 = izip2_m = izip3 = izip3_m = izip_m = izip
fzip_elems2 = fzip_elems2_m = fzip_elems3 = fzip_elems3_m = fzip_elems = fzip_elems_m = dzip_elems
dzip_elems2 = dzip_elems2_m = dzip_elems3 = dzip_elems3_m = dzip_elems_m = dzip_elems
icart_product2_m, icart_product3_m = icart_product2, icart_product3
unsafe_map_slices = map_slices
