"""The image pipelines over planes in blocks: the same results as :mod:`gridspark.plans.recipes` on numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..blocks import BlockGrid
from ..operators import connect, stencil
from .recipes import BINOMIAL, BLUR, BLUR_SUM, HORIZ, NEG_DIAG, NO_EDGE, NO_ORIENT, POS_DIAG, SOBEL_X, SOBEL_Y, STRONG, VERT, WEAK


def luminosity(red: BlockGrid, green: BlockGrid, blue: BlockGrid) -> BlockGrid:
    """0.21 r + 0.71 g + 0.07 b, toward zero, as a byte."""
    return red.map(lambda a, b, c: (0.21 * a + 0.71 * b + 0.07 * c).astype(np.int64) & 255, green, blue, kind="int16")


def contrast(plane: BlockGrid, amount: float) -> BlockGrid:
    c = 1.02 * (amount + 1.0) / (1.02 - amount)
    return plane.map(lambda m: np.clip(c * (m - 0.5) + 0.5, 0.0, 1.0))


def blur(plane: BlockGrid) -> BlockGrid:
    """The 5 x 5 blur."""
    return plane.convolve([stencil.dim2(BLUR)], lambda s: s / BLUR_SUM)


Stage = tuple[int, int, Callable[[np.ndarray, int], np.ndarray], str]


def _blurred() -> Stage:
    row = [int(x) for x in BINOMIAL.split()]

    def work(m: np.ndarray, y: int) -> np.ndarray:
        wide = np.concatenate([m[:, :1], m[:, :1], m, m[:, -1:], m[:, -1:]], 1).astype(np.int32)
        w, h = m.shape[1], len(m) - 4
        along = sum(c * wide[:, k : k + w] for k, c in enumerate(row))
        return sum(c * along[k : k + h] for k, c in enumerate(row)) / 256.0

    return 2, 2, work, "float64"


def _turned(low: int) -> Stage:
    def put(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
        mag = np.sqrt(gx * gx + gy * gy).astype(np.int64) & 255
        flat = gx == 0
        ratio = np.divide(gy, gx, out=np.zeros_like(gx), where=~flat)
        a = np.abs(ratio)
        br = 0.596227 * a
        turn = (br + a * a) / (1.0 + br + (br + a * a))
        slanted = np.where(ratio < 0, NEG_DIAG, POS_DIAG)
        orient = np.where(flat, np.where(gy < 0, NEG_DIAG, POS_DIAG), np.where(turn < 0.33, HORIZ, np.where(turn > 0.66, VERT, slanted)))
        return mag * 256 + np.where(mag < low, NO_ORIENT, orient)

    return *BlockGrid.sums([stencil.dim2(SOBEL_X), stencil.dim2(SOBEL_Y)], put), "int32"


def _peaks(extent: tuple[int, int], high: int) -> Stage:
    h, w = extent

    def work(m: np.ndarray, y: int) -> np.ndarray:
        mag, orient = m // 256, m[1:-1] % 256
        wide = np.pad(mag, ((0, 0), (1, 1)), mode="edge")
        at = lambda dy, dx: wide[1 + dy : len(wide) - 1 + dy, 1 + dx : 1 + dx + w]
        here = at(0, 0)
        best = np.zeros(here.shape, bool)
        for mark, a, b in ((HORIZ, (0, -1), (0, 1)), (VERT, (-1, 0), (1, 0)), (NEG_DIAG, (-1, -1), (1, 1)), (POS_DIAG, (-1, 1), (1, -1))):
            best |= (orient == mark) & (here > at(*a)) & (here > at(*b))
        best[:, [0, -1]] = False
        lines = y + np.arange(len(here))
        best[(lines == 0) | (lines == h - 1)] = False
        return np.where(best, np.where(here < high, WEAK, STRONG), NO_EDGE)

    return 1, 1, work, "int16"


def blur_separable(plane: BlockGrid) -> BlockGrid:
    """1-4-6-4-1 along lines and across them, in one exchange of rims."""
    return plane.windows(*_blurred())


def gradient(plane: BlockGrid, low: int) -> BlockGrid:
    """Size and direction as one number a cell, ``mag * 256 + orient``."""
    return plane.windows(*_turned(low))


def suppress(packed: BlockGrid, high: int) -> BlockGrid:
    """Weak and strong edges of :func:`gradient`; the rim stays 0."""
    return packed.windows(*_peaks(packed.extent, high))


def edges(red: BlockGrid, green: BlockGrid, blue: BlockGrid, low: int = 50, high: int = 100) -> BlockGrid:
    """Weak and strong edges of an image: blur, gradient and suppression in one exchange of rims."""
    return luminosity(red, green, blue).chain(_blurred(), _turned(low), _peaks(red.extent, high))


def labels(m: np.ndarray) -> np.ndarray:
    """The least cell number of the 8-connected component of each marked cell of a band, -1 elsewhere; in logarithmic rounds."""
    h, w = m.shape
    at = np.flatnonzero(m)
    place = np.full(h * w, -1, np.int64)
    place[at] = np.arange(len(at))
    y, x = at // w, at % w
    pairs = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        ok = (y + dy < h) & (x + dx >= 0) & (x + dx < w)
        to = place[(at[ok] + dy * w + dx)]
        pairs.append(np.stack([np.flatnonzero(ok)[to >= 0], to[to >= 0]]))
    a, b = np.concatenate(pairs, 1)
    root = np.arange(len(at))
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low < high
        if not apart.any():
            break
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:  # every root is followed to its end
            up = root[root]
            if (up == root).all():
                break
            root = up
    out = np.full(h * w, -1, np.int64)
    out[at] = at[root]
    return out.reshape(h, w)


def hysteresis(marks: BlockGrid, start: tuple[int, int] | None = None, end: tuple[int, int] | None = None) -> BlockGrid:
    """255 for marked cells that are 8-connected to a strong one of a range (by default within the rim), 0 elsewhere.

    Each band labels its own cells; labels that meet where two bands touch are linked, and the
    components of these links, a table of labels on rims, tell which labels burn. Only rims and
    labels on them are exchanged.
    """
    (h, w), lines, kind = marks.extent, marks.lines, marks.kind
    (top, left), (bottom, right) = start or (1, 1), end or (h - 1, w - 1)
    marks = BlockGrid(connect.kept(marks.df), marks.extent, lines, kind)  # read twice

    def read(band: int, data: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
        """The marks of a band and the labels that are strong by themselves."""
        m = np.frombuffer(data.as_buffer(), kind).reshape(-1, w)
        of = labels(m)
        strong = m == STRONG
        x, y = np.arange(w), band * lines + np.arange(len(m))
        strong[:, (x < left) | (x >= right)] = False
        strong[(y < top) | (y >= bottom)] = False
        return of, np.unique(of[strong])

    def rims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                of, strong = read(band, data)
                for line in sorted({0, len(of) - 1}):
                    x = np.flatnonzero(of[line] >= 0)
                    node = of[line][x]
                    cols = (np.full(len(x), band * lines + line), x, node + band * lines * w, np.isin(node, strong))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["y", "x", "node", "strong"])

    rim = connect.kept(marks.df.mapInArrow(rims, "y long, x long, node long, strong boolean"))
    below = rim.where(F.col("y") % lines == lines - 1).select(F.col("node").alias("u"), (F.col("y") + 1).alias("y"), F.explode(F.array(*[F.col("x") + d for d in (-1, 0, 1)])).alias("x"))
    links = below.join(rim.select("y", "x", F.col("node").alias("v")), ["y", "x"]).select("u", "v").distinct()
    owned = rim.select("node", "strong").distinct().join(connect.components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lit = owned.join(owned.where("strong").select("root").distinct(), "root", "left_semi").where("not strong")
    # A band has at most two lines of labels.
    lists = lit.groupBy(F.floor(F.floor(F.col("node") / w) / lines).alias("band")).agg(F.collect_set("node").alias("lit"))
    rows = marks.df.join(lists, "band", "left").select("band", "data", "lit")

    def burn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, data, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                of, strong = read(band, data)
                hot = np.concatenate([strong, np.array(more or [], np.int64) - band * lines * w])
                out = np.where((of >= 0) & np.isin(of, hot), STRONG, NO_EDGE).astype("int16")
                yield pa.RecordBatch.from_arrays([pa.array([band]), pa.array([out.tobytes()], pa.binary())], names=["band", "data"])

    return BlockGrid(rows.mapInArrow(burn, "band long, data binary"), marks.extent, lines, "int16")


def canny(red: BlockGrid, green: BlockGrid, blue: BlockGrid, low: int = 50, high: int = 100) -> BlockGrid:
    """Edges of an image of planes in 0..255, with hysteresis."""
    return hysteresis(edges(red, green, blue, low, high))


def equalize(plane: BlockGrid) -> BlockGrid:
    """Values in 0..1 by their rank; the histogram has 256 counters."""
    cdf = np.cumsum(plane.histogram(256, 255.99))
    n = plane.extent[0] * plane.extent[1]
    return plane.map(lambda m: (cdf[(m * 255).astype(np.int64)] - cdf[0]) / (n - cdf[0]))
