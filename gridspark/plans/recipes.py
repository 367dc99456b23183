"""Pipelines over images and bodies, composed of grid operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import shape as sh
from ..blocks import BlockGrid
from ..functions import elem, vector
from ..grid import Grid
from ..operators import connect, flow, stencil, walk

# Kernels, orientation and edge marks, colour weights, constants of motion.
BLUR = "2 4 5 4 2 | 4 9 12 9 4 | 5 12 15 12 5 | 4 9 12 9 4 | 2 4 5 4 2"
BLUR_SUM = 159
BINOMIAL = "1 4 6 4 1"
SOBEL_X = "-1 0 1 | -2 0 2 | -1 0 1"
SOBEL_Y = "1 2 1 | 0 0 0 | -1 -2 -1"
NO_ORIENT, POS_DIAG, VERT, NEG_DIAG, HORIZ = 0, 64, 128, 192, 255
NO_EDGE, WEAK, STRONG = 0, 128, 255
GRAVITY, SOFTENING2 = 6.67384e-11, 0.25


def luminosity(r: Column, g: Column, b: Column) -> Column:
    """The weights sum to 0.99."""
    return F.lit(0.21) * r + F.lit(0.71) * g + F.lit(0.07) * b


def contrast(amount: float, x: Column) -> Column:
    """Steeper about the middle for amounts over 0; held to 0..1."""
    c = 1.02 * (amount + 1.0) / (1.02 - amount)
    return elem.clamp(0.0, 1.0, F.lit(c) * (x - 0.5) + 0.5)


def rgb2hsl(v: Column) -> Column:
    """(r, g, b) to (h, s, l), all in 0..1; grey has neither hue nor saturation and its level as l."""
    return vector.let(v, _rgb2hsl)


def _rgb2hsl(v: Column) -> Column:
    r, g, b = vector.parts(v, 3)
    low, high = F.least(r, g, b), F.greatest(r, g, b)
    d, total = high - low, low + high
    light = total / 2.0
    sat = F.when(light <= 0.5, d / total).otherwise(d / (2.0 - total))
    hue = F.when(r == high, F.lit(1.0 / 6.0) * (g - b) / d).when(g == high, F.lit(1.0 / 6.0) * (b - r) / d + 1.0 / 3.0).otherwise(F.lit(1.0 / 6.0) * (r - g) / d + 2.0 / 3.0)
    zero = F.lit(0.0)
    return F.when(high == low, F.array(zero, zero, high)).otherwise(F.array(F.when(hue < 0, hue + 1.0).otherwise(hue), sat, light))


def hsl2rgb(v: Column) -> Column:
    """The inverse of :func:`rgb2hsl`."""
    return vector.let(v, _hsl2rgb)


def _hsl2rgb(v: Column) -> Column:
    h, s, light = vector.parts(v, 3)
    q = F.when(light < 0.5, light * (1.0 + s)).otherwise(light + s - light * s)
    p = 2.0 * light - q

    def part(x: Column) -> Column:
        t = x - F.floor(x)
        return F.when(t < 1.0 / 6.0, p + (q - p) * 6.0 * t).when(t < 0.5, q).when(t < 2.0 / 3.0, p + (q - p) * 6.0 * (F.lit(2.0 / 3.0) - t)).otherwise(p)

    return F.array(part(h + 1.0 / 3.0), part(h), part(h - 1.0 / 3.0))


def blur(g: Grid) -> Grid:
    """The 5 x 5 blur of a grid of numbers."""
    return flow.dmap(lambda v: v / F.lit(float(BLUR_SUM)), stencil.convolve([stencil.dim2(BLUR)], g))


def blur_separable(g: Grid) -> Grid:
    """The 1-4-6-4-1 blur along lines, then across them."""
    row = stencil.Stencil(2, (1, 5), stencil.dim1(BINOMIAL).taps)
    across = stencil.Stencil(2, (5, 1), tuple(((dx, dy), c) for (dy, dx), c in row.taps))
    return flow.dmap(lambda v: v / F.lit(256.0), stencil.convolve([across], stencil.convolve([row], g)))


def gradient(g: Grid, low: int) -> Grid:
    """struct<mag, orient> of bytes: the gradient's size modulo 256 and its direction in four, none below ``low``."""

    def put(gx: Column, gy: Column) -> Column:
        gx, gy = gx.cast("double"), gy.cast("double")
        mag = elem.to_byte(F.sqrt(gx * gx + gy * gy))
        # A gradient straight along an axis divides by zero: the ratio is infinite and both comparisons fail.
        flat = gx == 0
        ratio = F.when(~flat, gy / F.when(flat, F.lit(1.0)).otherwise(gx))
        r = F.abs(ratio)
        br = F.lit(0.596227) * r
        turn = (br + r * r) / (F.lit(1.0) + br + (br + r * r))
        slanted = F.when(ratio < 0, F.lit(NEG_DIAG)).otherwise(F.lit(POS_DIAG))
        orient = F.when(flat, F.when(gy < 0, F.lit(NEG_DIAG)).otherwise(F.lit(POS_DIAG))).when(turn < 0.33, F.lit(HORIZ)).when(turn > 0.66, F.lit(VERT)).otherwise(slanted)
        return F.struct(mag.cast("int").alias("mag"), F.when(mag < low, F.lit(NO_ORIENT)).otherwise(orient).cast("int").alias("orient"))

    return stencil.convolve([stencil.dim2(SOBEL_X), stencil.dim2(SOBEL_Y)], g, put)


def suppress(g: Grid, high: int) -> Grid:
    """Weak and strong edges: cells whose size exceeds both neighbours' along their direction; the rim stays 0."""
    h, w = g.extent
    names = {(dy, dx): stencil.Stencil(2, (3, 3), (((dy, dx), 1),)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}

    def put(*vs: Column) -> Column:
        at = dict(zip(names, vs, strict=True))
        m, o = at[0, 0]["mag"], at[0, 0]["orient"]
        peak = lambda a, b: (m > at[a]["mag"]) & (m > at[b]["mag"])
        best = (
            F.when(o == HORIZ, peak((0, -1), (0, 1)))
            .when(o == VERT, peak((-1, 0), (1, 0)))
            .when(o == NEG_DIAG, peak((-1, -1), (1, 1)))
            .when(o == POS_DIAG, peak((-1, 1), (1, -1)))
            .otherwise(F.lit(False))
        )
        inside = sh.inside_column(((1, 1), (h - 1, w - 1)), g.index)
        return F.when(inside & best, F.when(m < high, F.lit(WEAK)).otherwise(F.lit(STRONG))).otherwise(F.lit(NO_EDGE))

    return stencil.convolve(list(names.values()), g, put)


def wildfire(edges: Grid, start: sh.Shape | None = None, end: sh.Shape | None = None) -> Grid:
    """255 for cells with an edge that are 8-connected to a strong one (by default within the rim), 0 elsewhere.

    The grid is packed into bands of lines, which label their own cells; only labels on rims are
    linked (:func:`gridspark.plans.planes.hysteresis`).
    """
    from .planes import hysteresis

    fired = hysteresis(BlockGrid.of(edges, "int16"), start, end).cells()
    return Grid(fired.df.select("i0", "i1", F.col("v").cast("int").alias("v")), edges.extent)


def canny(image: Grid, low: int = 50, high: int = 100) -> Grid:
    """Edges of a grid of (r, g, b) in 0..255: luminosity, blur, gradient, suppression, hysteresis."""
    grey = flow.zip_elems(lambda r, g, b: elem.to_byte(luminosity(r.cast("double"), g.cast("double"), b.cast("double"))).cast("int"), 3, image)
    return wildfire(suppress(gradient(blur_separable(grey), low), high))


def histogram(g: Grid) -> Grid:
    """256 counters of values in 0..1 by ``truncate(v * 255.99)``."""
    return walk.mutate(g, lambda *a: F.floor(a[-1] * 255.99), 256)


def cumulate(hist: Grid) -> Grid:
    return walk.scan(hist)


def equalize(values: Grid) -> Grid:
    """Values by their rank: ``(cdf[truncate(v * 255)] - cdf[0]) / (n - cdf[0])``; the cdf has 256 rows."""
    cdf = cumulate(histogram(values)).settled()
    first = cdf.at(0).select(F.col("v").alias("c0"))
    rows, name = values.own()
    table = cdf.df.select(F.col("i0").alias("at"), F.col("v").alias("c"))
    one = table.join(first, F.lit(True))  # one row beside 256
    both = rows.join(F.broadcast(one), F.floor(F.col(name) * 255.0) == F.col("at"), "left")
    n = sh.size(values.extent)
    return Grid(both, values.extent, (F.col("c") - F.col("c0")).cast("double") / (F.lit(n) - F.col("c0")).cast("double"))


def equalize_lightness(image: Grid) -> Grid:
    """A grid of (r, g, b) in 0..1 with its lightness equalized."""
    hsl = flow.dmap(rgb2hsl, image)
    h, s, light = hsl.slices(3)
    return flow.dzip(lambda a, b, c: hsl2rgb(F.array(a, b, c)), h, s, equalize(light))


def forces(positions: Grid, masses: Grid) -> Grid:
    """The softened pull of all bodies on each: a product of the bodies, summed along the second axis."""
    bodies = flow.dzip(lambda p, m: F.struct(p.alias("p"), m.alias("m")), positions, masses).settled()

    def pull(i: Column, j: Column, a: Column, b: Column) -> Column:
        d = vector.vzip(lambda x, y: x - y, a["p"], b["p"])
        dist2 = sum((vector.sel(d, k) * vector.sel(d, k) for k in (1, 2)), vector.sel(d, 0) * vector.sel(d, 0))
        inv = F.lit(1.0) / (dist2 + SOFTENING2)
        size = F.lit(-GRAVITY) * a["m"] * b["m"] * inv * F.sqrt(inv)
        return F.when(i == j, vector.zeros(3)).otherwise(vector.vmap(lambda x: x * size, d))

    pairs = flow.icart_product2(pull, bodies, bodies.settled())
    return walk.reduce_inner(lambda v: F.array(*[F.sum(v.getItem(k)) for k in range(3)]), pairs)


def step_velocity(dt: float, velocities: Grid, force: Grid, masses: Grid) -> Grid:
    return flow.dzip(lambda v, f, m: vector.vzip(lambda x, y: x + y, v, vector.vmap(lambda y: y * dt / m, f)), velocities, force, masses)


def step_position(dt: float, positions: Grid, velocities: Grid) -> Grid:
    return flow.dzip(lambda p, v: vector.vzip(lambda x, y: x + y, p, vector.vmap(lambda y: y * dt, v)), positions, velocities)


def step(dt: float, masses: Grid, positions: Grid, velocities: Grid) -> tuple[Grid, Grid]:
    """Velocities first, then positions with the new velocities."""
    faster = step_velocity(dt, velocities, forces(positions, masses), masses)
    return step_position(dt, positions, faster), faster


def motion(dt: float, steps: int, masses: Grid, positions: Grid, velocities: Grid, keep_each: int = 4) -> tuple[Grid, Grid]:
    """Several steps; every few of them are checkpointed."""
    for k in range(steps):
        positions, velocities = step(dt, masses, positions, velocities)
        if (k + 1) % keep_each == 0:
            positions = Grid(connect.kept(positions.df), positions.extent)
            velocities = Grid(connect.kept(velocities.df), velocities.extent)
    return positions, velocities
