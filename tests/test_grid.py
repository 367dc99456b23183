import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import shape as sh
from gridspark.blocks import BlockGrid
from gridspark.functions import elem, vector
from gridspark.grid import Grid
from gridspark.operators import flow, load, stencil, walk
from gridspark.plans import planes, recipes
from gridspark.sources import generate as gen
from gridspark.sources import images


def line(spark, xs, kind="bigint"):
    return gen.from_list(spark, len(xs), xs, kind)


def table(spark, a, kind="bigint"):
    a = np.asarray(a)
    return gen.from_list(spark, a.shape, a.ravel().tolist(), kind)


def back(g):
    return np.array(g.to_list()).reshape(g.extent)


def clamped(a, kernel):
    (y0, _), (x0, _) = stencil.offsets(len(kernel)), stencil.offsets(len(kernel[0]))
    h, w = a.shape
    out = np.zeros(a.shape, a.dtype)
    for y in range(h):
        for x in range(w):
            out[y, x] = sum(c * a[min(max(y + y0 + i, 0), h - 1), min(max(x + x0 + j, 0), w - 1)] for i, row in enumerate(kernel) for j, c in enumerate(row))
    return out


def test_lists(spark):
    g = gen.from_list(spark, (2, 3), [1, 2, 3, 4, 5, 6], "bigint")
    assert g.to_list() == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        gen.from_list(spark, (2, 3), [1, 2], "bigint")
    assert gen.from_list(spark, 0, [], "bigint").to_list() == []


def test_maps_compose_without_a_join(spark):
    g = line(spark, [1, 2, 3])
    got = flow.dzip(lambda a, b: a + b, flow.dmap(lambda v: v * 2, g), flow.imap(lambda i, v: v * i, g))
    assert got.to_list() == [2, 6, 12]
    assert "Join" not in got.df._jdf.queryExecution().optimizedPlan().toString()


def test_zip_takes_the_common_extent(spark):
    a, b = line(spark, [1, 2, 3]), line(spark, [10, 20, 30, 40, 50])
    got = flow.dzip(lambda x, y: x + y, a, b)
    assert got.extent == (3,) and got.to_list() == [11, 22, 33]
    with pytest.raises(ValueError):
        flow.dzip(lambda x, y: x, a, b, strict=True)
    wide, tall = table(spark, [[1, 2, 3]]), table(spark, [[10, 20], [30, 40]])
    assert flow.dzip(lambda x, y: x + y, wide, tall).to_list() == [11, 22]


def test_products(spark):
    assert back(flow.cart_product2(lambda a, b: a + b, line(spark, [1, 2]), line(spark, [10, 20, 30]))).tolist() == [[11, 21, 31], [12, 22, 32]]
    with pytest.raises(ValueError):
        flow.cart_product2(lambda a, b: a, table(spark, [[1]]), line(spark, [1]))


def test_large_products_are_dealt_out(spark, monkeypatch):
    n = 4200
    g = Grid(spark.range(n, numPartitions=1).select(F.col("id").alias("i0"), (F.col("id") % 70 * 7919 % 1009 - 500).alias("v")), n)
    rows = flow.cart_product2(lambda a, b: a * b, g, g.settled()).df
    assert rows.rdd.getNumPartitions() > 8
    got = rows.agg(F.count("*"), F.countDistinct("i0"), F.sum(F.col("v") * (F.col("i0") + 3 * F.col("i1")))).first()
    i = np.arange(n)
    v = i % 70 * 7919 % 1009 - 500
    assert tuple(got) == (n * n, n, 4 * int((i * v).sum()) * int(v.sum()))
    monkeypatch.setattr(flow, "PAIRS", 8)
    monkeypatch.setattr(flow, "TILE", 2)
    small = flow.icart_product2(lambda i, j, a, b: i + 10 * j + F.coalesce(a * b, F.lit(-1)), line(spark, [4, None, 4, 5]), line(spark, [1, 2, 3]))
    assert back(small).tolist() == [[i + 10 * j + (x * y if x else -1) for j, y in enumerate([1, 2, 3])] for i, x in enumerate([4, None, 4, 5])]
    maps = flow.dmap(lambda x: F.create_map(F.lit("k"), x), line(spark, [1, 2, 3, 4]))
    assert back(flow.cart_product2(lambda a, b: a["k"] * b, maps, line(spark, [10, 20, 30]))).tolist() == [[x * y for y in (10, 20, 30)] for x in (1, 2, 3, 4)]


def test_folds_are_ordered(spark):
    g, zero = line(spark, [1, 2, 3]), F.lit(0).cast("bigint")
    assert walk.reduce_l(lambda a, x: a * 10 + x, zero, g).first()[0] == 123
    assert walk.reduce_r(lambda x, a: a * 10 + x, zero, g).first()[0] == 321
    assert walk.walk_p(lambda a, x: a + x, zero, lambda a, b: a + b, g, 2).first()[0] == 6


def test_inner_reductions(spark):
    g = table(spark, [[1, 2, 3], [4, 5, 6]])
    assert walk.reduce_inner(F.sum, g).to_list() == [6, 15]
    cube = gen.from_list(spark, (2, 2, 2), list(range(8)), "bigint")
    assert back(walk.reduce_inner(F.sum, cube)).tolist() == [[1, 5], [9, 13]]
    assert walk.fold_inner(lambda a, x: a * 10 + x, lambda y: y, g).to_list() == [123, 1456]


def test_scan_and_histogram(spark):
    assert walk.scan(line(spark, [1, 0, 2])).to_list() == [1, 1, 3]
    assert walk.mutate(line(spark, [5, 5, 1]), lambda i, v: v, 7).to_list() == [0, 1, 0, 0, 0, 2, 0]


def test_scan_over_bands(spark, monkeypatch):
    monkeypatch.setattr(walk, "BAND", 3)
    xs = list(range(1, 12))
    assert walk.scan(line(spark, xs)).to_list() == np.cumsum(xs).tolist()


def test_line_stencils(spark):
    g = line(spark, [1, 2, 3])
    assert stencil.convolve([stencil.dim1("1 2 1")], g).to_list() == [5, 8, 11]
    assert stencil.convolve([stencil.dim1("1 1")], g).to_list() == [3, 5, 6]
    assert stencil.convolve([stencil.dim1("1 0 -1")], line(spark, [0, 1, 0])).to_list() == [-1, 0, 1]


def test_line_stencils_over_bands(spark, monkeypatch):
    xs = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7])
    want = clamped(xs[None, :], [[1, 4, 6, 4, 1]])[0].tolist()
    monkeypatch.setattr(stencil, "BAND", 4)
    assert stencil.convolve([stencil.dim1("1 4 6 4 1")], line(spark, xs.tolist())).to_list() == want


@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (2, 2), (3, 5), (6, 4)])
def test_plane_stencils(spark, shape):
    a = np.arange(shape[0] * shape[1]).reshape(shape) ** 2 % 17
    for text in (recipes.SOBEL_X, recipes.BLUR, "1 2 | 3 4"):
        kernel = [[int(x) for x in row.split()] for row in text.split("|")]
        want = clamped(a, kernel).tolist()
        assert back(stencil.convolve([stencil.dim2(text)], table(spark, a))).tolist() == want
        assert back(stencil.convolve_by_joins(stencil.dim2(text), table(spark, a))).tolist() == want


def test_stencil_range_and_center(spark):
    a = np.arange(20).reshape(4, 5) ** 2
    g, s = table(spark, a), stencil.dim2(recipes.SOBEL_X)
    want = clamped(a, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    got = stencil.convolve([s], g, block=((0, 1), (2, 4))).df.orderBy("i0", "i1").collect()
    assert [r["v"] for r in got] == want[0:2, 1:4].ravel().tolist()
    c = stencil.just_center(s, g)
    assert c.extent == (2, 3) and back(c).tolist() == want[1:3, 1:4].tolist()
    with pytest.raises(ValueError):
        stencil.dim2([[1, 2], [3]])


def test_border(spark):
    got = stencil.convolve([stencil.dim1("1 0 1")], line(spark, [1, 2, 3]), border=lambda i, v: F.lit(100).cast("bigint"))
    assert got.to_list() == [102, 4, 102]


def test_loads_and_writes(spark):
    g = table(spark, [[1, 2], [3, 4]])
    zeros = flow.dmap(lambda v: v * 0, g)
    assert load.range_load(g, zeros, (0, 1), (2, 2)).to_list() == [0, 2, 0, 4]
    other = gen.new_empty(spark, (2, 2))
    assert load.range_load(g, other, (1, 0), (2, 2)).to_list() == [0, 0, 3, 4]
    assert load.load(line(spark, [7]), line(spark, [1, 2])).to_list() == [7, 2]
    assert g.write(spark.createDataFrame([(0, 1, None)], "i0 bigint, i1 bigint, v bigint")).to_list() == [1, None, 3, 4]
    for how in ("persist", "checkpoint"):
        if how == "checkpoint":
            spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
        assert g.compute(how).to_list() == [1, 2, 3, 4]


def test_checked_mode(spark):
    g = line(spark, [1, 2]).check()
    assert g.read(1) == 2
    with pytest.raises(IndexError):
        g.at(2)
    with pytest.raises(IndexError):
        g.at_linear(-1)
    with pytest.raises(Exception, match="out of extent"):
        g.write(spark.createDataFrame([(5, 1)], "i0 bigint, v bigint")).df.collect()
    with pytest.raises(Exception, match="uninitialized"):
        gen.new(spark, 2, checked=True).to_list()
    assert gen.new(spark, 2).to_list() == [None, None]


def test_vectors(spark):
    g = line(spark, [[1, 2, 3], [4, 5, 6]], "array<bigint>")
    assert flow.zip_elems(lambda a, b, c: a + b * c, 3, g).to_list() == [7, 34]
    assert [s.to_list() for s in g.slices(3)] == [[1, 4], [2, 5], [3, 6]]
    assert gen.from_slices(g.slices(3)).to_list() == [[1, 2, 3], [4, 5, 6]]
    assert flow.dmap(lambda v: vector.apply([lambda x: x + 1, lambda x: x * 2], v), g).to_list() == [[2, 4], [5, 10]]
    assert stencil.convolve_slices(stencil.dim1("1 1"), 3, g).to_list() == [[5, 7, 9], [8, 10, 12]]


def test_scalars(spark):
    xs = line(spark, [-0.5, 0.5, 1.5, float("nan")], "double")
    assert flow.dmap(lambda v: elem.clamp(0.0, 1.0, v), xs).to_list() == [0.0, 0.5, 1.0, 1.0]
    assert flow.dmap(elem.to_byte, line(spark, [260.7, -3.2], "double")).to_list() == [4, 253]
    grey = line(spark, [[255.0, 255.0, 255.0]], "array<double>")
    assert flow.zip_elems(lambda r, g, b: elem.to_byte(recipes.luminosity(r, g, b)), 3, grey).to_list() == [252]


def test_gathers(spark):
    g = table(spark, [[1, 2, 3], [4, 5, 6]])
    assert back(flow.reindex(g, (3, 2), lambda y, x: (x, y))).tolist() == [[1, 4], [2, 5], [3, 6]]
    got = flow.traverse((2,), [lambda y: (y, F.lit(0)), lambda y: (y, F.lit(9))], lambda y, a, b: F.coalesce(b, a * 10), g)
    assert got.to_list() == [10, 40]


def test_colours(spark):
    g = line(spark, [[0.5, 0.5, 0.5], [1.0, 0.0, 0.0], [0.2, 0.4, 0.9]], "array<double>")
    hsl = flow.dmap(recipes.rgb2hsl, g)
    got = hsl.to_list()
    assert got[0] == [0.0, 0.0, 0.5] and got[1] == [0.0, 1.0, 0.5]
    assert np.allclose(flow.dmap(recipes.hsl2rgb, hsl).to_list(), g.to_list())
    assert flow.dmap(lambda v: recipes.contrast(0.5, v), line(spark, [0.0, 0.5, 1.0], "double")).to_list() == [0.0, 0.5, 1.0]


def test_orientation_and_suppression(spark):
    up = np.repeat(np.array([[100], [50], [0], [0], [0]]), 5, axis=1)
    got = recipes.gradient(table(spark, up), 1).df.where("i0 = 1 and i1 = 2").first()["v"]
    assert (got["mag"], got["orient"]) == (400 & 255, recipes.POS_DIAG)
    flat = recipes.suppress(recipes.gradient(table(spark, np.zeros((4, 4), int)), 0), 10)
    assert set(flat.to_list()) == {0}


def test_wildfire(spark):
    e = [[0, 0, 0, 0, 0, 0], [0, 255, 128, 0, 0, 0], [0, 0, 0, 128, 0, 0], [0, 0, 0, 0, 0, 0], [0, 128, 0, 0, 0, 0], [0, 0, 0, 0, 0, 255]]
    got = back(recipes.wildfire(table(spark, e, "int"))).tolist()
    assert got == [[0, 0, 0, 0, 0, 0], [0, 255, 255, 0, 0, 0], [0, 0, 0, 255, 0, 0], [0] * 6, [0] * 6, [0] * 6]


def test_wildfire_along_a_spiral(spark):
    """One strong cell at the end of an edge of some 2,000 cells, over cells and over bands."""
    n = 66
    m = np.zeros((n, n), int)
    y, x, dy, dx, low, high = 1, 1, 0, 1, [1, 1], [n - 2, n - 2]
    m[y, x] = 128
    while True:
        ny, nx = y + dy, x + dx
        ahead = m[min(max(ny + dy, 0), n - 1), min(max(nx + dx, 0), n - 1)]
        if not (1 <= ny <= n - 2 and 1 <= nx <= n - 2) or ahead or m[ny, nx]:
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            ahead = m[min(max(ny + dy, 0), n - 1), min(max(nx + dx, 0), n - 1)]
            if not (1 <= ny <= n - 2 and 1 <= nx <= n - 2) or ahead or m[ny, nx]:
                break
        y, x = ny, nx
        m[y, x] = 128
    m[y, x] = 255
    assert (m > 0).sum() > 2000
    g = gen.from_list(spark, (n, n), m.ravel().tolist(), "int")
    want = np.where(m > 0, 255, 0)
    assert (np.array(recipes.wildfire(g).to_list()).reshape(n, n) == want).all()
    fired = planes.hysteresis(BlockGrid.of(g, lines=5))
    assert (np.array(fired.cells().to_list()).reshape(n, n) == want).all()


def test_hysteresis_of_random_marks(spark):
    rng = np.random.default_rng(31)
    for h, w, lines in ((23, 17, 4), (9, 30, 1), (5, 5, 9)):
        m = rng.choice([0, 0, 128, 255], (h, w), p=[0.4, 0.25, 0.33, 0.02])
        found, todo = set(), [(y, x) for y in range(1, h - 1) for x in range(1, w - 1) if m[y, x] == 255]
        while todo:
            y, x = todo.pop()
            if (y, x) in found or not (0 <= y < h and 0 <= x < w) or not m[y, x]:
                continue
            found.add((y, x))
            todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        want = [255 if (y, x) in found else 0 for y in range(h) for x in range(w)]
        g = gen.from_list(spark, (h, w), m.ravel().tolist(), "int")
        assert planes.hysteresis(BlockGrid.of(g, lines=lines)).cells().to_list() == want
        assert recipes.wildfire(g).to_list() == want


def test_walks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(walk, "BLOCK", 7)
    monkeypatch.setattr(walk, "FAN", 3)
    text = "".join(chr(97 + i * 7 % 26) for i in range(500))
    g = gen.from_list(spark, 500, list(text), "string")
    put = lambda a, b: F.concat(a, b)
    assert walk.walk_p(put, F.lit(""), put, g).first()["r"] == text
    assert walk.walk_p(put, F.lit(""), put, g, start=(33,), end=(402,)).first()["r"] == text[33:402]
    assert walk.walk_p(put, F.lit(""), put, g, start=(5,), end=(5,)).first()["r"] == ""


def test_equalize(spark):
    got = recipes.equalize(line(spark, [0.0, 0.5, 1.0, 1.0], "double")).to_list()
    assert np.allclose(got, [0.0, 1 / 3, 1.0, 1.0])


def test_motion(spark):
    m, dt, gravity, soft = [5.9722e24, 1.8986e27, 1.9889e30], 864000.0, 6.67384e-11, 0.25
    p = np.array([[1.470983e11, 0, 0], [-7.405736e11, 0, 0], [0, 0, 0]])
    v = np.array([[2.694354528161541e03, 3.016946927465788e04, 0], [-1.0965244901087316e02, -1.3710001990210707e04, 0], [0, 0, 0]])
    gm = line(spark, m, "double")
    gp, gv = line(spark, p.tolist(), "array<double>"), line(spark, v.tolist(), "array<double>")
    got, _ = recipes.motion(dt, 2, gm, gp, gv, keep_each=1)
    for _ in range(2):
        f = np.zeros((3, 3))
        for i in range(3):
            for j in range(3):
                if i != j:
                    d = p[i] - p[j]
                    a = 1 / ((d * d).sum() + soft)
                    f[i] += d * (-gravity * m[i] * m[j] * a * np.sqrt(a))
        v = v + f * dt / np.array(m)[:, None]
        p = p + v * dt
    assert np.allclose(got.to_list(), p, rtol=1e-12)


def test_images(spark, tmp_path):
    a = np.arange(2 * 3 * 3).reshape(2, 3, 3) * 9
    g = gen.from_list(spark, (2, 3), a.reshape(6, 3).tolist(), "array<int>")
    path = f"{tmp_path}/t.png"
    images.write_image(g, path, "rgb")
    got = images.read_image(spark, path)
    assert got.layout in images.LAYOUTS and got.grid.extent == (2, 3)
    assert images.read_rgb_vectors(got).to_list() == a.reshape(6, 3).tolist()
    grey = gen.from_list(spark, (2, 2), [1, 2, 3, 4], "int")
    images.write_image(grey, f"{tmp_path}/g.png", "grey")
    assert images.read_rgb(lambda r, g, b: r + g + b, images.read_image(spark, f"{tmp_path}/g.png")).to_list() == [3, 6, 9, 12]


def test_checked_flag_is_kept(spark):
    g = line(spark, [1, 2]).check()
    assert flow.dmap(lambda v: v + 1, g).checked and isinstance(g.slices(0), list)
    assert sh.size(Grid(g.df, (2,)).extent) == 2
