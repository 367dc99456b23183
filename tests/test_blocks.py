import numpy as np
import pytest

from gridspark.blocks import BlockGrid
from gridspark.operators import stencil
from gridspark.plans import recipes
from gridspark.sources import generate as gen

from .test_grid import clamped

KERNELS = [recipes.SOBEL_X, recipes.BLUR, "1 2 | 3 4", "1 2 1"]


def make(y, x):
    return (y * 7 + x * x) % 23


def matrix(g):
    return np.array(g.cells().to_list()).reshape(g.extent)


@pytest.mark.parametrize("extent", [(1, 1), (2, 3), (7, 5), (10, 4)])
def test_stencils_over_bands(spark, extent):
    want = make(np.arange(extent[0])[:, None], np.arange(extent[1])[None, :])
    made = BlockGrid.generate(spark, extent, make, lines=2)
    stored = BlockGrid(made.df, extent, 2)
    assert matrix(made).tolist() == want.tolist()
    for text in KERNELS:
        kernel = [[int(v) for v in row.split()] for row in text.split("|")]
        for plane in (made, stored):
            assert matrix(plane.convolve([stencil.dim2(text)])).tolist() == clamped(want, kernel).tolist()


def test_to_and_from_cells(spark):
    a = np.arange(35).reshape(7, 5)
    g = BlockGrid.of(gen.from_list(spark, (7, 5), a.ravel().tolist(), "bigint"), lines=3)
    assert g.bands == 3 and matrix(g).tolist() == a.tolist()


def test_maps_and_folds(spark):
    g = BlockGrid.generate(spark, (9, 4), make, lines=4)
    stored = BlockGrid(g.df, (9, 4), 4)
    want = make(np.arange(9)[:, None], np.arange(4)[None, :])
    for a, b in ((g, g), (stored, stored.map(lambda m: m)), (g, stored)):
        assert matrix(a.map(lambda p, q: p * 2 + q, b)).tolist() == (3 * want).tolist()
    for plane in (g, stored):
        assert plane.histogram(23, 1.0).tolist() == np.bincount(want.ravel(), minlength=23).tolist()
    with pytest.raises(ValueError):
        g.map(lambda p, q: p, BlockGrid.generate(spark, (8, 4), make, lines=4))


def test_several_stencils_share_one_exchange(spark):
    g = BlockGrid.generate(spark, (6, 6), make, lines=2)
    got = matrix(g.convolve([stencil.dim2(recipes.SOBEL_X), stencil.dim2(recipes.SOBEL_Y)], lambda a, b: a * 100 + b))
    a = make(np.arange(6)[:, None], np.arange(6)[None, :])
    x, y = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[1, 2, 1], [0, 0, 0], [-1, -2, -1]]
    assert got.tolist() == (clamped(a, x) * 100 + clamped(a, y)).tolist()


def test_pipelines_match_the_cell_form(spark):
    from pyspark.sql import functions as F

    from gridspark.functions import elem
    from gridspark.operators import flow
    from gridspark.plans import planes

    extent, rng = (9, 8), np.random.default_rng(3)
    rgb = rng.integers(0, 256, (9, 8, 3))
    image = gen.from_list(spark, extent, rgb.reshape(-1, 3).tolist(), "array<int>")
    channels = [BlockGrid.of(c, lines=4) for c in image.slices(3)]
    grey = flow.zip_elems(lambda r, g, b: elem.to_byte(recipes.luminosity(r.cast("double"), g.cast("double"), b.cast("double"))).cast("int"), 3, image)
    want = recipes.suppress(recipes.gradient(recipes.blur_separable(grey), 20), 60).to_list()
    assert matrix(planes.edges(*channels, 20, 60)).ravel().astype(int).tolist() == want
    level = flow.dmap(lambda v: v.cast("double") / F.lit(255.0), image.slices(3)[0])
    assert np.allclose(matrix(planes.equalize(BlockGrid.of(level, lines=4))).ravel(), recipes.equalize(level).to_list())
    assert np.allclose(matrix(planes.blur(channels[0])).ravel(), recipes.blur(image.slices(3)[0]).to_list())
    assert np.allclose(matrix(planes.contrast(BlockGrid.of(level, lines=4), 0.5)).ravel(), flow.dmap(lambda v: recipes.contrast(0.5, v), level).to_list())


@pytest.mark.parametrize("height", [1, 5, 9, 13])
def test_chains_match_separate_windows(spark, height):
    extent, text = (height, 6), ["1 2 | 3 4 | 5 6", recipes.BLUR, "0 1 0 | 0 0 2 | 3 0 0"]
    made = BlockGrid.generate(spark, extent, make, lines=4)
    want = make(np.arange(height)[:, None], np.arange(6)[None, :])
    for t in text:
        want = clamped(want, [[int(v) for v in row.split()] for row in t.split("|")])
    for lines in (2, 4, 5):  # the first is shorter than the rims
        made = BlockGrid.generate(spark, extent, make, lines=lines)
        for plane in (made, BlockGrid(made.df, extent, lines)):
            got = plane.chain(*[(*BlockGrid.sums([stencil.dim2(t)]), "float64") for t in text])
            assert matrix(got).tolist() == want.tolist()
