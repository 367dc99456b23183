import pytest

from gridspark import shape as sh


def test_linear_order_is_row_major():
    assert sh.from_linear((3, 4), 5) == (1, 1)
    assert sh.to_linear((5, 5), (3, 0)) == 15
    for ext in ((7,), (3, 4), (2, 3, 4)):
        for k in range(sh.size(ext)):
            assert sh.to_linear(ext, sh.from_linear(ext, k)) == k


def test_arithmetic():
    assert sh.plus((1, 2, 3), (0, 0, 1)) == (1, 2, 4)
    assert sh.minus((1, 2), (1, 0)) == (0, 2)
    assert sh.offset((1, 0), (1, 2)) == (0, 2)
    assert sh.inc((1, 2)) == (1, 3)
    assert sh.intersect([(3, 5), (4, 2)]) == (3, 2)
    assert sh.complement([(3, 5), (4, 2)]) == (4, 5)
    assert sh.lower((2, 3)) == (2,) and sh.inner((2, 3)) == 3 and sh.combine((2,), 3) == (2, 3)


def test_splits():
    assert sh.split_points(4, 0, 10) == [0, 3, 6, 8, 10]
    assert sh.split_points(4, 0, 2) == [0, 1, 2, 2, 2]
    assert sh.even_chunks([1, 2, 3, 4, 5], 2) == [[1, 2, 3], [4, 5]]
    assert sh.chunk_range(2, (0, 0), (5, 6)) == [((0, 0), (3, 6)), ((3, 0), (5, 6))]


def test_blocks():
    assert sh.clip_block(((0,), (10,)), ((2,), (8,))) == [((0,), (2,)), ((8,), (10,))]
    got = sh.clip_block(((0, 0), (5, 6)), ((1, 1), (4, 5)))
    assert got == [((0, 1), (1, 6)), ((1, 5), (5, 6)), ((4, 0), (5, 5)), ((0, 0), (4, 1))]
    cells = [(y, x) for y in range(5) for x in range(6)]
    for c in cells:
        assert sum(sh.inside_block(b, c) for b in got) == (not sh.inside_block(((1, 1), (4, 5)), c))
    assert sum(map(sh.block_size, got)) == 30 - 12
    assert sh.intersect_blocks([((0, 0), (3, 3)), ((1, 0), (5, 2))]) == ((1, 0), (3, 2))


def test_extents_are_checked():
    for bad in ((), (1, 2, 3, 4), (-1,)):
        with pytest.raises(ValueError):
            sh.shape(bad)
