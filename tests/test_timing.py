import pytest

from gridspark import timing
from gridspark.sources import generate as gen


def test_stat_is_the_population_deviation():
    assert timing.stat([1, 3]) == (2.0, 1.0)


def test_results(spark, caplog):
    g = gen.from_list(spark, 2, [[1, 2], [3, 4]], "array<bigint>")
    got = timing.bench_slices("parts", 2, g, 2)
    assert [r.cells for r in got] == [2, 2] and all(r.ns > 0 and r.ns_per_cell == r.ns / 2 for r in got)
    assert timing.bench_min("fast", 3, (4,), lambda: None).repeats == 3
    assert timing.time("one", (1,), lambda: 7) == 7 and "ns a cell" in str(got[0])
    with pytest.raises(RuntimeError):
        timing.fail("no")
