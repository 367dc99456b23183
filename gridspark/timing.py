"""Timing of jobs: single runs, means with deviations, minima, per component, in ms and ns a cell."""

from __future__ import annotations

import logging
import time as clock
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import sqrt

from . import shape as sh
from .grid import Grid

log = logging.getLogger("gridspark")


def report(message: str) -> None:
    """A line of the engine's log."""
    log.info("%s", message)


def fail(message: str) -> None:
    """An error of the engine's own."""
    raise RuntimeError(f"gridspark: {message}")


def stat(samples: Sequence[float]) -> tuple[float, float]:
    """Mean and population standard deviation."""
    mean = sum(samples) / len(samples)
    return mean, sqrt(sum((x - mean) ** 2 for x in samples) / len(samples))


def time_io(job: Callable[[], object]) -> tuple[object, int]:
    """A job's result and its nanoseconds."""
    start = clock.perf_counter_ns()
    out = job()
    return out, clock.perf_counter_ns() - start


@dataclass
class Result:
    """Mean (or minimum) and deviation of some runs over a number of cells."""

    label: str
    repeats: int
    cells: int
    ns: float
    deviation_ns: float = 0.0

    @property
    def ms(self) -> float:
        return self.ns / 1e6

    @property
    def ns_per_cell(self) -> float:
        return self.ns / max(1, self.cells)

    def __str__(self) -> str:
        return f"{self.label}: {self.ms:.3g} ± {self.deviation_ns / 1e6:.2g} ms, {self.ns_per_cell:.3g} ns a cell ({self.repeats} runs)"


def run(grid: Grid) -> None:
    """Computes every cell and keeps none."""
    grid.df.write.format("noop").mode("overwrite").save()


def bench(label: str, repeats: int, extent: sh.Shape, job: Callable[[], object]) -> Result:
    """The mean of some runs."""
    mean, deviation = stat([time_io(job)[1] for _ in range(repeats)])
    out = Result(label, repeats, sh.size(extent), mean, deviation)
    report(str(out))
    return out


def bench_min(label: str, repeats: int, extent: sh.Shape, job: Callable[[], object]) -> Result:
    """The fastest of some runs."""
    out = Result(label, repeats, sh.size(extent), min(time_io(job)[1] for _ in range(repeats)))
    report(str(out))
    return out


def time(label: str, extent: sh.Shape, job: Callable[[], object]) -> object:
    """A job's result; its time goes to the log."""
    out, ns = time_io(job)
    report(str(Result(label, 1, sh.size(extent), ns)))
    return out


def bench_slices(label: str, repeats: int, grid: Grid, n: int) -> list[Result]:
    """:func:`bench` of each component of a grid of vectors."""
    return [bench(f"{label} {k}", repeats, grid.extent, lambda part=part: run(part)) for k, part in enumerate(grid.slices(n))]


def time_slices(label: str, grid: Grid, n: int) -> list[Result]:
    return bench_slices(label, 1, grid, n)
