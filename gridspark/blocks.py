"""Rank-two grids of numbers in blocks: whole lines, a band of them a row.

The cell form (:mod:`gridspark.grid`) takes any element and any column function. This form is for
what built-in functions cannot do at the speed of memory: stencils, maps and folds over large
planes of numbers. A row is a band of ``lines`` lines as one binary value, and a task works on it
as a NumPy matrix that Arrow hands over without a copy a cell. Bands are independent but for
their rims: for a stencil each band sends its first and last lines to its neighbours, so the
shuffle carries the rims twice and each band once, whatever the kernel, and nothing is ever
gathered in one task. Bands that are generated compute their own rims instead, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import Grid
from .operators.stencil import Stencil
from .sources.generate import packed

#: Cells of a band if nothing else is said: 4 MB of double precision.
CELLS = 1 << 19
SCHEMA = "band long, data binary"
_OUT = pa.schema([("band", pa.int64()), ("data", pa.binary())])

Make = Callable[[np.ndarray, np.ndarray], np.ndarray]


class BlockGrid:
    """An (height, width) plane: rows (band, data), with ``lines`` lines a band and one NumPy type.

    ``make`` generates the values of any lines, where the plane is generated and not stored.
    """

    def __init__(self, df: DataFrame | None, extent: tuple[int, int], lines: int, kind: str = "float64", make: Make | None = None, spark: SparkSession | None = None):
        self.extent, self.lines, self.kind, self.make = extent, lines, kind, make
        self.spark = spark or df.sparkSession
        self._df = df

    @property
    def bands(self) -> int:
        return -(-self.extent[0] // self.lines)

    @property
    def df(self) -> DataFrame:
        """Rows (band, data)."""
        if self._df is None:
            self._df = self._run(self.spark.range(0, self.bands, 1, self._tasks()).withColumnRenamed("id", "band"), 0, 0, lambda m, y: m)
        return self._df

    def _tasks(self) -> int:
        return max(1, min(self.bands, 4 * self.spark.sparkContext.defaultParallelism))

    def _span(self, band: int) -> tuple[int, int]:
        return band * self.lines, min(self.extent[0], (band + 1) * self.lines)

    def _run(self, bands: DataFrame, above: int, below: int, f: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
        """Applies ``f(lines with rims, first line)`` to generated bands."""
        make, lines, (h, w), kind = self.make, self.lines, self.extent, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for band in batch.column(0).to_pylist():
                    a, b = band * lines, min(h, (band + 1) * lines)
                    ys = np.clip(np.arange(a - above, b + below), 0, h - 1)
                    got = f(np.asarray(make(ys[:, None], np.arange(w)[None, :]), kind), a)
                    yield pa.RecordBatch.from_arrays([pa.array([band]), pa.array([np.ascontiguousarray(got).tobytes()], pa.binary())], schema=_OUT)

        return bands.mapInArrow(run, SCHEMA)

    # Sources and sinks

    @staticmethod
    def generate(spark: SparkSession, extent: tuple[int, int], make: Make, kind: str = "float64", lines: int | None = None) -> BlockGrid:
        """The plane of ``make(line numbers as a column, cell numbers as a row)``; nothing is stored."""
        return BlockGrid(None, extent, lines or max(1, CELLS // max(1, extent[1])), kind, make, spark)

    @staticmethod
    def of(grid: Grid, kind: str = "float64", lines: int | None = None) -> BlockGrid:
        """A grid of numbers in blocks: cells meet once, by line and then by band."""
        h, w = grid.extent
        lines = lines or max(1, CELLS // max(1, w))
        rows = packed(grid.with_value(grid.value.cast("double")))
        bands = rows.select(F.floor(F.col("i0") / lines).alias("band"), "i0", "vs")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            band, held = None, []
            for batch in batches:
                for b, vs in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    if band is not None and b != band:
                        yield pa.RecordBatch.from_arrays([pa.array([band]), pa.array([np.vstack(held).astype(kind).tobytes()], pa.binary())], schema=_OUT)
                        held = []
                    band = b
                    held.append(vs.values.to_numpy(zero_copy_only=False))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([band]), pa.array([np.vstack(held).astype(kind).tobytes()], pa.binary())], schema=_OUT)

        dealt = bands.repartition("band").sortWithinPartitions("band", "i0")
        return BlockGrid(dealt.mapInArrow(pack, SCHEMA), (h, w), lines, kind)

    def cells(self) -> Grid:
        """The plane as rows (i0, i1, v)."""
        lines, (_, w), kind = self.lines, self.extent, self.kind

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for band, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    m = np.frombuffer(data.as_buffer(), kind).reshape(-1, w)
                    for k in range(0, len(m), max(1, 65536 // max(1, w))):
                        part = m[k : k + max(1, 65536 // max(1, w))]
                        y = np.repeat(band * lines + k + np.arange(len(part)), w)
                        x = np.tile(np.arange(w), len(part))
                        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(x), pa.array(part.ravel().astype("float64"))], names=["i0", "i1", "v"])

        return Grid(self.df.mapInArrow(unpack, "i0 long, i1 long, v double"), self.extent)

    def persist(self) -> BlockGrid:
        """Evaluates the plane into executors' memory and disk."""
        rows = self.df.persist()
        rows.count()
        return BlockGrid(rows, self.extent, self.lines, self.kind)

    # Operators

    def map(self, f: Callable[..., np.ndarray], *others: BlockGrid, kind: str | None = None) -> BlockGrid:
        """``f`` of whole bands, of this plane and others of one extent; others are joined by band.

        Maps of a generated plane stay generated.
        """
        if any(o.extent != self.extent or o.lines != self.lines for o in others):
            raise ValueError("planes of one extent and band are mapped together")
        planes = [self, *others]
        out = kind or self.kind
        if all(p.make is not None for p in planes):
            makes = [(p.make, p.kind) for p in planes]
            return BlockGrid(None, self.extent, self.lines, out, lambda y, x: f(*[np.asarray(m(y, x), k) for m, k in makes]), self.spark)
        rows = self.df.withColumnRenamed("data", "d0")
        for i, o in enumerate(others, 1):
            rows = rows.join(o.df.withColumnRenamed("data", f"d{i}"), "band")
        kinds, w = [p.kind for p in planes], self.extent[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    got = f(*[np.frombuffer(batch.column(1 + j)[i].as_buffer(), k).reshape(-1, w) for j, k in enumerate(kinds)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([np.ascontiguousarray(got, out).tobytes()], pa.binary())], schema=_OUT)

        return BlockGrid(rows.mapInArrow(run, SCHEMA), self.extent, self.lines, out)

    def windows(self, above: int, below: int, f: Callable[[np.ndarray, int], np.ndarray], kind: str | None = None) -> BlockGrid:
        """``f(lines with rims, first line)`` of each band with some lines above and below it; beyond the plane the nearest line counts."""
        out = kind or self.kind
        if self.make is not None:
            rows = self._run(self.spark.range(0, self.bands, 1, self._tasks()).withColumnRenamed("id", "band"), above, below, lambda m, y: f(m, y).astype(out))
            return BlockGrid(rows, self.extent, self.lines, out)
        if max(above, below) > self.lines:
            raise ValueError(f"a band of {self.lines} lines is shorter than the rim")
        lines, (h, w), kind_in, last = self.lines, self.extent, self.kind, self.bands - 1
        size = np.dtype(kind_in).itemsize * w
        # A band goes to itself whole, its first lines to the band above, its last lines to the band below.
        whole = self.df.select("band", F.lit(1).alias("part"), "data")
        parts = [whole]
        if above:
            parts.append(self.df.where(F.col("band") < last).select((F.col("band") + 1).alias("band"), F.lit(0).alias("part"), F.expr(f"substring(data, greatest(1, length(data) - {above * size} + 1), {above * size})").alias("data")))
        if below:
            parts.append(self.df.where("band > 0").select((F.col("band") - 1).alias("band"), F.lit(2).alias("part"), F.expr(f"substring(data, 1, {below * size})").alias("data")))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionAll(p)
        rows = rows.repartition(self._tasks(), "band").sortWithinPartitions("band", "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            band, held = None, {}

            def done() -> pa.RecordBatch:
                body = held[1]
                top = held.get(0, body[:1])
                bottom = held.get(2, body[-1:])
                top = np.concatenate([np.repeat(top[:1], max(0, above - len(top)), 0), top[len(top) - min(above, len(top)) :]])
                bottom = np.concatenate([bottom[: min(below, len(bottom))], np.repeat(bottom[-1:], max(0, below - len(bottom)), 0)])
                got = f(np.concatenate([top, body, bottom]), band * lines)
                return pa.RecordBatch.from_arrays([pa.array([band]), pa.array([np.ascontiguousarray(got, out).tobytes()], pa.binary())], schema=_OUT)

            for batch in batches:
                for b, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if band is not None and b != band:
                        yield done()
                        held = {}
                    band = b
                    held[part] = np.frombuffer(data.as_buffer(), kind_in).reshape(-1, w)
            if held:
                yield done()

        return BlockGrid(rows.mapInArrow(run, SCHEMA), self.extent, self.lines, out)

    @staticmethod
    def sums(stencils: Sequence[Stencil], f: Callable[..., np.ndarray] | None = None, kind: str = "float64") -> tuple[int, int, Callable[[np.ndarray, int], np.ndarray]]:
        """The rims and the work of :meth:`windows` for the weighted sums of stencils, clamped at the border."""
        if any(s.step is not None for s in stencils):
            raise ValueError("only weighted sums are taken over blocks")
        taps = [t for s in stencils for t, _ in s.taps] or [(0, 0)]
        above, below = max(0, -min(t[0] for t in taps)), max(0, max(t[0] for t in taps))
        left, right = max(0, -min(t[1] for t in taps)), max(0, max(t[1] for t in taps))
        plans = [[(dy + above, dx + left, c) for (dy, dx), c in s.taps] for s in stencils]
        put = f or (lambda *vs: vs[0])

        def work(m: np.ndarray, y: int) -> np.ndarray:
            h, w = len(m) - above - below, m.shape[1]
            wide = np.concatenate([np.repeat(m[:, :1], left, 1), m, np.repeat(m[:, -1:], right, 1)], 1).astype(kind)
            sums = []
            for plan in plans:
                total = np.zeros((h, w), kind)
                step = np.empty((h, w), kind)
                for dy, dx, c in plan:
                    part = wide[dy : dy + h, dx : dx + w]
                    if c in (1, -1):  # no product
                        (np.add if c == 1 else np.subtract)(total, part, out=total)
                    else:
                        np.multiply(part, c, out=step)
                        total += step
                sums.append(total)
            return put(*sums)

        return above, below, work

    def convolve(self, stencils: Sequence[Stencil], f: Callable[..., np.ndarray] | None = None, kind: str = "float64") -> BlockGrid:
        """The weighted sums of stencils, clamped at the border, put together by ``f``; their rims are exchanged once."""
        return self.windows(*self.sums(stencils, f, kind), kind)

    def chain(self, *stages: tuple[int, int, Callable[[np.ndarray, int], np.ndarray], str]) -> BlockGrid:
        """Several :meth:`windows`, given as (above, below, f, kind), with one exchange of rims.

        A band computes the lines of a stage that the next ones need itself. At every stage the
        nearest line counts for lines beyond the plane. Bands shorter than all rims together take
        the stages one by one.
        """
        above, below, h = sum(s[0] for s in stages), sum(s[1] for s in stages), self.extent[0]
        if self.make is None and max(above, below) > self.lines:
            out = self
            for stage in stages:
                out = out.windows(*stage)
            return out

        def work(m: np.ndarray, y: int) -> np.ndarray:
            first = y - above
            for more, _, f, kind in stages:
                first += more
                m = f(m, first).astype(kind, copy=False)
                if first < 0 or first + len(m) > h:
                    m = m[np.clip(np.arange(first, first + len(m)), 0, h - 1) - first]
            return m

        return self.windows(above, below, work, stages[-1][3])

    def fold(self, each: Callable[[np.ndarray, int], np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """A parallel walk: ``each(band, first line)`` gives a state, ``join`` merges them; one state a task reaches the driver."""
        lines, (_, w), kind, make, (h, _) = self.lines, self.extent, self.kind, self.make, self.extent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for batch in batches:
                for i, band in enumerate(batch.column(0).to_pylist()):
                    if make is not None:
                        ys = np.arange(band * lines, min(h, (band + 1) * lines))
                        m = np.asarray(make(ys[:, None], np.arange(w)[None, :]), kind)
                    else:
                        m = np.frombuffer(batch.column(1)[i].as_buffer(), kind).reshape(-1, w)
                    got = np.asarray(each(m, band * lines))
                    state = got if state is None else join(state, got)
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array([state.dtype.str]), pa.array([state.tobytes()], pa.binary())], names=["t", "s"])

        rows = self.df if make is None else self.spark.range(0, self.bands, 1, self._tasks()).withColumnRenamed("id", "band")
        out = None
        for r in rows.mapInArrow(run, "t string, s binary").collect():
            got = np.frombuffer(r["s"], r["t"])
            out = got if out is None else join(out, got)
        return out

    def histogram(self, bins: int, scale: float) -> np.ndarray:
        """Counters of ``truncate(v * scale)``."""
        return self.fold(lambda m, y: np.bincount((m.ravel() * scale).astype(np.int64), minlength=bins), lambda a, b: a + b)
