"""A quality classifier on statistics of whole texts.

Each text gives ``STATS`` statistics. Random Fourier features of the standardised statistics
approximate a Gaussian kernel; ridge regression on them is solved from normal equations that
each partition sums up and ``PARTS`` tasks add to one matrix each, which the driver adds; isotonic regression on
labelled rows that the ridge has not seen turns its output into a probability.

Bounds of the fit: ``FIT`` labelled rows by hash of their id; the driver gets at most ``PARTS``
matrices however many partitions there are; calibration works on counts in ``BINS`` bins of the output over
all labelled rows of its fold.

Defined results: a null text counts as empty; empty texts have statistics (zeros) and a score.
Labels that are null are not learned from; repeated labels count each. Without any labelled
rows, or with labels of one kind, the score is the labels' mean (0.5 without any). Rows keep
their ids, null or repeated; a null id is held out. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune, written
from .langid import fold

FIT, PARTS, BINS = 200_000, 8, 2000
FEATURES, GAMMA, RIDGE, SEED = 384, 0.04, 1e-2, 11
#: Bytes whose share is a statistic of its own, and groups of them.
MARKS = [b".", b",", b"|", b"!", b"?", b"\n", b'"', b"#*$%&<>@^~", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"-_/=+:;()[]{}"]
STATS = len(MARKS) + 10
_GROUP = np.zeros(256, np.int64)
for _i, _m in enumerate(MARKS):
    _GROUP[list(_m)] = _i + 1


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a text: shares of characters and words, sizes on a logarithmic scale."""
    out = np.zeros(STATS)
    if not text or not text.strip():
        return out
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return out
    raw = np.frombuffer(data, np.uint8)
    share = np.bincount(raw, minlength=256)
    groups = np.bincount(_GROUP, share, len(MARKS) + 1)[1:]
    out[: len(MARKS)] = np.log1p(groups) - np.log1p(n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = share[share > 0] / len(data)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[len(MARKS) :] = [
        np.log1p(n),
        sizes.mean(),
        sizes.std(),
        np.log(len(counts)) - np.log(n),
        np.log1p(pairs) - np.log(n),
        max(counts.values()) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log(n / max(1, len(lines))),
        float(-(p * np.log(p)).sum()),
        float(share[128:].sum() / len(data)),
    ]
    return out


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<float>) for each row."""
    tune(df.sparkSession)
    thin = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, STATS)
            at = np.arange(0, rows.size + 1, STATS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()))], names=["id", "stats"])

    return thin.mapInArrow(run, "id long, stats array<float>")


def _rows(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS).astype(float)


class Model:
    """Scale, random features, weights and calibration; small enough to travel with a task."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.freq = rng.normal(0, np.sqrt(2 * GAMMA), (STATS, FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weight = np.zeros(FEATURES + 1)
        self.steps = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.freq + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The ridge's output, held to -0.5 to 1.5."""
        return np.clip(self.features(x) @ self.weight, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


SUMS = "m array<binary>, s array<array<long>>"


def _packed(total: list[np.ndarray]) -> pa.RecordBatch:
    m = pa.array([[np.ascontiguousarray(a, float).tobytes() for a in total]], pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([m, pa.array([[list(a.shape) for a in total]], pa.list_(pa.list_(pa.int64())))], names=["m", "s"])


def _unpacked(m: list[bytes], s: list[list[int]]) -> list[np.ndarray]:
    return [np.frombuffer(x).reshape(shape) for x, shape in zip(m, s, strict=True)]


def _added(total: list[np.ndarray] | None, more: list[np.ndarray]) -> list[np.ndarray]:
    return more if total is None else [a + b for a, b in zip(total, more, strict=True)]


def sums(rows: DataFrame, of) -> list[np.ndarray]:
    """Sums over all rows (stats, y) of the matrices that ``of(x, y)`` gives for a batch; at most ``PARTS`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = _added(total, of(_rows(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)))
        if total is not None:
            yield _packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = _added(total, _unpacked(m, s))
        if total is not None:
            yield _packed(total)

    out: list[np.ndarray] | None = None
    for row in rows.mapInArrow(run, SUMS).repartition(PARTS).mapInArrow(add, SUMS).collect():
        out = _added(out, _unpacked(row["m"], row["s"]))
    return out or []


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values to ``y`` with weights ``w``, by pooling adjacent violators; ``x`` rises."""
    pools: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def fit(labelled: DataFrame) -> Model:
    """A model from rows (id, stats, y, part); part 1 calibrates, the others fit the ridge."""
    ours = labelled.where("part <> 1")
    n = ours.count()
    if n > FIT:
        ours = ours.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(1e6 * FIT / n)))
    ours = written(ours.select("stats", "y"), "fit")
    model = Model(np.zeros(STATS), np.ones(STATS))
    got = sums(ours, lambda x, y: [np.array([len(x), y.sum()]), x.sum(0), (x * x).sum(0)])
    if not got:
        return model
    (count, ones), total, squares = got
    model = Model(total / count, np.sqrt(np.maximum(squares / count - (total / count) ** 2, 0)) + 1e-6)
    model.steps = (np.array([0.0, 1.0]), np.full(2, ones / count))
    if ones in (0, count):
        return model

    def normal(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        f = model.features(x)
        return [f.T @ f, f.T @ y]

    gram, right = sums(ours, normal)
    ridge = RIDGE * np.eye(FEATURES + 1) * count / 1000
    ridge[-1, -1] = 0
    model.weight = np.linalg.solve(gram + ridge + 1e-9 * np.eye(FEATURES + 1), right)

    def binned(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        k = np.minimum((model.raw(x) + 0.5) / 2 * BINS, BINS - 1).astype(int)
        return [np.bincount(k, minlength=BINS).astype(float), np.bincount(k, y, BINS)]

    bins = sums(labelled.where("part = 1").select("stats", "y"), binned)
    if bins:
        seen = np.flatnonzero(bins[0])
        x = (seen + 0.5) / BINS * 2 - 0.5
        model.steps = (x, isotonic(x, bins[1][seen] / bins[0][seen], bins[0][seen]))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of measured rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_rows(batch.column(1))))], names=["id", "score"])

    return stats.mapInArrow(run, "id long, score double")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labelled rows that are not held out, applied to all."""
    stats = written(measured(df, id_col, text_col), "stats")
    part: Column = fold("id", 5)
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    model = fit(stats.join(known, "id").withColumn("part", part).where("part <> 0"))
    scored = score(stats, model)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(part == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
