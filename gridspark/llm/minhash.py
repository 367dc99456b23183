"""Near-duplicate documents by min-max hashing.

A document's set holds the hashes of its distinct word shingles. Under each of ``PERMUTATIONS``
hash functions both the smallest and the largest value are kept, so a signature of n values
takes n / 2 hash evaluations; both agree with the probability of the Jaccard similarity. Bands
of ``ROWS`` values are hashed into buckets: at a similarity of 0.85 a pair shares no bucket with
a probability of 2e-8.

Documents with one set are a class, and only classes are compared. In every bucket the smallest
class is the hub and is compared with the others, on full sets. Links merge classes into
components. What buckets are then left with more than one component go through an exact prefix
join: shingles are put in one order, by how often a sketch has counted them, rare ones first (its
cells are as many as the shingles it counts, within ``CELLS``; the order changes the work, never
the result); two sets that reach the threshold share a shingle near the start of both, at
positions that their sizes bound. So a family of near copies that are just too different for a
link is told apart by its rare shingles, and neither bucket nor family becomes all its pairs.
Buckets, pairs and components are tables, deleted as soon as no plan reads them: only a byte a
cell of the sketch and the components' row counts reach the driver.

Words, and the sets that links are confirmed on, are compared as 64-bit hashes: that two texts
with a million shingles between them count one as common by collision has a chance under 1e-7.

Defined results: a null, empty or blank text has no shingles and is linked with nothing. A text
with fewer words than a shingle has one, its whole word sequence. Rows with one doc_id are one
document. A row with a null doc_id is kept, with a null component. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light, parts, release, salted, tidy, tune, written
from .components import components

PERMUTATIONS, ROWS = 48, 4
#: Bytes of text that are hashed together.
SECTION = 1 << 19
#: Least and most cells of the sketch that orders shingles, and cells that are added up together, as powers of two.
CELLS, CHUNK = (18, 22), 14

U = np.uint64
_random = np.random.default_rng(20240229)
_BASE = U(0x9E3779B97F4A7C15)
_PERM = _random.integers(1, 1 << 63, PERMUTATIONS, dtype=U) | U(1)
_SPACE = bytes(1 if b in b"\t\n\x0b\x0c\r " else 0 for b in range(256))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Hashes of the words of texts."""

    def __init__(self):
        self.power = np.ones(1, U)
        self.inverse = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            one = np.full(n, _BASE, U)
            one[0] = U(1)
            self.power = np.cumprod(one, dtype=U)
            one[1:] = U(pow(int(_BASE), -1, 1 << 64))
            self.inverse = np.cumprod(one, dtype=U)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes of all texts, and the words at which texts begin (and end)."""
        raw = data.tobytes()
        space = np.frombuffer(raw.translate(_SPACE), bool)
        data = np.frombuffer(raw.translate(_LOWER), np.uint8)
        word = ~space
        first = word.copy()
        first[1:] &= space[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        first[inner] = word[inner]  # a text begins
        last = word.copy()
        last[:-1] &= space[1:]
        before = inner[inner > 0] - 1
        last[before] = word[before]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        out = np.empty(len(starts), U)
        at = 0
        while at < len(starts):  # sections of whole words, so that the powers stay few
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SECTION)))
            a, b = starts[at], ends[stop - 1] + 1
            self._grow(int(b - a))
            total = np.cumsum((data[a:b].astype(U) + U(1)) * self.power[: b - a], dtype=U)
            s, e = starts[at:stop] - a, ends[at:stop] - a
            part = total[e]
            part[1:] -= total[s[1:] - 1]
            if s[0]:
                part[0] -= total[s[0] - 1]
            out[at:stop] = mixed(part * self.inverse[s] + (e - s).astype(U))
            at = stop
        return out, np.searchsorted(starts, offsets)


def shingle_sets(words: Words, texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    raw = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    out = []
    i = 0
    while i < len(raw):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SECTION, side="right")) - 1)
        part = offsets[i : j + 1] - offsets[i]
        h, at = words.hashes(data[offsets[i] : offsets[j]], part)
        n = len(h)
        run = np.zeros(max(0, n - size + 1), U)
        for k in range(size):
            run = run * U(0xD6E8FEB86659FD93) + h[k : n - size + 1 + k] if n >= size else run
        run = mixed(run)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(run[a : b - size + 1]))
            elif b > a:
                whole = U(b - a)
                for x in h[a:b]:
                    whole = U(int(whole) * 0xD6E8FEB86659FD93 + int(x) & (1 << 64) - 1)
                out.append(mixed(np.array([whole], U)))
            else:
                out.append(np.zeros(0, U))
        i = j
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band hashes for each set, none of them empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    low, high = np.empty((PERMUTATIONS, len(sets)), U), np.empty((PERMUTATIONS, len(sets)), U)
    for k, a in enumerate(_PERM):
        x = flat * a
        low[k] = np.minimum.reduceat(x, at)
        high[k] = np.maximum.reduceat(x, at)
    values = np.concatenate((low, high))
    out = np.empty((len(values) // ROWS, len(sets)), U)
    for k in range(len(out)):
        got = np.full(len(sets), U(k + 1))
        for row in values[ROWS * k : ROWS * (k + 1)]:
            got = mixed(got * U(0xD6E8FEB86659FD93) + row)
        out[k] = got
    return out.T


def signatures(df: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, bands): the set's size, a 128-bit hash of the set, and its band hashes (null without shingles)."""
    tune(df.sparkSession)
    thin = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in parts(batch):
                sets = shingle_sets(words, part.column(1), size)
                full = [k for k, s in enumerate(sets) if len(s)]
                got: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, bands([sets[k] for k in full]).view(np.int64), strict=True):
                        got[k] = row
                h1 = [int(mixed(s + _BASE).sum(dtype=U).view(np.int64)) for s in sets]
                h2 = [int(np.bitwise_xor.reduce(mixed(s ^ _BASE)).view(np.int64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(got, pa.list_(pa.int64()))],
                    names=["id", "n", "h1", "h2", "bands"],
                )

    return thin.mapInArrow(tidy(run), "id long, n long, h1 long, h2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as a table; ``texts`` is (id, text)."""
    need = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    some = texts.join(light(need), "id", "left_semi")
    one = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    degrees = written(pairs.groupBy("b").count(), "degrees")
    both = salted(one, some.select(F.col("id").alias("b"), F.col("text").alias("text_b")), ["b"], "a", degrees, "count").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, b_set = Words(), None, None
        for batch in batches:
            for part in parts(batch, 2):
                a_sets = shingle_sets(words, part.column(2), size)
                yes = []
                for k, (b, s) in enumerate(zip(part.column(1).to_pylist(), a_sets, strict=True)):
                    if seen is None or seen[0] != b or seen[1] != part.column(3)[k].as_py():  # rows of one b come together
                        seen = b, part.column(3)[k].as_py()
                        (b_set,) = shingle_sets(words, pa.array([seen[1]], pa.string()), size)
                    common = len(np.intersect1d(s, b_set, assume_unique=True))
                    yes.append(common > 0 and 100 * common >= percent * (len(s) + len(b_set) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    links = written(both.mapInArrow(tidy(run), "a long, b long").distinct(), "links")
    release(need, degrees)
    return links


def sketch(nodes: DataFrame, size: int, shingles: int) -> np.ndarray:
    """How often shingles fall in each cell, over all sets of ``nodes`` (text), in quarters of a power of two; a byte a cell is collected."""
    bits = min(max(CELLS[0], shingles.bit_length()), CELLS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for s in shingle_sets(words, batch.column(0), size):
                np.add.at(counts, (s >> U(64 - bits)).astype(np.int64), 1)
        for chunk, part in enumerate(counts.reshape(-1, 1 << CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(n.as_buffer(), np.int64)
                held[chunk] = held[chunk] + got if chunk in held else got
        for chunk, n in held.items():
            level = np.where(n > 0, np.floor(4 * np.log2(np.maximum(n, 1))) + 1, 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "level"])

    out = np.zeros((1 << (bits - CHUNK), 1 << CHUNK), np.uint8)
    sums = nodes.select("text").mapInArrow(tidy(run), "chunk int, n binary").repartition("chunk").mapInArrow(add, "chunk int, level binary")
    for chunk, level in sums.collect():
        out[chunk] = np.frombuffer(level, np.uint8)
    return out.ravel()


def prefix_pairs(nodes: DataFrame, size: int, percent: int, shingles: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that may reach the threshold, and the table they read; ``nodes`` is (node, component, text). None that does is missing.

    Of two sets with sizes x and y that reach it, at least ``percent * (x + y) / (100 + percent)``
    shingles are common, so the first common one in any order stands among the first x less that
    number plus one of the first set, and likewise of the second. The smaller set's bound is at
    most its own with y = x: those rows alone are looked up.
    """
    counted = sketch(nodes, size, shingles)
    shift = U(64 - (len(counted).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in parts(batch, 2):
                rows: list[list] = [[], [], [], [], [], []]
                for node, comp, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(words, part.column(2), size), strict=True):
                    n = len(s)
                    first = s[np.lexsort((s, counted[(s >> shift).astype(np.int64)]))[: n - -(-percent * n // 100) + 1]]
                    short = n - -(-2 * percent * n // (100 + percent)) + 1
                    for col, x in zip(rows, (first.view(np.int64), np.full(len(first), node), np.full(len(first), comp), np.full(len(first), n), np.arange(1, len(first) + 1), np.arange(len(first)) < short), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], names=["s", "node", "c", "n", "pos", "short"])

    rows = written(nodes.select("node", "component", "text").mapInArrow(tidy(run), "s long, node long, c long, n long, pos long, short boolean"), "prefixes")
    small = rows.where("short").select("s", *[F.col(x).alias(f"{x}2") for x in ("node", "c", "n", "pos")])
    need = f"(({percent} * (n + n2) + {99 + percent}) div {100 + percent})"
    fits = f"(n2 < n or (n2 = n and node2 < node)) and c <> c2 and 100 * n2 >= {percent} * n and pos <= n - {need} + 1 and pos2 <= n2 - {need} + 1"
    met = rows.alias("r").join(small.alias("q"), (F.col("r.s") == F.col("q.s")) & F.expr(fits))
    return met.select(F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b")).distinct(), rows


def near_duplicates(df: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``df``; linked if 100 * intersection >= percent * union.

    The bands' figures above hold for a ``percent`` of 85; at 80 a pair shares no bucket with a
    probability of 3e-6.
    """
    tune(df.sparkSession)
    signed = written(signatures(df, size, id_col, text_col), "signatures")
    full = signed.where("n > 0 and id is not null")
    classes = written(full.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "classes")
    rows = classes.select("node", "n", F.explode("bands").alias("bucket"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    hubs = rows.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")).where("last > hub.node")
    shared = written(rows.join(hubs.select("bucket", F.col("hub.node").alias("b"), F.col("hub.n").alias("bn")), "bucket"), "shared")
    near = F.expr(f"100 * least(n, bn) >= {percent} * greatest(n, bn)")
    pairs = written(shared.where(near & (F.col("node") > F.col("b"))).select(F.col("node").alias("a"), "b").distinct(), "pairs")
    first = verified(pairs, texts, size, percent)
    release(pairs)
    merged = components(first)

    owned = shared.join(merged, shared.node == merged.node, "left").select(shared.node, "n", "bucket", F.coalesce("component", shared.node).alias("component"))
    open_ = owned.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("high > low").select("bucket")
    left = written(owned.join(open_, "bucket", "left_semi").select("node", "component", "n").distinct(), "left")
    release(shared, merged)
    bodies = written(texts.join(light(left), texts.id == left.node).select("node", "component", "text"), "bodies")
    met, prefixes = prefix_pairs(bodies, size, percent, left.agg(F.sum("n")).first()[0] or 0)
    pairs = written(met, "pairs")
    second = verified(pairs, bodies.select(F.col("node").alias("id"), "text"), size, percent)
    links = written(first.union(second), "links")
    release(first, second, left, bodies, prefixes, pairs)

    final = components(links)
    release(links)
    named = classes.select("h1", "h2", "node").join(final, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    known = salted(full.select("id", "n", "h1", "h2"), named, ["h1", "h2"], "id", classes, "copies").select("id", "n", "component")
    alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    out = known.union(alone)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.expr("id <=> component").alias("kept"))


def keep_one(df: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, without the near-duplicates of smaller ids."""
    gone = near_duplicates(df, size, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = light(written(gone, "gone"))
    return df.join(gone, df[id_col] == F.col("__gone"), "left_anti")


#: :func:`near_duplicates` over ``documents`` as DuckDB SQL, by all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM t
), n AS (SELECT doc_id, CAST(count(shingle) AS BIGINT) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT y, c FROM reach JOIN edges ON reach.doc_id = x)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n
"""
