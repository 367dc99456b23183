"""Helpers shared by the text operators: session settings and the shared work folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def chars(*ranges: tuple[int, int]) -> str:
    """A regex class body that lists every character below U+0100 of some ranges: Java looks such a set up, and goes through ranges one by one."""
    return "".join(f"\\x{c:02X}" for a, b in ranges for c in range(a, b + 1))


#: The whitespace of the word definition ``[^\x20\x09-\x0D]+``, as a regex class body.
WS = chars((0x20, 0x20), (0x09, 0x0D))
#: Rows and bytes that one Arrow batch may carry, so that a run of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2500, 8 << 20

#: Rows and bytes of text that a Python worker works on together.
PART_ROWS, PART_BYTES = 2500, 2 << 20

#: A key is hot that holds more than this part of all rows, so at most ``HOT`` keys are; and rows of a key below which it never is.
HOT, COOL = 10_000, 256

#: Rows of ids that are broadcast rather than have all texts shuffled to them.
LIGHT = 1_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session (texts are large rows)."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the test data, whole."""
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; on a cluster that would lose
    files with their machine, so there it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "gridspark-work")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/gridspark/{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, whichever store holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before; the folder is scratch space
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends there and any executor can be lost."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._work_path = path
    return got


def release(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that no later plan reads."""
    for df in tables:
        remove(df.sparkSession, df._work_path.rpartition("/")[0])


def parts(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most ``PART_ROWS`` rows and, but for single texts, ``PART_BYTES`` of the text column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = ends[i - 1] if i else 0
        n = int(np.searchsorted(ends, before + PART_BYTES, side="right")) - i
        n = min(max(n, 1), PART_ROWS)
        yield batch.slice(i, n)
        i += n


def give_back() -> None:
    """Returns what a task has freed to the system: a Python worker lives on and the next task may be another stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` whose worker gives its memory back when a task has ended."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def light(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if its rows are counted to be at most ``LIGHT``; else texts are shuffled to it."""
    return F.broadcast(ids) if ids.count() <= LIGHT else ids


def salted(rows: DataFrame, side: DataFrame, key: list[str], by: str, counts: DataFrame, n: str) -> DataFrame:
    """``rows`` joined with ``side``, a row a key; a hot key's rows are dealt out by a hash of ``by``, and its row of ``side`` is copied to each part.

    ``counts`` (key, n) tells how many rows each key has and is read twice, so it should be a written
    table. A part holds about a ``HOT``-th of all rows: at most ``HOT`` keys are hot, which bounds the
    broadcast, and they have at most twice as many parts together.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    grain = max(-(-total // HOT), COOL)
    hot = F.broadcast(counts.where(F.col(n) > grain).select(*key, F.ceil(F.col(n) / grain).cast("int").alias("__parts")))
    most = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), most).cast("int")).drop("__parts")
    copied = side.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), most - 1))).drop("__parts")
    return dealt.join(copied, [*key, "__salt"]).drop("__salt")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], Iterator[dict[str, list]]]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` over columns as Python lists; ``make`` builds a task's function once.

    The function yields dictionaries of equally long lists; each becomes one batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for got in work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}):
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
