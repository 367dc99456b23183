"""Connected components of an edge table, for hysteresis over cells and bands.

Rounds of alternating stars: first every node's larger neighbours are linked to its smallest one,
then its smaller ones. Each round is aggregates and joins on a node and is checkpointed to
``spark.checkpoint.dir``; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: its lineage ends, and any executor can be lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or _local_folder(context.master))
    return df.checkpoint()


def _local_folder(master: str) -> str:
    import tempfile

    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/gridspark-work"


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (u, v) with the smallest node that it is connected to."""
    down = lambda df: kept(df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, mark = down(edges), None
    while True:
        found = tuple(now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(u, v))")).first())
        if found == mark or not found[0]:
            break
        mark = found
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v")))
        now = down(small)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
