"""Connected components of an edge table by alternating large and small stars.

Every round is two joins on a node against its smallest neighbour, pre-aggregated, and is
written to the shared folder, so lineage stays short. The number of rounds grows with the
logarithm of the longest path. Nothing but row counts and a checksum reaches the driver.

Defined results: self-loops and null ends are ignored, repeated edges count once, and a node
without an edge has no row. No edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it is connected to, as a table."""
    now = _tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    now = written(now, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _tidy(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        then = written(_tidy(small), "edges")
        found = _mark(then)
        release(now)
        now, same, mark = then, found == mark, found
        if same:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = written(leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    release(now)
    return out


def _tidy(pairs: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000000007"))).first())
