"""The array engine's registered queries, each with the same query as DuckDB SQL.

The relational test tables are read as arrays: event values and order prices by their dense
keys, counts of line items by quantity and discount, of events by day and hour (and type), and
the embedding matrix. Measures are whole numbers (cents, thousandths), so sums agree exactly.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..blocks import BlockGrid
from ..functions import elem, vector
from ..grid import Grid
from ..operators import flow, load, stencil, walk
from ..sources import generate as gen
from ..sources import images
from . import planes, recipes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL (WITH clauses of the arrays are added)."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            used = [v for k, v in CTES.items() if f"FROM {k}" in sql or f"JOIN {k}" in sql]
            _SQL[f.__name__] = ("WITH " + ", ".join(used) + " " if used else "") + sql
        return f

    return add


# Arrays of the test tables, and the same as SQL

CTES = {
    "ev": "ev AS (SELECT event_id AS i0, CAST(floor(value * 100) AS BIGINT) AS v FROM events)",
    "od": "od AS (SELECT o_orderkey AS i0, CAST(floor(o_totalprice * 100) AS BIGINT) AS v FROM orders)",
    "su": "su AS (SELECT s_suppkey AS i0, CAST(floor(s_acctbal * 100) AS BIGINT) AS v FROM supplier)",
    "re": "re AS (SELECT CAST(n_nationkey AS BIGINT) AS i0, CAST(n_regionkey + 1 AS BIGINT) AS v FROM nation)",
    "vec": "vec AS (SELECT event_id AS i0, CAST(floor(value * 100) AS BIGINT) AS c0, event_id % 7 AS c1, user_id % 5 AS c2 FROM events)",
    "em": "em AS (SELECT vec_id AS i0, CAST(k - 1 AS BIGINT) AS i1, CAST(floor(embedding[k] * 1000) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings))",
    "qd": "qd AS (SELECT CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, coalesce(n, 0) AS v FROM range(50) a(i0), range(11) b(i1) LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) - 1 AS y, CAST(round(l_discount * 100) AS BIGINT) AS x, count(*) AS n FROM lineitem GROUP BY 1, 2) ON y = i0 AND x = i1)",
    "dh": "dh AS (SELECT CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, coalesce(n, 0) AS v FROM range(30) a(i0), range(24) b(i1) LEFT JOIN (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS y, hour(ts) AS x, count(*) AS n FROM events GROUP BY 1, 2) ON y = i0 AND x = i1)",
    "tdh": "tdh AS (SELECT CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, CAST(i2 AS BIGINT) AS i2, coalesce(n, 0) AS v FROM range(5) a(i0), range(30) b(i1), range(24) c(i2) LEFT JOIN (SELECT user_id % 5 AS z, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS y, hour(ts) AS x, count(*) AS n FROM events GROUP BY 1, 2, 3) ON z = i0 AND y = i1 AND x = i2)",
}


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.floor(F.col(c) * 100).cast("long")


def _line(df: DataFrame, key: str, value: Column) -> Grid:
    """A rank-one grid by a dense key; its extent is the number of rows."""
    return gen.from_table(df, df.count(), [F.col(key)], value)


def ev(s: SparkSession, d: str) -> Grid:
    return _line(_table(s, d, "events"), "event_id", _cents("value"))


def od(s: SparkSession, d: str) -> Grid:
    return _line(_table(s, d, "orders"), "o_orderkey", _cents("o_totalprice"))


def su(s: SparkSession, d: str) -> Grid:
    return _line(_table(s, d, "supplier"), "s_suppkey", _cents("s_acctbal"))


def re(s: SparkSession, d: str) -> Grid:
    return _line(_table(s, d, "nation"), "n_nationkey", (F.col("n_regionkey") + 1).cast("long"))


def vec(s: SparkSession, d: str) -> Grid:
    return _line(_table(s, d, "events"), "event_id", vector.vec(_cents("value"), F.col("event_id") % 7, F.col("user_id") % 5))


def em(s: SparkSession, d: str) -> Grid:
    """Thousandths of the embeddings. The product is one of floats, as in SQL: a double's floor may be one less or more."""
    rows = _table(s, d, "embeddings")
    g = gen.from_packed(rows, (rows.count(), 64), [F.col("vec_id")], F.col("embedding"))
    return flow.dmap(lambda v: F.floor(v * F.lit(1000).cast("float")).cast("long"), g)


def qd(s: SparkSession, d: str) -> Grid:
    return gen.counted(_table(s, d, "lineitem"), (50, 11), [F.col("l_quantity").cast("long") - 1, F.round(F.col("l_discount") * 100)])


def _day() -> Column:
    return F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))


def dh(s: SparkSession, d: str) -> Grid:
    return gen.counted(_table(s, d, "events"), (30, 24), [_day(), F.hour("ts")])


def tdh(s: SparkSession, d: str) -> Grid:
    return gen.counted(_table(s, d, "events"), (5, 30, 24), [F.col("user_id") % 5, _day(), F.hour("ts")])


def _parts(g: Grid, n: int = 3) -> DataFrame:
    return g.df.select(*g.names, *[F.col("v").getItem(k).alias(f"c{k}") for k in range(n)])


def _one(df: DataFrame, kind: str = "long") -> DataFrame:
    return df.select(F.col("r").cast(kind).alias("r"))


# Sources


@query("SELECT CAST(y AS BIGINT) AS i0, CAST(x AS BIGINT) AS i1, CAST(y * 10 + x * x AS BIGINT) AS v FROM range(40) a(y), range(30) b(x)")
def from_function(s, d):
    return gen.from_function(s, (40, 30), lambda y, x: y * 10 + x * x).df


@query("SELECT CAST(p // 7 AS BIGINT) AS i0, CAST(p % 7 AS BIGINT) AS i1, CAST(p * p AS BIGINT) AS v FROM range(63) t(p)")
def from_linear_function(s, d):
    return gen.from_linear_function(s, (9, 7), lambda p: p * p).df


@query("SELECT CAST(z AS BIGINT) AS i0, CAST(y AS BIGINT) AS i1, CAST(x AS BIGINT) AS i2, 5 AS v FROM range(2) a(z), range(3) b(y), range(4) c(x)")
def const(s, d):
    return gen.const(s, (2, 3, 4), 5).df


@query("SELECT CAST(x AS BIGINT) AS i0, CAST(0 AS BIGINT) AS v FROM range(12) t(x)")
def new_empty(s, d):
    return gen.new_empty(s, 12).df


@query("SELECT CAST(p // 3 AS BIGINT) AS i0, CAST(p % 3 AS BIGINT) AS i1, CAST(10 * p + 1 AS BIGINT) AS v FROM range(6) t(p)")
def from_list(s, d):
    return gen.from_list(s, (2, 3), [10 * p + 1 for p in range(6)], "bigint").df


@query("SELECT i0, i1, v FROM dh")
def from_table(s, d):
    return dh(s, d).df


@query("SELECT i0, i1, i2, v FROM tdh")
def from_table_dim3(s, d):
    return tdh(s, d).df


@query("SELECT i0, i1, v FROM em")
def from_packed(s, d):
    return em(s, d).df


@query("SELECT i0, CAST(sum(v * (i1 + 1)) AS BIGINT) AS v FROM em GROUP BY i0")
def packed_rows(s, d):
    rows = gen.packed(em(s, d))
    terms = F.filter(F.transform("vs", lambda v, k: v * (k + 1)), F.isnotnull)
    return rows.select("i0", F.when(F.size(terms) > 0, F.aggregate(terms, F.lit(0).cast("long"), lambda a, v: a + v)).alias("v"))


@query("SELECT i0, v AS c0, i0 AS c1, 2 * v AS c2 FROM ev")
def from_slices(s, d):
    g = ev(s, d)
    return _parts(gen.from_slices([g, flow.imap(lambda i, v: i, g), flow.dmap(lambda v: v * 2, g)]))


@query("SELECT i0, c2 AS v FROM vec")
def slices(s, d):
    return vec(s, d).slices(3)[2].df


@query("SELECT i0, c0 AS re, c1 AS im FROM vec")
def convert(s, d):
    return flow.convert(vec(s, d), 2, ["re", "im"]).df.select("i0", "v.re", "v.im")


@query("SELECT i0 AS pos, v FROM ev WHERE i0 < 50")
def linear_rows(s, d):
    return load.range_load(ev(s, d), gen.new_empty(s, 50), (0,), (50,)).linear()


# Indexing


@query("SELECT i0, i1, v FROM qd WHERE i0 = 17 AND i1 = 4")
def index(s, d):
    return qd(s, d).at(17, 4)


@query("SELECT i0, i1, v FROM qd WHERE i0 * 11 + i1 = 123")
def linear_index(s, d):
    return qd(s, d).at_linear(123)


@query("SELECT i0, i1, CASE WHEN (i0 + i1) % 5 = 0 THEN CAST(-1 AS BIGINT) ELSE v END AS v FROM qd")
def write(s, d):
    g = qd(s, d)
    return g.write(g.df.where((F.col("i0") + F.col("i1")) % 5 == 0).withColumn("v", F.lit(-1).cast("long"))).df


@query("SELECT i0, i1, CASE WHEN i0 * 11 + i1 < 30 THEN i0 * 11 + i1 ELSE v END AS v FROM qd")
def linear_write(s, d):
    return qd(s, d).write_linear(s.range(30).select(F.col("id").alias("pos"), F.col("id").alias("v"))).df


@query("SELECT i0, i1, v FROM qd WHERE i0 = 3 AND i1 = 3")
def checked_index(s, d):
    return qd(s, d).check().at(3, 3)


# Projections


@query("SELECT i0, i1, CASE WHEN i0 = i1 THEN 7 ELSE v END AS v FROM qd")
def checked_write(s, d):
    return qd(s, d).check().write(s.range(11).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(7).cast("long").alias("v"))).df


@query("SELECT CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, CASE WHEN i0 = 2 THEN i1 * 10 ELSE -1 END AS v FROM range(5) a(i0), range(4) b(i1)")
def new(s, d):
    """Cells without a value, here -1, but for those written."""
    g = gen.new(s, (5, 4), "bigint").write(s.range(4).select(F.lit(2).cast("long").alias("i0"), F.col("id").alias("i1"), (F.col("id") * 10).alias("v")))
    return flow.dmap(lambda v: F.coalesce(v, F.lit(-1).cast("long")), g).df


@query("SELECT i0, v * 3 + 1 AS v FROM ev")
def dmap(s, d):
    return flow.dmap(lambda v: v + 1, flow.dmap(lambda v: v * 3, ev(s, d))).df


@query("SELECT i0, i1, v * i0 - i1 AS v FROM qd")
def imap(s, d):
    return flow.imap(lambda y, x, v: v * y - x, qd(s, d)).df


@query("SELECT i0, c0 + 1 AS c0, c1 + 1 AS c1, c2 + 1 AS c2 FROM vec")
def map_elems(s, d):
    return _parts(flow.map_elems(lambda c: c + 1, vec(s, d)))


@query("SELECT i0, c0 * 2 AS c0, c1 + 10 AS c1, -c2 AS c2 FROM vec")
def dmap_elems(s, d):
    return _parts(flow.dmap_elems([lambda c: c * 2, lambda c: c + 10, lambda c: -c], vec(s, d)))


@query("SELECT i0, c0 + 100 * c1 + c2 AS v FROM vec")
def zip_elems(s, d):
    return flow.zip_elems(lambda a, b, c: a + 100 * b + c, 3, vec(s, d)).df


@query("SELECT i1 AS i0, i0 AS i1, v FROM qd")
def transpose(s, d):
    return flow.reindex(qd(s, d), (11, 50), lambda y, x: (x, y)).df


@query("SELECT CAST(y AS BIGINT) AS i0, CAST(x AS BIGINT) AS i1, a.v - b.v AS v FROM range(25) t(y), range(11) u(x) JOIN qd a ON a.i0 = 2 * y AND a.i1 = x JOIN qd b ON b.i0 = 2 * y + 1 AND b.i1 = 10 - x")
def traverse(s, d):
    return flow.traverse((25, 11), [lambda y, x: (y * 2, x), lambda y, x: (y * 2 + 1, F.lit(10) - x)], lambda y, x, a, b: a - b, qd(s, d)).df


@query("SELECT e.i0, e.v + r.v AS v FROM ev e JOIN re r ON r.i0 = e.i0 % 25")
def map_with_lookup(s, d):
    g = flow.imap(lambda i, v: F.struct(i.alias("i"), v.alias("v")), ev(s, d))
    return flow.lookup(g, lambda c: c["i"] % 25, re(s, d), lambda c, x: c["v"] + x).df


@query("SELECT i0, c0 % 10 AS c0, c1 % 10 AS c1, c2 % 10 AS c2 FROM vec")
def map_slices(s, d):
    return _parts(flow.map_slices(lambda g: flow.dmap(lambda v: v % 10, g), 3, vec(s, d)))


# Zips and products


@query("SELECT e.i0, e.v + o.v AS v FROM ev e JOIN od o ON e.i0 = o.i0")
def dzip2(s, d):
    return flow.dzip2(lambda a, b: a + b, ev(s, d), od(s, d)).df


@query("SELECT i0, v * v - i0 AS v FROM ev")
def dzip2_same_source(s, d):
    g = ev(s, d)
    return flow.dzip2(lambda a, b: a - b, flow.dmap(lambda v: v * v, g), flow.imap(lambda i, v: i, g)).df


@query("SELECT e.i0, e.v + o.v * s.v AS v FROM ev e JOIN od o ON e.i0 = o.i0 JOIN su s ON s.i0 = e.i0")
def dzip3(s, d):
    return flow.dzip3(lambda a, b, c: a + b * c, ev(s, d), od(s, d), su(s, d)).df


@query("SELECT e.i0, least(e.v, o.v, s.v, r.v) AS v FROM ev e JOIN od o ON e.i0 = o.i0 JOIN su s ON s.i0 = e.i0 JOIN re r ON r.i0 = e.i0")
def dzip_n(s, d):
    return flow.dzip(F.least, ev(s, d), od(s, d), su(s, d), re(s, d)).df


@query("SELECT a.i0, a.i1, a.v + b.v * (a.i0 - a.i1) AS v FROM qd a JOIN dh b ON a.i0 = b.i0 AND a.i1 = b.i1")
def izip2(s, d):
    return flow.izip2(lambda y, x, a, b: a + b * (y - x), qd(s, d), dh(s, d)).df


@query("SELECT a.i0, a.v + b.v + c.v + a.i0 AS v FROM ev a JOIN od b ON a.i0 = b.i0 JOIN su c ON c.i0 = a.i0")
def izip3(s, d):
    return flow.izip3(lambda i, a, b, c: a + b + c + i, ev(s, d), od(s, d), su(s, d)).df


@query("SELECT a.i0, a.c0 + b.v AS c0, a.c1 * b.v AS c1, a.c2 - b.v AS c2 FROM vec a JOIN od b ON a.i0 = b.i0")
def dzip_elems2(s, d):
    other = flow.dmap(lambda v: vector.vec(v, v, v), od(s, d))
    return _parts(flow.dzip_elems2([lambda a, b: a + b, lambda a, b: a * b, lambda a, b: a - b], vec(s, d), other))


@query("SELECT a.i0, a.c0 + b.v + c.v AS c0, a.c1 * b.v - c.v AS c1 FROM vec a JOIN od b ON a.i0 = b.i0 JOIN su c ON c.i0 = a.i0")
def dzip_elems3(s, d):
    twin = lambda g: flow.dmap(lambda v: vector.vec(v, v), g)
    return _parts(flow.dzip_elems3([lambda a, b, c: a + b + c, lambda a, b, c: a * b - c], vec(s, d), twin(od(s, d)), twin(su(s, d))), 2)


@query("SELECT e.i0, e.v + o.v - s.v * r.v + e.i0 AS v FROM ev e JOIN od o ON e.i0 = o.i0 JOIN su s ON s.i0 = e.i0 JOIN re r ON r.i0 = e.i0")
def izip_n(s, d):
    return flow.izip(lambda i, e, o, a, r: e + o - a * r + i, ev(s, d), od(s, d), su(s, d), re(s, d)).df


@query("SELECT a.i0, a.c0 + b.v + c.v + r.v AS c0, a.c1 * b.v - c.v * r.v AS c1 FROM vec a JOIN od b ON a.i0 = b.i0 JOIN su c ON c.i0 = a.i0 JOIN re r ON r.i0 = a.i0")
def dzip_elems_n(s, d):
    twin = lambda g: flow.dmap(lambda v: vector.vec(v, v), g)
    return _parts(flow.dzip_elems([lambda a, b, c, r: a + b + c + r, lambda a, b, c, r: a * b - c * r], vec(s, d), twin(od(s, d)), twin(su(s, d)), twin(re(s, d))), 2)


@query("SELECT a.i0, b.i0 AS i1, a.v * b.v AS v FROM su a, su b")
def cart_product2(s, d):
    g = su(s, d)
    return flow.cart_product2(lambda a, b: a * b, g, g.settled()).df


@query("SELECT a.i0, b.i0 AS i1, CASE WHEN a.i0 = b.i0 THEN 0 ELSE a.v - b.v END AS v FROM re a, re b")
def icart_product2(s, d):
    g = re(s, d)
    return flow.icart_product2(lambda i, j, a, b: F.when(i == j, 0).otherwise(a - b), g, g.settled()).df


@query("SELECT a.i0, b.i0 AS i1, c.i0 AS i2, a.v + 10 * b.v + 100 * c.v AS v FROM re a, re b, re c")
def cart_product3(s, d):
    g = re(s, d)
    return flow.cart_product3(lambda a, b, c: a + 10 * b + 100 * c, g, g.settled(), g.settled()).df


@query("SELECT a.i0, b.i0 AS i1, c.i0 AS i2, a.v * a.i0 + b.i0 - c.v AS v FROM re a, re b, re c")
def icart_product3(s, d):
    g = re(s, d)
    return flow.icart_product3(lambda i, j, k, a, b, c: a * i + j - c, g, g.settled(), g.settled()).df


# Walks

_FOLD = "list_reduce(list(v ORDER BY {order}), lambda a, x: (a * 31 + x) % 1000003, CAST(7 AS BIGINT))"


def _hash(a: Column, x: Column) -> Column:
    return (a * 31 + x) % 1000003


@query("SELECT " + _FOLD.format(order="i0, i1") + " AS r FROM qd")
def reduce_l(s, d):
    return _one(walk.reduce_l(_hash, F.lit(7).cast("long"), qd(s, d)))


@query("SELECT " + _FOLD.format(order="i0 DESC, i1 DESC") + " AS r FROM qd")
def reduce_r(s, d):
    return _one(walk.reduce_r(lambda x, a: _hash(a, x), F.lit(7).cast("long"), qd(s, d)))


@query("SELECT list_reduce(list(v * i0 + i1 ORDER BY i0, i1), lambda a, x: (a * 31 + x) % 1000003, CAST(7 AS BIGINT)) AS r FROM qd")
def ireduce_l(s, d):
    return _one(walk.ireduce_l(lambda a, y, x, v: _hash(a, v * y + x), F.lit(7).cast("long"), qd(s, d)))


@query("SELECT list_reduce(list(v * i0 + i1 ORDER BY i0 DESC, i1 DESC), lambda a, x: (a * 31 + x) % 1000003, CAST(7 AS BIGINT)) AS r FROM qd")
def ireduce_r(s, d):
    return _one(walk.ireduce_r(lambda y, x, v, a: _hash(a, v * y + x), F.lit(7).cast("long"), qd(s, d)))


@query("SELECT CAST(sum(v) AS BIGINT) AS total, max(v) AS most, arg_max(i0, v * 100000 + i0) AS at FROM ev")
def walk_all(s, d):
    return walk.walk(ev(s, d), total=F.sum("v"), most=F.max("v"), at=F.max_by("i0", F.col("v") * 100000 + F.col("i0")))


@query("SELECT CAST(sum(v * i1) AS BIGINT) AS total, count(*) AS n FROM qd WHERE i0 >= 5 AND i0 < 40 AND i1 >= 2 AND i1 < 9")
def range_walk(s, d):
    return walk.range_walk(qd(s, d), (5, 2), (40, 9), total=F.sum(F.col("v") * F.col("i1")), n=F.count("*"))


@query("SELECT CAST(sum(v * (i0 % 13)) AS BIGINT) AS r FROM ev")
def walk_p(s, d):
    return _one(walk.iwalk_p(lambda a, i, v: a + v * (i % 13), F.lit(0).cast("long"), lambda a, b: a + b, ev(s, d), chunks=16))


@query("SELECT CAST(sum(v) AS BIGINT) AS r FROM ev WHERE i0 >= 100 AND i0 < 900")
def range_walk_p(s, d):
    return _one(walk.range_walk_p(lambda a, v: a + v, F.lit(0).cast("long"), lambda a, b: a + b, ev(s, d), 8, (100,), (900,)))


@query("SELECT max(c0) AS r0, max(c1) AS r1, max(c2) AS r2 FROM vec")
def walk_slices(s, d):
    return walk.walk_slices(vec(s, d), 3, F.max)


@query("SELECT CAST(sum(c0) AS BIGINT) AS r0, CAST(sum(c1) AS BIGINT) AS r1, CAST(sum(c2) AS BIGINT) AS r2 FROM vec WHERE i0 >= 10 AND i0 < 700")
def range_walk_slices(s, d):
    return walk.walk_slices(vec(s, d), 3, F.sum, (10,), (700,))


@query("SELECT CAST(b AS BIGINT) AS i0, coalesce(n, 0) AS v FROM range(97) t(b) LEFT JOIN (SELECT v % 97 AS k, count(*) AS n FROM ev GROUP BY 1) ON k = b")
def mutate(s, d):
    return walk.mutate(ev(s, d), lambda i, v: v % 97, 97).df


@query("SELECT CAST(b AS BIGINT) AS i0, CAST(coalesce(n, 0) AS BIGINT) AS v FROM range(60) t(b) LEFT JOIN (SELECT i0 + i1 AS k, sum(v) AS n FROM qd GROUP BY 1) ON k = b")
def imutate(s, d):
    return walk.imutate(qd(s, d), lambda y, x, v: y + x, 60, F.col("v")).df


@query("SELECT i0, CAST(sum(v) AS BIGINT) AS v FROM em GROUP BY i0")
def reduce_inner(s, d):
    return walk.reduce_inner(walk.wide_sum, em(s, d)).df


@query("SELECT i0, i1, max(v) AS v FROM tdh GROUP BY i0, i1")
def reduce_inner_dim3(s, d):
    return walk.reduce_inner(F.max, tdh(s, d)).df


@query("SELECT i0, CAST(sum(v * (i1 + 1)) AS BIGINT) AS v FROM em GROUP BY i0")
def ireduce_inner(s, d):
    return walk.ireduce_inner(lambda v: walk.wide_sum(v * (F.col("i1") + 1)), em(s, d)).df


@query("SELECT i0, list_reduce(list(v ORDER BY i1), lambda a, x: (a * 31 + x) % 1000003, i0) AS v FROM qd GROUP BY i0")
def fold_inner(s, d):
    return walk.fold_inner(_hash, lambda y: y, qd(s, d)).df


@query("SELECT i0, CAST(sum(v) OVER (ORDER BY i0) AS BIGINT) AS v FROM ev")
def scan(s, d):
    return walk.scan(ev(s, d)).df


_M = 1000003


def _affine(acc: Column, v: Column) -> Column:
    """One step of the hash ``(a * 31 + v) % M`` as a pair (factor, summand), so that pairs can be joined."""
    return F.array(acc.getItem(0) * 31 % _M, (acc.getItem(1) * 31 + v) % _M)


def _composed(a: Column, b: Column) -> Column:
    return F.array(a.getItem(0) * b.getItem(0) % _M, (a.getItem(1) * b.getItem(0) + b.getItem(1)) % _M)


def _neutral() -> Column:
    return F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))


def _hash_sql(v: str, table: str, by: str = "i0, i1") -> str:
    return f"(SELECT list_reduce(list({v} ORDER BY {by}), lambda a, x: (a * 31 + x) % 1000003, CAST(0 AS BIGINT)) FROM {table})"


@query("SELECT " + _hash_sql("v", "qd") + " AS r FROM (SELECT 1 FROM qd LIMIT 1)")
def walk_p_ordered(s, d):
    """A join that does not commute: the hash of all cells in order, over blocks."""
    old = walk.walk_p(_affine, _neutral(), _composed, qd(s, d), chunks=23)
    return old.select(F.col("r").getItem(1).alias("r"))


@query("SELECT " + ", ".join(_hash_sql(f"c{k}", "vec", "i0") + f" AS r{k}" for k in range(3)) + " FROM (SELECT 1 FROM vec LIMIT 1)")
def walk_slices_separate_p(s, d):
    got = walk.walk_slices_separate_p(_affine, _neutral(), _composed, vec(s, d), 3, chunks=7)
    return got.select(*[F.col(f"r{k}").getItem(1).alias(f"r{k}") for k in range(3)])


@query("SELECT " + ", ".join(_hash_sql(f"c{k}", "vec", "i0") + f" AS r{k}" for k in range(3)) + " FROM (SELECT 1 FROM vec LIMIT 1)")
def walk_slices_separate(s, d):
    return walk.walk_slices_separate(lambda a, v: (a * 31 + v) % _M, F.lit(0).cast("long"), vec(s, d), 3)


@query("SELECT " + ", ".join(f"CAST(sum(c{k} * i0) AS BIGINT) AS r{k}" for k in range(3)) + " FROM vec WHERE i0 >= 3 AND i0 < 90")
def iwalk_slices_separate_p(s, d):
    return walk.iwalk_slices_separate_p(lambda a, i, v: a + i * v, F.lit(0).cast("long"), lambda a, b: a + b, vec(s, d), 3, None, (3,), (90,))


@query("SELECT " + ", ".join(f"CAST(sum(c{k} * i0) AS BIGINT) AS r{k}" for k in range(3)) + " FROM vec WHERE i0 >= 3 AND i0 < 90")
def iwalk_slices_separate(s, d):
    return walk.iwalk_slices_separate(lambda a, i, v: a + i * v, F.lit(0).cast("long"), vec(s, d), 3, (3,), (90,))


# Stencils


def _stencil_sql(table: str, h: str, w: str, rows: list[list[int]], agg: str = "sum(k.c * s.v)", kind: str = "BIGINT") -> str:
    """The clamped stencil by a gather of every tap."""
    (y0, _), (x0, _) = stencil.offsets(len(rows)), stencil.offsets(len(rows[0]))
    taps = ", ".join(f"({y0 + y}, {x0 + x}, {c})" for y, row in enumerate(rows) for x, c in enumerate(row))
    return (
        f"SELECT g.i0, g.i1, CAST({agg} AS {kind}) AS v FROM {table} g CROSS JOIN (VALUES {taps}) k(dy, dx, c) "
        f"JOIN {table} s ON s.i0 = greatest(0, least({h} - 1, g.i0 + k.dy)) AND s.i1 = greatest(0, least({w} - 1, g.i1 + k.dx)) GROUP BY g.i0, g.i1"
    )


def _line_sql(row: list[int]) -> str:
    low, _ = stencil.offsets(len(row))
    taps = ", ".join(f"({low + x}, {c})" for x, c in enumerate(row))
    return f"SELECT g.i0, CAST(sum(k.c * s.v) AS BIGINT) AS v FROM ev g CROSS JOIN (VALUES {taps}) k(dx, c) JOIN ev s ON s.i0 = greatest(0, least((SELECT max(i0) FROM ev), g.i0 + k.dx)) GROUP BY g.i0"


_SX = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
_SY = [[1, 2, 1], [0, 0, 0], [-1, -2, -1]]
_B5 = [[2, 4, 5, 4, 2], [4, 9, 12, 9, 4], [5, 12, 15, 12, 5], [4, 9, 12, 9, 4], [2, 4, 5, 4, 2]]


@query(_line_sql([1, 4, 6, 4, 1]))
def convolve_dim1(s, d):
    return stencil.convolve([stencil.dim1("1 4 6 4 1")], ev(s, d)).df


@query(_line_sql([3, -1]))
def convolve_dim1_even(s, d):
    return stencil.convolve([stencil.dim1("3 -1")], ev(s, d)).df


@query("SELECT a.i0, a.v + coalesce(b.v, -1) - coalesce(c.v, -1) AS v FROM ev a LEFT JOIN ev b ON b.i0 = a.i0 + 1 LEFT JOIN ev c ON c.i0 = a.i0 - 1")
def convolve_dim1_border(s, d):
    return stencil.convolve([stencil.dim1("-1 1 1")], ev(s, d), border=lambda i, v: F.lit(-1).cast("long")).df


@query(_stencil_sql("qd", "50", "11", _SX))
def convolve_dim2(s, d):
    return stencil.convolve([stencil.dim2(recipes.SOBEL_X)], qd(s, d)).df


@query(_stencil_sql("dh", "30", "24", _B5))
def convolve_dim2_5x5(s, d):
    return stencil.convolve([stencil.dim2(_B5)], dh(s, d)).df


@query(_stencil_sql("qd", "50", "11", [[1, 1, 1]] * 3, "max(s.v)"))
def convolve_reduce(s, d):
    return stencil.convolve([stencil.dim2([[1] * 3] * 3, lambda a, c, v: F.greatest(a, v), F.lit(-1).cast("long"))], qd(s, d)).df


@query("SELECT a.i0, a.i1, a.v + coalesce(b.v, 0) AS v FROM qd a LEFT JOIN qd b ON b.i0 = a.i0 + 1 AND b.i1 = a.i1 + 1")
def convolve_dim2_border(s, d):
    return stencil.convolve([stencil.dim2("1 0 | 0 1")], qd(s, d), border=lambda y, x, v: F.lit(0).cast("long")).df


@query("SELECT i0 - 1 AS i0, i1 - 1 AS i1, v FROM (" + _stencil_sql("qd", "50", "11", _SX) + ") WHERE i0 BETWEEN 1 AND 48 AND i1 BETWEEN 1 AND 9")
def just_center(s, d):
    return stencil.just_center(stencil.dim2(recipes.SOBEL_X), qd(s, d)).df


@query("SELECT i0, i1, v FROM (" + _stencil_sql("qd", "50", "11", _SX) + ") WHERE i0 BETWEEN 0 AND 9 AND i1 BETWEEN 3 AND 5")
def convolve_range(s, d):
    return stencil.convolve([stencil.dim2(recipes.SOBEL_X)], qd(s, d), block=((0, 3), (10, 6))).df


@query(_stencil_sql("dh", "30", "24", _B5))
def convolve_by_joins(s, d):
    g = stencil.convolve_by_joins(stencil.dim2(_B5), dh(s, d))
    return flow.dmap(lambda v: v.cast("long"), g).df


@query("SELECT a.i0, a.c0 * 2 + l.c0 + r.c0 AS c0, a.c1 * 2 + l.c1 + r.c1 AS c1, a.c2 * 2 + l.c2 + r.c2 AS c2 FROM vec a JOIN vec l ON l.i0 = greatest(0, a.i0 - 1) JOIN vec r ON r.i0 = least((SELECT max(i0) FROM vec), a.i0 + 1)")
def convolve_slices(s, d):
    return _parts(stencil.convolve_slices(stencil.dim1("1 2 1"), 3, vec(s, d)))


# Planes in blocks


@query(_stencil_sql("qd", "50", "11", _SX))
def blocks_convolve(s, d):
    plane = BlockGrid.of(qd(s, d), lines=8)
    return flow.dmap(lambda v: v.cast("long"), plane.convolve([stencil.dim2(recipes.SOBEL_X)]).cells()).df


@query("SELECT CAST(k AS BIGINT) AS i0, coalesce(n, 0) AS v FROM range(256) t(k) LEFT JOIN (SELECT v % 256 AS b, count(*) AS n FROM dh GROUP BY 1) ON b = k")
def blocks_histogram(s, d):
    counts = BlockGrid.of(flow.dmap(lambda v: v % 256, dh(s, d)), lines=7).histogram(256, 1.0)
    return gen.from_list(s, 256, counts.tolist(), "bigint").df


# Loads


@query("SELECT i0, i1, CASE WHEN i0 >= 10 AND i0 < 20 AND i1 >= 2 AND i1 < 8 THEN v * 2 ELSE 0 END AS v FROM qd")
def range_load(s, d):
    g = qd(s, d)
    return load.range_load(flow.dmap(lambda v: v * 2, g), flow.dmap(lambda v: F.lit(0).cast("long"), g), (10, 2), (20, 8)).df


@query("SELECT o.i0, coalesce(e.v, o.v) AS v FROM od o LEFT JOIN ev e ON e.i0 = o.i0")
def load_smaller(s, d):
    return load.load(ev(s, d), od(s, d)).df


@query("SELECT i0, CASE WHEN i0 >= 5 AND i0 < 50 THEN c0 + 1 ELSE c0 END AS c0, CASE WHEN i0 >= 5 AND i0 < 50 THEN c1 + 1 ELSE c1 END AS c1, CASE WHEN i0 >= 5 AND i0 < 50 THEN c2 + 1 ELSE c2 END AS c2 FROM vec")
def load_slices(s, d):
    g = vec(s, d)
    return _parts(load.load_slices(flow.map_elems(lambda c: c + 1, g), g, 3, (5,), (50,)))


@query("SELECT i0, v + 1 AS v FROM ev")
def compute(s, d):
    return flow.dmap(lambda v: v + 1, ev(s, d)).compute().df


# Scalars


@query("SELECT i0, greatest(500, least(20000, v)) AS v FROM ev")
def clamp(s, d):
    return flow.dmap(lambda v: elem.clamp(500, 20000, v), ev(s, d)).df


@query("SELECT i0, least(greatest(v, 700), 20000) + greatest(v, 5000) AS v FROM ev")
def min_max(s, d):
    low, high = F.lit(700).cast("long"), F.lit(20000).cast("long")
    return flow.dmap(lambda v: elem.min_m(elem.max_m(v, low), high) + elem.max_m(v, F.lit(5000).cast("long")), ev(s, d)).df


@query("SELECT i0, CAST(CAST(trunc((v % 256) / 255.0::DOUBLE * 255.0::DOUBLE) AS BIGINT) & 255 AS SMALLINT) AS v FROM ev")
def normalized_to_byte(s, d):
    return flow.dmap(lambda v: elem.normalized_to_byte(elem.normalize_byte(v % 256)), ev(s, d)).df


@query("SELECT i0, c0 + 1 AS c0, c1 * 2 AS c1, -c2 AS c2 FROM vec")
def vector_apply(s, d):
    return _parts(flow.dmap(lambda v: vector.apply([lambda a: a + 1, lambda b: b * 2, lambda c: -c], v), vec(s, d)))


@query("SELECT i0, c0, c1, c2, (c0, c1, c2) > (3000, 3, 2) AS larger FROM vec")
def named_vectors(s, d):
    g = flow.dmap(lambda v: vector.named(*vector.parts(v, 3)), vec(s, d))
    limit = vector.named(*[F.lit(x).cast("long") for x in (3000, 3, 2)])
    return g.df.select("i0", "v.c0", "v.c1", "v.c2", (F.col("v") > limit).alias("larger"))


@query("SELECT i0, CAST(CAST(trunc(v / 7.0::DOUBLE) AS BIGINT) & 255 AS SMALLINT) AS v FROM ev")
def to_byte(s, d):
    return flow.dmap(lambda v: elem.to_byte(v / F.lit(7.0)), ev(s, d)).df


@query("SELECT i0, c0 + 10 * c1 + 100 * c2 AS v FROM vec")
def vector_fold(s, d):
    return flow.dmap(lambda v: vector.ifoldl(1, lambda k: 10 * k, lambda a, k, x: a + x * k, F.lit(0), v, 3), vec(s, d)).df


# Pipelines

def image(s: SparkSession, d: str) -> Grid:
    """The quantity and discount grid in colours of 0..255."""
    return flow.imap(lambda y, x, v: vector.vec((v * 7) % 256, (v * 13 + y) % 256, (v * 29 + x) % 256), qd(s, d))


@query("SELECT i0, i1, CAST(CAST(trunc(0.21::DOUBLE * r + 0.71::DOUBLE * g + 0.07::DOUBLE * b) AS BIGINT) & 255 AS SMALLINT) AS v FROM (SELECT i0, i1, (v * 7) % 256 AS r, (v * 13 + i0) % 256 AS g, (v * 29 + i1) % 256 AS b FROM qd)")
def luminosity(s, d):
    return flow.zip_elems(lambda r, g, b: elem.to_byte(recipes.luminosity(r.cast("double"), g.cast("double"), b.cast("double"))), 3, image(s, d)).df


@query("SELECT i0, i1, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.02::DOUBLE * 1.5 / (1.02::DOUBLE - 0.5)) * (((v * 7) % 256) / 255.0::DOUBLE - 0.5) + 0.5)), 6) AS v FROM qd")
def contrast(s, d):
    red = image(s, d).slices(3)[0]
    return flow.dmap(lambda v: F.round(recipes.contrast(0.5, elem.normalize_byte(v)), 6), red).df


@query("SELECT i0, i1, round(v / 159.0::DOUBLE, 6) AS v FROM (" + _stencil_sql("qd", "50", "11", _B5) + ")")
def blur(s, d):
    return flow.dmap(lambda v: F.round(v, 6), recipes.blur(qd(s, d))).df


@query("SELECT i0, i1, v / 256.0::DOUBLE AS v FROM (" + _stencil_sql("qd", "50", "11", [[a * b for a in (1, 4, 6, 4, 1)] for b in (1, 4, 6, 4, 1)]) + ")")
def blur_separable(s, d):
    g = flow.dmap(lambda v: v, qd(s, d))
    return recipes.blur_separable(g).df


@query("SELECT x.i0, x.i1, CAST(CAST(trunc(sqrt(CAST(x.v * x.v + y.v * y.v AS DOUBLE))) AS BIGINT) & 255 AS INTEGER) AS v FROM (" + _stencil_sql("qd", "50", "11", _SX) + ") x JOIN (" + _stencil_sql("qd", "50", "11", _SY) + ") y ON x.i0 = y.i0 AND x.i1 = y.i1")
def gradient_magnitude(s, d):
    return recipes.gradient(qd(s, d), 0).df.select("i0", "i1", F.col("v.mag").alias("v"))


def _marks_sql(low: int, high: int) -> str:
    """Clauses up to weak and strong edges of the image: lum, bl, gr, marks."""
    outer = [[a * b for a in (1, 4, 6, 4, 1)] for b in (1, 4, 6, 4, 1)]
    near = {"a": "CASE o WHEN 255 THEN 0 WHEN 128 THEN -1 ELSE -1 END", "ax": "CASE o WHEN 255 THEN -1 WHEN 128 THEN 0 WHEN 192 THEN -1 ELSE 1 END"}
    return (
        "lum AS (SELECT i0, i1, CAST(trunc(0.21::DOUBLE * ((v * 7) % 256) + 0.71::DOUBLE * ((v * 13 + i0) % 256) + 0.07::DOUBLE * ((v * 29 + i1) % 256)) AS BIGINT) & 255 AS v FROM qd), "
        f"bl AS (SELECT i0, i1, v / 256.0::DOUBLE AS v FROM ({_stencil_sql('lum', '50', '11', outer)})), "
        f"gr AS (SELECT i0, i1, m, CASE WHEN m < {low} THEN 0 WHEN x = 0 THEN CASE WHEN y < 0 THEN 192 ELSE 64 END WHEN t < 0.33 THEN 255 WHEN t > 0.66 THEN 128 WHEN q < 0 THEN 192 ELSE 64 END AS o FROM ("
        "SELECT *, (b + r * r) / (1.0::DOUBLE + b + (b + r * r)) AS t FROM (SELECT *, 0.596227::DOUBLE * r AS b FROM (SELECT *, abs(q) AS r FROM ("
        "SELECT gx.i0, gx.i1, gx.v AS x, gy.v AS y, CAST(trunc(sqrt(gx.v * gx.v + gy.v * gy.v)) AS BIGINT) & 255 AS m, CASE WHEN gx.v = 0 THEN NULL ELSE gy.v / gx.v END AS q FROM "
        f"({_stencil_sql('bl', '50', '11', _SX, kind='DOUBLE')}) gx JOIN ({_stencil_sql('bl', '50', '11', _SY, kind='DOUBLE')}) gy ON gx.i0 = gy.i0 AND gx.i1 = gy.i1))))), "
        f"marks AS (SELECT g.i0, g.i1, CASE WHEN g.o <> 0 AND g.i0 BETWEEN 1 AND 48 AND g.i1 BETWEEN 1 AND 9 AND g.m > a.m AND g.m > c.m THEN CASE WHEN g.m < {high} THEN 128 ELSE 255 END ELSE 0 END AS v "
        f"FROM (SELECT *, {near['a']} AS dy, {near['ax']} AS dx FROM gr) g LEFT JOIN gr a ON a.i0 = g.i0 + g.dy AND a.i1 = g.i1 + g.dx LEFT JOIN gr c ON c.i0 = g.i0 - g.dy AND c.i1 = g.i1 - g.dx)"
    )


def _fire_sql(cells: str) -> str:
    """Cells 8-connected to a strong one within the rim, of (i0, i1, v) rows."""
    return (
        "SELECT g.i0, g.i1, CASE WHEN f.i0 IS NULL THEN 0 ELSE 255 END AS v FROM qd g LEFT JOIN (WITH RECURSIVE e AS (" + cells + "), "
        "f AS (SELECT i0, i1 FROM e WHERE v = 255 AND i0 BETWEEN 1 AND 48 AND i1 BETWEEN 1 AND 9 UNION SELECT e.i0, e.i1 FROM f JOIN e ON e.v <> 0 AND abs(e.i0 - f.i0) <= 1 AND abs(e.i1 - f.i1) <= 1) "
        "SELECT DISTINCT i0, i1 FROM f) f ON f.i0 = g.i0 AND f.i1 = g.i1"
    )


@query(_fire_sql("SELECT i0, i1, v FROM marks"))
def canny(s, d):
    return recipes.canny(image(s, d), 20, 60).df


_SQL["canny"] = "WITH " + CTES["qd"] + ", " + _marks_sql(20, 60) + " " + _fire_sql("SELECT i0, i1, v FROM marks")


@query("")
def suppress(s, d):
    grey = flow.zip_elems(lambda r, g, b: elem.to_byte(recipes.luminosity(r.cast("double"), g.cast("double"), b.cast("double"))).cast("int"), 3, image(s, d))
    return recipes.suppress(recipes.gradient(recipes.blur_separable(grey), 20), 60).df


_SQL["suppress"] = "WITH " + CTES["qd"] + ", " + _marks_sql(20, 60) + " SELECT i0, i1, v FROM marks"


def _channels(g: Grid) -> list[BlockGrid]:
    return [BlockGrid.of(c, lines=16) for c in g.slices(3)]


@query("")
def blocks_edges(s, d):
    marks = planes.edges(*_channels(image(s, d)), 20, 60).cells()
    return flow.dmap(lambda v: v.cast("int"), marks).df


_SQL["blocks_edges"] = _SQL["suppress"]


_EDGES = "SELECT i0, i1, CASE WHEN (i0 * 7 + i1 * 13 + v) % 11 = 0 THEN 255 WHEN (i0 * 7 + i1 * 13 + v) % 3 = 0 THEN 128 ELSE 0 END AS v FROM qd"


@query(_fire_sql(_EDGES))
def wildfire(s, d):
    mark = lambda y, x, v: F.when((y * 7 + x * 13 + v) % 11 == 0, 255).when((y * 7 + x * 13 + v) % 3 == 0, 128).otherwise(0)
    return recipes.wildfire(flow.imap(mark, qd(s, d))).df


@query("SELECT CAST(b AS BIGINT) AS i0, coalesce(n, 0) AS v FROM range(256) t(b) LEFT JOIN (SELECT CAST(floor(((v * 7) % 256) / 255.0::DOUBLE * 255.99::DOUBLE) AS BIGINT) AS k, count(*) AS n FROM qd GROUP BY 1) ON k = b")
def histogram(s, d):
    return recipes.histogram(flow.dmap(elem.normalize_byte, image(s, d).slices(3)[0])).df


@query(
    "SELECT x.i0, x.i1, round((c.c - z.c) / CAST((SELECT count(*) FROM qd) - z.c AS DOUBLE), 9) AS v FROM (SELECT i0, i1, ((v * 7) % 256) / 255.0::DOUBLE AS l FROM qd) x "
    "JOIN (SELECT b, (SELECT count(*) FROM qd WHERE CAST(floor(((v * 7) % 256) / 255.0::DOUBLE * 255.99::DOUBLE) AS BIGINT) <= b) AS c FROM range(256) t(b)) c ON c.b = CAST(floor(x.l * 255.0::DOUBLE) AS BIGINT) "
    "JOIN (SELECT count(*) AS c FROM qd WHERE CAST(floor(((v * 7) % 256) / 255.0::DOUBLE * 255.99::DOUBLE) AS BIGINT) <= 0) z ON true"
)
def equalize(s, d):
    return flow.dmap(lambda v: F.round(v, 9), recipes.equalize(flow.dmap(elem.normalize_byte, image(s, d).slices(3)[0]))).df


@query(
    "SELECT i0, i1, round(r, 6) AS c0, round(g, 6) AS c1, round(b, 6) AS c2 FROM (SELECT i0, i1, ((v * 7) % 256) / 255.0::DOUBLE AS r, ((v * 13 + i0) % 256) / 255.0::DOUBLE AS g, ((v * 29 + i1) % 256) / 255.0::DOUBLE AS b FROM qd)"
)
def hsl_round_trip(s, d):
    g = flow.dmap(recipes.hsl2rgb, flow.dmap(recipes.rgb2hsl, flow.map_elems(elem.normalize_byte, image(s, d))))
    return _parts(flow.map_elems(lambda c: F.round(c, 6), g))


_RGB = "rgb AS (SELECT i0, i1, ((v * 7) % 256) / 255.0::DOUBLE AS r, ((v * 13 + i0) % 256) / 255.0::DOUBLE AS g, ((v * 29 + i1) % 256) / 255.0::DOUBLE AS b FROM qd)"
_SIXTH, _THIRD, _THIRDS = (f"{x!r}::DOUBLE" for x in (1.0 / 6.0, 1.0 / 3.0, 2.0 / 3.0))
_HSL = (
    "hsl AS (SELECT i0, i1, CASE WHEN hi = lo THEN 0::DOUBLE WHEN hu < 0 THEN hu + 1 ELSE hu END AS h, "
    "CASE WHEN hi = lo THEN 0::DOUBLE WHEN (lo + hi) / 2 <= 0.5::DOUBLE THEN (hi - lo) / (lo + hi) ELSE (hi - lo) / (2 - (lo + hi)) END AS s, CASE WHEN hi = lo THEN hi ELSE (lo + hi) / 2 END AS l FROM ("
    f"SELECT *, CASE WHEN hi = lo THEN 0::DOUBLE WHEN r = hi THEN {_SIXTH} * (g - b) / (hi - lo) WHEN g = hi THEN {_SIXTH} * (b - r) / (hi - lo) + {_THIRD} ELSE {_SIXTH} * (r - g) / (hi - lo) + {_THIRDS} END AS hu "
    "FROM (SELECT *, least(r, g, b) AS lo, greatest(r, g, b) AS hi FROM rgb)))"
)


def _back_sql(table: str) -> str:
    """Colours of (h, s, l) rows, rounded."""
    part = lambda x, c: f"round(CASE WHEN {x} - floor({x}) < {_SIXTH} THEN p + (q - p) * 6 * ({x} - floor({x})) WHEN {x} - floor({x}) < 0.5::DOUBLE THEN q WHEN {x} - floor({x}) < {_THIRDS} THEN p + (q - p) * 6 * ({_THIRDS} - ({x} - floor({x}))) ELSE p END, 6) AS {c}"
    return (
        f"SELECT i0, i1, {part(f'(h + {_THIRD})', 'c0')}, {part('h', 'c1')}, {part(f'(h - {_THIRD})', 'c2')} FROM (SELECT *, 2 * l - q AS p FROM ("
        f"SELECT *, CASE WHEN l < 0.5::DOUBLE THEN l * (1 + s) ELSE l + s - l * s END AS q FROM {table}))"
    )


@query("")
def rgb2hsl(s, d):
    g = flow.dmap(recipes.rgb2hsl, flow.map_elems(elem.normalize_byte, image(s, d)))
    return _parts(flow.map_elems(lambda c: F.round(c, 6), g))


_SQL["rgb2hsl"] = "WITH " + CTES["qd"] + f", {_RGB}, {_HSL} SELECT i0, i1, round(h, 6) AS c0, round(s, 6) AS c1, round(l, 6) AS c2 FROM hsl"


@query("")
def hsl2rgb(s, d):
    g = flow.dmap(recipes.hsl2rgb, flow.map_elems(elem.normalize_byte, image(s, d)))
    return _parts(flow.map_elems(lambda c: F.round(c, 6), g))


_SQL["hsl2rgb"] = "WITH " + CTES["qd"] + f", {_RGB} " + _back_sql("(SELECT i0, i1, r AS h, g AS s, b AS l FROM rgb)")


@query("")
def equalize_lightness(s, d):
    return _parts(flow.map_elems(lambda c: F.round(c, 6), recipes.equalize_lightness(flow.map_elems(elem.normalize_byte, image(s, d)))))


_SQL["equalize_lightness"] = (
    "WITH " + CTES["qd"] + f", {_RGB}, {_HSL}, counts AS (SELECT CAST(floor(l * 255.99::DOUBLE) AS BIGINT) AS k, count(*) AS n FROM hsl GROUP BY 1), "
    "cdf AS (SELECT b, coalesce((SELECT sum(n) FROM counts WHERE k <= b), 0) AS c FROM range(256) t(b)), "
    "even AS (SELECT i0, i1, h, s, CAST(c.c - z.c AS DOUBLE) / CAST((SELECT count(*) FROM qd) - z.c AS DOUBLE) AS l FROM hsl JOIN cdf c ON c.b = CAST(floor(l * 255.0::DOUBLE) AS BIGINT) JOIN cdf z ON z.b = 0) "
    + _back_sql("even")
)


@query("")
def blocks_canny(s, d):
    fired = planes.canny(*_channels(image(s, d)), 20, 60).cells()
    return flow.dmap(lambda v: v.cast("int"), fired).df


_SQL["blocks_canny"] = _SQL["canny"]


def _stored(s: SparkSession, layout: str, g: Grid) -> images.Image:
    """An image written to the shared folder and read back."""
    where = s.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}/gridspark-work"
    path = f"{where}/images/{uuid.uuid4().hex}.png"
    images.write_image(g, path, layout)
    return images.read_image(s, path)


@query("SELECT i0, i1, CAST((v * 7) % 256 AS INTEGER) AS c0, CAST((v * 13 + i0) % 256 AS INTEGER) AS c1, CAST((v * 29 + i1) % 256 AS INTEGER) AS c2 FROM qd")
def image_round_trip(s, d):
    return _parts(images.read_rgb_vectors(_stored(s, "rgb", image(s, d))))


@query("SELECT i0, i1, CAST((v * 7) % 256 AS INTEGER) AS v FROM qd")
def image_grey(s, d):
    return _stored(s, "grey", image(s, d).slices(3)[0]).grid.df


@query("SELECT i0, i1, CAST((v * 7) % 256 + 2 * ((v * 13 + i0) % 256) - (v * 29 + i1) % 256 AS INTEGER) AS v FROM qd")
def image_read_rgb(s, d):
    return images.read_rgb(lambda r, g, b: r + 2 * g - b, _stored(s, "rgb", image(s, d))).df


_BODIES = "b0 AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), 5.9722e24::DOUBLE, 1.470983e11::DOUBLE, 0::DOUBLE, 2.694354528161541e03::DOUBLE, 3.016946927465788e04::DOUBLE), (1, 1.8986e27, -7.405736e11, 0, -1.0965244901087316e02, -1.3710001990210707e04), (2, 1.9889e30, 0, 0, 0, 0)) t(i0, m, x, y, u, w))"


def _step_sql(n: int) -> str:
    """Clauses that bring the bodies from step n to step n + 1: velocities, then positions with them."""
    pull = lambda c: f"sum(CASE WHEN a.i0 = b.i0 THEN 0 ELSE -6.67384e-11::DOUBLE * a.m * b.m * (1 / ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + 0.25)) * sqrt(1 / ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + 0.25)) * (a.{c} - b.{c}) END)"
    return (
        f"v{n} AS (SELECT a.i0, a.m, a.x, a.y, a.u + {pull('x')} * 864000 / a.m AS u, a.w + {pull('y')} * 864000 / a.m AS w FROM b{n} a CROSS JOIN b{n} b GROUP BY a.i0, a.m, a.x, a.y, a.u, a.w), "
        f"b{n + 1} AS (SELECT i0, m, x + u * 864000 AS x, y + w * 864000 AS y, u, w FROM v{n})"
    )


@query("")
def planet_motion(s, d):
    masses = gen.from_list(s, 3, [5.9722e24, 1.8986e27, 1.9889e30], "double")
    places = gen.from_list(s, 3, [[1.470983e11, 0.0, 0.0], [-7.405736e11, 0.0, 0.0], [0.0, 0.0, 0.0]], "array<double>")
    speeds = gen.from_list(s, 3, [[2.694354528161541e03, 3.016946927465788e04, 0.0], [-1.0965244901087316e02, -1.3710001990210707e04, 0.0], [0.0, 0.0, 0.0]], "array<double>")
    moved = recipes.motion(864000.0, 2, masses, places, speeds)[0]
    return _parts(flow.map_elems(lambda c: F.round(c / 100.0).cast("long"), moved), 2)


_SQL["planet_motion"] = f"WITH {_BODIES}, {_step_sql(0)}, {_step_sql(1)} SELECT i0, CAST(round(x / 100.0) AS BIGINT) AS c0, CAST(round(y / 100.0) AS BIGINT) AS c1 FROM b2"


@query("SELECT i0, CAST(sum(v * v) AS BIGINT) AS v FROM em GROUP BY i0")
def embedding_norms(s, d):
    return walk.reduce_inner(F.sum, flow.dmap(lambda v: v * v, em(s, d))).df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the quantity and discount grid: both gradients in shared windows, their size modulo 256."""
    return gradient_magnitude(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f"grid_{k}": v for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"grid_{k}": v for k, v in _SQL.items()}


