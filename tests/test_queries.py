"""Registered queries against their SQL, on small tables of values that the test tables seldom have."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridspark.sources import generate as gen

duckdb = pytest.importorskip("duckdb")


@pytest.fixture
def close(spark, tmp_path):
    """Embeddings with values that a thousandfold float rounds to a whole number, and a double does not."""
    rows = np.zeros((4, 64), np.float32)
    rows[0, ::7], rows[1, 5], rows[2, 40], rows[3, 63] = -0.061, -0.149, 0.053, 0.072
    spark.createDataFrame([(k, row.tolist(), 0) for k, row in enumerate(rows)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def same_as_sql(spark, d, name, table="embeddings"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, d).collect()]
    assert Counter(got) == Counter(want)


def test_embedding_norms_round_as_floats(spark, close):
    same_as_sql(spark, close, "grid_embedding_norms")


@pytest.fixture
def uneven(spark, tmp_path):
    """Embeddings that are missing, empty, too short, too long, or have a missing element."""
    rows = [(0, [0.5] * 64), (1, None), (2, []), (3, [0.25] * 63), (4, [0.125] * 70), (5, [0.75] * 9 + [None] + [0.75] * 54)]
    spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("rows", ["close", "uneven"])
def test_from_packed_is_its_sql(spark, request, rows):
    same_as_sql(spark, request.getfixturevalue(rows), "grid_from_packed")


def test_packed_lines_of_no_cells(spark):
    rows = spark.createDataFrame([(0, []), (1, [1])], "k bigint, vs array<bigint>")
    assert gen.from_packed(rows, (2, 0), [F.col("k")], F.col("vs")).to_list() == []


@pytest.mark.parametrize("rows", ["close", "uneven"])
def test_ireduce_inner_is_its_sql(spark, request, rows):
    same_as_sql(spark, request.getfixturevalue(rows), "grid_ireduce_inner")


@pytest.mark.parametrize("rows", ["close", "uneven"])
def test_packed_rows_are_its_sql(spark, request, rows):
    same_as_sql(spark, request.getfixturevalue(rows), "grid_packed_rows")


@pytest.mark.parametrize("rows", ["close", "uneven"])
def test_reduce_inner_is_its_sql(spark, request, rows):
    same_as_sql(spark, request.getfixturevalue(rows), "grid_reduce_inner")


@pytest.fixture
def wide(spark, tmp_path):
    """Embeddings with sums that fit 64 bits, of which parts do not; one line has no value, one an ordinary sum."""
    high = [9e15, 4.5e15, -3e15, -2.25e15]
    rows = [high + [0.0] * 60, [-x for x in high] + [0.001] * 60, [-0.5] * 64, [None] * 64]
    spark.createDataFrame([(k, v, 0) for k, v in enumerate(rows)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_ireduce_inner_of_parts_beyond_64_bits(spark, wide):
    same_as_sql(spark, wide, "grid_ireduce_inner")


def test_reduce_inner_of_parts_beyond_64_bits(spark, wide):
    same_as_sql(spark, wide, "grid_reduce_inner")
