"""Exact copies by compressed radix tries.

Texts are equal when identical after deleting the characters of ``[\\x20\\x09-\\x0D]``. Each input
partition first merges its own copies in a trie, so a text leaves a partition once however often
it stands there. What is left is dealt out by length and content hash, and each task inserts the
full byte strings into a Patricia trie whose terminal nodes keep the row that stays: most code
points in the original text, then the smallest id. A task's rows come sorted by length and hash,
so a subtree is complete when the next one begins: the trie is emitted and emptied there once it
holds ``BUDGET`` bytes, and Spark's sort does the spilling. Memory holds one budget's worth of
distinct texts whatever the sizes of groups. Nodes refer to the texts they were cut from, so a
text is held once. The owners, a short row a text, are a written table; rows find theirs by a
join in which a text with many copies is dealt out over many tasks.

Defined results: a null text counts as empty, and empty and blank texts are copies of each
other. Equal rows (even with one id) are rows of one group and each counts. A null id is larger
than all others. An empty table gives no rows. Extra columns are dropped before the shuffle;
:func:`keep_one` keeps them, whatever their names, and where rows of a group agree in the id and
code points of the row that stays, the one with the smallest MD5 of its text, then the smallest
JSON of its other columns, stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, parts, salted, tidy, tune, written

#: Bytes that a trie holds before finished subtrees leave it, and what a text takes besides its own bytes.
BUDGET, ENTRY = 32 << 20, 500
#: Bytes of text that leave a trie together.
OUT = 4 << 20
BLANKS = b"\t\n\x0b\x0c\r "


class Node:
    """An edge, bytes ``lo`` to ``hi`` of a text, the children by first byte and, at the end of a text, its owner."""

    __slots__ = ("text", "lo", "hi", "children", "owner")

    def __init__(self, text: bytes, lo: int, hi: int):
        self.text, self.lo, self.hi, self.children, self.owner = text, lo, hi, None, None


def better(a: tuple[int, int | None], b: tuple[int, int | None]) -> bool:
    """Whether (code points, id) ``a`` stays rather than ``b``."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


class Patricia:
    """A compressed radix trie over byte strings; terminal nodes hold [points, id, rows, payload]."""

    def __init__(self):
        self.root, self.bytes, self.terminals = Node(b"", 0, 0), 0, []

    def insert(self, text: bytes, points: int, ident: int | None, rows: int, payload=None) -> None:
        node, at = self.root, 0
        while at < len(text):
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = node = Node(text, at, len(text))
                break
            edge = child.text[child.lo : child.hi]
            if text.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            n = common_prefix(edge, text, at)
            middle = Node(child.text, child.lo, child.lo + n)
            child.lo += n
            middle.children = {edge[n]: child}
            node.children[text[at]] = middle
            node, at = middle, at + n
        if node.owner is None:
            node.owner = [points, ident, rows, payload]
            self.bytes += len(text) + ENTRY
            self.terminals.append(node.owner)
            return
        node.owner[2] += rows
        if better((points, ident), (node.owner[0], node.owner[1])):
            node.owner[:2] = points, ident


def common_prefix(edge: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``edge`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(edge[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An input partition's copies merged: distinct text with its best row and the number of rows."""
    trie = Patricia()

    def emit() -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for i, owner in enumerate(trie.terminals):
            part.append(owner)
            size += len(owner[3])
            if size >= OUT or len(part) == 500 or i == len(trie.terminals) - 1:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(o[3]) for o in part], pa.int64()),
                        pa.array([hashlib.sha256(o[3]).digest() for o in part], pa.binary()),
                        pa.array([o[3] for o in part], pa.binary()),
                        pa.array([o[0] for o in part], pa.int64()),
                        pa.array([o[1] for o in part], pa.int64()),
                        pa.array([o[2] for o in part], pa.int64()),
                    ],
                    names=["len", "hash", "body", "points", "id", "n"],
                )
                part, size = [], 0

    for batch in batches:
        for rows in parts(batch):
            texts = pc.fill_null(rows.column(1), "")
            points = pc.utf8_length(texts).to_pylist()
            for ident, text, p in zip(rows.column(0).to_pylist(), texts.cast(pa.binary()).to_pylist(), points, strict=True):
                body = text.translate(None, BLANKS)
                trie.insert(body, p, ident, 1, body)
                if trie.bytes > BUDGET:
                    yield from emit()
                    trie = Patricia()
    yield from emit()


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text's owner and number of rows; the rows come sorted by length and hash."""
    trie, last = Patricia(), None

    def emit() -> pa.RecordBatch:
        part = trie.terminals
        if len({o[3] for o in part}) < len(part):
            raise ValueError("two different texts have one SHA-256")
        return pa.RecordBatch.from_arrays(
            [pa.array([o[3] for o in part], pa.string()), pa.array([o[1] for o in part], pa.int64()), pa.array([o[0] for o in part], pa.int64()), pa.array([o[2] for o in part], pa.int64())],
            names=["text_sha256", "keep_id", "keep_points", "group_size"],
        )

    for batch in batches:
        for rows in parts(batch, 2):
            for size, digest, body, points, ident, n in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                if trie.bytes > BUDGET and (size, digest) != last:
                    yield emit()
                    trie = Patricia()
                last = (size, digest)
                trie.insert(body, points, ident, n, digest.hex())
    if trie.terminals:
        yield emit()


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_sha256, keep_id, keep_points, group_size), a row a distinct normalised text."""
    tune(df.sparkSession)
    thin = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    merged = thin.mapInArrow(tidy(_local), "len long, hash binary, body binary, points long, id long, n long")
    dealt = merged.repartition("len", "hash").sortWithinPartitions("len", "hash")
    return dealt.mapInArrow(tidy(_owners), "text_sha256 string, keep_id long, keep_points long, group_size long")


def keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with text_sha256 of the normalised text, by built-in functions."""
    body = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), f"[{WS}]+", "")
    return df.withColumn("text_sha256", F.sha2(body.cast("binary"), 256))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: (doc_id, keep_id, group_size, kept, text_sha256).

    Where several rows of a group share the id that stays, all of them are marked kept.
    """
    slim = keys(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text").select("doc_id", "text_sha256")
    own = written(owners(df, id_col, text_col), "owners")
    return salted(slim, own, ["text_sha256"], "doc_id", own, "group_size").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that stay: one a group; ties as above."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    tagged = keys(df.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text").select("row", "id", F.col("text_sha256").alias("sha"))
    own = written(owners(df, id_col, text_col).withColumnRenamed("text_sha256", "sha"), "owners")
    same = salted(tagged, own, ["sha"], "id", own, "group_size").where(F.col(f"row.`{id_col}`").eqNullSafe(F.col("keep_id")) & (F.char_length(text) == F.col("keep_points")))
    rest = F.to_json(F.struct(F.lit(0), *[F.col(f"row.`{c}`") for c in df.columns if c != text_col]))
    best = same.groupBy("sha").agg(F.min_by("row", F.struct(F.md5(text.cast("binary")), rest)).alias("row"))
    return best.select("row.*")


#: :func:`dedup` over ``documents`` as DuckDB SQL.
SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM k
"""
