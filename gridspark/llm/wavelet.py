"""Token ids as wavelet-matrix files: one compressed file a shard, with access, counting and lookup.

File format (little endian): the magic ``GSWM0001``; the header's length as an unsigned 32-bit
integer; the header, JSON with ``n`` (ids), ``docs``, ``levels`` and ``block`` (bits a block);
then the body. The body holds, each as an unsigned 32-bit length and zstandard data, the table
of document ids (64-bit, with a byte a document that is 0 for a null id), the table of
documents' numbers of ids (64-bit), and per level, from the highest bit down, an index and its
blocks. An index has the number of zero bits, then per block its length in the file and the
number of one bits before it. A block is a slice of the level's bit-plane, zstandard-compressed.
Rank is a block's count plus the ones in the block up to the place; select is a search in the
counts and then in a block. So one id is read by decompressing one block a level.

Defined results: a null or empty text has the end id alone. Rows with a null ``doc_id`` come
first, equal ``doc_id`` stand in the order of their texts' hash and text. An empty table writes
no file and gives no rows. Extra columns are dropped before the shuffle.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Pieces, granted, ids_of_batch
from .common import parts, tidy, tune, work_path, written

MAGIC = b"GSWM0001"
#: Bits of a plane in one block; ids of a shard (a document is never divided).
BLOCK, SHARD = 1 << 18, 1 << 22
#: Ids that are moved together.
STEP = 1 << 16


def _put(out: list[bytes], raw: bytes, level: int = 1) -> None:
    import zstandard

    data = zstandard.ZstdCompressor(level=level).compress(raw)
    out.append(struct.pack("<I", len(data)) + data)


def build(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """The file of a shard."""
    import zstandard

    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "levels": levels, "block": BLOCK}).encode()
    out = [MAGIC, struct.pack("<I", len(head)), head]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    _put(out, np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes())
    _put(out, np.asarray(sizes, "<i8").tobytes())
    squeeze = zstandard.ZstdCompressor(level=1)
    cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels - 1, -1, -1):
        one = (cur & cur.dtype.type(1 << level)) != 0
        plane = np.packbits(one)
        blocks = [squeeze.compress(plane[i : i + BLOCK // 8].tobytes()) for i in range(0, len(plane), BLOCK // 8)]
        counts = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
        before = np.cumsum(counts) - counts
        _put(out, struct.pack("<q", len(one) - int(counts.sum())) + np.array([[len(b) for b in blocks], before], "<i8").tobytes())
        out += blocks
        cur = _dealt(cur, one, len(one) - int(counts.sum()))
    return b"".join(out)


def _dealt(cur: np.ndarray, one: np.ndarray, zeros: int) -> np.ndarray:
    """The ids with a zero bit, then those with a one, in order; in steps that stay in cache, and by places, which is faster than by masks."""
    out = np.empty_like(cur)
    z, o = 0, zeros
    for i in range(0, len(cur), STEP):
        part, bits = cur[i : i + STEP], one[i : i + STEP]
        a, b = np.flatnonzero(~bits), np.flatnonzero(bits)
        out[z : z + len(a)], out[o : o + len(b)] = part[a], part[b]
        z, o = z + len(a), o + len(b)
    return out


class WaveletFile:
    """Reads a shard's file; blocks are decompressed when asked for."""

    def __init__(self, data: bytes | memoryview):
        import zstandard

        self.data, self.zstd = memoryview(data), zstandard.ZstdDecompressor()
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack_from("<I", self.data, 8)
        head = json.loads(bytes(self.data[12 : 12 + size]))
        self.n, self.levels, self.block = head["n"], head["levels"], head["block"]
        at = 12 + size
        raw, at = self._get(at)
        ids, known = np.frombuffer(raw, "<i8", head["docs"]), np.frombuffer(raw, np.uint8, offset=8 * head["docs"])
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        raw, at = self._get(at)
        self.sizes = np.frombuffer(raw, "<i8")
        self.zeros, self.where, self.before = [], [], []
        for _ in range(self.levels):
            raw, at = self._get(at)
            (zeros,) = struct.unpack_from("<q", raw)
            lengths, before = np.frombuffer(raw, "<i8", offset=8).reshape(2, -1)
            self.zeros.append(zeros)
            self.where.append(at + np.concatenate(([0], np.cumsum(lengths))))
            self.before.append(before)
            at += int(lengths.sum())

    def _get(self, at: int) -> tuple[bytes, int]:
        (size,) = struct.unpack_from("<I", self.data, at)
        return self.zstd.decompress(self.data[at + 4 : at + 4 + size]), at + 4 + size

    def _bits(self, row: int, k: int) -> np.ndarray:
        """The bits of block ``k`` of the plane ``row`` (0: highest bit)."""
        raw = self.zstd.decompress(self.data[self.where[row][k] : self.where[row][k + 1]])
        return np.unpackbits(np.frombuffer(raw, np.uint8))[: min(self.block, self.n - k * self.block)].astype(bool)

    def _ones(self, row: int, i: int) -> int:
        """One bits before place ``i``."""
        if i >= self.n:
            return self.n - self.zeros[row]
        k, rest = divmod(i, self.block)
        return int(self.before[row][k]) + (int(self._bits(row, k)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for row in range(self.levels):
            k, rest = divmod(i, self.block)
            bits = self._bits(row, k)
            ones = int(self.before[row][k]) + int(bits[:rest].sum())
            out = out << 1 | int(bits[rest])
            i = self.zeros[row] + ones if bits[rest] else i - ones
        return out

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often ``token`` stands in places start to stop, exclusive."""
        a, b = self._range(token, start, self.n if stop is None else min(stop, self.n))
        return b - a

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token < 0 or token >> self.levels or a >= b:
            return 0, 0
        for row in range(self.levels):
            x, y = self._ones(row, a), self._ones(row, b)
            a, b = (self.zeros[row] + x, self.zeros[row] + y) if token >> (self.levels - 1 - row) & 1 else (a - x, b - y)
            if a >= b:
                return 0, 0
        return a, b

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th occurrence (from 0) of ``token``; -1 if there are fewer."""
        first, last = self._range(token, 0, self.n)
        if not 0 <= k < last - first:
            return -1
        i = first + k
        for row in range(self.levels - 1, -1, -1):
            one = bool(token >> (self.levels - 1 - row) & 1)
            i = self._place(row, one, i - self.zeros[row] if one else i)
        return i

    def _place(self, row: int, one: bool, k: int) -> int:
        """The place of the ``k``-th one (or zero) bit."""
        base = self.before[row] if one else np.arange(len(self.before[row])) * self.block - self.before[row]
        block = int(np.searchsorted(base, k, side="right")) - 1
        bits = self._bits(row, block)
        return block * self.block + int(np.flatnonzero(bits if one else ~bits)[k - int(base[block])])

    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for row in range(self.levels - 1, -1, -1):
            one = np.concatenate([self._bits(row, k) for k in range(len(self.before[row]))]) if self.n else np.zeros(0, bool)
            out = np.empty_like(cur)
            zeros = self.zeros[row]
            z, o, bit = 0, zeros, kind(1 << (self.levels - 1 - row))
            for i in range(0, self.n, STEP):
                part, bits = out[i : i + STEP], one[i : i + STEP]
                a, b = np.flatnonzero(~bits), np.flatnonzero(bits)
                part[a], part[b] = cur[z : z + len(a)], cur[o : o + len(b)] | bit
                z, o = z + len(a), o + len(b)
            cur = out
        return cur


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_shards(df: DataFrame, path: str, folder: str, end_id: int, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, appends ``end_id`` and writes wavelet files to ``folder`` in ascending id order.

    Returns the manifest (part, seq, file, n_docs, n_tokens), a row a file, as a table in the
    shared folder. ``folder`` is a URI that driver and executors share. A task that runs again
    writes the same files under the same names, each put in place by a rename.
    """
    spark = tune(df.sparkSession)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = granted(df, path)
    thin = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = thin.repartitionByRange(shards, "id", tie).sortWithinPartitions("id", tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, seq, held, n = task.partitionId(), 0, [], 0
        table = Pieces(known)
        store, top = _files(folder)

        def flush() -> pa.RecordBatch:
            data = build(np.concatenate([h[0] for h in held]), [d for h in held for d in h[1]], np.concatenate([h[2] for h in held]))
            name = f"{top}/part-{part:06d}-{seq:06d}.gswm"
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as f:
                f.write(data)
            store.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            row = {"part": part, "seq": seq, "file": name, "n_docs": sum(len(h[1]) for h in held), "n_tokens": n}
            return pa.RecordBatch.from_pylist([row], schema=MANIFEST)

        store.create_dir(top, recursive=True)
        for batch in batches:
            for one in parts(batch):
                ids, sizes = ids_of_batch(table, one.column(1))
                ends = np.cumsum(sizes)
                whole = np.insert(ids.astype(np.uint16 if table.most_id < 65536 else np.uint32), ends, end_id)
                held.append((whole, one.column(0).to_pylist(), sizes + 1))
                n += len(whole)
                if n >= SHARD:
                    yield flush()
                    seq, held, n = seq + 1, [], 0
        if held:
            yield flush()

    return written(dealt.mapInArrow(tidy(run), "part int, seq int, file string, n_docs long, n_tokens long"), "manifest")


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the files back: (doc_id, start, n_tokens, ids_crc32), from the files' own contents."""
    spark = manifest.sparkSession
    # One row a file: the running total is over the list of files, not over documents.
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long").alias("first"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["file"]) as f:
                    shard = WaveletFile(f.read())
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.sizes)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(shard.sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(row["first"] + ends - shard.sizes), pa.array(shard.sizes), pa.array(crc, pa.int64())], schema=READ)

    return placed.repartition(tasks, "file").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, path: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Writes the shards to the shared folder and reads them back."""
    folder = work_path(df.sparkSession, "shards")
    return read_shards(write_shards(df, path, folder, end_id, shards), folder)
