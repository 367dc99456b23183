"""BPE encoding and decoding with a public tokenizer file.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct piece is
encoded once per task by the ``tokenizers`` library, and a text's ids are its pieces' ids in
order. A piece without such a cut may be very long; it is encoded as a tree of concatenations:
halves are encoded apart, in parallel on the ``spark.task.cpus`` threads that Spark grants a task,
and at each join a window around it is encoded anew, growing until its first and last tokens are
those that stand there already. A sequence in which every two neighbours are stable is the
encoding of the whole, so the joined ids are exact. Special tokens inside a long piece part it.

A task keeps pieces and their ids up to ``TABLE`` bytes, works on a bounded part of a batch at a
time, and gives its memory back when it ends.

Defined results: a null or empty text has no ids and decodes to the empty string. Rows repeat
as they are in the input; a null ``doc_id`` stays null. Extra columns are dropped before the
texts reach Python. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, parts, tidy, tune

#: Pieces longer than this many bytes go through the tree.
LEAF = 2048
#: Tokens at either end of a window that must not change, and the first window's tokens a side.
AGREE, WINDOW = 4, 16
#: Bytes of distinct pieces and their ids that a task keeps, and what a piece takes besides its text and ids.
TABLE, ENTRY = 24 << 20, 200


@dataclass(frozen=True)
class Facts:
    """What the cuts need to know of a tokenizer file; read on the driver and sent with the tasks."""

    path: str
    kind: str
    special: dict[str, int]
    joined: bool
    threads: int = 1


def facts(path: str, threads: int = 1) -> Facts:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: only special tokens that stand for themselves are known")
    pre, kind = spec["pre_tokenizer"], None
    if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
        kind = "byte"
    if pre["type"] == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed":
        kind = "word"
    if kind is None:
        raise ValueError(f"{path}: this pre-tokenizer's cuts are not known")
    return Facts(path, kind, {t["content"]: t["id"] for t in spec["added_tokens"]}, spec["decoder"] is None, threads)


def granted(df: DataFrame, path: str) -> Facts:
    """The facts of a file for tasks of ``df``'s session."""
    return facts(path, int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))


class TreeEncoder:
    """Encodes one long pre-token, already in the model's alphabet; leaves on ``threads`` threads of the library."""

    def __init__(self, spec: dict, threads: int = 1):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.inner = BPE(model["vocab"], merges)
        self.last = BPE(model["vocab"], merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.whole = Tokenizer(self.inner)
        self.threads = threads

    def encode(self, word: str, leaf: int = LEAF) -> list[tuple[int, int]]:
        """(id, characters) of each token of ``word``."""
        parts = [(i, min(i + leaf, len(word))) for i in range(0, len(word), leaf)]
        if not parts:
            return []
        if self.threads == 1:
            level = [self._flat(word, a, b) for a, b in parts]
        else:
            level = [*self._leaves([word[a:b] for a, b in parts[:-1]]), self._flat(word, *parts[-1])]
        spans = parts
        while len(level) > 1:
            joined, wider = [], []
            for i in range(0, len(level) - 1, 2):
                joined.append(self._join(word, spans[i][1], level[i], level[i + 1]))
                wider.append((spans[i][0], spans[i + 1][1]))
            if len(level) % 2:
                joined.append(level[-1])
                wider.append(spans[-1])
            level, spans = joined, wider
        return level[0]

    def _leaves(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        got = self.whole.encode_batch(texts, add_special_tokens=False) if texts else []
        return [[(i, b - a) for i, (a, b) in zip(e.ids, e.offsets, strict=True)] for e in got]

    def _flat(self, word: str, a: int, b: int) -> list[tuple[int, int]]:
        model = self.last if b == len(word) else self.inner
        out = []
        for t in model.tokenize(word[a:b]):
            shown = t.value
            if model is not self.inner and shown.endswith(self.suffix):
                shown = shown[: -len(self.suffix)]
            out.append((t.id, len(shown)))
        return out

    def _join(self, word: str, at: int, left: list, right: list) -> list[tuple[int, int]]:
        k = WINDOW
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            before, after = left[i:], right[:j]
            start = at - sum(n for _, n in before)
            stop = at + sum(n for _, n in after)
            anew = self._flat(word, start, stop)
            fits = i == 0 or anew[:AGREE] == before[:AGREE]
            fits = fits and (j == len(right) or anew[-AGREE:] == after[-AGREE:])
            if fits and len(anew) >= (AGREE if i or j < len(right) else 0):
                return left[:i] + anew + right[j:]
            if i == 0 and j == len(right):
                return anew
            k *= 2


def byte_alphabet() -> dict[int, str]:
    """Byte -> character of byte-level BPE: printable bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """piece -> its ids as bytes of 32-bit integers, for a task.

    The first distinct pieces of a task stay, up to ``most`` bytes (frequent ones come early);
    the rest are encoded once a part of a batch.
    """

    def __init__(self, known: Facts, most: int = TABLE):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if known.threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(known.threads)
        self.known, self.room = known, most
        self.tok = Tokenizer.from_file(known.path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(known.special, key=len, reverse=True)) + ")") if known.special else None
        self.most_id = self.tok.get_vocab_size(with_added_tokens=True) - 1
        self.alphabet = byte_alphabet()
        self.tree: TreeEncoder | None = None

    def entries(self, distinct: list[bytes], plain: np.ndarray) -> list[bytes]:
        """The ids of each piece; ``plain``: those that are letters alone, after a blank at most.

        Plain pieces are one pre-token, so they go to the library's model without its pipeline.
        """
        got = [*map(self.get, distinct)]
        missing = [i for i, e in enumerate(got) if e is None]
        model, words = self.tok.model, self.known.kind == "word"
        for i in missing:
            piece = distinct[i]
            if plain[i] and len(piece) <= LEAF:
                text = (piece.lstrip() if words else piece).decode("latin-1").translate(self.alphabet)
                got[i] = packed([t.id for t in model.tokenize(text)])
            else:
                text = piece.decode()
                if words:
                    text = text.strip(" \t\n\r\x0b\x0c")
                got[i] = packed(self.tok.encode(text, add_special_tokens=False).ids if len(text) <= LEAF else self.long(text))
            cost = len(piece) + len(got[i]) + ENTRY
            if cost <= self.room:
                self[piece] = got[i]
                self.room -= cost
        return got

    def long(self, text: str) -> list[int]:
        """Ids of a long piece: special tokens part it, the library cuts what is between into pre-tokens, and the tree encodes these."""
        if self.tree is None:
            with open(self.known.path, encoding="utf-8") as f:
                self.tree = TreeEncoder(json.load(f), self.known.threads)
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.known.special:
                out.append(self.known.special[part])
                continue
            if self.tok.normalizer:
                part = self.tok.normalizer.normalize_str(part)
            out += [i for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(part) for i, _ in self.tree.encode(word)] if part else []
        return out


#: Cuts of a byte-level pre-tokenizer at white space: a word with one space before it, or a run of white space but for its last character.
BYTE_LEVEL_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that Python takes for white space and the pre-tokenizer's Unicode class does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")


#: What a byte is, as flags: white space, a letter, ASCII that is no letter, a byte that the cuts on whole batches do not handle, the lead byte of U+00C0 to U+00FF.
SPACE, LETTER, OTHER, ODD, LEAD = 1, 2, 4, 8, 16


def _flags() -> bytes:
    out = bytearray(256)
    for b in range(128):
        out[b] = LETTER if chr(b).isalpha() else OTHER
    for b in b"\t\n\x0b\x0c\r ":
        out[b] |= SPACE
    for b in (9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xC3, 0xE1, 0xE2, 0xE3):
        out[b] |= ODD
    out[0xC3] |= LEAD
    return bytes(out)


FLAGS = _flags()
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def flags(data: np.ndarray) -> np.ndarray:
    """The flags of each byte; both bytes of a Latin-1 letter count as letters."""
    got = np.frombuffer(bytearray(data.tobytes().translate(FLAGS)), np.uint8)
    lead = np.flatnonzero(got & LEAD)
    lead = lead[lead + 1 < len(data)]
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    got[lead] = got[lead + 1] = LETTER
    return got


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for letters of ASCII and Latin-1, in place of the library's for the same letters."""
    out = np.frombuffer(bytearray(data.tobytes().translate(LOWER)), np.uint8)
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[lead] += 32
    return out


def starts_of_pieces(data: np.ndarray, offsets: np.ndarray, kind: str, special: list[str]) -> np.ndarray:
    """Where pieces begin: places where the pre-tokenizer always cuts.

    These are before a blank or line end, after other white space, and between a letter and
    ASCII that is none, but not after a blank (it belongs to the word) or an apostrophe (it may).
    Texts with special tokens, and for the byte-level kind those with runs of white space or
    white space beyond blanks and line ends, are cut one by one.
    """
    full = offsets[:-1] < offsets[1:]
    is_ = flags(data)
    space, letter, other = is_ & SPACE, is_ & LETTER, is_ & OTHER
    start = space.copy()
    start[1:] |= space[:-1] & (data[:-1] != 32)
    start[1:] |= letter[:-1] & (other[1:] >> 1)
    start[1:] |= letter[1:] & (other[:-1] >> 1) & ((data[:-1] != 32) & (data[:-1] != 39)) * np.uint8(LETTER)
    start = start.astype(bool)
    start[offsets[:-1][full]] = True
    hits: set[int] = set()
    if kind == "byte":
        odd = is_ & ODD
        odd[1:] |= space[1:] & space[:-1]
        hits.update(np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1).tolist())
    for s in special:
        whole = data.tobytes()
        at = whole.find(s.encode())
        while at >= 0:
            hits.add(int(np.searchsorted(offsets, at, side="right") - 1))
            at = whole.find(s.encode(), at + 1)
    for i in hits:
        a, b = offsets[i], offsets[i + 1]
        start[a:b] = False
        text = data[a:b].tobytes().decode()
        sizes = [len(p.encode()) for p in (cut_byte_level(text, special) if kind == "byte" else [text])]
        start[a + np.cumsum([0, *sizes[:-1]])] = True
    return np.flatnonzero(start)


def cut_byte_level(text: str, special: list[str]) -> list[str]:
    """Pieces of one text for the byte-level pre-tokenizer; the whole text where its cuts are not certain."""
    if ODD_SPACE.search(text) or any(s in text for s in special):
        return [text]
    return BYTE_LEVEL_PIECES.findall(text)


def pieces_of_batch(texts: pa.Array, kind: str, special: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces of a batch of texts, which of them are plain, each piece's number in order, and the pieces at which texts begin (and end)."""
    raw = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return [], np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    starts = starts_of_pieces(data, offsets, kind, special)
    at = np.searchsorted(starts, offsets)
    ends = np.append(starts, len(data)).astype(np.int32)
    data = np.ascontiguousarray(lowered(data) if kind == "word" else data)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    distinct = coded.dictionary
    ends = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1]
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[: ends[-1]]
    letters = np.add.reduceat(flags(data) == LETTER, ends[:-1], dtype=np.int32)
    size = ends[1:] - ends[:-1] - (data[ends[:-1]] == 32)
    return distinct.to_pylist(), (letters == size) & (size > 0), coded.indices.to_numpy(zero_copy_only=False), at


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges, empty ones too."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _joined(shown: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """What is shown of each id, one after the other by text, without the blank that ends it."""
    if not len(ids):
        return pa.array([""] * (len(at) - 1), pa.string())
    taken = shown.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    data = taken.buffers()[2] or pa.py_buffer(b"")
    whole = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[at])), data])
    return pc.utf8_rtrim(whole, " ")


def _map_batches(df: DataFrame, work: Callable, id_col: str, text_col: str, fields: str) -> DataFrame:
    """mapInArrow over (id, text) alone; ``work()`` gives a function from a text array to a list of arrays."""
    kind_of_id = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind_of_id}, {fields}"
    thin = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = work()
        names = ["id", *[x.split()[0] for x in fields.split(", ")]]
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *of(part.column(1))], names=names)

    return thin.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids as decimal text and its decoded text, in one pass.

    Returns (id, n_tokens long, ids_text string, decoded string), a row for each input row.
    Only for tokenizer files without a decoder, where decoding joins token strings with blanks.
    """
    tune(df.sparkSession)
    known = granted(df, path)
    if not known.joined:
        raise ValueError(f"{path}: only a tokenizer file without a decoder is decoded id by id; use decode()")

    def work():
        table = Pieces(known)
        digits = pa.array([f"{i} " for i in range(table.most_id + 1)], pa.string())
        tokens = pa.array([f"{table.tok.id_to_token(i)} " for i in range(table.most_id + 1)], pa.string())

        def of(texts: pa.Array) -> list[pa.Array]:
            ids, n = ids_of_batch(table, texts)
            at = np.concatenate(([0], np.cumsum(n)))
            return [pa.array(n), _joined(digits, ids, at), _joined(tokens, ids, at)]

        return of

    return _map_batches(df, work, id_col, text_col, "n_tokens long, ids_text string, decoded string")


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit integers."""
    return array("I", ids).tobytes()


def ids_of_batch(table: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of texts, and each text's number of ids."""
    distinct, plain, codes, at = pieces_of_batch(texts, table.known.kind, list(table.known.special))
    got = table.entries(distinct, plain)
    size = np.array([*map(len, got)] or [0], np.int64) >> 2
    flat = np.frombuffer(b"".join(got), np.uint32)
    first = np.cumsum(size) - size
    n = size[codes]
    ends = np.cumsum(n)
    where = np.repeat(first[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    return flat[where], sums(n, at)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each text."""
    tune(df.sparkSession)
    known = granted(df, path)

    def work():
        table = Pieces(known)

        def of(texts: pa.Array) -> list[pa.Array]:
            ids, n = ids_of_batch(table, texts)
            return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids.astype(np.int32)))]

        return of

    return _map_batches(df, work, id_col, text_col, "ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string) of arrays of ids, special tokens kept; null ids decode to the empty string."""
    tune(df.sparkSession)

    def make():
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)

        def work(cols: dict[str, list]) -> Iterator[dict[str, list]]:
            for doc, ids in zip(cols["id"], cols["ids"], strict=True):
                yield {"id": [doc], "decoded": [tok.decode(ids or [], skip_special_tokens=False)]}

        return work

    kind_of_id = df.schema[id_col].dataType.simpleString()
    thin = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_rows(thin, make, f"id {kind_of_id}, decoded string").withColumnRenamed("id", id_col)


def digest(df: DataFrame, path: str) -> DataFrame:
    """The digest columns of :func:`encode_decode`, for documents (doc_id, text)."""
    got = encode_decode(df, path)
    return got.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
