"""Language identification by compression.

Each language has a raw-content zstandard dictionary: pieces of its own training texts. A text
is compressed with each of them, in lower case and with single blanks for all that is no letter,
block by block so that the dictionary stays in reach however long the text is, and the language
that gives the fewest bytes is predicted; each adds the information of its share of the training
documents, which decides between equal sizes. Where the runner-up is nearly as small the
prediction is marked as rejected.

The dictionaries are the only thing learned. They are fitted on a bounded sample: per language
the ``DOCS`` distinct training texts with the smallest hash, whole or, of a text longer than
``PIECE`` characters, ``CUTS`` cuts spread evenly over all of it from a hashed place in its first
part on, so that neither copies nor a common opening fill a dictionary. Each text is compressed
once a language, so the time grows with the number of languages that the labels have.

Defined results: a null text or one without a letter is ``und`` with score 0. Texts of a null
language are not learned from. Without training documents everything is ``und``. Rows keep their
ids, null or repeated. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tune

#: Bounds of the fit: documents a language, characters of each, and the cuts that these come from. Languages are the label's values.
DOCS, PIECE, CUTS = 128, 1024, 8
#: Groups of partitions whose smallest hashes are found first.
FAN = 16
#: Bytes of text that are compressed at once.
BLOCK, LEVEL = 4096, 3
#: A margin between the two smallest sizes, relative to the smaller, below which a prediction is rejected.
NARROW = 0.01


#: All that is no letter.
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is compressed of a text."""
    return OTHER.sub(" ", text.lower()).encode()


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def dictionaries(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[bytes, float]]:
    """Each language's dictionary and share of the training documents; at most ``DOCS * PIECE`` characters a language reach the driver."""
    rows = df.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    first_of = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("k") <= DOCS)
    text = F.col(text_col).cast("string")
    key = [F.col(lang_col).alias("lang"), F.xxhash64(text, F.lit(7)).alias("h")]
    # Only hashes are exchanged; texts are cut where they are read. The smallest are found in a tree, of
    # groups of partitions and then of languages, so no task reads every partition's; any grouping gives the same.
    some = first_of(rows.select(*key).distinct().withColumn("part", F.spark_partition_id() % FAN), "lang", "part")
    best = first_of(some.select("lang", "h"), "lang")
    size = PIECE // CUTS - 1
    first = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1000)) / 1000.0
    cuts = [F.substring("text", ((first + i) * (F.length("text") - size) / CUTS).cast("int") + 1, F.lit(size)) for i in range(CUTS)]
    piece = F.when(F.length("text") <= PIECE, F.col("text")).otherwise(F.concat_ws(" ", *cuts))
    pieces = rows.select(*key, text.alias("text")).join(F.broadcast(best), ["lang", "h"]).groupBy("lang", "k").agg(F.min(piece).alias("piece"))
    out: dict[str, list] = {}
    for r in sorted(pieces.collect()):
        out.setdefault(r["lang"], []).append(r["piece"])
    counts = dict(rows.groupBy(lang_col).count().collect())
    return {k: (letters(" ".join(v)), counts[k] / sum(counts.values())) for k, v in out.items()}


def classify(df: DataFrame, known: dict[str, tuple[bytes, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row."""
    tune(df.sparkSession)
    langs = sorted(known)
    thin = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        prior = np.array([-np.log2(known[lang][1]) / 8 for lang in langs])
        for lang in langs:
            words = zstandard.ZstdCompressionDict(known[lang][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))

        def one(text: str | None) -> tuple[str, float, bool]:
            if not text or not langs or not any(c.isalpha() for c in text):
                return "und", 0.0, True
            data = letters(text)
            blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
            sizes = np.array([sum([len(c.compress(b)) for b in blocks]) for c in coders], float) + prior
            best = int(sizes.argmin())
            unit = max(1.0, 0.005 * sizes[best])
            score = 1.0 / np.exp((sizes[best] - sizes) / unit).sum()
            rest = np.delete(sizes, best)
            narrow = bool(len(rest)) and rest.min() - sizes[best] < NARROW * sizes[best]
            return langs[best], float(score), narrow

        for batch in batches:
            got = [one(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "lang_pred", "score", "rejected"])

    return thin.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned from the rows that are not held out, applied to all."""
    out = F.coalesce(fold(id_col, 3) == 1, F.lit(True))
    known = dictionaries(df, ~out, id_col, text_col, lang_col)
    return classify(df, known, id_col, text_col).withColumn("held_out", out).select(id_col, "held_out", "lang_pred", "score", "rejected")
