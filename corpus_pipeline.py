"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, BPE.

Each stage takes the documents its predecessor kept and returns documents with the same columns;
the last returns the digest of their encoding, a row a document row. Documents that a mix takes
more than once appear as often.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from gridspark.llm.common import documents, release, tune, written
from gridspark.llm.queries import domain, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the base policy."""
    tune(spark)
    return quality_rules.keep(docs, quality_rules.STRICT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near-duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_one(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, domains 4:3:2:1, in up to two epochs; a null source has the domain of an empty one."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(row.alias("row"), domain(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("domain"), "lang", "source", "doc_id", "text")
    weights = spark.sql("SELECT * FROM VALUES ('domain0', 4), ('domain1', 3), ('domain2', 2), ('domain3', 1) AS t(domain, weight)")
    mixed = mixing.Mix(named, ["domain", "lang", "source"], budget_ratio=1.0, weights={"domain": weights}, max_epochs=2)
    return mixed.take(named).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of each document's ids and decoded text."""
    return bpe.digest(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]
#: The last stage's tokenizer is not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs, before = documents(spark, sf_dir), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
            if before is not None:
                release(before)
            before = docs
    return docs
