"""The queries of this subpackage: thin wrappers that apply an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, license_scan, minhash, mixing, quality_model, quality_rules, secret_scan, wavelet
from .common import documents


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(documents(spark, sf_dir)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.licenses(documents(spark, sf_dir)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=2)


def domain(source: Column) -> Column:
    """A domain for a source: the first hexadecimal digit of its MD5 modulo 4."""
    return F.concat(F.lit("domain"), (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source.cast("binary")), 1, 1)) % 4).cast("string"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 % of the corpus's tokens, domains 4:3:2:1, languages and sources alike, up to three epochs.

    A null source has no domain and is not taken, as in ``MIXING_SQL``, though its tokens count for the budget.
    """
    docs = documents(spark, sf_dir).withColumn("domain", domain(F.col("source")))
    weights = spark.sql("SELECT * FROM VALUES ('domain0', 4), ('domain1', 3), ('domain2', 2), ('domain3', 1) AS t(domain, weight)")
    return mixing.Mix(docs, ["domain", "lang", "source"], budget_ratio=0.6, weights={"domain": weights}, max_epochs=3).documents()


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


ALL = (op1_bpe, op2_quality_model, op3_minhash, op4_secrets, op5_quality_rules, op6_licenses, op7_langid, op8_wavelet, op9_mixing, op10_exact_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def _fill(nodes: str, parent: str, name: str) -> str:
    """SQL for :func:`gridspark.llm.mixing.shares` over rows with cap, w and budget."""
    order = f"PARTITION BY {parent} ORDER BY cap / w, {name}"
    return f"""
  SELECT * EXCLUDE (r, before, rest, level, cut), CASE WHEN cut IS NULL THEN cap ELSE greatest(0, least(cap, cut * w)) END AS share FROM (
    SELECT *, arg_min(level, row(r, {name})) FILTER (WHERE r > level) OVER (PARTITION BY {parent}) AS cut FROM (
      SELECT *, (budget - before) / rest AS level FROM (
        SELECT *, cap / w AS r, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ({nodes}))))"""


_DOMAINS = _fill("SELECT domain, CAST(sum(3 * tokens) AS DOUBLE) AS cap, CAST(any_value(w) AS DOUBLE) AS w, any_value(b) AS budget FROM leaf JOIN (VALUES ('domain0', 4), ('domain1', 3), ('domain2', 2), ('domain3', 1)) t(domain, w) USING (domain) CROSS JOIN total GROUP BY domain", "1", "domain")
_LANGS = _fill("SELECT domain, lang, CAST(sum(3 * tokens) AS DOUBLE) AS cap, CAST(1 AS DOUBLE) AS w, any_value(share) AS budget FROM leaf JOIN domains USING (domain) GROUP BY domain, lang", "domain", "lang")
_SOURCES = _fill("SELECT domain, lang, source, tokens, CAST(3 * tokens AS DOUBLE) AS cap, CAST(1 AS DOUBLE) AS w, share AS budget FROM leaf JOIN (SELECT domain, lang, share FROM langs) USING (domain, lang)", "domain, lang", "source")
#: :func:`op9_mixing` as DuckDB SQL.
MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, 'domain' || (instr('0123456789abcdef', substr(md5(source), 1, 1)) % 4) AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents
), leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY ALL
), total AS (SELECT CAST(0.6 AS DOUBLE) * CAST(sum(tokens) AS DOUBLE) AS b FROM leaf
), domains AS ({_DOMAINS}
), langs AS ({_LANGS}
), sources AS ({_SOURCES}
), given AS (
  SELECT domain, lang, source, tokens, CAST(floor(share) AS BIGINT) AS given, CASE WHEN tokens > 0 THEN CAST(floor(share) AS BIGINT) // tokens ELSE 0 END AS epochs FROM sources
), placed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('0:' || epochs || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN given USING (domain, lang, source)
), taken AS (SELECT *, epochs + CASE WHEN before < given - epochs * tokens THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, domain, lang, source, n AS n_tokens, tokens AS leaf_tokens, given AS leaf_budget, CAST(copies AS BIGINT) AS copies FROM taken WHERE copies > 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash": minhash.SQL, "op5_quality_rules": quality_rules.SQL, "op9_mixing": MIXING_SQL, "op10_exact_dedup": exact_dedup.SQL}
