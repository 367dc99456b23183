"""Quality rules as a bitmask ledger, by built-in functions alone.

Every rule is evaluated once a document; the ledger keeps its measurements and one bit a failed
rule. A policy is a named, versioned mask over those bits, so a new policy reads the ledger and
not the texts, and an ablation (what each rule rejects, and what it alone rejects) is one
aggregation over bits.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Windows of three words are compared by 64-bit hashes
within a document. A document's windows never leave its row, so nothing is shuffled.

Defined results: a null text counts as empty and fails the rule on few words. Rows keep their
ids as they are, null or repeated. An empty table gives an empty ledger. Columns of the input
whose names clash with the ledger's are replaced in the ledger; :func:`keep` returns the input's
columns as they were.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, chars, let

#: (name, failure as SQL over the measurements). A rule's bit is its place; places never change, new rules go at the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "n_words > 0 and 10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("shouting", "word_chars - n_marks >= 50 and 100 * n_upper > 60 * (word_chars - n_marks)"),
    ("few_letters", "word_chars > 0 and 100 * n_marks > 50 * word_chars"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    """The mask of some rules."""
    return sum(1 << BIT[n] for n in names)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if none of them failed."""

    name: str
    version: int
    mask: int


BASE = Policy("base", 1, mask("few_words", "repeated_windows"))
STRICT = Policy("strict", 1, mask(*BIT))
POLICIES = {(p.name, p.version): p for p in (BASE, STRICT)}


def _repeats(hashes: Column) -> Column:
    """Words in windows that stand twice or more, from the windows' hashes in order.

    The hashes are sorted with their places, equal neighbours give the places of repeated
    windows, and each such place covers three words but for those that the next place covers.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        last = F.greatest(F.size(p) - 1, F.lit(0))
        same = F.zip_with(F.slice(p, 1, last), F.slice(p, 2, last), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda z: z.isNotNull()))))

    places = let(pairs, repeated)
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, none, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n")), lambda acc: acc["n"])


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the measurements of each text."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{WS}]+"))
    split = df.withColumns({"__t": t, "__w": words})
    n = F.size("__w")
    some = lambda first: F.slice("__w", first, F.greatest(n - 2, F.lit(0)))
    windows = F.arrays_zip(some(1).alias("a"), some(2).alias("b"), some(3).alias("c"))
    hashed = split.withColumn("__h", F.transform(windows, lambda z: F.xxhash64(z["a"], z["b"], z["c"])))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    left = lambda chars: F.char_length(F.regexp_replace("__t", chars, ""))
    size = F.char_length("__t")
    found = hashed.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (size - left(r"[#*$%&|<>]+")).cast("long"),
            "__l": lines,
            "n_repeat_words": F.when(F.size(F.array_distinct("__h")) < F.size("__h"), _repeats(F.col("__h"))).otherwise(F.lit(0)).cast("long"),
            "n_marks": (size - left(f"[{chars((0x21, 0x40), (0x5B, 0x60), (0x7B, 0x7E))}]+")).cast("long"),
            "n_upper": (size - left(f"[{chars((0x41, 0x5A), (0xC0, 0xD6), (0xD8, 0xDE))}]+")).cast("long"),
        }
    )
    return found.withColumns({"n_lines": F.size("__l").cast("long"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")}).drop("__t", "__w", "__h", "__l")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"]


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with the measurements and ``failed``, the mask of failed rules."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(df, text_col).drop(text_col).withColumn("failed", total.cast("long"))


def passes(policy: Policy, failed: str = "failed") -> Column:
    """Whether a ledger's row passes a policy."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """(policy, version, rule, n_docs, n_failed, n_only): per rule of the policy, the documents that fail it, and those it alone rejects."""
    under = F.col("failed").bitwiseAND(F.lit(policy.mask))
    names = [n for n in BIT if policy.mask >> BIT[n] & 1]
    sums = [F.count("*").alias("n")]
    for n in names:
        bit = 1 << BIT[n]
        sums += [F.coalesce(F.sum((under.bitwiseAND(F.lit(bit)) > 0).cast("long")), F.lit(0)).alias(f"f_{n}"), F.coalesce(F.sum((under == bit).cast("long")), F.lit(0)).alias(f"o_{n}")]
    one = rows.agg(*sums)
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n in names])
    return one.select("n", F.explode(each).alias("r")).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "r.rule", F.col("n").alias("n_docs"), "r.n_failed", "r.n_only")


def keep(df: DataFrame, policy: Policy = STRICT, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that pass a policy."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(text_col).alias("__text"))
    # Counted on the way. A filter is not moved below a count, where it would repeat every rule's expression for each of its uses.
    counted = ledger(whole, "__text").observe(f"ledger-{uuid.uuid4().hex}", F.count("*").alias("n_docs"), F.bit_or("failed").alias("failed"))
    return counted.where(passes(policy)).select("__row.*")


def verdicts(df: DataFrame, policy: Policy = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy, by document."""
    rows = ledger(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select(
        "doc_id", *MEASURES[:5], (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(policy)).alias("kept"), *MEASURES[5:], "failed"
    )


#: :func:`verdicts` over ``documents`` as DuckDB SQL.
SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), numbered AS (SELECT *, row_number() OVER () AS k FROM t
), windows AS (
  SELECT k, i, row(w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM numbered)
), again AS (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM windows
), covered AS (
  SELECT k, count(DISTINCT i + d) AS n FROM (SELECT k, i, unnest([0, 1, 2]) AS d FROM again WHERE c >= 2) GROUP BY k
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '[\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) AS BIGINT) AS n_marks,
         CAST(length(t) - length(regexp_replace(t, '[A-Z\x{00C0}-\x{00D6}\x{00D8}-\x{00DE}]+', '', 'g')) AS BIGINT) AS n_upper
  FROM numbered LEFT JOIN covered USING (k)
), f AS (
  SELECT *, CAST(0{bits} AS BIGINT) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {base}) <> 0 AS base_failed, (failed & {strict}) = 0 AS kept, n_lines, n_marks, n_upper, failed
FROM f
""".replace("{bits}", "".join(f" + CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))).replace("{base}", str(BASE.mask)).replace("{strict}", str(STRICT.mask))
