"""Secrets in text, by built-in functions alone: fixed patterns and a battery of randomness tests.

Patterns find assignments to secret-like names, access keys and long hexadecimal runs, leftmost
and non-overlapping per kind. The battery looks at every run of 20 or more characters of the
usual encodings' alphabets; ``=`` is in none of them, so it parts runs and belongs to one only as
its end. A run with characters of both base64 and base64url is tested as a whole over both
alphabets, and so are its longest parts of 20 or more characters that fit one of the two, as a key
in a path does; their spans may overlap. Every run is tested.

The battery infers the encoding from the characters that occur, codes each character by its
place in that alphabet and tests uniformity (chi-squared), runs about the middle, and serial
correlation at lag one, from sums that one pass over the characters gives. Three times the
smallest of the three p-values, at most one, is a p-value whatever their dependence. False
discoveries are then controlled twice, per octave of length. First the Benjamini-Yekutieli
procedure on the battery's p-values decides which runs are not random; under any dependence at
most ``FDR`` of these are expected to be random. What it leaves includes runs too short for the
tests to tell, so it is held against ordinary text: the likelihood ratio of uniform characters
to the best of some models of text by classes of characters is an e-value, which grows with the
length of a random run, and the e-value form of the Benjamini-Hochberg procedure, in which runs
found not random have an e-value of 0, gives the discoveries. Both thresholds come from counts
by octave and step of a logarithm, so the corpus is counted, never sorted or collected.

Defined results: a null text counts as empty and has no spans. Positions are code points, ends
exclusive. Equal rows give equal results. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chars, let, written

# The kinds in order, with pattern, number of the group that counts, and its least length.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs are whole, so the least length can stand in the pattern
_RUN = chars((48, 57), (65, 90), (97, 122)) + r"+/_\-"
RUN = f"[{_RUN}]{{20,}}(?:=+(?![{_RUN}=]))?"
#: Runs of more than one alphabet, and what of them is tested besides the whole.
MIXED = ["[+/]", "[_-]"]
PARTS = ["[A-Za-z0-9+/]{20,}=*", "[A-Za-z0-9_-]{20,}=*"]

FDR = 0.01
#: Steps of the logarithms of p- and e-values in which they are counted, and the largest one told
#: apart: 400 stands for a chance of 1e-174, which passes any threshold of fewer than 1e170 runs.
STEP, MOST = 0.25, 400.0
#: Encodings from narrow to wide: name, alphabet, characters that only fill up its end.
_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("decimal", _DIGIT),
    ("hex", _DIGIT + "abcdef"),
    ("HEX", _DIGIT + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGIT + _LOWER),
    ("BASE36", _DIGIT + _UPPER),
    ("base62", _UPPER + _LOWER + _DIGIT),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
    ("mixed", _UPPER + _LOWER + _DIGIT + "+/-_"),
]
#: Classes of characters with their sizes, and models of text: the share of each class, spread evenly over it.
CLASSES = {"[a-z]": 26, "[A-Z]": 26, "[0-9]": 10, "[+/_-]": 4}
TEXT = {"prose": (0.80, 0.06, 0.10, 0.04), "capitals": (0.06, 0.80, 0.10, 0.04), "numbers": (0.06, 0.06, 0.84, 0.04)}
#: Matches, and characters of a run, that are gone over together.
BLOCK, SECTION = 256, 8192


def located(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """Matches as array<struct<start, stop, value>>: places of the whole match, and the group's text.

    What stands between matches and the matches themselves are laid end to end. Running sums
    go over blocks, so that a text with very many matches is not copied once a match.
    """
    of = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.arrays_zip(
        F.split(text, of, -1).alias("gap"), F.regexp_extract_all(text, of, F.lit(0)).alias("all"), F.regexp_extract_all(text, of, F.lit(group)).alias("value")
    )
    items = F.transform(parts, lambda z: F.struct(F.char_length(z["gap"]).alias("gap"), F.coalesce(F.char_length(z["all"]), F.lit(0)).alias("n"), z["value"].alias("value")))
    kind = "array<struct<start:int,stop:int,value:string>>"

    def spans(base: Column, block: Column) -> Column:
        start = F.struct(base.cast("int").alias("at"), F.array().cast(kind).alias("out"))

        def add(acc: Column, x: Column) -> Column:
            a = acc["at"] + x["gap"]
            one = F.struct(a.alias("start"), (a + x["n"]).alias("stop"), x["value"].alias("value"))
            return F.struct((a + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(block, start, add, lambda acc: acc["out"])

    def all_of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(xs, i + 1, F.lit(BLOCK)))
        total = lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"])
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def bases(bs: Column) -> Column:
            return F.aggregate(
                bs, first, lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"]
            )

        return F.flatten(let(blocks, lambda bs: F.zip_with(bs, bases(bs), lambda b, base: spans(base, b))))

    return F.filter(let(items, all_of), lambda x: x["value"].isNotNull())


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by a polynomial with errors under 1e-7."""
    t = 1.0 / (1.0 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi) * poly


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, v: a + v)


def moments(body: Column, letters: Column) -> Column:
    """struct<n, k, first, last, s, ss, lag, ones, turns> of a run's codes, its characters' places in ``letters``.

    Sums of all but the last code and its square, of products of neighbours, and numbers of codes
    in the upper half (all but the last) and of changes of half. Sections of the run, of bounded
    length, are gone over one after the other, each with the first character of the next.
    """
    fields = ("s", "ss", "lag", "ones", "turns")
    zero = [F.lit(0).cast("long").alias(f) for f in fields]

    def section(codes: Column, half: Column) -> Column:
        start = F.struct(F.element_at(codes, 1).alias("prev"), *zero)
        upper = lambda c: F.when(c >= half, F.lit(1)).otherwise(F.lit(0)).cast("long")

        def step(acc: Column, c: Column) -> Column:
            a = acc["prev"]
            grown = (a, a * a, a * c, upper(a), F.when((a >= half) != (c >= half), F.lit(1)).otherwise(F.lit(0)).cast("long"))
            return F.struct(c.alias("prev"), *[(acc[f] + x).alias(f) for f, x in zip(fields, grown, strict=True)])

        return F.aggregate(F.slice(codes, 2, F.size(codes)), start, step)

    def of(h: Column) -> Column:
        code = lambda c: (F.instr(h["letters"], c) - 1).cast("long")
        starts = F.sequence(F.lit(0), F.greatest(h["n"] - 2, F.lit(0)), F.lit(SECTION))
        text = lambda i: F.substring(h["raw"], i + 1, F.lit(SECTION + 1)).cast("string")
        codes = lambda i: F.transform(F.filter(F.split(text(i), ""), lambda c: c != ""), code)
        each = F.transform(starts, lambda i: let(codes(i), lambda c: section(c, h["half"])))
        added = F.aggregate(each, F.struct(*zero), lambda acc, x: F.struct(*[(acc[f] + x[f]).alias(f) for f in fields]))
        one = lambda at: code(F.substring(h["raw"], at, F.lit(1)).cast("string"))
        return let(added, lambda a: F.struct(h["n"].alias("n"), h["k"].alias("k"), one(F.lit(1)).alias("first"), one(h["n"]).alias("last"), *[a[f].alias(f) for f in fields]))

    k = F.char_length(letters)
    return let(F.struct(body.cast("binary").alias("raw"), letters.alias("letters"), F.char_length(body).alias("n"), k.alias("k"), (k / 2.0).alias("half")), of)


def battery(body: Column) -> Column:
    """struct<encoding, n, p, log_e> of a run of characters without its final ``=``."""
    pick = F.lit(None).cast("string")
    letters = F.lit(None).cast("string")
    for name, alphabet in reversed(ENCODINGS):
        fits = body.rlike("^[" + alphabet.replace("-", r"\-").replace("/", r"\/") + "]+$")
        pick = F.when(fits, F.lit(name)).otherwise(pick)
        letters = F.when(fits, F.lit(alphabet)).otherwise(letters)

    def tested(head: Column, m: Column) -> Column:
        n, k = m["n"].cast("double"), m["k"].cast("double")
        # A character's count is what the run loses without it.
        each = F.transform(F.filter(F.split(head["letters"], ""), lambda c: c != ""), lambda c: F.char_length(head["body"]) - F.char_length(F.replace(head["body"], c, F.lit(""))))
        squares = total(F.transform(each, lambda c: c.cast("long") * c.cast("long"))).cast("double")
        chi, df = k / n * squares - n, k - 1.0
        hilferty = (F.pow(F.greatest(chi / df, F.lit(1e-9)), F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        p_chi = F.when(hilferty <= 0, 1.0).otherwise(normal_tail(hilferty))

        ones = (m["ones"] + F.when(m["last"] >= k / 2.0, F.lit(1)).otherwise(F.lit(0))).cast("double")
        runs = 1.0 + m["turns"].cast("double")
        mean = 2.0 * ones * (n - ones) / n + 1.0
        var = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
        p_runs = F.when(var <= 0, 0.0).otherwise(2.0 * normal_tail(F.abs(runs - mean) / F.sqrt(var)))

        s, ss = (m["s"] + m["last"]).cast("double"), (m["ss"] + m["last"] * m["last"]).cast("double")
        own = ss - s * s / n
        lag = m["lag"].cast("double") - s / n * (2.0 * s - (m["first"] + m["last"]).cast("double")) + (n - 1.0) * (s / n) * (s / n)
        p_serial = F.when(own <= 0, 0.0).otherwise(2.0 * normal_tail(F.abs(lag / own + 1.0 / n) * F.sqrt(n)))

        def evidence(counts: Column) -> Column:
            said = [sum((counts[f"c{i}"].cast("double") * math.log(share / size) for i, (share, size) in enumerate(zip(shares, CLASSES.values(), strict=True))), F.lit(0.0)) for shares in TEXT.values()]
            return -n * F.log(k) - F.greatest(*said)

        log_e = let(F.struct(*[F.regexp_count(head["body"], F.lit(chars)).alias(f"c{i}") for i, chars in enumerate(CLASSES)]), evidence)
        p = F.least(F.lit(1.0), 3.0 * F.least(p_chi, p_runs, p_serial))
        return F.struct(head["encoding"].alias("encoding"), m["n"].alias("n"), p.alias("p"), log_e.alias("log_e"))

    measured = lambda h: let(moments(h["body"], h["letters"]), lambda m: tested(h, m))
    return let(F.struct(body.alias("body"), pick.alias("encoding"), letters.alias("letters")), lambda h: F.when(h["letters"].isNotNull(), measured(h)))


def candidates(runs: Column) -> Column:
    """What is tested: each run, and the parts of one of more than one alphabet."""

    def each(s: Column) -> Column:
        def parts(pattern: str) -> Column:
            return F.transform(
                located(s["value"], pattern), lambda p: F.struct((s["start"] + p["start"]).alias("start"), (s["start"] + p["stop"]).alias("stop"), p["value"].alias("value"))
            )

        return F.when(s["value"].rlike(MIXED[0]) & s["value"].rlike(MIXED[1]), F.concat(F.array(s), *[parts(p) for p in PARTS])).otherwise(F.array(s))

    return F.flatten(F.transform(runs, each))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, runs): spans of the patterns, and runs with the battery's measurements, a row a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    assign = F.when(F.col("t").rlike("[:=]") & F.col("t").rlike(ASSIGN), located(F.col("t"), ASSIGN, 2)).otherwise(none)
    access = F.when(F.col("t").contains("AKIA"), located(F.col("t"), ACCESS)).otherwise(none)
    hexes = F.when(F.col("t").rlike("[0-9a-f]{24}"), located(F.col("t"), HEX)).otherwise(none)
    runs = F.when(F.col("t").rlike(RUN), located(F.col("t"), RUN)).otherwise(none)
    kind = lambda name, spans: F.transform(spans, lambda s: F.struct(F.lit(name).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    long = lambda spans, least: F.filter(spans, lambda s: F.char_length(s["value"]) >= least)
    base = F.concat(kind("assign", long(assign, 6)), kind("access", long(access, 20)), kind("hex", long(hexes, 24)))
    tested = F.transform(candidates(runs), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), battery(F.rtrim(s["value"], F.lit("="))).alias("test")))
    return df.select(F.col(id_col).alias(id_col), text.alias("t")).select(id_col, base.alias("base"), tested.alias("runs"))


def octave(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def steps(value: Column) -> Column:
    """The step of a logarithm; infinite and undefined ones, of a p-value of 0, are in the last."""
    return F.coalesce(F.floor(F.least(value, F.lit(MOST)) / STEP).cast("int"), F.lit(int(MOST / STEP)))


def counted(step: Column, each: DataFrame) -> dict[int, dict[int, int]]:
    """octave -> step -> number of runs; at most 31 rows of at most ``MOST / STEP + 2`` counts reach the driver."""
    got = each.groupBy("octave", step.alias("step")).count().groupBy("octave").agg(F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("counts")).collect()
    return {r["octave"]: r["counts"] for r in got}


def cut(counts: dict[int, int], fdr: float, m: float) -> float | None:
    """The step-up procedures on counts: the least logarithm x, a step's lower end, with ``m * exp(-x) <= fdr *`` the number at x or more."""
    so_far, found = 0, None
    for s in sorted((s for s in counts if s >= 0), reverse=True):
        so_far += counts[s]
        if math.log(m / (fdr * so_far)) <= s * STEP:
            found = s * STEP
    return found


def by_octave(limits: dict[int, float], n: Column) -> Column:
    """The limit of a length's octave; null without one."""
    if not limits:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair]), octave(n))


def surprise(test: Column) -> Column:
    """The logarithm of 1 / p."""
    return -F.log(test["p"])


def rejected(limits: dict[int, float], test: Column) -> Column:
    """Whether the tests find a run not random; the logarithm of a p-value of 0 is null."""
    return F.coalesce(F.coalesce(surprise(test), F.lit(MOST)) >= by_octave(limits, test["n"]), F.lit(False))


def thresholds(scanned: DataFrame, fdr: float = FDR) -> tuple[dict[int, float], dict[int, float]]:
    """Per octave of length, the least log 1 / p of a run that is not random, and the least log e of a discovery."""
    each = scanned.select(F.explode("runs").alias("r")).select(octave(F.col("r.test.n")).alias("octave"), F.col("r.test").alias("test"))
    not_random = {}
    for k, counts in counted(steps(surprise(F.col("test"))), each).items():
        m = sum(counts.values())
        limit = cut(counts, fdr, m * sum(1.0 / i for i in range(1, m + 1)) if m < 1000 else m * (math.log(m) + 0.5772156649 + 0.5 / m))
        if limit is not None:
            not_random[k] = limit
    e = F.col("test")["log_e"]
    step = F.when(rejected(not_random, F.col("test")) | (e <= 0), F.lit(-1)).otherwise(steps(e))
    limits = {k: cut(counts, fdr, sum(counts.values())) for k, counts in counted(step, each).items()}
    return not_random, {k: v for k, v in limits.items() if v is not None}


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id, base, spans): array<struct<kind, start, stop>>, those of the patterns and all, in order of place and kind."""
    scanned = written(scan(df, id_col, text_col), "scanned")
    not_random, limits = thresholds(scanned, fdr)
    hit = F.filter("runs", lambda r: F.coalesce(~rejected(not_random, r["test"]) & (r["test"]["log_e"] >= by_octave(limits, r["test"]["n"])), F.lit(False)))
    random = F.transform(hit, lambda r: F.struct(F.lit("random").alias("kind"), r["start"].alias("start"), r["stop"].alias("stop")))
    return scanned.select(id_col, ordered(F.col("base")).alias("base"), ordered(F.concat("base", random)).alias("spans"))


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    place = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of :func:`secrets`."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
