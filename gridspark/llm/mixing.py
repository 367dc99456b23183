"""Mixing sources to target weights by hierarchical budgets, by built-in functions alone.

Leaves are the distinct values of some levels (domain, language, source). Capacities, a leaf's
tokens times ``max_epochs``, are summed up the tree; then budgets run down it. At each parent
its budget is shared in proportion to the children's weights, and what a child cannot hold goes
to its siblings (the level where every child gets ``min(capacity, level * weight)``). A parent's
own capacity bounds its share, so a shortage leaves a parent for its siblings only when its
children are full. A leaf takes whole epochs and then a prefix of one more, in an order seeded
by that epoch; a document is in the prefix if the tokens before it are fewer than what is left.

The prefix needs a running sum over a leaf's documents, and one leaf may hold a third of all
rows. So the seeded order is cut into ``16 ** BIN_DIGITS`` ranges of the hash: sums of ranges are
pre-aggregated and run over ranges, ranges wholly within or beyond the budget are decided at
once, and the one range where a leaf's budget ends is cut again in the same way until it has at
most ``SMALL`` rows, which are summed document by document. Small tables of leaves and ranges are
all that is windowed by leaf. Capacities are summed as decimals, so no order of sums shows.

Defined results: a null level is a value of its own. A null or empty text has no tokens; a
document without tokens is taken as often as its leaf's whole epochs, and also in the prefix if
it comes before the cut. Rows that agree in id and text are ordered next to each other and are
taken alike, all if the first of them is. Weights default to 1 for each child; a null,
negative or missing one counts as 0. An empty table, or a budget of 0, takes nothing.
Extra columns are kept; names that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, written

#: Hexadecimal digits of the seeded hash that number the ranges of a cut, and rows of a range that is not cut again.
BIN_DIGITS, SMALL = 2, 4096


def tokens(text_col: str = "text") -> Column:
    """The default measure of a text: its words."""
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"[^{WS}]+")).cast("long")


def shares(nodes: DataFrame, parent: list[str], budget: str = "__budget") -> DataFrame:
    """Adds ``__share``: each parent's budget filled into its children by weight, up to their capacities.

    Rows need ``__cap`` and ``__weight`` and, alike for all children of a parent, ``budget``.
    """
    ratio = F.when(F.col("__weight") > 0, F.col("__cap") / F.col("__weight"))
    order = [ratio.asc_nulls_last(), F.col("__name")]
    by = Window.partitionBy(*parent).orderBy(*order)
    before = F.coalesce(F.sum(F.when(ratio.isNotNull(), F.col("__cap"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("__weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = nodes.withColumns({"__r": ratio, "__before": before, "__left": weight})
    full = full.withColumn("__level", F.when(F.col("__left") > 0, (F.col(budget) - F.col("__before")) / F.col("__left")))
    # Children are filled in order of capacity by weight; the first that is not filled sets the level for the rest.
    first = F.min(F.when(F.col("__r") > F.col("__level"), F.struct("__r", "__name", "__level"))).over(Window.partitionBy(*parent))
    level = first["__level"]
    share = F.when(F.col("__r").isNull(), 0.0).when(level.isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), level * F.col("__weight")))
    return full.withColumn("__share", F.greatest(share, F.lit(0.0))).drop("__r", "__before", "__left", "__level")


def budgets(leaves: DataFrame, levels: list[str], budget: float, weights: dict[str, DataFrame] | None = None, max_epochs: int = 4) -> DataFrame:
    """(levels, __tokens, __budget): each leaf's budget; ``leaves`` has the levels and ``__tokens``.

    ``weights[level]`` has the levels down to that one and ``weight``.
    """
    tree = leaves.withColumn("__exact", F.col("__tokens").cast("decimal(20,0)"))
    given = None
    for depth, level in enumerate(levels):
        above, here = levels[:depth], levels[: depth + 1]
        nodes = tree.groupBy(*here).agg(F.sum("__exact").alias("__exact"))
        nodes = nodes.withColumn("__cap", (F.col("__exact") * F.lit(max_epochs).cast("decimal(8,0)")).cast("double"))
        if weights and level in weights:
            w = weights[level].select(*[F.col(c).alias(f"__w_{c}") for c in here], F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("__weight"))
            match = F.lit(True)
            for c in here:
                match = match & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
            nodes = nodes.join(w, match, "left").drop(*[f"__w_{c}" for c in here]).fillna({"__weight": 0.0})
        else:
            nodes = nodes.withColumn("__weight", F.lit(1.0))
        nodes = nodes.withColumn("__name", F.col(level).cast("string"))
        if given is None:
            nodes = nodes.withColumn("__budget", F.lit(float(budget)))
        else:
            up = given.select(*[F.col(c).alias(f"__u_{c}") for c in above], F.col("__share").alias("__budget"))
            match = F.lit(True)
            for c in above:
                match = match & F.col(c).eqNullSafe(F.col(f"__u_{c}"))
            nodes = nodes.join(up, match).drop(*[f"__u_{c}" for c in above])
        given = shares(nodes, above or [F.lit(0)]).select(*here, "__exact", "__share")
    return given.select(*levels, F.col("__exact").cast("long").alias("__tokens"), F.floor("__share").cast("long").alias("__budget"))


def equal_join(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on null-safe equality that keeps ``a``'s columns."""
    other = b.select(*[F.col(c).alias(f"__j_{c}") for c in names], *[c for c in b.columns if c not in names])
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(f"__j_{c}"))
    return a.join(other, match, how).drop(*[f"__j_{c}" for c in names])


def _key(seed: int, ident: str) -> Column:
    """The seeded order of a leaf's next epoch."""
    parts = [F.lit(str(seed)), F.col("__epochs").cast("string"), F.coalesce(F.col(ident).cast("string"), F.lit(""))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _place(seed: int, ident: str, tie: str) -> Column:
    return F.struct(_key(seed, ident).alias("key"), F.col(ident).alias("id"), F.col(tie).alias("tie"))


def _range(digits: int) -> Column:
    """The range of a place by so many digits."""
    return F.substring("__at.key", 1, digits)


class Mix:
    """A mix of ``df``'s rows; ``budget`` is in tokens, without it it is ``budget_ratio`` times all tokens."""

    def __init__(
        self,
        df: DataFrame,
        levels: list[str],
        budget: float | None = None,
        budget_ratio: float = 1.0,
        weights: dict[str, DataFrame] | None = None,
        max_epochs: int = 4,
        seed: int = 0,
        id_col: str = "doc_id",
        text_col: str = "text",
    ):
        self.levels, self.seed, self.id_col, self.text_col = levels, seed, id_col, text_col
        # One row a document, without its text: the texts are read once for this and once to take them.
        slim = df.select(*levels, F.col(id_col).alias("__id"), tokens(text_col).alias("__n"), F.xxhash64(text_col).alias("__tie"))
        self.slim = written(slim, "slim")
        leaves = self.slim.groupBy(*levels).agg(F.sum("__n").alias("__tokens"))
        if budget is None:
            budget = budget_ratio * (leaves.agg(F.sum("__tokens")).first()[0] or 0)
        given = budgets(leaves, levels, budget, weights, max_epochs)
        whole = F.when(F.col("__tokens") > 0, F.floor(F.col("__budget") / F.col("__tokens"))).otherwise(F.lit(0)).cast("long")
        given = given.withColumn("__epochs", whole).withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("__tokens"))
        given = written(given, "budgets")

        placed = equal_join(self.slim, given, levels).withColumn("__at", _place(seed, "__id", "__tie"))
        run = Window.partitionBy(*levels).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        cuts, self.digits = None, 0
        while cuts is None or (self.digits < 32 and (cuts.agg(F.max("__rows")).first()[0] or 0) > SMALL):
            inner = placed.withColumn("__start", F.lit(0).cast("long")) if cuts is None else self._cut(placed, cuts)
            self.digits += BIN_DIGITS
            sums = inner.groupBy(*levels, "__rest", "__start", _range(self.digits).alias("__bin")).agg(F.sum("__n").alias("__sum"), F.count("*").alias("__rows"))
            bins = sums.withColumn("__start", F.col("__start") + F.coalesce(F.sum("__sum").over(run), F.lit(0)))
            over = F.col("__start") + F.col("__sum") >= F.col("__rest")
            found = bins.where(over).groupBy(*levels).agg(F.min(F.struct("__bin", "__start", "__rows")).alias("__cut"))
            cuts = written(found.select(*levels, F.col("__cut.__bin").alias("__cutbin"), F.col("__cut.__start").alias("__start"), F.col("__cut.__rows").alias("__rows")), "cuts")
        order = Window.partitionBy(*levels).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        cut = self._cut(placed, cuts).withColumn("__before", F.col("__start") + F.coalesce(F.sum("__n").over(order), F.lit(0)))
        last = cut.where("__before < __rest").groupBy(*levels).agg(F.max("__at").alias("__last"))
        #: Per leaf: its whole epochs, the range where its prefix ends, and the last row of the prefix there.
        self.bounds = written(equal_join(equal_join(given, cuts.drop("__start", "__rows"), levels, "left"), last, levels, "left"), "bounds")

    def _cut(self, placed: DataFrame, cuts: DataFrame) -> DataFrame:
        """The rows in the range of each leaf where its prefix ends."""
        return equal_join(placed, cuts.drop("__rows"), self.levels).where(_range(self.digits) == F.col("__cutbin")).drop("__cutbin")

    def _copies(self, rows: DataFrame, ident: str, tie: str) -> DataFrame:
        placed = equal_join(rows, self.bounds, self.levels).withColumn("__at", _place(self.seed, ident, tie))
        here = _range(self.digits)
        inside = F.coalesce((here < F.col("__cutbin")) | ((here == F.col("__cutbin")) & (F.col("__at") <= F.col("__last"))), F.lit(False))
        return placed.withColumn("__copies", F.col("__epochs") + inside.cast("long"))

    def documents(self) -> DataFrame:
        """(id, levels, n_tokens, leaf_tokens, leaf_budget, copies) of the rows that are taken."""
        got = self._copies(self.slim, "__id", "__tie").where("__copies > 0")
        return got.select(
            F.col("__id").alias(self.id_col), *self.levels, F.col("__n").alias("n_tokens"), F.col("__tokens").alias("leaf_tokens"), F.col("__budget").alias("leaf_budget"), F.col("__copies").alias("copies")
        )

    def take(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, the table mixed, as often as they are taken."""
        got = self._copies(df.withColumn("__tie", F.xxhash64(self.text_col)), self.id_col, "__tie").where("__copies > 0")
        return got.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*df.columns)
