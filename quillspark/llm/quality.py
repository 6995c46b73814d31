"""Operator 1: quality rules with adaptive thresholds (native: DataFrame functions only).

Every document gets a handful of ratios of a count to a size. Per (lang, source) a mergeable quantile sketch of each
ratio counts its values in cells that grow by the factor ``gamma``: partial counts are made map-side, cells of the same
place add up when sketches are merged, and a quantile is right within the factor gamma. Sketches
hold the documents that pass the base rules. Sketches of small groups are merged upwards (language, then everything), so
a group of under ``min_group`` such documents takes the thresholds of its language. A threshold lies ``reach`` times the
distance from the median to the quantile ``body`` beyond that quantile; there are no fixed ratios. A count rejects a
document if it exceeds what the threshold's rate gives for the document's size by more than ``sigmas`` standard
deviations of a Poisson count, so a few events in a short text are no evidence. The thresholds are a small table that is
joined back. Counts and integer cells add up alike in any order: every run keeps the same rows.

Edge cases: null text has no words (base_failed); null lang or source is a group of its own; where no document passes
the base rules there are no thresholds and nothing to keep; values equal to a threshold (ties) are kept; an empty table
gives an empty result; repeated rows are judged alike; very long texts are processed whole (n log n in their words);
extra columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, pick, small

#: Up to so many repeated windows are looked up one by one.
FEW = 32
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The cell of a ratio of zero, below all others.
ZERO = -1_000_000


@dataclass(frozen=True)
class Ratio:
    """A count by a size. A count of events is weighed against chance; a mean is compared as it is, on both sides."""

    name: str
    count: str
    size: str
    events: bool = True

    def column(self) -> Column:
        return (F.col(self.count) / F.greatest(F.col(self.size), F.lit(1))).cast("double")


RATIOS = (
    Ratio("symbol_ratio", "n_symbols", "word_chars"),
    Ratio("dup_line_ratio", "n_dup_lines", "n_lines"),
    Ratio("repeat_ratio", "n_repeat_words", "n_words"),
    Ratio("upper_ratio", "n_upper", "word_chars"),
    Ratio("word_length", "word_chars", "n_words", events=False),
)


@dataclass(frozen=True)
class QualityParams:
    gamma: float = 1.02
    body: float = 0.9  # and 1 - body on the lower side
    reach: float = 4.0
    sigmas: float = 3.0
    min_group: int = 500
    min_words: int = 50
    max_repeat_percent: int = 50
    broadcast_rows: int = 100_000


def measure(docs: DataFrame) -> DataFrame:
    """Adds the counts to a frame with a string column ``text``. One pass, no shuffle, everything JVM-side."""
    text = F.coalesce("text", F.lit(""))
    step = docs.withColumn("__w", F.array_remove(F.split(text, SPACE + "+", -1), ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("__l", lines).withColumn("n_words", F.size("__w").cast("long"))
    # a window of three words is known by its 64-bit hash within its document
    step = step.withColumn("__g", F.expr(
        "CASE WHEN size(__w) >= 3 THEN transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) ELSE array() END"))
    step = step.withColumn("__s", F.expr("CASE WHEN size(array_distinct(__g)) < size(__g) THEN sort_array(__g) END"))
    step = step.withColumn("__d", F.expr(
        "CASE WHEN __s IS NOT NULL THEN array_distinct(filter(__s, (e, i) -> i > 0 AND __s[i - 1] = e)) END"))
    # few repeated windows: look each window up among them; many: sort windows with their places
    step = step.withColumn("__t", F.expr(
        f"CASE WHEN size(__d) > {FEW} THEN sort_array(transform(__g, (x, i) -> struct(x AS k, i AS p))) END"))
    step = step.withColumn("__p", F.expr(
        "CASE WHEN __d IS NULL THEN NULL WHEN __t IS NULL THEN"
        " filter(transform(__g, (h, i) -> IF(array_contains(__d, h), i, -1)), p -> p >= 0) ELSE"
        " sort_array(transform(filter(__t, (e, i) -> (i > 0 AND __t[i - 1].k = e.k) OR"
        " (i + 1 < size(__t) AND __t[i + 1].k = e.k)), e -> e.p)) END"))
    step = step.withColumn("n_repeat_words", F.expr(
        "CASE WHEN __p IS NULL THEN 0L ELSE aggregate(__p, named_struct('n', 0L, 'q', -3), (a, p) ->"
        " named_struct('n', a.n + least(3, p - a.q), 'q', p)).n END"))
    return (step.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
            .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
            .withColumn("n_upper", F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"))
            .withColumn("n_lines", F.size("__l").cast("long"))
            .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
            .drop("__w", "__l", "__g", "__s", "__d", "__t", "__p"))


def sketch(measured: DataFrame, p: QualityParams) -> DataFrame:
    """(lang, source, ratio, cell, n): rows of a group in each cell of each ratio. Cells of merged groups are summed."""
    def cell(r: Ratio) -> Column:
        v = r.column()
        return F.when(v > 0, F.ceil(F.ln(v) / math.log(p.gamma))).otherwise(ZERO).cast("int")

    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ratio"), cell(r).alias("cell")) for i, r in enumerate(RATIOS)]))
    rows = measured.select("lang", "source", cells.alias("c")).select("lang", "source", "c.ratio", "c.cell")
    return rows.groupBy("lang", "source", "ratio", "cell").agg(F.count(F.lit(1)).alias("n"))


def bounds(cells: DataFrame, keys: tuple[str, ...], p: QualityParams) -> DataFrame:
    """(keys, rows, and hi and lo of each ratio) from sketches. A partition holds the cells of one sketch: a few thousand."""
    own = Window.partitionBy(*keys, "ratio")
    upto = own.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.withColumn("cum", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(own))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("cum") >= F.ceil(F.lit(q) * F.col("rows")), F.col("cell")))

    def edge(cell: str, up: int) -> Column:
        return F.when(F.col(cell) == ZERO, 0.0).otherwise(F.pow(F.lit(p.gamma), F.col(cell) + up))

    per = c.groupBy(*keys, "ratio").agg(F.max("rows").alias("rows"), quantile(1 - p.body).alias("low"), quantile(0.5).alias("mid"), quantile(p.body).alias("high"))
    # upper edges of the cells above and lower edges below, so that a threshold never cuts through the cell it comes from
    hi = edge("high", 0) + p.reach * (edge("high", 0) - edge("mid", 0))
    lo = edge("low", -1) - p.reach * (edge("mid", -1) - edge("low", -1))
    per = per.withColumn("hi", hi).withColumn("lo", lo)
    return per.groupBy(*keys).agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("ratio") == i, F.col(side))).alias(f"{side}_{r.name}") for i, r in enumerate(RATIOS) for side in ("hi", "lo")])


def thresholds(measured: DataFrame, p: QualityParams) -> DataFrame:
    """(lang, source) -> hi and lo of each ratio. One row for each group; measured: the rows that pass the base rules."""
    leaf = materialize(sketch(measured, p), "quality-sketches")
    names = [f"{side}_{r.name}" for r in RATIOS for side in ("hi", "lo")]
    a = bounds(leaf, ("lang", "source"), p)
    b = bounds(leaf.groupBy("lang", "ratio", "cell").agg(F.sum("n").alias("n")), ("lang",), p)
    c = bounds(leaf.groupBy("ratio", "cell").agg(F.sum("n").alias("n")), (), p)
    b = b.select(F.col("lang").alias("lang_b"), F.col("rows").alias("rows_b"), *[F.col(n).alias("b_" + n) for n in names])
    c = c.select(*[F.col(n).alias("c_" + n) for n in names])
    # the whole table has one row by construction
    out = a.join(b, a.lang.eqNullSafe(b.lang_b), "left").join(F.broadcast(c), F.lit(True), "left")
    return out.select("lang", "source", *[F.when(F.col("rows") >= p.min_group, F.col(n)).when(F.col("rows_b") >= p.min_group, F.col("b_" + n)).otherwise(F.col("c_" + n)).alias(n) for n in names])


def judge(docs: DataFrame, p: QualityParams | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` of docs, the counts, base_failed and kept. docs: text, lang, source and carry.

    The counts are made once and written to the shared folder; sketches and verdicts both read that table.
    """
    p = p or QualityParams()
    carry = tuple(dict.fromkeys(carry))
    need = tuple(dict.fromkeys((*carry, "text", "lang", "source")))
    extra = tuple(c for c in ("lang", "source") if c not in carry)
    base = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    measured = measure(pick(docs, *need)).select(*carry, *extra, *COUNTS, "n_upper", "n_lines", base.alias("base_failed"))
    measured = materialize(measured, "quality-counts")
    limits = materialize(thresholds(measured.where("NOT base_failed"), p), "quality-thresholds").withColumnsRenamed({"lang": "__lang", "source": "__source"})
    if small(limits, p.broadcast_rows):
        joined = measured.join(F.broadcast(limits), measured.lang.eqNullSafe(limits["__lang"]) & measured.source.eqNullSafe(limits["__source"]), "left")
    else:  # many sources: both sides salted, so that a source with a third of all rows is dealt to 64 tasks
        left = measured.withColumn("__salt", F.pmod(F.xxhash64(*COUNTS, carry[0]), F.lit(64)))
        right = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("__salt", F.col("__salt").cast("long"))
        joined = left.join(right, (left["__salt"] == right["__salt"]) & left.lang.eqNullSafe(right["__lang"]) & left.source.eqNullSafe(right["__source"]), "left")
    return joined.select(*carry, *COUNTS, "base_failed", (~F.col("base_failed") & ~outside(p)).alias("kept"))


def outside(p: QualityParams) -> Column:
    """A ratio lies beyond its threshold; without thresholds none does."""
    bad = F.lit(False)
    for r in RATIOS:
        hi, lo, n = F.col("hi_" + r.name), F.col("lo_" + r.name), F.col(r.count)
        if r.events:
            beyond = n - hi * F.greatest(F.col(r.size), F.lit(1)) > p.sigmas * F.sqrt(n.cast("double"))
        else:
            beyond = (r.column() > hi) | (r.column() < lo)
        bad = bad | F.coalesce(beyond, F.lit(False))
    return bad


def quality_filter(docs: DataFrame, columns: tuple[str, ...], p: QualityParams | None = None) -> DataFrame:
    """The rows of docs that pass, with ``columns`` only."""
    return judge(docs, p, carry=columns).where("kept").select(*columns)
