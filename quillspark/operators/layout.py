"""Page layout over a spans frame (doc_id, page_number, span_idx, text, x, y, w, h, font_size); y grows downwards.

Ties in an order go to span_idx; a null text weighs nothing; pages without spans have no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

PAGE_WIDTH, PAGE_HEIGHT, MARGIN = 612.0, 792.0, 45.0
KEY = ("doc_id", "page_number")


def header_footer(y: Column, h: Column, text: Column, page_number: Column, margin: float = MARGIN, height: Column | float = PAGE_HEIGHT) -> Column:
    """In the top or bottom margin and a page number or, trimmed, under 40 bytes."""
    height = F.lit(height) if isinstance(height, float) else height
    return ((y <= margin) | (y + h >= height - margin)) & (page_number | (F.octet_length(strip(text)) < 40))


def region(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (F.when(y <= MARGIN, "Header").when(y + h >= PAGE_HEIGHT - MARGIN, "Footer")
            .when(((x + w <= 0.28 * PAGE_WIDTH) | (x >= 0.72 * PAGE_WIDTH)) & (w < 0.25 * PAGE_WIDTH), "Sidebar").otherwise("Body"))


def font_histogram(spans: DataFrame) -> DataFrame:
    """Bytes at each font size (in tenths) of a page."""
    return spans.groupBy(*KEY, F.round(F.col("font_size") * 10).cast("int").alias("size10")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("weight"))


def font_levels(hist: DataFrame) -> DataFrame:
    """Body size (weighted mode, smallest on ties) and the sizes over 1.08 times of it, largest first."""
    body = hist.groupBy(*KEY).agg(F.max_by("size10", F.struct("weight", -F.col("size10"))).alias("body10"), F.collect_set("size10").alias("sizes"))
    return body.select(*KEY, "body10", F.sort_array(F.filter("sizes", lambda s: s > 1.08 * F.col("body10")), asc=False).alias("levels"))


def projection_profile(spans: DataFrame, bin_width: float = 2.0) -> DataFrame:
    """Spans over each vertical strip of a page."""
    lo, hi = F.floor(F.col("x") / bin_width), F.ceil((F.col("x") + F.col("w")) / bin_width)
    bins = spans.where("w > 0").select(*KEY, F.explode(F.sequence(lo.cast("int"), (hi - 1).cast("int"))).alias("bin"))
    return bins.groupBy(*KEY, "bin").agg(F.count(F.lit(1)).alias("n"))


def blocks(spans: DataFrame, gap: float = 17.5) -> DataFrame:
    """Vertical blocks: a gap of more than ``gap`` below the previous span starts one. One row for each block."""
    order = Window.partitionBy(*KEY).orderBy("y", "span_idx")
    start = F.coalesce((F.col("y") - F.lag(F.col("y") + F.col("h")).over(order) > gap).cast("int"), F.lit(0))
    marked = spans.withColumn("s", start).withColumn("block", F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(*KEY, "block").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


def gap_stats(lines: DataFrame) -> DataFrame:
    """Mean, population deviation and upper median of the gaps between lines of a page (y, h)."""
    order = Window.partitionBy(*KEY).orderBy("y", "span_idx")
    g = lines.withColumn("gap", F.col("y") - F.lag(F.col("y") + F.col("h")).over(order)).where("gap IS NOT NULL")
    s = g.groupBy(*KEY).agg(F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.sort_array(F.collect_list("gap")).alias("a"), F.count(F.lit(1)).alias("n"))
    return s.select(*KEY, "n", "mean", "sd", F.expr("a[cast(n div 2 as int)]").alias("median"))


def cluster_coordinates(values: Column, tolerance: float = 4.0) -> Column:
    """1-D clustering of an array of doubles in order: a value within tolerance of the last place moves it halfway to itself."""
    last = lambda a: F.try_element_at(a, F.lit(-1))

    def step(a, v):
        moved = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array((last(a) + v) / 2))
        return F.when((F.size(a) > 0) & (F.abs(v - last(a)) <= tolerance), moved).otherwise(F.concat(a, F.array(v.cast("double"))))

    return F.aggregate(F.sort_array(values), F.expr("cast(array() AS array<double>)"), step)
