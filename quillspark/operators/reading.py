"""From spans of pages to nodes in reading order: columns, blocks, lines, kinds of lines, paragraphs. Left to right as
declarative steps over frames; the right-to-left order of a page and its lines at the end.

A span frame has the columns of KEY, span_idx, text, x, y, w, h, font_size, bold, italic, mono and, of its page, width,
height, body10, levels and n_columns (sizes in tenths of a point); y grows downwards. Steps after the first keep their
rows by KEY, so one shuffle serves them all. A page without spans may be one row with a null span_idx; it stays. Ties in
an order go to span_idx; texts are used whole; other columns are ignored by each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arabic import is_clause_start, joins, recover
from . import layout

KEY = ("uid", "page_number")
BLOCK = (*KEY, "zone", "block")
FULL_WIDTH, TOP, MIN_GAP, BLOCK_GAP, LINE = 0.65, 250.0, 12.0, 17.5, 4.0
DEFAULT_BODY = 110  # tenths of a point, for pages without text

NARROW = "s.w < 0.55 * width AND s.w > 20"
BINS = "cast(greatest(1, ceil(width / 2)) AS int)"


def page_columns(pages: DataFrame, spans: str = "content") -> DataFrame:
    """pages (width, and an array of span structs) with n_columns: 1, 2 or 3 by the empty strips of two points in the
    middle two thirds of the page that are MIN_GAP wide and have text to their right."""
    narrow = f"filter({spans}, s -> {NARROW})"
    strips = f"sequence(cast(least(greatest(floor(s.x / 2), 0), {BINS} - 1) AS int), cast(least(ceil((s.x + s.w) / 2), {BINS}) AS int) - 1)"
    filled = f"array_sort(array_distinct(flatten(transform(filter({narrow}, s -> ceil((s.x + s.w) / 2) > greatest(floor(s.x / 2), 0) AND floor(s.x / 2) < {BINS}), s -> {strips}))))"
    low, high = f"({BINS} DIV 6)", f"({BINS} * 5 DIV 6)"
    inner = f"filter({filled}, b -> b >= {low} AND b < {high})"
    valleys = f"size(filter(transform(inner_, (b, i) -> b - IF(i = 0, {low} - 1, inner_[i - 1]) - 1), g -> g * 2 >= {MIN_GAP}))"
    out = pages.withColumn("many_", F.expr(f"size({narrow}) >= 4")).withColumn("inner_", F.when(F.col("many_"), F.expr(inner)))
    return out.withColumn("n_columns", F.expr(f"CASE WHEN NOT many_ OR many_ IS NULL THEN 1 WHEN {valleys} >= 2 THEN 3 WHEN {valleys} = 1 THEN 2 ELSE 1 END")).drop("many_", "inner_")


def page_sizes(pages: DataFrame, spans: str = "content") -> DataFrame:
    """pages with body10 (the size of most bytes, the smallest on ties) and levels (larger sizes, largest first)."""
    out = pages.withColumn("sized_", F.expr(f"transform({spans}, s -> struct(cast(round(s.font_size * 10) AS int) AS z, octet_length(s.text) AS n))"))
    out = out.withColumn("sizes_", F.expr("array_distinct(sized_.z)"))
    body = "-array_max(transform(sizes_, z -> struct(aggregate(filter(sized_, s -> s.z = z), 0, (a, s) -> a + s.n) AS n, -z AS z))).z"
    out = out.withColumn("body10", F.coalesce(F.expr(body), F.lit(DEFAULT_BODY)))
    return out.withColumn("levels", F.coalesce(F.expr("sort_array(filter(sizes_, z -> z * 100 > 108 * body10), false)"), F.expr("cast(array() AS array<int>)"))).drop("sized_", "sizes_")


def content(spans: Column, height: Column) -> Column:
    """The spans of an array that are no header and no footer."""
    return F.filter(spans, lambda s: ~layout.header_footer(s["y"], s["h"], s["text"], T.is_page_number(T.strip(s["text"])), height=height))


def zones(spans: DataFrame) -> DataFrame:
    """Adds zone: 0 for wide spans at the top, 1 to 3 for the columns, 9 for wide spans below, which come last."""
    cx = F.col("x") + F.col("w") / 2
    wide = F.col("w") > FULL_WIDTH * F.col("width")
    two = F.when(cx < F.col("width") / 2, 1).otherwise(2)
    three = F.when(cx < F.col("width") / 3, 1).when(cx < F.col("width") / 3 * 2, 2).otherwise(3)
    column = F.when(F.col("n_columns") == 2, two).when(F.col("n_columns") == 3, three).otherwise(1)
    return spans.withColumn("zone", F.when(wide, F.when(F.col("y") + F.col("h") / 2 < TOP, 0).otherwise(9)).otherwise(column))


def blocks(spans: DataFrame) -> DataFrame:
    """Adds block: a gap of more than BLOCK_GAP points below the previous span of the zone starts one."""
    order = Window.partitionBy(*KEY, "zone").orderBy("y", "span_idx")
    start = F.coalesce((F.col("y") - F.lag(F.col("y") + F.col("h")).over(order) > BLOCK_GAP).cast("int"), F.lit(0))
    return spans.withColumn("start_", start).withColumn("block", F.sum("start_").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("start_")


_ADD = "IF(endswith(t, ' ') OR startswith(s.text, ' '), concat(t, s.text), concat(t, ' ', s.text))"
#: Line of each span in an array sorted from the top: a span within LINE points of the line's first one belongs to it.
_ANCHORED = f"""aggregate(spans, named_struct('y', -1e9D, 'k', -1, 'of', cast(array() AS array<int>)),
 (a, s) -> IF(abs(s.y - a.y) <= {LINE}, named_struct('y', a.y, 'k', a.k, 'of', concat(a.of, array(a.k))), named_struct('y', s.y, 'k', a.k + 1, 'of', concat(a.of, array(a.k + 1))))).of"""


def lines(spans: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each line: BLOCK, line, text, words (spans joined by spaces), y, height, x_start, size, bold, mono,
    italic, runs; and of the block its whole text (block_text), top and mean size. carry: columns that are the same for a page."""
    fields = ["y", "span_idx", "x", "w", "h", "text", "font_size", "bold", "italic", "mono"]
    per = spans.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.when(F.col("span_idx").isNotNull(), F.struct(*fields)))).alias("spans"), *[F.first(c, ignorenulls=True).alias(c) for c in carry])
    per = per.withColumn("of_", F.expr(_ANCHORED)).withColumn("block_text", T.strip(F.array_join("spans.text", " ")))
    per = per.withColumn("top", F.array_min("spans.y")).withColumn("mean_size", F.expr("aggregate(spans.font_size, 0D, (a, x) -> a + x) / nullif(size(spans), 0)"))
    own = "transform(sequence(0, array_max(of_)), k -> array_sort(transform(filter(arrays_zip(spans, of_), z -> z.of_ = k), z -> named_struct('x', z.spans.x, 'i', z.spans.span_idx, 's', z.spans))))"
    per = per.withColumn("lines_", F.when(F.size("spans") > 0, F.expr(own)))
    line = per.select(*BLOCK, "block_text", "top", "mean_size", *carry, F.posexplode_outer("lines_").alias("line", "l")).withColumn("l", F.col("l.s"))
    first = "aggregate(l, cast(null AS struct<y: double, h: double>), (a, s) -> named_struct('y', least(coalesce(a.y, s.y), s.y), 'h', greatest(coalesce(a.h, s.h), s.h)))"
    line = line.withColumn("g_", F.expr(first))
    return line.select(*BLOCK, "line", "block_text", "top", "mean_size", *carry, F.expr(f"aggregate(slice(l, 2, size(l)), l[0].text, (t, s) -> {_ADD})").alias("text"), T.strip(F.array_join("l.text", " ")).alias("words"),
                       F.col("g_.y").alias("y"), F.col("g_.h").alias("height"), F.expr("l[0].x").alias("x_start"), F.array_max("l.font_size").alias("size"), F.expr("exists(l, s -> s.bold)").alias("bold"),
                       F.expr("forall(l, s -> s.mono)").alias("mono"), F.expr("forall(l, s -> s.italic)").alias("italic"), F.expr("transform(l, s -> named_struct('text', s.text, 'bold', s.bold, 'italic', s.italic, 'mono', s.mono))").alias("runs"))


def is_clause_number(c: Column) -> Column:
    """The first word is numbers with points between them."""
    return F.regexp_replace(F.regexp_extract(c, rf"^([^{T.SPACE}]*)", 1), r"\.+$", "").rlike(r"^\+?[0-9]{1,9}(\.\+?[0-9]{1,9})+$")


def heading(words: Column, size: Column, bold: Column, levels: Column, body: Column) -> Column:
    """struct(level, confidence) or null. levels: larger sizes of the page, body: its own; all in points."""
    n = F.octet_length(words)
    caps = (n > 3) & ~words.rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]")
    clause = is_clause_number(words)
    place = F.array_position(F.transform(levels, lambda z: F.abs(size - z) <= 0.8), True)
    ratio = size / body
    out = lambda level, confidence: F.struct(F.lit(level).cast("int").alias("level") if isinstance(level, int) else level.cast("int").alias("level"), F.lit(confidence).alias("confidence") if isinstance(confidence, float) else confidence.alias("confidence"))
    return (F.when((n == 0) | (n > 160) | words.isNull(), None).when(place > 0, out(F.least(place, F.lit(6)), F.when(bold, 0.96).otherwise(0.88)))
            .when(ratio >= 1.75, out(1, 0.95)).when(ratio >= 1.40, out(2, 0.90)).when(ratio >= 1.20, out(3, 0.85)).when((ratio >= 1.08) & (bold | clause), out(4, 0.82))
            .when(bold & (clause | caps) & (n < 80), out(5, 0.78)).when(bold & (n < 60) & ~F.endswith(words, F.lit(".")), out(6, 0.70)))


def footnote(text: Column, top: Column, mean_size: Column, height: Column, body: Column) -> Column:
    """struct(id, content) of a block of small type in the lower part of a page that begins with a mark, or null."""
    bracket = F.regexp_extract(text, r"(?s)^\[([^\]]*)\]", 1)
    number = F.regexp_extract(text, rf"^(\+?[0-9]{{1,3}})\.*(?=[{T.SPACE}]|$)", 1)
    sign = F.regexp_extract(text, r"^([*†‡])", 1)
    out = lambda mark, pattern: F.struct(mark.alias("id"), T.strip(F.regexp_replace(text, pattern, "")).alias("content"))
    small = (top >= 0.70 * height) & (mean_size <= 0.90 * F.greatest(body, F.lit(8.0)))
    found = F.when(text.rlike(r"(?s)^\[[^\]]*\]"), out(bracket, r"(?s)^\[[^\]]*\]")).when((number != "") & (F.length(number) <= 3), out(number, rf"^[^{T.SPACE}]+")).when(sign != "", out(sign, "^[*†‡]"))
    return F.when(small, found)


def is_break(gap: Column, mean_height: Column, n: Column, sd: Column, median: Column, threshold: float = 1.4) -> Column:
    """A gap between lines that ends a paragraph: beyond the cluster of the block's gaps if they differ, else by height."""
    clustered = gap > median + F.greatest(1.2 * sd, mean_height * (threshold - 1.0))
    return F.when((n >= 3) & (sd > 0.5), clustered).otherwise(gap > mean_height * threshold)


def kinds(line: DataFrame) -> DataFrame:
    """Adds kind (Caption, Footnote, List, Heading, Paragraph) and what belongs to it: target, note, item, head."""
    item = T.list_item(F.col("text"))
    line = line.withColumn("target", T.caption_target(F.col("block_text")))
    line = line.withColumn("note", F.when(F.col("target").isNull(), footnote(F.col("block_text"), F.col("top"), F.col("mean_size"), F.col("height_"), F.col("body10") / 10)))
    line = line.withColumn("item", F.when(item["ordered"].isNotNull(), F.struct(item["ordered"].alias("ordered"), item["marker"].alias("marker"), item["content"].alias("content"), T.indent_level(F.col("x_start")).alias("level"))))
    line = line.withColumn("head", heading(F.col("words"), F.col("size"), F.col("bold"), F.transform("levels", lambda z: z / 10), F.greatest(F.col("body10") / 10, F.lit(8.0))))
    kind = F.when(F.col("line").isNull(), None).when(F.col("target").isNotNull(), "Caption").when(F.col("note").isNotNull(), "Footnote").when(F.col("item").isNotNull(), "List").when(F.col("head").isNotNull(), "Heading").otherwise("Paragraph")
    return line.withColumn("kind", kind)


def paragraphs(line: DataFrame, threshold: float = 1.4) -> DataFrame:
    """Adds node: its number in the block. Lists are runs of items, headings stand alone, paragraphs end at wide gaps;
    captions and footnotes are whole blocks."""
    whole, order = Window.partitionBy(*BLOCK), Window.partitionBy(*BLOCK).orderBy("line")
    line = line.withColumn("gap_", F.abs(F.col("y") - F.lag("y").over(order)))
    line = line.withColumn("n_", F.count("gap_").over(whole)).withColumn("sd_", F.stddev_pop("gap_").over(whole)).withColumn("gaps_", F.collect_list("gap_").over(whole))
    median = F.expr("sort_array(gaps_)[cast(n_ DIV 2 AS int)]")
    mean_height = (F.col("height") + F.lag("height").over(order)) / 2
    before = F.lag("kind").over(order)
    broken = (F.col("kind") == "Paragraph") & is_break(F.col("gap_"), mean_height, F.col("n_"), F.col("sd_"), median, threshold)
    start = F.when(before.isNull(), 0).when(before != F.col("kind"), 1).when(F.col("kind") == "Heading", 1).when(broken, 1).otherwise(0)
    return line.withColumn("start_", start).withColumn("node", F.sum("start_").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("gap_", "n_", "sd_", "gaps_", "start_")


QUOTE_INDENT = 92.0


def nodes(line: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each node in order: KEY, zone, block, node, type, level, confidence, text, items, runs, id.

    Types: Heading, Paragraph, CodeBlock, BlockQuote, List, Caption, Footnote. Texts are clean but for NFC."""
    parts = F.struct("line", "text", "item", "runs")
    per = line.groupBy(*BLOCK, "node").agg(
        F.first("kind").alias("kind"), F.first("head").alias("head"), F.first("note").alias("note"), F.first("target").alias("target"), F.first("block_text").alias("block_text"),
        F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), parts))).alias("lines"), F.bool_and("mono").alias("mono"), F.bool_and("italic").alias("italic"), F.min("x_start").alias("left"), *[F.first(c, ignorenulls=True).alias(c) for c in carry])
    raw = F.when(F.col("kind") == "Paragraph", T.join_paragraph(F.col("lines.text"))).when(F.col("kind") == "Caption", F.col("block_text")).when(F.col("kind") == "Footnote", F.col("note.content"))
    per = per.withColumn("text", T.clean(raw))
    code = F.col("mono") & ((F.size("lines") >= 2) | F.col("text").rlike(r"\{|fn |def "))
    quote = ((F.col("left") > QUOTE_INDENT) | F.col("italic")) & (F.octet_length("text") > 20)
    kind = F.when((F.col("kind") == "Paragraph") & code, "CodeBlock").when((F.col("kind") == "Paragraph") & quote, "BlockQuote").otherwise(F.col("kind"))
    items = F.when(F.col("kind") == "List", F.expr("transform(lines.item, i -> named_struct('marker', i.marker, 'text', i.content, 'level', i.level))"))
    items = F.transform(items, lambda i: F.struct(i["marker"].alias("marker"), T.clean(i["text"]).alias("text"), i["level"].alias("level")))
    runs = F.when(F.col("kind") == "Heading", F.flatten("lines.runs"))
    runs = F.filter(F.transform(runs, lambda r: F.struct(T.clean(r["text"]).alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), r["mono"].alias("mono"))), lambda r: r["text"] != "")
    return per.select(*BLOCK, "node", kind.alias("type"), F.col("head.level").alias("level"), F.coalesce(F.col("head.confidence"), F.when(kind == "BlockQuote", 0.90).when(kind == "Paragraph", 0.92)).alias("confidence"),
                      "text", F.expr("IF(kind = 'List', lines[0].item.ordered, NULL)").alias("ordered"), items.alias("items"), runs.alias("runs"), F.col("note.id").alias("id"), "target", *carry)


# --- right to left

def rtl_order(spans: DataFrame) -> DataFrame:
    """Spans (KEY, span_idx, text, x, y, w, h, font_size, bold, width, height) of a right-to-left page with zone and place.

    Here y grows upwards. Zones: 0 header, 1 title, 2 authors and abstract, 3 to 5 columns from the right, 6 sidebar,
    7 footnotes, 8 footer; within a zone by rows of six points from the top and from the right."""
    page = Window.partitionBy(*KEY)
    top = F.col("y") + F.col("h")
    note = (F.col("font_size") <= 10) & (F.col("text").rlike(r"^[(\[١1]") | F.contains("text", F.lit("انظر")) | F.contains("text", F.lit("المرجع")))
    s = spans.withColumn("edge_", F.when(F.col("y") >= F.col("height") - 40, 0).when(top <= 40, 8).when((top <= 120) & note, 7))
    s = s.withColumn("high_", top >= F.greatest(F.max(F.when(F.col("edge_").isNull(), top)).over(page), F.lit(0.0)) - 100)
    title = F.col("high_") & ((F.col("font_size") >= 16) | (F.col("font_size") >= 13) & F.col("bold"))
    abstract = F.col("high_") & F.col("text").rlike("المستخلص|ملخص|Abstract")
    s = s.withColumn("edge_", F.coalesce("edge_", F.when(title, 1).when(abstract, 2)))
    several = F.max(F.col("edge_").isNull() & (F.col("w") <= 0.48 * F.col("width")) & (F.col("w") >= 50)).over(page)
    cx, mid = F.col("x") + F.col("w") / 2, F.col("width") / 2
    side = (F.col("w") < 0.22 * F.col("width")) & ((F.col("x") > 0.78 * F.col("width")) | (F.col("x") < 0.22 * F.col("width")))
    column = F.when(~several, 3).when(side, 6).when(cx > mid + 20, 3).when(cx < mid - 20, 5).otherwise(4)
    s = s.withColumn("zone", F.coalesce("edge_", column)).drop("edge_", "high_")
    order = Window.partitionBy(*KEY).orderBy("zone", F.desc(F.floor(F.col("y") / 6 + 0.5)), F.desc("x"), "span_idx")
    return s.withColumn("place", F.row_number().over(order) - 1)


def rtl_lines(spans: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Spans (key, span_idx, text, x, w, font_size) of right-to-left lines -> key, text: from the right, with a space where
    two spans belong to different words, then the recovery chain."""
    order = Window.partitionBy(*key).orderBy(F.desc("x"), "span_idx")
    before = {c: F.lag(c).over(order) for c in ("x", "font_size", "text")}
    gap = F.greatest(before["x"] - (F.col("x") + F.col("w")), F.lit(0.0))
    last, first = (F.coalesce(F.nullif(c, F.lit("")), F.lit(" ")) for c in (F.substring(before["text"], -1, 1), F.substring("text", 1, 1)))
    one = joins(last, first, gap, F.greatest("font_size", before["font_size"]))
    space = F.when(before["text"].isNull() | one | F.endswith(before["text"], F.lit(" ")) | F.startswith("text", F.lit(" ")), "").otherwise(" ")
    parts = spans.withColumn("part_", F.concat(space, F.col("text"))).withColumn("n_", F.row_number().over(order))
    whole = parts.groupBy(*key).agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(n_, part_))), s -> s.part_)"), "").alias("text"))
    return whole.withColumn("text", recover(F.col("text")))


def merge_lines(line: DataFrame, key: tuple[str, ...], threshold: float | None = None) -> DataFrame:
    """Lines (key, line, text and, with a threshold, y and height) -> key, paragraph, text. Blank lines and clause starts
    begin a paragraph; so does, with a threshold, a wide gap."""
    order, whole = Window.partitionBy(*key).orderBy("line"), Window.partitionBy(*key)
    s = line.withColumn("text", T.strip(F.col("text")))
    start = is_clause_start(F.col("text")) | F.coalesce(F.lag("text").over(order) == "", F.lit(False))
    if threshold is not None:
        s = s.withColumn("gap_", F.abs(F.col("y") - F.lag("y").over(order)))
        s = s.withColumn("n_", F.count("gap_").over(whole)).withColumn("sd_", F.stddev_pop("gap_").over(whole)).withColumn("gaps_", F.collect_list("gap_").over(whole))
        mean = (F.col("height") + F.lag("height").over(order)) / 2
        start = start | F.coalesce(is_break(F.col("gap_"), mean, F.col("n_"), F.col("sd_"), F.expr("sort_array(gaps_)[cast(n_ DIV 2 AS int)]"), threshold), F.lit(False))
    s = s.withColumn("start_", start.cast("int")).withColumn("paragraph", F.sum("start_").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    out = s.where("text <> ''").groupBy(*key, "paragraph").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(line, text))), l -> l.text)"), " ").alias("text"))
    return out.withColumn("paragraph", (F.row_number().over(Window.partitionBy(*key).orderBy("paragraph")) - 1).cast("int"))
