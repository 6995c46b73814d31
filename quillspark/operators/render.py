"""Renderers: tables as Markdown or HTML, nodes, documents, front matter, vector drawings, the evaluation report.

Columns in, columns out; nulls of optional parts leave the part out, texts are kept whole, order is that of the arrays.
A cell is a struct (text, colspan, rowspan, align), a row an array of cells. Frames of cells (key, row_idx, col_idx,
text and optional is_header, colspan, rowspan, align) are gathered into such arrays first; other columns, also with
clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RTL, escape_gfm_cell, escape_xml, escape_yaml, strip

NO_ROWS = "cast(array() AS array<array<struct<text: string, colspan: int, rowspan: int, align: string>>>)"


# --- tables


def gathered(cells: DataFrame, key: str, first_is_header: bool = False) -> DataFrame:
    """Frame of cells -> key, headers, rows. One shuffle by key; a table is one row."""
    have = cells.columns
    own = lambda name, default: F.col(name) if name in have else F.lit(default)
    header = (F.col("row_idx") == 0) if first_is_header else F.coalesce(own("is_header", False).cast("boolean"), F.lit(False))
    cell = F.struct(F.coalesce(F.col("text"), F.lit("")).alias("text"), own("colspan", 1).cast("int").alias("colspan"), own("rowspan", 1).cast("int").alias("rowspan"), own("align", None).cast("string").alias("align"))
    plain = cells.select(F.col(key).alias("__k"), F.col("row_idx").alias("__r"), F.col("col_idx").alias("__c"), header.alias("__h"), cell.alias("__x"))
    rows = plain.groupBy("__k", "__r", "__h").agg(F.expr("transform(array_sort(collect_list(struct(__c, __x))), s -> s.__x)").alias("__row"))
    tables = rows.groupBy("__k").agg(F.expr("array_sort(collect_list(struct(__r, __h, __row)))").alias("__t"))
    part = lambda flag: F.expr(f"transform(filter(__t, s -> {flag} s.__h), s -> s.__row)")
    return tables.select(F.col("__k").alias(key), part("").alias("headers"), part("NOT").alias("rows"))


def width(headers: Column, rows: Column) -> Column:
    """Cells of the first header, or else of the first row."""
    return F.coalesce(F.size(F.get(headers, 0)), F.size(F.get(rows, 0)), F.lit(0))


def gfm(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    """A Markdown table: rows are cut or filled up to the header's width; without a header the columns are numbered."""
    n = width(headers, rows)
    cell = lambda c: F.concat(F.lit(" "), escape_gfm_cell(F.coalesce(c["text"], F.lit(""))), F.lit(" |"))
    side = F.transform(F.get(headers, 0), lambda c: F.when(F.lower(c["align"]) == "left", ":---|").when(F.lower(c["align"]) == "center", ":---:|").when(F.lower(c["align"]) == "right", "---:|").otherwise("---|"))
    own = F.concat(F.lit("|"), F.array_join(F.transform(F.get(headers, 0), cell), ""), F.lit("\n|"), F.array_join(side, ""), F.lit("\n"))
    numbered = F.concat(F.lit("|"), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(" Col "), i.cast("string"), F.lit(" |"))), ""), F.lit("\n|"), F.repeat(F.lit("---|"), n), F.lit("\n"))
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(F.slice(r, 1, F.greatest(n, F.lit(0))), cell), ""), F.repeat(F.lit("  |"), F.greatest(n - F.size(r), F.lit(0))), F.lit("\n"))
    body = F.when(n > 0, F.concat(F.when(F.size(headers) > 0, own).otherwise(numbered), F.array_join(F.transform(rows, line), ""))).otherwise("")
    return F.concat(_caption(caption, "*Table: ", "*\n\n"), body)


def _caption(caption: Column | None, before: str, after: str) -> Column:
    return F.lit("") if caption is None else F.when(caption.isNull(), "").otherwise(F.concat(F.lit(before), caption, F.lit(after)))


def html(headers: Column, rows: Column, caption: Column | None = None, rtl: bool = False) -> Column:
    """An HTML table; right-to-left cells have no align."""
    def cell(tag):
        def one(c):
            spans = [F.when(c[k] > 1, F.concat(F.lit(f' {k}="'), c[k].cast("string"), F.lit('"'))).otherwise("") for k in ("colspan", "rowspan")]
            side = F.lower(c["align"])
            align = [] if rtl else [F.when(side.isin("left", "center", "right"), F.concat(F.lit(' align="'), side, F.lit('"'))).otherwise("")]
            text = F.coalesce(c["text"], F.lit(""))
            return F.concat(F.lit(f"      <{tag}"), *spans, *align, F.lit(">"), strip(text) if rtl else text, F.lit(f"</{tag}>\n"))

        return one

    def part(name, tag, rs):
        lines = F.transform(rs, lambda r: F.concat(F.lit("    <tr>\n"), F.array_join(F.transform(r, cell(tag)), ""), F.lit("    </tr>\n")))
        return F.when(F.size(rs) > 0, F.concat(F.lit(f"  <{name}>\n"), F.array_join(lines, ""), F.lit(f"  </{name}>\n"))).otherwise("")

    head = '<table dir="rtl">\n' if rtl else "<table>\n"
    named = strip(caption) if rtl and caption is not None else caption
    return F.concat(F.lit(head), _caption(named, "  <caption>", "</caption>\n"), part("thead", "th", headers), part("tbody", "td", rows), F.lit("</table>\n"))


def has_spans(headers: Column, rows: Column) -> Column:
    """A cell spans several columns or rows."""
    return F.exists(F.flatten(F.concat(headers, rows)), lambda c: (c["colspan"] > 1) | (c["rowspan"] > 1))


def table(headers: Column, rows: Column, caption: Column | None = None, html_for_spans: bool = True) -> Column:
    """Markdown, or HTML where cells span several columns or rows."""
    plain = gfm(headers, rows, caption)
    return F.when(has_spans(headers, rows), html(headers, rows, caption)).otherwise(plain) if html_for_spans else plain


def rtl_gfm(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    """A right-to-left Markdown table: columns lean right unless told otherwise; rows keep their own width."""
    cell = lambda c: F.concat(F.lit(" "), F.replace(F.replace(strip(F.coalesce(c["text"], F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(" |"))
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, cell), ""), F.lit("\n"))
    side = F.transform(F.get(headers, 0), lambda c: F.when(F.lower(c["align"]) == "left", " :--- |").when(F.lower(c["align"]) == "center", " :---: |").otherwise(" ---: |"))
    head = F.when(F.size(headers) > 0, F.concat(line(F.get(headers, 0)), F.lit("|"), F.array_join(side, ""), F.lit("\n"))).otherwise("")
    named = strip(caption) if caption is not None else None
    return F.concat(_caption(named, "*جدول: ", "*\n\n"), F.when(width(headers, rows) > 0, F.concat(head, F.array_join(F.transform(rows, line), ""))).otherwise(""))


def rtl_table(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    return F.when(has_spans(headers, rows), html(headers, rows, caption, rtl=True)).otherwise(rtl_gfm(headers, rows, caption))


def gfm_table(cells: DataFrame, key: str) -> DataFrame:
    """Frame of cells -> key, markdown; row 0 is the header."""
    return gathered(cells, key, first_is_header=True).select(key, gfm(F.col("headers"), F.col("rows")).alias("markdown"))


def html_table(cells: DataFrame, key: str, rtl: bool = False) -> DataFrame:
    return gathered(cells, key).select(key, html(F.col("headers"), F.col("rows"), rtl=rtl).alias("html"))


def rtl_gfm_table(cells: DataFrame, key: str) -> DataFrame:
    return gathered(cells, key).select(key, rtl_gfm(F.col("headers"), F.col("rows")).alias("markdown"))


# --- nodes


def inline(run: Column) -> Column:
    """A run of text (text, bold, italic, mono, and optional strike, url, title, footnote, formula as in FULL_RUN)."""
    t = run["text"]
    return F.when(run["bold"] & run["italic"], F.concat(F.lit("***"), t, F.lit("***"))).when(run["bold"], F.concat(F.lit("**"), t, F.lit("**"))).when(run["italic"], F.concat(F.lit("*"), t, F.lit("*"))).when(run["mono"], F.concat(F.lit("`"), t, F.lit("`"))).otherwise(t)


FULL_RUN = "struct<text: string, bold: boolean, italic: boolean, mono: boolean, strike: boolean, url: string, title: string, footnote: string, formula: string>"


def full_inline(run: Column) -> Column:
    """Any kind of inline: a formula or a note stands for itself, then styles, then the link around them."""
    styled = F.when(run["strike"], F.concat(F.lit("~~"), inline(run), F.lit("~~"))).otherwise(inline(run))
    title = F.when(run["title"].isNotNull(), F.concat(F.lit(' "'), run["title"], F.lit('"'))).otherwise("")
    link = F.when(run["url"].isNotNull(), F.concat(F.lit("["), styled, F.lit("]("), run["url"], title, F.lit(")"))).otherwise(styled)
    return F.when(run["footnote"].isNotNull(), F.concat(F.lit("[^"), run["footnote"], F.lit("]"))).when(run["formula"].isNotNull(), F.concat(F.lit("$"), run["formula"], F.lit("$"))).otherwise(link)


def plain_text(runs: Column) -> Column:
    """Text of runs without styles; notes and formulas keep their signs."""
    one = lambda r: F.when(r["footnote"].isNotNull(), F.concat(F.lit("[^"), r["footnote"], F.lit("]"))).when(r["formula"].isNotNull(), F.concat(F.lit("$"), r["formula"], F.lit("$"))).otherwise(r["text"])
    return F.array_join(F.transform(runs, one), "")


def list_items(items: Column, ordered: Column, normalize=lambda c: c) -> Column:
    """Lines of a list; ordered ones are numbered from 1."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.when(ordered, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), normalize(x["text"]), F.lit("\n"))), "")


def node(kind: Column, text: Column, level: Column, items: Column, ordered: Column, heading: Column, mark: Column, title: Column | None = None) -> Column:
    """Markdown of a node: text of a Paragraph, CodeBlock, BlockQuote, Caption, Footnote (mark is its id), Formula (ordered:
    inline), Image (text: place, mark: description, title), Unknown; heading is the written text of a Heading."""
    quote = F.concat(F.array_join(F.transform(F.split(F.concat(text, F.lit("\n")), "\n"), lambda x: F.concat(F.lit("> "), x, F.lit("\n"))), ""), F.lit("\n"))
    end = F.lit("\n\n")
    title = F.lit(None).cast("string") if title is None else title
    image = F.concat(F.lit("!["), mark, F.lit("]("), text, F.when(title.isNull(), "").otherwise(F.concat(F.lit(' "'), title, F.lit('"'))), F.lit(")"), end)
    cases = {
        "Heading": F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(level, F.lit(6))).cast("int")), F.lit(" "), heading, end), "Paragraph": F.concat(text, end),
        "CodeBlock": F.concat(F.lit("```\n"), F.regexp_replace(text, r"\s+\z", ""), F.lit("\n```"), end), "BlockQuote": quote, "List": F.concat(list_items(items, ordered), F.lit("\n")), "Caption": F.concat(F.lit("*"), text, F.lit("*"), end),
        "Footnote": F.concat(F.lit("[^"), mark, F.lit("]: "), text, end), "Image": image, "Formula": F.when(ordered, F.concat(F.lit("$"), text, F.lit("$"), end)).otherwise(F.concat(F.lit("$$\n"), strip(text), F.lit("\n$$"), end)),
        "ThematicBreak": F.lit("---\n\n"), "Unknown": F.when(text == "", "").otherwise(F.concat(text, end))}
    out = None
    for k, v in cases.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def front_matter(title: Column, author: Column, subject: Column, keywords: Column, pages: Column) -> Column:
    """YAML block; empty if there is no title, author, subject or keyword. Nulls are left out."""
    quoted = lambda c: F.concat(F.lit('"'), escape_yaml(c), F.lit('"'))
    words = F.coalesce(F.size(keywords) > 0, F.lit(False))
    lines = [F.concat(F.lit(f"{k}: "), quoted(v)) for k, v in (("title", title), ("author", author), ("subject", subject))]
    lines.append(F.when(words, F.concat(F.lit("keywords: ["), F.array_join(F.transform(keywords, quoted), ", "), F.lit("]"))))
    lines.append(F.when(pages > 0, F.concat(F.lit("pages: "), pages.cast("string"))))
    some = title.isNotNull() | author.isNotNull() | subject.isNotNull() | words
    return F.when(some, F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))).otherwise("")


def page_break(style: str, page: Column) -> Column:
    """What stands between two pages: none, rule, comment or bracket."""
    styles = {"none": F.lit(""), "rule": F.lit("\n---\n\n"), "comment": F.concat(F.lit("\n<!-- pagebreak: page "), page.cast("string"), F.lit(" -->\n\n")),
              "bracket": F.concat(F.lit("\n[[Page "), page.cast("string"), F.lit("]]\n\n"))}
    return styles[style]


# --- drawings


def _number(c: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def svg_path_data(commands: Column, x0: Column, y0: Column) -> Column:
    """The d attribute of path commands (op: m, l, c, re, h; v: numbers)."""
    at = lambda c, i: _number(F.get(c["v"], i) - (x0 if i % 2 == 0 else y0))

    def one(c):
        left, top = F.get(c["v"], 0) - x0, F.get(c["v"], 1) - y0
        rect = F.concat(F.lit("M "), _number(left), F.lit(" "), _number(top), F.lit(" H "), _number(left + F.get(c["v"], 2)), F.lit(" V "), _number(top + F.get(c["v"], 3)), F.lit(" H "), _number(left), F.lit(" Z"))
        curve = F.concat(F.lit("C "), at(c, 0), F.lit(" "), at(c, 1), F.lit(", "), at(c, 2), F.lit(" "), at(c, 3), F.lit(", "), at(c, 4), F.lit(" "), at(c, 5))
        line = lambda n: F.concat(F.lit(n + " "), at(c, 0), F.lit(" "), at(c, 1))
        return F.when(c["op"] == "m", line("M")).when(c["op"] == "l", line("L")).when(c["op"] == "c", curve).when(c["op"] == "re", rect).otherwise("Z")

    return F.array_join(F.transform(commands, one), " ")


def svg_path(p: Column, x0: Column, y0: Column) -> Column:
    """A line of a drawing for a path struct of the parser; empty for a path without commands."""
    stroke, fill = F.when(p["stroke"], p["color"]).otherwise("none"), F.when(p["fill"], F.coalesce(p["fill_color"], p["color"])).otherwise("none")
    wide = F.when(p["stroke"], F.greatest(p["stroke_width"], F.lit(0.5))).otherwise(0.0)
    paint = F.concat(F.lit('stroke="'), stroke, F.lit('" stroke-width="'), _number(wide), F.lit('" fill="'), fill, F.lit('" />\n'))
    r, zero = p["rect"], F.lit(0.0)
    rect = F.concat(F.lit('  <rect x="'), _number(F.greatest(r["x"] - x0, zero)), F.lit('" y="'), _number(F.greatest(r["y"] - y0, zero)), F.lit('" width="'), _number(r["w"]), F.lit('" height="'), _number(r["h"]), F.lit('" '), paint)
    data = svg_path_data(p["commands"], x0, y0)
    return F.when(r.isNotNull(), rect).when(F.size(p["commands"]) > 0, F.concat(F.lit('  <path d="'), data, F.lit('" '), paint)).otherwise("")


def svg_text(s: Column, x0: Column, y0: Column) -> Column:
    """A line of a drawing for a span struct of the parser."""
    zero = F.lit(0.0)
    style = F.concat(F.when(s["text"].rlike(f"[{RTL}]"), ' direction="rtl" unicode-bidi="bidi-override"').otherwise(""), F.when(s["bold"], ' font-weight="bold"').otherwise(""), F.when(s["italic"], ' font-style="italic"').otherwise(""))
    return F.concat(F.lit('  <text x="'), _number(F.greatest(s["x"] - x0, zero)), F.lit('" y="'), _number(F.greatest(s["y"] + s["h"] - y0, zero)), F.lit('" font-size="'), _number(F.greatest(s["font_size"], F.lit(6.0)), 1),
                    F.lit('px" font-family="sans-serif" fill="'), s["color"], F.lit('"'), style, F.lit(">"), escape_xml(s["text"]), F.lit("</text>\n"))


def svg_document(paths: Column, texts: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """A drawing of arrays of path and span structs within a box."""
    w, h = (_number(F.greatest(c, F.lit(1.0))) for c in (w, h))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), w, F.lit(" "), h, F.lit('" width="'), w, F.lit('" height="'), h, F.lit('">\n'))
    return F.concat(head, F.array_join(F.transform(paths, lambda p: svg_path(p, x, y)), ""), F.array_join(F.transform(texts, lambda s: svg_text(s, x, y)), ""), F.lit("</svg>\n"))


def chart_paths(paths: Column) -> Column:
    """Paths that belong to a drawing: rectangles over 10 by 10 points, and others of two points at least."""
    return F.filter(paths, lambda p: F.when(p["rect"].isNotNull(), (p["rect"]["w"] > 10) & (p["rect"]["h"] > 10)).otherwise(F.size(p["points"]) >= 2))


def charts(pages: DataFrame) -> DataFrame:
    """Pages (spans, paths as the parser gives them, and other columns) with box, drawn and labels: the drawing of the page,
    if it has one: the box around its paths, the paths, and the spans within 30 points of the box."""
    out = pages.withColumn("drawn", chart_paths(F.coalesce("paths", F.expr("filter(paths, p -> false)"))))
    corner = "IF(p.rect IS NOT NULL, array(named_struct('x', p.rect.x, 'y', p.rect.y), named_struct('x', p.rect.x + p.rect.w, 'y', p.rect.y + p.rect.h)), p.points)"
    out = out.withColumn("corners_", F.expr(f"flatten(transform(drawn, p -> {corner}))"))
    out = out.withColumn("box_", F.expr("named_struct('x0', array_min(corners_.x), 'y0', array_min(corners_.y), 'x1', array_max(corners_.x), 'y1', array_max(corners_.y))"))
    real = (F.col("box_.x0") < F.col("box_.x1")) & (F.col("box_.y0") < F.col("box_.y1"))
    out = out.withColumn("box", F.when(real, F.expr("named_struct('x', box_.x0, 'y', box_.y0, 'w', box_.x1 - box_.x0, 'h', box_.y1 - box_.y0)")))
    near = "filter(spans, s -> s.x >= box_.x0 - 30 AND s.x + s.w <= box_.x1 + 30 AND s.y >= box_.y0 - 30 AND s.y + s.h <= box_.y1 + 30)"
    return out.withColumn("labels", F.when(F.col("box").isNotNull(), F.expr(near))).drop("corners_", "box_")


def chart_svg(pages: DataFrame) -> DataFrame:
    """charts with svg, null for pages without a drawing."""
    b = F.col("box")
    return charts(pages).withColumn("svg", F.when(b.isNotNull(), svg_document(F.col("drawn"), F.col("labels"), b["x"], b["y"], b["w"], b["h"])))


# --- images


def asset_name(image_id: Column, extension: Column) -> Column:
    """A safe file name: without control signs and slashes; an empty, long or climbing one becomes a hash of the id."""
    clean = F.regexp_replace(image_id, r"[\x00-\x1F\x7F-\x{009F}/\\]", "")
    odd = (clean == "") | F.contains(clean, F.lit("..")) | (F.octet_length(clean) > 64)
    low = F.lower(extension)
    kind = F.when(low == "png", "png").when(low.isin("jpg", "jpeg"), "jpg").when(low == "webp", "webp").otherwise("bin")
    return F.concat(F.when(odd, F.concat(F.lit("img_"), F.lpad(F.lower(F.hex(F.xxhash64(image_id))), 16, "0"))).otherwise(clean), F.lit("."), kind)


def is_picture(w: Column, h: Column, least: int = 32, most: int = 10_000) -> Column:
    """Neither a small ornament nor a bomb."""
    return w.between(least, most) & h.between(least, most)


# --- evaluation


def report(scored: DataFrame) -> DataFrame:
    """scored (filename, cer, wer, reference_chars, substitutions, deletions, insertions, passed) -> one row with markdown.
    The report names every file, so it is one row by its nature."""
    two = lambda c: F.format_string("%.2f", c * 100.0)
    line = F.concat(F.lit("| `"), "filename", F.lit("` | **"), two(F.col("cer")), F.lit("%** | **"), two(F.col("wer")), F.lit("%** | "), F.col("reference_chars").cast("string"), F.lit(" | "),
                    F.concat_ws("/", *[F.col(c).cast("string") for c in ("substitutions", "deletions", "insertions")]), F.lit(" | "), F.when(F.col("passed"), "✅ PASS").otherwise("❌ FAIL"), F.lit(" |\n"))
    rows = scored.select("filename", line.alias("line"), "cer", "wer", "passed")
    all_ = rows.agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(filename, line))), s -> s.line)"), "").alias("lines"), F.coalesce(F.avg("cer"), F.lit(0.0)).alias("c"), F.coalesce(F.avg("wer"), F.lit(0.0)).alias("w"), F.count_if("passed").alias("p"), F.count(F.lit(1)).alias("n"))
    head = "### 📊 Automated Evaluation Report (CER / WER)\n\n| Fixture Document | CER (%) | WER (%) | Ref Chars | Errors (S/D/I) | Status |\n| :--- | :---: | :---: | :---: | :---: | :---: |\n"
    tail = F.concat(F.lit("\n**Summary**: Average CER: **"), two(F.col("c")), F.lit("%** | Average WER: **"), two(F.col("w")), F.lit("%** | Fixtures Passed: **"), F.col("p").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("**\n"))
    return all_.select(F.concat(F.lit(head), "lines", tail).alias("markdown"))
