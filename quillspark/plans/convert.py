"""PDF bytes to Markdown: parse, find tables, drop headers and footers, order, classify, write, with diagnostics.

Parsing, tables, pictures and recognition run page by page in one pass over the files. The layout is declarative: one
shuffle by page, in which all its windows and groups run, then one of the written pages by document. A document is one
row at the end, so its text must fit a row; pages are never gathered elsewhere.

Every document has a row, also a broken one (error is set, markdown null), one without text, and rows that repeat an id.
Null content is an error; pages count whether they hold text or not; columns beside doc_id and content are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..functions import plain
from ..functions import text as T
from ..operators import evaluation, reading, render, tables
from ..sources import pdf
from .options import PROFILES, ConvertOptions

_cell = P.StructType([P.StructField("text", P.StringType()), P.StructField("colspan", P.IntegerType()), P.StructField("rowspan", P.IntegerType()), P.StructField("align", P.StringType())])
_rows = P.ArrayType(P.ArrayType(_cell))
#: A node of a page: type, and its Markdown or the parts of a table.
NODE = P.StructType([P.StructField(n, k) for n, k in (("type", P.StringType()), ("markdown", P.StringType()), ("headers", _rows), ("rows", _rows), ("caption", P.StringType()), ("confidence", P.DoubleType()), ("borders", P.BooleanType()), ("box", P.ArrayType(P.DoubleType())))])
COUNTS = ("glyph_bytes", "images", "pictures", "tables")
EXTRA = P.StructType([P.StructField("nodes", P.ArrayType(NODE)), *(P.StructField(n, P.LongType()) for n in COUNTS), P.StructField("scanned", P.BooleanType()), P.StructField("recognized", P.BooleanType())])
_SECTION = P.StructType([P.StructField("page_number", P.IntegerType()), P.StructField("nodes", P.ArrayType(NODE))])


def _node(kind: str, markdown: str | None = None, table: tables.Table | None = None) -> dict:
    out = dict.fromkeys(NODE.names) | {"type": kind, "markdown": markdown}
    if table is not None:
        out |= {"headers": tables.cells(table.headers), "rows": tables.cells(table.rows), "caption": table.caption, "confidence": table.confidence, "borders": table.borders, "box": list(table.box) if table.box else None}
    return out


def _has_chart(paths) -> bool:
    xs, ys = [], []
    for rect, points, *_ in paths:
        if rect and rect[2] > 10 and rect[3] > 10:
            xs += [rect[0], rect[0] + rect[2]]
            ys += [rect[1], rect[1] + rect[3]]
        elif not rect and len(points) >= 2:
            xs += [p[0] for p in points]
            ys += [p[1] for p in points]
    return bool(xs) and min(xs) < max(xs) and min(ys) < max(ys)


def page_values(o: ConvertOptions):
    """A function that takes the tables' spans out of a parsed page and gives the columns of EXTRA."""
    provider = o.provider if o.recognition != "never" and o.provider is not None and o.provider.is_available() else None

    def values(page: pdf.Page) -> tuple:
        size = sum(len(s[0].encode()) for s in page.spans)
        scanned = size <= 20 and bool(page.images)
        nodes, recognized, pictures, found = [], False, 0, []
        if provider is not None and (o.recognition == "always" or size < 20 and (scanned or page.images)):
            for image in page.images:
                try:
                    text = provider.recognize(image[4], None, o.recognition_dpi).text
                except Exception:  # a provider's failure leaves the page as it is
                    continue
                if text.strip():
                    nodes.append(_node("Paragraph", text + "\n\n"))
                    recognized = True
        if o.extract_images:
            for name, w, h, mime, _ in page.images:
                if 32 <= w <= 10_000 and 32 <= h <= 10_000:
                    nodes.append(_node("Image", f"![Figure {name}]({o.assets}/{name}.{'jpg' if 'jpeg' in mime else 'png'})\n\n"))
                    pictures += 1
        if o.extract_vectors and _has_chart(page.paths):
            nodes.append(_node("Image", f"![Vector Chart / Schematic Diagram]({o.assets}/vector_chart_p{page.number}_1.svg)\n\n"))
            pictures += 1
        if o.detect_tables:
            found = tables.detect(page.paths, page.spans, plain.normalize)
            nodes += [_node("Table", table=t) for t in found]
            used = {i for t in found for i in t.spans}
            page.spans = [s for i, s in enumerate(page.spans) if i not in used] if used else page.spans
        return nodes, size, len(page.images), pictures, len(found), scanned, recognized

    return values


def layout_pages(docs: DataFrame, o: ConvertOptions = ConvertOptions()) -> DataFrame:
    """One row for each page, or document without pages: the parser's columns, spans without those of tables, EXTRA."""
    return pdf.parsed(docs, EXTRA, page_values(o), o.limits, text_bytes=PROFILES[o.profile] << 18)


def page_nodes(pages: DataFrame, o: ConvertOptions = ConvertOptions()) -> DataFrame:
    """layout_pages -> one row for each node of reading.nodes; extra: the page's other columns, on some of its nodes."""
    page = pages.withColumn("content", reading.content(F.col("spans"), F.col("height")))
    page = reading.page_columns(reading.page_sizes(page))
    rest = F.struct("doc_id", "total_pages", "error", "meta", *EXTRA.names)
    spans = page.select("uid", "page_number", "width", F.col("height").alias("height_"), "body10", "levels", "n_columns", rest.alias("extra"), F.posexplode_outer("content").alias("pos", "s"))
    spans = spans.select("uid", "page_number", "width", "height_", "body10", "levels", "n_columns", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("extra")).alias("extra"), "s.*")
    line = reading.lines(reading.blocks(reading.zones(spans)), carry=("height_", "body10", "levels", "extra"))
    return reading.nodes(reading.paragraphs(reading.kinds(line), o.paragraph_gap), carry=("extra",))


def node_markdown() -> Column:
    """Markdown of a row of page_nodes."""
    written = F.array_join(F.transform("runs", render.inline), "")
    return render.node(F.col("type"), F.col("text"), F.col("level"), F.col("items"), F.col("ordered"), written, F.col("id"))


@F.udf(returnType=P.ArrayType(_SECTION), useArrow=True)
def _stitched(pages):
    """Tables that go on over pages become one; null for documents without such tables."""
    if pages is None:
        return None

    def table(n):
        rows = lambda rs: [[(c["text"], c["colspan"], c["rowspan"], c["align"]) for c in r] for r in rs]
        return tables.Table(rows(n["headers"]), rows(n["rows"]), n["caption"], n["confidence"], n["borders"], tuple(n["box"]) if n["box"] else None) if n["type"] == "Table" else n

    as_dict = lambda n: n.asDict(recursive=True) if hasattr(n, "asDict") else n
    pages = [as_dict(p) for p in pages]
    done = tables.stitch_sections([[table(n) for n in p["nodes"]] for p in pages])
    return [{"page_number": p["page_number"], "nodes": [_node("Table", table=n) if isinstance(n, tables.Table) else n for n in nodes]} for p, nodes in zip(pages, done)]


def convert(docs: DataFrame, o: ConvertOptions = ConvertOptions()) -> DataFrame:
    """docs (doc_id, content) -> doc_id, total_pages, error, markdown, diagnostics, pages (diagnostics of each)."""
    node = page_nodes(layout_pages(docs, o), o)
    # a page: its tables and pictures, then the nodes of its layout in order
    made = F.struct("zone", "block", "node", F.col("type").alias("type"), node_markdown().alias("markdown"))
    page = node.groupBy(*reading.KEY).agg(F.first("extra", ignorenulls=True).alias("extra"), F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), made))).alias("made"))
    page = page.withColumn("written", T.nfc(F.array_join("made.markdown", "")))
    empty = {k.name: F.lit(None).cast(k.dataType).alias(k.name) for k in NODE}
    text = F.struct(F.lit("Text").alias("type"), F.col("written").alias("markdown"), *[empty[n] for n in NODE.names[2:]])
    nodes = F.concat(F.coalesce("extra.nodes", F.lit(None).cast(P.ArrayType(NODE)), F.array().cast(P.ArrayType(NODE))), F.when(F.size("made") > 0, F.array(text)).otherwise(F.array().cast(P.ArrayType(NODE))))
    page = page.select("uid", "page_number", nodes.alias("nodes"), *[F.col("extra." + c).alias(c) for c in ("doc_id", "total_pages", "error", "meta", *EXTRA.names[1:])])

    real = F.col("page_number").isNotNull()
    own = F.struct("page_number", F.col("scanned").alias("is_scanned"), F.col("recognized").alias("ocr_applied"), F.col("glyph_bytes").alias("glyph_count"), F.col("images").alias("image_count"), F.col("tables").alias("table_count"),
                   F.when(F.col("recognized"), 0.85).otherwise(0.96).alias("confidence"), F.lit(0.95).alias("reading_order_score"), F.when(F.col("recognized"), 0.90).alias("fusion_confidence"))
    whole = page.groupBy("uid").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("total_pages").alias("total_pages"), F.max("error").alias("error"), F.first("meta", ignorenulls=True).alias("meta"),
        F.array_sort(F.collect_list(F.when(real, F.struct("page_number", "nodes"))), lambda a, b: a["page_number"] - b["page_number"]).alias("sections"), F.array_sort(F.collect_list(F.when(real, own))).alias("pages"),
        F.coalesce(F.count_if(real & ~(F.col("recognized") | F.col("scanned"))), F.lit(0)).alias("text_pages"), F.coalesce(F.count_if(real & (F.col("recognized") | F.col("scanned"))), F.lit(0)).alias("ocr_pages"),
        F.coalesce(F.sum("tables"), F.lit(0)).alias("tables_detected"), F.coalesce(F.sum("pictures"), F.lit(0)).alias("images_extracted"), F.coalesce(F.sum("glyph_bytes"), F.lit(0)).alias("glyph_count"))
    if o.detect_tables and o.stitch_tables:
        several = F.expr("size(filter(sections, p -> exists(p.nodes, n -> n.type = 'Table'))) > 1")
        whole = whole.withColumn("sections", F.coalesce(_stitched(F.when(several, F.col("sections"))), F.col("sections")))

    def written(n):
        table = F.concat(render.table(n["headers"], n["rows"], n["caption"], o.html_tables), F.lit("\n"))
        return F.when(n["type"] == "Table", table).otherwise(n["markdown"])

    def section(p, i):
        mark = F.when(i > 0, render.page_break(o.page_breaks, p["page_number"])).otherwise("")
        return F.concat(mark, F.array_join(F.transform(p["nodes"], written), ""))

    body = F.array_join(F.transform("sections", section), "")
    if o.front_matter:
        front = render.front_matter(F.col("meta.title"), F.col("meta.author"), F.col("meta.subject"), F.lit(None).cast("array<string>"), F.col("total_pages"))
        body = F.concat(F.when(front == "", "").otherwise(F.concat(front, F.lit("\n"))), body)
    diagnostics = F.struct("total_pages", "text_pages", "ocr_pages", "tables_detected", "images_extracted", "glyph_count", F.when(F.col("ocr_pages") > 0, 0.88).otherwise(0.96).alias("overall_confidence"))
    return whole.select("doc_id", F.coalesce("total_pages", F.lit(0)).alias("total_pages"), "error", F.when(F.col("error").isNull(), body).alias("markdown"), diagnostics.alias("diagnostics"), "pages")


#: What a node of each type holds in the JSON of a document; nulls are left out.
FIELDS = ("level", "confidence", "text", "ordered", "items", "runs", "id", "target")


def document_json(docs: DataFrame, o: ConvertOptions = ConvertOptions()) -> DataFrame:
    """docs -> doc_id, error, json: the pages of a document with their nodes in order, each with its type. Tables come first
    on a page, as in its Markdown; a document is one row, so it must fit one."""
    node = page_nodes(layout_pages(docs, o), o)
    own = F.when(F.col("type").isNotNull(), F.struct("zone", "block", "node", F.to_json(F.struct("type", *FIELDS)).alias("n")))
    page = node.groupBy(*reading.KEY).agg(F.first("extra", ignorenulls=True).alias("extra"), F.array_sort(F.collect_list(own)).alias("made"))
    tables_ = F.transform(F.filter("extra.nodes", lambda n: n["type"] == "Table"), lambda n: F.to_json(n))
    page = page.withColumn("elements", F.concat(F.coalesce(tables_, F.array().cast("array<string>")), F.col("made.n")))
    text = F.concat(F.lit('{"page_number":'), F.col("page_number").cast("string"), F.lit(',"elements":['), F.array_join("elements", ","), F.lit("]}"))
    whole = page.groupBy("uid").agg(F.first("extra.doc_id", ignorenulls=True).alias("doc_id"), F.max("extra.error").alias("error"), F.first("extra.meta", ignorenulls=True).alias("meta"),
                                    F.array_sort(F.collect_list(F.when(F.col("page_number").isNotNull(), F.struct("page_number", text.alias("t"))))).alias("p"))
    json = F.concat(F.lit('{"metadata":'), F.coalesce(F.to_json("meta"), F.lit("{}")), F.lit(',"sections":['), F.array_join("p.t", ","), F.lit("]}"))
    return whole.select("doc_id", "error", F.when(F.col("error").isNull(), json).alias("json"))


def assets(docs: DataFrame, o: ConvertOptions = ConvertOptions()) -> DataFrame:
    """docs -> doc_id, page_number, name, mime, data: the pictures and drawings that a conversion links to."""
    pages = pdf.read_pages(docs, o.limits).where("page_number IS NOT NULL")
    picture = pages.select("doc_id", "page_number", F.explode("images").alias("i")).where(render.is_picture(F.col("i.width"), F.col("i.height")))
    kind = F.when(F.contains("i.mime", F.lit("jpeg")), "jpg").otherwise("png")
    out = picture.select("doc_id", "page_number", render.asset_name(F.col("i.id"), kind).alias("name"), F.col("i.mime").alias("mime"), F.col("i.data").alias("data"))
    drawn = render.chart_svg(pages).where("svg IS NOT NULL")
    name = F.concat(F.lit("vector_chart_p"), F.col("page_number").cast("string"), F.lit("_1.svg"))
    return out.unionByName(drawn.select("doc_id", "page_number", name.alias("name"), F.lit("image/svg+xml").alias("mime"), F.col("svg").cast("binary").alias("data")))


class Engine:
    """Everything with one set of options: convert, pages, nodes, assets, evaluate, and the sinks."""

    def __init__(self, spark: SparkSession, options: ConvertOptions = ConvertOptions()):
        self.spark, self.options = spark, options

    def read(self, path: str) -> DataFrame:
        return pdf.read_files(self.spark, path)

    def convert(self, docs: DataFrame) -> DataFrame:
        return convert(docs, self.options)

    def convert_bytes(self, data: bytes) -> dict:
        """One document at hand: markdown, error and diagnostics."""
        return self.convert(pdf.from_bytes(self.spark, data)).first().asDict(recursive=True)

    def pages(self, docs: DataFrame) -> DataFrame:
        return pdf.read_pages(docs, self.options.limits)

    def nodes(self, docs: DataFrame) -> DataFrame:
        return page_nodes(layout_pages(docs, self.options), self.options)

    def assets(self, docs: DataFrame) -> DataFrame:
        return assets(docs, self.options)

    def evaluate(self, pairs: DataFrame, max_cer: float = 0.05) -> DataFrame:
        """pairs (filename, reference, hypothesis) -> the frame that render.report takes."""
        return evaluation.evaluate(pairs, max_cer)

    def evaluate_corpus(self, path: str, max_cer: float = 0.05) -> DataFrame:
        """The PDF files under a path against the .md.gold files beside them, by file name."""
        files = self.read(path)
        stem = lambda c, end: F.regexp_replace(c, end, "")
        gold = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.md.gold").option("recursiveFileLookup", "true").load(path)
        gold = gold.select(stem(F.col("path"), r"\.md\.gold$").alias("stem"), F.decode("content", "UTF-8").alias("reference"))
        done = self.convert(files).select("doc_id", F.coalesce("markdown", F.lit("")).alias("hypothesis"))
        pairs = files.select("doc_id", stem(F.col("path"), r"\.pdf$").alias("stem"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename")).join(gold, "stem").join(done, "doc_id")
        return self.evaluate(pairs.select("filename", "reference", "hypothesis"), max_cer)


# --- sinks


def write_markdown(converted: DataFrame, path: str) -> None:
    """doc_id, error and markdown as Parquet."""
    converted.select("doc_id", "error", "markdown").write.mode("overwrite").parquet(path)


def write_diagnostics(converted: DataFrame, path: str) -> None:
    """One JSON object a document: its diagnostics and those of its pages. Nulls are left out."""
    converted.select("doc_id", "error", "diagnostics.*", "pages").write.mode("overwrite").json(path)


def write_assets(found: DataFrame, path: str) -> None:
    """Pictures and drawings as Parquet by document; names repeat from document to document, so they aren't file names."""
    found.write.mode("overwrite").partitionBy("mime").parquet(path)
