"""Conversion: layouts as in books, papers and forms, tables, pictures, recognition, options, sinks, streams, command line."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillspark import __main__ as cli
from quillspark.operators import tables
from quillspark.operators.ocr import MockProvider, Provider, TesseractProvider
from quillspark.plans.convert import Engine, write_assets, write_diagnostics, write_markdown
from quillspark.plans.options import ConvertOptions
from quillspark.sources import pdf
from quillspark.streaming import convert as streams


def styled(spans, drawing=b"", fonts=("Helvetica", "Helvetica-Bold", "Times-Italic", "Courier")):
    """One page of (x, y from below, size, text, font number)."""
    body = drawing + b"BT\n" + b"".join(b"/F%d %g Tf 1 0 0 1 %g %g Tm (%s) Tj\n" % (f, s, x, y, t.replace("(", r"\(").replace(")", r"\)").encode()) for x, y, s, t, f in spans) + b"ET"
    names = b" ".join(b"/F%d %d 0 R" % (i, i + 2) for i in range(1, len(fonts) + 1))
    objs = [b"<< /Type /Page /MediaBox [0 0 612 792] /Resources << /Font << %s >> >> /Contents 2 0 R >>" % names, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body), *(b"<< /Type /Font /BaseFont /%s >>" % f.encode() for f in fonts)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objs, 1))


def markdown(spark, data, **options):
    return Engine(spark, ConvertOptions(front_matter=False, **options)).convert_bytes(data)["markdown"]


def test_paragraphs_by_gaps(spark):
    page = [(72, y, 12, f"line {i}", 1) for i, y in enumerate((700, 686, 654, 640, 626))]
    assert markdown(spark, styled(page)) == "line 0 line 1\n\nline 2 line 3 line 4\n\n"


def test_two_columns_under_a_title(spark):
    left = [(72, 500 - 14 * k, 10, f"left {k} words here", 1) for k in range(4)]
    right = [(330, 500 - 14 * k, 10, f"right {k} words here", 1) for k in range(4)]
    title = [(72, 720, 20, "A paper with a title as wide as the page is", 1)]
    got = markdown(spark, styled([*right, *left, *title]), detect_tables=False)
    assert got.startswith("# A paper with") and got.index("left 0 words here left 1") < got.index("right 0 words here right 1")


def test_kinds_of_nodes(spark):
    spans = [(72, 720, 16, "Chapter One", 1), (72, 690, 11, "Plain text of the chapter that sets the body size.", 1), (72, 660, 11, "BOLD CAPS", 2), (72, 630, 11, "Figure 1 shows a thing", 1),
             (72, 600, 11, "fn main() {", 4), (72, 586, 11, "}", 4), (120, 550, 11, "An indented quotation of some length", 1), (72, 510, 11, "- first", 1), (72, 496, 11, "- second (b)", 1), (72, 460, 11, "3. third", 1), (72, 446, 11, "4) fourth", 1),
             (72, 100, 8, "1. a note at the foot", 1), (72, 20, 8, "Page 7", 1)]
    got = markdown(spark, styled(spans))
    assert got == ("# Chapter One\n\nPlain text of the chapter that sets the body size.\n\n##### **BOLD CAPS**\n\n*Figure 1 shows a thing*\n\n```\nfn main() { }\n```\n\n"
                   "> An indented quotation of some length\n> \n\n- first\n- second (b)\n\n1. third\n2. fourth\n\n[^1]: a note at the foot\n\n")


def test_words_cut_at_the_end_of_a_line(spark):
    got = markdown(spark, styled([(72, 700, 12, "a docu-", 1), (72, 686, 12, "ment, well-", 1), (72, 672, 12, "Known", 1)]))
    assert got == "a document, well- Known\n\n"


def grid(rows, top=600):
    """Drawing and spans of a ruled table."""
    n, m = len(rows), len(rows[0])
    lines = b"".join(b"70 %d %d 1 re\n" % (top - 20 * i, 100 * m) for i in range(n + 1)) + b"".join(b"%d %d m %d %d l S\n" % (70 + 100 * j, top, 70 + 100 * j, top - 20 * n) for j in range(m + 1))
    return lines, [(75 + 100 * j, top - 15 - 20 * i, 10, t, 1) for i, r in enumerate(rows) for j, t in enumerate(r) if t]


def test_ruled_table_and_text_around_it(spark):
    drawing, spans = grid([["Name", "Size"], ["a|b", "1"], ["c", ""]])
    got = markdown(spark, styled([(72, 700, 12, "Before", 1), *spans, (72, 400, 12, "After", 1)], drawing))
    assert got == "| Name | Size |\n|:---|:---|\n| a\\|b | 1 |\n| c |  |\n\nBefore\n\nAfter\n\n"
    assert "|" not in markdown(spark, styled(spans, drawing), detect_tables=False).replace("a|b", "")


def test_columns_without_lines(spark):
    spans = [(72 + 150 * j, 600 - 20 * i, 10, f"r{i}c{j}", 1) for i in range(3) for j in range(3)]
    assert markdown(spark, styled(spans)) == "| r0c0 | r0c1 | r0c2 |\n|:---|:---|:---|\n| r1c0 | r1c1 | r1c2 |\n| r2c0 | r2c1 | r2c2 |\n\n"
    short = [(72 + 150 * j, 600 - 20 * i, 10, t, 1) for i, r in enumerate((["a", "b", "c"], ["d", "e"], ["f", "g", "h"])) for j, t in enumerate(r)]
    assert '<td colspan="2" align="left">e</td>' in markdown(spark, styled(short)) and "| d | e |  |" in markdown(spark, styled(short), html_tables=False)


def pages_of_tables(*tables_of_pages):
    out, n = [], 1
    for rows in tables_of_pages:
        drawing, spans = grid(rows)
        body = drawing + b"BT\n" + b"".join(b"/F1 %g Tf 1 0 0 1 %g %g Tm (%s) Tj\n" % (s, x, y, t.encode()) for x, y, s, t, _ in spans) + b"ET"
        out += [b"<< /Type /Page /Contents %d 0 R >>" % (n + 1), b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)]
        n += 2
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(out, 1))


def test_tables_over_pages(spark):
    """A repeated header goes, data on the first row of a page stays, and three pages make one table."""
    data = pages_of_tables([["Name", "Size"], ["a", "1"]], [["Name", "Size"], ["b", "2"]], [["x", "3"], ["c", "4"]])
    got = markdown(spark, data)
    assert got.startswith("| Name | Size |\n|:---|:---|\n| a | 1 |\n| b | 2 |\n| x | 3 |\n| c | 4 |\n\n") and got.count("|:---|") == 1
    assert markdown(spark, data, stitch_tables=False).count("|:---|:---|") == 3


def test_stitching():
    def t(head, *rows, **kw):
        row = lambda r: [(x, 1, 1, "left") for x in r]
        return tables.Table([row(head)] if head else [], [row(r) for r in rows], **kw)

    a, b, c = t("xy", "12"), t("xy", "34"), t(None, "xy", "56")
    both = tables.stitch(a, b)
    assert [[x[0] for x in r] for r in both.rows] == [["1", "2"], ["3", "4"]]
    assert [[x[0] for x in r] for r in tables.stitch(both, c).rows] == [["1", "2"], ["3", "4"], ["5", "6"]]
    data = t("pq", "78")
    assert len(tables.stitch(a, data).rows) == 3 and len(tables.stitch(a, data, parity=True).rows) == 2
    assert tables.stitch(a, t("xyz", "123")) is None and tables.stitch(a, t(None)) is None
    assert tables.header_similarity(t(["Total sum", "b"]), t(["total", "c"])) == 0.5
    assert abs(tables.stitch_confidence(a, b) - 0.855) < 1e-9 and abs(tables.stitch_confidence(a, c) - 0.8075) < 1e-9 and tables.stitch_confidence(a, t("x")) == 0.0
    assert tables.stitch_list([a, "text", b, c]) [1] == "text" and len(tables.stitch_list([a, b, c])) == 1
    chain = [[a], [b], [c, "end"], [b]]
    assert [len(p) for p in tables.stitch_sections(chain)] == [1, 0, 1, 1] and [len(p) for p in tables.stitch_sections(chain, parity=True)] == [1, 0, 2, 1]
    assert tables.balance(t("abc", "d")).rows == [[("d", 3, 1, "left")]] and tables.cluster([10, 13, 20]) == [11.5, 20]


def scanned(text=b""):
    image = b"<< /Subtype /Image /Width 640 /Height 480 /Filter /DCTDecode >>\nstream\nJPEGDATA\nendstream"
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Resources << /XObject << /Im1 2 0 R >> >> /Contents 3 0 R >>\nendobj\n2 0 obj\n" + image + b"\nendobj\n3 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(text), text)


class Failing(Provider):
    def recognize(self, image, language=None, dpi=150):
        raise RuntimeError("no")


def test_recognition_and_pictures(spark):
    mock = MockProvider("recognised text")
    done = Engine(spark, ConvertOptions(provider=mock)).convert_bytes(scanned())
    assert done["markdown"] == "recognised text\n\n" and (done["diagnostics"]["ocr_pages"], done["diagnostics"]["overall_confidence"], done["pages"][0]["fusion_confidence"]) == (1, 0.88, 0.90)
    text = scanned(b"BT 72 700 Td (enough text to do without recognition) Tj ET")
    assert "recognised" not in markdown(spark, text, provider=mock) and "recognised" in markdown(spark, text, provider=mock, recognition="always")
    assert markdown(spark, scanned(), provider=mock, recognition="never") == "" == markdown(spark, scanned(), provider=Failing())
    assert markdown(spark, scanned(), extract_images=True) == "![Figure page_1_Im1](assets/page_1_Im1.jpg)\n\n"
    assert not TesseractProvider("/nowhere").is_available() or TesseractProvider("/nowhere").resolve()
    assert mock.recognize(b"").lines() == [["recognised", "text"]]


def test_drawings(spark):
    data = pdf.write_pdf([[(80, 690, 10, "Label")]], b"1 0 0 rg 100 500 200 120 re 110 510 m 200 600 l S\n")
    assert "![Vector Chart / Schematic Diagram](assets/vector_chart_p1_1.svg)" in markdown(spark, data, extract_vectors=True)
    found = Engine(spark).assets(pdf.from_bytes(spark, data, scanned())).collect()
    svg, jpg = sorted(found, key=lambda r: r.mime, reverse=True)
    text = bytes(svg.data).decode()
    assert (svg.name, jpg.name, bytes(jpg.data)) == ("vector_chart_p1_1.svg", "page_1_Im1.jpg", b"JPEGDATA")
    assert text.startswith('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 200.00 120.00" width="200.00" height="120.00">\n  <rect x="0.00" y="0.00" width="200.00" height="120.00" stroke="#000000" stroke-width="1.00" fill="none" />\n')
    assert '<path d="M 10.00 110.00 L 100.00 20.00" stroke="#000000"' in text and text.endswith("</svg>\n")


def test_every_document_has_a_row(spark):
    blank, margin = pdf.write_pdf([[]]), pdf.write_pdf([[(72, 770, 10, "Page 1")], [(72, 700, 12, "body")], [(72, 20, 8, "3")]])
    docs = spark.createDataFrame([(1, bytearray(blank), "a"), (2, bytearray(margin), "b"), (2, bytearray(margin), "c"), (3, None, "d"), (None, bytearray(b"x"), "e")], "doc_id long, content binary, MARKDOWN string")
    got = sorted((r.doc_id or 0, r.total_pages, r.error, r.markdown) for r in Engine(spark).convert(docs).collect())
    body = "\n<!-- pagebreak: page 2 -->\n\nbody\n\n\n<!-- pagebreak: page 3 -->\n\n"
    assert got == [(0, 0, "not a PDF", None), (1, 1, None, ""), (2, 3, None, body), (2, 3, None, body), (3, 0, "not a PDF", None)]
    assert Engine(spark).convert(docs.limit(0)).count() == 0


def test_options(spark):
    data = pdf.write_pdf([[(72, 700, 12, "one")], [(72, 700, 12, "two")]], title='A "b"')
    plain = lambda **k: Engine(spark, ConvertOptions(**k)).convert_bytes(data)["markdown"]
    assert plain().startswith('---\ntitle: "A \\"b\\""\npages: 2\n---\n\none') and plain(front_matter=False, page_breaks="none") == "one\n\ntwo\n\n"
    assert plain(front_matter=False, page_breaks="rule") == "one\n\n\n---\n\ntwo\n\n" and "[[Page 2]]" in plain(page_breaks="bracket")
    assert plain(dialect="commonmark", profile="low_memory") == plain()
    with pytest.raises(ValueError):
        ConvertOptions(page_breaks="star")


def test_normalisation_is_the_same_beside_the_parser(spark):
    import random

    from quillspark.functions import plain
    from quillspark.functions import text as T

    r = random.Random(6)
    letters = "ab ﺎﺑﻼةءلاﬁæ­​ é\x07ﻟﺍم​\n"
    rows = [("".join(r.choice(letters) for _ in range(r.randrange(25))),) for _ in range(800)]
    d = spark.createDataFrame(rows, "t string").select("t", T.normalize(F.col("t")).alias("n"))
    assert all(x.n == plain.normalize(x.t) for x in d.collect())


def test_sinks(spark, tmp_path):
    docs = pdf.from_bytes(spark, pdf.write_pdf([[(72, 700, 12, "one")]]), scanned())
    engine = Engine(spark)
    done = engine.convert(docs)
    for write, what, name in ((write_markdown, done, "md"), (write_diagnostics, done, "json"), (write_assets, engine.assets(docs), "assets")):
        write(what, f"{tmp_path}/{name}")
        write(what, f"{tmp_path}/{name}")  # again
    assert spark.read.parquet(f"{tmp_path}/md").where("markdown = 'one\n\n'").count() == 1
    assert spark.read.json(f"{tmp_path}/json").where("total_pages = 1").count() == 2 and spark.read.parquet(f"{tmp_path}/assets").count() == 1


def test_evaluation_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.write_pdf([[(72, 700, 12, "the same text")]]))
    (tmp_path / "a.md.gold").write_text("the same text\n")
    (tmp_path / "b.pdf").write_bytes(pdf.write_pdf([[(72, 700, 12, "other")]]))
    (tmp_path / "b.md.gold").write_text("another thing")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-")
    got = {r.filename: (r.cer, r.passed, r.insertions) for r in Engine(spark).evaluate_corpus(str(tmp_path)).collect()}
    assert got["a.pdf"] == (0.0, True, 0) and not got["b.pdf"][1] and set(got) == {"a.pdf", "b.pdf"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    source, out, diagnostics = tmp_path / "x.pdf", tmp_path / "x.md", tmp_path / "x.json"
    source.write_bytes(pdf.write_pdf([[(72, 700, 12, "hello")], [(72, 700, 12, "again")]]))
    assert cli.main([str(source), "-o", str(out), "--diagnostics-json", str(diagnostics), "--page-breaks", "none"]) == 0
    assert out.read_text() == "hello\n\nagain\n\n" and json.loads(diagnostics.read_text())["diagnostics"]["total_pages"] == 2
    assert cli.main(["convert", str(source), "--max-pages", "1"]) == 1 and "over 1 pages" in capsys.readouterr().err
    gold = tmp_path / "x.md.gold"
    gold.write_text("something else")
    assert cli.main(["eval", str(source), "--ground-truth", str(gold)]) == 1
    gold.write_text("hello\n\nagain")  # comments, as of page breaks, don't count
    assert cli.main(["eval", str(source), "--ground-truth", str(gold)]) == 0 and "Fixtures Passed" in capsys.readouterr().out
    assert cli.main(["eval-corpus", "--fixtures-dir", str(tmp_path), "--max-cer", "1.0"]) == 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(pdf.write_pdf([[(72, 700, 12, f"doc {k}")]]))
        time.sleep(0.05)
        assert streams.convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(90)
    assert sorted(r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["doc 0\n\n", "doc 1\n\n"]
    frame = spark.createDataFrame([("k", 1), ("k", 2), ("l", 3)], "idempotency_key string, n int")
    assert streams.once(frame).count() == 2


def test_document_as_json(spark):
    from quillspark.plans.convert import document_json

    drawing, cells = grid([["Name", "Size"], ["a", "1"]])
    docs = pdf.from_bytes(spark, styled([(72, 720, 18, "Head", 1), *cells, (72, 400, 12, "Text of the page", 1), (72, 386, 12, "and more", 1)], drawing), b"x")
    good, bad = document_json(docs).orderBy("doc_id").collect()
    found = json.loads(good.json)["sections"][0]["elements"]
    assert [e["type"] for e in found] == ["Table", "Heading", "Paragraph"] and found[0]["rows"][0][0]["text"] == "a" and found[2]["text"] == "Text of the page and more" and "level" not in found[2]
    assert (bad.json, bad.error) == (None, "not a PDF")


def test_pages_put_together_with_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "doc_id long, page_number int, total_pages int, markdown string"
    status = streams.TaskStatus()
    spark.streams.addListener(status)

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        pages = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = streams.assemble(pages).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(map(tuple, spark.read.schema("doc_id long, total_pages int, markdown string").parquet(f"{tmp_path}/out").collect()))

    assert push([(1, 2, 2, "b"), (2, 1, 3, "x"), (1, 2, 2, "b")]) == []
    assert push([(1, 1, 2, "a"), (2, 3, 3, "z")]) == [(1, 2, "ab")]
    spark.streams.removeListener(status)
    assert set(status.states.values()) <= {"Pending", "Processing", "Completed"}
