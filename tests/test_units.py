import os
import time

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation, layout, ocr, render
from quillspark.plans.convert import convert
from quillspark.sources import pdf
from quillspark.streaming.convert import spans_stream


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(col(F.col("t")).alias("r")).first().r


def test_text_functions(spark):
    assert one(spark, T.unfold_ligatures, "ﬁn ﬂ æ​ x") == "fin fl ae x"
    assert one(spark, T.normalize, "é­\x07") == "é"
    assert one(spark, T.normalize, None) is None
    assert one(spark, T.to_western, "٣٫٥٪ ۷") == "3.5% 7"
    assert one(spark, T.paragraph_direction, "abc ابتث") == "RightToLeft"
    assert one(spark, T.is_page_number, "3 of 10") and one(spark, T.is_page_number, "12") and not one(spark, T.is_page_number, "and/or")
    assert one(spark, T.caption_target, "Fig. 3 shows") == "Figure"
    assert one(spark, lambda c: T.list_item(c)["content"], "  (b) second") == "second"
    q = spark.createDataFrame([("",), ("ok",), ("a" + "�" * 3,)], "t string").select(*[v.alias(k) for k, v in T.text_quality(F.col("t")).items()]).collect()
    assert (q[0].quality_score, q[0].printable_ratio) == (0.0, 1.0) and q[1].quality_score == 1.0 and q[2].is_corrupted


def test_arabic_and_evaluation_text(spark):
    assert one(spark, T.presentation_forms, "ﻻ ﺏ ﭖ x") == "لا ب پ x"
    assert one(spark, T.join_isolated_letters, "س ل ا م  a b") == "سلام ab" and one(spark, T.join_isolated_letters, None) is None
    assert one(spark, T.attach_diacritics, "ب َ  ً") == "بَ ً"
    assert one(spark, T.mirror_punctuation, 'a, "b"? 1,234; "c') == "a، «b»؟ 1,234؛ «c"
    assert one(spark, T.citation, " (x 1 ) ") == "[^x 1]" and one(spark, T.citation, " (x") == "(x"
    assert one(spark, lambda c: T.scholarly_heading(c, F.lit(9)), " t ") == "###### t"
    assert one(spark, lambda c: T.join_line(c, F.lit("語")), "日本 ") == "日本語" and one(spark, lambda c: T.join_line(c, F.lit("b")), "a") == "a b"
    assert one(spark, T.eval_normalize, "---\nt: x\n---\n# A <!-- n\n--> *b*\n- c <!--> d") == "A b c d"


def test_recognition_decisions(spark):
    rows = [("a", "", 0, 1, False), ("b", "short", 1, 1, False), ("c", "x�" * 20, 1, 0, False), ("d", "clean text of a page", 1, 1, None), ("e", None, 0, 0, True)]
    d = spark.createDataFrame(rows, "k string, t string, s int, i int, f boolean")
    got = {r.k: r for r in d.select("k", *[v.alias(n) for n, v in ocr.necessity(F.col("t"), F.col("s"), F.col("i"), F.col("f")).items()]).collect()}
    assert [got[k].necessity for k in "abcde"] == [1.0, 0.85, 0.90, 0.0, 1.0] and got["c"].is_font_corrupted and not got["d"].should_ocr and got["e"].is_image_only
    b = spark.range(1).select(*[v.alias(n) for n, v in ocr.best_stream(F.lit("n"), F.lit(0.5), F.lit("o"), F.lit(0.6)).items()]).first()
    assert (b.text, b.confidence, b.source) == ("o", 0.6, "ocr")


def test_renderers(spark):
    cells = spark.createDataFrame([(1, 0, 0, True, " h|1 ", 2, 1, "Left"), (1, 1, 0, False, "a\nb", 1, 1, None), (1, 1, 1, False, None, 1, 2, "center")],
                                  "k int, row_idx int, col_idx int, is_header boolean, text string, colspan int, rowspan int, align string")
    html = render.html_table(cells, "k").first().html
    assert '<th colspan="2" align="left"> h|1 </th>' in html and '<td rowspan="2" align="center"></td>' in html and html.index("<thead>") < html.index("<tbody>")
    assert render.rtl_gfm_table(cells, "k").first().markdown == "| h\\|1 |\n| :--- |\n| a b |  |\n"
    assert render.html_table(cells.limit(0), "k").count() == 0
    none = F.lit(None).cast("string")
    r = spark.range(1).select(render.front_matter(F.lit('a"b'), none, none, F.array(F.lit("k")), F.lit(2)).alias("a"), render.front_matter(none, none, none, F.lit(None).cast("array<string>"), F.lit(2)).alias("b"),
                              render.page_break("comment", F.lit(3)).alias("c"), render.page_break("rule", F.lit(3)).alias("d")).first()
    assert tuple(r) == ('---\ntitle: "a\\"b"\nkeywords: ["k"]\npages: 2\n---\n', "", "\n<!-- pagebreak: page 3 -->\n\n", "\n---\n\n")


def test_clusters_and_edits(spark):
    assert one(spark, layout.cluster_coordinates, [10.0, 12.0, 15.0, 40.0], "array<double>") == [13.0, 40.0]
    e = spark.createDataFrame([("a b c", "a x c d")], "a string, b string").select(evaluation.word_edits("a", "b").alias("e")).first().e
    assert (e.errors, e.substitutions, e.deletions, e.insertions) == (2, 1, 0, 1)


def test_pdf_round_trip_and_broken_input(spark):
    data = pdf.write_pdf([[(72, 700, 18, "Title (1)"), (72, 680, 12, "line é of the body")], [(72, 700, 12, "second")]])
    pages, _, error = pdf.parse(data)
    assert error is None and [[s[0] for s in p.spans] for p in pages] == [["Title (1)", "line é of the body"], ["second"]]
    docs = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"junk")), (3, None)], "doc_id long, content binary")
    got = {r.doc_id: r for r in convert(docs).collect()}
    assert got[1].total_pages == 2 and got[1].markdown.startswith("# Title (1)") and "second" in got[1].markdown
    assert got[2].error == got[3].error == "not a PDF"


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(pdf.write_pdf([[(72, 700, 12, f"doc {k}")]]))
        time.sleep(0.05)
        assert spans_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["doc 0", "doc 1"]
