"""Arabic and mixed text: order, shapes, tokens, expressions, classifiers; recognition decisions; right-to-left pages."""

from pyspark.sql import functions as F

from quillspark.functions import arabic as A
from quillspark.functions import text as T
from quillspark.operators import evaluation, ocr, reading, render, spatial


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(col(F.col("t")).alias("r")).first().r


def test_words_in_visual_order(spark):
    assert one(spark, A.bidi, "ﻡﻼﺳ abc") == "سالم abc"  # turned round letter by letter
    assert one(spark, A.bidi, "سلام") == "سلام" and one(spark, A.bidi, "ةسردم x") == "مدرسة x" and one(spark, A.bidi, None) is None and one(spark, A.bidi, "plain  text ") == "plain  text "


def test_shapes_and_marks(spark):
    assert one(spark, A.unshape, "ﷺ ﻼ ﭧ ﯼ مـد") == "صلى الله عليه وسلم لا ٹ ۍ مد"
    assert one(spark, lambda c: A.unshape(c, diacritics="strip"), "مُحَمَّد") == "محمد" and one(spark, lambda c: A.unshape(c, diacritics="shadda"), "مُحَمَّد") == "محمّد"
    assert one(spark, lambda c: A.unshape(c, shaping="preserve"), "ﻼـ") == "ﻼـ"


def test_recovery_chain(spark):
    assert one(spark, A.recover, "ت ق ر ي ر  ح و ل") == "تقرير حول"
    assert one(spark, A.recover, 'قال "نعم", ما؟ 1,234') == "قال «نعم»، ما؟ 1,234" and one(spark, A.recover, "") == ""
    assert one(spark, lambda c: A.recover(c, A.ArabicOptions(letters="orthographic", punctuation="preserve")), "أحمد فى مدرسة؟,") == "احمد في مدرسه؟,"


def test_tokens(spark):
    text = "زر https://x.org/ﺏ) [A1,2] [too long to be one] `ﺏ x` a_b@c.de file.txt 12.5% ﺏ!"
    got = one(spark, A.tokens, text)
    assert "".join(t.text for t in got) == text
    kinds = {t.text: t.kind for t in got}
    assert [kinds[k] for k in ("زر", "https://x.org/ﺏ", "[A1,2]", "`ﺏ x`", "a_b@c.de", "file.txt", "12.5%", "!")] == ["ArabicText", "Url", "CitationOrReference", "CodeFragment", "Email", "FilenameOrPath", "Numeric", "PunctuationOrSymbol"]
    assert kinds["["] == "PunctuationOrSymbol" and kinds["long"] == "LatinText" and one(spark, A.tokens, "") == []
    assert one(spark, A.process_line, text) == text[:-2] + "ب!" and one(spark, A.process_line, "no ﻿") is not None


def test_expressions(spark):
    got = one(spark, A.expressions, "في 12/05/2020 ٥٠٪ 10:30 100 ريال [1] (٣) ص. 12% ص ص 5 x-y 1-2 1-2-3 ص")
    assert [(e.kind, e.value, e.unit) for e in got] == [("Date", "12/05/2020", None), ("Percentage", "٥٠٪", None), ("Time", "10:30", None), ("Currency", "100", "ريال"), ("Citation", "[1]", None), ("FootnoteMarker", "(٣)", None),
                                                        ("PageReference", "ص. 12%", None), ("PageReference", "ص ص", None), ("Date", "1-2-3", None)]
    assert one(spark, A.expressions, "") == [] and one(spark, A.expressions, None) is None


def test_classifiers(spark):
    level = lambda c: A.heading(c)[0]
    assert [one(spark, level, t) for t in (" الباب الأول", "الفصل ٢", "المادة 1", "أولاً: كذا", "نص")] == [1, 2, 3, 4, None]
    marker = lambda c: A.list_item(c)["marker"]
    assert [one(spark, marker, t) for t in ("أ- بند", "(١٢) بند", "ب) x", "12. x", "")] == ["أ", "١٢", "ب", None, None]
    assert one(spark, A.caption_target, "جدول 2: x") == "Table" and one(spark, A.scholarly_section, "قائمة المراجع") == "References" and one(spark, A.scholarly_section, "x") is None
    assert one(spark, A.has_isolated_letters, "ت ق ر ي") and not one(spark, A.has_isolated_letters, "ت ق ر ab cd ef gh") and one(spark, A.has_broken_lam_alef, "ل ا") and one(spark, A.has_private_use, "\ue001")
    assert [one(spark, A.dialect, t) for t in ("ar_EG", "SA", "fr", None)] == ["Egypt", "SaudiArabia", "GeneralArabic", "GeneralArabic"]
    assert one(spark, A.table_direction, ["ابت", "ab"], "array<string>") == "RightToLeft" and one(spark, A.table_direction, [" "], "array<string>") == "RightToLeft" and one(spark, A.table_direction, ["abc"], "array<string>") == "LeftToRight"


def test_hyphens_and_lists(spark):
    join = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(T.merge_hyphenated(F.col("a"), F.col("b")).alias("r")).first().r
    assert join("The docu-", "mentation") == "The documentation" and join("well-", "Known") == "well- Known" and join("", " b") == " b" and join("a ", "") == "a "
    item = lambda t: spark.createDataFrame([(t,)], "t string").select(*[v.alias(k) for k, v in T.list_item(F.col("t")).items()]).first()
    assert tuple(item("(iv) x")) == (True, "iv", "x") and tuple(item("1.1 x")) == (True, "1", "1 x") and item("mm. x").marker is None and item("123456789. x").marker is None and item(None).marker is None


def test_right_to_left_page(spark):
    spans = [(0, "title", 200, 700, 200, 20, 18.0), (1, "right 1", 320, 600, 200, 12, 11.0), (2, "left 1", 60, 600, 200, 12, 11.0), (3, "right 2", 320, 580, 200, 12, 11.0), (4, "(1) note", 320, 80, 100, 10, 9.0), (5, "12", 300, 20, 12, 10, 9.0), (6, "head", 60, 770, 90, 10, 9.0), (7, "side", 500, 400, 60, 10, 9.0)]
    rows = [(1, 1, *s, False, 612.0, 792.0) for s in spans]
    d = spark.createDataFrame([(*r[:4], *map(float, r[4:9]), *r[9:]) for r in rows], "uid long, page_number int, span_idx int, text string, x double, y double, w double, h double, font_size double, bold boolean, width double, height double")
    got = [r.text for r in reading.rtl_order(d).orderBy("place").collect()]
    assert got == ["head", "title", "right 1", "right 2", "left 1", "side", "(1) note", "12"]
    line = spark.createDataFrame([(1, 0, "بيت", 100.0, 20.0, 12.0), (1, 1, "كبير", 60.0, 30.0, 12.0), (1, 2, "ة", 56.0, 4.0, 12.0)], "k int, span_idx int, text string, x double, w double, font_size double")
    assert reading.rtl_lines(line, ("k",)).first().text == "بيت كبيرة"


def test_paragraphs_of_lines(spark):
    lines = [(1, i, t, y, 12.0) for i, (t, y) in enumerate((("one", 100.0), ("two", 114.0), ("three", 128.0), ("four", 158.0), ("five", 172.0)))]
    d = spark.createDataFrame(lines, "k int, line int, text string, y double, height double")
    assert [r.text for r in reading.merge_lines(d, ("k",), 1.4).orderBy("paragraph").collect()] == ["one two three", "four five"]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(("one", "", " two", "- three", "1. four"))], "k int, line int, text string")
    assert [r.text for r in reading.merge_lines(d, ("k",)).orderBy("paragraph").collect()] == ["one", "two", "- three", "1. four"]


def fused(spark, native, recognised, quality, confidence):
    return spark.createDataFrame([(native, recognised, quality, confidence)], "a string, b string, q double, c double").select(ocr.fuse(F.col("a"), F.col("b"), F.col("q"), F.col("c")).alias("f")).first().f


def test_fusion(spark):
    assert tuple(fused(spark, None, " ", 0.5, 0.5))[0:1] + (fused(spark, None, " ", 0.5, 0.5).source,) == ("", "empty")
    assert fused(spark, "", "x", 0.1, 0.9).source == "ocr" and fused(spark, "x", None, 0.3, 0.9).source == "native" and fused(spark, "x ", "x", 0.3, 0.9).confidence == 0.9
    assert fused(spark, "good", "g00d", 0.98, 0.82).text == "good" and fused(spark, "��", "ok", 0.15, 0.95).source == "ocr"
    f = fused(spark, "t�xt and more", "text", 0.65, 0.60)
    assert (f.text, f.source, f.native_chars, f.ocr_chars) == ("text and more", "fused", 12, 1) and abs(f.confidence - 0.65) < 1e-9
    assert fused(spark, "a\U0001f600c", "b\U0001f601cd", 0.5, 0.6).text == "b\U0001f601cd"


def test_decisions(spark):
    d = spark.createDataFrame([("", 0, None, 0.0), ("clean text", 1, None, 0.0), ("clean text", 1, "Diwani", 0.95), ("x\ue001" * 20, 1, None, 0.0), ("fine te�t", 1, None, 0.0)], "t string, n int, s string, c double")
    got = [r.kind for r in d.select(ocr.decision(F.col("t"), F.col("n"), F.lit(0), F.col("s"), F.col("c"))["kind"].alias("kind")).collect()]
    assert got == ["Require", "Skip", "Require", "Require", "Fuse"]
    gate = spark.createDataFrame([(5, 1, None), (5, 0, True), (5, 0, False), (50, 1, None), (None, 1, None)], "b int, i int, s boolean").select(ocr.needed("auto", F.col("b"), F.col("i"), F.col("s")).alias("g")).collect()
    assert [r.g for r in gate] == [True, True, False, False, True]
    assert one(spark, ocr.script_by_font, "Jameel Noori") == "Nastaliq" and one(spark, ocr.script_by_font, "Arial") is None


def test_boxes(spark):
    items = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 20.0, 10.0, 5.0), (1, 2, 4.0, 20.0, 10.0, 5.0), (2, 3, 0.0, 20.0, 10.0, 5.0)], "page int, id int, x double, y double, w double, h double")
    top = items.where("id = 0")
    assert spatial.nearest_below(top, items, ("page",), 50.0).first().item_id == 2 and spatial.nearest_below(top, items, ("page",), 5.0).count() == 0
    assert spatial.nearest_above(items.where("id = 1"), items, ("page",), 50.0).first().item_id == 0
    assert {r.item_id for r in spatial.query_intersecting(items.where("id = 1"), items, ("page",)).collect()} == {1, 2} and spatial.query_contained(top, items, ("page",)).count() == 1
    a, b = spatial.box(), spatial.box()
    r = items.where("id = 0").select(spatial.distance_to_point(a, F.lit(13.0), F.lit(14.0)).alias("d"), spatial.overlap_share(a, b).alias("o"), spatial.same_line(F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(0.01), 2.0).alias("l"), spatial.hex_color(F.lit(2.0), F.lit(-1.0), F.lit(0.5)).alias("c")).first()
    assert tuple(r) == (5.0, 1.0, True, "#ff0080")


def test_inline_kinds_and_reports(spark):
    run = "named_struct('text', 't', 'bold', {}, 'italic', {}, 'mono', false, 'strike', {}, 'url', {}, 'title', {}, 'footnote', {}, 'formula', {})"
    runs = [run.format(*v) for v in (("true", "true", "false", *["cast(null AS string)"] * 4), ("false", "false", "true", *["cast(null AS string)"] * 4), ("true", "false", "false", "'u'", "'T'", *["cast(null AS string)"] * 2), ("false", "false", "false", *["cast(null AS string)"] * 2, "'1'", "cast(null AS string)"), ("false", "false", "false", *["cast(null AS string)"] * 3, "'x^2'"))]
    d = spark.range(1).select(F.expr(f"array({', '.join(runs)})").alias("r"))
    r = d.select(F.array_join(F.transform("r", render.full_inline), " ").alias("a"), render.plain_text(F.col("r")).alias("b")).first()
    assert tuple(r) == ('***t*** ~~t~~ [**t**](u "T") [^1] $x^2$', "ttt[^1]$x^2$")
    empty = spark.createDataFrame([], "filename string, cer double, wer double, reference_chars int, substitutions int, deletions int, insertions int, passed boolean")
    assert "**0/0**" in render.report(empty).first().markdown and not evaluation.corpus_report(empty).first().all_passed
    name = lambda t: spark.createDataFrame([(t,)], "t string").select(render.asset_name(F.col("t"), F.lit("JPEG")).alias("n")).first().n
    assert name("a/b\x00c") == "abc.jpg" and name("../../x").startswith("img_") and name("").startswith("img_") and name("x" * 65).startswith("img_")


def test_tables_without_header_and_with_spans(spark):
    cells = spark.createDataFrame([(1, 1, 0, "a", False, "x"), (1, 1, 1, "b", False, "y"), (1, 2, 0, "c", False, "z")], "k int, row_idx int, col_idx int, text string, is_header boolean, t string")
    assert render.gathered(cells, "k").select(render.gfm(F.col("headers"), F.col("rows"), F.lit("Cap")).alias("m")).first().m == "*Table: Cap*\n\n| Col 1 | Col 2 |\n|---|---|\n| a | b |\n| c |  |\n"
    wide = cells.withColumn("colspan", F.when(F.col("text") == "c", 2).otherwise(1))
    assert '<td colspan="2">c</td>' in render.gathered(wide, "k").select(render.table(F.col("headers"), F.col("rows")).alias("m")).first().m
    assert render.gathered(cells.limit(0), "k").count() == 0
    rtl = render.gathered(cells, "k").select(render.rtl_table(F.col("headers"), F.col("rows"), F.lit(" عنوان ")).alias("m")).first().m
    assert rtl == "*جدول: عنوان*\n\n| a | b |\n| c |\n"


def test_evaluation_of_pairs(spark):
    d = spark.createDataFrame([("a", "same text", "same  text"), ("b", "", "x"), ("c", None, None), ("d", "abcd", "abxd")], "filename string, reference string, hypothesis string")
    got = {r.filename: (r.cer, r.wer, r.substitutions, r.passed) for r in evaluation.evaluate(d).collect()}
    assert got == {"a": (0.0, 0.0, 0, True), "b": (1.0, 1.0, 0, False), "c": (0.0, 0.0, 0, True), "d": (0.25, 1.0, 1, False)}


def test_paragraphs_are_joined_as_line_after_line(spark):
    import random

    r = random.Random(12)
    rows = [([("".join(r.choice("ab Zé-\u2010\u00ad漢。 ") for _ in range(r.randrange(5)))) for _ in range(r.randrange(1, 6))],) for _ in range(3000)]
    fold = F.aggregate("t", F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(T.join_paragraph_line(a, x)))
    got = spark.createDataFrame(rows, "t array<string>").select("t", fold.alias("a"), T.join_paragraph(F.col("t")).alias("b")).collect()
    assert [(x.t, x.a) for x in got] == [(x.t, x.b) for x in got]
