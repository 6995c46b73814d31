"""The parser: tokens, strings, state, drawing, fonts, images, limits, broken files."""

import random
import zlib

import pytest

from quillspark.sources import fonts, pdf


def run(stream: bytes, parity=False, **own) -> pdf.Page:
    page = pdf.Page(1)
    pdf.Interpreter(page, own, parity).run(stream)
    return page


def texts(page):
    return [s[0] for s in page.spans]


def document(*objects: bytes) -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"%%EOF"


def stream(data: bytes, head: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


PAGE = b"<< /Type /Page /MediaBox [0 0 200 100] /Resources << /Font << /F1 3 0 R >> >> /Contents 2 0 R >>"


def test_strings():
    assert texts(run(rb"(a (b (c) d) e) Tj (x\)y\\) Tj (\101\7z) Tj (new\nline) Tj (cut\
off) Tj")) == ["a (b (c) d) e", "x)y\\", "A\x07z", "new\nline", "cutoff"]
    assert texts(run(b"<48 49> Tj <484> Tj <> Tj")) == ["HI", "H@"]
    font = fonts.Font("F1", "Arial")
    assert texts(run(b"/F1 9 Tf <00480049> Tj <4849AB> Tj", F1=font)) == ["HI", "HI\xab"]
    assert texts(run("(سلام) Tj".encode())) == ["سلام"] and texts(run("/F1 9 Tf (ﺏé) Tj".encode(), F1=font)) == ["بé"]
    assert texts(run(b"% comment (no) Tj\n(yes) Tj")) == ["yes"] and texts(run(b"(open")) == []


def test_state_and_places():
    p = run(b"BT /F1 10 Tf 1 0 0 1 50 700 Tm (ab) Tj (c) Tj 0 -20 Td (d) Tj T* (e) Tj 14 TL T* (f) Tj (g) ' ET")
    assert [(s[0], round(s[1], 6), round(s[2], 6)) for s in p.spans] == [("ab", 50, 82), ("c", 61, 82), ("d", 50, 102), ("e", 50, 102), ("f", 50, 116), ("g", 50, 130)]
    p = run(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 5 Td (x) Tj ET Q BT 5 5 Td (y) Tj ET Q")
    assert [s[1:5] for s in p.spans] == [(20.0, 742.0, 11.0, 20.0), (5.0, 775.0, 6.6000000000000005, 12.0)]  # the size goes with the state, too
    p = run(b"BT /F1 10 Tf [(A) -500 (B) 100 (C)] TJ 0 -5 TD T* (D) Tj ET")
    assert [(s[0], round(s[1], 6)) for s in p.spans] == [("A", 0), ("B", 10.5), ("C", 15), ("D", 0)] and p.spans[3][2] == 792 - (-10) - 10
    assert run(b"1 0 0 rg (r) Tj 0.5 g (g) Tj 0 0 0 1 k (k) Tj").spans[0][-1] == "#ff0000"


def test_operands_of_unknown_operators():
    cut = b"/GS0 gs 5 5 Td (x) Tj"
    assert run(cut).spans[0][1] == 5.0 and run(b"/GS0 gs /F1 7 Tf (x) Tj").spans[0][5] == 7.0
    assert run(b"/F9 gs /F1 7 Tf (x) Tj", parity=True).spans[0][6] == "F9"  # as the reference engine reads it
    assert texts(run(b"Td cm (a) Tj 1 Tm (b) Tj Tf re m l c Q Q")) == ["a", "b"]


def test_paths():
    p = run(b"2 w 1 0 0 RG 10 20 30 40 re 0 0 m 5 5 l 1 2 3 4 5 6 c h S 0 0 m 1 1 2 2 v 3 3 4 4 y f* n")
    rect, line, curve = p.paths
    assert rect[0] == (10.0, 732.0, 30.0, 40.0) and rect[3:] == (True, False, 2.0, "#ff0000", "#000000")
    assert [c[0] for c in line[2]] == ["m", "l", "c", "h"] and line[1] == [(0.0, 792.0), (5.0, 787.0), (5.0, 786.0)] and line[3:5] == (True, False)
    assert curve[2][1] == ("c", [0.0, 792.0, 1.0, 791.0, 2.0, 790.0]) and curve[2][2] == ("c", [3.0, 789.0, 4.0, 788.0, 4.0, 788.0]) and curve[3:5] == (False, True)


def test_fonts_and_maps():
    cmap = b"1 beginbfchar\n<01> <0628>\n<02> <00660069>\nendbfchar\n2 beginbfrange\n<10> <12> <0041>\n<20> <21> [<0058> <0059005A>]\nendbfrange\nendcmap"
    font = b"<< /Type /Font /BaseFont /ABCDEF+Times-BoldItalic /ToUnicode 4 0 R >>"
    data = document(PAGE, stream(b"/F1 8 Tf (\\001\\002\\020\\022) Tj <2021> Tj"), font, stream(zlib.compress(cmap), b"/Filter /FlateDecode"))
    (page,), meta, error = pdf.parse(data)
    # an even number of code pairs is read four digits at a time
    assert error is None and meta[-1] == "%PDF-1.5" and page.spans[0][:1] + page.spans[0][7:10] == ("بfiAC", True, True, False)
    assert (page.width, page.height) == (200.0, 100.0)
    assert fonts.recover(0xF0C7, None, {}) == "ا" and fonts.recover(5, "uniFE8F", {}) == "ب" and fonts.recover(5, "afii57448", {}) != "" and fonts.recover(0x41, "nothing", {}) == "A"
    assert fonts.by_glyph_name("afii57414") == "ا" and fonts.by_glyph_name("bismillah") == "بسم الله الرحمن الرحيم" and fonts.by_glyph_name("tatweel") == "" and fonts.by_glyph_name("x") is None
    assert fonts.recover(1, None, {1: "\ue000"}) == "\x01"
    assert all(x in fonts.Font("F", n).__dict__ for n in ("Courier",) for x in ("bold", "mono")) and fonts.Font("F", "Consolas-Oblique").italic
    assert fonts.read_cmap("beginbfrange\n<zz> <01>\n<05> <01> <0041>\n<01> <FFFFFF> <0041>") and fonts.read_cmap("") == {}


def test_descendant_fonts_and_indirect_resources():
    page = b"<</Type/Page/Resources 5 0 R/Contents [2 0 R 6 0 R]>>"
    font = b"<< /BaseFont /Mono /DescendantFonts [4 0 R] >>"
    data = document(page, stream(b"/F7 8 Tf <0001> Tj"), font, b"<< /ToUnicode 7 0 R >>", b"<< /Font << /F7 3 0 R >> >>", stream(b"(more) Tj"), stream(b"beginbfchar <0001> <05D0> endbfchar"))
    (page,), _, _ = pdf.parse(data)
    assert texts(page) == ["א", "more"] and page.spans[0][9]
    assert pdf.parse(data, pdf.Limits(parity=True))[0][0].spans == []  # an array of streams is an empty page there


def test_images_and_capabilities(spark):
    image = stream(b"\xff\xd8data", b"/Subtype /Image /Width 40 /Height 50 /Filter /DCTDecode")
    scanned = b"<< /Type /Page /Resources << /XObject << /Im0 3 0 R /Fm 2 0 R >> >> >>"
    text = b"<< /Type /Page /Contents 5 0 R >>"
    data = document(scanned, stream(b"", b"/Subtype /Form"), image, text, stream(b"(a line of over twenty bytes) Tj"))
    pages, _, _ = pdf.parse(data)
    assert pages[0].images == [("page_1_Im0", 40, 50, "image/jpeg", b"\xff\xd8data")] and not pages[1].images
    docs = spark.createDataFrame([(1, bytearray(data)), (2, None)], "doc_id long, content binary")
    got = {r.doc_id: tuple(r)[2:] for r in pdf.capabilities(pdf.read_pages(docs)).collect()}
    assert got == {1: (2, 1, 1, 1, True), 2: (0, 0, 0, 0, False)}


def test_limits_are_errors():
    bomb = document(PAGE, stream(zlib.compress(b"0 g " * 20_000_000), b"/Filter /FlateDecode"))
    assert "times its size" in pdf.parse(bomb, pdf.Limits(stream_bytes=1 << 30))[2] and "inflates to over" in pdf.parse(bomb)[2]
    ten = pdf.write_pdf([[(72, 700, 12, "x")]] * 10)
    assert pdf.parse(ten, pdf.Limits(pages=9)) == ([], (None,) * 6, "over 9 pages") and pdf.parse(ten, pdf.Limits(pages=0))[2] and len(pdf.parse(ten, pdf.Limits(pages=10))[0]) == 10
    assert pdf.parse(ten, pdf.Limits(file_bytes=10))[2] == "over 10 bytes"
    assert [pdf.parse(x)[2] for x in (None, b"", b"PK\x03\x04")] == ["not a PDF"] * 3


def test_streams():
    raw = zlib.compress(b"(flate) Tj")
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    bare = deflate.compress(b"(bare) Tj") + deflate.flush()
    assert pdf.inflate(raw) == b"(flate) Tj" and pdf.inflate(bare) == b"(bare) Tj" and pdf.inflate(b"junk!") == b""
    assert pdf.ascii_hex(b"48 4 9 5>zz") == b"HIP" and pdf.decode_stream(b"/Filter /ASCIIHexDecode", b"28612920546A>", pdf.Limits()) == b"(a) Tj"


def test_files_without_pages_and_broken_ones():
    assert texts(pdf.parse(b"%PDF-1.4\nstream\n(one) Tj\nendstream stream\r\n" + zlib.compress(b"(two) Tj") + b"endstream")[0][0]) == ["one", "two"]
    assert pdf.parse(b"%PDF-1.4 1 0 obj << /Type /Page /Contents 9 0 R >>")[0][0].spans == []
    again = document(PAGE, stream(b"(old) Tj"), b"<< >>") + b"2 0 obj\n" + stream(b"(new) Tj") + b"\nendobj"
    assert texts(pdf.parse(again)[0][0]) == ["new"]
    r = random.Random(1)
    whole = pdf.write_pdf([[(72, 700, 12, "some (text)")]] * 2, b"q 1 0 0 1 0 0 cm 10 10 50 50 re S Q\n", "T", compress=True)
    for _ in range(300):
        cut = bytearray(whole[: r.randrange(10, len(whole))])
        for _ in range(r.randrange(6)):
            cut[r.randrange(9, len(cut))] = r.randrange(256)
        pdf.parse(bytes(cut))  # no file may fail the job


def test_metadata():
    data = pdf.write_pdf([[]], title="A title") + b" /Author (Ann) /Producer (x(y))"
    assert pdf.parse(data)[1] == ("A title", "Ann", None, None, "x(y", "%PDF-1.4")


def test_frames(spark, tmp_path):
    data = pdf.write_pdf([[(72, 700, 12, "one")], []], b"10 10 50 50 re S\n")
    docs = spark.createDataFrame([(5, bytearray(data), "x"), (5, bytearray(data), "y"), (None, None, "z")], "doc_id long, content binary, TEXT string")
    pages = pdf.read_pages(docs).collect()
    assert sorted((p.doc_id or 0, p.page_number or 0, p.total_pages, len(p.spans or ()), len(p.paths or ()), p.error) for p in pages) == [(0, 0, 0, 0, 0, "not a PDF"), (5, 1, 2, 1, 1, None), (5, 1, 2, 1, 1, None), (5, 2, 2, 0, 1, None), (5, 2, 2, 0, 1, None)]
    assert len({p.uid for p in pages}) == 3 and pages[0].spans[0].color == "#000000"
    spans = pdf.read_spans(docs).collect()
    assert sorted(((s.doc_id or 0), s.page_number or 0, s.text or "") for s in spans) == [(0, 0, ""), (5, 1, "one"), (5, 1, "one"), (5, 2, ""), (5, 2, "")]
    assert pdf.read_pages(docs.limit(0)).count() == 0
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "b.txt").write_bytes(data)
    assert pdf.read_files(spark, str(tmp_path)).count() == 1 and pdf.from_bytes(spark, data, b"x").count() == 2


@pytest.mark.parametrize("rows", [1, 3, 200])
def test_batches_don_t_change_the_rows(spark, rows):
    from pyspark.sql import types as T

    docs = spark.createDataFrame([(i, bytearray(pdf.write_pdf([[(72, 700, 12, f"d{i} p{k}")] for k in range(4)]))) for i in range(7)], "doc_id long, content binary").coalesce(1)
    got = pdf.parsed(docs, T.StructType([]), lambda p: (), pdf.Limits(), rows=rows).collect()
    assert sorted((r.doc_id, r.page_number, r.spans[0].text) for r in got) == [(i, k + 1, f"d{i} p{k}") for i in range(7) for k in range(4)]
