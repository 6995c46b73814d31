"""Queries against brute force on whole inputs: nothing is cut, filtered or left out."""

import random

from quillspark import catalogue
from quillspark.operators import evaluation

SF = "/root/testdata/sf0.001"


def edits(a, b):
    """Word edits cell by cell: a substitution before a deletion before an insertion."""
    row = [(j, 0, 0, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        prev, row = row, [(i, 0, i, 0)]
        for j, y in enumerate(b, 1):
            s, d, n = prev[j - 1], prev[j], row[j - 1]
            if x == y:
                row.append(s)
            elif s[0] <= min(d[0], n[0]):
                row.append((s[0] + 1, s[1] + 1, s[2], s[3]))
            else:
                row.append((d[0] + 1, d[1], d[2] + 1, d[3]) if d[0] <= n[0] else (n[0] + 1, n[1], n[2], n[3] + 1))
    return row[-1]


def test_count_edits_cell_by_cell():
    r = random.Random(5)
    for _ in range(3000):
        a, b = ([r.choice("abc") for _ in range(r.randrange(9))] for _ in "12")
        assert evaluation.count_edits(a, b) == edits(a, b), (a, b)


def texts(spark, sf):
    d = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    b = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    return d, b


def fixture(spark, tmp_path):
    """Three documents, one longer than 200 characters, one null; 41 references with a gap and an empty one."""
    long = "word " * 60 + "end"
    spark.createDataFrame([(0, long), (1, None), (40, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i + (i > 2), "word " * 70 if i == 0 else "" if i == 1 else f"a x{i} c") for i in range(41)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_word_error_edits_of_whole_texts(spark, tmp_path):
    for sf in (SF, fixture(spark, tmp_path)):
        docs, items = texts(spark, sf)
        got = {r.doc_id: tuple(r)[1:] for r in catalogue.queries()["word_error_edits"](spark, sf).collect()}
        assert got == {d: edits(items[d % len(items)][1].split(), (t or "").split()) for d, t in docs.items()}


def test_character_error_rate_of_whole_texts(spark, tmp_path):
    docs, items = texts(spark, sf := fixture(spark, tmp_path))
    got = {r.doc_id: tuple(r)[1:] for r in catalogue.queries()["character_error_rate_whole"](spark, sf).collect()}
    for d, t in docs.items():
        item, ref = items[d % len(items)]
        n = edits(list(ref), list(t or ""))[0]
        assert got[d] == (item, n, round(n / len(ref), 6) if ref else float(bool(t)))
    assert len(got) == len(docs)


def test_list_items_of_every_line(spark):
    got = {(r.doc_id, r.line_idx): (r.ordered, r.marker) for r in catalogue.queries()["list_items"](spark, SF).collect()}
    docs, _ = texts(spark, SF)
    assert set(got) == {(d, i) for d, t in docs.items() for i in range(len(t.split("\n")))}
    put = {2: ("false", "-"), 3: ("true", "3"), 4: ("true", "b"), 7: ("false", "•")}
    for (d, i), item in got.items():
        kind = (d + i) % 8
        if kind in put or kind in (1, 5, 6):  # 'Page ', 'Figure 2 ', 'Table 1 ' are no items
            assert item == put.get(kind, (None, None))
    assert any(item == (None, None) for (d, i), item in got.items() if (d + i) % 8 == 0)


def test_pdf_headings_by_the_size_ladder(spark):
    from quillspark.plans.convert import convert
    from quillspark.sources import pdf

    text = [(72, 600 - 15 * k, 11, "body text of the page") for k in range(9)]
    ladder = pdf.write_pdf([[(72, 720, 20, "One"), (72, 690, 16, "Two"), (72, 660, 14, "Three"), *text], [(72, 700 - 20 * k, 18, f"large line {k}") for k in range(4)]])
    docs = spark.createDataFrame([(1, bytearray(ladder)), (2, bytearray(pdf.write_pdf([[(72, 700 - 20 * k, 18, "all large") for k in range(5)]])))], "doc_id long, content binary")
    got = {r.doc_id: r.markdown for r in convert(docs).collect()}
    assert got[1].startswith("# One\n\n## Two\n\n### Three\n\nbody text of the page body text")  # sizes of the page itself
    assert "#" not in got[1].split("page 2")[1] and "large line 0 large line 1" in got[1] and got[2] == " ".join(["all large"] * 5) + "\n\n"


def test_used_spans_are_not_broadcast(spark):
    """Behind a map over pages Spark guesses sizes far too small; the spans of tables may not pass through the driver."""
    rest = catalogue.queries()["consumed_anti_join"](spark, SF)
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "LeftAnti" in plan


def test_spans_without_tables_keep_nulls(spark):
    """Two tables of a page that share a span; spans and pages without a number belong to no table."""
    from quillspark.operators import tables

    spans = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (1, None), (2, 0), (None, 0)], "page int, span_idx int")
    found = spark.createDataFrame([(1, [0, 1]), (1, [1, 2]), (None, [0]), (2, [])], "page int, spans array<int>")
    got = {tuple(r) for r in tables.without_tables(spans, found, ("page",)).collect()}
    assert got == {(1, 3), (1, None), (2, 0), (None, 0)}
