"""Registry of the library's queries and of the DuckDB SQL that checks them.

The tables hold no Arabic, ligatures or broken characters, so the text queries put them in, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluation, layout, ocr, render
from .plans.convert import convert
from .sources import pdf

# Queries run over whole tables and whole texts; letters are put in alike on both sides, never rows left out.

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir, text):
    return _t(spark, sf_dir, "documents").select("doc_id", text.alias("t"))


def _n(pattern: str) -> str:
    """Characters of a class in DuckDB: all matches, listed and counted."""
    return f"len(regexp_extract_all(t, '[{pattern}]'))"


def flagship(spark, sf_dir):
    return convert(pdf.synthesize(_t(spark, sf_dir, "documents")))


@_query()
def convert_pdf(spark, sf_dir):
    return flagship(spark, sf_dir)


BROKEN = "translate(text, 'qzk', '�\ue001\x02')"
QUALITY = f"""
WITH d AS (SELECT doc_id, {BROKEN.replace(chr(2), "' || chr(2) || '")} AS t FROM documents),
c AS (SELECT doc_id, t, length(t)::DOUBLE AS n, {_n('�')} AS bad, {_n(chr(0xE000) + '-' + chr(0xF8FF))} AS pua,
      {_n(r'\x{0001}-\x{001F}\x{007F}-\x{009F}')} AS every, {_n(r'\n\r\t')} AS white FROM d),
r AS (SELECT *, (n - bad - pua - every) / n AS ratio FROM c)
SELECT doc_id, round(greatest(0.0, least(1.0, ratio - (bad * 0.05::DOUBLE + pua * 0.02::DOUBLE + (every - white) * 0.05::DOUBLE))), 6) AS quality_score,
       (bad / n > 0.05 OR pua / n > 0.10 OR ratio < 0.70) AS is_corrupted, round(ratio, 6) AS printable_ratio,
       bad::BIGINT AS replacement_chars, pua::BIGINT AS pua_chars FROM r
"""


class _Counted(dict):
    """Columns q_* of _counted by the names of quality_counts; made when asked for, as columns need a session."""

    def __missing__(self, k):
        return F.col("q_" + k)

    def __bool__(self):
        return True


_COUNTED = _Counted()


def _counted(d):
    """d with the counts of column t, each made once."""
    return d.withColumns({"q_" + k: v for k, v in T.quality_counts(F.col("t")).items()})


@_query(QUALITY)
def text_quality(spark, sf_dir):
    d = _docs(spark, sf_dir, F.translate("text", "qzk", "�\ue001\x02"))
    q = T.text_quality(F.col("t"))
    for k in ("quality_score", "printable_ratio"):
        q[k] = F.round(q[k], 6)
    return d.select("doc_id", *[v.alias(k) for k, v in q.items()])


MIXED = ("bcdfgh", "ابتцчα")
_COUNTS = ", ".join(f"{_n(r)}::BIGINT AS n_{s.lower()}" for s, r in T.SCRIPTS.items())


@_query(f"WITH d AS (SELECT doc_id, translate(text, '{MIXED[0]}', '{MIXED[1]}') AS t FROM documents) SELECT doc_id, {_COUNTS} FROM d")
def script_distribution(spark, sf_dir):
    d = _docs(spark, sf_dir, F.translate("text", *MIXED))
    return d.select("doc_id", *T.script_counts(F.col("t")))


#: Texts of several scripts: by doc_id letters become Arabic, Cyrillic, Chinese, Devanagari, Hebrew, or stay.
_SCRIPTED = (("", ""), ("abcdefghilmnoprstuvw", "ابتثجحخدذرزسشصضطظعغف"), ("abcdefghilmnoprstuvw", "абвгдежзиклмнопрстуі"), ("abcdefghilmnoprstuvw", "一二三四五六七八九十日月火水木金土山川か"),
             ("abcdefghilmnoprstuvw", "अआइईउऊएऐओऔकखगघचछजझटठ"), ("abcdefghilmnoprstuvw", "אבגדהוזחטיכלמנסעפצקר"), ("aeiou", "ٹڈپچې"), ("et", "ğñ"))
_SCRIPT_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN " + (f"translate(text, '{a}', '{b}')" if a else "text") for i, (a, b) in enumerate(_SCRIPTED)) + " END"


def _scripted(spark, sf_dir):
    return _docs(spark, sf_dir, F.expr("CASE pmod(doc_id, 8) " + " ".join(f"WHEN {i} THEN " + (f"translate(text, '{a}', '{b}')" if a else "text") for i, (a, b) in enumerate(_SCRIPTED)) + " END"))


_NAMES = [s.lower() for s in T.SCRIPTS]
_TOTAL = " + ".join(f"n_{s}" for s in _NAMES)
_TOP = "greatest(" + ", ".join(f"n_{s}" for s in _NAMES) + ")"
_MIXED = " + ".join(f"(n_{s} > 0.15::DOUBLE * ({_TOTAL}))::INT" for s in _NAMES)
_DOMINANT = (f"CASE WHEN {_TOTAL} = 0 THEN 'Unknown' WHEN {_MIXED} > 1 AND {_TOP} < 0.70::DOUBLE * ({_TOTAL}) THEN 'Mixed' " + " ".join(f"WHEN n_{s.lower()} = {_TOP} THEN '{s}'" for s in T.SCRIPTS) + " END")
_DOMINANT_SQL = f"WITH d AS (SELECT doc_id, {_SCRIPT_SQL} AS t FROM documents), c AS (SELECT doc_id, t, {_COUNTS} FROM d), s AS (SELECT *, {_DOMINANT} AS script FROM c)"


def _with_scripts(d):
    """d with a column for each script, so that each class is counted once, and the dominant script."""
    d = d.select("doc_id", "t", *T.script_counts(F.col("t")))
    return d.withColumn("script", T.dominant_script({s: F.col(f"n_{s.lower()}") for s in T.SCRIPTS}))


@_query(f"{_DOMINANT_SQL} SELECT doc_id, script, " + ", ".join(f"round(n_{s} / greatest({_TOTAL}, 1)::DOUBLE, 6) AS ratio_{s}" for s in _NAMES) + " FROM s")
def script_dominant(spark, sf_dir):
    d = _with_scripts(_scripted(spark, sf_dir))
    total = F.greatest(sum((F.col(f"n_{s}") for s in _NAMES), F.lit(0)), F.lit(1))
    return d.select("doc_id", "script", *[F.round(F.col(f"n_{s}") / total, 6).alias(f"ratio_{s}") for s in _NAMES])


def _by_marks(value) -> str:
    cases = [(f"script = '{s}'" + (f" AND regexp_matches(t, '{pattern}')" if pattern else ""), value(lang, conf)) for s, marks in T.LANGUAGE_MARKS.items() for pattern, lang, conf in marks]
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " END"


@_query(f"{_DOMINANT_SQL} SELECT doc_id, {_by_marks(lambda lang, conf: repr(lang))} AS language, {_by_marks(lambda lang, conf: f'{conf}::DOUBLE')} AS confidence FROM s")
def language_classify(spark, sf_dir):
    d = _with_scripts(_scripted(spark, sf_dir))
    name, confidence = T.language(F.col("script"), F.col("t"))
    return d.select("doc_id", name.alias("language"), confidence.cast("double").alias("confidence"))


def _same(name: str, inject: tuple[str, str] | None, func, sql: str):
    """A query that maps documents.text, with letters put in, by one column function."""
    src = f"translate(text, '{inject[0]}', '{inject[1]}')" if inject else "text"

    def run(spark, sf_dir):
        c = F.translate("text", *inject) if inject else F.col("text")
        return _docs(spark, sf_dir, c).select("doc_id", func(F.col("t")).alias("result"))

    run.__name__ = name
    _query(f"WITH d AS (SELECT doc_id, {src} AS t FROM documents) SELECT doc_id, {sql} AS result FROM d")(run)


def _nest(pairs) -> str:
    out = "t"
    for a, b in pairs:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def FORM_NEST(c: str) -> str:
    """SQL for plain letters of a text named c."""
    return f"translate({_nest(T.FORM_PAIRS).replace('(t,', f'({c},').replace('t, ', f'{c}, ')}, '{T.FORMS[0]}', '{T.FORMS[1]}')"


_same("ligature_unfold", ("qzkx", "ﬁﬄæ "), T.unfold_ligatures, f"regexp_replace(regexp_replace({_nest(T.LIGATURES)}, '{T.WIDE_SPACES}', ' ', 'g'), '{T.DROPPED}', '', 'g')")
_same("soft_hyphens", ("qz", "­­"), T.clean_soft_hyphens, "replace(t, '­', '')")
_same("strip_diacritics", ("aei", "ًَْ"), T.strip_diacritics, "regexp_replace(t, '[\\x{064B}-\\x{065F}\\x{0670}]', '', 'g')")
_same("collapse_whitespace", ("qz", "\t "), T.collapse_whitespace, "regexp_replace(t, '[\\t \\x{00A0}]+', ' ', 'g')")
_same("normalize_alif", ("abc", "أإآ"), T.normalize_alif, "translate(t, 'أإآٱ', 'اااا')")
_same("normalize_orthography", ("abc", "ةىئ"), T.normalize_orthography, "translate(t, 'ةىئ', 'هيي')")
_same("numerals_western", ("abcde", "٠٣۷٫٪"), T.to_western, "translate(t, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬٪', '01234567890123456789.,%')")
_same("numerals_eastern", ("abc", "059"), T.to_eastern_indic, "translate(t, '0123456789.,%', '٠١٢٣٤٥٦٧٨٩٫٬٪')")
_same("numerals_persian", ("abc", "059"), T.to_perso_arabic, "translate(t, '0123456789', '۰۱۲۳۴۵۶۷۸۹')")
_same("numeral_system", ("abc", "٠5۷"), T.numeral_system, f"CASE WHEN {_n('٠-٩')} > {_n('0-9')} AND {_n('٠-٩')} > {_n('۰-۹')} THEN 'EasternArabicIndic' WHEN {_n('0-9')} > {_n('٠-٩')} AND {_n('0-9')} > {_n('۰-۹')} THEN 'WesternArabic' WHEN {_n('۰-۹')} > 0 THEN 'PersoArabic' ELSE 'WesternArabic' END")
_same("paragraph_direction", ("abcdefghio", "ابتثجحخدذر"), T.paragraph_direction, f"CASE WHEN {_n(T.RTL)} > 0 AND ({_n(T.RTL)} >= {_n('A-Za-z')} OR regexp_matches(regexp_extract(t, '[{T.RTL}A-Za-z]'), '[{T.RTL}]')) THEN 'RightToLeft' ELSE 'LeftToRight' END")
_same("escape_xml", ("qzk", "<&>"), T.escape_xml, "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')")
_same("escape_yaml", ("qz", '"\\'), T.escape_yaml, "replace(replace(t, '\\', '\\\\'), '\"', '\\\"')")
_same("escape_gfm_cell", ("qz", "|\n"), T.escape_gfm_cell, "regexp_replace(replace(replace(replace(t, '|', '\\|'), chr(10), '<br>'), chr(13), ''), '^\\s+|\\s+$', '', 'g')")
_same("nfc_normalize", None, lambda c: T.nfc(F.replace(c, F.lit("é"), F.lit("é"))), "nfc_normalize(replace(t, 'é', 'e' || chr(769)))")

_same("presentation_forms", ("abcdefg", "ﺏﺘﻼﻻﭖﯶﻶ"), T.presentation_forms, f"translate({_nest(T.FORM_PAIRS)}, '{T.FORMS[0]}', '{T.FORMS[1]}')")
_same("lam_alef_repair", ("eatn", "لاأـ"), T.repair_lam_alef, _nest(T.LAM_ALEF))
_same("isolated_letters", ("eat,", "لاأ "), T.join_isolated_letters, f"CASE WHEN contains(t, '  ') THEN array_to_string(list_transform(string_split(t, '  '), lambda w: {_nest(T.LAM_ALEF).replace('(t,', '(w,').replace('t, ', 'w, ')}), ' ') ELSE {_nest(T.LAM_ALEF)} END".replace("(w, 'ل ا'", "(regexp_replace(w, '\\s+', '', 'g'), 'ل ا'", 1))
_same("floating_diacritics", ("aei", "ًَۖ"), T.attach_diacritics, f"regexp_replace(t, ' ({T.ATTACHED})', '\\1', 'g')")
_COMMAS = "regexp_replace(regexp_replace(t, '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g')"
_same("mirror_punctuation", ("abcde", '?;12"'), T.mirror_punctuation, f"replace(regexp_replace(translate({_COMMAS}, '?;,' || chr(1), '؟؛،,'), '\"([^\"]*)\"', '«\\1»', 'g'), '\"', '«')")
_same("citation", None, lambda c: T.citation(F.concat(F.lit(" ( "), c, F.lit(" ) "))), "'[^' || regexp_replace(t, '^\\s+|\\s+$', '', 'g') || ']'")
_same("scholarly_heading", None, lambda c: T.scholarly_heading(c, F.length(c) % 9), "repeat('#', greatest(1, least(6, length(t) % 9))::INT) || ' ' || regexp_replace(t, '^\\s+|\\s+$', '', 'g')")
_same("eval_normalize", None, lambda c: T.eval_normalize(F.concat(F.lit("---\na: b\n---\n# *x* <!-- y -->- "), c), tashkeel=True, lower=True),
      "trim(regexp_replace(lower(replace(replace(translate(nfc_normalize('# *x*  - ' || t), '#*_`|', '     '), '- ', ' '), '---', ' ')), '\\s+', ' ', 'g'))")

LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx, unnest(string_split(text, chr(10))) AS text FROM documents"
KINDS = ("''", "'Page '", "'- '", "'3. '", "'(b) '", "'Figure 2 '", "'Table 1 '", "'• '")
PREFIXED = f"WITH l AS ({LINES}) SELECT doc_id, line_idx, (CASE (doc_id + line_idx) % 8 {' '.join(f'WHEN {i} THEN {k}' for i, k in enumerate(KINDS))} END) || text AS t FROM l"


def _lines(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "text")).withColumn("line_idx", F.col("line_idx").cast("long"))


def _prefixed(spark, sf_dir):
    kinds = " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(KINDS))
    return _lines(spark, sf_dir).select("doc_id", "line_idx", F.expr(f"concat(CASE (doc_id + line_idx) % 8 {kinds} END, text)").alias("t"))


@_query(f"WITH p AS ({PREFIXED}) SELECT doc_id, line_idx, regexp_matches(lower(t), '^(page |p\\. |- )') OR regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '^[0-9]+ (of|/) [0-9]+$') AS hit FROM p")
def page_number_predicate(spark, sf_dir):
    return _prefixed(spark, sf_dir).select("doc_id", "line_idx", T.is_page_number(F.col("t")).alias("hit"))


@_query(f"""WITH p AS ({PREFIXED}) SELECT doc_id, line_idx, CASE WHEN regexp_matches(lower(t), '^(figure|fig\\.|fig|illustration) ') THEN 'Figure' WHEN regexp_matches(lower(t), '^(table|tab\\.|tab) ') THEN 'Table'
 WHEN regexp_matches(lower(t), '^(listing|algorithm|code) ') THEN 'Code' WHEN regexp_matches(lower(t), '^(equation|eq\\.|eq) ') THEN 'Equation' END AS target FROM p""")
def captions(spark, sf_dir):
    return _prefixed(spark, sf_dir).select("doc_id", "line_idx", T.caption_target(F.col("t")).alias("target"))


_MARK = "([0-9]{1,8}|(?:" + "|".join(f"(?i:{r})" for r in sorted(T.ROMAN, key=len, reverse=True)) + ")|[A-Za-z])"


@_query(f"""WITH p AS ({PREFIXED}), s AS (SELECT doc_id, line_idx, regexp_replace(t, '^\\s+', '') AS t FROM p),
 m AS (SELECT doc_id, line_idx, t, regexp_extract(t, '^[•*+▪▫–—◦‣⁃●○-]') AS bullet, regexp_extract(t, '^\\(*\\[*{_MARK}[.)\\]]', 1) AS number FROM s)
 SELECT doc_id, line_idx, CASE WHEN bullet <> '' THEN 'false' WHEN number <> '' THEN 'true' END AS ordered, coalesce(nullif(bullet, ''), nullif(number, '')) AS marker,
 CASE WHEN bullet <> '' THEN regexp_replace(t, '^.\\s*', '') WHEN number <> '' THEN regexp_replace(t, '^\\(*\\[*{_MARK}[.)\\]]\\s*', '') END AS content,
 least((doc_id + line_idx) % 130 // 16, 6)::INT AS level FROM m""")
def list_items(spark, sf_dir):
    """Every line; ordered, marker and content are null where there is no item."""
    i = T.list_item(F.col("t"))
    return _prefixed(spark, sf_dir).select("doc_id", "line_idx", i["ordered"].cast("string").alias("ordered"), i["marker"].alias("marker"), i["content"].alias("content"), T.indent_level((F.col("doc_id") + F.col("line_idx")) % 130).alias("level"))


SPANS = f"""SELECT doc_id, 1 + line_idx // 60 AS page_number, line_idx % 60 AS span_idx, text, 72.0::DOUBLE + 264 * ((line_idx % 60) % 2) AS x,
 64.0::DOUBLE + 16 * ((line_idx % 60) // 2) + 32 * ((line_idx % 60) // 10) AS y, 8.0::DOUBLE * least(length(text), 24) AS w, 12.0::DOUBLE AS h,
 (CASE (line_idx % 60) % 7 WHEN 0 THEN 18 WHEN 1 THEN 14 ELSE 11 END)::DOUBLE AS font_size FROM ({LINES})"""


def spans(spark, sf_dir):
    e = F.expr
    return _lines(spark, sf_dir).select(
        "doc_id", e("1 + line_idx DIV 60").alias("page_number"), e("line_idx % 60").alias("span_idx"), "text", e("cast(72 + 264 * ((line_idx % 60) % 2) AS double)").alias("x"),
        e("cast(64 + 16 * ((line_idx % 60) DIV 2) + 32 * ((line_idx % 60) DIV 10) AS double)").alias("y"), e("8.0D * least(length(text), 24)").alias("w"), F.lit(12.0).alias("h"),
        e("cast(CASE (line_idx % 60) % 7 WHEN 0 THEN 18 WHEN 1 THEN 14 ELSE 11 END AS double)").alias("font_size"))


@_query(f"""WITH s AS ({SPANS}), t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS w_ FROM s)
 SELECT doc_id, page_number, span_idx, (y <= 77 OR y + h >= 715) AND (strlen(w_) < 40 OR regexp_matches(lower(w_), '^(page |p\\. |- )') OR regexp_matches(w_, '^[0-9]{{1,9}}$')) AS margin,
 CASE WHEN y <= 45 THEN 'Header' WHEN y + h >= 747 THEN 'Footer' WHEN (x + w <= 171.36 OR x >= 440.64) AND w < 153 THEN 'Sidebar' ELSE 'Body' END AS region FROM t""")
def regions(spark, sf_dir):
    """Headers and footers with margins of 77 points, which the derived spans reach, and the regions of a page."""
    s = spans(spark, sf_dir)
    margin = layout.header_footer(F.col("y"), F.col("h"), F.col("text"), T.is_page_number(T.strip(F.col("text"))), margin=77.0)
    return s.select("doc_id", "page_number", "span_idx", margin.alias("margin"), layout.region(*map(F.col, "xywh")).alias("region"))


@_query(f"WITH s AS ({SPANS}) SELECT doc_id, page_number, round(font_size * 10)::INT AS size10, sum(strlen(text))::BIGINT AS weight FROM s GROUP BY ALL")
def font_histogram(spark, sf_dir):
    return layout.font_histogram(spans(spark, sf_dir))


@_query(f"""WITH s AS ({SPANS}), f AS (SELECT doc_id, page_number, round(font_size * 10)::INT AS size10, sum(strlen(text)) AS weight FROM s GROUP BY ALL),
 b AS (SELECT doc_id, page_number, size10 AS body10 FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY weight DESC, size10) = 1)
 SELECT doc_id, page_number, body10, coalesce(string_agg(size10::VARCHAR, ',' ORDER BY size10 DESC) FILTER (size10 > 1.08 * body10), '') AS levels FROM f JOIN b USING (doc_id, page_number) GROUP BY ALL""")
def font_levels(spark, sf_dir):
    levels = layout.font_levels(layout.font_histogram(spans(spark, sf_dir)))
    return levels.select("doc_id", "page_number", "body10", F.array_join(F.transform("levels", lambda z: z.cast("string")), ",").alias("levels"))


@_query(f"WITH s AS ({SPANS}), b AS (SELECT doc_id, page_number, unnest(range(floor(x / 2)::INT, ceil((x + w) / 2)::INT)) AS bin FROM s WHERE w > 0) SELECT doc_id, page_number, bin::INT AS bin, count(*) AS n FROM b GROUP BY ALL")
def projection_profile(spark, sf_dir):
    return layout.projection_profile(spans(spark, sf_dir))


@_query(f"""WITH s AS ({SPANS}), m AS (SELECT *, coalesce((y - lag(y + h) OVER o > 17.5)::INT, 0) AS st FROM s WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY y, span_idx)),
 k AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page_number ORDER BY y, span_idx ROWS UNBOUNDED PRECEDING)::INT AS block FROM m)
 SELECT doc_id, page_number, block, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM k GROUP BY doc_id, page_number, block""")
def block_segmentation(spark, sf_dir):
    return layout.blocks(spans(spark, sf_dir))


@_query(f"""WITH s AS ({SPANS}), g AS (SELECT doc_id, page_number, y - lag(y + h) OVER (PARTITION BY doc_id, page_number ORDER BY y, span_idx) AS gap FROM s)
 SELECT doc_id, page_number, count(*) AS n, round(avg(gap), 6) AS mean, round(stddev_pop(gap), 6) AS sd, list_sort(list(gap))[1 + count(*) // 2] AS median FROM g WHERE gap IS NOT NULL GROUP BY doc_id, page_number""")
def line_gap_stats(spark, sf_dir):
    g = layout.gap_stats(spans(spark, sf_dir))
    return g.select("doc_id", "page_number", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "median")


@_query(f"""WITH s AS ({SPANS}), v AS (SELECT doc_id, page_number, list_sort(list(DISTINCT y)) AS ys FROM s GROUP BY ALL),
 c AS (SELECT doc_id, page_number, list_reduce(list_transform(ys, lambda y: [y]), lambda a, b: CASE WHEN abs(b[1] - a[-1]) <= 20 THEN list_append(a[:-2], (a[-1] + b[1]) / 2) ELSE list_append(a, b[1]) END) AS c FROM v)
 SELECT doc_id, page_number, array_to_string(list_transform(c, lambda x: round(x, 4)::DECIMAL(18, 4)::VARCHAR), ',') AS clusters FROM c""")
def coordinate_clusters(spark, sf_dir):
    s = spans(spark, sf_dir).groupBy("doc_id", "page_number").agg(F.collect_set("y").alias("ys"))
    written = F.transform(layout.cluster_coordinates(F.col("ys"), 20.0), lambda x: F.round(x, 4).cast("decimal(18,4)").cast("string"))
    return s.select("doc_id", "page_number", F.array_join(written, ",").alias("clusters"))


@_query(r"""WITH c AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_idx, n_nationkey, n_name FROM nation)
 SELECT r_regionkey AS region, '| key | name |' || chr(10) || '|---:|:---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || CASE WHEN row_idx % 3 = 0 THEN '' ELSE n_name END || ' |', chr(10) ORDER BY row_idx) || chr(10) AS markdown
 FROM c JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def gfm_table(spark, sf_dir):
    """Rows of every third nation lack a cell, of every fourth have one too many."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    body = n.selectExpr("n_regionkey AS region", "row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_idx", "cast(n_nationkey AS string) AS a", "n_name AS b")
    body = body.selectExpr("region", "row_idx", "CASE WHEN row_idx % 3 = 0 THEN array(a) WHEN row_idx % 4 = 0 THEN array(a, b, 'more') ELSE array(a, b) END AS v")
    head = r.selectExpr("r_regionkey AS region", "0 AS row_idx", "array('key', 'name') AS v")
    cells = head.unionByName(body).selectExpr("region", "row_idx", "posexplode(v) AS (col_idx, text)").selectExpr("*", "CASE WHEN row_idx > 0 THEN NULL WHEN col_idx = 0 THEN 'Right' ELSE 'Left' END AS align", "'other' AS t")
    return render.gfm_table(cells, "region")


ASCII = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g')"  # one engine counts bytes, the other characters


@_query(f"""WITH n AS (SELECT greatest(count(*), 1) AS n FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, item_id, {ASCII} AS b FROM benchmark),
 d AS (SELECT doc_id, {ASCII} AS a, doc_id % n AS k FROM documents, n)
 SELECT doc_id, item_id, levenshtein(b, a)::INT AS errors, round(CASE WHEN length(b) > 0 THEN levenshtein(b, a) / length(b)::DOUBLE WHEN length(a) > 0 THEN 1.0 ELSE 0.0 END, 6) AS cer FROM d JOIN b USING (k)""")
def character_error_rate(spark, sf_dir):
    """Whole texts against all of benchmark in turn; letters beyond ASCII count as one sign, so that SQL can check it."""
    plain = lambda name: _t(spark, sf_dir, name).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    return _error_rates(evaluation.with_reference(plain("documents"), plain("benchmark")))


def _error_rates(d):
    d = d.withColumn("errors", evaluation.character_errors(F.col("b"), F.col("a")))
    return d.select("doc_id", "item_id", "errors", F.round(evaluation.error_rate(F.col("errors"), F.length("b"), F.length("a")), 6).alias("cer"))


@_query()
def character_error_rate_whole(spark, sf_dir):
    """The same with all letters as they are; tested against brute force."""
    return _error_rates(evaluation.with_reference(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")))


@_query()
def word_error_edits(spark, sf_dir):
    d = evaluation.with_reference(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
    return d.select("doc_id", evaluation.word_edits("b", "a").alias("e")).select("doc_id", "e.*")


_SCORES = {k: f"(CASE {i % 3} WHEN 0 THEN 1 - toxic * 0.2 WHEN 1 THEN 0.85 + quality * 0.15 ELSE 0.9 + (doc_id % 11) / 100.0 END)" for i, k in enumerate(evaluation.WEIGHTS)}
_COMPOSITE = "round(" + " + ".join(f"{_SCORES[k]}::DOUBLE * {w}" for k, w in evaluation.WEIGHTS.items()) + ", 3)"


@_query(f"SELECT doc_id, quality, toxic, {_COMPOSITE} AS score, {_COMPOSITE} >= {evaluation.GATE_ALL} AND " + " AND ".join(f"{_SCORES[k]}::DOUBLE >= {evaluation.GATE}" for k in evaluation.GATED) + " AS passed FROM labels")
def release_gate(spark, sf_dir):
    d = _t(spark, sf_dir, "labels")
    scores = {k: F.expr(v.replace("0.2", "0.2D").replace("0.85", "0.85D").replace("0.15", "0.15D").replace("0.9 ", "0.9D ").replace("100.0", "100.0D")) for k, v in _SCORES.items()}
    return d.select("doc_id", "quality", "toxic", evaluation.composite(scores).alias("score"), evaluation.release_gate(scores).alias("passed"))


_CELLS = """c AS (SELECT r_regionkey AS region, 0 AS row_idx, 0 AS col_idx, true AS hd, r_name AS x, 2 AS cs, NULL AS al FROM region
 UNION ALL SELECT n_regionkey, n_nationkey + 1, 0, false, n_nationkey::VARCHAR, 1, 'right' FROM nation UNION ALL SELECT n_regionkey, n_nationkey + 1, 1, false, n_name, 1, NULL FROM nation)"""


def _cells(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    left = n.selectExpr("n_regionkey AS region", "n_nationkey + 1 AS row_idx", "0 AS col_idx", "false AS is_header", "cast(n_nationkey AS string) AS text", "1 AS colspan", "1 AS rowspan", "'Right' AS align")
    right = n.selectExpr("n_regionkey AS region", "n_nationkey + 1 AS row_idx", "1 AS col_idx", "false AS is_header", "n_name AS text", "1 AS colspan", "1 AS rowspan", "cast(NULL AS string) AS align")
    head = r.selectExpr("r_regionkey AS region", "0 AS row_idx", "0 AS col_idx", "true AS is_header", "r_name AS text", "2 AS colspan", "1 AS rowspan", "cast(NULL AS string) AS align")
    return head.unionByName(left).unionByName(right)


def _html_sql(table: str, align: str) -> str:
    return f"""WITH {_CELLS}, k AS (SELECT *, '      <' || CASE WHEN hd THEN 'th' ELSE 'td' END || CASE WHEN cs > 1 THEN ' colspan="' || cs || '"' ELSE '' END || {align} || '>' || x || '</' || CASE WHEN hd THEN 'th' ELSE 'td' END || '>' || chr(10) AS cell FROM c),
 l AS (SELECT region, hd, row_idx, '    <tr>' || chr(10) || string_agg(cell, '' ORDER BY col_idx) || '    </tr>' || chr(10) AS line FROM k GROUP BY ALL),
 p AS (SELECT region, hd, string_agg(line, '' ORDER BY row_idx) AS part FROM l GROUP BY ALL)
 SELECT region, '{table}' || chr(10) || string_agg(CASE WHEN hd THEN '  <thead>' || chr(10) || part || '  </thead>' ELSE '  <tbody>' || chr(10) || part || '  </tbody>' END || chr(10), '' ORDER BY hd DESC) || '</table>' || chr(10) AS html FROM p GROUP BY region"""


@_query(_html_sql("<table>", "CASE WHEN al IS NOT NULL THEN ' align=\"' || al || '\"' ELSE '' END"))
def html_table(spark, sf_dir):
    return render.html_table(_cells(spark, sf_dir), "region")


@_query(_html_sql('<table dir="rtl">', "''"))
def rtl_html_table(spark, sf_dir):
    return render.html_table(_cells(spark, sf_dir), "region", rtl=True)


@_query(f"""WITH {_CELLS}, l AS (SELECT region, row_idx, '|' || string_agg(' ' || x || ' |', '' ORDER BY col_idx) || chr(10) || CASE WHEN hd THEN '| ---: |' || chr(10) ELSE '' END AS line FROM c GROUP BY region, row_idx, hd)
 SELECT region, string_agg(line, '' ORDER BY row_idx) AS markdown FROM l GROUP BY region""")
def rtl_table(spark, sf_dir):
    return render.rtl_gfm_table(_cells(spark, sf_dir), "region")


@_query("""SELECT doc_id, '---' || chr(10) || 'title: "' || replace(replace(coalesce(source, ''), '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || CASE WHEN lang IS NOT NULL THEN 'keywords: ["' || lang || '", "x"]' || chr(10) ELSE '' END
 || CASE WHEN doc_id % 5 > 0 THEN 'pages: ' || (doc_id % 5) || chr(10) ELSE '' END || '---' || chr(10) AS front FROM documents""")
def front_matter(spark, sf_dir):
    d, none = _t(spark, sf_dir, "documents"), F.lit(None).cast("string")
    words = F.when(F.col("lang").isNotNull(), F.array("lang", F.lit("x")))
    return d.select("doc_id", render.front_matter(F.coalesce("source", F.lit("")), none, none, words, F.col("doc_id") % 5).alias("front"))


@_query(QUALITY.replace("FROM c)\nSELECT doc_id,", "FROM c), q AS (SELECT doc_id, t, n,").rstrip() + """)
SELECT doc_id, (img OR few OR bad) AS should_ocr, CASE WHEN img THEN 1.0 WHEN few THEN 0.85 WHEN bad THEN 0.9 ELSE 0.0 END::DOUBLE AS necessity, img AS is_image_only, (NOT img AND NOT few AND bad) AS is_font_corrupted,
 CASE WHEN img THEN 0 ELSE n END::BIGINT AS native_chars, CASE WHEN img THEN 0.0 WHEN few THEN 0.3 ELSE quality_score END::DOUBLE AS native_quality
 FROM (SELECT *, doc_id % 7 = 0 AS img, n < 15 AND doc_id % 3 > 0 AS few, is_corrupted OR quality_score < 0.6 AS bad FROM q)""")
def ocr_necessity(spark, sf_dir):
    d = _docs(spark, sf_dir, F.translate("text", "qzk", "�\ue001\x02"))
    c = ocr.necessity(F.col("t"), F.lit(1), (F.col("doc_id") % 3).cast("int"), F.col("doc_id") % 7 == 0)
    c["native_quality"] = F.round(c["native_quality"], 6)
    return d.select("doc_id", *[v.alias(k) for k, v in c.items()])


@_query("""SELECT doc_id, CASE WHEN p THEN 'ocr' ELSE 'native' END AS source, CASE WHEN p THEN c ELSE q END AS confidence FROM
 (SELECT doc_id, q, c, q < 0.85 AND c > q AS p FROM (SELECT doc_id, (doc_id % 8) / 8.0::DOUBLE AS q, (doc_id % 5) / 4.0::DOUBLE AS c FROM documents))""")
def best_stream(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 8 / 8.0).alias("q"), (F.col("doc_id") % 5 / 4.0).alias("c"))
    b = ocr.best_stream(F.col("text"), F.col("q"), F.upper("text"), F.col("c"))
    return d.select("doc_id", b["source"].alias("source"), b["confidence"].alias("confidence"))


def queries():
    from . import catalogue_more  # noqa: F401  registers its queries here

    return dict(_Q)


def oracle_sql():
    from . import catalogue_more  # noqa: F401

    return dict(_SQL)
