"""Further queries and their SQL: Arabic text, reading order, tables, boxes, recognition, drawings, conversion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from .catalogue import FORM_NEST as _PLAIN
from .catalogue import LINES, SPANS, _docs, _lines, _n, _nest, _query, _same, _t, spans
from .functions import arabic as A
from .functions import text as T
from .operators import evaluation, ocr, reading, render, spatial, tables
from .plans.convert import ConvertOptions, convert
from .sources import fonts, pdf

WS = T.SPACE
STRIP = f"regexp_replace(t, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _chain(name, inject, func, steps, columns=None):
    """A query that maps documents.text, with letters put in, by one column function; SQL in steps over t."""
    src = f"translate(text, '{inject[0]}', '{inject[1]}')" if inject else "text"

    def run(spark, sf_dir):
        return _docs(spark, sf_dir, F.translate("text", *inject) if inject else F.col("text")).select("doc_id", func(F.col("t")).alias("result"))

    run.__name__ = name
    ctes = [f"s0 AS (SELECT doc_id, {src} AS t FROM documents)"] + [f"s{i} AS (SELECT doc_id, {sql} AS t FROM s{i - 1})" for i, sql in enumerate(steps, 1)]
    _query(f"WITH {', '.join(ctes)} SELECT doc_id, t AS result FROM s{len(steps)}")(run)


# --- text

SHAPED = ("abcdefghilmnostu", "ﺎﺑةءﻼاﻟﻪﺍﻡاﻠخﻼدﻞ")
_FIRST, _LAST = f"regexp_extract(w, '([{T.RTL}])', 1)", f"regexp_extract(w, '(?s).*([{T.RTL}])', 1)"
_REVERSED = (f"regexp_matches({_FIRST}, '[{A.FINAL}]') AND regexp_matches({_LAST}, '[{A.INITIAL}{A.ALEF_FORMS}]') OR regexp_matches({_LAST}, '[{A.INITIAL}]') AND NOT regexp_matches({_FIRST}, '[{A.INITIAL}]')"
             f" OR length({_PLAIN('w')}) >= 2 AND (starts_with({_PLAIN('w')}, 'ة') OR starts_with({_PLAIN('w')}, 'ء') OR ends_with({_PLAIN('w')}, 'لا') AND NOT starts_with({_PLAIN('w')}, 'ال'))")
BIDI = f"array_to_string(list_transform(string_split(t, ' '), lambda w: CASE WHEN NOT regexp_matches(w, '[{T.RTL}]') THEN w WHEN {_REVERSED} THEN reverse({_PLAIN('w')}) ELSE {_PLAIN('w')} END), ' ')"
UNSHAPE = f"replace(translate({_nest(A.UNSHAPED_PAIRS)}, '{A.UNSHAPED[0]}', '{A.UNSHAPED[1]}'), '{A.TATWEEL}', '')"
SOFT = "replace(t, '­', '')"
LIGATURES = f"regexp_replace(regexp_replace({_nest(T.LIGATURES)}, '{T.WIDE_SPACES}', ' ', 'g'), '{T.DROPPED}', '', 'g')"
NO_CONTROL = r"regexp_replace(t, '[\x{0001}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]', '', 'g')"

_same("contains_rtl", ("qz", "اع"), lambda c: T.contains(c, T.RTL), f"regexp_matches(t, '[{T.RTL}]')")
_same("contains_cjk", ("qk", "漢。"), lambda c: T.contains(c, T.CJK), f"regexp_matches(t, '[{T.CJK}]')")
_same("presentation_positions", ("qkz", "ﺎﺑﺕ"), lambda c: F.concat_ws(",", T.count(c, A.FINAL).cast("string"), T.count(c, A.INITIAL).cast("string")), f"{_n(A.FINAL)} || ',' || {_n(A.INITIAL)}")
_chain("bidi_reorder", SHAPED, A.bidi, [BIDI])
_chain("arabic_unshape", ("abcdefghi", "ﺎﻼﺷﺺﭧﯼـًّ"), A.unshape, [UNSHAPE])
_chain("arabic_unshape_strip", ("abcdefghi", "ﺎﻼﺷﺺﭧﯼـًّ"), lambda c: A.unshape(c, diacritics="strip"), [f"regexp_replace(t, '{T.ATTACHED}+', '', 'g')", UNSHAPE])
_chain("arabic_unshape_shadda", ("abcdefghi", "ﺎﻼﺷﺺﭧﯼـًّ"), lambda c: A.unshape(c, diacritics="shadda"), [f"replace(regexp_replace(replace(t, '{A.SHADDA}', chr(1)), '{T.ATTACHED}+', '', 'g'), chr(1), '{A.SHADDA}')", UNSHAPE])
_chain("normalize_text", ("aeqkzx", "ﺎﺑﬁ­\u0001é"), T.normalize, [SOFT, LIGATURES, BIDI, "nfc_normalize(t)", NO_CONTROL])
_JOINED = f"CASE WHEN contains(t, '  ') THEN array_to_string(list_transform(string_split(t, '  '), lambda w: {_nest(T.LAM_ALEF).replace('(t,', '(w,').replace('t, ', 'w, ')}), ' ') ELSE {_nest(T.LAM_ALEF)} END".replace("(w, 'ل ا'", f"(regexp_replace(w, '[{WS}]+', '', 'g'), 'ل ا'", 1)
_COMMAS = r"regexp_replace(regexp_replace(t, '([0-9]),([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(1) || '\2', 'g')"
MIRROR = f"replace(regexp_replace(translate({_COMMAS}, '?;,' || chr(1), '؟؛،,'), '\"([^\"]*)\"', '«\\1»', 'g'), '\"', '«')"
_chain("arabic_recover", ("abcdefhij,", "ﺎﻼلﺑةءـا­?"), A.recover, [SOFT, _JOINED, f"regexp_replace(t, ' ({T.ATTACHED})', '\\1', 'g')", UNSHAPE, MIRROR, BIDI, "nfc_normalize(t)"])
_chain("arabic_spelling", ("abcdef", "أإآةىئ"), lambda c: A.recover(c, A.ArabicOptions(letters="orthographic", punctuation="preserve")),
       [SOFT, _JOINED, UNSHAPE, "translate(translate(t, 'أإآٱ', 'اااا'), 'ةىئ', 'هيي')", BIDI, "nfc_normalize(t)"])
for _system, _sql in (("eastern", "translate(t, '0123456789.,%', '٠١٢٣٤٥٦٧٨٩٫٬٪')"), ("keep", "t")):
    _same(f"process_numerals_{_system}", ("abc", "059"), lambda c, s=_system: A.numerals(c, s), _sql)

_A, _B = f"regexp_replace(t, '[{WS}]+$', '')", f"regexp_replace(CASE WHEN length(t) % 2 = 0 THEN lower(t) ELSE t END, '^[{WS}]+', '')"
_same("merge_hyphens", None, lambda c: T.merge_hyphenated(F.concat(c, F.lit("- ")), F.when(F.length(c) % 2 == 0, F.lower(c)).otherwise(c)),
      f"CASE WHEN {_B} = '' THEN t || '- ' WHEN regexp_matches({_B}, '^\\p{{Ll}}') THEN t || {_B} ELSE t || '- ' || {_B} END")
_same("join_cjk_lines", ("aek", "漢。ア"), lambda c: T.join_line(c, F.reverse(c)),
      f"CASE WHEN {_A} = '' THEN regexp_replace(reverse(t), '^[{WS}]+', '') WHEN regexp_matches({_A}, '[{T.CJK}]$') AND regexp_matches(regexp_replace(reverse(t), '^[{WS}]+', ''), '^[{T.CJK}]') THEN {_A} || regexp_replace(reverse(t), '^[{WS}]+', '') ELSE {_A} || ' ' || regexp_replace(reverse(t), '^[{WS}]+', '') END")

_TOKEN = A._TOKEN.replace(r"\p{IsAlphabetic}", r"\p{L}").replace("'", "''")
_TOKENS = f"list_transform(regexp_extract_all(t, '{_TOKEN}'), lambda x: CASE WHEN starts_with(x, '[') AND strlen(x) > 10 THEN list_concat(['['], regexp_extract_all(x[2:], '{_TOKEN}')) ELSE [x] END)"
_same("bidi_line", ("aeiq", "ﺎﻼﺑ`"), A.process_line, f"array_to_string(list_transform(flatten({_TOKENS}), lambda x: CASE WHEN regexp_matches(x, '^[{T.RTL}]') THEN {_PLAIN('x')} ELSE x END), '')")
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(x, '(?s){p}') THEN '{k}'" for p, k in A._KINDS) + " ELSE 'PunctuationOrSymbol' END"


@_query(f"WITH d AS (SELECT doc_id, translate(text, 'aeiq', 'ﺎﻼﺑ`') AS t FROM documents), x AS (SELECT doc_id, unnest(flatten({_TOKENS})) AS x FROM d) SELECT doc_id, {_KIND} AS kind, count(*) AS n, sum(length(x))::BIGINT AS chars, count(*) FILTER (regexp_matches(x, '^[{T.RTL}]')) AS rtl FROM x GROUP BY ALL")
def bidi_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir, F.translate("text", "aeiq", "ﺎﻼﺑ`")).select("doc_id", F.explode(A.tokens(F.col("t"))).alias("x")).select("doc_id", "x.*")
    return d.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if("is_rtl").alias("rtl"))


_EXPR = "o_orderkey || '% 1/2/' || o_custkey || ' 10:' || o_orderkey % 60 || ' ' || o_orderkey || ' SAR [' || o_custkey || '] (' || o_orderkey % 10 || ') ص ص 5 ص ' || o_custkey || '٪ x-y 3-4 ص'"


@_query("""SELECT o_orderkey, 'Percentage:' || o_orderkey || '%|Date:1/2/' || o_custkey || '|Time:10:' || o_orderkey % 60 || '|Currency:' || o_orderkey || ' SAR|Citation:[' || o_custkey || ']|FootnoteMarker:(' || o_orderkey % 10
 || ')|PageReference:ص ص|PageReference:ص ' || o_custkey || '٪' AS found FROM orders""")
def expressions(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select("o_orderkey", A.expressions(F.expr(_EXPR)).alias("e"))
    return d.select("o_orderkey", F.array_join(F.transform("e", lambda e: F.concat_ws(" ", F.concat(e["kind"], F.lit(":"), e["value"]), e["unit"])), "|").alias("found"))


_AR = ("'الباب '", "'المبحث '", "'أ- '", "'(٣) '", "'جدول '", "'ص م ن ا'", "''", "'ثانياً: '", "'المقدمة '", "'ل ا '", "'النتائج '", "'ب) '")
_AR_CASE = "CASE (doc_id + line_idx) % 12 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(_AR)) + " END"
AR_LINES = f"WITH l AS ({LINES}) SELECT doc_id, line_idx, ({_AR_CASE}) || text AS t FROM l"


def _ar_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_idx", F.expr(f"concat({_AR_CASE}, text)").alias("t"))


def _starts(prefixes, c="t"):
    return "(" + " OR ".join(f"starts_with({c}, '{p}')" for p in prefixes) + ")"


@_query(f"""WITH l AS ({AR_LINES}), s AS (SELECT doc_id, line_idx, {STRIP} AS t FROM l) SELECT doc_id, line_idx, CASE {' '.join(f'WHEN {_starts(p)} THEN {n}' for p, n, _ in A.HEADINGS)} END::VARCHAR AS level,
 CASE {' '.join(f'WHEN {_starts(p)} THEN {c}::DOUBLE' for p, _, c in A.HEADINGS)} ELSE 0.0 END::DOUBLE AS confidence, CASE {' '.join(f"WHEN {_starts(p)} THEN '{k}'" for k, p in A.CAPTIONS)} END AS caption,
 CASE {' '.join("WHEN " + ' OR '.join(f"contains(lower(t), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in A.SECTIONS)} END AS section, {_starts(A.CLAUSE_STARTS)} AS clause FROM s""")
def arabic_headings(spark, sf_dir):
    level, confidence = A.heading(F.col("t"))
    return _ar_lines(spark, sf_dir).select("doc_id", "line_idx", level.cast("string").alias("level"), F.coalesce(confidence.cast("double"), F.lit(0.0)).alias("confidence"), A.caption_target(F.col("t")).alias("caption"), A.scholarly_section(F.col("t")).alias("section"), A.is_clause_start(T.strip(F.col("t"))).alias("clause"))


_ITEM = f"CASE WHEN regexp_matches(t, '^[{A.ABJAD}][-.)]') THEN t[1] WHEN regexp_matches(t, '^\\(*\\[*\\s*[٠-٩]+\\s*[.)\\]]') THEN regexp_extract(t, '([٠-٩]+)', 1) END"


@_query(f"WITH l AS ({AR_LINES}), s AS (SELECT doc_id, line_idx, regexp_replace(t, '^[{WS}]+', '') AS t FROM l) SELECT doc_id, line_idx, {_ITEM} AS marker, CASE WHEN {_ITEM} IS NOT NULL THEN regexp_replace(t, '^[^-.)\\]]*[-.)\\]]\\s*', '') END AS content FROM s")
def arabic_list_items(spark, sf_dir):
    i = A.list_item(F.col("t"))
    return _ar_lines(spark, sf_dir).select("doc_id", "line_idx", i["marker"].alias("marker"), i["content"].alias("content"))


_WORDS = f"list_filter(string_split_regex(t, '[{WS}]+'), lambda w: w <> '')"


@_query(f"WITH l AS ({AR_LINES.replace('(' + _AR_CASE + ')', '(' + _AR_CASE + ')').replace('|| text', '|| CASE WHEN line_idx % 2 = 0 THEN text ELSE chr(57345) END')}) SELECT doc_id, line_idx, len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^[{T.RTL}]$'))) >= 3 AND len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^[{T.RTL}]$'))) > len({_WORDS}) // 2 AS isolated, contains(t, 'ل ا') AS lam_alef, regexp_matches(t, '[\\x{{E000}}-\\x{{F8FF}}]') AS private_use FROM l")
def corruption(spark, sf_dir):
    line = _lines(spark, sf_dir).withColumn("text", F.when(F.col("line_idx") % 2 == 0, F.col("text")).otherwise("\ue001"))
    d = line.select("doc_id", "line_idx", F.expr(f"concat({_AR_CASE}, text)").alias("t"))
    return d.select("doc_id", "line_idx", A.has_isolated_letters(F.col("t")).alias("isolated"), A.has_broken_lam_alef(F.col("t")).alias("lam_alef"), A.has_private_use(F.col("t")).alias("private_use"))


@_query("SELECT doc_id, coalesce(list_value('SaudiArabia', 'Egypt', 'GeneralArabic', 'Lebanon', 'GeneralArabic')[1 + doc_id % 5], '') AS dialect FROM documents")
def dialects(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", A.dialect(F.expr("CASE doc_id % 5 WHEN 0 THEN 'ar_SA' WHEN 1 THEN 'EG' WHEN 2 THEN 'ar' WHEN 3 THEN 'ar-lb' END")).alias("dialect"))


@_query(f"""WITH c AS (SELECT n_regionkey AS region, string_agg(CASE WHEN n_regionkey % 2 = 0 THEN translate(n_name, 'ABCDEIN', 'ابتثجحخ') ELSE n_name END, '' ORDER BY n_nationkey) AS t FROM nation GROUP BY ALL)
 SELECT region, CASE WHEN {_n(T.RTL)} / length(regexp_replace(t, '[{WS}]+', '', 'g'))::DOUBLE >= 0.40 THEN 'RightToLeft' ELSE 'LeftToRight' END AS direction FROM c""")
def table_direction(spark, sf_dir):
    name = F.when(F.col("n_regionkey") % 2 == 0, F.translate("n_name", "ABCDEIN", "ابتثجحخ")).otherwise(F.col("n_name"))
    return _t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list(name).alias("c")).select("region", A.table_direction(F.col("c")).alias("direction"))


_GLYPH = "substr('بادرزس', 1 + p_partkey % 6, 1)"


@_query(f"SELECT p_partkey, p_size / 50.0::DOUBLE * 6 <= 0.20::DOUBLE * 12 OR regexp_matches({_GLYPH}, '[{A.DUAL_JOINING}]') AND p_size / 50.0::DOUBLE * 6 <= 0.38::DOUBLE * 12 OR p_partkey % 7 = 0 AS joined FROM part".replace("p_partkey % 6", "(p_partkey % 6)::INT"))
def glyph_joins(spark, sf_dir):
    before, after = F.expr("substr('بادرزس', cast(1 + p_partkey % 6 AS int), 1)"), F.when(F.col("p_partkey") % 7 == 0, "ً").otherwise("ب")
    return _t(spark, sf_dir, "part").select("p_partkey", A.joins(before, after, F.col("p_size") / 50.0 * 6, F.lit(12.0)).alias("joined"))


#: Lines of an order with a number of their own, as the table repeats numbers.
_NUMBERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"


@_query(f"""WITH k AS (SELECT l_orderkey, {_NUMBERED} AS i FROM lineitem), s AS (SELECT l_orderkey, i, 500 - 40.0::DOUBLE * i AS x, CASE WHEN i % 3 = 0 THEN 38.0 ELSE 20.0 END::DOUBLE AS w, list_value('بيت', 'دور', 'نار', 'Word')[1 + i % 4] AS t FROM k),
 g AS (SELECT *, lag(x) OVER o AS px, lag(t) OVER o AS pt FROM s WINDOW o AS (PARTITION BY l_orderkey ORDER BY x DESC, i))
 SELECT l_orderkey, string_agg(CASE WHEN pt IS NULL OR px - (x + w) <= 2.4 OR pt = 'بيت' AND px - (x + w) <= 4.56 THEN '' ELSE ' ' END || t, '' ORDER BY x DESC, i) AS text FROM g GROUP BY l_orderkey""")
def rtl_lines(spark, sf_dir):
    e = F.expr
    s = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{_NUMBERED} AS i").select("l_orderkey", F.col("i").alias("span_idx"), e("500 - 40.0D * i").alias("x"), e("CASE WHEN i % 3 = 0 THEN 38.0D ELSE 20.0D END").alias("w"), F.lit(12.0).alias("font_size"),
                                                                                          e("array('بيت', 'دور', 'نار', 'Word')[cast(i % 4 AS int)]").alias("text"))
    return reading.rtl_lines(s, ("l_orderkey",))


# --- pages of derived spans

PAGED = f"SELECT *, (span_idx % 9 = 0) AS bold, (span_idx % 10 >= 8) AS mono, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height FROM ({SPANS})"


def _paged(spark, sf_dir):
    s = spans(spark, sf_dir).withColumnRenamed("doc_id", "uid")
    return s.withColumns({"bold": F.col("span_idx") % 9 == 0, "mono": F.col("span_idx") % 10 >= 8, "italic": F.lit(False), "width": F.lit(612.0), "height": F.lit(792.0)})


def _measured(spark, sf_dir):
    """Derived spans with the numbers of their page; one shuffle gathers the spans of a page."""
    s = _paged(spark, sf_dir)
    fields = [c for c in s.columns if c not in ("uid", "page_number", "width", "height")]
    page = s.groupBy("uid", "page_number", "width", "height").agg(F.array_sort(F.collect_list(F.struct(F.col("span_idx").alias("k"), *fields))).alias("content"))
    page = reading.page_columns(reading.page_sizes(page))
    return page.select("uid", "page_number", "width", F.col("height").alias("height_"), "body10", "levels", "n_columns", F.explode("content").alias("s")).select("uid", "page_number", "width", "height_", "body10", "levels", "n_columns", "s.*").drop("k")


_BINS = "SELECT DISTINCT doc_id, page_number, unnest(range(floor(x / 2)::INT, ceil((x + w) / 2)::INT)) AS bin FROM p WHERE w > 20 AND w < 336.6"
_COLS = f"""p AS ({PAGED}), bins AS ({_BINS}), g AS (SELECT doc_id, page_number, bin - coalesce(lag(bin) OVER (PARTITION BY doc_id, page_number ORDER BY bin), 50) - 1 AS gap FROM bins WHERE bin >= 51 AND bin < 255),
 v AS (SELECT doc_id, page_number, count(*) FILTER (gap >= 6) AS valleys FROM g GROUP BY ALL), nn AS (SELECT doc_id, page_number, count(*) FILTER (w > 20) AS narrow FROM p GROUP BY ALL),
 cols AS (SELECT nn.doc_id, nn.page_number, CASE WHEN narrow < 4 OR valleys IS NULL OR valleys = 0 THEN 1 WHEN valleys = 1 THEN 2 ELSE 3 END AS n_columns FROM nn LEFT JOIN v USING (doc_id, page_number))"""
_ZONED = _COLS + """, z AS (SELECT p.*, n_columns, CASE WHEN n_columns = 1 THEN 1 WHEN n_columns = 2 THEN CASE WHEN x + w / 2 < 306 THEN 1 ELSE 2 END WHEN x + w / 2 < 204 THEN 1 WHEN x + w / 2 < 408 THEN 2 ELSE 3 END AS zone FROM p JOIN cols USING (doc_id, page_number)),
 st AS (SELECT *, coalesce((y - lag(y + h) OVER (PARTITION BY doc_id, page_number, zone ORDER BY y, span_idx) > 17.5)::INT, 0) AS s FROM z),
 bl AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page_number, zone ORDER BY y, span_idx ROWS UNBOUNDED PRECEDING)::INT AS block FROM st)"""


@_query(f"WITH {_COLS} SELECT * FROM cols")
def column_count(spark, sf_dir):
    return _measured(spark, sf_dir).select(F.col("uid").alias("doc_id"), "page_number", "n_columns").distinct()


@_query(f"WITH {_ZONED} SELECT doc_id, page_number, span_idx, zone, block, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY zone, y, span_idx) AS place FROM bl")
def reading_order(spark, sf_dir):
    from pyspark.sql import Window

    s = reading.blocks(reading.zones(_measured(spark, sf_dir)))
    place = F.row_number().over(Window.partitionBy(*reading.KEY).orderBy("zone", "y", "span_idx"))
    return s.select(F.col("uid").alias("doc_id"), "page_number", "span_idx", "zone", "block", place.alias("place"))


_LINED = _ZONED + f""", ln AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_number, zone, block ORDER BY y) - 1 AS line FROM bl),
 sp AS (SELECT *, CASE WHEN lag(text) OVER q IS NULL OR ends_with(lag(text) OVER q, ' ') OR starts_with(text, ' ') THEN text ELSE ' ' || text END AS part FROM ln WINDOW q AS (PARTITION BY doc_id, page_number, zone, block, line ORDER BY x, span_idx)),
 li AS (SELECT doc_id, page_number, zone, block, line, string_agg(part, '' ORDER BY x, span_idx) AS text, regexp_replace(string_agg(text, ' ' ORDER BY x, span_idx), '^[{WS}]+|[{WS}]+$', '', 'g') AS words, min(y) AS y, max(h) AS height, min(x) AS x_start, max(font_size) AS size, bool_or(bold) AS bold, bool_and(mono) AS mono FROM sp GROUP BY ALL)"""


@_query(f"WITH {_LINED} SELECT doc_id, page_number, zone, block, line::INT AS line, text, words, y, height, x_start, size, bold, mono FROM li")
def line_grouping(spark, sf_dir):
    line = reading.lines(reading.blocks(reading.zones(_measured(spark, sf_dir))))
    return line.select(F.col("uid").alias("doc_id"), "page_number", "zone", "block", "line", "text", "words", "y", "height", "x_start", "size", "bold", "mono")


_FONTS = """f AS (SELECT doc_id, page_number, round(font_size * 10)::INT AS z, sum(strlen(text)) AS n FROM p GROUP BY ALL), bd AS (SELECT doc_id, page_number, z AS body FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY n DESC, z) = 1),
 lv AS (SELECT doc_id, page_number, z, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY z DESC) AS level FROM f JOIN bd USING (doc_id, page_number) WHERE z > 1.08 * body)"""
_CAPS = "(strlen(words) > 3 AND NOT regexp_matches(words, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]'))"
_CLAUSE = f"regexp_matches(regexp_replace(regexp_extract(words, '^([^{WS}]*)', 1), '\\.+$', ''), '^\\+?[0-9]{{1,9}}(\\.\\+?[0-9]{{1,9}})+$')"
_HEAD = (f"CASE WHEN words = '' OR strlen(words) > 160 THEN NULL WHEN lv.level IS NOT NULL THEN least(lv.level, 6) WHEN size * 10 / body >= 1.75 THEN 1 WHEN size * 10 / body >= 1.40 THEN 2 WHEN size * 10 / body >= 1.20 THEN 3 WHEN size * 10 / body >= 1.08 AND (bold OR {_CLAUSE}) THEN 4"
         f" WHEN bold AND ({_CLAUSE} OR {_CAPS}) AND strlen(words) < 80 THEN 5 WHEN bold AND strlen(words) < 60 AND NOT ends_with(words, '.') THEN 6 END")


@_query(f"WITH {_LINED}, {_FONTS} SELECT li.doc_id, li.page_number, zone, block, line::INT AS line, ({_HEAD})::VARCHAR AS level FROM li JOIN bd USING (doc_id, page_number) LEFT JOIN lv ON li.doc_id = lv.doc_id AND li.page_number = lv.page_number AND lv.z = round(size * 10)::INT")
def heading_levels(spark, sf_dir):
    line = reading.lines(reading.blocks(reading.zones(_measured(spark, sf_dir))), carry=("body10", "levels"))
    head = reading.heading(F.col("words"), F.col("size"), F.col("bold"), F.transform("levels", lambda z: z / 10), F.col("body10") / 10)
    return line.select(F.col("uid").alias("doc_id"), "page_number", "zone", "block", "line", head["level"].cast("string").alias("level"))


_PARAS = _LINED + """, gp AS (SELECT *, abs(y - lag(y) OVER q) AS gap, (height + lag(height) OVER q) / 2 AS mean FROM li WINDOW q AS (PARTITION BY doc_id, page_number, zone, block ORDER BY line)),
 gs AS (SELECT *, count(gap) OVER b AS n, stddev_pop(gap) OVER b AS sd, list_sort(list(gap) FILTER (gap IS NOT NULL) OVER b) AS gaps FROM gp WINDOW b AS (PARTITION BY doc_id, page_number, zone, block)),
 br AS (SELECT *, CASE WHEN n >= 3 AND sd > 0.5 THEN gap > gaps[1 + n // 2] + greatest(1.2 * sd, mean * 0.2) ELSE gap > mean * 1.2 END AS broken FROM gs)"""


@_query(f"WITH {_PARAS} SELECT doc_id, page_number, zone, block, line::INT AS line, coalesce(broken, false) AS broken FROM br")
def paragraph_breaks(spark, sf_dir):
    """Whether a line's gap ends a paragraph at 1.2 heights, as the derived lines are near each other."""
    from pyspark.sql import Window

    line = reading.lines(reading.blocks(reading.zones(_measured(spark, sf_dir))))
    numbered = reading.paragraphs(line.withColumn("kind", F.lit("Paragraph")), 1.2)
    before = F.lag("node").over(Window.partitionBy(*reading.BLOCK).orderBy("line"))
    return numbered.select(F.col("uid").alias("doc_id"), "page_number", "zone", "block", "line", F.coalesce(F.col("node") > before, F.lit(False)).alias("broken"))


@_query(f"""WITH l AS ({LINES}), t AS (SELECT doc_id, line_idx, (CASE line_idx % 5 WHEN 0 THEN '[' || line_idx || '] ' WHEN 1 THEN line_idx % 1000 || '. ' WHEN 2 THEN '† ' WHEN 3 THEN '' ELSE '12345 ' END) || text AS raw, 500.0::DOUBLE + line_idx % 100 AS top, 9.0::DOUBLE + doc_id % 3 AS size FROM l),
 s AS (SELECT *, regexp_replace(raw, '^[{WS}]+|[{WS}]+$', '', 'g') AS x FROM t),
 m AS (SELECT *, CASE WHEN top < 554.4 OR size > 9.9 THEN NULL WHEN regexp_matches(x, '(?s)^\\[[^\\]]*\\]') THEN 1 WHEN regexp_matches(x, '^\\+?[0-9]{{1,3}}\\.*([{WS}]|$)') AND length(regexp_extract(x, '^(\\+?[0-9]{{1,3}})', 1)) <= 3 THEN 2 WHEN regexp_matches(x, '^[*†‡]') THEN 3 END AS k FROM s)
 SELECT doc_id, line_idx, CASE k WHEN 1 THEN regexp_extract(x, '(?s)^\\[([^\\]]*)\\]', 1) WHEN 2 THEN regexp_extract(x, '^(\\+?[0-9]{{1,3}})', 1) WHEN 3 THEN x[1] END AS id,
 regexp_replace(CASE k WHEN 1 THEN regexp_replace(x, '(?s)^\\[[^\\]]*\\]', '') WHEN 2 THEN regexp_replace(x, '^[^{WS}]+', '') WHEN 3 THEN x[2:] END, '^[{WS}]+', '') AS content FROM m""")
def footnotes(spark, sf_dir):
    raw = F.expr("concat(CASE line_idx % 5 WHEN 0 THEN concat('[', line_idx, '] ') WHEN 1 THEN concat(line_idx % 1000, '. ') WHEN 2 THEN '† ' WHEN 3 THEN '' ELSE '12345 ' END, text)")
    d = _lines(spark, sf_dir).select("doc_id", "line_idx", T.strip(raw).alias("x"), F.expr("500.0D + line_idx % 100").alias("top"), F.expr("9.0D + doc_id % 3").alias("size"))
    note = reading.footnote(F.col("x"), F.col("top"), F.col("size"), F.lit(792.0), F.lit(11.0))
    return d.select("doc_id", "line_idx", note["id"].alias("id"), note["content"].alias("content"))


@_query(f"""WITH p AS ({PAGED}), s AS (SELECT *, 792 - y - h AS u FROM p), e AS (SELECT *, u + h AS top, CASE WHEN u >= 752 THEN 0 WHEN u + h <= 40 THEN 8 WHEN u + h <= 120 AND font_size <= 10 AND regexp_matches(text, '^[(\\[١1]') THEN 7 END AS edge FROM s),
 m AS (SELECT *, top >= greatest(max(top) FILTER (edge IS NULL) OVER g, 0) - 100 AS high FROM e WINDOW g AS (PARTITION BY doc_id, page_number)),
 t AS (SELECT *, coalesce(edge, CASE WHEN high AND (font_size >= 16 OR font_size >= 13 AND bold) THEN 1 WHEN high AND regexp_matches(text, 'المستخلص|ملخص|Abstract') THEN 2 END) AS e2 FROM m),
 c AS (SELECT *, bool_or(e2 IS NULL AND w <= 293.76 AND w >= 50) OVER (PARTITION BY doc_id, page_number) AS several FROM t),
 z AS (SELECT *, coalesce(e2, CASE WHEN NOT several THEN 3 WHEN w < 134.64 AND (x > 477.36 OR x < 134.64) THEN 6 WHEN x + w / 2 > 326 THEN 3 WHEN x + w / 2 < 286 THEN 5 ELSE 4 END) AS zone FROM c)
 SELECT doc_id, page_number, span_idx, zone, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY zone, floor(u / 6 + 0.5) DESC, x DESC, span_idx) - 1 AS place FROM z""")
def rtl_reading_order(spark, sf_dir):
    s = reading.rtl_order(_paged(spark, sf_dir).withColumn("y", 792 - F.col("y") - F.col("h")))
    return s.select(F.col("uid").alias("doc_id"), "page_number", "span_idx", "zone", F.col("place").cast("long").alias("place"))


@_query(f"""WITH l AS ({LINES}), t AS (SELECT doc_id, line_idx, regexp_replace((CASE line_idx % 4 WHEN 0 THEN 'المادة ' WHEN 2 THEN '- ' ELSE '' END) || text, '^[{WS}]+|[{WS}]+$', '', 'g') AS t FROM l),
 b AS (SELECT *, ({_starts(A.CLAUSE_STARTS)} OR coalesce(lag(t) OVER o = '', false))::INT AS s FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY line_idx)), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS k FROM b)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS paragraph, text FROM (SELECT doc_id, k, string_agg(t, ' ' ORDER BY line_idx) AS text FROM g WHERE t <> '' GROUP BY ALL)""")
def paragraph_merge(spark, sf_dir):
    d = _lines(spark, sf_dir).select("doc_id", F.col("line_idx").alias("line"), F.expr("concat(CASE line_idx % 4 WHEN 0 THEN 'المادة ' WHEN 2 THEN '- ' ELSE '' END, text)").alias("text"))
    return reading.merge_lines(d, ("doc_id",))


# --- tables of orders

_CELL4 = ("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
_VALUES = ", ".join(f"cast(cast({c} AS bigint) AS string)" if i < 2 else c for i, c in enumerate(_CELL4))
_ROWS_SQL = f"SELECT l_orderkey, {_NUMBERED} AS r, [l_linenumber::BIGINT::VARCHAR, l_quantity::BIGINT::VARCHAR, l_returnflag, l_linestatus] AS v FROM lineitem"


def _order_pages(spark, sf_dir, ruled: bool):
    """A page for each order, a row of four spans for each of its lines, and the ruling lines of a grid around them."""
    cells = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{_NUMBERED} AS r", f"array({_VALUES}) AS v").selectExpr("l_orderkey", "r", "posexplode(v) AS (c, text)")
    span = F.expr("named_struct('text', text, 'x', 72 + 120.0D * c, 'y', 100 + 20.0D * r, 'w', 60.0D, 'h', 10.0D)")
    pages = cells.groupBy("l_orderkey").agg(F.expr("max(r)").alias("n"), F.array_sort(F.collect_list(F.struct("r", "c", span.alias("s")))).alias("spans")).withColumn("spans", F.col("spans.s"))
    across = "transform(sequence(1, n + 1), i -> named_struct('rect', named_struct('x', 66.0D, 'y', 95 + 20.0D * i, 'w', 480.0D, 'h', 1.0D), 'points', cast(NULL AS array<struct<x: double, y: double>>)))"
    down = "transform(sequence(0, 4), j -> named_struct('rect', cast(NULL AS struct<x: double, y: double, w: double, h: double>), 'points', array(named_struct('x', 66 + 120.0D * j, 'y', 115.0D), named_struct('x', 66 + 120.0D * j, 'y', 115 + 20.0D * n))))"
    return pages.withColumn("paths", F.expr(f"concat({across}, {down})" if ruled else f"slice({down}, 1, 0)"))


def _written(rows):
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: c["text"]), "|")), ";")


_TABLE_SQL = "string_agg(array_to_string(v, '|'), ';' ORDER BY r)"


@_query(f"WITH v AS ({_ROWS_SQL}) SELECT l_orderkey, min_by(array_to_string(v, '|'), r) AS header, coalesce(string_agg(array_to_string(v, '|'), ';' ORDER BY r) FILTER (r > 1), '') AS body, true AS borders, count(*) * 4 AS used FROM v GROUP BY l_orderkey")
def lattice_tables(spark, sf_dir):
    t = tables.page_tables(_order_pages(spark, sf_dir, True), ("l_orderkey",))
    return t.select("l_orderkey", _written(F.col("headers")).alias("header"), _written(F.col("rows")).alias("body"), "borders", F.size("spans").cast("long").alias("used"))


@_query(f"WITH v AS ({_ROWS_SQL}) SELECT l_orderkey, min_by(array_to_string(v, '|'), r) AS header, string_agg(array_to_string(v, '|'), ';' ORDER BY r) FILTER (r > 1) AS body, false AS borders, count(*) * 4 AS used FROM v GROUP BY l_orderkey HAVING count(*) >= 3")
def borderless_tables(spark, sf_dir):
    t = tables.page_tables(_order_pages(spark, sf_dir, False), ("l_orderkey",))
    return t.select("l_orderkey", _written(F.col("headers")).alias("header"), _written(F.col("rows")).alias("body"), "borders", F.size("spans").cast("long").alias("used"))


@_query("SELECT l_orderkey, count(*) * 4 AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) < 3")
def consumed_anti_join(spark, sf_dir):
    """Spans that no table took: those of orders of one or two lines."""
    pages = _order_pages(spark, sf_dir, False)
    rest = tables.without_tables(pages.select("l_orderkey", F.posexplode("spans").alias("span_idx", "s")), tables.page_tables(pages, ("l_orderkey",)), ("l_orderkey",))
    return rest.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH h AS (SELECT l_orderkey AS k, l_linenumber AS c, lower(trim(l_shipmode_)) AS a, lower(trim(l_other_)) AS b FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode_, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus ELSE l_returnflag || l_linestatus || 'x' END AS l_other_ FROM lineitem)),
 s AS (SELECT k, avg((contains(a, b) OR contains(b, a))::INT) AS sim FROM h GROUP BY k) SELECT k AS l_orderkey, round(sim, 6) AS similarity, round((0.60 + CASE WHEN sim >= 0.70 THEN 0.30 * sim ELSE 0 END + 0.10) * 0.885, 6) AS confidence FROM s""")
def header_similarity(spark, sf_dir):
    """Similarity of two header rows of an order's lines, and how sure the two tables belong together."""
    d = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("a"), F.expr("CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus ELSE concat(l_returnflag, l_linestatus, 'x') END").alias("b"))
    g = d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "a", "b"))).alias("h")).select("l_orderkey", F.col("h.a").alias("a"), F.col("h.b").alias("b"))

    def run(batches):
        for b in batches:
            out = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                one, two = (tables.Table([[(t, 1, 1, "left") for t in row]], [], confidence=c, box=(0, 0, w, 1)) for row, c, w in ((x, 0.95, 100.0), (y, 0.82, 120.0)))
                out.append((round(tables.header_similarity(one, two), 6), round(tables.stitch_confidence(one, two), 6)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64())], names=["l_orderkey", "similarity", "confidence"])

    return g.mapInArrow(run, "l_orderkey long, similarity double, confidence double")


# --- boxes of parts

_BOXES = "SELECT p_partkey AS id, p_partkey % 7 AS page, 8.0::DOUBLE * (p_partkey % 64) AS x, 8.0::DOUBLE * (p_partkey // 64) + p_size AS y, 4.0::DOUBLE + p_size % 20 AS w, 6.0::DOUBLE AS h FROM part"


def _boxes(spark, sf_dir):
    return _t(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey % 7 AS page", "8.0D * (p_partkey % 64) AS x", "8.0D * (p_partkey DIV 64) + p_size AS y", "4.0D + p_size % 20 AS w", "6.0D AS h")


_ON = "a.page = b.page"
_MEET = "a.x <= b.x + b.w AND a.x + a.w >= b.x AND a.y <= b.y + b.h AND a.y + a.h >= b.y"
_OVER = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0)"


@_query(f"WITH a AS ({_BOXES}), b AS ({_BOXES}) SELECT a.page, a.id, b.id AS item_id, (b.x >= a.x AND b.x + b.w <= a.x + a.w AND b.y >= a.y AND b.y + b.h <= a.y + a.h) AS inside, round(coalesce({_OVER} * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / nullif(a.w * a.h + b.w * b.h - {_OVER} * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0), 0), 0), 6) AS share FROM a JOIN b ON {_ON} AND {_MEET}")
def spatial_intersect(spark, sf_dir):
    d = _boxes(spark, sf_dir)
    a, b = (spatial.box(p) for p in ("", "item_"))
    return spatial.query_intersecting(d, d, ("page",)).select("page", "id", "item_id", spatial.contains(a, b).alias("inside"), F.round(spatial.overlap_share(a, b), 6).alias("share"))


@_query(f"WITH a AS ({_BOXES}), b AS ({_BOXES}) SELECT a.page, a.id, b.id AS item_id FROM a JOIN b ON {_ON} AND b.x >= a.x AND b.x + b.w <= a.x + a.w AND b.y >= a.y AND b.y + b.h <= a.y + a.h")
def spatial_contained(spark, sf_dir):
    d = _boxes(spark, sf_dir)
    return spatial.query_contained(d, d, ("page",)).select("page", "id", "item_id")


def _nearest(name, gap, func):
    sql = f"WITH a AS ({_BOXES}), b AS ({_BOXES}), p AS (SELECT a.page, a.id, b.id AS item_id, {gap} AS distance FROM a JOIN b ON {_ON} AND {gap} >= 0 AND {gap} <= 40 AND {_OVER} > 0) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY distance, item_id DESC) = 1"

    def run(spark, sf_dir):
        d = _boxes(spark, sf_dir)
        return func(d, d, ("page",), 40.0).select("page", "id", "item_id", "distance")

    run.__name__ = name
    _query(sql)(run)


_nearest("nearest_below", "(b.y - (a.y + a.h))", spatial.nearest_below)
_nearest("nearest_above", "(a.y - (b.y + b.h))", spatial.nearest_above)


@_query(f"WITH q AS (SELECT s_suppkey AS id, s_suppkey % 7 AS page, 7.0::DOUBLE * (s_suppkey % 60) AS x, 30.0::DOUBLE AS y FROM supplier), b AS ({_BOXES}), p AS (SELECT q.page, q.id, b.id AS item_id, sqrt((b.x + b.w / 2 - q.x) ** 2 + (b.y + b.h / 2 - q.y) ** 2) AS d FROM q JOIN b USING (page)) SELECT page, id, item_id, round(d, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY d, item_id) = 1")
def nearest_to_point(spark, sf_dir):
    q = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey % 7 AS page", "7.0D * (s_suppkey % 60) AS x", "30.0D AS y")
    return spatial.nearest_to_point(q, _boxes(spark, sf_dir), ("page",)).select("page", "id", "item_id", F.round("distance", 6).alias("distance"))


@_query("""WITH p AS (SELECT p_partkey, least(1.0, p_size / 40.0::DOUBLE) AS r, 0.5::DOUBLE AS g, (p_partkey % 10) / 9.0::DOUBLE AS b FROM part)
 SELECT p_partkey, '#' || lower(lpad(to_hex(floor(r * 255 + 0.5)::INT), 2, '0')) || '80' || lower(lpad(to_hex(floor(b * 255 + 0.5)::INT), 2, '0')) AS color, 0.299 * r + 0.587 * g + 0.114 * b < 0.5 AS dark FROM p""")
def colors(spark, sf_dir):
    r, g, b = F.col("p_size") / 40.0, F.lit(0.5), F.col("p_partkey") % 10 / 9.0
    return _t(spark, sf_dir, "part").select("p_partkey", spatial.hex_color(r, g, b).alias("color"), spatial.is_dark(F.least(r, F.lit(1.0)), g, b).alias("dark"))


# --- recognition

@_query("""SELECT page_id, strlen(url) < 20 AND (page_id % 5 = 0 OR page_id % 3 > 0) AS auto, false AS never, true AS always FROM pages""")
def ocr_gate(spark, sf_dir):
    gate = lambda mode: ocr.needed(mode, F.octet_length("url"), F.col("page_id") % 3, F.col("page_id") % 5 == 0).alias(mode)
    return _t(spark, sf_dir, "pages").select("page_id", gate("auto"), gate("never"), gate("always"))


_DECIDE = "translate(text, 'qzk', '\ue001�ا')"
_Q = f"""d AS (SELECT doc_id, {_DECIDE} AS t FROM documents), q0 AS (SELECT doc_id, t, length(t)::DOUBLE AS n, {_n(chr(0xFFFD))} AS bad, {_n(chr(0xE000) + '-' + chr(0xF8FF))} AS pua, {_n(T.RTL)} AS arabic, {_n('A-Za-z')} AS latin,
 {_n(chr(92) + 'x{0001}-' + chr(92) + 'x{001F}' + chr(92) + 'x{007F}-' + chr(92) + 'x{009F}')} AS every, {_n(chr(92) + 'n' + chr(92) + 'r' + chr(92) + 't')} AS white FROM d),
 q AS (SELECT *, CASE WHEN NOT regexp_matches(t, '[^{WS}]') THEN 0.0 ELSE greatest(0.0, least(1.0, (n - bad - pua - every) / n - (bad * 0.05::DOUBLE + pua * 0.02::DOUBLE + (every - white) * 0.05::DOUBLE))) END AS quality, CASE doc_id % 9 WHEN 1 THEN 'Nastaliq' END AS script, doc_id % 6 = 0 AS empty FROM q0)"""


@_query(f"""WITH {_Q} SELECT doc_id, CASE WHEN empty OR quality < 0.50 OR pua > 10 OR script IS NOT NULL AND (doc_id % 2 > 0 OR quality < 0.95) THEN 'Require' WHEN quality >= 0.88 AND pua = 0 THEN 'Skip' ELSE 'Fuse' END AS kind,
 CASE WHEN empty OR script IS NOT NULL THEN 300 ELSE 150 END AS dpi, NOT empty AND arabic > 0 AND latin > 0 AND latin / (arabic + latin)::DOUBLE > 0.15 AS is_bilingual, CASE WHEN empty THEN 0 ELSE arabic END::BIGINT AS arabic_chars, round(CASE WHEN empty THEN 0 ELSE quality END, 6) AS quality FROM q""")
def ocr_decision(spark, sf_dir):
    from .catalogue import _COUNTED, _counted

    d = _counted(_docs(spark, sf_dir, F.translate("text", "qzk", "\ue001�ا")))
    script = ocr.script_by_font(F.expr("CASE doc_id % 9 WHEN 1 THEN 'Jameel Noori' END"))
    c = ocr.decision(F.col("t"), F.when(F.col("doc_id") % 6 == 0, 0).otherwise(3), F.col("doc_id") % 2, script, F.lit(0.5), _COUNTED)
    return d.select("doc_id", c["kind"].alias("kind"), c["dpi"].alias("dpi"), c["is_bilingual"].alias("is_bilingual"), c["arabic_chars"].cast("long").alias("arabic_chars"), F.round(c["quality"], 6).alias("quality"))


_FA, _FB = "CASE doc_id % 7 WHEN 1 THEN '' WHEN 2 THEN replace(text, 'e', chr(65533)) WHEN 3 THEN translate(text, 'etaoinshr', repeat(chr(57345), 9)) WHEN 4 THEN text || 'more' ELSE text END", "CASE doc_id % 5 WHEN 1 THEN '' WHEN 2 THEN replace(text, 't', 'x') WHEN 3 THEN text ELSE translate(text, 'abcdi', 'vwxyz') END"
_BROKEN = "[\\x{FFFD}\\x{E000}-\\x{F8FF}]"


@_query(f"""WITH d AS (SELECT doc_id, {_FA} AS a, {_FB} AS b, CASE doc_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.5 ELSE 0.1 END::DOUBLE AS q, CASE doc_id % 4 WHEN 0 THEN 0.9 ELSE 0.4 END::DOUBLE AS c FROM documents),
 k AS (SELECT *, regexp_replace(a, '^[{WS}]+|[{WS}]+$', '', 'g') AS ta, regexp_replace(b, '^[{WS}]+|[{WS}]+$', '', 'g') AS tb, len(regexp_extract_all(a, '{_BROKEN}')) AS br FROM d),
 w AS (SELECT *, CASE WHEN ta = '' AND tb = '' THEN 'empty' WHEN ta = '' THEN 'ocr' WHEN tb = '' THEN 'native' WHEN ta = tb THEN 'identical' WHEN q >= 0.92 AND br = 0 THEN 'native' WHEN (q < 0.20 OR br / greatest(length(a), 1)::DOUBLE > 0.50) AND c >= 0.85 THEN 'ocr' ELSE 'fused' END AS source FROM k),
 f AS (SELECT *, CASE WHEN source = 'fused' THEN list_filter(list_transform(range(1, greatest(length(a), length(b)) + 1), lambda i: CASE WHEN i <= length(a) AND i <= length(b) THEN CASE WHEN a[i] = b[i] THEN 'n' || a[i] WHEN regexp_matches(a[i], '{_BROKEN}') THEN 'o' || b[i] WHEN b[i] = chr(65533) OR q >= c THEN 'n' || a[i] ELSE 'o' || b[i] END
   WHEN i <= length(a) THEN CASE WHEN regexp_matches(a[i], '{_BROKEN}') THEN NULL ELSE 'n' || a[i] END ELSE CASE WHEN b[i] = chr(65533) THEN NULL ELSE 'o' || b[i] END END), lambda x: x IS NOT NULL) END AS s FROM w),
 g AS (SELECT *, len(list_filter(s, lambda x: x[1] = 'n')) AS n, len(list_filter(s, lambda x: x[1] = 'o')) AS o, array_to_string(list_transform(s, lambda x: x[2:]), '') AS merged FROM f)
 SELECT doc_id, source, CASE source WHEN 'empty' THEN '' WHEN 'ocr' THEN b WHEN 'fused' THEN merged ELSE a END AS text, CASE source WHEN 'fused' THEN n WHEN 'native' THEN length(a) WHEN 'identical' THEN length(a) ELSE 0 END::BIGINT AS native_chars,
 CASE source WHEN 'fused' THEN o WHEN 'ocr' THEN length(b) ELSE 0 END::BIGINT AS ocr_chars, round(CASE source WHEN 'empty' THEN 1 WHEN 'ocr' THEN c WHEN 'native' THEN q WHEN 'identical' THEN greatest(q, c)
 ELSE greatest(0, least(1, least((q * n + c * o) / greatest(n + o, 1) + CASE WHEN br > 0 AND NOT regexp_matches(merged, '{_BROKEN}') THEN 0.15 ELSE 0 END, greatest(q, c)))) END, 6) AS confidence FROM g""")
def stream_fusion(spark, sf_dir):
    a = F.expr(_FA.replace("chr(65533)", "'�'").replace("chr(57345)", "'\ue001'"))
    q, c = F.expr("CASE doc_id % 3 WHEN 0 THEN 0.95D WHEN 1 THEN 0.5D ELSE 0.1D END"), F.expr("CASE doc_id % 4 WHEN 0 THEN 0.9D ELSE 0.4D END")
    d = _t(spark, sf_dir, "documents").select("doc_id", a.alias("a"), F.expr(_FB).alias("b"), q.alias("q"), c.alias("c"))
    d = d.select("doc_id", ocr.fuse(F.col("a"), F.col("b"), F.col("q"), F.col("c")).alias("f"))
    return d.select("doc_id", "f.source", "f.text", "f.native_chars", "f.ocr_chars", F.round("f.confidence", 6).alias("confidence"))


_SLANT = f"SELECT l_orderkey, {_NUMBERED} AS i, 100 + 10.0::DOUBLE * l_linenumber AS x, 200 + (l_linenumber * l_quantity) % 9 AS y, 14.0::DOUBLE AS w, 12.0::DOUBLE AS font_size, CASE WHEN l_orderkey % 13 = 0 AND l_linenumber = 2 THEN 'Diwani Letter' ELSE 'Plain' END AS font FROM lineitem"


@_query(f"""WITH s AS ({_SLANT}), p AS (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM s WINDOW o AS (PARTITION BY l_orderkey ORDER BY i)), g AS (SELECT *, greatest(abs(nx - x), 1) AS dx, abs(ny - y) AS dy FROM p),
 m AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (greatest(x, nx) < least(x + w, nx + w) AND dy > 1.5 AND dy < 24) AS o, count(*) FILTER (dy / dx BETWEEN 0.10 AND 2.5 AND dy >= 1.5) AS d, coalesce(avg(dy / dx) FILTER (dy / dx BETWEEN 0.10 AND 2.5 AND dy >= 1.5), 0) AS ms, stddev_pop(y) AS sd, bool_or(font = 'Diwani Letter') AS named FROM g GROUP BY ALL),
 c AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE o / (n - 1)::DOUBLE END AS od, CASE WHEN n < 3 THEN 0 ELSE d / (n - 1)::DOUBLE END AS sr, CASE WHEN n < 3 THEN 0 ELSE sd END AS dv FROM m), k AS (SELECT *, least(least(od / 0.25, 1) * 0.40 + least(sr / 0.30, 1) * 0.45 + least(dv / 4, 1) * 0.15, 1) AS conf FROM c)
 SELECT l_orderkey, CASE WHEN named THEN 'Diwani' WHEN conf >= 0.75 AND sr >= 0.35 THEN 'Nastaliq' WHEN conf >= 0.75 THEN 'GenericCalligraphic' END AS script, round(CASE WHEN named THEN 0.95 WHEN conf >= 0.75 THEN conf ELSE 1 - conf END, 6) AS confidence, CASE WHEN named OR conf >= 0.75 THEN 300 ELSE 150 END AS dpi FROM k""")
def calligraphy(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{_NUMBERED} AS span_idx", "100 + 10.0D * l_linenumber AS x", "200 + (l_linenumber * l_quantity) % 9 AS y", "14.0D AS w", "12.0D AS font_size", "CASE WHEN l_orderkey % 13 = 0 AND l_linenumber = 2 THEN 'Diwani Letter' ELSE 'Plain' END AS font")
    return ocr.calligraphy(s, ("l_orderkey",)).select("l_orderkey", "script", F.round("confidence", 6).alias("confidence"), "dpi")


# --- nodes, drawings, reports

_NODE = "CASE doc_id % 9 WHEN 0 THEN 'Heading' WHEN 1 THEN 'Paragraph' WHEN 2 THEN 'CodeBlock' WHEN 3 THEN 'BlockQuote' WHEN 4 THEN 'List' WHEN 5 THEN 'Caption' WHEN 6 THEN 'Footnote' WHEN 7 THEN 'Formula' ELSE 'Unknown' END"
_NL = "chr(10)"


@_query(f"""WITH d AS (SELECT doc_id, {_NODE} AS k, text AS t FROM documents) SELECT doc_id, CASE k WHEN 'Heading' THEN repeat('#', (1 + doc_id % 6)::INT) || ' **' || t || '***x*`y`' || {_NL} || {_NL} WHEN 'Paragraph' THEN t || {_NL} || {_NL}
 WHEN 'CodeBlock' THEN '```' || {_NL} || regexp_replace(t, '\\s+$', '') || {_NL} || '```' || {_NL} || {_NL} WHEN 'BlockQuote' THEN '> ' || replace(t || {_NL}, {_NL}, {_NL} || '> ') || {_NL} || {_NL}
 WHEN 'List' THEN array_to_string(list_transform(string_split(t, {_NL}), lambda x, i: CASE WHEN doc_id % 2 = 0 THEN i || '. ' ELSE '- ' END || x || {_NL}), '') || {_NL} WHEN 'Caption' THEN '*' || t || '*' || {_NL} || {_NL} WHEN 'Footnote' THEN '[^' || doc_id || ']: ' || t || {_NL} || {_NL}
 WHEN 'Formula' THEN CASE WHEN doc_id % 2 = 0 THEN '$' || t || '$' || {_NL} || {_NL} ELSE '$$' || {_NL} || {STRIP} || {_NL} || '$$' || {_NL} || {_NL} END ELSE CASE WHEN t = '' THEN '' ELSE t || {_NL} || {_NL} END END AS markdown FROM d""")
def markdown_nodes(spark, sf_dir):
    runs = F.expr("array(named_struct('text', text, 'bold', true, 'italic', false, 'mono', false), named_struct('text', 'x', 'bold', false, 'italic', true, 'mono', false), named_struct('text', 'y', 'bold', false, 'italic', false, 'mono', true))")
    items = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text")))
    written = F.array_join(F.transform(runs, render.inline), "")
    md = render.node(F.expr(_NODE), F.col("text"), (1 + F.col("doc_id") % 6).cast("int"), items, F.col("doc_id") % 2 == 0, written, F.col("doc_id").cast("string"))
    return _t(spark, sf_dir, "documents").select("doc_id", md.alias("markdown"))


@_query("""SELECT p_partkey, '  <rect x="' || printf('%.2f', p_size - 5.0::DOUBLE) || '" y="' || printf('%.2f', greatest(p_partkey % 50 - 10.0::DOUBLE, 0)) || '" width="' || printf('%.2f', p_size * 1.0::DOUBLE) || '" height="8.00" stroke="' || CASE WHEN p_partkey % 2 = 0 THEN '#102030' ELSE 'none' END
 || '" stroke-width="' || CASE WHEN p_partkey % 2 = 0 THEN '0.50' ELSE '0.00' END || '" fill="' || CASE WHEN p_partkey % 3 = 0 THEN '#aabbcc' ELSE 'none' END || '" />' || chr(10) || '  <path d="M ' || printf('%.2f', p_size - 5.0::DOUBLE) || ' -10.00 L 5.00 ' || printf('%.2f', p_partkey % 50 - 10.0::DOUBLE)
 || ' Z" stroke="#102030" stroke-width="2.00" fill="none" />' || chr(10) AS svg FROM part WHERE p_size >= 5""")
def svg_shapes(spark, sf_dir):
    e = F.expr
    line = e("named_struct('rect', cast(NULL AS struct<x: double, y: double, w: double, h: double>), 'commands', array(named_struct('op', 'm', 'v', array(double(p_size), 0D)), named_struct('op', 'l', 'v', array(10D, double(p_partkey % 50))), named_struct('op', 'h', 'v', cast(array() AS array<double>))), 'stroke', true, 'fill', false, 'stroke_width', 2D, 'color', '#102030', 'fill_color', cast(NULL AS string))")
    rect = e("named_struct('rect', named_struct('x', double(p_size), 'y', double(p_partkey % 50), 'w', double(p_size), 'h', 8D), 'commands', cast(array() AS array<struct<op: string, v: array<double>>>), 'stroke', p_partkey % 2 = 0, 'fill', p_partkey % 3 = 0, 'stroke_width', 0.1D, 'color', '#102030', 'fill_color', '#aabbcc')")
    d = _t(spark, sf_dir, "part").where("p_size >= 5").select("p_partkey", rect.alias("r"), line.alias("l"))
    return d.select("p_partkey", F.concat(render.svg_path(F.col("r"), F.lit(5.0), F.lit(10.0)), render.svg_path(F.col("l"), F.lit(5.0), F.lit(10.0))).alias("svg"))


@_query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' || page_id || '.png' WHEN 1 THEN 'b' || page_id || '.jpg' WHEN 2 THEN 'cd.webp' ELSE 'x.bin' END AS name, strlen(url) BETWEEN 32 AND 10000 AND page_id BETWEEN 32 AND 10000 AS picture FROM pages")
def image_assets(spark, sf_dir):
    name = F.expr("CASE page_id % 4 WHEN 0 THEN concat('a', page_id) WHEN 1 THEN concat('/b\\\\', page_id) WHEN 2 THEN 'c/d' ELSE 'x' END")
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' ELSE 'exe' END")
    return _t(spark, sf_dir, "pages").select("page_id", render.asset_name(name, kind).alias("name"), render.is_picture(F.octet_length("url"), F.col("page_id")).alias("picture"))


_SCORED = "SELECT 'file' || item_id AS filename, (item_id % 13) / 100.0::DOUBLE AS cer, (item_id % 7) / 50.0::DOUBLE AS wer, strlen(text)::INT AS chars, item_id % 3 AS s, item_id % 4 AS d, item_id % 5 AS i, (item_id % 13) / 100.0::DOUBLE <= 0.05 AS passed FROM benchmark"


@_query(f"""WITH s AS ({_SCORED}) SELECT '### 📊 Automated Evaluation Report (CER / WER)' || chr(10) || chr(10) || '| Fixture Document | CER (%) | WER (%) | Ref Chars | Errors (S/D/I) | Status |' || chr(10) || '| :--- | :---: | :---: | :---: | :---: | :---: |' || chr(10)
 || string_agg('| `' || filename || '` | **' || printf('%.2f', cer * 100) || '%** | **' || printf('%.2f', wer * 100) || '%** | ' || chars || ' | ' || s || '/' || d || '/' || i || ' | ' || CASE WHEN passed THEN '✅ PASS' ELSE '❌ FAIL' END || ' |' || chr(10), '' ORDER BY filename)
 || chr(10) || '**Summary**: Average CER: **' || printf('%.2f', avg(cer) * 100) || '%** | Average WER: **' || printf('%.2f', avg(wer) * 100) || '%** | Fixtures Passed: **' || count(*) FILTER (passed) || '/' || count(*) || '**' || chr(10) AS markdown FROM s""")
def evaluation_report(spark, sf_dir):
    return render.report(_scored(spark, sf_dir))


def _scored(spark, sf_dir):
    e = F.expr
    return _t(spark, sf_dir, "benchmark").select(e("concat('file', item_id)").alias("filename"), e("item_id % 13 / 100.0D").alias("cer"), e("item_id % 7 / 50.0D").alias("wer"), F.octet_length("text").alias("reference_chars"),
                                                 e("item_id % 3").alias("substitutions"), e("item_id % 4").alias("deletions"), e("item_id % 5").alias("insertions"), e("item_id % 13 / 100.0D <= 0.05").alias("passed"))


@_query(f"WITH s AS ({_SCORED}) SELECT count(*) AS files, round(avg(cer), 9) AS mean_cer, round(avg(wer), 9) AS mean_wer, count(*) FILTER (passed) AS passed, bool_and(passed) AS all_passed FROM s")
def corpus_report(spark, sf_dir):
    r = evaluation.corpus_report(_scored(spark, sf_dir))
    return r.withColumns({c: F.round(c, 9) for c in ("mean_cer", "mean_wer")})


@_query("SELECT p_partkey, least(round(CASE WHEN p_size > 5 THEN least(p_size / 50.0::DOUBLE * 20, 20) ELSE 5 END + least(p_partkey % 9 * 5, 25) + 10 + least((p_partkey % 101) / 100.0::DOUBLE * 25, 25) + least((p_partkey % 20) * 2.0::DOUBLE, 20)), 100) AS score FROM part")
def complexity(spark, sf_dir):
    k = F.col("p_partkey")
    fonts_ = F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(0)
    return _t(spark, sf_dir, "part").select("p_partkey", evaluation.complexity(fonts_, F.lit(50), k % 9, k % 101, k % 20).alias("score"))


@_query("SELECT p_partkey, p_partkey % 4 = 1 AS bold, p_partkey % 4 = 2 AS italic, p_partkey % 4 = 3 AS mono FROM part")
def font_styles(spark, sf_dir):
    """Style flags of font names, by the parser's font class."""
    names = F.expr("element_at(array('Helvetica', 'ArialMT-Bold', 'Times-Oblique', 'CourierNew'), cast(1 + p_partkey % 4 AS int))")

    def run(batches):
        for b in batches:
            found = [fonts.Font("F1", n) for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([getattr(f, k) for f in found], pa.bool_()) for k in ("bold", "italic", "mono"))], names=["p_partkey", "bold", "italic", "mono"])

    return _t(spark, sf_dir, "part").select("p_partkey", names.alias("n")).mapInArrow(run, "p_partkey long, bold boolean, italic boolean, mono boolean")


# --- conversion

#: The lines of synthesised files: 90 characters at most, 45 a page.
_PIECES = f"""l AS ({LINES}), c AS (SELECT doc_id, line_idx, text, unnest(range(0, greatest(1, ceil(length(text) / 90.0)::INT))) AS k FROM l),
 n AS (SELECT doc_id, text[k * 90 + 1 : k * 90 + 90] AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, k) - 1 AS i FROM c)"""


@_query(f"""WITH {_PIECES}, s AS (SELECT doc_id, 1 + i // 45 AS page_number, row_number() OVER (PARTITION BY doc_id, i // 45 ORDER BY i) - 1 AS span_idx, t, i % 45 AS k, i = 0 AS big FROM n WHERE t <> ''),
 p AS (SELECT DISTINCT doc_id, 1 + i // 45 AS page_number FROM n)
 SELECT p.doc_id, p.page_number::INT AS page_number, coalesce(span_idx, -1)::INT AS span_idx, coalesce(t, '') AS text, CASE WHEN t IS NULL THEN 0 ELSE 72 END::DOUBLE AS x, round(coalesce(CASE WHEN big THEN 54.0 ELSE 60.0 + 15 * k END, 0)::DOUBLE, 6) AS y,
 round(coalesce(length(t) * CASE WHEN big THEN 18 ELSE 12 END * 0.55::DOUBLE, 0), 6) AS w, CASE WHEN t IS NULL THEN 0 WHEN big THEN 18 ELSE 12 END::DOUBLE AS font_size FROM p LEFT JOIN s USING (doc_id, page_number)""")
def parse_spans(spark, sf_dir):
    """Spans of files made of documents, at the places where they were written; a page without text has a row."""
    s = pdf.read_spans(pdf.synthesize(_t(spark, sf_dir, "documents")))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0)).alias(c)
    return s.select("doc_id", "page_number", F.coalesce("span_idx", F.lit(-1)).alias("span_idx"), F.coalesce("text", F.lit("")).alias("text"), *map(zero, ("x", "y", "w", "font_size")))


@_query(f"WITH {_PIECES} SELECT doc_id, (1 + max(i) // 45)::INT AS total_pages, (1 + max(i) // 45)::BIGINT AS text_pages, 0::BIGINT AS ocr_pages, 0::BIGINT AS tables_detected, sum(strlen(t))::BIGINT AS glyph_count, true AS written FROM n GROUP BY doc_id")
def convert_diagnostics(spark, sf_dir):
    c = convert(pdf.synthesize(_t(spark, sf_dir, "documents")))
    return c.select("doc_id", "total_pages", *[F.col("diagnostics." + k).cast("long").alias(k) for k in ("text_pages", "ocr_pages", "tables_detected", "glyph_count")], (F.col("markdown").isNotNull() & F.col("error").isNull()).alias("written"))


#: Files of one line a block: each line, 40 characters at most, stands 50 points below the one before, 12 a page; the first is large.
_SPACED = f"""l AS ({LINES}), c AS (SELECT doc_id, line_idx, text, unnest(range(0, greatest(1, ceil(length(text) / 40.0)::INT))) AS k FROM l),
 n AS (SELECT doc_id, text[k * 40 + 1 : k * 40 + 40] AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, k) - 1 AS i FROM c)"""
_LI = "^\\(*\\[*([0-9]{1,8}|(?i:viii|iii|vii|xii|ii|iv|vi|ix|xi|i|v|x)|[A-Za-z])[.)\\]]"
_CAPTION = "^(figure|fig\\.|fig|illustration|table|tab\\.|tab|listing|algorithm|code|equation|eq\\.|eq) "


@_query(f"""WITH {_SPACED}, s AS (SELECT *, regexp_replace(t, '^[{WS}]+|[{WS}]+$', '', 'g') AS w, regexp_replace(t, '^[{WS}]+', '') AS r, count(*) FILTER (t <> '') OVER g AS full_, sum(strlen(t)) FILTER (i % 12 > 0) OVER g AS small, sum(strlen(t)) FILTER (i % 12 = 0) OVER g AS big FROM n WINDOW g AS (PARTITION BY doc_id, i // 12)),
 m AS (SELECT doc_id, i // 12 AS page, i, CASE WHEN t = '' THEN '' WHEN regexp_matches(lower(w), '{_CAPTION}') THEN '*' || w || '*' || chr(10) || chr(10) WHEN regexp_matches(r, '^[•*+▪▫–—◦‣⁃●○-]') THEN '- ' || regexp_replace(r, '^.[{WS}]*', '') || chr(10) || chr(10)
   WHEN regexp_matches(r, '{_LI}') THEN '1. ' || regexp_replace(r, '{_LI}[{WS}]*', '') || chr(10) || chr(10) WHEN i % 12 = 0 AND w <> '' AND coalesce(small, 0) >= coalesce(big, 0) THEN '# ' || t || chr(10) || chr(10) ELSE t || chr(10) || chr(10) END AS md FROM s),
 p AS (SELECT doc_id, page, string_agg(md, '' ORDER BY i) AS md FROM m GROUP BY ALL)
 SELECT doc_id, (1 + max(page))::INT AS total_pages, string_agg(CASE WHEN page > 0 THEN chr(10) || '<!-- pagebreak: page ' || page + 1 || ' -->' || chr(10) || chr(10) ELSE '' END || md, '' ORDER BY page) AS markdown FROM p GROUP BY doc_id""")
def convert_spaced(spark, sf_dir):
    """The whole chain on files in which every line is a block of its own, so that SQL can say what it must write."""

    def write(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                lines = [x[i : i + 40] for x in (t or "").split("\n") for i in range(0, max(1, len(x)), 40)]
                out.append(pdf.write_pdf([[(72, 680 - 50 * k, 18 if k == 0 else 12, x) for k, x in enumerate(lines[at : at + 12])] for at in range(0, max(1, len(lines)), 12)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    files = _t(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(write, "doc_id long, content binary")
    return convert(files, ConvertOptions(front_matter=False)).select("doc_id", "total_pages", "markdown")


@_query("SELECT region, 2::BIGINT AS page_count, 1::BIGINT AS scanned_pages, 1::BIGINT AS digital_pages, 1::BIGINT AS total_images, true AS requires_ocr FROM (SELECT r_regionkey AS region FROM region)")
def capability_summary(spark, sf_dir):
    """Files of a page of text and a page with a picture alone."""
    image = b"<< /Subtype /Image /Width 64 /Height 64 /Filter /DCTDecode >>\nstream\nabc\nendstream"

    def write(batches):
        for b in batches:
            out = [pdf.write_pdf([[(72, 700, 12, f"Region {n} has a page of text")]])[: -len(b"trailer << /Root 1 0 R >>\n%%EOF")] + b"8 0 obj\n<< /Type /Page /MediaBox [0 0 612 792] /Resources << /XObject << /Im1 9 0 R >> >> >>\nendobj\n9 0 obj\n" + image + b"\nendobj\n" for n in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    files = _t(spark, sf_dir, "region").selectExpr("cast(r_regionkey AS bigint) AS doc_id").mapInArrow(write, "doc_id long, content binary")
    return pdf.capabilities(pdf.read_pages(files)).select(F.col("doc_id").alias("region"), "page_count", "scanned_pages", "digital_pages", F.col("total_images").cast("long").alias("total_images"), "requires_ocr")
