"""Column functions over Arabic and mixed text: reversed words, shaped letters, the recovery chain, tokens, expressions,
headings, list items, captions, scholarly sections, corruption. JVM-side but for NFC. Null in, null out, unless stated."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Shaped letters that stand last or first in a word, further shaped letters and ligatures, joining letters,
# prefixes, unit names and section words. They decide results and are stated as they are.
FINAL_FORMS = (0xFE8E, 0xFE90, 0xFE94, 0xFE96, 0xFE9A, 0xFE9E, 0xFEA2, 0xFEA6, 0xFEAA, 0xFEAC, 0xFEAE, 0xFEB0, 0xFEB2, 0xFEB6, 0xFEBA,
               0xFEBE, 0xFEC2, 0xFEC6, 0xFECA, 0xFECE, 0xFED2, 0xFED6, 0xFEDA, 0xFEDE, 0xFEE2, 0xFEE6, 0xFEEA, 0xFEEE, 0xFEF0, 0xFEF2)
INITIAL_FORMS = (0xFE8B, 0xFE91, 0xFE97, 0xFE9B, 0xFE9F, 0xFEA3, 0xFEA7, 0xFEB3, 0xFEB7, 0xFEBB, 0xFEBF, 0xFEC3, 0xFEC7, 0xFECB, 0xFECF,
                 0xFED3, 0xFED7, 0xFEDB, 0xFEDF, 0xFEE3, 0xFEE7, 0xFEEB, 0xFEF3)
EXTENDED_FORMS = ((0xFB56, 0xFB59, "پ"), (0xFB66, 0xFB69, "ٹ"), (0xFB7A, 0xFB7D, "چ"), (0xFB88, 0xFB89, "ڈ"), (0xFB8A, 0xFB8B, "ژ"), (0xFB8C, 0xFB8D, "ڑ"),
                  (0xFB8E, 0xFB91, "ک"), (0xFB92, 0xFB95, "گ"), (0xFBA6, 0xFBA9, "ں"), (0xFBAA, 0xFBAD, "ہ"), (0xFBAE, 0xFBAF, "ے"), (0xFBF6, 0xFBF8, "ی"),
                  (0xFB62, 0xFB65, "ټ"), (0xFB6E, 0xFB71, "ځ"), (0xFB76, 0xFB79, "څ"), (0xFB84, 0xFB85, "ډ"), (0xFB9A, 0xFB9D, "ګ"), (0xFBE4, 0xFBE7, "ې"),
                  (0xFBFC, 0xFBFF, "ۍ"), (0xFB52, 0xFB55, "ٻ"), (0xFB5A, 0xFB5D, "ڀ"), (0xFB5E, 0xFB61, "ٽ"), (0xFB72, 0xFB75, "ڄ"), (0xFB7E, 0xFB81, "ڇ"),
                  (0xFB96, 0xFB99, "ڦ"), (0xFB9E, 0xFBA1, "ڪ"), (0xFBA2, 0xFBA3, "ڳ"))
HONORIFICS = (("ﷺ", "صلى الله عليه وسلم"), ("ﷻ", "جل جلاله"), ("﷼", "ريال"), ("﷽", "بسم الله الرحمن الرحيم"))
TATWEEL, SHADDA = "ـ", "ّ"
DUAL_JOINING = "بتثجحخسشصضطظعغفقكلمنهيئـپچگکٹںےہڵۆێټځڅښګڼېۍٻٿڀٽڄڃڇڪڳڱڦڻ"
RIGHT_JOINING = "اأإآٱدذرزوؤةىءژڈڑڕډړږۀڌڍڊڙڏ"
HEADINGS = ((("الباب ", "الكتاب "), 1, 0.96), (("الفصل ", "المحور "), 2, 0.95), (("المبحث ", "المادة ", "مادة "), 3, 0.94), (("المطلب ", "الفرع ", "أولاً:", "ثانياً:"), 4, 0.92))
CAPTIONS = (("Figure", ("شكل ", "الشكل ", "صورة ")), ("Table", ("جدول ", "الجدول ")), ("Code", ("مخطط ", "كود ", "خوارزمية ")), ("Equation", ("معادلة ", "المعادلة ")))
ABJAD = "أبجدهوزحطيكلمنسعفصقرشتثخذضظغ"
CLAUSE_STARTS = ("المادة ", "الفصل ", "الباب ", "أولاً:", "ثانياً:", "•", "-", "1.", "١.")
CURRENCIES = ("ر.س", "SAR", "ج.م", "د.إ", "د.ك", "$", "€", "ريال", "جنيه", "درهم")
PAGE_MARKS = ("ص.", "ص")
SECTIONS = (("Abstract", ("المستخلص", "ملخص", "خلاصة", "abstract")), ("Introduction", ("المقدمة", "مقدمة", "توطئة", "تمهيد", "مدخل", "introduction")),
            ("Methodology", ("المنهجية", "منهج البحث", "طريقة البحث", "إجراءات الدراسة", "المواد والطرائق", "methodology")),
            ("Results", ("النتائج", "معطيات الدراسة", "findings", "results")), ("Discussion", ("المناقشة", "مناقشة النتائج", "تحليل النتائج", "discussion")),
            ("Conclusion", ("الخاتمة", "الاستنتاج", "خاتمة البحث", "التوصيات", "conclusion")),
            ("References", ("المراجع", "المصادر", "قائمة المراجع", "ثبت المراجع", "references")), ("Footnotes", ("الهوامش", "الحواشي", "شروح وتوضيحات", "footnotes")))
DIALECTS = {"sa": "SaudiArabia", "eg": "Egypt", "iq": "Iraq", "ae": "UAE", "ma": "Morocco", "dz": "Algeria", "tn": "Tunisia", "jo": "Jordan", "sy": "Syria", "lb": "Lebanon"}

FINAL, INITIAL = "".join(map(chr, FINAL_FORMS)), "".join(map(chr, INITIAL_FORMS))
ALEF_FORMS = "ﺍﺎ"
#: Shaped letters of FE80-FEFC by compatibility decomposition, and the extended ones.
_UNSHAPED = {chr(x): unicodedata.normalize("NFKC", chr(x)) for x in range(0xFE80, 0xFEFD)} | {chr(x): to for a, b, to in EXTENDED_FORMS for x in range(a, b + 1)}
UNSHAPED = ("".join(a for a, b in _UNSHAPED.items() if len(b) == 1), "".join(b for b in _UNSHAPED.values() if len(b) == 1))
UNSHAPED_PAIRS = tuple((a, b) for a, b in _UNSHAPED.items() if len(b) > 1) + HONORIFICS


def starts(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def holds(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def is_visually_reversed(token: Column, plain: Column) -> Column:
    """A word without spaces whose letters stand in visual order. plain: the word in plain letters."""
    first = F.regexp_extract(token, f"([{T.RTL}])", 1)
    last = F.regexp_extract(token, f"(?s).*([{T.RTL}])", 1)
    shaped = token.rlike(f"[{FINAL}{INITIAL}]")  # without such a letter the order of forms says nothing
    by_form = shaped & (first.rlike(f"[{FINAL}]") & last.rlike(f"[{INITIAL}{ALEF_FORMS}]") | last.rlike(f"[{INITIAL}]") & ~first.rlike(f"[{INITIAL}]"))
    by_letter = (F.length(plain) >= 2) & (starts(plain, "ةء") | F.endswith(plain, F.lit("لا")) & ~F.startswith(plain, F.lit("ال")))
    return by_form | by_letter


def bidi(c: Column) -> Column:
    """Words in visual order are turned round, shaped letters become plain ones; words without right-to-left letters stay."""
    def word(t, plain):
        return F.when(t.rlike(f"[{T.RTL}]"), F.when(is_visually_reversed(t, plain), F.reverse(plain)).otherwise(plain)).otherwise(t)

    # letters become plain in the whole text at once: that moves no space, so its words stand beside the ones they come from
    return F.when(c.rlike(f"[{T.RTL}]"), F.array_join(F.zip_with(F.split(c, " "), F.split(T.presentation_forms(c), " "), word), " ")).otherwise(c)


def unshape(c: Column, shaping: str = "unshape", diacritics: str = "preserve") -> Column:
    """Plain letters for shaped ones and ligatures, no elongation. shaping: unshape or preserve (no change at all).
    diacritics: preserve, shadda (that one alone stays), strip or quranic (all stay)."""
    if shaping == "preserve":
        return c
    if diacritics == "strip":
        c = F.regexp_replace(c, T.ATTACHED + "+", "")
    elif diacritics == "shadda":
        c = F.regexp_replace(c, f"[{T.ATTACHED[1:-1]}&&[^{SHADDA}]]+", "")
    for a, b in UNSHAPED_PAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(F.translate(c, *UNSHAPED), F.lit(TATWEEL), F.lit(""))


@dataclass(frozen=True)
class ArabicOptions:
    """numerals: keep, eastern, western, persian. shaping, diacritics: see unshape. letters: nfc, alif, orthographic.
    punctuation: mirrored or preserve."""

    numerals: str = "keep"
    shaping: str = "unshape"
    diacritics: str = "preserve"
    letters: str = "nfc"
    punctuation: str = "mirrored"


def recover(c: Column, o: ArabicOptions = ArabicOptions()) -> Column:
    """The whole chain: soft hyphens, isolated letters, floating marks, shaped letters, spelling, punctuation, order, NFC."""
    c = T.attach_diacritics(T.join_isolated_letters(T.clean_soft_hyphens(c)))
    c = unshape(c, o.shaping, o.diacritics)
    if o.letters in ("alif", "orthographic"):
        c = T.normalize_alif(c)
    if o.letters == "orthographic":
        c = T.normalize_orthography(c)
    if o.punctuation == "mirrored":
        c = T.mirror_punctuation(c)
    return T.nfc(bidi(c))


def numerals(c: Column, system: str) -> Column:
    """Digits in one system; keep and mixed change nothing."""
    return {"eastern": T.to_eastern_indic, "western": T.to_western, "persian": T.to_perso_arabic}.get(system, lambda x: x)(c)


def joins(before: Column, after: Column, gap: Column, size: Column) -> Column:
    """Two glyphs belong to one word: a small gap, a wider one after a dual-joining letter, or a mark that follows."""
    return (gap <= 0.20 * size) | (before.rlike(f"[{DUAL_JOINING}]") & (gap <= 0.38 * size)) | after.rlike(T.ATTACHED)


# --- tokens and expressions

#: One token at a place, in this order: white space, address, citation, code, right-to-left run, number, word (mail, file), sign.
_TOKEN = (rf"[{T.SPACE}]+|(?:https?://|www\.)[^{T.SPACE})>\]]*|\[[\p{{IsAlphabetic}}\p{{N}},\-]*\]|`[^`]*`|[{T.RTL}]+|[0-9][0-9٠-٩۰-۹.,٫٬%٪\-]*"
          r"|[A-Za-z][A-Za-z0-9_\-]*(?:@[A-Za-z0-9.\-]*|\.[A-Za-z]+)?|(?s:.)")
_KINDS = ((rf"^[{T.SPACE}]", "Whitespace"), (r"^(https?://|www\.)", "Url"), (r"^\[.", "CitationOrReference"), (r"^`.*`$", "CodeFragment"), (rf"^[{T.RTL}]", "ArabicText"),
          (r"^[0-9]", "Numeric"), (r"^[A-Za-z][A-Za-z0-9_\-]*@", "Email"), (r"^[A-Za-z][A-Za-z0-9_\-]*\.", "FilenameOrPath"), (r"^[A-Za-z]", "LatinText"))


def token_texts(c: Column) -> Column:
    """The tokens in order; together they are the text. A bracket of over 10 bytes is no citation and is read sign by sign."""
    every = lambda x: F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0))
    long = lambda t: F.startswith(t, F.lit("[")) & (F.octet_length(t) > 10)
    return F.flatten(F.transform(every(c), lambda t: F.when(long(t), F.concat(F.array(F.lit("[")), every(F.substring(t, F.lit(2), F.length(t))))).otherwise(F.array(t))))


def token_kind(t: Column) -> Column:
    out = None
    for pattern, kind in _KINDS:
        out = F.when(t.rlike("(?s)" + pattern), kind) if out is None else out.when(t.rlike("(?s)" + pattern), kind)
    return out.otherwise("PunctuationOrSymbol")


def tokens(c: Column) -> Column:
    """array<struct<kind, text, is_rtl>>; no text, no tokens."""
    return F.transform(token_texts(c), lambda t: F.struct(token_kind(t).alias("kind"), t.alias("text"), t.rlike(f"^[{T.RTL}]").alias("is_rtl")))


def process_line(c: Column) -> Column:
    """Plain letters in right-to-left runs; addresses, code, citations and all other tokens stay."""
    plain = lambda t: F.when(t.rlike(f"^[{T.RTL}]"), T.presentation_forms(t)).otherwise(t)
    return F.when(c.rlike(f"[{T.RTL}]"), F.array_join(F.transform(token_texts(c), plain), "")).otherwise(c)


def expressions(c: Column) -> Column:
    """array<struct<kind, value, unit>> of the dates, times, shares, sums, citations, footnote marks and page references."""
    none = F.lit(None).cast("string")

    def found(kind, value, unit=none):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), unit.alias("unit"))

    def marks(ws, i):
        """The token before i is a page mark that takes i with it: an odd run of marks ends there."""
        run = F.aggregate(F.slice(ws, 1, i), F.lit(0), lambda a, x: F.when(x.isin(*PAGE_MARKS), a + 1).otherwise(0))
        return F.when((i > 0) & F.get(ws, i - 1).isin(*PAGE_MARKS), run % 2 == 1).otherwise(False)

    def classify(ws):
        def one(w, i):
            after = F.get(ws, i + 1)
            parts = F.when(F.contains(w, F.lit("/")), F.size(F.split(w, "/"))).otherwise(F.size(F.split(w, "-")))
            date = w.rlike("[/-]") & w.rlike("[0-9٠-٩۰-۹]") & (parts == 3)
            case = F.when(marks(ws, i), None).when(w.rlike("[%٪]$"), found("Percentage", w)).when(date, found("Date", w))
            case = case.when(F.contains(w, F.lit(":")) & w.rlike("[0-9٠-٩]"), found("Time", w))
            case = case.when(after.isin(*CURRENCIES) & w.rlike("^[0-9٠-٩۰-۹.٫,]*$"), found("Currency", w, after))
            case = case.when(w.rlike(r"^\[.*\]$"), found("Citation", w)).when(w.rlike(r"^\(.*\)$") & (F.octet_length(w) <= 5), found("FootnoteMarker", w))
            return case.when(w.isin(*PAGE_MARKS) & after.isNotNull(), found("PageReference", F.concat_ws(" ", w, after)))

        return F.filter(F.transform(ws, one), lambda x: x.isNotNull())

    return classify(F.filter(F.split(c, f"[{T.SPACE}]+"), lambda w: w != ""))


# --- classifiers

def heading(c: Column) -> tuple[Column, Column]:
    """(level, confidence) by the first word; null for other text."""
    t = T.strip(c)
    level = confidence = None
    for prefixes, n, conf in HEADINGS:
        hit = starts(t, prefixes)
        level = F.when(hit, n) if level is None else level.when(hit, n)
        confidence = F.when(hit, conf) if confidence is None else confidence.when(hit, conf)
    return level, confidence


def list_item(c: Column) -> dict[str, Column]:
    """marker (null: no item) and content of items by Arabic letters or eastern digits."""
    t = F.regexp_replace(c, f"^[{T.SPACE}]+", "")
    letter = F.regexp_extract(t, rf"^([{ABJAD}])[\-.)]", 1)
    digits = F.regexp_extract(t, rf"^\(*\[*[{T.SPACE}]*([٠-٩]+)[{T.SPACE}]*[.)\]]", 1)
    rest = F.regexp_replace(t, rf"^([{ABJAD}][\-.)]|\(*\[*[{T.SPACE}]*[٠-٩]+[{T.SPACE}]*[.)\]])[{T.SPACE}]*", "")
    marker = F.when(letter != "", letter).when(digits != "", digits)
    return {"marker": marker, "content": F.when(marker.isNotNull(), rest)}


def caption_target(c: Column) -> Column:
    t, out = T.strip(c), None
    for kind, prefixes in CAPTIONS:
        out = F.when(starts(t, prefixes), kind) if out is None else out.when(starts(t, prefixes), kind)
    return out


def scholarly_section(c: Column) -> Column:
    """The first kind of section one of whose words the heading holds."""
    t, out = F.lower(T.strip(c)), None
    for kind, words in SECTIONS:
        out = F.when(holds(t, words), kind) if out is None else out.when(holds(t, words), kind)
    return out


def is_clause_start(c: Column) -> Column:
    return starts(c, CLAUSE_STARTS)


def has_isolated_letters(c: Column) -> Column:
    """Three or more words of one right-to-left letter, and more than half of the words."""
    ws = F.filter(F.split(c, f"[{T.SPACE}]+"), lambda w: w != "")
    n = F.size(F.filter(ws, lambda w: w.rlike(f"^[{T.RTL}]$")))
    return (n >= 3) & (n > F.floor(F.size(ws) / 2))


def has_broken_lam_alef(c: Column) -> Column:
    return holds(c, ("ل ا", "ل أ", "ل إ", "ل آ"))


def has_private_use(c: Column) -> Column:
    return c.rlike(r"[\x{E000}-\x{F8FF}]")


def dialect(code: Column) -> Column:
    """Country of a language code, with or without ar in front; GeneralArabic otherwise, also for null."""
    c = F.regexp_replace(F.replace(F.lower(code), F.lit("_"), F.lit("-")), "^ar-", "")
    out = None
    for k, v in DIALECTS.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise("GeneralArabic")


def table_direction(texts: Column) -> Column:
    """Of an array of cell texts: right to left if 0.40 of what isn't white space is, or if there is nothing."""
    whole = F.array_join(texts, "")
    every = F.length(F.regexp_replace(whole, f"[{T.SPACE}]+", ""))
    return F.when((every == 0) | (T.count(whole, T.RTL) / every >= 0.40), "RightToLeft").otherwise("LeftToRight")
