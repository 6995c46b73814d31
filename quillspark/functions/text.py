"""Column functions over text: normalisation, scripts, numerals, direction, quality, line predicates.

All are JVM-side expressions but ``nfc``. Null in, null out, unless stated otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code point ranges of scripts, ligature expansions, digits, letter pairs, shaped letters, letters that mark a
# language, and prefixes of captions and page numbers. They decide results and are stated as they are.
RTL = r"\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0700}-\x{074F}\x{0750}-\x{077F}\x{0780}-\x{07BF}\x{0840}-\x{085F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
SCRIPTS = {
    "Latin": r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}",
    "Arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "Hebrew": r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}",
    "Cyrillic": r"\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}",
    "Cjk": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
    "Devanagari": r"\x{0900}-\x{097F}",
    "Greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "Math": r"\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{2190}-\x{21FF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}",
}
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st"),
             ("Ĳ", "IJ"), ("ĳ", "ij"), ("Œ", "OE"), ("œ", "oe"), ("Æ", "AE"), ("æ", "ae"))
WIDE_SPACES = r"[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
DROPPED = r"[\x{00AD}\x{200B}\x{FEFF}]"
DIACRITICS = r"[\x{064B}-\x{065F}\x{0670}]"
WESTERN, EASTERN, PERSIAN = "0123456789", "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
ATTACHED = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"  # marks that belong to the letter before
LAM_ALEF = (("ل ا", "لا"), ("ل أ", "لأ"), ("ل إ", "لإ"), ("ل آ", "لآ"), ("لـا", "لا"), ("لـأ", "لأ"), ("لـإ", "لإ"), ("لـآ", "لآ"))
MORE_FORMS = ((0xFB56, 0xFB59, "پ"), (0xFB7A, 0xFB7D, "چ"), (0xFB8A, 0xFB8B, "ژ"), (0xFB8E, 0xFB91, "ک"), (0xFB92, 0xFB95, "گ"), (0xFBA6, 0xFBA9, "ں"), (0xFBF6, 0xFBF8, "ی"))
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")
BULLETS = "•\\-*+▪▫–—◦‣⁃●○"
HYPHENS = "-\u2010\u00AD"  # at the end of a line
LANGUAGE_MARKS = {  # script -> letters that decide, in order; then the script's own language and the confidences
    "Arabic": ((r"[ٻٿڀٽڄڃڇڌڍڊڙڪڳڱڦڻڏ]", "Sindhi", 0.96), (r"[ټځڅډړږښګڼېۍۀ]", "Pashto", 0.96), (r"[ڵۆێڕە]", "Kurdish", 0.95),
               (r"[ٹڈڑےںہ]", "Urdu", 0.95), (r"[گچپژ]", "Persian", 0.95), ("", "Arabic", 0.92)),
    "Hebrew": (("", "Hebrew", 0.98),),
    "Cjk": ((r"[\x{3040}-\x{30FF}]", "Japanese", 0.98), (r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]", "Korean", 0.98), ("", "Chinese", 0.92)),
    "Cyrillic": ((r"[іїєґІЇЄҐ]", "Ukrainian", 0.95), ("", "Russian", 0.90)),
    "Devanagari": (("", "Hindi", 0.95),),
    "Latin": ((r"[ğışĞİŞ]", "Turkish", 0.95), (r"[äÄß]", "German", 0.90), (r"[éèêëàâùûôîïœæ]", "French", 0.90), (r"[ñÑ¿¡]", "Spanish", 0.90), ("", "English", 0.85)),
    "Math": (("", "Unknown", 0.50),), "Greek": (("", "Unknown", 0.50),), "Mixed": (("", "Unknown", 0.30),), "Unknown": (("", "Unknown", 0.30),),
}


#: White space as Unicode has it; the engine's own class is ASCII only.
SPACE = r"\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def count(c: Column, chars: str) -> Column:
    """Characters of a class, by removing all others, runs at once: no list of matches is built."""
    return F.length(F.regexp_replace(c, f"[^{chars}]+", ""))


def contains(c: Column, chars: str) -> Column:
    """A character of the class is in the text."""
    return c.rlike(f"[{chars}]")


def clean_soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit("­"), F.lit(""))


def unfold_ligatures(c: Column) -> Column:
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(c, WIDE_SPACES, " "), DROPPED, "")


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, DIACRITICS, "")


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space but newlines become one space."""
    return F.regexp_replace(c, r"[ \t\r\f\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " ")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Spark has no NFC; ASCII texts don't go to Python."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def drop_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]", "")


def clean(c: Column) -> Column:
    """normalize without its NFC, which needs Python: soft hyphens, ligatures and spaces, reversed words, control characters."""
    from .arabic import bidi

    return drop_control(bidi(unfold_ligatures(clean_soft_hyphens(c))))


def normalize(c: Column) -> Column:
    """Soft hyphens, ligatures and spaces, right-to-left words in visual order, NFC, control characters."""
    from .arabic import bidi

    return drop_control(nfc(bidi(unfold_ligatures(clean_soft_hyphens(c)))))


def normalize_alif(c: Column) -> Column:
    return F.translate(c, "أإآٱ", "اااا")


def normalize_orthography(c: Column) -> Column:
    return F.translate(c, "ةىئ", "هيي")


def to_western(c: Column) -> Column:
    return F.translate(c, EASTERN + PERSIAN + "٫٬٪", WESTERN + WESTERN + ".,%")


def to_eastern_indic(c: Column) -> Column:
    return F.translate(c, WESTERN + ".,%", EASTERN + "٫٬٪")


def to_perso_arabic(c: Column) -> Column:
    return F.translate(c, WESTERN, PERSIAN)


def numeral_system(c: Column) -> Column:
    e, w, p = count(c, EASTERN), count(c, WESTERN), count(c, PERSIAN)
    return F.when((e > w) & (e > p), "EasternArabicIndic").when((w > e) & (w > p), "WesternArabic").when(p > 0, "PersoArabic").otherwise("WesternArabic")


def script_counts(c: Column) -> list[Column]:
    return [count(c, r).cast("long").alias(f"n_{s.lower()}") for s, r in SCRIPTS.items()]


def dominant_script(counts: dict[str, Column]) -> Column:
    """Mixed if two scripts exceed 15 % and none reaches 70 %; ties go to the first in the order of SCRIPTS."""
    total = sum(counts.values(), F.lit(0))
    top = F.greatest(*counts.values())
    several = sum((F.when(v > 0.15 * total, 1).otherwise(0) for v in counts.values()), F.lit(0)) > 1
    out = F.when(total == 0, "Unknown").when(several & (top < 0.70 * total), "Mixed")
    for s, v in counts.items():
        out = out.when(v == top, s)
    return out


def language(script: Column, c: Column) -> tuple[Column, Column]:
    """(language, confidence) from the script and marker letters."""
    name = conf = None
    for s, marks in LANGUAGE_MARKS.items():
        for pattern, lang, v in marks:
            cond = (script == s) & c.rlike(pattern) if pattern else script == s
            name = F.when(cond, lang) if name is None else name.when(cond, lang)
            conf = F.when(cond, v) if conf is None else conf.when(cond, v)
    return name, conf


def paragraph_direction(c: Column) -> Column:
    rtl, ltr = count(c, RTL), count(c, "A-Za-z")
    first = F.regexp_extract(c, f"([{RTL}A-Za-z])", 1).rlike(f"[{RTL}]")
    return F.when((rtl > 0) & ((rtl >= ltr) | first), "RightToLeft").otherwise("LeftToRight")


QUALITY_COUNTS = {"bad": r"\x{FFFD}", "pua": r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}", "every": r"\x{0000}-\x{001F}\x{007F}-\x{009F}", "white": r"\n\r\t"}


def quality_counts(c: Column) -> dict[str, Column]:
    """What text_quality is made of. In a frame these belong into columns of their own, so that each is counted once."""
    return {"n": F.length(c), "blank": ~c.rlike(f"[^{SPACE}]")} | {k: count(c, v) for k, v in QUALITY_COUNTS.items()}


def text_quality(c: Column, counts=None) -> dict[str, Column]:
    """quality_score and its parts; blank text scores 0 with a printable ratio of 1. counts: columns that hold quality_counts."""
    k = quality_counts(c) if counts is None else counts
    n, blank, bad, pua, every = k["n"].cast("double"), k["blank"], k["bad"], k["pua"], k["every"]
    control = every - k["white"]
    ratio = (n - bad - pua - every) / n
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio - (bad * 0.05 + pua * 0.02 + control * 0.05)))
    corrupt = (bad / n > 0.05) | (pua / n > 0.10) | (ratio < 0.70)
    zero = F.lit(0)
    return {"quality_score": F.when(blank, 0.0).otherwise(score), "is_corrupted": F.when(blank, False).otherwise(corrupt), "printable_ratio": F.when(blank, 1.0).otherwise(ratio),
            "replacement_chars": F.when(blank, zero).otherwise(bad).cast("long"), "pua_chars": F.when(blank, zero).otherwise(pua).cast("long")}


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_yaml(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_gfm_cell(c: Column) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")), F.lit("\r"), F.lit(""))
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_page_number(c: Column) -> Column:
    return F.lower(c).rlike(r"^(page |p\. |- )") | c.rlike(r"^\+?[0-9]{1,9}$") | (c.rlike(r"( of |/)") & c.rlike(r"^[ /]*((\+?[0-9]{1,9}|of)([ /]+|$)){0,3}$"))


def list_item(c: Column) -> dict[str, Column]:
    """ordered (null: no item), marker, content. Null text is no item."""
    t = F.regexp_replace(c, f"^[{SPACE}]+", "")
    mark = rf"([0-9]{{1,8}}|\+[0-9]{{1,7}}|(?i:{'|'.join(sorted(ROMAN, key=len, reverse=True))})|[A-Za-z])"
    bullet = F.regexp_extract(t, f"^([{BULLETS}])", 1)
    number = F.regexp_extract(t, rf"^\(*\[*{mark}[.)\]]", 1)
    rest = F.regexp_replace(F.regexp_replace(t, rf"^([{BULLETS}]|\(*\[*{mark}[.)\]])", ""), f"^[{SPACE}]+", "")
    ordered = F.when(bullet != "", False).when(number != "", True)
    return {"ordered": ordered, "marker": F.when(bullet != "", bullet).when(number != "", number), "content": F.when(ordered.isNotNull(), rest)}


def indent_level(x: Column) -> Column:
    """Depth of a list item by its left edge: steps of 16 points, 6 at most."""
    return F.least(F.floor(F.greatest(x, F.lit(0.0)) / 16), F.lit(6)).cast("int")


def caption_target(c: Column) -> Column:
    t = F.lower(F.regexp_replace(c, r"^\s+", ""))
    return (F.when(t.rlike(r"^(figure|fig\.|fig|illustration) "), "Figure").when(t.rlike(r"^(table|tab\.|tab) "), "Table")
            .when(t.rlike(r"^(listing|algorithm|code) "), "Code").when(t.rlike(r"^(equation|eq\.|eq) "), "Equation"))


#: Shaped letters of the block FE80-FEFC and their plain letters by compatibility decomposition; some become two letters.
_PLAIN = {chr(x): unicodedata.normalize("NFKC", chr(x)) for x in range(0xFE80, 0xFEFD)} | {chr(x): to for a, b, to in MORE_FORMS for x in range(a, b + 1)}
FORMS = ("".join(a for a, b in _PLAIN.items() if len(b) == 1), "".join(b for b in _PLAIN.values() if len(b) == 1))
FORM_PAIRS = tuple((a, b) for a, b in _PLAIN.items() if len(b) > 1)


def _replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def presentation_forms(c: Column) -> Column:
    """Shaped Arabic letters become plain ones; lam-alef becomes two."""
    return F.translate(_replaced(c, FORM_PAIRS), *FORMS)


def repair_lam_alef(c: Column) -> Column:
    return _replaced(c, LAM_ALEF)


def join_isolated_letters(c: Column) -> Column:
    """Where words are two spaces apart, single spaces inside them go; lam-alef pairs are repaired."""
    words = F.transform(F.split(c, "  "), lambda w: repair_lam_alef(F.regexp_replace(w, r"\s+", "")))
    return F.when(F.contains(c, F.lit("  ")), F.array_join(words, " ")).otherwise(repair_lam_alef(c))


def attach_diacritics(c: Column) -> Column:
    """The space before a mark goes."""
    return F.regexp_replace(c, f" (?={ATTACHED})", "")


def mirror_punctuation(c: Column) -> Column:
    """Arabic question mark, semicolon and comma (not between digits); quotes open and close in turn."""
    c = F.translate(F.regexp_replace(c, r"(?<![0-9]),|,(?![0-9])", "،"), "?;", "؟؛")
    return F.replace(F.regexp_replace(c, '"([^"]*)"', "«$1»"), F.lit('"'), F.lit("«"))


def scholarly_heading(c: Column, level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), level)).cast("int")), F.lit(" "), strip(c))


def citation(c: Column) -> Column:
    """(x) becomes [^x]; anything else is only trimmed."""
    t = strip(c)
    return F.when(t.rlike(r"(?s)\A\(.*\)\z"), F.concat(F.lit("[^"), strip(F.substring(t, F.lit(2), F.length(t) - 2)), F.lit("]"))).otherwise(t)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def merge_hyphenated(left: Column, right: Column) -> Column:
    """Two lines of a paragraph: a word cut by a hyphen before a lower-case letter is joined; an empty side adds nothing."""
    a, b = F.regexp_replace(left, rf"[{SPACE}]+\z", ""), F.regexp_replace(right, rf"\A[{SPACE}]+", "")
    cut = a.rlike(f"[{HYPHENS}]\\z") & b.rlike(r"\A[\p{IsAlphabetic}&&\p{IsLowercase}]")
    return F.when(a == "", right).when(b == "", left).when(cut, F.concat(F.regexp_replace(a, f"[{HYPHENS}]\\z", ""), b)).otherwise(F.concat_ws(" ", a, b))


def join_paragraph_line(left: Column, right: Column) -> Column:
    """The shorter, in bytes, of the two ways to join lines."""
    plain, merged = join_line(left, right), merge_hyphenated(left, right)
    return F.when(F.octet_length(merged) < F.octet_length(plain), merged).otherwise(plain)


def join_paragraph(lines: Column) -> Column:
    """All lines of an array, as join_paragraph_line would join one after the other, but looking at each line once: what
    stands between two lines depends on the end of one and the beginning of the next alone. No lines give null."""
    left, right = (lambda c: F.regexp_replace(c, rf"\A[{SPACE}]+", "")), (lambda c: F.regexp_replace(c, rf"[{SPACE}]+\z", ""))
    filled = lambda c: c.rlike(f"[^{SPACE}]")

    def whole(ls):
        first, open_end = F.get(ls, 0), filled(F.element_at(ls, -1))
        rest = F.filter(F.slice(ls, 2, F.size(ls)), filled)
        rest = F.transform(F.array(rest), lambda rs: F.transform(rs, lambda x, i: F.when((i == F.size(rs) - 1) & open_end, left(x)).otherwise(right(left(x)))))[0]
        parts = F.concat(F.when(filled(first), F.array(right(first))).otherwise(F.array().cast("array<string>")), rest)
        return F.when(F.size(ls) < 2, first).otherwise(F.transform(F.array(parts), joined)[0])

    def joined(ps):
        def one(c, i):
            after = F.get(ps, i + 1)
            cut = c.rlike(f"[{HYPHENS}]\\z") & after.rlike(r"\A[\p{IsAlphabetic}&&\p{IsLowercase}]")
            tight = c.rlike(f"[{CJK}]\\z") & after.rlike(f"\\A[{CJK}]")
            return F.when(after.isNull(), c).when(cut, F.substring(c, F.lit(1), F.length(c) - 1)).when(tight, c).otherwise(F.concat(c, F.lit(" ")))

        return F.array_join(F.transform(ps, one), "")

    return F.transform(F.array(lines), whole)[0]


def join_line(left: Column, right: Column) -> Column:
    """Two lines of a paragraph: no space between CJK characters, one space elsewhere; an empty side adds nothing."""
    a, b = F.regexp_replace(left, rf"[{SPACE}]+\z", ""), F.regexp_replace(right, rf"\A[{SPACE}]+", "")
    tight = a.rlike(f"[{CJK}]\\z") & b.rlike(f"\\A[{CJK}]")
    return F.when(a == "", b).when(b == "", a).when(tight, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))


def eval_normalize(c: Column, tashkeel: bool = False, decorations: bool = True, lower: bool = False) -> Column:
    """Text as the evaluation compares it: no front matter, comments or Markdown marks, NFC, single spaces."""
    c = F.regexp_replace(strip(c), r"(?s)\A---.*?---\s*", "")
    c = nfc(F.regexp_replace(c, r"(?s)<!--(?:>|->|.*?-->)", " "))
    if tashkeel:
        c = F.regexp_replace(c, r"[\x{064B}-\x{0652}\x{0670}]", "")
    if decorations:
        c = _replaced(F.translate(c, "#*_`|", " " * 5), (("- ", " "), ("---", " ")))
    if lower:
        c = F.lower(c)
    return F.trim(F.regexp_replace(collapse_whitespace(c), r"\s+", " "))
