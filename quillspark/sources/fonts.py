"""Fonts of a PDF: style flags, ToUnicode maps, and the recovery of a character from a code or a glyph name."""

from __future__ import annotations

import re
import unicodedata

from ..functions.text import MORE_FORMS

# Parts of font names, glyph names, and the letters that fonts put into the private use area.
BOLD, ITALIC, MONOSPACE = ("bold", "black", "heavy", "b-"), ("italic", "oblique", "it-"), ("courier", "mono", "consolas", "code")
AFII_FIRST, AFII_LETTERS = 57414, "ابةتثجحخدذرزسشصضطظعغـفقكلمنهوىي"
GLYPH_NAMES = dict(x.split("=") for x in """
hamza=ء alefmadda=آ alefmaddah=آ alefhamza=أ alefhamzaabove=أ wawhamza=ؤ alefhamzabelow=إ yehhamza=ئ alef=ا beh=ب ba=ب tehmarbuta=ة teh=ت ta=ت theh=ث tha=ث
jeem=ج jim=ج hah=ح ha=ح khah=خ kha=خ dal=د thal=ذ reh=ر ra=ر zain=ز zay=ز seen=س sin=س sheen=ش shin=ش sad=ص dad=ض tah=ط zah=ظ ain=ع ayn=ع ghain=غ ghayn=غ
tatweel= kashida= feh=ف fa=ف qaf=ق kaf=ك lam=ل meem=م mim=م noon=ن nun=ن heh=ه he=ه waw=و alefmaksura=ى yeh=ي ya=ي
lam_alef=لا lamalef=لا lam_alefhamza=لأ lamalefhamzaabove=لأ lam_alefhamzabelow=لإ lam_alefmadda=لآ allah=الله sallallahou_alayhe_wasallam=صلى_الله_عليه_وسلم
saw=صلى_الله_عليه_وسلم jalajalalouhou=جل_جلاله bismillah=بسم_الله_الرحمن_الرحيم rial=ريال riyal=ريال
peh=پ tcheh=چ cheh=چ jeh=ژ zheh=ژ gaf=گ keheh=ک tteh=ٹ ddal=ڈ rreh=ڑ noonghunna=ں yeh_barree=ے heh_goal=ہ lam_kurdish=ڵ oe_kurdish=ۆ yeh_kurdish=ێ reh_kurdish=ڕ e_kurdish=ە
zero_arabic=٠ one_arabic=١ two_arabic=٢ three_arabic=٣ four_arabic=٤ five_arabic=٥ six_arabic=٦ seven_arabic=٧ eight_arabic=٨ nine_arabic=٩
question_arabic=؟ comma_arabic=، semicolon_arabic=؛ percent_arabic=٪""".split())
PRIVATE = dict(zip([*range(0xF0C1, 0xF0D7), *range(0xF0D8, 0xF0E0), 0xF0E1, *range(0xF0E3, 0xF0E7), 0xF0EC, 0xF0ED], "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىي"))

_PLAIN = str.maketrans({chr(x): unicodedata.normalize("NFKC", chr(x)) for x in range(0xFE80, 0xFEFD)} | {chr(x): to for a, b, to in MORE_FORMS for x in range(a, b + 1)})


def plain(text: str) -> str:
    """Plain letters for shaped ones."""
    return text.translate(_PLAIN)


def direct(code: int) -> str | None:
    """An Arabic letter, plain or shaped, by its code point."""
    if 0x600 <= code <= 0x6FF or 0x750 <= code <= 0x77F or 0x8A0 <= code <= 0x8FF:
        return chr(code)
    if 0xFB50 <= code <= 0xFDFF or 0xFE70 <= code <= 0xFEFF:
        return plain(chr(code))
    return None


def by_glyph_name(name: str) -> str | None:
    """uniXXXX, uXXXX, afii numbers and descriptive names; None for others."""
    name = name.strip()
    code = re.fullmatch(r"[uU]ni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,5})", name)
    if code and (found := direct(int(code[1] or code[2], 16))):
        return found
    if re.fullmatch(r"afii[0-9]{5}", name) and 0 <= int(name[4:]) - AFII_FIRST < len(AFII_LETTERS):
        return AFII_LETTERS[int(name[4:]) - AFII_FIRST]
    return GLYPH_NAMES[name].replace("_", " ") if name in GLYPH_NAMES else None


def recover(code: int, glyph_name: str | None, to_unicode: dict[int, str]) -> str:
    """The first that knows the code: its map (unless private), its glyph name, the private letters, the code point."""
    mapped = to_unicode.get(code, "")
    if mapped and not all("\ue000" <= c <= "\uf8ff" for c in mapped):
        return plain(mapped)
    if glyph_name is not None and (found := by_glyph_name(glyph_name)) is not None:
        return found
    if code in PRIVATE:
        return PRIVATE[code]
    if (found := direct(code)) is not None:
        return found
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else ""


def _unicode(hexed: str) -> str:
    units = [int(hexed[i : i + 4], 16) for i in range(0, len(hexed), 4)] if hexed and len(hexed) % 4 == 0 else [int(hexed, 16)] if hexed else []
    return b"".join(u.to_bytes(2, "big") for u in units if u < 0x10000).decode("utf-16-be", "ignore")


def read_cmap(data: str) -> dict[int, str]:
    """code -> text from the bfchar and bfrange sections of a ToUnicode map. A broken entry is left out."""
    out: dict[int, str] = {}
    for kind, body in re.findall(r"beginbf(char|range)(.*?)(?:endbf|endcmap|\Z)", data, re.S):
        if kind == "char":
            for code, text in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", body):
                if to := _unicode(text):
                    out[int(code, 16)] = to
            continue
        for lo, hi, one, many in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", body):
            lo_, hi_ = int(lo, 16), min(int(hi, 16), int(lo, 16) + 0xFFFF)
            if one:
                text = _unicode(one)
                for k in range(max(0, hi_ - lo_ + 1)):
                    if text and ord(text[-1]) + k < 0x110000:
                        out[lo_ + k] = text[:-1] + chr(ord(text[-1]) + k)
            else:
                for k, t in enumerate(re.findall(r"<([0-9A-Fa-f]*)>", many)):
                    if to := _unicode(t):
                        out[lo_ + k] = to
    return out


class Font:
    """A font as the interpreter needs it: style flags and decoded codes."""

    def __init__(self, name: str, base: str, to_unicode: dict[int, str] | None = None):
        low = base.lower()
        self.name, self.base, self.map = name, base, to_unicode or {}
        self.bold, self.italic, self.mono = (any(x in low for x in parts) for parts in (BOLD, ITALIC, MONOSPACE))
        self.seen: dict[int, str] = {}

    def decode(self, codes) -> str:
        out = []
        for c in codes:
            t = self.seen.get(c)
            if t is None:
                t = self.seen[c] = recover(c, None, self.map)
            out.append(t)
        return "".join(out)
