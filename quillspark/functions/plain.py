"""Text normalisation in Python, for the page functions that run beside the parser; the columns in text.py say the same."""

from __future__ import annotations

import re
import unicodedata

from ..sources.fonts import plain
from . import arabic as A
from . import text as T


def _class(chars: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), chars)


_RTL = re.compile(f"[{_class(T.RTL)}]")
_WIDE, _DROPPED = re.compile(_class(T.WIDE_SPACES)), re.compile(_class(T.DROPPED))
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")
_LIGATURES = str.maketrans(dict(T.LIGATURES))


def _word(t: str) -> str:
    letters = _RTL.findall(t)
    if not letters:
        return t
    out, first, last = plain(t), letters[0], letters[-1]
    by_form = first in A.FINAL and last in A.INITIAL + A.ALEF_FORMS or last in A.INITIAL and first not in A.INITIAL
    by_letter = len(out) >= 2 and (out[0] in "ةء" or out.endswith("لا") and not out.startswith("ال"))
    return out[::-1] if by_form or by_letter else out


def normalize(s: str) -> str:
    if s.isascii():
        return _CONTROL.sub("", s)
    s = _DROPPED.sub("", _WIDE.sub(" ", s.replace("\u00ad", "").translate(_LIGATURES)))
    if _RTL.search(s):
        s = " ".join(map(_word, s.split(" ")))
    return _CONTROL.sub("", unicodedata.normalize("NFC", s))
