"""PDF bytes to pages of text spans, drawn paths and images: a small writer for tests, a parser, and its frames.

The parser reads objects by their markers, as broken files need no cross-reference table. It runs in mapInArrow and
gathers the pages of many documents into a record batch. Broken input and what exceeds a limit give a row with ``error``
set and no pages instead of failing the job. Null content is an error row, too; empty pages are pages without spans;
rows that repeat an id stay apart by their ``uid``.

Not as the format says but as the reference engine's results have it: a glyph is 0.55 of the font size wide, a rectangle
is a path of its own, and every object of type Page counts, in the order of the file.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fonts import Font, read_cmap


@dataclass(frozen=True)
class Limits:
    """What a file may hold; beyond it the file is refused. parity: operands and matrices as the reference engine takes them."""

    file_bytes: int = 512 << 20
    stream_bytes: int = 32 << 20
    ratio: float = 100.0  # of streams that inflate to over 1 MB
    pages: int = 5000
    parity: bool = False


class LimitError(ValueError):
    pass


# --- writer


def write_pdf(pages: list[list[tuple[float, float, float, str]]], drawing: bytes = b"", title: str = "", compress: bool = False) -> bytes:
    """pages of (x, y from below, size, text); drawing goes into each page's stream."""
    objs, kids = [b"<< /Type /Catalog /Pages 2 0 R >>", b""], []
    for page in pages:
        body = drawing + b"BT\n" + b"".join(b"/F1 %g Tf 1 0 0 1 %g %g Tm (%s) Tj\n" % (s, x, y, re.sub(rb"([()\\])", rb"\\\1", t.encode())) for x, y, s, t in page) + b"ET"
        if compress:
            body = zlib.compress(body)
        n = len(objs) + 1
        kind = b" /Filter /FlateDecode" if compress else b""
        objs += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 << /Type /Font /BaseFont /Helvetica >> >> >> /Contents %d 0 R >>" % (n + 1), b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), kind, body)]
        kids.append(b"%d 0 R" % n)
    objs[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(pages))
    info = b"<< /Title (%s) >>" % title.encode() if title else b""
    if info:
        objs.append(info)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objs, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


# --- streams


def inflate(data: bytes, limits: Limits = Limits()) -> bytes:
    """zlib, or else raw deflate; what cannot be inflated gives nothing. Raises LimitError beyond the limits."""
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(data, limits.stream_bytes + 1)
        except zlib.error:
            continue
        if len(out) > limits.stream_bytes:
            raise LimitError(f"a stream inflates to over {limits.stream_bytes} bytes")
        if bits > 0 and len(out) > 1 << 20 and len(out) > limits.ratio * max(len(data), 1):
            raise LimitError(f"a stream inflates to over {limits.ratio:g} times its size")
        if d.eof or out and bits > 0:  # a zlib stream that ends too early still gives what it holds
            return out
    return b""


def ascii_hex(data: bytes) -> bytes:
    """Hex digits up to >; other bytes are skipped, a last single digit counts as the upper half of a byte."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def decode_stream(head: bytes, data: bytes, limits: Limits) -> bytes:
    if b"/ASCIIHexDecode" in head or b"/AHx" in head:
        data = ascii_hex(data)
    return inflate(data, limits) if b"/FlateDecode" in head or b"/Fl " in head else data


# --- content streams

_SKIP = re.compile(rb"(?:[\s\x00]+|%[^\r\n]*)*")
#: Numbers, names and operators, simple strings, hex strings, and the signs that begin anything else.
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<<|>>|<[^>]*>?|/[^\s\x00()<>\[\]/%]*|[^\s\x00()<>\[\]/%]+|[\[\]()>]", re.S)
_NESTING = re.compile(rb"\\.|[()]", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n|\r|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
OPERATORS = frozenset(b"q Q cm BT ET Tf Tm Td TD T* TL Tc Tw Tj TJ ' \" re m l c v y h S s f F f* B B* b b* rg k g RG K G w Do".split())
#: Further operators of the format: without effect here, but they end their operands.
SILENT = frozenset(b"gs d i j J M ri W W* n cs CS sc SC scn SCN sh Tr Ts Tz d0 d1 BI ID EI MP DP BMC BDC EMC BX EX".split())


def tokens(stream: bytes) -> Iterator[bytes]:
    """Tokens of a content stream; an array is its opening bracket, its items and its closing bracket."""
    at, end = 0, len(stream)
    while True:
        at = _SKIP.match(stream, at).end()
        if at >= end:
            return
        m = _TOKEN.match(stream, at)
        if m is None:
            at += 1
            continue
        if m[0] != b"(":
            at = m.end()
            yield m[0]
            continue
        depth = 0
        for n in _NESTING.finditer(stream, at):  # a string with parentheses inside, however deep
            depth += (n[0] == b"(") - (n[0] == b")")
            if not depth:
                break
        stop = n.end() if not depth else end
        yield stream[at:stop]
        at = stop


def _unescaped(raw: bytes) -> bytes:
    return _ESCAPE.sub(lambda m: _NAMED.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else b"" if m[1] in (b"\n", b"\r\n", b"\r") else m[1]), raw)


def decode_string(tok: bytes, font: Font | None) -> str:
    """Text of a literal or hex string. A font's codes have four hex digits if their number allows it, else two."""
    if tok[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", tok)
        if font is not None:
            size = 4 if len(digits) % 4 == 0 else 2
            return font.decode(int(digits[i : i + size], 16) for i in range(0, len(digits), size))
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    raw = tok[1:-1]
    if b"\\" in raw:
        raw = _unescaped(raw)
    if raw.isascii() and (font is None or not font.map):
        return raw.decode()
    if font is None:
        return raw.decode("utf-8", "replace")
    if not font.map:
        try:  # text that is Unicode already
            return font.decode(map(ord, raw.decode("utf-8")))
        except UnicodeDecodeError:
            pass
    return font.decode(raw)


def _mul(m, n):
    """m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _hex(rgb) -> str:
    return "#" + "".join("%02x" % int(min(max(v, 0.0), 1.0) * 255 + 0.5) for v in rgb)


class Page:
    """Elements of one page. Places are from the top left."""

    __slots__ = ("number", "width", "height", "spans", "paths", "images")

    def __init__(self, number: int, width: float = 612.0, height: float = 792.0):
        self.number, self.width, self.height = number, width, height
        self.spans, self.paths, self.images = [], [], []


class Interpreter:
    """Runs content streams on a page. spans: (text, x, y, w, h, size, font, bold, italic, mono, color); paths:
    (rect, points, commands, stroke, fill, width, color, fill color); a command is (name, numbers)."""

    def __init__(self, page: Page, fonts: dict[str, Font], parity: bool = False):
        self.page, self.fonts, self.parity = page, fonts, parity
        self.stack: list[tuple] = []
        self.ctm, self.size, self.font, self.leading = IDENTITY, 12.0, "", 0.0
        self.fill = self.stroke = (0.0, 0.0, 0.0)
        self.line = 1.0
        self.tm = self.lm = IDENTITY
        self.points, self.commands = [], []

    def run(self, stream: bytes) -> None:
        args: list = []
        array: list | None = None
        for tok in tokens(stream):
            if tok == b"[":
                array = []
            elif tok == b"]":
                args.append(array)
                array = None
            elif array is not None:
                array.append(tok)
            elif tok in OPERATORS:
                try:
                    self.operate(tok, args)
                except (IndexError, ValueError, TypeError):
                    pass  # an operator with missing or wrong operands has no effect
                args = []
            elif tok in SILENT and not self.parity:
                args = []
            else:
                args.append(tok)

    def place(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.ctm
        return a * x + c * y + e, max(0.0, self.page.height - (b * x + d * y + f))

    def move(self, x: float, y: float) -> None:
        step = (1.0, 0.0, 0.0, 1.0, x, y)
        self.tm = self.lm = _mul(self.lm, step) if self.parity else _mul(step, self.lm)

    def advance(self, dx: float) -> None:
        step = (1.0, 0.0, 0.0, 1.0, dx, 0.0)
        self.tm = _mul(self.tm, step) if self.parity else _mul(step, self.tm)

    def show(self, tok: bytes) -> None:
        font = self.fonts.get(self.font)
        text = decode_string(tok, font)
        if not text:
            return
        a, b, c, d, x, y = self.tm if self.ctm is IDENTITY else _mul(self.tm, self.ctm)
        wide = len(text) * self.size * 0.55
        w, h = (wide * a, self.size * d) if not b and not c and a >= 0 and d >= 0 else (wide * math.hypot(a, b), self.size * math.hypot(c, d))
        flags = (font.bold, font.italic, font.mono) if font else (False, False, False)
        self.page.spans.append((text, x, max(0.0, self.page.height - y - h), max(w, 0.0), max(h, 0.0), self.size, self.font, *flags, _hex(self.fill)))
        self.advance(wide)

    def operate(self, op: bytes, args: list) -> None:
        if op == b"Tj":
            self.show(args[-1])
        elif op == b"Tm":
            self.tm = self.lm = tuple(float(x) for x in (args[:6] if self.parity else args[-6:]))
            if len(self.tm) < 6:
                self.tm = self.lm = IDENTITY
        elif op == b"Tf":
            name, size = args[:2] if self.parity else args[-2:]
            self.font = name.lstrip(b"/").decode("latin-1")
            self.size = float(size)
        elif op in (b"Td", b"TD"):
            x, y = (float(v) for v in (args[:2] if self.parity else args[-2:]))
            self.move(x, y)
            if op == b"TD":
                self.leading = -y
        elif op == b"TJ":
            for item in args[-1]:
                if item[:1] in b"(<":
                    self.show(item)
                else:
                    self.advance(-float(item) / 1000 * self.size)
        elif op == b"T*":
            self.move(0.0, -self.leading)
        elif op in (b"'", b'"'):
            self.move(0.0, -self.leading)
            self.show(args[-1])
        elif op == b"BT":
            self.tm = self.lm = IDENTITY
        elif op == b"TL":
            self.leading = float(args[-1])
        elif op == b"q":
            self.stack.append((self.ctm, self.size, self.font, self.leading, self.fill, self.stroke, self.line, self.tm, self.lm))
        elif op == b"Q":
            if self.stack:
                self.ctm, self.size, self.font, self.leading, self.fill, self.stroke, self.line, self.tm, self.lm = self.stack.pop()
        elif op == b"cm":
            m = tuple(float(v) for v in (args[:6] if self.parity else args[-6:]))
            if len(m) == 6:
                self.ctm = _mul(self.ctm, m) if self.parity else _mul(m, self.ctm)
        else:
            self.draw(op, args)

    def draw(self, op: bytes, args: list) -> None:
        if op == b"re":
            x, y, w, h = (float(v) for v in (args[:4] if self.parity else args[-4:]))
            (x1, y1), (x2, y2) = self.place(x, y), self.place(x + w, y + h)
            a, b, c, d, e, f = self.ctm
            high = abs((b * (x + w) + d * (y + h)) - (b * x + d * y))
            rect = (min(x1, x2), min(y1, y2), abs(x2 - x1), high)
            corners = [(rect[0], rect[1]), (rect[0] + rect[2], rect[1] + rect[3])]
            self.page.paths.append((rect, corners, [("re", [*rect])], True, False, self.line, _hex(self.stroke), _hex(self.fill)))
        elif op in (b"m", b"l"):
            p = self.place(*(float(v) for v in (args[:2] if self.parity else args[-2:])))
            if op == b"m":
                self.points, self.commands = [], []
            self.points.append(p)
            self.commands.append((op.decode(), [*p]))
        elif op in (b"c", b"v", b"y"):
            n = 6 if op == b"c" else 4
            v = [float(x) for x in (args[:n] if self.parity else args[-n:])]
            if len(v) < n:
                return
            ps = [self.place(*v[i : i + 2]) for i in range(0, n, 2)]
            if op == b"v":
                ps.insert(0, self.points[-1] if self.points else (0.0, 0.0))
            elif op == b"y":
                ps.append(ps[-1])
            self.points.append(ps[2])
            self.commands.append(("c", [x for p in ps for x in p]))
        elif op == b"h":
            self.commands.append(("h", []))
        elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
            fill, stroke = op[:1] in b"fFBb", op[:1] in b"SsBb"
            if self.commands:
                self.page.paths.append((None, self.points, self.commands, stroke, fill, self.line, _hex(self.stroke), _hex(self.fill) if fill else None))
            self.points, self.commands = [], []
        elif op in (b"rg", b"g", b"RG", b"G"):
            n = len(op) * 2 - 1
            v = [float(x) for x in (args[:n] if self.parity else args[-n:])]
            if len(v) == n:
                color = (v[0],) * 3 if n == 1 else tuple(v)
                if op in (b"rg", b"g"):
                    self.fill = color
                else:
                    self.stroke = color
        elif op == b"w":
            self.line = float(args[-1])


# --- files

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_STREAM = re.compile(rb"stream(?:\r\n|\n|\r)?")
META = ("title", "author", "subject", "creator", "producer", "pdf_version")


class File:
    """The objects of a file by number; the last one of a number counts."""

    def __init__(self, data: bytes, limits: Limits):
        self.data, self.limits = data, limits
        self.objects: dict[int, bytes] = {}
        self.order: list[int] = []
        starts = list(_OBJECT.finditer(data))
        for m, after in zip(starts, [*(s.start() for s in starts[1:]), len(data)]):
            end = data.find(b"endobj", m.end(), after)
            self.objects[int(m[1])] = data[m.end() : end if end >= 0 else after]
            self.order.append(int(m[1]))

    def stream(self, body: bytes) -> bytes | None:
        """The decoded stream of an object, if it has one."""
        m = _STREAM.search(body)
        if m is None:
            return None
        head, end = body[: m.start()], body.find(b"endstream", m.end())
        size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
        raw = body[m.end() : end if end >= 0 else len(body)]
        if size and m.end() + int(size[1]) <= len(body):
            raw = body[m.end() : m.end() + int(size[1])]
        return decode_stream(head, raw, self.limits)

    def refs(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(re.escape(key) + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def named_refs(self, body: bytes, key: bytes) -> list[tuple[str, int]]:
        """(name, object) of a dictionary, given in place or as an object of its own."""
        for n in self.refs(body, key):
            body, key = key + b" <<" + self.objects.get(n, b"") + b">>", key
        at = body.find(key)
        if at < 0:
            return []
        depth, end = 0, len(body)
        for m in re.compile(rb"<<|>>").finditer(body, at):
            depth += 1 if m[0] == b"<<" else -1
            if depth <= 0:
                end = m.end()
                break
        return [(a.decode("latin-1"), int(b)) for a, b in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", body[at + len(key) : end])]

    def fonts(self, resources: bytes) -> dict[str, Font]:
        out = {}
        for key, n in self.named_refs(resources, b"/Font"):
            body = self.objects.get(n, b"")
            maps = self.refs(body, b"/ToUnicode") or [r for d in self.refs(body, b"/DescendantFonts") for r in self.refs(self.objects.get(d, b""), b"/ToUnicode")]
            cmap = (self.stream(self.objects.get(maps[0], b"")) or b"") if maps else b""
            out[key] = Font(key, self.base_font(body), read_cmap(cmap.decode("latin-1")))
        if not out:  # dictionaries in place: the fonts of the file in order
            for m in re.finditer(rb"/BaseFont", self.data):
                if len(out) >= 65:
                    break
                cmap = re.search(rb"beginbfchar.*?endcmap", self.data[m.end() : m.end() + 8192], re.S)
                key = f"F{len(out) + 1}"
                out[key] = Font(key, self.base_font(self.data[m.start() : m.start() + 200]), read_cmap(cmap[0].decode("latin-1")) if cmap else {})
        return out

    @staticmethod
    def base_font(body: bytes) -> str:
        m = re.search(rb"/BaseFont\s*/?([^\s/<>\[\]()]+)", body)
        return m[1].decode("latin-1").replace("#20", " ") if m else "UnknownFont"

    def images(self, resources: bytes, page: Page) -> None:
        for name, n in self.named_refs(resources, b"/XObject"):
            body = self.objects.get(n, b"")
            if not re.search(rb"/Subtype\s*/Image\b", body) or not (m := _STREAM.search(body)):
                continue
            head = body[: m.start()]
            size = [int(s[1]) if (s := re.search(k + rb"\s+(\d+)", head)) else int(d) for k, d in ((rb"/Width", page.width), (rb"/Height", page.height))]
            end = body.find(b"endstream", m.end())
            data = body[m.end() : end if end >= 0 else len(body)].rstrip(b"\r\n ")
            page.images.append((f"page_{page.number}_{name}", *size, "image/jpeg" if b"/DCTDecode" in head else "image/png", data))

    def pages(self) -> list[Page]:
        out: list[Page] = []
        for n in self.order:
            body = self.objects[n]
            if not _PAGE.search(body):
                continue
            if len(out) >= self.limits.pages:
                raise LimitError(f"over {self.limits.pages} pages")
            box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", body)
            v = [float(x) for x in box.groups()] if box else [0.0, 0.0, 612.0, 792.0]
            page = Page(len(out) + 1, abs(v[2] - v[0]), abs(v[3] - v[1]))
            resources = b"".join([body, *(self.objects.get(r, b"") for r in self.refs(body, b"/Resources"))])
            run = Interpreter(page, self.fonts(resources), self.limits.parity)
            parts = [self.stream(self.objects.get(r, b"")) for r in self.refs(body, b"/Contents")]
            if _STREAM.search(body):
                parts = [self.stream(body)]
            elif self.limits.parity and re.search(rb"/Contents\s*\[", body):
                parts = []
            run.run(b"\n".join(p for p in parts if p))
            self.images(resources, page)
            out.append(page)
        if not out and self.limits.pages:  # no page objects: all streams on one page
            page = Page(1)
            run = Interpreter(page, {}, self.limits.parity)
            for m in re.finditer(rb"(?<!end)stream(?:\r\n|\n|\r)?(.*?)endstream", self.data, re.S):
                run.run(inflate(m[1], self.limits) or m[1])
            out.append(page)
        return out

    def meta(self) -> tuple:
        out = []
        for key in (b"/Title", b"/Author", b"/Subject", b"/Creator", b"/Producer"):
            m = re.search(re.escape(key) + rb"[^(]*?\(([^)]*)\)", self.data)
            out.append(m[1].decode("utf-8", "replace").strip() if m else None)
        return (*out, re.split(rb"[\r\n]", self.data, maxsplit=1)[0][:32].decode("latin-1").strip())


def parse(data: bytes | None, limits: Limits = Limits()) -> tuple[list[Page], tuple, str | None]:
    """(pages, values of META, error). With an error there are no pages."""
    none = (None,) * len(META)
    if not data or not data.startswith(b"%PDF-"):
        return [], none, "not a PDF"
    if len(data) > limits.file_bytes:
        return [], none, f"over {limits.file_bytes} bytes"
    if limits.pages < 1:
        return [], none, f"over {limits.pages} pages"
    try:
        file = File(data, limits)
        return file.pages(), file.meta(), None
    except LimitError as e:
        return [], none, str(e)


# --- frames

_d, _s, _b = T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


SPAN = _struct(span_idx=T.IntegerType(), text=_s, x=_d, y=_d, w=_d, h=_d, font_size=_d, font=_s, bold=_b, italic=_b, mono=_b, color=_s)
POINT = _struct(x=_d, y=_d)
PATH = _struct(path_idx=T.IntegerType(), rect=_struct(x=_d, y=_d, w=_d, h=_d), points=T.ArrayType(POINT), commands=T.ArrayType(_struct(op=_s, v=T.ArrayType(_d))), stroke=_b, fill=_b, stroke_width=_d, color=_s, fill_color=_s)
IMAGE = _struct(id=_s, width=T.IntegerType(), height=T.IntegerType(), mime=_s, data=T.BinaryType())
META_TYPE = _struct(**{k: _s for k in META})
HEAD = (("uid", T.LongType()), ("doc_id", T.LongType()), ("total_pages", T.IntegerType()), ("error", _s), ("meta", META_TYPE), ("page_number", T.IntegerType()), ("width", _d), ("height", _d))
PAGES = T.StructType([*(T.StructField(n, k) for n, k in HEAD), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("paths", T.ArrayType(PATH)), T.StructField("images", T.ArrayType(IMAGE))])


def numbered(docs: DataFrame) -> DataFrame:
    """uid, doc_id, content: a number for each row, so that rows with the same id stay apart; the id itself in streams."""
    number = F.col("doc_id").cast("long") if docs.isStreaming else F.monotonically_increasing_id()
    return docs.select(number.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))


def _spans_array(pages: list[Page | None], kind: pa.DataType) -> pa.Array:
    """Spans of the pages as a list array, column by column."""
    ends, flat, idx = [0], [], []
    for p in pages:
        n = len(p.spans) if p else 0
        if n:
            flat += p.spans
            idx += range(n)
        ends.append(len(flat))
    fields = list(kind.value_type)
    cols = list(zip(*flat)) if flat else [()] * (len(fields) - 1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip([idx, *cols], fields)], fields=fields))


def _path(i: int, p: tuple) -> dict:
    rect, points, commands, stroke, fill, width, color, fill_color = p
    return {"path_idx": i, "rect": dict(zip("xywh", rect)) if rect else None, "points": [{"x": a, "y": b} for a, b in points], "commands": [{"op": o, "v": v} for o, v in commands],
            "stroke": stroke, "fill": fill, "stroke_width": width, "color": color, "fill_color": fill_color}


def raw_page(page: Page) -> tuple[list, list]:
    """Values of the columns paths and images."""
    return [_path(i, p) for i, p in enumerate(page.paths)], [dict(zip(("id", "width", "height", "mime", "data"), x)) for x in page.images]


def parsed(docs: DataFrame, extra: T.StructType, values: Callable[[Page], tuple], limits: Limits, rows: int = 200, text_bytes: int = 8 << 20) -> DataFrame:
    """One row for each page, or for a document without pages: HEAD, spans and the columns of extra, which ``values``
    gives for a page (it may change the page's spans). Batches are cut by pages and by the size of the files."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*(T.StructField(n, k) for n, k in HEAD), T.StructField("spans", T.ArrayType(SPAN)), *extra])

    def run(batches):
        arrow = to_arrow_schema(schema)
        span_type = arrow.field("spans").type
        span_type = pa.list_(span_type.value_type)

        def batch(found):
            head = list(zip(*(f[0] for f in found)))
            own = list(zip(*(f[2] for f in found))) if len(extra) else []
            cols = [pa.array(c, f.type) for c, f in zip(head, arrow)] + [_spans_array([f[1] for f in found], span_type)]
            cols += [pa.array(c, f.type) for c, f in zip(own, list(arrow)[len(cols):])]
            return pa.RecordBatch.from_arrays(cols, names=arrow.names)

        found, size = [], 0
        none = (None,) * len(extra)
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist()
            for i, (uid, doc) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                pages, meta, error = parse(b.column(2)[i].as_py(), limits)
                meta = dict(zip(META, meta))
                if not pages:
                    found.append(((uid, doc, 0, error, meta, None, None, None), None, none))
                for p in pages:
                    own = values(p)
                    found.append(((uid, doc, len(pages), error, meta if p.number == 1 else None, p.number, p.width, p.height), p, own))
                size += lengths[i]
                if len(found) >= rows or size >= text_bytes:
                    yield batch(found)
                    found, size = [], 0
        if found:
            yield batch(found)

    return numbered(docs).mapInArrow(run, schema)


def read_pages(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs (doc_id, content) -> PAGES: one row for each page with its spans, paths and images; an error row else."""
    return parsed(docs, T.StructType(PAGES.fields[-2:]), raw_page, limits)


SPANS = ("doc_id", "page_number", "span_idx", "text", "x", "y", "w", "h", "font_size", "error")


def read_spans(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs (doc_id, content) -> SPANS; a page without spans has one row with null text, a broken document its error."""
    pages = parsed(docs, T.StructType([]), lambda p: (), limits)
    return pages.select("doc_id", "page_number", "error", F.explode_outer("spans").alias("s")).select("doc_id", "page_number", "s.span_idx", "s.text", "s.x", "s.y", "s.w", "s.h", "s.font_size", "error")


def capabilities(pages: DataFrame) -> DataFrame:
    """uid, doc_id, page_count, scanned_pages, digital_pages, total_images, requires_ocr of PAGES. Usable text: over 20 bytes."""
    chars = F.aggregate(F.transform("spans", lambda s: F.octet_length(s["text"])), F.lit(0), lambda a, x: a + x)
    images = F.coalesce(F.size(F.filter("images", lambda x: x.isNotNull())), F.lit(0))
    flagged = pages.withColumn("usable", F.coalesce(chars, F.lit(0)) > 20).withColumn("n", F.greatest(images, F.lit(0)))
    scanned = ~F.col("usable") & (F.col("n") > 0)
    return flagged.groupBy("uid", "doc_id").agg(F.count("page_number").alias("page_count"), F.count_if(scanned).alias("scanned_pages"), F.count_if("usable").alias("digital_pages"), F.sum("n").alias("total_images"), (F.count_if(scanned) > 0).alias("requires_ocr"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files under a path as (doc_id, path, content); doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def from_bytes(spark: SparkSession, *contents: bytes) -> DataFrame:
    """Bytes at hand, from a reader or standard input, as (doc_id, content)."""
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "doc_id long, content binary")


def synthesize(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, content): each line of text on a line of 90 characters at most, 45 a page."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                lines = [x[i : i + 90] for x in (t or "").split("\n") for i in range(0, max(1, len(x)), 90)]
                out.append(write_pdf([[(72, 720 - 15 * k, 18 if at == 0 and k == 0 else 12, x) for k, x in enumerate(lines[at : at + 45])] for at in range(0, max(1, len(lines)), 45)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, content binary")
