"""Tables of a page and across pages, as folds over the page's elements. A page function sees one page; the frames at
the end run it in mapInArrow, one page a row.

A cell is (text, colspan, rowspan, align); a row is a list of cells; a table is a Table. Spans are tuples that begin with
(text, x, y, w, h), paths those of the parser. Pages without elements have no tables; texts are kept whole; ties in an
order go to the order of the page; null places don't occur in parsed pages and are left out of derived ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE, CLUSTER, COLUMN_GAP, RUN, FREE_SPANS = 4.0, 4.0, 12.0, 3, 6
SIMILAR, REPEATED = 0.70, 0.70


@dataclass
class Table:
    headers: list[list[tuple]]
    rows: list[list[tuple]]
    caption: str | None = None
    confidence: float = 0.95
    borders: bool = True
    box: tuple[float, float, float, float] | None = None
    spans: list[int] = field(default_factory=list)  # places of its spans on the page


def ruling_lines(paths) -> tuple[list[float], list[float]]:
    """Heights of the horizontal and places of the vertical lines: thin rectangles and straight segments."""
    across, down = [], []
    for rect, points, *_ in paths:
        if rect:
            x, y, w, h = rect
            if w > 20 and h <= 3:
                across.append(y)
            elif h > 20 and w <= 3:
                down.append(x)
            continue
        for (x1, y1), (x2, y2) in zip(points, points[1:]):
            dx, dy = abs(x1 - x2), abs(y1 - y2)
            if dy <= 2 and dx > 20:
                across.append(min(y1, y2))
            elif dx <= 2 and dy > 15:
                down.append(min(x1, x2))
    return across, down


def cluster(values: list[float], tolerance: float = CLUSTER) -> list[float]:
    """Sorted values; one within tolerance of the last place moves that place halfway to itself."""
    out: list[float] = []
    for v in sorted(values):
        if out and abs(v - out[-1]) <= tolerance:
            out[-1] = (out[-1] + v) / 2
        else:
            out.append(v)
    return out


def lattice(paths, spans, clean=str) -> list[Table]:
    """At most one table: the grid of the ruling lines, with the spans whose middle lies in a cell (borders count)."""
    across, down = ruling_lines(paths)
    if len(across) < 2 or len(down) < 2:
        return []
    ys, xs = cluster(across), cluster(down)
    if len(ys) < 2 or len(xs) < 2:
        return []
    middle = [(s[1] + s[3] / 2, s[2] + s[4] / 2) for s in spans]
    used: dict[int, None] = {}
    grid = []
    for top, bottom in zip(ys, ys[1:]):
        inside = [i for i, (_, y) in enumerate(middle) if top <= y <= bottom]
        row = []
        for left, right in zip(xs, xs[1:]):
            own = [i for i in inside if left <= middle[i][0] <= right]
            used.update(dict.fromkeys(own))
            row.append((clean(" ".join(spans[i][0] for i in own)), 1, 1, "left"))
        grid.append(row)
    return [Table(grid[:1], grid[1:], box=(xs[0], ys[0], xs[-1] - xs[0], ys[-1] - ys[0]), spans=list(used))]


def lines_by_anchor(spans, places) -> list[list[int]]:
    """Places of spans in lines: from the top, a span within LINE points of a line's first one belongs to it."""
    out: list[list[int]] = []
    for i in sorted(places, key=lambda i: spans[i][2]):
        if out and abs(spans[i][2] - spans[out[-1][0]][2]) <= LINE:
            out[-1].append(i)
        else:
            out.append([i])
    return [sorted(line, key=lambda i: spans[i][1]) for line in out]


def is_tabular(spans, line: list[int]) -> bool:
    """Two spans at least, and a gap of COLUMN_GAP points between neighbours."""
    return any(spans[b][1] - (spans[a][1] + spans[a][3]) >= COLUMN_GAP for a, b in zip(line, line[1:]))


def borderless(spans, used=(), clean=str) -> list[Table]:
    """Runs of RUN and more tabular lines among the spans that no other table has."""
    used = set(used)
    free = [i for i in range(len(spans)) if i not in used]
    if len(free) < FREE_SPANS:
        return []
    out, run = [], []
    for line in [*lines_by_anchor(spans, free), None]:
        if line is not None and is_tabular(spans, line):
            run.append(line)
            continue
        if len(run) >= RUN:
            cells = [[(clean(spans[i][0]), 1, 1, "left") for i in own] for own in run]
            out.append(Table(cells[:1], cells[1:], confidence=0.82, borders=False, spans=[i for own in run for i in own]))
        run = []
    return out


def balance(t: Table) -> Table:
    """Rows that span fewer columns than the widest give the rest to their last cell."""
    rows = [*t.headers, *t.rows]
    wide = max((sum(c[1] for c in r) for r in rows), default=0)

    def fill(r):
        rest = wide - sum(c[1] for c in r)
        return [*r[:-1], (r[-1][0], r[-1][1] + rest, *r[-1][2:])] if r and rest > 0 else r

    return replace(t, headers=[fill(r) for r in t.headers], rows=[fill(r) for r in t.rows])


def detect(paths, spans, clean=str) -> list[Table]:
    """The lattice first, runs of tabular lines among the rest, both balanced."""
    found = lattice(paths, spans, clean)
    found += borderless(spans, [i for t in found for i in t.spans], clean)
    return [balance(t) for t in found]


# --- stitching


def columns(t: Table) -> int:
    return len(t.headers[0]) if t.headers else len(t.rows[0]) if t.rows else 0


def _texts(row) -> list[str]:
    return [c[0].strip().lower() for c in row]


def header_similarity(a: Table, b: Table) -> float:
    """Share of header cells of which one text holds the other; 0 without headers of the same width."""
    if not a.headers or not b.headers or len(a.headers[0]) != len(b.headers[0]) or not a.headers[0]:
        return 0.0
    pairs = list(zip(_texts(a.headers[0]), _texts(b.headers[0])))
    return sum(x in y or y in x for x, y in pairs) / len(pairs)


def stitch_confidence(a: Table, b: Table, similar: float = SIMILAR) -> float:
    """0.60 for equal widths, more for alike or missing second headers and for boxes of nearly the same width, by the mean
    confidence."""
    if not columns(a) or columns(a) != columns(b):
        return 0.0
    score = 0.60
    if a.headers and b.headers:
        like = header_similarity(a, b)
        score += 0.30 * like if like >= similar else 0.0
    elif a.headers:
        score += 0.25
    if a.box and b.box and abs(a.box[2] - b.box[2]) < 50:
        score += 0.10
    return min(1.0, max(0.0, score * (a.confidence + b.confidence) / 2))


def can_stitch(a: Table, b: Table, similar: float = SIMILAR, headerless: bool = True) -> bool:
    if not columns(a) or columns(a) != columns(b):
        return False
    if b.headers:
        return header_similarity(a, b) >= similar or len(a.headers) == len(b.headers)
    return bool(b.rows) and headerless


def _repeats(header, row) -> bool:
    pairs = list(zip(_texts(header), _texts(row)))
    return len(header) == len(row) and bool(pairs) and sum(x == y != "" for x, y in pairs) / len(pairs) >= REPEATED


def stitch(a: Table, b: Table, parity: bool = False, similar: float = SIMILAR) -> Table | None:
    """One table of two, or None. A repeated header goes; another first row of b is data and stays, but not with parity."""
    if not can_stitch(a, b, similar):
        return None
    rows = list(b.rows)
    if not b.headers and rows and a.headers and _repeats(a.headers[0], rows[0]):
        rows = rows[1:]
    elif b.headers and not parity and not (header_similarity(a, b) >= similar and a.headers):
        rows = [*b.headers, *rows]
    box = a.box or b.box
    if a.box and b.box:
        box = (min(a.box[0], b.box[0]), min(a.box[1], b.box[1]), max(a.box[2], b.box[2]), a.box[3] + b.box[3])
    return Table(a.headers, [*a.rows, *rows], a.caption or b.caption, (a.confidence + b.confidence) / 2, a.borders or b.borders, box)


def stitch_list(nodes: list, parity: bool = False) -> list:
    """A list of tables and other things: neighbouring tables that fit become one, however many."""
    out: list = []
    for n in nodes:
        both = stitch(out[-1], n, parity) if out and isinstance(out[-1], Table) and isinstance(n, Table) else None
        if both:
            out[-1] = both
        else:
            out.append(n)
    return out


def stitch_sections(pages: list[list], parity: bool = False) -> list[list]:
    """A table at the end of a page takes the one at the beginning of the next. Chains over pages that hold nothing else;
    with parity only pairs, as a page whose table was taken ends the chain."""
    pages = [list(p) for p in pages]
    at = 0  # the page that holds the open table
    for k in range(1, len(pages)):
        last = pages[at][-1] if pages[at] else None
        first = pages[k][0] if pages[k] else None
        both = stitch(last, first, parity) if isinstance(last, Table) and isinstance(first, Table) else None
        if both:
            pages[at][-1] = both
            pages[k] = pages[k][1:]
        if not both or pages[k] or parity:
            at = k
    return pages


# --- frames

CELL = "struct<text: string, colspan: int, rowspan: int, align: string>"
TABLES = f"table_idx int, headers array<array<{CELL}>>, rows array<array<{CELL}>>, confidence double, borders boolean, spans array<int>"
_CELL = pa.struct([("text", pa.string()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("align", pa.string())])


def cells(rows) -> list:
    return [[dict(zip(("text", "colspan", "rowspan", "align"), c)) for c in r] for r in rows]


def page_tables(pages: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """pages (key, spans, paths as in the parser's frame) -> key and TABLES, one row for each table of a page. No shuffle."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*key).schema)

    def run(batches):
        for b in batches:
            keep, out = [], [[] for _ in range(6)]
            for i, (spans, paths) in enumerate(zip(b.column(len(key)).to_pylist(), b.column(len(key) + 1).to_pylist())):
                ss = [(s["text"] or "", s["x"], s["y"], s["w"], s["h"]) for s in spans or ()]
                pp = [(tuple(p["rect"].values()) if p["rect"] else None, [(q["x"], q["y"]) for q in p["points"] or ()]) for p in paths or ()]
                for k, t in enumerate(detect(pp, ss)):
                    keep.append(i)
                    for o, v in zip(out, (k, cells(t.headers), cells(t.rows), t.confidence, t.borders, t.spans)):
                        o.append(v)
            own = [b.column(i).take(pa.array(keep, pa.int64())) for i in range(len(key))]
            types = (pa.int32(), pa.list_(pa.list_(_CELL)), pa.list_(pa.list_(_CELL)), pa.float64(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(o, t) for o, t in zip(out, types))], names=[*key, "table_idx", "headers", "rows", "confidence", "borders", "spans"])

    return pages.select(*key, "spans", "paths").mapInArrow(run, f"{kinds}, {TABLES}")


def without_tables(spans: DataFrame, tables: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The spans (key, span_idx) that no table has. Joined by page, so spans that lie together already stay where they are. Both
    sides are dealt out: their sizes, guessed behind a map over pages, are far too small, and Spark would send all used spans
    through the driver."""
    used = tables.groupBy(*(F.col(k).alias(f"used_{k}") for k in key)).agg(F.flatten(F.collect_list("spans")).alias("used_spans"))
    on = [F.col(k) == F.col(f"used_{k}") for k in key]
    return spans.join(used.hint("merge"), [*on, F.array_contains("used_spans", F.col("span_idx"))], "left_anti")
