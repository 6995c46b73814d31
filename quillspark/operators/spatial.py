"""Rectangles and points as columns, and joins of boxes on a page.

A box is four columns x, y, w, h (w and h of at least 0), y growing downwards; touching counts as meeting. Joins always
go by the columns of key first, so boxes meet only those of their own page. Boxes with a null place meet nothing; ties go
as stated; other columns of the left side stay, those of the right get the prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x", "y", "w", "h")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of the columns with a prefix."""
    x, y, w, h = (F.col(prefix + c) for c in BOX)
    zero = F.lit(0.0)
    return x, y, x + F.greatest(w, zero), y + F.greatest(h, zero)


def center(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersects(a, b) -> Column:
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def contains(a, b) -> Column:
    """b lies within a."""
    return (b[0] >= a[0]) & (b[2] <= a[2]) & (b[1] >= a[1]) & (b[3] <= a[3])


def contains_point(a, x: Column, y: Column) -> Column:
    return x.between(a[0], a[2]) & y.between(a[1], a[3])


def horizontal_overlap(a, b) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))


def vertical_overlap(a, b) -> Column:
    return F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def overlap_share(a, b) -> Column:
    """Intersection by union; 0 for two empty boxes."""
    both = horizontal_overlap(a, b) * vertical_overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def union_box(a, b) -> tuple[Column, Column, Column, Column]:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def distance_to_point(a, x: Column, y: Column) -> Column:
    """0 inside."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(a[0] - x, x - a[2], zero), F.greatest(a[1] - y, y - a[3], zero)
    return F.sqrt(dx * dx + dy * dy)


def same_line(y1: Column, y2: Column, angle1: Column, angle2: Column, tolerance: float) -> Column:
    """Two baselines go on from one another."""
    return (F.abs(y1 - y2) <= tolerance) & (F.abs(angle1 - angle2) <= 0.05)


def is_dark(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b < 0.5


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of parts from 0 to 1, cut to that range."""
    part = lambda c: F.lpad(F.lower(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255 + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


#: Cells of the grid have sides of powers of 4. Sides of boxes below the least of them count as that; those that aren't finite
#: are of a level that has one cell only.
_LEAST, _WHOLE = -20, 600
_INF = float("inf")


def _level(low: Column, high: Column) -> Column:
    """The exponent of a power of 4 above high - low, so that the side from low to high lies in two cells at most."""
    size = high - low
    k = F.greatest(F.ceil(F.log(4.0, size)), F.lit(_LEAST)).cast("int")
    return F.when((size < _INF) & (F.abs(low) < _INF), F.when(F.pow(F.lit(4.0), k) > size, k).otherwise(k + 1)).otherwise(_WHOLE)


def _cell(v: Column, level: Column) -> Column:
    return F.when(level == _WHOLE, F.lit(0).cast("long")).otherwise(F.floor(v / F.pow(F.lit(4.0), level)).cast("long"))


def _side(low: Column, high: Column, own: Column, others: Column, first: bool) -> Column:
    """The cells of a side: at its own level, where the other frame has sides of a lower one, and at each level that the other frame
    has above its own. Codes are even where the first frame's side is of the level itself; so equal levels meet once."""
    at = lambda k, odd: F.struct(k.alias("k"), (k * 2 + odd).alias("code"))
    here = F.when(F.exists(others, lambda k: k <= own if first else k < own), F.array(at(own, 0 if first else 1))).otherwise(F.array().cast("array<struct<k: int, code: int>>"))
    levels = F.concat(here, F.transform(F.filter(others, lambda k: k > own if first else k >= own), lambda k: at(k, 1 if first else 0)))
    return F.flatten(F.transform(levels, lambda v: F.transform(F.array_distinct(F.array(_cell(low, v["k"]), _cell(high, v["k"]))), lambda c: F.struct(v["k"].alias("k"), v["code"].alias("code"), c.alias("c")))))


def _meeting(left: DataFrame, right: DataFrame, key: tuple[str, ...], prefix: str, a, b) -> DataFrame:
    """Pairs of rows of a page, each once: all whose rectangles a and b (x0, y0, x1, y1 over columns without and with the prefix)
    meet, and few others. A pair is looked for at the higher of its two levels, across and down, and taken in the cell that holds
    the upper left corner of what they share. Joined by cells, dealt out: Spark's guesses of sizes don't know the copies."""
    right = right.withColumnsRenamed({c: prefix + c for c in right.columns if c not in key})
    names = [*key, *(c for c in left.columns if c not in key), *(c for c in right.columns if c not in key)]

    def placed(d, rect, tag):
        d = d.withColumn(f"grid_{tag}", F.struct(*(c.cast("double").alias(n) for c, n in zip(rect, ("x0", "y0", "x1", "y1")))))
        g = F.col(f"grid_{tag}")
        d = d.where(F.forall(F.array(*(g[n] for n in ("x0", "y0", "x1", "y1"))), lambda v: v.isNotNull()))
        return d.withColumns({f"grid_{tag}x": _level(g["x0"], g["x1"]), f"grid_{tag}y": _level(g["y0"], g["y1"])})

    one, two = placed(left, a, "a"), placed(right, b, "b")

    def dealt(d, other, tag, otag):
        has = other.agg(F.collect_set(f"grid_{otag}x").alias("grid_hx"), F.collect_set(f"grid_{otag}y").alias("grid_hy"))
        d, g = d.crossJoin(F.broadcast(has)), F.col(f"grid_{tag}")
        for s in "xy":
            d = d.withColumn(f"grid_{s}", F.explode(_side(g[s + "0"], g[s + "1"], F.col(f"grid_{tag}{s}"), F.col(f"grid_h{s}"), tag == "a")))
            d = d.withColumns({f"grid_code{s}": F.col(f"grid_{s}.code"), f"grid_cell{s}": F.col(f"grid_{s}.c"), f"grid_level{s}": F.col(f"grid_{s}.k")})
        gone = [f"grid_{x}" for x in ("x", "y", "hx", "hy", tag + "x", tag + "y")]
        return d.drop(*gone, *(["grid_levelx", "grid_levely"] if tag == "b" else []))

    pairs = dealt(one, two, "a", "b").join(dealt(two, one, "b", "a").hint("merge"), [*key, "grid_codex", "grid_codey", "grid_cellx", "grid_celly"])
    here = [_cell(F.greatest(F.col(f"grid_a.{s}0"), F.col(f"grid_b.{s}0")), F.col(f"grid_level{s}")) == F.col(f"grid_cell{s}") for s in "xy"]
    return pairs.where(here[0] & here[1]).select(*names)


def query_intersecting(queries: DataFrame, items: DataFrame, key: tuple[str, ...], prefix: str = "item_") -> DataFrame:
    """Each query box with each item box of its page that it meets."""
    a, b = box(), box(prefix)
    return _meeting(queries, items, key, prefix, a, b).where(intersects(a, b))


def query_contained(queries: DataFrame, items: DataFrame, key: tuple[str, ...], prefix: str = "item_") -> DataFrame:
    """Each query box with each item box of its page that lies within it."""
    a, b = box(), box(prefix)
    return _meeting(queries, items, key, prefix, a, b).where(contains(a, b))


def _best(pairs: DataFrame, key: tuple[str, ...], distance: Column, last: bool, prefix: str) -> DataFrame:
    """The first pair of each query (id); pairs without a distance come last."""
    number = F.col(prefix + "id")
    order = Window.partitionBy(*key, "id").orderBy(F.col("distance").asc_nulls_last(), number.desc_nulls_last() if last else number.asc_nulls_last())
    return pairs.withColumn("distance", distance).withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def _reach(most: float, v: Column) -> Column:
    """``most`` and what rounding may add."""
    return most + (F.abs(v) + abs(most)) * 1e-9


def nearest_below(queries: DataFrame, items: DataFrame, key: tuple[str, ...], most: float, prefix: str = "item_") -> DataFrame:
    """For each query (id) the nearest item below it that shares a strip with it, at most ``most`` away; the last id on ties."""
    a, b = box(), box(prefix)
    gap = b[1] - a[3]
    pairs = _meeting(queries, items, key, prefix, (a[0], a[3], a[2], a[3] + _reach(most, a[3])), (b[0], b[1], b[2], b[1]))
    return _best(pairs.where((gap >= 0) & (gap <= most) & (horizontal_overlap(a, b) > 0)), key, gap, True, prefix)


def nearest_above(queries: DataFrame, items: DataFrame, key: tuple[str, ...], most: float, prefix: str = "item_") -> DataFrame:
    """The same above."""
    a, b = box(), box(prefix)
    gap = a[1] - b[3]
    pairs = _meeting(queries, items, key, prefix, (a[0], a[1] - _reach(most, a[1]), a[2], a[1]), (b[0], b[3], b[2], b[3]))
    return _best(pairs.where((gap >= 0) & (gap <= most) & (horizontal_overlap(a, b) > 0)), key, gap, True, prefix)


#: Cells across and down a page in which nearest middles are looked for, and cells of them in one of the first look.
_FINE, _STEP = 256, 4


def _bounds(b, x: Column, y: Column):
    """The least and the greatest distance from a point to what lies in b; computed like the distances, so rounding keeps the order."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(b["x0"] - x, x - b["x1"], zero), F.greatest(b["y0"] - y, y - b["y1"], zero)
    fx, fy = F.greatest(F.abs(b["x0"] - x), F.abs(b["x1"] - x)), F.greatest(F.abs(b["y0"] - y), F.abs(b["y1"] - y))
    return F.sqrt(dx * dx + dy * dy), F.sqrt(fx * fx + fy * fy)


def _near(d: DataFrame, least: Column | None = None) -> DataFrame:
    """Rows with a point and an array of cells -> a row for each cell that may hold the item nearest to it: near, with its bounds low
    and high, and least, by which the nearest is known to lie. The array is gone through once a point."""
    def bound(c):
        low, high = _bounds(c, F.col("x"), F.col("y"))
        return F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"), low.alias("low"), high.alias("high"))

    d = d.withColumn("near", F.transform("cells", bound)).drop("cells")
    d = d.withColumn("least", F.array_min("near.high") if least is None else F.least(F.array_min("near.high"), least))
    return d.withColumn("near", F.explode("near")).where(_may(F.col("near.low"), F.col("least")))


def _may(low: Column, least: Column) -> Column:
    """Whether a cell from a distance on may hold the nearest, if one is known at ``least``. Without a distance: last."""
    return F.coalesce(~(low > least) | F.isnan(low), least.isNull())


def nearest_to_point(points: DataFrame, items: DataFrame, key: tuple[str, ...], prefix: str = "item_") -> DataFrame:
    """For each point (id, x, y) the item whose middle is nearest; the first id on ties.

    Equal points, and equal middles, are looked at once. A page's middles lie in 256 times 256 cells with tight bounds; a point
    takes the cells of 16 times 16 that may hold the nearest, then the cells in them, then the middles there.
    """
    x, y, number = F.col("x"), F.col("y"), prefix + "id"
    right = items.withColumnsRenamed({c: prefix + c for c in items.columns if c not in key})
    mx, my = center(box(prefix))
    distance = lambda a, b: F.sqrt((a - x) * (a - x) + (b - y) * (b - y))
    middles = right.groupBy(*key, mx.alias("mx"), my.alias("my")).agg(F.min(number).alias(number))
    finite = {n: F.when(F.abs(F.col(n)) < _INF, F.col(n)) for n in ("mx", "my")}
    ends = middles.groupBy(*key).agg(*(f(finite[n]).alias(f"{n}_{e}") for n in finite for e, f in (("from", F.min), ("to", F.max))))

    def cell(n):
        part = (F.col(n) - F.col(n + "_from")) / F.nullif(F.col(n + "_to") - F.col(n + "_from"), F.lit(0.0))
        inner = F.coalesce(F.least(F.greatest(F.floor(part * _FINE).cast("long"), F.lit(0)), F.lit(_FINE - 1)), F.lit(0)).cast("int")
        return F.when(F.col(n).isNull() | F.isnan(n), -1).otherwise(inner)

    middles = middles.join(ends.hint("merge"), list(key)).select(*key, "mx", "my", number, cell("mx").alias("cx"), cell("my").alias("cy"))
    tight = lambda a: [f(c).alias(n) for n, f, c in zip(("x0", "x1", "y0", "y1"), (F.min, F.max) * 2, a)]
    fine = middles.groupBy(*key, "cx", "cy").agg(*tight(("mx", "mx", "my", "my"))).withColumns({"gx": F.shiftright("cx", _STEP), "gy": F.shiftright("cy", _STEP)})
    member = F.struct("cx", "cy", "x0", "x1", "y0", "y1")
    fine = fine.groupBy(*key, "gx", "gy").agg(*tight(("x0", "x1", "y0", "y1")), F.collect_list(member).alias("cells"))
    coarse = fine.groupBy(*key).agg(F.collect_list(F.struct(F.col("gx").alias("cx"), F.col("gy").alias("cy"), "x0", "x1", "y0", "y1")).alias("cells"))

    asked = points.select(*key, "x", "y").distinct()
    look = _near(asked.join(coarse.hint("merge"), list(key)))
    look = look.select(*key, "x", "y", "least", F.col("near.cx").alias("gx"), F.col("near.cy").alias("gy"))
    look = _near(look.join(fine.select(*key, "gx", "gy", "cells").hint("merge"), [*key, "gx", "gy"]), F.col("least"))
    every = Window.partitionBy(*key, "x", "y")
    look = look.select(*key, "x", "y", "near.*").withColumn("least", F.min("high").over(every)).where(_may(F.col("low"), F.col("least")))
    found = look.select(*key, "x", "y", "cx", "cy").join(middles.hint("merge"), [*key, "cx", "cy"])
    found = found.withColumn("rank_", F.row_number().over(every.orderBy(distance(F.col("mx"), F.col("my")).asc_nulls_last(), F.col(number).asc_nulls_last()))).where("rank_ = 1")

    def back(left, other, by):
        other = other.withColumnsRenamed({c: f"found_{c}" for c in by})
        on = [F.col(c).eqNullSafe(F.col(f"found_{c}")) for c in by]
        return left.join(other.hint("merge"), on).drop(*(f"found_{c}" for c in by))

    pairs = back(points, found.select(*key, "x", "y", F.col(number).alias("nearest_")), [*key, "x", "y"])
    pairs = pairs.join(right.withColumn("nearest_", F.col(number)).hint("merge"), [*key, "nearest_"])
    names = [*key, *(c for c in points.columns if c not in key), *(c for c in right.columns if c not in key)]
    return _best(pairs.select(*names), key, distance(mx, my), False, prefix)
