"""Joins of boxes against all pairs of a page."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import spatial

PAGE = ("page",)


def box_joins():
    """name: the operator, its pairs by all pairs, the distance of which the least stays. Boxes with a null place meet nothing."""
    a, b = spatial.box(), spatial.box("item_")
    strip = (spatial.horizontal_overlap(a, b) > 0) & a[0].isNotNull() & b[0].isNotNull()
    below, above = b[1] - a[3], a[1] - b[3]
    return {
        "nearest_above": (lambda p, q: spatial.nearest_above(p, q, PAGE, 40.0), (above >= 0) & (above <= 40) & strip, above),
        "query_intersecting": (lambda p, q: spatial.query_intersecting(p, q, PAGE), spatial.intersects(a, b), None),
        "nearest_below": (lambda p, q: spatial.nearest_below(p, q, PAGE, 40.0), (below >= 0) & (below <= 40) & strip, below),
        "query_contained": (lambda p, q: spatial.query_contained(p, q, PAGE), spatial.contains(a, b), None),
    }


NAMES = ["nearest_above", "query_intersecting", "nearest_below", "query_contained"]


def boxes(spark, n, seed):
    """Boxes of all sizes, some with a null, endless or huge place or side."""
    r, out = random.Random(seed), []
    for k in range(n):
        place = lambda: r.choice([r.uniform(-50, 50), float(r.randrange(-20, 20)), 0.0, 16.0])
        side = lambda: r.choice([0.0, 1.0, 4.0, 16.0, 64.0, 500.0, r.uniform(0, 30), r.uniform(0, 0.01)])
        b = [place(), place(), side(), side()]
        if r.random() < 0.2:
            b[r.randrange(1, 4)] = r.choice([float("inf"), float("nan"), None, 1e300, 1e18])
        out.append((r.randrange(2), k, *b))
    return spark.createDataFrame(out, "page int, id int, x double, y double, w double, h double")


@pytest.mark.parametrize("name", NAMES)
def test_equals_all_pairs(spark, name):
    run, holds, distance = box_joins()[name]
    left, right = boxes(spark, 150, 1), boxes(spark, 200, 2)
    want = left.join(right.withColumnsRenamed({c: "item_" + c for c in right.columns if c != "page"}), "page").where(holds)
    want = want if distance is None else spatial._best(want, PAGE, distance, True, "item_")
    got = run(left, right)
    assert got.columns == want.columns
    assert (found := sorted(map(str, got.select("page", "id", "item_id").collect()))) == sorted(map(str, want.select("page", "id", "item_id").collect())) and found


@pytest.mark.parametrize("name", NAMES)
def test_boxes_far_apart_are_no_pairs(spark, name):
    """A page of 60,000 boxes side by side is joined by cells, not by the page alone."""
    d = spark.range(60_000).select(F.lit(1).alias("page"), "id", (F.col("id") * 20.0).alias("x"), (F.col("id") % 2 * 20.0).alias("y"), F.lit(8.0).alias("w"), F.lit(8.0).alias("h"))
    run, _, distance = box_joins()[name]
    plan = run(d, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "grid_cellx" in plan and "grid_celly" in plan
    assert run(d, d).count() == (60_000 if distance is None else 0)


def test_nearest_to_point_equals_all_pairs(spark):
    """In plain Python; clusters, copies, ties, far points; pages of one place only, without places, without items."""
    r = random.Random(4)
    at = lambda: r.choice([r.uniform(-50, 50), float(r.randrange(-9, 9)), r.uniform(0, 0.001), 1e6])
    items = [(r.randrange(3), k, at(), at(), r.choice([0.0, 2.0]), 1.0) for k in range(500)] + [(7, k, None, None, 1.0, 1.0) for k in (901, 900)] + [(8, k, 5.0, 5.0, 1.0, 1.0) for k in range(700, 800)]
    items += [(p, 990 + p, None, 1.0, 1.0, 1.0) for p in range(3)]
    points = [(r.choice([0, 1, 2, 7, 8, 9]), k, at(), at()) for k in range(200)]
    got = spatial.nearest_to_point(spark.createDataFrame(points, "page int, id int, x double, y double"), spark.createDataFrame(items, "page int, id int, x double, y double, w double, h double"), PAGE)
    middle = lambda a, size: (a + (a + size)) / 2

    def distance(x, y, i):
        return float("inf") if i[2] is None or i[3] is None else ((middle(i[2], i[4]) - x) ** 2 + (middle(i[3], i[5]) - y) ** 2) ** 0.5

    want = {(p, k): min((distance(x, y, i), i[1]) for i in items if i[0] == p) for p, k, x, y in points if p != 9}
    assert {(g.page, g.id): (float("inf") if g.distance is None else g.distance, g.item_id) for g in got.collect()} == want


def test_nearest_to_point_looks_at_few_items(spark):
    d = spark.range(1000).select(F.lit(1).alias("page"), "id", (F.col("id") * 20.0).alias("x"), F.lit(0.0).alias("y"), F.lit(8.0).alias("w"), F.lit(8.0).alias("h"))
    plan = spatial.nearest_to_point(d.select("page", "id", "x", "y"), d, PAGE)._jdf.queryExecution().optimizedPlan().toString()
    assert "cx" in plan and "cy" in plan
