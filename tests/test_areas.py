"""Boolean operations on areas against known measures and point tests."""

import math
import random

import pytest

from quadloom.operators import areas


def ring(points):
    return [(*map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1], strict=True)]


def square(x, y, side):
    return ring([(x, y), (x + side, y), (x + side, y + side), (x, y + side)])


def frame(spark, shapes):
    rows = [(k, *e) for k, shape in enumerate(shapes) for e in shape]
    return spark.createDataFrame(rows, "area long, x1 double, y1 double, x2 double, y2 double")


def size(df):
    return areas.measure(df).first().area


def test_dissolve_and_intersection_of_squares(spark):
    shapes = [square(0, 0, 4), square(2, 2, 4), square(6, 2, 4), square(20, 0, 2)]  # two overlap, two share a side, one is apart
    assert size(areas.dissolved(frame(spark, shapes), 3.0)) == pytest.approx(16 + 16 - 4 + 16 + 4)
    assert size(areas.intersection(frame(spark, shapes[:1]), frame(spark, shapes[1:]), 3.0)) == pytest.approx(4)
    holed = [square(0, 0, 10) + square(2, 2, 6)]
    assert size(areas.dissolved(frame(spark, holed), 3.0)) == pytest.approx(64)
    assert size(areas.intersection(frame(spark, holed), frame(spark, [square(1, 1, 4)]), 3.0)) == pytest.approx(16 - 9)
    assert areas.intersection(frame(spark, shapes[:1]), frame(spark, shapes[3:]), 3.0).isEmpty()


def inside(edges, x, y):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1


def test_results_agree_with_points(spark):
    rnd = random.Random(3)
    star = lambda cx, cy, r: ring([(cx + r * rnd.uniform(0.4, 1) * math.cos(i / 9 * 2 * math.pi), cy + r * rnd.uniform(0.4, 1) * math.sin(i / 9 * 2 * math.pi)) for i in range(9)])
    one, other = [star(0, 0, 10), star(6, 3, 9)], [star(3, -4, 10)]
    union = [tuple(r) for r in areas.dissolved(frame(spark, one + other), 4.0).collect()]
    both = [tuple(r) for r in areas.intersection(frame(spark, one), frame(spark, other), 4.0).collect()]
    for _ in range(300):
        x, y = rnd.uniform(-12, 18), rnd.uniform(-15, 15)
        a, b = any(inside(s, x, y) for s in one), inside(other[0], x, y)
        assert inside(union, x, y) == (a or b) and inside(both, x, y) == (a and b)


def test_buffer(spark):
    for quarter, shapes in ((16, [square(0, 0, 10)]), (4, [square(0, 0, 10)])):
        got = size(areas.buffered(frame(spark, shapes), 2.0, 5.0, quarter))
        corner = quarter * 4 / 2 * math.sin(2 * math.pi / (4 * quarter)) * 4  # a regular polygon of 4 x quarter corners
        assert got == pytest.approx(100 + 4 * 20 + corner, rel=1e-6)
    ringed = [square(0, 0, 10) + square(4, 4, 2)]
    assert size(areas.buffered(frame(spark, ringed), 2.0, 5.0)) == pytest.approx(100 + 80 + 16 * 2 * math.sin(math.pi / 32) * 4, rel=1e-6)


def test_empty(spark):
    none = spark.createDataFrame([], "area long, x1 double, y1 double, x2 double, y2 double")
    assert areas.dissolved(none, 1.0).isEmpty() and areas.buffered(none, 1.0, 1.0).isEmpty()
