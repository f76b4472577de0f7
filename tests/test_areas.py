"""Distances, surfaces, unions, choices and bootstraps against plain Python on small cases."""

import hashlib
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelens.operators import areas as A
from tidelens.operators import skill

RING = "array<struct<x:double,y:double>>"


def rings(spark, shapes, group="a"):
    return spark.createDataFrame([(group, k, [(float(x), float(y)) for x, y in [*s, s[0]]]) for k, s in enumerate(shapes)], f"g string, id int, ring {RING}")


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


@pytest.mark.parametrize("size", [7.0, 50.0])
def test_union_of_boxes_and_bent_shapes(spark, size):
    """Of whole coordinates: unit squares are counted, overlaps once, by block; in either direction of the ring."""
    rnd = random.Random(2)
    shapes, cells = [], set()
    for k in range(40):
        x, y, w, h = rnd.randrange(-30, 60), rnd.randrange(-30, 60), 2 * rnd.randrange(1, 12), 2 * rnd.randrange(1, 12)
        bent = k % 3 == 0
        ring = [(x, y), (x + w, y), (x + w, y + h // 2), (x + w // 2, y + h // 2), (x + w // 2, y + h), (x, y + h)] if bent else box(x, y, w, h)
        shapes.append(ring[::-1] if k % 2 else ring)
        cells |= {(i, j) for i in range(x, x + w) for j in range(y, y + h) if not bent or i < x + w // 2 or j < y + h // 2}
    shapes += [shapes[0], shapes[1]]
    want = Counter((i // size, j // size) for i, j in cells)
    got = {(r.bx, r.by): r.area for r in A.union_areas(rings(spark, shapes), ["g"], size).collect() if r.area > 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("size", [3.0, 100.0])
def test_union_of_sloping_shapes(spark, size):
    total = lambda shapes: A.union_areas(rings(spark, shapes), ["g"], size).agg(F.sum("area")).first()[0]
    assert abs(total([[(0, 0), (10, 0), (0, 10)], [(0, 0), (10, 0), (10, 10)]]) - 75) < 1e-9
    assert abs(total([[(5, 0), (10, 5), (5, 10), (0, 5)], box(0, 0, 10, 5)]) - 75) < 1e-9
    star = [(10 * math.cos(a) * (1 if k % 2 else 0.4), 10 * math.sin(a) * (1 if k % 2 else 0.4)) for k, a in enumerate(math.pi / 5 * i for i in range(10))]
    own = abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(star, star[1:] + star[:1], strict=True))) / 2
    assert abs(total([star]) - own) < 1e-9 and abs(total([star, star]) - own) < 1e-9
    moved = [(x + 30, y) for x, y in star]
    assert abs(total([star, moved]) - 2 * own) < 1e-9


def test_no_shapes(spark):
    assert A.union_areas(rings(spark, [box(0, 0, 1, 1)]).limit(0), ["g"], 10.0).count() == 0


def gap(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    n = d[0] ** 2 + d[1] ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0.0
    return math.dist(p, (a[0] + t * d[0], a[1] + t * d[1]))


def test_distance_from_a_mask_at_any_distance(spark):
    rnd = random.Random(3)
    lines = [tuple(rnd.uniform(-50, 50) for _ in range(4)) for _ in range(12)] + [(5.0, 5.0, 5.0, 5.0)]
    squares = [box(rnd.uniform(-90, 90), rnd.uniform(-90, 90), 8, 5) for _ in range(4)]
    points = [(k, rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for k in range(60)] + [(100, 90_000.0, 3.0), (101, *squares[0][0]), (102, squares[1][0][0] + 1, squares[1][0][1] + 1)]
    sides = [(line[:2], line[2:]) for line in lines] + [(s[k], s[(k + 1) % 4]) for s in squares for k in range(4)]
    df = spark.createDataFrame([*points, (200, None, 1.0), (201, float("nan"), 1.0)], "k int, x double, y double")
    masks = spark.createDataFrame(lines, "x0 double, y0 double, x1 double, y1 double"), rings(spark, squares).select(F.col("id").alias("ring_id"), "ring")
    got = {r.k: r.d for r in A.mask_distance(df, *masks, "k", 5.0).collect()}
    assert got.pop(200) is None and got.pop(201) is None
    for k, x, y in points:
        within = any(s[0][0] <= x < s[2][0] and s[0][1] <= y < s[2][1] for s in squares)
        assert abs(got[k] - (0 if within else min(gap((x, y), a, b) for a, b in sides))) < 1e-9
    assert {r.d for r in A.mask_distance(df, masks[0].limit(0), masks[1].limit(0), "k", 5.0).collect()} == {None}


def test_depth_surface(spark):
    area = spark.createDataFrame([(0.0, 0.0, 200.0, 100.0)], "x0 double, y0 double, x1 double, y1 double")
    water = spark.createDataFrame([(0.0, 0.0, 0.0, 100.0)], "x0 double, y0 double, x1 double, y1 double")
    got = A.depth_surface(area, water, rings(spark, [box(0, 0, 1, 1)]).limit(0).select(F.col("id").alias("ring_id"), "ring"), 2.0, 30.0, 50.0, 0.05).collect()
    want = {(50.0 * i, 50.0 * j): 2 * math.exp(-50 * i / 30) for i in range(5) for j in range(3) if 2 * math.exp(-50 * i / 30) > 0.05}
    assert {(r.x, r.y) for r in got} == want.keys() and all(abs(r.depth_m - want[r.x, r.y]) < 1e-12 for r in got)


def test_choices_have_their_weights(spark):
    """Of many outings from one place, by squares of several sizes: counts within five deviations of the weights; reruns agree."""
    rnd = random.Random(4)
    spots = [(k, rnd.uniform(-4000, 9000), rnd.uniform(-4000, 4000)) for k in range(25)] + [(25, 100.0, 100.0), (26, 100.0, 100.0)]
    c = spark.createDataFrame([*spots, (99, None, 0.0)], "id int, x double, y double")
    n = 6000
    outings = spark.range(n).select(F.col("id").alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(3000.0).alias("preference"))
    weight = {k: math.exp(-(((math.hypot(x, y) - 3000) / 2500) ** 2)) for k, x, y in spots}
    total = sum(weight.values())
    for size, most in ((700.0, 4096), (500.0, 4)):
        got = {r.k: r.choice for r in A.chosen(outings, c, "k", 8, size=size, most=most).collect()}
        count = Counter(got.values())
        for k, w in weight.items():
            p = w / total
            assert abs(count[k] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1
        assert got == {r.k: r.choice for r in A.chosen(outings.repartition(7), c, "k", 8, size=size, most=most).collect()}
    odd = spark.createDataFrame([(1, None, 0.0, 5.0), (2, 0.0, 0.0, None)], "k long, x double, y double, preference double")
    assert {tuple(r) for r in A.chosen(odd, c, "k", 8).collect()} == {(1, None), (2, None)}
    assert {r.choice for r in A.chosen(outings.limit(3), c.limit(0), "k", 8).collect()} == {None}


def auc(pairs):
    pos, neg = [(s, w) for s, y, w in pairs if y == 1], [(s, w) for s, y, w in pairs if y == 0]
    won = sum(w * v * (1 if s > t else 0.5 if s == t else 0) for s, w in pos for t, v in neg)
    all_ = sum(w for _, w in pos) * sum(w for _, w in neg)
    return won / all_ if all_ else None


def test_bootstrap_by_definition(spark):
    rnd = random.Random(6)
    rows = [(i, j, rnd.choice([0, 1, -1]), float(rnd.randrange(6)), float(rnd.randrange(6))) for i in range(9) for j in range(7)]
    df = spark.createDataFrame([*rows, (50, 50, None, 1.0, 1.0)], "bi int, bj int, label int, a double, b double")
    got = {r.score: r for r in skill.block_bootstrap(df, ["a", "b"], "label", 4, 40, 9).collect()}
    known = [r for r in rows if r[2] >= 0]
    tiles = sorted({(r[0] // 4, r[1] // 4) for r in known})
    draws = {"a": [], "b": [], "difference": []}
    for d in range(40):
        times = Counter(tiles[int(int(hashlib.sha256(f"9|bootstrap|{d}/{s}".encode()).hexdigest()[:13], 16) / 2**52 * len(tiles))] for s in range(len(tiles)))
        values = [auc([(r[k], r[2], times[r[0] // 4, r[1] // 4]) for r in known]) for k in (3, 4)]
        for name, v in zip(draws, (*values, None if None in values else values[0] - values[1]), strict=True):
            draws[name] += [] if v is None else [v]
    whole = [auc([(r[k], r[2], 1) for r in known]) for k in (3, 4)]
    for name, v in zip(draws, (*whole, whole[0] - whole[1]), strict=True):
        cut = sorted(draws[name])
        at = lambda q: cut[int(q * (len(cut) - 1))] + (q * (len(cut) - 1) % 1) * (cut[min(int(q * (len(cut) - 1)) + 1, len(cut) - 1)] - cut[int(q * (len(cut) - 1))])  # noqa: B023, E731
        assert got[name].draws == len(cut) and all(abs(x - y) < 1e-9 for x, y in zip((got[name].auc, got[name].low, got[name].high), (v, at(0.025), at(0.975)), strict=True))
    assert statistics.pstdev(draws["a"]) > 0


def test_bootstrap_of_one_class(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.5)], "bi int, bj int, label int, a double")
    assert [tuple(r) for r in skill.block_bootstrap(df, ["a"], "label", 4, 5, 9).collect()] == [("a", None, None, None, 0)]
    assert skill.block_bootstrap(df.limit(0), ["a"], "label", 4, 5, 9).count() == 0
