"""Steps whose work or memory once grew faster than the input."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from tidelens.operators import areas as A
from tidelens.operators import network as N
from tidelens.operators import places as P
from tidelens.operators import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, n=50):
    return spark.createDataFrame([(float(k), 0.0, k + 40.0, 9.0) for k in range(n)], "x0 double, y0 double, x1 double, y1 double")


def test_bucketed_rows_are_not_broadcast(spark):
    """F8: the estimate of exploded rows is that of the rows before, so a driver would have to hold them."""
    points = spark.createDataFrame([(k, float(k), 1.0) for k in range(50)], "k int, x double, y double")
    assert "Broadcast" not in plan(P.line_distance(points, lines(spark), 5.0, "k"))


def test_sides_in_blocks_are_not_broadcast(spark):
    """the same for the sides of shapes, which meet each other and their slabs in blocks."""
    shapes = spark.createDataFrame([(k, [(0.0, 0.0), (9.0 + k, 0.0), (9.0, 9.0), (0.0, 0.0)]) for k in range(5)], "id int, ring array<struct<x:double,y:double>>")
    assert "Broadcast" not in plan(A.union_areas(shapes, [], 5.0))


def test_ways_are_not_broadcast(spark):
    """an edge table needs the class of every way, so a driver would have to hold them all."""
    w = spark.range(50).withColumnRenamed("id", "k").selectExpr("concat('w', k) as way_id", "'primary' as highway", "array(named_struct('x', cast(k as double), 'y', 0D), named_struct('x', cast(k as double), 'y', 9D)) as points")
    edges = N.edge_table(w, "way_id")
    assert "Broadcast" not in plan(edges) and edges.count() == w.count()


def test_far_points_meet_few_things(spark):
    """pairs measured for points far from everything; the answers are brute force's, ties by id."""
    rnd = random.Random(5)
    spots = [(k, 50.0 * (k % 10), 50.0 * (k // 10)) for k in range(2000)]
    points = [(k, rnd.choice([-3e5, 2e4, 7e6]), rnd.uniform(-1e5, 2e5)) for k in range(60)] + [(100 + k, 25.0 + 50 * k, 75.0) for k in range(5)]
    pairs = spark.sparkContext.accumulator(0)

    @F.udf(Y.DoubleType())
    def distance(x, y, lx, ly):
        pairs.add(1)
        return math.hypot(x - lx, y - ly)

    things = spark.createDataFrame(spots, "id int, lx double, ly double").select("*", F.col("lx").alias("hx"), F.col("ly").alias("hy"))
    p = spark.createDataFrame(points, "k int, x double, y double")
    got = {r.k: (r.d, r.id) for r in P.closest(p, things, "k", "id", distance("x", "y", "lx", "ly"), 100.0).collect()}
    assert got == {k: min((math.hypot(x - a, y - b), n) for n, a, b in spots) for k, x, y in points}
    assert pairs.value < 40 * len(points)


def test_many_points_at_one_place(spark):
    """a place is searched for once, and all its points get the answer."""
    points = spark.range(500).select(F.col("id").alias("k"), F.lit(3.0).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    others = spark.createDataFrame([(4, 0.0, 0.0), (2, 0.0, 0.0), (9, 6.0, 1.0)], "o int, x double, y double")
    got = P.nearest_any(points, others, 100.0, "k", "o")
    assert {(r.k, r.other) for r in got.collect()} == {(k, 9 if k % 2 else 2) for k in range(500)}


@pytest.mark.parametrize("peak", [2.0, 0.01])
def test_surface_asks_only_within_reach(spark, peak, monkeypatch):
    """depths above the least lie within a reach, so one join of that size does, not one of ever larger buckets."""
    asked = []
    monkeypatch.setattr(A, "line_distance", lambda p, m, cutoff, key: asked.append(cutoff) or P.line_distance(p, m, cutoff, key))
    area = spark.createDataFrame([(0.0, 0.0, 4000.0, 100.0)], "x0 double, y0 double, x1 double, y1 double")
    rings = spark.createDataFrame([], "ring_id int, ring array<struct<x:double,y:double>>")
    got = A.depth_surface(area, lines(spark, 1), rings, peak, 30.0, 50.0, 0.05).collect()
    want = [(x, y) for x in range(0, 4001, 50) for y in (0, 50, 100) if peak * math.exp(-(math.hypot(max(x - 40, 0), max(y - 9, 0)) if x >= 40 else 0) / 30) > 0.05 and (x >= 40 or x == 0)]
    assert peak < 0.05 or len(asked) == 1
    assert {(r.x, r.y) for r in got} >= {(x, y) for x, y in want if y == 0 and x >= 50} and (got or peak < 0.05)


def test_overlaps_with_ways_of_one_and_many_intervals(spark):
    """ways within others, equal ones, and one of two intervals on a line, against brute force; ways of one interval are not added up by pairs."""
    rnd = random.Random(8)
    ways = [[f"w{k:02d}", [(float(a), 7.0), (float(a + n), 7.0)]] for k in range(60) for a, n in [(rnd.randrange(90), rnd.randrange(1, 40))]]
    ways[30][1] = [(0.0, 7.0), (15.0, 7.0), (15.0, 9.0), (30.0, 9.0), (30.0, 7.0), (60.0, 7.0)]
    segs = [(k, float(a), 7.0, float(a + n), 7.0) for k in range(80) for a, n in [(rnd.randrange(110), rnd.randrange(1, 30))]]
    df = spark.createDataFrame(segs, "id int, x0 double, y0 double, x1 double, y1 double")
    w = spark.createDataFrame(ways, "way_id string, points array<struct<x:double,y:double>>")
    want = {}
    for k, x0, _, x1, _ in segs:
        shared = [(-sum(max(0.0, min(x1, max(p[0], q[0])) - max(x0, min(p[0], q[0]))) for p, q in zip(line, line[1:], strict=False) if p[1] == q[1] == 7.0), name) for name, line in ways]
        if min(shared)[0] < 0:
            want[k] = min(shared)[::-1]
    found = N.longest_overlap(df, w, ["id"], "way_id", size=10.0)
    assert {r.id: (r.way_id, -r.overlap_m) for r in found.collect()} == want
    assert "ArrowCoGroup" in plan(found) or "FlatMapCoGroupsInArrow" in plan(found)


def test_shifts_are_counted_in_strips(spark, monkeypatch):
    """single blocks are not crossed with shifts."""
    crossed = []
    cross = type(spark.range(1)).crossJoin
    monkeypatch.setattr(type(spark.range(1)), "crossJoin", lambda a, b: crossed.append(a.columns) or cross(a, b))
    df = spark.createDataFrame([(i, j, float((i * 7 + j * 3) % 5), (i + j) % 3 - 1) for i in range(9) for j in range(14)], "bi long, bj long, score double, label int")
    assert T.shift_null(df, "score", "label", n=20, seed=3).first().n == 20
    assert all("i" not in c for c in crossed)


def test_only_squares_that_can_win_race(spark):
    """two clusters far apart; each outing's race is over the squares near it, and choices stay on its side."""
    c = spark.createDataFrame([(k, 300.0 * (k % 20) + (1e6 if k >= 40 else 0.0), 0.0) for k in range(80)], "id int, x double, y double")
    outings = spark.createDataFrame([(k, 1e6 * (k % 2), 0.0, 900.0) for k in range(200)], "k long, x double, y double, preference double")
    found = A.chosen(outings, c, "k", 3)
    assert {r.k % 2 == (r.choice >= 40) for r in found.collect()} == {True}
    tall = spark.createDataFrame([(k, 0.0, 3000.0 * k) for k in range(4000)], "id int, x double, y double")
    held, seen = A.held, []
    A.held = lambda rows: seen.append(r) or r if "squares" in (r := held(rows)).columns else r
    try:
        A.chosen(outings.where("x = 0"), tall, "k", 3).collect()
    finally:
        A.held = held
    assert seen and seen[0].agg(F.max(F.size("squares"))).first()[0] < 40


def test_rain_ships_few_rows(spark):
    """a point goes to each group of gauges; groups are large, and pairs are taken in blocks."""
    points, gauges = spark.range(3000).selectExpr("id as k", "cast(id as double) as x", "0.5D as y"), spark.range(2500).selectExpr("cast(2 * id as double) as x", "0D as y", "cast(id as double) as total")
    got = {r.k: r.rain for r in T.idw(points, gauges).where("k % 500 = 0").collect()}
    for k, rain in got.items():
        w = [1 / ((k - 2 * g) ** 2 + 0.25) for g in range(2500)]
        assert abs(rain - sum(a * g for g, a in enumerate(w)) / sum(w)) < 1e-9
    assert len(got) == 6 and "16384" in str(T.idw.__defaults__).replace("_", "")
