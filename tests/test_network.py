"""Noding, least costs, paths, ties, overlaps and closures against plain Python on small networks."""

import heapq
import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelens.operators import network as N

POINTS = "way_id string, highway string, points array<struct<x:double,y:double>>"


def ways(spark, lines, highway="residential"):
    return spark.createDataFrame([(f"w{k}", highway, p) for k, p in enumerate(lines)], POINTS)


def test_noding_of_a_grid(spark):
    """Three by three straight ways, with crossings in and on the edge of buckets, an end on another way, and two on one line."""
    lines = [[(0.0, 100.0 * k), (200.0, 100.0 * k)] for k in range(3)] + [[(100.0 * k, 0.0), (100.0 * k, 200.0)] for k in range(3)]
    lines += [[(50.0, 0.0), (50.0, 100.0)], [(20.0, 0.0), (80.0, 0.0)], [(7.0, 7.0), (7.0, 7.0)], [(9.0, 9.0)], []]
    got = N.edge_table(ways(spark, lines), "way_id").collect()
    length = defaultdict(float)
    for r in got:
        length[r.way_id] += r.length_m
    assert dict(length) == {"w0": 200, "w1": 200, "w2": 200, "w3": 200, "w4": 200, "w5": 200, "w6": 100, "w7": 60}
    nodes = {n for r in got for n in (r.u, r.v)}
    assert nodes == {f"{x * 1000}_{y * 1000}" for x in (0, 100, 200) for y in (0, 100, 200)} | {"20000_0", "50000_0", "80000_0", "50000_100000"}
    assert sorted((r.u, r.v) for r in got if r.way_id == "w0") == [("0_0", "20000_0"), ("100000_0", "200000_0"), ("20000_0", "50000_0"), ("50000_0", "80000_0"), ("80000_0", "100000_0")]


def cross(a, b, c, d):
    """Whether two segments cross away from the ends of both, well inside."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    far = lambda p, q, r: abs(side(p, q, r)) / math.dist(p, q) > 0.01
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 and far(a, b, c) and far(a, b, d) and far(c, d, a) and far(c, d, b)


@pytest.mark.parametrize("size", [30.0, 100.0, 1000.0])
def test_no_edges_cross_inside(spark, size):
    rnd = random.Random(4)
    lines = [[(rnd.uniform(-150, 150), rnd.uniform(-150, 150)) for _ in range(rnd.randrange(2, 5))] for _ in range(25)]
    got = N.noded(ways(spark, lines), "way_id", size, 0.0).collect()
    at = lambda n: tuple(int(v) / 1000 for v in n.split("_"))
    edges = [(at(r.u), at(r.v)) for r in got]
    assert not any(cross(*e, *f) for e, f in itertools.combinations(edges, 2))
    assert abs(sum(r.length_m for r in got) - sum(math.dist(p, q) for line in lines for p, q in itertools.pairwise(line))) < 0.5
    assert len(got) > 150


def test_edge_classes(spark):
    got = {}
    for c in ("motorway", "footway", "primary", "river"):
        got[c] = [(r.walk_allowed, r.vehicle_allowed, r.speed_walk_mps, r.speed_vehicle_mps) for r in N.edge_table(ways(spark, [[(0.0, 0.0), (5.0, 5.0)]], c), "way_id").collect()]
    assert got == {"motorway": [(False, True, None, 20.0)], "footway": [(True, False, 1.25, None)], "primary": [(True, True, 1.25, 10.0)], "river": []}


def test_longest_overlap_on_sloping_lines(spark):
    """Along a line of slope 3/4: a way over 5 m of the segment, one over 10 m against its direction, one beside it; ties to the least id."""
    at = lambda d: (4.0 * d, 3.0 * d)
    lines = [[at(0), at(2)], [at(4), at(1), at(1)], [at(4), at(1)], [(4.0, 4.0), (12.0, 10.0)]]
    segs = spark.createDataFrame([(1, *at(1), *at(3)), (2, 100.0, 0.0, 101.0, 0.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    for size in (3.0, 500.0):
        assert [tuple(r) for r in N.longest_overlap(segs, ways(spark, lines), ["id"], "way_id", size=size).collect()] == [(1, "w1", 10.0)]


def plain(edges, starts, cutoff=math.inf, shut=lambda source, edge: False):
    """Least (cost, edge, node before) of each source and node."""
    near = defaultdict(list)
    for u, v, cost, edge in edges:
        near[u].append((v, cost, edge))
        near[v].append((u, cost, edge))
    best = {}
    for source in {s for s, _ in starts}:
        cost = {n: 0.0 for s, n in starts if s == source}
        heap = [(0.0, n) for n in cost]
        while heap:
            c, n = heapq.heappop(heap)
            if c > cost[n]:
                continue
            for v, w, edge in near[n]:
                if not shut(source, edge) and c + w <= cutoff and c + w < cost.get(v, math.inf):
                    cost[v] = c + w
                    heapq.heappush(heap, (c + w, v))
        for n, c in cost.items():
            before = [(edge, v) for v, w, edge in near[n] if v in cost and cost[v] + w == c and not shut(source, edge)] if c else []
            best[source, n] = (c, *min(before, default=(None, None)))
    return best


def network(spark, seed, n=60, m=110):
    rnd = random.Random(seed)
    edges = [(*rnd.sample(range(n), 2), float(rnd.randrange(1, 6)), f"e{k:03d}") for k in range(m)]
    rows = [(*e, rnd.randrange(8)) for e in edges]
    df = spark.createDataFrame(rows, "u long, v long, cost double, edge_id string, closed long")
    cells = spark.createDataFrame([(k, f"c{rnd.randrange(7)}") for k in range(n)], "node long, cell string")
    return edges, {r[3]: r[4] for r in rows}, df, cells


@pytest.mark.parametrize("seed, cutoff", [(1, math.inf), (2, 9.0)])
def test_least_costs_over_cells(spark, seed, cutoff):
    edges, _, df, cells = network(spark, seed)
    starts = [(0, 0), (1, 5), (1, 50), (2, 7), (77, 7)]
    found = N.shortest(df.drop("closed"), spark.createDataFrame(starts, "source long, node long"), cells, cutoff)
    assert {(r.source, r.node): (r.cost, r.prev_edge, r.prev_node) for r in found.collect()} == plain(edges, starts, cutoff)


def test_closures_side_by_side(spark):
    edges, closed, df, cells = network(spark, 3)
    starts = [(s, n) for s in range(3) for n in (0, 31)]
    found = N.shortest(df, spark.createDataFrame(starts, "source long, node long"), cells)
    assert {(r.source, r.node): (r.cost, r.prev_edge, r.prev_node) for r in found.collect()} == plain(edges, starts, shut=lambda s, e: closed[e] >> s & 1)


def test_no_starts(spark):
    _, _, df, cells = network(spark, 3)
    assert N.shortest(df, spark.createDataFrame([], "source long, node long"), cells).count() == 0
    assert N.shortest(df.limit(0), spark.createDataFrame([(1, 2)], "source long, node long"), cells).select("source", "node", "cost").collect() == [(1, 2, 0.0)]


def test_paths_and_ties(spark):
    edges, _, df, cells = network(spark, 5)
    starts = [(0, 0), (9, 9)]
    found = N.shortest(df.drop("closed"), spark.createDataFrame(starts, "source long, node long"), cells)
    best = plain(edges, starts)
    asked = [(s, t) for s in (0, 9) for t in range(0, 60, 3)] + [(0, 1000), (5, 1)]
    rows = defaultdict(list)
    for r in N.path_edges(found, spark.createDataFrame(asked * 2, "source long, target long")).collect():
        rows[r.source, r.target].append((r.seq, r.node, r.edge_id, r.cost))
    want = {}
    for s, t in asked:
        if (s, t) in best:
            node, after, way = t, None, []
            while node is not None:
                cost, edge, before = best[s, node]
                way.append((node, after, cost))
                node, after = before, edge
            want[s, t] = [(k, *w) for k, w in enumerate(reversed(way))]
    assert {k: sorted(v) for k, v in rows.items()} == want
    # ways are counted by cost order
    several = {}
    for s in (0, 9):
        count = {}
        for (_, n), (c, *_) in sorted(((k, v) for k, v in best.items() if k[0] == s), key=lambda x: x[1][0]):
            count[n] = 1 if n == s else sum(count[b] for u, v, w, _ in edges for a, b in ((u, v), (v, u)) if a == n and (s, b) in best and best[s, b][0] + w == c)
            several[s, n] = count[n] > 1
    assert {(r.source, r.node): r.tied for r in N.tied(found, df).collect()} == several
    assert 0 < sum(several.values()) < len(several)


def test_cells_are_bounded(spark):
    """A dense corner among sparse places: no cell above the bound unless all its nodes share the finest square."""
    rnd = random.Random(1)
    places = [(k, rnd.uniform(0, 10), rnd.uniform(0, 10)) for k in range(500)] + [(k, rnd.uniform(-1000, 1000), rnd.uniform(-1000, 1000)) for k in range(500, 700)] + [(k, 3.0, 3.0) for k in range(700, 760)]
    got = N.cells_of(spark.createDataFrame(places, "node long, x double, y double"), 1024.0, 50, 12).collect()
    assert sorted(r.node for r in got) == list(range(760))
    held = defaultdict(list)
    for r in got:
        held[r.cell].append(r.node)
    assert all(len(v) <= 50 or set(v) >= set(range(700, 760)) for v in held.values()) and len(held) < 150


def test_reasons(spark):
    found = spark.createDataFrame([(1, 2, 5.0)], "source long, node long, cost double")
    trips = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, None, 2), (4, 1, None), (5, None, None)], "trip_id long, o_node long, d_node long")
    assert {r.trip_id: (r.duration_s, r.reason) for r in N.routed(trips, found).collect()} == {1: (5.0, None), 2: (None, "no_path_in_time"), 3: (None, "origin_not_near_network"), 4: (None, "destination_not_near_network"), 5: (None, "origin_not_near_network")}


def test_nested_closures(spark):
    """A larger share closes what a smaller one closes, only wet edges, and all of them at 1."""
    edges = spark.createDataFrame([(f"e{k}", k, k + 1, 1.0) for k in range(200)], "edge_id string, u long, v long, cost double")
    wet = spark.createDataFrame([(f"e{k}", 2010) for k in range(0, 200, 2)] * 2 + [("e1", 2011)], "edge_id string, year int")
    got = N.with_closures(edges, wet, [(2010, 0.0), (2010, 0.3), (2010, 1.0), (2011, 1.0)], 5).select("edge_id", "u", *(F.getbit("closed", F.lit(k)).alias(f"b{k}") for k in range(4))).collect()
    assert sum(r.b2 for r in got) == 100 and all(r.b2 == (r.u % 2 == 0) for r in got) and [r.edge_id for r in got if r.b3] == ["e1"]
    assert not any(r.b0 for r in got) and all(r.b1 <= r.b2 for r in got) and 15 < sum(r.b1 for r in got) < 45
