"""Every registered query against DuckDB on the smallest tables, and small cases by hand."""

import heapq
import math
import os
import random
import statistics
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelens.functions import values as V
from tidelens.operators import places as P
from tidelens.operators import tables as T
from tidelens.plans import areas, catalog, network, people, places, records, registry, runs  # noqa: F401
from tidelens.sources.derived import Tables

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, bool | str) else float(v) if isinstance(v, int | float) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_like_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = Counter(tuple(plain(r[c]) for c in names) for r in got.collect())
    assert rows == Counter(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in names)).fetchall())


def test_weighted_clearance(spark):
    rows = spark.createDataFrame([("a", 20, 1.0), ("a", 20, 1.0), ("a", 30, 0.1), ("b", 10, 1.0), ("b", 20, 1.0), ("b", 25, 0.2)], "k string, t int, w double")
    got = {r.k: (r.q5, r.q50, r.q95) for r in T.quantiles(rows, ["k"], "t", "w", [0.05, 0.5, 0.95]).collect()}
    assert got == {"a": (20, 20, 20), "b": (10, 20, 25)}


def test_projection(spark):
    r = spark.createDataFrame([(100.5, 13.7), (99.0, 0.0)], "lon double, lat double")
    x, y = V.to_utm(F.col("lon"), F.col("lat"))
    got = [tuple(v) for v in r.select(F.round(x, 4), F.round(y, 4)).collect()]
    assert got == [(662210.6563, 1515051.1732), (500000.0, 0.0)]


def test_serialised_day(spark):
    rows = spark.createDataFrame([(1, 1, 100, 300, "work"), (1, 2, 200, 400, "shop"), (1, 3, 250, 260, "lost"), (1, 4, 86_000, 90_000, "late")], "p int, k int, s long, e long, purpose string")
    got = [(r.start_s, r.end_s, r.purpose) for r in T.serialised(rows, "p", "s", "e", "k").orderBy("seq").collect()]
    assert got == [(0, 100, "home"), (100, 300, "work"), (300, 400, "shop"), (400, 86_000, "home"), (86_000, 86_400, "late")]


def test_paths(spark):
    edges = [(1, 2, 1.0), (2, 3, 1.0), (1, 4, 5.0), (3, 4, 1.0), (5, 6, 1.0), (6, 7, 9.0)]
    df = spark.createDataFrame(edges, "u long, v long, cost double")
    start = spark.createDataFrame([(1, 1), (5, 5)], "source long, node long")
    got = {(r.source, r.node): r.cost for r in T.distances(df, start, 8.0).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (5, 5): 0, (5, 6): 1}
    assert {r.node: r.component for r in T.components(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5}


def test_geometry(spark):
    row = spark.createDataFrame([("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))",)], "w string").select(V.wkt_points(F.col("w")).alias("ring"))
    got = row.select(V.ring_area(F.col("ring")), V.line_length(F.col("ring")), V.in_ring(F.lit(5.0), F.lit(5.0), F.col("ring")), V.in_ring(F.lit(15.0), F.lit(5.0), F.col("ring"))).first()
    assert tuple(got) == (100.0, 40.0, True, False)
    n = [F.lit(float(v)) for v in (-5, 5, 15, 5, 0, 0, 10, 10)]
    assert spark.range(1).select(V.clipped_length(*n), V.segment_distance(F.lit(3.0), F.lit(4.0), *n[:4])).first() == (10.0, 1.0)


def test_nearest_at_any_distance(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e4, 0.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 5.0, 0.0)], "p int, x double, y double")
    others = spark.createDataFrame([(7, 0.0, 1.0), (8, 10.0, 0.0), (9, 10.0, 0.0), (6, None, 0.0)], "o int, x double, y double")
    assert {r.p: r.other for r in P.nearest_any(points, others, 4.0, "p", "o").collect()} == {1: 7, 2: 8, 3: None, 4: None, 5: 8}
    assert {r.p: r.other for r in P.nearest_any(points, others.limit(0), 4.0, "p", "o").collect()} == dict.fromkeys(range(1, 6))


def test_rain_of_all_gauges_at_all_blocks(spark):
    """Of brute force at every block, from every gauge."""
    got = {(r.bi, r.bj): r.rain for r in catalog.QUERIES["j22_idw_rain"](spark, DATA).collect()}
    blocks = [(int(r.p_partkey) % 50, int(r.p_partkey) // 50) for r in spark.read.parquet(f"{DATA}/part.parquet").collect()]
    gauges = [(500.0 * (r.s_suppkey % 10), 500.0 * (r.s_suppkey // 10), abs(float(r.s_acctbal)) / 100) for r in spark.read.parquet(f"{DATA}/supplier.parquet").collect()]
    assert got.keys() == set(blocks)
    for (bi, bj), rain in got.items():
        near = [(math.hypot(100 * bi - x, 100 * bj - y), t) for x, y, t in gauges]
        on = [t for d, t in near if d <= 1e-6]
        want = sum(on) / len(on) if on else sum(t / d**2 for d, t in near) / sum(1 / d**2 for d, _ in near)
        assert abs(rain - want) < 2e-6


def test_rain_by_small_groups(spark):
    gauges = [(float(7 * k % 40), float(11 * k % 30), float(k)) for k in range(90)] + [(3.5, None, 9.0), (4.5, 1.5, None), (float("nan"), 1.0, 9.0)]
    points = [(k, k * 0.75, k * 0.5) for k in range(40)] + [(99, None, 1.0)]
    g = spark.createDataFrame(gauges, "x double, y double, total double")
    got = {r.k: r.rain for r in T.idw(spark.createDataFrame(points, "k int, x double, y double"), g, size=16).collect()}
    assert got[99] is None and len(got) == 41
    for k, x, y in points[:40]:
        near = [(math.hypot(x - a, y - b), t) for a, b, t in gauges[:90]]
        on = [t for d, t in near if d <= 1e-6]
        assert abs(got[k] - (sum(on) / len(on) if on else sum(t / d**2 for d, t in near) / sum(1 / d**2 for d, _ in near))) < 1e-9


def test_cut_off_reasons(spark):
    open_ = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "u long, v long")
    trips = spark.createDataFrame([(1, 1, 3), (2, 1, 8), (3, 5, 1), (4, 1, 5), (5, 5, 6), (6, 7, 7), (7, None, 1)], "trip_id long, a long, b long")
    got = {r.trip_id: r.reason for r in P.cut_off(trips, open_, "a", "b").collect()}
    assert got == {1: None, 2: "no_path", 3: "origin", 4: "destination", 5: "origin", 6: None, 7: "origin"}


def test_trips_over_all_nodes(spark):
    """Of a union of open edges by hand, from every node."""
    t = Tables(spark, DATA)
    closed = {r.edge_id for r in t.edge_depths.collect() if r.max_depth_m >= 0.5}
    edges = t.edges.collect()
    root = {}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for e in edges:
        if e.walk_allowed and e.edge_id not in closed:
            u, v = (find(root.setdefault(n, n)) for n in (e.u, e.v))
            root[max(u, v)] = min(u, v)
    last = max(max(e.u, e.v) for e in edges) + 1
    want = {}
    for r in t.trips.collect():
        a, b = r.person % last, r.trip_id % last
        want[r.trip_id] = "origin" if a not in root else "destination" if b not in root else "no_path" if find(a) != find(b) else None
    assert "no_path" in want.values()
    assert {r.trip_id: r.reason for r in catalog.QUERIES["n08_cut_off_reason"](spark, DATA).collect()} == want


def test_travel_times_of_all_gauges(spark):
    """Of Dijkstra by hand from the node nearest to each gauge, on all edges open on foot."""
    t = Tables(spark, DATA)
    near = {}
    for e in t.edges.where("walk_allowed").collect():
        for a, b in ((e.u, e.v), (e.v, e.u)):
            near.setdefault(a, []).append((b, e.length_m / 1.25, e.edge_id))
    want = {}
    for g in t.gauges.collect():
        start = min(near, key=lambda n: (math.hypot(50 * (n % 50) - g.x, 50 * (n // 50) - float(g.y)), n))
        cost, todo = {start: 0.0}, [(0.0, start)]
        while todo:
            c, n = heapq.heappop(todo)
            for b, step, _ in near[n] if c <= cost[n] else ():
                if c + step <= 1200 and c + step < cost.get(b, math.inf):
                    cost[b] = c + step
                    heapq.heappush(todo, (c + step, b))
        want |= {(start, n): c for n, c in cost.items()}
    got = {(r.source, r.node): r for r in catalog.QUERIES["n03_travel_times"](spark, DATA).collect()}
    assert got.keys() == want.keys() and len({s for s, _ in got}) > 1
    for (s, n), r in got.items():
        assert abs(r.cost - want[s, n]) < 1e-6
        assert r.prev_edge is None if s == n else any(e == r.prev_edge and abs(want.get((s, b), math.inf) + step - r.cost) < 1e-6 for b, step, e in near[n])


def test_components_of_all_edges_on_foot(spark):
    root = {}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for e in Tables(spark, DATA).edges.where("walk_allowed").collect():
        u, v = (find(root.setdefault(n, n)) for n in (e.u, e.v))
        root[max(u, v)] = min(u, v)
    assert {r.node: r.component for r in catalog.QUERIES["n06_components"](spark, DATA).collect()} == {n: find(n) for n in root}


def area(pairs):
    pos, neg = ([s for s, y in pairs if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("n", [99_999, 9])
def test_shift_null(spark, n):
    """Of brute force on a small torus: of all shifts, and of a draw of some."""
    rnd = random.Random(3)
    cells = {(i, j): (float(rnd.randrange(6)), rnd.choice([1, 0, 0, -1])) for i in range(2, 7) for j in range(6) if (i, j) != (4, 4)}
    cells |= {(2, 0): (5.0, 1), (6, 5): (0.0, 0)}
    df = spark.createDataFrame([(i, j, *v) for (i, j), v in cells.items()], "bi long, bj long, score double, label int")
    r = T.shift_null(df, "score", "label", n=n, seed=7).first()
    known = {c: v for c, v in cells.items() if v[1] >= 0}
    observed, values = area(list(known.values())), []
    for di in range(5):
        for dj in range(6):
            land = [(known[to][0], y) for (i, j), (_, y) in known.items() for to in [((i - 2 + di) % 5 + 2, (j + dj) % 6)] if to in known]
            values += [(area(land), len(land))] if (di or dj) else []
    assert abs(r.auc - observed) < 1e-12 and r.n == min(n, 29)
    if n > 29:
        done = [v for v, _ in values if v is not None]
        k = sum(v >= observed - 1e-12 for v in done)
        assert (r.n_undefined, r.p_ge_observed, r.share_ge_observed) == (29 - len(done), (1 + k) / (1 + len(done)), k / len(done))
        assert (r.evaluable_low, r.evaluable_high) == (min(m for v, m in values if v is not None), max(m for v, m in values if v is not None))
    assert T.shift_null(df, "score", "label", n=n, seed=7).first() == r


def test_shift_null_query(spark):
    r = catalog.QUERIES["a50_shift_null"](spark, DATA).first()
    assert r.n >= 190 and 0 < r.p_ge_observed <= 1


def test_correlogram(spark):
    """Every lag up to half the shorter side, none below 30 pairs, and the first of at most 0.05."""
    rnd = random.Random(4)
    rows = {(i, j): i // 3 + rnd.random() for i in range(12) for j in range(30)}
    got = {r.lag: r for r in T.correlogram(spark.createDataFrame([(*c, v) for c, v in rows.items()], "bi long, bj long, v double"), "v").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    first = None
    for h in sorted(got):
        pairs = [(v, rows[to]) for (i, j), v in rows.items() for to in ((i + h, j), (i, j + h)) if to in rows]
        x, y = zip(*pairs)
        corr = statistics.correlation(x, y)
        assert got[h].pairs == len(pairs) and abs(got[h].corr - corr) < 1e-9
        first = h if first is None and corr <= 0.05 else first
    assert {r.range_lag for r in got.values()} == {first}
    few = T.correlogram(spark.createDataFrame([(i, j, float(i * j % 5)) for i in range(4) for j in range(4)], "bi long, bj long, v double"), "v").collect()
    assert [(r.lag, r.pairs, r.corr, r.range_lag) for r in sorted(few)] == [(1, 24, None, None), (2, 16, None, None)]


@pytest.mark.parametrize("share", [0.0, 0.01, 0.25, 0.9, 1.0])
def test_least_share(spark, share):
    rnd = random.Random(8)
    rows = [(k, rnd.choice([0.0, 0.25, 0.5, rnd.random()])) for k in range(500)]
    got = T.least_share(spark.createDataFrame(rows, "k long, u double"), "u", "k", share, size=20)
    assert sorted(r.k for r in got.collect()) == sorted(k for k, _ in sorted(rows, key=lambda r: (r[1], r[0]))[: int(500 * share + 0.5)])
