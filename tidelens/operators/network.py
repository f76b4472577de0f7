"""Road networks: noding of ways, least costs from many starts, paths from predecessors, connectivity of many closures at once."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import values as V
from tidelens.operators.places import buckets
from tidelens.operators.tables import held

#: Speed in m/s on foot and by vehicle, by class of road; null where that mode has no access.
CLASSES = {"residential": (1.25, 5.0), "primary": (1.25, 10.0), "footway": (1.25, None), "motorway": (None, 20.0)}


def segments(ways: DataFrame, way_id: str) -> DataFrame:
    """(way_id, seg, x0, y0, x1, y1) of ways (way_id, points: array of struct(x, y)), from each vertex to the next; those of no length are left out."""
    n = F.size("points")
    both = F.arrays_zip(F.slice("points", 1, n - 1).alias("a"), F.slice("points", 2, n - 1).alias("b"))
    s = ways.where(n > 1).select(way_id, F.posexplode(both).alias("seg", "p"))
    s = s.select(way_id, "seg", *(F.col(f"p.{e}.{c}").cast("double").alias(f"{c}{k}") for k, e in enumerate("ab") for c in "xy"))
    return s.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))


def crossings(segs: DataFrame, key: list[str], size: float) -> DataFrame:
    """(key, t, x, y): where segments (key, x0, y0, x1, y1) meet others away from their own ends; t is the share of the segment up to there.

    Segments meet in buckets of size metres, a pair only in the bucket that holds the lower corner of their common box. The place
    of a pair is computed once, an end where it is one, so both sides get equal coordinates. Of segments on one line each is cut
    at the other's ends. Segments that only touch at ends of both are not cut.
    """
    low, high = (lambda c, f=f: f(F.col(f"{c}0"), F.col(f"{c}1")) for f in (F.least, F.greatest))
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    s = segs.select(F.struct(*key).alias("id"), *ends)
    s = buckets(s, low("x"), low("y"), high("x"), high("y"), size)
    a, b = s.alias("a"), s.alias("b")
    A, B = ({c: F.col(f"{n}.{c}") for c in ("x0", "y0", "x1", "y1")} for n in "ab")  # noqa: N806
    meet = (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by")) & (F.col("a.id") < F.col("b.id"))
    for c in "xy":
        least = F.greatest(F.least(A[f"{c}0"], A[f"{c}1"]), F.least(B[f"{c}0"], B[f"{c}1"]))
        meet = meet & (F.floor(least / size) == F.col(f"a.b{c}")) & (least <= F.least(F.greatest(A[f"{c}0"], A[f"{c}1"]), F.greatest(B[f"{c}0"], B[f"{c}1"])))
    dx, dy, ex, ey = A["x1"] - A["x0"], A["y1"] - A["y0"], B["x1"] - B["x0"], B["y1"] - B["y0"]
    rx, ry = B["x0"] - A["x0"], B["y0"] - A["y0"]
    j = a.join(b, meet).select(
        F.col("a.id").alias("ia"), F.col("b.id").alias("ib"), *(v.alias(f"{n}{c}") for n, e in (("a", A), ("b", B)) for c, v in e.items()),
        (dx * ey - dy * ex).alias("den"), (rx * ey - ry * ex).alias("nt"), (rx * dy - ry * dx).alias("ns"), dx.alias("dx"), dy.alias("dy"), ex.alias("ex"), ey.alias("ey"))
    j = j.withColumns({"t": F.try_divide("nt", "den"), "s": F.try_divide("ns", "den")})
    apart = j.where("den != 0 and t between 0 and 1 and s between 0 and 1")
    at = lambda c: F.when(F.col("s") == 0, F.col(f"b{c}0")).when(F.col("s") == 1, F.col(f"b{c}1")).when(F.col("t") == 0, F.col(f"a{c}0")).when(F.col("t") == 1, F.col(f"a{c}1")).otherwise(F.col(f"a{c}0") + F.col("t") * F.col(f"d{c}"))
    apart = apart.withColumns({"x": at("x"), "y": at("y")})
    cuts = apart.select(F.explode(F.array(F.struct(F.col("ia").alias("id"), "t", "x", "y"), F.struct(F.col("ib").alias("id"), F.col("s").alias("t"), "x", "y"))).alias("c")).select("c.*")
    for one, other, d in (("a", "b", "d"), ("b", "a", "e")):
        along = [((F.col(f"{other}x{k}") - F.col(f"{one}x0")) * F.col(f"{d}x") + (F.col(f"{other}y{k}") - F.col(f"{one}y0")) * F.col(f"{d}y")) / (F.col(f"{d}x") * F.col(f"{d}x") + F.col(f"{d}y") * F.col(f"{d}y")) for k in (0, 1)]
        line = j.where("den = 0 and nt = 0 and ns = 0").select(F.explode(F.array(*(F.struct(F.col(f"i{one}").alias("id"), along[k].alias("t"), F.col(f"{other}x{k}").alias("x"), F.col(f"{other}y{k}").alias("y")) for k in (0, 1)))).alias("c"))
        cuts = cuts.unionByName(line.select("c.*"))
    return cuts.where("t > 0 and t < 1").select("id.*", "t", "x", "y")


def millimetres(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5)


def noded(ways: DataFrame, way_id: str, size: float, least_m: float = 0.5) -> DataFrame:
    """(way_id, seg, piece, u, v, length_m): ways cut wherever they meet; u and v name places rounded to the millimetre.

    Pieces shorter than least_m, or that end where they begin, are left out.
    """
    s = held(segments(ways, way_id))
    key = [way_id, "seg"]
    ends = s.select(*key, F.explode(F.array(*(F.struct(F.lit(float(k)).alias("t"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)))).alias("c")).select(*key, "c.*")
    points = ends.unionByName(crossings(s, key, size)).select(*key, "t", millimetres(F.col("x")).alias("mx"), millimetres(F.col("y")).alias("my"))
    points = points.groupBy(*key, "mx", "my").agg(F.min("t").alias("t"))
    along = Window.partitionBy(*key).orderBy("t", "mx", "my")
    p = points.withColumns({"piece": F.row_number().over(along) - 1, "nx": F.lead("mx").over(along), "ny": F.lead("my").over(along)}).where("nx is not null")
    ddx, ddy = (F.col("nx") - F.col("mx")) / 1000.0, (F.col("ny") - F.col("my")) / 1000.0
    p = p.select(*key, "piece", F.concat_ws("_", "mx", "my").alias("u"), F.concat_ws("_", "nx", "ny").alias("v"), F.sqrt(ddx * ddx + ddy * ddy).alias("length_m"))
    return p.where((F.col("length_m") >= least_m) & (F.col("u") != F.col("v")))


def edge_table(ways: DataFrame, way_id: str, size: float = 100.0) -> DataFrame:
    """The edge table of ways (way_id, points, highway): noded pieces with an id, class, access and speed by mode; ways of other classes are left out."""
    speeds = F.create_map(*(v for c, (w, d) in CLASSES.items() for v in (F.lit(c), F.struct(F.lit(w).cast("double").alias("walk"), F.lit(d).cast("double").alias("drive")))))
    known = ways.where(F.col("highway").isin(*CLASSES))
    pieces = noded(known, way_id, size).join(known.select(way_id, "highway").hint("merge"), way_id)  # all ways, so not to be broadcast by an estimate
    speed = F.try_element_at(speeds, F.col("highway"))
    return pieces.select(F.concat_ws("_", way_id, "seg", "piece").alias("edge_id"), way_id, "u", "v", "length_m", "highway", speed["walk"].isNotNull().alias("walk_allowed"), speed["drive"].isNotNull().alias("vehicle_allowed"), speed["walk"].alias("speed_walk_mps"), speed["drive"].alias("speed_vehicle_mps"))


def longest_overlap(segs: DataFrame, ways: DataFrame, key: list[str], way_id: str, step: float = 1e-3, size: float = 100.0) -> DataFrame:
    """(key, way_id, overlap_m): for each of segs (key, x0, y0, x1, y1) the way whose segments on the same line share most with it; ties to the least id.

    A line is known by its direction and its distance from the origin, both rounded to step; along it segments are intervals, which meet
    in stretches of size metres. Ways with one interval on a line, the rule, are compared whole: one that lies within another of a lesser id
    never wins, so few of them are left, and of a stretch only each segment's best goes on. Parts of other ways are added up.
    Segments without an overlap of positive length have no row.
    """

    def placed(rows: DataFrame) -> DataFrame:
        dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        n = F.sqrt(dx * dx + dy * dy)
        turned = (dx < 0) | ((dx == 0) & (dy < 0))
        cx, cy = F.when(turned, -dx).otherwise(dx) / n, F.when(turned, -dy).otherwise(dy) / n
        r = rows.withColumns({"cx": cx, "cy": cy})
        along = [F.col(f"x{k}") * F.col("cx") + F.col(f"y{k}") * F.col("cy") for k in (0, 1)]
        r = r.withColumns({"lo": F.least(*along), "hi": F.greatest(*along), "off": F.col("x0") * F.col("cy") - F.col("y0") * F.col("cx")})
        return r.withColumns({"line": F.struct(F.floor(F.col("cx") * 1e6 + 0.5).alias("c"), F.floor(F.col("cy") * 1e6 + 0.5).alias("s"), F.floor(F.col("off") / step + 0.5).alias("o"))})

    def binned(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size)))).hint("merge")

    def longest(rows: pa.Table, ways: pa.Table) -> pa.Table:
        ways = ways.sort_by("_way")
        lo, hi, lo_b, hi_b = (t[c].to_numpy() for t in (rows, ways) for c in ("lo", "hi"))
        keep = np.zeros(0, int)
        for at in range(0, len(ways), 512):
            c = np.arange(at, min(at + 512, len(ways)))
            c = c[~((lo_b[keep] <= lo_b[c, None]) & (hi_b[keep] >= hi_b[c, None])).any(axis=1)]
            within = (lo_b[c] <= lo_b[c, None]) & (hi_b[c] >= hi_b[c, None]) & (np.arange(len(c)) < np.arange(len(c))[:, None])
            keep = np.concatenate([keep, c[~within.any(axis=1)]])
        best, most = np.zeros(len(rows), int), np.zeros(len(rows))
        for at in range(0, len(rows) if len(keep) else 0, 512):
            s = slice(at, at + 512)
            m = np.minimum(hi[s, None], hi_b[keep]) - np.maximum(lo[s, None], lo_b[keep])
            first = np.argmax(np.floor(m * 1e6 + 0.5), axis=1)
            best[s], most[s] = keep[first], m[np.arange(len(m)), first]
        some = np.flatnonzero(most > 0)
        out = rows.select(key).take(some)
        return out.append_column("_way", ways["_way"].take(best[some])).append_column("m", pa.array(np.floor(most[some] * 1e6 + 0.5) / 1e6))

    asked = placed(segs)
    pieces = placed(segments(ways, way_id)).select(F.col(way_id).alias("_way"), "seg", "line", "lo", "hi")
    pieces = held(pieces.withColumn("n", F.count("*").over(Window.partitionBy("_way", "line"))))
    stretch = [F.col("line.c").alias("c"), F.col("line.s").alias("s"), F.col("line.o").alias("o"), "bin"]
    alone = pieces.where("n = 1").groupBy("line", "lo", "hi").agg(F.min("_way").alias("_way"))
    schema = ", ".join([f"`{k}` {segs.schema[k].dataType.simpleString()}" for k in key] + [f"_way {ways.schema[way_id].dataType.simpleString()}, m double"])
    one = binned(asked).select(*key, *stretch, "lo", "hi").groupBy("c", "s", "o", "bin").cogroup(binned(alone).select(*stretch, "_way", "lo", "hi").groupBy("c", "s", "o", "bin")).applyInArrow(longest, schema)
    a = binned(asked).select(*key, "line", "bin", "lo", "hi")
    b = binned(pieces.where("n > 1")).select("_way", "seg", "line", "bin", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    shared = F.least("hi", "hi_b", (F.col("bin") + 1) * size) - F.greatest("lo", "lo_b", F.col("bin") * size)
    sums = a.join(b, ["line", "bin"]).where(shared > 0).groupBy(*key, "_way").agg(F.sum(shared).alias("m"))
    best = sums.select(*key, "_way", "m").unionByName(one).groupBy(*key).agg(F.min(F.struct((-F.round("m", 6)).alias("m"), "_way")).alias("b"))
    return best.select(*key, F.col("b._way").alias(way_id), (-F.col("b.m")).alias("overlap_m"))


def cells_of(nodes: DataFrame, size: float, most: int = 4096, levels: int = 8) -> DataFrame:
    """(node, cell) of nodes (node, x, y): the coarsest square of at most `most` nodes, of size, size / 2, ... metres (the finest whatever it holds)."""
    finest = size / 2**levels
    n = nodes.select("node", F.floor(F.col("x") / finest).alias("fx"), F.floor(F.col("y") / finest).alias("fy"))
    at = lambda level: [F.shiftright("fx", levels - level), F.shiftright("fy", levels - level)]
    every = F.array(*(F.struct(F.lit(k).alias("level"), at(k)[0].alias("cx"), at(k)[1].alias("cy")) for k in range(levels + 1)))
    counts = n.groupBy("fx", "fy").agg(F.count("*").alias("n")).select("fx", "fy", "n", F.explode(every).alias("c"))
    full = counts.groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    # a square is split where it, and so all around it, holds too many
    depth = counts.join(full.select("c", F.lit(1).alias("split")), "c", "left").groupBy("fx", "fy").agg(F.least(F.coalesce(F.max(F.when(F.col("split") == 1, F.col("c.level") + 1)), F.lit(0)), F.lit(levels)).alias("level"))
    shift = F.pow(F.lit(2.0), F.lit(levels) - F.col("level"))
    return n.join(depth, ["fx", "fy"]).select("node", F.concat_ws("_", "level", F.floor(F.col("fx") / shift), F.floor(F.col("fy") / shift)).alias("cell"))


def shortest(edges: DataFrame, starts: DataFrame, cells: DataFrame, cutoff: float = math.inf) -> DataFrame:
    """(source, node, cost, prev_edge, prev_node): least cost from the nodes of each source along both directions of edges.

    edges (edge_id, u, v, cost > 0, and perhaps closed), starts (source long, node), cells (node, cell) of all nodes. A source may start at
    many nodes, which gives the cost from the nearest. closed is a bit mask of sources that may not use an edge, so that many closures
    of one network are searched at once. Of equal costs the least edge_id counts; nodes beyond the cutoff have no row.

    Nodes lie in cells of bounded size. A task relaxes all sources that have come into its cell together, by sweeps over the cell's edges, and
    costs that fell at its border go to other cells in the next round, until nothing falls; so rounds follow cells on the way, not edges. Only
    sources that get something work in a round. Between rounds a source's costs in a cell are one row, held in the shared folder.
    """
    node = edges.schema["u"].dataType.simpleString()
    name = edges.schema["edge_id"].dataType.simpleString()
    e = edges if "closed" in edges.columns else edges.withColumn("closed", F.lit(0).cast("long"))
    e = e.where("u is not null and v is not null and cost > 0")
    both = e.select("u", "v", "cost", "edge_id", "closed").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost", "edge_id", "closed"))
    other, own = (cells.select(F.col("node").alias(c), F.col("cell").alias(k)) for c, k in (("u", "from"), ("v", "cell")))
    roads = held(both.join(other, "u").join(own, "v").select("cell", "from", "u", "v", F.col("cost").cast("double").alias("cost"), "edge_id", "closed").repartition("cell"))
    schema = f"kind int, cell string, source long, nodes array<{node}>, costs array<double>, prev array<int>"
    columns = [c.split()[0] for c in schema.split(", ")]
    at = held(starts.select(F.col("source").cast("long").alias("source"), "node").distinct().join(cells, "node"))
    # kind 0: costs at all nodes of a cell, in order; 1: costs at nodes across the border; 2: a start
    news = held(at.select(F.lit(2).alias("kind"), "cell", "source", F.array("node").alias("nodes"), F.array(F.lit(0.0)).alias("costs"), F.array().cast("array<int>").alias("prev")))
    known = news.limit(0)
    types = [f.type for f in edges.sparkSession.createDataFrame([], schema).toArrow().schema]

    def lists(values, sizes, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind.value_type)).cast(kind)

    def placed(near: pa.Table):
        """Edges in the order of their ids, and the cell's nodes with each edge's."""
        near = near.sort_by([(c, "ascending") for c in ("edge_id", "u", "v", "cost")])
        return near, *np.unique(near["v"].to_numpy(), return_inverse=True)

    def settle(rows: pa.Table, near: pa.Table) -> pa.Table:
        if not len(rows) or not len(near):
            return pa.Table.from_arrays([pa.array([], t) for t in types], columns)
        near, nodes, head = placed(near)
        cell, tail, cost_of, closed = rows["cell"][0].as_py(), near["u"].to_numpy(), near["cost"].to_numpy(), near["closed"].to_numpy()
        beyond = np.array(near["from"].to_pylist(), dtype=object)
        inner, outer = np.flatnonzero(beyond == cell), np.flatnonzero(beyond != cell)
        inner = inner[np.argsort(head[inner], kind="stable")]
        first = np.flatnonzero(np.diff(head[inner], prepend=-1))
        to, start, w = head[inner[first]], np.searchsorted(nodes, tail[inner]), cost_of[inner][:, None]
        outside, at_outside = np.unique(tail[outer], return_inverse=True)
        borders = []
        for x in sorted(set(beyond[outer])):
            mine = outer[beyond[outer] == x]
            inside, k = np.unique(head[mine], return_inverse=True)
            least = np.full(len(inside), np.inf)
            np.minimum.at(least, k, cost_of[mine])
            borders.append((x, inside, least[:, None]))
        flat = {c: (lambda v: (v.offsets.to_numpy(), v.values.to_numpy()))(rows[c].combine_chunks()) for c in ("nodes", "costs", "prev")}
        part = lambda c, r: flat[c][1][flat[c][0][r] : flat[c][0][r + 1]]
        kinds, of = rows["kind"].to_numpy(), rows["source"].to_numpy()
        every, tables, none = np.unique(of), [], len(near)
        for low in range(0, len(every), 256):
            sources = every[low : low + 256]
            n = len(sources)
            old, before, come = np.full((len(nodes), n), np.inf), np.full((len(nodes), n), none), np.full((len(outside), n), np.inf)
            begun = []
            for r in np.flatnonzero((of >= sources[0]) & (of <= sources[-1])):
                k = np.searchsorted(sources, of[r])
                if kinds[r] == 0:
                    old[:, k], before[:, k] = part("costs", r), part("prev", r)
                elif kinds[r] == 1:
                    i = np.searchsorted(outside, part("nodes", r))
                    come[i, k] = np.minimum(come[i, k], part("costs", r))
                else:
                    i = min(np.searchsorted(nodes, part("nodes", r)[0]), len(nodes) - 1)
                    begun += [(i, k)] if nodes[i] == part("nodes", r)[0] else []
            cost = old.copy()
            for i, k in begun:
                cost[i, k] = 0.0
            shut = (closed[:, None] >> np.minimum(sources, 63)) & 1 == 1 if closed.any() else None

            def offered(of_costs, w, which, cols, shut=shut):
                offers = of_costs + w
                offers[offers > cutoff] = np.inf
                if shut is not None:
                    offers[shut[np.ix_(which, cols)]] = np.inf
                return offers

            cols = np.arange(n)
            across = offered(come[at_outside], cost_of[outer][:, None], outer, cols)
            np.minimum.at(cost, head[outer], across)
            cols = cols[(cost < old).any(axis=0)]
            while len(cols) and len(inner):
                now = cost[:, cols]
                best = np.minimum.reduceat(offered(now[start], w, inner, cols), first, axis=0)
                fell = (best < now[to]).any(axis=0)
                now[to] = np.minimum(now[to], best)
                cost[:, cols] = now
                cols = cols[fell]
            # of the edges that give a cost the least; none at a start
            prev = np.where(cost < old, none, before)
            if len(inner):
                offers = offered(cost[start], w, inner, np.arange(n))
                prev[to] = np.minimum(prev[to], np.minimum.reduceat(np.where(offers == cost[head[inner]], inner[:, None], none), first, axis=0))
            np.minimum.at(prev, head[outer], np.where(across == cost[head[outer]], outer[:, None], none))
            prev[(cost == 0) | np.isinf(cost)] = none
            some = np.flatnonzero(np.isfinite(cost).any(axis=0))
            size = np.full(len(some), len(nodes))
            tables.append([np.zeros(len(some)), [cell] * len(some), sources[some], lists(nodes[:0], size * 0, types[3]), lists(cost[:, some].T.ravel(), size, types[4]), lists(prev[:, some].T.ravel(), size, types[5])])
            for x, inside, least in borders:
                k, i = np.nonzero(((cost[inside] < old[inside]) & (cost[inside] + least <= cutoff)).T)
                sent, size = np.unique(k, return_counts=True)
                tables.append([np.ones(len(sent)), [x] * len(sent), sources[sent], lists(nodes[inside[i]], size, types[3]), lists(cost[inside[i], k], size, types[4]), lists(prev[:0].ravel(), size * 0, types[5])])
        return pa.concat_tables([pa.Table.from_arrays([v if isinstance(v, pa.Array) else pa.array(v).cast(t) if len(v) else pa.array([], t) for v, t in zip(row, types, strict=True)], columns) for row in tables])

    def spread(rows: pa.Table, near: pa.Table) -> pa.Table:
        if not len(rows) or not len(near):
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), types[3].value_type, pa.float64(), ids, types[3].value_type)], ["source", "node", "cost", "prev_edge", "prev_node"])
        near, nodes, _ = placed(near)
        cost, prev = (rows[c].combine_chunks().flatten().to_numpy().reshape(len(rows), len(nodes)) for c in ("costs", "prev"))
        r, i = np.nonzero(np.isfinite(cost))
        by = pa.array(prev[r, i], mask=prev[r, i] == len(near))
        kept = [rows["source"].combine_chunks().take(pa.array(r)), pa.array(nodes[i], types[3].value_type), pa.array(cost[r, i]), *(near[c].combine_chunks().take(by) for c in ("edge_id", "u"))]
        return pa.Table.from_arrays(kept, ["source", "node", "cost", "prev_edge", "prev_node"])

    ids = roads.select("edge_id").limit(0).toArrow().schema.field("edge_id").type
    while not news.isEmpty():
        active = news.select("cell", "source").distinct()
        here = known.join(active, ["cell", "source"], "left_semi").unionByName(news).select(*columns)
        moved = held(here.groupBy("cell").cogroup(roads.join(news.select("cell").distinct(), "cell", "left_semi").groupBy("cell")).applyInArrow(settle, schema))
        known = held(known.join(active, ["cell", "source"], "left_anti").unionByName(moved.where("kind = 0")))
        news = moved.where("kind = 1")
    found = known.groupBy("cell").cogroup(roads.groupBy("cell")).applyInArrow(spread, f"source long, node {node}, cost double, prev_edge {name}, prev_node {node}")
    alone = at.join(roads.select(F.col("v").alias("node")).distinct(), "node", "left_anti")
    return found.unionByName(alone.select("source", "node", F.lit(0.0).alias("cost"), F.lit(None).cast(name).alias("prev_edge"), F.lit(None).cast(node).alias("prev_node")))


def path_edges(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, target, seq, node, edge_id, cost) of the ways to asked (source, target): nodes from 0 on, each with the edge to the next, null at the target.

    found is of shortest(). Pointer doubling over all ways at once: ancestors 1, 2, 4, ... steps back are joined, then each way takes those
    it needs from the farthest on, so a way of n nodes takes log n joins. Ways that don't exist have no row.
    """
    at = held(found.select("source", "node", "cost", "prev_edge", "prev_node"))
    ups = [held(at.where("prev_node is not null").select("source", "node", F.col("prev_node").alias("up")))]
    while not ups[-1].isEmpty():
        u = ups[-1]
        ups.append(held(u.alias("a").join(u.alias("b"), (F.col("a.source") == F.col("b.source")) & (F.col("a.up") == F.col("b.node"))).select("a.source", "a.node", "b.up")))
    rows = asked.select("source", "target").distinct().join(at.select("source", F.col("node").alias("target")), ["source", "target"])
    rows = rows.select("source", "target", F.col("target").alias("node"), F.lit(0).alias("back"))
    for k in range(len(ups) - 2, -1, -1):
        rows = rows.unionByName(rows.join(ups[k], ["source", "node"]).select("source", "target", F.col("up").alias("node"), (F.col("back") + 2**k).alias("back")))
    rows = rows.join(at.select("source", "node", "cost", "prev_edge"), ["source", "node"])
    way = Window.partitionBy("source", "target").orderBy(F.col("back").desc())
    return rows.select("source", "target", (F.row_number().over(way) - 1).alias("seq"), "node", F.lead("prev_edge").over(way).alias("edge_id"), "cost")


def tied(found: DataFrame, edges: DataFrame, step: float = 1e-9) -> DataFrame:
    """(source, node, tied): whether several ways of least cost lead from a source to a node; found is of shortest(), edges (u, v, cost).

    An edge is tight where the cost at one end plus its own is the cost at the other, within step. A way is the only one if each node on
    it has one tight edge before it, so that is asked of all nodes on the ways at once, by pointer doubling. Parallel edges are ways
    of their own.
    """
    both = edges.select("u", "v", "cost").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost"))
    a = found.select("source", F.col("node").alias("u"), F.col("cost").alias("cost_u"))
    b = found.select("source", F.col("node").alias("v"), F.col("cost").alias("cost_v"))
    tight = both.join(a, "u").join(b, ["source", "v"]).where(F.abs(F.col("cost_u") + F.col("cost") - F.col("cost_v")) <= step)
    several = tight.groupBy("source", F.col("v").alias("node")).agg((F.count("*") > 1).alias("tied"))
    flags = found.select("source", "node", F.col("prev_node").alias("up")).join(several, ["source", "node"], "left").withColumn("tied", F.coalesce("tied", F.lit(False)))
    flags = held(flags)
    while not flags.where("up is not null").isEmpty():
        up = flags.select("source", F.col("node").alias("up"), F.col("up").alias("next"), F.col("tied").alias("there"))
        flags = held(flags.join(up, ["source", "up"], "left").select("source", "node", F.col("next").alias("up"), (F.col("tied") | F.coalesce("there", F.lit(False))).alias("tied")))
    return flags.select("source", "node", "tied")


def routed(trips: DataFrame, found: DataFrame) -> DataFrame:
    """trips (o_node, d_node; null where no node is near) with duration_s and reason: why there is none, else null."""
    d = found.select(F.col("source").alias("o_node"), F.col("node").alias("d_node"), F.col("cost").alias("duration_s"))
    j = trips.join(d, ["o_node", "d_node"], "left")
    return j.withColumn("reason", F.when(F.col("o_node").isNull(), "origin_not_near_network").when(F.col("d_node").isNull(), "destination_not_near_network").when(F.col("duration_s").isNull(), "no_path_in_time"))


def with_closures(edges: DataFrame, wet: DataFrame, cases: list[tuple[int, float]], seed: int) -> DataFrame:
    """edges with closed, a bit for each case (year, fraction): edges wet in that year whose draw is below the fraction, so larger ones close more.

    wet (edge_id, year). At most 63 cases.
    """
    years = wet.groupBy("edge_id").agg(F.collect_set("year").alias("years"))
    e = edges.join(years, "edge_id", "left").withColumn("_draw", V.uniform(seed, "closure", F.col("edge_id")))
    bits = [F.when(F.array_contains("years", F.lit(y)) & (F.col("_draw") < f), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (y, f) in enumerate(cases)]
    closed = bits[0]
    for b in bits[1:]:
        closed = closed.bitwiseOR(b)
    return e.withColumn("closed", closed).drop("years", "_draw")


def screened(edges: DataFrame, destinations: DataFrame, homes: DataFrame, cells: DataFrame, cases: list[tuple[int, float]], within_s: tuple[int, ...] = (900, 1800)) -> DataFrame:
    """A row for each case: people, reached (weight that reaches any destination), share, and those within so many seconds.

    edges as of with_closures(); destinations (node); homes (node, weight), anchored to the network before closures: null nodes are never reached.
    All cases are searched at once, each from all its destinations.
    """
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(cases) - 1).cast("long"))).alias("source")
    found = shortest(edges, destinations.select("node", number), cells)
    people = homes.groupBy("node").agg(F.sum("weight").alias("weight"))
    j = people.select("node", "weight", number).join(found.select("source", "node", "cost"), ["source", "node"], "left")
    year = F.element_at(F.array(*(F.lit(y) for y, _ in cases)), (F.col("source") + 1).cast("int"))
    part = F.element_at(F.array(*(F.lit(float(f)) for _, f in cases)), (F.col("source") + 1).cast("int"))
    reached = F.sum(F.when(F.col("cost").isNotNull(), F.col("weight")).otherwise(0.0))
    within = [F.sum(F.when(F.col("cost") <= s, F.col("weight")).otherwise(0.0)).alias(f"within_{s}_s") for s in within_s]
    out = j.groupBy("source").agg(F.sum("weight").alias("people"), reached.alias("reached"), *within)
    return out.select(year.alias("year"), part.alias("fraction"), "people", "reached", F.round(V.ratio(F.col("reached"), F.col("people")), 6).alias("share"), *(f"within_{s}_s" for s in within_s))
