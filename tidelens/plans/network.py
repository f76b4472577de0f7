"""Registered queries on road networks: edges from ways, ways of least cost, trips, closures; the names go into the catalog."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.operators import network as N
from tidelens.operators import places as P
from tidelens.operators import tables as T
from tidelens.plans.catalog import FACTOR, STATES, C, L, query, r6, states

CASES = [(2010, 0.0), *((y, f) for y in (2010, 2011, 2012) for f in (0.25, 0.5, 1.0))]
WALK = "walk as (select u, v, length_m / speed_walk_mps as cost, edge_id from {edges} where walk_allowed)"
WET = f"wet as (select w.u, w.v, w.cost / s.f as cost, w.edge_id from walk w join (select edge_id, {FACTOR} as f from {STATES} where mode = 0 and time_s = 68400) s using (edge_id) where s.f > 0)"


def adjacent(name: str, of: str) -> str:
    return f"{name} as (select u as a, v as b, cost, edge_id from {of} union all select v, u, cost, edge_id from {of})"


def search(name: str, adj: str, starts: str, cutoff: float, closed: str = "") -> str:
    """Tables name (source, node, cost) of least costs and name_p with prev_edge and prev_node, as common table expressions of DuckDB."""
    shut = f"left join {closed} c on c.source = x.source and c.edge_id = a.edge_id" if closed else ""
    where = " and c.edge_id is null" if closed else ""
    return f"""{name}(source, node, cost) using key (source, node) as (select source, node, 0::double from {starts} union
 select m.source, m.b, m.cost from (select x.source, a.b, min(x.cost + a.cost) as cost from {name} x join {adj} a on a.a = x.node {shut} where x.cost + a.cost <= {cutoff}{where} group by 1, 2) m left join recurring.{name} k on k.source = m.source and k.node = m.b where k.cost is null or m.cost < k.cost),
 {name}_p as (select k.source, k.node, k.cost, min(a.edge_id) as prev_edge, arg_min(a.a, a.edge_id) as prev_node from {name} k left join ({name} x join {adj} a on a.a = x.node) on x.source = k.source and a.b = k.node and x.cost + a.cost = k.cost and k.cost > 0 group by 1, 2, 3)"""


def walk(t) -> DataFrame:
    return t.edges.where("walk_allowed").select("u", "v", (C("length_m") / C("speed_walk_mps")).alias("cost"), "edge_id")


def nodes_of(edges: DataFrame) -> DataFrame:
    """The nodes of edges with their places."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", (50.0 * (C("node") % 50)).alias("x"), (50.0 * F.floor(C("node") / 50)).alias("y"))


def cells(t) -> DataFrame:
    return N.cells_of(nodes_of(t.edges), 25_600.0, 2048)


def wet_walk(t) -> DataFrame:
    return walk(t).join(states(t).where("mode = 0 and time_s = 68400 and speed_multiplier > 0").select("edge_id", "speed_multiplier"), "edge_id").withColumn("cost", C("cost") / C("speed_multiplier"))


# --- edges ------------------------------------------------------------------------------------------------------------
MET = " and ".join(f"greatest(least(a.{c}0, a.{c}1), least(b.{c}0, b.{c}1)) <= least(greatest(a.{c}0, a.{c}1), greatest(b.{c}0, b.{c}1))" for c in "xy")
query("n02_edge_table", f"""with w as (select * from {{ways}} where highway <> 'river'),
s as (select * from (select way_id, 0 as seg, x0::double as x0, y0::double as y0, x1::double as x1, y1::double as y1 from w union all select way_id, 1, x1, y1, x2, y2 from w) where x0 <> x1 or y0 <> y1),
j as (select a.way_id as wa, a.seg as sa, b.way_id as wb, b.seg as sb, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1, a.x1 - a.x0 as dx, a.y1 - a.y0 as dy, b.x1 - b.x0 as ex, b.y1 - b.y0 as ey, b.x0 - a.x0 as rx, b.y0 - a.y0 as ry from s a join s b on (a.way_id, a.seg) < (b.way_id, b.seg) and {MET}),
d as (select *, dx * ey - dy * ex as den, rx * ey - ry * ex as nt, rx * dy - ry * dx as ns from j),
h as (select *, nt / den as t, ns / den as s from d where den <> 0 and nt / den between 0 and 1 and ns / den between 0 and 1),
p as (select *, case when s = 0 then bx0 when s = 1 then bx1 when t = 0 then ax0 when t = 1 then ax1 else ax0 + t * dx end as x, case when s = 0 then by0 when s = 1 then by1 when t = 0 then ay0 when t = 1 then ay1 else ay0 + t * dy end as y from h),
c as (select wa as way_id, sa as seg, t, x, y from p where t > 0 and t < 1 union all select wb, sb, s, x, y from p where s > 0 and s < 1
 union all select wa, sa, ((qx - ax0) * dx + (qy - ay0) * dy) / (dx * dx + dy * dy) as t, qx, qy from (select *, unnest([bx0, bx1]) as qx, unnest([by0, by1]) as qy from d where den = 0 and nt = 0 and ns = 0) where ((qx - ax0) * dx + (qy - ay0) * dy) / (dx * dx + dy * dy) > 0 and ((qx - ax0) * dx + (qy - ay0) * dy) / (dx * dx + dy * dy) < 1
 union all select wb, sb, ((qx - bx0) * ex + (qy - by0) * ey) / (ex * ex + ey * ey) as t, qx, qy from (select *, unnest([ax0, ax1]) as qx, unnest([ay0, ay1]) as qy from d where den = 0 and nt = 0 and ns = 0) where ((qx - bx0) * ex + (qy - by0) * ey) / (ex * ex + ey * ey) > 0 and ((qx - bx0) * ex + (qy - by0) * ey) / (ex * ex + ey * ey) < 1),
m as (select way_id, seg, min(t) as t, mx, my from (select way_id, seg, t, floor(x * 1000 + 0.5)::bigint as mx, floor(y * 1000 + 0.5)::bigint as my from (select * from c union all select way_id, seg, 0, x0, y0 from s union all select way_id, seg, 1, x1, y1 from s)) group by way_id, seg, mx, my),
l as (select *, row_number() over o - 1 as piece, lead(mx) over o as nx, lead(my) over o as ny from m window o as (partition by way_id, seg order by t, mx, my)),
e as (select way_id, concat_ws('_', way_id, seg::varchar, piece::varchar) as edge_id, concat_ws('_', mx::varchar, my::varchar) as u, concat_ws('_', nx::varchar, ny::varchar) as v, sqrt(((nx - mx) / 1000::double) * ((nx - mx) / 1000::double) + ((ny - my) / 1000::double) * ((ny - my) / 1000::double)) as length_m from l where nx is not null)
select edge_id, way_id, u, v, round(length_m, 6) as length_m, highway, highway <> 'motorway' as walk_allowed, highway <> 'footway' as vehicle_allowed, case when highway <> 'motorway' then 1.25::double end as speed_walk_mps, case highway when 'residential' then 5 when 'primary' then 10 when 'motorway' then 20 end::double as speed_vehicle_mps from e join w using (way_id) where length_m >= 0.5 and u <> v""")(
    lambda t: N.edge_table(t.ways.select("way_id", "highway", F.array(*(F.struct(C(f"x{k}").cast("double").alias("x"), C(f"y{k}").cast("double").alias("y")) for k in range(3))).alias("points")), "way_id").withColumn("length_m", F.round("length_m", 6)))


def axis(rows: DataFrame) -> DataFrame:
    """Intervals (dir, off, lo, hi) as segments along or across the grid."""
    along = C("dir") == 0
    return rows.select("id", *(F.when(along if c == "x" else ~along, C(e)).otherwise(C("off")).cast("double").alias(f"{c}{k}") for k, e in enumerate(("lo", "hi")) for c in "xy"))


query("j15_longest_overlap", "select id, way_id, m as overlap_m from (select s.id, w.id as way_id, sum(least(s.hi, w.hi) - greatest(s.lo, w.lo))::double as m, row_number() over (partition by s.id order by sum(least(s.hi, w.hi) - greatest(s.lo, w.lo)) desc, w.id) as r from {stretches} s join {carriers} w on s.dir = w.dir and s.off = w.off and s.lo < w.hi and w.lo < s.hi group by 1, 2) where r = 1")(
    lambda t: N.longest_overlap(axis(t.stretches), axis(t.carriers).select(C("id").alias("way_id"), F.array(F.struct(C("x0").alias("x"), C("y0").alias("y")), F.struct(C("x1").alias("x"), C("y1").alias("y"))).alias("points")), ["id"], "way_id"))

# --- ways of least cost -----------------------------------------------------------------------------------------------
NODES = "nodes as (select distinct node, 50 * (node % 50) as x, 50 * floor(node / 50) as y from (select u as node from walk union all select v from walk))"
GAUGE_NODES = "starts as (select distinct node as source, node from (select gauge_id, arg_min(node, ((g.x - n.x) ** 2 + (g.y - n.y) ** 2, node)) as node from {gauges} g, nodes n group by 1))"
query("n03_travel_times", f"with recursive {WALK}, {adjacent('adj', 'walk')}, {NODES}, {GAUGE_NODES}, {search('best', 'adj', 'starts', 1200)} select source, node, round(cost, 6) as cost, prev_edge from best_p")(
    lambda t: from_gauges(t).select("source", "node", r6(C("cost"), "cost"), "prev_edge"))


def from_gauges(t) -> DataFrame:
    """Seconds on foot, up to 1,200 (1,500 m), from the node nearest to each gauge."""
    edges = walk(t)
    at = P.nearest_any(t.gauges.select("gauge_id", "x", C("y").cast("double").alias("y")), nodes_of(edges), 500.0, "gauge_id", "node")
    return N.shortest(edges, at.where("other is not null").select(C("other").alias("source"), C("other").alias("node")), cells(t), 1200.0)


query("n11_equal_cost_ties", f"""with recursive {WALK}, {adjacent('adj', 'walk')}, {NODES}, {GAUGE_NODES}, {search('best', 'adj', 'starts', 1200)},
tight as (select k.source, x.node as u, k.node as v from best k join best x on x.source = k.source join adj a on a.a = x.node and a.b = k.node and abs(x.cost + a.cost - k.cost) <= 1e-9),
amb as (select source, v as node from tight group by 1, 2 having count(*) > 1 union select g.source, g.v from amb a join tight g on g.source = a.source and g.u = a.node)
select source, node, a.node is not null as tied from best left join amb a using (source, node)""")(
    lambda t: N.tied(from_gauges(t), walk(t)))

#: Destinations: the first node of each square kilometre. Homes keep to nodes of the network before closures.
ANCHORS = "dest as (select min(node) as node from nodes group by floor(x / 1000), floor(y / 1000)), home as (select h.weight, n.node from {homes} h left join nodes n on n.node = h.place)"


def anchors(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges on foot, destinations, homes."""
    edges = walk(t)
    nodes = nodes_of(edges)
    dest = nodes.groupBy(F.floor(C("x") / 1000), F.floor(C("y") / 1000)).agg(F.min("node").alias("node")).select("node")
    return edges, dest, t.homes.join(nodes.select("node"), C("place") == C("node"), "left").select("node", "weight")


@query("n04_path_edges", f"""with recursive {WALK}, {adjacent('adj', 'walk')}, {NODES}, {ANCHORS}, starts as (select 0 as source, node from dest), {search('best', 'adj', 'starts', 1e300)},
back as (select node as target, node, 0 as n, null::varchar as edge_id from (select distinct h.node from home h join best b on b.node = h.node) union all select k.target, p.prev_node, k.n + 1, p.prev_edge from back k join best_p p on p.node = k.node where p.prev_node is not null)
select 0::bigint as source, target, (max(n) over (partition by target) - n)::int as seq, b.node, edge_id, round(p.cost, 6) as cost from back b join best_p p on p.node = b.node""")
def _(t):
    """The ways from the nearest destination to each home."""
    edges, dest, homes = anchors(t)
    found = N.shortest(edges, dest.select(L(0).alias("source"), "node"), cells(t))
    asked = homes.where("node is not null").select(L(0).cast("long").alias("source"), C("node").alias("target"))
    return N.path_edges(found, asked).withColumn("cost", F.round("cost", 6))


SNAPPED = """o as (select origin, arg_min(node, (d, node)) as o_node from (select distinct origin, n.node, sqrt((ox - n.x) ** 2 + (oy - n.y) ** 2) as d from (select distinct origin, ox, oy from {journeys}) j join nodes n on abs(ox - n.x) <= 250 and abs(oy - n.y) <= 250) where d <= 250 group by 1),
g as (select destination, arg_min(node, (d, node)) as d_node from (select distinct destination, n.node, sqrt((dx - n.x) ** 2 + (dy - n.y) ** 2) as d from (select distinct destination, dx, dy from {journeys}) j join nodes n on abs(dx - n.x) <= 250 and abs(dy - n.y) <= 250) where d <= 250 group by 1)"""


def journeys(t) -> DataFrame:
    """Trips with the nodes within 250 m of both ends."""
    nodes = T.held(nodes_of(walk(t)))
    j = t.journeys
    for key, x, y, name in (("origin", "ox", "oy", "o_node"), ("destination", "dx", "dy", "d_node")):
        near = T.nearest(j.select(key, C(x).alias("x"), C(y).alias("y")).distinct(), nodes, 250.0, key, "node")
        j = j.join(near.select(key, C("other").alias(name)), key, "left")
    return T.held(j.select("trip_id", "depart_s", "o_node", "d_node"))


def searched(t, trips: DataFrame, edges: DataFrame) -> DataFrame:
    return N.shortest(edges, trips.where("o_node is not null").select(C("o_node").alias("source"), C("o_node").alias("node")), cells(t), 1500.0)


REASON = "case when o_node is null then 'origin_not_near_network' when d_node is null then 'destination_not_near_network' when b.cost is null then 'no_path_in_time' end"
query("n05_routed_trips", f"""with recursive {WALK}, {adjacent('adj', 'walk')}, {NODES}, {SNAPPED}, starts as (select distinct o_node as source, o_node as node from o), {search('best', 'adj', 'starts', 1500)}
select trip_id, o_node, d_node, round(b.cost, 6) as duration_s, {REASON} as reason from {{journeys}} left join o using (origin) left join g using (destination) left join best b on b.source = o_node and b.node = d_node""")(
    lambda t: (lambda j: N.routed(j, searched(t, j, walk(t))).select("trip_id", "o_node", "d_node", r6(C("duration_s"), "duration_s"), "reason"))(journeys(t)))
query("n07_trip_outcomes", f"""with recursive {WALK}, {WET}, {adjacent('adj', 'walk')}, {adjacent('wadj', 'wet')}, {NODES}, {SNAPPED}, starts as (select distinct o_node as source, o_node as node from o), {search('best', 'adj', 'starts', 1500)}, {search('wbest', 'wadj', 'starts', 1500)}
select trip_id, case when b.cost is null then 'not_routed_dry' when depart_s < 64800 or depart_s > 72000 then 'outside_window' when w.cost is null then 'no_route' when w.cost - b.cost <= 0.01 then 'unaffected' else 'delayed' end as outcome, case when depart_s between 64800 and 72000 then round(w.cost - b.cost, 6) end as delay_s
from {{journeys}} left join o using (origin) left join g using (destination) left join best b on b.source = o_node and b.node = d_node left join wbest w on w.source = o_node and w.node = d_node""")(
    lambda t: (lambda j: outcomes(j, searched(t, j, walk(t)), searched(t, j, wet_walk(t))))(journeys(t)))


def outcomes(trips: DataFrame, dry: DataFrame, wet: DataFrame) -> DataFrame:
    """(trip_id, outcome, delay_s) of trips in the flood's window, by their costs on the dry and the flooded network."""
    side = lambda df, name: df.select(C("source").alias("o_node"), C("node").alias("d_node"), C("cost").alias(name))
    j = trips.join(side(dry, "dry"), ["o_node", "d_node"], "left").join(side(wet, "wet"), ["o_node", "d_node"], "left")
    late = C("depart_s").between(64800, 72000)
    outcome = F.when(C("dry").isNull(), "not_routed_dry").when(~late, "outside_window").when(C("wet").isNull(), "no_route").when(C("wet") - C("dry") <= 0.01, "unaffected").otherwise("delayed")
    return j.select("trip_id", outcome.alias("outcome"), F.when(late, F.round(C("wet") - C("dry"), 6)).alias("delay_s"))


# --- closures ---------------------------------------------------------------------------------------------------------
DRAW = "('0x' || substr(sha256(concat_ws('|', '5', 'closure', edge_id)), 1, 13))::bigint::double / 4503599627370496"
SCREENED = f"""{WALK}, {adjacent('adj', 'walk')}, {NODES}, {ANCHORS}, cases(source, year, fraction) as (values {", ".join(f"({k}, {y}, {f}::double)" for k, (y, f) in enumerate(CASES))}),
shut as (select c.source, w.edge_id from cases c join {{wet_edges}} w on w.year = c.year where {DRAW} < c.fraction), starts as (select c.source, d.node from cases c, dest d), {search('best', 'adj', 'starts', 1e300, 'shut')},
screened as (select c.year, c.fraction, sum(h.weight) as people, sum(case when b.cost is not null then h.weight else 0 end) as reached, round(sum(case when b.cost is not null then h.weight else 0 end) / sum(h.weight), 6) as share, sum(case when b.cost <= 900 then h.weight else 0 end) as within_900_s, sum(case when b.cost <= 1800 then h.weight else 0 end) as within_1800_s from cases c cross join home h left join best b on b.source = c.source and b.node = h.node group by 1, 2)"""


def screened(t) -> DataFrame:
    edges, dest, homes = anchors(t)
    return N.screened(N.with_closures(edges, t.wet_edges, CASES, 5), dest, homes, cells(t), CASES)


query("n09_connectivity_screening", f"with recursive {SCREENED} select * from screened")(screened)


@query("n10_compared_years", f"with recursive {SCREENED} select fraction, min(share) as least, max(share) as most, round(max(share) - min(share), 6) as spread, arg_min(year, (share, year)) as worst_year, count(*) as years from screened where fraction > 0 group by 1")
def _(t):
    s = screened(t).where("fraction > 0")
    return s.groupBy("fraction").agg(F.min("share").alias("least"), F.max("share").alias("most"), F.round(F.max("share") - F.min("share"), 6).alias("spread"), F.min_by("year", F.struct("share", "year")).alias("worst_year"), F.count("*").alias("years"))
