"""Registered queries: name -> function of (spark, sf_dir), and the same in DuckDB's SQL."""

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import values as V
from tidelens.operators import places as P
from tidelens.operators import tables as T
from tidelens.sources.derived import Tables, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C, L = F.col, F.lit
# Depth in metres up to which speed is full, where it is least, where a mode closes, and the least factor.
THRESHOLDS = {0: (0.1, 0.3, 0.5, 0.4), 3: (0.05, 0.2, 0.3, 0.3)}
BANDS = (("low", 0.0), ("moderate", 0.25), ("high", 0.5), ("very_high", 0.75))
SHARES = [(b, s, round(p * q, 4)) for b, p in (("0-14", 0.2), ("15-64", 0.65), ("65+", 0.15)) for s, q in (("F", 0.52), ("M", 0.48))]
STATES = """(select e.edge_id, e.length_m, e.max_depth_m, t.time_s, m.mode, e.max_depth_m * t.multiplier as depth_m from {edge_depths} e cross join {times} t cross join (select 0 as mode union all select 3) m)"""
FACTOR = """case when depth_m is null then null when mode = 0 then case when depth_m <= 0.1 then 1.0::double when depth_m < 0.3 then 1.0 + (0.4 - 1.0) * (depth_m - 0.1::double) / (0.3::double - 0.1::double) when depth_m < 0.5 then 0.4 + (0.0 - 0.4) * (depth_m - 0.3::double) / (0.5::double - 0.3::double) else 0 end
 else case when depth_m <= 0.05 then 1.0::double when depth_m < 0.2 then 1.0 + (0.3 - 1.0) * (depth_m - 0.05::double) / (0.2::double - 0.05::double) when depth_m < 0.3 then 0.3 + (0.0 - 0.3) * (depth_m - 0.2::double) / (0.3::double - 0.2::double) else 0 end end"""
CLOSED = "depth_m >= case mode when 0 then 0.5::double else 0.3::double end"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def states(t: Tables) -> DataFrame:
    return T.edge_states(t.edge_depths, t.times, THRESHOLDS)


# --- values -----------------------------------------------------------------------------------------------------------
query("x08_grid_cell", "select c_custkey, concat_ws('_', 'g1km', (floor((660050 + 37 * c_custkey) / 1000)::bigint * 1000)::varchar, (floor((1510050 + 53 * c_custkey) / 1000)::bigint * 1000)::varchar) as cell from customer")(
    lambda t: t.customer.select("c_custkey", V.grid_id("g1km", 660050 + 37 * C("c_custkey"), 1510050 + 53 * C("c_custkey"), 1000).alias("cell")))
query("x10_block_of_point", "select s_suppkey, floor((s_suppkey * 37 + 25) / 100)::bigint as bi, floor((s_suppkey * 53 + 25) / 100)::bigint as bj from supplier")(
    lambda t: t.supplier.select("s_suppkey", F.floor((C("s_suppkey") * 37 + 25) / 100).alias("bi"), F.floor((C("s_suppkey") * 53 + 25) / 100).alias("bj")))
query("x11_stable_ids", "select c_custkey, concat('p_', substr(sha256(concat_ws('|', 'v1', c_custkey::varchar)), 1, 20)) as person_id from customer")(
    lambda t: t.customer.select("c_custkey", V.stable_id("p_", 20, L("v1"), C("c_custkey")).alias("person_id")))
query("x12_edge_keys", "select edge_id, sha256(concat_ws('|', least(u, v)::varchar, greatest(u, v)::varchar)) as key from {edges}")(
    lambda t: t.edges.select("edge_id", V.edge_key(C("v"), C("u")).alias("key")))
query("x13_heights", r"""select id, round_even(case when regexp_extract(height_text, '^\s*(\d+(?:\.\d+)?)\s*(m|ft|'')?\s*$', 1) = '' then null else regexp_extract(height_text, '^\s*(\d+(?:\.\d+)?)\s*(m|ft|'')?\s*$', 1)::double * case when regexp_extract(height_text, '^\s*(\d+(?:\.\d+)?)\s*(m|ft|'')?\s*$', 2) = 'ft' then 0.3048 else 1 end end, 2) as height_m,
 try_cast(nullif(regexp_extract(level_text, '^\s*(\d+(?:\.\d+)?)', 1), '') as double) as levels from {tags}""")(
    lambda t: t.tags.select("id", V.height_m(C("height_text")).alias("height_m"), V.levels(C("level_text")).alias("levels")))


@query("x14_height_precedence", r"""with h as (select id, case when height_text = 'no' then null else try_cast(regexp_extract(height_text, '(\d+(?:\.\d+)?)', 1) as double) * case when height_text like '%ft' then 0.3048 else 1 end end as raw, try_cast(nullif(regexp_extract(level_text, '^\s*(\d+(?:\.\d+)?)', 1), '') as double) as lv from {tags})
select id, coalesce(round_even(raw, 2), lv * 3) as height_m, case when raw is not null then 'tag_height' when lv is not null then 'tag_levels' else 'unknown' end as height_source, case when raw is not null then 0.9 when lv is not null then 0.6 end::double as confidence from h""")
def _(t):
    h, lv = V.height_m(C("height_text")), V.levels(C("level_text"))
    return t.tags.select("id", F.coalesce(h, lv * V.LEVEL_M).alias("height_m"), F.when(h.isNotNull(), "tag_height").when(lv.isNotNull(), "tag_levels").otherwise("unknown").alias("height_source"), F.when(h.isNotNull(), 0.9).when(lv.isNotNull(), 0.6).alias("confidence"))


query("x17_footprint_area", "select id, round(w * h, 6) as area_m2, round(2 * (w + h), 6) as perimeter_m from {footprints}")(
    lambda t: t.footprints.withColumn("ring", F.array(*(F.struct((C("x") + a * C("w")).cast("double").alias("x"), (C("y") + b * C("h")).cast("double").alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))).select("id", r6(V.ring_area(C("ring")), "area_m2"), r6(V.line_length(C("ring")), "perimeter_m")))
query("x18_hydrograph", "select o_orderkey, round(case when s <= 64800 or s >= 79200 then 0 when s <= 72000 then (s - 64800)::double / 7200 else (79200 - s)::double / 7200 end, 6) as multiplier from (select o_orderkey, o_orderkey * 37 % 86400 as s from orders)")(
    lambda t: t.orders.select("o_orderkey", r6(V.hydrograph((C("o_orderkey") * 37 % 86400), 64800, 72000, 79200), "multiplier")))
query("x19_speed_factor", f"select edge_id, time_s, mode, round({FACTOR}, 6) as speed_multiplier from {STATES}")(
    lambda t: states(t).select("edge_id", "time_s", "mode", r6(C("speed_multiplier"), "speed_multiplier")))
query("x20_decayed_depth", "select p_partkey, round(p_size / 100::double * exp(-(p_partkey % 300)::double / greatest(80.0, 1)), 6) as depth_m from part")(
    lambda t: t.part.select("p_partkey", r6(V.decayed(C("p_size") / 100, (C("p_partkey") % 300).cast("double"), L(80.0)), "depth_m")))
query("x21_mode_choice", "select o_orderkey, case when d <= 800 then 0 when d <= 3000 and u < 0.5 then 0 else 3 end as mode from (select o_orderkey, o_custkey % 5000 as d, ('0x' || substr(sha256(concat_ws('|', '11', 'mode', o_orderkey::varchar)), 1, 13))::bigint::double / 4503599627370496 as u from orders)")(
    lambda t: t.orders.select("o_orderkey", F.when(C("o_custkey") % 5000 <= 800, 0).when((C("o_custkey") % 5000 <= 3000) & (V.uniform(11, "mode", C("o_orderkey")) < 0.5), 0).otherwise(3).alias("mode")))
query("x22_risk_band", "select p_partkey, case when s >= 0.75 then 'very_high' when s >= 0.5 then 'high' when s >= 0.25 then 'moderate' when s >= 0 then 'low' end as band from (select p_partkey, p_size / 50::double as s from part)")(
    lambda t: t.part.select("p_partkey", V.band(C("p_size") / L(50.0), BANDS).alias("band")))


@query("x23_min_max_scale", "select s_suppkey, round(case when hi - lo <= 1e-12 then 0.5 else (s_acctbal - lo) / (hi - lo) end, 6) as scaled from supplier, (select min(s_acctbal) lo, max(s_acctbal) hi from supplier)")
def _(t):
    m = t.supplier.agg(F.struct(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi")))
    s = t.supplier.withColumn("m", m.scalar())
    return s.select("s_suppkey", r6(F.when(C("m.hi") - C("m.lo") <= 1e-12, 0.5).otherwise((C("s_acctbal") - C("m.lo")) / (C("m.hi") - C("m.lo"))), "scaled"))


query("x25_known_flags", "select p_partkey, case when p_partkey % 5 = 0 and p_size % 4 = 0 then null else round(((case when p_partkey % 5 = 0 then 0 when p_partkey % 2 = 0 then 0.5 else 0 end) + (case when p_size % 4 = 0 then 0 when p_size % 3 = 0 then 0.5 else 0 end))::double / ((case when p_partkey % 5 = 0 then 0 else 1 end) + (case when p_size % 4 = 0 then 0 else 1 end)), 6) end as score from part")(
    lambda t: t.part.withColumns({"a": F.when(C("p_partkey") % 5 != 0, F.when(C("p_partkey") % 2 == 0, 0.5).otherwise(0.0)), "b": F.when(C("p_size") % 4 != 0, F.when(C("p_size") % 3 == 0, 0.5).otherwise(0.0))}).select("p_partkey", r6(V.ratio(F.coalesce("a", L(0.0)) + F.coalesce("b", L(0.0)), C("a").isNotNull().cast("int") + C("b").isNotNull().cast("int")), "score")))
query("x26_flags", "select l_orderkey, l_partkey, l_linenumber, case when l_linestatus in ('O') then null when l_linenumber % 2 = 0 then true else false end as flag from lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", V.flag(F.when(C("l_linestatus") == "O", "maybe").when(C("l_linenumber") % 2 == 0, " TRUE").otherwise("0")).alias("flag")))
query("x27_road_state", f"select edge_id, time_s, mode, case when closed then 'closed' when f < 1 then 'slowed' else 'open' end as state from (select edge_id, time_s, mode, {CLOSED} as closed, {FACTOR} as f from {STATES})")(
    lambda t: states(t).select("edge_id", "time_s", "mode", V.road_state(C("closed"), C("speed_multiplier")).alias("state")))
query("x29_water_known", "select year, px_row, px_col, code >= 2 as water, code <> 0 as known from {pixels}")(
    lambda t: t.pixels.select("year", "px_row", "px_col", (C("code") >= 2).alias("water"), (C("code") != 0).alias("known")))
query("x30_permanent_water", "select year, px_row, px_col, code = 3 as permanent from {pixels}")(
    lambda t: t.pixels.select("year", "px_row", "px_col", (C("code") == 3).alias("permanent")))
query("x31_pixel_area", "select distinct px_row, round(0.0309 * 0.0309 * cos(radians(13.7 + px_row * 0.001)), 9) as km2 from {pixels}")(
    lambda t: t.pixels.select("px_row").distinct().select("px_row", F.round(0.0309 * 0.0309 * F.cos(F.radians(13.7 + C("px_row") * 0.001)), 9).alias("km2")))
DRAW = "('0x' || substr(sha256(concat_ws('|', '7', '{}', person_id)), 1, 13))::bigint::double / 4503599627370496"
query("x32_draws", f"select person_id, u, round(sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b), 6) as z, len(list_filter({[sum(math.exp(-2) * 2**j / math.factorial(j) for j in range(k + 1)) for k in range(26)]}, lambda c: p >= c))::int as n, case when c < 0.5 then 'walk' when c < 0.8 then 'ride' else 'stay' end as choice from (select person_id, {DRAW.format('compliance')} as u, {DRAW.format('delay/u')} as a, {DRAW.format('delay/v')} as b, {DRAW.format('calls')} as p, {DRAW.format('choice')} as c from {{persons}})")(
    lambda t: t.persons.select("person_id", V.uniform(7, "compliance", C("person_id")).alias("u"), r6(V.normal(7, "delay", C("person_id")), "z"), V.poisson(7, "calls", C("person_id"), 2.0).alias("n"), V.categorical(7, "choice", C("person_id"), [("walk", 0.5), ("ride", 0.3), ("stay", 0.2)]).alias("choice")))
query("x33_whole_people", "select c_custkey, greatest(round_even(c_acctbal / 1000, 0), 1) as people from customer")(
    lambda t: t.customer.select("c_custkey", F.greatest(F.bround(C("c_acctbal") / 1000, 0), L(1.0)).alias("people")))
query("x34_clip", "select c_custkey, greatest(least(c_acctbal, 5000), 0)::double as clipped from customer")(
    lambda t: t.customer.select("c_custkey", V.clip(C("c_acctbal"), 0.0, 5000.0).alias("clipped")))
query("x35_edge_samples", "select edge_id, i, round(u % 50 * 50 + length_m * i / n, 6) as x from (select edge_id, u, length_m, greatest(ceil(length_m / 25)::bigint, 1) as n, unnest(range(0, greatest(ceil(length_m / 25)::bigint, 1) + 1)) as i from {edges})")(
    lambda t: t.edges.withColumn("n", F.greatest(F.ceil(C("length_m") / 25), L(1))).select("edge_id", "u", "length_m", "n", F.explode(F.sequence(L(0).cast("long"), C("n"))).alias("i")).select("edge_id", "i", r6(C("u") % 50 * 50 + C("length_m") * C("i") / C("n"), "x")))
query("x51_ratio", "select l_returnflag, l_linestatus, round(sum(case when l_discount > 0.05 then 1 else 0 end)::double / nullif(sum(case when l_tax > 0.079 then 1 else 0 end), 0), 6) as ratio from lineitem group by all")(
    lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(V.ratio(F.count_if(C("l_discount") > 0.05), F.count_if(C("l_tax") > 0.079)), 6).alias("ratio")))


def projected() -> str:
    """The projection and its inverse in DuckDB's SQL, from the same series."""
    radius, forth, back = V._series()
    n = V.FLAT / (2 - V.FLAT)
    e = 2 * n**0.5 / (1 + n)
    delta = V._latitudes()
    to = lambda f, g: " + ".join(f"{a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(forth, 1))
    fro = lambda f, g: " + ".join(f"{a!r} * {f}({2 * j} * xi0) * {g}({2 * j} * eta0)" for j, a in enumerate(back, 1))
    return f"""with a as (select person_id, lon, lat, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) as t, radians(lon - {V.LON0!r}) as d from {{persons}}), b as (select *, atan2(t, cos(d)) as xi, asinh(sin(d) / sqrt(t * t + cos(d) ** 2)) as eta from a),
c as (select *, {V.E0!r} + {V.K0 * radius!r} * (eta + {to('cos', 'sinh')}) as x, {V.K0 * radius!r} * (xi + {to('sin', 'cosh')}) as y from b), f as (select *, y / {V.K0 * radius!r} as xi0, (x - {V.E0!r}) / {V.K0 * radius!r} as eta0 from c),
g as (select *, xi0 - ({fro('sin', 'cosh')}) as xi1, eta0 - ({fro('cos', 'sinh')}) as eta1 from f), h as (select *, asin(sin(xi1) / cosh(eta1)) as chi from g)
select person_id, round(x, 3) as x, round(y, 3) as y, round({V.LON0!r} + degrees(atan2(sinh(eta1), cos(xi1))), 6) as lon, round(degrees(chi + {" + ".join(f"{d!r} * sin({2 * j} * chi)" for j, d in enumerate(delta, 1))}), 6) as lat from h"""


@query("x01_x02_projection", projected())
def _(t):
    p = t.persons
    x, y = V.to_utm(C("lon"), C("lat"))
    p = p.select("person_id", "lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = V.from_utm(C("x"), C("y"))
    return p.select("person_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


query("x03_tiles", "select person_id, least(greatest(floor((lon + 180) / 360 * 16384), 0), 16383)::bigint as tx, least(greatest(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384), 0), 16383)::bigint as ty from {persons}")(
    lambda t: t.persons.select("person_id", V.tile(C("lon"), C("lat"), 14).alias("t")).select("person_id", C("t.x").alias("tx"), C("t.y").alias("ty")))

# --- filters ----------------------------------------------------------------------------------------------------------
query("f01_walkable", "select edge_id from {edges} where highway in ('residential', 'primary', 'footway')")(lambda t: t.edges.where(C("highway").isin("residential", "primary", "footway")).select("edge_id"))
query("f04_storage_floor", "select cell_id, time_s from {slices} where depth_m > 0.01 and time_s > 64800")(lambda t: t.slices.where("depth_m > 0.01 and time_s > 64800").select("cell_id", "time_s"))
query("f06_present_at", "select distinct user_id from {activities} where start_s <= 43200 and 43200 < end_s")(lambda t: t.activities.where("start_s <= 43200 and 43200 < end_s").select("user_id").distinct())
query("f07_attractors", "select p_partkey from part where p_type in (select p_type from part group by 1 order by 1 limit 2)")(lambda t: t.part.join(t.part.select("p_type").distinct().orderBy("p_type").limit(2), "p_type", "left_semi").select("p_partkey"))
query("f08_closed_window", "select event_id from events where ts between timestamp '2024-01-01 06:00:00' and timestamp '2024-01-10 00:00:00'")(lambda t: t.events.where("ts between timestamp '2024-01-01 06:00:00' and timestamp '2024-01-10 00:00:00'").select("event_id"))
query("f09_half_open_window", "select event_id from events where ts >= timestamp '2024-01-01 06:00:00' and ts < timestamp '2024-01-10 00:00:00'")(lambda t: t.events.where("ts >= timestamp '2024-01-01 06:00:00' and ts < timestamp '2024-01-10 00:00:00'").select("event_id"))
query("f12_viewport", "select id from {footprints} where x + w >= 100 and x <= 900 and y + h >= 50 and y <= 700")(lambda t: t.footprints.where("x + w >= 100 and x <= 900 and y + h >= 50 and y <= 700").select("id"))
query("f13_default_time", "select cell_id, depth_m from {slices} where time_s = (select min(time_s) from {slices})")(lambda t: t.slices.where(C("time_s") == t.slices.agg(F.min("time_s")).scalar()).select("cell_id", "depth_m"))
query("f14_positive_depth", "select sensor_id, event_id from {readings} where depth_m > 0")(lambda t: t.readings.where("depth_m > 0").select("sensor_id", "event_id"))
query("f15_order_radius", "select person_id from {persons}, (select avg(lon) mx, avg(lat) my from {persons}) where sqrt((lon - mx) * (lon - mx) + (lat - my) * (lat - my)) <= 1500 / 111320.0::double")(
    lambda t: t.persons.join(F.broadcast(t.persons.agg(F.avg("lon").alias("mx"), F.avg("lat").alias("my")))).where(F.sqrt((C("lon") - C("mx")) * (C("lon") - C("mx")) + (C("lat") - C("my")) * (C("lat") - C("my"))) <= 1500 / 111320.0).select("person_id"))

# --- joins ------------------------------------------------------------------------------------------------------------
query("j01_reconcile", "select cell_id, round(pop * case when c.total is null then 1 else c.total / s end, 6) as scaled from {cells} x join (select control_group as g, sum(pop) s from {cells} group by 1) y on y.g = x.control_group left join (select distinct control_group as cg, (1000 + 100 * control_group)::double as total from {cells} where control_group < 4) c on c.cg = x.control_group")(
    lambda t: T.reconcile(t.cells, t.cells.where("control_group < 4").select("control_group", (1000 + 100 * C("control_group")).cast("double").alias("total")).distinct(), "control_group", "pop", "total").select("cell_id", r6(C("scaled"), "scaled")))
query("j02_people_cells", "select person_id, gx, gy from {persons} p join {cells} c on p.home_cell_id = c.cell_id")(lambda t: t.persons.join(t.cells, C("home_cell_id") == C("cell_id")).select("person_id", "gx", "gy"))
query("j05_as_of_state", f"select trip_id, s.time_s as state_time_s, s.multiplier from {{trips}} t left join lateral (select time_s, multiplier from {{times}} where time_s <= depart_s order by time_s desc limit 1) s on true")(
    lambda t: T.as_of(t.trips.withColumn("k", L(1) + C("trip_id") % 64), t.times.select("*", F.explode(F.sequence(L(1).cast("long"), L(64).cast("long"))).alias("k")), "k", "depart_s", "time_s", "multiplier", 3600).select("trip_id", C("time_s").alias("state_time_s"), "multiplier"))


@query("j06_state_volume", f"select s.edge_id, s.mode, s.closed, coalesce(v.volume, 0) as volume from (select edge_id, mode, {CLOSED} as closed from {STATES} where time_s = 68400) s left join (select concat('r', (l_partkey)::varchar) as edge_id, count(*) as volume from lineitem group by 1) v using (edge_id)")
def _(t):
    v = t.lineitem.groupBy(F.concat(L("r"), C("l_partkey").cast("string")).alias("edge_id")).agg(F.count("*").alias("volume"))
    return states(t).where("time_s = 68400").join(v, "edge_id", "left").select("edge_id", "mode", "closed", F.coalesce("volume", L(0)).alias("volume"))


query("j08_nearest_within", "select s_suppkey, arg_min(gauge_id, (d, gauge_id)) filter (d <= 400) as other from (select s_suppkey, g.gauge_id, sqrt((s_suppkey * 41.5::double - g.x) ** 2 + (s_suppkey * 13.5::double - g.y) ** 2) as d from supplier, {gauges} g) group by 1")(
    lambda t: T.nearest(t.supplier.select("s_suppkey", (C("s_suppkey") * 41.5).alias("x"), (C("s_suppkey") * 13.5).alias("y")), t.gauges, 400.0, "s_suppkey", "gauge_id").select("s_suppkey", "other"))
query("j21_outside_domain", "select user_id, count(*) as n from events where user_id not in (select s_suppkey from supplier) group by 1")(
    lambda t: t.events.join(t.supplier, C("user_id") == C("s_suppkey"), "left_anti").groupBy("user_id").agg(F.count("*").alias("n")))
query("j22_idw_rain", "select bi, bj, round(coalesce(avg(total) filter (d <= 1e-6), sum(total / (d * d)) filter (d > 1e-6) / sum(1 / (d * d)) filter (d > 1e-6)), 6) as rain from (select bi, bj, total, sqrt((bi * 100 - g.x) ** 2 + (bj * 100 - g.y) ** 2) as d from {blocks}, {gauges} g) group by 1, 2")(
    lambda t: T.idw(t.blocks.select("bi", "bj", (C("bi") * 100).cast("double").alias("x"), (C("bj") * 100).cast("double").alias("y")), t.gauges.select(C("x").cast("double").alias("x"), C("y").cast("double").alias("y"), "total")).select("bi", "bj", r6(C("rain"), "rain")))
query("j27_outcome_compare", "select coalesce(a.o_orderkey, b.o_orderkey) as k, a.o_totalprice is not distinct from b.p or abs(a.o_totalprice - b.p) <= 1e-6 as same from orders a full join (select o_orderkey, case when o_orderkey % 10 = 0 then o_totalprice + 1 else o_totalprice end as p from orders where o_orderkey % 7 <> 0) b using (o_orderkey)")(
    lambda t: t.orders.select(C("o_orderkey").alias("k"), "o_totalprice").join(t.orders.where("o_orderkey % 7 <> 0").select(C("o_orderkey").alias("k"), F.when(C("o_orderkey") % 10 == 0, C("o_totalprice") + 1).otherwise(C("o_totalprice")).alias("p")), "k", "full").select("k", (C("o_totalprice").eqNullSafe(C("p")) | (F.abs(C("o_totalprice") - C("p")) <= 1e-6)).alias("same")))
query("j29_same_rows", "select (select count(*) from (select person_id, weight from {persons} except all select person_id, weight from {persons} where k % 9 <> 0)) as only_first, 0::bigint as only_second")(
    lambda t: (a := t.persons.select("person_id", "weight")).exceptAll(b := t.persons.where("k % 9 <> 0").select("person_id", "weight")).agg(F.count("*").alias("only_first")).join(b.exceptAll(a).agg(F.count("*").alias("only_second"))))

# --- groupings --------------------------------------------------------------------------------------------------------
query("a01_demographics", "select cell_id, s.age_band, s.sex_code, round(case when s.n < 5 then round_even(pop * s.p, 6) else pop - b end, 6) as weight from (select *, " + " + ".join(f"round_even(pop * {p}::double, 6)" for _, _, p in SHARES[:-1]) + " as b from {cells}) c cross join (values " + ", ".join(f"({k}, '{b}', '{s}', {p}::double)" for k, (b, s, p) in enumerate(SHARES)) + ") s(n, age_band, sex_code, p)")(
    lambda t: T.demographics(t.cells, "pop", SHARES).select("cell_id", "age_band", "sex_code", r6(C("weight"), "weight")))
query("a03_population_summary", "select 'sex_code' as dimension, sex_code as value, count(*) as n, sum(weight) as weight from {persons} group by 2 union all select 'age_band', age_band, count(*), sum(weight) from {persons} group by 2 union all select 'mobility_profile', mobility_profile, count(*), sum(weight) from {persons} group by 2")(
    lambda t: T.totals(t.persons, ["sex_code", "age_band", "mobility_profile"], "weight"))
query("a04_age_marginal", "select age_band, sum(weight) / (select sum(weight) from {persons}) as share from {persons} group by 1")(lambda t: T.shares(t.persons, "age_band", "weight").select("age_band", "share"))
query("a05_height_coverage", "select count(*) as n, count(*) filter (height_text <> 'no') as with_height, count(level_text) as with_levels, round(count(*) filter (height_text <> 'no') / count(*), 6) as share from {tags}")(
    lambda t: t.tags.agg(F.count("*").alias("n"), F.count_if(C("height_text") != "no").alias("with_height"), F.count("level_text").alias("with_levels"), r6(V.ratio(F.count_if(C("height_text") != "no"), F.count("*")), "share")))
query("a06_attractor_classes", "select use_class, count(*) as n, sum(w * h) as footprint_m2 from {footprints} group by 1")(lambda t: t.footprints.groupBy("use_class").agg(F.count("*").alias("n"), F.sum(C("w") * C("h")).alias("footprint_m2")))
query("a07_presence", "with a as (select *, unnest(range(0, 144)) * 600 as time_s from {activities}), b as (select user_id, time_s, arg_max((place, weight), (start_s, event_id)) as l from a where time_s >= start_s and time_s < end_s group by 1, 2) select l[1] as place, time_s, sum(l[2]) as total, count(*) as people from (select time_s, [struct_extract_at(l, 1)::double, struct_extract_at(l, 2)::double] as l from b) group by 1, 2")(
    lambda t: T.presence(t.activities.where("start_s < 86400"), "user_id", "place", "start_s", "end_s", "weight", 600, "event_id").where("time_s < 86400").select(C("place").cast("double").alias("place"), "time_s", "total", "people"))
query("a08_link_volume", "select l_partkey as edge, floor(l_quantity / 10)::bigint as hour, l_linenumber % 2 as mode, count(*) as traversals from lineitem group by all")(
    lambda t: t.lineitem.groupBy(C("l_partkey").alias("edge"), F.floor(C("l_quantity") / 10).alias("hour"), (C("l_linenumber") % 2).alias("mode")).agg(F.count("*").alias("traversals")))
query("a09_coarse_cells", "select floor(x / 1000)::bigint as gx, floor(y / 1000)::bigint as gy, round(sum(pop), 6) as pop from {cells} group by 1, 2")(
    lambda t: t.cells.groupBy(F.floor(C("x") / 1000).alias("gx"), F.floor(C("y") / 1000).alias("gy")).agg(F.round(F.sum("pop"), 6).alias("pop")))
query("a10_water_cells", "select year, px_row // 10 as gy, px_col // 10 as gx, count(*) filter (code >= 2) as water_px, count(*) filter (code <> 0) as known_px, round(count(*) filter (code >= 2) / nullif(count(*) filter (code <> 0), 0), 6) as water_share, round(count(*) filter (code >= 2) * 0.0009::double, 6) as water_km2 from {pixels} group by 1, 2, 3 having count(*) filter (code >= 2) > 0")(
    lambda t: t.pixels.groupBy("year", F.floor(C("px_row") / 10).alias("gy"), F.floor(C("px_col") / 10).alias("gx")).agg(F.count_if(C("code") >= 2).alias("water_px"), F.count_if(C("code") != 0).alias("known_px")).where("water_px > 0").withColumns({"water_share": F.round(V.ratio(C("water_px"), C("known_px")), 6), "water_km2": F.round(C("water_px") * 0.0009, 6)}))
query("a11_year_classes", "select year, count(*) as pixels, count(*) filter (code = 0) as unknown, count(*) filter (code = 2) as seasonal, count(*) filter (code = 3) as permanent, round(count(*) filter (code >= 2) / count(*) filter (code <> 0), 6) as water_share from {pixels} group by 1")(
    lambda t: t.pixels.groupBy("year").agg(F.count("*").alias("pixels"), F.count_if(C("code") == 0).alias("unknown"), F.count_if(C("code") == 2).alias("seasonal"), F.count_if(C("code") == 3).alias("permanent"), F.round(V.ratio(F.count_if(C("code") >= 2), F.count_if(C("code") != 0)), 6).alias("water_share")))
query("a12_ever_water", "select count(*) as pixels, count(*) filter (c >= 2) as ever_water from (select px_row, px_col, max(code) as c from {pixels} group by 1, 2)")(
    lambda t: t.pixels.groupBy("px_row", "px_col").agg(F.max("code").alias("c")).agg(F.count("*").alias("pixels"), F.count_if(C("c") >= 2).alias("ever_water")))
query("a13_excess_over_first", "select year, n - first_value(n) over (order by year) as excess from (select year, count(*) filter (code >= 2) as n from {pixels} group by 1)")(
    lambda t: t.pixels.groupBy("year").agg(F.count_if(C("code") >= 2).alias("n")).select("year", (C("n") - F.first("n").over(Window.orderBy("year"))).alias("excess")))
query("a15_outcome_pivot", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")(
    lambda t: t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().select("o_orderpriority", *(F.coalesce(C(c), L(0)).alias(c.lower()) for c in "FOP")))
QUANTILE = "select state, " + ", ".join(f"min(event_time_s) filter (run >= all_ * {q}::decimal(6,4)) as q{round(100 * q)}" for q in (0.05, 0.5, 0.95)) + " from (select state, event_time_s, sum(sum(weight::decimal(38,12))) over (partition by state order by event_time_s) as run, sum(sum(weight::decimal(38,12))) over (partition by state) as all_ from {states} group by 1, 2) group by 1"
query("a16_weighted_quantiles", QUANTILE.replace("decimal(38,12)", "decimal(28,6)"))(lambda t: T.quantiles(t.states, ["state"], "event_time_s", "weight", [0.05, 0.5, 0.95]))
query("a17_percentiles", "select state, quantile_cont(event_time_s, 0.05) as p5, quantile_cont(event_time_s, 0.5) as p50, quantile_cont(event_time_s, 0.95) as p95 from {states} group by 1")(
    lambda t: t.states.groupBy("state").agg(F.percentile("event_time_s", [0.05, 0.5, 0.95]).alias("p")).select("state", C("p")[0].alias("p5"), C("p")[1].alias("p50"), C("p")[2].alias("p95")))
query("a18_within_minutes", "select sum(weight) filter (event_time_s - 64800 <= 900) as m15, sum(weight) filter (event_time_s - 64800 <= 1800) as m30, sum(weight) filter (event_time_s - 64800 <= 3600) as m60, sum(weight) filter (event_time_s - 64800 <= 7200) as m120 from {states} where state = 'arrived'")(
    lambda t: t.states.where("state = 'arrived'").agg(*(F.sum(F.when(C("event_time_s") - 64800 <= 60 * m, C("weight"))).alias(f"m{m}") for m in (15, 30, 60, 120))))
query("a19_state_shares", "select state, count(*) as n, sum(weight) as weight, round(sum(weight) / (select sum(weight) from {states}), 6) as share from {states} group by 1")(lambda t: T.shares(t.states, "state", "weight").withColumn("share", F.round("share", 6)))
query("a20_reason_weights", "select reason, sum(weight) as weight from {states} where reason is not null group by 1")(lambda t: t.states.where("reason is not null").groupBy("reason").agg(F.sum("weight").alias("weight")))
query("a21_traversals", "select dest_id as edge, sum(weight) as weight from {states} where state = 'arrived' group by 1")(lambda t: t.states.where("state = 'arrived'").groupBy(C("dest_id").alias("edge")).agg(F.sum("weight").alias("weight")))
SIX = """d as (select 'full' as name, k, weight from {persons} union all select 'sample', k, weight from {persons} where k % 4 = 0 union all select 'present', k, weight from {persons} p where exists (select 1 from {activities} a where a.user_id = p.k and a.start_s <= 64800 and a.end_s > 64800)
 union all select 'exposed', k, weight from {persons} p where exists (select 1 from {homes} h join {wet_edges} w on w.edge_id = concat('u', h.place::varchar) where h.person_id = p.person_id and w.year = 2010)
 union all select 'cohort', k, weight from {persons} p where k % 4 = 0 and exists (select 1 from {homes} h join {wet_edges} w on w.edge_id = concat('u', h.place::varchar) where h.person_id = p.person_id and w.year = 2010)
 union all select 'states', p.k, p.weight from {persons} p where exists (select 1 from {states} s where s.person = p.k))"""
query("a22_denominators", f"with {SIX} select name, count(*) as n, sum(weight) as weight, round(sum(weight) / (select sum(weight) from {{persons}}), 6) as share, (select count(*) from d o where o.name = d.name and o.k not in (select k from {{persons}})) = 0 and sum(weight) <= (select sum(weight) from {{persons}}) as holds from d group by name")(
    lambda t: denominators(t))


def denominators(t: Tables) -> DataFrame:
    """Rows and weights of six populations, their shares of all, and whether each is part of all and weighs no more."""
    p = t.persons.select("k", "person_id", "weight")
    here = t.activities.where("start_s <= 64800 and end_s > 64800").select(C("user_id").alias("k"))
    wet = t.wet_edges.where("year = 2010").select("edge_id")
    exposed = t.homes.select("person_id", F.concat(L("u"), C("place").cast("string")).alias("edge_id")).join(wet, "edge_id", "left_semi").select("person_id")
    parts = {"full": p, "sample": p.where("k % 4 = 0"), "present": p.join(here, "k", "left_semi"), "exposed": p.join(exposed, "person_id", "left_semi"), "cohort": p.where("k % 4 = 0").join(exposed, "person_id", "left_semi"), "states": p.join(t.states.select(C("person").alias("k")), "k", "left_semi")}
    return T.denominators({n: d.select("k", "weight") for n, d in parts.items()}, "full", "k", "weight").select("name", "n", "weight", r6(C("share"), "share"), "holds")


query("a24_conservation", "select round(abs(sum(weight) - (select sum(l_quantity) from lineitem)), 6) as gap, count(*) filter (state not in ('arrived', 'shelter_in_place', 'unreachable', 'refuge_full')) as bad from {states}")(
    lambda t: t.states.agg(F.round(F.abs(F.sum("weight") - t.lineitem.agg(F.sum("l_quantity")).scalar()), 6).alias("gap"), F.count_if(~C("state").isin("arrived", "shelter_in_place", "unreachable", "refuge_full")).alias("bad")))
query("a25_band_summary", "select band, count(*) as n, round(avg(s), 6) as mean, count(*) filter (s is null) as nulls, min(s) as low, quantile_cont(s, 0.5) as median, max(s) as high from (select p_size / 50::double as s, case when p_size >= 37.5 then 'very_high' when p_size >= 25 then 'high' when p_size >= 12.5 then 'moderate' else 'low' end as band from part) group by 1")(
    lambda t: t.part.select((C("p_size") / L(50.0)).alias("s")).withColumn("band", V.band(C("s"), BANDS)).groupBy("band").agg(F.count("*").alias("n"), r6(F.avg("s"), "mean"), F.count_if(C("s").isNull()).alias("nulls"), F.min("s").alias("low"), F.percentile("s", 0.5).alias("median"), F.max("s").alias("high")))
query("a27_network_totals", "select count(*) as edges, (select count(distinct n) from (select u as n from {edges} union all select v from {edges})) as nodes, sum(length_m) filter (walk_allowed) / 1000 as walk_km, sum(length_m) filter (vehicle_allowed) / 1000 as vehicle_km from {edges}")(
    lambda t: t.edges.agg(F.count("*").alias("edges"), (F.sum(F.when(C("walk_allowed"), C("length_m"))) / 1000).alias("walk_km"), (F.sum(F.when(C("vehicle_allowed"), C("length_m"))) / 1000).alias("vehicle_km")).withColumn("nodes", t.edges.select(F.explode(F.array("u", "v")).alias("n")).agg(F.countDistinct("n")).scalar()))
query("a29_run_stats", f"select count(distinct edge_id) filter (closed) as closed_edges, round(avg(f), 6) as mean_factor from (select edge_id, {CLOSED} as closed, {FACTOR} as f from {STATES})")(
    lambda t: states(t).agg(F.countDistinct(F.when(C("closed"), C("edge_id"))).alias("closed_edges"), F.round(F.avg("speed_multiplier"), 6).alias("mean_factor")))
query("a31_how_big", "select time_s, count(distinct cell_id) * 0.0025::double as km2 from {slices} where depth_m >= 0.15 group by 1")(lambda t: t.slices.where("depth_m >= 0.15").groupBy("time_s").agg((F.countDistinct("cell_id") * 0.0025).alias("km2")))
query("a32_how_deep", "select time_s, max(depth_m) as max_depth_m, count(*) filter (depth_m >= 0.5) as at_walk_closing, count(*) filter (depth_m >= 0.3) as at_vehicle_closing from {slices} group by 1")(
    lambda t: t.slices.groupBy("time_s").agg(F.max("depth_m").alias("max_depth_m"), F.count_if(C("depth_m") >= 0.5).alias("at_walk_closing"), F.count_if(C("depth_m") >= 0.3).alias("at_vehicle_closing")))


@query("a33_movement_by_mode", f"with s as (select *, {CLOSED} as closed, {FACTOR} as f from {STATES} where time_s = 68400), g as (select mode, case when closed then 'closed' when f < 1 then 'slowed' else 'open' end as state, sum(length_m) as m from s join {{edge_depths}} d using (edge_id, length_m) where case mode when 0 then d.walk_allowed else d.vehicle_allowed end group by 1, 2) select mode, state, round(m / 1000, 6) as km, round(m / sum(m) over (partition by mode), 6) as share from g")
def _(t):
    peak = t.slices.groupBy("time_s").agg(F.max("depth_m").alias("d")).agg(F.min_by("time_s", F.struct(-C("d"), C("time_s")))).scalar()
    s = states(t)
    edges = s.where(F.when(C("mode") == 0, C("walk_allowed")).otherwise(C("vehicle_allowed"))).select("edge_id", "mode", "length_m").distinct()
    return T.movement(edges, s.where(C("time_s") == peak))


query("a34_peak_time", "select arg_min(time_s, (-d, time_s)) as peak_time_s from (select time_s, max(depth_m) as d from {slices} group by 1)")(
    lambda t: t.slices.groupBy("time_s").agg(F.max("depth_m").alias("d")).agg(F.min_by("time_s", F.struct(-C("d"), C("time_s"))).alias("peak_time_s")))
query("a35_unrecorded_depth", "select sensor_id, count(*) filter (depth_m is null) as missing, case when count(*) filter (depth_m is null) = 0 then max(depth_m) end as peak from {readings} group by 1")(
    lambda t: t.readings.groupBy("sensor_id").agg(F.count_if(C("depth_m").isNull()).alias("missing"), F.max("depth_m").alias("p")).select("sensor_id", "missing", F.when(C("missing") == 0, C("p")).alias("peak")))
query("a37_domain_summary", "select label, count(*) as blocks from {blocks} group by 1")(lambda t: t.blocks.groupBy("label").agg(F.count("*").alias("blocks")))
TALLY = "(select s.sensor_id, s.scheduled, coalesce(n, 0) as arrived, peak from {schedule} s left join (select sensor_id, count(*) as n, max(depth_m) as peak from {readings} where depth_m is not null group by 1) r using (sensor_id))"
query("a39_window_tally", f"select * from {TALLY}")(lambda t: T.window_tally(t.readings, t.schedule, "sensor_id", "depth_m", L(True)).select("sensor_id", "scheduled", "arrived", "peak"))
query("a40_sensor_label", f"select sensor_id, case when peak >= 0.15 then 'wet' when arrived * 10 >= scheduled * 9 then 'dry' else 'unknown' end as label from {TALLY}")(
    lambda t: T.sensor_label(T.window_tally(t.readings, t.schedule, "sensor_id", "depth_m", L(True))).select("sensor_id", "label"))
query("a41_block_label", f"select sensor_id % 10 as block, bool_or(label = 'wet') as any_wet, bool_and(label = 'dry') as all_dry from (select sensor_id, case when peak >= 0.15 then 'wet' when arrived * 10 >= scheduled * 9 then 'dry' else 'unknown' end as label from {TALLY}) group by 1")(
    lambda t: T.sensor_label(T.window_tally(t.readings, t.schedule, "sensor_id", "depth_m", L(True))).groupBy((C("sensor_id") % 10).alias("block")).agg(F.bool_or(C("label") == "wet").alias("any_wet"), F.bool_and(C("label") == "dry").alias("all_dry")))
query("a43_report_contract", "select count(*) as repeated from (select user_id, ts from events group by 1, 2 having count(*) > 1)")(lambda t: t.events.groupBy("user_id", "ts").count().where("count > 1").agg(F.count("*").alias("repeated")))
query("a44_gauge_totals", "select s.sensor_id, case when n = scheduled then total end as total from {schedule} s join (select sensor_id, count(depth_m) as n, round(sum(depth_m), 6) as total from {readings} group by 1) r using (sensor_id)")(
    lambda t: T.window_tally(t.readings, t.schedule, "sensor_id", "depth_m", L(True)).select("sensor_id", F.when(C("arrived") == C("scheduled"), F.round("total", 6)).alias("total")))
query("a45_block_scores", "select bi // 5 as b, max(score) as wettest, count(*) as points from {blocks} group by 1")(lambda t: t.blocks.groupBy(F.floor(C("bi") / 5).alias("b")).agg(F.max("score").alias("wettest"), F.count("*").alias("points")))
AUC = "(select {k} as k, score, sum(label)::double as pos, sum(1 - label)::double as neg from {{blocks}} where label >= 0 group by 1, 2)"
query("a47_auc", "select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc, sum(pos) as n_pos, sum(neg) as n_neg from (select *, sum(neg) over (order by score) - neg as below from (select score, sum(label)::double as pos, sum(1 - label)::double as neg from {blocks} where label >= 0 group by 1))")(
    lambda t: T.auc(t.blocks.withColumn("k", L(1)), ["k"], "score", "label").select(r6(C("auc"), "auc"), "n_pos", "n_neg"))
query("a48_toc", "select score, sum(sum(label)) over (order by score desc)::bigint as hits, sum(sum(1 - label)) over (order by score desc)::bigint as false_alarms from {blocks} where label >= 0 group by score")(lambda t: T.toc(t.blocks, "score", "label"))
query("a49_contingency", "with c as (select count(*) filter (d and o) as hits, count(*) filter (not d and o) as misses, count(*) filter (d and not o) as false_alarms, count(*) filter (not d and not o) as rest from (select score >= 25 as d, label = 1 as o from {blocks} where label >= 0)) select *, round(((hits + misses) * (hits + false_alarms) / (hits + misses + false_alarms + rest)) / (hits + misses + hits + false_alarms - (hits + misses) * (hits + false_alarms) / (hits + misses + false_alarms + rest)), 6) as csi_random, round(hits / (hits + misses), 6) as hit_rate, round(false_alarms / (hits + false_alarms), 6) as far, round(hits / (hits + misses + false_alarms), 6) as csi, round((hits + false_alarms) / (hits + misses), 6) as bias from c")(
    lambda t: T.contingency(t.blocks.where("label >= 0"), C("score") >= 25, C("label") == 1).select("hits", "misses", "false_alarms", "rest", *(F.round(c, 6).alias(c) for c in ("hit_rate", "far", "csi", "csi_random", "bias"))))


@query("a50_shift_null", """with g as (select min(bi) as i0, min(bj) as j0, max(bi) - min(bi) + 1 as nx, max(bj) - min(bj) + 1 as ny from {blocks}), k as (select bi - i0 as i, bj - j0 as j, score, label from {blocks}, g where label in (0, 1)),
d as (select id as shift, id // ny as di, id % ny as dj from range(1, (select nx * ny from g)) r(id), g order by ('0x' || substr(sha256(concat_ws('|', '1', 'shift', id::varchar)), 1, 13))::bigint, id limit 999),
m as (select shift, k.score, m.label from (select shift, (i + di) % nx as i, (j + dj) % ny as j, label from k, d, g) m join k using (i, j)),
w as (select shift, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc, sum(pos) / (sum(pos) + sum(neg)) as prevalence, sum(pos) + sum(neg) as evaluable from (select *, sum(neg) over (partition by shift order by score) - neg as below from (select shift, score, sum(label)::double as pos, sum(1 - label)::double as neg from m group by 1, 2)) group by 1),
o as (select sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc from (select *, sum(neg) over (order by score) - neg as below from (select score, sum(label)::double as pos, sum(1 - label)::double as neg from k group by 1))),
t as (select count(w.auc) as defined, count(*) filter (w.auc >= o.auc - 1e-12) as k, min(prevalence) filter (w.auc is not null) as prevalence_low, max(prevalence) filter (w.auc is not null) as prevalence_high, (min(evaluable) filter (w.auc is not null))::bigint as evaluable_low, (max(evaluable) filter (w.auc is not null))::bigint as evaluable_high, max(o.auc) as auc from o left join w on true)
select round(auc, 9) as auc, 1 as seed, (select count(*) from d) as n, (select count(*) from d) - defined as n_undefined, round((1 + k) / (1 + defined), 9) as p_ge_observed, round(k / defined, 9) as share_ge_observed, round(prevalence_low, 9) as prevalence_low, round(prevalence_high, 9) as prevalence_high, evaluable_low, evaluable_high from t""")
def _(t):
    r = T.shift_null(t.blocks, "score", "label")
    return r.select(*(F.round(c, 9).alias(c) if c in ("auc", "p_ge_observed", "share_ge_observed", "prevalence_low", "prevalence_high") else c for c in r.columns))


query("a52_correlogram", "with l as (select unnest(range(1, least(max(bi) - min(bi) + 1, max(bj) - min(bj) + 1) // 2 + 1)) as lag from {blocks}), p as (select lag, a.score as v, b.score as w from {blocks} a cross join l join {blocks} b on b.bi = a.bi + lag and b.bj = a.bj union all select lag, a.score, b.score from {blocks} a cross join l join {blocks} b on b.bi = a.bi and b.bj = a.bj + lag), o as (select l.lag, count(v) as pairs, case when count(v) >= 30 and not isnan(corr(v, w)) then corr(v, w) end as corr from l left join p using (lag) group by 1) select lag, pairs, round(corr, 6) as corr, (select min(lag) from o where corr <= 0.05) as range_lag from o")(
    lambda t: T.correlogram(t.blocks, "score").select("lag", "pairs", r6(C("corr"), "corr"), "range_lag"))
query("a53_class_medians", "select label, quantile_cont(score, 0.5) as median from {blocks} group by 1")(lambda t: t.blocks.groupBy("label").agg(F.percentile("score", 0.5).alias("median")))
query("a58_destinations", "select p_brand, count(*) as n from part group by 1")(lambda t: t.part.groupBy("p_brand").agg(F.count("*").alias("n")))
query("a59_pair_deltas", "select state, sum(case when person % 2 = 0 then weight else 0 end) - sum(case when person % 2 = 1 then weight else 0 end) as delta from {states} group by 1")(
    lambda t: t.states.groupBy("state").agg((F.sum(F.when(C("person") % 2 == 0, C("weight")).otherwise(0)) - F.sum(F.when(C("person") % 2 == 1, C("weight")).otherwise(0))).alias("delta")))

# --- windows ----------------------------------------------------------------------------------------------------------
query("w01_trips", "select user_id, seq, origin, dest, depart_s, arrive_s from (select user_id, row_number() over w - 1 as seq, lag(purpose) over w as origin, purpose as dest, lag(end_s) over w as depart_s, start_s as arrive_s from {activities} window w as (partition by user_id order by start_s, event_id)) where origin is not null")(
    lambda t: T.trips(t.activities, "user_id", "start_s", "end_s", "event_id"))
query("w02_cumulative_time", "select l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as before from lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)), L(0.0)).alias("before")))
query("w03_admission", "select outcome_id, greatest(least(people, 2000 - coalesce(b, 0)), 0)::double as taken from (select outcome_id, greatest(round_even(weight, 0), 1) as people, sum(greatest(round_even(weight, 0), 1)) over (partition by dest_id order by outcome_id rows between unbounded preceding and 1 preceding) as b from {states})")(
    lambda t: T.admitted(t.states.withColumn("cap", L(2000.0)), "dest_id", "outcome_id", "weight", "cap").select("outcome_id", "taken"))
query("w04_running_weight", "select state, event_time_s, (sum(sum(weight)) over (partition by state order by event_time_s))::double as run from {states} group by 1, 2")(
    lambda t: t.states.groupBy("state", "event_time_s").agg(F.sum("weight").alias("w")).select("state", "event_time_s", F.sum("w").over(Window.partitionBy("state").orderBy("event_time_s")).alias("run")))
query("w05_fragments", "select outcome_id, row_number() over (partition by person order by outcome_id) - 1 as fragment from {states}")(
    lambda t: t.states.select("outcome_id", (F.row_number().over(Window.partitionBy("person").orderBy("outcome_id")) - 1).alias("fragment")))
query("w06_serialised", """with e as (select *, coalesce(max(least(greatest(end_s, start_s), 86400)) over (o rows between unbounded preceding and 1 preceding), 0) as before, row_number() over o as r from {activities} window o as (partition by user_id order by start_s, event_id)),
p as (select user_id, r, 0 as part, before as start_s, least(start_s, 86400) as end_s, 'home' as purpose from e where start_s > before union all select user_id, r, 1, greatest(before, start_s), least(end_s, 86400), purpose from e where least(end_s, 86400) > greatest(before, start_s)
 union all select user_id, 1 << 40, 0, max(least(greatest(end_s, start_s), 86400)), 86400, 'home' from e group by 1 having max(least(greatest(end_s, start_s), 86400)) < 86400)
select user_id, (row_number() over (partition by user_id order by r, part) - 1)::int as seq, start_s, end_s, purpose from p""")(lambda t: T.serialised(t.activities, "user_id", "start_s", "end_s", "event_id"))
query("w09_last_activity", "select user_id, max(event_id) as event_id from (select *, max(start_s) over (partition by user_id) as m from {activities} where start_s <= 43200) where start_s = m group by 1")(
    lambda t: T.ranked(t.activities.where("start_s <= 43200"), ["user_id"], [C("start_s").desc(), C("event_id").desc()]).select("user_id", "event_id"))
query("w10_last_state", f"select edge_id, mode, round(arg_max({FACTOR}, time_s), 6) as speed_multiplier from {STATES} group by 1, 2")(
    lambda t: states(t).groupBy("edge_id", "mode").agg(F.round(F.max_by("speed_multiplier", "time_s"), 6).alias("speed_multiplier")))
query("w11_monotone", f"select count(*) as rises from (select f - lag(f) over (partition by edge_id, mode order by depth_m, time_s) as d from (select edge_id, mode, depth_m, time_s, {FACTOR} as f from {STATES})) where d > 1e-9")(
    lambda t: states(t).withColumn("d", C("speed_multiplier") - F.lag("speed_multiplier").over(Window.partitionBy("edge_id", "mode").orderBy("depth_m", "time_s"))).where("d > 1e-9").agg(F.count("*").alias("rises")))
query("w13_chain_whole", "select l_orderkey, count(*) as n, min(l_linenumber) as low, max(l_linenumber) as high from lineitem group by 1")(
    lambda t: t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high")))
query("w14_first_impact", "select l_orderkey, arg_min(l_partkey, (case when l_returnflag = 'R' then 0 else 1 end, l_linenumber, l_partkey)) as edge from lineitem where l_returnflag in ('R', 'A') group by 1")(
    lambda t: t.lineitem.where(C("l_returnflag").isin("R", "A")).groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct(C("l_returnflag") != "R", "l_linenumber", "l_partkey")).alias("edge")))
query("w16_closure_prefix", "with w as (select distinct edge_id from {wet_edges} where year = 2010) select edge_id from (select edge_id, row_number() over (order by u, edge_id) as r, count(*) over () as n from (select edge_id, ('0x' || substr(sha256(concat_ws('|', '3', 'closure', edge_id)), 1, 13))::bigint::double / 4503599627370496 as u from w)) where r <= floor(n * 0.25::double + 0.5)")(
    lambda t: T.least_share(t.wet_edges.where("year = 2010").select("edge_id").distinct().select("edge_id", V.uniform(3, "closure", C("edge_id")).alias("u")), "u", "edge_id", 0.25).select("edge_id"))
query("w17_cell_size", "select min(d) as spacing_m from (select x - lag(x) over (order by x) as d from (select distinct x from {slices}))")(
    lambda t: t.slices.select("x").distinct().select((C("x") - F.lag("x").over(Window.orderBy("x"))).alias("d")).agg(F.min("d").alias("spacing_m")))
query("w18_sample", "select person_id, weight from (select *, ('0x' || substr(sha256(concat_ws('|', '5', 'sample', person_id)), 1, 13))::bigint::double / 4503599627370496 as u from {persons}) order by u, person_id limit 100")(
    lambda t: t.persons.select("person_id", "weight", V.uniform(5, "sample", C("person_id")).alias("u")).orderBy("u", "person_id").limit(100).select("person_id", "weight"))
query("w19_share_of_cell", "select person_id, round(weight / sum(weight) over (partition by home_cell_id), 6) as share from {persons}")(
    lambda t: t.persons.select("person_id", r6(C("weight") / F.sum("weight").over(Window.partitionBy("home_cell_id")), "share")))

# --- top rows, sets ---------------------------------------------------------------------------------------------------
query("t01_top_edges", "select dest_id, sum(weight) as weight from {states} group by 1 order by 2 desc, 1 limit 10")(lambda t: t.states.groupBy("dest_id").agg(F.sum("weight").alias("weight")).orderBy(C("weight").desc(), "dest_id").limit(10))
query("t02_largest_footprints", "select id, w * h as area from {footprints} order by 2 desc, 1 limit 3")(lambda t: t.footprints.select("id", (C("w") * C("h")).alias("area")).orderBy(C("area").desc(), "id").limit(3))
query("t04_wettest_cells", "select cell_id, max(depth_m) as depth_m from {slices} group by 1 order by 2 desc, 1 limit 20")(lambda t: t.slices.groupBy("cell_id").agg(F.max("depth_m").alias("depth_m")).orderBy(C("depth_m").desc(), "cell_id").limit(20))
query("t05_highest_risk", "select p_partkey, p_size from part order by p_size desc, p_partkey limit 25")(lambda t: t.part.orderBy(C("p_size").desc(), "p_partkey").select("p_partkey", "p_size").limit(25))
query("t06_keyset_page", "with p as (select p_partkey, row_number() over (order by p_partkey) as r from part where p_partkey > 50) select p_partkey, case when (select count(*) from p) > 30 then (select p_partkey from p where r = 30) end as next_after from p where r <= 30")(
    lambda t: T.page(t.part.select("p_partkey"), "p_partkey", 50, 30))
query("t07_thinned", "select id from (select id, row_number() over (partition by floor(x / 1000), floor(y / 1000) order by id) as r from {footprints}) where r = 1")(
    lambda t: T.ranked(t.footprints.withColumns({"bx": F.floor(C("x") / 1000), "by": F.floor(C("y") / 1000)}), ["bx", "by"], [C("id")]).select("id"))
query("t08_newest", "select arg_max(o_orderkey, (o_orderdate, o_orderkey)) as newest from orders")(lambda t: t.orders.agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest")))
query("u01_union_layers", "select edge_id as id from {edges} union all select cell_id from {slices}")(lambda t: t.edges.select(C("edge_id").alias("id")).unionByName(t.slices.select(C("cell_id").alias("id"))))
query("u03_common_ids", "with c as (select c_custkey as k from customer intersect select o_custkey from orders), n as (select c_custkey as k from customer intersect select -o_custkey - 1 from orders) select 'orders' as layer, k from c union all select 'none', null where not exists (select 1 from n)")(
    lambda t: T.common(t.customer.select(C("c_custkey").alias("k")), t.orders.select(C("o_custkey").alias("k")), "orders").unionByName(T.common(t.customer.select(C("c_custkey").alias("k")), t.orders.select((-C("o_custkey") - 1).alias("k")), "none")))
query("u04_missing_orphans", "select 'missing' as kind, count(*) as n from customer where c_custkey not in (select o_custkey from orders) union all select 'orphan', count(*) from orders where o_custkey not in (select c_custkey from customer)")(
    lambda t: t.customer.join(t.orders, C("c_custkey") == C("o_custkey"), "left_anti").agg(L("missing").alias("kind"), F.count("*").alias("n")).unionByName(t.orders.join(t.customer, C("c_custkey") == C("o_custkey"), "left_anti").agg(L("orphan").alias("kind"), F.count("*").alias("n"))))
query("u05_first_of_key", "select user_id, min(event_id) as event_id, count(*) - 1 as repeats from events group by 1")(lambda t: t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("repeats")))
query("u06_both_directions", "select u, v from {edges} union all select v, u from {edges}")(lambda t: t.edges.select("u", "v").union(t.edges.select("v", "u")))

# --- generators, network ----------------------------------------------------------------------------------------------
query("g02_slices", "select cell_id, time_s, round(depth_m, 6) as depth_m from {slices} where depth_m > 0.01")(lambda t: t.slices.where("depth_m > 0.01").select("cell_id", "time_s", r6(C("depth_m"), "depth_m")))
query("g04_edge_states", f"select edge_id, time_s, mode, round(depth_m, 6) as depth_m, round(f, 6) as speed_multiplier, closed, case when closed then 'depth_at_or_above_closing' when f < 1 then 'depth_slows' else 'dry' end as reason from (select *, {CLOSED} as closed, {FACTOR} as f from {STATES})")(
    lambda t: states(t).select("edge_id", "time_s", "mode", r6(C("depth_m"), "depth_m"), r6(C("speed_multiplier"), "speed_multiplier"), "closed", "reason"))
U = "('0x' || substr(sha256(concat_ws('|', '9', '{}', person_id)), 1, 13))::bigint::double / 4503599627370496"
query("g09_departure", f"select person_id, {U.format('warned')} < 0.8 as warned, {U.format('compliant')} < 0.7 as compliant, floor(600 * {U.format('delay')})::bigint as delay_s from {{persons}}")(
    lambda t: t.persons.select("person_id", (V.uniform(9, "warned", C("person_id")) < 0.8).alias("warned"), (V.uniform(9, "compliant", C("person_id")) < 0.7).alias("compliant"), F.floor(600 * V.uniform(9, "delay", C("person_id"))).alias("delay_s")))
query("n01_mode_graph", f"select least(u, v) as a, greatest(u, v) as b, round(min(length_m / (speed_walk_mps * f)), 6) as cost from (select e.u, e.v, e.length_m, e.speed_walk_mps, s.f from {{edges}} e join (select edge_id, {FACTOR} as f from {STATES} where mode = 0 and time_s = 68400) s using (edge_id) where walk_allowed and s.f > 0) group by 1, 2")(
    lambda t: t.edges.where("walk_allowed").join(states(t).where("mode = 0 and time_s = 68400 and speed_multiplier > 0").select("edge_id", "speed_multiplier"), "edge_id").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.round(F.min(C("length_m") / (C("speed_walk_mps") * C("speed_multiplier"))), 6).alias("cost")))
query("n06_components", """with recursive walk as (select u, v from {edges} where walk_allowed), adj as (select u as a, v as b from walk union select v, u from walk),
c(node, component) using key (node) as (select distinct a, a from adj union select m.b, m.component from (select adj.b, min(c.component) as component from c join adj on adj.a = c.node group by 1) m join recurring.c k on k.node = m.b where m.component < k.component),
s as (select component, count(*) as size from c group by 1) select node, component, size, component = (select arg_min(component, (-size, component)) from s) as largest from c join s using (component)""")(
    lambda t: T.largest_component(t.edges.where("walk_allowed").select("u", "v")))

# --- checks -----------------------------------------------------------------------------------------------------------
for _id, _table, _spark, _duck in (
    ("q02_no_negative", "persons", lambda: F.count_if(C("weight") < 0), "count(*) filter (weight < 0)"),
    ("q03_unique_ids", "persons", lambda: F.count("*") - F.countDistinct("person_id"), "count(*) - count(distinct person_id)"),
    ("q09_durations", "activities", lambda: F.count_if(C("end_s") < C("start_s")), "count(*) filter (end_s < start_s)"),
):
    query(_id, f"select '{_id[:3]}' as check_id, 0.01::double as threshold, round(({_duck})::double, 6) as observed, ({_duck})::double <= 0.01 as passed from {{{_table}}}")(
        lambda t, i=_id[:3], n=_table, o=_spark: T.check(getattr(t, n), i, o(), 0.01))
# Checks beside the same on damaged rows, so that it shows whether they can fail: every 97th person is lost, sent to no cell or given a name.
LOST = "select *, k % 97 = 0 as hurt from {persons}"
for _id, _hurt, _spark, _duck in (
    ("q01_weights_reconcile", "weight", lambda weight, home, name: F.abs(F.sum(weight) - F.sum("weight")) / F.sum("weight"), "abs(sum(case when hurt and bad then 0 else weight end) - sum(weight)) / sum(weight)"),
    ("q04_home_cell", "home", lambda weight, home, name: F.count_if(home.isNull()), "count(*) filter (hurt and bad)"),
    ("q07_synthetic_ids", "name", lambda weight, home, name: F.count_if(~name.rlike("^p_[0-9]{8}$")), "count(*) filter (hurt and bad)"),
):
    query(_id, f"select '{_id[:3]}' || case when bad then '_damaged' else '' end as check_id, 0.01::double as threshold, round(({_duck})::double, 6) as observed, ({_duck})::double <= 0.01 as passed from ({LOST}) p cross join (values (false), (true)) b(bad) group by bad")(
        lambda t, i=_id[:3], o=_spark: damaged(t, i, o))
query("q13_height_source", f"select 'q13' || case when bad then '_damaged' else '' end as check_id, 0::double as threshold, (count(*) filter (bad and id % 97 = 0))::double as observed, count(*) filter (bad and id % 97 = 0) = 0 as passed from {{tags}} cross join (values (false), (true)) b(bad) group by bad")(
    lambda t: sources_known(t, False).unionByName(sources_known(t, True)))


def damaged(t: Tables, check_id: str, observed) -> DataFrame:
    """A check of all people, and of them after damage."""
    out = None
    for bad in (False, True):
        hurt = (C("k") % 97 == 0) & L(bad)
        o = observed(F.when(hurt, 0.0).otherwise(C("weight")), F.when(~hurt, C("home_cell_id")), F.when(hurt, "Ann").otherwise(C("person_id")))
        row = T.check(t.persons, check_id + "_damaged" * bad, o, 0.01)
        out = row if out is None else out.unionByName(row)
    return out


def sources_known(t: Tables, bad: bool) -> DataFrame:
    """Whether every height tells where it is from (x14's names)."""
    h, lv = V.height_m(C("height_text")), V.levels(C("level_text"))
    source = F.when(h.isNotNull(), "tag_height").when(lv.isNotNull(), "tag_levels").otherwise("unknown")
    source = F.when((C("id") % 97 == 0) & L(bad), "guess").otherwise(source)
    return T.check(t.tags, "q13" + "_damaged" * bad, F.count_if(~source.isin("tag_height", "tag_levels", "unknown")))


query("q06_sample_subset", "select 'q06' as check_id, 0::double as threshold, count(*)::double as observed, count(*) = 0 as passed from orders where o_custkey not in (select c_custkey from customer)")(
    lambda t: T.check(t.orders.join(t.customer, C("o_custkey") == C("c_custkey"), "left_anti"), "q06", F.count("*")))
query("q12_closed_zero", f"select 'q12' as check_id, 0::double as threshold, count(*)::double as observed, count(*) = 0 as passed from (select {CLOSED} as closed, {FACTOR} as f from {STATES}) where closed and f <> 0")(
    lambda t: T.check(states(t).where("closed and speed_multiplier <> 0"), "q12", F.count("*")))
query("q15_coverage", "select 'q15' as check_id, 0::double as threshold, count(*)::double as observed, count(*) = 0 as passed from (select c_custkey from customer where c_custkey not in (select user_id from events) union all select user_id from events where user_id not in (select c_custkey from customer))")(
    lambda t: T.check(t.customer.select(C("c_custkey").alias("k")).join(t.events.select(C("user_id").alias("k")), "k", "left_anti").unionByName(t.events.select(C("user_id").alias("k")).join(t.customer.select(C("c_custkey").alias("k")), "k", "left_anti")), "q15", F.count("*")))


@query("q16_report")
def _(t):
    rows = [QUERIES[k](t.spark, t.sf_dir) for k in QUERIES if k.startswith("q") and k != "q16_report"]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# --- sources ----------------------------------------------------------------------------------------------------------
query("s03_pushed_filter", "select event_id, value from events where user_id = 3")(lambda t: t.events.where("user_id = 3").select("event_id", "value"))
query("s18_status_counts", "select o_orderstatus, count(*) as n from orders group by 1")(lambda t: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
query("s19_status_or_null", "select n_nationkey, r_name from nation left join region on n_regionkey = r_regionkey and r_regionkey < 3")(lambda t: t.nation.join(t.region.where("r_regionkey < 3"), C("n_regionkey") == C("r_regionkey"), "left").select("n_nationkey", "r_name"))
query("s20_first_source", "select l_orderkey, l_partkey, min(l_linenumber) as first_line from lineitem group by 1, 2")(lambda t: t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first_line")))
query("s24_record_hash", "select n_nationkey, sha256(concat_ws('|', n_name, n_nationkey::varchar, n_regionkey::varchar)) as hash from nation")(lambda t: t.nation.select("n_nationkey", F.sha2(F.concat_ws("|", "n_name", C("n_nationkey").cast("string"), C("n_regionkey").cast("string")), 256).alias("hash")))
query("s27_times", "select distinct time_s from {slices}")(lambda t: t.slices.select("time_s").distinct())
query("s28_absent_inputs", "select n_name from nation where n_nationkey not in (select c_nationkey from customer)")(lambda t: t.nation.join(t.customer, C("n_nationkey") == C("c_nationkey"), "left_anti").select("n_name"))
