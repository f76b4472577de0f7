"""Registered queries on places, publishing rules, block tables and checks; the names go into the catalog."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelens.functions import values as V
from tidelens.operators import places as P
from tidelens.operators import tables as T
from tidelens.plans.catalog import CLOSED, FACTOR, STATES, C, L, query, r6, states

TILE = "least(greatest(floor((({lon}) + 180) / 360 * 16384), 0), 16383)::bigint", "least(greatest(floor((1 - asinh(tan(radians({lat}))) / pi()) / 2 * 16384), 0), 16383)::bigint"
LON, LAT = (lambda e: TILE[0].replace("{lon}", e)), (lambda e: TILE[1].replace("{lat}", e))
SUPPLIER_POINTS = "(select s_suppkey, s_suppkey * 41.5::double as x, s_suppkey * 13.5::double as y from supplier)"
SHORE = "(select id, x as x0, y + 3.5::double as y0, x + 3 * w as x1, y + 3.5::double as y1 from {footprints})"
MODES = {"walk": 0, "vehicle": 3}


def supplier_points(t):
    return t.supplier.select("s_suppkey", (C("s_suppkey") * 41.5).alias("x"), (C("s_suppkey") * 13.5).alias("y"))


def shore(t):
    y = (C("y") + 3.5).cast("double")
    return t.footprints.select("id", C("x").alias("x0"), y.alias("y0"), (C("x") + 3 * C("w")).alias("x1"), y.alias("y1"))


def rings(t):
    return t.footprints.select("id", P.rectangle(C("x"), C("y"), C("w"), C("h")).alias("ring"))


# --- values -----------------------------------------------------------------------------------------------------------
query("x04_tile_bounds", f"select person_id, round(tx / 16384 * 360 - 180, 6) as west, round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 16384)))), 6) as south, round((tx + 1) / 16384 * 360 - 180, 6) as east, round(degrees(atan(sinh(pi() * (1 - 2 * ty / 16384)))), 6) as north from (select person_id, {LON('lon')} as tx, {LAT('lat')} as ty from {{persons}})")(
    lambda t: t.persons.select("person_id", V.tile(C("lon"), C("lat"), 14).alias("t")).select("person_id", *(r6(c, n) for c, n in zip(V.tile_bounds(C("t.x"), C("t.y"), 14), ("west", "south", "east", "north"), strict=True))))
query("x05_tiles_of_box", f"select person_id, tx, unnest(range(y0, y1 + 1)) as ty from (select person_id, unnest(range({LON('lon - 0.02')}, {LON('lon + 0.02')} + 1)) as tx, {LAT('lat + 0.02')} as y0, {LAT('lat - 0.02')} as y1 from {{persons}})")(
    lambda t: t.persons.select("person_id", V.tile(C("lon") - 0.02, C("lat") + 0.02, 14).alias("a"), V.tile(C("lon") + 0.02, C("lat") - 0.02, 14).alias("b")).select("person_id", "a", "b", F.explode(F.sequence("a.x", "b.x")).alias("tx")).select("person_id", "tx", F.explode(F.sequence("a.y", "b.y")).alias("ty")))
query("x06_terrarium", "select year, px_row, px_col, px_row * 256 + px_col + code * 60 / 256 - 32768 as metres from {pixels}")(
    lambda t: t.pixels.select("year", "px_row", "px_col", V.terrarium(C("px_row"), C("px_col"), C("code") * 60).alias("metres")))
query("x09_grid_from_origin", "select cell_id, floor((x - (select min(x) from {cells})) / 300)::bigint as ix, floor((y - (select min(y) from {cells})) / 300)::bigint as iy from {cells}")(
    lambda t: t.cells.select("cell_id", F.floor((C("x") - t.cells.agg(F.min("x")).scalar()) / 300).alias("ix"), F.floor((C("y") - t.cells.agg(F.min("y")).scalar()) / 300).alias("iy")))
query("x15_use_flags", "select id, use_class like '%1' as attractor, 'unverified' as refuge_status from {footprints}")(
    lambda t: t.footprints.select("id", C("use_class").like("%1").alias("attractor"), L("unverified").alias("refuge_status")))
query("x16_id_or_hash", "select id, coalesce(case when id % 5 <> 0 then id end, ('0x' || substr(sha256(concat_ws('|', use_class, id::varchar)), 1, 12))::bigint) as building_id from {footprints}")(
    lambda t: t.footprints.select("id", F.coalesce(F.when(C("id") % 5 != 0, C("id")), F.conv(F.substring(F.sha2(F.concat_ws("|", "use_class", C("id").cast("string")), 256), 1, 12), 16, 10).cast("long")).alias("building_id")))
query("x24_component_mean", "select bi, bj, round((score * 0.5::double + score_b * 0.3::double) / (0.5::double + 0.3::double), 6) as mean from {blocks}")(
    lambda t: P.component_mean(t.blocks.withColumn("absent", L(None).cast("double")), {"score": 0.5, "score_b": 0.3, "absent": 0.2}, "mean").select("bi", "bj", r6(C("mean"), "mean")))
query("x28_water_class", "select year, px_row, px_col, case code when 0 then 'no_data' when 1 then 'not_water' when 2 then 'seasonal' when 3 then 'permanent' end as class from {pixels}")(
    lambda t: t.pixels.select("year", "px_row", "px_col", F.when(C("code") == 0, "no_data").when(C("code") == 1, "not_water").when(C("code") == 2, "seasonal").when(C("code") == 3, "permanent").otherwise(F.raise_error(L("unknown water code")).cast("string")).alias("class")))
query("x36_polygon_samples", "select id, x + w / 2 as px, y + h / 2 as py from {footprints} union all select id, x + a * w, y + b * h from {footprints} cross join (values (0, 0), (1, 0), (1, 1), (0, 1)) v(a, b)")(
    lambda t: t.footprints.select("id", F.explode(F.array(*(F.struct((C("x") + a * C("w")).alias("px"), (C("y") + b * C("h")).cast("double").alias("py")) for a, b in ((0.5, 0.5), (0, 0), (1, 0), (1, 1), (0, 1))))).alias("p")).select("id", "p.*"))
query("x37_wkt_points", "select id, 4::bigint as corners, x::double as first_x from {footprints}")(
    lambda t: t.footprints.select("id", V.wkt_points(F.concat(L("POLYGON (("), F.concat_ws(", ", *(F.concat_ws(" ", (C("x") + a * C("w")).cast("string"), (C("y") + b * C("h")).cast("string")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))), L("))"))).alias("p")).select("id", F.size("p").cast("long").alias("corners"), C("p")[0]["x"].alias("first_x")))
query("x38_features", "select to_json({'type': 'Feature', 'id': n_nationkey, 'properties': {'name': n_name}})::varchar as feature from nation")(
    lambda t: t.nation.select(F.to_json(F.struct(L("Feature").alias("type"), C("n_nationkey").alias("id"), F.struct(C("n_name").alias("name")).alias("properties"))).alias("feature")))
query("x39_published", "select p_partkey, case when p_partkey % 7 not in (0, 1) then p_size::double end as value from part")(
    lambda t: t.part.select("p_partkey", V.published(F.when(C("p_partkey") % 7 == 0, float("nan")).when(C("p_partkey") % 7 == 1, float("inf")).otherwise(C("p_size"))).alias("value")))
query("x40_public_columns", "select weight, mobility_profile, age_band, sex_code from {persons}")(lambda t: P.public_columns(t.persons, {"k", "lon", "lat"}, ("person", "home")))
query("x41_mode_filter", "select trip_id from {trips} where mode = 0")(lambda t: t.trips.where(C("mode").isin(MODES["walk"])).select("trip_id"))
query("x42_valid_times", "select count(*) filter (s is not null and s = floor(s)) as valid, count(*) filter (s is null or s <> floor(s)) as ignored from (select try_cast(height_text as double) as s from {tags})")(
    lambda t: t.tags.select(C("height_text").try_cast("double").alias("s")).agg(F.count_if(C("s").isNotNull() & (C("s") == F.floor("s"))).alias("valid"), F.count_if(C("s").isNull() | (C("s") != F.floor("s"))).alias("ignored")))
query("x44_rank_direction", "select bi, bj, -score as rank_score from {blocks}")(lambda t: t.blocks.select("bi", "bj", (-C("score")).alias("rank_score")))
query("x45_lattice_value", "select cell_id, time_s, case when depth_m > 0.1 then depth_m when time_s <> 64800 then -1.0::double end as value from {slices}")(
    lambda t: t.slices.select("cell_id", "time_s", F.when(C("depth_m") > 0.1, C("depth_m")).when(C("time_s") != 64800, -1.0).alias("value")))


@query("x46_band_shares", "select home_cell_id, age_band, round(sum(weight) / sum(sum(weight)) over (partition by home_cell_id), 6) as share from {persons} group by 1, 2")
def _(t):
    bands = t.persons.groupBy("home_cell_id", "age_band").agg(F.sum("weight").alias("w"))
    m = bands.groupBy("home_cell_id").agg(F.map_from_entries(F.collect_list(F.struct("age_band", "w"))).alias("m"))  # a few bands a cell
    total = F.aggregate(F.map_values("m"), L(0.0), lambda s, v: s + v)
    return m.withColumn("total", total).select("home_cell_id", F.explode(F.transform_values("m", lambda k, v: F.round(v / C("total"), 6))).alias("age_band", "share"))


query("x47_bounds", "select bi, bj, bi * 100 - 25 as minx, bj * 100 - 25 as miny, bi * 100 + 75 as maxx, bj * 100 + 75 as maxy from {blocks}")(
    lambda t: t.blocks.select("bi", "bj", (C("bi") * 100 - 25).alias("minx"), (C("bj") * 100 - 25).alias("miny"), (C("bi") * 100 + 75).alias("maxx"), (C("bj") * 100 + 75).alias("maxy")))
query("x48_water_split", "select year, round(count(*) filter (code = 2) * 0.0009::double, 6) as seasonal_km2, round(count(*) filter (code = 3) * 0.0009::double, 6) as permanent_km2 from {pixels} group by 1")(
    lambda t: t.pixels.groupBy("year").agg(F.round(F.count_if(C("code") == 2) * 0.0009, 6).alias("seasonal_km2"), F.round(F.count_if(C("code") == 3) * 0.0009, 6).alias("permanent_km2")))
query("x50_class_speed", "select edge_id, case highway when 'residential' then 8 when 'primary' then 14 when 'motorway' then 25 end::double as speed from {edges}")(
    lambda t: t.edges.join(F.broadcast(t.spark.createDataFrame([("residential", 8.0), ("primary", 14.0), ("motorway", 25.0)], "highway string, speed double")), "highway", "left").select("edge_id", "speed"))

# --- filters ----------------------------------------------------------------------------------------------------------
query("f02_usable", "select id from {tags} where height_text <> 'no' and level_text is not null")(lambda t: t.tags.where("height_text <> 'no' and level_text is not null").select("id"))
query("f03_segments", "select edge_id from {edges} where length_m >= 60 and u <> v")(lambda t: t.edges.where("length_m >= 60 and u <> v").select("edge_id"))
query("f05_area_clip", "select person_id from {persons} where abs(lon - 100.5203::double) + abs(lat - 13.7202::double) < 0.0103::double")(
    lambda t: t.persons.where(V.in_ring(C("lon"), C("lat"), F.array(*(F.struct(L(100.5203 + a).alias("x"), L(13.7202 + b).alias("y")) for a, b in ((0.0103, 0), (0, 0.0103), (-0.0103, 0), (0, -0.0103), (0.0103, 0)))))).select("person_id"))
WATER = "(select year, px_row, round(count(*) filter (code >= 2) / nullif(count(*) filter (code <> 0), 0), 6) as share from {pixels} group by 1, 2)"
for _name, _least in (("f10_least_share", 0.7), ("f10_share_of_none", 1.5)):
    query(_name, f"select * from {WATER} where share >= {_least} or not exists (select 1 from {WATER} where share >= {_least})")(
        lambda t, least=_least: P.at_least(t.pixels.groupBy("year", "px_row").agg(F.round(V.ratio(F.count_if(C("code") >= 2), F.count_if(C("code") != 0)), 6).alias("share")), "share", least))
query("f11_band_and_risk", "select p_partkey from part where p_size / 50::double >= 0.5 and p_size / 50::double < 0.75 and p_size / 50::double >= 0.6")(
    lambda t: t.part.withColumn("s", C("p_size") / L(50.0)).where((V.band(C("s"), (("low", 0.0), ("high", 0.5), ("very_high", 0.75))) == "high") & (C("s") >= 0.6)).select("p_partkey"))
query("f16_wgs84", "select person_id, lon, lat from {persons}")(
    lambda t: t.persons.where(F.assert_true((F.abs("lon") <= 180) & (F.abs("lat") <= 90), "outside WGS84").isNull()).select("person_id", "lon", "lat"))

# --- joins ------------------------------------------------------------------------------------------------------------
query("j03_cell_pixel", "select cell_id, code from {cells} join {pixels} on px_row = gy * 5 and px_col = gx * 5 and year = 2010")(
    lambda t: t.cells.join(t.pixels.where("year = 2010"), (C("px_row") == C("gy") * 5) & (C("px_col") == C("gx") * 5)).select("cell_id", "code"))
query("j04_exposure", "select id, depth_m, depth_m >= 0.15 as flooded from {footprints} left join (select cell_id, depth_m from {slices} where time_s = 68400 and depth_m > 0.2) on cell_id = 'c' || id")(
    lambda t: t.footprints.join(t.slices.where("time_s = 68400 and depth_m > 0.2"), C("cell_id") == F.concat(L("c"), C("id").cast("string")), "left").select("id", "depth_m", (C("depth_m") >= 0.15).alias("flooded")))
query("j07_nearest_cell", f"select s_suppkey, arg_min(gauge_id, (d, gauge_id)) as other from (select s_suppkey, gauge_id, sqrt((p.x * 7 - g.x) ** 2 + (p.y * 5 - g.y) ** 2) as d from {SUPPLIER_POINTS} p, {{gauges}} g) group by 1")(
    lambda t: P.nearest_any(supplier_points(t).select("s_suppkey", (C("x") * 7).alias("x"), (C("y") * 5).alias("y")), t.gauges, 500.0, "s_suppkey", "gauge_id").select("s_suppkey", "other"))
query("j09_nearest_destination", "select person_id, arg_min(gauge_id, (d, gauge_id)) as dest from (select person_id, gauge_id, sqrt((k % 40 * 100 + 13 - g.x) ** 2 + (k // 40 % 40 * 100 + 29 - g.y) ** 2) as d from {persons}, {gauges} g) group by 1")(
    lambda t: P.nearest_any(t.persons.select("person_id", (C("k") % 40 * 100 + 13).cast("double").alias("x"), (F.floor(C("k") / 40) % 40 * 100 + 29).cast("double").alias("y")), t.gauges, 1000.0, "person_id", "gauge_id").select("person_id", C("other").alias("dest")))
query("j10_point_in_polygon", f"select s_suppkey, id from {SUPPLIER_POINTS} p join {{footprints}} f on p.x >= f.x and p.x < f.x + w and p.y >= f.y and p.y < f.y + h")(
    lambda t: P.inside(supplier_points(t), rings(t), 100.0, "s_suppkey", "id").select("s_suppkey", "id"))
query("j11_intersects_any", "select id from {footprints} f where exists (select 1 from {slices} s where time_s = 68400 and depth_m > 0.45 and f.x < s.x + 50 and s.x < f.x + w and f.y < s.y + 50 and s.y < f.y + h)")(
    lambda t: P.overlapping(t.footprints.select("id", C("x").alias("x0"), C("y").alias("y0"), (C("x") + C("w")).alias("x1"), (C("y") + C("h")).alias("y1")), t.slices.where("time_s = 68400 and depth_m > 0.45").select(C("x").alias("x0"), C("y").alias("y0"), (C("x") + 50).alias("x1"), (C("y") + 50).alias("y1")), 100.0, "id"))
query("j12_clip_lengths", f"select gx, gy, round(sum(greatest(least(x1, gx * 100 + 100) - greatest(x0, gx * 100), 0)), 6) as length from (select x0, x1, unnest(range(floor(x0 / 100)::bigint, floor(x1 / 100)::bigint + 1)) as gx, floor(y0 / 100)::bigint as gy from {SHORE}) group by 1, 2")(
    lambda t: P.length_in_boxes(shore(t), 100.0).select(C("bx").alias("gx"), C("by").alias("gy"), r6(C("length"), "length")))
query("j13_line_distance", f"select s_suppkey, round(min(d) filter (d <= 60), 6) as d from (select s_suppkey, sqrt(greatest(x0 - x, x - x1, 0) ** 2 + (y - y0) ** 2) as d from {SUPPLIER_POINTS}, {SHORE}) group by 1")(
    lambda t: P.line_distance(supplier_points(t), shore(t), 60.0, "s_suppkey").select("s_suppkey", r6(C("d"), "d")))
query("j14_exposed_cells", "select cell_id from {cells} c where exists (select 1 from {footprints} f where c.gx * 100 < f.x + w and f.x < c.gx * 100 + 100 and c.gy * 100 < f.y + h and f.y < c.gy * 100 + 100)")(
    lambda t: P.overlapping(t.cells.select("cell_id", (C("gx") * 100).alias("x0"), (C("gy") * 100).alias("y0"), (C("gx") * 100 + 100).alias("x1"), (C("gy") * 100 + 100).alias("y1")), t.footprints.select(C("x").alias("x0"), C("y").alias("y0"), (C("x") + C("w")).alias("x1"), (C("y") + C("h")).alias("y1")), 200.0, "cell_id"))
query("j16_declared_nodes", "select i as bi, j as bj, case when b.label is null then 'absent' when b.label < 0 then 'not_evaluated' else 'stored' end as state from range(50) r(i) cross join (select distinct bj as j from {blocks}) left join (select * from {blocks} where bi % 7 <> 3) b on b.bi = i and b.bj = j")(
    lambda t: t.blocks.select("bj").distinct().select(F.explode(F.sequence(L(0).cast("long"), L(49).cast("long"))).alias("bi"), "bj").join(t.blocks.where("bi % 7 <> 3").select("bi", "bj", "label"), ["bi", "bj"], "full").select("bi", "bj", F.when(C("label").isNull(), "absent").when(C("label") < 0, "not_evaluated").otherwise("stored").alias("state")))
query("j18_unmatched_rows", "select count(*) as n, count(*) filter (c.cell_id is null) as unmatched from {persons} p left join (select * from {cells} where gx % 3 <> 0) c on p.home_cell_id = c.cell_id")(
    lambda t: t.persons.join(t.cells.where("gx % 3 <> 0").select("cell_id").distinct(), C("home_cell_id") == C("cell_id"), "left").agg(F.count("*").alias("n"), F.count_if(C("cell_id").isNull()).alias("unmatched")))
query("j20_sensor_positions", "select coalesce(s.sensor_id, g.gauge_id) as sensor_id, coalesce(case when scheduled % 2 = 0 then 'wet' end, 'unknown') as label, g.x from {schedule} s full join (select * from {gauges} where gauge_id % 4 <> 1) g on s.sensor_id = g.gauge_id")(
    lambda t: t.schedule.join(t.gauges.where("gauge_id % 4 <> 1").select(C("gauge_id").alias("sensor_id"), "x"), "sensor_id", "full").select("sensor_id", F.coalesce(F.when(C("scheduled") % 2 == 0, "wet"), L("unknown")).alias("label"), "x"))
query("j23_coarse_value", "select s.cell_id, s.time_s, b.score from {slices} s left join (select * from {blocks} where bi < 20) b on b.bi = floor(s.x / 100) and b.bj = floor(s.y / 100)")(
    lambda t: t.slices.withColumns({"bi": F.floor(C("x") / 100), "bj": F.floor(C("y") / 100)}).join(t.blocks.where("bi < 20").select("bi", "bj", "score"), ["bi", "bj"], "left").select("cell_id", "time_s", "score"))
query("j25_bottlenecks", "select k, weight, length_m from (select dest_id as k, sum(weight) as weight from {states} group by 1 order by 2 desc, 1 limit 10) join {edges} using (k)")(
    lambda t: t.edges.join(F.broadcast(t.states.groupBy(C("dest_id").alias("k")).agg(F.sum("weight").alias("weight")).orderBy(C("weight").desc(), "k").limit(10)), "k").select("k", "weight", "length_m"))
query("j28_child_of_parent", "select count(*) filter (p.k is null) as orphans, count(*) filter (p.weight <> c.weight) as changed from (select k, case when k % 11 = 0 then weight + 1 else weight end as weight from {persons}) c left join (select * from {persons} where k % 13 <> 0) p using (k)")(
    lambda t: t.persons.select("k", F.when(C("k") % 11 == 0, C("weight") + 1).otherwise(C("weight")).alias("c")).join(t.persons.where("k % 13 <> 0").select("k", "weight", L(True).alias("known")), "k", "left").agg(F.count_if(C("known").isNull()).alias("orphans"), F.count_if(C("weight") != C("c")).alias("changed")))
query("j31_pixel_pairs", "select a.px_row, a.px_col, a.code as before, b.code as after from {pixels} a join {pixels} b using (px_row, px_col) where a.year = 2010 and b.year = 2012")(
    lambda t: t.pixels.where("year = 2010").select("px_row", "px_col", C("code").alias("before")).join(t.pixels.where("year = 2012").select("px_row", "px_col", C("code").alias("after")), ["px_row", "px_col"]))
query("j32_edges_in_water", "select edge_id, bool_or(coalesce(code >= 2, false)) as wet from (select edge_id, u % 200 as r, (k * 3 + i) % 200 as c from {edges}, range(0, 5) s(i)) left join (select * from {pixels} where year = 2010) on px_row = r and px_col = c group by 1")(
    lambda t: t.edges.select("edge_id", (C("u") % 200).alias("px_row"), "k", F.explode(F.sequence(L(0), L(4))).alias("i")).withColumn("px_col", (C("k") * 3 + C("i")) % 200).join(t.pixels.where("year = 2010").select("px_row", "px_col", "code"), ["px_row", "px_col"], "left").groupBy("edge_id").agg(F.bool_or(F.coalesce(C("code") >= 2, L(False))).alias("wet")))
query("j33_smallest_polygon", f"select s_suppkey, arg_min(id, (w * h, id)) as id from {SUPPLIER_POINTS} p join {{footprints}} f on p.x >= f.x and p.x < f.x + w and p.y >= f.y and p.y < f.y + h group by 1")(
    lambda t: P.inside(supplier_points(t), rings(t), 100.0, "s_suppkey", "id").groupBy("s_suppkey").agg(F.min_by("id", F.struct("area", "id")).alias("id")))

# --- groupings --------------------------------------------------------------------------------------------------------
query("a02_age_report", "select round(sum(weight) filter (age_band = '0-14') / sum(weight), 6) as young, round(sum(weight) filter (age_band = '65+') / sum(weight), 6) as old, count(distinct home_cell_id) as cells from {persons}")(
    lambda t: t.persons.agg(*(F.round(V.ratio(F.sum(F.when(C("age_band") == b, C("weight"))), F.sum("weight")), 6).alias(n) for n, b in (("young", "0-14"), ("old", "65+"))), F.countDistinct("home_cell_id").alias("cells")))
query("a26_elevations", "select min(depth_m) as low, round(quantile_cont(depth_m, 0.25), 6) as q25, round(quantile_cont(depth_m, 0.75), 6) as q75, max(depth_m) as high, round(avg(depth_m), 6) as mean from {slices}")(
    lambda t: t.slices.agg(F.min("depth_m").alias("low"), F.round(F.percentile("depth_m", 0.25), 6).alias("q25"), F.round(F.percentile("depth_m", 0.75), 6).alias("q75"), F.max("depth_m").alias("high"), F.round(F.avg("depth_m"), 6).alias("mean")))
query("a28_layer_inventory", "select count(*) as n, count(*) filter (w > 10) as usable, count(*) filter (x < 600) as in_area, count(distinct use_class) as classes, round(sum(w * h) / 1000000, 6) as km2 from {footprints}")(
    lambda t: t.footprints.agg(F.count("*").alias("n"), F.count_if(C("w") > 10).alias("usable"), F.count_if(C("x") < 600).alias("in_area"), F.countDistinct("use_class").alias("classes"), F.round(F.sum(C("w") * C("h")) / 1000000, 6).alias("km2")))
query("a30_run_sums", "select (select sum(weight) from {persons}) as residents, (select sum(weight) from {persons} where k in (select user_id from {activities} where start_s <= 43200 and 43200 < end_s)) as present, (select min(source_role) from {slices}) as source_role")(
    lambda t: t.persons.agg(F.sum("weight").alias("residents")).withColumns({"present": t.persons.join(t.activities.where("start_s <= 43200 and 43200 < end_s"), C("k") == C("user_id"), "left_semi").agg(F.sum("weight")).scalar(), "source_role": t.slices.agg(F.array_join(F.array_sort(F.collect_set("source_role")), "+")).scalar()}))
query("a36_block_table", "select bi // 5 as b, bj // 5 as c, count(*) filter (label = 1) as wet, count(*) filter (label = 0) as open, count(*) filter (label < 0) as not_evaluated, case when count(*) filter (label >= 0) = 0 then 'unknown' when count(*) filter (label = 1) > 0 then 'wet' else 'dry' end as state from {blocks} group by 1, 2")(
    lambda t: t.blocks.groupBy(F.floor(C("bi") / 5).alias("b"), F.floor(C("bj") / 5).alias("c")).agg(F.count_if(C("label") == 1).alias("wet"), F.count_if(C("label") == 0).alias("open"), F.count_if(C("label") < 0).alias("not_evaluated")).withColumn("state", F.when(C("wet") + C("open") == 0, "unknown").when(C("wet") > 0, "wet").otherwise("dry")))
query("a38_coverage", "select count(*) filter (label >= 0) as evaluated, round(count(*) filter (label >= 0) / count(*), 6) as share from {blocks}")(
    lambda t: t.blocks.agg(F.count_if(C("label") >= 0).alias("evaluated"), F.round(V.ratio(F.count_if(C("label") >= 0), F.count("*")), 6).alias("share")))
query("a42_report_label", "select b.bi, b.bj, case when b.label < 0 then 'uncovered' when r.n > 0 then 'reported' else 'none' end as label from {blocks} b left join (select user_id % 50 as bi, count(*) as n from {readings} r join events using (event_id) where depth_m >= 0.15 group by 1) r on r.bi = b.bi")(
    lambda t: t.blocks.join(t.readings.where("depth_m >= 0.15").groupBy((C("sensor_id") % 50).alias("bi")).agg(F.count("*").alias("n")), "bi", "left").select("bi", "bj", F.when(C("label") < 0, "uncovered").when(C("n") > 0, "reported").otherwise("none").alias("label")))
query("a46_persistence", "select sensor_id, coalesce(peak, -1.0::double) as persistence from {schedule} left join (select sensor_id, max(depth_m) as peak from {readings} where ts < timestamp '2024-01-10 00:00:00' group by 1) using (sensor_id)")(
    lambda t: T.window_tally(t.readings, t.schedule, "sensor_id", "depth_m", C("ts") < F.expr("timestamp '2024-01-10 00:00:00'")).select("sensor_id", F.coalesce("peak", L(-1.0)).alias("persistence")))
query("a57_worst_year", "select code, arg_max(year, (n, -year)) as worst, max(n) - min(n) as spread from (select year, code, count(*) as n from {pixels} group by 1, 2) group by 1")(
    lambda t: t.pixels.groupBy("year", "code").agg(F.count("*").alias("n")).groupBy("code").agg(F.max_by("year", F.struct("n", -C("year"))).alias("worst"), (F.max("n") - F.min("n")).alias("spread")))
query("a60_mesh_conservation", "with a as (select unnest(range(0, 144)) * 600 as time_s, * from {activities} where start_s < 86400), n as (select * from a where time_s >= start_s and time_s < end_s), m as (select time_s, sum(w) as a from (select time_s, place, sum(weight) as w from (select time_s, user_id, arg_max(place, (start_s, event_id)) as place, arg_max(weight, (start_s, event_id)) as weight from n group by 1, 2) group by 1, 2) group by 1), u as (select time_s, sum(w) as b from (select time_s, user_id, max(weight) as w from n group by 1, 2) group by 1) select time_s, round(abs(a - b), 6) as gap from m join u using (time_s)")(
    lambda t: T.presence(t.activities.where("start_s < 86400"), "user_id", "place", "start_s", "end_s", "weight", 600, "event_id").where("time_s < 86400").groupBy("time_s").agg(F.sum("total").alias("a")).join(
        t.activities.where("start_s < 86400").select("user_id", "weight", "start_s", "end_s", F.explode(F.sequence(L(0).cast("long"), L(85800).cast("long"), L(600).cast("long"))).alias("time_s")).where("time_s >= start_s and time_s < end_s").groupBy("time_s", "user_id").agg(F.max("weight").alias("w")).groupBy("time_s").agg(F.sum("w").alias("b")), "time_s").select("time_s", F.round(F.abs(C("a") - C("b")), 6).alias("gap")))

# --- windows, order, generators, checks -------------------------------------------------------------------------------
query("w07_vertex_segments", "select id, i, x0, x1 from (select id, i, px as x0, lead(px) over (partition by id order by i) as x1 from (select id, 0 as i, x as px from {footprints} union all select id, 1, x + w from {footprints} union all select id, 2, x + 3 * w from {footprints})) where x1 is not null")(
    lambda t: t.footprints.select("id", F.posexplode(F.array(C("x"), C("x") + C("w"), C("x") + 3 * C("w"))).alias("i", "x0")).withColumn("x1", F.lead("x0").over(Window.partitionBy("id").orderBy("i"))).where("x1 is not null"))
query("w08_winner", "select l_orderkey, l_partkey from (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_linenumber) as r from lineitem) where r = 1")(
    lambda t: T.ranked(t.lineitem, ["l_orderkey"], [C("l_quantity").desc(), C("l_partkey"), C("l_linenumber")]).select("l_orderkey", "l_partkey"))
query("w12_chain_order", "select user_id, count(*) filter (start_s < before) as overlaps from (select user_id, start_s, lag(end_s) over (partition by user_id order by start_s, event_id) as before from {activities}) group by 1")(
    lambda t: t.activities.withColumn("before", F.lag("end_s").over(Window.partitionBy("user_id").orderBy("start_s", "event_id"))).groupBy("user_id").agg(F.count_if(C("start_s") < C("before")).alias("overlaps")))
query("w15_evenly_spaced", "select user_id, event_id from (select user_id, event_id, row_number() over w - 1 as r, count(*) over (partition by user_id) as n from {activities} window w as (partition by user_id order by start_s, event_id)) where n <= 8 or round(round(r * 7 / (n - 1)) * (n - 1) / 7) = r")(
    lambda t: P.evenly(t.activities, ["user_id"], ["start_s", "event_id"], 8).select("user_id", "event_id"))
query("t03_truncated", "select p_partkey, (select count(*) from part where p_size > 25) as matched, (select count(*) > 20 from part where p_size > 25) as truncated from part where p_size > 25 order by 1 limit 20")(
    lambda t: t.part.where("p_size > 25").orderBy("p_partkey").select("p_partkey").limit(20).withColumn("matched", t.part.where("p_size > 25").agg(F.count("*")).scalar()).withColumn("truncated", C("matched") > 20))
query("t09_stable_order", "select id from {footprints} order by y, x, id")(lambda t: t.footprints.orderBy("y", "x", "id").select("id"))
query("g03_edge_depths", "select edge_id, max(depth_m) as max_depth_m, round(avg(depth_m), 6) as mean_depth_m from (select edge_id, unnest([u, v]) as n from {edges}) join (select cell_id, depth_m from {slices} where time_s = 68400) on cell_id = 'c' || n group by 1")(
    lambda t: t.edges.select("edge_id", F.explode(F.array("u", "v")).alias("n")).join(t.slices.where("time_s = 68400"), C("cell_id") == F.concat(L("c"), C("n").cast("string"))).groupBy("edge_id").agg(F.max("depth_m").alias("max_depth_m"), F.round(F.avg("depth_m"), 6).alias("mean_depth_m")))
query("g12_grid", "select i as gx, j as gy from range((select floor(max(x + w) / 500)::bigint + 1 from {footprints})) a(i) cross join range((select floor(max(y + h) / 500)::bigint + 1 from {footprints})) b(j)")(
    lambda t: t.footprints.agg(F.floor(F.max(C("x") + C("w")) / 500).alias("nx"), F.floor(F.max(C("y") + C("h")) / 500).alias("ny")).select(F.explode(F.sequence(L(0).cast("long"), C("nx"))).alias("gx"), "ny").select("gx", F.explode(F.sequence(L(0).cast("long"), C("ny"))).alias("gy")))
@query("n08_cut_off_reason", f"""with recursive walk as (select e.u, e.v from {{edges}} e join (select edge_id from {STATES} where mode = 0 and time_s = 68400 and not ({CLOSED})) s using (edge_id) where walk_allowed), adj as (select u as a, v as b from walk union select v, u from walk),
c(node, component) using key (node) as (select distinct a, a from adj union select m.b, m.component from (select adj.b, min(c.component) as component from c join adj on adj.a = c.node group by 1) m join recurring.c k on k.node = m.b where m.component < k.component),
t as (select trip_id, person % n as a, trip_id % n as b from {{trips}}, (select max(greatest(u, v)) + 1 as n from {{edges}}))
select trip_id, case when x.node is null then 'origin' when y.node is null then 'destination' when x.component <> y.component then 'no_path' end as reason from t left join c x on x.node = a left join c y on y.node = b""")
def _(t):
    """Trips run from nodes of the edges, dealt by person and trip over all of them; closed roads may leave an end out, or the ends apart."""
    open_ = t.edges.where("walk_allowed").join(states(t).where("mode = 0 and time_s = 68400 and not closed").select("edge_id"), "edge_id").select("u", "v")
    last = t.edges.agg(F.max(F.greatest("u", "v")) + 1).scalar()
    trips = t.trips.select("trip_id", F.pmod(C("person"), last).alias("a"), F.pmod(C("trip_id"), last).alias("b"))
    return P.cut_off(trips, open_, "a", "b").select("trip_id", "reason")


query("q05_activity_order", "select 'q05' as check_id, 0::double as threshold, count(*)::double as observed, count(*) = 0 as passed from (select start_s, lag(start_s) over (partition by user_id order by start_s, event_id) as b from {activities}) where start_s < b")(
    lambda t: T.check(t.activities.withColumn("b", F.lag("start_s").over(Window.partitionBy("user_id").orderBy("start_s", "event_id"))).where("start_s < b"), "q05", F.count("*")))
query("q08_weights_match", "select 'q08' as check_id, 0::double as threshold, coalesce(max(abs(a.weight - p.weight)), 0)::double as observed, coalesce(max(abs(a.weight - p.weight)), 0) <= 0 as passed from {activities} a join {persons} p on a.user_id = p.k")(
    lambda t: T.check(t.activities.select("user_id", C("weight").alias("a")).join(t.persons.select(C("k").alias("user_id"), "weight"), "user_id"), "q08", F.max(F.abs(C("a") - C("weight")))))
query("q10_trips_have_rows", "select 'q10' as check_id, 0::double as threshold, count(*)::double as observed, count(*) = 0 as passed from {trips} where trip_id not in (select l_orderkey from lineitem)")(
    lambda t: T.check(t.trips.join(t.lineitem, C("trip_id") == C("l_orderkey"), "left_anti"), "q10", F.count("*")))
query("q11_speed_monotone", f"select 'q11' as check_id, 0::double as threshold, count(*)::double as observed, count(*) = 0 as passed from (select f - lag(f) over (partition by edge_id, mode order by depth_m, time_s) as d from (select edge_id, mode, depth_m, time_s, {FACTOR} as f from {STATES})) where d > 1e-9")(
    lambda t: T.check(states(t).withColumn("d", C("speed_multiplier") - F.lag("speed_multiplier").over(Window.partitionBy("edge_id", "mode").orderBy("depth_m", "time_s"))).where("d > 1e-9"), "q11", F.count("*")))
query("q14_no_verified_refuge", "select 'q14' as check_id, 0::double as threshold, count(*) filter (use_class = 'verified')::double as observed, count(*) filter (use_class = 'verified') = 0 as passed from {footprints}")(
    lambda t: T.check(t.footprints, "q14", F.count_if(C("use_class") == "verified")))
