"""Registered queries on runs, cases and exposure; the names go into the catalog."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelens.functions import values as V
from tidelens.operators import tables as T
from tidelens.plans import places  # noqa: F401 (its checks come before the report of all)
from tidelens.plans.catalog import ORACLES, C, L, query, r6

CORNERS = ((0.5, 0.5), (0, 0), (1, 0), (1, 1), (0, 1))


# --- sources ----------------------------------------------------------------------------------------------------------
query("s16_latest_holding", "select o_orderstatus, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as latest from orders group by 1")(
    lambda t: t.orders.groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest")))


S23 = "with h0 as (select o_orderkey as k, sha256(concat_ws('|', o_orderkey::varchar, o_custkey::varchar, o_totalprice::varchar)) as h from orders), " + ", ".join(f"h{n} as (select k >> 12 as k, sha256(string_agg(h, '' order by k, h)) as h from h{n - 1} group by 1)" for n in range(1, 5)) + " select (select count(*) from orders) as rows, h as digest from h4"
query("s23_table_digest", S23)(lambda t: T.ordered_digest(t.orders, "o_orderkey", "o_custkey", "o_totalprice"))


# --- joins ------------------------------------------------------------------------------------------------------------
query("j17_observed_nodes", "select b.bi, b.bj, o.score_b as fraction from {blocks} b left join (select bi, bj, score_b from {blocks} where label >= 0) o using (bi, bj)")(
    lambda t: t.blocks.select("bi", "bj", "label").join(t.blocks.where("label >= 0").select("bi", "bj", C("score_b").alias("fraction")), ["bi", "bj"], "left").where(F.assert_true((C("label") < 0) | C("fraction").isNotNull(), "an evaluated node has no observed fraction").isNull()).select("bi", "bj", "fraction"))
query("j19_case", "select a.bi, a.bj, l.label, a.score, b.score_b from (select * from {blocks} where bi % 5 <> 1) a join (select * from {blocks} where bj % 4 <> 2) b using (bi, bj) left join (select bi, bj, label from {blocks} where label >= 0) l using (bi, bj)")(
    lambda t: t.blocks.where("bi % 5 <> 1").select("bi", "bj", "score").join(t.blocks.where("bj % 4 <> 2").select("bi", "bj", "score_b"), ["bi", "bj"]).join(t.blocks.where("label >= 0").select("bi", "bj", "label"), ["bi", "bj"], "left").select("bi", "bj", "label", "score", "score_b"))

# --- groupings --------------------------------------------------------------------------------------------------------
query("a23_contract", "with d as (select 'full' as name, count(*) as n, sum(weight) as weight from {persons} union all select 'sample', count(*), sum(weight) from {persons} where k % 4 = 0 union all select 'cohort', count(*), sum(weight) from {persons} where k % 8 = 0) select name, n > 0 and n <= max(n) over () and weight <= max(weight) over () as holds, round(weight / max(weight) over (), 6) as share from d")(
    lambda t: t.persons.select(F.explode(F.array_compact(F.array(L("full"), F.when(C("k") % 4 == 0, "sample"), F.when(C("k") % 8 == 0, "cohort")))).alias("name"), "weight").groupBy("name").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).select(
        "name", ((C("n") > 0) & (C("n") <= F.max("n").over(Window.partitionBy())) & (C("w") <= F.max("w").over(Window.partitionBy()))).alias("holds"), r6(V.ratio(C("w"), F.max("w").over(Window.partitionBy())), "share")))
query("a56_case_shares", "select dest_id as case_id, sum(weight) as weight, " + ", ".join(f"round(coalesce(sum(weight) filter (state = '{s}'), 0) / sum(weight), 6) as {s}" for s in ("arrived", "shelter_in_place", "unreachable", "refuge_full")) + " from {states} group by 1")(
    lambda t: t.states.groupBy(C("dest_id").alias("case_id")).agg(F.sum("weight").alias("weight"), *(r6(V.ratio(F.coalesce(F.sum(F.when(C("state") == s, C("weight"))), L(0.0)), F.sum("weight")), s) for s in ("arrived", "shelter_in_place", "unreachable", "refuge_full"))))

# --- generators -------------------------------------------------------------------------------------------------------
query("g05_building_exposure", "select id, max(depth_m) as depth_m, coalesce(max(depth_m) >= 0.15, false) as flooded from (select id, floor((x + a * w) / 50) * 50 as cx, floor((y + b * h) / 50) * 50 as cy from {footprints} cross join (values (0.5, 0.5), (0, 0), (1, 0), (1, 1), (0, 1)) v(a, b)) left join (select x, y, depth_m from {slices} where time_s = 68400) s on s.x = cx and s.y = cy group by 1")(
    lambda t: t.footprints.select("id", F.explode(F.array(*(F.struct((F.floor((C("x") + a * C("w")) / 50) * 50).cast("double").alias("x"), (F.floor((C("y") + b * C("h")) / 50) * 50).cast("double").alias("y")) for a, b in CORNERS))).alias("p")).select("id", "p.*").join(
        t.slices.where("time_s = 68400").select("x", C("y").cast("double").alias("y"), "depth_m"), ["x", "y"], "left").groupBy("id").agg(F.max("depth_m").alias("depth_m")).withColumn("flooded", F.coalesce(C("depth_m") >= 0.15, L(False))))

# --- checks: the report of all of them ----------------------------------------------------------------------------------
ORACLES["q16_report"] = " union all by name ".join(f"select * from ({ORACLES[q]})" for q in sorted(ORACLES) if q.startswith("q"))
