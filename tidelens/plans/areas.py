"""Registered queries on distances, depth surfaces, areas, choices and bootstraps; the names go into the catalog."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.operators import areas as A
from tidelens.operators import places as P
from tidelens.operators import skill
from tidelens.plans.catalog import C, query, r6

# --- distances --------------------------------------------------------------------------------------------------------
RIVERS = "river as (select x0::double as x0, y0::double as y0, x1::double as x1, y1::double as y1 from {ways} where highway = 'river' union all select x1, y1, x2, y2 from {ways} where highway = 'river')"
MASK = f"""{RIVERS}, mask as (select * from river union select x, y, x + w, y from {{ponds}} union select x + w, y, x + w, y + h from {{ponds}} union select x + w, y + h, x, y + h from {{ponds}} union select x, y + h, x, y from {{ponds}})"""
SHARE = "greatest(least(((p.x - x0) * (x1 - x0) + (p.y - y0) * (y1 - y0)) / case when x1 = x0 and y1 = y0 then null else (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) end, 1), 0)"
NEAR = f"select x, y, min(sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2)) as d from (select p.x, p.y, m.*, coalesce({SHARE}, 0) as t from points p, mask m) group by 1, 2"
WITHIN = "exists (select 1 from {ponds} q where p.x >= q.x and p.x < q.x + q.w and p.y >= q.y and p.y < q.y + q.h)"


def rivers(t) -> DataFrame:
    w = t.ways.where("highway = 'river'")
    return w.select(F.explode(F.array(*(F.struct(*(C(f"{c}{k + e}").cast("double").alias(f"{c}{e}") for e in (0, 1) for c in "xy")) for k in (0, 1)))).alias("s")).select("s.*")


def ponds(t) -> DataFrame:
    return t.ponds.select(C("id").alias("ring_id"), P.rectangle(C("x"), C("y"), C("w"), C("h")).alias("ring"))


query("j24_mask_distance", f"with {MASK}, points as (select distinct x, y::double as y from {{gauges}}), near as ({NEAR}) select g.gauge_id, round(case when {WITHIN} then 0 else n.d end, 6) as d from {{gauges}} g join points p on p.x = g.x and p.y = g.y join near n on n.x = p.x and n.y = p.y")(
    lambda t: A.mask_distance(t.gauges.select("gauge_id", "x", C("y").cast("double").alias("y")), rivers(t), ponds(t), "gauge_id", 100.0).select("gauge_id", r6(C("d"), "d")))
@query("g01_depth_surface", f"with {MASK}, points as (select 50::double * i as x, 50::double * j as y from range(61) a(i), range((select max(p_partkey) // 50 * 60 // 50 + 1 from part)) b(j)), near as ({NEAR}) select x, y, round(d, 6) as distance_m, round(1.2::double * exp(-d / 40), 6) as depth_m from (select p.x, p.y, case when {WITHIN} then 0 else n.d end as d from points p join near n on n.x = p.x and n.y = p.y) where 1.2::double * exp(-d / 40) > 0.01")
def _(t):
    top = (F.floor(F.max("p_partkey") / 50) * 60).cast("double")
    area = t.part.agg(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(3000.0).alias("x1"), top.alias("y1"))
    return A.depth_surface(area, rivers(t), ponds(t), 1.2, 40.0).select("x", "y", r6(C("distance_m"), "distance_m"), r6(C("depth_m"), "depth_m"))


# --- areas ------------------------------------------------------------------------------------------------------------
BENT = ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0))
UNION = """r as (select year, x as x0, y as y0, x + w as x1, case when bent then y + h / 2 else y + h end as y1 from {extents} union all select year, x, y, x + w / 2, y + h from {extents} where bent),
c as (select g, bx, by_, greatest(x0, 100 * bx) as x0, least(x1, 100 * bx + 100) as x1, greatest(y0, 100 * by_) as y0, least(y1, 100 * by_ + 100) as y1 from (select *, unnest(range(floor(y0 / 100)::bigint, floor(y1 / 100)::bigint + 1)) as by_ from (select *, unnest(range(floor(x0 / 100)::bigint, floor(x1 / 100)::bigint + 1)) as bx from (select *, {group} as g from r)))),
b as (select g, bx, by_, x, lead(x) over (partition by g, bx, by_ order by x) as nx from (select g, bx, by_, x0 as x from c union select g, bx, by_, x1 from c)),
i as (select b.g, b.bx, b.by_, b.x, b.nx - b.x as w, c.y0, c.y1, max(c.y1) over (partition by b.g, b.bx, b.by_, b.x order by c.y0, c.y1 rows between unbounded preceding and 1 preceding) as top from b join c on c.g = b.g and c.bx = b.bx and c.by_ = b.by_ and c.x0 <= b.x and c.x1 >= b.nx where b.nx > b.x),
u as (select g, bx, by_, sum(w * greatest(y1 - greatest(y0, coalesce(top, y0)), 0)) as area from i group by 1, 2, 3)"""


def shapes(t) -> DataFrame:
    ring = lambda corners: F.array(*(F.struct((C("x") + a * C("w")).alias("x"), (C("y") + b * C("h")).alias("y")) for a, b in corners))
    return t.extents.select("year", "id", F.when(C("bent"), ring(BENT)).otherwise(P.rectangle(C("x"), C("y"), C("w"), C("h"))).alias("ring"))


query("j30_building_cover", f"with {UNION.replace('{group}', '0')} select bx as bi, by_ as bj, round(case when area < 1 then 0 else area end, 6) as area_m2 from u where area > 0")(
    lambda t: A.union_areas(shapes(t), [], 100.0).where("area > 0").select(C("bx").alias("bi"), C("by").alias("bj"), F.round(F.when(C("area") < 1, 0.0).otherwise(C("area")), 6).alias("area_m2")))
query("a14_mapped_extents", f"with {UNION.replace('{group}', 'year')}, a as (select year, id, w * h * case when bent then 0.75::double else 1 end as a from {{extents}}) select year, n, round(raw_m2, 4) as raw_m2, round(union_m2, 4) as union_m2, round(raw_m2 / union_m2, 6) as overlap, largest from (select year, count(*) as n, sum(a) as raw_m2, arg_min(id, (-a, id)) as largest from a group by 1) join (select g as year, sum(area) as union_m2 from u group by 1) using (year)")(
    lambda t: A.extents(shapes(t), "year", 100.0).select("year", "n", F.round("raw_m2", 4).alias("raw_m2"), F.round("union_m2", 4).alias("union_m2"), r6(C("overlap"), "overlap"), "largest"))

# --- choices: drawn by Spark's hash, in rounds; tests hold frequencies against weights ----------------------------------
query("j26_destination_choice")(lambda t: A.chosen(t.outings, t.footprints.select("id", "x", "y"), "k", 26))

# --- bootstrap --------------------------------------------------------------------------------------------------------
DRAWN = "('0x' || substr(sha256(concat_ws('|', '51', 'bootstrap', concat_ws('/', d::varchar, s::varchar))), 1, 13))::bigint::double / 4503599627370496"
query("a51_block_bootstrap", f"""with k as (select floor(bi / 5) as ti, floor(bj / 5) as tj, label::double as y, score, score_b from {{blocks}} where label in (0, 1)), n as (select ti, tj, row_number() over (order by ti, tj) - 1 as tile from (select distinct ti, tj from k)),
m as (select d, tile, count(*) as times from (select d, floor({DRAWN} * (select count(*) from n)) as tile from range(999) a(d), range((select count(*) from n)) b(s)) group by 1, 2 union all select -1, tile, 1 from n),
r as (select m.d, which, s, sum(y * times) as pos, sum((1 - y) * times) as neg from (select ti, tj, y, 'score' as which, score as s from k union all select ti, tj, y, 'score_b', score_b from k) join n using (ti, tj) join m using (tile) group by 1, 2, 3),
w as (select d, which, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc from (select *, sum(neg) over (partition by d, which order by s) - neg as below from r) group by 1, 2),
e as (select * from w union all select a.d, 'difference', a.auc - b.auc from w a join w b on a.d = b.d and a.which = 'score' and b.which = 'score_b')
select which as score, round(max(auc) filter (d < 0), 6) as auc, round(quantile_cont(auc, 0.025) filter (d >= 0), 6) as low, round(quantile_cont(auc, 0.975) filter (d >= 0), 6) as high, count(auc) filter (d >= 0) as draws from e group by 1""")(
    lambda t: skill.block_bootstrap(t.blocks, ["score", "score_b"], "label", 5, 999, 51).select("score", *(r6(C(c), c) for c in ("auc", "low", "high")), "draws"))
