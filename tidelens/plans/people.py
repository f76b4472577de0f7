"""Registered queries on people, buildings and cohorts; the names go into the catalog."""

from pyspark.sql import functions as F

from tidelens.operators import people as G
from tidelens.operators import places as P
from tidelens.plans.catalog import SHARES, C, L, query

PARTS = "(select cell_id, s.age_band, s.sex_code, case when s.n < 5 then round_even(pop * s.p, 6) else pop - b end as w from (select *, " + " + ".join(f"round_even(pop * {p}::double, 6)" for _, _, p in SHARES[:-1]) + " as b from {cells}) c cross join (values " + ", ".join(f"({k}, '{b}', '{s}', {p}::double)" for k, (b, s, p) in enumerate(SHARES)) + ") s(n, age_band, sex_code, p))"
U = "('0x' || substr(sha256(concat_ws('|', '6', 'profile', person_id)), 1, 13))::bigint::double / 4503599627370496"
PROFILE = "case age_band " + " ".join(f"when '{band}' then case " + " ".join(f"when {U} < {sum(s for _, s in of[: k + 1])!r} then '{name}'" for k, (name, _) in enumerate(of[:-1])) + f" else '{of[-1][0]}' end" for band, of in G.PROFILES.items()) + " end"
query("g06_weighted_people", f"with p as (select *, greatest(round_even(w / 4, 0), 1)::int as n from {PARTS} where w > 0), e as (select *, 'p_' || substr(sha256(concat_ws('|', '6', cell_id, age_band, sex_code, number::varchar)), 1, 20) as person_id from (select *, unnest(range(1, n + 1)) as number from p)) select person_id, cell_id, age_band, sex_code, round(w / n, 9) as weight, {PROFILE} as mobility_profile from e")(
    lambda t: G.weighted_people(t.cells, "cell_id", "pop", SHARES, 4.0, 6).withColumn("weight", F.round("weight", 9)))
query("g13_building_table", r"""select 'b_' || id as building_id, use_class as use, coalesce(h, lv * 3) as height_m, case when h is not null then 'tag_height' when lv is not null then 'tag_levels' else 'unknown' end as height_source, lv as levels, w * h_ as area_m2, round(x + w / 2, 6) as x, round(y + h_ / 2, 6) as y from (select f.id, f.use_class, f.x, f.y, f.w, f.h as h_,
 round_even(case when height_text = 'no' then null else try_cast(regexp_extract(height_text, '(\d+(?:\.\d+)?)', 1) as double) * case when height_text like '%ft' then 0.3048 else 1 end end, 2) as h, try_cast(nullif(regexp_extract(level_text, '^\s*(\d+(?:\.\d+)?)', 1), '') as double) as lv from {footprints} f join {tags} using (id))""")(
    lambda t: G.buildings(t.footprints.select("id", C("use_class").alias("use"), P.rectangle(C("x"), C("y"), C("w"), C("h")).alias("points")).join(t.tags, "id")).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)}))
HERE = "exists (select 1 from {activities} a where a.user_id = p.k and a.start_s <= 64800 and a.end_s > 64800) and exists (select 1 from {homes} h join {wet_edges} w on w.edge_id = concat('u', h.place::varchar) where h.person_id = p.person_id)"
query("g08_cohort", f"select person_id, weight from {{persons}} p where {HERE} and ('0x' || substr(sha256(concat_ws('|', '8', 'cohort', person_id)), 1, 13))::bigint::double / 4503599627370496 < 0.7")(lambda t: chosen(t)[0])
query("g08_cohort_identity", f"select count(*) as people, sum(weight) as weight, 64 as digest_length from {{persons}} p where {HERE} and ('0x' || substr(sha256(concat_ws('|', '8', 'cohort', person_id)), 1, 13))::bigint::double / 4503599627370496 < 0.7")(
    lambda t: chosen(t)[1].select("people", "weight", F.length("digest").alias("digest_length")))


def chosen(t):
    people = t.persons.select("person_id", "weight", "k")
    present = people.join(t.activities.where("start_s <= 64800 and end_s > 64800").select(C("user_id").alias("k")), "k", "left_semi")
    exposed = t.homes.select("person_id", F.concat(L("u"), C("place").cast("string")).alias("edge_id")).join(t.wet_edges.select("edge_id"), "edge_id", "left_semi")
    return G.cohort(people.select("person_id", "weight"), present, exposed, "person_id", "weight", 8, 0.7)
