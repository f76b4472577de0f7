"""People, buildings and cohorts on small cases."""

from collections import Counter

from pyspark.sql import functions as F

from tidelens.operators import people as G
from tidelens.operators import tables as T

SHARES = [("0-14", "F", 0.25), ("15-64", "F", 0.5), ("65+", "M", 0.25)]


def test_people_stand_for_their_cell(spark):
    cells = spark.createDataFrame([("a", 100.0), ("b", 1.0), ("c", 0.0), ("d", 33.333333)], "cell string, pop double")
    got = G.weighted_people(cells, "cell", "pop", SHARES, 4.0, 1).collect()
    total = Counter()
    for r in got:
        total[r.cell] += r.weight
    assert {c: round(w, 6) for c, w in total.items()} == {"a": 100.0, "b": 1.0, "d": 33.333333}
    assert len({r.person_id for r in got}) == len(got) and Counter((r.cell, r.age_band) for r in got)["a", "15-64"] == 12
    assert {r.mobility_profile for r in got if r.age_band == "65+"} <= {"walker", "limited"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, G.weighted_people(cells.repartition(3), "cell", "pop", SHARES, 4.0, 1).collect()))


def test_buildings(spark):
    bent = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    rows = [(1, bent, "10 ft", "3", "home"), (2, bent[::-1], None, "3;2", "shop"), (None, bent, "no", None, None), (4, bent[:1] * 4, None, None, None), (5, bent[:2], None, None, None), (6, None, None, None, None)]
    got = G.buildings(spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>, height_text string, level_text string, use string")).collect()
    seen = {r.building_id if r.use else "hashed": (r.height_m, r.height_source, r.levels, r.area_m2, round(r.x, 9), round(r.y, 9)) for r in got}
    place = (12.0, round(5 / 3, 9), round(5 / 3, 9))
    assert seen == {"b_1": (3.05, "tag_height", 3.0, *place), "b_2": (9.0, "tag_levels", 3.0, *place), "hashed": (None, "unknown", None, *place)}
    assert all(r.building_id.startswith("b_") for r in got)


def test_cohorts_are_told_apart(spark):
    people = spark.createDataFrame([(f"p{k}", 1.0 + k % 3) for k in range(300)], "id string, w double")
    present, exposed = people.where("w > 1").select("id"), people.where("w < 3").select("id")
    chosen, told = G.cohort(people, present.union(present), exposed, "id", "w", 4, 0.5)
    ids = {r.id for r in chosen.collect()}
    one = told.first()
    assert 30 < len(ids) < 70 and all(int(i[1:]) % 3 == 1 for i in ids) and one.people == len(ids) and one.weight == 2.0 * len(ids)
    assert G.cohort(people.repartition(7), present, exposed, "id", "w", 4, 0.5)[1].first() == one
    heavier = people.withColumn("w", F.when(F.col("id") == sorted(ids)[0], 2.5).otherwise(F.col("w")))
    other = G.cohort(heavier, present, exposed, "id", "w", 4, 0.5)[1].first()
    assert other.people == one.people and other.digest != one.digest
    assert tuple(G.cohort(people.limit(0), present, exposed, "id", "w", 4, 0.5)[1].first()) == (0, None, None)


def test_digest_follows_order_and_values(spark):
    rows = spark.createDataFrame([(k * 5000, f"v{k}") for k in range(40)], "k long, v string")
    one = T.ordered_digest(rows, "k", "v").first()
    assert T.ordered_digest(rows.repartition(5), "k", "v").first() == one and one["rows"] == 40
    swapped = rows.withColumn("v", F.when(F.col("k") == 0, "v1").when(F.col("k") == 5000, "v0").otherwise(F.col("v")))
    assert T.ordered_digest(swapped, "k", "v").first().digest != one.digest
