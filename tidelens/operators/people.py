"""Weighted people, buildings, and a cohort that is told by a digest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.functions import values as V
from tidelens.operators.tables import demographics, ordered_digest

#: Shares of profiles by age band.
PROFILES = {"0-14": (("accompanied", 0.9), ("walker", 0.1)), "15-64": (("walker", 0.35), ("rider", 0.4), ("driver", 0.25)), "65+": (("walker", 0.5), ("limited", 0.5))}


def weighted_people(cells: DataFrame, cell: str, weight: str, shares: list[tuple[str, str, float]], per_person: float, seed: int) -> DataFrame:
    """(person_id, cell, age_band, sex_code, weight, mobility_profile): people who stand for a cell's residents, weights adding up to them.

    Each cell's residents are split by shares of age and sex; a part of w residents becomes max(round(w / per_person), 1) people of equal weight, none
    where w is 0. Ids and profiles are hashes of seed, cell, part and number, so they don't depend on partitions.
    """
    parts = demographics(cells.select(cell, weight), weight, shares).where("weight > 0")
    n = F.greatest(F.bround(F.col("weight") / per_person), F.lit(1.0)).cast("int")
    each = parts.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    each = each.withColumn("person_id", V.stable_id("p_", 20, F.lit(str(seed)), F.col(cell), F.col("age_band"), F.col("sex_code"), F.col("number")))
    profile = F.lit(None).cast("string")
    for band, of in PROFILES.items():
        profile = F.when(F.col("age_band") == band, V.categorical(seed, "profile", F.col("person_id"), list(of))).otherwise(profile)
    return each.select("person_id", cell, "age_band", "sex_code", (F.col("weight") / F.col("n")).alias("weight"), profile.alias("mobility_profile"))


def buildings(shapes: DataFrame) -> DataFrame:
    """A row for each building (id, points: a closed ring, height_text, level_text, use): building_id, height with its source, levels, area, centre.

    A height comes from its own tag, else from levels, else it is unknown; places are metres. Rings of no area are left out. The id is a hash of
    the ring where a source id is missing.
    """
    ring = F.col("points")
    area = V.ring_area(ring)
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]

    def total(f):
        """The sum of f over the sides of the ring."""
        return F.aggregate(F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), f), F.lit(0.0), lambda s, v: s + v)

    signed, sum_x, sum_y = total(cross), total(lambda p, q: (p["x"] + q["x"]) * cross(p, q)), total(lambda p, q: (p["y"] + q["y"]) * cross(p, q))
    h, lv = V.height_m(F.col("height_text")), V.levels(F.col("level_text"))
    named = F.when(F.col("id").isNotNull(), F.concat(F.lit("b_"), F.col("id").cast("string"))).otherwise(V.stable_id("b_", 20, F.to_json(ring)))
    b = shapes.where(F.size(ring) > 3).withColumns({"area_m2": area, "_s": signed, "_x": sum_x, "_y": sum_y}).where("area_m2 > 0")
    return b.select(named.alias("building_id"), "use", F.coalesce(h, lv * V.LEVEL_M).alias("height_m"), F.when(h.isNotNull(), "tag_height").when(lv.isNotNull(), "tag_levels").otherwise("unknown").alias("height_source"),
        lv.alias("levels"), "area_m2", (F.col("_x") / (3 * F.col("_s"))).alias("x"), (F.col("_y") / (3 * F.col("_s"))).alias("y"))


def cohort(people: DataFrame, present: DataFrame, exposed: DataFrame, key: str, weight: str, seed: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Those of people who are present and exposed (key) and whose draw is below share, and one row (people, weight, digest) that tells the cohort.

    Weights stay as they are. The digest is of the ids with their exact weights in order of the ids' hashes, whatever the partitions.
    """
    chosen = people.join(present.select(key).distinct(), key, "left_semi").join(exposed.select(key).distinct(), key, "left_semi")
    chosen = chosen.where(V.uniform(seed, "cohort", F.col(key)) < share)
    place = F.shiftrightunsigned(F.xxhash64(key), 16)  # 48 bits
    told = ordered_digest(chosen.select(place.alias("at"), F.col(key).cast("string").alias("id"), F.col(weight).cast("string").alias("w")), "at", "id", "w")
    facts = chosen.agg(F.count("*").alias("people"), F.sum(weight).alias("weight"))
    return chosen, facts.select("people", "weight", told.agg(F.max("digest")).scalar().alias("digest"))
