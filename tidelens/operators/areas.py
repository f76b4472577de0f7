"""Distances from masks, depth surfaces, areas of unions, and choices among places."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import values as V
from tidelens.operators.places import buckets, closest, inside, line_distance
from tidelens.operators.tables import held

ENDS = ("x0", "y0", "x1", "y1")


def sides(rings: DataFrame, *keys: str) -> DataFrame:
    """(keys, x0, y0, x1, y1): the sides of closed rings (ring: array of struct(x, y))."""
    n = F.size("ring")
    both = F.arrays_zip(F.slice("ring", 1, n - 1).alias("a"), F.slice("ring", 2, n - 1).alias("b"))
    s = rings.where(n > 1).select(*keys, F.explode(both).alias("p"))
    return s.select(*keys, *(F.col(f"p.{e}.{c}").cast("double").alias(f"{c}{k}") for k, e in enumerate("ab") for c in "xy"))


def mask_distance(points: DataFrame, lines: DataFrame, rings: DataFrame, key: str, size: float, cutoff: float | None = None) -> DataFrame:
    """(key, d): how far each of points (key, x, y) is from the nearest of lines (x0, y0, x1, y1) and rings (ring_id, ring), at any distance.

    0 within a ring. Null where a point has no place or there is no mask. The search goes down from large cells to ones of size / 4 metres. With a
    cutoff d is null beyond it, and points meet lines in buckets of that size.
    """
    placed = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    points = points.select(key, "x", "y").distinct()
    none = F.lit(None).cast("double").alias("d")
    known = F.lit(True)
    for c in ENDS:
        known = known & (F.abs(c) < float("inf"))
    mask = held(lines.select(*ENDS).unionByName(sides(rings)).where(known).distinct())
    if mask.isEmpty():
        return points.select(key, none)
    left = held(points.where(placed))
    within = held(inside(left, rings, size, key, "ring_id").select(key).distinct())
    out = points.where(~placed).select(key, none).unionByName(within.select(key, F.lit(0.0).alias("d")))
    left = held(left.join(within, key, "left_anti"))
    if cutoff is not None:
        return out.unionByName(line_distance(left, mask, cutoff, key))
    box = [f(F.col(f"{c}0"), F.col(f"{c}1")).alias(f"{e}{c}") for e, f in (("l", F.least), ("h", F.greatest)) for c in "xy"]
    things = mask.select(F.struct(*ENDS).alias("line"), *ENDS, *box)
    d = V.segment_distance(*(F.col(c) for c in ("x", "y", *ENDS)))
    return out.unionByName(closest(left, things, key, "line", d, size / 4).select(key, "d"))


def lattice(areas: DataFrame, step: float) -> DataFrame:
    """(x, y) of a lattice from the lower corner of each of areas (x0, y0, x1, y1) on, up to its upper one; rows are dealt out before they are filled."""
    along = lambda a, b: F.explode(F.sequence(F.lit(0), F.floor((F.col(b) - F.col(a)) / step).cast("int")))
    rows = areas.select("x0", "x1", "y0", along("y0", "y1").alias("j")).repartition("j")
    return rows.select("x0", "y0", "j", along("x0", "x1").alias("i")).select((F.col("x0") + F.col("i") * step).alias("x"), (F.col("y0") + F.col("j") * step).alias("y"))


def depth_surface(areas: DataFrame, lines: DataFrame, rings: DataFrame, peak_m: float, decay_m: float, step: float = 50.0, least_m: float = 0.01) -> DataFrame:
    """(x, y, distance_m, depth_m) on a lattice over areas: peak at water, falling by exp(-distance / decay), where it is above least_m."""
    cells = lattice(areas, step).distinct().withColumn("cell", F.struct("x", "y"))
    # beyond reach the depth is not above least_m, so nothing there is asked for its distance
    reach = max(decay_m, 1.0) * math.log(peak_m / least_m) * (1 + 1e-9) if peak_m > least_m > 0 else None
    d = mask_distance(cells, lines, rings, "cell", 4 * step, reach)
    depth = V.decayed(F.lit(peak_m), F.col("d"), F.lit(decay_m))
    return d.select("cell.x", "cell.y", F.col("d").alias("distance_m"), depth.alias("depth_m")).where(F.col("depth_m") > least_m)


def union_areas(shapes: DataFrame, group: list[str], size: float) -> DataFrame:
    """(group, bx, by, area): what closed rings (group, id, ring) cover of each block of size metres, overlaps counted once; blocks without any have no row.

    A block is cut into slabs at all corners, at crossings of sides and where sides leave the block, so within a slab sides don't meet and
    what they cover at its middle, times its width, is exact. At the middle each ring's sides pair up to intervals, which are
    clipped and swept from below. Work in a block grows with the sides there; blocks are independent.
    """
    at = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    place = [*group, "bx", "by"]
    dealt = buckets(shapes.select(*group, "id", "ring"), at(F.array_min, "x"), at(F.array_min, "y"), at(F.array_max, "x"), at(F.array_max, "y"), size)
    west, south = F.col("bx") * size, F.col("by") * size
    s = sides(dealt, *place, "id")
    # from left to right; upright sides only bound slabs
    turn = F.col("x0") > F.col("x1")
    s = s.select(*place, "id", *(F.when(turn, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("x1", "x0"), ("y1", "y0"), ("x0", "x1"), ("y0", "y1"))))
    s = held(s.where((F.col("x0") < west + size) & (F.col("x1") > west)).distinct())
    slope = (F.col("y1") - F.col("y0")) / F.when(F.col("x1") != F.col("x0"), F.col("x1") - F.col("x0"))
    sloped = s.where("x1 > x0").withColumn("m", slope).withColumn("c", F.col("y0") - F.col("m") * F.col("x0"))
    corners = s.select(*place, F.explode(F.array("x0", "x1")).alias("x"))
    border = sloped.where("m != 0").select(*place, "x0", "x1", F.explode(F.array(*(F.try_divide(edge - F.col("c"), F.col("m")) for edge in (south, south + size)))).alias("x")).where("x > x0 and x < x1").select(*place, "x")
    a, b = sloped.alias("a"), sloped.hint("merge").alias("b")
    meet = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("bx", "by")] + [F.col("a.m") < F.col("b.m")]
    cross = a.join(b, meet).select(*(F.col(f"a.{c}") for c in place), F.try_divide(F.col("b.c") - F.col("a.c"), F.col("a.m") - F.col("b.m")).alias("x"), F.greatest("a.x0", "b.x0").alias("lo"), F.least("a.x1", "b.x1").alias("hi")).where("x > lo and x < hi").select(*place, "x")
    frame = s.select(*place).distinct().select(*place, F.explode(F.array(west, west + size)).alias("x"))
    breaks = corners.unionByName(border).unionByName(cross).where((F.col("x") > west) & (F.col("x") < west + size)).unionByName(frame).distinct()
    slabs = breaks.withColumn("next", F.lead("x").over(Window.partitionBy(*place).orderBy("x"))).where("next > x")
    slabs = slabs.select(*place, F.col("x").alias("left"), (F.col("next") - F.col("x")).alias("width"), ((F.col("x") + F.col("next")) / 2).alias("mid"))
    p, q = slabs.alias("p"), sloped.hint("merge").alias("q")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in group] + [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("bx", "by")]
    hits = p.join(q, [*same, F.col("q.x0") < F.col("p.mid"), F.col("q.x1") > F.col("p.mid")]).select(*(F.col(f"p.{c}") for c in place), "left", "width", "id", (F.col("q.m") * F.col("mid") + F.col("q.c")).alias("y"))
    up = Window.partitionBy(*place, "left", "id").orderBy("y")
    spans = hits.withColumns({"n": F.row_number().over(up), "top": F.lead("y").over(up)}).where("n % 2 = 1 and top is not null")
    spans = spans.select(*place, "left", "width", F.greatest("y", south).alias("low"), F.least("top", south + size).alias("high")).where("high > low")
    swept = Window.partitionBy(*place, "left").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("high") - F.greatest("low", F.coalesce(F.max("high").over(swept), F.col("low"))), F.lit(0.0))
    return spans.select(*place, (new * F.col("width")).alias("part")).groupBy(*place).agg(F.sum("part").alias("area"))


def extents(shapes: DataFrame, year: str, size: float) -> DataFrame:
    """A row for each year of shapes (year, id, ring): n, raw_m2 (all areas), union_m2, overlap (raw by union), largest (the id of the greatest area)."""
    area = V.ring_area(F.col("ring"))
    raw = shapes.select(year, "id", area.alias("a")).groupBy(year).agg(F.count("*").alias("n"), F.sum("a").alias("raw_m2"), F.min_by("id", F.struct(-F.col("a"), "id")).alias("largest"))
    union = union_areas(shapes, [year], size).groupBy(year).agg(F.sum("area").alias("union_m2"))
    return raw.join(union, year, "left").withColumn("overlap", V.ratio(F.col("raw_m2"), F.col("union_m2")))


def chosen(outings: DataFrame, candidates: DataFrame, key: str, seed: int, scale_m: float = 2500.0, size: float = 1000.0, most: int = 4096) -> DataFrame:
    """(key, choice): one of candidates (id, x, y) for each of outings (key, x, y, preference), with weights exp(-((distance - preference) / scale)^2).

    An exponential race over squares of candidates, each with its number times the greatest weight it can have, then one of the square's
    candidates at random, kept with its weight by that bound, else the outing races again: so the choice has the exact weights, and
    work is a race over squares, not over candidates. Squares are of size metres, doubled until there are at most `most`, so
    what all tasks hold is bounded. Draws are hashes of seed, key and round: reruns agree. Null without candidates or place.
    """
    c = held(candidates.where("x is not null and y is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    o = outings.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("preference").cast("double").alias("t"))
    able = o.where("x is not null and y is not null and t is not null")
    none = F.lit(None).cast(c.schema["id"].dataType).alias("choice")
    if c.isEmpty():
        return o.select(key, none)
    square = lambda: [F.floor(F.col(v) / size).alias(f"b{v}") for v in "xy"]
    while c.select(*square()).distinct().count() > max(most, 4):  # the four quadrants stay apart
        size *= 2
    c = held(c.select("*", *square()).withColumn("n", F.row_number().over(Window.partitionBy("bx", "by").orderBy("id")) - 1))
    sizes = c.groupBy("bx", "by").agg(F.count("*").alias("k"))
    tile = {"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size), "tt": F.floor(F.col("t") / scale_m)}
    able = held(able.withColumns(tile))
    out, left, turn = o.join(able.select(key), key, "left_anti").select(key, none), able, 0
    # by how many squares it is away, a square is at least and at most so far from all places of a tile, at its nearest and at its farthest
    away = [F.abs(F.col(f"b{v}") - F.col(f"t{v}")).cast("double") for v in "xy"]
    reach = lambda f: size * F.hypot(*(f(k) for k in away))
    near, far = (reach(lambda k: F.greatest(k - 1, F.lit(0.0))), reach(lambda k: k)), (reach(lambda k: F.greatest(k, F.lit(0.5))), reach(lambda k: k + 1))
    low, high = F.col("tt") * scale_m, (F.col("tt") + 1) * scale_m
    bound = lambda a, b: F.log(F.col("k").cast("double")) - (F.greatest(a, b, F.lit(0.0)) / scale_m) ** 2
    met = able.select(*tile).distinct().crossJoin(F.broadcast(sizes)).withColumns({"most": bound(near[0] - high, low - far[1]), "least": bound(near[1] - low, high - far[0])})  # at most `most` sizes
    met = met.withColumn("best", F.max("least").over(Window.partitionBy(*tile))).where("most >= best - 41")
    squares = held(met.groupBy(*tile).agg(F.sort_array(F.collect_list(F.struct("bx", "by", "k"))).alias("squares")))

    def draw(salt, *of):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.lit(turn), F.col(key), *of), F.lit(1 << 52)).cast("double") + 0.5) / 2.0**52

    def gap(b):
        """How far the preference is from all distances of a square's points."""
        near = F.hypot(*(F.greatest(b[f"b{v}"] * size - F.col(v), F.col(v) - (b[f"b{v}"] + 1) * size, F.lit(0.0)) for v in "xy"))
        far = F.hypot(*(F.greatest(F.col(v) - b[f"b{v}"] * size, (b[f"b{v}"] + 1) * size - F.col(v)) for v in "xy"))
        return F.greatest(near - F.col("t"), F.col("t") - far, F.lit(0.0)) / scale_m

    while n := left.count():
        race = F.transform("squares", lambda b: F.struct((F.log(b["k"].cast("double")) - gap(b) ** 2 - F.log(-F.log(draw("square", b["bx"], b["by"])))).alias("at"), b.alias("b")))
        won = left.repartition(-(-n // 2000)).join(squares, list(tile)).withColumn("won", F.array_max(race)["b"]).drop("squares")
        won = won.select(key, "x", "y", "t", *tile, "won.bx", "won.by", F.floor(draw("one") * F.col("won.k")).alias("n"), gap(F.col("won")).alias("bound"))
        tried = won.alias("o").join(c.alias("c"), ["bx", "by", "n"]).select(f"o.{key}", "o.x", "o.y", "t", *tile, "id", "bound", ((F.hypot(F.col("o.x") - F.col("c.x"), F.col("o.y") - F.col("c.y")) - F.col("t")) / scale_m).alias("off"))
        tried = held(tried.withColumn("kept", F.log(draw("keep")) <= F.col("bound") ** 2 - F.col("off") ** 2))
        out = out.unionByName(tried.where("kept").select(key, F.col("id").alias("choice")))
        left, turn = tried.where("not kept").select(key, "x", "y", "t", *tile), turn + 1
    return out
