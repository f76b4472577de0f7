"""Operators on places: buckets of a fixed size make every spatial join an equi-join."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import values as V
from tidelens.operators.tables import components, held


def buckets(rows: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """rows once for each bucket (bx, by) that a box touches. Joins on them shuffle: Spark's estimate does not know how many rows there are, so it would broadcast them."""
    span = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    return rows.withColumn("bx", span(x0, x1)).withColumn("by", span(y0, y1)).hint("merge")


def closest(points: DataFrame, things: DataFrame, key: str, name: str, distance: Column, size: float) -> DataFrame:
    """(key, d, name): for each of points (key, x, y) the nearest of things (name, lx, ly, hx, hy: its box, and what distance needs), at any distance; ties by name.

    Things lie in cells of size metres by their lower corner, cells in ever larger ones, 4 by 4 in one, each with the box of all it holds. From the
    few largest down, a point keeps the cells whose box may hold its nearest: each side of a box is touched by something, which bounds the
    distance from above. So a point meets few cells of each level, however far its nearest is. All places have to be finite.
    """
    ends = ("lx", "ly", "hx", "hy")
    t = held(things.withColumns({"cx": F.floor(F.col("lx") / size), "cy": F.floor(F.col("ly") / size)}))
    box = [(F.min if c[0] == "l" else F.max)(c).alias(c) for c in ends]
    levels = [held(t.groupBy("cx", "cy").agg(*box))]
    while levels[-1].limit(17).count() > 16:
        levels.append(held(levels[-1].groupBy(F.shiftright("cx", 2).alias("cx"), F.shiftright("cy", 2).alias("cy")).agg(*box)))

    def bounded(rows: DataFrame) -> DataFrame:
        """rows (key, x, y, most, cx, cy, box) that may hold the nearest; most: the square of what it is at most, with room for rounding."""
        sq = lambda a: a * a
        near, side, far = {}, {}, {}
        for c in "xy":
            at, low, high = F.col(c), F.col(f"l{c}"), F.col(f"h{c}")
            near[c] = F.greatest(low - at, at - high, F.lit(0.0))
            side[c], far[c] = F.least(F.abs(at - low), F.abs(at - high)), F.greatest(F.abs(at - low), F.abs(at - high))
        most = F.least(sq(side["x"]) + sq(far["y"]), sq(side["y"]) + sq(far["x"])) * (1 + 1e-9)
        r = rows.withColumns({"least": sq(near["x"]) + sq(near["y"]), "most": F.least("most", most)}).withColumn("most", F.min("most").over(Window.partitionBy(key)))
        return r.where("least <= most").select(key, "x", "y", "most", "cx", "cy")

    left = bounded(points.select(key, "x", "y", F.lit(float("inf")).alias("most")).crossJoin(F.broadcast(levels[-1])))
    for k in range(len(levels) - 2, -1, -1):
        inner = levels[k].select("*", F.shiftright("cx", 2).alias("px"), F.shiftright("cy", 2).alias("py")).hint("merge")
        outer = left.select(key, "x", "y", "most", F.col("cx").alias("px"), F.col("cy").alias("py"))
        left = held(bounded(outer.join(inner, ["px", "py"])))
    best = left.join(t.hint("merge"), ["cx", "cy"]).groupBy(key).agg(F.min(F.struct(distance.alias("d"), name)).alias("b"))
    return best.select(key, "b.d", f"b.{name}")


def nearest_any(points: DataFrame, others: DataFrame, size: float, point_id: str, other_id: str) -> DataFrame:
    """(point_id, other, d): each point's nearest other at any distance, ties by id; none if there are no others.

    Each place is searched for once, however many points share it; of others at one place the least id counts. Points without finite
    coordinates match none, others without them are not matched.
    """
    placed = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    at = [F.col(c).cast("double").alias(c) for c in "xy"]
    others = others.where(placed).select(F.col(other_id).alias("other"), *at).groupBy("x", "y").agg(F.min("other").alias("other"))
    others = held(others.where("other is not null"))
    points = points.select(point_id, *at)
    none = [F.lit(None).cast(others.schema["other"].dataType).alias("other"), F.lit(None).cast("double").alias("d")]
    if others.isEmpty():
        return points.select(point_id, *none)
    places = points.where(placed).select("x", "y").distinct().select(F.struct("x", "y").alias("place"), "x", "y")
    things = others.select("other", *(F.col(c).alias(f"{e}{c}") for e in "lh" for c in "xy"))
    dx, dy = (F.col(c) - F.col(f"l{c}") for c in "xy")
    found = held(closest(places, things, "place", "other", F.sqrt(dx * dx + dy * dy), size / 4)).select("place.x", "place.y", "other", "d")
    return points.where(~placed).select(point_id, *none).unionByName(points.where(placed).join(found, ["x", "y"]).select(point_id, "other", "d"))


def inside(points: DataFrame, rings: DataFrame, size: float, point_id: str, ring_id: str) -> DataFrame:
    """(point_id, ring_id, area) for each point (x, y) in a ring (ring: array of struct(x, y)); of an edge, the low side in x or y is in, the high side is not."""
    at = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    r = buckets(rings.select(ring_id, "ring"), at(F.array_min, "x"), at(F.array_min, "y"), at(F.array_max, "x"), at(F.array_max, "y"), size)
    p = points.select(point_id, "x", "y", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"))
    return p.join(r, ["bx", "by"]).where(V.in_ring(F.col("x"), F.col("y"), F.col("ring"))).select(point_id, ring_id, V.ring_area(F.col("ring")).alias("area"))


def overlapping(boxes: DataFrame, others: DataFrame, size: float, key: str) -> DataFrame:
    """key of boxes (x0, y0, x1, y1) that share a positive area with any of others."""
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    a = buckets(boxes.select(key, "x0", "y0", "x1", "y1"), *ends, size)
    b = buckets(others.select("x0", "y0", "x1", "y1"), *ends, size).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("bx", "by")] + [F.col(f"a.{c}0") < F.col(f"b.{c}1") for c in "xy"] + [F.col(f"b.{c}0") < F.col(f"a.{c}1") for c in "xy"]
    return a.alias("a").join(b, on, "left_semi").select(key).distinct()


def length_in_boxes(lines: DataFrame, size: float) -> DataFrame:
    """(bx, by, length) of segments (x0, y0, x1, y1) in each box of a grid of so many metres."""
    low, high = (lambda c, f=f: f(F.col(f"{c}0"), F.col(f"{c}1")) for f in (F.least, F.greatest))
    s = buckets(lines.select("x0", "y0", "x1", "y1"), low("x"), low("y"), high("x"), high("y"), size)
    west, south = F.col("bx") * size, F.col("by") * size
    part = V.clipped_length(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), west, south, west + size, south + size)
    return s.groupBy("bx", "by").agg(F.sum(part).alias("length"))


def line_distance(points: DataFrame, lines: DataFrame, cutoff: float, key: str) -> DataFrame:
    """(key, d): distance of each point (x, y) from the nearest segment (x0, y0, x1, y1), null beyond the cutoff."""
    low = lambda c: F.least(f"{c}0", f"{c}1") - cutoff
    high = lambda c: F.greatest(f"{c}0", f"{c}1") + cutoff
    s = buckets(lines.select("x0", "y0", "x1", "y1"), low("x"), low("y"), high("x"), high("y"), cutoff)
    p = points.select(key, "x", "y", F.floor(F.col("x") / cutoff).alias("bx"), F.floor(F.col("y") / cutoff).alias("by"))
    d = V.segment_distance(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    return p.join(s, ["bx", "by"], "left").withColumn("d", d).groupBy(key).agg(F.min(F.when(F.col("d") <= cutoff, F.col("d"))).alias("d"))


def component_mean(rows: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """rows with the weighted mean of the components that any row has; null where a row lacks one of those."""
    here = rows.agg(F.struct(*(F.max(F.col(c).isNotNull()).alias(c) for c in weights))).scalar()
    r = rows.withColumn("_here", here)
    total = sum((F.when(F.col(f"_here.{c}"), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.when(F.col(f"_here.{c}"), F.col(c) * w).otherwise(F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return r.withColumn(name, V.ratio(value, total)).drop("_here")


def at_least(rows: DataFrame, column: str, least: float) -> DataFrame:
    """rows with column of least or more; all of them if none has."""
    some = rows.agg(F.coalesce(F.max(F.col(column) >= least), F.lit(False))).scalar()
    return rows.where(~some | (F.col(column) >= least))


def evenly(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each key, evenly spaced in order, the first and the last among them."""
    w = Window.partitionBy(*keys)
    r = rows.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    i = F.round(F.col("_r") * (n - 1) / (F.col("_n") - 1))
    return r.where((F.col("_n") <= n) | (F.round(i * (F.col("_n") - 1) / (n - 1)) == F.col("_r"))).drop("_r", "_n")


def public_columns(rows: DataFrame, names: set[str], parts: tuple[str, ...]) -> DataFrame:
    """rows without columns of these names, or with any of these parts in their names."""
    return rows.drop(*(c for c in rows.columns if c in names or any(p in c for p in parts)))


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The closed ring of a rectangle."""
    return F.array(*(F.struct((x + a * w).cast("double").alias("x"), (y + b * h).cast("double").alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))


def cut_off(trips: DataFrame, open_: DataFrame, origin: str, destination: str) -> DataFrame:
    """trips with reason: origin or destination where no open edge (u, v) meets that node, no_path where both lie in different
    components of the open edges, else null. Trips with a null node have no open edge there.
    """
    of = components(open_)
    side = lambda name: of.select(F.col("node").alias(name), F.col("component").alias(f"_{name}"))
    j = trips.join(side(origin), origin, "left").join(side(destination), destination, "left")
    a, b = F.col(f"_{origin}"), F.col(f"_{destination}")
    return j.withColumn("reason", F.when(a.isNull(), "origin").when(b.isNull(), "destination").when(a != b, "no_path")).drop(f"_{origin}", f"_{destination}")
