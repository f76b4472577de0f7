"""Column expressions on single values: draws, ids, grids, projections, texts, rules."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per foot, metres per building level.
FOOT_M, LEVEL_M = 0.3048, 3.0
# WGS84 semi-major axis and flattening; UTM scale, false easting, zone 47 meridian.
A, FLAT, K0, E0, LON0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 99.0


def uniform(seed: int, stream: str, key: Column) -> Column:
    """A draw in [0, 1) from seed, stream and key: the same whatever the partitions."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def normal(seed: int, stream: str, key: Column) -> Column:
    """A standard normal draw of two uniforms."""
    u, v = uniform(seed, stream + "/u", key), uniform(seed, stream + "/v", key)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def poisson(seed: int, stream: str, key: Column, mean: float) -> Column:
    """A Poisson draw of a small mean: how many steps of the distribution lie at or below a uniform draw."""
    u, term, total, n, out = uniform(seed, stream, key), math.exp(-mean), 0.0, 0, F.lit(0)
    while n < mean or term > 2.0**-54:
        total += term
        out = out + (u >= F.lit(total)).cast("int")
        n += 1
        term *= mean / n
    return out


def categorical(seed: int, stream: str, key: Column, shares: list[tuple[str, float]]) -> Column:
    """One of the values by their shares, which add up to 1."""
    u, total, out = uniform(seed, stream, key), 0.0, None
    for value, share in shares[:-1]:
        total += share
        out = F.when(u < F.lit(total), value) if out is None else out.when(u < F.lit(total), value)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def stable_id(prefix: str, n: int, *parts: Column) -> Column:
    """prefix and n hex digits of a hash of parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, n))


def edge_key(a: Column, b: Column) -> Column:
    """The same key for both directions of an edge."""
    return F.sha2(F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")), 256)


def grid_id(prefix: str, x: Column, y: Column, size: int) -> Column:
    """Lower-left corner of the cell of so many metres."""
    return F.concat_ws("_", F.lit(prefix), *((F.floor(c / size) * size).cast("string") for c in (x, y)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero or null b."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def published(x: Column) -> Column:
    """x, null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def hydrograph(t: Column, start: float, peak: float, end: float) -> Column:
    """0 before start and after end, 1 at the peak, linear between."""
    return F.when((t <= start) | (t >= end), 0.0).when(t <= peak, (t - start) / (peak - start)).otherwise((end - t) / (end - peak)).cast("double")


def speed_factor(depth: Column, full: float, slow: float, closed: float, least: float) -> Column:
    """1 up to full depth, down to least at slow, 0 from closed on, linear between; null stays null."""
    down = lambda a, b, x, y: x + (y - x) * (depth - a) / (b - a)
    return F.when(depth <= full, 1.0).when(depth < slow, down(full, slow, 1.0, least)).when(depth < closed, down(slow, closed, least, 0.0)).when(depth >= closed, 0.0)


def decayed(peak: Column, distance: Column, decay: Column) -> Column:
    return peak * F.exp(-distance / F.greatest(decay, F.lit(1.0)))


def band(score: Column, cuts: tuple[tuple[str, float], ...]) -> Column:
    """The last name whose cut the score reaches; null score: unknown."""
    out = F.when(score.isNull(), "unknown")
    for name, low in sorted(cuts, key=lambda c: -c[1]):
        out = out.when(score >= low, name)
    return out


def height_m(text: Column) -> Column:
    """Metres of a height text: a number with m, ft, ' or no unit; else null."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*(m|ft|')?\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*(m|ft|')?\s*$", 2)
    value = F.when(number != "", number).try_cast("double")
    return F.bround(F.when(unit.isin("ft", "'"), value * FOOT_M).otherwise(value), 2)


def levels(text: Column) -> Column:
    """The first number of a level text."""
    found = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found).try_cast("double")


def flag(x: Column) -> Column:
    """true, false, 0, 1 as texts of any case; else null."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def road_state(closed: Column, multiplier: Column) -> Column:
    """open, slowed, closed, or unknown where nothing is known."""
    return F.when(closed.isNull() | multiplier.isNull(), "unknown").when(closed, "closed").when(multiplier < 1, "slowed").otherwise("open")


def tile(lon: Column, lat: Column, zoom: int) -> Column:
    """struct(x, y) of the web-map tile of a place."""
    n = 2**zoom
    y = F.radians(clip(lat, -85.05112878, 85.05112878))
    to = lambda c: F.greatest(F.least(F.floor(c), F.lit(n - 1)), F.lit(0))
    return F.struct(to((lon + 180) / 360 * n).alias("x"), to((1 - F.asinh(F.tan(y)) / F.pi()) / 2 * n).alias("y"))


def tile_bounds(x: Column, y: Column, zoom: int) -> list[Column]:
    """West, south, east, north."""
    n = 2**zoom
    lat = lambda v: F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * v / n))))
    return [x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)]


def terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256 - 32768


def _series() -> tuple[float, list[float], list[float]]:
    """Radius and coefficients of the Krüger series in the third flattening, to fourth order."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forth = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, forth, back


def _latitudes() -> list[float]:
    """Coefficients from the conformal to the geographic latitude, to fourth order."""
    n = FLAT / (2 - FLAT)
    return [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north in UTM zone 47 N."""
    radius, forth, _ = _series()
    n = FLAT / (2 - FLAT)
    e = 2 * n**0.5 / (1 + n)
    p, d = F.radians(lat), F.radians(lon - LON0)
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) ** 2))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(forth, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(forth, 1)), F.lit(0.0))
    return E0 + K0 * radius * x, K0 * radius * y


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of metres in UTM zone 47 N."""
    radius, _, back = _series()
    xi0, eta0 = y / (K0 * radius), (x - E0) / (K0 * radius)
    xi = xi0 - sum((b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0) for j, b in enumerate(back, 1)), F.lit(0.0))
    eta = eta0 - sum((b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0) for j, b in enumerate(back, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_latitudes(), 1)), F.lit(0.0))
    return LON0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def ring_area(ring: Column) -> Column:
    """Area of a closed ring of struct(x, y), by the shoelace."""
    cross = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def line_length(points: Column) -> Column:
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring: an odd number of crossings."""
    sides = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0))
    return F.aggregate(sides, F.lit(0), lambda s, v: s + v) % 2 == 1


def wkt_points(text: Column) -> Column:
    """The points of the first part of a WKT geometry."""
    inner = F.regexp_extract(text, r"\(+([^()]*)\)", 1)
    return F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y")))


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x1 - x0, y1 - y0
    t = F.when(dx * dx + dy * dy > 0, clip(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0.0, 1.0)).otherwise(0.0)
    return F.hypot(x - x0 - t * dx, y - y0 - t * dy)


def clipped_length(x0: Column, y0: Column, x1: Column, y1: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Length of a segment inside a box."""
    dx, dy = x1 - x0, y1 - y0
    low, high = F.lit(0.0), F.lit(1.0)
    inside = F.lit(True)
    for d, p, a, b in ((dx, x0, west, east), (dy, y0, south, north)):
        t0, t1 = (a - p) / F.when(d != 0, d), (b - p) / F.when(d != 0, d)
        low, high = F.greatest(low, F.least(t0, t1)), F.least(high, F.greatest(t0, t1))
        inside = inside & ((d != 0) | ((p >= a) & (p <= b)))
    return F.when(inside, F.greatest(high - low, F.lit(0.0)) * F.hypot(dx, dy)).otherwise(0.0)
