"""Records as JSON and CSV, and element documents (points, ways, relations with tags) as rows with geometry."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ELEMENT = "type string, id long, lon double, lat double, nodes array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
POINTS = "array<struct<x:double,y:double>>"
#: Tags that make a layer, and the values of a point's tags that may be a refuge.
ROAD, BUILDING = "highway", "building"
WATER = {"natural": ("water", "wetland", "bay"), "waterway": (), "landuse": ("reservoir", "basin")}
REFUGES = {"amenity": ("school", "hospital", "place_of_worship", "community_centre"), "emergency": ("assembly_point",)}


def write_json_lines(rows: DataFrame, path: str) -> int:
    """Writes rows as lines of JSON with sorted keys, nulls included, and returns their number, counted in the same pass."""
    seen = Observation()
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    rows.select(line.alias("value")).observe(seen, F.count("*").alias("n")).write.mode("errorifexists").text(path)
    return seen.get["n"]


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that is none has nulls only, and its text in _broken."""
    return spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)


def csv_inventory(spark: SparkSession, path: str, required: list[str], key: str) -> DataFrame:
    """(field, present, blanks, rows, repeats, encoding) of a CSV file with a header: a row for each of its fields and each required one.

    blanks: rows in which the field is null or white space (null where it is absent); repeats: rows beyond the first of their key (null without that
    field); encoding: utf-8, or other where bytes are none.
    """
    table = spark.read.option("header", "true").option("escape", '"').csv(path)
    names = table.columns
    odd = F.max(F.concat_ws("", *(F.col(f"`{c}`") for c in names)).contains("�")).alias("odd")
    blanks = [F.count_if(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) == "").alias(f"b{k}") for k, c in enumerate(names)]
    facts = table.agg(F.count("*").alias("rows"), odd, *blanks)
    repeats = table.groupBy(f"`{key}`").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeats")) if key in names else spark.range(1).select(F.lit(None).cast("long").alias("repeats"))
    fields = [F.struct(F.lit(c).alias("field"), F.lit(True).alias("present"), F.col(f"b{k}").alias("blanks")) for k, c in enumerate(names)]
    fields += [F.struct(F.lit(c).alias("field"), F.lit(False).alias("present"), F.lit(None).cast("long").alias("blanks")) for c in required if c not in names]
    # two tables of one row each
    both = facts.crossJoin(repeats)
    return both.select(F.explode(F.array(*fields)).alias("f"), "rows", "repeats", F.when(F.coalesce("odd", F.lit(False)), "other").otherwise("utf-8").alias("encoding")).select("f.*", "rows", "repeats", "encoding")


def geometries(elements: DataFrame) -> DataFrame:
    """(type, id, tags, points, closed) of elements (ELEMENT): a node's place, a way's vertices in order, a relation's outer ways end to end.

    Ways meet nodes, and relations ways, in joins on ids; what is missing is left out. closed: first and last vertex are one.
    """
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    nodes = elements.where("type = 'node'").select("id", tags.alias("tags"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    refs = elements.where("type = 'way'").select("id", F.posexplode("nodes").alias("at", "node"))
    placed = refs.join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias(c)
    ways = placed.groupBy("id").agg(order("points"))
    parts = elements.where("type = 'relation'").select("id", F.posexplode("members").alias("at", "m")).where("m.type = 'way' and coalesce(m.role, '') in ('outer', '')")
    joined = parts.select("id", "at", F.col("m.ref").alias("way")).join(ways.withColumnRenamed("id", "way"), "way")
    relations = joined.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "points"))), lambda p: p["points"])).alias("points"))
    none = F.array().cast(POINTS)
    named = elements.where("type in ('way', 'relation')").select("type", "id", tags.alias("tags"))
    shapes = ways.select(F.lit("way").alias("type"), "id", "points").unionByName(relations.select(F.lit("relation").alias("type"), "id", "points"))
    lines = named.join(shapes, ["type", "id"], "left").select("type", "id", "tags", F.coalesce("points", none).alias("points"))
    out = nodes.select(F.lit("node").alias("type"), "id", "tags", F.array(F.struct("x", "y")).alias("points")).unionByName(lines)
    return out.withColumn("closed", (F.size("points") > 3) & F.coalesce(F.get("points", F.lit(0)) == F.get("points", F.size("points") - 1), F.lit(False)))


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def water_kind() -> Column:
    """What kind of water tags tell: natural, else waterway, else landuse; null for none."""
    known = [F.when(tag(k).isin(*values), tag(k)) if values else tag(k) for k, values in WATER.items()]
    return F.coalesce(*known)


def layers(shapes: DataFrame) -> DataFrame:
    """(layer, id, kind, points): roads (open ways with a class), buildings (closed ones) and waters, out of one extract by their tags."""
    lines, rings = (F.col("type") == "way") & ~F.col("closed"), F.col("closed")
    found = F.array_compact(F.array(
        F.when(lines & tag(ROAD).isNotNull(), F.struct(F.lit("road").alias("layer"), tag(ROAD).alias("kind"))),
        F.when(rings & tag(BUILDING).isNotNull() & (tag(BUILDING) != "no"), F.struct(F.lit("building").alias("layer"), tag(BUILDING).alias("kind"))),
        F.when((F.col("type") != "node") & water_kind().isNotNull(), F.struct(F.lit("water").alias("layer"), water_kind().alias("kind")))))
    return shapes.select(F.explode(found).alias("f"), "id", "points").select("f.layer", "id", "f.kind", "points")


def candidates(shapes: DataFrame) -> DataFrame:
    """(id, kind, x, y, verified) of points that may be refuges by their tags; none of them is verified."""
    kind = F.coalesce(*(F.when(tag(k).isin(*values), tag(k)) for k, values in REFUGES.items()))
    return shapes.where(F.col("type") == "node").withColumn("kind", kind).where("kind is not null").select("id", "kind", F.get("points", F.lit(0))["x"].alias("x"), F.get("points", F.lit(0))["y"].alias("y"), F.lit(False).alias("verified"))
