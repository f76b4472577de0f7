"""Registered queries on records and element documents, written from the given tables and read back; the names go into the catalog."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.plans.catalog import C, L, query, r6
from tidelens.sources import records as S
from tidelens.sources.registry import new_folder


@query("s05_json_records", "select c_custkey, c_name, c_acctbal::double as c_acctbal, c_mktsegment from customer")
def _(t):
    path = new_folder(t.spark, "records")
    S.write_json_lines(t.customer.select("c_custkey", "c_name", C("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment"), path)
    return S.read_json_lines(t.spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").drop("_broken")


@query("s06_json_lines", """select '{"a_key":' || c_custkey || ',"note":' || case when c_custkey % 5 = 0 then 'null' else '"' || c_mktsegment || '"' end || '}' as line, (select count(*) from customer) as written from customer""")
def _(t):
    path = new_folder(t.spark, "lines")
    n = S.write_json_lines(t.customer.select(F.when(C("c_custkey") % 5 != 0, C("c_mktsegment")).alias("note"), C("c_custkey").alias("a_key")), path)
    return t.spark.read.text(path).select(C("value").alias("line"), L(n).cast("long").alias("written"))


@query("s07_csv_inventory", "with c as (select count(*) as n, count(*) filter (c_custkey % 7 = 0) as a, count(*) - count(distinct c_custkey // 2) as repeats from customer) select field, field <> 'phone' as present, case field when 'id' then 0 when 'name' then a when 'phone' then null else 0 end as blanks, n as rows, repeats, 'utf-8' as encoding from c cross join (values ('id'), ('name'), ('segment'), ('phone')) v(field)")
def _(t):
    """Customers, two an id, every seventh without a name; a phone is required, but there is none."""
    path = new_folder(t.spark, "csv")
    t.customer.select(F.floor(C("c_custkey") / 2).alias("id"), F.when(C("c_custkey") % 7 == 0, "  ").otherwise(C("c_name")).alias("name"), C("c_mktsegment").alias("segment")).write.option("header", "true").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return S.csv_inventory(t.spark, path, ["id", "name", "phone"], "id")


def extract(t) -> DataFrame:
    """Element documents of the ways (three nodes each), the footprints (four nodes, closed; every 50th a relation's too) and the suppliers (a node)."""
    w, f = t.ways.withColumn("k", F.substring("way_id", 2, 20).cast("long")), t.footprints
    tags = lambda *kv: F.map_filter(F.create_map(*(x if i % 2 else L(x) for i, x in enumerate(kv))), lambda _, v: v.isNotNull())
    node = lambda i, x, y: F.struct(i.cast("long").alias("id"), x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    bare = F.create_map().cast("map<string,string>")
    empty = {"nodes": "array<long>", "members": "array<struct<type:string,ref:long,role:string>>", "lon": "double", "lat": "double"}

    def element(rows, kind, **columns):
        return rows.select(L(kind).alias("type"), *(columns.get(c, L(None).cast(empty.get(c, "long"))).alias(c) for c in ("id", "lon", "lat", "nodes", "members", "tags")))

    corners = ((0, 0), (1, 0), (1, 1), (0, 1))
    nodes = w.select(F.explode(F.array(*(node(10 * C("k") + j, C(f"x{j}"), C(f"y{j}")) for j in range(3)))).alias("n")).unionAll(
        f.select(F.explode(F.array(*(node(-10 * C("id") - 1 - j, C("x") + a * C("w"), C("y") + b * C("h")) for j, (a, b) in enumerate(corners)))).alias("n")))
    built = f.select("id", F.when(C("id") % 13 == 0, "no").otherwise("yes").alias("b"), F.when(C("id") % 9 == 0, "basin").alias("u"))
    out = element(nodes, "node", id=C("n.id"), lon=C("n.lon"), lat=C("n.lat"), tags=bare)
    out = out.unionByName(element(w, "way", id=C("k"), nodes=F.array(*(10 * C("k") + j for j in range(3))), tags=tags("highway", F.when(C("highway") != "river", C("highway")), "waterway", F.when(C("highway") == "river", "canal"))))
    out = out.unionByName(element(built, "way", id=-C("id") - 1, nodes=F.array(*(-10 * C("id") - 1 - j for j in (0, 1, 2, 3, 0))), tags=tags("building", C("b"), "landuse", C("u"))))
    outer = F.array(F.struct(L("way").alias("type"), (-C("id") - 1).alias("ref"), L("outer").alias("role")))
    out = out.unionByName(element(built.where("id % 50 = 0"), "relation", id=C("id"), members=outer, tags=tags("natural", L("water"))))
    s = t.gauges
    return out.unionByName(element(s, "node", id=10**12 + C("gauge_id"), lon=C("x"), lat=C("y").cast("double"), tags=tags("amenity", F.when(C("gauge_id") % 3 == 0, "school").when(C("gauge_id") % 3 == 1, "cafe"), "emergency", F.when(C("gauge_id") % 5 == 0, "assembly_point"))))


def read_extract(t) -> DataFrame:
    path = new_folder(t.spark, "extract")
    S.write_json_lines(extract(t), path)
    return S.geometries(S.read_json_lines(t.spark, path, S.ELEMENT))


WAYS = "select substr(way_id, 2)::bigint as k, * from {ways}"
query("s09_elements", f"select 'way' as type, k as id, 3 as n, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) + sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) as length_m, x0 = x2 and y0 = y2 and false as closed, 1 as tags from ({WAYS}) union all select 'way', -id - 1, 5, round(2 * w + 2 * h, 6), true, 1 + (id % 9 = 0)::int from {{footprints}} union all select 'relation', id, 5, round(2 * w + 2 * h, 6), true, 1 from {{footprints}} where id % 50 = 0")(
    lambda t: read_extract(t).where("type <> 'node'").select("type", "id", F.size("points").alias("n"), r6(F.aggregate(F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))), L(0.0), lambda s, v: s + v), "length_m"), "closed", F.size("tags").alias("tags")))
query("s10_layers", f"select 'road' as layer, k as id, highway as kind, 3 as n from ({WAYS}) where highway <> 'river' union all select 'water', k, 'canal', 3 from ({WAYS}) where highway = 'river' union all select 'building', -id - 1, 'yes', 5 from {{footprints}} where id % 13 <> 0 union all select 'water', -id - 1, 'basin', 5 from {{footprints}} where id % 9 = 0 union all select 'water', id, 'water', 5 from {{footprints}} where id % 50 = 0")(
    lambda t: S.layers(read_extract(t)).select("layer", "id", "kind", F.size("points").alias("n")))
query("s11_water_kinds", f"select kind, count(*) as n from (select 'canal' as kind from ({WAYS}) where highway = 'river' union all select 'basin' from {{footprints}} where id % 9 = 0 union all select 'water' from {{footprints}} where id % 50 = 0) group by 1")(
    lambda t: S.layers(read_extract(t)).where("layer = 'water'").groupBy("kind").agg(F.count("*").alias("n")))
query("s12_candidates", "select 1000000000000 + gauge_id as id, case when gauge_id % 3 = 0 then 'school' else 'assembly_point' end as kind, x, y::double as y, false as verified from {gauges} where gauge_id % 3 = 0 or gauge_id % 5 = 0")(
    lambda t: S.candidates(read_extract(t)))
