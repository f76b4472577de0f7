"""Registered queries on run folders, written from the given tables into the shared folder and read back; the names go into the catalog."""

from pyspark.sql import functions as F

from tidelens.operators import places as P
from tidelens.operators.tables import held
from tidelens.plans.catalog import C, L, query
from tidelens.sources import registry as R

#: Runs of a base folder: a status of orders each, with tables of its orders and of their lines.
RUNS = (("run_f", "F", "2024-01-02T00:00:00Z"), ("run_o", "O", "2024-01-03T00:00:00Z"), ("run_p", "P", "2024-01-01T00:00:00Z"))


def run_folder(t) -> str:
    """A new base folder with the runs of RUNS."""
    base = R.new_folder(t.spark, "runs")
    for run, status, at in RUNS:
        orders = t.orders.where(C("o_orderstatus") == status).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        R.write_table(orders, base, run, "orders", at)
        R.write_table(t.lineitem.join(orders, C("l_orderkey") == C("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_quantity"), base, run, "lines", at)
    return base


def broken(t, base: str) -> None:
    """Two manifests more: one that is no JSON, one without rows."""
    for name, text in (("torn", '{"run_id": "run_x", "role": '), ("short", '{"run_id": "run_y", "role": "orders", "uri": "x", "created_at": "2024-01-09T00:00:00Z"}')):
        t.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/run_{name}/manifests/orders")


def last(path, n: int = 2):
    """The last n parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), -n, n), "/")


EACH = "(select case o_orderstatus when 'F' then 'run_f' when 'O' then 'run_o' else 'run_p' end as run_id, 'orders' as role, count(*) as rows from orders where o_orderstatus in ('F', 'O', 'P') group by 1 union all select case o_orderstatus when 'F' then 'run_f' when 'O' then 'run_o' else 'run_p' end, 'lines', count(*) from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus in ('F', 'O', 'P') group by 1)"
ALL = f"(select r as run_id, k as role, coalesce(rows, 0) as rows from (values ('run_f'), ('run_o'), ('run_p')) a(r) cross join (values ('orders'), ('lines')) b(k) left join {EACH} e on e.run_id = r and e.role = k)"
AT = "case run_id when 'run_f' then '2024-01-02T00:00:00Z' when 'run_o' then '2024-01-03T00:00:00Z' else '2024-01-01T00:00:00Z' end"


@query("s01_run_table", "select o_orderkey, o_custkey, null::varchar as warning from orders where o_orderstatus = 'F' union all select null, null, 'run_f/none: missing'")
def _(t):
    """Of the wanted columns those that the table has; a table that is missing gives its warning."""
    base = run_folder(t)
    table, _ = R.read_table(t.spark, f"{base}/run_f/orders", ["o_custkey", "o_orderkey", "no_such_column"])
    none, warning = R.read_table(t.spark, f"{base}/run_f/none")
    told = t.spark.range(0 if none else 1).select(L(None).cast("long").alias("o_orderkey"), L(None).cast("long").alias("o_custkey"), last(L(warning)).alias("warning"))
    return table.select("o_orderkey", "o_custkey", L(None).cast("string").alias("warning")).unionByName(told)


@query("s02_table_columns", "select * from (values ('lines', 0, 'l_orderkey'), ('lines', 1, 'l_linenumber'), ('lines', 2, 'l_quantity'), ('orders', 0, 'o_orderkey'), ('orders', 1, 'o_custkey'), ('orders', 2, 'o_orderdate'), ('orders', 3, 'o_orderstatus')) v(role, place, name)")
def _(t):
    base = run_folder(t)
    return t.spark.createDataFrame([(role, k, c) for role in ("lines", "orders") for k, c in enumerate(R.table_columns(t.spark, f"{base}/run_f/{role}"))], "role string, place int, name string")


@query("s04_registered_tables", f"select run_id, role, rows, {AT} as created_at from {ALL}")
def _(t):
    return R.manifests(t.spark, run_folder(t)).select("run_id", "role", "rows", "created_at")


@query("s15_run_catalogue", f"select row_number() over (order by problem is not null, created_at is null, created_at desc, run_id, role) - 1 as rank, run_id, role, rows, created_at, problem from (select run_id, role, rows, {AT} as created_at, null as problem from {ALL} union all select 'run_y', 'orders', null, '2024-01-09T00:00:00Z', 'missing: rows' union all select 'run_torn', null, null, null, 'not readable')")
def _(t):
    base = run_folder(t)
    broken(t, base)
    return R.catalogue(t.spark, base).select("rank", "run_id", "role", "rows", "created_at", "problem")


@query("s21_integrity", f"select run_id || '/' || role as name, rows as declared_rows, case run_id || '/' || role when 'run_o/orders' then null when 'run_p/lines' then rows + 1 else rows end as rows, case run_id || '/' || role when 'run_o/orders' then 'missing' when 'run_p/lines' then 'rows_differ' when 'run_f/orders' then 'content_differs' else 'ok' end as status from {ALL}")
def _(t):
    """After damage: a table is away, one has a row more, one has another value in a row."""
    base = run_folder(t)
    spark = t.spark
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/run_o/orders")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    extra = spark.read.parquet(f"{base}/run_p/lines")
    spark.createDataFrame([(1, 1, 1.0)], "l_orderkey long, l_linenumber long, l_quantity double").select(*(C(f.name).cast(f.dataType) for f in extra.schema)).write.mode("append").parquet(f"{base}/run_p/lines")
    orders = spark.read.parquet(f"{base}/run_f/orders")
    first = orders.agg(F.min("o_orderkey")).scalar()
    changed = held(orders.withColumn("o_custkey", C("o_custkey") + (C("o_orderkey") == first).cast("int")).select(orders.columns))
    changed.write.mode("overwrite").parquet(f"{base}/run_f/orders")
    return R.integrity(spark, base).select(last(C("uri")).alias("name"), "declared_rows", "rows", "status")


@query("s22_inventory", "select * from (values ('run_f/lines', true), ('run_f/orders', true), ('run_o/lines', true), ('run_o/orders', true), ('run_p/lines', true), ('run_p/orders', true)) v(name, filled)")
def _(t):
    """Which tables have files, of what size, without reading them."""
    files = R.inventory(t.spark, run_folder(t))
    return files.groupBy(last(F.regexp_replace("path", "/[^/]*$", "")).alias("name")).agg((F.sum("bytes") > 0).alias("filled"))


RINGED = "case when id % 11 = 0 then 'null' when id % 11 = 1 then 'empty' when id % 11 = 2 then 'invalid' when x < 1500 then 'selected' else 'outside' end"


@query("s25_staged_layer", f"select count(*) as rows, count(*) filter (s = 'null') as \"null\", count(*) filter (s = 'empty') as empty, count(*) filter (s = 'invalid') as invalid, count(*) filter (s = 'selected') as selected, round(sum(w * h) filter (s = 'selected'), 6) as area from (select *, {RINGED} as s from {{footprints}})")
def _(t):
    """Footprints, some without a ring, an empty one, or one that is not closed, staged for the western half."""
    full = P.rectangle(C("x"), C("y"), C("w"), C("h"))
    ring = F.when(C("id") % 11 == 0, L(None)).when(C("id") % 11 == 1, F.slice(full, 1, 0)).when(C("id") % 11 == 2, F.slice(full, 1, 4)).otherwise(full)
    layer = t.footprints.select("id", "x", (C("w") * C("h")).alias("area"), ring.alias("ring"))
    kept, seen = R.staged(layer, C("x") < 1500, R.new_folder(t.spark, "stage"), "footprints")
    return kept.agg(*(L(seen[c]).cast("long").alias(c) for c in ("rows", "null", "empty", "invalid", "selected")), F.round(F.sum("area"), 6).alias("area"))


OUTER = "x >= 100 and x < 2500 and y >= 100 and y < 4000"


@query("s26_source_coverage", f"select g.gauge_id, {OUTER} and not exists (select 1 from {{ponds}} q where g.x >= q.x and g.x < q.x + q.w and g.y >= q.y and g.y < q.y + q.h) as covered from (select gauge_id, x + 13 as x, y::double + 7 as y from {{gauges}}) g")
def _(t):
    """A boundary file with an outer ring and the ponds as holes, written as text and read back; which gauges does it cover?"""
    corner = lambda x, y: F.concat(L("   "), x.cast("string"), L("   "), y.cast("string"))
    hole = t.ponds.select(C("id"), F.concat_ws("\n", F.concat(L("!"), C("id").cast("string")), corner(C("x"), C("y")), corner(C("x") + C("w"), C("y")), corner(C("x") + C("w"), C("y") + C("h")), corner(C("x"), C("y") + C("h")), L("END")).alias("text"))
    outer = "area\n1\n   100   100\n   2500   100\n   2500   4000\n   1.0E2   4.0E3\n   100   100\nEND"
    path = R.new_folder(t.spark, "boundary")
    holes = F.coalesce(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda h: h["text"]), "\n"), L(""))
    hole.agg(F.concat_ws("\n", L(outer), holes, L("END")).alias("value")).coalesce(1).write.text(path)
    points = t.gauges.select("gauge_id", (C("x") + 13).alias("x"), (C("y").cast("double") + 7).alias("y"))
    return R.covered(points, R.polygon_file(t.spark, path), "gauge_id", 500.0)
