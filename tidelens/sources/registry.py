"""Run folders: tables written once with a manifest each, read back with warnings, listed, and held against their files."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidelens.operators.places import inside
from tidelens.operators.tables import shared_folder

MANIFEST = "run_id string, role string, uri string, rows long, digest string, created_at string"
#: Fields a manifest must have.
NEEDED = ("run_id", "role", "uri", "rows", "created_at")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/tidelens-{uuid.uuid4().hex}/{name}"


def digest(*columns: str) -> Column:
    """An aggregate that tells the rows of a table, whatever their order: the sum of their hashes, and of a second kind."""
    two = [F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    return F.sha2(F.concat_ws("|", *two), 256)


def write_table(rows: DataFrame, base: str, run_id: str, role: str, created_at: str) -> DataFrame:
    """Writes rows as base/run_id/role and registers them; returns the manifest's row (MANIFEST).

    Rows are counted and digested in the pass that writes them. A uri that exists is refused before anything is written, and Spark's own check
    refuses the second of two that write at once.
    """
    spark = rows.sparkSession
    uri = f"{base}/{run_id}/{role}"
    seen = Observation()
    kept = rows.observe(seen, F.count("*").alias("rows"), *(F.sum(F.xxhash64(F.lit(k), *rows.columns).cast("decimal(38,0)")).cast("string").alias(f"d{k}") for k in (1, 2)))
    kept.write.mode("errorifexists").parquet(uri)
    got = seen.get
    # as digest() writes it: an empty table's sums are null
    parts = spark.range(1).select(F.sha2(F.concat_ws("|", F.lit(got["d1"]).cast("string"), F.lit(got["d2"]).cast("string")), 256).alias("d"))
    row = spark.createDataFrame([(run_id, role, uri, got["rows"], parts.first().d, created_at)], MANIFEST)
    row.coalesce(1).write.mode("errorifexists").json(f"{base}/{run_id}/manifests/{role}")
    return row


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """All manifests below base, also those that are no manifests: (path, MANIFEST's fields, problem), problem being null where all is well.
    A run_id that can't be read is that of the folder."""
    fields = S.StructType.fromDDL(MANIFEST + ", _broken string")
    text = spark.read.text(f"{base}/*/manifests/*", wholetext=False).select(F.col("_metadata.file_path").alias("path"), "value").where(F.length(F.trim("value")) > 0)
    m = text.withColumn("m", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})).select("path", "m.*")
    missing = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in NEEDED))
    problem = F.when(F.col("_broken").isNotNull(), "not readable").when(missing != "", F.concat(F.lit("missing: "), missing))
    folder = F.regexp_extract("path", "([^/]+)/manifests/", 1)
    return m.withColumns({"problem": problem, "run_id": F.coalesce("run_id", folder)}).drop("_broken")


def catalogue(spark: SparkSession, base: str) -> DataFrame:
    """(rank, path, run_id, role, rows, created_at, problem): manifests newest first, then by run and role; broken ones come last, with a reason."""
    m = manifests(spark, base)
    # manifests are a row each of a run, so their order is one task's work
    at = F.struct(F.col("problem").isNotNull(), F.col("created_at").isNull())
    ranked = m.orderBy(at, F.col("created_at").desc(), "run_id", "role", "path")
    return ranked.withColumn("rank", F.monotonically_increasing_id()).select("rank", "path", "run_id", "role", "rows", "created_at", "problem")


def inventory(spark: SparkSession, base: str) -> DataFrame:
    """(path, bytes) of all data files below base, without reading what they hold."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(base)
    return files.select("path", F.col("length").alias("bytes"))


def integrity(spark: SparkSession, base: str) -> DataFrame:
    """(uri, declared_rows, rows, status) of every registered table: ok, missing, unreadable, rows_differ or content_differs.

    Tables are digested where they lie, one job each, as manifests name them: there are few tables and they are large.
    """
    out = None
    for m in manifests(spark, base).where("problem is null").select("uri", "rows", "digest").orderBy("uri").collect():  # a row a table
        declared = [F.lit(m.uri).alias("uri"), F.lit(m["rows"]).cast("long").alias("declared_rows")]
        table, warning = read_table(spark, m.uri)
        if table is None:
            rows = spark.range(1).select(*declared, F.lit(None).cast("long").alias("rows"), F.lit("missing" if "missing" in warning else "unreadable").alias("status"))
        else:
            status = F.when(F.col("rows") != m["rows"], "rows_differ").when(F.col("d") != m.digest, "content_differs").otherwise("ok")
            rows = table.agg(F.count("*").alias("rows"), digest(*table.columns).alias("d")).select(*declared, "rows", status.alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "uri string, declared_rows long, rows long, status string") if out is None else out


def table_columns(spark: SparkSession, path: str) -> list[str]:
    """The names of a table's columns, from its footers."""
    return spark.read.parquet(path).columns


def read_table(spark: SparkSession, path: str, wanted: list[str] | None = None) -> tuple[DataFrame | None, str | None]:
    """The wanted columns that a table has (all, if none are named), or None and a warning: the table is missing, unreadable or has none of them.

    An empty table stays empty, with its columns.
    """
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        return None, f"{path}: missing" if "PATH_NOT_FOUND" in str(e) else f"{path}: unreadable"
    except Exception as e:  # a file that is no table shows in the job that reads footers
        if "FAILED_READ_FILE" not in str(e) and "is not a Parquet file" not in str(e):
            raise
        return None, f"{path}: unreadable"
    names = [c for c in wanted or table.columns if c in table.columns]
    return (table.select(*names), None) if names else (None, f"{path}: none of the wanted columns")


def staged(layer: DataFrame, inside: Column, base: str, name: str) -> tuple[DataFrame, dict[str, int]]:
    """Rows of layer (ring) that lie inside, written to base/name, and what was seen in the same pass: rows, null, empty, invalid, selected.

    A ring is invalid if it is not closed, has fewer than four points or a point that is not finite.
    """
    ring = F.col("ring")
    flat = F.forall("ring", lambda p: F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False)))
    state = F.when(ring.isNull(), "null").when(F.size(ring) == 0, "empty").when(~flat | (F.size(ring) < 4) | (F.get(ring, F.lit(0)) != F.get(ring, F.size(ring) - 1)), "invalid").otherwise("valid")
    seen = Observation()
    judged = layer.withColumn("_state", state).withColumn("_in", F.when(F.col("_state") == "valid", F.coalesce(inside, F.lit(False))).otherwise(False))
    judged = judged.observe(seen, F.count("*").alias("rows"), *(F.count_if(F.col("_state") == s).alias(s) for s in ("null", "empty", "invalid")), F.count_if("_in").alias("selected"))
    judged.where("_in").drop("_state", "_in").write.mode("errorifexists").parquet(f"{base}/{name}")
    return layer.sparkSession.read.parquet(f"{base}/{name}"), dict(seen.get)


def polygon_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, ring_id, hole, ring) of boundary files: a name, then rings, each a label (with ! before it: a hole), a line of x and y for
    every corner, and END; END again ends the file.

    Lines are numbered within their file; a ring is what lies between two ENDs, told by a running sum of them. Rings are closed where they are not.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    text = text.withColumn("value", F.trim("value")).where("line > 0 and value != ''")
    order = Window.partitionBy("file").orderBy("line")
    ended = (F.upper("value") == "END").cast("int")
    lines = text.withColumn("ring_id", F.sum(ended).over(order) - ended)
    number = r"^[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?$"
    lines = lines.withColumn("first", F.row_number().over(Window.partitionBy("file", "ring_id").orderBy("line")) == 1)
    corner = F.split("value", r"\s+")
    point = F.when(~F.col("first") & F.col("value").rlike(number), F.struct("line", corner[0].cast("double").alias("x"), corner[1].cast("double").alias("y")))
    rings = lines.where(ended == 0).groupBy("file", "ring_id").agg(F.max(F.when(F.col("first"), F.col("value").startswith("!"))).alias("hole"), F.transform(F.sort_array(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    rings = rings.where(F.size("ring") >= 3)
    closed = F.get("ring", F.lit(0)) == F.get("ring", F.size("ring") - 1)
    return rings.withColumn("ring", F.when(closed, F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1))))


def covered(points: DataFrame, rings: DataFrame, key: str, size: float) -> DataFrame:
    """(key, covered): whether each of points (key, x, y) lies in a ring that is no hole, and in no hole (rings: hole, ring)."""
    named = rings.withColumn("_ring", F.struct("file", "ring_id"))
    hits = inside(points, named, size, key, "_ring").join(named.select("_ring", "hole"), "_ring").groupBy(key).agg((F.bool_or(~F.col("hole")) & ~F.bool_or("hole")).alias("covered"))
    return points.select(key).join(hits, key, "left").select(key, F.coalesce("covered", F.lit(False)).alias("covered"))
