"""Run folders, manifests, boundary files and staged layers on small cases."""

import pytest
from pyspark.sql import functions as F

from tidelens.operators import tables as T
from tidelens.sources import registry as R

RING = "array<struct<x:double,y:double>>"


@pytest.fixture
def base(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string").repartition(3)
    R.write_table(rows, str(tmp_path), "r1", "things", "2024-01-01")
    R.write_table(rows.limit(0), str(tmp_path), "r2", "things", "2024-01-02")
    return str(tmp_path)


def states(spark, base):
    return {r.uri.removeprefix(base + "/"): (r.declared_rows, r["rows"], r.status) for r in R.integrity(spark, base).collect()}


def test_tables_are_registered_once(spark, base):
    got = {r.run_id: r for r in R.manifests(spark, base).collect()}
    assert {k: (r.role, r.uri, r["rows"], r.created_at, r.problem) for k, r in got.items()} == {"r1": ("things", f"{base}/r1/things", 3, "2024-01-01", None), "r2": ("things", f"{base}/r2/things", 0, "2024-01-02", None)}
    with pytest.raises(Exception, match="already exists"):
        R.write_table(spark.range(5).toDF("k"), base, "r1", "things", "2024-01-03")
    assert states(spark, base) == {"r1/things": (3, 3, "ok"), "r2/things": (0, 0, "ok")}


def test_damage_is_found(spark, base, tmp_path):
    R.write_table(spark.range(4).toDF("k"), base, "r3", "x", "2024-01-03")
    R.write_table(spark.range(4).toDF("k"), base, "r3", "y", "2024-01-03")
    spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k long, v string").write.mode("overwrite").parquet(f"{base}/r1/things")
    spark.range(1).toDF("k").write.mode("append").parquet(f"{base}/r3/x")
    for f in (tmp_path / "r3" / "y").glob("*"):
        f.unlink()
    (tmp_path / "r3" / "y").rmdir()
    for f in list((tmp_path / "r2" / "things").glob("*.parquet")) + list((tmp_path / "r2" / "things").glob(".*.crc")):
        f.write_bytes(b"no parquet" if f.suffix == ".parquet" else b"")
        if f.suffix == ".crc":
            f.unlink()
    assert states(spark, base) == {"r1/things": (3, 3, "content_differs"), "r2/things": (0, None, "unreadable"), "r3/x": (4, 5, "rows_differ"), "r3/y": (4, None, "missing")}


def test_catalogue_lists_what_is_broken(spark, base, tmp_path):
    for name, text in (("r8", "{not json"), ("r9", '{"run_id": "r9", "role": "a", "uri": "u", "created_at": "2025-01-01"}')):
        (tmp_path / name / "manifests").mkdir(parents=True)
        (tmp_path / name / "manifests" / "m.json").write_text(text)
    got = [(r.run_id, r.problem) for r in R.catalogue(spark, base).orderBy("rank").collect()]
    assert got == [("r2", None), ("r1", None), ("r9", "missing: rows"), ("r8", "not readable")]


def test_tables_with_warnings(spark, base):
    assert R.table_columns(spark, f"{base}/r1/things") == ["k", "v"]
    table, warning = R.read_table(spark, f"{base}/r1/things", ["v", "none"])
    assert table.columns == ["v"] and table.count() == 3 and warning is None
    empty, warning = R.read_table(spark, f"{base}/r2/things")
    assert (empty.columns, empty.count(), warning) == (["k", "v"], 0, None)
    assert R.read_table(spark, f"{base}/r1/things", ["none"]) == (None, f"{base}/r1/things: none of the wanted columns")
    assert R.read_table(spark, f"{base}/nowhere") == (None, f"{base}/nowhere: missing")


def test_inventory_reads_no_content(spark, base):
    files = R.inventory(spark, base)
    assert files.columns == ["path", "bytes"] and files.where("bytes > 0").count() == files.count() > 1
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()


def test_boundary_files(spark, tmp_path):
    """Two rings and two holes, one ring left open, odd spacing and numbers, and a second file."""
    (tmp_path / "a.poly").write_text("area\n1\n  0 0\n  10 0\n  1.0E1  1e1\n  0 10\n  0 0\nEND\n\n!2\n2 2\r\n4 2\r\n4 4\r\n2 4\r\nEND\n!3\n6 6\n7 6\n7 7\nEND\nisland\n20 0\n+22 0\n22 2.0\n20 2\nEND\nEND\n")
    (tmp_path / "b.poly").write_text("other\nx\n-5 -5\n-4 -5\n-4 -4\nEND\nEND\n")
    rings = R.polygon_file(spark, str(tmp_path))
    got = {(r.file, r.ring_id): (r.hole, [tuple(p) for p in r.ring]) for r in rings.collect()}
    assert got == {("a.poly", 0): (False, [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), ("a.poly", 1): (True, [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]), ("a.poly", 2): (True, [(6, 6), (7, 6), (7, 7), (6, 6)]), ("a.poly", 3): (False, [(20, 0), (22, 0), (22, 2), (20, 2), (20, 0)]), ("b.poly", 0): (False, [(-5, -5), (-4, -5), (-4, -4), (-5, -5)])}
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 6.7, 6.3), (4, 21.0, 1.0), (5, 50.0, 50.0), (6, None, 1.0)], "k int, x double, y double")
    assert {r.k: r.covered for r in R.covered(points, rings, "k", 4.0).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}


def test_staged_layers(spark, tmp_path):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [(1, square), (2, None), (3, []), (4, square[:3]), (5, [*square[:2], (float("nan"), 1.0), square[0]]), (6, [*square[:2], None, square[0]]), (7, square)]
    layer = spark.createDataFrame(rows, f"id int, ring {RING}")
    kept, seen = R.staged(layer, F.col("id") < 5, str(tmp_path), "layer")
    assert seen == {"rows": 7, "null": 1, "empty": 1, "invalid": 3, "selected": 1} and [r.id for r in kept.collect()] == [1] and kept.columns == ["id", "ring"]
    _, seen = R.staged(layer.limit(0), F.col("id") < 5, str(tmp_path), "none")
    assert set(seen.values()) == {0}


def test_folders_are_shared(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        T.shared_folder(Session())
    assert T.shared_folder(spark)
