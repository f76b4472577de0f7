"""JSON, CSV and element documents on small cases."""

import json

from pyspark.sql import functions as F

from tidelens.sources import records as S


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "ä\n\"", [1, 2]), (2, 0.5, "b", None)], "z int, a double, m string, l array<int>")
    assert S.write_json_lines(rows, str(tmp_path / "x")) == 2
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "x")).collect())
    assert all(list(json.loads(x)) == ["a", "l", "m", "z"] for x in lines)
    assert {(r.z, r.a, r.m) for r in S.read_json_lines(spark, str(tmp_path / "x"), "z int, a double, m string").collect()} == {(1, None, 'ä\n"'), (2, 0.5, "b")}
    (tmp_path / "y.json").write_text('{"z": 3}\n{torn\n')
    assert {(r.z, r._broken) for r in S.read_json_lines(spark, str(tmp_path / "y.json"), "z int").collect()} == {(3, None), (None, "{torn")}
    assert S.write_json_lines(rows.limit(0), str(tmp_path / "none")) == 0


def test_csv_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,the name,v\n1,"a, b",\n1, ,2\n2,"c ""d""",3\n,x,4\n', encoding="utf-8")
    got = {r.field: tuple(r)[1:] for r in S.csv_inventory(spark, str(tmp_path / "a.csv"), ["id", "phone"], "id").collect()}
    assert got == {"id": (True, 1, 4, 1, "utf-8"), "the name": (True, 1, 4, 1, "utf-8"), "v": (True, 1, 4, 1, "utf-8"), "phone": (False, None, 4, 1, "utf-8")}
    (tmp_path / "b.csv").write_bytes("id\n".encode() + "ไทย\n".encode("cp874"))
    (tmp_path / "c.csv").write_text("id\n")
    assert [tuple(r) for r in S.csv_inventory(spark, str(tmp_path / "b.csv"), [], "nothing").collect()] == [("id", True, 0, 1, None, "other")]
    assert [tuple(r) for r in S.csv_inventory(spark, str(tmp_path / "c.csv"), [], "id").collect()] == [("id", True, 0, 0, 0, "utf-8")]


def test_elements(spark):
    def e(type, id, lon=None, lat=None, nodes=None, members=None, tags=None):
        return (type, id, lon, lat, nodes, members, tags)

    rows = [e("node", k, float(k), 0.0) for k in range(1, 6)] + [e("node", 9, 9.0, 9.0, tags={"amenity": "school"}), e("node", 10, 8.0, 8.0, tags={"amenity": "cafe", "emergency": "assembly_point"})]
    rows += [e("way", 1, nodes=[3, 1, 2], tags={"highway": "primary"}), e("way", 2, nodes=[1, 2, 3, 1], tags={"building": "yes", "natural": "water"}), e("way", 3, nodes=[1, 77, 2], tags={"highway": "path", "waterway": "ditch"})]
    rows += [e("way", 4, nodes=[], tags={"highway": "primary"}), e("way", 5, nodes=[4, 5]), e("way", 6, nodes=[1, 2, 3, 1], tags={"building": "no", "natural": "tree", "landuse": "forest"})]
    rows += [e("relation", 1, members=[("way", 5, "outer"), ("way", 2, "inner"), ("way", 1, ""), ("node", 1, "outer"), ("way", 99, "outer")], tags={"landuse": "basin"}), e("relation", 2, members=[])]
    shapes = S.geometries(spark.createDataFrame(rows, S.ELEMENT))
    got = {(r.type, r.id): ([int(p.x) for p in r.points], r.closed) for r in shapes.collect()}
    assert got[("way", 1)] == ([3, 1, 2], False) and got[("way", 2)] == ([1, 2, 3, 1], True) and got[("way", 3)] == ([1, 2], False) and got[("way", 4)] == ([], False)
    assert got[("relation", 1)] == ([4, 5, 3, 1, 2], False) and got[("relation", 2)] == ([], False) and got[("node", 9)] == ([9], False) and len(got) == len(rows)
    found = {(r.layer, r.id, r.kind) for r in S.layers(shapes).collect()}
    assert found == {("road", 1, "primary"), ("building", 2, "yes"), ("water", 2, "water"), ("road", 3, "path"), ("water", 3, "ditch"), ("road", 4, "primary"), ("water", 1, "basin")}
    assert {(r.id, r.kind, r.x, r.verified) for r in S.candidates(shapes).collect()} == {(9, "school", 9.0, False), (10, "assembly_point", 8.0, False)}
    assert S.geometries(spark.createDataFrame([], S.ELEMENT)).withColumn("n", F.size("points")).count() == 0
