import pytest
from pyspark.sql import functions as F

from tessera.plans import snapshot
from tessera.plans.engine import statistics
from tessera.sources import markdown_folder

SCHEMA = "output_name string, success boolean, markdown string, images array<struct<name string, content binary>>"


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_markdown_folder(spark, tmp_path):
    rows = [
        ("a", True, "# A\n![x](images/1.png) ![y](out/deep/2.png)", [("1.png", b"one"), ("somewhere/2.png", b"two"), ("3.png", b"no")]),
        ("ü b", True, None, None),
        ("c", False, "failed", [("1.png", b"x")]),
        ("d", True, "", [("4.png", b"")]),
    ]
    markdown_folder.write(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path), "images")
    want = {"_SUCCESS": b"", "a/a.md": rows[0][2].encode(), "a/images/1.png": b"one", "a/images/2.png": b"two", "ü b/ü b.md": b"", "d/d.md": b""}
    assert tree(tmp_path) == want
    # a document is replaced with its images, the others stay
    again = [("a", True, "![z](images/9.png)", [("9.png", b"nine")])]
    markdown_folder.write(spark.createDataFrame(again, SCHEMA), f"file://{tmp_path}", "images")
    want = {k: v for k, v in want.items() if not k.startswith("a/")} | {"a/a.md": again[0][2].encode(), "a/images/9.png": b"nine"}
    assert tree(tmp_path) == want and not [p for p in tmp_path.iterdir() if p.name.startswith("_parts")]
    markdown_folder.write(spark.createDataFrame([("a", True, "plain")], "output_name string, success boolean, markdown string"), str(tmp_path))
    assert tree(tmp_path)["a/a.md"] == b"plain" and "a/images/9.png" not in tree(tmp_path)


def test_a_lost_task_leaves_no_file(spark, tmp_path):
    @F.udf("string")
    def broken(name):
        if name == "n150":
            raise RuntimeError("lost")
        return "text"

    rows = spark.range(200).select(F.concat(F.lit("n"), "id").alias("output_name"), F.lit(True).alias("success")).repartition(1)
    with pytest.raises(Exception, match="lost"):
        markdown_folder.write(rows.withColumn("markdown", broken("output_name")), str(tmp_path))
    assert tree(tmp_path) == {}
    with pytest.raises(Exception, match="no name of a file"):
        markdown_folder.write(spark.createDataFrame([("../x", True, "y")], "output_name string, success boolean, markdown string"), str(tmp_path))
    assert tree(tmp_path) == {}


def test_statistics(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.range(3000).selectExpr("cast(id div 3 as string) as paper_id", "cast(id % 700 as string) as doi", "id as n")
    snapshot.publish(rows, root, "paper_id")
    found = statistics(spark, root)
    assert all("/_stats/" in f for f in found.inputFiles())
    got = found.first()
    assert got.rows == 3000 and abs(got.paper_id - 1000) <= 50 and abs(got.doi - 700) <= 35
    # a delta: papers that go, and a new one
    new = spark.createDataFrame([("new", "x", 1)], "paper_id string, doi string, n long")
    snapshot.update(new, spark.range(100).selectExpr("cast(id as string) as paper_id"), root, snapshot.manifest(spark, root))
    got = statistics(spark, root).first()
    assert got.rows == 3000 - 300 + 1 and abs(got.paper_id - 901) <= 45
    snapshot.publish(new.limit(0), root, "paper_id")
    assert tuple(statistics(spark, root).first()) == (0, 0, 0)
    with pytest.raises(LookupError):
        statistics(spark, str(tmp_path / "none"))
