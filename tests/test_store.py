import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import answers
from tessera.plans import snapshot
from tessera.plans.engine import Engine, build_index, clamped, vacuum, valid_top_k
from tessera.sources import documents
from tessera.sources.sqlite import SqliteSource
from tessera.streaming.sync import follow, ingest, signature, sync, watch
from tests.test_operators import catalog_tables


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "store")
    assert snapshot.generation(spark, root) == "0" and snapshot.current(spark, root) is None
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "paper_id string, n int")
    first = snapshot.publish(df, root)
    assert snapshot.generation(spark, root) == first
    snapshot.publish(snapshot.replaced(snapshot.current(spark, root), spark.createDataFrame([("a", 9)], "paper_id string, n int")), root)
    assert sorted(map(tuple, snapshot.current(spark, root).collect())) == [("a", 9), ("b", 3)]

    def broken(batches):
        raise RuntimeError("lost")
        yield

    before = snapshot.generation(spark, root)
    with pytest.raises(Exception, match="lost"):
        snapshot.publish(df.mapInArrow(broken, df.schema), root)
    assert snapshot.generation(spark, root) == before and snapshot.current(spark, root).count() == 2


def test_update_touches_few_buckets(spark, tmp_path):
    root = str(tmp_path / "store")
    snapshot.publish(spark.range(500).selectExpr("cast(id as string) as paper_id", "id as n"), root)
    base = snapshot.manifest(spark, root)
    snapshot.update(spark.createDataFrame([("7", -7), ("new", 0)], "paper_id string, n long"), spark.createDataFrame([("8",)], "paper_id string"), root, base)
    after = snapshot.manifest(spark, root)
    assert sum(base["parts"][b] != p for b, p in after["parts"].items() if b in base["parts"]) <= 3
    want = {(str(i), i) for i in range(500)} - {("7", 7), ("8", 8)} | {("7", -7), ("new", 0)}
    assert {tuple(r) for r in snapshot.current(spark, root).collect()} == want
    with pytest.raises(snapshot.Conflict):
        snapshot.update(spark.createDataFrame([("9", -9)], "paper_id string, n long"), spark.createDataFrame([], "paper_id string"), root, base)
    assert {tuple(r) for r in snapshot.current(spark, root).collect()} == want


def test_ingest(spark, tmp_path):
    root = str(tmp_path / "kb")
    text = "Salt stores heat for a long time and gives it back at night. " * 3
    docs = spark.createDataFrame([("/f/a.pdf", "p1", "A", text), ("/f/b.pdf", "p2", "B", "short"), ("/f/c.pdf", "p3", "C", None)], "path string, paper_id string, title string, text string")
    assert ingest(spark, root, docs) == {"found": 3, "imported": 1, "too_short": 2}
    more = docs.unionByName(spark.createDataFrame([("/f/d.pdf", "p4", "D", text.replace("Salt", "Sand"))], docs.schema))
    assert ingest(spark, root, more) == {"found": 4, "imported": 1, "too_short": 2, "skipped": 1}
    engine = Engine(spark, root)
    assert {r.paper_id for r in engine.chunks.collect()} == {"p1", "p4"} if engine.refresh() else None
    assert engine.search_text("sand stores").first().title == "D" and engine.search("Sand stores heat", 1)[0].title == "D"
    assert engine.scan("filename", "a.pdf").count() == 1 and engine.scan("paper_id", "p4", 1).count() == 1
    with pytest.raises(ValueError):
        engine.scan("text", "x")
    hit = json.loads(answers(spark, [root, "sand stores", "3"])[0])
    assert hit["title"] == "D" and hit["position"] == 1 and json.loads(answers(spark, [root, "sand stores", "1", "--mode", "semantic"])[0])["title"] == "D"
    assert json.loads(answers(spark, [root, "--full-text", "p1"])[0])["text"].startswith("Salt")
    assert {r["table"] for r in engine.schema().collect()} == {"chunks", "papers", "lists"}


def test_search_follows_the_snapshot(spark, tmp_path):
    """A snapshot that is replaced while a search runs gives one more search."""
    root, runs = str(tmp_path / "kb"), []
    text = "Salt stores heat for a long time and gives it back at night. " * 3
    docs = lambda n, t: spark.createDataFrame([(f"/f/{n}.pdf", n, n.upper(), t)], "path string, paper_id string, title string, text string")
    ingest(spark, root, docs("a", text))
    engine = Engine(spark, root)
    inner = engine._search

    def search(*args):
        runs.append(engine.generation)
        found = inner(*args)
        if len(runs) == 1:
            ingest(spark, root, docs("b", text.replace("Salt", "Sand")))
        return found

    engine._search = search
    assert {r.title for r in engine.search("salt stores heat", 2)} == {"A", "B"} and len(set(runs)) == 2


def test_index_follows_a_delta(spark, tmp_path):
    """One more document writes a small part of what the first ones wrote; searches equal those of
    an index that is written whole; older generations go, those kept go on answering."""
    root = str(tmp_path / "kb")
    body = lambda i: f"Document {i} tells of item{i * 37} and of salt. " + " ".join(f"w{(i * j) % 997}" for j in range(150))
    docs = lambda ids: spark.createDataFrame([(f"/f/d{i}.pdf", f"d{i}", f"Title {i}", body(i)) for i in ids], "path string, paper_id string, title string, text string")
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "kb" / "index").rglob("*.parquet"))
    ingest(spark, root, docs(range(150)))
    first = size()
    ingest(spark, root, docs([500]))
    assert size() - first < first / 5
    engine = Engine(spark, root)
    followed = {q: [r.asDict() for r in engine.search_text(q, 5).collect()] for q in ("item18500", "item3700 OR item74", "salt NOT item37")}
    near = engine.search("Document 500 tells of item18500", 3, exact=True)
    assert followed["item18500"][0]["title"] == "Title 500" and engine.search("Document 500 tells of item18500", 3)[0] == near[0]
    assert len(engine.scan("paper_id", "d7").inputFiles()) < 4 < len(engine.chunks.inputFiles())
    assert {r.title for r in engine.scan("paper_id", "d7").collect()} == {"Title 7"} == {r.title for r in engine.scan("filename", "d7.pdf").collect()}
    assert engine.scan("filename", "none").count() == 0 == engine.scan("paper_id", None).count()
    folders = sum(1 for f in (tmp_path / "kb").iterdir() if f.is_dir())
    ingest(spark, root, docs([501]))
    assert vacuum(spark, root, keep=2) >= 0 and sum(1 for f in (tmp_path / "kb").iterdir() if f.is_dir()) <= folders + 1
    assert engine.index.papers.count() == 151  # the generation before is kept
    build_index(spark, root)
    engine.refresh()
    ingest(spark, root, docs([]))
    whole = Engine(spark, root)
    assert [r.asDict() for r in whole.search_text("item18500", 5).collect()] == followed["item18500"] and whole.index.papers.count() == 152


def test_watch(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, 5)], "path string, length long, modificationTime long")
    assert signature(files) == signature(files) != signature(files.withColumn("length", F.lit(2)))
    states, runs = iter(["s1", "s1", "s1", "s2", "s3", "s3", "s3", "s3", "s4", "s4", "s4"]), []

    def run():
        runs.append(1)
        if len(runs) == 3:
            raise RuntimeError("locked")

    # first state, none, a change that settles late, none, a change that fails and is run again
    assert watch(lambda: next(states, "s4"), run, rounds=7, sleep=lambda _: None) == 3 and len(runs) == 4


def test_state(spark, tmp_path):
    root = str(tmp_path)
    assert snapshot.load_state(spark, root) == snapshot.EMPTY_STATE
    snapshot.save_state(spark, root, {"last_item_id": 40})
    assert snapshot.load_state(spark, root)["last_item_id"] == 40
    (tmp_path / "STATE").write_text("{broken")
    (tmp_path / ".STATE.crc").unlink(missing_ok=True)
    assert snapshot.load_state(spark, root) == snapshot.EMPTY_STATE


def test_sync_and_engine(spark, tmp_path):
    root, tables = str(tmp_path / "kb"), catalog_tables(spark)

    def extract(wanted):
        return wanted.select("itemID", F.lit("ABSTRACT The first paper studies the storage of heat in salt. KEYWORDS heat. " + "More words follow here. " * 60).alias("text"))

    assert sync(spark, root, tables, extract, dry_run=True) == {"found": 2, "with_attachment": 1}
    assert sync(spark, root, tables, extract) == {"found": 2, "removed": 0, "imported": 1, "no_attachment": 1}
    state = snapshot.load_state(spark, root)
    assert (state["last_item_id"], state["last_version"]) == (2, 9) and [r.itemID for r in spark.read.parquet(f"{root}/{state['pending']}").collect()] == [2]
    chunks = snapshot.current(spark, root)
    assert chunks.count() == 3 and {r.authors for r in chunks.collect()} == {"A, B; C; D et al."}
    engine = Engine(spark, root)
    assert engine.health()["status"] == "ready"
    assert engine.search_text("storage of heat").first().title == "One"
    assert len(engine.search("storage of heat", 2)) == 2 == len(engine.search("storage of heat", 2, exact=True))
    with pytest.raises(ValueError):
        engine.search(" ", 2)
    gone = tables | {"deletedItems": spark.createDataFrame([(1, "2025-01-01")], "itemID long, dateDeleted string"), "items": tables["items"].filter("itemID > 1")}
    assert sync(spark, root, gone, extract)["removed"] == 1
    assert snapshot.current(spark, root).count() == 0
    engine.close()


def test_sync_follows_a_stream(spark, tmp_path):
    """A failed item waits; the stream that goes on from its checkpoint tries it again."""
    root, tables, works = str(tmp_path / "kb"), catalog_tables(spark), []

    def extract(wanted):
        text = "ABSTRACT The first paper studies the storage of heat in salt. KEYWORDS heat. " + "More words follow here. " * 20
        return wanted.select("itemID", F.lit(text if works else None).cast("string").alias("text"))

    def run(name):
        spark.createDataFrame([(name,)], "change string").coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        changes = spark.readStream.schema("change string").parquet(str(tmp_path / "changes"))
        query = follow(spark, root, changes, lambda: tables, extract, str(tmp_path / "at"), index=False)
        assert query.awaitTermination(120) and query.exception() is None
        return snapshot.load_state(spark, root)

    state = run("a")
    waiting = {r.itemID for r in spark.read.parquet(f"{root}/{state['pending']}").collect()}
    assert waiting == {1, 2} and snapshot.current(spark, root) is None
    works.append(1)
    state = run("b")
    assert {r.itemID for r in spark.read.parquet(f"{root}/{state['pending']}").collect()} == {2} and snapshot.current(spark, root).count() > 0


def test_top_k():
    assert valid_top_k(100) == 100 and clamped("7") == 7 and clamped(None) == 5 and clamped(1000) == 100
    for bad in (0, 101, True, "5"):
        with pytest.raises(ValueError):
            valid_top_k(bad)


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "a.db")
    con = sqlite3.connect(path)
    con.execute("create table items(itemID integer primary key, key text, w real, b blob)")
    con.executemany("insert into items values (?, ?, ?, ?)", [(i, f"k{i}", i / 2, b"x") for i in range(25)])
    con.commit()
    con.close()
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", "items").option("rowsPerPartition", "10").load()
    assert df.count() == 25 and df.rdd.getNumPartitions() == 3 and df.filter("itemID = 4").first()[:3] == (4, "k4", 2.0)


def test_folders(spark, tmp_path):
    (tmp_path / "B_12.pdf").write_bytes(b"x")
    (tmp_path / "a.PDF").write_bytes(b"xy")
    (tmp_path / "c.txt").write_bytes(b"no")
    (tmp_path / "d.md").write_text("# T\n---\n**b**")
    assert [r.title for r in documents.listing(spark, str(tmp_path)).collect()] == ["B", "a"]
    assert documents.listing(spark, str(tmp_path), most_bytes=1).count() == 1
    row = documents.markdown(spark, str(tmp_path)).first()
    assert row.text == "T\n\nb" and row.pages == 2


def test_outputs_and_inputs(spark):
    """The first output by name of each stem; supported inputs by path; block texts."""
    from tessera.functions import text as T
    from tessera.operators import convert

    files = spark.createDataFrame([("/o/b/x.md",), ("/o/a/x.md",), ("/o/y.md",), ("/o/z.md",)], "path string")
    found = documents.find_output(files, spark.createDataFrame([("x",), ("y",), ("x",), ("none",)], "stem string"))
    assert {tuple(r) for r in found.collect()} == {("x", "/o/a/x.md"), ("y", "/o/y.md")}
    names = spark.createDataFrame([(p,) for p in ("b.PDF", "a.docx", "c.txt", "d.tiff", "pdf", ".pdf")], "path string")
    assert [r.path for r in convert.supported(names).collect()] == ["a.docx", "b.PDF", "d.tiff"]
    blocks = spark.sql("select array(named_struct('spans', array(named_struct('text', 'exam-'))), named_struct('spans', array(named_struct('text', '\nple'), named_struct('text', ' end - \nx')))) as lines")
    assert blocks.select(T.block_text(F.col("lines"))).first()[0] == "example end - \nx"
