import math
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import catalog, chunk, convert, dedup, layout, lexical, matching, papers, textindex, vector


def test_chunks(spark):
    text = "1. Introduction\nhttps://a.b\n" + " ".join(f"w{i}" for i in range(230)) + "\nhttps://a.b\nResults\nshort one"
    rows = chunk.chunk_documents(spark.createDataFrame([(1, text), (2, "tiny"), (3, None)], "id int, text string"), "id").orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.section, len(r.text.split())) for r in rows] == [(0, "1. Introduction", 2), (1, "1. Introduction", 100), (2, "1. Introduction", 100), (3, "1. Introduction", 30), (4, "Results", 3)]
    assert {r.total_chunks for r in rows} == {5}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab \n", max_size=900), min_size=1, max_size=3))
def test_chunks_keep_words(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for i, text in enumerate(texts):
        rows = chunk.chunk_documents(df.filter(F.col("id") == i), "id").orderBy("chunk_index").collect()
        if rows:
            assert " ".join(r.text for r in rows).split() == text.split()
            assert [r.chunk_index for r in rows] == list(range(len(rows))) and all(len(r.text.split()) <= 100 for r in rows)


PAPERS = [
    ("p1", "Solar energy storage", "A study of thermal storage with storage tanks", "energy summary"),
    ("p2", "Deep learning", "Neural nets for energy forecasting", ""),
    ("p3", "Graph PEC cells", "especially good results", "x"),
    ("p4", "光电化学电池", "关于能源的研究", "中文"),
    ("p5", "Unrelated", "specimen of especially rare rocks", "none"),
]


@pytest.fixture(scope="module")
def papers_df(spark):
    return spark.createDataFrame([(*p, f"{p[0]}.pdf") for p in PAPERS], "paper_id string, title string, abstract string, summary string, filename string").cache()


def test_bm25_equals_sqlite(spark, papers_df):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, abstract, summary, tokenize='trigram')")
    con.executemany("insert into f(rowid, title, abstract, summary) values (?, ?, ?, ?)", [(i, *p[1:]) for i, p in enumerate(PAPERS, 1)])
    queries = ["storage", "energy", "especially rare", "能源的", "solar OR rare", "energy NOT solar", "especially AND good", "sto* rare OR neural net", "title:energy", 'abstract:"thermal storage" OR summary:energy', "energy NOT solar storage OR rare", "especially good NOT specimen AND results"]
    for q in queries:
        want = {f"p{i}": r for i, r in con.execute("select rowid, rank from f where f match ?", (q,))}
        got = {r.paper_id: r["rank"] for r in lexical.bm25(papers_df, q).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def sqlite_index(rows):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, abstract, summary, tokenize='trigram')")
    con.executemany("insert into f(rowid, title, abstract, summary) values (?, ?, ?, ?)", rows)
    return con


def sqlite_hits(con, q):
    try:
        return {f"p{i}": r for i, r in con.execute("select rowid, rank from f where f match ?", (q,))}
    except sqlite3.OperationalError:
        return None


def generated_queries(draw, n):
    def phrase():
        word = draw.choice(["solar", "wind", "storm", "sun", "ab", "nsu", '"ar wind"', '"x y z"', '"un su"', '""', "zzz", "é能源x"])
        return word + draw.choice(["", "", "", "*", " + arw", ' + "ar "', " + wind"])

    def columns():
        return draw.choice(["title:", "abstract :", "{title summary}:", "-title:", "- {abstract summary} :"]) if draw.random() < 0.3 else ""

    def group():
        r = draw.random()
        if r < 0.25:
            return f"{columns()}NEAR({' '.join(phrase() for _ in range(draw.choice([1, 2, 2, 3])))}{draw.choice(['', ',3', ', 8', ',0'])})"
        return columns() + ("^ " if r < 0.35 else "") + phrase()

    def whole(depth=0):
        r = draw.random()
        if depth > 3 or r < 0.4:
            return " ".join(group() for _ in range(draw.choice([1, 1, 2])))
        if r < 0.5:
            return f"{columns()}({whole(depth + 1)})"
        return f"{whole(depth + 1)} {draw.choice(['AND', 'OR', 'NOT'])} {whole(depth + 1)}"

    return [whole() for _ in range(n)]


def test_the_query_language_is_sqlites(spark):
    """Hits of generated queries, and which queries are of the language. Ranks where no
    alternative that fails has phrases: what SQLite counts of those depends on where its cursors
    stand."""
    draw = random.Random(11)
    text = lambda n: " ".join(draw.choice(["solar", "wind", "storm", "sun", "ab", "olar", "ar wind", "sunsun", "x y z", "é能源x"]) for _ in range(draw.randrange(n)))
    rows = [(i, text(4), text(14), text(6)) for i in range(1, 41)]
    con, df = sqlite_index(rows), spark.createDataFrame([(f"p{i}", *r) for i, *r in rows], "paper_id string, title string, abstract string, summary string").cache()
    odd = ["NEAR abc", "NEAR", "a AND b", "x-y abc", '"open', "OR abc", "abc OR", "other:abc", "(abc)", "solar (wind)", "(solar) wind", "NEAR(solar wind, x)", "NEAR(solar, wind)", "solar+", "^", "solar ^wind", "^title:sun", "-{title}:wind", "foo(solar)", "sun * wind", "()", "title:abstract:sun", "solar'", "sun%", "AND", "-sun", "{}:sun", "+sun", "NEAR(^sun wind)", "sun,wind", "NEAR(sun storm,5)wind", "a.b", "sun OR storm AND wind NOT solar"]
    for q in odd + generated_queries(draw, 300):
        assert (lexical.parse(q) is None) == (sqlite_hits(con, q) is None), q
    for q in odd[-1:] + generated_queries(draw, 40):
        got, want = {r.paper_id: r["rank"] for r in lexical.bm25(df, q).collect()}, sqlite_hits(con, q)
        assert got.keys() == want.keys(), q
        if "NOT" not in q and not ("AND" in q and "OR" in q) and not (" OR " in q and " " in q.replace(" OR ", "")):
            assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want), q


def test_near_counts():
    assert matching.near_counts([[0, 50], [4, 100]], [3, 3], 1) == [1, 1]
    assert matching.near_counts([[0, 2, 9], [4]], [3, 3], 10) == [3, 1]
    assert matching.near_counts([[0], []], [1, 1], 5) == [0, 0] and matching.places_of("aaaa", "aaa") == [0, 1]


def test_search(spark, papers_df):
    rows = lexical.search(papers_df, "energy", 5).orderBy("position").collect()
    assert [r.paper_id for r in rows][:1] == ["p1"] and rows[0].match_type == "title+summary" and rows[0].score >= 14
    short = lexical.search(papers_df, "PEC", 5).orderBy("position").collect()
    assert [r.paper_id for r in short] == ["p3", "p5"] and [r.match_type for r in short] == ["title", "unknown"]
    assert lexical.search(papers_df, "  ", 5).count() == 0 and lexical.search(papers_df, "absent", 5).count() == 0
    assert [r.paper_id for r in lexical.search(papers_df, "能源", 5).collect()] == ["p4"]
    assert lexical.search(papers_df, "50%_x", 5).count() == 0
    assert [p.text for p in lexical.parse('"deep learning" net ab')[0]] == ["deep learning", "net"]


def test_index(spark, papers_df, tmp_path, monkeypatch):
    """Searches over the written index equal scans, by ids and, where lists are long, by joins."""
    state = textindex.write_index(papers_df, str(tmp_path / "i"))
    queries = ("energy", "PEC", "能源", "storage OR rare", "especially NOT good", "sto_age", "50%_x", "absent", "ab", "e_e", "x-y", "title:energy", "NEAR(thermal storage) OR ^deep", "st%ge")
    want = {q: [r.asDict() for r in lexical.search(papers_df, q, 5).orderBy("position").collect()] for q in queries}
    for most in (textindex.MOST_IDS, -1):
        monkeypatch.setattr(textindex, "MOST_IDS", most)
        index = textindex.Index(spark, str(tmp_path / "i"), state)
        for q in queries:
            assert [r.asDict() for r in lexical.search(index.papers, q, 5, index).orderBy("position").collect()] == want[q], (q, most)
    empty = textindex.Index(spark, str(tmp_path / "e"), textindex.write_index(papers_df.limit(0), str(tmp_path / "e")))
    assert lexical.search(empty.papers, "energy", 5, empty).count() == 0


def test_index_in_segments(spark, tmp_path):
    """After each delta, searches equal those over a new index; a delta writes in proportion to
    itself; older states go on answering until they are vacuumed."""
    folder, draw = str(tmp_path / "i"), random.Random(4)
    words = ["".join(draw.choice("abcdefg") for _ in range(6)) for _ in range(200)]
    text = lambda: " ".join(draw.choice(words) for _ in range(60))
    df = lambda rows: spark.createDataFrame([(k, *v, "s") for k, v in rows.items()], "paper_id string, title string, abstract string, summary string")
    size = lambda: sum(f.stat().st_size for f in tmp_path.joinpath("i").rglob("*.parquet"))
    papers = {f"p{i}": (text()[:20], text()) for i in range(400)}
    states = [textindex.write_index(df(papers), folder)]
    first = size()
    for step in range(5):
        new = {f"p{draw.randrange(420)}": (text()[:20], text()) for _ in range(4)}
        gone = [f"p{step * 7}", "none"]
        before = size()
        states.append(textindex.update_index(spark, folder, states[-1], df(new), spark.createDataFrame([(g,) for g in gone if g not in new], "paper_id string")))
        papers = {k: v for k, v in papers.items() if k not in gone} | new
        if step == 0:
            assert size() - before < first / 4 and len(states[-1]["segments"]) == 2
        index = textindex.Index(spark, folder, states[-1])
        whole = df(papers)
        assert index.totals == (lexical.totals(whole)[0], pytest.approx(lexical.totals(whole)[1]))
        for q in (words[step], f"{words[step][:4]} OR {new[next(iter(new))][1][:6]}", "absent"):
            assert [r.asDict() for r in lexical.search(index.papers, q, 8, index).collect()] == [r.asDict() for r in lexical.search(whole, q, 8).collect()], (step, q)
    assert len(states[-1]["segments"]) < 5
    old = textindex.Index(spark, folder, states[-2])
    n = old.papers.count()
    assert textindex.vacuum(spark, folder, states[-2:]) > 0 and old.papers.count() == n
    assert lexical.search(old.papers, words[0], 3, old).count() == 3


def test_highlight(spark):
    text = "0123456789abc" + "x" * 487
    got = spark.createDataFrame([(text,)], "t string").select(lexical.highlight(F.col("t"), "ABC").alias("h")).first()["h"]
    assert got == "0123456789**abc**" + "x" * 200 + "..."
    assert spark.range(1).select(lexical.highlight(F.lit("no match"), "zzz").alias("h")).first()["h"] == "no match"


def test_vectors(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(50)] + [(50, [0.0, 0.0]), (51, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(range(50), key=lambda i: (-round(math.cos(i - 7), 12), i))[:5]
    assert [r.vec_id for r in vector.nearest(df, rows[7][1], 5).collect()] == want
    batch = vector.nearest_batch(df, df.filter("vec_id in (7, 8)"), 5, rows=16).orderBy("query_id", "position").collect()
    assert [r.vec_id for r in batch if r.query_id == 7] == want
    hits = spark.createDataFrame([("a", 0.8), ("b", 0.3), ("c", 0.9)], "id string, score double")
    assert [r.id for r in vector.rerank(hits, 2).collect()] == ["c", "a"]
    assert [r.id for r in vector.rerank(hits.withColumn("score", F.lit(0.5)), 2, ties=("id",)).collect()] == ["a", "b"]
    embedded = vector.embed(spark.createDataFrame([("hello world",), (None,)], "text string"), lambda: vector.trigram_encoder(16)).collect()
    assert math.isclose(sum(x * x for x in embedded[0].embedding), 1, rel_tol=1e-5) and not any(embedded[1].embedding)


def test_vector_index(spark, tmp_path):
    """Recall of the index against exact neighbours, every row indexed."""
    corpus = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vector.write_index(corpus, str(tmp_path / "v"), sample_rows=2000)
    index = vector.Index(spark, str(tmp_path / "v"))
    assert index.rows.count() == corpus.filter("embedding is not null").count()
    queries = corpus.filter("vec_id % 20 = 0")
    want = {(r.query_id, r.vec_id) for r in vector.nearest_batch(corpus, queries, 10).collect()}
    rows = index.nearest_batch(queries, 10).collect()
    got = {(r.query_id, r.vec_id) for r in rows}
    print("recall", len(got & want) / len(want))
    assert len(got & want) >= 0.9 * len(want) and len(rows) == len(got) == len(want)
    q = queries.first()
    one = [r.vec_id for r in index.nearest(list(q["embedding"]), 10).collect()]
    assert one == [r.vec_id for r in sorted(rows, key=lambda r: r.position) if r.query_id == q["vec_id"]]


def catalog_tables(spark):
    df = spark.createDataFrame
    return {
        "items": df([(1, "k1", 5, 1), (2, "k2", 6, 1), (3, "k3", 7, 2), (4, "a1", 1, 3), (5, "a2", 1, 3), (6, "k6", 9, 1)], "itemID long, key string, version long, itemTypeID long"),
        "itemTypes": df([(1, "journalArticle"), (2, "note"), (3, "attachment")], "itemTypeID long, typeName string"),
        "deletedItems": df([(6, "2024-01-01"), (None, "2024-01-01")], "itemID long, dateDeleted string"),
        "itemData": df([(1, 1, 1), (1, 59, 2), (2, 1, 3)], "itemID long, fieldID long, valueID long"),
        "itemDataValues": df([(1, "One"), (2, "10.1/x"), (3, "Two")], "valueID long, value string"),
        "itemAttachments": df([(4, 1, 0, catalog.ATTACHMENT_TYPES[1]), (5, 1, 0, catalog.ATTACHMENT_TYPES[0])], "itemID long, parentItemID long, linkMode int, contentType string"),
        "collections": df([(1, "top", None), (2, "sub", 1), (3, "lost", 99)], "collectionID long, collectionName string, parentCollectionID long"),
        "collectionItems": df([(1, 2), (1, 3)], "itemID long, collectionID long"),
        "creators": df([(1, "A", "B"), (2, "C", ""), (3, "", "D"), (4, "E", "F")], "creatorID long, lastName string, firstName string"),
        "itemCreators": df([(1, c, 1, c) for c in (1, 2, 3, 4)] + [(2, 2, 1, 0), (2, 1, 2, 1)], "itemID long, creatorID long, creatorTypeID long, orderIndex long"),
    }


def test_catalog(spark):
    t = catalog_tables(spark)
    rows = catalog.scan_items(t).collect()
    assert [(r.itemID, r.title, r.doi) for r in rows] == [(1, "One", "10.1/x"), (2, "Two", "")]
    assert [r.itemID for r in catalog.scan_items(t, 1, 5, spark.createDataFrame([(1,), (1,)], "itemID long")).collect()] == [1, 2] and [r.itemID for r in catalog.scan_items(t, 1, 5).collect()] == [2]
    assert catalog.attachments(t).collect()[0].attachment_key == "a2"
    files = spark.createDataFrame([("/s/a2/b.docx", 5), ("/s/a2/c.PDF", 6), ("/s/a2/d.pdf", 7)], "path string, length long")
    assert [tuple(r) for r in catalog.stored_files(files, catalog.attachments(t)).collect()] == [(1, "/s/a2/c.PDF", 6)] and catalog.stored_files(files, catalog.attachments(t), 5).count() == 0
    assert catalog.item_collections(t).collect()[0].collections == "lost; top/sub"
    assert {r.itemID: r.authors for r in catalog.item_authors(t).collect()} == {1: "A, B; C; D et al.", 2: "C"}
    assert catalog.high_water(t["items"].limit(0), "version").first()[0] == 0


def test_greedy_dedup(spark):
    rows = [(1, "d1", "x"), (2, "d2", "x"), (3, "d2", "y"), (4, "", ""), (5, None, None), (6, "d3", "y")]
    got = {r.id: r.accepted for r in dedup.greedy(spark.createDataFrame(rows, "id long, doi string, title string"), ["doi", "title"], "id").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False}


def test_greedy_follows_long_chains(spark, monkeypatch):
    """Ten thousand items of which each shares a key with the next; a chain with side branches."""
    steps, plain = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: steps.append(1) or plain(df))
    for n, branched in ((10_000, False), (120, True)):
        steps.clear()
        rows = [(i, f"d{i // 2}", f"t{(i + 1) // 2}", f"b{i // 50}" if branched and i % 50 in (3, 20) else None) for i in range(n)]
        seen, want = set(), {}
        for i, *ks in rows:
            own = {(j, k) for j, k in enumerate(ks) if k}
            want[i] = not own & seen
            seen |= own if want[i] else set()
        got = dedup.greedy(spark.createDataFrame(rows, "id long, doi string, title string, branch string"), ["doi", "title", "branch"], "id").collect()
        assert {r.id: r.accepted for r in got} == want and len(steps) < 40


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=14))
def test_greedy_equals_fold(spark, keys):
    rows = [(i, f"a{x}", f"b{y}") for i, (x, y) in enumerate(keys)]
    seen, want = set(), {}
    for i, a, b in rows:
        want[i] = not {a, b} & seen
        if want[i]:
            seen |= {a, b}
    got = {r.id: r.accepted for r in dedup.greedy(spark.createDataFrame(rows, "id long, a string, b string"), ["a", "b"], "id").collect()}
    assert got == want


def test_probe(spark):
    store = spark.createDataFrame([("p1", "d1", "t1", 1), ("p2", "", "t2", 2)], "paper_id string, doi_norm string, title_norm string, item_id long")
    items = spark.createDataFrame([(1, "d1", "zz"), (9, "", "t2"), (3, "d9", "t9"), (4, "", "")], "item_id long, doi_norm string, title_norm string")
    assert {r.item_id: r.action for r in dedup.decide(dedup.probe(items, store)).collect()} == {1: "update", 9: "skip_dup", 3: "insert", 4: "insert"}


def test_papers(spark):
    body = "This abstract has more than forty characters in all."
    chunks = spark.createDataFrame([("p", 1, "KEYWORDS a", "t"), ("p", 0, f"ABSTRACT {body}", "t"), ("q", 0, "short", None)], "paper_id string, chunk_index int, text string, title string")
    got = {r.paper_id: r for r in papers.papers_of(chunks).collect()}
    assert got["p"].abstract == body and got["p"].has_abstract == 1 and got["p"].source == "papers" and got["q"].title == "" and got["q"].abstract_len == 0
    assert papers.build_stats(papers.papers_of(chunks)).first() == (2, 1, 0, 1, 50.0)
    loose = spark.createDataFrame([("p", "k", "B", 2), ("p", "k", "A", 1), ("", "k2", "C", 3), ("", "", "D", 4), (None, None, "D", 5)], "paper_id string, zotero_key string, title string, place int")
    assert sorted(r.title for r in papers.paper_titles(loose).collect()) == ["A", "C", "D", "D"] and papers.paper_keys(loose).filter("paper_key like 'unknown-%'").count() == 2
    titles = spark.createDataFrame([(0, "Solar Energy solar"), (1, "能源 energy of"), (2, None)], "place int, title string")
    assert [(r.keyword, r.n) for r in papers.keywords(titles).collect()] == [("solar", 2), ("energy", 2), ("能源", 1)]
    info = papers.collection_info(titles, 7).first()
    assert info.language == "zh" and info.paper_count == 3 and info.chunk_count == 7 and info.keywords[:2] == ["solar", "energy"]


def test_layout(spark):
    rows = [("d", 0, 0, 10.0, 104.0, 110.0, 1000.0, "b"), ("d", 0, 0, 5.0, 101.0, 110.0, 1000.0, "a"), ("d", 0, 0, 1.0, 10.0, 20.0, 1000.0, "header"), ("d", 1, 0, 1.0, 100.0, 110.0, 1000.0, "References"), ("d", 2, 0, 1.0, 100.0, 110.0, 1000.0, "gone"), ("e", 0, 1, 1.0, 100.0, 110.0, 1000.0, "image")]
    df = spark.createDataFrame(rows, "doc string, page int, type int, x0 double, y0 double, y1 double, height double, text string")
    assert {r.doc: r.text for r in layout.page_text(df).collect()} == {"d": "a\nb", "e": None}


def test_convert(spark, tmp_path):
    names = lambda paths: [r.output_name for r in convert.output_names(spark.createDataFrame([(p,) for p in paths], "path string")).orderBy("path").collect()]
    assert names(["a/paper.pdf", "b/Paper.pdf", "c/paper-2.pdf"]) == ["paper", "Paper-2", "paper-2-2"]
    assert names(["a/x-2.pdf", "b/x.pdf", "c/X.docx", "d/x.png", "e/x-3.gif"]) == ["x-2", "x", "X-3", "x-4", "x-3-2"]
    files = spark.createDataFrame([("a.pdf", "a", b"x"), ("b.pdf", "b", b"bad")], "path string, output_name string, content binary")

    def converter(path, content, options):
        if content == b"bad":
            raise ValueError("damaged")
        return f"# {path} {options['max_pages']} {options['language']}"

    assert {r.path: (r.success, r.error) for r in convert.convert(files, converter).collect()} == {"a.pdf": (True, ""), "b.pdf": (False, "damaged")}
    done = convert.convert(files.drop("output_name"), converter, "pipeline", "en", "txt", 7)
    assert [(r.output_name, r.markdown, r.backend, r.language, r.method) for r in done.filter("success").collect()] == [("a", "# a.pdf 7 en", "pipeline", "en", "txt")]
    assert convert.counted(done).first() == (2, 1, 1)
    convert.write_markdown(done, str(tmp_path / "md"))
    assert [p.read_text() for p in (tmp_path / "md" / "output_name=a").glob("*.txt")] == ["# a.pdf 7 en\n"]
    for bad in ({"max_pages": True}, {"backend": "x"}, {"language": "xx"}, {"method": "x"}):
        with pytest.raises(ValueError):
            convert.convert(files, converter, **bad)
    md = spark.createDataFrame([("a ![x](p.png) b",)], "md string")
    assert md.select(convert.describe_images(F.col("md"), F.create_map(F.lit("p.png"), F.lit("a cat")))).first()[0] == "a ![x](p.png)\n> VLM description: a cat\n b"


def test_sql_functions(spark):
    from tessera.functions import sql
    from tessera.functions import text as T

    sql.register(spark)
    texts = spark.createDataFrame([("a  b [1, 2] see https://x.y/z\n\nDOI: 10.1/x end ", " 10.1/AB.. ")], "t string, d string")
    texts.createOrReplaceTempView("texts")
    got = spark.sql("select clean_text(t) c, doi_norm(d) d, paper_id(t) p, cosine(array(3D, 4D), array(4D, 3D)) s, cosine(array(0D), array(1D)) z from texts").first()
    want = texts.select(T.clean_text(F.col("t")), T.doi_norm(F.col("d")), T.paper_id(F.col("t")), F.lit(0.96), F.lit(0.0)).first()
    assert tuple(got) == tuple(want)


def test_info_and_hits(spark, tmp_path):
    titles = spark.createDataFrame([(0, "Solar Energy solar")], "place int, title string")
    papers.write_info(papers.collection_info(titles, 7), str(tmp_path / "info"))
    assert papers.read_info(spark, str(tmp_path / "info")).first()["paper_count"] == 1
    assert papers.as_json(titles.withColumn("n", F.lit(None).cast("int"))).first()[0] == '{"place":0,"title":"Solar Energy solar","n":null}'
    hits = spark.createDataFrame([("p", 2, "s" * 40, "t" * 500), ("p", 1, None, "t"), ("q", 3, "s", None)], "paper_id string, position int, section string, text string")
    got = {(r.paper_id, r.position): (r.is_first, len(r.section), len(r.preview)) for r in papers.grouped_hits(hits).collect()}
    assert got == {("p", 1): (True, 0, 1), ("p", 2): (False, 30, 403), ("q", 3): (True, 1, 0)}


def test_scratch(spark):
    """What is cut in a block goes with it; what it keeps stays."""
    from tessera import lineage

    with lineage.scratch(spark) as keep:
        inner = lineage.cut(spark.range(5))
        kept = keep(inner.filter("id > 1"))
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist"):
        inner.count()


def test_layout_stops(spark):
    """Whole pages are dropped once the text before them is long enough."""
    df = spark.createDataFrame([("d", p, 0, 1.0, 100.0, 110.0, 1000.0, "x" * 60) for p in range(4)], "doc string, page int, type int, x0 double, y0 double, y1 double, height double, text string")
    assert layout.page_text(df, soft_chars=100).first()["text"] == "\n".join(["x" * 60] * 2)
