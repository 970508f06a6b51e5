"""Steps whose memory or traffic must not grow faster than the input: the index where lists are
long (lists in several rows, places sent to the papers, scans), attributes, spaced words."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import catalog, lexical, semantic, textindex, vector

QUERIES = ("abc NOT fed", "NEAR(abc def, 20) OR ^fed", "c_e")


def _papers(spark, n=300):
    draw = random.Random(7)
    words = ["abcdef", "defabc", "fedcba", "aabbcc", "ccddee", "\U0001d4b6é\U0001d4b6", "ééé"]
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.randrange(1, 12)))
    rows = [(f"p{i:04}", text()[:12], None if i % 50 == 0 else text(), "s") for i in range(n)]
    return spark.createDataFrame(rows, "paper_id string, title string, abstract string, summary string")


def _shown(df):
    return [r.asDict() for r in df.orderBy("position").collect()]


def test_long_lists(spark, tmp_path, monkeypatch):
    """With lists of several rows a trigram, by number, by broadcast places and by scan alike."""
    df = _papers(spark)
    monkeypatch.setattr(textindex, "BLOCK_ROWS", 40)
    want = {q: _shown(lexical.search(df, q, 7)) for q in QUERIES}
    ranks = {q: sorted(map(tuple, lexical.bm25(df, q).selectExpr("paper_id", "round(rank, 9)").collect())) for q in QUERIES}
    state = textindex.write_index(df, str(tmp_path / "i"))
    for most, wide, share, one in ((200_000, 0, 4, 5), (-1, 10_000, 0, 5), (-1, 0, 4, 5)):
        for name, value in (("MOST_IDS", most), ("WIDE_IDS", wide), ("SCAN_SHARE", share), ("ONE_TASK", one)):
            monkeypatch.setattr(textindex, name, value)
        index = textindex.Index(spark, str(tmp_path / "i"), state)
        for q in QUERIES:
            assert _shown(lexical.search(index.papers, q, 7, index)) == want[q], (q, most, wide)
            rows, small = index.rows((lexical.parse(q) or ([],))[0])
            assert sorted(map(tuple, lexical.bm25(rows, q, index.totals, small).selectExpr("paper_id", "round(rank, 9)").collect())) == ranks[q], (q, most, wide)


def test_lists_of_parts():
    """A block that is held in parts gives each paper once under each of its trigrams."""
    import pyarrow as pa

    texts = ["abcabc", "", "xabc", "\U0001d4b6bc\U0001d4b6", "ab"]
    batch = pa.RecordBatch.from_pydict({"block": pa.array([3] * 5, pa.int32()), "pos": pa.array(range(1, 6), pa.int32()), "t": texts, "u": [""] * 5})
    want = {(t[i : i + 3], p) for p, t in enumerate(texts, 1) for i in range(len(t) - 2)}
    most, textindex.MOST_CHARS = textindex.MOST_CHARS, 3
    try:
        rows = [r for b in textindex._post([batch]) for r in b.to_pylist()]
    finally:
        textindex.MOST_CHARS = most
    got = [(r["gram"], p) for r in rows for p in r["places"]]
    assert set(got) == want and len(got) == len(want) and {r["block"] for r in rows} == {3}


def test_no_text_is_shuffled(spark, tmp_path, monkeypatch):
    """Where the lists are long, papers with their texts pass no exchange."""
    state = textindex.write_index(_papers(spark), str(tmp_path / "i"))
    monkeypatch.setattr(textindex, "MOST_IDS", -1)
    index = textindex.Index(spark, str(tmp_path / "i"), state)
    for share in (0, 4):
        monkeypatch.setattr(textindex, "SCAN_SHARE", share)
        rows, _ = index.rows(lexical.parse("abc")[0])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "abstract" in plan


def test_texts_are_lowered_once(spark):
    """However many phrases are counted, and with a filter on their counts above."""
    df = _papers(spark)
    for q in ("abc AND def OR fed NOT ccd", "NEAR(abc def, 20)", "^abc OR fed"):
        rows = lexical.bm25(df.withColumn("d", F.length("abstract")), q, (300, 40.0), True)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") == 3, plan


def test_pivot_in_parts(spark, monkeypatch):
    """Attributes are not broadcast, and many are sorted in several parts."""
    monkeypatch.setattr(catalog, "PART_ROWS", 20)
    data = spark.range(60).selectExpr("id % 20 AS itemID", "element_at(array(1, 6, 99), cast(id % 3 + 1 as int)) AS fieldID", "id AS valueID")
    values = spark.range(60).selectExpr("id AS valueID", "concat('v', id) AS value").filter("valueID != 3")
    got = catalog.pivot_attributes(data, values)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString() and got.rdd.getNumPartitions() == 3
    want = {}
    for v in range(60):
        if v % 3 < 2 and v != 3:
            want.setdefault(v % 20, {}).setdefault(("title", "date")[v % 3], f"v{v}")
    assert {r.itemID: {k: v for k, v in r.asDict().items() if v and k != "itemID"} for r in got.collect()} == want


def test_spaced_words_without_python(spark):
    """Joined spaced words equal the plain rule on odd texts, a run of any length included, and no
    Python worker is needed."""
    def plain(text):
        def join(m):
            found = T.known_words("".join(m[0].split()))
            return f" {' '.join(found)} " if found else m[0]
        return re.sub(r"(?:[A-Z](?:\s+|$)){2,}", join, text)

    draw = random.Random(11)
    pieces = ["A B S T R A C T", "K E Y W O R D S", "I N F O", "X Y", "Ab", "A", " ", "\n", "\u00a0", "\x1c", "x", "é", "R E V I E W A B C", "$1", "\\", "W O R K\n"]
    texts = ["".join(draw.choice(pieces) + draw.choice(["", " ", "  "]) for _ in range(draw.randrange(8))) for _ in range(300)]
    texts += ["A " * 20_000, "A B S T R A C T" + " W O R K" * 3000, "", "A\n", "A B", "A B\n"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize_spaced(F.col("t")).alias("x"), T.extract_abstract(F.col("t")).alias("a"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.x for r in out.collect()}
    assert [t for i, t in enumerate(texts) if got[i] != plain(t)] == []


def test_trigram_encoder():
    """All texts at once give the counts of one trigram after the other."""
    draw = random.Random(5)
    alphabet = "abcXYZ 0é\u00dfİ能\uffff\U0001d4b6\U0010ffff\x7f\x80\u07ff\u0800\u3042\n"
    texts = ["", "ab", "abc", "É", *("".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(200)), ""]
    for width in (64, 384):
        want = np.zeros((len(texts), width))
        for row, t in zip(want, texts, strict=True):
            t = t.lower()
            for i in range(len(t) - 2):
                row[zlib.crc32(t[i : i + 3].encode()) % width] += 1
        assert (vector.trigram_encoder(width)(texts) == want).all() and vector.trigram_encoder(width)([]).shape == (0, width)


def test_entries():
    """Counting what stands between white space gives the counts of the words."""
    draw = random.Random(6)
    pieces = ["word", "Wörd", "don't", "a_b", "--", "…", " ", " ", "\n", "\x1c", "\u00a0", "能源", "x" * 40, "Σας", "1,2", "word."]
    texts = [None, "", " ", *("".join(draw.choice(pieces) for _ in range(draw.randrange(40))) for _ in range(300))]
    for t in texts:
        want: dict[int, int] = {}
        for w in re.findall(r"\w+", (t or "").lower()):
            b = zlib.crc32(w.encode()) % semantic.BUCKETS
            want[b] = want.get(b, 0) + 1
        found, counts = semantic._entries(t)
        assert found.tolist() == sorted(want) and counts.tolist() == [want[b] for b in sorted(want)], t
    # the regular expression sees a token once, then it is remembered
    semantic._buckets.clear()
    semantic._entries("again, again, again,")
    assert semantic._buckets == {"again,": zlib.crc32(b"again") % semantic.BUCKETS}
