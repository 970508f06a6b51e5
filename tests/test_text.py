import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "clean"),
    [("a\nhttps://x.y\nb", "a\n\nb"), ("a\n\nb", "a\nb"), ("x [1-3] y", "x [1-3] y"), ("x [1, 2] y", "x  y"), ("see DOI: 10.1/ab.c now", "see  now"), ("  a    b ", "a b"), (None, None)],
)
def test_clean_text(spark, text, clean):
    assert one(spark, text, T.clean_text) == clean


@pytest.mark.parametrize(
    ("line", "section"),
    [("Results: ", "Results:"), ("2.1 Setup", "2.1 Setup"), ("III. Setup", None), ("3 a b c d e f g h i", None), ("结论", "结论"), ("text goes on", None), ("1. 2020 budget", None), ("", None)],
)
def test_section_header(spark, line, section):
    assert one(spark, line, T.section_header) == section


@pytest.mark.parametrize(
    ("md", "plain"),
    [("# A\n\n\n\nb", "A\n\nb"), ("![alt](p.png) [t](u) **b** _i_", "alt t b i"), ("| a | b |\n|---|---|", "a   b"), ("```\ncode\n```x", "x"), ("a<br>b", "ab"), ("", ""), (None, "")],
)
def test_markdown(spark, md, plain):
    assert one(spark, md, T.markdown_to_text) == plain


def test_ids_and_small_functions(spark):
    import hashlib

    assert one(spark, " 10.1/AB.. ", lambda x: T.paper_id(T.doi_norm(x))) == hashlib.sha256(b"10.1/ab").hexdigest()[:12]
    assert one(spark, "2024-00-00", T.year) == "2024"
    assert one(spark, "no date", T.year) == "" and one(spark, None, T.year) == ""
    assert one(spark, "/x/My  Paper_12.pdf", T.title_from_filename) == "My Paper"
    assert one(spark, "/x/a.B.PDF", T.suffix) == ".pdf"
    assert one(spark, "a\n---\nb\n---\n", T.page_estimate) == 3
    assert one(spark, "done page 3 / 10", T.progress) == (3, 10)
    assert one(spark, "x ![a](d/e.png) ![b](f.png)", T.image_names) == ["e.png", "f.png"]
    assert [one(spark, str(n), lambda x: T.human_size(x.cast("long"))) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert [one(spark, str(n), lambda x: T.elapsed(x.cast("long"))) for n in (59, 61)] == ["59s", "1m 1s"]
    assert one(spark, "A Useful: Paper!", T.normalize_title) == "a useful paper" == one(spark, "a useful paper", T.normalize_title)
    assert one(spark, "Straße", T.normalize_title) == "strasse"
    assert one(spark, "中 text", T.has_chinese) and not one(spark, "text", T.has_chinese)


def test_spaced_words(spark):
    assert T.known_words("ARTICLEINFOABSTRACT") == ["ARTICLE", "INFO", "ABSTRACT"]
    assert T.known_words("XYZ") == []
    assert one(spark, "A B S T R A C T here", T.normalize_spaced).split() == ["ABSTRACT", "here"]
    assert one(spark, "plain", T.normalize_spaced) == "plain"


def test_abstract_and_summary(spark):
    body = "This is the abstract of a paper that is long enough."
    assert one(spark, f"T\nA B S T R A C T\n{body}\nKeywords: a", T.extract_abstract) == (body, True)
    assert one(spark, f"T\nAbstract\n{body} 1. Introduction\nmore", T.extract_abstract) == (body, True)
    assert one(spark, "标题\n摘要：这是一个足够长的摘要，用来检查中文的分支是否工作正常，再写一些字。关键词：甲" + "文" * 30, T.extract_abstract)[1]
    assert one(spark, "short", T.extract_abstract) == ("", False) and one(spark, None, T.extract_abstract) == ("", False)
    assert one(spark, "Energy " + "words go on " * 10, T.extract_abstract) == ("", False)
    found = one(spark, "1 some words " + "go on " * 200, T.extract_abstract)
    assert not found[1] and found[0].startswith("some words") and len(found[0]) <= 500
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(20))
    summary = one(spark, text, lambda x: T.summarize(x, F.lit("")))
    assert 200 <= len(summary) < 260 and summary.endswith(".")
    assert one(spark, "", lambda x: T.summarize(x, F.lit(""))) == ""
