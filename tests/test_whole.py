"""Text functions: results written out by hand, and what holds of every document's result."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T

PLAIN = {
    "# Head\nbody": "Head\nbody",
    "####### seven": "####### seven",
    "#no head": "#no head",
    "![alt](a.png) and [link](http://x)": "alt and link",
    "**bold** *it* ***both***": "bold it both",
    "_i_ __b__ a_b_c": "i b abc",
    "before\n~~~\ncode a_b\n~~~\nafter": "before\n\nafter",
    "```x\n|y|\n```": "",
    "| a | b |\n|---|:-:|\nend": "a   b \n\nend",
    "up\n---\ndown": "up\n\ndown",
    "up\n***\ndown": "up\n\ndown",
    "a\n\n\n\n\nb": "a\n\nb",
    "<b>tag</b> <br": "tag <br",
    "- item": "- item",
    "": "",
}
ABSTRACTS = {
    "One  two\n three. Keywords: a, b\nc": "One two three.",
    "KEY WORDS : x": "",
    "a monkey and keyword": "a monkey and",
    "a monkey and keywordless": "a monkey and keywordless",
    "fi- xed a hyphen-\nated word": "fixed a hyphenated word",
    "range 1- and - b": "range 1and - b",
    "K E Y W O R D S a": "",
    "  plain  ": "plain",
}
LONG = "This sentence has exactly forty letters."
SUMMARIES = {
    " ".join([LONG] * 9): " ".join([LONG] * 5),
    "First one here, long enough. Second one! Third?": "First one here, long enough. Second one! Third?",
    "句子一个很长的内容在这里面，也还要更长一些。 第二句也在这里。": "句子一个很长的内容在这里面，也还要更长一些。 第二句也在这里。",
    "Elsevier 2020\nShort text": "Short text",
    "": "",
}
TITLES = {
    "Plain Title: a study!\nbody": "plain title a study",
    "Die Straße, groß": "die strasse gross",
    "ſo it was": "so it was",
    "a_b-c\td": "a_b c d",
    "你好，World": "你好 world",
    "": "",
}


@pytest.mark.parametrize(
    ("rule", "table"),
    [(T.markdown_to_text, PLAIN), (T.clean_abstract, ABSTRACTS), (lambda c: T.summarize(c, c), SUMMARIES), (lambda c: T.normalize_title(F.substring_index(c, "\n", 1)), TITLES)],
    ids=["plain", "abstract", "summary", "title"],
)
def test_by_hand(spark, rule, table):
    got = spark.createDataFrame([(k,) for k in table], "t string").select("t", rule(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == table


ODD = ["ÀÉ İstanbul, ǅ!\tx　y\nz", "a | b | c\u0085---\u0085d\n|p q|\n--- \nlast\n---\n", "***\n* * *\n\n\n\n## Two\r\n|x|\r\n---\r\nend", "Energy saved\n\n  Journal of X\nWhat? Yes.", "short. Text", "x " * 5000, "Ⅷ ² ½ ـ ", None]


@pytest.fixture(scope="module")
def results(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for t in ODD], "text string")).select(F.coalesce("text", F.lit("")).alias("t"))
    found = docs.select("t", T.markdown_to_text(F.col("t")).alias("plain"), T.clean_abstract(F.col("t")).alias("abstract"), T.summarize(F.col("t"), F.col("t")).alias("summary"), T.normalize_title(F.substring_index("t", "\n", 1)).alias("title"))
    return found.withColumn("again", T.clean_abstract(F.col("abstract"))).withColumn("title_again", T.normalize_title(F.col("title"))).collect()


def test_plain_text_has_no_marks(results):
    for r in results:
        assert "|" not in r.plain and "\n\n\n" not in r.plain and not re.search(r"<[^>]+>|^#{1,6}\s|^```", r.plain, re.M), r.t[:80]
        assert r.plain == r.plain.strip(" \t\n\r\f\v") and len(r.plain) <= len(r.t)


def test_abstracts_are_one_line_without_keywords(results):
    for r in results:
        assert not re.search(r"\s\s|\n", r.abstract) and not re.search(r"(?i)\bkeywords?\b", r.abstract) and r.again == r.abstract, r.t[:80]


def test_summaries_stop_at_the_sentence_that_fills_them(results):
    for r in results:
        sentences = re.findall(r".*?[.!?。！？](?=\s|$)|.+$", r.summary, re.S)
        assert sum(len(s.strip()) for s in sentences[:-1]) < 200
        assert all(s.strip() in r.t for s in sentences), r.t[:80]


def test_titles_are_words_in_one_case(results):
    for r in results:
        # folding the dotted capital I leaves a mark that is no word character
        assert (r.title_again == r.title or "İ" in r.t) and r.title == " ".join(r.title.split()), r.t[:80]
        assert all(c in " _" or unicodedata.category(c)[0] in "LNM" for c in r.title)
