"""Text functions as Column expressions. White space and word classes follow Python's str rules
(Java's \\s and \\w are ASCII), so they are spelled out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.isspace() accepts, and what \w accepts.
WS = r"[ \t\n\x0b\f\r\x1c-\x1f\x85   -     　]"
NOT_WS = r"[^ \t\n\x0b\f\r\x1c-\x1f\x85   -     　]"
WORD = r"[\p{L}\p{N}_]"
#: A word boundary by those classes.
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
CJK = r"一-鿿"


def _all(text: Column, *rewrites: tuple[str, str]) -> Column:
    for pattern, by in rewrites:
        text = F.regexp_replace(text, pattern, by)
    return text


#: The characters of WS.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


def words(text: Column) -> Column:
    """str.split()."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


#: Collapse line breaks, then spaces, then drop citations, urls and dois. A doi: stands at the
#: start of a word, which is looked at only where a d is.
CLEANING = ((r"\n+", "\n"), (" {2,}", " "), (rf"\[\p{{Nd}}+(?:,{WS}*\p{{Nd}}+)*\]", ""), (f"https?://{NOT_WS}+", ""), (rf"(?iu)d(?<!{WORD}d)oi:{WS}*10\.{NOT_WS}+", ""))


def clean_text(text: Column) -> Column:
    """The later steps can leave empty lines, which is what makes paragraphs."""
    return strip(_all(text, *CLEANING))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<={WORD})-\n(?={WORD})", "")


def block_text(lines: Column) -> Column:
    """Text of a layout block: all spans of all lines, joined."""
    return dehyphenate(F.array_join(F.flatten(F.transform(lines, lambda x: F.transform(x["spans"], lambda s: s["text"]))), ""))


# Section names.
SECTION_NAMES = (
    "abstract", "introduction", "background", "related work", "method", "methodology", "experiment", "experimental", "results", "result",
    "discussion", "conclusion", "conclusions", "nomenclature", "acknowledgment", "acknowledgements", "references", "bibliography",
    "摘要", "引言", "方法", "实验", "结果", "讨论", "结论", "参考文献", "附录",
)


def section_header(line: Column) -> Column:
    """The section that a line announces, at most 60 characters, else null. The line is
    lower-cased first, so only digits number a header."""
    low = F.regexp_replace(strip(F.lower(line)), "[.: ]+$", "")
    title = F.regexp_replace(strip(F.regexp_extract(low, rf"^\p{{Nd}}+(?:\.\p{{Nd}}+)*(?:\.|{WS})+([^\n]+)\n?\z", 1)), "[.: ]+$", "")
    numbered = title.rlike(f"^[a-z{CJK}]") & (F.size(words(title)) <= 8)
    return F.when(low.isin(*SECTION_NAMES) | numbered, F.substring(strip(line), 1, 60))


def paper_id(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 12)


def doi_norm(doi: Column) -> Column:
    return F.regexp_replace(F.lower(strip(doi)), r"\.+$", "")


def item_paper_id(doi: Column, key: Column, item_id: Column) -> Column:
    """By DOI if there is one, else by the source item."""
    has = F.coalesce(F.trim(doi), F.lit("")) != ""
    return paper_id(F.when(has, doi_norm(doi)).otherwise(F.concat_ws(":", F.lit("zotero"), key, item_id)))


def year(date: Column) -> Column:
    return F.coalesce(F.regexp_extract(date, r"(\p{Nd}{4})", 1), F.lit(""))


# The marks that are taken out of Markdown, and the patterns of abstracts below.
def markdown_to_text(md: Column) -> Column:
    m = "(?md)"  # only \n ends a line
    text = _all(
        md, (r"```[\s\S]*?```", ""), (r"~~~[\s\S]*?~~~", ""), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (rf"{m}^#{{1,6}}{WS}+", ""),
        (r"\*{1,3}([^*]+)\*{1,3}", "$1"), ("_{1,3}([^_]+)_{1,3}", "$1"), (rf"{m}^\|(.+)\|$", "$1"), (rf"{m}^[-:| ]+$", ""), (r"\|", " "), (rf"{m}^[-*_]{{3,}}{WS}*$", ""), ("<[^>]+>", ""), (r"\n{3,}", "\n\n"),
    )
    return strip(F.coalesce(text, F.lit("")))


def page_estimate(md: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(md, F.lit(rf"(?md)^---{WS}*$")) + 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?<=.)(\.[^.]+)$", 1))


def title_from_filename(path: Column) -> Column:
    return strip(squeeze(_all(stem(path), (r"\(科研通-ablesci\.com\).*", ""), (r"_\p{Nd}+$", ""))))


# How a boiler-plate line of a journal page starts.
BOILER_STARTS = r"journal of|international|applied|energy|thermal|heat and mass|electrochimica|renewable|sustainable|©|copyright|published by|elsevier|springer|mdpi|http|doi:|vol\.|pp\.|issn|isbn"


def strip_journal_header(text: Column) -> Column:
    """Drop blank and boiler-plate lines."""
    boiler = f"(?iu)^{WS}*(?:{BOILER_STARTS})"
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: (strip(x) != "") & ~x.rlike(boiler)), "\n")


def clean_abstract(text: Column) -> Column:
    return strip(_all(text, (rf"(?isu){EDGE}(?:Keywords?|K E Y W O R D S?|Key words?){EDGE}(?::|{WS})*.*\z", ""), (f"{WS}+", " "), (rf"({WORD})-{WS}({WORD})", "$1$2")))


# Words that journals print with spaces between their letters.
SPACED_WORDS = frozenset({
    "ABSTRACT", "INTRODUCTION", "KEYWORDS", "ARTICLE", "INFO", "RESEARCH", "PAPER", "REVIEW", "METHODOLOGY", "METHODS", "RESULTS", "DISCUSSION", "CONCLUSION", "CONCLUSIONS",
    "NOMENCLATURE", "REFERENCES", "BIBLIOGRAPHY", "ACKNOWLEDGMENT", "ACKNOWLEDGEMENTS", "APPENDIX", "HIGHLIGHTS", "GRAPHICAL", "SUPPLEMENTARY", "MATERIALS", "EXPERIMENTAL", "EXPERIMENT", "BACKGROUND", "RELATED", "WORK",
})


#: The words read backwards, longest first, so that a scan of reversed letters takes from the right.
_REVERSED = "|".join(sorted((w[::-1] for w in SPACED_WORDS if 4 <= len(w) <= 12), key=lambda w: (-len(w), w)))
_BACKWARDS = re.compile(_REVERSED)
#: Two or more capitals with white space behind each; possessive, so that a long run needs no stack.
_RUN = rf"(?:[A-Z](?:{WS}++|\z)){{2,}}+"


def known_words(letters: str) -> list[str]:
    """Words of 4 to 12 letters, the longest first, taken from the right; other letters are
    passed over."""
    return [w[::-1] for w in _BACKWARDS.findall(letters[::-1])][::-1]


def _join_spaced(run: Column) -> Column:
    """known_words() of the letters of a run, or the run where there are none."""
    found = F.regexp_extract_all(F.reverse(F.regexp_replace(run, f"{WS}+", "")), F.lit(_REVERSED), 0)
    joined = F.reverse(F.array_join(found, " "))
    return F.when(joined != "", F.concat(F.lit(" "), joined, F.lit(" "))).otherwise(run)


def normalize_spaced(text: Column) -> Column:
    """Join words whose capitals stand apart: what stands between the runs, and the runs joined,
    by turns."""
    joined = F.transform(F.regexp_extract_all(text, F.lit(_RUN), 0), _join_spaced)
    parts = F.zip_with(F.split(text, _RUN, -1), joined, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(rf"[A-Z](?:{WS}+[A-Z](?:{WS}|\z))"), F.array_join(parts, "")).otherwise(text)


def extract_abstract(text: Column) -> Column:
    """struct<abstract, found>: the first branch whose result is long enough, else the first
    words of the text."""
    text = F.coalesce(text, F.lit(""))
    head = F.substring(text, 1, 15000)
    # a one-element transform computes it once
    return F.transform(F.array(squeeze(normalize_spaced(head))), lambda line: _abstract_of(text, head, line))[0]


def _abstract_of(text: Column, head: Column, line: Column) -> Column:
    start = rf"{EDGE}ABSTRACT{EDGE}{WS}*(?:\(.*?\))?{WS}*(.+?)"
    part = lambda source, pattern: clean_abstract(strip(F.regexp_extract(source, pattern, 1)))
    branches = [
        (part(line, rf"(?isu){start}{WS}*KEYWORDS?{EDGE}"), 40),
        (part(line, rf"(?isu){start}(?:{EDGE}INTRODUCTION{EDGE}|\p{{Nd}}+\.?{WS}*(?:Introduction|INTR))"), 40),
        (part(head, rf"(?s)摘{WS}*要{WS}*[:：]?{WS}*(.+?)(?:关键词|关键字|第[一二三\p{{Nd}}]章|引言|绪论|一、)"), 20),
        (part(head, rf"(?isu){f'{WS}*'.join('ABSTRACT')}{WS}*(?:\(.*?\))?{WS}*(.+?){WS}*(?:{f'{WS}*'.join('KEYWORD')}{WS}*S?|Keywords?)"), 40),
    ]
    # a one-element filter computes each branch once
    long_enough = lambda x, least: F.get(F.filter(F.array(x), lambda v: F.length(v) >= least), F.lit(0))
    found = F.coalesce(*(long_enough(x, least) for x, least in branches))
    rest = words(strip_journal_header(line))
    first = F.array_position(F.transform(rest, lambda w: (F.length(w) > 1) & w.rlike(f"^[A-Za-z{CJK}]")), True)
    usual = strip(F.substring(F.array_join(F.slice(rest, F.greatest(first, F.lit(1)).cast("int"), F.lit(100)), " "), 1, 500))
    short = F.length(strip(text)) < 50
    return F.when(short, F.struct(F.lit("").alias("abstract"), F.lit(False).alias("found"))).otherwise(F.struct(F.coalesce(found, usual).alias("abstract"), found.isNotNull().alias("found")))


def summarize(abstract: Column, text: Column) -> Column:
    """The first sentences up to and with the one that reaches 200 characters."""
    own = strip(F.coalesce(abstract, F.lit("")))
    source = F.when(F.length(own) >= 30, own).otherwise(strip_journal_header(F.substring(F.coalesce(text, F.lit("")), 1, 5000)))
    parts = F.filter(F.transform(F.split(source, rf"(?<=[.!?。！？]){WS}+"), strip), lambda s: s != "")
    none = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("size"))
    fold = F.aggregate(parts, none, lambda a, s: F.when(a["size"] >= 200, a).otherwise(F.struct(F.concat(a["taken"], F.array(s)).alias("taken"), (a["size"] + F.length(s)).alias("size"))))
    return strip(F.array_join(fold["taken"], " "))


def has_chinese(text: Column) -> Column:
    return text.rlike(r"[一-鿿㐀-䶿]")


def _casefold(text: pd.Series) -> pd.Series:
    return text.str.casefold()


def casefold(text: Column) -> Column:
    """Folding differs from lowering for few characters, so ASCII texts stay in the JVM."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, F.lower(text)).otherwise(F.pandas_udf(_casefold, "string")(F.when(~plain, text)))


def normalize_title(title: Column) -> Column:
    """Punctuation to spaces, case folded, white space squeezed."""
    spaced = F.regexp_replace(F.coalesce(title, F.lit("")), rf"[^\p{{L}}\p{{N}}_ \t\n\x0b\f\r\x1c-\x1f\x85   -     　]", " ")
    return strip(squeeze(casefold(spaced)))


def human_size(size: Column) -> Column:
    kb, mb = size / 1024.0, size / 1048576.0
    return F.when(size < 1024, F.concat(size, F.lit(" B"))).when(size < 1048576, F.concat(F.format_string("%.1f", F.bround(kb, 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(mb, 1)), F.lit(" MB")))


def elapsed(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.when(s < 60, F.concat(s, F.lit("s"))).otherwise(F.concat(F.floor(s / 60), F.lit("m "), s % 60, F.lit("s")))


def progress(message: Column) -> Column:
    """struct<page, pages> of a log line such as 'page 3 / 10'."""
    at = lambda k: F.regexp_extract(message, r"(?i)page\s*(\d+)\s*/\s*(\d+)", k).try_cast("int")
    return F.struct(at(1).alias("page"), at(2).alias("pages"))


def image_names(md: Column) -> Column:
    """Base names of the images that a Markdown text shows."""
    return F.transform(F.regexp_extract_all(md, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1), lambda p: F.substring_index(p, "/", -1))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def with_note(chunk_index: Column, note: Column, text: Column) -> Column:
    """The source's abstract before the first chunk, if both have text."""
    return F.when((chunk_index == 0) & (F.coalesce(note, F.lit("")) != "") & (text != ""), F.concat_ws("\n\n", note, text)).otherwise(text)
