"""Paragraph and word chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def windows(words: Column, size: int) -> Column:
    """Consecutive runs of size words, joined by a space."""
    starts = F.sequence(F.lit(1), F.size(words), F.lit(size))
    return F.when(F.size(words) > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def chunk_array(text: Column, max_words: int = 100) -> Column:
    """array<struct<section, text>> of a text. Sections carry forward over paragraphs: a
    paragraph's is that of the last one at or before it with a header. What is used twice is
    bound by a one-element transform, so it is computed once."""
    split = lambda clean: F.filter(F.transform(F.split(clean, rf"\n{T.WS}*\n"), T.strip), lambda p: p != "")
    header = lambda p, i: F.struct(i.alias("i"), T.section_header(T.strip(F.substring_index(p, "\n", 1))).alias("section"))
    bind = lambda x, f: F.transform(F.array(x), f)[0]

    def chunks(b: Column) -> Column:
        section = lambda i: F.coalesce(F.try_element_at(F.filter(b["headers"], lambda h: h["i"] <= i), F.lit(-1))["section"], F.lit("Abstract"))
        own = lambda p, i: bind(F.struct(section(i).alias("section"), T.words(p).alias("words")), lambda c: F.transform(windows(c["words"], max_words), lambda t: F.struct(c["section"].alias("section"), t.alias("text"))))
        return F.flatten(F.transform(b["paragraphs"], own))

    marked = lambda ps: F.struct(ps.alias("paragraphs"), F.filter(F.transform(ps, header), lambda h: h["section"].isNotNull()).alias("headers"))
    none = F.array().cast("array<struct<section:string,text:string>>")
    found = lambda clean: F.when(F.length(clean) >= 20, bind(bind(split(clean), marked), chunks)).otherwise(none)
    return bind(T.clean_text(F.coalesce(text, F.lit(""))), found)


def chunk_documents(docs: DataFrame, key: str, text: str = "text", max_words: int = 100) -> DataFrame:
    """(key, chunk_index, total_chunks, section, text)."""
    numbered = lambda all_: F.transform(all_, lambda c, i: F.struct(i.alias("chunk_index"), F.size(all_).alias("total_chunks"), c["section"].alias("section"), c["text"].alias("text")))
    chunks = F.transform(F.array(chunk_array(F.col(text), max_words)), numbered)[0]
    return docs.select(key, F.explode(chunks).alias("chunk")).select(key, "chunk.*")


def text_prefix(chunks: DataFrame, key: str, order: str, text: str = "text", max_chars: int = 8000) -> DataFrame:
    """The leading chunks of each document whose lengths sum to at most max_chars."""
    from pyspark.sql import Window

    running = F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("chars_so_far", running).filter(F.col("chars_so_far") <= max_chars)


def concat_chunks(chunks: DataFrame, key: str, order: str, text: str = "text", glue: str = " ") -> DataFrame:
    """(key, n_chunks, full_text) in order of the chunk index."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.array_join(F.transform(parts, lambda x: x["t"]), glue).alias("full_text"))


def numbered_dump(chunks: DataFrame, key: str, order: str, section: str, text: str = "text", most: int = 100_000) -> DataFrame:
    """(key, dump): '[i] (section) text' paragraphs, at most so many characters."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(section).alias("s"), F.col(text).alias("t"))))
    lines = F.transform(parts, lambda x: F.concat(F.lit("["), x["o"], F.lit("] ("), x["s"], F.lit(") "), x["t"]))
    return chunks.groupBy(key).agg(F.substring(F.array_join(lines, "\n\n"), 1, most).alias("dump"))
