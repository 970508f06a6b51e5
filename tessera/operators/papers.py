"""Second-level index: papers built from chunks, build statistics and the collection info."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

METADATA = ("title", "filename", "source", "doi", "authors", "journal", "collections", "zotero_key")


def papers_of(chunks: DataFrame) -> DataFrame:
    """One row per paper: metadata of its first chunk, abstract and summary of its whole text."""
    for n, usual in {**dict.fromkeys(METADATA, ""), "source": "papers"}.items():
        chunks = chunks.withColumn(n, F.coalesce(n, F.lit(usual)) if n in chunks.columns else F.lit(usual))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    grouped = chunks.groupBy("paper_id").agg(F.min_by(F.struct(*METADATA), "chunk_index").alias("m"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("full_text"))
    found = grouped.withColumn("a", T.extract_abstract(F.col("full_text")))
    abstract = F.col("a.abstract")
    return found.select("paper_id", *(F.col(f"m.{n}").alias(n) for n in METADATA), abstract.alias("abstract"), T.summarize(abstract, F.col("full_text")).alias("summary"), F.length(abstract).alias("abstract_len"), F.col("a.found").cast("int").alias("has_abstract"))


def build_stats(papers: DataFrame) -> DataFrame:
    """One row: counts of papers with a marked, a fallback and no abstract, and their share."""
    total = F.count(F.lit(1))
    marked, empty = F.count_if(F.col("has_abstract") == 1), F.count_if(F.col("abstract_len") == 0)
    return papers.agg(total.alias("total"), marked.alias("with_abstract"), (total - marked - empty).alias("fallback"), empty.alias("empty"), (100.0 * marked / F.greatest(total, F.lit(1))).alias("percent"))


def keywords(titles: DataFrame, most: int = 10, title: str = "title", place: str = "place") -> DataFrame:
    """(keyword, n): the most frequent words of the titles; ties by first appearance, where the
    English words of a title come before its CJK runs."""
    return _ranked(titles, most, title, place).orderBy(F.desc("n"), "first").select("keyword", "n")


def _ranked(titles: DataFrame, most: int, title: str, place: str) -> DataFrame:
    english = F.filter(F.regexp_extract_all(title, F.lit("([a-zA-Z]+)"), 1), lambda w: F.length(w) > 2)
    cjk = F.regexp_extract_all(title, F.lit(f"([{T.CJK}]{{2,}})"), 1)
    found = titles.select(F.col(place), F.posexplode(F.concat(F.transform(english, F.lower), cjk)).alias("at", "keyword"))
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(place, "at")).alias("first")).orderBy(F.desc("n"), "first").limit(most)


def paper_keys(chunks: DataFrame) -> DataFrame:
    """chunks plus paper_key: the first of paper_id, zotero_key and filename that is not empty;
    a row without any is a paper of its own, under a number that no other row has."""
    names = [n for n in ("paper_id", "zotero_key", "filename") if n in chunks.columns]
    return chunks.withColumn("paper_key", F.coalesce(*(F.nullif(n, F.lit("")) for n in names), F.concat(F.lit("unknown-"), F.monotonically_increasing_id())))


def paper_titles(chunks: DataFrame, place: str = "place") -> DataFrame:
    """(paper_key, title, place): the first title by place of each paper."""
    return paper_keys(chunks).groupBy("paper_key").agg(F.coalesce(F.min_by("title", place), F.lit("")).alias("title"), F.min(place).alias(place))


def collection_info(titles: DataFrame, chunk_count: int, name: str = "My Paper Collection", title: str = "title", place: str = "place") -> DataFrame:
    """One row (name, description, paper_count, chunk_count, keywords, language)."""
    listed = _ranked(titles, 10, title, place).withColumn("at", F.row_number().over(Window.orderBy(F.desc("n"), "first")))
    words = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    totals = titles.agg(F.count(F.lit(1)).alias("paper_count"), F.coalesce(F.bool_or(F.col(title).rlike(f"[{T.CJK}]")), F.lit(False)).alias("zh"))
    joined = totals.join(words)
    topics = F.when(F.size("keywords") > 0, F.concat(F.lit(" covering topics related to "), F.array_join(F.slice("keywords", 1, 5), ", "), F.lit("."))).otherwise(".")
    said = F.concat(F.lit("A collection of "), F.col("paper_count"), F.lit(" academic papers"), topics)
    return joined.select(F.lit(name).alias("name"), said.alias("description"), "paper_count", F.lit(chunk_count).cast("long").alias("chunk_count"), "keywords", F.when(F.col("zh"), "zh").otherwise("en").alias("language"))


def write_info(info: DataFrame, path: str) -> None:
    info.coalesce(1).write.mode("overwrite").json(path)


def read_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def as_json(df: DataFrame) -> DataFrame:
    """(value), one JSON object for each row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def grouped_hits(hits: DataFrame, paper: str = "paper_id", order: str = "position") -> DataFrame:
    """hits(paper, order, section, text) plus is_first, true for the first hit of each paper, with
    sections of at most 30 and previews of at most 400 characters."""
    first = F.row_number().over(Window.partitionBy(paper).orderBy(order)) == 1
    preview = F.when(F.length("text") > 400, F.concat(F.substring("text", 1, 400), F.lit("..."))).otherwise(F.col("text"))
    return hits.withColumns({"is_first": first, "section": F.substring(F.coalesce("section", F.lit("")), 1, 30), "preview": F.coalesce(preview, F.lit(""))})
