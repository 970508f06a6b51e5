"""Folders of documents and Markdown, by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

MAX_PDF_BYTES = 25 << 20


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".pdf",), recursive: bool = False, most_bytes: int = MAX_PDF_BYTES) -> DataFrame:
    """(path, paper_id, title, length) by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    kept = files.filter(T.suffix(F.col("path")).isin(*suffixes) & (F.col("length") <= most_bytes))
    return kept.select("path", T.paper_id(F.col("path")).alias("paper_id"), T.title_from_filename(F.col("path")).alias("title"), "length").orderBy("path")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, pages) of the Markdown files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    md = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", T.markdown_to_text(md).alias("text"), T.page_estimate(md).alias("pages"))


def find_output(files: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, path): the first file by name whose stem is wanted."""
    return files.withColumn("stem", T.stem(F.col("path"))).join(stems.select("stem").distinct(), "stem").groupBy("stem").agg(F.min("path").alias("path"))
