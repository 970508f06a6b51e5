"""Document conversion: output names, distributed conversion with an injected converter, images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.lineage import cut

# Parameter domains.
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".jp2", ".webp", ".gif", ".bmp", ".tiff", ".docx")
BACKENDS = ("pipeline", "hybrid-auto-engine")
LANGUAGES = (
    "ch", "ch_server", "ch_lite", "en", "korean", "japan", "chinese_cht", "ta", "te", "ka", "th", "el", "latin", "arabic", "east_slavic", "cyrillic", "devanagari",
)
METHODS = ("auto", "txt", "ocr")
MAX_PAGES = 1000
RESULT = "path string, output_name string, success boolean, markdown string, log_lines array<string>, error string, backend string, language string, method string"


def output_names(files: DataFrame, order: str = "path", stem: Column | None = None) -> DataFrame:
    """files plus output_name: the stem of the path, or the first of stem-2, stem-3, ... that no
    file before it in the order has, ignoring case.

    Each file starts at its number among those of its stem. Where files still meet under one
    name, the first of them keeps it and the others move on by one, in rounds; earlier files come
    first in every round, so the end is that of naming them one by one."""
    stem = T.stem(F.col(order)) if stem is None else stem
    folded = lambda c: T.casefold(F.col(c))
    named = files.select(F.col(order).alias("_order"), stem.alias("_stem")).withColumn("_low", folded("_stem"))
    state = cut(named.withColumn("_n", F.row_number().over(Window.partitionBy("_low").orderBy("_order"))))
    while True:
        tried = state.withColumn("_name", F.when(F.col("_n") == 1, F.col("_stem")).otherwise(F.concat_ws("-", "_stem", "_n"))).withColumn("_fold", folded("_name"))
        first = tried.groupBy("_fold").agg(F.min("_order").alias("_first"))
        met = cut(tried.join(first, "_fold").withColumn("_moves", F.col("_first") < F.col("_order")))
        if not met.filter("_moves").limit(1).count():
            break
        state = cut(met.select("_order", "_stem", "_low", (F.col("_n") + F.col("_moves").cast("int")).alias("_n")))
    return files.join(met.select(F.col("_order").alias(order), F.col("_name").alias("output_name")), order)


def supported(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    return files.filter(T.suffix(F.col("path")).isin(*suffixes)).orderBy("path")


def convert(files: DataFrame, converter: Callable[[str, bytes, dict], str], backend: str = BACKENDS[1], language: str = LANGUAGES[0], method: str = METHODS[0], max_pages: int = 0) -> DataFrame:
    """RESULT rows for files(path, content), with output_name if it is there (else names are
    made). The converter gets path, content and the options as a dict; max_pages 0 means all. One
    that fails gives a row with its error."""
    if isinstance(max_pages, bool) or not isinstance(max_pages, int) or not 0 <= max_pages <= MAX_PAGES:
        raise ValueError(f"max_pages must be from 0 to {MAX_PAGES}")
    for value, known in ((backend, BACKENDS), (language, LANGUAGES), (method, METHODS)):
        if value not in known:
            raise ValueError(f"{value} is none of {', '.join(known)}")
    options = {"backend": backend, "language": language, "method": method, "max_pages": max_pages}
    if "output_name" not in files.columns:
        files = output_names(files)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, name, content in zip(part["path"], part["output_name"], part["content"], strict=True):
                try:
                    rows.append((path, name, True, converter(path, content, dict(options)), [f"converted {path}"], ""))
                except Exception as e:  # a file's failure is a result, not the job's
                    rows.append((path, name, False, "", [f"failed {path}"], str(e)))
            found = pd.DataFrame(rows, columns=["path", "output_name", "success", "markdown", "log_lines", "error"])
            yield found.assign(backend=backend, language=language, method=method)

    return files.select("path", "output_name", "content").mapInPandas(run, RESULT)


def counted(results: DataFrame) -> DataFrame:
    """One row (total, succeeded, failed) of RESULT rows."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def write_markdown(results: DataFrame, folder: str) -> None:
    """One Markdown file for each success, in a folder of its output name; it ends with a line
    break."""
    done = results.filter("success").select("output_name", F.col("markdown").alias("value"))
    done.repartition("output_name").write.mode("overwrite").partitionBy("output_name").text(folder)


def orphan_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """images(name) that no Markdown text of pages(markdown) shows."""
    shown = pages.select(F.explode(T.image_names(F.col("markdown"))).alias("name")).distinct()
    return images.join(shown, "name", "left_anti")


def describe_images(markdown: Column, described: Column) -> Column:
    """Put a quoted description after each image reference; described maps an image's path to
    its text (a map column)."""
    refs = F.regexp_extract_all(markdown, F.lit(r"(!\[[^\]]*\]\([^)]+\))"), 1)
    rest = F.split(markdown, r"!\[[^\]]*\]\([^)]+\)")
    ref = lambda i: F.coalesce(F.get(refs, i), F.lit(""))
    said = lambda i: F.try_element_at(described, F.regexp_extract(ref(i), r"\(([^)]+)\)$", 1))
    parts = F.transform(rest, lambda x, i: F.concat(x, ref(i), F.coalesce(F.concat(F.lit("\n> VLM description: "), said(i), F.lit("\n")), F.lit(""))))
    return F.array_join(parts, "")
