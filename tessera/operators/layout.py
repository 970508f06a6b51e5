"""Reading order of page blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def page_text(blocks: DataFrame, key: str = "doc", max_pages: int = 20, band: float = 0.05, soft_chars: int = 100_000) -> DataFrame:
    """(key, text) from blocks (key, page, type, x0, y0, y1, height, text): text blocks of the
    first pages without header and footer bands, by page, row and column, up to the references;
    whole pages are dropped once the text before them is long enough. Null without any block."""
    kept = blocks.filter((F.col("page") < max_pages) & (F.col("type") == 0) & (F.col("y1") >= band * F.col("height")) & (F.col("y0") <= (1 - band) * F.col("height")))
    kept = kept.withColumn("text", T.strip(F.col("text"))).filter("text <> ''")
    by = [F.col("page"), F.bround("y0", -1), F.col("x0"), F.col("text")]
    ends = F.lower("text").rlike("^(references|bibliography|参考文献|文献)")
    order = Window.partitionBy(key).orderBy(*by)
    kept = kept.withColumn("at", F.row_number().over(order)).withColumn("over", F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("over"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("page").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("before", before).filter(F.col("before") <= soft_chars)
    joined = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return blocks.select(key).distinct().join(joined, key, "left")
