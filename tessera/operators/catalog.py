"""Source catalog: incremental scan, attribute pivot, attachments, collections and authors, each
as one join over all items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut

# Item types, attribute ids, attachment types in order of preference.
ITEM_TYPES = ("journalArticle", "conferencePaper", "preprint", "thesis", "computerProgram")
FIELDS = {1: "title", 2: "abstract_note", 59: "doi", 38: "journal", 6: "date", 13: "url"}
ATTACHMENT_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
AUTHOR_TYPE = 1
#: Attributes of a part, about, that one task sorts by item.
PART_ROWS = 200_000


def not_deleted(items: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """items without those in deleted; a null key in deleted takes part in nothing."""
    return items.join(deleted.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def changed(items: DataFrame, since_id: int, since_version: int, pending: DataFrame | None = None, key: str = "itemID", version: str = "version") -> DataFrame:
    """Items above either watermark, or with a key in pending(key)."""
    new = F.coalesce((F.col(key) > since_id) | (F.col(version) > since_version), F.lit(False))
    if pending is None:
        return items.filter(new)
    waiting = pending.select(F.col(key).alias("_key")).distinct().withColumn("_waits", F.lit(True))
    return items.join(waiting, F.col(key) == F.col("_key"), "left").filter(new | F.col("_waits").isNotNull()).drop("_key", "_waits")


def pivot_attributes(data: DataFrame, values: DataFrame, fields: dict[int, str] = FIELDS, key: str = "itemID") -> DataFrame:
    """(key, one column per field) from (key, fieldID, valueID) and (valueID, value): one join
    and one aggregation. Of several values the one with the least valueID counts. Attributes are
    as many as values, so neither is broadcast; the parts follow the number of attributes, so what
    a task sorts does not grow with them."""
    data = data.filter(F.col("fieldID").isin(*fields))
    joined = data.join(values.hint("merge"), "valueID").repartition(1 + data.count() // PART_ROWS, key)
    return joined.groupBy(key).agg(*(F.coalesce(F.min_by("value", F.when(F.col("fieldID") == i, F.col("valueID"))), F.lit("")).alias(n) for i, n in fields.items()))


def scan_items(tables: dict[str, DataFrame], since_id: int = 0, since_version: int = 0, pending: DataFrame | None = None) -> DataFrame:
    """(itemID, key, type, version, the fields of FIELDS), by itemID."""
    types = F.broadcast(tables["itemTypes"].filter(F.col("typeName").isin(*ITEM_TYPES)))
    items = changed(tables["items"], since_id, since_version, pending).join(types, "itemTypeID")
    items = not_deleted(items, tables["deletedItems"], "itemID")
    wide = items.join(pivot_attributes(tables["itemData"], tables["itemDataValues"]), "itemID", "left")
    return wide.select("itemID", "key", F.col("typeName").alias("type"), "version", *(F.coalesce(n, F.lit("")).alias(n) for n in FIELDS.values())).orderBy("itemID")


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def attachments(tables: dict[str, DataFrame]) -> DataFrame:
    """(itemID, attachment_key, contentType), the preferred stored attachment of each item."""
    rows = tables["itemAttachments"].filter((F.col("linkMode") == 0) & F.col("contentType").isin(*ATTACHMENT_TYPES))
    rows = rows.join(tables["items"].select("itemID", F.col("key").alias("attachment_key")), "itemID")
    best = first_by(rows, "parentItemID", F.array_position(F.array(*map(F.lit, ATTACHMENT_TYPES)), F.col("contentType")), F.col("itemID"))
    return best.select(F.col("parentItemID").alias("itemID"), "attachment_key", "contentType")


def stored_files(files: DataFrame, wanted: DataFrame, max_bytes: int = 500 << 20) -> DataFrame:
    """(itemID, path, length): of the binaryFile listing (path, length), the first file by name
    of the attachment's own type in each attachment's folder, if it is not too large. wanted is
    (itemID, attachment_key, contentType)."""
    listed = files.select("path", "length").withColumn("attachment_key", F.element_at(F.split("path", "/"), -2))
    own = F.when(F.col("contentType") == ATTACHMENT_TYPES[0], ".pdf").otherwise(".docx")
    return first_by(listed.join(wanted, "attachment_key").filter(F.lower("path").endswith(own)), "itemID", F.col("path")).filter(F.col("length") <= max_bytes).select("itemID", "path", "length")


def paths(nodes: DataFrame, glue: str = "/") -> DataFrame:
    """(id, path) from (id, name, parent): names from the root down. A parent that is not there
    makes its child a root. Levels are joined one by one, each from the written one above it,
    until none has rows."""
    nodes = nodes.select("id", "name", "parent")
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    level = cut(nodes.join(known, "parent", "left").filter("known is null").select("id", F.col("name").alias("path")))
    out = level
    while level.limit(1).count():
        level = cut(nodes.join(level.select(F.col("id").alias("parent"), F.col("path").alias("above")), "parent").select("id", F.concat_ws(glue, "above", "name").alias("path")))
        out = out.unionByName(level)
    return out


def item_collections(tables: dict[str, DataFrame]) -> DataFrame:
    """(itemID, collections): full paths by collection name."""
    tree = paths(tables["collections"].select(F.col("collectionID").alias("id"), F.col("collectionName").alias("name"), F.col("parentCollectionID").alias("parent")))
    named = tables["collectionItems"].join(tables["collections"].select("collectionID", "collectionName"), "collectionID").join(tree.withColumnRenamed("id", "collectionID"), "collectionID")
    parts = F.array_sort(F.collect_list(F.struct("collectionName", "path")))
    return named.groupBy("itemID").agg(F.array_join(F.transform(parts, lambda x: x["path"]), "; ").alias("collections"))


def et_al(names: Column, most: int = 3) -> Column:
    """Names joined, the first few with 'et al.' if there are more."""
    return F.when(F.size(names) <= most, F.array_join(names, "; ")).otherwise(F.concat(F.array_join(F.slice(names, 1, most), "; "), F.lit(" et al.")))


def ordered_names(df: DataFrame, key: str, order: list[str], name: Column, most: int = 3) -> DataFrame:
    """(key, authors)."""
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), name.alias("name"))))
    return df.groupBy(key).agg(et_al(F.transform(listed, lambda x: x["name"]), most).alias("authors"))


def item_authors(tables: dict[str, DataFrame]) -> DataFrame:
    rows = tables["itemCreators"].filter(F.col("creatorTypeID") == AUTHOR_TYPE).join(tables["creators"], "creatorID")
    return ordered_names(rows, "itemID", ["orderIndex"], F.concat_ws(", ", F.nullif("lastName", F.lit("")), F.nullif("firstName", F.lit(""))))


def high_water(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("high_water"))
