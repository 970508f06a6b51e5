"""Entity resolution by DOI, then by normalised title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut


def probe(items: DataFrame, store: DataFrame) -> DataFrame:
    """items plus existing_id and existing_item: the stored paper with the same doi_norm, else
    with the same title_norm. store is (paper_id, doi_norm, title_norm, item_id); empty keys
    match nothing. Store rows of one key count once, by the least paper_id."""
    by = lambda k, p: store.filter(F.coalesce(k, F.lit("")) != "").groupBy(k).agg(F.min(F.struct("paper_id", "item_id")).alias(p))
    found = items.join(by("doi_norm", "_by_doi"), "doi_norm", "left").join(by("title_norm", "_by_title"), "title_norm", "left")
    hit = F.coalesce("_by_doi", "_by_title")
    return found.select(*items.columns, hit["paper_id"].alias("existing_id"), hit["item_id"].alias("existing_item"))


def decide(probed: DataFrame, key: str = "item_id") -> DataFrame:
    """Add action: insert, update (the same source item) or skip_dup."""
    return probed.withColumn("action", F.when(F.col("existing_id").isNull(), "insert").when(F.col("existing_item") == F.col(key), "update").otherwise("skip_dup"))


def greedy(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(order, accepted): what taking items in order gives, where an item is skipped if an
    accepted one before it shares a non-empty key, and skipped items add no keys.

    Each round accepts every open item that is the least open one under all its keys, and skips
    the open items that share a key with an accepted one. An item with only one open item before
    it under all its keys is accepted if that one is not; chains of such items are followed by
    pointers that double their reach, so that a chain is settled in as many steps as its length
    has binary digits. That is the sequential result, without gathering a component in one task."""
    one = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(k).alias("value")) for i, k in enumerate(keys))))
    edges = cut(items.select(F.col(order).alias("id"), one.alias("k")).select("id", "k.kind", "k.value").filter(F.coalesce("value", F.lit("")) != ""))
    open_edges, done = edges, None
    while open_edges.limit(1).count():
        least = open_edges.groupBy("kind", "value").agg(F.min("id").alias("least"))
        marked = cut(open_edges.join(least, ["kind", "value"]))
        later = marked.filter("id > least").groupBy("kind", "value").agg(F.min("id").alias("second"))
        seen = marked.join(later, ["kind", "value"], "left")
        before = F.when(F.col("id") > F.col("least"), F.col("least"))
        found = cut(seen.groupBy("id").agg(F.min(before).alias("up"), F.max(before).alias("last"), F.bool_or(F.col("id") > F.col("second")).alias("more")))
        firsts = found.filter("up is null").select("id")
        taken_ids = cut(firsts.unionByName(_settled(cut(found.filter("up = last and not coalesce(more, false)").select("id", "up")), firsts)))
        taken = open_edges.join(taken_ids, "id", "left_semi").select("kind", "value").distinct()
        lost = open_edges.join(taken, ["kind", "value"], "left_semi").select("id").distinct()
        done = taken_ids if done is None else done.unionByName(taken_ids)
        open_edges = cut(open_edges.join(lost, "id", "left_anti"))
    ids = items.select(F.col(order).alias("id"))
    keyless = ids.join(edges.select("id").distinct(), "id", "left_anti")
    accepted = (keyless if done is None else keyless.unionByName(done)).withColumn("accepted", F.lit(True))
    return ids.join(accepted, "id", "left").select(F.col("id").alias(order), F.coalesce("accepted", F.lit(False)).alias("accepted"))


def _settled(chains: DataFrame, accepted: DataFrame) -> DataFrame:
    """Ids of chains(id, up), where an id is accepted if its up is not, that an even number of
    steps leads to an accepted id."""
    at = chains.select("id", "up", F.lit(True).alias("odd"))
    while True:
        further = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("odd").alias("next_odd"))
        step = cut(at.join(further, "up", "left").select("id", F.coalesce("next", "up").alias("up"), (F.col("odd") != F.coalesce("next_odd", F.lit(False))).alias("odd"), F.col("next").isNotNull().alias("moved")))
        at = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return at.filter("not odd").join(accepted.select(F.col("id").alias("up")), "up", "left_semi").select("id")
