"""Incremental synchronisation: catalog delta -> texts -> chunks -> snapshot, as one batch plan
that a stream of catalog changes can drive."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.lineage import cut
from tessera.operators import catalog, dedup, vector
from tessera.operators.chunk import chunk_documents
from tessera.plans import snapshot
from tessera.plans.engine import build_index, encoder_loader

#: Outcomes that are tried again at the next sync.
RETRY = ("no_attachment", "extract_fail")


def plan_delta(items: DataFrame, texts: DataFrame, store: DataFrame | None) -> DataFrame:
    """items(itemID, key, title, doi, ...) with paper_id, outcome and text. texts is
    (itemID, text), null where extraction failed. Duplicates against the store and inside the
    delta are skipped; items that yield no text add no keys."""
    items = items.withColumns({"doi_norm": T.doi_norm(F.col("doi")), "title_norm": T.normalize_title(F.col("title")), "has_file": F.lit(None).cast("boolean")}).drop("has_file")
    joined = items.join(texts.withColumn("has_file", F.lit(True)), "itemID", "left")
    keyed = joined.withColumn("paper_id", T.item_paper_id(F.col("doi"), F.col("key"), F.col("itemID")))
    if store is None:
        probed = keyed.withColumns({"existing_id": F.lit(None).cast("string"), "existing_item": F.lit(None).cast("long")})
    else:
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_index"))).alias(c)
        known = store.groupBy("paper_id").agg(first("doi"), first("title"), first("item_id"))
        probed = dedup.probe(keyed, known.select("paper_id", T.doi_norm(F.col("doi")).alias("doi_norm"), T.normalize_title(F.col("title")).alias("title_norm"), "item_id"))
    decided = dedup.decide(probed, "itemID").withColumn("paper_id", F.coalesce("existing_id", "paper_id"))
    short = F.length(T.strip(F.coalesce("text", F.lit("")))) < 20
    decided = cut(decided.withColumn("outcome", F.when(F.col("action") == "skip_dup", "dup").when(F.col("has_file").isNull(), "no_attachment").when(short, "extract_fail").otherwise("imported")))
    fresh = dedup.greedy(decided.filter("outcome = 'imported'"), ["doi_norm", "title_norm"], "itemID")
    final = decided.join(fresh, "itemID", "left").withColumn("outcome", F.when(F.coalesce("accepted", F.lit(True)), F.col("outcome")).otherwise("dup"))
    return final.drop("accepted", "has_file", "existing_id", "existing_item")


def sync(spark: SparkSession, root: str, tables: dict[str, DataFrame], extract: Callable[[DataFrame], DataFrame], full_rescan: bool = False, dry_run: bool = False, load_encoder: Callable[[], Callable] | None = None, index: bool = True) -> dict:
    """One synchronisation. extract turns the wanted items into (itemID, text); new chunks get
    their embeddings here, by the store's own encoder unless another is given. Returns the counts by outcome and removed papers. If another writer
    published meanwhile, all is planned once more on what it left."""
    try:
        return _sync(spark, root, tables, extract, full_rescan, dry_run, load_encoder, index)
    except snapshot.Conflict:
        return _sync(spark, root, tables, extract, full_rescan, dry_run, load_encoder, index)


def _sync(spark, root, tables, extract, full_rescan, dry_run, load_encoder, index) -> dict:
    state = dict(snapshot.EMPTY_STATE) if full_rescan else snapshot.load_state(spark, root)
    version = catalog.high_water(tables["items"], "version").first()[0]
    pending = spark.read.parquet(f"{root}/{state['pending']}") if state["pending"] else None
    items = cut(catalog.scan_items(tables, state["last_item_id"], state["last_version"], pending))
    wanted = items.join(catalog.attachments(tables), "itemID")
    if dry_run:
        return {"found": items.count(), "with_attachment": wanted.count()}
    base = snapshot.manifest(spark, root)
    store = snapshot.read(spark, root, base)
    delta = cut(plan_delta(items, extract(wanted), store))
    rows = delta.filter("outcome = 'imported'").join(catalog.item_authors(tables), "itemID", "left").join(catalog.item_collections(tables), "itemID", "left")
    chunks = chunk_documents(rows, "itemID").join(rows.drop("text"), "itemID")
    chunks = chunks.select(
        F.concat_ws("#", "paper_id", "chunk_index").alias("chunk_id"), "paper_id", "chunk_index", "total_chunks", "section", T.with_note(F.col("chunk_index"), F.col("abstract_note"), F.col("text")).alias("text"),
        "title", F.col("doi_norm").alias("doi"), F.col("itemID").alias("item_id"), F.col("key").alias("zotero_key"), F.coalesce("authors", F.lit("")).alias("authors"), "journal", T.year(F.col("date")).alias("year"), F.coalesce("collections", F.lit("")).alias("collections"),
    )
    counts = {r["outcome"]: r["count"] for r in delta.groupBy("outcome").count().collect()}
    chunks = cut(vector.embed(chunks, load_encoder or encoder_loader(spark, root, base)))
    removed, changed = 0, chunks.select("paper_id")
    if store is None:
        if counts.get("imported"):
            snapshot.publish(chunks, root, "paper_id", base)
    else:
        gone = tables["deletedItems"].withColumnRenamed("itemID", "item_id")
        removed = snapshot.removed_papers(store, gone, "item_id").agg(F.coalesce(F.sum("papers"), F.lit(0))).first()[0]
        if counts.get("imported") or removed:
            dropped = store.join(gone.filter("dateDeleted is not null").select("item_id").distinct(), "item_id", "left_semi").select("paper_id")
            dropped = cut(dropped.distinct())
            changed = changed.unionByName(dropped)
            snapshot.update(chunks, dropped, root, base)
    if index and (counts.get("imported") or removed):
        build_index(spark, root, base, changed)
    last = items.agg(F.max("itemID")).first()[0] or 0
    waiting = f"pending/{time.time_ns()}"
    delta.filter(F.col("outcome").isin(*RETRY)).select("itemID").write.parquet(f"{root}/{waiting}")
    snapshot.save_state(spark, root, {"last_item_id": max(state["last_item_id"], last), "last_version": max(state["last_version"], version), "pending": waiting, "last_sync_time": time.strftime("%Y-%m-%d %H:%M:%S")})
    return {"found": sum(counts.values()), "removed": removed} | counts


def ingest(spark: SparkSession, root: str, documents: DataFrame, least_chars: int = 50, load_encoder: Callable[[], Callable] | None = None, index: bool = True) -> dict:
    """Add a folder's documents(path, paper_id, title, text) to the store: those whose paper_id it
    has are skipped, and so are texts below least_chars; contents are not compared. Returns the
    counts."""
    base = snapshot.manifest(spark, root)
    store = snapshot.read(spark, root, base)
    docs = documents.dropDuplicates(["paper_id"])
    marked = docs if store is None else docs.join(store.select("paper_id").distinct().withColumn("known", F.lit(True)), "paper_id", "left")
    known = F.lit(False) if store is None else F.coalesce("known", F.lit(False))
    short = F.length(T.strip(F.coalesce("text", F.lit("")))) < least_chars
    decided = cut(marked.withColumn("outcome", F.when(known, "skipped").when(short, "too_short").otherwise("imported")))
    rows = decided.filter("outcome = 'imported'")
    chunks = chunk_documents(rows, "paper_id").join(rows.select("paper_id", "title", F.substring_index("path", "/", -1).alias("filename")), "paper_id")
    chunks = chunks.select(F.concat_ws("#", "paper_id", "chunk_index").alias("chunk_id"), "paper_id", "chunk_index", "total_chunks", "section", "text", "title", "filename", F.lit("papers").alias("source"))
    chunks = cut(vector.embed(chunks, load_encoder or encoder_loader(spark, root, base)))
    counts = {r["outcome"]: r["count"] for r in decided.groupBy("outcome").count().collect()}
    if counts.get("imported"):
        if store is None:
            snapshot.publish(chunks, root, "paper_id", base)
        else:
            snapshot.update(chunks, chunks.select("paper_id").limit(0), root, base)
        if index:
            build_index(spark, root, base, chunks.select("paper_id"))
    return {"found": sum(counts.values())} | counts


def signature(files: DataFrame) -> str:
    """A name for the state of files(path, length, modificationTime): it changes with any of
    them."""
    row = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.max("modificationTime"), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0))).first()
    return ":".join(map(str, row))


def watch(look: Callable[[], str], run: Callable[[], object], every: float = 86_400, settle: float = 5, initial: bool = True, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run when the signature that look gives has changed and then stood still for settle seconds.
    The signature that counts is the one before the run, so changes during it are seen again; a
    run that fails is tried again at the next look. Returns the number of runs that ended well."""
    last, done = (None if initial else look()), 0
    while rounds is None or rounds > 0:
        now = look()
        if now != last:
            while True:
                sleep(settle)
                again = look()
                if again == now:
                    break
                now = again
            try:
                run()
                last, done = now, done + 1
            except Exception as e:
                logging.getLogger(__name__).warning("failed, to be tried again: %s", e)
        rounds = None if rounds is None else rounds - 1
        if rounds is None or rounds > 0:
            sleep(every)
    return done


def drive(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run batch for each micro-batch of stream: all that is there, or at intervals."""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def follow(spark: SparkSession, root: str, changes: DataFrame, tables: Callable[[], dict[str, DataFrame]], extract: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None, **options):
    """Synchronise for each micro-batch of a stream of catalog changes. A batch only says that
    there are changes: what they are, and which items of earlier syncs wait to be tried again,
    comes from the saved state, so a batch that is run again after a failure does no harm, and a
    stream that goes on from its checkpoint goes on with the waiting items too. tables reads the
    catalog as it is then; options are sync's."""

    def batch(rows: DataFrame, number: int) -> None:
        if rows.limit(1).count():
            sync(spark, root, tables(), extract, **options)

    return drive(changes, batch, checkpoint, every)
