"""A resident engine over the current snapshot: validated search over the persisted index and
embeddings, which follows the snapshot's generation."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import cut, delete
from tessera.operators import chunk, lexical, semantic, textindex, vector
from tessera.operators.papers import papers_of
from tessera.plans import snapshot


def valid_top_k(top_k: object) -> int:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 100:
        raise ValueError("top_k must be a whole number from 1 to 100")
    return top_k


def clamped(top_k: object) -> int:
    """Any value to 1..100; 5 where it is no number."""
    try:
        return max(1, min(int(top_k), 100))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return 5


#: Columns that a store may be scanned by.
KEYS = ("doi", "paper_id", "filename", "item_id")


#: Vector segments after which the vectors are written anew, with new centres.
MOST_SEGMENTS = 16


def index_state(spark: SparkSession, root: str, generation: str) -> dict | None:
    found = snapshot.read_text(spark, f"{root}/index/{generation}.json")
    return json.loads(found) if found else None


def build_index(spark: SparkSession, root: str, base: dict | None = None, changed: DataFrame | None = None) -> str:
    """Write the index of the current snapshot: the papers' texts and trigrams and, where chunks
    have embeddings, the vectors. With base, the manifest before, and changed(paper_id), the
    papers that are new, changed or gone since then, base's index is carried on by a segment of
    these papers; else all is written. Readers find an index by the generation, so a failed build
    leaves what they have."""
    state = snapshot.manifest(spark, root)
    before = index_state(spark, root, base["generation"]) if base and changed is not None else None
    chunks = snapshot.read(spark, root, state)
    texts = f"{root}/index/texts"
    if before is None:
        made = {"texts": textindex.write_index(papers_of(chunks), texts)}
    else:
        changed = cut(changed.select("paper_id").distinct())
        new = cut(snapshot.of_keys(spark, root, state, changed))
        made = {"texts": textindex.update_index(spark, texts, before["texts"], papers_of(new), changed)}
    if "embedding" in chunks.columns:
        vectors = (before or {}).get("vectors")
        if vectors and len(vectors["segments"]) < MOST_SEGMENTS:
            made["vectors"] = vectors | vector.update_index(spark, f"{root}/index/{vectors['folder']}", vectors, new, changed)
        elif chunks.limit(1).count():
            folder = f"vectors-{state['generation']}"
            made["vectors"] = {"folder": folder} | vector.write_index(chunks.select("chunk_id", "embedding"), f"{root}/index/{folder}", "chunk_id")
    snapshot.write_text(spark, f"{root}/index/{state['generation']}.json", json.dumps(made))
    return state["generation"]


def encoder_of(spark: SparkSession, root: str, state: dict) -> Callable | None:
    """The encoder that a snapshot's embeddings were made with, if it was trained for the store."""
    return semantic.load(spark, f"{root}/{state['encoder']}") if "encoder" in state else None


def encoder_loader(spark: SparkSession, root: str, state: dict) -> Callable[[], Callable]:
    """What gives the workers the snapshot's encoder; the usual one where none was trained."""
    model = encoder_of(spark, root, state)
    if model is None:
        return vector.trigram_encoder
    shared = spark.sparkContext.broadcast(model)
    return lambda: shared.value


def train_encoder(spark: SparkSession, root: str, index: bool = True, **options) -> str:
    """Train an encoder on the store's chunks, embed all of them anew and publish them with the
    encoder's place; later syncs and searches use it. options are those of semantic.fit. Returns
    the new generation."""
    base = snapshot.manifest(spark, root)
    chunks = snapshot.read(spark, root, base)
    if chunks is None:
        raise LookupError("no snapshot is published")
    place = f"encoders/{time.time_ns()}"
    semantic.save(spark, semantic.fit(chunks, **options), f"{root}/{place}")
    load = encoder_loader(spark, root, {"encoder": place})
    now = snapshot.publish(cut(vector.embed(chunks.drop("embedding"), load)), root, base["key"], base, encoder=place)
    if index:
        build_index(spark, root)
    return now


def statistics(spark: SparkSession, root: str) -> DataFrame:
    """One row of the current snapshot's counted rows and estimated distinct values; no data file
    is opened."""
    state = snapshot.manifest(spark, root)
    if not state["number"]:
        raise LookupError("no snapshot is published")
    return snapshot.statistics(spark, root, state)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete folders of snapshots and indexes that none of the last keep generations has; readers
    of those are not disturbed. Returns the number of folders that went."""
    states = snapshot.last(spark, root, keep)
    made = [x for s in states if (x := index_state(spark, root, s["generation"]))]
    gone = snapshot.vacuum(spark, root, states)
    # an encoder younger than the newest generation may be on its way into one
    newest = max((int(s["generation"].split("-")[0]) for s in states), default=0)
    models = {s["encoder"].split("/")[1] for s in states if "encoder" in s}
    gone += delete(spark, f"{root}/encoders", models, before=newest)
    gone += textindex.vacuum(spark, f"{root}/index/texts", [m["texts"] for m in made])
    kept = {f"vectors-{s['generation']}" for s in states} | {m["vectors"]["folder"] for m in made if "vectors" in m}
    return gone + delete(spark, f"{root}/index", kept | {"texts"} | {f"{s['generation']}.json" for s in states})


class Engine:
    def __init__(self, spark: SparkSession, root: str, encoder=None):
        self.spark, self.root = spark, root
        self.encoder, self._given = encoder or vector.trigram_encoder(), encoder is not None
        self.place = None
        self.generation, self.chunks, self.index = "0", None, None

    def refresh(self) -> str:
        """Follow the manifest; a search then reads one immutable snapshot and its index, which is
        built here if the writer has not."""
        state = snapshot.manifest(self.spark, self.root)
        now = state["generation"]
        if now != self.generation:
            made = index_state(self.spark, self.root, now)
            if made is None:
                build_index(self.spark, self.root)
                made = index_state(self.spark, self.root, now)
            self.chunks, self.vectors = snapshot.read(self.spark, self.root, state), made.get("vectors")
            self.index = textindex.Index(self.spark, f"{self.root}/index/texts", made["texts"])
            if not self._given and state.get("encoder") != self.place:
                self.encoder, self.place = encoder_of(self.spark, self.root, state) or vector.trigram_encoder(), state.get("encoder")
            self.generation, self.state = now, state
        return now

    def health(self) -> dict:
        ready = self.refresh() != "0"
        return {"service": "tessera", "status": "ready" if ready else "loading", "generation": self.generation, "spark": self.spark.version}

    def _ready(self, query: str, top_k: int) -> None:
        if not isinstance(query, str) or not query.strip():
            raise ValueError("the query is empty")
        valid_top_k(top_k)
        if self.refresh() == "0":
            raise LookupError("no snapshot is published")

    def search_text(self, query: str, top_k: int = 10) -> DataFrame:
        self._ready(query, top_k)
        return lexical.search(self.index.papers, query, top_k, self.index)

    def search(self, query: str, top_k: int = 5, scorer=None, exact: bool = False) -> list:
        """Rows of the nearest chunks, reranked. Should the snapshot have been replaced while the
        search ran, it runs once more on the new one."""
        for _ in range(2):
            self._ready(query, top_k)
            rows = self._search(query, top_k, scorer, exact).collect()
            if snapshot.generation(self.spark, self.root) == self.generation:
                break
        return rows

    def _search(self, query: str, top_k: int, scorer, exact: bool) -> DataFrame:
        if self.vectors is None:
            raise LookupError("the snapshot has no embeddings; sync with an encoder")
        wanted, among = self.encoder([query])[0].tolist(), max(2 * top_k, 20)
        if exact:
            near = vector.nearest(self.chunks, wanted, among, "chunk_id")
        else:
            near = vector.Index(self.spark, f"{self.root}/index/{self.vectors['folder']}", self.vectors).nearest(wanted, among)
        hits = self.chunks.join(F.broadcast(near), "chunk_id").withColumn("query", F.lit(query))
        hits = hits if "filename" in hits.columns else hits.withColumn("filename", F.lit(""))
        return vector.result_rows(vector.rerank(hits, top_k, scorer, ties=("chunk_id",)))

    def full_text(self, paper_id: str, max_chars: int = 8000) -> DataFrame:
        self.refresh()
        return chunk.text_prefix(self.scan("paper_id", paper_id), "paper_id", "chunk_index", "text", max_chars).orderBy("chunk_index")

    def scan(self, key: str, value: object, limit: int | None = None) -> DataFrame:
        """The chunks whose key (one of KEYS) equals value."""
        if key not in KEYS:
            raise ValueError(f"{key} is none of {', '.join(KEYS)}")
        self.refresh()
        found = snapshot.of_value(self.spark, self.root, self.state, key, value)
        return found if limit is None else found.limit(limit)

    def schema(self) -> DataFrame:
        """(table, column, type) of the store and its index."""
        self.refresh()
        tables = {"chunks": self.chunks, "papers": self.index.papers, "lists": self.index.lists}
        return self.spark.createDataFrame([(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema], "table string, column string, type string")

    def close(self) -> None:
        self.generation, self.chunks, self.index = "0", None, None
