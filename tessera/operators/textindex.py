"""The trigram index of papers, in segments.

A segment holds papers in blocks by a hash of paper_id (some thousand papers each), and for each
trigram and block the numbers (in the block) of its papers that have it; lists lie in folders by a hash of
the trigram. A delta is a new segment with the new and changed papers, and a list of the rows of
older segments that it replaces or deletes, so it writes in proportion to itself. Segments of
like size are merged into one when there are several.

A search takes the rarest trigrams of each phrase (by stored sizes, summed in a table of fixed
size), reads their lists, meets them block by block, and reads the blocks that are left. While
the lists are short by those sizes, they come to the driver and the papers are read by number;
beyond that, the numbers that are left go to the papers, and where they are a large part of all
papers, these are scanned. No text is ever shuffled by a search.

The state (which segments there are, their sizes) is a small dictionary that the writer returns
and whoever publishes the index keeps; a reader with an older state goes on reading its own
segments until they are vacuumed."""

from __future__ import annotations

import re
import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from tessera.lineage import cut, delete
from tessera.operators.lexical import FIELDS, Phrase, literal, sized

#: Papers of a block, about, up to this number of blocks of a segment; then blocks grow.
BLOCK_ROWS, MOST_BLOCKS, PART_BLOCKS, SIZES = 1024, 50_000, 32, 1 << 16
#: Places that a search may bring to the driver, papers that a scan is given one by one, trigrams of a
#: phrase whose lists are read.
MOST_IDS, NAMED_IDS, MOST_GRAMS = 200_000, 2_000, 4
#: Characters of papers whose trigrams are held at once.
MOST_CHARS = 1 << 22
#: Papers whose numbers a search may send to all executors; beyond that, or if SCAN_SHARE times as
#: many are more than all, every paper is read, which moves no text. Papers that one task may rank.
WIDE_IDS, SCAN_SHARE, ONE_TASK = 4_000_000, 4, 20_000
#: Segments of one size class (powers of this) that are merged.
MERGE = 4


def _hash(gram: str) -> int:
    return zlib.crc32(gram.encode())


def _schema(first: StructType, **more: DataType) -> StructType:
    return StructType([*first.fields, *(StructField(n, t) for n, t in more.items())])


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("paper_id"), F.lit(blocks)).cast("int")


def _grams_of(texts: list[str]) -> np.ndarray:
    """The distinct runs of three characters of the texts, 21 bits a character."""
    keys = []
    for t in texts:
        if len(t) > 2:
            x = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            keys.append(x[:-2] << 42 | x[1:-1] << 21 | x[2:])
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)


def _lists_of(block: int, places: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each trigram of some papers of a block."""
    all_, owners = np.concatenate(grams), np.repeat(np.asarray(places, np.int32), [len(g) for g in grams])
    order = np.argsort(all_, kind="stable")
    all_ = all_[order]
    starts = np.flatnonzero(np.diff(all_, prepend=-1))
    own = all_[starts]
    said = np.stack([own >> 42, own >> 21 & 0x1FFFFF, own & 0x1FFFFF], 1).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(all_)), pa.int32()), pa.array(owners[order]))
    said = [said[i : i + 3] for i in range(0, len(said), 3)]
    return pa.RecordBatch.from_arrays([pa.array(said), pa.array(np.full(len(own), block, np.int32)), lists], ["gram", "block", "places"])


def _post(batches):
    """Rows of the trigrams of papers(block, pos, texts...), which come block by block. What is
    held at a time is bounded by characters, so a block of long texts gives several rows a trigram."""
    at, places, grams, held = None, [], [], 0
    for b in batches:
        for i in range(b.num_rows):
            block, pos, *texts = (c[i].as_py() for c in b.columns)
            if grams and (block != at or held > MOST_CHARS):
                yield _lists_of(at, places, grams)
                places, grams, held = [], [], 0
            own = _grams_of(texts)
            if len(own):
                at, held = block, held + sum(map(len, texts))
                places.append(pos)
                grams.append(own)
    if grams:
        yield _lists_of(at, places, grams)


def usable_trigrams(text: str) -> list[str]:
    """Trigrams of a lower-cased text whose lists can be relied on: lowering other letters than
    ASCII may depend on what is beside them, so trigrams with those are passed over."""
    usable = lambda g: all(c.isascii() or c.lower() == c == c.upper() for c in g)
    return sorted({g for g in (text[i : i + 3] for i in range(len(text) - 2)) if usable(g)})


def _write_segment(papers: DataFrame, folder: str) -> dict | None:
    """Write papers as a segment; what the state keeps of it."""
    spark = papers.sparkSession
    papers = papers.drop("segment", "block", "pos", "d")
    n = papers.count()
    if not n:
        return None
    name, blocks = uuid.uuid4().hex[:12], min(-(-n // BLOCK_ROWS), MOST_BLOCKS)
    lists = min(4096, max(8, n // 2_000))
    place = f"{folder}/papers/segment={name}"
    # as many parts as there are blocks, up to the usual number; then each has a bounded number of blocks
    parts = max(min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), blocks // PART_BLOCKS)
    placed = sized(papers).withColumn("block", _block(blocks)).repartition(parts, "block")
    # papers are numbered in their block, so that lists are of small numbers and not of ids
    placed.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy("paper_id"))).write.partitionBy("block").parquet(place)
    written = spark.read.schema(_schema(sized(papers).schema, pos=IntegerType(), block=IntegerType())).parquet(place)
    # a block's file is read by one task, which makes its lists; only these are shuffled
    low = written.select("block", "pos", *(F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS))
    rows = low.mapInArrow(_post, "gram string, block int, places array<int>").withColumn("list", (F.crc32(F.encode("gram", "UTF-8")) % lists).cast("int"))
    rows.repartition(max(min(lists, parts), blocks // PART_BLOCKS), "list").sortWithinPartitions("list", "gram", "block").write.partitionBy("list").parquet(f"{folder}/lists/segment={name}")
    sizes = spark.read.parquet(f"{folder}/lists/segment={name}").groupBy((F.crc32(F.encode("gram", "UTF-8")) % SIZES).cast("int").alias("bucket")).agg(F.sum(F.size("places")).alias("n"))
    sizes.coalesce(1).write.parquet(f"{folder}/sizes/segment={name}")
    total = written.agg(F.sum("d")).first()[0]
    return {"name": name, "rows": n, "size": int(total), "lists": lists, "dead": 0, "dead_size": 0}


def write_index(papers: DataFrame, folder: str) -> dict:
    """A new index of papers(paper_id, title, abstract, summary, ...); its state."""
    first = _write_segment(papers, folder)
    return {"schema": sized(papers).schema.jsonValue(), "segments": [first] if first else [], "dead": []}


def _read(spark: SparkSession, folder: str, kind: str, names: list[str], schema: StructType) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/{kind}").parquet(*(f"{folder}/{kind}/segment={n}" for n in names))


def _papers(spark: SparkSession, folder: str, state: dict) -> DataFrame:
    """All rows of the segments, dead ones too."""
    schema = _schema(StructType.fromJson(state["schema"]), pos=IntegerType(), segment=StringType(), block=IntegerType())
    return _read(spark, folder, "papers", [s["name"] for s in state["segments"]], schema)


def _dead(spark: SparkSession, folder: str, state: dict) -> DataFrame | None:
    """(segment, paper_id, d) of rows that later segments replace."""
    return spark.read.parquet(*(f"{folder}/dead/{n}" for n in state["dead"])) if state["dead"] else None


def _live(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    return rows if dead is None else rows.join(dead.select("segment", "paper_id"), ["segment", "paper_id"], "left_anti").select(*rows.columns)


def update_index(spark: SparkSession, folder: str, state: dict, papers: DataFrame, gone: DataFrame) -> dict:
    """The state after a delta: papers are new or changed, gone(paper_id) are deleted. Writes one
    segment of the papers and the list of rows that die; merges segments of like size."""
    papers = cut(papers)
    keys = papers.select("paper_id").unionByName(gone.select("paper_id")).distinct()
    dying = _live(_papers(spark, folder, state).select("segment", "paper_id", "d"), _dead(spark, folder, state)).join(keys, "paper_id", "left_semi")
    name = uuid.uuid4().hex[:12]
    dying.select("segment", "paper_id", "d").coalesce(4).write.parquet(f"{folder}/dead/{name}")
    died = {r["segment"]: r for r in spark.read.schema(dying.select("segment", "paper_id", "d").schema).parquet(f"{folder}/dead/{name}").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d")).collect()}
    segments = [s | {"dead": s["dead"] + died[s["name"]]["n"], "dead_size": s["dead_size"] + int(died[s["name"]]["d"])} if s["name"] in died else s for s in state["segments"]]
    new = _write_segment(papers, folder)
    state = state | {"segments": segments + ([new] if new else []), "dead": state["dead"] + ([name] if died else [])}
    return _merged(spark, folder, state)


def _class(segment: dict) -> int:
    return int(np.log2(max(1, segment["rows"] - segment["dead"])) / np.log2(MERGE))


def _merged(spark: SparkSession, folder: str, state: dict) -> dict:
    """Merge segments while MERGE of them are in one size class, or one is half dead."""
    while True:
        classes: dict[int, list[dict]] = {}
        for s in state["segments"]:
            classes.setdefault(_class(s), []).append(s)
        old = next((x for x in classes.values() if len(x) >= MERGE), None) or [s for s in state["segments"] if 2 * s["dead"] > s["rows"]]
        if not old:
            return state
        names = {s["name"] for s in old}
        rows = _live(_papers(spark, folder, state | {"segments": old}), _dead(spark, folder, state))
        new = _write_segment(rows, folder)
        kept = [s for s in state["segments"] if s["name"] not in names]
        # lists of the dead go with the last segment that they speak of
        state = state | {"segments": kept + ([new] if new else []), "dead": state["dead"] if any(s["dead"] for s in kept) else []}


def vacuum(spark: SparkSession, folder: str, states: list[dict]) -> int:
    """Delete the segments and lists that none of the states has; their number. Readers of the
    states given are not disturbed."""
    keep = {f"segment={s['name']}" for state in states for s in state["segments"]} | {n for state in states for n in state["dead"]}
    return sum(delete(spark, f"{folder}/{kind}", keep) for kind in ("papers", "lists", "sizes", "dead"))


class Index:
    """A state of an index, for reading."""

    def __init__(self, spark: SparkSession, folder: str, state: dict):
        self.spark, self.state, self.segments = spark, state, {s["name"]: s for s in state["segments"]}
        self.all, self.dead = _papers(spark, folder, state), _dead(spark, folder, state)
        schema = _schema(StructType(), gram=StringType(), block=IntegerType(), places=ArrayType(IntegerType()), segment=StringType(), list=IntegerType())
        self.lists = _read(spark, folder, "lists", list(self.segments), schema)
        n = sum(s["rows"] - s["dead"] for s in self.segments.values())
        self.totals = (n, sum(s["size"] - s["dead_size"] for s in self.segments.values()) / n or 1.0) if n else (0, 1.0)
        self.sizes = np.zeros(SIZES, np.int64)
        if self.segments:
            found = _read(spark, folder, "sizes", list(self.segments), _schema(StructType(), bucket=IntegerType(), n=LongType(), segment=StringType())).groupBy("bucket").agg(F.sum("n")).collect()
            self.sizes[[r[0] for r in found]] = [r[1] for r in found]

    @property
    def papers(self) -> DataFrame:
        return _live(self.all, self.dead).drop("segment", "block", "pos")

    def _rarest(self, *parts: str) -> list[str] | None:
        grams = sorted({g for p in parts for g in usable_trigrams(p)}, key=lambda g: (self.sizes[_hash(g) % SIZES], g))[:MOST_GRAMS]
        return grams or None

    def _postings(self, grams: set[str]) -> DataFrame:
        said = ", ".join(literal(g) for g in sorted(grams))
        where = " OR ".join(f"(segment = '{s['name']}' AND list IN ({', '.join(map(str, sorted({_hash(g) % s['lists'] for g in grams})))}))" for s in self.segments.values())
        return self.lists.filter(F.expr(f"({where}) AND gram IN ({said})"))

    def candidates(self, phrases: list[str], like: str | None = None) -> dict[tuple[str, int], set] | DataFrame | None:
        """Papers that may have one of the phrases, or be LIKE %like%: their numbers by segment
        and block, or, where the lists are long, a DataFrame(segment, block, places); None if a
        phrase has no usable trigram or too many papers are left."""
        chosen = [self._rarest(p) for p in phrases] + ([self._rarest(*re.split("[%_]", like.lower()))] if like is not None else [])
        if any(c is None for c in chosen):
            return None
        if not self.segments or not chosen:
            return {}
        grams = {g for c in chosen for g in c}
        rows = self._postings(grams)
        if sum(int(self.sizes[_hash(g) % SIZES]) for g in grams) <= MOST_IDS:
            held: dict[tuple[str, int], dict[str, list]] = {}
            for r in rows.select("segment", "block", "gram", "places").toArrow().to_pylist():
                held.setdefault((r["segment"], r["block"]), {}).setdefault(r["gram"], []).extend(r["places"])
            out = {}
            for place, lists in held.items():
                some: set = set()
                for c in chosen:
                    if all(g in lists for g in c):
                        some |= set(lists[c[0]]).intersection(*(lists[g] for g in c[1:]))
                if some:
                    out[place] = some
            return out
        # a phrase has at most as many papers as its shortest list
        most = sum(min(int(self.sizes[_hash(g) % SIZES]) for g in c) for c in chosen)
        if most > WIDE_IDS or SCAN_SHARE * most > self.totals[0]:
            return None
        of = lambda g: F.flatten(F.transform(F.filter("held", lambda h: h["gram"] == g), lambda h: h["places"]))
        met = reduce(F.array_union, (reduce(F.array_intersect, map(of, c)) for c in chosen))
        held = rows.groupBy("segment", "block").agg(F.collect_list(F.struct("gram", "places")).alias("held"))
        return held.select("segment", "block", met.alias("places")).filter(F.size("places") > 0)

    def read(self, found: dict[tuple[str, int], set]) -> DataFrame:
        """The live papers, with their places, of the blocks of candidates; while they are few,
        only they."""
        if not found:
            return _live(self.all, self.dead).limit(0)
        by_segment: dict[str, list[str]] = {}
        named = sum(map(len, found.values())) <= NAMED_IDS
        for (segment, block), places in sorted(found.items()):
            by_segment.setdefault(segment, []).append(f"(block = {block} AND pos IN ({', '.join(map(str, sorted(places)))}))" if named else str(block))
        said = (lambda x: f"({' OR '.join(x)})") if named else (lambda x: f"block IN ({', '.join(x)})")
        rows = self.all.filter(" OR ".join(f"(segment = '{s}' AND {said(x)})" for s, x in by_segment.items()))
        return _live(rows, self.dead)

    def rows(self, phrases: list[Phrase], like: str | None = None) -> tuple[DataFrame, bool]:
        """(papers, with their places, that may have any of the phrases or be LIKE %like%, whether
        they are few). A LIKE pattern is looked up by the parts between its wildcards."""
        found = self.candidates([p.text for p in phrases if p.text], like)
        if isinstance(found, dict):
            return self.read(found), sum(map(len, found.values())) <= ONE_TASK
        rows = self.all
        if found is not None:
            rows = rows.join(F.broadcast(found), ["segment", "block"]).filter(F.array_contains("places", F.col("pos"))).select(*rows.columns)
        return _live(rows, self.dead), False

