"""Operator 6: substring dedup with suffix automata and matching statistics.

A word is removed if a window of ``span`` consecutive words that covers it also starts in a
document with a smaller doc_id. The reference of a document is the whole corpus before it, which
no broadcast can hold; so automata go where they can match, by joins:

1. Winnowing: of the word ``anchor``-grams in every window the one with the least hash is an
   anchor, so equal windows have equal anchors. An anchor's owner is the first document that has
   it (one aggregation over (anchor, doc_id)).
2. A document that shares at least ``least_shared`` anchors with an owner streams the stretch
   that holds them through the suffix automaton of the owner's stretch. Matching statistics of
   ``span`` words or more are removed as maximal spans. A hot owner's automaton is built
   once for each block of about ``block`` partners, so its partners are spread over tasks.
3. Windows that this leaves open (too few shared anchors, or not in the owner) are posted by
   their hash and settled by the least doc_id of each. The first document that has such a window
   posts it too, so the result is exact.

Words are compared by 64-bit hashes, windows by 128 bits.

Defined results: null text counts as empty; texts below ``span`` words lose nothing; a null
doc_id counts as the largest number; rows with one doc_id never remove each other's words;
repeated rows each give a row; texts of any length are taken whole, a batch is worked on in
slices bounded by bytes; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.automaton import SuffixAutomaton, long_spans
from tessera.llm.common import IdFilter, cut, slices
from tessera.llm.minhash import WordHashes, _mixed

_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i for i up to n, modulo 2**64."""
    if base not in _tables or len(_tables[base]) <= n:
        x = np.full(max(4096, 2 * n), base, np.uint64)
        x[0] = 1
        _tables[base] = np.cumprod(x, dtype=np.uint64)
    return _tables[base]


def gram_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size items of w."""
    n = len(w)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * _power(_BASE, n)[:n], dtype=np.uint64)])
    return _mixed((sums[size:] - sums[:-size]) * _power(_INVERSE, n)[: n - size + 1])


def anchors(w: np.ndarray, span: int, anchor: int) -> np.ndarray:
    """For each window of span items: the key of its anchor, 48 bits."""
    least, width, want = gram_hashes(w, anchor), 1, span - anchor + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least >> np.uint64(16)).astype(np.int64)


def _hashed(words: list[bytes], hashes: dict) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _anchor_rows(docs: DataFrame, span: int, anchor: int) -> DataFrame:
    """(id, anchor), distinct within a text."""

    def run(batches):
        hashes = WordHashes()
        # fewer than 2**16 texts of span words fit a slice
        for b in (x for batch in batches for x in slices(batch, "text", most_bytes=1 << 20)):
            texts = [words for words in (text.encode().split() for text in b.column("text").to_pylist())]
            ids = b.column("id").to_numpy()[[len(words) >= span for words in texts]]
            texts = [words for words in texts if len(words) >= span]
            if texts:
                # all texts in a row: windows that cross a border are left out
                doc = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
                keys = anchors(np.concatenate([_hashed(words, hashes) for words in texts]), span, anchor)
                inside = doc[: len(keys)] == doc[span - 1 :]
                both = (doc[: len(keys)][inside].astype(np.uint64) << np.uint64(48)) | keys[inside].astype(np.uint64)
                both = np.unique(both[np.flatnonzero(np.diff(both, prepend=both[:1] + np.uint64(1)))])
                yield pa.RecordBatch.from_arrays([pa.array(ids[(both >> np.uint64(48)).astype(np.int64)]), pa.array((both & np.uint64((1 << 48) - 1)).astype(np.int64))], ["id", "anchor"])

    return docs.select("id", "text").mapInArrow(run, "id long, anchor long")


_OUT = {"owner": pa.int64(), "block": pa.int64(), "role": pa.int32(), "id": pa.int64(), "text_hash": pa.int64(), "at": pa.int64(), "stop": pa.int64(), "words": pa.binary(), "keys": pa.binary(), "h": pa.int64(), "g": pa.int64()}
_SCHEMA = "owner long, block long, role int, id long, text_hash long, at long, stop long, words binary, keys binary, h long, g long"
#: Roles of rows: an owner's stretch, a partner's stretch, an open window, a span to remove.
HEAD, PARTNER, WINDOW, SPAN = range(4)


class _Rows:
    """Rows of _OUT: windows as arrays, all others one by one."""

    def __init__(self):
        self.other: list[dict] = []
        self.windows: list[tuple] = []
        self.bytes = 0

    def add(self, **row) -> None:
        self.other.append(row)
        self.bytes += 100 + len(row.get("words", b""))

    def add_windows(self, w: np.ndarray, at: np.ndarray, span: int, base: int, i: int, text_hash: int) -> None:
        """The open windows of span items of w at the positions at."""
        if len(at):
            h = gram_hashes(w, span)[at]
            g = _mixed(h ^ gram_hashes(w ^ np.uint64(0x5851F42D4C957F2D), span)[at])
            self.windows.append((np.full(len(at), i), np.full(len(at), text_hash), at + base, h.view(np.int64), g.view(np.int64)))
            self.bytes += 40 * len(at)

    def batch(self) -> pa.RecordBatch:
        columns = {k: pa.array([r.get(k) for r in self.other], t) for k, t in _OUT.items()}
        if self.windows:
            found = dict(zip(("id", "text_hash", "at", "h", "g"), map(np.concatenate, zip(*self.windows, strict=True)), strict=True))
            n = len(found["id"])
            found["role"] = np.full(n, WINDOW, np.int32)
            columns = {k: pa.concat_arrays([c, pa.array(found[k], _OUT[k]) if k in found else pa.nulls(n, _OUT[k])]) for k, c in columns.items()}
        self.__init__()
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_FULL = 4 << 20


def _stretches(dirty: DataFrame, span: int, anchor: int) -> DataFrame:
    """What each text with shared anchors sends: its stretch to each owner, its own to its
    partners' blocks, and its open windows."""

    def add(out: _Rows, hashes: dict, i: int, text: str, text_hash: int, known, owned, is_open, owners, blocks) -> None:
        words = text.encode().split()
        if len(words) < span:
            return
        w = _hashed(words, hashes)
        keys = anchors(w, span, anchor)
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[place] == keys
        owner = np.where(hit, owned[place], -1)
        out.add_windows(w, np.flatnonzero(hit & is_open[place]), span, 0, i, text_hash)
        for o in owners or ():
            at = np.flatnonzero(hit & (owner == o["owner"]))
            if len(at):
                a, b = int(at[0]), int(at[-1]) + span
                out.add(owner=o["owner"], block=o["block"], role=PARTNER, id=i, text_hash=text_hash, at=a, words=w[a:b].tobytes(), keys=np.unique(keys[at]).tobytes())
        if blocks:
            at = np.flatnonzero(hit & (owner == i))
            if len(at):
                stretch = w[int(at[0]) : int(at[-1]) + span].tobytes()
                for k in range(blocks):
                    out.add(owner=i, block=k, role=HEAD, words=stretch)

    def run(batches):
        hashes, out = WordHashes(), _Rows()
        for b in (x for batch in batches for x in slices(batch, "text")):
            # the anchors' lists stay arrays
            lists = [b.column(c) for c in ("anchors", "anchor_owners", "anchor_open")]
            ends = np.cumsum([0, *(len(x) for x in lists[0])])
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            for n, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "text", "text_hash")), strict=True)):
                part = slice(ends[n], ends[n + 1])
                add(out, hashes, *row, *(x[part] for x in flat), b.column("owners")[n].as_py(), b.column("blocks")[n].as_py())
                if out.bytes >= _FULL:
                    yield out.batch()
        yield out.batch()

    return dirty.select("id", "text", "text_hash", "anchors", "anchor_owners", "anchor_open", "owners", "blocks").mapInArrow(run, _SCHEMA)


def _match(sent: DataFrame, span: int, anchor: int) -> DataFrame:
    """Spans that partners share with their owner, and the windows left open."""
    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        at, automaton, out = None, None, _Rows()
        for b in (x for batch in batches for x in slices(batch, "words")):
            for owner, block, role, i, text_hash, base, stretch, own in zip(*(b.column(c).to_pylist() for c in ("owner", "block", "role", "id", "text_hash", "at", "words", "keys")), strict=True):
                w = np.frombuffer(stretch, np.uint64)
                if (owner, block) != at:
                    at, automaton = (owner, block), SuffixAutomaton()
                if role == HEAD:
                    automaton.add(w.tolist())
                    continue
                sizes = automaton.matches(w.tolist())
                for x, y in long_spans(sizes, span):
                    out.add(role=SPAN, id=i, text_hash=text_hash, at=base + x, stop=base + y)
                left = np.array(sizes[span - 1 :]) < span
                if left.any():
                    left &= np.isin(anchors(w, span, anchor), np.frombuffer(own, np.int64))
                    out.add_windows(w, np.flatnonzero(left), span, base, i, text_hash)
                if out.bytes >= _FULL:
                    yield out.batch()
        yield out.batch()

    return sent.filter(F.col("role") <= PARTNER).repartition(n, "owner", "block").sortWithinPartitions("owner", "block", "role").mapInArrow(run, _SCHEMA)


def repeated_spans(docs: DataFrame, span: int = 13, anchor: int = 8, least_shared: int = 3, block: int = 64) -> DataFrame:
    """(id, text_hash, spans array<struct<at, stop>>) of the texts that lose words, where docs is
    (id, text_hash, text) without nulls; positions are words, stop is exclusive."""
    anchored = cut(_anchor_rows(docs, span, anchor))
    shared = cut(anchored.groupBy("anchor").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner < last").select("anchor", "owner"))
    mine = cut(anchored.join(shared, "anchor"))
    pairs = cut(mine.filter("owner < id").groupBy("id", "owner").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_shared).select("id", "owner"))
    blocks = pairs.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    owners = pairs.join(blocks, "owner").groupBy("id").agg(F.collect_list(F.struct("owner", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))).alias("owners"))
    # an anchor is open if some later document has it but streams through no automaton for it
    paired = mine.join(pairs.withColumn("paired", F.lit(True)), ["id", "owner"], "left")
    loose = paired.filter("owner < id and paired is null").select("anchor", F.lit(True).alias("loose")).distinct()
    marked = paired.join(loose, "anchor", "left")
    is_open = F.coalesce("loose", F.lit(False)) & (F.col("paired").isNull())
    listed = F.array_sort(F.collect_list(F.struct("anchor", "owner", is_open.alias("open"))))
    info = marked.groupBy("id").agg(listed.alias("shared")).select("id", *(F.col(f"shared.{n}").alias(to) for n, to in (("anchor", "anchors"), ("owner", "anchor_owners"), ("open", "anchor_open"))))
    info = cut(info.join(owners, "id", "left").join(blocks.select(F.col("owner").alias("id"), "blocks"), "id", "left"))
    sent = cut(_stretches(docs.filter(IdFilter(info, "id")()).join(info, "id"), span, anchor))
    settled = cut(_match(sent, span, anchor))
    open_windows = sent.filter(F.col("role") == WINDOW).unionByName(settled.filter(F.col("role") == WINDOW)).select("h", "g", "id", "text_hash", "at")
    # cut, so that adaptive execution can split the join where a window is very common
    first = cut(open_windows.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("h", "g", "first"))
    late = open_windows.join(first, ["h", "g"]).filter("id > first").select("id", "text_hash", "at", (F.col("at") + span).alias("stop"))
    spans = settled.filter(F.col("role") == SPAN).select("id", "text_hash", "at", "stop").unionByName(late)
    return cut(spans.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("at", "stop"))).alias("spans")))


def _keep(batches):
    for b in (x for batch in batches for x in slices(batch, "text")):
        n, gone, texts = [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            words = text.encode().split()
            drop = bytearray(len(words))
            for s in spans or ():
                drop[s["at"] : s["stop"]] = b"\1" * (s["stop"] - s["at"])
            n.append(len(words))
            gone.append(sum(drop))
            texts.append(b" ".join([w for w, d in zip(words, drop, strict=True) if not d] if gone[-1] else words).decode())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, span: int = 13, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each of docs(doc_id, text); the kept words are
    joined by one space. Only texts that the filter of losing texts lets through are shuffled."""
    texts = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumns({"id": F.coalesce("doc_id", F.lit(_LAST)), "text_hash": F.xxhash64("text")})
    spans = repeated_spans(texts, span, **options)
    loses = IdFilter(spans, "id", "text_hash")
    clean = texts.filter(~loses()).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    found = texts.filter(loses()).join(spans, ["id", "text_hash"], "left").select(*clean.columns).unionByName(clean)
    return found.select("doc_id", "text", "spans").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_text string")
