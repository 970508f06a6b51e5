"""Operator 9: document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (LZ78: each phrase is the longest earlier phrase plus
one code point). The set of phrases is hashed, and the fingerprint is the k smallest hashes.
Two fingerprints give the likeness |A and B| / |A or B| of the phrase sets, estimated on the k
smallest hashes of the union; it is exact for sets of up to k phrases.

Defined results: null text counts as empty and has the empty fingerprint; two empty fingerprints
have likeness 1, an empty and another one 0; texts of any length are parsed whole;
a doc_id that is no number counts as null; equal texts have equal fingerprints; rows follow
each other by descending doc_id, then text, nulls last, and the first follows the last; a single
row is its own next document; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices

SIZE = 64
_BASE = 0x9E3779B97F4A7C15 | 1


def parse(text: str, start: int = 0, known: set | None = None, open_phrase: str = "") -> tuple[list[int], str]:
    """Ends of the phrases completed in text[start:], and the open phrase at its end, which is
    empty or a known phrase. known holds the phrases so far and receives the new ones;
    open_phrase is what an earlier call left open just before start."""
    known = set() if known is None else known
    ends, add, end, phrase = [], known.add, start, open_phrase
    for point in text[start:] if start else text:
        phrase += point
        end += 1
        if phrase not in known:
            add(phrase)
            ends.append(end)
            phrase = ""
    return ends, phrase


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n + 1, _BASE, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(1 << 16)


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases that end at ends, each starting where the one before ends:
    polynomial sums over the code points, mixed with the length."""
    global _POWERS
    if not ends:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)[: ends[-1]].astype(np.uint64)
    points += np.uint64(1)
    if len(points) >= len(_POWERS):
        _POWERS = _powers(2 * len(points))
    stop = np.array(ends)
    start = np.concatenate([[0], stop[:-1]])
    size = stop - start
    # each point times a power for its offset in the phrase
    x = np.add.reduceat(points * _POWERS[np.arange(len(points)) - np.repeat(start, size)], start)
    x ^= size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(32)).astype(np.uint32)


def smallest(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The size smallest distinct hashes, ascending."""
    return np.unique(hashes)[:size]


def fingerprint(text: str | None, size: int = SIZE) -> np.ndarray:
    text = text or ""
    return smallest(phrase_hashes(text, parse(text)[0]), size)


class Parsed:
    """A text whose parse is kept at the start of its last third, so that the edited text is
    parsed from there and not from its start."""

    def __init__(self, text: str):
        self.text = text
        self.cut = len(text) - len(text) // 3
        self._known: set[str] = set()
        self._ends, self._open = parse(text[: self.cut], 0, self._known)
        tail, _ = parse(text, self.cut, set(self._known), self._open)
        hashes = phrase_hashes(text, self._ends + tail)
        self._head = hashes[: len(self._ends)]
        self.mark = smallest(hashes)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The edited text and its fingerprint; may be called once."""
        new = edited(self.text, following)
        if new == self.text:
            return new, self.mark
        tail, _ = parse(new, self.cut, self._known, self._open)
        # the first phrase of the tail starts where the head's last one ended
        begin = self._ends[-1] if self._ends else 0
        rest = phrase_hashes(new[begin:], [e - begin for e in tail])
        return new, smallest(np.concatenate([self._head, rest]))


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(both, union[-1], side="right")) / len(union)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first code points of following."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compare(doc_id: int | None, doc: Parsed, following: str, next_mark: np.ndarray) -> tuple:
    """The row of a document, given the next one."""
    new, new_mark = doc.edited(following)
    return doc_id, len(doc.text), hashlib.sha256(new.encode()).hexdigest(), doc.mark.tobytes(), new_mark.tobytes(), likeness(doc.mark, new_mark), likeness(doc.mark, next_mark)


def _walk(batches):
    """Rows of one range partition in order: each is compared with the one after it. The first
    and the last row are also given with their texts (edge 1 and 2), to be compared across
    partitions. One row is held at a time."""
    held: tuple[int | None, Parsed] | None = None

    def batch(rows: list[tuple], edges: list[tuple]):
        columns = [pa.array([r[i] for r in rows] + [e[0] if i == 0 else None for e in edges], t) for i, t in enumerate(_TYPES)]
        more = [pa.array([0] * len(rows) + [e[2] for e in edges], pa.int32()), pa.array([None] * len(rows) + [e[1] for e in edges], pa.string())]
        return pa.RecordBatch.from_arrays(columns + more, [*_COLUMNS, "edge", "text"])

    for b in (x for batch in batches for x in slices(batch, "text")):
        rows, edges = [], []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            text = text or ""
            if held is None:
                edges.append((doc_id, text, 1))
            doc = Parsed(text)
            if held:
                rows.append(compare(*held, text, doc.mark))
            held = (doc_id, doc)
        yield batch(rows, edges)
    if held:
        yield batch([], [(held[0], held[1].text, 2)])


def _across(batches):
    for b in batches:
        rows = [compare(d, Parsed(t), f, fingerprint(f)) for d, t, f in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "following")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], list(_COLUMNS))


def fingerprint_chain(docs: DataFrame) -> DataFrame:
    """One row for each of docs(doc_id, text): its fingerprint, that of its edited text (the
    last third replaced by the start of the next document) and the likenesses. Texts are
    shuffled once, into ranges of descending doc_id (rows of one doc_id, or of none, into ranges
    of their texts' beginnings); only the two edge rows of each range are handled apart."""
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    n = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2)
    # ~doc_id descends without overflow; nulls come last
    docs = docs.withColumns({"place": F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)), "start": F.coalesce(F.substring("text", 1, 64), F.lit(""))})
    walked = docs.repartitionByRange(n, "place", "start").sortWithinPartitions("place", F.coalesce("text", F.lit(""))).select("doc_id", "text").mapInArrow(_walk, _SCHEMA + ", edge int, text string")
    walked = cut(walked.withColumn("part", F.spark_partition_id()))
    # two rows for each range that has rows; only the ranges' numbers are put in order
    ends = walked.filter("edge > 0").groupBy("part").agg(
        F.max(F.when(F.col("edge") == 1, F.col("text"))).alias("first"), F.max_by("text", F.col("edge")).alias("text"), F.max_by("doc_id", F.col("edge")).alias("doc_id")
    )
    ring = Window.orderBy("part")
    least = F.first("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    numbers = walked.filter("edge = 2").select("part").withColumn("next", F.coalesce(F.lead("part").over(ring), least))
    across = ends.join(numbers, "part").join(ends.select(F.col("part").alias("next"), F.col("first").alias("following")), "next").select("doc_id", "text", "following")
    out = walked.filter("edge = 0").select(*_COLUMNS).unionByName(across.mapInArrow(_across, _SCHEMA))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
