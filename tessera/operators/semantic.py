"""A trained encoder: texts as TF-IDF of their words, projected on its leading right singular
vectors, so that texts of one subject are near even where they share few words.

Words are hashed into BUCKETS, the model's fixed size, and counted once a text (``count``). Document
frequencies are those of all texts. The singular vectors come from randomized subspace iteration
over all distinct texts: in each round the partitions multiply their sparse rows with the shared
basis and its result with their transposed rows; the products, at most BUCKETS x (width + extra)
numbers a task, are added as they arrive, and the driver orthonormalizes the sum (thin QR), whose
size is fixed. The last round's small symmetric matrix gives the singular vectors (Rayleigh-Ritz).
Tasks grow in number with the entries of the rows (PARTS at least, 2^24 entries in each), so the
products do not outgrow the rows.

Null texts count as empty; a text without words, or a model of no texts, gives zeros; texts of
any length are taken whole."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, ShortType

from tessera.lineage import cut, scratch

BUCKETS, BLOCKS, PARTS = 1 << 15, 64, 8
#: Buckets whose sums go together.
_GROUP = 8
_WORD = re.compile(r"\w+")
#: Entries, and rows, that are multiplied at once, as a dense matrix of the buckets they have.
_SLICE, _ROWS = 1 << 14, 64
#: Entries after which a batch of sparse rows is full.
_FULL = 1 << 19


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class _Buckets(dict):
    """What stands between white space to the bucket of its word, -1 unless it has just one; at
    most 2^17 of at most 32 characters are remembered."""

    def __missing__(self, token: str) -> int:
        words = _WORD.findall(token)
        out = _bucket(words[0]) if len(words) == 1 else -1
        if len(token) <= 32 and len(self) < 1 << 17:
            self[token] = out
        return out


_buckets = _Buckets()


def _entries(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words, rising, and how often each occurs."""
    tokens = Counter((text or "").lower().split())
    found, counts = np.fromiter(map(_buckets.__getitem__, tokens), np.int64, len(tokens)), np.fromiter(tokens.values(), np.float64, len(tokens))
    if len(found) and found.min() < 0:
        # no word, or several
        more = [(_bucket(w), n) for (t, n), b in zip(tokens.items(), found, strict=True) if b < 0 for w in _WORD.findall(t)]
        kept = found >= 0
        found, counts = (np.concatenate([x[kept], np.array(y, x.dtype)]) for x, y in ((found, [b for b, _ in more]), (counts, [n for _, n in more])))
    order = np.argsort(found)
    found, counts = found[order], counts[order]
    starts = np.flatnonzero(np.diff(found, prepend=-1))
    return found[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _slices(ends: np.ndarray):
    """Ranges of rows with about _SLICE entries together, at least one row each and at most _ROWS."""
    a = 0
    while a < len(ends) - 1:
        b = min(a + _ROWS, max(a + 1, int(np.searchsorted(ends, ends[a] + _SLICE, "right")) - 1))
        yield a, b
        a = b


def _weights(buckets: np.ndarray, counts: np.ndarray, rows: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """The TF-IDF of the entries of n rows, each row of length one; rows is the row of each entry."""
    w = (1 + np.log(counts)) * idf[buckets]
    size = np.sqrt(np.bincount(rows, w * w, n))
    return w / np.where(size, size, 1)[rows]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a column of lists, and where each list ends, from 0."""
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


class LatentEncoder:
    """Texts to rows of ``width`` numbers; picklable, about 10 MB at the usual width."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray):
        self.idf, self.basis = idf.astype(np.float32), basis.astype(np.float32)

    def row(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The row of a text with these entries, alike wherever the text stands."""
        w, out = (1 + np.log(counts)) * self.idf[buckets], np.zeros(self.basis.shape[1])
        size = np.sqrt(w @ w)
        if size:
            w /= size
        for at in range(0, len(buckets), _SLICE):
            out += w[at : at + _SLICE] @ self.basis[buckets[at : at + _SLICE]]
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(*_entries(t)) for t in texts]).reshape(len(texts), self.basis.shape[1])


def count(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with, in place of the text, its digest and its words' buckets, rising, and counts."""
    others, whole = [c for c in texts.columns if c != text], F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = texts.select(*others, F.unhex(F.md5(whole)).alias("digest"), whole.alias("_text"))

    def lists(found: list, at: int, kind: type) -> pa.Array:
        ends = np.cumsum([0, *(len(x[at]) for x in found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x[at] for x in found]).astype(kind)))

    def run(batches):
        for b in batches:
            kept, found, held = b.select([*others, "digest"]), [], 0
            for i, t in enumerate(b.column("_text"), 1):
                found.append(_entries(t.as_py()))
                held += len(found[-1][0])
                if held >= _FULL or i == b.num_rows:
                    columns = [*kept.slice(i - len(found), len(found)).columns, lists(found, 0, np.int16), lists(found, 1, np.int32)]
                    yield pa.RecordBatch.from_arrays(columns, [*others, "digest", "buckets", "counts"])
                    found, held = [], 0

    return rows.mapInArrow(run, rows.drop("_text").schema.add("buckets", ArrayType(ShortType())).add("counts", ArrayType(IntegerType())))


def encode(counted: DataFrame, load: Callable[[], LatentEncoder]) -> DataFrame:
    """Counted texts with the normalised embedding in place of the entries, that of vector.embed
    for the text; load runs once in each task."""
    others = [c for c in counted.columns if c not in ("digest", "buckets", "counts")]

    def run(batches):
        model = load()
        for b in batches:
            (buckets, ends), counts = _lists(b.column("buckets")), _lists(b.column("counts"))[0]
            x = np.array([model.row(buckets[i:j].astype(np.int64), counts[i:j].astype(np.float64)) for i, j in pairwise(ends)]).reshape(b.num_rows, model.basis.shape[1])
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0).astype(np.float32)
            made = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.select(others).columns, made], [*others, "embedding"])

    return counted.mapInArrow(run, counted.select(*others).schema.add("embedding", ArrayType(FloatType())))


def _frequencies(batches):
    n, found = 0, np.zeros(BUCKETS, np.int64)
    for b in batches:
        found += np.bincount(b.column(0).flatten().to_numpy(), minlength=BUCKETS)
        n += b.num_rows
    at = np.flatnonzero(found)
    # bucket -1: the number of texts
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(found[at], n), pa.int64())], ["bucket", "n"])


def _gram(sparse: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The transposed TF-IDF rows times the rows times the basis."""
    k, groups = basis.shape[1], BUCKETS // _GROUP
    shared = sparse.sparkSession.sparkContext.broadcast((idf, basis.astype(np.float32)))

    def sums(total: np.ndarray, kind: type) -> pa.RecordBatch:
        total = total.reshape(groups, -1)
        at = np.flatnonzero(total.any(1))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([x.tobytes() for x in total[at].astype(kind)], pa.binary())], ["group", "part"])

    def multiply(batches):
        (idf, basis), total, place = shared.value, np.zeros((BUCKETS, k)), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            (buckets, ends), counts = _lists(batch.column("buckets")), _lists(batch.column("counts"))[0]
            for a, b in _slices(ends):
                own, rows = buckets[ends[a] : ends[b]].astype(np.int64), np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                used = np.flatnonzero(np.bincount(own, minlength=BUCKETS))
                place[used] = np.arange(len(used))
                dense = np.zeros((b - a, len(used)), np.float32)
                dense[rows, place[own]] = _weights(own, counts[ends[a] : ends[b]], rows, b - a, idf)
                total[used] += dense.T @ (dense @ basis[used])
        yield sums(total, np.float32)

    def add(batches):
        total = np.zeros((groups, _GROUP * k))
        for batch in batches:
            for group, part in zip(batch.column("group").to_pylist(), batch.column("part"), strict=True):
                total[group] += np.frombuffer(part.as_buffer(), np.float32)
        yield sums(total, np.float64)

    out = np.zeros((groups, _GROUP * k))
    for group, part in sparse.mapInArrow(multiply, "group int, part binary").repartition("group").mapInArrow(add, "group int, part binary").collect():
        out[group] = np.frombuffer(part, np.float64)
    shared.destroy()
    return out.reshape(BUCKETS, k)


def fit_counted(counted: DataFrame, width: int = 64, extra: int = 16, rounds: int = 2, seed: int = 0) -> LatentEncoder:
    """The encoder of counted texts; counted is read twice."""
    found = {r[0]: r[1] for r in counted.select("buckets").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()}
    n, seen = found.pop(-1, 0), np.zeros(BUCKETS)
    seen[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + seen))
    with scratch(counted.sparkSession):
        sparse = cut(counted.dropDuplicates(["digest"]).select("buckets", "counts")).coalesce(max(PARTS, int(seen.sum()) >> 24))
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, width + extra)))[0]
        for _ in range(rounds):
            basis = np.linalg.qr(_gram(sparse, idf, basis))[0]
        _, turn = np.linalg.eigh(basis.T @ _gram(sparse, idf, basis))
    return LatentEncoder(idf, basis @ turn[:, ::-1][:, :width])


def fit(texts: DataFrame, text: str = "text", **options) -> LatentEncoder:
    """The encoder of these texts; options are those of fit_counted."""
    with scratch(texts.sparkSession):
        return fit_counted(cut(count(texts.select(text), text)), **options)


def save(spark: SparkSession, model: LatentEncoder, folder: str) -> None:
    per = BUCKETS // BLOCKS
    rows = [(i, bytearray(model.idf[i * per : (i + 1) * per].tobytes()), bytearray(model.basis[i * per : (i + 1) * per].tobytes())) for i in range(BLOCKS)]
    spark.createDataFrame(rows, "block int, idf binary, basis binary").write.parquet(folder)


def load(spark: SparkSession, folder: str) -> LatentEncoder:
    rows = sorted(spark.read.schema("block int, idf binary, basis binary").parquet(folder).collect())
    idf, basis = (np.frombuffer(b"".join(bytes(r[i]) for r in rows), np.float32) for i in (1, 2))
    return LatentEncoder(idf, basis.reshape(BUCKETS, -1))
