"""Operator 13: embedding whitening by a weighted multiplicity covariance.

Every entry c of a vector becomes the integer x = floor(1024 c) + 100000. Identical x vectors are
grouped, with their number as weight in the fit (or one, which fits the distinct vectors). The
weighted sums are exact integers; the covariance is a weighted matrix product of the vectors
centred at the exact mean (the integer part taken off as an integer, the rest as a fraction),
one per task, and the tasks' products are added up row by row of the matrix. Its leading
eigenvectors whiten each distinct vector once; the rows get the result by a join on a 128-bit
digest of x. Vectors that make up more than 1/1024 of all rows, which are fewer than 1024, are
joined by a broadcast, so that no task gets the rows of a hot one.

Defined results: rows whose vector is null, or has a null or non-finite entry, are dropped;
entries beyond 2^40 either way count as 2^40; vectors of another length than the commonest (the
shorter of equally common ones) take no part in the fit and get one row whose values are null, and
so do empty vectors; a component without variance (a rounding error of the trace) has null in
whitened and does not count for identity_error, which is null if there is none; a deviation
beyond a long is null; equal and null ids each have their rows; extra columns are ignored; an
empty table gives an empty result. A model is the square of a vector's length in doubles, held by
each task and the driver. Summing doubles in another order can change the last bits between runs.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**40
#: A vector is hot if it is more than this part of all rows.
HOT = 1 / 1024
#: Rows of a matrix at a time.
ROWS = 4096


def _integers(vector: str) -> Column:
    clear = F.transform(vector, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c.cast("double"))))
    return F.transform(clear, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))


def _finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))


def _blocks(batches, d: int):
    """(x as rows, weights) of Arrow batches with x and w."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d), part.column("w").to_numpy(zero_copy_only=False), part


def _exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    if len(x) and float(np.abs(x).max()) * float(w.sum()) < 2.0**62:
        return [int(s) for s in (x * w[:, None]).sum(0)]
    return [int(s) for s in (x.astype(object) * w.astype(object)[:, None]).sum(0)]


def _sums(distinct: DataFrame, d: int) -> list[int]:
    """The weighted sum of each dimension, exact."""

    def run(batches):
        total = [0] * d
        for x, w, _ in _blocks(batches, d):
            total = [a + b for a, b in zip(total, _exact_sums(x, w), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "s": pa.array(list(map(str, total)))})

    rows = distinct.select("x", "w").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return [int(r["s"]) for r in sorted(rows.collect())]


class Model:
    """The exact mean of n vectors and their leading components."""

    def __init__(self, sums: list[int], n: int):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s - s // n * n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def fit(self, covariance: np.ndarray, components: int) -> None:
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors = values[order], vectors[:, order]
        trace = float(np.trace(covariance))
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        self.vectors = vectors * np.where(signs == 0, 1, signs)
        self.varies = values > trace * len(covariance) * 1e-14 if trace > 0 else np.zeros(len(values), bool)
        self.values = np.where(self.varies, values, np.nan)
        self.explained = [float(v) / trace if ok else 0.0 for v, ok in zip(values, self.varies, strict=True)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S)^2) of each row, exact; None where a long cannot hold it."""
        off = x - self.whole
        if self.n * (float(np.abs(off).max(initial=0)) + 1) < isqrt((1 << 62) // x.shape[1]):
            return ((self.n * off - self.rest) ** 2).sum(1).tolist()
        exact = ((self.n * off.astype(object) - self.rest.astype(object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact.tolist()]


def _covariance(distinct: DataFrame, d: int, model: Model) -> np.ndarray:
    def products(batches):
        total = np.zeros((d, d))
        for x, w, _ in _blocks(batches, d):
            c = model.centred(x)
            total += (c * w[:, None]).T @ c
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "line": pa.array(list(total), pa.list_(pa.float64()))})

    def added(table: pa.Table) -> pa.Table:
        lines = table.column("line").combine_chunks().flatten().to_numpy().reshape(-1, d)
        return pa.table({"i": table.column("i").slice(0, 1), "line": pa.array([lines.sum(0)], pa.list_(pa.float64()))})

    rows = distinct.select("x", "w").mapInArrow(products, "i int, line array<double>").groupBy("i").applyInArrow(added, "i int, line array<double>")
    return np.array([r["line"] for r in sorted(rows.collect())]) / model.n


def _identity_error(done: DataFrame, model: Model) -> float | None:
    """Largest entry of the covariance of the whitened vectors minus the identity."""
    used = [int(i) for i in np.flatnonzero(model.varies)]
    if not used:
        return None
    y = {i: F.col("whitened")[i] for i in used}
    mean = done.agg(*(F.sum(y[i] * F.col("w")).alias(str(i)) for i in used)).first()
    off = {i: y[i] - F.lit(mean[str(i)] / model.n) for i in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    both = done.agg(*(F.sum(off[i] * off[j] * F.col("w")).alias(f"{i}_{j}") for i, j in pairs)).first()
    return max(abs(both[f"{i}_{j}"] / model.n - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = 8, weights: str = "counts", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of vectors(vec_id, embedding):
    n is the sum of the weights ("counts", or "one" for each distinct vector), whitened and
    explained are arrays over the components."""
    if weights not in ("counts", "one"):
        raise ValueError(f"weights: {weights}")
    rows = vectors.filter(_finite(vector)).select(F.col(vec_id).alias("vec_id"), _integers(vector).alias("x"))
    rows = rows.withColumns({"h": F.xxhash64("x"), "g": F.xxhash64(F.lit(1), "x")})
    distinct = cut(rows.groupBy("h", "g", "x").agg(F.count(F.lit(1)).alias("number")))
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("number").alias("number"), F.count(F.lit(1)).alias("kinds"))
    common = sizes.filter("d > 0").orderBy(F.desc("number"), "d").first()
    total = sizes.agg(F.sum("number")).first()[0] or 0
    kind = dict(rows.dtypes)["vec_id"]
    if common is None:
        return rows.select("vec_id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("array<double>").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    d, n = common["d"], common["number" if weights == "counts" else "kinds"]
    fitted = distinct.filter(F.size("x") == d).withColumn("w", F.col("number") if weights == "counts" else F.lit(1).cast("long"))
    model = Model(_sums(fitted, d), n)
    model.fit(_covariance(fitted, d, model), min(components, d))

    def run(batches):
        for x, _, part in _blocks(batches, d):
            y = model.whitened(x)
            y = pa.array([[None if np.isnan(v) else v for v in line] for line in y.tolist()] if not model.varies.all() else list(y), pa.list_(pa.float64()))
            columns = [*(part.column(c) for c in ("h", "g", "number", "w")), pa.array(model.deviations(x), pa.int64()), y]
            yield pa.RecordBatch.from_arrays(columns, ["h", "g", "number", "w", "deviation", "whitened"])

    done = cut(fitted.mapInArrow(run, "h long, g long, number long, w long, deviation long, whitened array<double>"))
    error = _identity_error(done, model)
    found = ["h", "g", "deviation", "whitened"]
    hot = F.broadcast(done.filter(F.col("number") > total * HOT).select(*found))
    keys = rows.select("vec_id", "h", "g")
    often = keys.join(hot, ["h", "g"])
    rest = keys.join(hot, ["h", "g"], "left_anti").join(done.filter(F.col("number") <= total * HOT).select(*found), ["h", "g"], "left")
    out = often.unionByName(rest)
    fits = F.col("whitened").isNotNull()
    constant = lambda x, kind: F.when(fits, F.lit(x).cast(kind))
    return out.select(F.col("vec_id").cast(kind).alias("vec_id"), constant(n, "long").alias("n"), "deviation", "whitened", F.when(fits, F.array(*map(F.lit, model.explained))).alias("explained"), constant(error, "double").alias("identity_error"))
