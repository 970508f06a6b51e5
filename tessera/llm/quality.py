"""Operator 10: quality rules with risk-controlled thresholds.

Every document gets word and repetition counts over its whole text. A fixed base rule rejects
very short and very repetitive documents. Beyond it, the scores share one path of LEVELS cutoffs,
fixed beforehand, from lenient to strict in all scores at once; a document fails a level if any
score is above its cutoff there. The labelled good documents that pass the base rule are the
holdout. In each stratum (language) the levels are tested in the order of the path by an exact
binomial test that more than ``risk`` of good documents fail; the last level before the first
test that does not pass is the stratum's. Testing in a fixed order needs no correction inside a
stratum; over the strata (and the pool of all of them) the error ``delta`` is divided
(Bonferroni). So with probability 1 - delta no stratum with a level of its own loses more than
``risk`` of its good documents to the method.
A stratum with so few labels that no test could pass takes the pool's level, for which the
promise holds over the pool.

Defined results: null text counts as empty (no words, so base_failed); a null or unlabelled
stratum takes the pool's level; without labels there are no cutoffs and only the base rule holds;
repeated rows are judged one by one; several labels of one document count as good only if all
say so; null doc_ids are judged but never matched with a label; a doc_id that is no number counts
as null; texts of any length are measured whole, in slices bounded by bytes; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, cut, lookup, masked, slices, unmasked

WINDOW = 8
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Steps of the path, and each score's cutoffs at its first and last step; those between are at even ratios.
LEVELS = 24
ENDS = {"symbol_share": (2.0, 0.05), "dup_lines_per_word": (0.5, 0.01), "repeat_share": (0.3, 0.1), "word_length": (20.0, 6.0)}
PATH = {s: [a * (b / a) ** (t / (LEVELS - 1)) for t in range(LEVELS)] for s, (a, b) in ENDS.items()}
_CHUNK_WORDS = 100_000


def _repeat_words(ids: list[list[int]]) -> list[int]:
    """Of each list: the positions in windows of WINDOW items that occur twice or more in it.
    Windows are named exactly, by ranking pairs of ranks: 1, 2, 4, then 8 items."""
    lens = np.array([len(x) for x in ids])
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(lens.sum()))
    doc = np.repeat(np.arange(len(ids)), lens)
    rank, span = flat, 1
    while span < WINDOW:
        if len(rank) <= span:
            return [0] * len(ids)
        rank = np.unique(rank[:-span] * (int(rank.max()) + 1) + rank[span:], return_inverse=True)[1]
        span *= 2
    whole = doc[: len(rank)] == doc[WINDOW - 1 :]
    names, at, counts = np.unique(rank[whole], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(whole)[counts[at] > 1]
    step = np.zeros(len(flat) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=len(ids)).tolist()


def text_metrics(texts: list[str | None]) -> list[list[int]]:
    """The METRICS of each text, as columns."""
    out: list[list[int]] = [[], [], [], [], []]
    ids: list[list[int]] = []
    base = held = 0
    for text in texts:
        text = text or ""
        words = text.encode().split()
        # names start anew beyond those of earlier documents: windows never match across documents
        names: dict[bytes, int] = {}
        ids.append([base + names.setdefault(w, len(names)) for w in words])
        base += len(names)
        held += len(words)
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        out[0].append(len(words))
        out[1].append(len(text) - sum(map(text.count, SPACES)))
        out[2].append(sum(map(text.count, "#*$%&|<>")))
        out[3].append(len(lines) - len(set(lines)))
        if held >= _CHUNK_WORDS:
            out[4] += _repeat_words(ids)
            ids, base, held = [], 0, 0
    out[4] += _repeat_words(ids) if ids else []
    return out


def _adder(keep: list[str], text: str):
    def add(batches):
        for batch in batches:
            for b in slices(batch, text):
                columns = text_metrics(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(c, pa.int64()) for c in columns], [*keep, *METRICS])

    return add


def _scores() -> dict:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_share": F.col("n_symbols") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def _measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.mapInArrow(_adder(keep, text), ", ".join([*fields, *(f"{m} long" for m in METRICS)]))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, METRICS) of each row of docs(doc_id, text, lang)."""
    return _measured(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), ["doc_id", "lang"])


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in i]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose_level(n: int, failed: list[int], risk: float, error: float) -> int:
    """The last level before the first whose exact test does not pass, -1 if none passes.
    failed[t] of n good documents fail level t."""
    for t, k in enumerate(failed):
        if n == 0 or binomial_cdf(k, n, risk) > error:
            return t - 1
    return len(failed) - 1


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _first_failed() -> Column:
    """The first level of the path that a document fails, LEVELS if it passes all."""
    passed = lambda score, cutoffs: F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: score <= c))
    return F.least(*(passed(score, PATH[name]) for name, score in _scores().items()))


def fit_levels(metrics: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, level) from the labelled good documents; the null stratum is the pool. Counts
    are one aggregation over all of them; what reaches Python is one row per stratum."""
    good = labels.groupBy(F.col("doc_id").try_cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = metrics.filter(~_base_failed()).join(good, "doc_id").select("lang", _first_failed().alias("level"))
    # once for the stratum, once for the pool
    twice = held.select("level", F.explode(F.array_distinct(F.array("lang", F.lit(None).cast("string")))).alias("stratum"))
    counts = cut(twice.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("level") <= t).alias(f"failed_{t}") for t in range(LEVELS))))
    error = delta / max(1, counts.count())

    def choose(batches):
        for b in batches:
            found = [(r["stratum"], None if r["stratum"] is not None and (1 - risk) ** r["n"] > error else choose_level(r["n"], [r[f"failed_{t}"] for t in range(LEVELS)], risk, error)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], ["stratum", "level"])

    return cut(counts.mapInArrow(choose, "stratum string, level int").filter("level is not null"))


def judge(measured: DataFrame, levels: DataFrame) -> DataFrame:
    """Add base_failed and kept to rows that have lang and METRICS."""
    pool = levels.filter("stratum is null").first()
    own = lookup(levels.filter("stratum is not null").select(F.col("stratum").alias("_stratum"), F.col("level").alias("_level")))
    joined = measured.join(own, F.col("lang") == F.col("_stratum"), "left")
    level = F.coalesce("_level", F.lit(pool["level"] if pool else -1))
    return joined.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & (_first_failed() > level)).drop("_stratum", "_level")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(doc_id, lang, METRICS, base_failed, kept), one row for each of docs(doc_id, text, lang)."""
    metrics = cut(measure(docs))
    return judge(metrics, fit_levels(metrics, labels, risk, delta))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their columns. Texts are measured once and
    written beside their metrics, where the filter then reads them; they are never shuffled."""
    plain, names = masked(docs)
    measured = cut(_measured(plain, plain.columns, names["text"]))
    named = {"doc_id": F.col(names["doc_id"]).try_cast("long"), "lang": F.col(names["lang"]).cast("string")}
    levels = fit_levels(measured.select(*(c.alias(n) for n, c in named.items()), *METRICS), labels, risk, delta)
    return unmasked(judge(measured.withColumn("lang", named["lang"]), levels).filter("kept"), names)
