"""Operator 5: mixing sources to target weights by Sainte-Lague apportionment.

Sources in code point order (null last) get the weights 3, 1, 2, repeating, and share a total of
``ratio`` times all words. A target stops at ``most`` times its source's size; the excess goes
to the others by weight until no target is above (water filling). Each source is dealt over
seeded shards of about ``shard_words`` words, and each shard is cut into blocks of ``block_words``
words (its last one may be shorter). Sainte-Lague then gives the blocks that all targets hold
together, floor(sum of targets / block_words), one by one to the shard with the highest quotient
w / (k - 1/2), where w is the shard's part of its source's target and k - 1 the blocks it has; no
shard gets more than ``most`` times its blocks. These quotas are found by narrowing the divisor,
32 values in one aggregation over the shards, and ties go by source, then shard.
Of its n blocks a quota q takes all of them q div n times and r = q mod n of them once more: the
blocks i with (i * r + seed) mod n < r, which are exactly r for any n, at even distances over the
whole shard from a seeded start, and need no sort and no list of blocks. Blocks run over the words
of the shard's documents in order of doc_id.

Defined results: null text counts as empty (size 0, taken 0); a null source is a source of its
own, after all others; a source without words has target 0; a null doc_id is dealt by its text;
repeated rows are documents of their own; ties in doc_id are ordered by size, which leaves the
rows' results the same set; texts of any length are taken whole, over as many blocks as they have
words for; a doc_id that is no number counts as null; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, lookup, masked, n_words, unmasked


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source: these
    few sums are ordered in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("w", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    # sources in order of cap / weight: up to some place they are full, the rest share what is left
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("_total", ratio * F.sum("source_size").over(every))
    w = w.withColumn("_left", F.col("_total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("_weights", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = F.max(F.when(F.col("cap") / F.col("w") >= F.col("_left") / F.col("_weights"), F.struct(F.col("cap") / F.col("w"), F.col("_left") / F.col("_weights")).getField("col2"))).over(every)
    # the first place whose cap is not reached sets the level; later places give none above it
    return w.withColumn("_level", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("_level") * F.col("w"), F.col("cap"))).alias("target"))


def quotas(parties: DataFrame, seats: int, *order: Column, points: int = 32) -> DataFrame:
    """parties(weight, most, ...) plus quota: so many seats given by the highest quotients
    weight / (k - 1/2), most to one party at most; ties go by order. parties must be cut and
    hold room for the seats."""
    at = lambda d: F.least(F.col("most"), F.floor(F.col("weight") / d + 0.5))
    given = lambda ds: [x or 0 for x in parties.agg(*(F.sum(at(d)).alias(f"n{i}") for i, d in enumerate(ds))).first()]
    top = parties.agg(F.max("weight")).first()[0] or 0.0
    if not seats or not top:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    # quotients of high and more are less than the seats, those of low and more are enough
    high, low, enough = 3.0 * top, top / 2, 0
    while True:
        tries = [low / 1000.0**k for k in range(points)]
        found = given(tries)
        k = next((k for k, n in enumerate(found) if n >= seats), None)
        if k is None:
            low = tries[-1] / 1000.0
            continue
        high, low, enough = (tries[k - 1] if k else high), tries[k], found[k]
        break
    while enough > seats:
        tries = sorted({high * (low / high) ** (k / (points + 1)) for k in range(1, points + 1)} - {high, low}, reverse=True)
        tries = [d for d in tries if low < d < high]
        if not tries:
            break
        found = given(tries)
        k = next((k for k, n in enumerate(found) if n >= seats), len(tries))
        high = tries[k - 1] if k else high
        if k < len(tries):
            low, enough = tries[k], found[k]
    if enough == seats:
        return parties.withColumn("quota", at(low))
    # no number lies between high and low: their quotients are tied
    short = seats - given([high])[0]
    tied = parties.filter(at(low) > at(high)).orderBy(*order).limit(short).select(*parties.columns, (at(high) + 1).alias("quota"))
    names = [c for c in parties.columns if c not in ("weight", "most")]
    keyed = tied.select(*(F.col(n).alias(f"_{n}") for n in names), F.col("quota").alias("_quota"))
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return parties.join(keyed, on, "left").select(*parties.columns, F.coalesce("_quota", at(high)).alias("quota"))


def _placed(sized: DataFrame, block_words: int, shard_words: int, most: float, seed: int) -> DataFrame:
    """sized (deal, doc_id, source, size) plus source_size, target, shard_size, first, n, quota and
    shift: a document covers the words from first on of a shard of n blocks."""
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = cut(targets(sources, most=most))
    near = lookup(goal.withColumnRenamed("source", "_source"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    dealt = sized.join(near, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", F.pmod(F.xxhash64("deal", F.lit(seed)), shards))
    n = F.greatest(F.ceil(F.col("shard_size") / block_words), F.lit(1))
    parties = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    weight = F.coalesce(F.col("target") * F.col("shard_size") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    parties = cut(parties.select("source", "shard", "shard_size", n.alias("n"), weight.alias("weight"), F.floor(most * n).alias("most")))
    seats = int((goal.agg(F.sum("target")).first()[0] or 0.0) / block_words)
    given = cut(quotas(parties, seats, F.col("source").asc_nulls_last(), F.col("shard")))
    given = given.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "n", "quota")
    order = Window.partitionBy("source", "shard").orderBy(F.col("doc_id").asc_nulls_last(), "size", "deal")
    placed = dealt.withColumn("first", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(lookup(given), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")
    part = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "shard")
    return placed.withColumn("shift", F.pmod(F.xxhash64(part, F.lit(seed)), "n"))


def _picked(block: Column) -> Column:
    rest = F.col("quota") % F.col("n")
    return F.pmod(block * rest + F.col("shift"), F.col("n")) < rest


def mix(docs: DataFrame, block_words: int = 32, shard_words: int = 1 << 20, most: float = 2.0, seed: int = 5) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes) for each of
    docs(doc_id, text, source): taken counts the words of the document in the mix, repeats
    included, and passes has one array of [from, to) word ranges for each time it is passed."""
    doc_id = F.col("doc_id").try_cast("long")
    sized = cut(docs.select(F.coalesce(doc_id, F.xxhash64("text")).alias("deal"), doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")))
    placed = _placed(sized, block_words, shard_words, most, seed)
    whole = F.floor(F.col("quota") / F.col("n")).cast("long")
    end = F.col("first") + F.col("size")
    blocks = F.sequence(F.floor(F.col("first") / block_words), F.floor((end - 1) / block_words))
    chosen = F.when(F.col("size") > 0, F.filter(blocks, _picked)).otherwise(F.array().cast("array<long>"))
    picked = placed.withColumn("chosen", chosen)
    start, stop = (lambda i: F.greatest(i * block_words, F.col("first")) - F.col("first")), (lambda i: F.least((i + 1) * block_words, end) - F.col("first"))
    taken = F.col("size") * whole + F.aggregate("chosen", F.lit(0).cast("long"), lambda s, i: s + stop(i) - start(i))
    passes = F.concat(
        F.array_repeat(F.array(F.array(F.lit(0).cast("long"), F.col("size"))), whole.cast("int")),
        F.when(F.size("chosen") > 0, F.array(F.transform("chosen", lambda i: F.array(start(i), stop(i))))).otherwise(F.array().cast("array<array<array<long>>>")),
    )
    return picked.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, passes).otherwise(F.array().cast("array<array<array<long>>>")).alias("passes"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def selected_text(text: str, ranges: list[list[int]]) -> str:
    """The words in ranges with the white space between them; ranges that do not touch are
    joined by a line break."""
    if len(ranges) == 1 and ranges[0][0] == 0:
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        if ranges[0][1] >= len(words):
            return text
    else:
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for a, b in ranges:
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in merged)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass over a document, whose
    text is what that pass takes. Rows that share doc_id, source and size are told apart by
    their rank, so that every row gets the ranges of one of them."""
    plain, names = masked(docs)
    text, columns = names["text"], list(names.values())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    twin = Window.partitionBy("doc_id", "source", "size").orderBy("order")
    left = plain.withColumns({"doc_id": F.col(names["doc_id"]).try_cast("long"), "source": F.col(names["source"]).cast("string"), "size": n_words(F.col(text)), "order": F.xxhash64(text)}).withColumn("twin", F.row_number().over(twin))
    taken = mix(docs, **options).filter(F.size("passes") > 0).withColumn("order", F.to_json("passes")).withColumn("twin", F.row_number().over(twin))
    taken = taken.select("passes", *(F.col(n).alias(f"_{n}") for n in ("doc_id", "source", "size", "twin")))
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("twin") == F.col("_twin"))
    joined = left.join(taken, on).select(*columns, F.explode("passes").alias("ranges"))

    def run(batches):
        for b in batches:
            texts = [selected_text(t, r) for t, r in zip(b.column(text).to_pylist(), b.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else b.column(n) for n in columns], columns)

    out = unmasked(joined.mapInArrow(run, fields), names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
