"""Quotas against a heap of highest quotients; blocks of a small source are spread over it."""

import heapq
import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


@pytest.mark.parametrize("docs", [500, 700, 4096])
def test_spread(spark, docs):
    # the first source is full at twice its size; the others give parts of their blocks
    rows = [(i, " ".join(["w"] * 10), s) for n, s in enumerate("abc") for i in range(n * docs, (n + 1) * docs)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    seen = 0
    for s in "abc":
        taken = [r.taken for r in sorted((r for r in got if r.source == s), key=lambda r: r.doc_id)]
        tenths = [sum(taken[k * docs // 10 : (k + 1) * docs // 10]) for k in range(10)]
        assert max(tenths) - min(tenths) <= 0.1 * sum(taken) / 10 + 20
        seen += sum(taken) not in (0, 10 * docs, 20 * docs)
        assert abs(sum(taken) - next(r.target for r in got if r.source == s)) <= 0.02 * sum(taken) + 10
    assert seen


def heap_quotas(parties, seats):
    """Seat by seat to the highest quotient weight / (k - 1/2); ties by source (null last), shard."""
    heap = [(-Fraction(w) * 2, (s is None, s or "", k), n, 1) for s, k, w, n in parties if n]
    heapq.heapify(heap)
    got = {(s, k): 0 for s, k, _, _ in parties}
    for _ in range(seats):
        _, key, most, k = heapq.heappop(heap)
        at = (None if key[0] else key[1], key[2])
        got[at] = k
        if k < most:
            w = next(w for s, x, w, _ in parties if (s, x) == at)
            heapq.heappush(heap, (-Fraction(w) / (Fraction(2 * k + 1, 2)), key, most, k + 1))
    return got


@pytest.mark.parametrize("seed", range(4))
def test_quotas(spark, seed):
    rng = random.Random(seed)
    pick = (lambda: float(rng.choice([4, 8, 12]))) if seed % 2 else (lambda: rng.choice([0.0, rng.random() * 10 ** rng.randint(-2, 4)]))
    parties = [(s, k, pick(), rng.choice([1, 3, 1000])) for s in ("a", "b", None) for k in range(rng.randint(1, 9))]
    room = sum(n for _, _, w, n in parties if w)
    df = spark.createDataFrame(parties, "source string, shard long, weight double, most long")
    for seats in {0, 1, min(room, 17), min(room, 200), room}:
        got = mixing.quotas(df, seats, F.col("source").asc_nulls_last(), F.col("shard")).collect()
        assert {(r.source, r.shard): r.quota for r in got} == heap_quotas([p if p[2] else (*p[:3], 0) for p in parties], seats)


def test_blocks(spark):
    """Quotas and chosen blocks of the whole mix against a loop over all blocks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix(docs, block_words=40, shard_words=900).collect()
    block, shard_words = 40, 900
    doc_shard = {(r.doc_id, r.source): r.h for r in docs.select("doc_id", "source", F.xxhash64(F.col("doc_id"), F.lit(5)).alias("h")).collect()}
    shards, target = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        target[r.source] = r.target
        shards[r.source, doc_shard[r.doc_id, r.source] % max(1, math.ceil(r.source_size / shard_words))].append(r)
    parties = []
    for (s, k), members in shards.items():
        size = sum(r.size for r in members)
        n = max(1, math.ceil(size / block))
        parties.append((s, k, target[s] * size / members[0].source_size, 2 * n))
    quota = heap_quotas(parties, int(sum(target[s] for s in sorted(target, key=str)) / block))
    shifts = spark.createDataFrame([(s, k) for s, k, _, _ in parties], "source string, shard long")
    part = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "shard")
    shift = {(r.source, r.shard): r.h for r in shifts.select("source", "shard", F.xxhash64(part, F.lit(5)).alias("h")).collect()}
    for at, members in shards.items():
        size = sum(r.size for r in members)
        n, first = max(1, math.ceil(size / block)), 0
        whole, rest = divmod(quota[at], n)
        chosen = [b for b in range(n) if (b * rest + shift[at] % n) % n < rest]
        assert len(chosen) == rest
        for r in members:
            covered = sum(max(0, min((b + 1) * block, first + r.size) - max(b * block, first)) for b in chosen)
            assert r.taken == whole * r.size + covered
            first += r.size
