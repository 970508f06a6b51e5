"""Operator 8: sharding by k-d tree partitioning.

All documents are split recursively at weighted medians (weight: bytes) along the dimension in
which a node is widest, until every leaf is a shard of the target bytes; a node of m shards is
cut at floor(m/2)/m of its bytes. The dimensions are metadata of the text: byte length, number of
lines and share of non-ASCII bytes, each scaled to [0, 2**20). Ties along a dimension are
ordered by a hash of the text, so every cut can be met closely, and equal texts always share a
shard. Only a group of equal texts larger than a shard's target is told apart by doc_id as well.
The law is ``bytes``: sizes near equal.

Cuts are found by distributed histograms: each round adds the bytes of every open node into 1024
bins and goes on in the bin that holds the cut, so the driver sees nodes x bins sums at most.

Defined results: null text has no bytes, so size 8, and crc 0; a null doc_id is placed like any
other row; repeated rows are placed together and get slots of their own; with fewer rows than
shards some shards stay empty; texts of any length count with all their bytes; a doc_id that is
no number counts as null; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

DIMENSIONS = ("d_bytes", "d_lines", "d_other")
COORD_BITS, HASH_BITS, BIN_BITS = 20, 30, 10


def _coordinates(text: Column) -> dict[str, Column]:
    top = float((1 << COORD_BITS) - 1)
    size = F.octet_length(text)
    scaled = lambda x: F.least(F.floor(x * top), F.lit(top)).cast("long")
    return {
        "d_bytes": scaled(F.log2(1.0 + size) / 32.0),
        "d_lines": scaled(F.log2(1.0 + F.length(text) - F.length(F.translate(text, "\n", ""))) / 32.0),
        "d_other": scaled((size - F.length(text)) / F.greatest(size, F.lit(1))),
    }


class Node:
    """m shards from shard on; once cut, rows whose key along dimension is below bound go left."""

    def __init__(self, m: int, shard: int):
        self.m, self.shard, self.sides = m, shard, None
        self.dimension, self.low, self.goal = "", 0, 0.0

    def halves(self) -> tuple[Node, Node]:
        left = self.m // 2
        return Node(left, self.shard), Node(self.m - left, self.shard + left)


def _columns(batch) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}


def _keys(x: dict[str, np.ndarray], dimension: str) -> np.ndarray:
    return (x[dimension] << HASH_BITS) + x["tie"]


def leaves(root: Node, x: dict[str, np.ndarray]) -> np.ndarray:
    """First shard of the leaf of each row."""
    out = np.zeros(len(x["tie"]), np.int64)
    todo = [(root, np.arange(len(out)))]
    while todo:
        node, at = todo.pop()
        if node.sides is None:
            out[at] = node.shard
        else:
            left = _keys({k: v[at] for k, v in x.items()}, node.dimension) < node.low
            todo += [(node.sides[0], at[left]), (node.sides[1], at[~left])]
    return out


def _sums(rows: DataFrame, root: Node, nodes: list[Node], shift: int) -> dict[int, list[tuple[int, int]]]:
    """For each node its (bin, bytes), by bin: bins of 2**shift keys from the node's low on."""

    def count(batches):
        for b in batches:
            x = _columns(b)
            at = leaves(root, x)
            found = []
            for n in nodes:
                mine = {k: v[at == n.shard] for k, v in x.items()}
                place = (_keys(mine, n.dimension) - n.low) >> shift
                ok = (place >= 0) & (place < 1 << BIN_BITS)
                bins, which = np.unique(place[ok], return_inverse=True)
                held = np.zeros(len(bins), np.int64)
                np.add.at(held, which, mine["size"][ok])
                found += [(n.shard, p, h) for p, h in zip(bins.tolist(), held.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["node", "bin", "bytes"])

    out: dict[int, list[tuple[int, int]]] = {n.shard: [] for n in nodes}
    for r in rows.mapInArrow(count, "node long, bin long, bytes long").groupBy("node", "bin").agg(F.sum("bytes").alias("bytes")).collect():
        out[r["node"]].append((r["bin"], r["bytes"]))
    return {k: sorted(v) for k, v in out.items()}


def _extents(rows: DataFrame, root: Node) -> dict:
    """Bytes and the least and greatest coordinates of each leaf."""

    def mark(batches):
        for b in batches:
            x = _columns(b)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (leaves(root, x), x["size"], *(x[d] for d in DIMENSIONS))], ["node", "size", *DIMENSIONS])

    ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    marked = rows.mapInArrow(mark, "node long, size long, " + ", ".join(f"{d} long" for d in DIMENSIONS))
    return {r["node"]: r for r in marked.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}


def build_tree(rows: DataFrame, shards: int) -> Node:
    """The tree for rows(size, tie, the DIMENSIONS), level by level."""
    rows = rows.select("size", "tie", *DIMENSIONS)
    root = Node(shards, 0)
    nodes = [root] if shards > 1 else []
    while nodes:
        stats = _extents(rows, root)
        nodes = [n for n in nodes if n.shard in stats]
        for n in nodes:
            r = stats[n.shard]
            n.dimension = max(DIMENSIONS, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"], d))
            n.low, n.goal = 0, r["bytes"] * (n.m // 2) / n.m
        for shift in range(COORD_BITS + HASH_BITS - BIN_BITS, -1, -BIN_BITS):
            sums = _sums(rows, root, nodes, shift)
            for n in nodes:
                at, held = 0, 0
                for at, held in sums[n.shard]:
                    if n.goal < held:
                        break
                    n.goal -= held
                n.low += at << shift
                # the last round's bin is one key: the cut goes to its nearer side
                if shift == 0 and n.goal >= held / 2:
                    n.low += 1
        for n in nodes:
            n.sides = n.halves()
        nodes = [s for n in nodes for s in n.sides if s.m > 1]
    return root


def assign_shards(docs: DataFrame, shards: int = 24, slot_rows: int = 2000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each of docs(doc_id, text).
    Slots follow a hash order within buckets of about slot_rows rows; counts of the buckets
    before give a bucket its first slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").try_cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"), *(c.alias(n) for n, c in _coordinates(text).items())
    )
    rows = cut(rows)
    totals = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    target = (totals["bytes"] or 0) / shards
    # fewer groups than shards can be larger than a shard
    large = [r["_text"] for r in rows.groupBy("_text").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > target).select("_text").collect()]
    tie = F.pmod("_text", F.lit(1 << HASH_BITS))
    if large:
        tie = F.when(F.col("_text").isin(large), F.pmod(F.xxhash64("_text", "doc_id"), F.lit(1 << HASH_BITS))).otherwise(tie)
    rows = rows.withColumn("tie", tie)
    buckets = max(1, -(-totals["n"] // (shards * slot_rows)))
    root = build_tree(rows, shards)
    names = ["doc_id", "size", "text_crc32", "_text"]

    def place(batches):
        for b in batches:
            x = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("tie", *DIMENSIONS)}
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(leaves(root, x).astype(np.int32))], [*names, "shard"])

    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, _text long, shard int").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("_shard"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "_text")
    ranked = placed.withColumn("rank", F.row_number().over(within))
    return ranked.join(starts, (F.col("shard") == F.col("_shard")) & (F.col("bucket") == F.col("_bucket"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
