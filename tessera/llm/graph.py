"""Connected components by least labels with pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, lookup


def components(edges: DataFrame, hot: int = 2048) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the least node reachable.

    Each round takes the least label of the neighbours, then that label's own label, and is cut
    off in the shared folder. Labels are gathered by partial aggregation; the edges of a node
    with more than hot of them are dealt into parts, each with a copy of the node's label, so
    no task gets them all."""
    pairs = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degrees = both.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("parts"))
    parts = lookup(cut(degrees.filter("parts > 1")))
    both = cut(both.join(parts, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"), F.lit(True).alias("changed")))
    while labels.filter("changed").limit(1).count():
        copies = labels.select(F.col("node").alias("b"), "component").join(parts, "b", "left").select("b", "component", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        near = both.join(copies, ["b", "part"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        better = labels.drop("changed").join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = cut(better.join(roots, "component", "left").select("node", F.least("component", "root").alias("component"), (F.least("component", "root") < F.col("before")).alias("changed")))
    return labels.select("node", "component")
