"""Operator 12: the prefix trie of conversations, by union-find over sorted-neighbour LCP edges.

A turn (role, text) becomes a 128-bit key, a conversation the bytes of its turns' keys. Sorted by
these bytes, conversations with a common prefix are neighbours, and the longest common prefix
(LCP) of two neighbours, in turns, is an edge between them. Taking the edges by descending depth,
union-find joins the components on both sides: each component's open node is lifted to the edge's
depth (the node it had is closed and becomes a child), and two open nodes of one depth become
one, a branching node. Nodes between a closed node and its parent have the same members and are
written out at the end.

Each range partition of the sorted conversations builds its own forest. An open node that holds
the partition's first or last conversation may go on beyond the boundary, so an edge that would
lift it stays; what remains of a partition is a short row of open nodes, at most two for each
turn of its first and last conversation, with the edges between them. Groups of 32 partitions
put their rows together, with the LCPs across the boundaries, and go through the same union-find,
level by level, until one group is left. Parents beyond a boundary are found by joining the
numbers that open nodes had with what became of them.

Members that end at a node are hashed in sorted order as they pass; a run of equal conversations
at the edge of a partition, where it may go on, is given as pieces of text, and the pieces of one
run are hashed one after another.

Defined results: null role and text are empty; turns are ordered by turn, null first, turns of
one number by their key; a row without conv_id belongs to no conversation; repeated rows are
turns of their own; a conversation without turns after rebuilding is a member of the root alone;
texts and conversations of any length are whole (a turn takes 24 bytes of its conversation's
row); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, lookup

#: Bytes of a turn's key.
KEY = 16
#: Partitions whose open nodes are put together at a time; rows of a partition, about.
GROUP, PART_ROWS = 32, 100_000
#: Characters of a piece of a list of ids.
PIECE = 1 << 16
_NODE, _OPEN, _ALIAS, _PIECE = range(4)
_NOTHING = hashlib.sha256(b"").hexdigest()

#: One row of what a level gives. All: kind, part (number of the group). Nodes: depth, conv_id,
#: n_convs, n_children, n_leaves, saved, own, ends, up_depth, and of the parent either up_conv or
#: up_id. Open nodes: the same up to ends, total (code points down to depth), place (in the part),
#: id, edge and edge_total (LCP with the next open node), left and right (bytes of the
#: part's first and last conversation, at its first and last node) with their running totals.
#: Aliases: id of an open node before, and up_conv or up_id now. Pieces: own, place, piece.
_FIELDS = {
    "kind": pa.int32(), "part": pa.int64(), "place": pa.int64(), "id": pa.int64(), "depth": pa.int32(), "total": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved": pa.int64(), "own": pa.binary(), "ends": pa.string(),
    "up_depth": pa.int32(), "up_conv": pa.int64(), "up_id": pa.int64(), "edge": pa.int32(), "edge_total": pa.int64(), "left": pa.binary(), "left_totals": pa.list_(pa.int64()), "right": pa.binary(), "right_totals": pa.list_(pa.int64()), "piece": pa.string(),
}
_SCHEMA = ", ".join(f"{n} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'}).get(t, 'array<long>')}" for n, t in _FIELDS.items())


def _table(rows: list[dict]) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS.items()})


def common_turns(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix of two conversations."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) // KEY


class Forest:
    """Open nodes in order, with the edges between neighbours."""

    def __init__(self):
        self.depth: list[int] = []
        self.total: list[int] = []
        self.conv: list[int] = []
        self.n: list[int] = []
        self.kids: list[int] = []
        self.leaves: list[int] = []
        self.saved: list[int] = []
        self.own: list[bytes | None] = []
        self.ends: list[str | None] = []
        #: of the edge to the next node
        self.edge: list[int] = []
        self.edge_total: list[int] = []

    def add(self, depth: int, total: int, conv: int, n: int, own: bytes | None, ends: str | None, kids: int = 0, leaves: int = 0, saved: int = 0) -> None:
        for column, v in ((self.depth, depth), (self.total, total), (self.conv, conv), (self.n, n), (self.own, own), (self.ends, ends), (self.kids, kids), (self.leaves, leaves), (self.saved, saved)):
            column.append(v)

    def link(self, edge: int, total: int) -> None:
        self.edge.append(edge)
        self.edge_total.append(total)

    def contract(self, whole: bool) -> tuple[list[dict], list[dict], list[tuple[int | None, int | None]]]:
        """(closed nodes, open nodes, what became of each node given). Unless this is the whole
        table, the first and the last node are open to what lies beyond. In the result, a parent
        is up_conv where it is closed, else up, the place of an open node; likewise the fates."""
        count = len(self.depth)
        parent = list(range(count))  # union-find over the components
        held = [False] * count  # open to the unknown
        held[0] = held[-1] = not whole
        node = list(range(count))  # the number of a component's open node
        merged: list[int] = list(range(count))  # union-find over the numbers of nodes
        closed: dict[int, dict] = {}

        def find(of: list[int], i: int) -> int:
            while of[i] != i:
                of[i] = of[of[i]]
                i = of[i]
            return i

        def close(c: int, depth: int, total: int) -> None:
            leaves = self.leaves[c] if self.kids[c] else 1
            new = len(merged)
            merged.append(new)
            closed[node[c]] = {"depth": self.depth[c], "conv_id": self.conv[c], "n_convs": self.n[c], "n_children": self.kids[c], "n_leaves": leaves, "saved": self.saved[c], "own": self.own[c], "ends": self.ends[c], "up_depth": depth, "up": new}
            self.saved[c] += (self.n[c] - 1) * (self.total[c] - total)
            self.depth[c], self.total[c], self.kids[c], self.leaves[c], self.own[c], self.ends[c], node[c] = depth, total, 1, leaves, None, None, new

        stays = [False] * len(self.edge)
        for e in np.argsort(-np.array(self.edge, np.int64), kind="stable").tolist():
            d, total = self.edge[e], self.edge_total[e]
            a, b = find(parent, e), find(parent, e + 1)
            for c in (a, b):
                if self.depth[c] > d and not held[c]:
                    close(c, d, total)
            if self.depth[a] != d or self.depth[b] != d:
                stays[e] = held[a] = held[b] = True
                continue
            parent[b] = a
            merged[find(merged, node[b])] = find(merged, node[a])
            held[a] = held[a] or held[b]
            self.conv[a] = min(self.conv[a], self.conv[b])
            for column in (self.n, self.kids, self.leaves, self.saved):
                column[a] += column[b]
            if self.own[a] is None:
                self.own[a], self.ends[a] = self.own[b], self.ends[b]
        if whole:
            root = find(parent, 0)
            if self.depth[root] > 0:
                close(root, 0, 0)
            close(root, -1, 0)  # the root's parent is no node
            for c in closed.values():
                if c["up_depth"] < 0:
                    c["up"] = None
        # the open nodes that remain, in order
        left = [i for i in range(count) if i == 0 or stays[i - 1]] if not whole else []
        at = {find(merged, node[find(parent, i)]): k for k, i in enumerate(left)}

        def fate(number: int) -> tuple[int | None, int | None]:
            """(conv_id, None) of a closed node, (None, place) of an open one."""
            number = find(merged, number)
            return (closed[number]["conv_id"], None) if number in closed else (None, at[number])

        rows = []
        for c in closed.values():
            up = c.pop("up")
            conv, place = (None, None) if up is None else fate(up)
            rows.append({"kind": _NODE, **c, "up_conv": conv, "up_id": place})
        edges = [e for e, s in enumerate(stays) if s]
        opened = []
        for k, i in enumerate(left):
            c = find(parent, i)
            e = edges[k] if k < len(edges) else None
            opened.append({"kind": _OPEN, "place": k, "depth": self.depth[c], "total": self.total[c], "conv_id": self.conv[c], "n_convs": self.n[c], "n_children": self.kids[c], "n_leaves": self.leaves[c], "saved": self.saved[c], "own": self.own[c], "ends": self.ends[c], "edge": None if e is None else self.edge[e], "edge_total": None if e is None else self.edge_total[e]})
        return rows, opened, [fate(i) for i in range(count)]


def _numbered(rows: list[dict], opened: list[dict], level: int, part: int) -> None:
    """Put the level and the part into the places of open nodes, which then are ids."""
    base = (level << 56) | (part << 32)
    for r in rows:
        r["part"] = part
        if r.get("up_id") is not None:
            r["up_id"] += base
    for r in opened:
        r |= {"part": part, "id": base + r["place"]}


class _Run:
    """The members of a run of equal conversations, in order of conv_id: hashed, or, while the
    run may go on beyond the partition, gathered in pieces."""

    def __init__(self, first: bool):
        self.first, self.sha, self.text, self.size, self.n, self.pieces = first, hashlib.sha256(), [], 0, 0, []

    def add(self, conv_id: int) -> None:
        word = str(conv_id)
        self.text.append(word)
        self.size += len(word) + 1
        self.n += 1
        if self.size >= PIECE:
            self.flush()

    def flush(self) -> list[str]:
        """The text gathered since the last call; pieces are joined by commas."""
        if self.text:
            self.pieces.append(",".join(self.text))
            self.text, self.size = [], 0
        out, self.pieces = self.pieces, []
        return out


def _walk(batches: Iterable[pa.RecordBatch]):
    """The forest of one range partition of (conv_id, seq, totals), sorted by seq and conv_id."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    forest, held, run = Forest(), None, None
    first = None
    out: list[dict] = []
    number = 0

    def own(seq: bytes) -> bytes:
        return hashlib.md5(seq).digest()

    def give(last: bool) -> None:
        """Close the run that is held."""
        nonlocal number
        seq, totals, conv = held
        edge = run.first or last
        for text in run.flush() if edge else ():
            out.append({"kind": _PIECE, "part": part, "place": number, "own": own(seq), "piece": text})
            number += 1
        forest.add(len(seq) // KEY, totals[-1] if totals else 0, conv, run.n, own(seq), None if edge else run.sha.hexdigest())

    for batch in batches:
        for conv, seq, totals in zip(batch.column("conv_id").to_pylist(), batch.column("seq").to_pylist(), batch.column("totals").to_pylist(), strict=True):
            if held is None or seq != held[0]:
                if held is not None:
                    d = common_turns(held[0], seq)
                    give(False)
                    forest.link(d, totals[d - 1] if d else 0)
                held, run = (seq, totals, conv), _Run(held is None)
                first = first or held
            # whether a run is the partition's last one shows only at its end, so full pieces go
            # out for every run; those of a run that ends inside have its hash already
            run.sha.update(b"," * (run.n > 0) + str(conv).encode())
            run.add(conv)
            if run.pieces:
                for text in run.flush():
                    out.append({"kind": _PIECE, "part": part, "place": number, "own": own(seq), "piece": text})
                    number += 1
        if len(out) >= 256:
            yield from _table(out).to_batches()
            out.clear()
    if held is None:
        return
    give(True)
    rows, opened, _ = forest.contract(False)
    _numbered(rows, opened, 0, part)
    opened[0] |= {"left": first[0], "left_totals": first[1]}
    opened[-1] |= {"right": held[0], "right_totals": held[1]}
    out += rows + opened
    for i in range(0, len(out), 50_000):
        yield from _table(out[i : i + 50_000]).to_batches()


def _joined(level: int, whole: bool):
    """Put the open nodes of a group of parts together and contract them."""

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["place"]))
        forest, before = Forest(), None
        for r in rows:
            if before is not None:
                d, total = before["edge"], before["edge_total"]
                if d is None:  # the boundary of two parts
                    d = common_turns(before["right"], r["left"])
                    total = r["left_totals"][d - 1] if d else 0
                forest.link(d, total)
            forest.add(r["depth"], r["total"], r["conv_id"], r["n_convs"], r["own"], r["ends"], r["n_children"], r["n_leaves"], r["saved"])
            before = r
        nodes, opened, fates = forest.contract(whole)
        part = key[0].as_py()
        aliases = [{"kind": _ALIAS, "id": r["id"], "up_conv": conv, "up_id": place} for r, (conv, place) in zip(rows, fates, strict=True)]
        _numbered(nodes + aliases, opened, level, part)
        if opened:
            opened[0] |= {k: rows[0][k] for k in ("left", "left_totals")}
            opened[-1] |= {k: rows[-1][k] for k in ("right", "right_totals")}
        return _table(nodes + opened + aliases)

    return run


def _hashed(batches: Iterable[pa.RecordBatch]):
    """The hash of each run's pieces, which come in order."""
    held, sha = None, None
    for batch in batches:
        owns, ends = [], []
        for own, piece in zip(batch.column("own").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if own != held:
                if held is not None:
                    owns.append(held)
                    ends.append(sha.hexdigest())
                held, sha = own, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(owns, pa.binary()), pa.array(ends, pa.string())], ["own", "ends"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["own", "ends"])


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, base, turns) of each conversation: base is conv_id less its remainder by 100,
    turns are (turn, key, size) in order. Texts are not shuffled, only their keys."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", key.alias("key"), F.char_length(text).cast("long").alias("size"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    # dealt by base, so that a conversation meets the one it takes turns from without another shuffle
    return rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation base, then the own ones after the first
    h, with h = crc32(conv_id) % 6."""
    lists = turn_lists(conversations)
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    heads = lists.filter("conv_id = base").select("base", F.slice("turns", 1, 5).alias("head"))
    turns = F.concat(F.slice(F.coalesce("head", F.array().cast(lists.schema["turns"].dataType)), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return lists.withColumn("h", h).join(heads, "base", "left").select("conv_id", turns.alias("turns"))


def _totals(sizes: pd.Series) -> pd.Series:
    return pd.Series([np.cumsum(np.asarray(x, np.int64)) for x in sizes])


def prefix_trie(lists: DataFrame) -> DataFrame:
    """The nodes of the trie of lists(conv_id, turns): turns are structs with key, 32 hexadecimal
    digits that are equal for equal turns only, and size, the turn's saved tokens.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of
    each distinct prefix, the empty one included. conv_ids must differ and not be null."""
    spark = lists.sparkSession
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    totals = F.pandas_udf(_totals, "array<long>")(F.transform("turns", lambda t: t["size"]))
    rows = cut(lists.select("conv_id", seq.alias("seq"), totals.alias("totals")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    level = cut(rows.repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_walk, _SCHEMA))
    levels, parts = [level], (level.agg(F.max("part")).first()[0] or 0) + 1
    whole = False
    while not whole:
        whole = parts <= GROUP
        group = F.floor(F.col("part") / GROUP).cast("long")
        opened = levels[-1].filter(F.col("kind") == _OPEN)
        levels.append(cut(opened.groupBy(group.alias("group")).applyInArrow(_joined(len(levels), whole), _SCHEMA)))
        parts = -(-parts // GROUP)
    # what became of open nodes, from the last level down
    nodes, fates = levels[-1].filter(F.col("kind") == _NODE), None
    for k in range(len(levels) - 1, 0, -1):
        alias = _resolved(levels[k].filter(F.col("kind") == _ALIAS).select("id", "up_conv", "up_id"), fates)
        fates = lookup(cut(alias.select(F.col("id").alias("up_id"), F.col("up_conv").alias("found"))))
        nodes = nodes.unionByName(_resolved(levels[k - 1].filter(F.col("kind") == _NODE), fates))
    pieces = level.filter(F.col("kind") == _PIECE).select("own", "part", "place", "piece")
    pieces = pieces.repartition("own").sortWithinPartitions("own", "part", "place").select("own", "piece").mapInArrow(_hashed, "own binary, ends string")
    return _written_out(nodes, lookup(cut(pieces)), rows)


def _resolved(rows: DataFrame, fates: DataFrame | None) -> DataFrame:
    """rows with the up_conv of those that have an up_id instead; only those are joined."""
    if fates is None:
        return rows
    later = rows.filter("up_id is not null").drop("up_conv").join(fates, "up_id").withColumnRenamed("found", "up_conv")
    return rows.filter("up_id is null").unionByName(later.select(rows.columns))


def _written_out(nodes: DataFrame, ends: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each depth from below a closed node's parent down to the node itself."""
    nodes = nodes.select("conv_id", "depth", "up_depth", "up_conv", "n_convs", "n_children", "n_leaves", "saved", "own", "ends")
    open_run = F.col("own").isNotNull() & F.col("ends").isNull()
    nodes = nodes.filter(~open_run).unionByName(nodes.filter(open_run).drop("ends").join(ends, "own").select(nodes.columns)).withColumn("ends", F.coalesce("ends", F.lit(_NOTHING)))
    # code points count only where members share them
    shared, alone = nodes.filter("n_convs > 1"), nodes.filter("n_convs <= 1")
    first = F.greatest("up_depth", F.lit(0))
    kept = F.slice("totals", first + 1, F.col("depth") - first)
    base = F.when(F.col("up_depth") > 0, F.element_at("totals", F.when(F.col("up_depth") > 0, F.col("up_depth")))).otherwise(F.lit(0).cast("long"))
    sized = shared.join(rows.select("conv_id", "totals"), "conv_id").withColumns({"before": F.concat(F.array(base), kept), "all": F.when(F.col("depth") > 0, F.element_at("totals", F.when(F.col("depth") > 0, F.col("depth")))).otherwise(F.lit(0).cast("long"))}).drop("totals")
    nodes = sized.unionByName(alone.withColumns({"before": F.lit(None).cast("array<long>"), "all": F.lit(0).cast("long")}))
    each = nodes.withColumn("at", F.explode(F.sequence(F.col("up_depth") + 1, F.col("depth"))))
    last, top = F.col("at") == F.col("depth"), F.col("at") == F.col("up_depth") + 1
    # members share the text from depth at on: all up to depth, less all before at
    above = F.when(F.col("at") > 0, F.col("before")[F.col("at") - F.greatest("up_depth", F.lit(0)) - 1]).otherwise(F.lit(0).cast("long"))
    shares = F.when(F.col("n_convs") > 1, (F.col("n_convs") - 1) * (F.col("all") - above)).otherwise(F.lit(0).cast("long"))
    return each.select(
        "conv_id", F.col("at").cast("long").alias("depth"), F.when(F.col("at") > 0, F.when(top, F.col("up_conv")).otherwise(F.col("conv_id"))).alias("parent_conv_id"), "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("saved") + shares).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(_NOTHING)).alias("ends_sha256"),
    )
