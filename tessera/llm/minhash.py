"""Operator 4: MinHash near-dedup by a signature-coordinate inverted join.

1. Each document becomes the set of its distinct word shingles and a MinHash signature of
   ``coordinates`` values. Equal sets form a class; only one row per class goes on.
2. Classes are posted under each (coordinate, value) pair. Two classes are candidates if they
   collide under at least ``threshold`` pairs; the threshold is set so that a pair at the wanted
   similarity is missed with probability below one in a million. Pairs that one class alone has
   are skipped, classes with fewer than ``threshold`` pairs left are skipped whole, and the others
   stay only in the lists of their rarest pairs: with m pairs left, any partner shares one of the
   m - threshold + 1 rarest (the prefix).
3. Each list links its members to its hub, the member with the most collisions in all. These
   links are counted on signatures of ``FINE`` coordinates of one byte and confirmed on the full
   shingle sets. That joins families of copies of any size with a linear number of pairs.
4. In lists whose members are still in different components, the members outside the largest
   component (minor) meet all members of other components, so no link between components is
   lost. A list of N members with at most ``block`` minor ones is compared in blocks, which moves
   at most N + block rows. Members of lists with more (a passage that many unlike documents
   share) are posted anew under the rarest of their full shingles: with n shingles, any partner
   has one of the n - ceil(n * percent / 100) + 1 rarest, which leaves the shared passage out.
   Those lists go through steps 3 and 4 again. A pair is counted in one list only, the first that
   it shares, and survivors are confirmed too.

Defined results: null or blank text has no shingles, stays alone and is kept; a document with a
null doc_id is linked like others, its component is the smallest doc_id reachable, and it is then
not kept; if none is reachable, it has no component and is kept (where some doc_id is 2**62 or
more, documents without a doc_id are linked with equal sets only); rows with one doc_id are one
node of the graph; repeated rows each give a row; texts of any length are taken whole, a batch
is worked on in slices bounded by bytes; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import IdFilter, cut, masked, slices, unmasked
from tessera.llm.graph import components

COORDINATES, FINE = 64, 1024
_PIECE = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLIERS = np.random.default_rng(4).integers(1, 1 << 63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words; those of the first words are kept between rows."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 50_000:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int, hashes: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, ascending."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, shingle)
    x = w[: n - width + 1]
    for k in range(1, width):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + w[k : n - width + 1 + k])
    return np.unique(_mixed(x + np.uint64(width)))


def least_hashes(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _PIECE):
        np.minimum(out, (shingles[at : at + _PIECE, None] * _MULTIPLIERS[:coordinates]).min(0), out=out)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    return (least_hashes(shingles, COORDINATES) >> np.uint64(32)).astype(np.uint32)


def fine_signature(shingles: np.ndarray) -> np.ndarray:
    return (_mixed(least_hashes(shingles, FINE)) >> np.uint64(56)).astype(np.uint8)


def collision_threshold(percent: int, coordinates: int = COORDINATES, miss: float = 1e-6) -> int:
    """The most collisions t with P(binomial(coordinates, percent / 100) < t) <= miss."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += math.exp(math.lgamma(coordinates + 1) - math.lgamma(t + 1) - math.lgamma(coordinates - t + 1) + t * math.log(p) + (coordinates - t) * math.log1p(-p)) if 0 < p < 1 else float(t == coordinates)
        if below > miss:
            return t
    return coordinates


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, named, n, set_hash, sig) of docs(id, named, text); the last two are null for an empty
    set."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for b in slices(batch, "text"):
                n, names, sigs = [], [], []
                for text in b.column("text").to_pylist():
                    x = shingle_set(text, shingle, hashes)
                    n.append(len(x))
                    names.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    sigs.append(signature(x).tobytes() if len(x) else None)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("named"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())], ["id", "named", "n", "set_hash", "sig"])

    return docs.select("id", "named", "text").mapInArrow(run, "id long, named boolean, n long, set_hash binary, sig binary")


def _sig_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _post(batches):
    """(key, rep) for each coordinate; the key holds coordinate and value."""
    for b in batches:
        if b.num_rows:
            keys = _sig_rows(b.column("sig")).astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("rep").to_numpy(), COORDINATES))], ["key", "rep"])


def _fit(n_a, n_b, percent: int):
    return np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent


def _prefixes(classes: DataFrame, threshold: int) -> DataFrame:
    """(rep, central, keys): the lists that each class stays in, and its collisions in all."""
    posted = classes.select("rep", "sig").mapInArrow(_post, "key long, rep long")
    often = posted.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = posted.join(often, "key").groupBy("rep").agg(F.collect_list(F.struct("often", "key")).alias("pairs"), F.sum("often").alias("central")).filter(F.size("pairs") >= threshold)
    prefix = F.slice(F.array_sort("pairs"), F.lit(1), F.size("pairs") - threshold + 1)
    return shared.select("rep", "central", F.array_sort(F.transform(prefix, lambda x: x["key"])).alias("keys"))


def _fine(texts: DataFrame, shingle: int) -> DataFrame:
    """(rep, n, fine), one row per rep."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for b in slices(batch, "text"):
                n, fine = [], []
                for text in b.column("text").to_pylist():
                    x = shingle_set(text, shingle, hashes)
                    n.append(len(x))
                    fine.append(fine_signature(x).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(n, pa.int64()), pa.array(fine, pa.binary())], ["rep", "n", "fine"])

    return texts.mapInArrow(run, "rep long, n long, fine binary").dropDuplicates(["rep"])


def _full_prefixes(texts: DataFrame, n: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(rep, central, keys) of texts(rep, text): the rarest full shingles that any partner at the
    similarity has one of. n is (rep, n)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for b in slices(batch, "text"):
                sets = [shingle_set(t, shingle, hashes).view(np.int64) for t in b.column("text").to_pylist()]
                reps = np.repeat(b.column("rep").to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(sets))], ["rep", "key"])

    posted = cut(texts.mapInArrow(run, "rep long, key long"))
    often = cut(posted.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
    shared = posted.join(often, "key").groupBy("rep").agg(F.collect_set(F.struct("often", "key")).alias("pairs"), F.sum("often").alias("central")).join(n, "rep")
    # what one document alone has is rarer than all others: it takes its part of the prefix
    size = F.size("pairs") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    return shared.filter(size > 0).select("rep", "central", F.array_sort(F.transform(F.slice(F.array_sort("pairs"), F.lit(1), size), lambda x: x["key"])).alias("keys"))


def _bytes_rows(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, FINE)


def _star(lists: DataFrame, block: int = 64) -> DataFrame:
    """(a, b, block): each member b of a list(key, rep, central) with its hub a. The partners of a
    hub are dealt into blocks of about block, so a hub is met in many tasks."""
    hubs = cut(lists.groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("less"))).alias("hub"), F.count(F.lit(1)).alias("often")).filter("often > 1"))
    pairs = lists.join(hubs, "key").select((-F.col("hub.less")).alias("a"), F.col("rep").alias("b"), "often").filter("a <> b").groupBy("a", "b").agg(F.max("often").alias("often"))
    return pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("often") / block)).alias("block"))


def _dealt(pairs: DataFrame, block: int = 64) -> DataFrame:
    """pairs(a, b) with such a block."""
    sizes = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
    return pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))


def _count(pairs: DataFrame, fine: DataFrame, threshold: int, percent: int) -> DataFrame:
    """The pairs(a, b, block) with enough collisions whose set sizes allow the similarity."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "fine_a", "fine_b"):
                same = _bytes_rows(b.column("fine_a").to_pylist()) == _bytes_rows(b.column("fine_b").to_pylist())
                ok = np.count_nonzero(same, axis=1) >= threshold
                ok &= _fit(b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), percent)
                yield b.select(["a", "b", "block"]).filter(pa.array(ok))

    side = lambda x: fine.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}"))
    pairs = cut(pairs)
    heads = pairs.select("a", "block").distinct().join(side("a"), "a")
    return pairs.join(side("b"), "b").join(heads, ["a", "block"]).mapInArrow(run, "a long, b long, block long")


class _Members:
    """Rows of a block as columns."""

    def __init__(self, rows: list[tuple]):
        self.rep, self.component, self.n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
        self.minor = np.array([r[3] for r in rows], bool)
        self.fine = _bytes_rows([r[4] for r in rows])
        self.keys = [r[5] for r in rows]


def _new_pairs(key: int, own: _Members, other: _Members, visiting: bool, threshold: int, percent: int) -> list[tuple[int, int]]:
    """Candidate pairs of different components, own x other, whose first common list is key.
    Two members that both visit other blocks meet in each other's; the block of the lesser rep
    counts."""
    out = []
    for at in range(0, len(other.rep), 64):
        part = slice(at, at + 64)
        ok = (own.component[:, None] != other.component[part]) & _fit(own.n[:, None], other.n[part], percent)
        ok &= (own.rep[:, None] < other.rep[part]) | (visiting & ~own.minor[:, None])
        i, j = np.nonzero(ok)
        j += at
        for k in range(0, len(i), 8192):
            x, y = i[k : k + 8192], j[k : k + 8192]
            hit = np.count_nonzero(own.fine[x] == other.fine[y], axis=1) >= threshold
            for a, b in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
                if min(set(own.keys[a]).intersection(other.keys[b])) == key:
                    out.append((min(own.rep[a], other.rep[b]), max(own.rep[a], other.rep[b])))
    return out


def _opened(marked: DataFrame, block: int) -> DataFrame:
    """Of lists(key, rep, component), those whose members are in different components, as
    (key, rep, component, minor, minors, blocks)."""
    sizes = marked.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    tops = cut(tops.select("key", "top", (F.col("size") - F.col("top.size")).alias("minors"), F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    return cut(marked.join(tops, "key").select("key", "rep", "component", (F.col("component") != F.col("top.component")).alias("minor"), "minors", "blocks"))


def _open_lists(lists: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    marked = lists.select("key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    return _opened(cut(marked), block)


def _compare_blocks(lists: DataFrame, members: DataFrame, threshold: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components, from open lists. Each list is dealt into
    its blocks; minor members visit all of them. A block's own rows are held, its visitors
    stream by."""
    rows = lists.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    to = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    rows = rows.select("key", "rep", "component", "minor", "own", F.explode(to).alias("block")).withColumn("visits", F.col("own") != F.col("block")).join(members, "rep")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("rep", "component", "n", "minor", "fine", "keys")

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([int(f[k]) for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        at, held, own, found = None, [], None, []

        def close():
            """The block's own rows are complete."""
            nonlocal own
            if own is None and held:
                own = _Members(held)
                found.extend(_new_pairs(at[0], own, own, False, threshold, percent))

        for b in (x for batch in batches for x in slices(batch, "fine")):
            visitors: list[tuple] = []
            for key, block_, visits, *row in zip(*(b.column(c).to_pylist() for c in ("key", "block", "visits", *names)), strict=True):
                if (key, block_) != at:
                    close()
                    if visitors and own:
                        found.extend(_new_pairs(at[0], own, _Members(visitors), True, threshold, percent))
                    at, held, own, visitors = (key, block_), [], None, []
                if visits:
                    close()
                    visitors.append(tuple(row))
                else:
                    held.append(tuple(row))
            if visitors and own:
                found.extend(_new_pairs(at[0], own, _Members(visitors), True, threshold, percent))
            yield batch(found)
            found.clear()
        close()
        yield batch(found)

    return rows.select("key", "block", "visits", *names).repartition(n, "key", "block").sortWithinPartitions("key", "block", "visits").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs(a, b, block) whose full shingle sets are similar enough. The text of a is met by
    those of the partners in its block, so a node with many partners is spread over tasks."""
    dealt = cut(pairs)
    heads = dealt.select("a", "block").distinct().join(texts.withColumnRenamed("rep", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    members = dealt.join(texts.withColumnRenamed("rep", "b"), "b").select("a", "block", "b", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        hashes, at, head = WordHashes(), None, None
        for batch in (x for whole in batches for x in slices(whole, "text")):
            found = []
            for a, block_, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b", "text")), strict=True):
                x = shingle_set(text, shingle, hashes)
                if b is None:
                    at, head = (a, block_), x
                elif at == (a, block_):
                    both = len(np.intersect1d(head, x, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(x) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return heads.unionByName(members).repartition(n, "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _families(lists: DataFrame, comps: DataFrame | None, fine: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The confirmed links of the lists' members to their hubs, and the components with them."""
    star = _star(lists)
    if comps is not None:
        side = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        known = cut(star).join(side("b"), "b", "left").join(side("a"), "a", "left")
        star = known.filter(~F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False))).select("a", "b", "block")
    links = cut(_confirm(_count(star, fine, collision_threshold(percent, FINE), percent), texts, shingle, percent))
    return links, _joined(comps, links)


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) with the links(a, b) added: they join whole components."""
    if comps is None:
        return cut(components(links))
    named = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    joined = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    above = cut(components(joined))
    nodes = comps.unionByName(above.join(comps.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return cut(nodes.join(above.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component")))


_UNNAMED = 1 << 62


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each of docs(doc_id, text); linked
    are documents with 100 * |A and B| >= percent * |A or B|."""
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    room = (docs.agg(F.max("doc_id")).first()[0] or 0) < _UNNAMED
    unnamed = F.lit(_UNNAMED) + F.xxhash64("text").bitwiseAND(F.lit(_UNNAMED - 1)) if room else F.lit(None)
    docs = docs.select(F.coalesce("doc_id", unnamed.cast("long")).alias("id"), F.col("doc_id").isNotNull().alias("named"), "text")
    signed = cut(signatures(docs, shingle))
    classes = cut(signed.filter("n > 0").groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    prefixes = cut(_prefixes(classes.filter("rep is not null"), collision_threshold(percent)))
    lists = prefixes.select("rep", "central", F.explode("keys").alias("key"))
    reps = prefixes.select("rep")
    texts = docs.select(F.col("id").alias("rep"), "text")
    texts = cut(texts.filter(IdFilter(reps, "rep")()).join(reps, "rep", "left_semi"))
    fine, fine_threshold = cut(_fine(texts, shingle)), collision_threshold(percent, FINE)
    _, comps = _families(lists, None, fine, texts, shingle, percent)
    opened = _open_lists(lists, comps, block)
    compared = _compare_blocks(opened.filter(F.col("minors") <= block), fine.join(prefixes.select("rep", "keys"), "rep"), fine_threshold, percent)
    many = cut(opened.filter(F.col("minors") > block).select("rep").distinct())
    if many.limit(1).count():
        again = cut(_full_prefixes(texts.join(many, "rep", "left_semi"), fine.select("rep", "n"), shingle, percent))
        lists = again.select("rep", "central", F.explode("keys").alias("key"))
        # links across components so far; what the first lists still hold open stays valid
        _, comps = _families(lists, comps, fine, texts, shingle, percent)
        rest = _compare_blocks(_open_lists(lists, comps, block), fine.join(again.select("rep", "keys"), "rep"), fine_threshold, percent)
        compared = compared.unionByName(rest).distinct()
    comps = _joined(comps, cut(_confirm(_dealt(cut(compared)), texts, shingle, percent)))
    named_sets = classes.select("set_hash", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "named", "n", "set_hash").join(named_sets, "set_hash", "left")
    component = F.coalesce("component", "id")
    if room:
        component = F.when(component < _UNNAMED, component)
    doc_id = F.when(F.col("named"), F.col("id"))
    return out.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(doc_id == component, component.isNull()).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, and of several rows with one doc_id only the
    first by a hash of the text. Rows without a doc_id cannot be named and stay. Only rows that
    the filter of doubtful ids lets through are shuffled."""
    plain, names = masked(docs)
    judged = cut(near_duplicates(docs, shingle, percent).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).filter("not kept or rows > 1"))
    marked = plain.withColumn("doc_id", F.col(names["doc_id"]).try_cast("long"))
    doubtful = IdFilter(judged, "doc_id")
    clean = marked.filter(F.col("doc_id").isNull() | ~doubtful())
    rest = marked.filter("doc_id is not null").filter(doubtful()).join(judged, "doc_id", "left").filter(F.coalesce("kept", F.lit(True)))
    first = rest.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(names["text"])))).filter("rank = 1")
    return unmasked(first.select(*plain.columns).unionByName(clean.select(*plain.columns)), names)
