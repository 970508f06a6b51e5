"""Operator 7: SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut into units (a word with the space before it, line breaks apart). The distinct
units of a batch that are new are encoded together: units of equal length advance one position
at a time; the polynomial hashes of all substrings that end there probe the sorted keys of the
pieces, and a vectorised maximum over the allowed pieces stores the score and the backpointer.

The public model is a BPE model, whose segmentation is not the one with the greatest sum of
scores. So an arc of the lattice is allowed only where BPE itself would leave its piece next to
the last piece of the path: merging at the boundary, followed bottom-up along both pieces'
derivations, never wins. With that mask the best path is the library's own encoding, which the
tests check against the library. Units with runs of spaces, and units over ``LONGEST`` code
points that no seam splits, go through plain merging instead.

Defined results: null and empty texts have no ids and decode to the empty text; code points
outside the vocabulary become their UTF-8 bytes; U+2581 stands for a space in the model and
decodes to a space; repeated rows are encoded alike; empty tables give empty results; extra
columns are ignored. The vocabulary file is a parameter; only its pieces, a fixed number, go to
the executors.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import masked, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONGEST = 512
_UNIT = re.compile(r" *[^ \n]+| +|\n")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


def load(path: str = MODEL) -> dict:
    """Pieces, scores and kinds of a model file, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) else "normal" for i in ids]
    return {"pieces": [sp.id_to_piece(i) for i in ids], "scores": [sp.get_score(i) for i in ids], "kinds": kinds}


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded cache of encoded units."""

    def __init__(self, model: dict, cache: int = 700_000):
        self.pieces, kinds = model["pieces"], model["kinds"]
        self.unk = len(self.pieces)  # stands for a code point that is no piece
        self.id_of = {p: i for i, p in enumerate(self.pieces) if kinds[i] == "normal"}
        self.byte_id = {int(p[3:-1], 16): i for i, p in enumerate(self.pieces) if kinds[i] == "byte"}
        self.raw = [bytes([int(p[3:-1], 16)]) if k == "byte" else b"" if k == "control" else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        # order of merging: higher scores first
        score = np.array(model["scores"])
        self.rank = {i: -score[i] for i in self.id_of.values()}
        self.scores = np.append(score, 0.0)
        # ids of a unit as packed 32-bit integers
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache
        self.width = max(map(len, self.id_of))
        # pieces longer than one code point whose bigrams mark where text cannot be cut
        self.bigrams = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self._index()

    def _index(self) -> None:
        """Sorted keys of the pieces, and of each piece the nodes at its left and right edge, from
        its first or last code point up to itself, with the ranks of their merges."""
        n = self.unk + 1
        self.powers, self.inverses = _powers(_BASE, LONGEST + self.width + 2), _powers(_INVERSE, LONGEST + self.width + 2)
        self.key, self.size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for p, i in self.id_of.items():
            points = np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            self.key[i], self.size[i] = (points * self.powers[: len(p)]).sum(dtype=np.uint64), len(p)
        normal = np.array(sorted(self.id_of.values()))
        order = normal[np.argsort(self.key[normal])]
        self.sorted_keys, self.sorted_ids = self.key[order], order
        # one bit for each leading part of a key spares most searches
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.sorted_keys >> np.uint64(44)).astype(np.int64)] = True
        # pairs whose compatibility is known, by slot; a later pair takes an earlier one's slot
        self.pair, self.pair_ok = np.full(1 << 21, -1), np.zeros(1 << 21, bool)
        depth = 2 * self.width
        self.left, self.right = np.full((n, depth), -1), np.full((n, depth), -1)
        self.reachable = np.zeros(n, bool)
        self.reachable[self.unk] = True
        self.left[self.unk, 0] = self.right[self.unk, 0] = self.unk
        for p, i in self.id_of.items():
            found = self.merge(p, trace=True)
            self.reachable[i] = len(found) == 1
            if self.reachable[i]:
                for side, edge in ((0, self.left), (1, self.right)):
                    node, path = found[0], []
                    while node is not None:
                        path.append(node[0])
                        node = node[1 + side]
                    edge[i, : len(path)] = path[::-1]
        self.ranks = np.full(n, np.inf)
        for i, r in self.rank.items():
            self.ranks[i] = r

    def merge(self, text: str, trace: bool = False) -> list:
        """Plain BPE: join the adjacent pair with the best piece, leftmost first, until none is
        left. Gives ids (self.unk for unknown code points), or with trace (id, left, right)."""
        nodes = [(self.id_of.get(c, self.unk), None, None) for c in text]
        strings, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(text)
            if a >= 0 and b < len(text):
                i = self.id_of.get(strings[a] + strings[b]) if len(strings[a]) + len(strings[b]) <= self.width else None
                if i is not None:
                    heapq.heappush(heap, (self.rank[i], a, b, strings[a], strings[b], i))

        for a in range(len(text) - 1):
            offer(a)
        while heap:
            _, a, b, x, y, i = heapq.heappop(heap)
            if strings[a] == x and b < len(text) and after[a] == b and strings[b] == y:
                nodes[a], strings[a], strings[b] = (i, nodes[a], nodes[b]), x + y, ""
                after[a] = after[b]
                if after[b] < len(text):
                    before[after[b]] = a
                offer(before[a])
                offer(a)
        left = [nodes[a] for a in range(len(text)) if strings[a]]
        return left if trace else [x[0] for x in left]

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the substring keys that are pieces, and the pieces' ids."""
        at = np.flatnonzero(self.maybe[(keys >> np.uint64(44)).astype(np.int64)])
        some = keys[at]
        place = np.minimum(np.searchsorted(self.sorted_keys, some), len(self.sorted_keys) - 1)
        hit = self.sorted_keys[place] == some
        return at[hit], self.sorted_ids[place[hit]]

    def compatible(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether merging leaves u next to t."""
        key = u * (self.unk + 1) + t
        slot = ((key.astype(np.uint64) * _BASE) >> np.uint64(43)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            ok[new] = self._merge_leaves(u[new], t[new])
            self.pair[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
            # two new pairs of one slot: the last one stays, with its own answer
            again = np.flatnonzero(self.pair[slot[new]] == key[new])
            self.pair_ok[slot[new[again]]] = ok[new[again]]
        return ok

    def _merge_leaves(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Both sides grow along their edges in order of rank; a merge across the boundary wins if
        its rank is below the left side's next merge and not above the right side's."""
        ok = np.ones(len(u), bool)
        live = np.flatnonzero((u != self.unk) & (t != self.unk))
        i, j = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        while len(live):
            a, b = u[live], t[live]
            x, y = self.right[a, i], self.left[b, j]
            at, both = self.probe(self.key[x] + self.powers[self.size[x]] * self.key[y])
            across = np.full(len(live), np.inf)
            across[at] = self.ranks[both]
            up_x, up_y = self.right[a, i + 1], self.left[b, j + 1]
            p, q = np.where(up_x >= 0, self.ranks[up_x], np.inf), np.where(up_y >= 0, self.ranks[up_y], np.inf)
            lost = (across < p) & (across <= q)
            ok[live[lost]] = False
            go = ~lost & ((up_x >= 0) | (up_y >= 0))
            step = (p <= q)[go]
            live, i, j = live[go], i[go] + step, j[go] + ~step
        return ok

    def _viterbi(self, units: list[str]) -> list[bytes]:
        """Encodings of units of one length."""
        n, size = len(units[0]), len(units)
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(size, n).astype(np.uint64) + np.uint64(1)
        sums = np.zeros((n + 1, size), np.uint64)
        np.cumsum((points * self.powers[:n]).T, axis=0, dtype=np.uint64, out=sums[1:])
        last = np.full((n + 1, size), -1)
        back = np.zeros((n + 1, size), np.int64)
        best = np.full((n + 1, size), -np.inf)
        best[0] = 0
        for end in range(1, n + 1):
            # a prefix has one allowed arc, so a unit is done here once it has that
            todo = np.arange(size)
            for start in range(end - 1, max(-1, end - 1 - self.width), -1):
                found, piece = self.probe((sums[end, todo] - sums[start, todo]) * self.inverses[start])
                if end - start == 1 and len(found) < len(todo):
                    some = np.full(len(todo), self.unk)
                    some[found] = piece
                    found, piece = np.arange(len(todo)), some
                at = todo[found]
                ok = self.reachable[piece]
                if start:
                    ok &= self.compatible(last[start, at], piece)
                score = best[start, at] + self.scores[piece]
                ok &= score > best[end, at]
                at, piece = at[ok], piece[ok]
                best[end, at], back[end, at], last[end, at] = score[ok], start, piece
                todo = np.delete(todo, found[ok])
                if not len(todo):
                    break
        out = []
        for unit, pieces, starts in zip(units, last.T.tolist(), back.T.tolist(), strict=True):
            path, end = [], n
            while end:
                path.append(pieces[end])
                end = starts[end]
            path.reverse()
            out.append(self._pack(unit, path))
        return out

    def _pack(self, unit: str, path: list[int]) -> bytes:
        """The ids of a path, with unknown code points as the ids of their bytes."""
        if self.unk not in path:
            return array("i", path).tobytes()
        out, at = [], 0
        for i in path:
            size = 1 if i == self.unk else len(self.pieces[i])
            out += [self.byte_id[x] for x in unit[at].encode()] if i == self.unk else [i]
            at += size
        return array("i", out).tobytes()

    def _seams(self, unit: str) -> list[str]:
        """Parts of a unit between code points that no piece has side by side."""
        if unit[1:].isalpha() and len(unit) <= 32:
            return [unit]
        cuts = [0, *(k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.bigrams), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, units) -> None:
        """Encode units into the cache."""
        parts: dict[str, list[str]] = {}
        by_size: dict[int, set[str]] = {}
        done: dict[str, bytes] = {}
        for u in units:
            parts[u] = own = self._seams(u.replace(" ", SPACE))
            for x in own:
                known = self.cache.get(x.replace(SPACE, " ")) if len(own) > 1 else None
                if known is not None:
                    done[x] = known
                elif len(x) == 1:
                    done[x] = self._pack(x, [self.id_of.get(x, self.unk)])
                elif len(x) > LONGEST or x.startswith(SPACE * 2):
                    done[x] = self._pack(x, self.merge(x))
                else:
                    by_size.setdefault(len(x), set()).add(x)
        for group in by_size.values():
            some = sorted(group)
            for at in range(0, len(some), 20_000):
                done.update(zip(some[at : at + 20_000], self._viterbi(some[at : at + 20_000]), strict=True))
        self.cache.update((x.replace(SPACE, " "), i) for x, i in done.items())
        self.cache.update((u, done[own[0]] if len(own) == 1 else b"".join(map(done.__getitem__, own))) for u, own in parts.items())

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        out: list[bytes] = []
        held, size = [], 0
        for text in texts:
            held.append(_UNIT.findall(f" {text.replace(SPACE, ' ')}") if text else [])
            size += len(held[-1])
            if size > 300_000:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, units: list[list[str]]) -> list[bytes]:
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        new = set(chain.from_iterable(units)).difference(self.cache)
        if new:
            self.learn(new)
        known = self.cache.__getitem__
        return [b"".join(map(known, u)) for u in units]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


_codecs: dict[int, Codec] = {}


def _codec(shipped) -> Codec:
    """One codec for each worker process and vocabulary."""
    if shipped.id not in _codecs:
        _codecs.clear()
        _codecs[shipped.id] = Codec(shipped.model)
    return _codecs[shipped.id]


class Shipped:
    """The vocabulary as a broadcast, with a name by which workers keep their codec."""

    def __init__(self, spark, path: str):
        self._broadcast = spark.sparkContext.broadcast(load(path))
        self.id = path

    @property
    def model(self) -> dict:
        return self._broadcast.value


RESULTS = ("n_ids", "ids", "round_trip")


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str = MODEL) -> DataFrame:
    """keep, n_ids, ids and round_trip (whether the ids decode to the text) of each row. A kept
    column with the name of a result gets an underscore at its end."""
    shipped = Shipped(docs.sparkSession, path)
    plain, names = masked(docs)
    kept, text = [names[k] for k in keep], names["text"]

    def run(batches):
        codec = _codec(shipped)
        for b in (x for batch in batches for x in slices(batch, text, most_bytes=4 << 20)):
            some = b.column(text).to_pylist()
            packed = codec.encode_packed(some)
            same = [codec.decode(np.frombuffer(x, np.int32).tolist()) == (t or "") for x, t in zip(packed, some, strict=True)]
            n = np.array([len(x) // 4 for x in packed], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(n), ids, pa.array(same, pa.bool_())], [*kept, *RESULTS])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in plain.select(*kept).schema]
    out = plain.select(*dict.fromkeys([*kept, text])).mapInArrow(run, ", ".join([*fields, "n_ids long, ids array<int>, round_trip boolean"]))
    return out.select(*(F.col(names[k]).alias(f"{k}_" if k in RESULTS else k) for k in keep), *RESULTS)


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str = MODEL) -> DataFrame:
    """keep and text of encoded rows with ids."""
    shipped = Shipped(encoded.sparkSession, path)
    keep = list(keep)

    def run(batches):
        codec = _codec(shipped)
        for b in batches:
            texts = [codec.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema]
    return encoded.select(*keep, "ids").mapInArrow(run, ", ".join([*fields, "text string"]))
