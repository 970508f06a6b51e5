"""Operator 11: token counts by rank-synchronous merging of ragged arrays.

A text is cut at the vocabulary's special strings (one token each), the rest into pre-tokens by
the byte-level pattern. The distinct new pre-tokens of a slice are laid out as one ragged numpy
array of symbols; in each round every sequence finds its pair of the lowest rank and merges all
its occurrences, left to right, all sequences at once. Sequences without a pair left are done,
and the surviving symbols of a pre-token are its tokens. A pre-token is laid out as several
sequences where two neighbouring bytes are neighbours in no piece of the vocabulary: no merge can
reach over such a seam.

The pattern's letters and numbers are those of the tokenizer library, whose Unicode version
differs from that of the regex module: code points that Python's own tables do not assign are
put to the library's pre-tokenizer once, and those that it does not take for letters or numbers
are taken out of the classes.

Defined results: null text counts as empty and has no bytes and no tokens; special strings inside
texts are one token each, as the library has it; texts of any length are counted whole, their
pre-tokens in blocks; rows with equal texts, equal or null doc_ids are counted each; an empty
table gives an empty result; extra columns are ignored. What a task keeps is bounded by bytes.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import slices

VOCABULARY = "byte_bpe_50k.json"
#: What the byte-level pre-tokenizer takes for a pre-token; {L} and {N} stand for
#: letters and numbers. The commonest comes first; no two of the first three can start alike.
PATTERN = r" ?{L}+|'(?:[stmd]|re|ve|ll)| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a text that are held at a time, and bytes of pre-tokens whose counts are kept.
BLOCK, KEPT_BYTES = 1 << 16, 48 << 20
_NONE = np.int32(1 << 30)


def _later(tokenizer: Tokenizer) -> list[list[int]]:
    """Ranges of the code points that are letters or numbers for regex but not for the tokenizer."""
    known = regex.compile(r"[\p{L}\p{N}]")
    asked = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and known.match(c)]
    # a full stop joins only what is neither letter, number nor space
    starts = {start for _, (start, _) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f".{c}\n" for c in asked))}
    out: list[list[int]] = []
    for i, c in enumerate(asked):
        if 3 * i + 1 not in starts:
            if out and out[-1][1] == ord(c) - 1:
                out[-1][1] += 1
            else:
                out.append([ord(c), ord(c)])
    return out


class Model:
    """The ranks of a byte-level BPE vocabulary as arrays, and its pre-tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = not (spec["normalizer"] or split["add_prefix_space"] or model["byte_fallback"] or model["ignore_merges"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"])
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or not plain or not split["use_regex"]:
            raise ValueError(f"{path}: only plain byte-level BPE")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: special tokens with rules of their own")
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        # the visible characters that stand for bytes: printable ones for themselves, the rest from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        vocab, self.size = model["vocab"], len(model["vocab"])
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.int64(1) << 62), np.append(order.astype(np.int32), _NONE)
        self.joined = np.zeros((256, 256), bool)
        for token in {a + b for a, b in merges}:
            at = [letters[c] for c in token]
            self.joined[at[:-1], at[1:]] = True
        self.first = np.full((256, 256), _NONE, np.int32)
        left, right = np.meshgrid(self.of_byte, self.of_byte, indexing="ij")
        self.first[:] = self.rank(left.ravel(), right.ravel()).reshape(256, 256)
        self.later = _later(Tokenizer.from_file(path))
        self.least_later = min((a for a, _ in self.later), default=sys.maxunicode + 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word (one byte at least each)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        out = np.zeros(len(words), np.int64)
        bound = np.ones(len(data), bool)  # the last symbol of a sequence
        bound[:-1] = (word[1:] != word[:-1]) | ~self.joined[data[:-1], data[1:]]
        sym, rank = self.of_byte[data], np.full(len(data), _NONE, np.int32)
        rank[:-1] = self.first[data[:-1], data[1:]]
        rank[bound] = _NONE
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], bound[:-1]]))
            size = np.diff(np.append(start, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, start), size)
            live = least < _NONE
            if not live.all():
                out += np.bincount(word[~live], minlength=len(out))
                sym, rank, bound, word, least = (x[live] for x in (sym, rank, bound, word, least))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            # of pairs that overlap, which are of one symbol twice, every other one merges
            step = np.diff(at, prepend=-2) != 1
            if not step.all():
                run = np.flatnonzero(step)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            bound[at] = bound[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # the places of the merged symbols after the removal
            sym, rank, bound, word = sym[keep], rank[keep], bound[keep], word[keep]
            # only the pairs beside a merged symbol have another rank
            touched = np.concatenate([new, new[(new > 0)] - 1])
            touched = touched[touched < len(sym)]
            rank[touched] = _NONE
            touched = touched[~bound[touched]]
            rank[touched] = self.rank(sym[touched], sym[touched + 1])
        return out


class Counter:
    """Counts the tokens of texts; keeps the counts of pre-tokens, up to a bound of bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.fast = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}"))
        later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in model.later)
        self.exact = regex.compile(PATTERN.format(L=rf"[\p{{L}}--[{later}]]", N=rf"[\p{{N}}--[{later}]]"), regex.V1) if later else self.fast
        self.split = regex.compile("|".join(map(regex.escape, model.special))) if model.special else None
        self.known: dict[str, int] = {}
        self.held = 0

    def blocks(self, text: str) -> Iterator[list[str]]:
        greatest = np.frombuffer(text.encode("utf-32-le"), np.uint32).max(initial=0)
        pattern = self.fast if greatest < self.model.least_later else self.exact
        if len(text) <= 4 * BLOCK:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def count(self, texts: list[str]) -> list[int]:
        total, waiting, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            parts = self.split.split(text) if self.split else [text]
            total[i] += len(parts) - 1
            for part in parts:
                for block in self.blocks(part):
                    waiting.append((i, block))
                    size += len(block)
                    if size >= BLOCK:
                        self._add(waiting, total)
                        waiting, size = [], 0
        self._add(waiting, total)
        return total

    def _add(self, waiting: list[tuple[int, list[str]]], total: list[int]) -> None:
        known = self.known
        if new := list({w for _, block in waiting for w in block if w not in known}):
            coded = [w.encode() for w in new]
            known.update(zip(new, self.model.counts(coded).tolist(), strict=True))
            self.held += sum(map(len, coded)) + 100 * len(coded)
        for i, block in waiting:
            total[i] += sum(map(known.__getitem__, block))
        if self.held > KEPT_BYTES:
            self.known, self.held = {}, 0


def count_tokens(docs: DataFrame, limit: int = 512, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each of docs(doc_id, text): UTF-8 bytes,
    tokens, and whether there are more than limit. vocabulary: a tokenizer file of byte-level
    BPE, read on the driver; only its arrays, of a fixed size, go to the executors."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(vocabulary or public_tokenizers.path(VOCABULARY)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = Counter(shared.value)
        for batch in (s for b in batches for s in slices(b, "text")):
            n = counter.count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
