"""Token counts, the prefix trie and whitening, against the library, brute force and numpy."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokencount, trie, whitening
from tessera.llm.queries import QUERIES

ALPHABET = ["a", "b", "aa", " ", "  ", "\n", "'s", "'ll", "'", "é", "你", "<|endoftext|>", "<|endof", "1", "٣", "　", "\x1c", "\x85", "​", "\U00010940", "\U0001d6a6", "ᲊ", "😀", "!", "zq", "\t", "\x00", "̀", "the", "꟎", "\U000323b0", "²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokencount.VOCABULARY))


@pytest.fixture(scope="module")
def model():
    return tokencount.Model(public_tokenizers.path(tokencount.VOCABULARY))


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_mixed_texts_are_the_librarys(model, library):
    draw = random.Random(1)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(60))) for _ in range(5000)]
    assert tokencount.Counter(model).count(texts) == counted(library, texts)


def test_every_code_point_is_cut_as_by_the_library(model, library):
    """Each code point after a letter, a number, a sign and a space."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"b{c}b 1{c}1 .{c}." for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    assert tokencount.Counter(model).count(texts) == counted(library, texts)


def test_long_texts_without_spaces(model, library):
    draw = random.Random(2)
    texts = ["".join(draw.choice("etaoin") for _ in range(100_000)), "a" * 99_999, "你好" * 50_000, "ab " * 100_000, "<|endoftext|>" * 3 + "x"]
    assert tokencount.Counter(model).count(texts) == counted(library, texts)


def test_kept_counts_are_bounded(model, library, monkeypatch):
    monkeypatch.setattr(tokencount, "KEPT_BYTES", 1000)
    monkeypatch.setattr(tokencount, "BLOCK", 16)
    counter = tokencount.Counter(model)
    texts = [f"word{i} other{i * 7} and so on" for i in range(300)]
    assert counter.count(texts) == counted(library, texts) and counter.held <= 1000


def test_token_counts_of_the_whole_table(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    n = dict(zip(texts, counted(library, list(texts.values())), strict=True))
    got = QUERIES["op11_token_counts"](spark, small).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == {d: (d, len(t.encode()), n[d], n[d] > 512) for d, t in texts.items()}


def test_token_counts_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", None), (None, "a b", "y"), (None, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    assert sorted(map(tuple, tokencount.count_tokens(docs, limit=1).collect()), key=str) == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, True), (None, 3, 2, True)], key=str)
    assert tokencount.count_tokens(docs.limit(0)).count() == 0


# ---- trie ----


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, role or "", text or ""))
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        built[conv] = [t[3:] for t in sorted(own.get(base, []))[:h] + sorted(turns)[h:]]
    members, kids = defaultdict(list), defaultdict(list)
    for conv in sorted(built):
        for d in range(len(built[conv]) + 1):
            members[tuple(built[conv][:d])].append(conv)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved, out = {}, {}, set()
    for path in sorted(members, key=len, reverse=True):
        m = members[path]
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(m) - 1) * (len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in m if len(built[c]) == len(path))
        out.add((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


_CONVERSATION = "conv_id long, turn long, role string, text string"


def built_trie(df):
    got = [tuple(r) for r in trie.prefix_trie(trie.rebuilt(df)).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed, size", [(0, 1), (1, 40), (2, 900)])
def test_trie_of_random_conversations(spark, seed, size):
    draw = random.Random(seed)
    rows = [(draw.choice([None, *range(0, 400, 7), -5, -100, -203]), draw.choice([None, *range(9)]), draw.choice(["a", "b", None]), draw.choice(["x", "yy", "é", None, ""])) for _ in range(size)]
    assert built_trie(spark.createDataFrame(rows, _CONVERSATION)) == trie_by_hand(rows)


def test_trie_of_copies_over_boundaries(spark, monkeypatch):
    """Runs of equal conversations over many partitions, groups of two, ids in small pieces."""
    monkeypatch.setattr(trie, "GROUP", 2)
    monkeypatch.setattr(trie, "PART_ROWS", 60)
    rows = [(c, t, "user", "hello"[: t % 3 + 1]) for c in range(700) for t in range(c % 3 + 1)]
    assert built_trie(spark.createDataFrame(rows, _CONVERSATION)) == trie_by_hand(rows)


def test_trie_of_long_conversations_and_extra_columns(spark):
    rows = [(c, t, "user", str(t if t < 300 * c else -c)) for c in range(1, 6) for t in range(900)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], _CONVERSATION + ", depth int, saved int")
    assert built_trie(df) == trie_by_hand(rows)


def test_trie_of_an_empty_table_and_the_given_one(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    assert built_trie(df.limit(0)) == set()
    assert {tuple(r) for r in QUERIES["op12_prefix_trie"](spark, small).collect()} == trie_by_hand([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])


# ---- whitening ----


def whitened_by_hand(vectors, weights, k):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    fit = x if weights == "counts" else np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    off = (n * x - total) / n
    base = (n * fit - total) / n
    values, parts = np.linalg.eigh(base.T @ base / n)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    return n, [int(v) for v in ((n * x.astype(object) - total.astype(object)) ** 2).sum(1)], off @ parts / np.sqrt(values), values / np.trace(base.T @ base / n)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_with_copies(spark, weights):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(400, 6)) * [5, 3, 2, 1, 0.5, 0.2]
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 300, 0)])
    df = spark.createDataFrame([(i, v, "t") for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>, x string")
    got = sorted(whitening.whiten(df, components=4, weights=weights).collect())
    n, deviations, y, explained = whitened_by_hand(vectors, weights, 4)
    assert [r["vec_id"] for r in got] == list(range(700)) and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got] == deviations
    mine = np.array([r["whitened"] for r in got])
    assert np.abs(mine * np.sign((mine * y).sum(0)) - y).max() < 1e-9
    assert np.allclose(got[0]["explained"], explained, rtol=1e-9) and got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.0, 0.5]), (3, None), (4, [1.0, None]), (5, [inf, 1.0]), (6, [nan, 1.0]), (7, [1.0]), (8, []), (9, [1e300, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "2", "7", "8", "9", "None"]
    assert all((r["whitened"] is None) == (r["vec_id"] in (7, 8)) for r in got) and got[0]["vec_id"] is not None
    far = next(r for r in got if r["vec_id"] == 9)
    assert far["deviation"] is None and far["n"] == 5
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in whitening.whiten(same).collect()] == [(0, [None, None], [0.0, 0.0], None)] * 2
    assert whitening.whiten(same.limit(0)).count() == 0 and whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_whitening_query_of_the_whole_table(spark, small):
    rows = sorted(spark.read.parquet(f"{small}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    n, deviations, y, explained = whitened_by_hand([r["embedding"] for r in rows], "counts", 8)
    got = sorted(QUERIES["op13_embedding_whitening"](spark, small).collect())
    assert [(r["vec_id"], r["component"]) for r in got] == [(r["vec_id"], k) for r in rows for k in range(1, 9)]
    assert [r["deviation"] for r in got[::8]] == deviations
    mine = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    assert np.abs(mine * np.sign((mine * y).sum(0)) - y).max() < 1e-7
    assert np.allclose([r["explained"] for r in got[:8]], explained, rtol=1e-9) and {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-4
