"""Brute-force checks of the plain functions inside the operators."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import license, lz, minhash, mixing, pieces, quality, secret_crf, substring, urlfilter
from tessera.llm.automaton import SuffixAutomaton, long_spans


@given(st.lists(st.text("ab", max_size=12), max_size=3), st.text("abc", max_size=20))
def test_automaton(references, text):
    a = SuffixAutomaton()
    for r in references:
        a.add(r)
    want = [max((n for n in range(end + 1) if any(text[end - n : end] in r for r in references)), default=0) for end in range(1, len(text) + 1)]
    assert a.matches(text) == want
    covered = {i for end, n in enumerate(want, 1) if n >= 3 for i in range(end - n, end)}
    assert {i for s, e in long_spans(want, 3) for i in range(s, e)} == covered


@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4))
def test_repeat_words(lists):
    def brute(x):
        w = [tuple(x[i : i + 8]) for i in range(len(x) - 7)]
        return len({j for i, v in enumerate(w) if w.count(v) > 1 for j in range(i, i + 8)})

    texts = [" ".join(map(str, x)) for x in lists]
    assert quality.text_metrics(texts)[4] == [brute(x) for x in lists]


def test_metrics():
    m = quality.text_metrics(["a b\n\na b\n # é\t$", None, "", " \n "])
    assert m == [[7, 0, 0, 0], [7, 0, 0, 0], [2, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0]]


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.02), (50, 50, 0.3), (7, 30, 0.5)])
def test_binomial(k, n, p):
    assert math.isclose(quality.binomial_cdf(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_choose_level():
    assert quality.choose_level(5000, [0, 1, 400], 0.01, 1e-4) == 1
    assert quality.choose_level(50, [0, 0, 0], 0.01, 1e-4) == -1 and quality.choose_level(0, [0, 0, 0], 0.01, 1e-4) == -1
    assert quality.choose_level(5000, [0, 0, 0], 0.01, 1e-4) == 2


@given(st.text("abé日", max_size=60), st.text("ab", max_size=40))
def test_phrases(text, following):
    known: set[str] = set()
    lz.parse(text, 0, known)
    want, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in want:
            end += 1
        want.add(text[at:end])
        at = end
    assert known == want
    doc = lz.Parsed(text)
    new, mark = doc.edited(following)
    third = len(text) // 3
    assert new == text[: len(text) - third] + following[:third]
    assert (mark == lz.fingerprint(new)).all() and (doc.mark == lz.fingerprint(text)).all()


def test_likeness():
    rng = random.Random(1)
    a = "".join(rng.choices("abcdefgh", k=4000))
    b = a[:3000] + "".join(rng.choices("abcdefgh", k=1000))
    c = "".join(rng.choices("ijklmnop", k=4000))
    f = [lz.fingerprint(x) for x in (a, b, c, "")]
    assert lz.likeness(f[0], f[0]) == 1 == lz.likeness(f[3], f[3]) and lz.likeness(f[0], f[3]) == 0
    assert lz.likeness(f[0], f[1]) > 0.45 > 0.1 > lz.likeness(f[0], f[2])


def brute_viterbi(scores, moves):
    paths = itertools.product(range(3), repeat=len(scores))
    value = lambda p: moves[2, p[0]] + sum(scores[i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))
    return max(paths, key=value)


def test_crf_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(30):
        scores, moves = rng.normal(size=(rng.integers(1, 6), 3)), rng.normal(size=(3, 3))
        assert tuple(secret_crf.viterbi(scores, moves)) == brute_viterbi(scores, moves)


def test_crf_expectations():
    """Forward-backward against the sum over all paths."""
    rng = np.random.default_rng(3)
    scores, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    expect, pairs, logs = secret_crf._expected(scores, moves, np.ones((1, 4), bool))
    total, want, want_pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for p in itertools.product(range(3), repeat=4):
        steps = list(itertools.pairwise((2, *p)))
        v = math.exp(sum(moves[a, b] for a, b in steps) + sum(scores[0, i, x] for i, x in enumerate(p)))
        total += v
        for i, x in enumerate(p):
            want[i, x] += v
        for a, b in steps:
            want_pairs[a, b] += v
    assert np.allclose(expect[0], want / total) and np.allclose(pairs, want_pairs / total) and np.isclose(logs, math.log(total))


def test_crf_learns_and_finds():
    rng, classes, lines = random.Random(5), secret_crf._Classes(), []
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    secret = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    for i in range(120):
        text = f"{word()} {word()} token = \"{secret()}\" {word()} {word()}" if i % 2 else f"{word()} {word()} {rng.randint(1, 2000)} a-b {word()}"
        starts, ends, kinds = secret_crf.tokens_of(text, classes)
        value = [(m.start(2), m.end(2)) for m in secret_crf.ASSIGN.finditer(text)]
        labels = [secret_crf.BEGIN if any(s < e2 and s2 < e for s2, e2 in value) else secret_crf.OUTSIDE for s, e in zip(starts, ends, strict=True)]
        lines.append((kinds.tolist(), labels, secret_crf.file_features(text)))
    w = secret_crf.fit(lines)
    hidden = f"some words passcode = \"{secret()[:30]}\" and more"
    assert [hidden[s:e] for s, e in secret_crf.crf_spans(hidden, w, classes)] == [re.search('"(.*)"', hidden)[1]]
    assert secret_crf.crf_spans("plain words, and 12 more of them.", w, classes) == []


@given(st.text("tokenTOKEN=:\"' aAKIA019f\n", max_size=120))
def test_base_spans(text):
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Tt][Oo][Kk][Ee][Nn])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    assert secret_crf.base_spans(text) == sorted(want)


@pytest.mark.parametrize(("percent", "size"), [(80, 64), (85, 64), (85, 512)])
def test_threshold(percent, size):
    t, p = minhash.collision_threshold(percent, size), percent / 100
    tail = lambda n: sum(math.comb(size, i) * p**i * (1 - p) ** (size - i) for i in range(n))
    assert tail(t) <= 1e-6 < tail(t + 1)


@given(st.lists(st.sampled_from(["a", "B", "b", "é"]), max_size=12))
def test_shingles(words):
    low = [w.replace("B", "b") for w in words]
    want = {tuple(low[i : i + 3]) for i in range(len(low) - 2)} or ({tuple(low)} if low else set())
    assert len(minhash.shingle_set(" ".join(words), 3, minhash.WordHashes())) == len(want)


@given(st.lists(st.integers(0, 3), min_size=13, max_size=60))
def test_anchors(items):
    """Equal windows have equal anchors."""
    w = np.array([minhash.WordHashes()[str(x).encode()] for x in items], np.uint64)
    keys, seen = substring.anchors(w, 13, 8), {}
    assert len(keys) == len(items) - 12
    for i, k in enumerate(keys.tolist()):
        assert seen.setdefault(tuple(items[i : i + 13]), k) == k


@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=3), st.integers(1, 50)), max_size=5), st.text("abc", min_size=1, max_size=7))
def test_segment(counts, name):
    known = dict(counts)
    total = max(sum(known.values()), 2)
    p = lambda w: math.log(known[w] / total) if w in known else -math.log(total) - len(w) * math.log(10)
    cuts = [[name[a:b] for a, b in itertools.pairwise((0, *c, len(name)))] for n in range(len(name)) for c in itertools.combinations(range(1, len(name)), n)]
    got = urlfilter.segment(name, known, sum(known.values()))
    assert "".join(got) == name and math.isclose(sum(map(p, got)), max(sum(map(p, c)) for c in cuts), abs_tol=1e-9)


def test_license_templates():
    m = license.Matcher({}, 1.0)
    for text, name in (("Released under the MIT License.", "MIT"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")):
        score, found = m.best(text)
        assert found == name and score > 0.5
    assert all(m.best(t)[1] == name and m.best(t)[0] > 0.99 for name, texts in license.TEMPLATES.items() for t in texts)
    assert m.best("The permission of the king was needed.")[0] < 0.5


def test_license_cosine():
    """The index gives the plain cosine to every template."""
    weights = {license.bucket("mit license"): 2.5, license.bucket("released under"): 0.5}
    m = license.Matcher(weights, 1.25)
    weigh = lambda t: weights.get(license.bucket(t), 1.25)

    def vector(text):
        words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())
        pairs = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)) or Counter(words)
        return {t: (1 + math.log(n)) * weigh(t) for t, n in pairs.items()}

    def cosine(a, b):
        return sum(a[t] * b.get(t, 0) for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    for text in ("Released under the MIT License. MIT license!", "licensed under the apache license", "you may obtain a copy", "isc", "nothing of it here"):
        want = max(cosine(vector(text), vector(t)) for texts in license.TEMPLATES.values() for t in texts)
        assert math.isclose(m.best(text)[0], want, abs_tol=1e-12)


def test_selected_text():
    text = " a b\n c  d e"
    assert mixing.selected_text(text, [[0, 5]]) == text and mixing.selected_text(text, [[1, 2], [2, 3]]) == "b\n c" and mixing.selected_text(text, [[0, 1], [4, 5]]) == "a\ne"


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("abcdefgh ieou\n.,", max_size=80))
def test_pieces(codec, library, text):
    ids = codec.encode([text])[0]
    assert ids == library.encode(text.replace("▁", " "))
    assert codec.decode(ids) == text.replace("▁", " ")


def test_long_pieces(codec, library):
    for text in ("a" * 3000, "ab" * 700, " " * 999 + "x", "日本語" * 400, "", "x\n\n y"):
        assert codec.encode([text])[0] == library.encode(text) and codec.decode(codec.encode([text])[0]) == text
