"""Secrets of letters alone, neighbouring words, and the training sample."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import secret_crf as crf

RNG = random.Random(4)
LOW, MIXED = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word():
    return "".join(RNG.choices(LOW, k=RNG.randint(2, 14)))


def mixed(n=20):
    return "aB" + "".join(RNG.choices(MIXED, k=n))


def line_of(text, value, classes):
    starts, ends, kinds = crf.tokens_of(text, classes)
    labels = [crf.BEGIN if value and text[s:e] == value else crf.OUTSIDE for s, e in zip(starts, ends, strict=True)]
    return kinds.tolist(), labels, crf.file_features(text)


def tagged(text, weights):
    return [text[s:e] for s, e in crf.crf_spans(text, weights, crf._Classes())]


def test_letters_only():
    classes, lines = crf._Classes(), []
    for i in range(200):
        v = mixed(RNG.randint(6, 40))
        lines.append(line_of(f"{word()} {RNG.choice(['password', word()])}: {v}", v, classes) if i % 2 else line_of(f"{word()} note: {word()} {word()} {word().title()}.", "", classes))
    w = crf.fit(lines)
    assert tagged("pwd: CorrectHorseBatteryStaple", w) == ["CorrectHorseBatteryStaple"]
    assert tagged("only words\n\npass: QwErTyUiOpAsDfGhJkLz\nwords: considerations of Straßenbahnen, internationally.", w) == ["QwErTyUiOpAsDfGhJkLz"]


def test_skipped_lines_are_exact():
    """crf_spans equals the decoding of every line by brute weights."""
    rng = np.random.default_rng(1)
    classes = crf._Classes()
    for _ in range(40):
        w = crf.fit([line_of("a b", "", classes)], 0)
        w = {k: rng.normal(size=v.shape) for k, v in w.items()}
        for k in ("here", "moves"):
            w[k][..., crf.OUTSIDE] += 2
        text = "\n".join(" ".join(RNG.choice([word(), mixed(8), "=", '"', "a1b2c3d4e5", ".", "é", "x_y"]) for _ in range(RNG.randint(0, 6))) for _ in range(8))
        want, at = [], 0
        for line in text.split("\n"):
            starts, ends, kinds = crf.tokens_of(line, classes)
            labels = crf.viterbi(crf.emissions(w, kinds, crf.file_features(text)), w["moves"]) if len(kinds) else []
            for i, y in enumerate(labels):
                if y == crf.BEGIN:
                    end = next((k for k in range(i + 1, len(labels)) if labels[k] != crf.INSIDE), len(labels))
                    want.append((at + starts[i], at + ends[end - 1]))
            at += len(line) + 1
        assert crf.crf_spans(text, w, classes) == want


def test_neighbouring_words():
    """Values of one shape, told apart by the word before them alone."""
    classes, lines = crf._Classes(), []
    for i in range(300):
        v = "".join(RNG.choices("0123456789abcdef", k=24))
        head = RNG.choice([("bearer", " "), ("pwd", ': "'), ("credential", " = ")] if i % 2 else [("commit", " "), ("digest", ': "'), ("trace", " = ")])
        lines.append(line_of(f"{word()} {''.join(head)}{v}{'"' * ('"' in head[1])} {word()}", v if i % 2 else "", classes))
    w = crf.fit(lines)
    assert tagged("at 1 Bearer 0a1b2c3d4e5f60718293a4b5 end\nat 1 commit 0a1b2c3d4e5f60718293a4b5 end", w) == ["0a1b2c3d4e5f60718293a4b5"]
    text = 'x PWD: "0a1b2c3d4e5f60718293a4b5" end\nx digest: "0a1b2c3d4e5f60718293a4b5" end'
    assert crf.crf_spans(text, w, classes) == [(8, 32)]


def sampled(texts):
    return [(r["kinds"], r["labels"]) for b in crf._sample_lines([pa.RecordBatch.from_pydict({"text": texts})]) for r in b.to_pylist()]


def test_sample_of_lines(spark):
    text = "\n".join(f"{word()} {word()} in line {i}" for i in range(400))
    drawn = sampled([text])
    first = [crf.tokens_of(x, crf._Classes())[2].tolist() for x in text.split("\n")[:20]]
    assert len(drawn) == crf.WITHOUT and sum(k in first for k, _ in drawn) <= 2
    assert max(len(k) for k, _ in sampled([" ".join(word() for _ in range(500))])) == 60
    # the bound on all lines keeps lines that begin with a secret's name, and long texts train too
    value = lambda i: f"{i:04}" + "".join(RNG.choices("0123456789abcdef", k=12))
    texts = ["\n".join(f'{RNG.choice(["api_key", word() + " token"])} = "{value(i)}"' for i in range(40)) for _ in range(5)] + ["\n".join(f"{word()} goes on" for _ in range(9000)) + '\napi_key = "0a1b2c3d4e5f"']
    assert len(texts[-1]) > 50_000
    seen = []
    fit, crf.fit = crf.fit, lambda lines, rounds: seen.append(lines)
    try:
        crf.train(spark.createDataFrame([(t,) for t in texts], "text string"), sample_docs=4)
        crf.train(spark.createDataFrame([(texts[-1],)], "text string"))
    finally:
        crf.fit = fit
    name = crf.token_code("api_key")
    # the sampled lines, then VARIED copies of those with a span
    assert len(seen[0]) == 64 * (1 + crf.VARIED) and 16 < sum(k[0] == name for k, _, _ in seen[0][:64]) < 48
    assert any(k[0] == name for k, _, _ in seen[1]) and not any(k[0] == name for k, _, _ in seen[0][64:])
