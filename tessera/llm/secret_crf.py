r"""Operator 2: secret scans with a linear-chain conditional random field.

Three base patterns (assign, access, hex) find secrets exactly. A linear-chain CRF, trained here
on a bounded, seeded sample of lines that the base patterns label, adds further spans: it tags
each token of a line as begin, inside or outside, from shape classes of the token and of its
neighbours, from their lower-cased words hashed into N_WORDS buckets (those beside it, and the
last word before it past any marks), and from features of the whole file, decoded by Viterbi. Only sentence punctuation,
letters beyond ASCII and words of one case with fewer letters than the shortest assigned secret
are outside by construction. A line is left undecoded only if no token's scores can make up for
leaving the all-outside path, which is exact; all other lines are decoded whole.

Each sampled line with a span also trains in VARIED copies under other names and, but for one, with
drawn values of other shapes, as the base patterns know few names and a table may have few shapes;
a third of those without one also in a copy of drawn words.

Defined results: null text counts as empty; empty texts have no spans; texts of any length are
scanned whole, in slices bounded by bytes; a doc_id that is no number counts as null; repeated rows each give
a row; ties in Viterbi go to the lower label (begin, inside, outside); if no line of the table
has a base span, the CRF adds none; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, masked, slices, unmasked

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+=*|[^\sA-Za-z0-9+/_.\-]+|\s+")
#: The same tokens without white space, and the line breaks.
_LINED = re.compile(r"[A-Za-z0-9+/_.\-]+=*|[^\sA-Za-z0-9+/_.\-]+|\n")
#: Characters that an assigned secret has at least.
LEAST = 8
_PLAIN = re.compile(r"[^\W\d_]+\.?|[.,;:?!()'\"\-]+")
_LENGTHS = (4, 8, 16, 24, 32, 48)
BEGIN, INSIDE, OUTSIDE = 0, 1, 2

#: Token classes: 0 plain, 1 keyword, 2 assignment mark, 3 quote, then form x length x digit share, and the edge of a line.
N_CLASSES = 4 + 8 * 7 * 3 + 1
EDGE = N_CLASSES - 1
N_FILE = 6
#: Buckets of words; 0 is no word, 1 the edge of a line. A token's code is its class + N_CLASSES * bucket.
N_WORDS = 1 << 12
_NAME = re.compile(r"[A-Za-z][A-Za-z_.\-]{0,31}|[^\W\d_]{1,32}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    spans = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def token_class(token: str) -> int:
    if token.rstrip("=").lower() in _KEYS:
        return 1
    if _PLAIN.fullmatch(token) and not set(token) <= set(":\"'"):
        core = token.removesuffix(".")
        one_case = core.isupper() or core[1:] == core[1:].lower()
        if not (core.isascii() and core.isalpha()) or one_case and len(core) < LEAST:
            return 0
        return 4 + ((6 if one_case else 7) * 7 + sum(len(core) >= x for x in _LENGTHS)) * 3
    if token == "\n":
        return EDGE
    if set(token) <= set("=:"):
        return 2
    if set(token) <= set("\"'"):
        return 3
    digits = sum(c.isdigit() for c in token)
    core = token.strip("=")
    if not any(c.isalnum() for c in token):
        form = 0
    elif re.fullmatch(r"[0-9a-f]+", core) and digits < len(core):
        form = 1
    elif digits == len(core):
        form = 2
    elif re.fullmatch(r"[A-Z0-9]+", core):
        form = 3
    elif re.fullmatch(r"[A-Za-z0-9]+", core):
        form = 4
    else:
        form = 5
    length = sum(len(token) >= x for x in _LENGTHS)
    share = 0 if digits == 0 else 1 if 3 * digits < len(token) else 2
    return 4 + (form * 7 + length) * 3 + share


def token_code(token: str) -> int:
    word = token.rstrip("=").strip(".").lower()
    bucket = 1 if token == "\n" else 2 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (N_WORDS - 2) if _NAME.fullmatch(word) else 0
    return token_class(token) + N_CLASSES * bucket


class _Classes(dict):
    def __missing__(self, token):
        if len(self) > 500_000:
            self.clear()
        out = self[token] = token_code(token)
        return out


def file_features(text: str) -> int:
    """Shape of the whole file: share of lines with '=' or ':' (3 levels), any key word."""
    lines = text.count("\n") + 1
    marks = text.count("=") + text.count(":")
    low = text.lower()
    return (0 if marks == 0 else 1 if 2 * marks < lines else 2) * 2 + any(k in low for k in _KEYS)


def tokens_of(line: str, classes: dict) -> tuple[list[int], list[int], np.ndarray]:
    """Starts, ends and codes of the tokens of a line."""
    starts, ends, kinds, at = [], [], [], 0
    for piece in _TOKEN.findall(line):
        if not piece[0].isspace():
            starts.append(at)
            ends.append(at + len(piece))
            kinds.append(classes[piece])
        at += len(piece)
    return starts, ends, np.array(kinds, np.int64)


_BREAK = EDGE + N_CLASSES
_SHAPES = ("here", "back2", "back1", "next1")
_WORDS = ("word2", "word1", "word_next", "word_last")


def _neighbours(codes: np.ndarray) -> dict[str, np.ndarray]:
    """Of each token, the rows of the weight tables that it takes; lines are apart by two edges."""
    edge = np.full(2, _BREAK)
    words, pad = np.divmod(np.concatenate([edge, codes, edge]), N_CLASSES)
    last = words[np.maximum.accumulate(np.where(words > 0, np.arange(len(words)), 0))]
    return dict(zip(_SHAPES, (pad[2:-2], pad[:-4], pad[1:-3], pad[3:-1]), strict=True)) | dict(zip(_WORDS, (words[:-4], words[1:-3], words[3:-1], last[1:-3]), strict=True))


def emissions(weights: dict, codes: np.ndarray, file_kind: int) -> np.ndarray:
    """[n, 3] scores of the labels; plain tokens and edges can only be outside."""
    out = np.repeat(weights["file"][file_kind][None], len(codes), 0)
    for name, rows in _neighbours(codes).items():
        out += weights[name][rows]
    out[_fixed(codes), :OUTSIDE] = -np.inf
    return out


def _fixed(codes: np.ndarray) -> np.ndarray:
    kinds = codes % N_CLASSES
    return (kinds == 0) | (kinds == EDGE)


def viterbi(scores: np.ndarray, moves: np.ndarray, goes_on: bool = False) -> list[int]:
    """Best labels of a chain; the label before the first token is outside, and so is the one after
    the last where the line goes on."""
    best, back = scores[0] + moves[OUTSIDE], []
    for row in scores[1:]:
        all_moves = best[:, None] + moves
        back.append(all_moves.argmax(0))
        best = all_moves.max(0) + row
    path = [int((best + moves[:, OUTSIDE] if goes_on else best).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def crf_spans(text: str, weights: dict, classes: dict) -> list[tuple[int, int]]:
    """(start, end) of the tagged secrets. Tokens that can only be outside cut a line into parts
    that are decoded one by one, which is exact. A part is decoded only if leaving the all-outside
    path could pay: some start of a span with the best run of later tokens and the best way out.
    All other parts have no span, so passing them over is exact too."""
    found = _LINED.findall(text.replace("\n", "\n\n"))
    if not found:
        return []
    moves = weights["moves"]
    kinds = np.fromiter(map(classes.__getitem__, found), np.int64, len(found))
    scores = emissions(weights, kinds, file_features(text))
    loss = scores[:, OUTSIDE] + moves[OUTSIDE, OUTSIDE]
    start = (scores[:, :OUTSIDE] + moves[OUTSIDE, :OUTSIDE]).max(1) - loss
    later = np.maximum((scores[:, :OUTSIDE] + moves[:OUTSIDE, :OUTSIDE].max(0)).max(1) - loss, -1e5)
    sums = np.cumsum(later)
    run = np.maximum.accumulate(sums[::-1])[::-1] - sums
    way_out = max(0.0, float(moves[:OUTSIDE, OUTSIDE].max() - moves[OUTSIDE, OUTSIDE]))
    hot = np.flatnonzero(start + run + way_out >= -1e-3)
    if not len(hot):
        return []
    fixed = np.flatnonzero(_fixed(kinds))
    places = [m.span() for m in _LINED.finditer(text)]
    # each line break was there twice
    breaks = np.cumsum([x == "\n" for x in found]) // 2
    spans = []
    for part in np.unique(np.searchsorted(fixed, hot)).tolist():
        a = int(fixed[part - 1]) + 1 if part else 0
        b = int(fixed[part]) if part < len(fixed) else len(found)
        shift = int(breaks[a])
        open_at = None
        for i, label in enumerate([*viterbi(scores[a:b], moves, b < len(found) and found[b] != "\n"), OUTSIDE], a):
            if open_at is not None and label != INSIDE:
                spans.append((places[open_at - shift][0], places[i - 1 - shift][1]))
                open_at = None
            if label == BEGIN:
                open_at = i
    return spans


def scan(text: str | None, weights: dict | None, classes: dict) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans: base ones, and tagged ones that overlap none of them."""
    text = text or ""
    base = base_spans(text)
    added = []
    if weights is not None:
        added = [(s, 3, e) for s, e in crf_spans(text, weights, classes) if not any(s < e2 and s2 < e for s2, _, e2 in base)]
    return sorted(base + added) if added else base


# ---- training, on a bounded sample ----


#: Of each sampled text, at most so many lines with a span and without one, by least seeded hash.
WITH_SPAN, WITHOUT = 16, 6
#: Copies of each sampled line with a span, under other names and with other values.
VARIED = 6


def _line_seed(line: str) -> int:
    return zlib.crc32(line.encode("utf-8", "surrogatepass"), 17)


def _sample_lines(batches):
    """Lines of sampled texts as (code list, labels, file features, seed), at most 60 tokens each."""
    classes = _Classes()
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            value = sorted([(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST] + [(s, e) for s, k, e in base_spans(text) if k])
            file_kind, at, v = file_features(text), 0, 0
            drawn: tuple[list, list] = ([], [])
            for line in text.split("\n"):
                inside = []
                while v < len(value) and value[v][0] < at + len(line):
                    inside.append((value[v][0] - at, value[v][1] - at))
                    v += 1
                if inside or line.strip():
                    drawn[not inside].append((_line_seed(line), line, inside))
                at += len(line) + 1
            for lines, most in zip(drawn, (WITH_SPAN, WITHOUT), strict=True):
                for seed, line, inside in heapq.nsmallest(most, lines):
                    starts, ends, kinds = tokens_of(line, classes)
                    labels = [OUTSIDE] * len(kinds)
                    for s, e in inside:
                        hit = [i for i in np.flatnonzero(~_fixed(kinds)).tolist() if starts[i] < e and s < ends[i]]
                        for n, i in enumerate(hit):
                            labels[i] = INSIDE if n else BEGIN
                    # without a span, any 60 tokens of the line, so that long lines give more than their start
                    first = next((i for i, x in enumerate(labels) if x != OUTSIDE), 30 + seed % max(1, len(kinds) - 59))
                    a = max(0, first - 30)
                    rows.append((kinds[a : a + 60].tolist(), labels[a : a + 60], file_kind, seed))
        yield pa.RecordBatch.from_pydict({"kinds": pa.array([r[0] for r in rows], pa.list_(pa.int64())), "labels": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "file": pa.array([r[2] for r in rows], pa.int64()), "seed": pa.array([r[3] for r in rows], pa.int64())})


def train(docs: DataFrame, sample_docs: int = 300, rounds: int = 100) -> dict | None:
    """CRF weights from at most sample_docs documents with a base pattern and as many
    without, the smallest by seeded hash, whatever their length; of each, lines by seeded hash.
    None if no line has a span."""
    text = F.col("text")
    has = text.rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}") | text.rlike("AKIA[A-Z0-9]{12}") | text.rlike("[0-9a-f]{32}")
    docs = docs.select("text").filter(text.isNotNull()).withColumn("seed", F.xxhash64(text, F.lit(17)))
    # seeds first: the texts of the sample alone are gathered, below the seed that bounds it
    marks = cut(docs.select("seed", F.when(has, 1).otherwise(0).alias("kind")).distinct())
    lines = []
    for kind in (1, 0):
        last = marks.filter(F.col("kind") == kind).select("seed").orderBy("seed").limit(sample_docs).agg(F.max("seed")).first()[0]
        if last is not None:
            near = docs.filter(F.col("seed") <= last).join(F.broadcast(marks.filter((F.col("kind") == kind) & (F.col("seed") <= last)).select("seed")), "seed", "left_semi")
            sample = near.dropDuplicates(["seed"]).select("text")
            lines += [(r.seed, r.kinds, r.labels, r.file) for r in sample.mapInArrow(_sample_lines, "kinds array<long>, labels array<long>, file long, seed long").collect() if r.kinds]
    lines = sorted(lines)[: sample_docs * 16]
    if not any(BEGIN in x[2] for x in lines):
        return None
    # a value that looks like an ordinary word is told by the base patterns' names alone
    named = [x for x in lines if BEGIN in x[2] and not any(y == BEGIN and k % N_CLASSES in _ORDINARY for k, y in zip(x[1], x[2], strict=True))]
    worded = [_worded(*x) for x in lines if BEGIN not in x[2] and x[0] % 3 == 0]
    return fit([x[1:] for x in lines] + [_varied(*x, copy) for x in named for copy in range(VARIED)] + worded, rounds)


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


#: Token classes of an assignment mark, of a quote and of long words of one case.
_MARK, _QUOTE, _ORDINARY = 2, 3, range(4 + 6 * 7 * 3, 4 + 7 * 7 * 3)


def _varied(seed: int, kinds: list[int], labels: list[int], file_kind: int, copy: int) -> tuple[list[int], list[int], int]:
    """A copy of the line with other words in place of its key words and, in all copies but the
    first, other values in place of its secrets and other marks around them, in the last two without
    the rest of the line: the model also learns secrets under names and of shapes that the sample
    does not have."""
    rng = random.Random(seed * VARIED + copy)
    out: list[tuple[int, int]] = []
    for k, y in zip(kinds, labels, strict=True):
        if k % N_CLASSES == 1:
            # a word or a joined name; few buckets, as real words share them
            k = token_class(rng.choice(("word", "a_name", "some_name", "longer_name"))) + N_CLASSES * rng.randrange(2, 10)
        elif y == BEGIN and copy:
            k = token_code("".join(rng.choices(_ALPHABETS[copy % 3], k=rng.randint(16, 48))))
        if copy > 1 and k % N_CLASSES == _QUOTE:
            if copy % 2 and out and out[-1][0] % N_CLASSES == _MARK:
                out[-1] = (token_code('="'), OUTSIDE)
            elif copy % 2:
                out.append((k, y))
            continue
        out.append((k, y))
    if copy > 3:
        # the name, the mark and the value as a line of its own
        at = next(i for i, (_, y) in enumerate(out) if y == BEGIN)
        out = out[max(0, at - 2) : at + 1 + copy % 2]
    return [k for k, _ in out], [y for _, y in out], file_kind // 2 * 2


def _worded(seed: int, kinds: list[int], labels: list[int], file_kind: int) -> tuple[list[int], list[int], int]:
    """A copy of a line without a span, of other words: the model also learns that words of one
    case are none, of any length."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice((4, 9, 14, 20, 28, 40)) + rng.randrange(6)))
    return [token_code(word()) if k % N_CLASSES == 0 and k or k % N_CLASSES in _ORDINARY else k for k in kinds], labels, file_kind


def fit(lines: list[tuple[list[int], list[int], int]], rounds: int = 100) -> dict:
    """Maximum likelihood with an L2 penalty, by full-batch Adam, after 50 rounds only until
    ten rounds gain less than a hundredth; the best round's weights count. Forward-backward runs over all lines at once."""
    lines = sorted(lines)
    n, width = len(lines), max(len(x[0]) for x in lines)
    kinds, labels, real = np.full((n, width), _BREAK), np.full((n, width), OUTSIDE), np.zeros((n, width), bool)
    for i, (k, y, _) in enumerate(lines):
        kinds[i, : len(k)], labels[i, : len(k)], real[i, : len(k)] = k, y, True
    files = np.array([x[2] for x in lines])[:, None].repeat(width, 1)
    # two edges after each line, so that the lines can stand in one row
    flat = _neighbours(np.pad(kinds, ((0, 0), (0, 2)), constant_values=_BREAK).ravel())
    index = {k: i.reshape(n, width + 2)[:, :width][real] for k, i in flat.items()} | {"file": files[real]}
    sizes = {k: N_FILE if k == "file" else N_WORDS if k in _WORDS else N_CLASSES for k in index}
    w = {k: np.zeros((size, 3)) for k, size in sizes.items()} | {"moves": np.zeros((3, 3))}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    gold = np.eye(3)[labels[real]]
    before = np.concatenate([np.full((n, 1), OUTSIDE), labels[:, :-1]], 1)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (before[real], labels[real]), 1)
    plain = _fixed(kinds[real])
    score = np.zeros((n, width, 3))
    losses, best = [], None
    for t in range(1, rounds + 1):
        own = sum(w[k][i] for k, i in index.items())
        own[plain, :OUTSIDE] = -1e4
        score[real] = own
        expect, moves, total = _expected(score, w["moves"], real)
        losses.append(total - (own * gold).sum() - (w["moves"] * gold_moves).sum() + 0.025 * sum((x * x).sum() for x in w.values()))
        if losses[-1] <= min(losses):
            best = {k: v.copy() for k, v in w.items()}
        # the first rounds overshoot
        if t > 50 and min(losses[-10:]) > 0.99 * min(losses[:-10]):
            break
        off = expect[real] - gold
        grad = {k: np.stack([np.bincount(i, off[:, y], sizes[k]) for y in range(3)], 1) + 0.05 * w[k] for k, i in index.items()}
        grad["moves"] = moves - gold_moves + 0.05 * w["moves"]
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g * g
            w[k] = w[k] - 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-8)
    return best or w


def _expected(score: np.ndarray, moves: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label and transition expectations of all chains, and the sum of their log partition
    functions."""
    n, width, _ = score.shape
    # chances instead of logs, scaled to a sum of one at each step
    top = score.max(2)
    here, step = np.exp(score - top[:, :, None]), np.exp(moves)
    fore, back, scale = np.empty((n, width, 3)), np.ones((n, width, 3)), np.ones((n, width))
    for t in range(width):
        found = (fore[:, t - 1] @ step if t else step[OUTSIDE]) * here[:, t]
        scale[:, t] = np.where(real[:, t], found.sum(1), 1.0)
        fore[:, t] = np.where(real[:, t, None], found / scale[:, t, None], fore[:, t - 1]) if t else found / scale[:, :1]
    ahead = here / scale[:, :, None]
    for t in range(width - 2, -1, -1):
        back[:, t] = np.where(real[:, t + 1, None], (ahead[:, t + 1] * back[:, t + 1]) @ step.T, 1.0)
    expect = fore * back * real[:, :, None]
    after = (ahead * back)[:, 1:] * real[:, 1:, None]
    both = step * (fore[:, :-1].reshape(-1, 3).T @ after.reshape(-1, 3))
    both[OUTSIDE] += expect[:, 0].sum(0)
    return expect, both, float(((np.log(scale) + top) * real).sum())


# ---- Spark ----


def find_secrets(docs: DataFrame, weights: dict | None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) by start, then kind; ends are exclusive,
    positions are code points."""

    def run(batches):
        classes = _Classes()
        for b in (x for batch in batches for x in slices(batch, "text")):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t, weights, classes)] for t in b.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, weights: dict | None, mark: str = "[secret]") -> DataFrame:
    """docs with every found span of text replaced by mark (overlapping spans by one) and
    n_chars, if there is one, counted anew."""
    plain, masks = masked(docs)
    names, text = plain.columns, masks["text"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)

    def clean(whole: str | None, classes: dict) -> str | None:
        if not whole:
            return whole
        out, at = [], 0
        for s, _, e in scan(whole, weights, classes):
            if s >= at:
                out += [whole[at:s], mark]
            at = max(at, e)
        return "".join([*out, whole[at:]]) if out else whole

    def run(batches):
        classes = _Classes()
        for b in (x for batch in batches for x in slices(batch, text)):
            texts = pa.array([clean(t, classes) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == text else b.column(n) for n in names], names)

    out = unmasked(plain.mapInArrow(run, fields), masks)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in masks else out
