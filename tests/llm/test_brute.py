"""Whole results of operators that SQL cannot say, against plain loops; planted secrets."""

import math
import random
import re
from collections import Counter, defaultdict
from functools import cache

import pytest

from tessera.llm import kdshard, secret_crf, urlfilter

# ---- 8 ----


def brute_tree(rows, m, shard):
    """{shard: [row numbers]}: rows are (number, size, tie, coordinates)."""
    if m == 1 or not rows:
        return {shard: [r[0] for r in rows]}
    spread = [max(r[3][d] for r in rows) - min(r[3][d] for r in rows) for d in range(3)]
    d = max(range(3), key=lambda d: (spread[d], kdshard.DIMENSIONS[d]))
    key = lambda r: (r[3][d] << kdshard.HASH_BITS) + r[2]
    weight = Counter()
    for r in rows:
        weight[key(r)] += r[1]
    goal, low, left = sum(weight.values()) * (m // 2) / m, 0, 0
    for k in sorted(weight):
        if goal - left < weight[k]:
            low = k if goal - left < weight[k] / 2 else k + 1
            break
        left += weight[k]
    halves = [r for r in rows if key(r) < low], [r for r in rows if key(r) >= low]
    return brute_tree(halves[0], m // 2, shard) | brute_tree(halves[1], m - m // 2, shard + m // 2)


@pytest.mark.parametrize("shards", [5, 24])
def test_shards(spark, small, shards):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", (F.octet_length("text") + 8).alias("size"), F.pmod(F.xxhash64("text"), F.lit(1 << kdshard.HASH_BITS)).alias("tie"), *(c.alias(n) for n, c in kdshard._coordinates(F.col("text")).items())).collect()
    same = Counter(r.tie for r in rows)
    assert all(r.size * same[r.tie] <= sum(x.size for x in rows) / shards for r in rows), "no group larger than a shard here"
    want = brute_tree([(r.doc_id, r.size, r.tie, [r[d] for d in kdshard.DIMENSIONS]) for r in rows], shards, 0)
    got = defaultdict(list)
    for r in kdshard.assign_shards(docs, shards).collect():
        got[r.shard].append(r.doc_id)
    assert {s: sorted(x) for s, x in got.items()} == {s: sorted(x) for s, x in want.items() if x}


# ---- 1 ----


def brute_urls(rows):
    """(page_id, host, path, rule, verdict) by plain rules, splitting and counting."""
    counts = Counter()
    for _, _, html in rows:
        text = re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<(script|style)\b.*?</\1>", " ", (html or "").lower()))
        counts.update(w for w in re.findall(r"[^\W\d_]+", text) if re.fullmatch("[a-z]{2,20}", w))
    total = max(2, sum(counts.values()))
    for w in urlfilter.SEED_WORDS:
        counts[w] = counts[w] or max(1, sum(counts.values()) // 100_000)

    def worth(word):
        return math.log(counts[word] / total) if counts[word] else -math.log(total) - len(word) * math.log(10)

    @cache
    def split(name):
        """Ties go to the longer last word."""
        if not name:
            return 0.0, ()
        best = max((split(name[:k])[0] + worth(name[k:]), -k) for k in range(max(0, len(name) - 20), len(name)))
        return best[0], (*split(name[: -best[1]])[1], name[-best[1] :])

    judged = []
    for page, url, _ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h) + len(p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, None)
        words = [w for name in re.findall("[a-z]+", host) for w in split(name)[1]]
        tokens = words + [f"path:{len(t)} digits" if t[0].isdigit() else f"path:{t}" for t in re.findall("[a-z]+|[0-9]+", path.lower())]
        judged.append((page, host, path, *rule, words, tokens))
    seen = {True: Counter(urlfilter._bucket(w, 1 << 16) for w in urlfilter.SEED_WORDS), False: Counter()}
    for _, _, _, _, verdict, words, tokens in judged:
        block = any(w in urlfilter.SEED_WORDS for w in words)
        if block or verdict != "block":
            seen[block].update(urlfilter._bucket(t, 1 << 16) for t in tokens)
    size = {k: max(1, sum(c.values())) for k, c in seen.items()}
    odds = lambda t: math.log((1 + 10_000 * seen[True][urlfilter._bucket(t, 1 << 16)] / size[True]) / (1 + 10_000 * seen[False][urlfilter._bucket(t, 1 << 16)] / size[False]))
    return sorted((page, host, path, rule, verdict or ("block" if math.log(1 / 9) + sum(map(odds, tokens)) > 0 else "allow")) for page, host, path, rule, verdict, _, tokens in judged), {h: w for _, h, _, _, _, w, _ in judged}


def test_urls_of_pages(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    want, _ = brute_urls([(r.page_id, r.url, r.html) for r in df.select("page_id", "url", "html").collect()])
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df).collect()) == want


def test_glued_hosts(spark):
    """Names glued from words of the pages are split, and verdicts follow the words."""
    rng = random.Random(6)
    good, bad = "garden news river daily stone music travel kitchen".split(), "casino cheap pills jackpot".split()
    html = "<p>" + " ".join(good * 9 + bad * 3) + "</p>"
    rows, truth = [], {}
    for i in range(300):
        words = rng.sample(good, 2) if i % 3 else [rng.choice(bad), rng.choice(good)]
        host = "".join(words) + ".example.org"
        truth[host] = words
        rows.append((i, f"http://{host}/{rng.choice(['a', 'b'])}/{i}", html))
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want, split = brute_urls(rows)
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert all(r.host_words == split[r.host] and r.host_words[:2] == truth[r.host] for r in got)
    assert all(r.verdict == ("block" if r.page_id % 3 == 0 else "allow") for r in got)


# ---- 2 ----


def test_planted_secrets(spark):
    """Secrets that the base patterns cannot see, found by a model that the base patterns of the
    documents teach; most are found, and hardly anything else is tagged."""
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = secret_crf.train(docs)
    token = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    plain = [" ".join(t.split()[:60]) for (t,) in docs.select("text").filter("text is not null").limit(300).collect() if not secret_crf.base_spans(t)]
    classes, found, wrong, tagged = secret_crf._Classes(), 0, 0, 0
    heads = ('pwd = "{}"', "auth_key: {}", 'credential="{}"', "private_key = {}")
    for k in range(200):
        value = token(rng.randint(20, 40))
        text = f"{rng.choice(plain)}\n{rng.choice(heads).format(value)}\n{rng.choice(plain)}"
        spans = secret_crf.crf_spans(text, weights, classes)
        found += any(text[a:b].strip("\"'") == value for a, b in spans)
        wrong += sum(value not in text[a:b] for a, b in spans)
        tagged += len(spans)
    print("recall", found / 200, "precision", 1 - wrong / max(1, tagged))
    assert found >= 140 and wrong <= 0.1 * tagged
