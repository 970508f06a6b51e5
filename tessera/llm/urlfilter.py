"""Operator 1: URL filters with host word segmentation and naive Bayes.

Rules decide first: of all rules whose host equals the url's host or is a parent domain of it,
and whose path starts the url's path, the longest wins. Every other url is judged by the
method: concatenated names in the host are split into words by unigram Viterbi, over word counts
of the visible text of all pages, and a multinomial naive Bayes model scores the host's words
and the path's tokens. The model is trained on the pages themselves: pages whose host words
have one of SEED_WORDS, and those words themselves, are examples to block; all other pages that
no rule blocks are examples to allow. Counts are taken over all pages and hashed into ``buckets``, the model's
fixed size; each class is scaled to the same number of tokens.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is
allowed; names of any length are split; words are of 2 to LONGEST_WORD letters a-z where they are
counted, and of 1 to LONGEST_WORD where names are split; ties between rules of one length go to
the first given; ties in Viterbi go to the longer last word;
repeated rows are judged alike; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, lookup

# The production rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Words of names to block (gambling, pills, loans, adult, link farms).
SEED_WORDS = (
    "adult", "bet", "betting", "bonus", "casino", "cheap", "clickbait", "escort", "farm", "jackpot", "loan", "loans", "lottery",
    "payday", "pharma", "pharmacy", "pills", "poker", "porn", "replica", "roulette", "seo", "sex", "slots", "spam", "viagra", "win", "xxx",
)
LONGEST_WORD = 20


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def names_of(host: Column) -> Column:
    return F.regexp_extract_all(host, F.lit("([a-z]+)"), 1)


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely split of name; an unknown word of n letters has probability
    10**-n / total."""
    total = max(total, 2)
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = name[start:end]
            known = counts.get(word, 0)
            score = math.log(known / total) if known else -math.log(total) - len(word) * math.log(10)
            options.append((best[start] + score, -start))
        score, start = max(options)
        best.append(score)
        back.append(-start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of the visible text of all pages."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), r"(?s)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return words.filter(F.col("word").rlike(f"^[a-z]{{2,{LONGEST_WORD}}}$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segmented_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) for each of hosts(host). A name meets only the words that are its
    substrings, by a join, so the whole word list is never broadcast."""
    counts = cut(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    floor = max(1, total // 100_000)
    names = cut(hosts.select("host", F.posexplode_outer(names_of(F.col("host"))).alias("at", "name")))
    whole = names.filter("name is not null").select("name").distinct()
    ends = F.sequence(F.col("start"), F.least(F.col("start") + LONGEST_WORD - 1, F.length("name")))
    parts = whole.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("name")))).select("name", F.explode(F.transform(ends, lambda e: F.substring("name", F.col("start"), e - F.col("start") + 1))).alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    def run(batches):
        seeds = dict.fromkeys(SEED_WORDS, floor)
        for b in batches:
            out = [segment(name, seeds | dict(known or ()), total) for name, known in zip(b.column("name").to_pylist(), b.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    split = whole.join(known, "name", "left").mapInArrow(run, "name string, words array<string>")
    joined = names.join(split, "name", "left").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))).alias("words"))
    return cut(joined)


_PATH_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def path_tokens(path: str) -> list[str]:
    """Lower-cased letter runs of a path; digit runs only by their number of digits."""
    return [f"path:{len(t)} digits" if t[0].isdigit() else f"path:{t}" for t in _PATH_TOKEN.findall(path.lower())]


def _bucket(token: str, buckets: int) -> int:
    return xxhash.xxh3_64_intdigest(token) % buckets


def train(judged: DataFrame, hosts: DataFrame, buckets: int) -> np.ndarray:
    """Log odds (block against allow) of each bucket, from counts over all examples."""
    seeded = hosts.select("host", "words", F.arrays_overlap("words", F.array(*map(F.lit, SEED_WORDS))).alias("seeded"))
    rows = judged.select("host", "path", F.coalesce(F.col("best.verdict") == "allow", F.lit(True)).alias("allowed")).join(lookup(seeded), "host").filter("seeded or allowed")

    def count(batches):
        for b in batches:
            sums = np.zeros((2, buckets), np.int64)
            for path, words, block in zip(*(b.column(c).to_pylist() for c in ("path", "words", "seeded")), strict=True):
                for t in [*words, *path_tokens(path)]:
                    sums[int(block), _bucket(t, buckets)] += 1
            kind, at = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(sums[kind, at])], ["kind", "bucket", "n"])

    sums = np.zeros((2, buckets))
    for r in rows.select("path", "words", "seeded").mapInArrow(count, "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect():
        sums[r["kind"], r["bucket"]] += r["n"]
    for w in SEED_WORDS:
        sums[1, _bucket(w, buckets)] += 1
    scaled = sums * (10_000 / np.maximum(sums.sum(1, keepdims=True), 1))
    smooth = scaled + 1.0
    return np.log(smooth[1] / smooth[0])


def judge_urls(pages: DataFrame, rules=RULES, buckets: int = 1 << 16, prior: float = 0.1) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, host_words) for each of
    pages(page_id, url, html); score is the log odds to block."""
    host, path = parse(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    hosts = segmented_hosts(judged.select("host").distinct(), word_counts(pages))
    odds = train(judged, hosts, buckets)
    base = math.log(prior / (1 - prior))

    def score(batches):
        for b in batches:
            out = [base + sum(odds[_bucket(t, buckets)] for t in [*words, *path_tokens(path)]) if words or path else base for words, path in zip(b.column("host_words").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in b.schema.names] + [pa.array(out, pa.float64())], [*b.schema.names, "score"])

    joined = judged.join(lookup(hosts.withColumnRenamed("words", "host_words")), "host", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"), F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema)
    scored = joined.mapInArrow(score, fields + ", score double")
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "host_words")
