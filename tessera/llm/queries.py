"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kdshard, license, lz, minhash, mixing, pieces, quality, secret_crf, substring, tokencount, trie, urlfilter, whitening
from tessera.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages")).drop("host_words")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_crf.find_secrets(docs, secret_crf.train(docs))
    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: source / language / hundreds of doc_id / doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    found = license.scan_licenses(docs.select(path.alias("path"), "text"))
    doc_id = F.expr("try_cast(substring_index(path, '/', -1) as bigint)")
    return found.select(doc_id.alias("doc_id"), "path", "own_license", F.round("own_score", 6).alias("own_score"), "is_license_file", "license", "from_directory")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_ids", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.assign_shards(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.fingerprint_chain(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.METRICS, "base_failed", "kept")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", F.posexplode_outer("whitened").alias("at", "whitened"), "n", "deviation", "explained", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_secret_scans, op3_license_scans, op4_minhash_near_dedup, op5_mixing, op6_substring_dedup, op7_sentencepiece, op8_sharding, op9_fingerprints, op10_quality_rules, op11_token_counts, op12_prefix_trie, op13_embedding_whitening)}
_WORDS = r"list_filter(regexp_split_to_array({x}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_near_dedup": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(x="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(m) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id""",
    "op6_substring_dedup": f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS ws FROM documents),
v AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS MATERIALIZED (SELECT g, min(doc_id) AS first FROM v GROUP BY g),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS at FROM v JOIN f USING (g) WHERE v.doc_id > f.first),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM w),
k AS (SELECT u.doc_id, count(x.at) AS gone, string_agg(word, ' ' ORDER BY u.at) FILTER (x.at IS NULL) AS kept FROM u LEFT JOIN x ON x.doc_id = u.doc_id AND x.at = u.at GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op12_prefix_trie": """
WITH t AS MATERIALIZED (SELECT conv_id, key, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS i FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS size, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL)),
d AS MATERIALIZED (SELECT conv_id AS base, count(*) AS held FROM t GROUP BY conv_id),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
r AS MATERIALIZED (SELECT c.conv_id, t.i AS pos, key, size FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL SELECT c.conv_id, t.i - c.h + least(c.h, coalesce(held, 0)), key, size FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h LEFT JOIN d ON d.base = c.base),
p AS MATERIALIZED (SELECT conv_id, pos + 1 AS depth, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path, size FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(depth) AS turns FROM p GROUP BY conv_id),
n AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256 FROM p JOIN l USING (conv_id) GROUP BY path, depth),
k AS MATERIALIZED (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT a.path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens FROM n a JOIN n b ON starts_with(b.path, a.path) LEFT JOIN k ON k.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN u USING (path) LEFT JOIN k USING (path) LEFT JOIN n m ON n.depth > 0 AND m.path = left(n.path, length(n.path) - 32)""",
}
