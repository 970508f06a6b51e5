"""Vector search: exact cosine neighbours, reranking, and encoder hooks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import sigmoid


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalize(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def nearest(corpus: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score), the k most similar to one query, by a constant vector and a top-k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return corpus.select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _packed(df: DataFrame, key: str, vector: str, rows: int, prefix: str) -> DataFrame:
    """Blocks of at most rows vectors as bytes: (prefix_keys, prefix_vectors)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                values = part.column("v")
                x = np.asarray(values.flatten(), np.float64).reshape(part.num_rows, -1)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("k").to_numpy().tobytes()]), pa.array([x.tobytes()])], [f"{prefix}_keys", f"{prefix}_vectors"])

    return df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"{prefix}_keys binary, {prefix}_vectors binary")


def nearest_batch(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", rows: int = 1024) -> DataFrame:
    """(query_id, key, score, position): the k most similar to each query, exactly. Blocks of
    queries meet blocks of the corpus; each pair is one matrix product that gives k rows per
    query, and the k best of those are taken per query."""
    pairs = _packed(queries, key, vector, rows, "q").crossJoin(_packed(corpus, key, vector, rows, "c"))

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], []]
            for qk, qv, ck, cv in zip(*(b.column(n).to_pylist() for n in ("q_keys", "q_vectors", "c_keys", "c_vectors")), strict=True):
                q_ids, c_ids = np.frombuffer(qk, np.int64), np.frombuffer(ck, np.int64)
                scores = np.frombuffer(qv).reshape(len(q_ids), -1) @ np.frombuffer(cv).reshape(len(c_ids), -1).T
                # by score, then key
                order = np.lexsort((np.broadcast_to(c_ids, scores.shape), -scores), axis=1)[:, :k]
                out[0].append(np.repeat(q_ids, order.shape[1]))
                out[1].append(c_ids[order].ravel())
                out[2].append(np.take_along_axis(scores, order, 1).ravel())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", key, "score"])

    found = pairs.mapInArrow(run, f"query_id long, {key} long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


# ---- the index: vectors in lists by their nearest centre ----


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def centres_of(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means over the sample, from evenly spaced rows of it."""
    sample = _unit(sample)
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(np.bincount(own, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def write_index(corpus: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", lists: int = 64, sample_rows: int = 20_000) -> dict:
    """Every vector of corpus(key, vector) in the folder of its nearest centre; the index's state.
    The centres are fitted on at most sample_rows vectors, the least by a seeded hash of the key;
    null vectors are left out."""
    rows = corpus.filter(F.col(vector).isNotNull()).select(key, vector)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64(key, F.lit(3)), key).select(vector).limit(sample_rows).collect()], np.float64)
    centres = centres_of(sample, lists) if len(sample) else np.zeros((1, 1))
    spark = corpus.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    return {"segments": [_place(rows, centres, folder)], "dead": []}


def _place(rows: DataFrame, centres: np.ndarray, folder: str) -> str:
    """Write rows(key, vector) as a segment; its name."""
    key, vector = rows.columns
    name = uuid.uuid4().hex[:12]

    @F.pandas_udf("int")
    def nearest_centre(x: pd.Series) -> pd.Series:
        return pd.Series((_unit(np.stack(x.to_numpy()).astype(np.float64)) @ centres.T).argmax(1)) if len(x) else pd.Series([], dtype="int32")

    placed = rows.withColumn("list", nearest_centre(F.col(vector)))
    placed.repartition("list", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists/segment={name}")
    return name


def update_index(spark: SparkSession, folder: str, state: dict, corpus: DataFrame, gone: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> dict:
    """The segments and dead lists after a delta: corpus(key, vector) is new, and the rows so far
    of the papers in gone(paper_id, ...), whose keys are paper_id#number, are dead. Writes the new
    vectors and the dead keys."""
    index = Index(spark, folder, state)
    dead = uuid.uuid4().hex[:12]
    owned = index.rows.select("segment", key, F.regexp_replace(key, "#[^#]*$", "").alias("paper_id"))
    owned.join(gone.select("paper_id"), "paper_id", "left_semi").select("segment", key).coalesce(4).write.parquet(f"{folder}/dead/{dead}")
    new = _place(corpus.filter(F.col(vector).isNotNull()).select(key, vector), index.centres, folder)
    return {"segments": [*state["segments"], new], "dead": [*state["dead"], dead]}


class Index:
    """What write_index wrote. A query reads the lists whose centres are nearest to it. The usual
    40 of 64 are for vectors without clusters; vectors of texts need fewer."""

    def __init__(self, spark: SparkSession, folder: str, state: dict | None = None):
        rows = spark.read.option("basePath", f"{folder}/lists").parquet(*([f"{folder}/lists/segment={n}" for n in state["segments"]] if state else [f"{folder}/lists"]))
        self.spark, (self.key, self.vector) = spark, rows.columns[:2]
        if state and state["dead"]:
            dead = spark.read.parquet(*(f"{folder}/dead/{n}" for n in state["dead"]))
            rows = rows.join(dead, ["segment", self.key], "left_anti").select(*rows.columns)
        self.rows = rows
        found = spark.read.parquet(f"{folder}/centres").orderBy("list").collect()
        self.centres = np.array([r["centre"] for r in found])

    def nearest(self, query: list[float], k: int, probes: int = 40) -> DataFrame:
        """(key, score), the k most similar in the probed lists."""
        near = np.argsort(-(self.centres @ _unit(np.asarray(query, np.float64))), kind="stable")[:probes]
        return nearest(self.rows.filter(F.col("list").isin(near.tolist())), query, k, self.key, self.vector)

    def nearest_batch(self, queries: DataFrame, k: int, key: str | None = None, vector: str | None = None, probes: int = 40, parts: int = 4) -> DataFrame:
        """(query_id, key, score, position) for each of queries: a query goes to its probed lists
        by an equi-join, where the rows of each list are met part by part as one product; the k
        best of all are taken per query."""
        key, vector, centres, own_key = key or self.key, vector or self.vector, self.centres, self.key

        @F.pandas_udf("array<int>")
        def probed(x: pd.Series) -> pd.Series:
            scores = _unit(np.stack(x.to_numpy()).astype(np.float64)) @ centres.T
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        asked = asked.withColumn("list", F.explode(probed(F.col("v")))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("asks", F.lit(1))
        held = self.rows.select(F.col(self.key).cast("long").alias("id"), F.col(self.vector).cast("array<double>").alias("v"), "list", F.pmod(F.xxhash64(self.key), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("asks"))

        def best(q_ids: list, q: list, c_ids: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
            scores = np.asarray(q) @ c.T
            order = np.lexsort((np.broadcast_to(c_ids, scores.shape), -scores), axis=1)[:, :k]
            return [np.repeat(np.asarray(q_ids), order.shape[1]), c_ids[order].ravel(), np.take_along_axis(scores, order, 1).ravel()]

        def run(batches):
            at, ids, rows = None, [], []
            for b in batches:
                out: list[list[np.ndarray]] = []
                place = list(zip(b.column("list").to_pylist(), b.column("part").to_pylist(), strict=True))
                asks, keys = b.column("asks").to_numpy(), b.column("id").to_numpy()
                vectors = _unit(np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, -1))
                start = 0
                while start < b.num_rows:
                    stop = start
                    while stop < b.num_rows and place[stop] == place[start] and asks[stop] == asks[start]:
                        stop += 1
                    if place[start] != at:
                        at, ids, rows = place[start], [], []
                    if asks[start]:
                        if ids:
                            out.append(best(keys[start:stop].tolist(), vectors[start:stop], np.concatenate(ids), np.concatenate(rows)))
                    else:
                        ids.append(keys[start:stop])
                        rows.append(vectors[start:stop])
                    start = stop
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", own_key, "score"])

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        met = held.unionByName(asked).repartition(n, "list", "part").sortWithinPartitions("list", "part", "asks")
        found = met.mapInArrow(run, f"query_id long, {own_key} long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), own_key)
        return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def rerank(hits: DataFrame, k: int, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None, query: str = "query", text: str = "text", ties: tuple[str, ...] = ()) -> DataFrame:
    """The k best hits by a scorer of (query, text) pairs through a sigmoid; without a scorer,
    by the score they have. ties are the columns that order equal scores."""
    if scorer is not None:
        hits = hits.withColumn("score", sigmoid(F.pandas_udf(scorer, "double")(F.col(query), F.col(text))))
    return hits.orderBy(F.desc("score"), *ties).limit(k)


def result_rows(hits: DataFrame, preview: int = 300) -> DataFrame:
    """(score, title, section, filename, preview) with the usual fallbacks."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit("")), F.lit("Unknown"))
    return hits.select(F.round("score", 4).alias("score"), title.alias("title"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("filename", F.lit("")).alias("filename"), F.substring("text", 1, preview).alias("preview"))


def embed(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch: int = 32) -> DataFrame:
    """df with a normalised embedding of text; load runs once in each worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            rows: list = []
            for at in range(0, len(s), batch):
                x = np.asarray(model(s.iloc[at : at + batch].fillna("").tolist()), np.float64)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                rows += list(np.divide(x, size, out=np.zeros_like(x), where=size > 0).astype(np.float32))
            yield pd.Series(rows, index=s.index)

    return df.withColumn("embedding", run(F.col(text)))


def trigram_encoder(width: int = 384) -> Callable[[list[str]], np.ndarray]:
    """The default model: hashed counts of character trigrams (CRC-32 of their UTF-8), all texts
    of a call at once."""

    def encode(texts: list[str]) -> np.ndarray:
        low = [t.lower() for t in texts]
        x = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        rows = np.repeat(np.arange(len(low)), [len(t) for t in low])
        # starts of trigrams within one text
        at = np.flatnonzero(rows[:-2] == rows[2:]) if len(x) > 2 else np.zeros(0, np.int64)
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for k in range(3):
            crc = _crc_character(crc, x[at + k])
        return np.bincount(rows[at] * width + ~crc % np.uint32(width), minlength=len(low) * width).reshape(len(low), width).astype(np.float64)

    return encode


#: CRC-32 steps by byte: of byte b, what zlib's register goes through from 0.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_CRC ^= _CRC[0]


def _crc_character(crc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the UTF-8 bytes of one more character each."""
    step = lambda c, b: _CRC[(c ^ b) & 0xFF] ^ (c >> 8)
    wide = np.flatnonzero(x > 0x7F)
    out = step(crc, x)
    if len(wide):
        c, y = crc[wide], x[wide]
        two, three = y < 0x800, y < 0x10000
        c = step(c, np.where(two, 0xC0 | y >> 6, np.where(three, 0xE0 | y >> 12, 0xF0 | y >> 18)))
        for shift, has in ((12, ~three), (6, ~two), (0, None)):
            then = step(c, 0x80 | y >> shift & 0x3F)
            c = then if has is None else np.where(has, then, c)
        out[wide] = c
    return out
