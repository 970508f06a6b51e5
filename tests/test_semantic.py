import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import semantic, vector
from tessera.plans import snapshot
from tessera.plans.engine import Engine, encoder_of, train_encoder, vacuum
from tessera.streaming.sync import ingest

TOPICS, WORDS, TEXTS, TAKEN = 8, 60, 80, 8


def word(topic, n):
    """A word of random letters, so that words of one topic are not alike."""
    return "".join(np.random.default_rng((topic + 1, n)).choice(list("abcdefghijklmnopqrstuvwxyz"), 7))


def planted(seed=1):
    """(id, topic, text): each text takes few of its topic's words and some of all topics'."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(TOPICS * TEXTS):
        topic = i % TOPICS
        own = rng.choice(WORDS, TAKEN, replace=False)
        common = rng.integers(0, 40, 6)
        words = [word(topic, w) for w in own] + [word(99, w) for w in common]
        rows.append((i, topic, " ".join(rng.permutation(words))))
    return rows


def same_topic(x, topics, k=10):
    """Mean share of a row's own topic among its k nearest others, by cosine."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    best = np.argsort(-near, axis=1)[:, :k]
    return (topics[best] == topics[:, None]).mean()


def test_planted_topics(spark):
    rows = planted()
    texts, topics = [r[2] for r in rows], np.array([r[1] for r in rows])
    # two texts of one topic share about one of their fourteen words
    common = {word(99, w) for w in range(40)}
    shared = [len((set(texts[i].split()) & set(texts[i + TOPICS].split())) - common) for i in range(200)]
    assert np.mean(shared) < 1.5
    model = semantic.fit(spark.createDataFrame(rows, "id long, topic long, text string"), width=8, rounds=4)
    latent = same_topic(model(texts), topics)
    assert latent > 0.95 and latent > same_topic(vector.trigram_encoder()(texts), topics) + 0.1


def test_basis_is_that_of_a_full_decomposition(spark):
    texts = [r[2] for r in planted(3)[:160]]
    model = semantic.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), width=6, rounds=12)
    seen = np.zeros(semantic.BUCKETS)
    for t in texts:
        seen[semantic._entries(t)[0]] += 1
    idf = np.log((1 + len(texts)) / (1 + seen))
    full = np.zeros((len(texts), semantic.BUCKETS))
    for row, t in zip(full, texts, strict=True):
        at, n = semantic._entries(t)
        row[at] = (1 + np.log(n)) * idf[at]
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    want = np.linalg.svd(full, full_matrices=False)[1][:6]
    got = np.linalg.norm(full @ model.basis, axis=0)
    assert np.allclose(got, want, rtol=1e-3) and np.allclose(model.basis.T @ model.basis, np.eye(6), atol=1e-4)
    assert np.allclose(model(texts), full @ model.basis, atol=1e-4)


def test_no_text_is_left_out_of_the_basis(spark):
    """A topic is learnt of 60,000 texts whose texts a sample of 50,000 by their hash would leave out."""
    rare = " ".join(word(8, i) for i in range(10))
    drawn = F.md5(F.col("id").cast("string"))
    filler = spark.range(60_000).select(F.concat_ws(" ", F.substring(drawn, 1, 6), F.substring(drawn, 7, 6)).alias("text"))
    left_out = F.pmod(F.xxhash64("text", F.lit(0)), F.lit(1 << 32)) >= int(50_000 / 60_000 * (1 << 32))
    topic = spark.createDataFrame([(f"{rare} {word(7, i)}",) for i in range(500)], "text string").filter(left_out).limit(40)
    texts = [r.text for r in topic.collect()]
    assert len(texts) == 40
    model = semantic.fit(filler.union(spark.createDataFrame([(t,) for t in texts], "text string")), width=4)
    assert np.linalg.norm(model(texts), axis=1).min() > 0.8


def test_counted_texts_embed_as_texts_do(spark):
    texts = [None, "", "...", "alpha beta " * 40_000 + " ".join(f"w{i}" for i in range(40_000)), *(r[2] for r in planted(4)[:300]), "alpha", "alpha"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(3)
    counted = semantic.count(rows, "body")
    assert counted.columns == ["id", "digest", "buckets", "counts"]
    for r in counted.collect():
        found, counts = semantic._entries(texts[r.id])
        assert r.buckets == found.tolist() and r.counts == counts.tolist()
    model = semantic.fit_counted(counted, width=6)
    want = {r.id: r.embedding for r in vector.embed(rows, lambda: model, "body").collect()}
    assert {r.id: r.embedding for r in semantic.encode(counted, lambda: model).collect()} == want
    assert want[len(texts) - 1] == want[len(texts) - 2] and model([]).shape == (0, 6)


def test_copies_of_a_text_count_once_in_the_basis(spark):
    """With the idf kept, the products are those of the distinct texts."""
    texts = [r[2] for r in planted(5)[:40]]
    once, often = (semantic.count(spark.createDataFrame([(t,) for t in x], "text string").repartition(3)) for x in (texts, texts * 3))
    # the frequencies of three copies are thrice those of one, which leaves log((1 + n) / (1 + seen)) nearly as it is
    a, b = (semantic.fit_counted(x, width=6, rounds=6)(texts) for x in (once, often))
    assert np.allclose(a @ a.T, b @ b.T, atol=0.05)


def test_edges(spark, tmp_path):
    none = semantic.fit(spark.createDataFrame([], "text string"), width=4, rounds=1)
    assert not none(["a b", None, ""]).any()
    long = "alpha beta " * 100_000 + " ".join(f"w{i}" for i in range(20_000))
    model = semantic.fit(spark.createDataFrame([(None,), ("",), ("...",), (long,), ("alpha",), ("alpha",), ("gamma delta",)], "text string"), width=4, rounds=2)
    x = model([None, "", "...", long, "alpha", "ALPHA"])
    assert not x[:3].any() and x[3].any() and np.array_equal(x[4], x[5])
    semantic.save(spark, model, str(tmp_path / "m"))
    assert np.array_equal(semantic.load(spark, str(tmp_path / "m"))([long, "beta"]), model([long, "beta"]))


def test_the_store_keeps_its_encoder(spark, tmp_path):
    root, schema = str(tmp_path / "kb"), "path string, paper_id string, title string, text string"
    rows = [(f"/f/{i}.pdf", f"p{i}", f"t{topic}", text) for i, topic, text in planted(2)[:160]]
    ingest(spark, root, spark.createDataFrame(rows, schema), index=False)
    train_encoder(spark, root, width=8)
    state = snapshot.manifest(spark, root)
    stored = snapshot.read(spark, root, state).select("text", "embedding").collect()
    made = encoder_of(spark, root, state)([r.text for r in stored])
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    # embeddings by value, each those of the model for its text
    assert np.allclose([r.embedding for r in stored], made, atol=1e-5)
    engine = Engine(spark, root)
    hits = engine.search(" ".join(word(3, i) for i in range(4)), 10)
    assert {h.title for h in hits} == {"t3"}
    # a later ingest embeds by the store's encoder, and the mark stays
    new = " ".join(word(5, i) for i in range(10, 19))
    ingest(spark, root, spark.createDataFrame([("/f/n.pdf", "new", "t5", new)], schema))
    after = snapshot.manifest(spark, root)
    assert after["encoder"] == state["encoder"]
    assert len(snapshot.read(spark, root, after).filter("paper_id = 'new'").first().embedding) == 8
    assert {h.title for h in engine.search(new, 5)} == {"t5"}
    train_encoder(spark, root, width=4)
    vacuum(spark, root, keep=1)
    assert len(engine.search(new, 5)) == 5 and engine.place == snapshot.manifest(spark, root)["encoder"]
    assert [p.name for p in (tmp_path / "kb" / "encoders").iterdir() if p.is_dir()] == [engine.place.split("/")[1]]
    with pytest.raises(LookupError):
        train_encoder(spark, str(tmp_path / "nothing"))
