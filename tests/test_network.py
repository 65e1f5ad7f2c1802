"""Training by epochs against the same steps in numpy, and attributions that add up."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from docloom.operators import corpus
from docloom.operators.chunks import chunk
from docloom.plans import classifier, network

P = network.NetworkPlan(buckets=97, hidden=5, batches=3, epochs=4, patience=2)


@pytest.fixture(scope="module")
def cut(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(str(i), corpus.LABELS[i % 4], f"common words {' '.join([words[i % 4]] * (2 + i % 5))} and {i * 7 % 5}. " * 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "document_id string, agency string, text string").repartition(4)
    return chunk(docs, 12, 4).select("document_id", "agency", "chunk_id", "chunk_index", "chunk_ids").cache()


def held(cut):
    return F.col("document_id").cast("int") % 5 == 0


def plain_gradient(theta, rows):
    """Of the weighted losses by central differences of a plain forward pass."""

    def loss(theta):
        e, b, v, c = network.split_parameters(theta, P)
        total = 0.0
        for ids, label, w in rows:
            x = np.mean([e[i % P.buckets] for i in ids], axis=0) if ids else np.zeros(P.hidden)
            logits = np.tanh(x + b) @ v + c
            total += w * (np.log(np.exp(logits).sum()) - logits[label])
        return total

    out, step = np.zeros(P.size), 1e-6
    for i in range(P.size):
        up, down = theta.copy(), theta.copy()
        up[i] += step
        down[i] -= step
        out[i] = (loss(up) - loss(down)) / (2 * step)
    return out


def test_gradient():
    rng = np.random.default_rng(1)
    rows = [(rng.integers(0, 300, n).tolist(), int(rng.integers(4)), float(rng.random())) for n in (0, 1, 5, 9)]
    theta = network.start(P).theta
    got = network.gradient(theta, P, np.concatenate([np.array(r[0], dtype=np.int64) for r in rows]) % P.buckets, np.array([len(r[0]) for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    assert got[-1] == pytest.approx(sum(r[2] for r in rows)) and np.abs(got[:-1] - plain_gradient(theta, rows)).max() < 1e-6


def test_epochs_are_the_steps_of_numpy_and_go_on_where_they_were(spark, cut, tmp_path):
    learn, check = cut.where(~held(cut)), cut.where(held(cut))
    model = network.train(learn, check, str(tmp_path / "a"), P)
    rows = classifier.training_rows(learn).withColumn("part", F.pmod(F.xxhash64(F.lit(P.seed), "chunk_id"), F.lit(P.batches))).collect()
    state = network.start(P)
    for epoch in range(1, len(model.history) + 1):
        for part in network.order_of(epoch, P):
            own = [r for r in rows if r.part == part]
            tokens = np.concatenate([np.array(r.chunk_ids, dtype=np.int64) for r in own]) % P.buckets
            g = network.gradient(state.theta, P, tokens, np.array([len(r.chunk_ids) for r in own]), np.array([int(r.label) for r in own]), np.array([r.w for r in own]))
            state = network.stepped(state, g, P)
        if epoch == model.best_epoch:
            assert np.abs(state.theta - model.theta).max() < 1e-8
    scores = [h[1] for h in model.history]
    assert model.best_epoch == 1 + int(np.argmax(scores)) and max(scores) > 0.9
    said = {r.document_id: r.predicted for r in network.predict(model, check).collect()}
    assert sum(said[str(i)] == corpus.LABELS[i % 4] for i in range(0, 60, 5)) >= 11
    # two epochs, then a run that goes on
    network.train(learn, check, str(tmp_path / "b"), network.NetworkPlan(buckets=97, hidden=5, batches=3, epochs=2, patience=2))
    again = network.train(learn, check, str(tmp_path / "b"), P)
    assert again.history == model.history and np.abs(again.theta - model.theta).max() < 1e-8
    vectors = network.document_vectors(model, check).collect()
    assert len(vectors) == 12 and all(sum(v) == pytest.approx(1) for r in vectors for v in r.vectors)


def test_nothing_to_learn_from(cut, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        network.train(cut.where("agency = 'none'"), cut, str(tmp_path), P)


def test_shares_add_up_and_are_merged_to_words(spark):
    rng = np.random.default_rng(2)
    theta = rng.normal(scale=0.5, size=P.size)
    tokens = rng.integers(0, P.buckets, 40)
    for target in range(4):
        share, logit, empty = network.shares(theta, P, tokens, target, 400)
        assert share.sum() == pytest.approx(logit - empty, abs=1e-4)
        # equal tokens have equal shares
        assert all(share[tokens == t].std() < 1e-12 for t in set(tokens.tolist()))
    model = network.Trained(P, theta, 1)
    docs = spark.createDataFrame([("1", "unbelievable words, words"), ("2", ""), ("3", None)], "document_id string, text string")
    rows = network.word_shares(model, docs).collect()
    assert {r.word for r in rows} == {"unbelievable", "words,", "words"} and {r.document_id for r in rows} == {"1"}
    assert sum(r.share for r in rows) == pytest.approx(rows[0].total) == pytest.approx(rows[0].logit - rows[0].empty_logit, abs=1e-3)


def test_scores_and_shares_of_few_rows_at_a_time(spark, monkeypatch):
    """No task has the token vectors of a whole batch of chunks, and of a document only the n largest shares leave it."""
    plain = network.forward
    p = network.NetworkPlan(buckets=64, hidden=2)
    theta = network.start(p).theta

    def counted(theta, plan, tokens, sizes):
        if len(sizes) > 512:
            raise ValueError("too many chunks at a time")
        return plain(theta, plan, tokens, sizes)

    class Task:
        """Stands for a table, and keeps the function that its tasks would run."""

        schema = {"document_id": StructField("document_id", StringType())}

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    monkeypatch.setattr(network, "forward", counted)
    batch = pa.RecordBatch.from_pydict({"document_id": [str(i) for i in range(1300)], "chunk_index": [0] * 1300, "chunk_ids": [[i, 7] for i in range(1300)]})
    assert [r for b in network.scored(theta, p, Task())(iter([batch])) for r in b.column("document_id").to_pylist()] == batch.column("document_id").to_pylist()
    monkeypatch.setattr(network, "forward", plain)
    docs = spark.createDataFrame([("a", " ".join(f"word{i}" for i in range(200))), ("b", "same same"), ("c", None)], "document_id string, text string")
    rows = network.word_shares(network.Trained(p, theta, 1), docs, n=3).collect()
    assert {d: sum(r["document_id"] == d for r in rows) for d in "abc"} == {"a": 6, "b": 1, "c": 0}


def test_memory_of_scores_is_that_of_few_chunks():
    """Chunks of full length are scored in a few megabytes, however many a batch has."""
    import tracemalloc

    class Chunks:
        schema = {"document_id": StructField("document_id", StringType())}

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    p = network.NetworkPlan()
    theta, n = network.start(p).theta, 600
    ids = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 510, pa.int32()), pa.array(np.arange(n * 510) % 50_000, pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(n))), pa.array([0] * n, pa.int32()), ids], names=["document_id", "chunk_index", "chunk_ids"])
    tracemalloc.start()
    found = [x for b in network.scored(theta, p, Chunks())(iter([batch])) for x in b.column("probs").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = network.forward(theta, p, *network._tokens(batch, p))[2]
    assert np.abs(np.array(found) - whole).max() < 1e-9 and peak < 32 << 20
