"""Class bigram scores against plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from docloom.llm import brown

P = brown.Brown(classes=9, rounds=4, least_count=12, batch_bytes=20000)


def learnt(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1


def words(text):
    return (text or "").encode().lower().split() + [None]


@pytest.fixture(scope="module")
def rows(texts):
    return [*texts, (None, "The Of and"), (7, "a seventh row"), (7, "a seventh row")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 3, "x") for i, t in rows], "doc_id long, text string, batch string, shard int, tokens string").repartition(3)


def test_scores(spark, rows, frame):
    counts = collections.Counter(w for i, t in rows if learnt(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    model = brown.train(frame, P)
    classes = {r.word.encode(): r["class"] for r in brown.word_classes(model).collect()}
    assert {r.word.encode(): r.n for r in brown.word_classes(model).collect()} == {w: c for w, c in counts.items() if w}
    classes[None] = brown.END
    assert brown.END not in {c for w, c in classes.items() if w}
    pairs, totals = collections.Counter(), collections.Counter()
    for i, t in rows:
        if learnt(i):
            own = [brown.END, *(classes[w] for w in words(t))]
            pairs.update(zip(own, own[1:], strict=False))
            totals.update(own[:-1])
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    # the end is no word that could be seen once
    d = once / (once + 2 * twice)
    assert d == pytest.approx(brown.discount(model))
    left, free = collections.Counter(), d * v / n
    for w, c in counts.items():
        left[classes[w]] += c - d
    every = sum(left.values())

    def step(before, w):
        if w not in counts:
            return free
        c = classes[w]
        a = classes.get(before, "unknown")
        return (1 - free) * (pairs[a, c] + P.prior * left[c] / every) / (totals[a] + P.prior) * (counts[w] - d) / left[c]

    for before in (None, b"the", b"no such word"):
        assert sum(step(before, w) for w in [*counts, b"no such word"]) == pytest.approx(1)
    want = []
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        full = sum(math.log10(step(a, b)) for a, b in zip([None, *own], own, strict=False))
        want.append((str(i), not learnt(i), len(own), sum(w in counts for w in own), n, base, full))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in brown.score(frame, P).collect())
    assert len(got) == len(rows)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-6)


def test_rounds_raise_the_likelihood(frame):
    model = brown.train(frame, P)
    assert model.likelihoods[-1] > model.likelihoods[0]
    assert sorted(model.likelihoods) == model.likelihoods
    assert model.words.sum() == brown.word_classes(model).count() + 1 and model.matrix.sum() == model.tokens.sum()


def test_held_out_documents_are_less_perplexing(spark):
    """Two kinds of documents with words of their own: classes learn which belong together."""
    rng = random.Random(1)
    lexicon = [[f"{kind}{j}" for j in range(150)] for kind in "ab"]
    rows = [(i, " ".join(rng.choice(lexicon[i % 2]) for _ in range(150))) for i in range(150)]
    scored = brown.score(spark.createDataFrame(rows, "doc_id long, text string"), brown.Brown(classes=6, rounds=10, least_count=5))
    got = {r.held_out: r for r in brown.perplexity(scored, ["held_out"]).collect()}
    assert got[True].perplexity < 0.7 * got[True].base_perplexity


def test_few_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert brown.score(empty, P).count() == 0
    # 1's remainder: see learnt(); all words unknown, or no words at all
    i = next(i for i in range(100) if not learnt(i))
    got = brown.score(spark.createDataFrame([(i, "Some words"), (i, None)], "doc_id long, text string"), P).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    got = brown.score(spark.createDataFrame([(None, ""), (None, " \n")], "doc_id long, text string"), P).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got] == [(1, 1, 2, round(math.log10(2.5 / 3), 9))] * 2


def test_exchange_gains():
    """Differences of gains are differences of the likelihood, for moves of one word."""
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 12, 600)
    tokens[100:140] = 3  # beside itself
    classes = rng.integers(0, 4, 12)

    def table(classes):
        m = np.zeros((4, 4), dtype=np.int64)
        np.add.at(m, (classes[tokens[:-1]], classes[tokens[1:]]), 1)
        return m

    m = table(classes)
    for w in range(1, 12):
        if w in (tokens[0], tokens[-1]):
            continue
        own = int(classes[w])
        before = np.bincount(classes[tokens[:-1]][tokens[1:] == w], minlength=4)
        after = np.bincount(classes[tokens[1:]][tokens[:-1] == w], minlength=4)
        alone = np.array([((tokens[1:] == w) & (tokens[:-1] == w)).sum()])
        gains = brown.exchange_gains(m, own, before[None], after[None], alone)[0]
        for c in range(4):
            other = classes.copy()
            other[w] = c
            assert gains[c] - gains[own] == pytest.approx(brown.likelihood(table(other)) - brown.likelihood(m), abs=1e-6)
