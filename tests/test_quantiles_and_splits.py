"""Percentiles against numpy, the family split against the rule taken one family at a time."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import splitting
from docloom.operators.quantiles import percentiles, with_percentiles

SHARES = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}


def groups():
    r = np.random.default_rng(5)
    return {
        "latency": r.exponential(300.0, 997).tolist(),
        "wide": (10.0 ** r.uniform(-250, 250, 400) * r.choice([-1, 1], 400)).tolist(),
        "hot": [7.0] * 900 + r.normal(7, 1e-9, 100).tolist(),
        "lengths": [float(x) for x in r.integers(0, 30, 500)],
        "extremes": [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, -5e-324],
        "two": [1.0, 2.0],
        "one": [3.5],
        None: [1.0, 4.0, 9.0],
    }


@pytest.mark.parametrize("parts", [2, 4096])
def test_percentiles_equal_numpy(spark, parts):
    data = groups()
    if parts == 2:  # one bit of range a pass: few values
        data = {k: data[k] for k in ("two", "one", "lengths", None)}
    rows = [(g, x) for g, xs in data.items() for x in xs] + [("latency", None), ("nulls", None)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in percentiles(df, ["g"], F.col("v"), SHARES, parts).collect()}
    assert got.keys() == data.keys()
    for g, xs in data.items():
        for name, q in SHARES.items():
            at = q * (len(xs) - 1)
            xs_ = sorted(xs)
            low, high = xs_[int(np.floor(at))], xs_[int(np.ceil(at))]
            want = low if low == high else low * (np.floor(at) + 1 - at) + high * (at - np.floor(at))
            assert got[g][name] == pytest.approx(want, rel=1e-12, abs=0), (g, name)


def test_percentiles_without_groups_or_rows(spark):
    df = spark.range(1, 102).select(F.col("id").alias("v"))
    assert [tuple(r) for r in percentiles(df, [], F.col("v"), {"m": 0.5, "p": 0.95}).collect()] == [(51.0, 96.0)]
    assert percentiles(df.where("v < 0"), [], F.col("v"), {"m": 0.5}).count() == 0
    plain = spark.createDataFrame([("a", 1.0), ("b", None), (None, 2.0)], "g string, v double")
    out = with_percentiles(plain.groupBy("g").agg(F.count("*").alias("n")), plain, ["g"], F.col("v"), {"m": 0.5})
    assert {tuple(r) for r in out.collect()} == {("a", 1, 1.0), ("b", 1, None), (None, 1, 2.0)}
    with pytest.raises(Exception, match="finite"):
        percentiles(spark.createDataFrame([(float("nan"),)], "v double"), [], F.col("v"), {"m": 0.5}).collect()


def test_no_operator_keeps_values_in_one_buffer(spark):
    from docloom.operators import corpus, evaluation

    docs = spark.createDataFrame([("1", "some text", "IRS"), ("2", None, "SSA")], "document_id string, text string, agency string")
    cases = spark.createDataFrame([("1", "m", "IRS", "IRS", 5.0, 3, 0.1, "success")], "document_id string, method string, true_label string, predicted_label string, latency_ms double, total_tokens long, estimated_cost_usd double, status string")
    for df in (corpus.validation_report(docs), corpus.describe_by(docs, "agency", F.length("text")), evaluation.summary_metrics(cases, ["method"])):
        assert "percentile" not in df._jdf.queryExecution().toString()


def one_by_one(lack, size, count):
    lack, out = dict(lack), []
    for _ in range(count):
        best = max(lack, key=lack.__getitem__)
        out.append(best)
        lack[best] -= size
    return out


def test_deal_is_the_rule_one_by_one():
    r = random.Random(11)
    for _ in range(4000):
        size, count = r.randint(1, 9), r.randint(0, 25)
        lack = {s: Fraction(r.randint(-20, 60), r.choice([1, 1, 2, 20])) for s in splitting.SPLITS}
        order, alone, pair, taken = splitting.deal(lack, size, count)
        want = one_by_one(lack, size, count)
        x = 1 if (pair - alone) % 2 == 0 else 0
        got = [order[0 if i < alone else (i - alone + 1) % 2 if i < pair else (2, x, 1 - x)[(i - pair) % 3]] for i in range(count)]
        assert got == want
        assert taken == [want.count(s) for s in order]


@pytest.mark.parametrize("seed", range(3))
def test_family_split_one_by_one(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for agency, n in (("A", 180), ("B", 140), ("C", 3), ("D", 2), ("E", 1), (None, 20)):
        sizes = {f"{agency}:{i}": min(int(r.paretovariate(1.1)), 40) for i in range(n)}
        rows += [(f"{f}#{k}", agency, f) for f, m in sizes.items() for k in range(m)]
        total, have = float(sum(sizes.values())), dict.fromkeys(splitting.SPLITS, 0.0)
        for i, f in enumerate(sorted(sizes, key=lambda f: (-sizes[f], hashlib.sha256(f"42:{f}".encode()).hexdigest()))):
            lack = {s: total * splitting.RATIOS[s] - have[s] for s in splitting.SPLITS}
            want[f] = "test" if i == 0 and n > 1 else "validation" if i == 1 and n > 2 else max(lack, key=lack.__getitem__)
            have[want[f]] += sizes[f]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "document_id string, effective_agency string, effective_family_id string")
    got = splitting.family_split(df)
    assert {x.effective_family_id: x.split for x in got.collect()} == want
    assert got.count() == len(want)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()  # families themselves go through no Python


def test_family_split_of_nothing(spark):
    none = spark.createDataFrame([], "document_id string, effective_agency string, effective_family_id string")
    assert splitting.family_split(none).collect() == []


def test_stratified_split_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, "x"), ("1", "x"), ("2", None)], "k string, label string")
    assert splitting.stratified_split(df, "label", "k").count() == 3


def test_near_duplicates_of_long_and_short_texts(spark):
    from docloom.operators import corpus

    r = random.Random(2)
    texts = [" ".join(f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.choice([3, 40, 400]))) for _ in range(120)]
    texts += [" ".join(t.split()[: -len(t.split()) // 9 or None]) for t in texts[:60]]
    df = spark.createDataFrame([(f"{i:03}", t, i) for i, t in enumerate(texts)], "document_id string, text string, hash int").repartition(6)
    once = {}
    for i, t in enumerate(texts):
        once.setdefault(t, f"{i:03}")
    known = sorted({w for t in texts for w in t.split()})
    tf = np.array([[t.split().count(w) for w in known] for t in once], dtype=float)
    copies = np.array([texts.count(t) for t in once])
    w = tf * (np.log((1 + len(texts)) / (1 + copies @ (tf > 0))) + 1)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    ids = list(once.values())
    for threshold in (0.6, 0.92):
        near = w @ w.T
        want = {(a, b): near[i, j] for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b and near[i, j] >= threshold}
        got = {(x.a, x.b): x.similarity for x in corpus.near_duplicate_pairs(df, threshold, max_features=None).collect()}
        assert got == pytest.approx(want) and want
        vectors = corpus.tfidf_vectors(df.selectExpr("document_id", "text", "1L AS copies"), df.count(), threshold)
        assert {(x.a, x.b) for x in corpus.near_duplicate_candidates(vectors, threshold).collect()} >= want.keys()
    assert corpus.near_duplicate_pairs(df.where("false")).count() == 0


def test_near_duplicates_of_many_blocks(spark, monkeypatch):
    """Documents that share a term of their prefixes meet block by block: the same pairs, whatever the size of a block."""
    from docloom.operators import corpus

    r = random.Random(5)
    texts = [" ".join(["shared", *(f"w{r.randrange(40)}" for _ in range(r.choice([2, 5, 9])))]) for _ in range(90)]
    df = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "document_id string, text string")
    got = []
    for size in (1 << 15, 7):
        monkeypatch.setattr(corpus, "PAIR_BLOCK", size)
        got.append({(x.a, x.b, round(x.similarity, 9)) for x in corpus.near_duplicate_pairs(df, 0.5, max_features=None).collect()})
    assert got[0] == got[1] and len(got[0]) > 3
