"""Rules on small cases, written out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import checks, chunks, corpus, evaluation, retrieval, splitting
from docloom.plans import cases as case_plans
from docloom.plans.prepare import prepare
from docloom.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("agency", "name", "number", "family", "evidence"),
    [
        ("SSA", "fss4.pdf", None, "SSA:SS4", "filename_code_match"),
        ("SSA", "fss4sp.pdf", None, "SSA:SS4", "filename_code_match"),
        ("USCIS", "i-765.pdf", "I-765", "USCIS:I765", "form_number_exact"),
        ("USCIS", "i-765instr.pdf", "I-765", "USCIS:I765", "form_number_exact"),
        ("DMV", "verification-authorization-dl-93.pdf", None, "DMV:DL93", "filename_code_match"),
        ("DMV", "verification-thai-dl-93-th.pdf", None, "DMV:DL93", "filename_code_match"),
        ("DMV", "certificate-of-facts-re-unsatisfied-judgment.pdf", None, "SINGLETON:DMV:1", "singleton_no_evidence"),
        ("IRS", "fw4v.pdf", "nan", "IRS:W4V", "filename_code_match"),
        ("IRS", "f1040eskr.pdf", "", "IRS:F1040", "filename_code_match"),
        ("USCIS", "form-instructions-sp.pdf", None, "SINGLETON:USCIS:1", "singleton_no_evidence"),
        ("USCIS", "a%2Bb c_reg-12%zz.pdf", None, "USCIS:REG12ZZ", "filename_code_match"),
    ],
)
def test_families(spark, agency, name, number, family, evidence):
    df = spark.createDataFrame([("1", agency, name, number)], "document_id string, agency string, filename string, form_number string")
    got = corpus.assign_families(df).first()
    assert (got.family_id, got.evidence_type) == (family, evidence)


@pytest.mark.parametrize("total", [0, 1, 509, 510, 511, 892, 893, 50_000])
def test_windows_against_a_loop(spark, total):
    want, start = [], 0
    while total > 0:
        if start + 510 >= total:
            want.append((max(0, total - 510), total))
            break
        want.append((start, start + 510))
        start += 382
    got = one(spark, chunks.window_ranges(F.lit(total), 510, 382).alias("r")).r
    assert [(r.token_start, r.token_end) for r in got] == want
    with pytest.raises(ValueError, match="step"):
        chunks.window_ranges(F.lit(1), 10, 0)


@pytest.mark.parametrize(
    ("text", "rule", "n", "masked"),
    [
        ("the United States Citizenship and Immigration Services (USCIS).", "agency_identifier:USCIS", 2, "the [AGENCY_NAME] ([AGENCY_NAME])."),
        ("Please complete Form I-9 and submit it", "form_number", 1, "Please complete Form [FORM_NUMBER] and submit it"),
        ("OMB No. 1615-0047 appears", "omb_number", 1, "[OMB_NUMBER] appears"),
        ("Visit www.uscis.gov/i-9 now", "agency_url", 1, "Visit [AGENCY_URL] now"),
        ("Form SSA-714 of the SSA", "form_number", 1, "Form [FORM_NUMBER] of the [AGENCY_NAME]"),
    ],
)
def test_masks(spark, text, rule, n, masked):
    got = chunks.masked(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert got.rule_match_counts[rule] == n and got.masked_text == masked


def test_text_hashes(spark):
    h = lambda x: T.normalized_text_hash(F.lit(x))
    r = one(spark, (h("a - b") == h("a b")).alias("dash"), (h("École!") == h("cole")).alias("letters"), (h("  A\n b ") == h("a b")).alias("spaces"))
    assert (r.dash, r.letters, r.spaces) == (False, False, True)


SCORES = {
    "tie": [(0.99, 0.01, 0.0, 0.0), (0.9, 0.05, 0.03, 0.02), (0.05, 0.55, 0.2, 0.2), (0.1, 0.51, 0.19, 0.2)],
    "full": [(0.7, 0.1, 0.1, 0.1), (0.1, 0.7, 0.1, 0.1)],
    "early": [(0.8, 0.1, 0.05, 0.05), (0.1, 0.8, 0.05, 0.05)],
}


def test_aggregation(spark):
    rows = [(d, i, list(p), [10 * x for x in p]) for d, ps in SCORES.items() for i, p in enumerate(ps)]
    rows += [("logits", 0, [0.25] * 4, [2.0, 0.0, 0.0, 0.0]), ("logits", 1, [0.25] * 4, [0.0, 3.0, 0.0, 0.0]), ("bad", 0, [0.5], None)]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, probs array<double>, logits array<double>")
    said = {m: {r.document_id: r.predicted for r in evaluation.aggregate_scores(df, m).collect()} for m in evaluation.METHODS}
    assert said["majority_vote"]["tie"] == "USCIS" and said["majority_vote"]["full"] == "USCIS"
    assert said["max_confidence"]["early"] == "USCIS" and said["mean_logits"]["logits"] == "DMV"
    assert all("bad" not in x for x in said.values())
    with pytest.raises(ValueError, match="unknown"):
        evaluation.aggregate_scores(df, "median")


def greedy(pool, k=5):
    out = []
    for c in pool:
        if len(out) < k and sum(o[1] == c[1] for o in out) < 2 and sum(o[2] == c[2] for o in out) < 2 and all(o[3] != c[3] for o in out):
            out.append(c)
    return [c[0] for c in out]


def test_diversified_selection(spark):
    import random

    rng = random.Random(4)
    pools = {
        0: [(f"c{i}", "p", "f", f"h{i}") for i in range(10)],
        1: [(f"c{i}", "p0", "f0", f"h{i}") for i in range(20)] + [(f"d{i}", f"p{i}", f"f{i}", f"g{i}") for i in range(1, 6)],
        2: [("c1", "p1", "f1", "same"), ("c2", "p2", "f2", "same"), ("c3", "p3", "f3", "h3")],
        # the third is turned away by its family and must not use up its parent's share
        3: [("a", "p1", "f1", "1"), ("b", "p2", "f1", "2"), ("c", "p3", "f1", "3"), ("d", "p3", "f2", "4"), ("e", "p3", "f3", "5")],
    } | {q: [(f"c{i}", f"p{rng.randrange(5)}", f"f{rng.randrange(4)}", f"h{rng.randrange(12)}") for i in range(20)] for q in range(4, 30)}
    rows = [(q, i + 1, *c) for q, pool in pools.items() for i, c in enumerate(pool)]
    got = {}
    for r in retrieval.diversified(spark.createDataFrame(rows, "query_id int, place int, chunk_id string, parent string, family string, text_hash string")).orderBy("new_place").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {q: greedy(pool) for q, pool in pools.items()}


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8 * 3 * 2)
    rows = [(f"c{i}", [math.cos(i), math.sin(i), i / 10]) for i in range(40)] + [("c40", [math.cos(3), math.sin(3), 0.3])]
    v = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(3)
    q = v.where("chunk_id in ('c3', 'c7', 'c9', 'c11', 'c20')").select(F.col("chunk_id").alias("query_id"), "vector")
    got = {(r.query_id, r.place): r.chunk_id for r in retrieval.nearest(v, q, 4).collect()}
    assert len(got) == 20 and {got["c3", 1], got["c3", 2]} == {"c3", "c40"} and got["c7", 1] == "c7"
    assert retrieval.nearest(v, q.where("query_id = 'none'"), 4).count() == 0


def fold(sizes):
    import hashlib

    out, total = {}, sum(sizes.values())
    order = sorted(sizes, key=lambda f: (-sizes[f], hashlib.sha256(f"42:{f}".encode()).hexdigest()))
    have = dict.fromkeys(splitting.SPLITS, 0)
    for i, f in enumerate(order):
        lack = {s: total * splitting.RATIOS[s] - have[s] for s in splitting.SPLITS}
        split = "test" if i == 0 and len(order) > 1 else "validation" if i == 1 and len(order) > 2 else max(splitting.SPLITS, key=lambda s: lack[s])
        out[f], have[split] = split, have[split] + sizes[f]
    return out


def test_family_split(spark):
    agencies = {"BIG": {f"BIG:F{i}": 1 if i % 3 else 2 for i in range(30)}, "TINY": {f"TINY:F{i}": 2 - i % 2 for i in range(6)}, "TWO": {"TWO:a": 1, "TWO:b": 1}, "ONE": {"ONE:a": 5}}
    rows = [(f"{f}#{k}", a, f) for a, fs in agencies.items() for f, n in fs.items() for k in range(n)]
    df = spark.createDataFrame(rows, "document_id string, effective_agency string, effective_family_id string")
    got = {r.effective_family_id: r.split for r in splitting.family_split(df.repartition(7)).collect()}
    assert got == {f: s for fs in agencies.values() for f, s in fold(fs).items()}
    split = splitting.split_documents(df, splitting.family_split(df))
    assert checks.report(checks.split_checks(df, split)).where("violations > 0").count() == 0
    lost = splitting.split_documents(df, splitting.family_split(df).where("effective_agency <> 'ONE'"))
    with pytest.raises(Exception, match="no split for family ONE:a"):
        lost.collect()


def test_planted_violations_are_found(spark):
    eligible = spark.createDataFrame([("1", "f1"), ("2", "f1"), ("3", "f2")], "document_id string, effective_family_id string")
    split = spark.createDataFrame([("1", "f1", "train"), ("1", "f1", "test"), ("2", "f1", "train"), ("9", "f9", "test")], "document_id string, effective_family_id string, split string")
    got = {r.check: r.violations for r in checks.report(checks.split_checks(eligible, split)).collect()}
    assert got == {"document_overlap": 1, "family_overlap": 1, "eligible_not_once": 2, "excluded_in_split": 1}
    schema = "chunk_id string, document_id string, effective_family_id string, split string, chunk_index int, total_chunks int, chunk_text string"
    parents = spark.createDataFrame([("1", "train"), ("2", "test"), ("5", "train")], "document_id string, split string")
    bad = spark.createDataFrame([("a", "1", "f1", "train", 0, 2, "x"), ("a", "1", "f1", "test", 2, 2, " "), ("b", "7", "f7", "test", 0, 3, "x")], schema)
    got = {r.check: r.violations for r in checks.report(checks.chunk_checks(parents, bad)).collect()}
    assert got == {"chunk_without_parent": 1, "chunk_split_differs": 1, "chunk_id_in_splits": 1, "document_chunks_in_splits": 1, "family_chunks_in_splits": 1, "chunk_id_repeats": 1, "indices_not_contiguous": 1, "total_chunks_differs": 1, "empty_chunk": 1, "document_without_chunk": 2}
    c = spark.createDataFrame([("m", "1", "x", "h1"), ("m", "1", "x", "h2"), ("n", "8", "x", "h")], "method string, document_id string, condition string, input_fingerprint string")
    docs = spark.createDataFrame([("1",), ("2",)], "document_id string")
    got = {r.check: r.violations for r in checks.report(checks.evaluation_checks(c, docs, docs)).collect()}
    assert got == {"case_repeats": 1, "unknown_document": 1, "document_not_evaluated": 1, "input_differs": 1, "test_document_in_index": 2}
    with pytest.raises(AssertionError, match="case_repeats: 1"):
        checks.require(checks.report(checks.evaluation_checks(c, docs)))
    weights = spark.createDataFrame([("1", 0.5), ("1", 0.4)], "document_id string, weight double")
    assert checks.report(checks.weight_checks(weights)).first().violations == 1
    repeats = spark.createDataFrame([([0, 0],)], "selected array<int>")
    assert checks.report(checks.selection_checks(repeats)).first().violations == 1
    assert checks.declared_inputs(["train.parquet", "test.parquet"]) == ["test.parquet"]


def test_fingerprints_do_not_depend_on_layout(spark):
    df = spark.createDataFrame([(str(i), None if i % 3 else "x") for i in range(100)], "a string, b string")
    for make in (splitting.fingerprint, splitting.fingerprint_at_scale):
        prints = {make(df.repartition(n), ["a", "b"]).first().fingerprint for n in (1, 3, 7)}
        assert len(prints) == 1 and prints != {make(df.where("a <> '5'"), ["a", "b"]).first().fingerprint}


def test_labels_without_cases_count(spark):
    c = spark.createDataFrame([("m", "USCIS", "USCIS"), ("m", "DMV", None)], "method string, true_label string, predicted_label string")
    got = {r.label: r for r in evaluation.label_metrics(c, ["method"]).collect()}
    assert got["IRS"].f1 == 0 and got["IRS"].support == 0 and got["USCIS"].f1 == 1 and got["DMV"].recall == 0
    assert evaluation.confusion(c, ["method"]).agg(F.sum("n")).first()[0] == 1


def test_mcnemar(spark):
    rows = [(15, 5), (5, 15), (10, 10), (4, 5), (0, 12)]
    got = {(r.b, r.c): r for r in evaluation.mcnemar(spark.createDataFrame(rows, "b long, c long")).collect()}
    for b, c in rows:
        n = b + c
        want = min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
        assert got[b, c].p_value == (None if n < 10 else pytest.approx(1.0 if b == c else want, abs=1e-6))


def test_bootstrap_covers_the_point(spark):
    rows = [("m", str(i), "complete_unmasked", "USCIS", "USCIS" if i % 5 else None) for i in range(200)] + [("n", str(i), "complete_unmasked", "USCIS", "USCIS") for i in range(200)]
    c = spark.createDataFrame(rows, "method string, document_id string, condition string, true_label string, predicted_label string")
    got = {(r.method, r.metric): r for r in evaluation.bootstrap(c).collect()}
    assert got["m", "accuracy"].point == 0.8 and 0.7 < got["m", "accuracy"].low < 0.8 < got["m", "accuracy"].high < 0.9
    assert got["n", "accuracy"].low == 1.0
    diff = {(r.method_a, r.method_b, r.metric): r for r in evaluation.paired_bootstrap(c, ["n", "m", "o"]).collect()}
    assert len(diff) == 6
    one = diff["n", "m", "accuracy"]
    assert one.point == pytest.approx(0.2) and 0.1 < one.low < 0.2 < one.high < 0.3
    # of four labels only one has cases: its F1 is 1, and 2 * 160 / (200 + 160)
    assert diff["n", "m", "macro_f1"].point == pytest.approx((1 - 320 / 360) / 4) and diff["n", "m", "macro_f1"].low < diff["n", "m", "macro_f1"].point < diff["n", "m", "macro_f1"].high


def test_bootstrap_is_a_resampling_of_documents(spark):
    """Its intervals agree with those from drawing documents one by one."""
    rng = np.random.default_rng(1)
    n = 300
    true, said = rng.integers(0, 4, n), rng.integers(0, 4, n)
    said = np.where(rng.random(n) < 0.7, true, said)
    labels = corpus.LABELS
    rows = [("m", str(i), "c", labels[t], labels[p]) for i, (t, p) in enumerate(zip(true, said, strict=True))]
    got = {r.metric: r for r in evaluation.bootstrap(spark.createDataFrame(rows, "method string, document_id string, condition string, true_label string, predicted_label string")).collect()}
    draws = rng.integers(0, n, (2000, n))
    f1 = lambda t, p: np.mean([2 * ((t == x) & (p == x)).sum() / max((t == x).sum() + (p == x).sum(), 1) for x in range(4)])
    for metric, score in (("accuracy", lambda t, p: (t == p).mean()), ("macro_f1", f1)):
        values = [score(true[d], said[d]) for d in draws]
        assert got[metric].point == pytest.approx(score(true, said))
        assert got[metric].low == pytest.approx(np.percentile(values, 2.5), abs=0.01) and got[metric].high == pytest.approx(np.percentile(values, 97.5), abs=0.01)


def test_tfidf_terms(spark):
    df = spark.createDataFrame([("1", "a", "The red fox, the RED fox"), ("2", "a", "red wolf"), ("3", "b", "x"), ("4", "b", None)], "document_id string, kind string, text string")
    got = {(r.document_id, r.term) for r in corpus.tfidf(df, ["the"], 2).collect()}
    assert got == {("1", t) for t in ("red", "fox", "red fox", "fox red")} | {("2", t) for t in ("red", "wolf", "red wolf")}
    assert {r.term for r in corpus.tfidf(df, ["the"], 2, 3).collect()} == {"red", "fox", "red fox"}
    means = {r.term: r.score for r in corpus.tfidf_by_class(df, "kind", stop=["the"], ngrams=1).collect()}
    idf = lambda k: math.log(5 / (1 + k)) + 1
    one, two = math.hypot(2 * idf(2), 2 * idf(1)), math.hypot(idf(2), idf(1))
    assert means == pytest.approx({"red": (2 * idf(2) / one + idf(2) / two) / 2, "fox": idf(1) / one, "wolf": idf(1) / two / 2}, abs=1e-6)


def test_near_duplicates_against_all_pairs(spark):
    import random
    from collections import Counter

    rng = random.Random(9)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(25)]
    texts += [t + " extra" for t in texts[:8]] + [texts[0], "", None]
    df = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "document_id string, text string")
    got = {(r.a, r.b): r.similarity for r in corpus.near_duplicate_pairs(df, 0.9).collect()}
    counts = [Counter((t or "").split()) for t in texts]
    once = {(t or ""): i for i, t in reversed(list(enumerate(texts)))}
    df_ = Counter(w for own in counts for w in own)
    idf = {w: math.log((1 + len(texts)) / (1 + k)) + 1 for w, k in df_.items()}
    vec = {i: {w: k * idf[w] for w, k in counts[i].items()} for i in once.values()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    want = {}
    ids = sorted(vec)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            s = sum(v * vec[j].get(w, 0) for w, v in vec[i].items()) / (norm[i] * norm[j] or 1)
            if s >= 0.9:
                want[f"{i:03}", f"{j:03}"] = s
    assert set(got) == set(want) and len(want) >= 8
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_cases_resume_and_retry(spark, tmp_path):
    calls = tmp_path / "calls"

    def provider(prompt):
        with calls.open("a") as f:
            f.write(prompt[-1] + "\n")
        if prompt.endswith("a") and calls.read_text().count("a") < 2:
            raise RuntimeError("429 rate limit")
        if prompt.endswith("b"):
            raise ValueError("bad key")
        return ("nonsense" if prompt.endswith("c") else "DMV", 0.5, 1, 1)

    registry = spark.createDataFrame([(x, "complete_unmasked", x, x) for x in "abcd"], "document_id string, condition string, text string, text_fingerprint string").coalesce(1)
    keyed = case_plans.case_keys(registry, "llm", "m")
    none = spark.createDataFrame([], case_plans.RESULT)
    case_plans.resume(keyed, none, provider, backoff=0.0).write.parquet(str(tmp_path / "stored"))
    done = spark.read.parquet(str(tmp_path / "stored"))
    got = {r.document_id: r for r in done.join(keyed.select("cache_key", "document_id"), "cache_key").collect()}
    assert (got["a"].status, got["a"].attempt_count) == ("success", 2)
    assert (got["b"].status, got["b"].error_type, got["b"].attempt_count) == ("failed", "ValueError", 1)
    assert (got["c"].status, got["c"].predicted_label) == ("invalid_response", None)
    before = calls.read_text()
    assert case_plans.resume(keyed, done, provider).count() == 4 and calls.read_text() == before
    other = case_plans.case_keys(registry.withColumn("condition", F.lit("complete_masked")), "llm", "m")
    assert other.join(done, "cache_key", "left_semi").count() == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted"\nline', "SSA"), ("2", None, "IRS")], "document_id string, text string, agency string")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), "document_id string, text string, agency string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_csv(df, str(tmp_path / "csv"))
    tables.write_jsonl(df, str(tmp_path / "jsonl"))
    assert tables.read_jsonl(spark, str(tmp_path / "jsonl"), df.schema).count() == 2
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "a string").count() == 0
    path = tables.write_version(df, str(tmp_path), "docs", "r1", ["agency"])
    assert tables.read_split(spark, path).count() == 2
    tables.write_manifest(spark, {"b": 1, "a": "x"}, str(tmp_path / "manifest"))
    assert tables.read_manifest(spark, str(tmp_path / "manifest"), "a string, b int").first() == ("x", 1)
    stored = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "cache_key string, stored_at int, v string")
    assert tables.newest(stored).first().v == "new"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_bytes(b"<p>caf\xc3\xa9</p>")
    got = tables.read_files(spark, str(tmp_path / "raw")).select("too_small", tables.page_text(F.col("text")).alias("t")).first()
    assert got == (True, "café")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="agency"):
        corpus.validation_report(spark.createDataFrame([("1", "x")], "document_id string, text string"))


def test_prepare_holds_its_invariants(spark):
    rows = [(str(i), f"word{i} " * (30 + i * 7 % 900), corpus.LABELS[i % 4], f"reg-{i % 23}.pdf", None, "en" if i % 9 else "es", 0.95) for i in range(120)]
    source = spark.createDataFrame(rows, "document_id string, text string, agency string, filename string, form_number string, detected_language string, language_confidence double")
    done = prepare(source, spark.createDataFrame([("9", None, None, "include_english_corpus")], corpus.OVERRIDES), 100, 20)
    checks.require(done.checks())
    assert done.registry.count() == 10 * done.split.count() and done.split.where("document_id = '9'").count() == 1


def test_settings_are_checked():
    from docloom.plans import settings

    assert settings.settings('{"window": 20, "overlap": 5}').window == 20
    assert settings.settings('{"seed": 1, "window": 9, "overlap": 2}').digest() == settings.settings('{"overlap": 2, "window": 9, "seed": 1}').digest()
    for bad in ('{"windw": 3}', '{"window": 3, "overlap": 3}', '{"ratios": {"train": 0.5}}'):
        with pytest.raises(ValueError):
            settings.settings(bad)
    with pytest.raises(ValueError):
        settings.prompt('{"template": "no place for the text"}')


def test_csv_keeps_what_it_was_given(spark, tmp_path):
    from docloom.sources import tables

    rows = [("1", ' "quoted", \n two lines '), ("2", ""), ("3", None), ("4", "back\\slash\\")]
    tables.write_csv(spark.createDataFrame(rows, "document_id string, text string"), str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), "document_id string, text string")
    assert sorted((r[0], r[1]) for r in back.collect()) == [(i, t or None) for i, t in rows]


def test_unready_models_are_refused(spark, tmp_path):
    from docloom.plans import classifier

    with pytest.raises(FileNotFoundError):
        classifier.load_artifact(spark, str(tmp_path), "m1")


def test_chunk_split_refuses_documents_without_tokens(spark):
    from docloom.operators import chunks as K

    docs = spark.createDataFrame([("1", "a b"), ("2", " ")], "document_id string, text string")
    with pytest.raises(Exception, match="no chunks: 2"):
        K.chunk_split(docs).collect()


def test_model_inputs_cut_and_pad(spark):
    from docloom.operators import chunks as K

    docs = spark.createDataFrame([([7, 8],), ([],), ([1, 2, 3, 4, 5],)], "ids array<int>")
    got = [(r[0], r[1]) for r in docs.select(*K.model_inputs(F.col("ids"), 5)).collect()]
    assert got == [([101, 7, 8, 102, 0], [1, 1, 1, 1, 0]), ([101, 102, 0, 0, 0], [1, 1, 0, 0, 0]), ([101, 1, 2, 3, 4], [1] * 5)]


def test_what_a_task_keeps_of_neighbours_is_bounded(spark, monkeypatch):
    """Many queries, with ties and an incoming order that is the worst, in small steps: the same rows as all at once by hand."""
    import hashlib

    monkeypatch.setattr(retrieval, "KEPT_BYTES", 112 * 4 * 10)
    monkeypatch.setattr(retrieval, "FRAME_ROWS", 3)
    monkeypatch.setattr(retrieval, "OUT_QUERIES", 2)
    rows = [(f"c{i}", [1.0, 5.0 / (1 + i // 3)]) for i in range(40)]
    asked = [(f"q{i}", [1.0, i / 10]) for i in range(25)]
    v, q = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(2), spark.createDataFrame(asked, "query_id string, vector array<double>")
    assert retrieval.nearest(v, q, 4)._jdf.queryExecution().analyzed().toString().count("MapInPandas") == 3  # blocks of ten queries at most
    got = {}
    for r in retrieval.nearest(v, q, 4).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.similarity))
    cos = lambda a, b: round((a[0] * b[0] + a[1] * b[1]) / (math.hypot(*a) * math.hypot(*b)), 6)
    for name, x in asked:
        near = sorted(((c, cos(x, y)) for c, y in rows), key=lambda t: (-t[1], hashlib.sha256(f"42:{t[0]}".encode()).hexdigest()))[:4]
        assert got[name] == near


def test_terms_by_class_send_no_terms_of_documents(spark, monkeypatch):
    """Pairs of words below the last one kept are left out, others not; steps of some words; the same as from all terms of all documents."""
    import random

    rng = random.Random(8)
    words = [f"w{i}é" for i in range(30)]
    docs = [(str(i), rng.choice(["x", "y", None]), " ".join(rng.choices(words, [1 / (1 + j) for j in range(30)], k=rng.randrange(40)))) for i in range(60)] + [("e", "x", None), ("f", "y", ""), (None, "y", "w0é w1é w0é w1é")]
    df = spark.createDataFrame(docs, "document_id string, kind string, text string").repartition(3)
    monkeypatch.setattr(corpus, "WORD_STEP", 50)
    for most, least_words in ((12, corpus.MOST_WORDS), (12, 3), (1000, corpus.MOST_WORDS)):
        monkeypatch.setattr(corpus, "MOST_WORDS", least_words)
        weights = corpus.tfidf(df, ["the"], 2, most).join(df.select("document_id", "kind"), "document_id").where("kind is not null")
        sizes = {r.kind: r["count"] for r in df.groupBy("kind").count().collect()}
        want = {(r.kind, r.term): round(r.s / sizes[r.kind], 6) for r in weights.groupBy("kind", "term").agg(F.sum("weight").alias("s")).collect()}
        made = corpus.tfidf_by_class(df, "kind", 10_000, ["the"], 2, most)
        got = {(r.kind, r.term): r.score for r in made.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
        assert "hashpartitioning(document_id" not in made._jdf.queryExecution().executedPlan().toString()


def test_reruns_are_dealt_out_over_the_session_s_partitions(spark, monkeypatch):
    from docloom.queries import integrity

    parts, of = [], splitting.fingerprint_at_scale
    monkeypatch.setattr(splitting, "fingerprint_at_scale", lambda df, *a: parts.append(df._jdf.queryExecution().analyzed().toString()) or of(df, *a))
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        integrity.j14(spark, "/root/testdata/sf0.001")
        integrity.j18b(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    dealt = [p for p in parts if "RepartitionByExpression" in p]
    assert len(dealt) == 2 and all(", 5" in p.partition("RepartitionByExpression")[2].partition("\n")[0] for p in dealt)


def test_masked_texts_are_not_sent(spark):
    plain = spark.createDataFrame([("a", "see www.x.gov now"), ("b", None), ("c", "plain")], "document_id string, text string")
    hidden = spark.createDataFrame([("a", "see [AGENCY_URL] now"), ("b", ""), ("c", "other")], "document_id string, masked_text string")
    out = checks.masked_index_checks(plain, hidden)
    assert {n: d.count() for n, d in out.items()} == {"masked_text_differs": 1, "identifier_in_masked_text": 0}
    assert {len(r["was"]) for r in out["masked_text_differs"].collect()} == {64}


def test_training_takes_saved_counts(spark, monkeypatch):
    from docloom.plans import classifier

    saved, of = [], classifier.materialise
    monkeypatch.setattr(classifier, "materialise", lambda df, label: saved.append(df.columns) or of(df, label))
    rows = [(str(i), a, i % 2, f"{a} text {i}") for i in range(12) for a in ("USCIS", "IRS")]
    chunks = spark.createDataFrame([(f"{a}{d}", a, k, t) for d, a, k, t in rows], "document_id string, agency string, chunk_index int, chunk_text string")
    model = classifier.train(chunks, 64, 5)
    assert saved == [["features", "label", "w"]]
    assert {(r.document_id[:-1].rstrip("0123456789"), r.predicted) for r in classifier.predict(model, chunks).collect()} == {("USCIS", "USCIS"), ("IRS", "IRS")}
