"""Cases that an operator's own definition covers and its shortcuts once left out."""

import math
import os
import random
import re
import string

import duckdb
import numpy as np

from docloom.llm import credentials, decontaminate, fertility, suffix_dedup


def test_quality_bands_tell_junk_from_prose(spark):
    """Labelled junk that the surface rules keep falls outside the bands of its language; clean documents stay inside, with or without a lang column."""
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for frame in (docs, docs.drop("lang")):
        rows = [r for r in fertility.quality(frame).collect() if not r.base_failed]
        junk = [r.kept for r in rows if labels.get(r.doc_id) == 0]
        clean = [r.kept for r in rows if labels.get(r.doc_id) == 1]
        assert len(junk) > 20 and len(clean) > 200
        assert sum(junk) <= 0.05 * len(junk) and sum(clean) >= 0.98 * len(clean)


def test_derived_band_holds_what_it_was_derived_from():
    rng = np.random.default_rng(3)
    n = rng.integers(50, 9000, 2000).astype(float)
    per_token, entropy = 2.6 + rng.normal(size=2000) / np.sqrt(n), 0.65 - 0.05 * np.log2(n / 1024) + 0.01 * rng.normal(size=2000)
    band = fertility.derive_band(n, per_token, np.full(2000, 0.01), entropy)
    inside = [band.fits(*x) for x in zip(n, per_token, np.full(2000, 0.01), entropy, strict=True)]
    assert sum(inside) >= 0.995 * 2000
    assert not band.fits(1024, 2.6, 0.01, 0.55) and not band.fits(1024, 2.3, 0.01, 0.65) and not band.fits(1024, 2.6, 0.02, 0.65)


def brute_alignments(docs, items, window, share):
    """Every document and item at every offset, without seeds."""
    said = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    found = set()
    for d, t in docs:
        w = said(t)
        for i, b in items:
            v = said(b)
            n = min(window, len(v))
            for shift in range(-len(v) + 1, len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == v[k] for k in range(len(v))]
                if max(sum(same[k : k + n]) for k in range(len(v) - n + 1)) >= math.ceil(n * share):
                    found.add((d, i))
                    break
    return found


def test_masks_miss_no_pattern():
    seeds = decontaminate.Seeds()
    assert all(decontaminate.missed_patterns(seeds, n) == [] for n in range(1, 40))


def test_overlaps_at_every_alignment(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(n, draw(n)) for n in (2, 3, 4, 5, 7, 9, 10, 11, 13, 14, 15, 15, 15, 16, 18, 30)]
    items = [(k, v) for k, (_, v) in enumerate(items)]
    docs = [(1000, items[6][1][:]), (1001, ["w0"]), (1002, draw(300)), (1003, ["x", *items[13][1][2:-1]])]
    for k, v in items:
        for copy in range(6):
            piece = list(v[: rng.randint(16, 18)])
            for at in rng.sample(range(len(piece)), min(len(piece), rng.randint(0, 4))):
                piece[at] = f"y{at}"
            docs.append((10 * k + copy, draw(rng.choice([0, 3, 40])) + piece + draw(rng.choice([0, 25]))))
    lost = [0, 11, 12]
    docs.append((1004, [f"z{j}" if j in lost else w for j, w in enumerate(items[13][1])]))
    docs, items = ([(d, " ".join(w)) for d, w in x] for x in (docs, items))
    want = brute_alignments(docs, items, 16, 0.8)
    frame, table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame, table).collect()} == want
    assert {(1000, 6), (1003, 13), (1004, 13)} <= want
    assert decontaminate.overlaps(frame, table.where("length(text) > 60")).count() == len({x for x in want if len(items[x[1]][1]) > 60})
    assert decontaminate.overlaps(frame, spark.createDataFrame([(1, "W0")], "item_id long, text string")).count() == sum("w0" in t.split() for _, t in docs)


def test_common_prefixes_after_a_prefix_of_zero():
    """Copies that differ in one byte whose groups are neighbours: the chain runs past a common prefix of 0."""
    rng = random.Random(4)
    draw = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    for size in (20, 60, 150):
        p, s = draw(size), draw(119)
        text = p + b"1" + s + p + b"2" + s
        raw = np.frombuffer(text + b"\0" * 16, dtype=np.uint8)
        order, _ = suffix_dedup.suffix_array(raw, 100)
        got = suffix_dedup.common_prefixes(raw, order, 100)
        for k in range(1, len(text)):
            a, b = text[order[k] :][:100], text[order[k - 1] :][:100]
            assert got[k] == len(os.path.commonprefix([a, b])) or len(a) < 100 or len(b) < 100
        assert sum(got >= 100) >= 20


def test_random_strings_of_one_case_and_within_paths():
    rng, rules, vocabulary = random.Random(2), credentials.SecretRules(), credentials.load_tiktoken("byte_bpe_50k.tiktoken")
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    spans = lambda t: credentials.random_spans(t, credentials.base_spans(t, rules), rules, vocabulary)
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    assert sum(spans(f"of {draw(upper, 24)} and") == [(3, 3, 27)] for _ in range(200)) >= 190
    assert sum(spans(f"of {draw(lower, 24)} and") == [(3, 3, 27)] for _ in range(200)) >= 150
    path = "/hooks/services/incoming/production/"
    keys = [draw(string.ascii_letters + string.digits, 20) for _ in range(200)]
    assert sum(any(a <= len(path) and b >= len(path) + 20 for a, _, b in spans(path + k)) for k in keys) >= 190
    for clean in (path + "index", "550e8400-e29b-41d4-a716-446655440000", "internationalization-and-localization", "sha256-" + keys[0] * 2, "2020-01-02_2021-03-04/2022"):
        assert spans(clean) == []


def test_near_copies_make_no_pairs_in_the_prefix_join(spark):
    """Texts near to one text but not to each other: no pair leaves the join that the parities of the sets exclude."""
    import random

    from docloom.llm import simhash

    r = random.Random(3)
    base = [r.randrange(-(1 << 31), 1 << 31) for _ in range(60)]
    bags = [[*base[:40], *(r.randrange(-(1 << 31), 1 << 31) for _ in range(20))] for _ in range(40)]
    bags += [[*bags[0][:58], 1, 2], [*bags[1][:59], 3]]
    found = spark.createDataFrame([(i, i, b) for i, b in enumerate(bags)], "key long, same long, bag array<int>")
    members = found.selectExpr("key", "0 band", "0L bucket")
    groups = spark.createDataFrame([], "node long, component long")
    asked = []
    plain, simhash.verified = simhash.verified, lambda f, pairs, p: asked.append(pairs.count()) or plain(f, pairs, p)
    try:
        got = {(x.a, x.b) for x in simhash.similar_in_buckets(found, members, groups, simhash.Similarity()).collect()}
    finally:
        simhash.verified = plain
    assert got == {(0, 40), (1, 41)} and asked[0] < 50
