"""Caches with several writers, and manifests that follow from each other."""

import threading

import pytest
from pyspark.sql import functions as F

from docloom.sources import cache, manifests


def test_writers_at_once_leave_each_key_once(spark, tmp_path):
    base, schema = str(tmp_path / "cache"), spark.createDataFrame([], "cache_key string, v long").schema
    assert cache.cached(spark, base, schema).count() == 0 and cache.missing(spark.createDataFrame([("a", 1)], schema), base, schema).count() == 1
    numbers = []

    def write(writer):
        rows = spark.createDataFrame([(f"k{i}", writer) for i in range(20)] + [(None, 9)], schema)
        numbers.append(cache.commit(rows, base))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == [0, 1, 2, 3]
    got = cache.cached(spark, base, schema).collect()
    assert sorted(r.cache_key for r in got) == sorted(f"k{i}" for i in range(20)) and {r.part for r in got} == {0} and len({r.v for r in got}) == 1
    (tmp_path / "cache" / "_half").mkdir()  # a writer that died
    assert cache.commit(spark.createDataFrame([], schema), base) is None
    assert cache.commit(spark.createDataFrame([("new", 7), ("new", 5), ("k1", 8)], schema), base) == 4
    got = {r.cache_key: (r.v, r.part) for r in cache.cached(spark, base, schema).collect()}
    assert got["new"] == (5, 4) and got["k1"][1] == 0 and len(got) == 21
    assert [r.cache_key for r in cache.missing(spark.createDataFrame([("k3", 1), ("other", 1)], schema), base, schema).collect()] == ["other"]


def test_stale_manifests_are_found(spark, tmp_path):
    base = str(tmp_path / "m")
    build = lambda name, payload, sources=None: manifests.build(spark, base, name, payload, sources)
    assert manifests.stale(spark, base).count() == 0
    with pytest.raises(ValueError, match="no manifest"):
        build("split", {}, ["language"])
    with pytest.raises(ValueError, match="itself"):
        build("split", {}, ["split"])
    first = build("language", {"b": 1, "a": 2})
    assert build("language", {"a": 2, "b": 1}) == first  # the same again changes nothing
    build("split", {"n": 3}, ["language"])
    build("chunks", {"n": 9}, ["split"])
    manifests.freeze(spark, base)
    assert manifests.stale(spark, base).count() == 0
    build("language", {"a": 3})
    got = {(r.name, r.source, r.reason) for r in manifests.stale(spark, base).collect()}
    assert got == {("split", "language", "changed"), ("freeze", "language", "changed"), ("chunks", "split", "follows"), ("freeze", "split", "follows"), ("freeze", "chunks", "follows")}
    with pytest.raises(ValueError, match="stale"):
        manifests.freeze(spark, base)
    build("split", {"n": 3}, ["language"])
    got = {(r.name, r.reason) for r in manifests.stale(spark, base).collect()}
    assert ("chunks", "changed") in got and ("split", "changed") not in got
    build("chunks", {"n": 9}, ["split"])
    manifests.freeze(spark, base)
    assert manifests.stale(spark, base).count() == 0


def test_payloads(spark):
    rows = [("1", "A", 0.2, "english", "F1", False), ("2", "B", None, None, "F1", False), ("3", "B", 0.9, "english", "F2", False), ("4", "B", 0.1, "uncertain_review", None, True)]
    audit = spark.createDataFrame(rows, "document_id string, effective_agency string, family_confidence double, final_language_status string, effective_family_id string, overridden boolean")
    assert manifests.language_manifest(audit) == {"by_status": {"english": 2, "none": 1, "uncertain_review": 1}, "by_status_and_agency": {"english|A": 1, "none|B": 1, "english|B": 1, "uncertain_review|B": 1}}
    assert [r.document_id for r in manifests.override_proposals(audit, 0.5).collect()] == ["2", "1"]
    flags = {r.document_id: r.flags for r in manifests.review_flags(audit, 0.5).select("document_id", F.col("flags")).collect()}
    assert flags == {"1": ["uncertain_family", "shared_family"], "2": ["uncertain_family", "unclear_language", "shared_family"], "4": ["uncertain_family", "unclear_language"]}
