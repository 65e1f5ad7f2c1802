"""Searches through an index against a search through all vectors."""

import hashlib
import re

import numpy as np
import pytest

from docloom.operators import vector_index as X

PLAN = X.IndexPlan(centroids=12, sample=200)


@pytest.fixture(scope="module")
def rows():
    """Groups of unlike size, copies, vectors between groups, zero vectors."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 24))
    x = np.concatenate([centres[i] + 0.15 * rng.normal(size=(20 + 40 * i, 24)) for i in range(8)] + [rng.normal(size=(60, 24)), np.zeros((3, 24))])
    x[5:15] = x[5]
    return [(f"v{i}", v, int(i % 7)) for i, v in enumerate(x.tolist())]


def plain(rows, queries, k):
    out = {}
    unit = lambda v: np.asarray(v) / max(np.linalg.norm(v), 1e-300)
    for q, v in queries:
        scored = [(-(round(float(unit(v) @ unit(x)), 6) + 0.0), hashlib.sha256(f"42:{i}".encode()).hexdigest(), i, label) for i, x, label in rows]
        out[q] = [(i, -s, label) for s, _, i, label in sorted(scored)[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r.place):
        out.setdefault(r.query_id, []).append((r.chunk_id, r.similarity, r.label))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "chunk_id string, vector array<double>, label int, text string").repartition(3)


@pytest.mark.parametrize("k", [1, 5, 60])
def test_search_is_exact_and_reads_some_cells_only(spark, tmp_path, rows, k):
    index = X.build(frame(spark, rows), str(tmp_path), PLAN)
    queries = [(i, v) for i, v, _ in rows[::29]] + [("zero", [0.0] * 24)]
    got = found(X.search(index, spark.createDataFrame(queries, "query_id string, vector array<double>"), k, columns=["label"]))
    assert got == plain(rows, queries, k)
    index = X.load(spark, str(tmp_path))
    one = X.search(index, spark.createDataFrame(queries[:1], "query_id string, vector array<double>"), k, columns=["label"])
    assert found(one) == plain(rows, queries[:1], k)
    if k < 60:
        assert len(index.visited) == 1 and len(index.visited[0]) < len(index.counts) / 2
        # cells are folders: what is not visited is not read
        spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
        plan = index.table.where(f"cell in ({','.join(map(str, index.visited[0]))})")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (IN|=)", plan)


def test_queries_in_blocks(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_BYTES", 8 * (24 + 4) * 5)
    index = X.build(frame(spark, rows), str(tmp_path), X.IndexPlan(centroids=1, rings=3, sample=5))
    queries = [(i, v) for i, v, _ in rows[::60]]
    got = found(X.search(index, spark.createDataFrame(queries, "query_id string, vector array<double>"), 3, columns=["label"]))
    assert got == plain(rows, queries, 3) and len(index.visited) > 1


def test_probes_trade_recall(spark, tmp_path, rows):
    index = X.build(frame(spark, rows), str(tmp_path), PLAN)
    queries = [(i, v) for i, v, _ in rows[:-3:11]]
    exact, few = plain(rows, queries, 5), found(X.search(index, spark.createDataFrame(queries, "query_id string, vector array<double>"), 5, columns=["label"], probes=8))
    hits = sum(len({x[0] for x in exact[q]} & {x[0] for x in few[q]}) for q in exact)
    assert hits >= 0.9 * sum(map(len, exact.values()))


def test_newest_complete_version(spark, tmp_path, rows):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError, match="no index"):
        X.load(spark, path)
    X.build(frame(spark, rows), path, PLAN)
    X.build(frame(spark, rows[:50]), path, PLAN)
    assert len(X.versions(spark, path)) == 1 and X.load(spark, path).table.count() == 50
    (tmp_path / "index" / "v99999999999999999999-broken" / "vectors").mkdir(parents=True)  # not complete
    assert X.report(X.load(spark, path)).first() == (50, 50, 24, 24)
    odd = [("a", None, 1), ("b", [float("nan")] * 24, 1), ("c", [1.0], 1)]
    index = X.build(frame(spark, odd + rows[:2]), path, PLAN)
    assert sorted(r.chunk_id for r in index.table.collect()) in (["v0", "v1"], ["c"])  # the first width counts
    for none in (rows[:0], odd[:1]):
        index = X.build(frame(spark, none), path, PLAN)
        assert X.search(index, spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")).count() == 0
    assert "text" not in index.table.columns
