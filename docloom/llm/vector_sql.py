"""DuckDB SQL for the queries on vectors: rounds are written out one after the other, in integer arithmetic."""

from __future__ import annotations


def _kept(scale: int, width: int) -> str:
    """Rows with a whole vector, as integers."""
    finite = "len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"
    return f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {scale}) AS BIGINT)) AS x, row_number() OVER () AS r FROM embeddings WHERE len(embedding) = {width} AND {finite})"


def _distance(a: str, b: str, width: int) -> str:
    return f"list_sum(list_transform(range(1, {width + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _floored_mean(total: str, n: str) -> str:
    return f"CAST(({total} - (({total} % {n}) + {n}) % {n}) // {n} AS BIGINT)"


def codes(scale: int = 4096, width: int = 64, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    size = width // parts
    steps = [_kept(scale, width), f"part AS MATERIALIZED (SELECT r, k, x[k * {size} + 1:(k + 1) * {size}] AS y FROM kept, range({parts}) AS t(k))"]
    steps.append(f"book0 AS MATERIALIZED (SELECT k, e, x[k * {size} + 1:(k + 1) * {size}] AS c FROM (SELECT x, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM kept WHERE vec_id IS NOT NULL) s, range({parts}) AS t(k) WHERE e < {entries})")
    for n in range(rounds + 1):
        steps.append(f"near{n} AS MATERIALIZED (SELECT r, k, any_value(y) AS y, min(struct_pack(d := d, e := e)) AS best FROM (SELECT r, k, y, e, {_distance('y', 'c', size)} AS d FROM part JOIN book{n} USING (k)) GROUP BY r, k)")
        if n < rounds:
            steps.append(f"sums{n} AS (SELECT k, e, i, sum(v) AS s, count(*) AS n FROM (SELECT k, best.e AS e, unnest(range(1, {size + 1})) AS i, unnest(y) AS v FROM near{n}) GROUP BY k, e, i)")
            steps.append(f"mean{n} AS (SELECT k, e, list({_floored_mean('s', 'n')} ORDER BY i) AS m FROM sums{n} GROUP BY k, e)")
            steps.append(f"book{n + 1} AS MATERIALIZED (SELECT k, e, coalesce(m, c) AS c FROM book{n} LEFT JOIN mean{n} USING (k, e))")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM book{rounds})")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY k) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), digest"


def clusters(scale: int = 256, width: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    steps = [_kept(scale, width), f"cen0 AS MATERIALIZED (SELECT x AS c, e FROM (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS e FROM kept WHERE vec_id IS NOT NULL) WHERE e < {k})"]
    for n in range(rounds + 1):
        steps.append(f"near{n} AS MATERIALIZED (SELECT r, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (SELECT r, x, e, {_distance('x', 'c', width)} AS d FROM kept, cen{n}) GROUP BY r)")
        if n < rounds:
            steps.append(f"sums{n} AS (SELECT e, i, sum(v) AS s, count(*) AS n FROM (SELECT best.e AS e, unnest(range(1, {width + 1})) AS i, unnest(x) AS v FROM near{n}) GROUP BY e, i)")
            steps.append(f"cen{n + 1} AS MATERIALIZED (SELECT e, coalesce(m, c) AS c FROM cen{n} LEFT JOIN (SELECT e, list({_floored_mean('s', 'n')} ORDER BY i) AS m FROM sums{n} GROUP BY e) USING (e))")
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(best.e AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.e) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM near{rounds} JOIN kept USING (r) JOIN cen{rounds} ON e = best.e"
