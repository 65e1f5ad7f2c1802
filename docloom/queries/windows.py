"""Token windows, masking, selections, the registry, and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import checks, retrieval, vector_index
from docloom.operators import chunks as K
from docloom.operators.quantiles import with_percentiles
from docloom.operators.vocabulary import encoded, tokens_sql
from docloom.queries.bind import CORPUS_SQL, MARKED_SQL, Registry, corpus, marked, table
from docloom.sources.shared import checkpoint_dir, materialise

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
WINDOW, OVERLAP = 510, 128
STEP = WINDOW - OVERLAP
WITH = f"WITH {CORPUS_SQL}, {MARKED_SQL} "


def ranges_sql(source: str, total: str) -> str:
    return f"""(SELECT * EXCLUDE (nn), nn AS total_chunks, CASE WHEN chunk_index = nn - 1 AND {total} > {WINDOW} THEN {total} - {WINDOW} ELSE chunk_index * {STEP} END AS token_start, least(CASE WHEN chunk_index = nn - 1 AND {total} > {WINDOW} THEN {total} - {WINDOW} ELSE chunk_index * {STEP} END + {WINDOW}, {total}) AS token_end
FROM (SELECT *, unnest(range(nn)) AS chunk_index FROM (SELECT *, CASE WHEN {total} <= 0 THEN 0 WHEN {total} <= {WINDOW} THEN 1 ELSE 1 + CAST(ceil(({total} - {WINDOW}) / {STEP}) AS BIGINT) END AS nn FROM {source})))"""


def chunk_sql(source: str) -> str:
    return f"""toks AS MATERIALIZED (SELECT c.document_id, doc_id, effective_agency, effective_family_id, text, coalesce(ids, []) AS ids, starts, ends, len(coalesce(ids, [])) AS total FROM {source} c LEFT JOIN ({tokens_sql(source)}) t ON t.document_id = c.document_id),
chunks AS MATERIALIZED (SELECT document_id, doc_id, effective_agency, effective_family_id, CAST(total_chunks AS INT) AS total_chunks, CAST(chunk_index AS INT) AS chunk_index, CAST(token_start AS INT) AS token_start, CAST(token_end AS INT) AS token_end, substring(text, starts[token_start + 1] + 1, ends[token_end] - starts[token_start + 1]) AS chunk_text, sha256('v1|' || document_id || '|' || chunk_index || '|' || token_start || '|' || token_end) AS chunk_id FROM {ranges_sql("toks", "total")})"""


CHUNK_SQL = chunk_sql("corpus")


@query("c01_tokens", f"WITH {CORPUS_SQL}, {CHUNK_SQL} SELECT document_id, total AS n_tokens, array_to_string(ids[1:5], '|') AS first_five, array_to_string(ends[1:5], '|') AS first_ends, coalesce(CAST(list_sum(ids) AS BIGINT), 0) AS id_sum, coalesce(CAST(list_sum(ends) AS BIGINT), 0) AS end_sum FROM toks")
def c01(s, d):
    five = lambda c: F.array_join(F.transform(F.slice(c, 1, 5), lambda x: x.cast("string")), "|")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    rows = encoded(corpus(s, d).select("document_id", "text"), columns=("ids", "ends"), keep_text=False)
    return rows.select("document_id", F.size("ids").cast("long").alias("n_tokens"), five("ids").alias("first_five"), five("ends").alias("first_ends"), add("ids").alias("id_sum"), add("ends").alias("end_sum"))


@query("c02_chunk_ranges", f"WITH {CORPUS_SQL} SELECT document_id, CAST(chunk_index AS INT) AS chunk_index, CAST(token_start AS INT) AS token_start, CAST(token_end AS INT) AS token_end FROM {ranges_sql('corpus', 'n_chars')}")
def c02(s, d):
    return corpus(s, d).select("document_id", F.inline(K.window_ranges(F.col("n_chars").cast("int"), WINDOW, STEP)))


def chunked(s, d, *columns):
    return K.chunk(corpus(s, d).select("document_id", "text", "effective_agency", "effective_family_id"), WINDOW, OVERLAP, columns=list(columns))


def saved_chunks(s, d, *columns):
    """For queries that take chunks more than once: a text is cut once."""
    return materialise(chunked(s, d, *columns), "chunks")


@query("c03_chunk_rows", f"WITH {CORPUS_SQL}, {CHUNK_SQL} SELECT document_id, chunk_index, total_chunks, token_start, token_end, chunk_id, sha256(chunk_text) AS chunk_text_hash FROM chunks")
def c03(s, d):
    return chunked(s, d, "document_id", "chunk_index", "total_chunks", "token_start", "token_end", "chunk_id", "chunk_text_hash")


@query("c05_first_tokens", f"WITH {CORPUS_SQL}, {CHUNK_SQL} SELECT document_id, sha256(array_to_string(ids[1:510], ' ')) AS digest FROM toks")
def c05(s, d):
    return encoded(corpus(s, d).select("document_id", "text"), columns=("ids",), keep_text=False).select("document_id", T.sha256(F.array_join(F.transform(F.slice("ids", 1, 510), lambda x: x.cast("string")), " ")).alias("digest"))


@query("c06_sampled_windows", f"""WITH {CORPUS_SQL}, w AS (SELECT document_id, n_chars AS n, CAST(i AS BIGINT) AS i, greatest(CASE i WHEN 0 THEN 0 WHEN 1 THEN CAST(floor(n_chars / 2) AS BIGINT) - {OVERLAP} ELSE n_chars - {WINDOW} END, 0) AS st FROM corpus, range(3) AS t(i) WHERE n_chars > 0)
SELECT document_id, CAST(st AS INT) AS token_start, CAST(least(st + {WINDOW}, n) AS INT) AS token_end FROM w GROUP BY document_id, st, n""")
def c06(s, d):
    return corpus(s, d).select("document_id", F.inline(K.sampled_windows(F.col("n_chars").cast("int"), WINDOW, OVERLAP, 3)))


SELECTED_SQL = """totals AS (SELECT document_id, max(total_chunks) AS n FROM chunks GROUP BY 1),
sel AS (SELECT document_id, n AS total_chunks, 'beginning_only' AS condition, [0] AS idx, false AS fallback FROM totals UNION ALL SELECT document_id, n, 'middle_only', [n // 2], false FROM totals UNION ALL SELECT document_id, n, 'end_only', [n - 1], false FROM totals
UNION ALL SELECT document_id, n, 'beginning_middle_end', CASE WHEN n = 1 THEN [0] WHEN n = 2 THEN [0, 1] ELSE [0, n // 2, n - 1] END, n < 3 FROM totals)"""


@query("c07_selections", f"WITH {CORPUS_SQL}, {CHUNK_SQL}, {SELECTED_SQL} SELECT document_id, total_chunks, condition, array_to_string(idx, ',') AS picked, fallback, sha256('v1|' || document_id || '|' || condition || '|' || array_to_string(idx, ',')) AS selection_hash FROM sel")
def c07(s, d):
    totals = chunked(s, d, "document_id", "total_chunks").groupBy("document_id").agg(F.max("total_chunks").alias("total_chunks"))
    return K.selections(totals).withColumn("picked", F.array_join(F.transform("selected", lambda i: i.cast("string")), ",")).drop("selected")


@query("e22_fallbacks", f"WITH {CORPUS_SQL}, {CHUNK_SQL}, {SELECTED_SQL} SELECT condition, count(*) AS n, count(*) FILTER (fallback) AS fallbacks FROM sel GROUP BY 1")
def e22(s, d):
    totals = chunked(s, d, "document_id", "total_chunks").groupBy("document_id").agg(F.max("total_chunks").alias("total_chunks"))
    return K.selections(totals).groupBy("condition").agg(F.count("*").alias("n"), F.count_if("fallback").alias("fallbacks"))


def _mask_sql(x: str) -> list[tuple[str, str, str]]:
    """(rule, the text before it, the text after it) for each rule."""
    out = []
    for i, (name, pattern, replacement) in enumerate(K.MASKS):
        before = x if i == 0 else f"x{i - 1}"
        out.append((name, before, f"regexp_replace({before}, '{pattern}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"))
    return out


def masked_sql(source: str, column: str) -> str:
    """Successive subqueries x0, x1, ... with n0, n1, ... the matches."""
    sql = f"(SELECT *, {column} AS x FROM {source})"
    for i, (_, before, after) in enumerate(_mask_sql("x")):
        sql = f"(SELECT *, len(regexp_extract_all({before}, '{K.MASKS[i][1]}')) AS n{i}, {after} AS x{i} FROM {sql})"
    return sql


LAST = f"x{len(K.MASKS) - 1}"


@query("b21_mask_counts", WITH + f"SELECT document_id, {', '.join(f'n{i} AS c{i}' for i in range(len(K.MASKS)))}, sha256({LAST}) AS masked_text_hash FROM {masked_sql('marked', 'text')}")
def b21(s, d):
    rows = K.masked(marked(s, d), "text")
    return rows.select("document_id", *(F.col("rule_match_counts")[n].alias(f"c{i}") for i, (n, _, _) in enumerate(K.MASKS)), "masked_text_hash")


@query("e21_mask_summary", WITH + " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(sum(n{i}) AS BIGINT) AS matches, count(*) FILTER (n{i} > 0) AS documents FROM m" for i, (n, _, _) in enumerate(K.MASKS)).replace("SELECT", f", m AS (SELECT * FROM {masked_sql('marked', 'text')}) SELECT", 1))
def e21(s, d):
    rows = K.masked(marked(s, d), "text").select(F.explode("rule_match_counts").alias("rule", "n"))
    return rows.groupBy("rule").agg(F.sum("n").alias("matches"), F.count_if(F.col("n") > 0).alias("documents"))


@query("b22_masked_chunks", f"WITH {CORPUS_SQL}, {MARKED_SQL}, {chunk_sql('marked')} SELECT chunk_id, n0 + n1 + n2 + n3 + n4 + n5 + n6 AS total_replacements, sha256({LAST}) AS masked_text_hash FROM {masked_sql('chunks', 'chunk_text')}")
def b22(s, d):
    cut = K.chunk(marked(s, d).select("document_id", "text"), WINDOW, OVERLAP, columns=["chunk_id", "chunk_text"])
    return K.masked(cut, "chunk_text").select("chunk_id", "total_replacements", "masked_text_hash")


@query("c09_condition_registry", f"""WITH {CORPUS_SQL}, {MARKED_SQL}, {chunk_sql('marked')}, {SELECTED_SQL}, mc AS (SELECT document_id, chunk_index, chunk_id, chunk_text, {LAST} AS hidden FROM {masked_sql('chunks', 'chunk_text')}),
parts AS (SELECT s.document_id, s.condition, string_agg(mc.chunk_text, chr(10) || chr(10) ORDER BY mc.chunk_index) AS plain, string_agg(mc.hidden, chr(10) || chr(10) ORDER BY mc.chunk_index) AS hidden, string_agg(mc.chunk_id, ',' ORDER BY mc.chunk_index) AS ids FROM (SELECT *, unnest(idx) AS i FROM sel) s JOIN mc ON mc.document_id = s.document_id AND mc.chunk_index = s.i GROUP BY 1, 2),
whole AS (SELECT document_id, text, {LAST} AS hidden FROM {masked_sql('marked', 'text')})
SELECT document_id, 'complete_unmasked' AS condition, false AS masked, sha256(text) AS text_fingerprint, '' AS source_chunk_ids FROM whole UNION ALL SELECT document_id, 'complete_masked', true, sha256(hidden), '' FROM whole
UNION ALL SELECT document_id, condition || '_unmasked', false, sha256(plain), ids FROM parts UNION ALL SELECT document_id, condition || '_masked', true, sha256(hidden), ids FROM parts""")
def c09(s, d):
    m = marked(s, d)
    return K.registry(m.select("document_id", "text"), K.chunk(m.select("document_id", "text"), WINDOW, OVERLAP, ends_only=True, columns=K.REGISTERED)).select("document_id", "condition", "masked", "text_fingerprint", "source_chunk_ids")


@query("e23_registry_counts", f"WITH {CORPUS_SQL} SELECT c AS condition, count(*) AS n FROM corpus, (SELECT unnest([{', '.join(repr(c) for c, _, _ in K.CONDITIONS)}]) AS c) GROUP BY 1")
def e23(s, d):
    m = marked(s, d)
    return K.registry(m.select("document_id", "text"), K.chunk(m.select("document_id", "text"), WINDOW, OVERLAP, ends_only=True, columns=K.REGISTERED)).groupBy("condition").agg(F.count("*").alias("n"))


@query("e20_chunk_distribution", f"WITH {CORPUS_SQL}, {CHUNK_SQL}, t AS (SELECT document_id, effective_agency, count(*) AS n FROM chunks GROUP BY 1, 2) SELECT effective_agency, min(n) AS least, round(quantile_cont(n, 0.5), 6) AS p50, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multiple FROM t GROUP BY 1")
def e20(s, d):
    n = F.col("n")
    # taken by the plain figures and the percentiles: texts are cut once
    counts = materialise(chunked(s, d, "document_id", "effective_agency").groupBy("document_id", "effective_agency").agg(F.count("*").alias("n")), "counts")
    plain = counts.groupBy("effective_agency").agg(F.min(n).alias("least"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("most"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("multiple"))
    return with_percentiles(plain, counts, ["effective_agency"], n, {"p50": 0.5, "p90": 0.9, "p95": 0.95})


@query("j05_chunk_invariants", "SELECT unnest(['chunk_without_parent', 'chunk_split_differs', 'chunk_id_in_splits', 'document_chunks_in_splits', 'family_chunks_in_splits', 'chunk_id_repeats', 'indices_not_contiguous', 'total_chunks_differs', 'empty_chunk', 'document_without_chunk']) AS \"check\", 0::BIGINT AS violations")
def j05(s, d):
    from docloom.operators import splitting

    c = corpus(s, d)
    split = splitting.split_documents(c, splitting.family_split(c)).select("document_id", "text", "effective_agency", "effective_family_id", "split")
    cut = K.chunk(split, WINDOW, OVERLAP, columns=["document_id", "effective_family_id", "split", "chunk_id", "chunk_index", "total_chunks", "chunk_text"])
    return checks.report(checks.chunk_checks(split, checks.slim_chunks(cut)))


@query("j22_selection_invariants", WITH + f", {CHUNK_SQL} SELECT 'index_repeats' AS \"check\", 4 * count(DISTINCT document_id) AS violations FROM chunks WHERE CAST(document_id AS BIGINT) % 9 = 0")
def j22(s, d):
    """Planted: selections that take their chunks twice."""
    some = K.selections(chunked(s, d, "document_id", "total_chunks").groupBy("document_id").agg(F.max("total_chunks").alias("total_chunks")))
    return checks.report(checks.selection_checks(some.withColumn("selected", F.when(F.col("document_id").cast("long") % 9 == 0, F.concat("selected", "selected")).otherwise(F.col("selected")))))


VECTORS = """v AS (SELECT CAST(vec_id AS STRING) AS chunk_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(vec_id // 5 AS STRING) AS parent, CAST(vec_id // 10 AS STRING) AS family, label, CAST(vec_id % 400 AS STRING) AS text_hash FROM embeddings),
knn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, sha256('42:' || chunk_id)) AS INT) AS place FROM (SELECT q.vec_id AS query_id, q.label AS query_label, c.chunk_id, c.parent, c.family, c.label, c.text_hash, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS similarity FROM v q, v c WHERE q.vec_id % 50 = 0)) WHERE place <= 20)"""


def vectors(s, d):
    return table(s, d, "embeddings").selectExpr("cast(vec_id as string) AS chunk_id", "vec_id", "embedding AS vector", "cast(vec_id div 5 as string) AS parent", "cast(vec_id div 10 as string) AS family", "label", "cast(vec_id % 400 as string) AS text_hash")


def nearest(s, d):
    v = vectors(s, d)
    found = retrieval.nearest(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"))
    return found.join(v.select("chunk_id", "parent", "family", "label", "text_hash"), "chunk_id")


def saved_nearest(s, d):
    """For queries that take the neighbours more than once: they are searched once."""
    return materialise(nearest(s, d), "nearest")


@query("d13_knn_top20", f"WITH {VECTORS} SELECT query_id, chunk_id, similarity, place FROM knn")
def d13(s, d):
    return nearest(s, d).select("query_id", "chunk_id", "similarity", "place")


#: Few cells for small tables: each is a file at least.
SMALL_INDEX = vector_index.IndexPlan(centroids=8, rings=4)


def indexed(s, d, k=20, columns=None):
    """The neighbours of d13 through an index on disk."""
    v = vectors(s, d)
    index = vector_index.build(v, f"{checkpoint_dir(s)}/vectors-{uuid.uuid4().hex}", SMALL_INDEX)
    return vector_index.search(index, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), k, columns=columns)


@query("d13_indexed_top20", f"WITH {VECTORS} SELECT query_id, chunk_id, similarity, place, label FROM knn")
def d13_indexed(s, d):
    return indexed(s, d, columns=["label"])


DIVERSE = """fold(query_id, place, parents, families, hashes, chunk_id, taken) AS (SELECT DISTINCT query_id, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), '', false FROM knn UNION ALL
SELECT query_id, place, CASE WHEN ok THEN list_append(parents, parent) ELSE parents END, CASE WHEN ok THEN list_append(families, family) ELSE families END, CASE WHEN ok THEN list_append(hashes, text_hash) ELSE hashes END, chunk_id, ok
FROM (SELECT k.query_id, k.place, f.parents, f.families, f.hashes, k.parent, k.family, k.text_hash, k.chunk_id, len(f.parents) < 5 AND len(list_filter(f.parents, lambda x: x = k.parent)) < 2 AND len(list_filter(f.families, lambda x: x = k.family)) < 2 AND NOT list_contains(f.hashes, k.text_hash) AS ok FROM fold f JOIN knn k ON k.query_id = f.query_id AND k.place = f.place + 1)),
chosen AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INT) AS new_place, place AS old_place FROM fold WHERE taken)"""


@query("g06_diversified_topk", f"WITH RECURSIVE {VECTORS}, {DIVERSE} SELECT * FROM chosen")
def g06(s, d):
    return retrieval.diversified(nearest(s, d))


def _retrieved(s, d):
    pool = saved_nearest(s, d)
    label = vectors(s, d).select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    rows = pool.join(retrieval.diversified(pool).select("query_id", "chunk_id", "new_place"), ["query_id", "chunk_id"]).join(label, "query_id")
    return rows.select(F.when(F.col("query_id") % 100 == 0, "unmasked").otherwise("masked").alias("condition"), "query_id", F.col("new_place").alias("place"), "similarity", (F.col("label") == F.col("query_label")).alias("relevant"), "text_hash")


@query("h21_retrieval_diagnostics", f"""WITH RECURSIVE {VECTORS}, {DIVERSE}, r AS (SELECT CASE WHEN query_id % 100 = 0 THEN 'unmasked' ELSE 'masked' END AS condition, query_id, new_place, similarity, label = query_label AS relevant, text_hash FROM knn JOIN chosen USING (query_id, chunk_id)),
q AS (SELECT condition, query_id, min(CASE WHEN relevant THEN new_place END) AS hit, count(*) AS n, 1.0 - count(DISTINCT text_hash) / count(*) AS rep FROM r GROUP BY 1, 2)
SELECT condition, (SELECT count(*) FROM q WHERE q.condition = r.condition) AS queries, (SELECT round(100.0 * avg(CASE WHEN hit IS NULL THEN 0.0 ELSE 1.0 END), 6) FROM q WHERE q.condition = r.condition) AS hit_rate, (SELECT round(avg(coalesce(1.0 / hit, 0)), 6) FROM q WHERE q.condition = r.condition) AS mrr,
round(avg(similarity), 6) AS mean_similarity, round(stddev_pop(similarity), 4) AS std_similarity, (SELECT round(100.0 * avg(CASE WHEN n < 5 THEN 1.0 ELSE 0.0 END), 6) FROM q WHERE q.condition = r.condition) AS fewer_than_k, (SELECT round(avg(rep), 6) FROM q WHERE q.condition = r.condition) AS mean_repeats FROM r GROUP BY condition""")
def h21(s, d):
    return retrieval.diagnostics(_retrieved(s, d))


@query("h22_diversification_effect", f"""WITH RECURSIVE {VECTORS}, {DIVERSE}, b AS (SELECT query_id, family FROM knn WHERE place <= 5), a AS (SELECT query_id, family FROM knn JOIN chosen USING (query_id, chunk_id)),
s AS (SELECT 'before' AS stage, query_id, max(n) / sum(n) AS share FROM (SELECT query_id, family, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 2 UNION ALL SELECT 'after', query_id, max(n) / sum(n) FROM (SELECT query_id, family, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY 2) SELECT stage, round(avg(share), 6) AS top_family_share FROM s GROUP BY 1""")
def h22(s, d):
    pool = saved_nearest(s, d)
    after = pool.join(retrieval.diversified(pool).select("query_id", "chunk_id"), ["query_id", "chunk_id"])
    both = pool.where("place <= 5").withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))
    share = both.groupBy("stage", "query_id", "family").agg(F.count("*").alias("n")).groupBy("stage", "query_id").agg((F.max("n") / F.sum("n")).alias("share"))
    return share.groupBy("stage").agg(F.round(F.avg("share"), 6).alias("top_family_share"))


@query("c12_retrieved_explode", f"WITH RECURSIVE {VECTORS}, {DIVERSE} SELECT query_id, unnest(list(chunk_id)) AS chunk_id FROM chosen GROUP BY query_id")
def c12(s, d):
    listed = retrieval.diversified(nearest(s, d)).groupBy("query_id").agg(F.collect_list("chunk_id").alias("retrieved"))
    return listed.select("query_id", F.explode("retrieved").alias("chunk_id"))


@query("d15_chunk_parents", f"WITH {CORPUS_SQL}, {CHUNK_SQL} SELECT effective_family_id, count(DISTINCT document_id) AS parents, count(*) AS n FROM chunks GROUP BY 1")
def d15(s, d):
    return chunked(s, d, "document_id", "effective_family_id").groupBy("effective_family_id").agg(F.count_distinct("document_id").alias("parents"), F.count("*").alias("n"))


@query("f02_chunk_weights", f"WITH {CORPUS_SQL}, {CHUNK_SQL} SELECT chunk_id, 1.0 / count(*) OVER (PARTITION BY document_id) AS weight FROM chunks")
def f02(s, d):
    from docloom.operators import evaluation

    return evaluation.chunk_weights(saved_chunks(s, d, "document_id", "chunk_id")).select("chunk_id", "weight")


@query("e25_balancing_report", f"WITH {CORPUS_SQL}, {CHUNK_SQL}, t AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) SELECT document_id, n, round(n / sum(n) OVER (), 9) AS raw_share, round(1.0 / count(*) OVER (), 9) AS weighted_share FROM t ORDER BY n DESC, document_id LIMIT 10")
def e25(s, d):
    t = materialise(chunked(s, d, "document_id").groupBy("document_id").agg(F.count("*").alias("n")), "counts")
    sums = t.agg(F.sum("n").alias("total"), F.count("*").alias("documents"))
    total, documents = sums.select("total").scalar(), sums.select("documents").scalar()
    return t.orderBy(F.desc("n"), "document_id").limit(10).select("document_id", "n", F.round(F.col("n") / total, 9).alias("raw_share"), F.round(1.0 / documents, 9).alias("weighted_share"))


@query("j21_weight_invariant", WITH + f", {CHUNK_SQL} SELECT 'weights_do_not_sum_to_one' AS \"check\", count(DISTINCT document_id) AS violations FROM chunks WHERE total_chunks > 1 AND CAST(document_id AS BIGINT) % 7 = 0")
def j21(s, d):
    """Planted: documents that lost their first chunk after they were weighted."""
    from docloom.operators import evaluation

    lost = (F.col("document_id").cast("long") % 7 == 0) & (F.col("total_chunks") > 1) & (F.col("chunk_index") == 0)
    return checks.report(checks.weight_checks(evaluation.chunk_weights(saved_chunks(s, d, "document_id", "total_chunks", "chunk_index")).where(~lost)))
