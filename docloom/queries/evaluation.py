"""Aggregation of scores, metrics, comparisons and uncertainty."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import checks
from docloom.operators import evaluation as E
from docloom.operators.corpus import LABELS
from docloom.queries.bind import CASES_SQL, CORPUS_SQL, METHODS, SCORES_SQL, Registry, cases, corpus, scores, table
from docloom.queries.windows import CHUNK_SQL
from docloom.sources.shared import checkpoint_dir, materialise

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_N = "CASE {0} WHEN 0 THEN 'USCIS' WHEN 1 THEN 'DMV' WHEN 2 THEN 'SSA' ELSE 'IRS' END"


def _first_of(cols: list[str]) -> str:
    best = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} = {best} THEN '{x}'" for c, x in zip(cols, LABELS, strict=True)) + " END"


def _means(p: str) -> str:
    return f"SELECT document_id, {_first_of(['s0', 's1', 's2', 's3'])} AS predicted FROM (SELECT document_id, {', '.join(f'round(avg({p}{i}), 9) AS s{i}' for i in range(4))} FROM scores GROUP BY 1)"


AGGREGATED = {
    "mean_logits": _means("l"),
    "mean_probabilities": _means("p"),
    "majority_vote": f"SELECT document_id, {_N.format('-b.i')} AS predicted FROM (SELECT document_id, greatest({', '.join(f'struct_pack(v := v{i}, s := s{i}, i := {-i})' for i in range(4))}) AS b FROM (SELECT document_id, {', '.join(f'sum(CASE WHEN best = {i} THEN 1 ELSE 0 END) AS v{i}, round(sum(p{i}), 9) AS s{i}' for i in range(4))} FROM (SELECT *, list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1 AS best FROM scores) GROUP BY 1))",
    "max_confidence": f"SELECT document_id, {_N.format('best')} AS predicted FROM (SELECT *, list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1 AS best, row_number() OVER (PARTITION BY document_id ORDER BY greatest(p0, p1, p2, p3) DESC, chunk_index) AS r FROM scores) WHERE r = 1",
}
for _i, _m in enumerate(E.METHODS):

    @query(f"h0{_i + 1}_{_m}", f"WITH {SCORES_SQL} {AGGREGATED[_m]}")
    def _aggregate(s, d, m=_m):
        return E.aggregate_scores(scores(s, d), m)


def _f1_sql(source: str, by: str) -> str:
    """Per-label metrics of (by, true_label, predicted_label)."""
    return f"""(SELECT {by}, label, coalesce(t, 0)::BIGINT AS support, coalesce(tp / nullif(p, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(t, 0), 0)::DOUBLE AS recall, coalesce(2.0 * tp / nullif(p + t, 0), 0)::DOUBLE AS f1 FROM
(SELECT k.*, count(*) FILTER (c.true_label = label) AS t, count(*) FILTER (c.predicted_label = label) AS p, count(*) FILTER (c.true_label = label AND c.predicted_label = label) AS tp FROM (SELECT DISTINCT {by}, unnest(['USCIS', 'DMV', 'SSA', 'IRS']) AS label FROM {source}) k JOIN {source} c USING ({by}) GROUP BY ALL))"""


@query("h06_evaluated_methods", f"WITH {SCORES_SQL}, a AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({AGGREGATED[m]})" for m in E.METHODS) + f"), l AS (SELECT method, CASE CAST(document_id AS BIGINT) % 4 WHEN 0 THEN 'USCIS' WHEN 1 THEN 'DMV' WHEN 2 THEN 'SSA' ELSE 'IRS' END AS true_label, predicted AS predicted_label FROM a) SELECT method, round(avg(f1), 6) AS macro_f1, round(min(f1), 6) AS worst_f1, (SELECT round(avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END), 6) FROM l WHERE l.method = x.method) AS accuracy FROM {_f1_sql('l', 'method')} x GROUP BY method")
def h06(s, d):
    return _evaluated(s, d)


def _evaluated(s, d):
    sc = scores(s, d)
    rows = None
    for m in E.METHODS:
        one = E.aggregate_scores(sc, m).withColumn("method", F.lit(m))
        rows = one if rows is None else rows.unionByName(one)
    truth = corpus(s, d).select("document_id", F.col("agency").alias("true_label"))
    c = rows.withColumnRenamed("predicted", "predicted_label").join(truth, "document_id").withColumns({"status": F.lit("success"), "latency_ms": F.lit(0.0), "total_tokens": F.lit(0), "estimated_cost_usd": F.lit(0.0)})
    return E.summary_metrics(c, ["method"]).select("method", "macro_f1", "worst_f1", "accuracy")


@query("g09_selected_method", f"WITH m AS ({ORACLES['h06_evaluated_methods']}) SELECT * FROM m ORDER BY macro_f1 DESC, accuracy DESC, worst_f1 DESC, (method = 'mean_probabilities') DESC, method LIMIT 1")
def g09(s, d):
    return E.select_method(_evaluated(s, d))


WITH = f"WITH {CASES_SQL} "
KEYED = f"WITH {CASES_SQL}, keyed AS (SELECT *, method || '|' || condition AS mc FROM cases) "


@query("h08_prf_per_label", KEYED + f"SELECT split_part(mc, '|', 1) AS method, split_part(mc, '|', 2) AS condition, label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {_f1_sql('keyed', 'mc')}")
def h08(s, d):
    return E.label_metrics(cases(s, d), ["method", "condition"]).select("method", "condition", "label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("h10_confusion", WITH + "SELECT k.method, k.condition, k.true_label, k.predicted_label, count(c.document_id) AS n FROM (SELECT DISTINCT method, condition, t.x AS true_label, p.x AS predicted_label FROM cases, (SELECT unnest(['USCIS', 'DMV', 'SSA', 'IRS']) AS x) t, (SELECT unnest(['USCIS', 'DMV', 'SSA', 'IRS']) AS x) p) k LEFT JOIN cases c USING (method, condition, true_label, predicted_label) GROUP BY ALL")
def h10(s, d):
    return E.confusion(cases(s, d), ["method", "condition"])


SUMMARY = f"""plain AS (SELECT method, condition, method || '|' || condition AS mc, count(*) AS cases, round(avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (true_label IS DISTINCT FROM predicted_label) AS errors, round(100.0 * avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(latency_ms), 6) AS mean_latency,
round(quantile_cont(latency_ms, 0.5), 6) AS median_latency, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(estimated_cost_usd), 6) AS total_cost FROM cases GROUP BY 1, 2),
summary AS (SELECT plain.* EXCLUDE (mc), macro_f1, weighted_f1, worst_f1 FROM plain JOIN (SELECT mc, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(min(f1), 6) AS worst_f1 FROM {_f1_sql('keyed', 'mc')} GROUP BY mc) USING (mc))"""
KEYED_SUMMARY = f"{KEYED.strip()}, {SUMMARY} "


def _summary(s, d):
    return E.summary_metrics(cases(s, d), ["method", "condition"])


@query("h12_summary_metrics", KEYED_SUMMARY + "SELECT * FROM summary")
def h12(s, d):
    return _summary(s, d)


@query("h17_robustness", KEYED_SUMMARY + "SELECT m.method, m.condition, CASE WHEN abs(m.macro_f1 - b.macro_f1) < 0.00005 THEN 0.0 ELSE round(m.macro_f1 - b.macro_f1, 4) END::DOUBLE AS f1_delta, CASE WHEN abs(m.accuracy - b.accuracy) < 0.00005 THEN 0.0 ELSE round(m.accuracy - b.accuracy, 4) END::DOUBLE AS accuracy_delta, m.errors FROM summary m JOIN summary b ON b.method = m.method AND b.condition = 'complete_unmasked'")
def h17(s, d):
    return E.robustness(_summary(s, d))


@query("h23_method_pivot", KEYED_SUMMARY + "SELECT condition, max(macro_f1) FILTER (method = 'bert') AS bert, max(macro_f1) FILTER (method = 'llm') AS llm, max(macro_f1) FILTER (method = 'llm_rag') AS llm_rag FROM summary GROUP BY 1")
def h23(s, d):
    return _summary(s, d).groupBy("condition").pivot("method", METHODS).agg(F.first("macro_f1"))


@query("g10_best_per_criterion", KEYED_SUMMARY + "SELECT method, arg_max(condition, {'a': accuracy, 'c': condition}) AS best_accuracy, arg_min(condition, {'a': mean_latency, 'c': condition}) AS fastest FROM summary GROUP BY 1")
def g10(s, d):
    return _summary(s, d).groupBy("method").agg(F.max_by("condition", F.struct("accuracy", "condition")).alias("best_accuracy"), F.min_by("condition", F.struct("mean_latency", "condition")).alias("fastest"))


_ALIGNED = "w AS (SELECT condition, document_id, true_label, max(coalesce(predicted_label, '__NO_PREDICTION__')) FILTER (method = 'bert') AS bert, max(coalesce(predicted_label, '__NO_PREDICTION__')) FILTER (method = 'llm') AS llm, max(coalesce(predicted_label, '__NO_PREDICTION__')) FILTER (method = 'llm_rag') AS rag FROM cases GROUP BY 1, 2, 3), o AS (SELECT *, bert = true_label AS b, llm = true_label AS m, rag = true_label AS r FROM w)"


@query("d14_aligned_predictions", f"WITH {CASES_SQL}, {_ALIGNED} SELECT condition, document_id, true_label, bert, llm, rag AS llm_rag FROM w")
def d14(s, d):
    return E.aligned(cases(s, d), METHODS)


@query("h16_paired_comparison", f"WITH {CASES_SQL}, {_ALIGNED} SELECT condition, count(*) AS documents, count(*) FILTER (b AND m AND r) AS all_correct, count(*) FILTER (NOT b AND NOT m AND NOT r) AS all_wrong, count(*) FILTER (NOT b AND m AND r) AS bert_only_wrong, count(*) FILTER (b AND NOT m AND r) AS llm_only_wrong, count(*) FILTER (b AND m AND NOT r) AS rag_only_wrong, count(*) FILTER (NOT m AND r) AS rag_corrects, count(*) FILTER (m AND NOT r) AS rag_breaks, count(*) FILTER (llm = rag) AS identical, round(100.0 * avg(CASE WHEN llm = rag THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM o GROUP BY 1")
def h16(s, d):
    return E.paired_comparison(cases(s, d))


def _pairs(s, d):
    w = E.aligned(cases(s, d), METHODS)
    ok = {m: F.col(m) == F.col("true_label") for m in METHODS}
    return w.groupBy("condition").agg(F.sum((ok["llm"] & ~ok["llm_rag"]).cast("long")).alias("b"), F.sum((~ok["llm"] & ok["llm_rag"]).cast("long")).alias("c"))


@query("h20_mcnemar", f"""WITH {CASES_SQL}, {_ALIGNED}, p AS (SELECT condition, count(*) FILTER (m AND NOT r) AS b, count(*) FILTER (NOT m AND r) AS c FROM o GROUP BY 1)
SELECT condition, b, c, CASE WHEN b + c >= 10 THEN round(b / (b + c), 6) END AS statistic, CASE WHEN b + c >= 10 THEN round(CASE WHEN b = c THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))))) END, 6) END AS p_value FROM p""")
def h20(s, d):
    return E.mcnemar(_pairs(s, d))


@query("h14_error_concentration", WITH + "SELECT method, bucket, count(*) AS n, count(*) FILTER (true_label IS DISTINCT FROM predicted_label) AS errors, round(100.0 * avg(CASE WHEN true_label = predicted_label THEN 0.0 ELSE 1.0 END), 6) AS error_rate FROM (SELECT *, CASE WHEN k <= 1 THEN '1' WHEN k <= 5 THEN '2-5' WHEN k <= 20 THEN '6-20' ELSE '21+' END AS bucket FROM (SELECT *, ceil(n_chars / 1000) AS k FROM cases)) GROUP BY 1, 2")
def h14(s, d):
    wrong = (~F.coalesce(F.col("true_label") == F.col("predicted_label"), F.lit(False))).cast("long")
    return cases(s, d).groupBy("method", T.size_bucket(F.ceil(F.col("n_chars") / 1000)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(wrong).alias("errors"), F.round(100.0 * F.avg(wrong), 6).alias("error_rate"))


@query("h13_misclassified", WITH + "SELECT method, condition, document_id, true_label, coalesce(predicted_label, '__NO_PREDICTION__') AS predicted_label FROM cases WHERE true_label IS DISTINCT FROM predicted_label")
def h13(s, d):
    return cases(s, d).where(~F.col("true_label").eqNullSafe(F.col("predicted_label"))).select("method", "condition", "document_id", "true_label", F.coalesce("predicted_label", F.lit(T.NO_PREDICTION)).alias("predicted_label"))


@query("h15_unsure_errors", WITH + "SELECT method, count(*) AS n FROM cases WHERE true_label IS DISTINCT FROM predicted_label AND confidence < 0.9 GROUP BY 1")
def h15(s, d):
    return cases(s, d).where(~F.col("true_label").eqNullSafe(F.col("predicted_label")) & (F.col("confidence") < 0.9)).groupBy("method").agg(F.count("*").alias("n"))


@query("h11_failures", WITH + "SELECT method, count(*) FILTER (status = 'failed') AS failed, round(100.0 * count(*) FILTER (status = 'success') / count(*), 6) AS coverage FROM cases GROUP BY 1")
def h11(s, d):
    return cases(s, d).groupBy("method").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.round(100.0 * F.count_if(F.col("status") == "success") / F.count("*"), 6).alias("coverage"))


@query("b38_masked_conditions", WITH + "SELECT NOT ends_with(condition, '_unmasked') AS masked, count(*) AS n FROM cases GROUP BY 1")
def b38(s, d):
    return cases(s, d).groupBy((~F.col("condition").endswith("_unmasked")).alias("masked")).agg(F.count("*").alias("n"))


@query("h25_recomputed_agrees", KEYED_SUMMARY + "SELECT method, condition, abs(accuracy - (1.0 - errors / cases)) < 0.000001 AS agrees FROM summary")
def h25(s, d):
    return _summary(s, d).select("method", "condition", checks.agree(F.col("accuracy"), 1.0 - F.col("errors") / F.col("cases"), 1e-6).alias("agrees"))


@query("e24_class_weights", f"WITH {CORPUS_SQL}, c AS (SELECT lang AS label, count(*) AS n FROM corpus GROUP BY 1), r AS (SELECT label, n, CASE WHEN max(n) OVER () / min(n) OVER () < 4.0 THEN 1.0 ELSE sum(n) OVER () / (count(*) OVER () * n) END AS raw FROM c) SELECT label, n, round(raw / avg(raw) OVER (), 6) AS weight FROM r")
def e24(s, d):
    return E.class_weights(corpus(s, d).groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n")))


@query("h27_losses", f"WITH {SCORES_SQL}, p AS (SELECT CASE agency WHEN 'USCIS' THEN p0 WHEN 'DMV' THEN p1 WHEN 'SSA' THEN p2 ELSE p3 END AS p, 1.0 / count(*) OVER (PARTITION BY document_id) AS w FROM scores) SELECT round(avg(-ln(greatest(p, 1e-9))), 6) AS mean_nll, round(sum(-ln(greatest(p, 1e-9)) * w) / sum(w), 6) AS weighted_loss FROM p")
def h27(s, d):
    place = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col("agency")).cast("int")
    return E.negative_log_likelihood(E.chunk_weights(scores(s, d)).select(F.element_at("probs", place).alias("p_true"), "weight"))


@query("g08_best_epoch", "SELECT arg_max(epoch, {'f': f1, 'e': -epoch}) AS epoch FROM (SELECT page_id AS epoch, (page_id * 7 % 13) / 13.0 AS f1 FROM pages)")
def g08(s, d):
    from docloom.plans.classifier import best_epoch

    return best_epoch(table(s, d, "pages").select(F.col("page_id").alias("epoch"), ((F.col("page_id") * 7 % 13) / 13.0).alias("macro_f1")))


def _draws_sql(counts: str, cell: str) -> str:
    """Counted cells with 2,000 weights each, as evaluation.resampled_weight has them."""
    u = lambda key: f"((CAST('0x' || substr(sha256('42:' || draw || ':' || cell || ':' || {key}), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)!r}::DOUBLE)"
    poisson = "[" + ", ".join(f"{x!r}::DOUBLE" for x in E.POISSON_1) + "]"
    single = f"list_sum(list_transform(range(1, n + 1), lambda j: len(list_filter({poisson}, lambda x: x < {u('j')}))))"
    z = f"(sqrt(-2.0 * ln({u(repr('a'))})) * cos(2.0 * {math.pi!r}::DOUBLE * {u(repr('b'))}))"
    rows = f"(SELECT *, {cell} AS cell FROM ({counts}), range(2001) AS r(draw))"
    return f"(SELECT *, CASE WHEN draw = 0 THEN CAST(n AS DOUBLE) WHEN n < {E.WHOLE_CELL} THEN CAST({single} AS DOUBLE) ELSE greatest(0.0, n + sqrt(n) * {z} + ({z} * {z} - 1.0) / 6.0) END AS w FROM {rows})"


def _drawn_metrics_sql(said: str) -> dict[str, str]:
    total = lambda where: f"coalesce(sum(w) FILTER (WHERE {where}), 0.0)"
    f1 = " + ".join(f"coalesce(2.0 * {total(f"true_label = '{x}' AND {said} = '{x}'")} / nullif({total(f"true_label = '{x}'")} + {total(f"{said} = '{x}'")}, 0.0), 0.0)" for x in LABELS)
    return {"macro_f1": f"({f1}) / 4.0", "accuracy": f"coalesce({total(f'true_label = {said}')} / nullif(sum(w), 0.0), 0.0)"}


def _interval_sql(by: str, rows: str) -> str:
    one = lambda m: f"SELECT {by}, '{m}' AS metric, round(max({m}) FILTER (WHERE draw = 0), 9) AS point, round(quantile_cont({m}, 0.025) FILTER (WHERE draw > 0), 9) AS low, round(quantile_cont({m}, 0.975) FILTER (WHERE draw > 0), 9) AS high FROM ({rows}) GROUP BY {by}"
    return " UNION ALL ".join(map(one, E.METRICS))


_PLAIN = f"(SELECT document_id, method, true_label, coalesce(predicted_label, '{T.NO_PREDICTION}') AS said FROM cases WHERE condition = 'complete_unmasked')"
_COUNTS = f"SELECT method, true_label, said, count(*) AS n FROM {_PLAIN} GROUP BY 1, 2, 3"
_PAIR_COUNTS = f"SELECT a.method AS method_a, b.method AS method_b, a.true_label, a.said AS said_a, b.said AS said_b, count(*) AS n FROM {_PLAIN} a JOIN {_PLAIN} b ON a.document_id = b.document_id AND list_position({METHODS!r}, a.method) < list_position({METHODS!r}, b.method) GROUP BY 1, 2, 3, 4, 5"
_DRAWN = f"SELECT method, draw, {', '.join(f'{e} AS {m}' for m, e in _drawn_metrics_sql('said').items())} FROM {_draws_sql(_COUNTS, "concat_ws('|', method, true_label, said)")} GROUP BY 1, 2"
_PAIR_DRAWN = f"SELECT method_a, method_b, draw, {', '.join(f'{e} - {_drawn_metrics_sql("said_b")[m]} AS {m}' for m, e in _drawn_metrics_sql('said_a').items())} FROM {_draws_sql(_PAIR_COUNTS, "concat_ws('|', method_a, method_b, true_label, said_a, said_b)")} GROUP BY 1, 2, 3"


@query("h18_bootstrap", f"WITH {CASES_SQL} {_interval_sql('method', _DRAWN)}")
def h18(s, d):
    return E.bootstrap(cases(s, d).where(F.col("condition") == "complete_unmasked"))


@query("h19_paired_bootstrap", f"WITH {CASES_SQL} {_interval_sql('method_a, method_b', _PAIR_DRAWN)}")
def h19(s, d):
    return E.paired_bootstrap(cases(s, d).where(F.col("condition") == "complete_unmasked"), METHODS)


@query("j20_evaluation_invariants", f"""WITH {CORPUS_SQL} SELECT 'case_repeats' AS "check", (SELECT count(*) FROM corpus WHERE doc_id % 23 = 0 AND doc_id % 31 <> 0) AS violations UNION ALL SELECT 'unknown_document', (SELECT CAST(sum(CASE WHEN doc_id % 23 = 0 THEN 31 ELSE 30 END) AS BIGINT) FROM corpus WHERE doc_id % 29 = 0 AND doc_id % 31 <> 0)
UNION ALL SELECT 'document_not_evaluated', (SELECT count(*) FROM corpus WHERE doc_id % 31 = 0 AND doc_id % 29 <> 0) UNION ALL SELECT 'input_differs', (SELECT count(*) FROM corpus WHERE doc_id % 37 = 0 AND doc_id % 31 <> 0)""")
def j20(s, d):
    """Planted: cases that repeat, unknown and missing documents, and a method that saw another input."""
    c = cases(s, d).where("doc_id % 31 <> 0")
    other = (F.col("doc_id") % 37 == 0) & (F.col("method") == "llm_rag") & (F.col("condition") == "end_only_masked")
    planted = c.unionByName(c.where("doc_id % 23 = 0 AND method = 'llm' AND condition = 'complete_masked'")).withColumn("input_fingerprint", F.when(other, "another").otherwise(F.col("input_fingerprint")))
    return checks.report(checks.evaluation_checks(planted, corpus(s, d).where("doc_id % 29 <> 0").select("document_id")))


_PROMPT = "'Classify the document into one of USCIS, DMV, SSA, IRS.' || chr(10) || chr(10) || 'Document:' || chr(10) || substr(text, 1, 6000)"
_TEMPLATE = "'Classify the document into one of {labels}.' || chr(10) || '{context}' || chr(10) || 'Document:' || chr(10) || '{document}'"


@query("h32_case_results", f"""WITH {CORPUS_SQL}, c AS (SELECT sha256(concat_ws('|', 'llm', 'stand-in', sha256({_TEMPLATE}), document_id, 'complete_unmasked', sha256(text), sha256(''))) AS cache_key, length({_PROMPT}) AS n FROM corpus),
l AS (SELECT *, {_N.format("n % 4")} AS label FROM c) SELECT cache_key, label AS predicted_label, 0.9::DOUBLE AS confidence, 'success' AS status, CAST(NULL AS VARCHAR) AS error_type, 1 AS attempt_count, CAST(n // 4 AS INT) AS prompt_tokens, 5 AS completion_tokens, sha256(label) AS raw_response_hash FROM l""")
def h32(s, d):
    from docloom.plans.cases import case_keys, run_cases

    registry = corpus(s, d).select("document_id", F.lit("complete_unmasked").alias("condition"), "text", T.sha256(F.col("text")).alias("text_fingerprint"))
    provider = lambda prompt: (LABELS[len(prompt) % 4], 0.9, len(prompt) // 4, 5)
    return run_cases(case_keys(registry, "llm", "stand-in"), provider).drop("latency_ms")


@query("h34_embeddings", f"WITH {CORPUS_SQL}" + r""", once AS (SELECT DISTINCT coalesce(text, '') AS text FROM corpus), words AS (SELECT text, unhex(md5(w)) AS h FROM (SELECT text, unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+')) AS w FROM once) WHERE w <> ''),
cells AS (SELECT text, CAST('0x' || substr(hex(h), 1, 2) AS INT) % 64 AS place, sum(CASE WHEN CAST('0x' || substr(hex(h), 9, 2) AS INT) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM words GROUP BY 1, 2),
grid AS (SELECT o.text, o.i, coalesce(c.v, 0.0::DOUBLE) AS v FROM (SELECT text, unnest(range(64)) AS i FROM once) o LEFT JOIN cells c ON c.text = o.text AND c.place = o.i)
SELECT sha256(text) AS text_hash, list(CASE WHEN s > 0 THEN v / sqrt(s) ELSE v END ORDER BY i) AS vector FROM (SELECT *, sum(v * v) OVER (PARTITION BY text) AS s FROM grid) GROUP BY text""")
def h34(s, d):
    from docloom.plans.cases import embed

    return embed(corpus(s, d).select("text"))


@query("b20_detected_languages")
def b20(s, d):
    from docloom.plans import language

    c = corpus(s, d)
    # the fit is bounded: about 20,000 labelled rows, by a threshold of a hash
    sample = c.where(F.pmod(F.xxhash64("document_id"), F.lit(1 << 20)) < (20_000 << 20) // max(1, c.count())).select("text", "lang")
    found = language.detect(c, language.fit(sample))
    return found.join(c.select("document_id", "lang"), "document_id").groupBy("lang", "detected_language").agg(F.count("*").alias("n"))


def agency_of_language():
    """A label that texts tell: languages stand for agencies."""
    return F.element_at(F.create_map(*(F.lit(x) for p in zip(("en", "fr", "de", "es"), LABELS, strict=True) for x in p)), F.col("lang"))


def trained_network(s, d, epochs):
    """(model, chunks with their split): trained on six documents of ten, its epoch chosen on two."""
    from docloom.operators.chunks import chunk
    from docloom.plans import network

    place = F.pmod(F.xxhash64(F.lit(42), "document_id"), F.lit(10))
    split = F.when(place < 6, "train").when(place < 8, "validation").otherwise("test")
    docs = corpus(s, d).select("document_id", "text", agency_of_language().alias("agency"), split.alias("split"))
    cut = materialise(chunk(docs, columns=["document_id", "agency", "split", "chunk_id", "chunk_index", "chunk_ids"]), "chunks")
    plan = network.NetworkPlan(epochs=epochs)
    return network.train(cut.where("split = 'train'"), cut.where("split = 'validation'"), f"{checkpoint_dir(s)}/network-{uuid.uuid4().hex}", plan), cut


@query("h30_trained_classifier")
def h30(s, d):
    """Test documents only; the epochs are told with them."""
    from docloom.plans import network

    model, cut = trained_network(s, d, 6)
    held = cut.where("split = 'test'")
    truth = held.groupBy("document_id").agg(F.first("agency").alias("agency"))
    said = network.predict(model, held).join(truth, "document_id")
    return said.select("document_id", "predicted", (F.col("predicted") == F.col("agency")).alias("right"), F.lit(model.best_epoch).alias("best_epoch"), F.lit(len(model.history)).alias("epochs"))


@query("h31_model_vectors", f"WITH {CORPUS_SQL}, {CHUNK_SQL} SELECT document_id, count(*) AS chunks, CAST(4 * count(*) AS BIGINT) AS scores, CAST(count(*) AS DOUBLE) AS total FROM chunks GROUP BY 1")
def h31_model(s, d):
    """Each document's probabilities of a trained model, of which those of a chunk add up to one."""
    from docloom.plans import network

    model, cut = trained_network(s, d, 1)
    flat = F.flatten("vectors")
    add = F.aggregate(flat, F.lit(0.0), lambda x, y: x + y)
    return network.document_vectors(model, cut).select("document_id", F.size("vectors").cast("long").alias("chunks"), F.size(flat).cast("long").alias("scores"), F.round(add, 6).alias("total"))


@query("h35_gradient_shares")
def h35_gradient(s, d):
    from docloom.plans import network

    model, _ = trained_network(s, d, 1)
    return network.word_shares(model, corpus(s, d).select("document_id", "text"))
