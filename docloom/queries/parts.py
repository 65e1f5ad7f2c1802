"""The single steps that other operators are built of, each by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunks as K
from docloom.operators import corpus as C
from docloom.operators import evaluation as E
from docloom.operators import retrieval
from docloom.operators.vocabulary import encoded, has_tokens
from docloom.queries.bind import CORPUS_SQL, SCORES_SQL, Registry, corpus, scores, table
from docloom.queries.corpus import STOP
from docloom.queries.evaluation import KEYED, KEYED_SUMMARY, _f1_sql, _summary
from docloom.queries.scalars import FAMILY_SQL
from docloom.queries.windows import CHUNK_SQL, DIVERSE, OVERLAP, VECTORS, WINDOW, _retrieved, chunked, indexed, nearest, saved_chunks, vectors

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {CORPUS_SQL} "
WITH_FAMILIES = f"WITH {CORPUS_SQL}, {FAMILY_SQL} "
WITH_CHUNKS = f"WITH {CORPUS_SQL}, {CHUNK_SQL} "

_FORMS = {
    "b05_form_numbers_dmv": ("DMV", r"nullif(upper(regexp_extract(lower(filename), '(reg|dl|ol|adm|inf|mc)-?\d+', 0)), '')"),
    "b06_form_numbers_ssa": ("SSA", r"nullif(upper(regexp_extract(lower(filename), 'ssa-\d+[a-z\-]*|ss-\d+[a-z\-]*', 0)), '')"),
    "b07_form_numbers_irs": ("IRS", r"CASE WHEN regexp_matches(lower(filename), '^[fi]') THEN regexp_replace(upper(replace(lower(filename), '.pdf', ''))[2:], '^W(.*)$', 'W-\1') END"),
}
for _name, (_agency, _sql) in _FORMS.items():

    @query(_name, WITH + f"SELECT document_id, {_sql} AS form FROM corpus WHERE agency = '{_agency}'")
    def _form(s: SparkSession, d: str, agency: str = _agency) -> DataFrame:
        return corpus(s, d).where(F.col("agency") == agency).select("document_id", T.form_number(F.lit(agency), F.col("filename")).alias("form"))


@query("b11_normalized_codes", WITH + "SELECT document_id, regexp_replace(upper(form_number), '[^A-Z0-9]', '', 'g') AS code FROM corpus")
def b11(s, d):
    return corpus(s, d).select("document_id", T.normalized_code(F.col("form_number")).alias("code"))


@query("b12_stem_tokens", WITH_FAMILIES + "SELECT document_id, array_to_string(raw, '|') AS tokens FROM t0")
def b12(s, d):
    return corpus(s, d).select("document_id", F.array_join(T.stem_tokens(F.col("filename")), "|").alias("tokens"))


@query("b13_without_noise", WITH_FAMILIES + "SELECT document_id, array_to_string(toks, '|') AS tokens FROM t1")
def b13(s, d):
    return corpus(s, d).select("document_id", F.array_join(T.without_trailing(T.stem_tokens(F.col("filename")), T.NOISE_TOKENS), "|").alias("tokens"))


@query("b14_without_language_endings", WITH_FAMILIES + "SELECT document_id, joined AS code FROM t2")
def b14(s, d):
    tokens = T.without_trailing(T.stem_tokens(F.col("filename")), T.NOISE_TOKENS)
    return corpus(s, d).select("document_id", T.without_language_ending(F.array_join(tokens, "")).alias("code"))


@query("b23_text_sha256", WITH + "SELECT document_id, sha256(coalesce(text, '')) AS digest FROM corpus")
def b23(s, d):
    return corpus(s, d).select("document_id", T.sha256(F.coalesce("text", F.lit(""))).alias("digest"))


@query("b26_token_estimate", WITH + "SELECT document_id, greatest(1, length(text) // 4) AS tokens FROM corpus")
def b26(s, d):
    return corpus(s, d).select("document_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("b27_cost_by_agency", WITH + "SELECT agency, round(sum(length(text)) / 1e6 * 0.10 + 5 * count(*) / 1e6 * 0.40, 9) AS cost FROM corpus GROUP BY 1")
def b27(s, d):
    sums = corpus(s, d).groupBy("agency").agg(F.sum(F.length("text")).alias("p"), (5 * F.count("*")).alias("c"))
    return sums.select("agency", F.round(T.cost(F.col("p"), F.col("c")), 9).alias("cost"))


@query("b29_chunk_ids", WITH_CHUNKS + "SELECT document_id, chunk_index, chunk_id FROM chunks")
def b29(s, d):
    return chunked(s, d, "document_id", "chunk_index", "chunk_id")


@query("b30_selection_hashes", WITH + "SELECT document_id, sha256('v1|' || document_id || '|beginning_middle_end|0,2,4') AS selection_hash FROM corpus")
def b30(s, d):
    five = corpus(s, d).select("document_id", F.lit(5).alias("total_chunks"))
    return K.selections(five).where("condition = 'beginning_middle_end'").select("document_id", "selection_hash")


@query("b33_labelled_context", "SELECT conv_id AS query_id, string_agg((turn + 1) || '. Agency: ' || role || chr(10) || '   Excerpt: ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1")
def b33(s, d):
    from docloom.plans.cases import labelled_context

    return labelled_context(table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("new_place"), F.col("role").alias("agency"), "text"))


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with'))"


@query("b34_clean_words", WITH + f"SELECT document_id, len({_WORDS}) AS n, sha256(array_to_string({_WORDS}, ' ')) AS digest FROM corpus")
def b34(s, d):
    words = T.words_for_counts(F.col("text"), STOP)
    return corpus(s, d).select("document_id", F.size(words).cast("long").alias("n"), T.sha256(F.array_join(words, " ")).alias("digest"))


@query("b41_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS place FROM embeddings")
def b41(s, d):
    return table(s, d, "embeddings").select("vec_id", T.argmax(F.col("embedding")).alias("place"))


@query("c04_split_chunks", WITH_CHUNKS + "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(DISTINCT document_id) AS documents, count(*) AS n FROM chunks GROUP BY 1")
def c04(s, d):
    docs = corpus(s, d).where(has_tokens()).select("document_id", "text", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return K.chunk_split(docs, WINDOW, OVERLAP, columns=["document_id", "split"]).groupBy("split").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("n"))


@query("c11_exploded_words", WITH + f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM corpus) GROUP BY 1")
def c11(s, d):
    return corpus(s, d).select(F.explode(T.words_for_counts(F.col("text"), STOP)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("c13_model_inputs", WITH_CHUNKS + ", x AS (SELECT document_id, ([50256] || ids[1:510] || [50256]) AS whole FROM toks) SELECT document_id, 512::INT AS width, CAST(len(whole) AS INT) AS attended, sha256(array_to_string(whole || list_transform(range(512 - len(whole)), lambda i: 0), ',')) AS ids_sha256 FROM x")
def c13(s, d):
    # the vocabulary has one free id, which stands at both ends
    ids, mask = K.model_inputs(F.slice("ids", 1, 510), 512, 50256, 50256)
    rows = encoded(corpus(s, d).select("document_id", "text"), columns=("ids",), keep_text=False).select("document_id", ids.alias("input_ids"), mask.alias("attention_mask"))
    add = F.aggregate("attention_mask", F.lit(0), lambda x, y: x + y)
    return rows.select("document_id", F.size("input_ids").alias("width"), add.alias("attended"), T.sha256(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("ids_sha256"))


@query("d05_split_with_audit", WITH_FAMILIES + "SELECT u.document_id, u.split, f.family_id FROM (SELECT document_id, 'train' AS split FROM corpus WHERE doc_id % 5 > 1 UNION ALL SELECT document_id, 'validation' FROM corpus WHERE doc_id % 5 = 1 UNION ALL SELECT document_id, 'test' FROM corpus WHERE doc_id % 5 = 0) u LEFT JOIN families f USING (document_id)")
def d05(s, d):
    c = corpus(s, d)
    part = lambda cond, name: c.where(cond).select("document_id", F.lit(name).alias("split"))
    union = part("doc_id % 5 > 1", "train").unionByName(part("doc_id % 5 = 1", "validation")).unionByName(part("doc_id % 5 = 0", "test"))
    return union.join(C.assign_families(c).select("document_id", "family_id"), "document_id", "left")


@query("d07_registry_lookup", WITH_CHUNKS + ", t AS (SELECT document_id, max(chunk_index) AS last FROM chunks GROUP BY 1) SELECT c.document_id, c.chunk_id AS end_chunk_id FROM chunks c JOIN t ON c.document_id = t.document_id AND c.chunk_index = t.last")
def d07(s, d):
    cut = saved_chunks(s, d, "document_id", "chunk_index", "total_chunks", "chunk_id")
    taken = K.selections(cut.where("chunk_index = 0").select("document_id", "total_chunks")).where("condition = 'end_only'")
    return K.resolve(taken, cut, "chunk_id").select("document_id", F.col("source_chunk_ids").alias("end_chunk_id"))


@query("e02_missing_columns", "SELECT unnest(['agency', 'text']) AS required, unnest([false, true]) AS refused")
def e02(s, d):
    c, out = corpus(s, d), []
    for name, df in (("agency", c), ("text", c.drop("text"))):
        try:
            C.require_columns(df, ["document_id", name])
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return s.createDataFrame(out, "required string, refused boolean")


@query("e03_length_statistics", WITH + "SELECT round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median, min(length(text)) AS least, max(length(text)) AS most, round(quantile_cont(length(text), 0.95), 6) AS p95 FROM corpus")
def e03(s, d):
    return C.validation_report(corpus(s, d)).selectExpr("mean_length AS mean", "median_length AS median", "min_length AS least", "max_length AS most", "p95_length AS p95")


@query("f05_reciprocal_rank", f"WITH RECURSIVE {VECTORS}, {DIVERSE} SELECT c.query_id, CAST(min(CASE WHEN k.label = k.query_label THEN c.new_place END) AS INT) AS first_hit, round(coalesce(1.0 / min(CASE WHEN k.label = k.query_label THEN c.new_place END), 0), 6) AS reciprocal FROM chosen c JOIN knn k USING (query_id, chunk_id) GROUP BY 1")
def f05(s, d):
    hit = F.min(F.when(F.col("relevant"), F.col("place")))
    return _retrieved(s, d).groupBy("query_id").agg(hit.alias("first_hit"), F.round(F.coalesce(1.0 / hit, F.lit(0.0)), 6).alias("reciprocal"))


@query("h05_invalid_scores", f"WITH {SCORES_SQL} SELECT document_id, chunk_index, CASE CAST(document_id AS BIGINT) % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'shape' WHEN 2 THEN 'not_finite' ELSE 'not_finite' END AS reason FROM scores WHERE CAST(document_id AS BIGINT) % 7 < 4")
def h05(s, d):
    k = F.col("document_id").cast("long") % 7
    p = F.col("probs")
    bad = F.when(k == 0, F.slice(p, 1, 0)).when(k == 1, F.slice(p, 1, 3)).when(k == 2, F.concat(F.slice(p, 1, 3), F.array(F.lit(float("nan"))))).when(k == 3, F.concat(F.slice(p, 1, 3), F.array(F.lit(float("inf"))))).otherwise(p)
    return E.invalid_scores(scores(s, d).withColumn("probs", bad)).select("document_id", "chunk_index", "reason")


@query("h07_condition_sweep", KEYED_SUMMARY + "SELECT condition, accuracy, macro_f1, errors FROM summary WHERE method = 'bert'")
def h07(s, d):
    return _summary(s, d).where("method = 'bert'").select("condition", "accuracy", "macro_f1", "errors")


@query("h09_weighted_f1", KEYED + f"SELECT split_part(mc, '|', 1) AS method, split_part(mc, '|', 2) AS condition, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM {_f1_sql('keyed', 'mc')} GROUP BY mc")
def h09(s, d):
    return _summary(s, d).select("method", "condition", "weighted_f1")


@query("h29_mean_nll", f"WITH {SCORES_SQL} SELECT agency, round(avg(-ln(greatest(CASE agency WHEN 'USCIS' THEN p0 WHEN 'DMV' THEN p1 WHEN 'SSA' THEN p2 ELSE p3 END, 1e-9))), 6) AS mean_nll FROM scores GROUP BY 1")
def h29(s, d):
    place = F.array_position(F.array(*(F.lit(x) for x in C.LABELS)), F.col("agency")).cast("int")
    return scores(s, d).groupBy("agency").agg(F.round(F.avg(E.log_loss(F.element_at("probs", place))), 6).alias("mean_nll"))


@query("h33_cases_with_context", f"WITH RECURSIVE {VECTORS}, {DIVERSE}, x AS (SELECT query_id, string_agg('[' || new_place || '] chunk ' || chunk_id, chr(10) || chr(10) ORDER BY new_place) AS context FROM chosen GROUP BY 1) SELECT CAST(query_id AS STRING) AS document_id, length(context) AS context_chars, CASE WHEN length(context) % 2 = 0 THEN 'USCIS' ELSE 'IRS' END AS predicted_label, 'success' AS status FROM x")
def h33(s, d):
    """Retrieval, diversified selection, context, prompt, and the answers of a stand-in for a provider."""
    from docloom.plans.cases import case_keys, context_text, run_cases

    chosen = retrieval.diversified(nearest(s, d)).select("query_id", "new_place", F.concat(F.lit("chunk "), "chunk_id").alias("text"))
    shown = context_text(chosen).select(F.col("query_id").cast("string").alias("document_id"), "context")
    registry = shown.withColumns({"condition": F.lit("complete_unmasked"), "text": F.lit(""), "text_fingerprint": T.sha256(F.lit(""))})
    keyed = case_keys(registry, "llm_rag", "stand-in", "{context}", "context")
    provider = lambda prompt: ("USCIS" if len(prompt) % 2 == 0 else "IRS", 0.9, len(prompt), 5)
    return keyed.select("cache_key", "document_id", F.length("context").cast("long").alias("context_chars")).join(run_cases(keyed, provider), "cache_key").select("document_id", "context_chars", "predicted_label", "status")


@query("h35_word_attribution", WITH + f"""SELECT document_id, word, share FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY share DESC, word) AS up, row_number() OVER (PARTITION BY document_id ORDER BY share, word) AS down FROM
(SELECT document_id, word, count(*) * (length(word) - 5.0)::DOUBLE AS share FROM (SELECT document_id, unnest({_WORDS}) AS word FROM corpus) GROUP BY 1, 2, length(word))) WHERE up <= 10 OR down <= 10""")
def h35(s, d):
    from docloom.plans.classifier import word_attribution

    counts = corpus(s, d).select("document_id", F.explode(T.words_for_counts(F.col("text"), STOP)).alias("word")).groupBy("document_id", "word").agg(F.count("*").alias("tf"))
    learnt = counts.select("word").distinct().withColumn("coefficient", F.length("word") - 5.0)
    return word_attribution(counts, learnt).select("document_id", "word", "share")


@query("h37_guidance_prompts", WITH + "SELECT document_id, CASE WHEN agency IN ('USCIS', 'SSA') THEN sha256('For ' || agency || ': ' || text) END AS digest FROM corpus")
def h37(s, d):
    from docloom.plans.cases import guidance_prompts

    made = guidance_prompts(corpus(s, d).select("document_id", "agency", "text"), {a: f"For {a}: {{document}}" for a in ("USCIS", "SSA")})
    return made.select("document_id", T.sha256(F.col("prompt")).alias("digest"))


@query("h38_retrieved_labels", f"WITH {VECTORS}, r AS (SELECT query_id, query_label, label, place, similarity FROM knn WHERE place <= 5) SELECT query_id, max(similarity) AS best_similarity, count(*) FILTER (label = query_label) AS same_label FROM r GROUP BY 1")
def h38(s, d):
    v = vectors(s, d)
    found = indexed(s, d, 5, ["label"])
    of = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return found.join(of, "query_id").groupBy("query_id").agg(F.max("similarity").alias("best_similarity"), F.count_if(F.col("label") == F.col("query_label")).alias("same_label"))
