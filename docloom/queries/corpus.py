"""Validation, families, language, duplicates and splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import checks, splitting
from docloom.operators import corpus as C
from docloom.queries.bind import CORPUS_SQL, Registry, corpus, table
from docloom.queries.scalars import FAMILY_SQL, HASHED_SQL

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {CORPUS_SQL} "
STOP = ["the", "and", "for", "with"]


@query("e01_validation_report", WITH + r"""SELECT count(*) AS n_rows, count(document_id) - count(DISTINCT document_id) AS duplicate_ids, CAST(sum(CASE WHEN regexp_replace(coalesce(text, ''), '\s', '', 'g') = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_texts,
count(text) - count(DISTINCT text) AS duplicate_texts, CAST(sum(CASE WHEN agency IN ('USCIS', 'DMV', 'SSA', 'IRS') THEN 0 ELSE 1 END) AS BIGINT) AS invalid_labels, round(avg(length(text)), 6) AS mean_length, round(quantile_cont(length(text), 0.5), 6) AS median_length,
CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length, round(quantile_cont(length(text), 0.95), 6) AS p95_length FROM corpus""")
def e01(s, d):
    return C.validation_report(corpus(s, d))


@query("e04_class_distribution", WITH + "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM corpus GROUP BY lang")
def e04(s, d):
    return C.class_distribution(corpus(s, d), "lang")


@query("e05_null_report", WITH + "SELECT 'form_number' AS column_name, count(*) - count(form_number) AS nulls, round(100.0 * (count(*) - count(form_number)) / count(*), 6) AS percentage FROM corpus UNION ALL SELECT 'text', count(*) - count(text), round(100.0 * (count(*) - count(text)) / count(*), 6) FROM corpus")
def e05(s, d):
    return C.null_report(corpus(s, d).select("form_number", "text"))


@query("e06_describe_by_class", WITH + "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, round(quantile_cont(n_chars, 0.25), 6) AS q1, round(quantile_cont(n_chars, 0.5), 6) AS q2, round(quantile_cont(n_chars, 0.75), 6) AS q3, max(n_chars) AS most FROM corpus GROUP BY lang")
def e06(s, d):
    return C.describe_by(corpus(s, d), "lang", F.col("n_chars"))


@query("e07_agency_summary", WITH + "SELECT agency, count(*) AS documents, count(DISTINCT source) AS sources, round(avg(n_chars), 6) AS mean_length, round(avg(CASE WHEN form_number IS NULL THEN 0.0 ELSE 1.0 END), 6) AS with_number FROM corpus GROUP BY agency")
def e07(s, d):
    return corpus(s, d).groupBy("agency").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.round(F.avg("n_chars"), 6).alias("mean_length"), F.round(F.avg(F.col("form_number").isNotNull().cast("int")), 6).alias("with_number"))


@query("e08_health_check", WITH + "SELECT unnest(['documents', 'empty', 'short', 'long', 'sources', 'languages']) AS metric, unnest([count(*), count(*) FILTER (n_chars = 0), count(*) FILTER (n_chars < 200), count(*) FILTER (n_chars > 10000), count(DISTINCT source), count(DISTINCT lang)]) AS value FROM corpus")
def e08(s, d):
    n = F.col("n_chars")
    return corpus(s, d).agg(F.count("*").alias("documents"), F.count_if(n == 0).alias("empty"), F.count_if(n < 200).alias("short"), F.count_if(n > 10000).alias("long"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("languages")).unpivot([], ["documents", "empty", "short", "long", "sources", "languages"], "metric", "value")


_STATUS = r"""decided AS (SELECT *, CASE WHEN t = '' THEN 'empty_text' WHEN length(t) < 30 THEN 'text_too_short_for_reliable_detection' WHEN coalesce(length(regexp_replace(t, '[^\p{L}]', '', 'g')) / nullif(length(regexp_replace(t, '\s', '', 'g')), 0), 0) < 0.5 THEN 'insufficient_alphabetic_content'
WHEN doc_id % 31 = 0 THEN 'mixed_language_signal_across_document' WHEN doc_id % 20 >= 10 THEN 'detector_high_confidence' ELSE 'low_detection_confidence' END AS reason FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM corpus)),
status AS (SELECT *, CASE WHEN reason <> 'detector_high_confidence' THEN 'uncertain_review' WHEN lang = 'en' THEN 'confidently_english' ELSE 'confidently_non_english' END AS status FROM decided)"""


def _decided(s, d):
    return C.language_decision(corpus(s, d), F.col("lang"), (F.col("doc_id") % 20 + 80) / 100.0, F.col("doc_id") % 31 == 0)


@query("b19_language_decision", f"WITH {CORPUS_SQL}, {_STATUS} SELECT document_id, reason, status FROM status")
def b19(s, d):
    return _decided(s, d).select("document_id", "reason", "status")


@query("e09_status_by_agency", f"WITH {CORPUS_SQL}, {_STATUS} SELECT status, agency, count(*) AS n FROM status GROUP BY 1, 2")
def e09(s, d):
    return _decided(s, d).groupBy("status", "agency").agg(F.count("*").alias("n"))


@query("b16_family_assignment", f"WITH {CORPUS_SQL}, {FAMILY_SQL} SELECT document_id, family_id, evidence_type, CASE WHEN evidence_type = 'filename_code_match' THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence, count(*) OVER (PARTITION BY family_id) AS family_size FROM families")
def b16(s, d):
    return C.assign_families(corpus(s, d)).select("document_id", "family_id", "evidence_type", "confidence", "family_size")


@query("d08_override_overlay", f"""WITH {CORPUS_SQL}, {FAMILY_SQL}, {_STATUS}, o AS (SELECT * FROM (VALUES ('3', 'SSA', NULL, 'include_english_corpus'), ('4', NULL, 'USCIS:I9', 'include_english_corpus'), ('5', NULL, NULL, 'exclude_manual')) AS t(document_id, a, f, e))
SELECT c.document_id, coalesce(o.a, c.agency) AS effective_agency, coalesce(o.f, c.family_id) AS effective_family_id, CASE WHEN o.document_id IS NOT NULL THEN o.e WHEN s.status = 'confidently_non_english' THEN 'exclude_non_english' WHEN s.status = 'uncertain_review' THEN 'hold_for_review' ELSE 'include_english_corpus' END AS final_modeling_eligibility
FROM families c JOIN status s USING (document_id) LEFT JOIN o ON o.document_id = c.document_id""")
def d08(s, d):
    overrides = s.createDataFrame([("3", "SSA", None, "include_english_corpus"), ("4", None, "USCIS:I9", "include_english_corpus"), ("5", None, None, "exclude_manual")], C.OVERRIDES)
    return C.apply_overrides(C.assign_families(_decided(s, d)), overrides).select("document_id", "effective_agency", "effective_family_id", "final_modeling_eligibility")


@query("e11_cross_agency_codes", f"WITH {CORPUS_SQL}, {FAMILY_SQL} SELECT regexp_extract(family_id, '[^:]*$', 0) AS code, count(*) AS n_documents, string_agg(DISTINCT agency, ',' ORDER BY agency) AS agencies FROM families WHERE family_id NOT LIKE 'SINGLETON:%' GROUP BY 1 HAVING count(DISTINCT agency) > 1")
def e11(s, d):
    return C.cross_agency_codes(C.assign_families(corpus(s, d)))


@query("e13_family_languages", WITH + "SELECT effective_family_id, count(DISTINCT lang) AS languages, bool_or(lang = 'en') AND bool_or(lang = 'es') AS english_and_spanish FROM corpus GROUP BY 1")
def e13(s, d):
    return corpus(s, d).groupBy("effective_family_id").agg(F.count_distinct("lang").alias("languages"), (F.bool_or(F.col("lang") == "en") & F.bool_or(F.col("lang") == "es")).alias("english_and_spanish"))


@query("e14_family_kinds", WITH + "SELECT effective_family_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS kinds, list_has_any(list(lang), ['de', 'fr']) AS bundle FROM corpus GROUP BY 1")
def e14(s, d):
    kinds = F.collect_set("lang")
    return corpus(s, d).groupBy("effective_family_id").agg(F.array_join(F.array_sort(kinds), ",").alias("kinds"), F.arrays_overlap(kinds, F.array(F.lit("de"), F.lit("fr"))).alias("bundle"))


@query("e10_family_sizes", WITH + "SELECT size, count(*) AS families FROM (SELECT count(*) AS size FROM corpus GROUP BY effective_family_id) GROUP BY size")
def e10(s, d):
    return corpus(s, d).groupBy("effective_family_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("families"))


@query("f01_family_size", WITH + "SELECT document_id, count(*) OVER (PARTITION BY effective_family_id) AS family_size FROM corpus")
def f01(s, d):
    c = corpus(s, d).select("document_id", "effective_family_id")
    return c.join(c.groupBy("effective_family_id").agg(F.count("*").alias("family_size")), "effective_family_id").select("document_id", "family_size")


@query("f03_first_per_key", WITH + "SELECT source, arg_min(document_id, doc_id) AS first_document FROM corpus GROUP BY source")
def f03(s, d):
    return corpus(s, d).groupBy("source").agg(F.min_by("document_id", "doc_id").alias("first_document"))


@query("f04_percentile_rank", WITH + "SELECT document_id, round(100.0 * (rank() OVER (PARTITION BY lang ORDER BY n_chars) - 1) / count(*) OVER (PARTITION BY lang), 6) AS percentile FROM corpus")
def f04(s, d):
    c = corpus(s, d)
    # ranks from counts of each length, so that no window holds a language's documents
    counts = c.groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    less = F.sum("n").over(W.partitionBy("lang").orderBy("n_chars").rowsBetween(W.unboundedPreceding, -1))
    ranks = counts.withColumns({"less": F.coalesce(less, F.lit(0)), "total": F.sum("n").over(W.partitionBy("lang"))}).select("lang", "n_chars", F.round(100.0 * F.col("less") / F.col("total"), 6).alias("percentile"))
    return c.join(ranks, ["lang", "n_chars"]).select("document_id", "percentile")


@query("d11_exact_duplicates", f"WITH {CORPUS_SQL}, {HASHED_SQL} SELECT min(document_id) OVER w AS a, document_id AS b, 1.0::DOUBLE AS similarity, 'exact_normalized_text' AS method FROM hashed WINDOW w AS (PARTITION BY text_hash) QUALIFY document_id <> min(document_id) OVER w")
def d11(s, d):
    return C.exact_duplicate_pairs(corpus(s, d))


@query("d12_near_duplicates", WITH + r""", once AS (SELECT min(document_id) AS document_id, count(*) AS copies, lower(coalesce(any_value(text), '')) AS t FROM corpus GROUP BY sha256(coalesce(text, ''))),
terms AS (SELECT document_id, term, count(*) AS tf, any_value(copies) AS copies FROM (SELECT document_id, copies, unnest(regexp_extract_all(t, '[\p{L}\p{N}_]{2,}')) AS term FROM once) WHERE term NOT IN ('the', 'and', 'for', 'with') GROUP BY 1, 2),
stats AS (SELECT term, sum(copies) AS df, sum(tf * copies) AS total FROM terms GROUP BY 1 ORDER BY total DESC, term LIMIT 20000), raw AS (SELECT document_id, term, tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1 + df)) + 1) AS w FROM terms JOIN stats USING (term)),
unit AS (SELECT document_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY document_id)) AS w FROM raw)
SELECT x.document_id AS a, y.document_id AS b, round(sum(x.w * y.w), 6) AS similarity FROM unit x JOIN unit y ON x.term = y.term AND x.document_id < y.document_id GROUP BY 1, 2 HAVING sum(x.w * y.w) >= 0.92""")
def d12(s, d):
    return C.near_duplicate_pairs(corpus(s, d), stop=STOP).withColumn("similarity", F.round("similarity", 6))


@query("e28_top_words", WITH + r"""SELECT lang, word, n, place FROM (SELECT lang, word, count(*) AS n, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS INT) AS place FROM (SELECT lang, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+')) AS word FROM corpus) WHERE length(word) > 2 AND word NOT IN ('the', 'and', 'for', 'with') GROUP BY lang, word) WHERE place <= 15""")
def e28(s, d):
    return C.top_words(corpus(s, d), "lang", STOP, 15)


@query("e29_tfidf_terms", WITH + r""", said AS (SELECT document_id, w, i FROM (SELECT document_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT document_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS ws FROM corpus)) WHERE w NOT IN ('the', 'and', 'for', 'with')),
grams AS (SELECT document_id, w AS term FROM said UNION ALL SELECT document_id, term FROM (SELECT document_id, w || ' ' || lead(w) OVER (PARTITION BY document_id ORDER BY i) AS term FROM said) WHERE term IS NOT NULL), terms AS (SELECT document_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
stats AS (SELECT term, count(*) AS df, sum(tf) AS total FROM terms GROUP BY 1 ORDER BY total DESC, term LIMIT 5000), raw AS (SELECT document_id, term, tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1 + df)) + 1) AS w FROM terms JOIN stats USING (term)),
unit AS (SELECT document_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY document_id)) AS w FROM raw), means AS (SELECT lang, term, round(sum(w) / any_value(k), 6) AS score FROM unit JOIN corpus USING (document_id) JOIN (SELECT lang, count(*) AS k FROM corpus GROUP BY 1) USING (lang) GROUP BY 1, 2)
SELECT lang, term, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS INT) AS place FROM means) WHERE place <= 15""")
def e29(s, d):
    return C.tfidf_by_class(corpus(s, d), "lang", stop=STOP)


@query("e32_duplicate_filenames", WITH + "SELECT count(filename) - count(DISTINCT filename) AS duplicates, count(*) FILTER (form_number IS NOT NULL) AS with_number FROM corpus")
def e32(s, d):
    return corpus(s, d).agg((F.count("filename") - F.count_distinct("filename")).alias("duplicates"), F.count_if(F.col("form_number").isNotNull()).alias("with_number"))


SPLIT_SQL = """sizes AS (SELECT effective_agency AS a, effective_family_id AS f, count(*) AS n FROM corpus GROUP BY 1, 2),
ord AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, sha256('42:' || f)) AS i, count(*) OVER (PARTITION BY a) AS k, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS total FROM sizes),
fold(a, i, tr, va, te, split, f, n) AS (SELECT a, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM (SELECT DISTINCT a FROM ord) UNION ALL
SELECT a, i, tr + CASE WHEN s = 'train' THEN n ELSE 0 END, va + CASE WHEN s = 'validation' THEN n ELSE 0 END, te + CASE WHEN s = 'test' THEN n ELSE 0 END, s, f, n FROM (SELECT o.a, o.i, o.f, o.n, p.tr, p.va, p.te,
CASE WHEN o.i = 1 AND o.k >= 2 THEN 'test' WHEN o.i = 2 AND o.k >= 3 THEN 'validation' WHEN o.total * 0.70::DOUBLE - p.tr >= o.total * 0.15::DOUBLE - p.va AND o.total * 0.70::DOUBLE - p.tr >= o.total * 0.15::DOUBLE - p.te THEN 'train' WHEN o.total * 0.15::DOUBLE - p.va >= o.total * 0.15::DOUBLE - p.te THEN 'validation' ELSE 'test' END AS s
FROM fold p JOIN ord o ON o.a = p.a AND o.i = p.i + 1)),
assigned AS (SELECT a AS effective_agency, f AS effective_family_id, n AS doc_count, split FROM fold WHERE i > 0)"""
WITH_SPLIT = f"WITH RECURSIVE {CORPUS_SQL}, {SPLIT_SQL} "


@query("g04_family_split", WITH_SPLIT + "SELECT * FROM assigned")
def g04(s, d):
    return splitting.family_split(corpus(s, d))


@query("e17_split_report", WITH_SPLIT + "SELECT effective_agency, split, coalesce(d, 0)::BIGINT AS documents, coalesce(k, 0)::BIGINT AS families, round(100.0 * coalesce(d, 0) / sum(coalesce(d, 0)) OVER (PARTITION BY effective_agency), 6) AS percentage FROM (SELECT DISTINCT effective_agency FROM assigned) CROSS JOIN (SELECT unnest(['train', 'validation', 'test']) AS split) LEFT JOIN (SELECT effective_agency, split, sum(doc_count) AS d, count(*) AS k FROM assigned GROUP BY 1, 2) USING (effective_agency, split)")
def e17(s, d):
    return splitting.split_report(splitting.family_split(corpus(s, d)))


@query("d03_split_documents", WITH_SPLIT + "SELECT document_id, split FROM corpus JOIN assigned USING (effective_family_id)")
def d03(s, d):
    c = corpus(s, d)
    return splitting.split_documents(c, splitting.family_split(c)).select("document_id", "split")


@query("g02_seeded_order", WITH + "SELECT document_id, sha256('42:' || document_id) AS order_key FROM corpus")
def g02(s, d):
    return corpus(s, d).select("document_id", splitting.seeded_key(F.col("document_id"), 42).alias("order_key"))


_STRAT = "strat AS (SELECT *, CASE WHEN x < 0.64 THEN 'train' WHEN x < 0.80 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, (row_number() OVER (PARTITION BY agency ORDER BY sha256('42:' || document_id), document_id) - 1) / count(*) OVER (PARTITION BY agency) AS x FROM corpus))"


@query("g05_stratified_split", f"WITH {CORPUS_SQL}, {_STRAT} SELECT document_id, split FROM strat")
def g05(s, d):
    return splitting.stratified_split(corpus(s, d), "agency", "document_id").select("document_id", "split")


@query("e19_leaking_families", f"WITH {CORPUS_SQL}, {_STRAT} SELECT effective_family_id, count(*) AS documents, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM strat GROUP BY 1 HAVING count(DISTINCT split) > 1")
def e19(s, d):
    return splitting.leaking_families(splitting.stratified_split(corpus(s, d), "agency", "document_id"))


@query("e18_agencies_missing_by_split", WITH_SPLIT + "SELECT effective_agency, split FROM (SELECT DISTINCT effective_agency FROM assigned) CROSS JOIN (SELECT unnest(['train', 'validation', 'test']) AS split) WHERE (effective_agency, split) NOT IN (SELECT (effective_agency, split) FROM assigned)")
def e18(s, d):
    return splitting.missing_by_split(splitting.family_split(corpus(s, d)))


def fingerprint_sql(columns: list[str], source: str = "corpus") -> str:
    part = lambda i: f"sum(CAST('0x' || substr(r, {i}, 12) AS BIGINT))"
    row = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in columns)
    return f"SELECT sha256(coalesce(string_agg(b || '|' || n || '|' || x || '|' || y, chr(10) ORDER BY b), '')) AS fingerprint FROM (SELECT CAST(CAST('0x' || substr(r, 1, 8) AS BIGINT) % 4096 AS VARCHAR) AS b, count(*) AS n, {part(9)} AS x, {part(21)} AS y FROM (SELECT sha256(concat_ws('|', {row})) AS r FROM {source}) GROUP BY 1)"


@query("e26_fingerprint", WITH + fingerprint_sql(["document_id", "agency", "form_number"]))
def e26(s, d):
    return splitting.fingerprint_at_scale(corpus(s, d), ["document_id", "agency", "form_number"])


@query("e26_fingerprint_of_texts", WITH + fingerprint_sql(["document_id", "text"]))
def e26b(s, d):
    return splitting.fingerprint_at_scale(corpus(s, d), ["document_id", "text"])


@query("g03_longest", WITH + "SELECT document_id, n_chars FROM corpus ORDER BY n_chars DESC, document_id LIMIT 10")
def g03(s, d):
    return corpus(s, d).select("document_id", "n_chars").orderBy(F.desc("n_chars"), "document_id").limit(10)


@query("g01_mixed_sort", WITH + "SELECT source, lang, n, row_number() OVER (ORDER BY n DESC, source, lang) AS place FROM (SELECT source, lang, count(*) AS n FROM corpus GROUP BY ALL)")
def g01(s, d):
    return corpus(s, d).groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "source", "lang")).cast("long"))


@query("g12_seeded_sample", WITH + "SELECT document_id FROM corpus ORDER BY sha256('7:' || document_id) LIMIT 50")
def g12(s, d):
    return corpus(s, d).select("document_id").orderBy(splitting.seeded_key(F.col("document_id"), 7)).limit(50)


@query("g11_latest_ready", "SELECT arg_max(url, page_id) AS name FROM pages WHERE page_id % 3 = 0")
def g11(s, d):
    from docloom.sources.tables import latest_ready

    return latest_ready(table(s, d, "pages").select(F.col("url").alias("name"), F.when(F.col("page_id") % 3 == 0, "ready").otherwise("training").alias("status"), F.col("page_id").alias("ready_at")))


@query("h24_class_pivot", WITH + "SELECT agency, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM corpus GROUP BY agency")
def h24(s, d):
    return corpus(s, d).groupBy("agency").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1))).na.fill(0)


@query("m_histogram", WITH + "SELECT least(CAST(floor(n_chars / 500) AS BIGINT), 39) AS bin, count(*) AS n FROM corpus GROUP BY 1")
def histogram(s, d):
    return corpus(s, d).groupBy(F.least(F.floor(F.col("n_chars") / 500), F.lit(39).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


@query("j01_split_invariants", WITH + """, s AS (SELECT doc_id, effective_family_id AS f, 'own' AS part FROM corpus WHERE doc_id % 17 <> 1 UNION ALL SELECT doc_id, effective_family_id, 'other' FROM corpus WHERE doc_id % 13 = 0), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
SELECT 'document_overlap' AS "check", (SELECT count(*) FROM n WHERE n > 1) AS violations UNION ALL SELECT 'family_overlap', (SELECT count(*) FROM (SELECT f FROM s GROUP BY f HAVING count(DISTINCT part) > 1))
UNION ALL SELECT 'eligible_not_once', (SELECT count(*) FROM corpus LEFT JOIN n USING (doc_id) WHERE doc_id % 19 <> 0 AND coalesce(n, 0) <> 1) UNION ALL SELECT 'excluded_in_split', (SELECT count(*) FROM s WHERE doc_id % 19 = 0)""")
def j01(s, d):
    """Planted: documents that the split lost, that it has twice, and that are not eligible."""
    c = corpus(s, d)
    split = splitting.split_documents(c, splitting.family_split(c)).select("document_id", "doc_id", "effective_family_id", "split")
    planted = split.where("doc_id % 17 <> 1").unionByName(split.where("doc_id % 13 = 0").withColumn("split", F.lit("other")))
    return checks.report(checks.split_checks(c.where("doc_id % 19 <> 0"), planted))


@query("d10_overlap_checks", f"WITH {CORPUS_SQL}, {_STRAT} SELECT a.split AS a, b.split AS b, count(DISTINCT a.effective_family_id) AS shared FROM strat a JOIN strat b ON a.effective_family_id = b.effective_family_id AND a.split < b.split GROUP BY 1, 2")
def d10(s, d):
    c = splitting.stratified_split(corpus(s, d), "agency", "document_id").select("effective_family_id", "split").distinct()
    other = c.select("effective_family_id", F.col("split").alias("b"))
    return c.withColumnRenamed("split", "a").join(other, "effective_family_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("d09_semi_join", WITH + "SELECT document_id FROM corpus WHERE source IN (SELECT source FROM corpus WHERE lang = 'es' GROUP BY source HAVING count(*) > 5)")
def d09(s, d):
    c = corpus(s, d)
    many = c.where("lang = 'es'").groupBy("source").agg(F.count("*").alias("n")).where("n > 5")
    return c.join(many, "source", "left_semi").select("document_id")


@query("d01_language_join", WITH + "SELECT document_id, quality, toxic FROM corpus LEFT JOIN labels USING (doc_id)")
def d01(s, d):
    return corpus(s, d).join(table(s, d, "labels"), "doc_id", "left").select("document_id", "quality", "toxic")
