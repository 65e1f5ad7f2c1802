"""Lineage joins, audits and reports that put other operators' results together."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunks as K
from docloom.operators import corpus as C
from docloom.operators import evaluation as E
from docloom.operators import retrieval
from docloom.queries.bind import CASES_SQL, CORPUS_SQL, Registry, cases, corpus
from docloom.queries.corpus import fingerprint_sql
from docloom.queries.corpus import _STATUS, _decided
from docloom.queries.scalars import FAMILY_SQL
from docloom.queries.windows import CHUNK_SQL, DIVERSE, OVERLAP, SELECTED_SQL, VECTORS, WINDOW, chunked, nearest, saved_chunks, saved_nearest, vectors
from docloom.sources.shared import materialise

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {CORPUS_SQL} "


@query("c08_resolved_selections", f"WITH {CORPUS_SQL}, {CHUNK_SQL}, {SELECTED_SQL} SELECT s.document_id, s.condition, sha256(string_agg(c.chunk_text, chr(10) || chr(10) ORDER BY c.chunk_index)) AS digest, string_agg(c.chunk_id, ',' ORDER BY c.chunk_index) AS source_chunk_ids FROM (SELECT *, unnest(idx) AS i FROM sel) s JOIN chunks c ON c.document_id = s.document_id AND c.chunk_index = s.i GROUP BY 1, 2")
def c08(s, d):
    docs = corpus(s, d).select("document_id", "text")
    cut = materialise(K.chunk(docs, WINDOW, OVERLAP, ends_only=True, columns=K.REGISTERED), "chunks")
    taken = K.selections(cut.where("chunk_index = 0").select("document_id", "total_chunks"))
    return K.resolve(taken, cut, "chunk_text").select("document_id", "condition", T.sha256(F.col("text")).alias("digest"), "source_chunk_ids")


@query("c10_condition_definitions", "SELECT unnest(['complete', 'beginning', 'middle', 'end', 'beginning_middle_end']) AS region, 2::BIGINT AS conditions")
def c10(s, d):
    return s.createDataFrame(K.CONDITIONS, "condition string, region string, masked boolean").groupBy("region").agg(F.count("*").alias("conditions"))


@query("d02_text_lookup", WITH + "SELECT e.document_id, sha256(c.text) AS digest FROM (SELECT document_id FROM corpus WHERE lang = 'en') e LEFT JOIN corpus c USING (document_id)")
def d02(s, d):
    c = corpus(s, d)
    return c.where("lang = 'en'").select("document_id").join(c.select("document_id", "text"), "document_id", "left").select("document_id", T.sha256(F.col("text")).alias("digest"))


@query("d04_chunk_lineage", f"WITH {CORPUS_SQL}, {CHUNK_SQL} SELECT chunk_id, source, lang FROM chunks JOIN corpus USING (document_id)")
def d04(s, d):
    cut, docs = chunked(s, d, "document_id", "effective_agency", "chunk_id"), corpus(s, d)
    missing = [c for c in ("text", "effective_agency", "source", "lang") if c not in cut.columns and c != "text"]
    return cut.join(docs.select("document_id", *missing), "document_id").select("chunk_id", "source", "lang")


@query("d06_errors_with_family", f"WITH {CORPUS_SQL}, {CASES_SQL} SELECT method, document_id, effective_family_id FROM cases JOIN corpus USING (document_id) WHERE condition = 'complete_unmasked' AND true_label IS DISTINCT FROM predicted_label")
def d06(s, d):
    wrong = cases(s, d).where((F.col("condition") == "complete_unmasked") & ~F.col("true_label").eqNullSafe(F.col("predicted_label")))
    return wrong.select("method", "document_id").join(corpus(s, d).select("document_id", "effective_family_id"), "document_id", "left")


@query("e12_conflicting_families", f"WITH {CORPUS_SQL}, {FAMILY_SQL} SELECT named AS code, string_agg(DISTINCT agency, ',' ORDER BY agency) AS agencies, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM families WHERE named IS NOT NULL GROUP BY 1 HAVING count(DISTINCT agency) > 1")
def e12(s, d):
    named = corpus(s, d).select("document_id", "agency", T.filename_code(F.col("filename")).alias("code")).where(F.col("code").isNotNull())
    out = named.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("agency")), ",").alias("agencies"), F.array_join(F.array_sort(F.collect_list("document_id")), ",").alias("documents"))
    return out.where(F.contains("agencies", F.lit(",")))


@query("e15_category_reports", f"WITH {CORPUS_SQL}, {FAMILY_SQL}, {_STATUS}, j AS (SELECT f.document_id, f.evidence_type, s.status FROM families f JOIN status s USING (document_id)) SELECT 'form_number' AS category, count(*) AS n FROM j WHERE evidence_type = 'form_number_exact' UNION ALL SELECT 'filename', count(*) FROM j WHERE evidence_type = 'filename_code_match' UNION ALL SELECT 'singleton', count(*) FROM j WHERE evidence_type = 'singleton_no_evidence' UNION ALL SELECT 'review', count(*) FROM j WHERE status = 'uncertain_review' UNION ALL SELECT 'non_english', count(*) FROM j WHERE status = 'confidently_non_english'")
def e15(s, d):
    audit = C.assign_families(_decided(s, d))
    e, st = F.col("evidence_type"), F.col("status")
    named = {"form_number": e == "form_number_exact", "filename": e == "filename_code_match", "singleton": e == "singleton_no_evidence", "review": st == "uncertain_review", "non_english": st == "confidently_non_english"}
    return audit.agg(*(F.count_if(c).alias(n) for n, c in named.items())).unpivot([], list(named), "category", "n")


@query("e16_audit_manifest", f"WITH {CORPUS_SQL}, {FAMILY_SQL} SELECT count(*) AS documents, count(DISTINCT family_id) AS families, count(DISTINCT CASE WHEN evidence_type = 'singleton_no_evidence' THEN family_id END) AS singletons, (SELECT count(*) FROM (SELECT family_id FROM families GROUP BY 1 HAVING count(*) > 1)) AS shared_families FROM families")
def e16(s, d):
    sizes = C.assign_families(corpus(s, d)).groupBy("family_id", "evidence_type").agg(F.count("*").alias("n"))
    by_family = sizes.groupBy("family_id").agg(F.sum("n").alias("n"), F.bool_or(F.col("evidence_type") == "singleton_no_evidence").alias("alone"))
    return by_family.agg(F.sum("n").alias("documents"), F.count("*").alias("families"), F.count_if("alone").alias("singletons"), F.count_if(F.col("n") > 1).alias("shared_families"))


@query("g07_before_and_after", f"WITH RECURSIVE {VECTORS}, {DIVERSE} SELECT query_id, string_agg(chunk_id, ',' ORDER BY place) FILTER (place <= 5) AS before, (SELECT string_agg(c.chunk_id, ',' ORDER BY new_place) FROM chosen c WHERE c.query_id = knn.query_id) AS after FROM knn GROUP BY query_id")
def g07(s, d):
    pool = saved_nearest(s, d)
    listed = lambda df, place, name: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "chunk_id"))), lambda x: x["chunk_id"]), ",").alias(name))
    return listed(pool.where("place <= 5"), "place", "before").join(listed(retrieval.diversified(pool), "new_place", "after"), "query_id")


@query("g13_first_example", WITH + "SELECT agency, arg_min(document_id, doc_id) AS example FROM corpus WHERE form_number LIKE 'I-%' GROUP BY agency")
def g13(s, d):
    return corpus(s, d).where(F.col("form_number").startswith("I-")).groupBy("agency").agg(F.min_by("document_id", "doc_id").alias("example"))


@query("h26_routing_audit", f"WITH RECURSIVE {VECTORS}, {DIVERSE} SELECT query_id, chosen.chunk_id FROM chosen JOIN v ON v.chunk_id = chosen.chunk_id WHERE (query_id % 100 = 0) <> (v.vec_id % 2 = 0)")
def h26(s, d):
    got = retrieval.diversified(nearest(s, d)).join(vectors(s, d).select("chunk_id", "vec_id"), "chunk_id")
    return got.where((F.col("query_id") % 100 == 0) != (F.col("vec_id") % 2 == 0)).select("query_id", "chunk_id")


@query("h28_combined_weights", f"WITH {CORPUS_SQL}, {CHUNK_SQL}, c AS (SELECT effective_agency AS label, count(*) AS n FROM corpus GROUP BY 1), r AS (SELECT label, CASE WHEN max(n) OVER () / min(n) OVER () < 4.0 THEN 1.0 ELSE sum(n) OVER () / (count(*) OVER () * n) END AS raw FROM c), w AS (SELECT label, round(raw / avg(raw) OVER (), 6) AS cw FROM r) SELECT chunk_id, round(cw / count(*) OVER (PARTITION BY document_id), 9) AS weight FROM chunks JOIN w ON label = effective_agency")
def h28(s, d):
    classes = E.class_weights(corpus(s, d).groupBy(F.col("effective_agency").alias("label")).agg(F.count("*").alias("n")))
    weighted = E.chunk_weights(saved_chunks(s, d, "document_id", "effective_agency", "chunk_id")).join(classes.select(F.col("label").alias("effective_agency"), F.col("weight").alias("class_weight")), "effective_agency")
    return weighted.select("chunk_id", F.round(F.col("class_weight") / F.col("n_chunks"), 9).alias("weight"))


@query("h36_default_route", f"WITH {CASES_SQL} SELECT document_id, arg_max(coalesce(predicted_label, 'review'), CASE method WHEN 'bert' THEN 2 WHEN 'llm' THEN 1 ELSE 0 END) AS route FROM cases WHERE condition = 'complete_unmasked' GROUP BY 1")
def h36(s, d):
    order = F.when(F.col("method") == "bert", 2).when(F.col("method") == "llm", 1).otherwise(0)
    return cases(s, d).where("condition = 'complete_unmasked'").groupBy("document_id").agg(F.max_by(F.coalesce("predicted_label", F.lit("review")), order).alias("route"))


@query("i02_ordered_distinct", WITH + "SELECT source, row_number() OVER (ORDER BY first) AS place FROM (SELECT source, min(doc_id) AS first FROM corpus GROUP BY source)")
def i02(s, d):
    from docloom.sources.tables import numbered

    firsts = corpus(s, d).groupBy("source").agg(F.min("doc_id").alias("first"))
    return numbered(firsts, ["first"]).select("source", F.col("document_id").cast("long").alias("place"))


@query("i04_deduplicated_keys", WITH + "SELECT filename, min(doc_id) AS doc_id FROM corpus GROUP BY filename")
def i04(s, d):
    return corpus(s, d).groupBy("filename").agg(F.min("doc_id").alias("doc_id"))


@query("k01_split_manifest", WITH + "SELECT 'v1' AS version, count(*) AS documents, count(DISTINCT effective_family_id) AS families, (" + fingerprint_sql(["document_id", "effective_family_id"]) + ") AS fingerprint FROM corpus")
def k01(s, d):
    from docloom.operators.splitting import fingerprint_at_scale

    c = corpus(s, d)
    print_ = fingerprint_at_scale(c, ["document_id", "effective_family_id"]).select("fingerprint").scalar()
    return c.agg(F.count("*").alias("documents"), F.count_distinct("effective_family_id").alias("families")).select(F.lit("v1").alias("version"), "documents", "families", print_.alias("fingerprint"))
