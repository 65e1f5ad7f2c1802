"""Proofs about splits, indices and runs, with violations planted so that the counts are not all zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import checks, splitting
from docloom.operators import chunks as K
from docloom.queries.bind import CASES_SQL, CONDITIONS, CORPUS_SQL, METHODS, Registry, cases, corpus, marked
from docloom.queries.windows import OVERLAP, WINDOW
from docloom.sources.shared import materialise

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {CORPUS_SQL} "
_PART = "CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def _split(s: SparkSession, d: str) -> DataFrame:
    """Cut by documents, so that families leak."""
    return corpus(s, d).withColumn("split", F.expr(_PART)).select("document_id", "doc_id", "effective_family_id", "split", "agency", "text")


@query("e27_settings_hash", "SELECT sha256('{\"overlap\":128,\"window\":510}') AS digest")
def e27(s, d):
    return s.range(1).select(F.sha2(F.to_json(F.struct(F.lit(128).alias("overlap"), F.lit(510).alias("window"))), 256).alias("digest"))


@query("j14_rerun_determinism", "SELECT unnest(['chunks', 'split']) AS step, true AS same")
def j14(s, d):
    """Each step from rows as they lie and from rows dealt out anew, by id, in as many parts as the session shuffles to: the fingerprints agree."""
    out = []
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    for name in ("chunks", "split"):
        prints = []
        # a step takes its own columns only, so that no more is dealt out
        c = corpus(s, d).select(*(("document_id", "text") if name == "chunks" else ("document_id", "effective_agency", "effective_family_id")))
        for docs in (c, c.repartition(parts, "document_id")):
            made = K.chunk(docs, WINDOW, OVERLAP, columns=["chunk_id"]) if name == "chunks" else splitting.family_split(docs).select("effective_family_id", "split")
            prints.append(splitting.fingerprint_at_scale(made, made.columns).first()[0])
        out.append((name, prints[0] == prints[1]))
    return s.createDataFrame(out, "step string, same boolean")


_SHARED = "(SELECT count(*) FROM (SELECT DISTINCT {k} FROM p WHERE split = '{a}' INTERSECT SELECT DISTINCT {k} FROM p WHERE split = '{b}'))"
_PAIRS = [("train", "validation"), ("train", "test"), ("validation", "test")]


@query("j15_split_overlap", WITH + f", p AS (SELECT document_id, effective_family_id, {_PART} AS split FROM corpus) " + " UNION ALL ".join(f"SELECT '{a}_{b}_{k}' AS \"check\", {_SHARED.format(k=k, a=a, b=b)} AS violations" for k in ("document_id", "effective_family_id") for a, b in _PAIRS))
def j15(s, d):
    parts = _split(s, d)
    return checks.report(checks.overlap_checks(parts, "document_id") | checks.overlap_checks(parts, "effective_family_id"))


@query("j16_index_without_test", WITH + f"SELECT 'test_document_in_index' AS \"check\", count(*) AS violations FROM corpus WHERE doc_id % 20 = 0 AND {_PART} = 'test'")
def j16(s, d):
    parts = _split(s, d)
    indexed = parts.where("split = 'train' OR doc_id % 20 = 0").select("document_id")
    return checks.report({"test_document_in_index": indexed.join(parts.where("split = 'test'").select("document_id"), "document_id", "left_semi")})


@query("j17_test_isolation", "SELECT 'data/test_chunks' AS banned_input")
def j17(s, d):
    return s.createDataFrame([(n,) for n in checks.declared_inputs(["data/train_chunks", "data/test_chunks", "weights"])], "banned_input string")


@query("j18_index_integrity", WITH + f""", p AS (SELECT document_id, doc_id, effective_family_id, {_PART} AS split FROM corpus), x AS (SELECT * FROM p WHERE split = 'train' OR doc_id % 20 = 0), xf AS (SELECT DISTINCT effective_family_id AS f FROM x)
SELECT 'indexed_not_in_train' AS "check", (SELECT count(*) FROM x WHERE split <> 'train') AS violations UNION ALL SELECT 'validation_document_indexed', 0 UNION ALL SELECT 'validation_family_indexed', (SELECT count(*) FROM xf WHERE f IN (SELECT effective_family_id FROM p WHERE split = 'validation'))
UNION ALL SELECT 'test_document_indexed', (SELECT count(*) FROM x WHERE split = 'test') UNION ALL SELECT 'test_family_indexed', (SELECT count(*) FROM xf WHERE f IN (SELECT effective_family_id FROM p WHERE split = 'test'))
UNION ALL SELECT 'excluded_document_indexed', (SELECT count(*) FROM x WHERE doc_id % 11 = 2) UNION ALL SELECT 'metadata_differs', 0""")
def j18(s, d):
    parts = _split(s, d)
    return checks.report(checks.index_checks(parts.where("split = 'train' OR doc_id % 20 = 0"), parts, parts.where("doc_id % 11 = 2")))


@query("j19_held_out_integrity", f"""WITH {CORPUS_SQL}, {CASES_SQL}, t AS (SELECT * FROM cases WHERE doc_id % 5 = 0 AND NOT (doc_id % 15 = 0 AND condition = 'end_only_masked') OR doc_id % 30 = 1)
SELECT 'document_outside_test' AS "check", (SELECT count(*) FROM t WHERE doc_id % 5 <> 0) AS violations UNION ALL SELECT 'unknown_condition', 0 UNION ALL SELECT 'case_missing', (SELECT 3 * count(*) FROM corpus WHERE doc_id % 15 = 0) UNION ALL SELECT 'case_repeats', 0
UNION ALL SELECT 'success_without_label', 0 UNION ALL SELECT 'confidence_out_of_range', 0 UNION ALL SELECT 'true_label_differs', 0""")
def j19(s, d):
    done = cases(s, d).where("doc_id % 5 = 0 AND NOT (doc_id % 15 = 0 AND condition = 'end_only_masked') OR doc_id % 30 = 1")
    return checks.report(checks.held_out_checks(done, _split(s, d), METHODS, CONDITIONS))


@query("j18_index_rebuild", f"""WITH {CORPUS_SQL} SELECT 'masked_text_differs' AS "check", (SELECT count(*) FROM corpus WHERE doc_id % 20 = 0) AS violations UNION ALL SELECT 'identifier_in_masked_text', (SELECT count(*) FROM corpus WHERE doc_id % 20 = 0)
UNION ALL SELECT 'query_fingerprint_differs', (SELECT count(*) FROM corpus WHERE doc_id % 50 = 0 AND coalesce(text, '') <> '') UNION ALL SELECT 'corpus_fingerprint_differs', 0 UNION ALL SELECT 'retrieval_order_differs', (SELECT 2 * count(*) FROM corpus WHERE doc_id % 40 = 0) UNION ALL SELECT 'older_store_changed', 1""")
def j18b(s, d):
    plain = marked(s, d).select("document_id", "doc_id", "text")
    # taken by two checks: texts are masked once
    hidden = materialise(K.masked(plain, "text").select("document_id", F.when(F.col("doc_id") % 20 == 0, F.col("text")).otherwise(F.col("masked_text")).alias("masked_text")), "hidden")
    c = corpus(s, d)
    print_ = lambda text: T.sha256(F.coalesce(text, F.lit("")))
    asked = c.select("document_id", print_(F.when(F.col("doc_id") % 50 != 0, F.col("text"))).alias("text_fingerprint"))
    # of rows as they lie and dealt out anew, in as many parts as the session shuffles to
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    prints = tuple(splitting.fingerprint_at_scale(x, ["document_id", "text"]).withColumn("name", F.lit("corpus")) for x in (c, c.select("document_id", "text").repartition(parts, "document_id")))
    order = lambda swapped: c.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("place")).select(F.col("doc_id").alias("query_id"), "place", F.when((F.col("doc_id") % 40 == 0) & F.lit(swapped), 3 - F.col("place")).otherwise(F.col("place")).alias("chunk_id"))
    stores = tuple(s.range(2).select(F.concat(F.lit("store"), "id").alias("name"), (F.col("id") * 3 + x * F.col("id")).alias("fingerprint")) for x in (0, 1))
    return checks.report(checks.masked_index_checks(plain, hidden) | checks.rebuild_checks(asked, c.select("document_id", print_(F.col("text")).alias("text_fingerprint")), prints, (order(False), order(True)), stores))


_TESTED = "doc_id % 5 = 0 OR doc_id % 30 = 1"


@query("j19_frozen_policies", WITH + f""", p AS (SELECT document_id, doc_id, effective_family_id, {_PART} AS split FROM corpus), t AS (SELECT * FROM p WHERE {_TESTED}), f AS (SELECT DISTINCT effective_family_id AS f FROM p WHERE split = 'test')
SELECT 'train_document_tested' AS "check", (SELECT count(*) FROM t WHERE split = 'train') AS violations UNION ALL SELECT 'validation_document_tested', (SELECT count(*) FROM t WHERE split = 'validation')
UNION ALL SELECT 'train_family_tested', (SELECT count(*) FROM f WHERE f IN (SELECT effective_family_id FROM p WHERE split = 'train')) UNION ALL SELECT 'validation_family_tested', (SELECT count(*) FROM f WHERE f IN (SELECT effective_family_id FROM p WHERE split = 'validation'))
UNION ALL SELECT 'excluded_document_tested', (SELECT count(*) FROM t WHERE doc_id % 11 = 2) UNION ALL SELECT 'frozen_setting_differs', 1""")
def j19b(s, d):
    parts = _split(s, d)
    setting = lambda *rows: s.createDataFrame(rows, "name string, value string")
    frozen = setting(("checkpoint", "epoch-2"), ("aggregation", "mean_probabilities"), ("condition_policy", "v1"))
    used = setting(("checkpoint", "epoch-2"), ("aggregation", "max_confidence"), ("condition_policy", "v1"))
    return checks.report(checks.policy_checks(cases(s, d).where(_TESTED), parts, parts.where("doc_id % 11 = 2"), used, frozen))
