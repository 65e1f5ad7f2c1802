"""Sources and sinks: tables are written in the given form to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import vector_index
from docloom.queries.bind import CASES_SQL, CORPUS_SQL, SCORES_SQL, Registry, cases, corpus, scores, table
from docloom.queries.windows import SMALL_INDEX
from docloom.sources import cache, manifests, tables
from docloom.sources.shared import checkpoint_dir, materialise

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {CORPUS_SQL} "


def _fresh(s: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(s)}/{name}-{uuid.uuid4().hex}"


@query("a01_csv_scan", WITH + "SELECT document_id, filename, agency, form_number, length(text) AS n_chars, sha256(text) AS digest FROM corpus")
def a01(s: SparkSession, d: str) -> DataFrame:
    path = _fresh(s, "csv")
    tables.write_csv(corpus(s, d).select("document_id", "filename", "agency", "form_number", "text"), path)
    back = tables.read_csv(s, path, "document_id string, filename string, agency string, form_number string, text string")
    return back.select("document_id", "filename", "agency", "form_number", F.length("text").cast("long").alias("n_chars"), T.sha256(F.col("text")).alias("digest"))


@query("a02_scan_by_split", WITH + "SELECT lang AS split, count(*) AS n FROM corpus GROUP BY 1")
def a02(s, d):
    path = tables.write_version(corpus(s, d).select("document_id", F.col("lang").alias("split")), _fresh(s, "splits"), "docs", "r1", ["split"])
    return tables.read_split(s, path).groupBy("split").agg(F.count("*").alias("n"))


@query("a04_csv_sink", WITH + "SELECT lang, agency, count(*) AS n FROM corpus GROUP BY ALL")
def a04(s, d):
    path = _fresh(s, "report")
    tables.write_csv(corpus(s, d).groupBy("lang", "agency").agg(F.count("*").alias("n")), path)
    return tables.read_csv(s, path, "lang string, agency string, n long")


@query("a05_json_manifest", WITH + "SELECT count(*) AS documents, count(DISTINCT source) AS sources, 'v1' AS version FROM corpus")
def a05(s, d):
    path = _fresh(s, "manifest")
    totals = corpus(s, d).agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources")).first()
    tables.write_manifest(s, {"version": "v1", **totals.asDict()}, path)
    return tables.read_manifest(s, path, "documents long, sources long, version string")


@query("a06_nested_scan", "SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM (SELECT vec_id AS query_id, unnest(range(1, 2 + vec_id % 3)) AS rank, CAST(vec_id + rank AS STRING) AS chunk_id FROM embeddings)")
def a06(s, d):
    path = _fresh(s, "nested")
    listed = F.expr("transform(sequence(1, cast(1 + vec_id % 3 as int)), r -> struct(cast(vec_id + r as string) AS chunk_id, r AS rank))")
    tables.write_jsonl(table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), listed.alias("retrieved_chunks")), path)
    return tables.read_jsonl(s, path, "query_id long, retrieved_chunks array<struct<chunk_id:string,rank:int>>").select("query_id", F.inline("retrieved_chunks"))


@query("a07_case_log", f"WITH {CASES_SQL} SELECT method, document_id, condition, predicted_label, status, round(confidence, 6) AS confidence FROM cases")
def a07(s, d):
    path = _fresh(s, "cases")
    tables.write_jsonl(cases(s, d), path)
    return tables.read_jsonl(s, path).select("method", "document_id", "condition", "predicted_label", "status", F.round("confidence", 6).alias("confidence"))


@query("a08_flattened_manifest", WITH + "SELECT source AS name, count(*) AS documents, min(n_chars) AS shortest, max(n_chars) AS longest FROM corpus GROUP BY 1")
def a08(s, d):
    path = _fresh(s, "manifests")
    rows = corpus(s, d).groupBy(F.col("source").alias("name")).agg(F.struct(F.count("*").alias("documents"), F.struct(F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest")).alias("length")).alias("totals"))
    rows.write.json(path)
    flat = tables.flattened(tables.read_manifest(s, path, "name string, totals struct<documents:long,length:struct<shortest:long,longest:long>>"))
    return flat.toDF(*(c.split(".")[-1] for c in flat.columns))


@query("a09_read_or_empty", WITH + "SELECT document_id FROM corpus")
def a09(s, d):
    none = tables.read_or_empty(s, _fresh(s, "absent"), "document_id string")
    path = _fresh(s, "present")
    corpus(s, d).select("document_id").write.parquet(path)
    return none.unionByName(tables.read_or_empty(s, path, "document_id string"))


@query("a10_result_store", f"WITH {CASES_SQL} SELECT method, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(predicted_label) AS answered FROM cases WHERE method IN ('bert', 'llm') AND (method = 'bert' OR doc_id % 5 = 0) GROUP BY ALL")
def a10(s, d):
    base = _fresh(s, "results")
    rows = cases(s, d).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")).select("method", "split", "document_id", "predicted_label")
    tables.save_results(rows, base)
    tables.save_results(rows.where("method = 'bert' AND split = 'test'"), base)  # again: replaces itself, leaves the rest
    kept = [("bert", "train"), ("bert", "test"), ("llm", "test")]
    first, *rest = (tables.load_results(s, base, *k) for k in kept)
    for r in rest:
        first = first.unionByName(r)
    return first.groupBy("method", "split").agg(F.count("*").alias("n"), F.count("predicted_label").alias("answered"))


@query("a11_versioned_sink", WITH + "SELECT count(*) AS n, true AS second_write_refused FROM corpus")
def a11(s, d):
    base, rows = _fresh(s, "versions"), corpus(s, d).select("document_id")
    path, refused = tables.write_version(rows, base, "docs", "r1"), False
    try:
        tables.write_version(rows, base, "docs", "r1")
    except AnalysisException:
        refused = True
    return s.read.parquet(path).agg(F.count("*").alias("n")).withColumn("second_write_refused", F.lit(refused))


@query("a13_embedding_cache", WITH + "SELECT DISTINCT sha256(text) AS text_hash, sha256('query|' || sha256(text)) AS cache_key FROM corpus WHERE text NOT IN (SELECT text FROM corpus WHERE doc_id % 3 = 0)")
def a13(s, d):
    keyed = corpus(s, d).select("doc_id", T.sha256(F.col("text")).alias("text_hash")).withColumn("cache_key", T.joined_hash(F.lit("query"), F.col("text_hash")))
    return tables.missing_from(keyed.drop("doc_id"), keyed.where("doc_id % 3 = 0"))


@query("a14_index_replaced", "SELECT CAST(vec_id AS STRING) AS chunk_id, label FROM embeddings WHERE label < 5")
def a14(s, d):
    path = _fresh(s, "index")
    chunks = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), "label", F.lit("not kept").alias("text"))
    vector_index.build(chunks, path, SMALL_INDEX)
    return vector_index.build(chunks.where("label < 5"), path, SMALL_INDEX).table.select("chunk_id", "label")


@query("a15_index_report", "SELECT count(*) AS vectors, count(DISTINCT vec_id) AS chunks, CAST(min(len(embedding)) AS INT) AS least_width, CAST(max(len(embedding)) AS INT) AS most_width FROM embeddings")
def a15(s, d):
    path = _fresh(s, "index")
    vector_index.build(table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector")), path, SMALL_INDEX)
    return vector_index.report(vector_index.load(s, path))


@query("a17_settings", "SELECT unnest(['overlap', 'seed', 'window']) AS name, unnest([128, 7, 510])::BIGINT AS setting")
def a17(s, d):
    from docloom.plans import settings

    made = settings.settings('{"seed": 7, "window": 510}')
    return s.createDataFrame([(n, getattr(made, n)) for n in ("overlap", "seed", "window")], "name string, setting long")


@query("a18_prompt", WITH + "SELECT document_id, sha256('Which agency wrote this? ' || text) AS digest, sha256('Which agency wrote this? {document}') AS prompt_hash FROM corpus")
def a18(s, d):
    from docloom.plans import settings

    template, digest = settings.prompt('{"template": "Which agency wrote this? {document}"}')
    return corpus(s, d).select("document_id", T.sha256(T.render(template, {"document": F.col("text")})).alias("digest"), F.lit(digest).alias("prompt_hash"))


@query("a19_run_isolation", WITH + "SELECT 'r' || (doc_id % 2) AS run, count(*) AS n FROM corpus GROUP BY 1")
def a19(s, d):
    base, rows = _fresh(s, "runs"), corpus(s, d).select("doc_id")
    made = [s.read.parquet(tables.write_version(rows.where(F.col("doc_id") % 2 == i), base, "docs", f"r{i}")).withColumn("run", F.lit(f"r{i}")) for i in (0, 1)]
    return made[0].unionByName(made[1]).groupBy("run").agg(F.count("*").alias("n"))


_STATUS = "CASE page_id % 4 WHEN 0 THEN 404 ELSE 200 END"
_KIND = "CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'Application/PDF; v=1' END"


@query("a23_content_types", f"SELECT page_id, coalesce({_STATUS} = 200 AND lower({_KIND}) LIKE '%pdf%', false) AS is_pdf FROM pages")
def a23(s, d):
    return table(s, d, "pages").select("page_id", tables.is_pdf_response(F.expr(_STATUS), F.expr(_KIND)).alias("is_pdf"))


@query("a25_small_files", "SELECT lang, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, sum(octet_length(encode(text)) + 1) < 300000 AS too_small FROM documents GROUP BY 1")
def a25(s, d):
    path = _fresh(s, "files")
    # text files hold a line for each row: one file for each language and part
    table(s, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    files = tables.read_files(s, path, 1).select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), "length")
    return files.groupBy("lang").agg(F.sum("length").alias("bytes")).withColumn("too_small", F.col("bytes") < 300_000)


@query("a27_model_artifacts", WITH + "SELECT lang, count(*) AS documents, count(*) AS same FROM corpus GROUP BY lang")
def a27(s, d):
    """A model is trained, saved, marked ready, and read again: it predicts the same."""
    from docloom.operators.chunks import chunk
    from docloom.operators.corpus import LABELS
    from docloom.plans import classifier

    base = _fresh(s, "models")
    c = corpus(s, d)
    agency = F.element_at(F.create_map(*(F.lit(x) for p in zip(("en", "fr", "de", "es"), LABELS, strict=True) for x in p)), F.col("lang"))
    cut = materialise(chunk(c.select("document_id", "text", agency.alias("agency")), columns=["document_id", "agency", "chunk_index", "chunk_text"]), "chunks")
    model = classifier.train(cut, 1 << 8, 3)
    classifier.save_artifact(model, base, "m1", 1)
    again = classifier.load_artifact(s, base, "m1")
    # documents without tokens have no chunks, and no prediction of either model
    both = c.select("document_id", "lang").join(classifier.predict(model, cut), "document_id", "left").join(classifier.predict(again, cut).withColumnRenamed("predicted", "again"), "document_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("predicted").eqNullSafe(F.col("again"))).alias("same"))


@query("h31_document_vectors", f"WITH {SCORES_SQL} SELECT document_id, count(*) AS chunks, round(arg_min(p0, chunk_index), 6) AS first_p0, round(arg_max(p0, chunk_index), 6) AS last_p0 FROM scores GROUP BY 1")
def h31(s, d):
    listed = scores(s, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "probs"))).alias("l"))
    return listed.select("document_id", F.size("l").cast("long").alias("chunks"), F.round(F.col("l")[0]["probs"][0], 6).alias("first_p0"), F.round(F.element_at("l", -1)["probs"][0], 6).alias("last_p0"))


@query("a12_cache_writers", WITH + "SELECT document_id, sha256('v1|' || document_id) AS cache_key, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS writer FROM corpus WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def a12_writers(s, d):
    """Two writers, who share keys: the first one to commit has them."""
    base = _fresh(s, "cache")
    wanted = corpus(s, d).select("doc_id", "document_id", T.joined_hash(F.lit("v1"), F.col("document_id")).alias("cache_key"))
    for writer, k in (("first", 2), ("second", 3)):
        cache.commit(wanted.where(F.col("doc_id") % k == 0).select("cache_key", "document_id", F.lit(writer).alias("writer")), base)
    return cache.cached(s, base, wanted.select("cache_key", "document_id", F.lit("").alias("writer")).schema).drop("part")


@query("k02_stale_manifests", WITH + """, n AS (SELECT lang, count(*) AS n FROM corpus GROUP BY 1) SELECT 'split' AS name, 'language-' || lang AS source, 'changed' AS reason FROM n WHERE n % 2 = 1 UNION ALL SELECT 'freeze', 'language-' || lang, 'changed' FROM n WHERE n % 2 = 1
UNION ALL SELECT 'freeze', 'split', 'follows' WHERE (SELECT count(*) FROM n WHERE n % 2 = 1) > 0""")
def k02(s, d):
    """Planted: the manifests of languages with an odd number of documents are built again, with another count, after what follows from them."""
    base = _fresh(s, "manifests")
    counts = {r["lang"]: r["n"] for r in corpus(s, d).groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    names = [f"language-{lang}" for lang in sorted(counts)]
    for lang, n in counts.items():
        manifests.build(s, base, f"language-{lang}", {"documents": n})
    manifests.build(s, base, "split", {"documents": sum(counts.values())}, names)
    manifests.freeze(s, base)
    for lang, n in counts.items():
        if n % 2:
            manifests.build(s, base, f"language-{lang}", {"documents": n - 1})
    return manifests.stale(s, base)


@query("k03_review_flags", WITH + """, f AS (SELECT document_id, effective_family_id, (doc_id % 10) / 10.0 AS family_confidence, CASE doc_id % 6 WHEN 0 THEN 'uncertain_review' WHEN 1 THEN NULL ELSE 'english' END AS status, CASE WHEN doc_id % 97 = 5 THEN 'IRS' ELSE effective_agency END AS agency FROM corpus),
g AS (SELECT *, count(DISTINCT agency) OVER (PARTITION BY effective_family_id) > 1 AS shared FROM f)
SELECT document_id, flags FROM (SELECT document_id, concat_ws(',', CASE WHEN family_confidence < 0.3 THEN 'uncertain_family' END, CASE WHEN coalesce(status, 'none') IN ('none', 'uncertain_review') THEN 'unclear_language' END, CASE WHEN shared THEN 'shared_family' END) AS flags FROM g) WHERE flags <> ''""")
def k03(s, d):
    status = F.when(F.col("doc_id") % 6 == 0, "uncertain_review").when(F.col("doc_id") % 6 != 1, "english")
    agency = F.when(F.col("doc_id") % 97 == 5, "IRS").otherwise(F.col("effective_agency"))
    audit = corpus(s, d).select("document_id", "effective_family_id", (F.col("doc_id") % 10 / 10.0).alias("family_confidence"), status.alias("final_language_status"), agency.alias("effective_agency"))
    return manifests.review_flags(audit, 0.3).select("document_id", F.array_join("flags", ",").alias("flags"))
