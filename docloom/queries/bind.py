"""The given tables as relations of the corpus model, for queries and oracles alike: expressions are written once and run on both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENCY = "CASE doc_id % 4 WHEN 0 THEN 'USCIS' WHEN 1 THEN 'DMV' WHEN 2 THEN 'SSA' ELSE 'IRS' END"
NEXT_AGENCY = AGENCY.replace("doc_id", "(doc_id + 1)")
FILENAME = "CASE doc_id % 7 WHEN 0 THEN 'i-' || (doc_id % 97) || 'instr.pdf' WHEN 1 THEN 'notice-reg-' || (doc_id % 53) || '.pdf' WHEN 2 THEN 'ssa-' || (doc_id % 41) || '-sp.pdf' WHEN 3 THEN 'f' || (1000 + doc_id % 37) || 'sp.pdf' WHEN 4 THEN 'My%20file_name-rev.pdf' WHEN 5 THEN 'fw' || (doc_id % 9) || '.pdf' ELSE 'fss' || (doc_id % 11) || 'eskr.pdf' END"
#: The corpus relation. Identifiers to mask are put before the text, which has none; other than ASCII letters go, as engines differ on word borders next to them.
CORPUS = {
    "document_id": "CAST(doc_id AS STRING)",
    "doc_id": "doc_id",
    "text": "text",
    "lang": "lang",
    "source": "source",
    "n_chars": "n_chars",
    "agency": AGENCY,
    "filename": FILENAME,
    "form_number": "CASE WHEN doc_id % 5 = 0 THEN 'I-' || (doc_id % 97) WHEN doc_id % 5 = 1 THEN 'nan' END",
    "effective_agency": AGENCY,
    "effective_family_id": f"{AGENCY} || ':F' || ((CAST(floor(doc_id / 4) AS BIGINT) * CAST(floor(doc_id / 4) AS BIGINT)) % 23)",
}
MARKED = "'Form I-' || (doc_id % 97) || ' OMB No. 1615-0047 at www.uscis.gov/i-9 by USCIS and the Internal Revenue Service (DMV) ' || "
CORPUS_SQL = "corpus AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CORPUS.items()) + " FROM documents)"

METHODS = ["bert", "llm", "llm_rag"]
CONDITIONS = ["complete_unmasked", "beginning_only_unmasked", "middle_only_unmasked", "end_only_unmasked", "beginning_middle_end_unmasked", "complete_masked", "beginning_only_masked", "middle_only_masked", "end_only_masked", "beginning_middle_end_masked"]
_FAILED = "(doc_id + c) % (29 + m) = 0"
#: Three methods' answers to each document in ten conditions, wrong or failed by a rule.
CASES = {
    "document_id": "CAST(doc_id AS STRING)",
    "doc_id": "doc_id",
    "n_chars": "n_chars",
    "method": "CASE m " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(METHODS)) + " END",
    "condition": "CASE c " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(CONDITIONS)) + " END",
    "true_label": AGENCY,
    "predicted_label": f"CASE WHEN {_FAILED} THEN NULL WHEN (doc_id + 3 * c) % (7 + 2 * m) = 0 THEN {NEXT_AGENCY} ELSE {AGENCY} END",
    "status": f"CASE WHEN {_FAILED} THEN 'failed' ELSE 'success' END",
    "confidence": "((doc_id * 7 + c) % 50 + 50) / 100.0",
    "latency_ms": "CAST((doc_id * 13 + c * 7 + m) % 100 AS DOUBLE) + CAST(0.5 AS DOUBLE)",
    "total_tokens": "CAST(floor(n_chars / 4) AS BIGINT)",
    "estimated_cost_usd": "CAST(floor(n_chars / 4) AS DOUBLE) * CAST(0.0000001 AS DOUBLE)",
    "input_fingerprint": "CAST(doc_id * 10 + c AS STRING)",
}
CASES_SQL = "cases AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CASES.items()) + " FROM documents, range(10) AS t1(c), range(3) AS t2(m))"
#: Scores of one to four chunks a document.
SCORE = "CAST((doc_id * 31 + chunk_index * 17 + {j} * 7 + (doc_id % 3) * chunk_index * {j}) % 19 + 1 AS DOUBLE)"
TOTAL = "(" + " + ".join(SCORE.format(j=j) for j in range(4)) + ")"
SCORES = {"document_id": "CAST(doc_id AS STRING)", "chunk_index": "CAST(chunk_index AS INT)", "agency": AGENCY, **{f"p{j}": f"{SCORE.format(j=j)} / {TOTAL}" for j in range(4)}, **{f"l{j}": SCORE.format(j=j) for j in range(4)}}
SCORES_SQL = "scores AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SCORES.items()) + " FROM documents, range(4) AS t(chunk_index) WHERE chunk_index <= doc_id % 4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in CORPUS.items()))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("text", F.expr(f"{MARKED} regexp_replace(text, '[^ -~\\\\n]', '')"))


MARKED_SQL = f"marked AS (SELECT * REPLACE ({MARKED} regexp_replace(text, '[^ -~\\n]', '', 'g') AS text) FROM corpus)"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.selectExpr(*(f"{e} AS {n}" for n, e in CASES.items()))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr("sequence(0, cast(doc_id % 4 as int))")).alias("chunk_index"))
    out = rows.selectExpr(*(f"{e} AS {n}" for n, e in SCORES.items()))
    return out.select("document_id", "chunk_index", "agency", F.array(*(f"p{j}" for j in range(4))).alias("probs"), F.array(*(f"l{j}" for j in range(4))).alias("logits"))


class Registry:
    """Collects a module's queries and oracles."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return keep
