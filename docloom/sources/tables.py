"""Tables of the corpus: explicit schemas in, versioned tables out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.sources.shared import materialise

SOURCE = "document_id string, filename string, filepath string, agency string, form_number string, document_type string, url string, file_exists boolean, text string, page_count int, text_length int, extraction_success boolean"
CASE = "method string, document_id string, effective_family_id string, condition string, true_label string, predicted_label string, confidence double, status string, error_type string, attempt_count int, truncated boolean, latency_ms double, prompt_tokens int, completion_tokens int, total_tokens int, estimated_cost_usd double, input_fingerprint string, retrieval_context_fingerprint string, raw_response_hash string, retrieved_chunks array<struct<chunk_id:string,rank:int,similarity:double,parent_document_id:string,effective_family_id:string,effective_agency:string,text_hash:string,masked:boolean>>, cache_key string"


def read_csv(spark: SparkSession, path: str, schema: str = SOURCE) -> DataFrame:
    """CSV with quoted line breaks; bytes that are no UTF-8 come out as replacement characters. Ids are strings as the schema says, never inferred."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """White space at the ends stays. Null and the empty string are both read back as null."""
    kept = df.write.mode("errorifexists").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    kept.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = CASE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The table, or an empty one of the schema where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(kind).load(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A table partitioned by split; one split reads its own files only."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def write_version(df: DataFrame, base: str, name: str, run_id: str, by: list[str] | None = None) -> str:
    """A table of one run; an existing one is never overwritten."""
    path = f"{base}/run_id={run_id}/{name}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def write_manifest(spark: SparkSession, payload: dict, path: str) -> None:
    """One JSON object; keys in order, so equal manifests are equal files."""
    spark.createDataFrame([(json.dumps(payload, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_manifest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flattened(df: DataFrame) -> DataFrame:
    """The leaves of nested structs as columns with dotted names."""

    def leaves(kind: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            at = (*path, f.name)
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(".".join(at)))
        return out

    return df.select(*leaves(df.schema, ()))


def save_results(df: DataFrame, base: str) -> None:
    """Predictions or metrics by (method, split); those that df has anew take the place of older ones, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "split").parquet(base)


def load_results(spark: SparkSession, base: str, method: str, split: str) -> DataFrame:
    """One method's results on one split; no other files are read."""
    return spark.read.parquet(base).where((F.col("method") == method) & (F.col("split") == split))


def is_pdf_response(status: Column, content_type: Column) -> Column:
    """A successful answer that says it is a PDF; unknown status or type is none."""
    return F.coalesce((status == 200) & F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False))


def missing_from(wanted: DataFrame, stored: DataFrame, key: str = "cache_key") -> DataFrame:
    """What a cache does not have: each key once."""
    return wanted.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def newest(stored: DataFrame, key: str = "cache_key", order: str = "stored_at") -> DataFrame:
    """One row per key: the last that was stored."""
    columns = [c for c in stored.columns if c != key]
    return stored.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row")).select(key, "row.*")


def snippet_index(docs: DataFrame, n: int = 500) -> DataFrame:
    return docs.withColumn("snippet", F.substring("text", 1, n)).drop("text")


def latest_ready(artifacts: DataFrame) -> DataFrame:
    """Of (name, status, ready_at) the newest that is ready."""
    return artifacts.where(F.col("status") == "ready").agg(F.max_by("name", F.struct("ready_at", "name")).alias("name"))


def normalize_metadata(df: DataFrame, agency: str, folder: str, columns: list[str]) -> DataFrame:
    """The common metadata columns: missing ones are null, the agency is given, the path is built."""
    out = df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns}).withColumn("agency", F.lit(agency))
    return out.withColumn("filepath", F.concat(F.lit(f"{folder}/"), F.col("filename"))).select(*dict.fromkeys([*columns, "agency", "filepath"]))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """document_id 1..n by a declared order. Ranges are sorted in parallel and offset by their counts, so no task holds all rows."""
    part, at, n, before = (f"numbered {c}" for c in ("part", "at", "n", "before"))
    ranged = df.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order)
    # kept as computed: a partition that is dealt anew would be numbered anew
    kept = materialise(ranged.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "numbered")
    counts = kept.groupBy(part).agg(F.count("*").alias(n), F.min(at).alias("numbered first"))
    so_far = F.coalesce(F.sum(n).over(W.partitionBy().orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn(before, so_far - F.col("numbered first") + 1).select(part, before)  # a row for each partition
    return kept.join(offsets, part).withColumn("document_id", (F.col(before) + F.col(at)).cast("string")).drop(part, at, before)


def links(html: Column) -> Column:
    """The targets of all links, each once, in the order of their first places."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1)))


def page_text(html: Column) -> Column:
    """A page's visible text: scripts, styles, comments and tags go, common entities are resolved, white space is squeezed."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def read_files(spark: SparkSession, path: str, least_bytes: int = 10 * 1024) -> DataFrame:
    """(path, length, too_small, text): small files are flagged, not dropped; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", (F.col("length") < least_bytes).alias("too_small"), F.decode("content", "UTF-8").alias("text"))
