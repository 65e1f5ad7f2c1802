"""Manifests that name what they were built from, so that a stale one is found.

A manifest is a row (name, digest, payload, sources): its payload as JSON with keys in order, and
the digests that its sources had when it was built. Its own digest covers both, so a change is seen by
all that follow from it. Rebuilding a manifest adds a row; the newest counts.

The builders below make the payloads of the corpus study from its tables.

Defined cases: a source that no manifest has is an error where a manifest is built, and reported
as missing where it is gone later; a manifest that names itself is an error; nulls count as the
word none in counts.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.tables import read_or_empty

SCHEMA = "name string, digest string, payload string, sources map<string,string>, built_at long"


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """The newest manifest of each name."""
    rows = read_or_empty(spark, base, SCHEMA)
    newest = F.row_number().over(W.partitionBy("name").orderBy(F.desc("built_at"), "digest"))
    return rows.withColumn("place", newest).where(F.col("place") == 1).drop("place")


def digest_of(payload: str, sources: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps([payload, sources], sort_keys=True).encode()).hexdigest()


def build(spark: SparkSession, base: str, name: str, payload: dict, sources: list[str] | None = None) -> str:
    """Writes a manifest from the sources as they are; its digest."""
    wanted = sorted(set(sources or []))
    if name in wanted:
        raise ValueError(f"{name} cannot be built from itself")
    known = {r["name"]: r["digest"] for r in manifests(spark, base).where(F.col("name").isin(wanted)).collect()} if wanted else {}  # those named here
    if gone := [s for s in wanted if s not in known]:
        raise ValueError(f"no manifest {gone[0]!r}")
    text = json.dumps(payload, sort_keys=True, default=str)
    row = (name, digest_of(text, known), text, known, time.time_ns())
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").option("maxRecordsPerFile", 0).parquet(base)
    return row[1]


def stale(spark: SparkSession, base: str) -> DataFrame:
    """(name, source, reason): manifests whose source has changed or is missing, or that follow from a stale one (reason: follows)."""
    rows = manifests(spark, base)
    edges = rows.select("name", F.explode("sources").alias("source", "seen"))
    now = rows.select(F.col("name").alias("source"), F.col("digest").alias("now"))
    reason = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("seen"), "changed")
    found = edges.join(now, "source", "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).select("name", "source", "reason")
    out, front = found, found.select("name").distinct()
    # a level at a time: as many rounds as manifests follow from each other
    while front.head(1):
        front = edges.join(front.withColumnRenamed("name", "source"), "source").select("name", "source").distinct().join(out.select("name", "source"), ["name", "source"], "left_anti")
        out = out.unionByName(front.withColumn("reason", F.lit("follows")))
        front = front.select("name").distinct()
    return out


def _counts(rows: DataFrame, by: Column) -> dict[str, int]:
    return {r["k"]: r["n"] for r in rows.groupBy(F.coalesce(by.cast("string"), F.lit("none")).alias("k")).agg(F.count("*").alias("n")).collect()}  # a row for each status


def language_manifest(audit: DataFrame) -> dict:
    """Of (final_language_status, effective_agency): documents by status, and by status and agency."""
    both = F.concat_ws("|", F.coalesce("final_language_status", F.lit("none")), F.coalesce("effective_agency", F.lit("none")))
    return {"by_status": _counts(audit, F.col("final_language_status")), "by_status_and_agency": _counts(audit, both)}


def override_proposals(audit: DataFrame, least: float) -> DataFrame:
    """(document_id, effective_family_id, family_confidence): what a person is to look at, the least certain first; those with an override already are left out."""
    return audit.where((F.coalesce("family_confidence", F.lit(0.0)) < least) & ~F.coalesce("overridden", F.lit(False))).select("document_id", "effective_family_id", "family_confidence").orderBy(F.asc_nulls_first("family_confidence"), "document_id")


def review_flags(audit: DataFrame, least: float) -> DataFrame:
    """(document_id, flags): why a document needs review: a family without certainty, a language that is not clear, a family that two agencies share."""
    agencies = audit.groupBy("effective_family_id").agg((F.count_distinct("effective_agency") > 1).alias("shared"))
    flags = F.array_compact(F.array(F.when(F.coalesce("family_confidence", F.lit(0.0)) < least, "uncertain_family"), F.when(F.coalesce("final_language_status", F.lit("none")).isin("none", "uncertain_review"), "unclear_language"), F.when(F.col("shared"), "shared_family")))
    return audit.join(agencies, "effective_family_id", "left").select("document_id", flags.alias("flags")).where(F.size("flags") > 0)


def freeze(spark: SparkSession, base: str, name: str = "freeze") -> str:
    """A manifest of all others as they are; an error where one of them is stale."""
    if bad := stale(spark, base).where(F.col("name") != name).head(1):
        raise ValueError(f"{bad[0]['name']} is stale: {bad[0]['source']} has {bad[0]['reason']}")
    names = [r["name"] for r in manifests(spark, base).where(F.col("name") != name).select("name").orderBy("name").collect()]
    return build(spark, base, name, {"frozen": names, "run": uuid.uuid4().hex}, names)
