"""Invariants: each is a count of violations that must be zero. One job, a row for each check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.chunks import masked
from docloom.sources.shared import materialise


def violations(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [violations(n, d) for n, d in checks.items()])


def require(checks: DataFrame) -> None:
    """Raises AssertionError that names the checks that failed."""
    if failed := [f"{r['check']}: {r['violations']}" for r in checks.where("violations > 0").collect()]:
        raise AssertionError("; ".join(failed))


def _in_more_than_one(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def split_checks(eligible: DataFrame, split: DataFrame) -> dict[str, DataFrame]:
    """No document or family in two splits; each eligible document exactly once; no other document."""
    copies = split.groupBy("document_id").agg(F.count("*").alias("n"))
    return {
        "document_overlap": _in_more_than_one(split, "document_id", "split"),
        "family_overlap": _in_more_than_one(split, "effective_family_id", "split"),
        "eligible_not_once": eligible.select("document_id").join(copies, "document_id", "left").where("coalesce(n, 0) <> 1"),
        "excluded_in_split": split.join(eligible.select("document_id"), "document_id", "left_anti"),
    }


def slim_chunks(chunks: DataFrame) -> DataFrame:
    """chunks as a table that chunk_checks() reads several times, so that texts are cut once; of a text it has what the checks take."""
    return materialise(chunks.withColumn("chunk_text", F.substring(F.trim("chunk_text"), 1, 1)), "chunks")


def chunk_checks(split: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Parents, splits, leakage, ids, indices, totals, empties, and coverage of chunks."""
    parents = split.select("document_id", F.col("split").alias("parent_split"))
    by_doc = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("d"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"), F.min("total_chunks").alias("t0"), F.max("total_chunks").alias("t1"))
    return {
        "chunk_without_parent": chunks.join(parents, "document_id", "left_anti"),
        "chunk_split_differs": chunks.join(parents, "document_id").where("split <> parent_split"),
        "chunk_id_in_splits": _in_more_than_one(chunks, "chunk_id", "split"),
        "document_chunks_in_splits": _in_more_than_one(chunks, "document_id", "split"),
        "family_chunks_in_splits": _in_more_than_one(chunks, "effective_family_id", "split"),
        "chunk_id_repeats": chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1"),
        "indices_not_contiguous": by_doc.where("low <> 0 or high <> n - 1 or d <> n"),
        "total_chunks_differs": by_doc.where("t0 <> n or t1 <> n"),
        "empty_chunk": chunks.where("coalesce(trim(chunk_text), '') = ''"),
        "document_without_chunk": parents.join(chunks, "document_id", "left_anti"),
    }


def evaluation_checks(cases: DataFrame, documents: DataFrame, indexed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every method sees the same documents, each once a condition, with the same input; nothing of the index is tested."""
    out = {
        "case_repeats": cases.groupBy("method", "document_id", "condition").agg(F.count("*").alias("n")).where("n > 1"),
        "unknown_document": cases.join(documents, "document_id", "left_anti"),
        "document_not_evaluated": documents.join(cases, "document_id", "left_anti"),
        "input_differs": cases.groupBy("document_id", "condition").agg(F.count_distinct("input_fingerprint").alias("n")).where("n > 1"),
    }
    if indexed is not None:
        out["test_document_in_index"] = indexed.join(documents, "document_id", "left_semi")
    return out


def selection_checks(selected: DataFrame) -> dict[str, DataFrame]:
    return {"index_repeats": selected.where("size(array_distinct(selected)) <> size(selected)")}


def weight_checks(weighted: DataFrame) -> dict[str, DataFrame]:
    return {"weights_do_not_sum_to_one": weighted.groupBy("document_id").agg(F.round(F.sum("weight"), 9).alias("s")).where("s <> 1")}


def overlap_checks(split: DataFrame, key: str) -> dict[str, DataFrame]:
    """Keys that each pair of splits shares."""
    own = lambda name: split.where(F.col("split") == name).select(key).distinct()
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    return {f"{a}_{b}_{key}": own(a).intersect(own(b)) for a, b in pairs}


def index_checks(indexed: DataFrame, split: DataFrame, excluded: DataFrame) -> dict[str, DataFrame]:
    """Whatever an index of training chunks must not hold. indexed: document_id, effective_family_id; split: those and split."""
    docs, families = indexed.select("document_id").distinct(), indexed.select("effective_family_id").distinct()
    of = lambda name, key: split.where(F.col("split") == name).select(key).distinct()
    known = split.select("document_id", "effective_family_id").distinct()
    return {
        "indexed_not_in_train": docs.join(of("train", "document_id"), "document_id", "left_anti"),
        **{f"{name}_{kind}_indexed": keys.join(of(name, key), key, "left_semi") for name in ("validation", "test") for kind, keys, key in (("document", docs, "document_id"), ("family", families, "effective_family_id"))},
        "excluded_document_indexed": docs.join(excluded.select("document_id"), "document_id", "left_semi"),
        "metadata_differs": indexed.select("document_id", "effective_family_id").distinct().join(known, ["document_id", "effective_family_id"], "left_anti"),
    }


def changed(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that have another value after than before, or stand on one side only."""
    one, two = before.select(*keys, F.col(value).alias("was")), after.select(*keys, F.col(value).alias("is"))
    return one.join(two, keys, "full_outer").where(~F.col("was").eqNullSafe(F.col("is")))


def masked_index_checks(plain: DataFrame, hidden: DataFrame) -> dict[str, DataFrame]:
    """A masked index holds what the masking rules make of the plain one, and nothing that they would still find. plain: document_id, text; hidden: document_id, masked_text."""
    # texts are compared by their hashes, so they are not sent
    print_ = F.sha2("masked_text", 256).alias("masked_text")
    want = masked(plain.select("document_id", "text"), "text").select("document_id", print_)
    again = masked(hidden.select("document_id", F.col("masked_text").alias("text")), "text")
    return {"masked_text_differs": changed(want, hidden.select("document_id", print_), ["document_id"], "masked_text"), "identifier_in_masked_text": again.where("total_replacements > 0")}


def rebuild_checks(queries: DataFrame, registry: DataFrame, prints: tuple[DataFrame, DataFrame], orders: tuple[DataFrame, DataFrame], stores: tuple[DataFrame, DataFrame]) -> dict[str, DataFrame]:
    """Queries are the registry's texts, and a rebuild (each pair: before, after) changes nothing. queries, registry: document_id, text_fingerprint; prints, stores: name, fingerprint; orders: query_id, place, chunk_id."""
    known = registry.join(queries.select("document_id"), "document_id", "left_semi")
    return {
        "query_fingerprint_differs": changed(known, queries, ["document_id"], "text_fingerprint"),
        "corpus_fingerprint_differs": changed(*prints, ["name"], "fingerprint"),
        "retrieval_order_differs": changed(*orders, ["query_id", "place"], "chunk_id"),
        "older_store_changed": changed(*stores, ["name"], "fingerprint"),
    }


def policy_checks(cases: DataFrame, split: DataFrame, excluded: DataFrame, used: DataFrame, frozen: DataFrame) -> dict[str, DataFrame]:
    """What is tested has no part in training or validation, by document or family, and nothing excluded; and the run used what was frozen. used, frozen: name (of a checkpoint, an aggregation, a policy) and value."""
    tested = cases.select("document_id").distinct()
    families = split.join(tested, "document_id", "left_semi").select("effective_family_id").distinct()
    of = lambda name, key: split.where(F.col("split") == name).select(key).distinct()
    held = split.where(F.col("split") == "test").select("document_id")
    own = split.join(held, "document_id", "left_semi").select("effective_family_id").distinct()
    return {
        **{f"{name}_document_tested": tested.join(of(name, "document_id"), "document_id", "left_semi") for name in ("train", "validation")},
        **{f"{name}_family_tested": families.intersect(own).join(of(name, "effective_family_id"), "effective_family_id", "left_semi") for name in ("train", "validation")},
        "excluded_document_tested": tested.join(excluded.select("document_id"), "document_id", "left_semi"),
        "frozen_setting_differs": changed(frozen, used, ["name"], "value"),
    }


def held_out_checks(cases: DataFrame, split: DataFrame, methods: list[str], conditions: list[str]) -> dict[str, DataFrame]:
    """A test run covers the test split, all of it and nothing else, in each condition, with known labels and confidences."""
    tested = split.where(F.col("split") == "test").select("document_id")
    every = lambda names: F.explode(F.array(*(F.lit(x) for x in names)))
    wanted = tested.withColumn("method", every(methods)).withColumn("condition", every(conditions))
    done = cases.select("method", "document_id", "condition")
    return {
        "document_outside_test": done.join(tested, "document_id", "left_anti"),
        "unknown_condition": done.where(~F.col("condition").isin(conditions)),
        "case_missing": wanted.join(done, ["method", "document_id", "condition"], "left_anti"),
        "case_repeats": done.groupBy("method", "document_id", "condition").agg(F.count("*").alias("n")).where("n > 1"),
        "success_without_label": cases.where("status = 'success' AND predicted_label IS NULL"),
        "confidence_out_of_range": cases.where("confidence < 0 OR confidence > 1 OR isnan(confidence)"),
        "true_label_differs": cases.groupBy("document_id").agg(F.count_distinct("true_label").alias("n")).where("n > 1"),
    }


def declared_inputs(names: list[str], banned: tuple[str, ...] = ("test",)) -> list[str]:
    """The declared inputs of a training step that name a held-out split."""
    return [n for n in names if any(b in n.lower() for b in banned)]


def agree(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.coalesce(F.abs(a - b) < tolerance, a.isNull() & b.isNull())
