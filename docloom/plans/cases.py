"""Cases for a classifier behind an API: cache, retries, statuses, retrieval context.

A provider is any callable from a prompt to (label, confidence, prompt tokens, completion tokens); it may raise. It
is called inside tasks. Calls that cost money should run with speculation off, and results are kept by cache key,
so that a rerun only asks for what is missing.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.corpus import LABELS

Provider = Callable[[str], tuple[str, float, int, int]]
RESULT = "cache_key string, predicted_label string, confidence double, status string, error_type string, attempt_count int, prompt_tokens int, completion_tokens int, raw_response_hash string, latency_ms double"
PROMPT = "Classify the document into one of {labels}.\n{context}\nDocument:\n{document}"


def case_keys(registry: DataFrame, method: str, model: str, prompt: str = PROMPT, context: str | None = None) -> DataFrame:
    """cache_key, prompt and truncated beside (document_id, condition, text, text_fingerprint). The condition is part of the key."""
    text, cut = T.truncated(F.col("text"))
    shown = F.col(context) if context else F.lit("")
    key = T.joined_hash(F.lit(method), F.lit(model), F.lit(hashlib.sha256(prompt.encode()).hexdigest()), F.col("document_id"), F.col("condition"), F.col("text_fingerprint"), T.sha256(shown))
    return registry.withColumns({"method": F.lit(method), "cache_key": key, "prompt": T.render(prompt, {"labels": F.lit(", ".join(LABELS)), "context": shown, "document": text}), "truncated": cut})


def context_text(chunks: DataFrame) -> DataFrame:
    """(query_id, context) from (query_id, new_place, text), without labels."""
    listed = F.array_sort(F.collect_list(F.struct("new_place", "text")))
    return chunks.groupBy("query_id").agg(listed.alias("l")).select("query_id", F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["new_place"].cast("string"), F.lit("] "), x["text"])), "\n\n").alias("context"))


def labelled_context(chunks: DataFrame) -> DataFrame:
    """(query_id, context) from (query_id, new_place, agency, text), with the labels that the older classifier shows."""
    listed = F.array_sort(F.collect_list(F.struct("new_place", "agency", "text")))
    line = lambda x: F.concat(x["new_place"].cast("string"), F.lit(". Agency: "), x["agency"], F.lit("\n   Excerpt: "), x["text"])
    return chunks.groupBy("query_id").agg(listed.alias("l")).select("query_id", F.array_join(F.transform("l", line), "\n").alias("context"))


def guidance_prompts(routed: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """(document_id, prompt) from (document_id, agency, text): each agency's own template; null for an agency without one."""
    filled = F.lit(None).cast("string")
    for agency, prompt in prompts.items():
        filled = F.when(F.col("agency") == agency, T.render(prompt, {"document": F.col("text")})).otherwise(filled)
    return routed.select("document_id", filled.alias("prompt"))


def run_cases(cases: DataFrame, provider: Provider, attempts: int = 3, backoff: float = 2.0) -> DataFrame:
    """A result for each case. Retryable errors are tried again, waiting twice as long each time; an answer that is no label is invalid and final."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, prompt in zip(frame["cache_key"], frame["prompt"], strict=True):
                began, status, error, label, confidence, used = time.time(), "failed", None, None, None, (None, None)
                for attempt in range(1, attempts + 1):
                    try:
                        label, confidence, *used = provider(prompt)
                        status = "success" if label in LABELS else "invalid_response"
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = type(e).__name__
                        if not any(s in str(e).lower() for s in T.RETRYABLE) or attempt == attempts:
                            break
                        time.sleep(backoff * 2 ** (attempt - 1))
                raw = hashlib.sha256(str(label).encode()).hexdigest() if label is not None else None
                out.append((key, label if status == "success" else None, confidence, status, error, attempt, *used, raw, 1000 * (time.time() - began)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"prompt_tokens": "Int32", "completion_tokens": "Int32"})

    return cases.select("cache_key", "prompt").dropDuplicates(["cache_key"]).mapInPandas(run, RESULT)


def resume(cases: DataFrame, stored: DataFrame, provider: Provider, **options) -> DataFrame:
    """Results for all cases: those stored, and new ones for the rest."""
    missing = cases.join(stored.select("cache_key"), "cache_key", "left_anti")
    return stored.unionByName(run_cases(missing, provider, **options))


def embed(texts: DataFrame, width: int = 64) -> DataFrame:
    """(text_hash, vector) of each distinct text: a deterministic stand-in for a model, of hashed words at unit length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            vectors = []
            for text in frame["text"]:
                v = np.zeros(width)
                for w in text.lower().split():
                    h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                    v[h % width] += 1.0 if h >> 32 & 1 else -1.0
                n = np.linalg.norm(v)
                vectors.append((v / n if n else v).tolist())
            yield pd.DataFrame({"text_hash": frame["text_hash"], "vector": vectors})

    once = texts.select(T.sha256(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text_hash"])
    return once.mapInPandas(run, "text_hash string, vector array<double>")
