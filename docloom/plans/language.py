"""A language detector: naive Bayes over character trigrams, fitted on labelled rows and applied to whole texts.

The model is bounded by its number of languages and features, whatever the corpus: trigrams are hashed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(text: str, width: int) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) < 3:
        return np.zeros(width)
    h = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)) >> np.uint64(5)
    return np.bincount((h % np.uint64(width)).astype(np.int64), minlength=width).astype(np.float64)


def fit(labelled: DataFrame, width: int = 4096) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods) from (text, lang). Counts are summed per partition before they are shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                sums[lang] = sums.get(lang, np.zeros(width)) + _features(text, width)
        for lang, v in sums.items():
            places = np.flatnonzero(v)
            yield pd.DataFrame({"lang": lang, "place": places, "n": v[places]})

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInPandas(run, "lang string, place long, n double").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()  # languages x width at most
    languages = sorted(rows["lang"].unique())
    table = np.ones((len(languages), width))
    for i, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        table[i, own["place"].to_numpy()] += own["n"].to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def detect(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(document_id, detected_language, language_confidence, mixed): mixed if the halves of a text differ."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = model[1].shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, table = shared.value

        def best(text: str) -> tuple[str, float]:
            scores = table @ _features(text, width)
            p = np.exp(scores - scores.max())
            return languages[int(scores.argmax())], float(p.max() / p.sum())

        for frame in frames:
            out = []
            for key, text in zip(frame["document_id"], frame["text"], strict=True):
                text = text or ""
                half = len(text) // 2
                mixed = half >= 30 and best(text[:half])[0] != best(text[half:])[0]
                out.append((key, *best(text), mixed))
            yield pd.DataFrame(out, columns=["document_id", "detected_language", "language_confidence", "mixed"])

    return docs.select("document_id", "text").mapInPandas(run, "document_id string, detected_language string, language_confidence double, mixed boolean")
