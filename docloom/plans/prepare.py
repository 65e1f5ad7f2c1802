"""The data pipeline: audit, families, split, chunks, masks, registry. Lazy throughout; sinks and checks are the only actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import checks, chunks, corpus, splitting


@dataclass
class Prepared:
    audit: DataFrame
    eligible: DataFrame
    assignment: DataFrame
    split: DataFrame
    chunks: DataFrame
    registry: DataFrame

    def checks(self) -> DataFrame:
        return checks.report(checks.split_checks(self.eligible, self.split) | checks.chunk_checks(self.split, self.chunks))


def prepare(source: DataFrame, overrides: DataFrame, window: int = 510, overlap: int = 128) -> Prepared:
    """source: document_id, text, agency, filename, form_number, detected_language, language_confidence."""
    decided = corpus.language_decision(source, F.col("detected_language"), F.col("language_confidence"), F.lit(False))
    audit = corpus.apply_overrides(corpus.assign_families(decided), overrides)
    eligible = audit.where(F.col("final_modeling_eligibility") == "include_english_corpus")
    assignment = splitting.family_split(eligible)
    split = splitting.split_documents(eligible, assignment)
    cut = chunks.chunk(split.select("document_id", "text", "effective_agency", "effective_family_id", "split"), window, overlap)
    return Prepared(audit, eligible, assignment, split, cut, chunks.registry(split.select("document_id", "text"), cut))
