"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.shared import checkpoint_dir, discard, materialise

__all__ = ["WORD", "checkpoint_dir", "discard", "documents", "materialise", "shuffle_width", "text_of"]

#: Words are maximal runs of anything but ASCII white space; bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
