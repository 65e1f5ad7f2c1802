"""A result cache that several writers add to at a time.

A writer writes its rows aside and commits them by renaming the folder to the next free number; a rename
onto a number that another writer has taken fails, and the next number is tried. So a
reader sees whole parts only, in one order for all, and of rows with equal keys the one of the
first part counts, whatever was committed later.

Defined cases: rows without a key are not kept; of equal keys within a part the least row
counts; an empty part is none; a cache that was never written is empty.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


def _names(spark: SparkSession, base: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def parts(spark: SparkSession, base: str) -> list[int]:
    """The numbers of the committed parts."""
    return [int(n.removeprefix("part=")) for n in _names(spark, base) if n.startswith("part=")]


def commit(rows: DataFrame, base: str, key: str = "cache_key") -> int | None:
    """Adds rows to the cache; the number of the part, or None for no rows."""
    spark = rows.sparkSession
    aside = f"{base}/_{uuid.uuid4().hex}"
    once = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("row")).select(key, "row.*")
    once.write.parquet(aside)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    if not spark.read.schema(once.schema).parquet(aside).head(1):
        path(aside).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(aside), True)
        return None
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(aside).toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    number = max(parts(spark, base), default=-1) + 1
    while True:
        try:
            files.rename(path(aside), path(f"{base}/part={number}"), never)
            return number
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()) + str(e.java_exception.getCause()):
                raise
            number += 1


def cached(spark: SparkSession, base: str, schema: StructType, key: str = "cache_key") -> DataFrame:
    """The rows of the committed parts, each key once, and the part it came from."""
    known = parts(spark, base)
    if not known:
        return spark.createDataFrame([], StructType([*schema.fields]).add("part", LongType()))
    rows = spark.read.schema(StructType([*schema.fields]).add("part", LongType())).option("basePath", base).parquet(*(f"{base}/part={n}" for n in known))
    return rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), "part").alias("row")).select(key, "row.*").select(*rows.columns)


def missing(wanted: DataFrame, base: str, schema: StructType, key: str = "cache_key") -> DataFrame:
    """What is wanted and not cached yet, each key once."""
    return wanted.dropDuplicates([key]).join(cached(wanted.sparkSession, base, schema, key).select(key), key, "left_anti")
