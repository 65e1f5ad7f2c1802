"""Exact percentiles by repeated range counts: no buffer and no task holds a group's values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.shared import discard, materialise


def _part(value: str, low: str, high: str, parts: int) -> Column:
    """The number of the part of low to high that a value lies in, for low < high: never falls as values grow, is 0 at low and the last at high. Halves where the width itself is not finite."""
    v, a, b = F.col(value), F.col(low), F.col(high)
    share = F.when(b - a < math.inf, (v - a) / (b - a)).otherwise((v / 2 - a / 2) / (b / 2 - a / 2))
    return F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int")


def _same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs.items():
        out &= left[a].eqNullSafe(right[b])
    return out


def percentiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float], parts: int = 4096) -> DataFrame:
    """One row of each group of by that has values (one row where by is empty), with a column for each of the shares,
    linear between the two values next to its place.

    Each pass counts values in equal parts of the ranges in question, and goes on within the part that holds the place,
    from its least to its greatest value, until these are equal. After the first pass only values near a place are
    counted. What is kept of a pass are parts a range at most; ranges are one or two for each share and group, places
    in one range share it. Nulls are left out; a group of nulls alone has no row, a null in by is a group like others.
    Repeated values are one range of no width. A value that is not finite is an error. A table without rows gives none.
    """
    keys = [f"by {i}" for i in range(max(len(by), 1))]
    of = [F.col(c) for c in by] or [F.lit(0)]
    x = value.cast("double")
    x = F.when(x.isNull() | (F.abs(x) < math.inf), x).otherwise(F.raise_error(F.lit("percentiles need finite values")).cast("double"))
    values = materialise(df.select(*(c.alias(k) for c, k in zip(of, keys, strict=True)), x.alias("x")).where(F.col("x").isNotNull()), "values")
    first = values.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("inside"))
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("share")) for n, q in shares.items()))
    at = F.col("share") * (F.col("inside") - 1)
    asked = first.select("*", F.inline(names)).withColumn("at", at).select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place"))
    # place: from the range's first value; a place within a range is told by its distance from the true one
    open_ = materialise(asked.select(*keys, "name", "at", F.col("place").alias("wanted"), "place", "low", "high"), "places")
    done = []
    while True:
        done.append(open_.where("low = high").select(*keys, "name", "at", "wanted", F.col("low").alias("value")))
        wide = open_.where("low < high")
        if wide.isEmpty():
            break
        ranges = wide.select(*(F.col(k).alias(f"r {k}") for k in keys), "low", "high").distinct()
        inside = values.join(ranges, _same(values, ranges, {k: f"r {k}" for k in keys}) & values["x"].between(ranges["low"], ranges["high"]))
        group = [f"r {k}" for k in keys] + ["low", "high"]
        counts = inside.withColumn("part", _part("x", "low", "high", parts)).groupBy(*group, "part").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("n").over(W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
        counts = counts.withColumn("upto", upto).withColumnsRenamed({"low": "r low", "high": "r high"})
        found = wide.join(counts, _same(wide, counts, {k: f"r {k}" for k in [*keys, "low", "high"]}) & (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        open_ = materialise(found.select(*keys, "name", "at", "wanted", (F.col("place") - (F.col("upto") - F.col("n"))).alias("place"), F.col("least").alias("low"), F.col("most").alias("high")), "places")
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionAll(more)
    ends = materialise(ends, "ends")
    discard(values)
    near = F.when(F.col("wanted") == F.floor("at"), F.floor("at") + 1 - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    # equal ends give their value itself, without rounding
    between = F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(F.sum(F.col("value") * F.col("near")))
    each = ends.withColumn("near", near).groupBy(*keys, "name").agg(between.alias("value"))
    wide = each.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in shares))
    return wide.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=False)), *shares)


def with_percentiles(grouped: DataFrame, df: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """grouped, one row for each group of by in df, with its percentiles, rounded to six digits; null for groups without values."""
    found = percentiles(df, by, value, shares)
    found = found.select(*(F.col(c).alias(f"of {c}") for c in by), *(F.round(n, 6).alias(n) for n in shares))
    return grouped.join(found, _same(grouped, found, {c: f"of {c}" for c in by}), "left").drop(*(f"of {c}" for c in by))
