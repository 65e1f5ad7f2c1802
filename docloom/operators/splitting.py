"""Leakage-safe splits: whole families, by the largest deficit."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.shared import materialise

SPLITS = ["train", "validation", "test"]
RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def seeded_key(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def _placed(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """df with "seeded place", from 0 in the order of seeded hashes within each group of by, and "seeded group", the group's rows.

    Places are counted within ranges of the hash, so that no task orders a whole group, and the ranges before are added.
    A null key comes first; nulls in by are a group."""
    hashed = df.withColumn("seeded hash", seeded_key(F.col(key), seed))
    hashed = hashed.withColumn("hash range", F.coalesce(F.conv(F.substring("seeded hash", 1, 3), 16, 10).cast("int"), F.lit(0)))
    of = [f"of {c}" for c in by]
    counts = hashed.groupBy(*(F.col(c).alias(o) for c, o in zip(by, of, strict=True)), F.col("hash range").alias("of range")).agg(F.count("*").alias("n"))
    group = W.partitionBy(*of)
    counts = counts.withColumns({"before": F.sum("n").over(group.orderBy("of range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"), "seeded group": F.sum("n").over(group)}).drop("n")
    inside = hashed.withColumn("in range", F.row_number().over(W.partitionBy(*by, "hash range").orderBy("seeded hash", key)) - 1)
    same = F.col("hash range") == F.col("of range")
    for c, o in zip(by, of, strict=True):
        same &= inside[c].eqNullSafe(counts[o])
    return inside.join(counts, same).withColumn("seeded place", F.col("in range") + F.col("before")).drop("seeded hash", "hash range", "in range", "of range", "before", *of)


def deal(lack: dict[str, Fraction], size: int, count: int) -> tuple[list[str], int, int, list[int]]:
    """How count families of one size go, one after the other, to the split that lacks most: (order, alone, pair, taken).

    By falling lack the splits are a, b, c. The first `alone` families go to a, until b lacks as much. Then b and a
    take turns, up to `pair` families in all, until c lacks as much; from there c, then the other two as their turn
    comes, over and over. Equal lacks go to the split named first. taken: the families of a, b and c."""
    names = list(lack)
    a, b, c = order = sorted(names, key=lambda s: (-lack[s], names.index(s)))

    def ahead(s: str, of: str) -> int:
        """Families that s takes before of takes its first."""
        steps = (lack[s] - lack[of]) / size
        return int(steps) + 1 if steps.denominator > 1 or names.index(s) < names.index(of) else int(steps)

    alone, pair = ahead(a, b), ahead(a, c) + ahead(b, c)
    one, two = min(alone, count), max(min(pair, count) - alone, 0)
    full, rest = divmod(max(count - pair, 0), 3)
    turn = [1, 0] if (pair - alone) % 2 == 0 else [0, 1]
    taken = [one + two // 2 + full, (two + 1) // 2 + full, full + (rest > 0)]
    if rest > 1:
        taken[turn[0]] += 1
    return order, alone, pair, taken


def family_split(eligible: DataFrame, seed: int = 42, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(effective_agency, effective_family_id, doc_count, split).

    Within an agency families come largest first, then by seeded hash. With three or more, the first goes to test
    and the second to validation; with two, the first to test; all others to the split that lacks most.
    Only the counts of families of one size are gone through in order (deal()); different sizes of an agency with D
    documents are at most the square root of 2 D. A family's split follows from its place among those of its size,
    as a column expression. A table without rows gives none; nulls are an agency, or a family of it, like others."""
    sizes = materialise(eligible.groupBy("effective_agency", "effective_family_id").agg(F.count("*").alias("doc_count")), "sizes")
    runs = sizes.groupBy("effective_agency", "doc_count").agg(F.count("*").alias("families"))
    totals = runs.groupBy(F.col("effective_agency").alias("of")).agg(F.sum(F.col("doc_count") * F.col("families")).cast("double").alias("total"), F.sum("families").alias("all"))
    ordered = runs.join(totals, F.col("effective_agency").eqNullSafe(F.col("of"))).drop("of").repartition("effective_agency").sortWithinPartitions("effective_agency", F.desc("doc_count"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, lack = object(), 0, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["effective_agency"] != now:
                    now, at = row["effective_agency"], 0
                    lack = {s: Fraction(row["total"] * ratios[s]) for s in SPLITS}
                size, count = row["doc_count"], row["families"]
                given = (["test"] if row["all"] >= 2 else []) + (["validation"] if row["all"] >= 3 else [])
                given = given[at : at + count]
                for split in given:
                    lack[split] -= size
                order, alone, pair, taken = deal(lack, size, count - len(given))
                for split, n in zip(order, taken, strict=True):
                    lack[split] -= n * size
                at += count
                out.append({"run_agency": now, "run_size": size, "given": given, "order": order, "alone": alone, "pair": pair})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("run_agency", pa.string()), ("run_size", pa.int64()), ("given", pa.list_(pa.string())), ("order", pa.list_(pa.string())), ("alone", pa.int64()), ("pair", pa.int64())])
    dealt = materialise(ordered.mapInArrow(go, "run_agency string, run_size bigint, given array<string>, order array<string>, alone bigint, pair bigint"), "dealt")
    placed = _placed(sizes, ["effective_agency", "doc_count"], "effective_family_id", seed)
    joined = placed.join(dealt, F.col("effective_agency").eqNullSafe(F.col("run_agency")) & (F.col("doc_count") == F.col("run_size")))
    i = F.col("seeded place") - F.size("given")
    turn = ((F.col("pair") - F.col("alone")) % 2).cast("int")
    in_pair = ((i - F.col("alone") + 1) % 2).cast("int")
    in_three = ((i - F.col("pair")) % 3).cast("int")
    chosen = F.when(i < F.col("alone"), 0).when(i < F.col("pair"), in_pair).when(in_three == 0, 2).when(in_three == 1, 1 - turn).otherwise(turn)
    split = F.when(i < 0, F.try_element_at("given", (F.col("seeded place") + 1).cast("int"))).otherwise(F.try_element_at("order", chosen + 1))
    return joined.select("effective_agency", "effective_family_id", "doc_count", split.alias("split"))


def split_documents(eligible: DataFrame, assignment: DataFrame) -> DataFrame:
    """Each document with its family's split; a family without one is an error."""
    out = eligible.join(assignment.select("effective_family_id", "split"), "effective_family_id", "left")
    return out.withColumn("split", F.coalesce("split", F.raise_error(F.concat(F.lit("no split for family "), "effective_family_id")).cast("string")))


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42, ratios: dict[str, float] | None = None) -> DataFrame:
    """A document-level split with the same shares in every class, by seeded hash order."""
    ratios = ratios or {"train": 0.64, "validation": 0.16, "test": 0.20}
    joined = _placed(df, [label], key, seed)
    share = F.col("seeded place") / F.col("seeded group")
    split = F.when(share < ratios["train"], "train").when(share < ratios["train"] + ratios["validation"], "validation").otherwise("test")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c != "split"), split.alias("split"))


def split_report(assignment: DataFrame) -> DataFrame:
    """Documents and families of each split and agency, those with none included."""
    cells = assignment.select("effective_agency").distinct().select("effective_agency", F.explode(F.array(*(F.lit(s) for s in SPLITS))).alias("split"))
    counts = assignment.groupBy("effective_agency", "split").agg(F.sum("doc_count").alias("documents"), F.count("*").alias("families"))
    out = cells.join(counts, ["effective_agency", "split"], "left").na.fill(0, ["documents", "families"])
    return out.withColumn("percentage", F.round(F.coalesce(F.try_divide(100.0 * F.col("documents"), F.sum("documents").over(W.partitionBy("effective_agency"))), F.lit(0.0)), 6))


def leaking_families(docs: DataFrame, family: str = "effective_family_id", split: str = "split") -> DataFrame:
    """Families that stand in more than one split."""
    return docs.groupBy(family).agg(F.count("*").alias("documents"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).where(F.contains("splits", F.lit(",")))


def missing_by_split(assignment: DataFrame) -> DataFrame:
    cells = assignment.select("effective_agency").distinct().select("effective_agency", F.explode(F.array(*(F.lit(s) for s in SPLITS))).alias("split"))
    return cells.join(assignment, ["effective_agency", "split"], "left_anti")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 over all rows in order, independent of how they are stored. The rows meet in one value: for manifests of bounded size; beyond that take fingerprint_at_scale()."""
    row = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in columns))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat_ws("|", *(r[c] for c in columns))), "\n")
    return df.agg(F.sha2(joined, 256).alias("fingerprint"))


def fingerprint_at_scale(df: DataFrame, columns: list[str], buckets: int = 4096) -> DataFrame:
    """Another fingerprint of the same rows: per bucket of row hashes their count and sums, then the hash of the buckets. No row holds more than a bucket list."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns)), 256)
    part = lambda i: F.conv(F.substring("row", i, 12), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("row")).groupBy((F.conv(F.substring("row", 1, 8), 16, 10).cast("bigint") % buckets).alias("bucket")).agg(F.count("*").alias("n"), F.sum(part(9)).alias("x"), F.sum(part(21)).alias("y"))
    return fingerprint(sums, ["bucket", "n", "x", "y"])
