"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask is laid over a run of words and the words at its ones are hashed, so
that a hash survives substitutions at its zeros. The masks depend on the length
of the item, and each way to substitute as many words as an overlap may differ in
leaves one of them intact (see missed_patterns), so no overlap is lost. Hashes of
the benchmark and of the documents meet in a join; around each hit the words are
compared, and a window of enough equal words at the same offset is an overlap.

Document hashes reach the join only if they pass a Bloom filter of the
benchmark's hashes. The filter is an array whose size follows the number of
hashes up to a ceiling, and is the only thing that is sent to
all executors; the join itself is left to the planner, which may split hot hashes.

Defined cases: texts are lower-cased and words are runs of letters and digits; null and
empty texts have none and never overlap; items of under five words are hit by
exact copies only; repeated items and documents give a row for each id once;
very long texts are taken whole, a row per word; only the named columns are read,
so others may have any name; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise
from docloom.llm.filters import Filter, bloom, passes


@dataclass(frozen=True)
class Seeds:
    """masks: for the shortest items; longer: (least words of an item, its masks), ascending, the last that fits an item holds. Masks begin and end with a one.
    An overlap is a window of so many words (or the whole item, if it is shorter) with a share of equal ones. Other windows or shares need other masks."""

    masks: tuple[str, ...] = ("1",)
    longer: tuple[tuple[int, tuple[str, ...]], ...] = (
        (2, ("11",)), (3, ("111",)), (4, ("1111",)), (5, ("11",)), (6, ("111",)), (8, ("1111",)), (10, ("111",)), (12, ("1111",)),
        (15, ("1111011", "11001000111", "11010110001")),
    )
    window: int = 16
    share: float = 0.8
    filter: Filter = field(default_factory=Filter)

    @property
    def span(self) -> int:
        return len(self.masks[0])

    @property
    def classes(self) -> list[tuple[int, tuple[str, ...]]]:
        return [(0, self.masks), *self.longer]

    @property
    def all_masks(self) -> list[str]:
        """Those for long items, which most benchmarks have, come first."""
        return list(dict.fromkeys(m for _, masks in reversed(self.classes) for m in masks))


def missed_patterns(seeds: Seeds, length: int) -> list[tuple[int, ...]]:
    """The ways to substitute words of an item (or, from seeds.window words on, of a window of one) that make an overlap but leave no mask intact."""
    n = min(length, seeds.window)
    masks = [masks for least, masks in seeds.classes if least <= length][-1]
    placed = [{at + j for j, one in enumerate(m) if one == "1"} for m in masks for at in range(n - len(m) + 1)]
    return [gone for gone in combinations(range(n), n - ceil(n * seeds.share)) if not any(ones.isdisjoint(gone) for ones in placed)]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _seed_hash(words: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(words, at + j) for j, one in enumerate(mask) if one == "1"))


def _around(words: Column, at: Column, seeds: Seeds) -> Column:
    """The words of each window that holds the start of a seed; null beyond the ends."""
    reach = seeds.window - 1
    return F.array(*(F.get(words, F.when(at + j >= 0, at + j)) if j < 0 else F.get(words, at + j) for j in range(-reach, reach + 1)))


def item_seeds(items: DataFrame, seeds: Seeds, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(hash, mask, item, item_words, item_near) for each seed of each item."""
    words = items.select(F.col(id_column).alias("item"), words_of(F.col(text_column)).alias("words")).select("*", F.size("words").alias("item_words"))
    rows = words.select("item", "words", "item_words", F.posexplode("words").alias("at", "word"))
    at, n, made = F.col("at"), F.col("item_words"), []
    ends = [least for least, _ in seeds.longer] + [None]
    for (least, masks), end in zip(seeds.classes, ends, strict=True):
        own = (n >= least) & (F.lit(True) if end is None else n < end)
        made += [F.when(own & (at + len(m) <= n), F.struct(F.lit(seeds.all_masks.index(m)).alias("mask"), _seed_hash(F.col("words"), at, m).alias("hash"))) for m in masks]
    found = rows.select("item", "item_words", _around(F.col("words"), at, seeds).alias("item_near"), F.explode(F.array(*made)).alias("seed")).where(F.col("seed").isNotNull())
    return found.select("item", "item_words", "item_near", "seed.mask", "seed.hash")


def overlaps(docs: DataFrame, items: DataFrame, seeds: Seeds | None = None, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(id, item, equal_words) for each document and item that overlap."""
    seeds = seeds or Seeds()
    # both are small, follow the benchmark, and are used in several places of the plan
    table = materialise(item_seeds(items, seeds, item_column, item_text_column), "seeds")
    filter_ = materialise(bloom(table.select("hash"), seeds.filter), "filter").scalar()

    def hits_of(some: DataFrame, masks: list[str]) -> DataFrame:
        rows = some.select(F.col(id_column).alias("key"), words_of(F.col(text_column)).alias("words")).select("key", "words", F.posexplode("words").alias("at", "word"))
        # generating the hashes, one row each, has them computed once, before the filter looks at them
        hashes = F.array(*(_seed_hash(F.col("words"), F.col("at"), m) for m in masks))
        return rows.select("key", "words", "at", F.explode(hashes).alias("hash")).where(passes(F.col("hash"), filter_, seeds.filter)).select("key", _around(F.col("words"), F.col("at"), seeds).alias("near"), "hash")

    # the masks of the longest items are always laid; others in a branch of their own (all masks in one are too much code to compile), which has no rows unless the benchmark has items for them
    usual = len(seeds.classes[-1][1])
    near = hits_of(docs, seeds.all_masks[:usual])
    if seeds.all_masks[usual:]:
        rare = table.agg(F.coalesce(F.max("mask"), F.lit(0)).alias("mask")).scalar() >= usual
        near = near.unionByName(hits_of(docs.where(rare), seeds.all_masks[usual:]))
    equal = F.zip_with("near", "item_near", lambda a, b: F.when(a == b, 1).otherwise(0))
    # each window with the seed's start; those of a long item that go beyond its ends have no more equal words than one within
    best = F.greatest(*(F.aggregate(F.slice("equal", i + 1, seeds.window), F.lit(0), lambda s, x: s + x) for i in range(seeds.window)), F.lit(0))
    hits = near.join(table, "hash").select("key", "item", "item_words", equal.alias("equal")).select("key", "item", "item_words", best.alias("equal_words"))
    hits = hits.where(F.col("equal_words") >= F.ceil(F.least(F.lit(seeds.window), F.col("item_words")) * F.lit(seeds.share)))
    return hits.groupBy("key", "item").agg(F.max("equal_words").cast("long").alias("equal_words")).select(F.col("key").alias(id_column), F.col("item").alias(item_column), "equal_words")


def contaminated(docs: DataFrame, items: DataFrame, seeds: Seeds | None = None, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(id, n_items, items): the documents that overlap the benchmark."""
    found = overlaps(docs, items, seeds, id_column, text_column, item_column, item_text_column)
    return found.groupBy(id_column).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(item_column)).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, seeds: Seeds | None = None, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The documents that don't overlap the benchmark, with their own columns. Documents without an id stay."""
    leaks = overlaps(docs, items, seeds, id_column, text_column, item_column, item_text_column).select(F.col(id_column).alias("leaking id")).distinct()
    return docs.join(leaks, docs[id_column] == leaks["leaking id"], "left_anti")
