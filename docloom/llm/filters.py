"""A Bloom filter of hashes as one array value, in DataFrame functions only.

Its size follows the number of hashes up to a ceiling, so what is sent to all
executors is bounded; beyond the ceiling more rows pass, and none is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """16 bits for each hash, least_bits at least and most_bits at most (powers of two); probes: bits looked at for a hash."""

    least_bits: int = 1 << 21
    most_bits: int = 1 << 25
    probes: int = 2


def _bits(h: Column, n_bits: Column, p: Filter) -> list[Column]:
    """The places of a hash in the filter."""
    return [F.shiftright(h, 24 * i).bitwiseAND(n_bits - 1) for i in range(p.probes)]


def bloom(hashes: DataFrame, p: Filter) -> DataFrame:
    """One row: the filter of the hashes (column hash) as an array of 64-bit words."""
    wanted = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.count("*") * 16, F.lit(1))))).cast("long")
    sized = hashes.agg(F.least(F.greatest(wanted, F.lit(p.least_bits)), F.lit(p.most_bits)).alias("n_bits"))
    bits = hashes.select(F.explode(F.array(*_bits(F.col("hash"), sized.scalar(), p))).alias("bit"))
    filled = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word"))
    # groups of 1024 words first, so that no row is built from more than a few thousand others
    dense = sized.select(F.explode(F.sequence(F.lit(0), (F.col("n_bits") / 64 - 1).cast("int"))).alias("place")).join(filled, "place", "left").select("place", F.coalesce("word", F.lit(0)).alias("word"))
    grouped = dense.groupBy(F.floor(F.col("place") / 1024).alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("words"))
    return grouped.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group", "words"))), lambda x: x["words"])).alias("filter"))


def passes(h: Column, filter_: Column, p: Filter) -> Column:
    n_bits = F.size(filter_).cast("long") * 64
    return reduce(lambda a, b: a & b, [F.call_function("getbit", F.get(filter_, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1 for bit in _bits(h, n_bits, p)])
