"""SimHash near-duplicates: fingerprints, blocks by the pigeonhole principle, and components.

Two fingerprints that differ in d bits share at least blocks - d of their
blocks. Every choice of that many blocks is a key; fingerprints that share a
key are candidates, and their Hamming distance is verified. The work is done on
distinct fingerprints, so copies cost a row each and no pairs.

A key that more than hot_bucket fingerprints share would give the square of
their number in pairs. For those fingerprints links come from another exact
rule: x and y differ in at most two bits if, and only if, some z differs from
each in at most one. Each such fingerprint is sent to the 65 values around it,
and those that meet at a z (65 at most) are linked to the smallest among them.
Where links are to differ in one bit at most, z must be one of them.

similar_documents() goes further, to documents that share a given part of their
shingles, whose fingerprints may differ in more bits than blocks can find. There,
links from blocks and links from bands of minimum hashes are candidates alike, and
each is verified on the sets of shingles. A bucket of more than pair_bucket documents
first gives a link of each to its first one, which joins its copies; documents of
buckets that are not one component by then are joined with each other exactly, by
prefixes of their shingles, rare ones first, so that what many of them share (a
passage, a licence) makes no pairs.

Defined cases: null and empty texts have fingerprint zero, which links like any
other; a text shorter than a shingle is one shingle; repeated rows get a row
each; very long texts are taken whole; only the named columns are read, so others
may have any name; an empty table gives no rows. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import materialise, text_of
from docloom.llm.components import connected_components
from docloom.llm.filters import Filter, bloom, passes


@dataclass(frozen=True)
class SimHash:
    """shingle: words in a shingle; max_distance: bits in which linked fingerprints may differ (2 at most); blocks: into which the 64 bits are cut."""

    shingle: int = 3
    max_distance: int = 2
    blocks: int = 4
    hot_bucket: int = 48


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included; none without words, one where there are fewer words than a shingle has."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["key", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", id_column)


def _keys(fp: Column, p: SimHash) -> Column:
    """array<struct<choice, key>>: the bits of each choice of blocks - max_distance blocks."""
    edges = [round(64 * i / p.blocks) for i in range(p.blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(p.blocks)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(p.blocks), p.blocks - p.max_distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))


def near_links(fps: DataFrame, p: SimHash) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all those within max_distance of each other."""
    if not 0 <= p.max_distance <= 2 or p.blocks <= p.max_distance:
        raise ValueError("max_distance must be 0, 1 or 2, and blocks must be more")
    keys = fps.select("fp", F.explode(_keys(F.col("fp"), p)).alias("k")).select("fp", "k.choice", "k.key")
    shared = materialise(keys.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "buckets")
    members = materialise(keys.join(shared, ["choice", "key"]), "members")
    cold = members.where(F.col("n") <= p.hot_bucket)
    left, right = (cold.select("choice", "key", F.col("fp").alias(c)) for c in "ab")
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= p.max_distance
    pairs = left.join(right, ["choice", "key"]).where((F.col("a") < F.col("b")) & far).select("a", "b")
    # an overflowing shift is a signed bit pattern, as wanted here
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    hot = members.where(F.col("n") > p.hot_bucket).select("fp").distinct().select("fp", F.explode(around).alias("z"))
    met = hot.groupBy("z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select("a", F.explode("all").alias("b")).where(F.col("a") != F.col("b"))
    if p.max_distance < 2:
        stars = hot.join(fps.select(F.col("fp").alias("z")), "z").where(F.col("fp") < F.col("z")).select(F.col("fp").alias("a"), F.col("z").alias("b")).where(far)
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, p: SimHash | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id that is reached by links."""
    p = p or SimHash()
    found = materialise(fingerprints(docs, p.shingle, id_column, text_column), "fingerprints")
    firsts = materialise(found.groupBy("fp").agg(F.min(id_column).alias("first")), "firsts")
    groups = connected_components(near_links(firsts.select("fp"), p))
    known = firsts.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(known.join(materialise(smallest, "smallest"), "component").select(F.col("fp").alias("of"), "component_id"), "named")
    return found.join(named, found["fp"] == named["of"]).select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class Similarity:
    """shingle: words in a shingle; least: of the shingles of two documents, the share that both have (Jaccard's); bands of so many rows of minimum hashes; in buckets of up to pair_bucket documents all pairs are candidates, in larger ones those that prefixes leave (see similar_in_buckets)."""

    shingle: int = 5
    least: float = 0.8
    bands: int = 20
    rows: int = 6
    pair_bucket: int = 8
    blocks: SimHash = field(default_factory=lambda: SimHash(shingle=5))
    filter: Filter = field(default_factory=Filter)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key for each band, from the minimum hash in each of bands * rows bins; an empty bin borrows from the next one that is not."""
    from xxhash import xxh64_intdigest

    n = bands * rows
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, (hashes % np.uint64(n)).astype(np.int64), hashes)
    full = np.flatnonzero(np.bincount((hashes % np.uint64(n)).astype(np.int64), minlength=n))
    empty = np.setdiff1d(np.arange(n), full)
    lender = full[np.searchsorted(full, empty) % len(full)]
    least[empty] = least[lender] + ((lender - empty) % n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) - (1 << 63) for i in range(bands)]


def profiles(docs: DataFrame, p: Similarity, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, fp, same, bag, bands): the fingerprint, a name of the set of shingles, the set as 32-bit hashes, and its band keys; an empty set has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        # so many rows at a time, as each takes several times its text
        for batch in (batch.slice(at, 1000) for batch in batches for at in range(0, batch.num_rows, 1000)):
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, p.shingle)
                distinct = np.unique(hashes)
                bag = np.unique((distinct >> np.uint64(32)).astype(np.uint32)).view(np.int32)
                fp = np.array(fingerprint(hashes), dtype=np.uint64).view(np.int64).item()
                rows.append((fp, xxh64_intdigest(distinct.tobytes()) - (1 << 63), bag, band_keys(distinct, p.bands, p.rows) if len(distinct) else []))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(4)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["key", "fp", "same", "bag", "bands"])

    return docs.select(F.col(id_column).cast("long").alias("key"), text_of(text_column).alias("text")).mapInArrow(run, "key long, fp long, same long, bag array<int>, bands array<long>")


def verified(found: DataFrame, pairs: DataFrame, p: Similarity) -> DataFrame:
    """The pairs (a, b) whose sets of shingles (key, bag of found) are similar."""
    pairs = materialise(pairs, "candidates")
    # most sets have no part in any pair: they are left out before sets are sent anywhere
    filter_ = materialise(bloom(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().select(F.xxhash64("key").alias("hash")), p.filter), "filter").scalar()
    of_pairs = found.where(passes(F.xxhash64("key"), filter_, p.filter))
    bags = [of_pairs.select(F.col("key").alias(c), F.col("bag").alias(f"bag_{c}")) for c in "ab"]
    both = F.size(F.array_intersect("bag_a", "bag_b"))
    similar = both >= p.least * (F.size("bag_a") + F.size("bag_b") - both)
    return pairs.join(bags[0], "a").join(bags[1], "b").where(similar).select("a", "b")


#: Words of 64 bits for the parities of a set's parts.
PARITIES = 8


def similar_in_buckets(found: DataFrame, members: DataFrame, groups: DataFrame, p: Similarity) -> DataFrame:
    """(a, b): the similar pairs of different components (groups) among the members (key, band, bucket) of buckets that hold several.

    Similar sets share a shingle of their prefixes, beyond which what is left is too small a part of the set, whatever common order
    shingles have; rare ones come first. Nothing before the first shared one is shared, so the places of it bound what both can have.
    A pair must hold that bound at a shared shingle (at the first one if at any), and the parities of the sets in 512 parts
    by hash must differ in no more parts than similar sets have members that the other lacks; no other pair leaves the join."""
    known = members.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    known = materialise(known, "known")
    open_ = known.groupBy("band", "bucket").agg((F.min("component") != F.max("component")).alias("several")).where("several")
    left_over = materialise(known.join(open_, ["band", "bucket"]).select("key", "component").distinct(), "open")
    # one row of those that share an id, and each shingle of it with the number of documents that have it
    sets = found.join(left_over, "key").dropDuplicates(["key", "same"]).select("key", "component", F.size("bag").alias("n"), "same", F.explode("bag").alias("shingle"))
    counts = sets.groupBy("shingle").agg(F.count("*").alias("df"))
    # a shingle that one document has can't be shared, but has its place
    rank = F.row_number().over(W.partitionBy("key", "same").orderBy("df", "shingle"))
    prefix = F.col("n") - F.ceil(p.least * F.col("n") - 1e-9) + 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("shingle", 3), F.lit(64)).cast("int"))
    odd = {f"odd{k}": F.bit_xor(F.when(F.pmod("shingle", F.lit(PARITIES)) == k, bit).otherwise(F.lit(0).cast("long"))).over(W.partitionBy("key", "same")) for k in range(PARITIES)}
    first = sets.join(counts, "shingle").withColumns({"place": rank} | odd).where((F.col("place") <= prefix) & (F.col("df") > 1))
    first = materialise(first.select("key", "component", "n", "shingle", "place", *odd), "prefixes")
    left, right = (first.select("shingle", F.col("key").alias(c), F.col("component").alias(f"c_{c}"), F.col("n").alias(f"n_{c}"), F.col("place").alias(f"place_{c}"), *(F.col(o).alias(f"{o}_{c}") for o in odd)) for c in "ab")
    sized = F.least("n_a", "n_b") >= p.least * F.greatest("n_a", "n_b")
    both = F.col("n_a") + F.col("n_b")
    placed = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= p.least / (1 + p.least) * both - 1e-9
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{o}_a").bitwiseXOR(F.col(f"{o}_b"))) for o in odd))
    even = differ <= (1 - p.least) / (1 + p.least) * both + 1e-9
    met = left.join(right, "shingle").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & sized & placed & even)
    return verified(found, met.select("a", "b").distinct(), p)


def similar_documents(docs: DataFrame, p: Similarity | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, component_id): component_id is the smallest id that is reached by links between documents of at least the given similarity. Rows with a null id are left out."""
    p = p or Similarity()
    found = materialise(profiles(docs.where(F.col(id_column).isNotNull()), p, id_column, text_column), "profiles")
    # one document of those with the same set stands for all
    first = materialise(found.groupBy("same", "fp").agg(F.min("key").alias("first")), "firsts")
    slim = found.select("same", "fp", "key", F.size("bag").alias("n"), "bands")
    ones = materialise(slim.join(first, ["same", "fp"]).where(F.col("key") == F.col("first")).dropDuplicates(["key", "same", "fp"]).select("key", "fp", "n", "bands"), "ones")
    keys = ones.select("key", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = materialise(keys.groupBy("band", "bucket").agg(F.count("*").alias("members"), F.min(F.struct("key", "n")).alias("first")).where(F.col("members") > 1), "buckets")
    members = materialise(keys.join(shared, ["band", "bucket"]), "members")
    few = members.where(F.col("members") <= p.pair_bucket)
    left, right = (few.select("band", "bucket", F.col("key").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    stars = members.where(F.col("members") > p.pair_bucket).select(F.col("first.key").alias("a"), F.col("first.n").alias("n_a"), F.col("key").alias("b"), F.col("n").alias("n_b"))
    # fingerprints at a small distance, and documents with the same one
    of_fp = materialise(ones.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("lead")), "leads")
    near = near_links(of_fp.select("fp"), p.blocks)
    lead = lambda fp, c: of_fp.select(F.col("fp").alias(fp), F.col("lead.key").alias(c), F.col("lead.n").alias(f"n_{c}"))
    near = near.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(lead("fa", "a"), "fa").join(lead("fb", "b"), "fb")
    same_fp = ones.select("fp", F.col("key").alias("b"), F.col("n").alias("n_b")).join(lead("fp", "a"), "fp")
    pairs = left.join(right, ["band", "bucket"])
    for more in (stars, near, same_fp):
        pairs = pairs.select("a", "n_a", "b", "n_b").unionByName(more.select("a", "n_a", "b", "n_b"))
    # sets of too different sizes can't be similar
    pairs = pairs.where((F.col("a") != F.col("b")) & (F.least("n_a", "n_b") >= p.least * F.greatest("n_a", "n_b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialise(verified(found, pairs, p), "similar")
    large = members.where(F.col("members") > p.pair_bucket).select("key", "band", "bucket")
    groups = connected_components(links)
    further = materialise(similar_in_buckets(found, large, groups, p), "further")
    if not further.isEmpty():
        groups = connected_components(links.unionByName(further))
    named = first.join(groups, first["first"] == groups["node"], "left").select(F.col("same").alias("of_same"), F.col("fp").alias("of_fp"), F.coalesce("component", "first").alias("component_id"))
    named = materialise(named, "named")
    return found.join(named, (found["same"] == named["of_same"]) & (found["fp"] == named["of_fp"])).select(F.col("key").alias(id_column), "component_id")


def _without_losers(docs: DataFrame, grouped: DataFrame, id_column: str) -> DataFrame:
    losers = grouped.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("losing id")).distinct()
    return docs.join(losers, docs[id_column] == losers["losing id"], "left_anti")


def drop_near_duplicates(docs: DataFrame, p: SimHash | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group of linked fingerprints: that with the smallest id. Documents without an id stay; of rows that share an id, all stay or all go."""
    return _without_losers(docs, near_duplicates(docs.where(F.col(id_column).isNotNull()), p, id_column, text_column), id_column)


def drop_similar(docs: DataFrame, p: Similarity | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group of similar ones: that with the smallest id. Documents without an id stay; of rows that share an id, all stay or all go."""
    return _without_losers(docs, similar_documents(docs, p, id_column, text_column), id_column)
