"""Which fixed-length windows of a corpus also start earlier: the exchange that two operators share.

A window is `length` consecutive units (bytes, or words) of one document. Each
window is named by its anchor, the smallest hash of the `gram`-unit runs inside
it (the leftmost of equals), so equal windows have equal anchors wherever they
stand. Consecutive windows with the same anchor form a stretch, some half a
window long plus one window. The exchange only brings together what could be
equal; whether it is, and what goes, is for the operator's own method:

1. Documents are dealt into batches by a hash of their id. A batch sends the
   anchors it holds, a few bytes each, to shards by anchor.
2. A shard replies to each batch which of its anchors recur, and which of those
   have so many stretches that they are to be split.
3. A batch sends each distinct stretch with a recurring anchor once, with its
   text and first place, to shards by anchor. Stretches of an anchor to be split
   (as of a common line that stands in ever different surroundings) go as single
   windows, each with its own text as its anchor, so that no anchor can fill a
   shard.
4. A shard has the operator compare the stretches with all their places, and
   replies to each batch with the least place of each window.
5. A batch has the operator locate the stretches in its documents, and marks the
   units of windows that stand later than their least place.

Anything that recurs is sent by each batch once, however often the batch holds
it, so a group of copies costs a row for each batch. Batches and shards grow in
number with the input, not in size; a row between two of them holds all that
one has for the other, so there are never more rows than stretches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import shuffle_width, text_of

U64 = np.uint64
#: Stands for a null id within the exchange.
NO_ID = (1 << 63) - 1
_PLACE_BITS = 24
_PLACE = U64((1 << _PLACE_BITS) - 1)


@dataclass(frozen=True)
class Exchange:
    """length, gram: of windows and anchors, in units. An anchor with more than split_count stretches (equal ones in a batch count once) is split. Batches and shards are as many as the text has batch_bytes and shard_bytes, and at least spread times (shards: once) the shuffle partitions. text_bytes: of all texts, which are measured in a pass of their own where it is None."""

    length: int
    gram: int
    split_count: int = 2000
    batch_bytes: int = 4 << 20
    shard_bytes: int = 8 << 20
    spread: int = 2
    text_bytes: int | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return x


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of so many values, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = np.minimum(out[:-rest], out[rest:])
    return out


def stretches(grams: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each stretch, in order. grams: the hash of the run at each unit of the concatenated documents; bounds: where documents begin, and the end. No stretch crosses a bound."""
    width = length - gram + 1
    firsts, counts, anchors = [], [], []
    if len(bounds) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    # pieces that stay in the cache; a piece begins where the last one's windows end, at any unit
    piece = 1 << 16
    total = int(bounds[-1])
    carried = None
    for at in range(0, max(total - length + 1, 0), piece):
        stop = min(at + piece, total - length + 1)
        values = grams[at : stop + width - 1]
        keyed = (values & ~_PLACE) | np.arange(len(values), dtype=U64)
        least = _sliding_min(keyed, width)[: stop - at]
        anchor_at = (least & _PLACE).astype(np.int64) + at
        # windows that would cross into the next document
        doc = np.searchsorted(bounds, np.array([at, stop - 1]), side="right") - 1
        fits = np.ones(stop - at, dtype=bool)
        for b in bounds[doc[0] + 1 : doc[1] + 2]:
            fits[max(int(b) - length + 1 - at, 0) : max(int(b) - at, 0)] = False
        change = np.empty(stop - at, dtype=bool)
        change[0] = carried is None or not carried[1] or not fits[0] or anchor_at[0] != carried[0]
        np.not_equal(anchor_at[1:], anchor_at[:-1], out=change[1:])
        change[1:] |= fits[1:] & ~fits[:-1]
        begins = np.flatnonzero(change & fits)
        last = np.flatnonzero(np.concatenate((change[1:] | ~fits[1:], [True])) & fits)
        if not change[0] and fits[0]:  # goes on from the piece before
            counts[-1][-1] += last[0] + 1
            last = last[1:]
        if len(begins):
            firsts.append(begins + at)
            counts.append(last - begins + 1)
            anchors.append(mix(values[anchor_at[begins] - at]))
        carried = (anchor_at[-1], bool(fits[-1]))
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(anchors)


@dataclass
class Batch:
    """The documents of a batch, sorted by id and text, laid end to end. bounds: of units, for each document and the end; text(first, n) gives the bytes of n units; numbers: of words, where units are words."""

    ids: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    text: Callable[[int, int], bytes]
    documents: list[bytes]
    numbers: np.ndarray | None = None


#: Builds a batch from ids and texts.
Reader = Callable[[np.ndarray, list[bytes]], Batch]


@dataclass
class Variants:
    """Distinct stretches at a shard: their bytes, number of windows, the document and unit where each first stands, whether it stands elsewhere too, and its anchor."""

    texts: list[bytes]
    n_windows: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    several: np.ndarray
    anchor: np.ndarray


#: For all windows of the variants, one after the other: document and start of its least place, if the window has several places; NO_ID, -1 if it has one only.
Comparer = Callable[[Variants], tuple[np.ndarray, np.ndarray]]


@dataclass
class Found:
    """Distinct stretches of a batch (first unit, number of windows, name), and all their places in it, in order: the first unit and the stretch of each."""

    firsts: np.ndarray
    counts: np.ndarray
    names: np.ndarray
    places: np.ndarray
    of: np.ndarray


#: The places in a batch at which the wanted ones (a bool array) of the distinct stretches are: first units, and the stretch of each.
Locator = Callable[[Batch, Found, np.ndarray], tuple[np.ndarray, np.ndarray]]


def places_known(batch: Batch, found: Found, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places at which the stretches were read."""
    keep = wanted[found.of]
    return found.places[keep], found.of[keep]


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _batches(table: pa.Table, read: Reader) -> Batch:
    pairs = sorted(zip(table.column("id").to_pylist(), (t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()), strict=True))
    return read(np.array([i for i, _ in pairs], dtype=np.int64), [t for _, t in pairs])


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U64(33)) % U64(n)).astype(np.int64)


def _split(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) for each shard that occurs."""
    order = np.argsort(shards, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(shards[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(shards[order[a]]), order[a:b]


def _names(batch: Batch, firsts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    text = batch.text
    return np.array([xxh3_64_intdigest(text(f, n + length - 1)) for f, n in zip(firsts.tolist(), counts.tolist(), strict=True)], dtype=U64)


def _window_names(batch: Batch, firsts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) 64-bit halves of the names of all windows of the stretches, one after the other."""
    from xxhash import xxh3_128_digest

    text = batch.text
    raw = b"".join(xxh3_128_digest(text(f + j, length)) for f, n in zip(firsts.tolist(), counts.tolist(), strict=True) for j in range(n))
    pairs = np.frombuffer(raw, dtype=">u8").astype(U64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of counts."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=kind)


def _compared(variants: Variants, compare: Comparer) -> tuple[np.ndarray, np.ndarray]:
    """compare() over the variants that stand in several places, or share their anchor with others; no window of another has a second place."""
    total = int(variants.n_windows.sum())
    doc, start = np.full(total, NO_ID), np.full(total, -1)
    _, inverse, n = np.unique(variants.anchor, return_inverse=True, return_counts=True)
    some = np.flatnonzero((n[inverse] > 1) | variants.several)
    if len(some):
        windows = variants.n_windows[some]
        where = np.repeat((np.cumsum(variants.n_windows) - variants.n_windows)[some], windows) + _ramp(windows)
        doc[where], start[where] = compare(Variants([variants.texts[i] for i in some.tolist()], windows, variants.doc[some], variants.start[some], variants.several[some], variants.anchor[some]))
    return doc, start


def _runs(variants: Variants, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of a variant whose least places are consecutive: how many each variant has, and their lengths, documents and (less the window's number) starts. A variant of which nothing can go has none."""
    base = np.where(start < 0, NO_ID, start - _ramp(variants.n_windows))
    begins = np.cumsum(variants.n_windows) - variants.n_windows
    own = np.repeat(np.arange(len(begins)), variants.n_windows)
    stays = (start < 0) | (~variants.several[own] & (doc == variants.doc[own]) & (base == variants.start[own]))
    some = np.bincount(own, ~stays, minlength=len(begins)) > 0
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (base[1:] != base[:-1])
    new[begins] = True
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, len(doc)))
    keep = some[own[at]]
    return np.bincount(own[at][keep], minlength=len(begins)), lengths[keep], doc[at][keep], base[at][keep]


def _part(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start .. start + count - 1 for each."""
    return np.repeat(starts, counts) + _ramp(counts)


def recurring(docs: DataFrame, read: Reader, compare: Comparer, locate: Locator, finish: Callable[[Batch, np.ndarray], pa.RecordBatch], schema: str, exchange: Exchange, across_documents: bool, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """finish(batch, marks) for each batch; marks: for each unit whether a recurring window covers it. across_documents: a window recurs only if it starts in a smaller document; else also if it starts earlier in the same one."""
    spark, x = docs.sparkSession, exchange
    base = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    total = x.text_bytes if x.text_bytes is not None else base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = shuffle_width(spark)
    n_batches = max(x.spread * width, -(-total // x.batch_bytes))
    # more shards than tasks even them out, as long as that makes few rows
    n_shards = max(width, -(-total // x.shard_bytes), min(4 * width, (1 << 16) // n_batches))
    # documents without an id come after all others, in batches by their text
    dealt = base.withColumn("batch", F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(n_batches)).cast("long")).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    grouped = dealt.groupBy("batch")

    def found(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        firsts, counts, anchors = stretches(batch.grams, batch.bounds, x.length, x.gram)
        return firsts, counts, anchors, np.searchsorted(batch.bounds, firsts, side="right") - 1

    def elsewhere(of: np.ndarray, n: int, doc: np.ndarray) -> np.ndarray:
        """Whether each of n groups of places, in order, has a second place: another document, or any."""
        counts = np.bincount(of, minlength=n)
        if not across_documents:
            return counts > 1
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(counts)
        return doc[order[ends - 1]] != doc[order[ends - counts]]

    def ask(table: pa.Table) -> pa.Table:
        """1: the distinct anchors, how many distinct stretches each has here, and whether it has a second place."""
        number = table.column("batch")[0].as_py()
        batch = _batches(table, read)
        firsts, windows, anchors, doc = found(batch)
        keys, inverse, counts = np.unique(anchors, return_inverse=True, return_counts=True)
        several = elsewhere(inverse, len(keys), doc).astype(np.uint8) if len(keys) else np.empty(0, np.uint8)
        many = np.flatnonzero(counts[inverse] > 1)
        if len(many):
            names = _names(batch, firsts[many], windows[many], x.length)
            order = np.lexsort((names, inverse[many]))
            of, names = inverse[many][order], names[order]
            again = (of[1:] == of[:-1]) & (names[1:] == names[:-1])
            counts = counts - np.bincount(of[1:][again], minlength=len(keys))
        rows = [(shard, number, *_pack(keys[p], np.minimum(counts[p], 65535).astype(np.uint16), several[p])) for shard, p in _split(_shards(keys, n_shards))]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(5)]
        return pa.table(dict(zip(("shard", "batch", "keys", "counts", "several"), (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)), strict=True)))

    asked = grouped.applyInArrow(ask, "shard long, batch long, keys binary, counts binary, several binary")

    def recur(table: pa.Table) -> pa.Table:
        """2: to each batch those of its anchors that recur, and whether they are to be split."""
        batches = table.column("batch").to_pylist()
        sizes = np.array([len(b) // 8 for b in table.column("keys").to_pylist()])
        every, counts, several = _joined(table, "keys", U64), _joined(table, "counts", np.uint16), _joined(table, "several", np.uint8)
        _, inverse, holders = np.unique(every, return_inverse=True, return_counts=True)
        recurs = (holders > 1) | (np.bincount(inverse, several) > 0)
        split = np.bincount(inverse, counts) > x.split_count
        yes, cut, at = recurs[inverse], split[inverse].astype(np.uint8), 0
        rows = []
        for number, n in zip(batches, sizes.tolist(), strict=True):
            keep = at + np.flatnonzero(yes[at : at + n])
            at += n
            if len(keep):
                rows.append((number, *_pack(every[keep], cut[keep])))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(3)]
        return pa.table({"batch": pa.array(columns[0], pa.int64()), "keys": pa.array(columns[1], pa.binary()), "split": pa.array(columns[2], pa.binary())})

    replies = asked.groupBy("shard").applyInArrow(recur, "batch long, keys binary, split binary")

    def entries(batch: Batch, reply: pa.Table) -> tuple[Found, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct stretches with recurring anchors (those of anchors to be split as single windows); their anchors, documents and whether they have a second place here."""
        keys, split = _joined(reply, "keys", U64), _joined(reply, "split", np.uint8)
        order = np.argsort(keys)
        keys, split = keys[order], split[order]
        firsts, counts, anchors, doc = found(batch)
        at = np.minimum(np.searchsorted(keys, anchors), len(keys) - 1)
        yes = np.flatnonzero(keys[at] == anchors)
        firsts, counts, anchors, doc, hot = firsts[yes], counts[yes], anchors[yes], doc[yes], split[at[yes]].astype(bool)
        names = _names(batch, firsts, counts, x.length)
        if hot.any():
            # the windows of each distinct stretch are named once
            _, once, inverse = np.unique(names[hot], return_index=True, return_inverse=True)
            n_once = counts[hot][once]
            high, low = _window_names(batch, firsts[hot][once], n_once, x.length)
            of_window = _part((np.cumsum(n_once) - n_once)[inverse], counts[hot])
            n = np.where(hot, counts, 1)
            of = np.repeat(np.arange(len(n)), n)
            single = hot[of]
            firsts, counts, anchors, doc, names = firsts[of] + np.where(single, _ramp(n), 0), np.where(single, 1, counts[of]), anchors[of], doc[of], names[of]
            anchors[single], names[single] = high[of_window], low[of_window]
        _, once, of = np.unique(names, return_index=True, return_inverse=True)  # the first of each, as stretches are in order
        return Found(firsts[once], counts[once], names[once], firsts, of), anchors[once], doc[once], elsewhere(of, len(once), doc)

    fields = [("shard", pa.int64()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("names", "anchors", "docs", "starts", "windows", "several", "lengths", "texts"))]

    def tell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """3: each distinct stretch with a recurring anchor."""
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            number = left.column("batch")[0].as_py()
            batch = _batches(left, read)
            here, anchors, doc, several = entries(batch, right)
            for shard, p in _split(_shards(anchors, n_shards)):
                texts = [batch.text(f, n + x.length - 1) for f, n in zip(here.firsts[p].tolist(), here.counts[p].tolist(), strict=True)]
                lengths = np.array([len(t) for t in texts], dtype=np.int32)
                rows.append((shard, number, *_pack(here.names[p], anchors[p], batch.ids[doc[p]], here.firsts[p] - batch.bounds[doc[p]], here.counts[p].astype(np.int32), several[p].astype(np.uint8), lengths), pa.compress(b"".join(texts), codec="zstd", asbytes=True)))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
        return pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, fields, strict=True)})

    told = grouped.cogroup(replies.groupBy("batch")).applyInArrow(tell, "shard long, batch long, names binary, anchors binary, docs binary, starts binary, windows binary, several binary, lengths binary, texts binary")
    verdicts = [("batch", pa.int64()), ("shard", pa.int64()), *((c, pa.binary()) for c in ("runs", "windows", "docs", "starts"))]

    def judge(table: pa.Table) -> pa.Table:
        """4: to each batch, for each stretch that it sent, the least places of its windows."""
        names, anchors, docs_, starts = (_joined(table, c, t) for c, t in (("names", U64), ("anchors", U64), ("docs", np.int64), ("starts", np.int64)))
        windows, several, lengths = (_joined(table, c, t) for c, t in (("windows", np.int32), ("several", np.uint8), ("lengths", np.int32)))
        sizes = np.array([len(b) // 8 for b in table.column("names").to_pylist()])
        order = np.lexsort((starts, docs_, names, anchors))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (names[order[1:]] != names[order[:-1]]) | (anchors[order[1:]] != anchors[order[:-1]])
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]
        ends = np.cumsum(lengths.astype(np.int64))
        filled = np.concatenate(([0], ends[np.cumsum(sizes) - 1]))
        blob = b"".join(pa.decompress(b, int(n), codec="zstd", asbytes=True) for b, n in zip(table.column("texts").to_pylist(), np.diff(filled), strict=True))
        texts = [blob[ends[i] - lengths[i] : ends[i]] for i in first.tolist()]
        del blob
        variants = Variants(texts, windows[first].astype(np.int64), docs_[first], starts[first], (np.bincount(group) > 1) | (np.bincount(group, several) > 0), anchors[first])
        runs, n_windows, least, base = _runs(variants, *_compared(variants, compare))
        begins = np.cumsum(runs) - runs
        rows, at = [], 0
        for number, n, shard in zip(table.column("batch").to_pylist(), sizes.tolist(), table.column("shard").to_pylist(), strict=True):
            own = group[at : at + n]
            at += n
            p = _part(begins[own], runs[own])
            rows.append((number, shard, *_pack(runs[own].astype(np.int32), n_windows[p].astype(np.int32), least[p], base[p])))
        columns = list(zip(*rows, strict=True))
        return pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, verdicts, strict=True)})

    judged = told.groupBy("shard").applyInArrow(judge, "batch long, shard long, runs binary, windows binary, docs binary, starts binary")
    # the replies of steps 2 and 4 in one table: those of step 2 have no shard
    answers = replies.select("batch", F.lit(None).cast("long").alias("shard"), F.col("keys").alias("a"), F.col("split").alias("b"), *(F.lit(None).cast("binary").alias(c) for c in "cd"))
    answers = answers.unionByName(judged.select("batch", "shard", F.col("runs").alias("a"), F.col("windows").alias("b"), F.col("docs").alias("c"), F.col("starts").alias("d")))

    def mark(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """5: marks for the units of each document."""
        if not left.num_rows:
            return empty
        batch = _batches(left, read)
        edges = np.zeros(int(batch.bounds[-1]) + 1, dtype=np.int32)
        early = right.column("shard").is_null()
        if right.num_rows:
            here, anchors, _, _ = entries(batch, right.filter(early).select(["a", "b"]).rename_columns(["keys", "split"]))
            judged_here = right.filter(pa.compute.invert(early)).sort_by("shard")
            sent = np.concatenate([p for _, p in _split(_shards(anchors, n_shards))])  # the order in which tell() sent them
            runs, n_windows, least, base_ = (_joined(judged_here, c, t) for c, t in (("a", np.int32), ("b", np.int32), ("c", np.int64), ("d", np.int64)))
            n_runs, begins = np.zeros(len(sent), dtype=np.int64), np.zeros(len(sent), dtype=np.int64)
            n_runs[sent], begins[sent] = runs, np.cumsum(runs) - runs
            inside = np.cumsum(n_windows) - n_windows  # windows before a run, from here on within its stretch
            inside = inside - np.repeat(inside[begins[sent][runs > 0]], runs[runs > 0])
            # of use is what has a place in a document that is not before the least one
            last = np.zeros(len(sent), dtype=np.int64)
            np.maximum.at(last, here.of, batch.ids[np.searchsorted(batch.bounds, here.places, side="right") - 1])
            wanted, entry = np.zeros(len(sent), dtype=bool), np.repeat(sent, runs)
            wanted[entry[least <= last[entry] - across_documents]] = True
            places, of = locate(batch, here, wanted)
            doc = np.searchsorted(batch.bounds, places, side="right") - 1
            r = _part(begins[of], n_runs[of])
            at, doc = np.repeat(places, n_runs[of]), np.repeat(doc, n_runs[of])
            gone = least[r] < batch.ids[doc]
            if not across_documents:
                gone |= (least[r] == batch.ids[doc]) & (base_[r] < at - batch.bounds[doc])
            r, at = r[gone], at[gone] + inside[r[gone]]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + n_windows[r] + x.length - 1, -1)
        return pa.Table.from_batches([finish(batch, np.cumsum(edges[:-1]) > 0)])

    empty = _empty(schema)
    return grouped.cogroup(answers.groupBy("batch")).applyInArrow(mark, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.table({f.split()[0]: pa.array([], kinds[f.split()[1]]) for f in schema.split(", ")})
