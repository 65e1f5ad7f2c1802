"""Substring dedup by suffix arrays: bytes covered by a string that also starts earlier.

The exchange in docloom.llm.recurrence brings the stretches of text that could
share a string of the given length to one shard. A shard sorts their suffixes
by Larsson-Sadakane refinement (groups of suffixes that are equal so far are
sorted again by the rank of what follows, which doubles the depth), takes
Kasai's common prefixes of neighbours, and so finds the groups of suffixes with
a common prefix of the full length, each with its least place: that alone says
which bytes go, those of exact copies included. A shard with more text than one array
should hold makes several, each of stretches next to each other by anchor, and
merges two that share an anchor by binary search of the prefixes of the one in
the other.

Defined cases: a null text counts as empty; documents shorter than the length
lose nothing; rows that share an id are compared as one document whose copies
start at the same place, so neither is earlier; documents without an id come
last; very long texts are one row in one batch, cut nowhere; only the named columns
are read, so others may have any name; an empty table gives no rows. Ids must be
integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.recurrence import NO_ID, U64, Batch, Exchange, Variants, mix, places_known, recurring


@dataclass(frozen=True)
class SuffixDedup:
    """length: of the strings, in bytes; array_bytes: of text in one suffix array."""

    length: int = 100
    array_bytes: int = 1 << 19
    exchange: Exchange = field(default_factory=lambda: Exchange(length=100, gram=16))


def _words_at(raw: np.ndarray, n: int, order: str) -> np.ndarray:
    """The 8 bytes from each of n places, as integers. raw must go on for 16 bytes after them."""
    out = np.empty(n + 8, dtype=U64)
    for k in range(8):
        m = len(out[k::8])
        out[k::8] = np.frombuffer(raw, dtype=f"{order}u8", count=m, offset=k)
    return out[:n]


def read_bytes(gram: int, ids: np.ndarray, texts: list[bytes]) -> Batch:
    """Units are bytes; a run's hash covers all its bytes, eight at a time."""
    if gram % 8:
        raise ValueError("runs of bytes are hashed eight at a time")
    joined = b"".join(texts)
    n = len(joined)
    padded = np.frombuffer(joined + b"\0" * (gram + 16), dtype=np.uint8)
    words = _words_at(padded, n + gram, "<")
    grams = np.empty(n, dtype=U64)
    for at in range(0, n, 1 << 15):
        stop = min(at + (1 << 15), n)
        hashed = mix(words[at + gram - 8 : stop + gram - 8])
        for k in range(gram - 16, -8, -8):
            hashed = mix(hashed ^ words[at + k : stop + k])
        grams[at:stop] = hashed
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    return Batch(ids, bounds, grams, lambda first, size: joined[first : first + size], texts)


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first depth bytes, group of each suffix). raw ends with at least 16 zero bytes, which are no part of the text."""
    n = len(raw) - 16
    first = _words_at(raw, n, ">")
    order = np.argsort(first)
    new = np.concatenate(([True], first[order[1:]] != first[order[:-1]]))
    begins = np.flatnonzero(new)
    group = np.empty(n + depth, dtype=np.int64)
    group[n:] = -1
    group[order] = np.repeat(begins, np.diff(np.append(begins, n)))
    reached = 8
    while reached < depth:
        # groups of one are done
        sizes = np.diff(np.append(begins, n))
        slots = np.repeat(sizes > 1, sizes).nonzero()[0]
        if not len(slots):
            break
        step = min(reached, depth - reached)
        members = order[slots]
        key = group[members] * (n + 2) + group[members + step] + 1
        sorted_ = np.argsort(key)
        order[slots] = members[sorted_]
        key = key[sorted_]
        new[slots] = np.concatenate(([True], key[1:] != key[:-1]))
        begins = np.flatnonzero(new)
        group[order] = np.repeat(begins, np.diff(np.append(begins, n)))
        reached += step
    return order, group[:n]


def common_prefixes(raw: np.ndarray, order: np.ndarray, depth: int, chain: int = 256) -> np.ndarray:
    """Bytes (up to depth) that each suffix in order has in common with the one before it. After Kasai: where the suffix before i + 1 is the one after that before i, their common prefix is one byte shorter as long as there is one, so only the heads of such chains are compared."""
    n = len(order)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    head = np.ones(n, dtype=bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0)
    since = place - np.maximum.accumulate(np.where(head, place, 0))
    head |= since % chain == 0
    words = np.concatenate((_words_at(raw, n, ">"), np.zeros(chain + depth + 16, dtype=U64)))
    lengths = np.zeros(n, dtype=np.int64)
    todo = np.flatnonzero(head)
    while len(todo):
        sizes = np.diff(np.append(np.flatnonzero(head), n))
        wanted = sizes[np.cumsum(head)[todo] - 1] + depth
        common = np.zeros(len(todo), dtype=np.int64)
        live = np.flatnonzero(before[todo] >= 0)
        at = 0
        while len(live):
            i = todo[live] + at
            a, b = words[i], words[before[todo[live]] + at]
            differ = a ^ b
            same = np.full(len(live), 8, dtype=np.int64)
            for k in range(7, -1, -1):  # the leftmost byte that differs
                same[(differ >> U64(8 * (7 - k))) & U64(255) != 0] = k
            common[live] += same
            at += 8
            live = live[(same == 8) & (wanted[live] > at) & (np.maximum(todo[live], before[todo[live]]) + at < n)]
        lengths[todo] = common
        # nothing follows from a common prefix of 0: the next suffix of such a chain is a head too
        todo = todo[common + 1 < wanted - depth] + common[common + 1 < wanted - depth] + 1
        head[todo] = True
    last = np.maximum.accumulate(np.where(head, place, 0))
    lengths = np.clip(lengths[last] - (place - last), 0, depth)
    return lengths[order]


def compare_suffixes(depth: int, array_bytes: int, variants: Variants) -> tuple[np.ndarray, np.ndarray]:
    """The least places of all windows (see Comparer), from the groups of equal prefixes in suffix arrays."""
    ids, rank = np.unique(variants.doc, return_inverse=True)
    lengths = np.array([len(t) for t in variants.texts], dtype=np.int64)
    by_anchor = np.argsort(variants.anchor, kind="stable")
    part = np.empty(len(lengths), dtype=np.int64)
    part[by_anchor] = (np.cumsum(lengths[by_anchor]) - lengths[by_anchor]) // array_bytes
    # anchors with stretches in more than one array
    _, name = np.unique(variants.anchor, return_inverse=True)
    low, high = np.full(name.max() + 1, part.max()), np.zeros(name.max() + 1, dtype=np.int64)
    np.minimum.at(low, name, part)
    np.maximum.at(high, name, part)
    shared = (low < high)[name]
    found, merged, reach = [], [], []
    for k in np.unique(part):
        own = np.flatnonzero(part == k)
        raw = np.frombuffer(b"".join(variants.texts[i] for i in own.tolist()) + b"\0" * 16, dtype=np.uint8)
        order, _ = suffix_array(raw, depth)
        common = common_prefixes(raw, order, depth)
        of = np.repeat(np.arange(len(own)), lengths[own])[order]
        window = order - (np.cumsum(lengths[own]) - lengths[own])[of]
        fits = window < variants.n_windows[own][of]
        group = np.cumsum(common < depth) - 1
        order, of, window, group = order[fits], own[of[fits]], window[fits], group[fits]
        where = (rank[of] << 40) + variants.start[of] + window
        least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, where)
        places = np.bincount(group, 1 + variants.several[of]).astype(np.int64)
        found.append((of, window, group, least, places))
        # the prefixes of the groups that another array may have too, in order
        groups, at = np.unique(group[shared[of]], return_index=True)
        starts = order[shared[of]][at]
        merged.append((groups, np.frombuffer(np.lib.stride_tricks.sliding_window_view(raw, depth)[starts].tobytes(), dtype=f"S{depth}")))
        reach.append((k, int(high[name[own]].max())))
    for a in range(len(found)):
        for b in range(a + 1, len(found)):
            if reach[b][0] > reach[a][1]:
                break
            (groups_a, prefixes_a), (groups_b, prefixes_b) = merged[a], merged[b]
            if not len(groups_a) or not len(groups_b):
                continue
            at = np.minimum(np.searchsorted(prefixes_a, prefixes_b), len(prefixes_a) - 1)
            both = np.flatnonzero(prefixes_a[at] == prefixes_b)
            in_a, in_b = groups_a[at[both]], groups_b[both]
            least_a, least_b, places_a, places_b = found[a][3], found[b][3], found[a][4], found[b][4]
            least_a[in_a] = least_b[in_b] = np.minimum(least_a[in_a], least_b[in_b])
            places_a[in_a] = places_b[in_b] = 2  # one in each at least
    begins = np.cumsum(variants.n_windows) - variants.n_windows
    doc, start = np.full(int(variants.n_windows.sum()), NO_ID), np.full(int(variants.n_windows.sum()), -1)
    for of, window, group, least, places in found:
        at = (begins[of] + window)[twice := places[group] > 1]
        doc[at], start[at] = ids[least[group][twice] >> 40], least[group][twice] & ((1 << 40) - 1)
    return doc, start


def _finish(batch: Batch, marks: np.ndarray) -> pa.RecordBatch:
    begins = batch.bounds[:-1]
    total = np.concatenate(([0], np.cumsum(marks)))
    removed = total[batch.bounds[1:]] - total[begins]
    starts = marks.copy()
    starts[1:] &= ~marks[:-1]
    inner = begins[begins < len(marks)]
    starts[inner] = marks[inner]  # a run ends with its document
    runs = np.concatenate(([0], np.cumsum(starts)))
    digests = []
    for i, text in enumerate(batch.documents):
        kept = np.frombuffer(text, dtype=np.uint8)[~marks[batch.bounds[i] : batch.bounds[i + 1]]].tobytes() if removed[i] else text
        digests.append(hashlib.sha256(kept).hexdigest())
    sizes = np.diff(batch.bounds)
    return pa.RecordBatch.from_arrays([pa.array(batch.ids), pa.array(sizes), pa.array(removed), pa.array(runs[batch.bounds[1:]] - runs[begins]), pa.array(digests, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(batch: Batch, marks: np.ndarray) -> pa.RecordBatch:
    texts = []
    for i, text in enumerate(batch.documents):
        kept = np.frombuffer(text, dtype=np.uint8)[~marks[batch.bounds[i] : batch.bounds[i + 1]]].tobytes()
        texts.append(kept.decode("utf-8", "ignore"))  # a cut may leave part of a character, which goes too
    return pa.RecordBatch.from_arrays([pa.array(batch.ids), pa.array(texts, pa.string())], names=["id", "text"])


def _run(docs: DataFrame, p: SuffixDedup, finish, schema: str, id_column: str, text_column: str) -> DataFrame:
    if p.exchange.length != p.length:
        raise ValueError("the exchange must have the same length")
    out = recurring(docs, partial(read_bytes, p.exchange.gram), partial(compare_suffixes, p.length, p.array_bytes), places_known, finish, schema, p.exchange, False, id_column, text_column)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_column)


def repeated_strings(docs: DataFrame, p: SuffixDedup | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per document."""
    return _run(docs, p or SuffixDedup(), _finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_column, text_column)


def without_repeated_strings(docs: DataFrame, p: SuffixDedup | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text) with the repeated bytes removed."""
    return _run(docs, p or SuffixDedup(), _texts, "id long, text string", id_column, text_column)
