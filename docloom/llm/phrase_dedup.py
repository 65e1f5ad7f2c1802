"""Substring dedup by repeated-phrase automata: words covered by a passage that also starts in an earlier document.

The exchange in docloom.llm.recurrence brings the passages that could share a
phrase of the given number of words to one shard. A shard confirms the phrases
that recur, word by word, and names the first document of each. The confirmed
passages go back to the batches of documents that have them, where they are
joined where they follow each other, and compiled into Aho-Corasick automata of
bounded size (pyahocorasick, over word numbers), sharded as the documents are. All
documents stream through the automata
of their batch, whole; what they locate is what goes.

Defined cases: a null text has no words; documents with fewer words than a
phrase lose nothing; rows that share an id are one document, so neither is
earlier; documents without an id come last; very long texts are one row in one
batch, cut nowhere; only the named columns are read, so others may have any name;
an empty table gives no rows. Ids must be integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.recurrence import NO_ID, U64, Batch, Exchange, Found, Variants, _part, _ramp, mix, recurring


@dataclass(frozen=True)
class PhraseDedup:
    """length: of phrases, in words; automaton_words: of the passages compiled into one automaton, about."""

    length: int = 13
    automaton_words: int = 1_000_000
    exchange: Exchange = field(default_factory=lambda: Exchange(length=13, gram=4))


def read_words(gram: int, ids: np.ndarray, texts: list[bytes]) -> Batch:
    """Units are words."""
    from xxhash import xxh3_64_intdigest

    words: list[bytes] = []
    counts = []
    for text in texts:
        own = text.split()
        words += own
        counts.append(len(own))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    names = np.array([xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=U64)
    hashes = names[numbers] if len(words) else np.empty(0, dtype=U64)
    grams = np.zeros(len(words), dtype=U64)
    m = max(len(words) - gram + 1, 0)
    for j in range(gram):
        grams[:m] = mix(grams[:m] ^ hashes[j : j + m]) + U64(j)
    bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    return Batch(ids, bounds, grams, lambda first, size: b" ".join(words[first : first + size]), texts, numbers)


def compare_phrases(length: int, variants: Variants) -> tuple[np.ndarray, np.ndarray]:
    """The first document of each phrase that stands in several; starts have no part in it, but join the windows of a passage to runs."""
    numbers: dict[bytes, int] = {}
    first: dict[tuple[int, ...], int] = {}
    recurs: set[tuple[int, ...]] = set()
    phrases: list[tuple[int, ...]] = []
    for text, doc, n, several in zip(variants.texts, variants.doc.tolist(), variants.n_windows.tolist(), variants.several.tolist(), strict=True):
        passage = tuple([numbers.setdefault(w, len(numbers)) for w in text.split(b" ")])
        for i in range(n):
            phrase = passage[i : i + length]
            phrases.append(phrase)
            known = first.setdefault(phrase, doc)
            if several or known != doc:
                recurs.add(phrase)
                if doc < known:
                    first[phrase] = doc
    least = np.fromiter((first[p] if p in recurs else NO_ID for p in phrases), dtype=np.int64, count=len(phrases))
    return least, np.where(least == NO_ID, -1, _ramp(variants.n_windows))


def _chains(found: Found, wanted: np.ndarray, mean: int = 16) -> list[tuple[int, tuple[int, ...]]]:
    """(first word, stretches) of each distinct run of wanted stretches that follow each other. A run also ends where a stretch's name says so, so that runs of copies end alike."""
    keep = wanted[found.of]
    follows = np.zeros(len(keep), dtype=bool)
    follows[1:] = keep[1:] & keep[:-1] & (found.places[1:] == found.places[:-1] + found.counts[found.of[:-1]]) & (found.names[found.of[:-1]] % U64(mean) != 0)
    heads = np.flatnonzero(keep & ~follows)
    # a run goes on to the next place that does not follow
    breaks = np.append(np.flatnonzero(~follows), len(keep))
    stops = breaks[np.searchsorted(breaks, heads, side="right")]
    of, known = found.of.tolist(), {}
    for a, b, at in zip(heads.tolist(), stops.tolist(), found.places[heads].tolist(), strict=True):
        known.setdefault(tuple(of[a:b]), at)
    return [(at, members) for members, at in known.items()]


def locate_passages(most: int, length: int, batch: Batch, found: Found, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted passages stand in the documents of a batch, by automata of about so many words each."""
    import ahocorasick

    words = batch.numbers.tolist()
    documents = [(a, tuple(words[a:b])) for a, b in zip(batch.bounds[:-1].tolist(), batch.bounds[1:].tolist(), strict=True) if b - a >= length]
    passages = _chains(found, wanted)
    members = np.array([k for _, own in passages for k in own], dtype=np.int64)
    n_members = np.array([len(own) for _, own in passages], dtype=np.int64)
    begins = np.cumsum(n_members) - n_members
    offsets = np.cumsum(found.counts[members]) - found.counts[members]
    offsets -= np.repeat(offsets[begins], n_members)
    sizes = np.add.reduceat(found.counts[members], begins) + length - 1 if len(passages) else n_members
    shards = (np.cumsum(sizes) - sizes) // most
    starts, hits = [], []
    for shard in np.unique(shards):
        own = np.flatnonzero(shards == shard).tolist()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k in own:
            at, n = passages[k][0], int(sizes[k])
            automaton.add_word(tuple(words[at : at + n]), (k, n - 1))
        automaton.make_automaton()
        for begin, document in documents:
            for end, (k, back) in automaton.iter(document):
                starts.append(begin + end - back)
                hits.append(k)
    hit = np.array(hits, dtype=np.int64)
    part = _part(begins[hit], n_members[hit])
    return np.repeat(np.array(starts, dtype=np.int64), n_members[hit]) + offsets[part], members[part]


def _kept(batch: Batch, marks: np.ndarray) -> list[list[bytes]]:
    out = []
    for i, text in enumerate(batch.documents):
        words, gone = text.split(), marks[batch.bounds[i] : batch.bounds[i + 1]]
        out.append([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
    return out


def _finish(batch: Batch, marks: np.ndarray) -> pa.RecordBatch:
    kept = _kept(batch, marks)
    sizes = np.diff(batch.bounds)
    removed = sizes - np.array([len(k) for k in kept], dtype=np.int64)
    digests = [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]
    return pa.RecordBatch.from_arrays([pa.array(batch.ids), pa.array(sizes), pa.array(removed), pa.array(digests, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])


def _texts(batch: Batch, marks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch.ids), pa.array([b" ".join(k).decode("utf-8", "replace") for k in _kept(batch, marks)], pa.string())], names=["id", "text"])


def _run(docs: DataFrame, p: PhraseDedup, finish, schema: str, id_column: str, text_column: str) -> DataFrame:
    if p.exchange.length != p.length:
        raise ValueError("the exchange must have the same length")
    out = recurring(docs, partial(read_words, p.exchange.gram), partial(compare_phrases, p.length), partial(locate_passages, p.automaton_words, p.length), finish, schema, p.exchange, True, id_column, text_column)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_column)


def repeated_phrases(docs: DataFrame, p: PhraseDedup | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per document."""
    return _run(docs, p or PhraseDedup(), _finish, "id long, n_words long, n_removed long, kept_sha256 string", id_column, text_column)


def without_repeated_phrases(docs: DataFrame, p: PhraseDedup | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text): the words that stay, joined by spaces."""
    return _run(docs, p or PhraseDedup(), _texts, "id long, text string", id_column, text_column)
