"""Repeated strings and phrases against brute force, with anchors whole and split."""

import hashlib
import random

import numpy as np
import pytest

from docloom.llm import phrase_dedup, suffix_dedup
from docloom.llm.recurrence import NO_ID, Exchange


def brute_strings(docs, length):
    first, out = {}, {}
    docs = sorted((i, (t or "").encode()) for i, t in docs)
    for i, t in docs:
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], (i, k))
    for i, t in docs:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < (i, k):
                gone[k : k + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def brute_phrases(docs, length):
    first, out = {}, {}
    docs = sorted((i, (t or "").encode().split()) for i, t in docs)
    for i, w in docs:
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    for i, w in docs:
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("split", [0, 3, 512])
def test_repeated_strings(docs, texts, split):
    p = suffix_dedup.SuffixDedup(array_bytes=5000, exchange=Exchange(100, 16, split_count=split, batch_bytes=30000, shard_bytes=50000, spread=1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_strings(docs, p).collect()}
    assert got == brute_strings(texts, 100)


@pytest.mark.parametrize("split", [0, 3, 512])
def test_repeated_phrases(docs, texts, split):
    p = phrase_dedup.PhraseDedup(automaton_words=400, exchange=Exchange(13, 4, split_count=split, batch_bytes=30000, shard_bytes=50000, spread=1))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.repeated_phrases(docs, p).collect()}
    assert got == brute_phrases(texts, 13)


def test_only_the_methods_remove(docs, texts, monkeypatch):
    """Without what the suffix arrays or the automata find, nothing goes, exact copies included."""
    nothing = lambda depth, *more: (np.full(int(more[-1].n_windows.sum()), NO_ID), np.full(int(more[-1].n_windows.sum()), -1))
    monkeypatch.setattr(suffix_dedup, "compare_suffixes", nothing)
    assert {r.n_removed for r in suffix_dedup.repeated_strings(docs).collect()} == {0}
    monkeypatch.setattr(phrase_dedup, "locate_passages", lambda *x: (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert {r.n_removed for r in phrase_dedup.repeated_phrases(docs).collect()} == {0}
    monkeypatch.undo()
    monkeypatch.setattr(phrase_dedup, "compare_phrases", nothing)
    assert {r.n_removed for r in phrase_dedup.repeated_phrases(docs).collect()} == {0}


def test_texts_without_repeats(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    alone = "z" + "".join(rng.choice("abcdefgh ") for _ in range(250))
    rows = [(2, " ".join(words)), (5, "x " + " ".join(words[10:40]) + " y"), (None, " ".join(words)), (9, ""), (None, f"{alone} {alone[:150]}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.text for r in suffix_dedup.without_repeated_strings(frame).collect() if r.doc_id is None} == {"", f"{alone} "}
    frame = frame.where("text not like 'z%'")
    got = {r.doc_id: r.text for r in phrase_dedup.without_repeated_phrases(frame).collect()}
    assert got == {2: rows[0][1], 5: "x y", None: "", 9: ""}
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeated_strings(frame).collect()}
    assert got[2] == rows[0][1] and got[None] == "" and got[5] == "xy"
    for made in (phrase_dedup.repeated_phrases(frame.where("doc_id < 0")), suffix_dedup.repeated_strings(frame.where("doc_id < 0"))):
        assert made.count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for text in (b"abracadabra" * 30, bytes(rng.choice(b"ab") for _ in range(700)), b"a" * 500, bytes(rng.randrange(256) for _ in range(300)), b"x"):
        for depth in (8, 20, 100):
            raw = np.frombuffer(text + b"\0" * 16, dtype=np.uint8)
            order, _ = suffix_dedup.suffix_array(raw, depth)
            padded = text + b"\0" * depth
            keys = [padded[i : i + depth] for i in order]
            assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(text)))
            common = suffix_dedup.common_prefixes(raw, order, depth, chain=16)
            for j in range(1, len(text)):
                a, b = text[order[j - 1] :], text[order[j] :]
                n = 0
                while n < min(len(a), len(b), depth) and a[n] == b[n]:
                    n += 1
                assert min(common[j], len(a), len(b)) == n
