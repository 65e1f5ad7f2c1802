"""Tokens of a vocabulary against a plain search, and chunks cut at their places."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunks as K
from docloom.operators import vocabulary as V

TEXTS = ["", " \n", "One word.", "étés à l'œuvre, naïve café!!", "日本語のテキスト 123 45", "éa combining", "😀😀 smile", "x" * 300 + " " + "ab" * 200, "tab\tnew\nline hard", "a-b_c d__e 3.14"]


def plain(pieces, text):
    """Each place tries all lengths, longest first."""
    import regex

    out = []
    for m in regex.finditer(r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+", text):
        spaced = m.start() == 0 or text[m.start() - 1] in " \t\n\r\f\v"
        raw = (" " if spaced else "") + m[0]
        chars = [i - spaced for i, c in enumerate(raw) for _ in c.encode()]
        raw, at = raw.encode(), 0
        while at < len(raw):
            n = next(n for n in range(len(raw) - at, 0, -1) if raw[at : at + n] in pieces)
            out.append((pieces[raw[at : at + n]], m.start() + max(chars[at], 0), m.start() + chars[at + n - 1] + 1))
            at += n
    return out


def test_longest_pieces_and_their_places():
    pieces = V.read_vocabulary(V.default_vocabulary())
    encoder = V.Encoder(pieces)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aäetß, .\n1é日") for _ in range(rng.randrange(60))) for _ in range(200)]
    for text in texts * 2:  # known words give the same
        assert list(zip(*encoder.encode(text), strict=True)) == plain(pieces, text)
    assert encoder.encode(None) == ([], [], [])


def test_a_long_word_takes_time_in_proportion():
    ids, starts, ends = V.Encoder(V.read_vocabulary(V.default_vocabulary())).encode("qz" * 500_000)
    assert ends[-1] == 1_000_000 and starts[1:] == ends[:-1]


def test_vocabularies_cover_all_bytes(tmp_path):
    (tmp_path / "v").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        V.read_vocabulary(str(tmp_path / "v"))


@pytest.mark.parametrize("total", [0, 1, 509, 510, 511, 892, 893, 5000])
def test_windows_are_those_of_the_columns(spark, total):
    made = spark.range(1).select(F.inline(K.window_ranges(F.lit(total), 510, 382))).collect()
    assert [(r.token_start, r.token_end) for r in made] == V.token_windows(total, 510, 382)


def test_chunks_are_cut_from_the_text(spark):
    rows = [(str(i), t, i, "z") for i, t in enumerate([*TEXTS, None])]
    docs = spark.createDataFrame(rows, "document_id string, text string, row long, words string")
    encoder = V.Encoder(V.read_vocabulary(V.default_vocabulary()))
    got = {}
    for r in K.chunk(docs, 7, 2).collect():
        ids, starts, ends = encoder.encode(rows[r.row][1])
        assert r.words == "z" and r.chunk_ids == ids[r.token_start : r.token_end]
        assert r.chunk_text == rows[r.row][1][starts[r.token_start] : ends[r.token_end - 1]]
        got.setdefault(r.row, []).append((r.chunk_index, r.token_start, r.token_end, r.total_chunks))
    for row, (_, t, *_) in enumerate(rows):
        windows = V.token_windows(len(encoder.encode(t)[0]), 7, 5)
        assert sorted(got.get(row, [])) == [(i, a, b, len(windows)) for i, (a, b) in enumerate(windows)]
    few = K.chunk(docs, 7, 2, ends_only=True).groupBy("row").agg(F.sort_array(F.collect_list("chunk_index")).alias("i"), F.max("total_chunks").alias("n")).collect()
    assert all(r.i == sorted({0, r.n // 2, r.n - 1}) for r in few) and len(few) == len(got)
    assert K.chunk(docs.limit(0)).count() == 0


def test_tokens_of_few_texts_at_a_time(spark, monkeypatch):
    """A batch is taken in steps of bounded bytes, a longer text by itself; what is made is the same."""
    import pyarrow as pa

    from docloom.operators import vocabulary as V

    texts = ["one two three", None, "x " * 100, "", "é à  日本語　end \n", "last"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    whole = V.Encoder(V.read_vocabulary(V.default_vocabulary())).encode_all(texts)
    monkeypatch.setattr(V, "STEP_BYTES", 20)
    steps = list(V.text_steps(iter([batch]), 0))
    assert all(len(t) == 1 or sum(len((x or "").encode()) for x in t) <= 20 for _, t in steps)
    assert len(steps) > 2 and [x for _, t in steps for x in t] == texts
    monkeypatch.setattr(V, "REMEMBERED", 3)
    encoder = V.Encoder(V.read_vocabulary(V.default_vocabulary()))
    assert [i for t in texts for i in encoder.encode(t)[0]] == whole[1].tolist()
    assert [i for t in texts for i in encoder.encode(t)[2]] == whole[3].tolist()


def test_chunks_have_what_is_asked_for(spark):
    """No text goes back with each of its chunks, and what a query does not take is not made."""
    from docloom.operators import vocabulary as V
    from docloom.operators.chunks import chunk

    docs = spark.createDataFrame([("a", "word " * 1200), ("b", None)], "document_id string, text string")
    assert "text" not in V.cut(docs, 510, 128).columns
    slim = chunk(docs, columns=["document_id", "chunk_id"])
    assert slim.columns == ["document_id", "chunk_id"]
    assert "chunk_text" not in slim._jdf.queryExecution().analyzed().toString()
    assert sorted(r["chunk_id"] for r in slim.collect()) == sorted(r["chunk_id"] for r in chunk(docs).collect())


def test_new_words_are_covered_together():
    pieces = V.read_vocabulary(V.default_vocabulary())
    trie = V.Trie(pieces)
    rng = random.Random(5)
    words = ["".join(rng.choice("aetnß1é日😀zq") for _ in range(rng.randrange(1, 12))).encode() for _ in range(300)] + [b" ", b"the"]
    whole = V.np.frombuffer(b"".join(words), V.np.uint8)
    ends = V.np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    found = list(zip(*(x.tolist() for x in trie.cover_all(whole, starts, ends)), strict=True))
    at = {i: [] for i in range(len(words))}
    for word, first, end, piece in found:
        assert first == (starts[word] if not at[word] else starts[word] + at[word][-1][1])
        at[word].append((piece, end - starts[word]))
    assert [at[i] for i in range(len(words))] == [trie.cover(w) for w in words]
    # a call covers the words that are new to it at once, and known ones not again
    encoder, calls = V.Encoder(pieces), []
    encoder.trie.cover_all = lambda *a, f=encoder.trie.cover_all: calls.append(len(a[1])) or f(*a)
    encoder.encode_all(["one two three two", "one four"])
    encoder.encode_all(["one two", "one three"])
    assert calls == [4]


def test_texts_of_a_distribution_are_cut_once(spark):
    from docloom.queries import queries

    plan = queries()["e20_chunk_distribution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_a_task_remembers_few_words():
    """What a task keeps of words doesn't grow with its texts, and what it makes stays the same."""
    import pyarrow as pa

    def word(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    texts = [" ".join(word(i) for i in range(at, at + 2000)) for at in range(0, 180_000, 2000)]
    encoder, most, n = V.Encoder(V.read_vocabulary(V.default_vocabulary())), 0, 0
    for _, step in V.text_steps(iter([pa.RecordBatch.from_pydict({"text": texts})]), 0):
        offsets, _, starts, ends = encoder.encode_all(step)
        assert sum(map(len, step)) <= 1 << 19
        assert all((starts[a], ends[b - 1]) == (0, len(t)) for t, a, b in zip(step, offsets[:-1], offsets[1:], strict=True))
        most, n = max(most, len(encoder.known)), n + len(step)
    assert n == len(texts) and most < 1 << 17
