"""The registered queries over whole small tables: against their SQL, or brute force."""

import hashlib
import random
import string
import zlib

import brute
import duckdb
import pytest
from test_native_operators import INVALID, VALUES, brute_overlaps
from test_recurrence import brute_phrases, brute_strings
from test_text_operators import brute_base, brute_components, brute_fingerprint, brute_similar, reference_ids

import corpus_pipeline
from docloom.llm import credentials, decontaminate, fertility, pseudonyms, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in found.columns) for r in df.collect()) == sorted(found.fetchall())


def test_op1(spark, rows):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = brute_overlaps(rows, items, decontaminate.Seeds())
    got = {(r.doc_id, i) for r in queries.op1_decontaminate(spark, SF).collect() for i in map(int, r["items"].split(","))}
    assert got == want


def test_op2(spark, rows):
    fps = {d: brute_fingerprint(t) for d, t in rows}
    want = brute_components(fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()} == {(d, f"{f:016x}", want[d]) for d, f in fps.items()}


def test_op3_and_op8(spark, rows):
    ids = {d: reference_ids(t) for d, t in rows}
    assert {(r.doc_id, r.n_tokens) for r in queries.op3_token_counts(spark, SF).collect()} == {(d, len(x)) for d, x in ids.items()}
    for r in queries.op8_packing(spark, SF).collect():
        piece = [*ids[r.doc_id], 1][r.start : r.start + r.length]
        assert (len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)), len(ids[r.doc_id]) + 1) == (r.length, r.ids_crc32, r.doc_tokens)


@pytest.fixture(scope="module")
def verdicts(rows):
    """Each document's quality measures and verdict, by brute force."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    out = {}
    for d, t in rows:
        base = brute_base(t)
        out[d] = base, brute.quality_verdict(t or "", lang[d], model, (base[0], base[4]), fertility.LANGUAGES, fertility.BANDS, fertility.script_of(t or ""), fertility.guess_language)
    return out


def test_op5(spark, rows, verdicts):
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, SF).collect()}
    for d, (base, (n, per_token, fallback, entropy, kept)) in verdicts.items():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert (r.n_tokens, r.kept) == (n, kept) and r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert (r.chars_per_token, r.byte_share, r.entropy_share) == (pytest.approx(per_token), pytest.approx(fallback), pytest.approx(entropy))
    assert any(not r.kept and not r.base_failed for r in got.values())  # the method's own rejections


def test_op6_and_op10(spark, rows):
    want = brute_strings(rows, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, SF).collect()} == want
    want = brute_phrases(rows, 13)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op10_phrase_dedup(spark, SF).collect()} == want


def spans_of(text):
    return brute.secret_spans(text or "", lambda piece: len(reference_ids(piece)), credentials.KNOWN.pattern, credentials.PATH.pattern)


def test_op7(spark, rows):
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, SF).collect()}
    for d, t in rows:
        base, spans = spans_of(t)
        assert got[d].spans == spans and got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex, got[d].n_random) == tuple(spans.count(f"{k}:") for k in credentials.KINDS)


def test_op7_finds_planted_strings(spark):
    rng = random.Random(6)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    prose = "the house by the river was sold to people who had seen it once".split()
    planted = []
    for i in range(400):
        chars = [string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase + string.digits, "0123456789abcdef"][i % 4]
        words = [rng.choice(prose) for _ in range(30)]
        words.insert(rng.randrange(30), draw(chars, rng.randint(24, 48)))
        planted.append((i, " ".join(words)))
    got = {r.doc_id: r.spans for r in credentials.scan_secrets(spark.createDataFrame(planted, "doc_id long, text string")).collect()}
    for i, t in planted:
        assert got[i] == spans_of(t)[1]
    assert sum(bool(s) for s in got.values()) >= 0.95 * len(planted)


def test_op9(spark, rows):
    got = {r.doc_id: r for r in queries.op9_pseudonyms(spark, SF).collect()}
    for d, t in rows:
        assert (got[d].text, got[d].n_private) == brute.pseudonymised(t, queries.DEMO_KEY)
    assert sum(r.n_private for r in got.values()) > 20  # the table has 23


def test_op9_formats(spark):
    texts = [*VALUES, *INVALID, "a@b.example and 1.2.3.4, +1 499.555.6503; 4845-1681-1440-7329 or 123-45-6789-0 and 1.2.3.4.5", "", "2020-02-30 1999-12-31x 21 2021-01-01", "+1 499 555 6503abc@x.example..b@c.example 1.2.3.4x@y.z", "a@b@c.d e@f. .@g.h"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pseudonyms.pseudonymise(frame, "k").collect():
        assert (r.text, r.n_private) == brute.pseudonymised(texts[r.doc_id], "k")


def test_op9_long_words_and_clashing_names(spark):
    """Time in proportion to the text, and all other columns as they were."""
    import time

    rows = [(1, "ab" * 500_000, "kept", "too"), (2, "a@" + "b" * 1_000_000 + " 1.2.3.4", "kept", "too"), (3, "1" * 1_000_000, "kept", "too"), (4, "x." * 500_000, "kept", "too")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `pii new` string, `fo``und` string")
    began = time.time()
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame, "k").collect()}
    assert time.time() - began < 30
    assert all(tuple(r)[2:4] == ("kept", "too") for r in got.values())
    assert [got[i].n_private for i in (1, 2, 3, 4)] == [0, 1, 0, 0] and got[1].text == rows[0][1]


def test_op9_key(spark, monkeypatch):
    """Long keys are hashed first; on a cluster there is no key but the session's."""
    key = "k" * 100
    got = pseudonyms.pseudonymise(spark.createDataFrame([(1, VALUES[0])], "doc_id long, text string"), key).first()
    assert (got.text, got.n_private) == brute.pseudonymised(VALUES[0], key)

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="pseudonym.key"):
        queries.pseudonym_key(Cluster)


def test_pipeline(spark, rows, verdicts):
    """The stages one after the other by brute force, down to what is packed."""
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = dict(rows)
    docs = {d: t for d, t in docs.items() if verdicts[d][1][-1]}
    part = brute_similar(docs.items())
    docs = {d: t for d, t in docs.items() if part[d] == d}
    leaks = {d for d, _ in brute_overlaps(list(docs.items()), items, decontaminate.Seeds())}
    docs = {d: t for d, t in docs.items() if d not in leaks}
    want = {}
    for d, t in docs.items():
        spans = [(int(a), 0, int(b)) for a, b in (x.split(":")[1:] for x in spans_of(t)[1].split(",") if x)]
        want[d] = [*reference_ids(credentials.masked(t, spans, "[SECRET]")), 1]
    got = {}
    for r in corpus_pipeline.run(spark, SF).orderBy("start").collect():
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want and len(want) < len(rows)


def test_stages_handle_nulls_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (None, "word " * 30 + "end of it", "en", "s", 1, 3), (3, None, None, "s", None, 4), (3, None, None, "s", None, 4)], "doc_id long, text string, lang string, source string, n_chars long, `losing id` int")
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            out.collect()
            if name != "packing":
                assert out.columns == frame.columns
