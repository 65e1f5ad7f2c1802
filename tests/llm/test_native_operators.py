"""Chat formatting, pseudonyms and decontamination against brute force."""

import hashlib
import re

from pyspark.sql import functions as F

from docloom.llm import chat, decontaminate, pseudonyms

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </s> \\ <|start|>user<|text|>x"), (1, 2, "assistant", "[INST] ok [/INST] \\\\ \\<"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "assistant", "first"), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (3, 5, "user", "a"), (3, 9, "assistant", "b"), (4, 0, None, "no role"), (4, 1, "<|end|>", "[[INST]"), (None, 0, "user", "x"),
]
ALONE = [(None, 0, "user", "y"), (None, 1, "assistant", "z")]


def test_chat_round_trip(spark):
    frame = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, segments string")
    made = chat.format_chats(frame)
    got = {r.conv_id: r for r in made.select("conv_id", "n_turns", "order_valid", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_learnt(F.col("segments")).alias("learnt")).collect()}
    convs = {}
    for c, n, role, text in TURNS:
        convs.setdefault(c, []).append((n, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].learnt == "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
        assert got[c].n_turns == len(turns)
    assert got[1].order_valid and got[3].order_valid and not got[2].order_valid and not got[4].order_valid and not got[None].order_valid
    for s in ("</s>", "[INST]", "[/INST]"):
        assert s not in got[1].formatted
    assert got[1].formatted.count("<|start|>") == 5
    assert chat.format_chats(frame.where("turn < 0")).count() == 0
    alone = chat.format_chats(spark.createDataFrame(ALONE, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.n_turns, r.segments[1].text) for r in alone) == [(1, "y"), (1, "z")]


def test_op4_returns_the_contract(spark):
    from docloom.llm.queries import op4_chat_format

    got = {r.conv_id: r for r in op4_chat_format(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    convs = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


VALUES = ["4845168114407329", "+1 (499) 555-6503", "+1 499-555-6503", "+1 (099) 555-6503", "2020-02-29", "1999-12-31", "123-45-6789", "899-01-0001", "152.143.123.131", "0.0.0.0", "255.255.255.255", "4845 1681 1440 7329"]
INVALID = ["2020-02-31", "666-45-6789", "000-45-6789", "152.343.123.131", "4845168114407328"]


def luhn(digits):
    twice = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def test_pseudonyms_are_permutations(spark):
    frame = spark.createDataFrame([(v,) for v in VALUES + INVALID], "v string")
    x = frame.withColumn("p", pseudonyms.pseudonym(F.col("v"), "k1")).withColumn("back", pseudonyms.pseudonym(F.col("p"), "k1", True)).withColumn("other", pseudonyms.pseudonym(F.col("v"), "k2"))
    got = {r.v: r for r in x.collect()}
    for v in VALUES:
        assert got[v].p != v and got[v].back == v and got[v].p != got[v].other
        assert re.sub("[0-9]+", "0", got[v].p) == re.sub("[0-9]+", "0", v)
    for v in INVALID:
        assert got[v].p == v
    assert luhn(got["4845168114407329"].p)
    assert re.sub(" ", "", got["4845 1681 1440 7329"].p) == got["4845168114407329"].p


def test_feistel_is_a_bijection(spark):
    n = 7 * 11
    out = spark.range(n).select(pseudonyms._feistel(F.col("id"), 7, 11, "k", "t").alias("y")).collect()
    assert sorted(r.y for r in out) == list(range(n))


def test_pseudonymise_texts(spark):
    rows = [(1, "call +1 (499) 555-6503, or 4845168114407329.\nx@y.example.com on 2020-02-29", 3, "z"), (2, None, None, "z"), (3, "", 0, "z"), (4, "clean text 12345", 16, "z"), (5, "+1 (499) 555-6503", 17, "z"), (6, "bad 4845168114407328 x.", 3, "z")]
    out = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n_private string").drop("n_private").withColumn("key", F.lit("k")), "k")
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].n_private == 4 and got[1].text.startswith("call +1 (") and "\nu" in got[1].text and got[1].text.endswith(got[1].text[-10:])
    assert got[5].text in got[1].text and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "" and got[4].text == "clean text 12345" and got[6].text == "bad 4845168114407328 x." and got[6].n_private == 0
    assert out.where("doc_id < 0").count() == 0


def brute_overlaps(docs, items, seeds):
    words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    under = lambda w, at, mask: tuple(w[at + j] for j, one in enumerate(mask) if one == "1")
    said, table = {i: words(b) for i, b in items}, {}
    for i, v in said.items():
        for start in range(len(v) - seeds.span + 1):
            for m in seeds.masks:
                table.setdefault((m, under(v, start, m)), []).append((i, start))
    found, reach = set(), seeds.window - seeds.span
    for d, t in docs:
        w = words(t)
        for at in range(len(w) - seeds.span + 1):
            for i, start in {x for m in seeds.masks for x in table.get((m, under(w, at, m)), ())}:
                v = said[i]
                same = [int(0 <= at + j < len(w) and 0 <= start + j < len(v) and w[at + j] == v[start + j]) for j in range(-reach, seeds.span + reach)]
                if max(sum(same[k : k + seeds.window]) for k in range(reach + 1)) >= -(-min(seeds.window, len(v)) * seeds.share // 1):
                    found.add((d, i))
    return found


def test_overlaps(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, draw(rng.choice([8, 11, 14, 30, 45]))) for i in range(25)]
    docs = [(d, draw(rng.choice([5, 60, 90]))) for d in range(40)]
    for d in range(20):
        piece = list(items[d][1])
        for _ in range(d % 5):
            piece[rng.randrange(len(piece))] = "X,"
        docs[d][1][3:3] = piece
    docs = [(d, " ".join(w)) for d, w in docs] + [(90, None), (91, ""), (92, "W1 " * 500)]
    items = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, "w1 " * 30)]
    seeds = decontaminate.Seeds()
    frame = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, words string").repartition(3)
    table = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, item string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame, table, seeds).collect()}
    want = brute_overlaps(docs, items, seeds)
    assert got == want and len(want) > 10
    kept = decontaminate.decontaminate(frame, table, seeds)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.contaminated(frame, table.where("item_id < 0"), seeds).count() == 0
    assert decontaminate.contaminated(frame.where("doc_id < 0"), table, seeds).count() == 0
