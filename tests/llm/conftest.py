import random

import pytest

ALPHABET = ["the", "of", "and", "tion", "er", "st", "lé", "ñaga", "wh", "on,", "in.", "queux", "THE", "ed"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int, str | None]]:
    """Plain, empty, null, long, tied, repeated and near-copied texts."""
    rng = random.Random(7)
    out: list[tuple[int, str | None]] = [(i, prose(rng, rng.choice([5, 30, 80, 200]))) for i in range(60)]
    out += [(100, ""), (101, None), (102, " \n\t "), (103, "one"), (104, "one two"), (105, "a" * 5000), (106, " ".join(["same"] * 500)), (107, "\n".join(["a line of words that repeats itself"] * 30))]
    out += [(110 + i, out[3][1]) for i in range(5)]  # exact copies
    words = prose(rng, 300).split()
    for i in range(12):  # near copies
        changed = list(words)
        changed[rng.randrange(300)] = f"edit{i}"
        out.append((130 + i, " ".join(changed)))
    passage = prose(rng, 60)
    out += [(160 + i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}") for i in range(8)]
    line = "A very common line that stands in many documents of this table, and is just about a hundred bytes."
    out += [(200 + i, f"{prose(rng, 15)}\n{line}\n{prose(rng, 15)}") for i in range(120)]
    out.append((400, prose(rng, 20000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Columns as in documents, with extra ones whose names clash with those the operators use."""
    rows = [(i, t, "en", "src0", len(t or ""), i, "k", 0.5) for i, t in texts]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, file string, label double")
    return frame.repartition(3)
