"""Quality rules: surface statistics of a text, and how a public vocabulary cuts it.

Fertility is measured under a SentencePiece vocabulary with byte fallback:
characters per token, the share of tokens that are fallback bytes, and the
entropy of the token distribution. Rejection bands are declared per language,
from the measured distributions of clean texts, and more widely per script; a
text outside the bands of its language or script is rejected. The language is
that of the lang column, or a guess by function words where there is none; where
the label and the guess name two languages, only the bands of the script hold.

Defined cases: a null or empty text has no words, fails the base rules and has
null measures; repeated rows are measured each for itself; very long texts are never
cut; only the named columns are read, so others may have any name (keep_quality keeps them);
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_of


@dataclass(frozen=True)
class Band:
    """A text is kept if its measures lie within. Entropy, in bits, counts as a share of what a text of its length could have."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy_share: float


#: Bands by script; wide enough for plain prose, and for scripts that the vocabulary knows only by bytes.
BANDS: dict[str, Band] = {
    "latin": Band((1.2, 12.0), 0.10, 0.25),
    "cyrillic": Band((0.8, 10.0), 0.20, 0.25),
    "greek": Band((0.5, 8.0), 0.60, 0.20),
    "arabic": Band((0.4, 8.0), 0.70, 0.20),
    "indic": Band((0.3, 8.0), 0.95, 0.15),
    "cjk": Band((0.3, 4.0), 0.80, 0.20),
    "other": Band((0.2, 12.0), 1.00, 0.15),
    "none": Band((0.9, 12.0), 0.30, 0.20),
}

@dataclass(frozen=True)
class LanguageBand:
    """What clean texts of a language measure under the default vocabulary. Short texts scatter more, and repeat tokens less:
    a text of n tokens has at least chars_per_token - chars_slack / sqrt(n) characters per token, and an entropy share of at least
    entropy_share + entropy_slope * log2(n / 1024). Beyond the measured range of tokens, the ends of the range hold."""

    chars_per_token: float
    chars_slack: float
    byte_share: float
    entropy_share: float
    entropy_slope: float
    tokens: tuple[float, float]

    def fits(self, n: int, per_token: float, byte_share: float, entropy_share: float) -> bool:
        n = min(max(n, self.tokens[0]), self.tokens[1])
        return per_token >= self.chars_per_token - self.chars_slack / n**0.5 and byte_share <= self.byte_share and entropy_share >= self.entropy_share + self.entropy_slope * float(np.log2(n / 1024))


def derive_band(n: np.ndarray, per_token: np.ndarray, byte_share: np.ndarray, entropy_share: np.ndarray, outside: float = 0.002) -> LanguageBand:
    """The band of the clean texts so measured; each lower bound leaves so small a share of them outside."""
    doublings = np.log2(n / 1024)
    slope, level = np.polyfit(doublings, entropy_share, 1)
    middle = float(np.median(per_token))
    slack = -np.quantile((per_token - middle) * np.sqrt(n), outside)
    level += np.quantile(entropy_share - level - slope * doublings, outside)
    return LanguageBand(middle, float(slack), float(byte_share.max()), float(level), float(slope), (float(n.min()), float(n.max())))


#: By derive_band, rounded outwards, from the labelled quality = 1 documents of sf0.1 that pass the base rules (2,013 en, 488 de, 490 fr, 311 es).
LANGUAGES: dict[str, LanguageBand] = {
    "en": LanguageBand(2.635, 6.10, 0.06, 0.648, -0.0523, (47, 10184)),
    "de": LanguageBand(2.625, 4.05, 0.05, 0.636, -0.0543, (47, 11522)),
    "fr": LanguageBand(2.355, 5.40, 0.05, 0.632, -0.0534, (105, 12515)),
    "es": LanguageBand(2.296, 3.60, 0.05, 0.628, -0.0530, (68, 7325)),
}

#: Function words and letters by which a text without a lang column is named; junk may have few of the words.
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the of and to a in is that it for was on with be by as this are at from".split()),
    "de": frozenset("der die das und in den von zu mit sich auf des für ist nicht dem im ein eine als".split()),
    "fr": frozenset("de la le et les des en un du une que pour est qui par dans sur au pas avec".split()),
    "es": frozenset("de la que el en y los se del las por un no con su una es para al como".split()),
}
LETTERS: dict[str, str] = {"en": "w", "de": "äöüß", "fr": "èêçà", "es": "ñóíá"}

#: First code point of each range, and its script.
RANGES: list[tuple[int, str]] = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"),
    (0x00B5, "latin"), (0x00B6, "none"), (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"), (0x00D7, "none"), (0x00D8, "latin"),
    (0x00F7, "none"), (0x00F8, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "indic"), (0x0E00, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"),
    (0x3000, "none"), (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x1F000, "none"), (0x20000, "cjk"), (0x32000, "other"),
]
_STARTS = np.array([a for a, _ in RANGES], dtype=np.uint32)
_NAMES = list(dict.fromkeys(s for _, s in RANGES))
_SCRIPT = np.array([_NAMES.index(s) for _, s in RANGES])


@dataclass(frozen=True)
class QualityRules:
    """Parameters. vocabulary: a SentencePiece model, by the tokenizer package's name for it, or a path."""

    vocabulary: str = "piece_bpe_32k.model"
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    bands: dict[str, Band] = field(default_factory=lambda: dict(BANDS))
    languages: dict[str, LanguageBand] = field(default_factory=lambda: dict(LANGUAGES))


SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, script string, chars_per_token double, byte_share double, entropy_share double, base_failed boolean, kept boolean"


def vocabulary_path(name: str) -> str:
    """A path stays as it is; any other name is looked up among the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def script_of(text: str) -> str:
    """The script of most letters; 'none' without letters."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.bincount(_SCRIPT[np.searchsorted(_STARTS, points, side="right") - 1], minlength=len(_NAMES))
    counts[_NAMES.index("none")] = 0
    return _NAMES[int(counts.argmax())] if counts.any() else "none"


def guess_language(text: str) -> str | None:
    """The language with the most function words and letters of its own, if they are a hundredth of the words at least and no other language has as many."""
    lowered = text.lower()
    counts = Counter(w.strip(".,;:!?#$%&*\"'()") for w in lowered.split())
    found = sorted(((sum(counts[w] for w in words) + sum(map(lowered.count, LETTERS[name])), name) for name, words in FUNCTION_WORDS.items()), reverse=True)
    return found[0][1] if found[0][0] > found[1][0] and 100 * found[0][0] >= counts.total() else None


def repeat_words(words: list[bytes], window: int) -> int:
    """Words covered by windows of so many words that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint64, count=len(words))
    hashed = np.zeros(n, dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for j in range(window):
        hashed = hashed * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    order = np.sort(hashed)
    if not (order[1:] == order[:-1]).any():
        return 0
    # exact names for the windows: those of the first 1, 2, 3 ... words, one after the other
    names = ids[:n].astype(np.int64)
    for j in range(1, window):
        names = np.unique(names * (len(known) + 1) + ids[j : j + n].astype(np.int64), return_inverse=True)[1]
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def base_measures(text: str, rules: QualityRules) -> tuple[int, int, int, int, int]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            dup_lines += line in seen
            seen.add(line)
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), dup_lines, repeat_words(words, rules.window)


def _measure(rules: QualityRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(rules.vocabulary))
        is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            languages = batch.column(2).to_pylist() if batch.num_columns > 2 else map(guess_language, texts)
            out: list[tuple] = []
            for text, language in zip(texts, languages, strict=True):
                base = base_measures(text, rules)
                failed = base[0] < rules.min_words or 100 * base[4] > rules.max_repeat_percent * base[0]
                ids = np.array(model.encode(text), dtype=np.int64)
                script = script_of(text)
                if not len(ids):
                    out.append((*base, 0, script, None, None, None, failed, False))
                    continue
                ids.sort()
                counts = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
                share = counts / len(ids)
                entropy = float(-(share * np.log2(share)).sum() / np.log2(max(2, min(len(ids), len(is_byte)))))
                per_token, fallback = len(text) / len(ids), float(is_byte[ids].mean())
                band = rules.bands[script]
                fine = band.chars_per_token[0] <= per_token <= band.chars_per_token[1] and fallback <= band.byte_share and entropy >= band.entropy_share
                # names such as en-GB and EN count as en; a language without bands of its own has those of its script
                name = re.split("[-_]", language.lower())[0] if language else None
                if fine and name in rules.languages and not rules.languages[name].fits(len(ids), per_token, fallback, entropy):
                    # a text that speaks for another language than its label is not measured by the label's bands
                    fine = guess_language(text) not in (name, None)
                out.append((*base, len(ids), script, per_token, fallback, entropy, failed, bool(fine and not failed)))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(12)]
            kinds = [pa.int64()] * 6 + [pa.string()] + [pa.float64()] * 3 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["key", *(m.split()[0] for m in MEASURES.split(", "))])

    return run


def quality(docs: DataFrame, rules: QualityRules | None = None, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """A row of measures and verdicts per document, in one pass without a shuffle."""
    kind = docs.schema[id_column].dataType.simpleString()
    language = [F.col(language_column).cast("string").alias("lang")] if language_column in docs.columns else []
    return docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text"), *language).mapInArrow(_measure(rules or QualityRules()), f"key {kind}, {MEASURES}").withColumnRenamed("key", id_column)


def keep_quality(docs: DataFrame, rules: QualityRules | None = None, text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns, in one pass: each batch of whole rows is measured and filtered in place."""
    rules = rules or QualityRules()
    place = docs.columns.index(text_column)
    named = docs.columns.index(language_column) if language_column in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _measure(rules)
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).fill_null("")
            columns = [texts, texts] if named is None else [texts, texts, batch.column(named).cast(pa.string())]
            got = next(measure(iter([pa.RecordBatch.from_arrays(columns, names=["key", "text", "lang"][: len(columns)])])))
            yield batch.filter(got.column(got.schema.get_field_index("kept")))

    return docs.mapInArrow(run, docs.schema)
