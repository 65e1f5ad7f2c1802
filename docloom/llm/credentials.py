"""Secret scans: declared patterns, and a token-efficiency test for what no pattern names.

Text that people write is cheap for a byte-pair vocabulary: few tokens for many
characters. Random strings are not. Long unbroken strings that take many tokens
for their length are reported as kind "random", unless they look like a known
digest or identifier (declared below) or overlap a span that a pattern found. Where
a string with separators (/ _ - =) is not random as a whole, each part of it is
tested by itself.

Defined cases: a null text counts as empty and has no spans; repeated rows are
scanned each for itself; very long texts are scanned whole; offsets are code points
and ends are exclusive; only the named columns are read, so others may have any name
(redact_secrets keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_of
from docloom.llm.fertility import vocabulary_path

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Strings that the token test looks at.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), UUIDs, plain numbers and times, and content addresses.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+|sha(?:1|224|256|384|512)[-=][A-Za-z0-9+/=]+|Qm[1-9A-HJ-NP-Za-km-z]{44})"
)
#: Candidates that are none as a whole but may have a random part.
PATH = re.compile(r"/?(?:[a-z_-]+/)+[a-z_-]*")
#: What stands between such characters is looked at by itself too.
SEGMENT = re.compile(r"[A-Za-z0-9+]{20,}")


@dataclass(frozen=True)
class SecretRules:
    """Parameters. vocabulary: a tiktoken rank file; a candidate with fewer characters per token than max_chars_per_token is random."""

    vocabulary: str = "byte_bpe_50k.tiktoken"
    max_chars_per_token: float = 2.0
    min_assigned: int = 6


def load_tiktoken(name: str, specials: tuple[tuple[str, int], ...] = ()):
    """The ranks of a vocabulary file; specials are the strings that encode() takes as one id."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(specials))


def base_spans(text: str, rules: SecretRules) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end), leftmost and non-overlapping within each kind. Matches that are too short are dropped after matching, as they use up their text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= rules.min_assigned] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, int]], rules: SecretRules, vocabulary) -> list[tuple[int, int, int]]:
    def free(a: int, b: int) -> bool:
        return not any(x < b and a < y for x, _, y in taken)

    def random(piece: str) -> bool:
        return not KNOWN.fullmatch(piece) and len(piece) < rules.max_chars_per_token * len(vocabulary.encode_ordinary(piece))

    found = []
    for m in CANDIDATE.finditer(text):
        if KNOWN.fullmatch(m[0]):
            continue
        if free(m.start(), m.end()) and not PATH.fullmatch(m[0]) and random(m[0]):
            found.append((m.start(), 3, m.end()))
            continue
        for part in SEGMENT.finditer(text, m.start(), m.end()):
            if (part.start(), part.end()) != (m.start(), m.end()) and free(part.start(), part.end()) and random(part[0]):
                found.append((part.start(), 3, part.end()))
    return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with each run of touching or overlapping spans replaced by mark."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, rules: SecretRules | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document with its spans, in one pass without a shuffle."""
    rules = rules or SecretRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_tiktoken(rules.vocabulary)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text, rules)
                more = random_spans(text, base, rules, vocabulary)
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more)))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["key", *(m.split()[0] for m in SPANS.split(", "))])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text")).mapInArrow(run, f"key {kind}, {SPANS}").withColumnRenamed("key", id_column)


def redact_secrets(docs: DataFrame, rules: SecretRules | None = None, text_column: str = "text", length_column: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The documents with their secrets replaced by a mark. A text without any, null included, stays as it is; length_column, where there is one, follows the text."""
    rules = rules or SecretRules()
    place = docs.columns.index(text_column)
    length = docs.columns.index(length_column) if length_column in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_tiktoken(rules.vocabulary)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            changed = False
            lengths = batch.column(length).to_pylist() if length is not None else []
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text, rules)
                    if spans := base + random_spans(text, base, rules, vocabulary):
                        texts[i], changed = masked(text, spans, mark), True
                        if length is not None:
                            lengths[i] = len(texts[i])
            if changed:
                columns = list(batch.columns)
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                if length is not None:
                    columns[length] = pa.array(lengths, batch.schema.field(length).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
