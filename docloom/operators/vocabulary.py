"""Token ids of a public vocabulary, with the places of the tokens in the text.

A text is cut into words (runs of letters, of digits, of other signs; white space
between them has no tokens). The bytes of a word, after a space if it follows white space or
begins the text, are covered from the left by the longest pieces of the vocabulary, which are found in a
trie. Places count characters; a piece that ends within a character covers it.

Defined cases: a null or blank text has no tokens; a vocabulary without all single
bytes is refused, so that any text has its tokens; a word of any length takes time in
proportion to it.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

WHITE = r"\x20\x09-\x0D"
BLANKS = " \t\n\v\f\r"
RUNS = rf"[{WHITE}]+|\p{{L}}+|\p{{N}}+|[^{WHITE}\p{{L}}\p{{N}}]+"
#: A vocabulary goes to every task: it is a file of at most so many bytes.
MOST_BYTES = 64 << 20
#: Longer words are covered anew each time. So many are remembered that a task's table is full, and grows no more, after a few megabytes of text.
REMEMBERED_LENGTH, REMEMBERED = 64, 1 << 16
#: Bytes of texts that a task has tokens of at a time.
STEP_BYTES = 1 << 19
#: Bytes of a word up to which it is covered together with others.
LONGEST_TOGETHER = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> dict[bytes, int]:
    """Of lines with a piece in base 64 and its id."""
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"a vocabulary has at most {MOST_BYTES} bytes")
    pieces = {base64.b64decode(piece): int(i) for piece, i in (line.split() for line in raw.splitlines() if line.strip())}
    if any(bytes([b]) not in pieces for b in range(256)):
        raise ValueError("a vocabulary has all single bytes")
    return pieces


class Trie:
    """The pieces as a tree: step from a node by a byte, node 0 being the root. ids: of the piece that ends at a node, -1 for none."""

    def __init__(self, pieces: dict[bytes, int]) -> None:
        self.steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        steps = self.steps
        for piece, i in pieces.items():
            node = 0
            for b in piece:
                node = steps.setdefault(node << 8 | b, len(steps) + 1)
            ends[node] = i
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        to = np.fromiter(steps.values(), np.int64, len(steps))
        order = np.argsort(keys)
        # one that no step equals ends the search
        self.keys, self.to = np.append(keys[order], -1), np.append(to[order], 0)
        self.ids = np.full(len(steps) + 1, -1, dtype=np.int64)
        self.ids[list(ends.keys())] = list(ends.values())

    def cover(self, word: bytes) -> list[tuple[int, int]]:
        """(id, end) of the longest pieces from the left."""
        out, at, n, steps, ids = [], 0, len(word), self.steps, self.ids
        while at < n:
            node, i = 0, at
            while i < n and (node := steps.get(node << 8 | word[i])) is not None:
                i += 1
                if ids[node] >= 0:
                    best = (int(ids[node]), i)
            out.append(best)
            at = best[1]
        return out

    def cover_all(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, first byte, end, id) of the pieces of many words, by word and place. raw: the bytes of all; a word is that from a start to an end. All words go on by a byte at a time."""
        word, found = np.arange(len(starts)), []
        at, place, end = starts.copy(), starts.copy(), ends.copy()
        node, best, best_id = np.zeros(len(starts), np.int64), starts.copy(), np.full(len(starts), -1)
        last = len(self.keys) - 2
        while len(word):
            inside = place < end
            key = node << 8 | raw[np.where(inside, place, at)]
            i = np.searchsorted(self.keys[:-1], key)
            goes = inside & (self.keys[np.minimum(i, last)] == key)
            node = np.where(goes, self.to[np.minimum(i, last)], 0)
            place = np.where(goes, place + 1, place)
            ended = goes & (self.ids[node] >= 0)
            best, best_id = np.where(ended, place, best), np.where(ended, self.ids[node], best_id)
            stopped = np.flatnonzero(~goes)
            if len(stopped):
                found.append((word[stopped], at[stopped], best[stopped], best_id[stopped]))
                at[stopped] = place[stopped] = best[stopped]
                left = at < end
                if not left.all():
                    word, at, place, end, node, best, best_id = (x[left] for x in (word, at, place, end, node, best, best_id))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        words, firsts, lasts, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        # words lie one after the other
        order = np.argsort(firsts)
        return words[order], firsts[order], lasts[order], ids[order]


class Encoder:
    """encode_all(texts) gives the tokens of many texts as flat arrays. Distinct words, with the white space before them, are covered once, all new ones of a call together, and numbered; a text is a gather from the table of these."""

    def __init__(self, pieces: dict[bytes, int]) -> None:
        import regex

        self.trie = Trie(pieces)
        self.runs = regex.compile(rf"[{WHITE}]*+(?:\p{{L}}++|\p{{N}}++|[^{WHITE}\p{{L}}\p{{N}}]++)")
        # the same for ASCII texts, in less time
        self.ascii_runs = re.compile(rf"[{WHITE}]*+(?:[A-Za-z]++|[0-9]++|[^{WHITE}A-Za-z0-9]++)")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.firsts, self.lasts, self.ends, self.lengths = array("i"), array("i"), array("i"), array("q", [0]), array("q")

    def learn(self, keys: list[str]) -> None:
        """Takes words with the white space before them into the table. A blank after a word says that it begins a text, as after white space."""
        words = [k.strip(BLANKS) for k in keys]
        begins = np.array([k[-1] == " " for k in keys])
        sizes = np.array([len(w) for w in words])
        blank = np.array([len(k) for k in keys]) - sizes - begins
        spaced = ((blank > 0) | begins).astype(np.int64)
        parts = [b" " + raw if s else raw for raw, s in zip((w.encode("utf-8", "surrogatepass") for w in words), spaced.tolist(), strict=True)]
        whole = b"".join(parts)
        raw, n = np.frombuffer(whole, dtype=np.uint8), np.array([len(p) for p in parts])
        ends = np.cumsum(n)
        starts = ends - n
        # a long word alone, as all others would be done long before it
        short = np.flatnonzero(n <= LONGEST_TOGETHER)
        pieces = self.trie.cover_all(raw, starts[short], ends[short])
        if len(short) == len(n):
            of, first, last, ids = pieces
        else:
            made = [(short[pieces[0]], *pieces[1:])]
            for i in np.flatnonzero(n > LONGEST_TOGETHER).tolist():
                covered = np.array(self.trie.cover(parts[i]))
                stops = starts[i] + covered[:, 1]
                made.append((np.full(len(stops), i), np.concatenate((starts[i : i + 1], stops[:-1])), stops, covered[:, 0]))
            of, first, last, ids = (np.concatenate(x) for x in zip(*made, strict=True))
            order = np.argsort(first)
            of, first, last, ids = of[order], first[order], last[order], ids[order]
        # characters that have begun at each byte
        begun = np.cumsum((raw & 0xC0) != 0x80)
        zero = (starts + spaced)[of]
        firsts = begun[np.maximum(first, zero)] - begun[zero] + blank[of]
        lasts = begun[last - 1] - begun[zero] + 1 + blank[of]
        for to, values in ((self.ids, ids), (self.firsts, firsts), (self.lasts, lasts)):
            to.frombytes(values.astype(np.int32).tobytes())
        at = len(self.lengths)
        self.ends.frombytes((self.ends[-1] + np.cumsum(np.bincount(of, minlength=len(n)))).astype(np.int64).tobytes())
        self.lengths.frombytes((blank + sizes).astype(np.int64).tobytes())
        self.known.update(zip(keys, range(at, at + len(keys)), strict=True))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets of the texts' tokens, ids, first places, ends); places count within each text."""
        if len(self.lengths) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self.forget()
        runs, counts = [], []
        for text in texts:
            text = (text or "").rstrip(BLANKS)
            found = (self.ascii_runs if text.isascii() else self.runs).findall(text)
            if found and found[0][0] not in BLANKS:
                found[0] += " "
            runs += found
            counts.append(len(found))
        known = self.known
        new = list(set(runs).difference(known))
        if new:
            self.learn(new)
        words = list(map(known.__getitem__, runs))
        for key in new:
            if len(key) > REMEMBERED_LENGTH:
                del known[key]
        # copies: the table may grow later, which views would forbid
        ids, firsts, lasts, ends, lengths = (np.array(x) for x in (self.ids, self.firsts, self.lasts, self.ends, self.lengths))
        of, per_text = np.array(words, dtype=np.int64), np.array(counts, dtype=np.int64)
        sizes = ends[of + 1] - ends[of]
        length = lengths[of]
        # where a word begins in its text
        before = np.cumsum(length) - length
        edges = np.concatenate(([0], np.cumsum(per_text)))
        total = np.concatenate(([0], np.cumsum(length)))[edges]
        before -= np.repeat(total[:-1], per_text)
        tokens = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(ends[of] - tokens[:-1], sizes) + np.arange(tokens[-1])
        shift = np.repeat(before, sizes)
        return tokens[edges], ids[at], (firsts[at] + shift).astype(np.int32), (lasts[at] + shift).astype(np.int32)

    def encode(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids and the first and last places of their characters."""
        _, ids, starts, ends = self.encode_all([text])
        return ids.tolist(), starts.tolist(), ends.tolist()


def token_windows(n: int, window: int, step: int) -> list[tuple[int, int]]:
    """The windows of n tokens, as chunks.window_ranges() has them."""
    if step <= 0:
        raise ValueError("step must be positive")
    count = 0 if n <= 0 else 1 if n <= window else 1 - (window - n) // step
    starts = [n - window if i == count - 1 and n > window else i * step for i in range(count)]
    return [(s, min(s + window, n)) for s in starts]


def text_steps(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The rows of batches, so many at a time that their texts (column at) have STEP_BYTES, one text at least: tokens take a multiple of their text."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0)).astype(np.int64)
        total = np.cumsum(sizes)
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(total, total[first] - sizes[first] + STEP_BYTES, side="right")))
            part = batch.slice(first, end - first)
            yield part, part.column(at).to_pylist()
            first = end


def encoded(docs: DataFrame, path: str | None = None, text_column: str = "text", columns: tuple[str, ...] = ("ids", "starts", "ends"), keep_text: bool = True) -> DataFrame:
    """docs with ids, starts and ends (arrays of int), or those of them that are named."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path or default_vocabulary()))  # bounded: see MOST_BYTES
    docs = docs.drop("ids", "starts", "ends")
    kept = [c for c in docs.columns if keep_text or c != text_column]
    schema = StructType([docs.schema[c] for c in kept])
    for name in columns:
        schema = schema.add(name, ArrayType(IntegerType()))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces.value)
        for part, texts in text_steps(batches, at):
            offsets, *found = encoder.encode_all(texts)
            lists = {n: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(f, pa.int32())) for n, f in zip(("ids", "starts", "ends"), found, strict=True)}
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(lists[n] for n in columns)], names=schema.names)

    return docs.mapInArrow(run, schema)


def cut(docs: DataFrame, window: int, overlap: int, path: str | None = None, text_column: str = "text", ends_only: bool = False, columns: tuple[str, ...] = ("chunk_text", "chunk_ids")) -> DataFrame:
    """A row per window of a document: docs but for the text, with chunk_index, total_chunks, token_start, token_end, chunk_text (cut from the text where the first token begins and the last one ends) and chunk_ids, or those of the last two that are named. ends_only: the first, the middle and the last one only."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path or default_vocabulary()))
    kept = [c for c in docs.columns if c != text_column]
    schema = StructType([docs.schema[c] for c in kept])
    for name in ("chunk_index", "total_chunks", "token_start", "token_end"):
        schema = schema.add(name, IntegerType())
    made = {"chunk_text": StringType(), "chunk_ids": ArrayType(IntegerType())}
    for name in columns:
        schema = schema.add(name, made[name])
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces.value)
        for part, texts in text_steps(batches, at):
            offsets, ids, starts, ends = encoder.encode_all(texts)
            rows: list[int] = []
            places: list[tuple[int, int, int, int]] = []
            for row, size in enumerate(np.diff(offsets).tolist()):
                windows = token_windows(size, window, window - overlap)
                n = len(windows)
                chosen = sorted({0, n // 2, n - 1}) if ends_only and n else range(n)
                rows += [row] * len(chosen)
                places += [(i, n, *windows[i]) for i in chosen]
            if not rows:
                continue
            table, of = np.array(places, dtype=np.int32), np.array(rows)
            first, end = offsets[of] + table[:, 2], offsets[of] + table[:, 3]
            out = [*(part.column(c).take(pa.array(of)) for c in kept), *(pa.array(table[:, j]) for j in range(4))]
            for name in columns:
                if name == "chunk_text":
                    out.append(pa.array([texts[row][a:b] for row, a, b in zip(rows, starts[first].tolist(), ends[end - 1].tolist(), strict=True)], pa.string()))
                else:
                    flat = np.concatenate([ids[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)])
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(end - first))), pa.int32()), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.mapInArrow(run, schema)


def has_tokens(text_column: str = "text"):
    """Whether a text has any token, without making them."""
    return F.coalesce(F.col(text_column).rlike(rf"[^{WHITE}]"), F.lit(False))


def _of_pieces(source: str, path: str) -> str:
    """DuckDB: (document_id, ids, starts, ends) of the documents of a relation, by the longest piece at each place of each distinct word."""
    white, runs = f"[{WHITE}]", RUNS.replace("'", "''")
    return f"""SELECT document_id, list(id ORDER BY i, s) AS ids, list(CAST(a + first AS INT) ORDER BY i, s) AS starts, list(CAST(a + last AS INT) ORDER BY i, s) AS ends FROM (
WITH RECURSIVE vocab AS MATERIALIZED (SELECT hex(from_base64(piece)) AS h, id FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'piece': 'VARCHAR', 'id': 'INT'}})),
runs AS (SELECT document_id, unnest(rs) AS w, unnest(range(len(rs))) AS i FROM (SELECT document_id, regexp_extract_all(text, '{runs}') AS rs FROM {source})),
placed AS MATERIALIZED (SELECT document_id, i, w, a, CASE WHEN spaced THEN '20' ELSE '' END || hex(encode(w)) AS hx, CAST(spaced AS INT) AS sp FROM (SELECT document_id, i, w, sum(length(w)) OVER (PARTITION BY document_id ORDER BY i) - length(w) AS a, coalesce(regexp_matches(lag(w) OVER (PARTITION BY document_id ORDER BY i), '{white}'), true) AS spaced FROM runs) WHERE NOT regexp_matches(w, '{white}')),
words AS MATERIALIZED (SELECT DISTINCT hx, sp, length(hx) // 2 AS n FROM placed),
tried AS (SELECT hx, s, n, unnest(range(1, least(n - s, (SELECT max(length(h)) // 2 FROM vocab)) + 1)) AS l FROM (SELECT hx, n, unnest(range(n)) AS s FROM words)),
longest AS MATERIALIZED (SELECT hx, s, max(l) AS l, arg_max(id, l) AS id FROM tried JOIN vocab ON h = substring(hx, 2 * s + 1, 2 * l) GROUP BY hx, s),
walk AS (SELECT hx, s, l, id FROM longest WHERE s = 0 UNION ALL SELECT w.hx, n.s, n.l, n.id FROM walk w JOIN longest n ON n.hx = w.hx AND n.s = w.s + w.l),
covered AS MATERIALIZED (SELECT hx, sp, s, id, leads(hx, sp, greatest(s + 1, sp + 1)) - 1 AS first, leads(hx, sp, s + l) AS last FROM walk JOIN words USING (hx))
SELECT document_id, i, s, id, a, first, last FROM placed JOIN covered USING (hx, sp)) GROUP BY document_id"""


def tokens_sql(source: str, path: str | None = None) -> str:
    """DuckDB SQL of encoded(): (document_id, ids, starts, ends); documents without tokens have no row."""
    # characters that begin in the bytes after the space and before a place
    leads = lambda m: f"len(list_filter(range({m[2]}, {m[3]}), lambda q: substring({m[1]}, CAST(2 * q + 1 AS BIGINT), 1) NOT IN ('8', '9', 'A', 'B')))"
    return re.sub(r"leads\((\w+), (\w+), (greatest\([^()]*\)|[^()]*)\)", leads, _of_pieces(source, path or default_vocabulary()))
