"""Language-model scores by Brown classes: exchange clustering of words, and a class bigram model.

P(word | word before) = P(class | class before) * P(word | class). Classes are found by
exchange: each round a word moves to the class that most raises the likelihood of
the class bigrams, given all others.

1. Documents are read once, tokenised and laid down as batches: a batch has its
   distinct words, ordered by shard (a hash of the word), and its tokens as numbers of
   these words. Training documents come first.
2. A batch sends its words and their counts to the shards, which add them up. The
   most frequent words start a class each, all others are in one.
3. A round: batches count, from their tokens, the classes that stand before and
   after each word, and send these counts to the shards; there they are added up and the
   word, if it occurs often enough to tell, goes to its best class. All classes
   change at once, so only half of the words may move in a round; where that lowers the
   likelihood all the same, the round is undone, and half as many may move from then on. The counts of class bigrams are added up by Spark.
4. At the end words that occur less often go to the class whose neighbours fit
   theirs best.
5. Batches get the counts and classes of their words and score all documents.

Everything is counted over all training documents. What is on the driver is as
large as the classes, squared. A row between a batch and a shard holds all that
one has for the other.

Smoothing: by absolute discounting. With N tokens of V words in training, n1 of them seen once and
n2 twice, each count is lowered by d = n1 / (n1 + 2 n2), and what that frees, u = d V / N, is the
probability of an unknown word after any class. Else emissions are (c(w) - d) over
the sum of that in the class, and transitions (n(a, b) + prior * q(b)) / (n(a) + prior), where q(b)
is the class's share of all discounted counts. So the probabilities of all words and of an unknown one
add up to one after any word.

Defined cases: a null text counts as empty, a null id as the empty text in the
choice of held-out documents; an empty text has its end only; repeated rows count
each; very long texts are taken whole; other columns are not read; an empty
table gives no rows; without training documents all words are unknown.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialise, shuffle_width, text_of

#: The class of the end of a text, which is also what stands before the first word; of words in no other class; the first of those begun by a frequent word.
END, OTHER, SEEDED = 0, 1, 2
ROW_GROUP = 8 << 20


@dataclass(frozen=True)
class Brown:
    """classes: those of END and OTHER included, 255 at most; rounds: of exchange; least_count: occurrences from which a word takes part in them; prior: the weight of a class's own frequency in transitions; batch_bytes: of text, at least one document; shard_bytes: of input, for each shard; modulus, held_out: documents whose crc32 leaves that remainder are not learnt from."""

    classes: int = 48
    rounds: int = 5
    least_count: int = 50
    prior: float = 5.0
    batch_bytes: int = 8 << 20
    shard_bytes: int = 8 << 20
    modulus: int = 5
    held_out: int = 1

    def __post_init__(self) -> None:
        if not 3 <= self.classes <= 255:
            raise ValueError("there are 3 to 255 classes")


def _ints(values) -> bytes:
    return np.ascontiguousarray(values, dtype=np.int32).tobytes()


def _of(binary: bytes | None, kind=np.int32) -> np.ndarray:
    return np.frombuffer(binary or b"", dtype=kind)


def _tight(values: np.ndarray) -> bytes:
    """Integers of 32 bits, compressed after their number: what goes through most shuffles."""
    return len(values).to_bytes(8, "little") + pa.compress(_ints(values), codec="zstd", asbytes=True)


def _loose(binary: bytes | None) -> np.ndarray:
    if not binary:
        return np.empty(0, dtype=np.int32)
    return np.frombuffer(pa.decompress(binary[8:], 4 * int.from_bytes(binary[:8], "little"), codec="zstd", asbytes=True), dtype=np.int32)


def _tight64(values: np.ndarray) -> bytes:
    """Counts over all documents: low and high halves."""
    return _tight(np.ascontiguousarray(values, dtype=np.int64).view(np.int32).reshape(-1, 2).T.ravel())


def _loose64(binary: bytes | None) -> np.ndarray:
    return np.ascontiguousarray(_loose(binary).reshape(2, -1).T).ravel().view(np.int64)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_LONG, _BYTES = pa.int64(), pa.binary()
BATCHES = "batch long, ids array<long>, sizes binary, n_train int, words binary, shards binary, tokens binary, held binary"
ASKED = _schema(shard=_LONG, batch=_LONG, words=_BYTES, counts=_BYTES)
#: A row for each batch that a shard has heard of, with the places of its words and their counts, and one with batch -1 for the shard itself, with all its words.
KNOWN = _schema(shard=_LONG, batch=_LONG, places=_BYTES, counts=_BYTES, words=_BYTES)
CLASSES = _schema(shard=_LONG, batch=_LONG, classes=_BYTES)
TOLD = _schema(shard=_LONG, batch=_LONG, keys=_BYTES, counts=_BYTES, matrix=pa.list_(pa.int64()))


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def read_batches(docs: DataFrame, p: Brown, n_shards: int, id_column: str, text_column: str) -> DataFrame:
    """Step 1. tokens: 0 is the end, others are the place of a word plus one; shards: how many of the words each shard has; tokens: of training documents, held: of the others."""
    from xxhash import xxh3_64_intdigest

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = np.asarray(batch.column("bytes"))
            part = (np.cumsum(lengths) - lengths) // p.batch_bytes
            for k in np.unique(part):
                rows = np.flatnonzero(part == k)
                piece = batch.slice(int(rows[0]), len(rows))
                ids = piece.column("id").to_pylist()
                held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % p.modulus == p.held_out for i in ids])
                order = np.argsort(held, kind="stable")
                texts = piece.column("text").take(pa.array(order)).to_pylist()
                words: list[bytes] = []
                sizes = []
                for text in texts:
                    own = text.encode().lower().split()
                    words += own
                    sizes.append(len(own))
                coded = pa.array(words, _BYTES).dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                shard = np.array([xxh3_64_intdigest(w) % n_shards for w in distinct], dtype=np.int64)
                by_shard = np.argsort(shard, kind="stable")
                place = np.empty(len(distinct), dtype=np.int32)
                place[by_shard] = np.arange(1, len(distinct) + 1)
                sizes = np.array(sizes, dtype=np.int64)
                tokens = np.zeros(len(words) + len(sizes), dtype=np.int32)
                at = np.ones(len(tokens), dtype=bool)
                at[np.cumsum(sizes + 1) - 1] = False
                tokens[at] = place[np.asarray(coded.indices)] if len(words) else 0
                learnt = int((sizes + 1)[~held[order]].sum())
                row = {"batch": [number], "ids": [[ids[i] for i in order.tolist()]], "sizes": [_ints(sizes + 1)], "n_train": [int((~held).sum())], "words": [b" ".join(distinct[i] for i in by_shard.tolist())], "shards": [_ints(np.bincount(shard, minlength=n_shards))], "tokens": [_tight(tokens[:learnt])], "held": [_tight(tokens[learnt:])]}
                yield pa.RecordBatch.from_pydict(row, schema=_schema(batch=_LONG, ids=pa.list_(_LONG), sizes=_BYTES, n_train=pa.int32(), words=_BYTES, shards=_BYTES, tokens=_BYTES, held=_BYTES))
                number += 1

    text = text_of(text_column)
    return docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("bytes")).mapInArrow(read, BATCHES)


def _train(row: dict) -> np.ndarray:
    """The tokens of a batch's training documents."""
    return _loose(row["tokens"])


def _by_shard(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first word, end) of each shard that has words."""
    ends = np.cumsum(shards)
    for s in np.flatnonzero(shards).tolist():
        yield s, int(ends[s] - shards[s]), int(ends[s])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: words and their counts, for each shard."""
    for batch in batches:
        for row in batch.to_pylist():
            words, shards = row["words"].split(b" "), _of(row["shards"])
            counts = np.bincount(_train(row), minlength=int(shards.sum()) + 1)[1:]
            yield from _table([(s, row["batch"], b" ".join(words[a:b]), _tight(counts[a:b])) for s, a, b in _by_shard(shards)], ASKED).to_batches()


def _add_up(table: pa.Table) -> pa.Table:
    """Step 2, at a shard: the counts of all its words, in order; words that no training document has are kept with 0."""
    lists = [w.split(b" ") for w in table.column("words").to_pylist()]
    coded = pa.array([w for own in lists for w in own], _BYTES).dictionary_encode()
    words = coded.dictionary.to_pylist()
    order = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
    place = np.empty(len(words), dtype=np.int32)
    place[order] = np.arange(len(words))
    places = place[np.asarray(coded.indices)]
    counts = np.bincount(places, np.concatenate([_loose(c) for c in table.column("counts").to_pylist()]), minlength=len(words)).astype(np.int64)
    shard, at = table.column("shard")[0].as_py(), 0
    rows = [(shard, -1, None, counts.tobytes(), b" ".join(words[i] for i in order.tolist()))]
    for batch, own in zip(table.column("batch").to_pylist(), lists, strict=True):
        rows.append((shard, batch, _tight(places[at : at + len(own)]), _tight64(counts[places[at : at + len(own)]]), None))
        at += len(own)
    return _table(rows, KNOWN)


def _frequent(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n most frequent words of each shard."""
    for batch in batches:
        for row in batch.to_pylist():
            counts, words = _of(row["counts"], np.int64), row["words"].split(b" ")
            top = np.lexsort((np.arange(len(counts)), -counts))[:n]
            top = top[counts[top] > 0]
            yield pa.RecordBatch.from_pydict({"shard": [row["shard"]] * len(top), "place": top.tolist(), "n": counts[top].tolist(), "word": [words[i] for i in top.tolist()]}, schema=_schema(shard=_LONG, place=_LONG, n=_LONG, word=_BYTES))


def _answers(shard: int, classes: np.ndarray, known: pa.Table) -> pa.Table:
    """A shard's classes, for itself (batch -1) and for each batch that asked."""
    rows = []
    for batch, places in zip(known.column("batch").to_pylist(), known.column("places").to_pylist(), strict=True):
        rows.append((shard, batch, (classes if batch < 0 else classes[_loose(places)]).tobytes()))
    return _table(rows, CLASSES)


def _start(seeds: dict[int, list[tuple[int, int]]], table: pa.Table) -> pa.Table:
    """The first classes at a shard. seeds: of each shard, (place of a word, its class)."""
    shard = table.column("shard")[0].as_py()
    own = table.filter(pa.compute.less(table.column("batch"), 0)).to_pylist()[0]
    classes = np.full(len(own["counts"]) // 8, OTHER, dtype=np.uint8)
    for place, c in seeds.get(shard, []):
        classes[place] = c
    return _answers(shard, classes, table)


def _classes_of(n_words: int, answers: pa.Table) -> np.ndarray:
    """The class of each token number of a batch: the end, then the words by shard."""
    answers = answers.sort_by("shard")
    out = np.frombuffer(bytes([END]) + b"".join(answers.column("classes").to_pylist()), dtype=np.uint8)
    if len(out) != n_words + 1:
        raise ValueError("a batch's words and their classes differ in number")
    return out


def _tell(k: int, least: int, most: int | None, left: pa.Table, right: pa.Table) -> pa.Table:
    """Step 3, at a batch: how often each class stands before (0 .. k - 1) and after (k .. 2k - 1) each word that occurs from least to most times, and (2k) the word itself, as word * (2k + 1) + that, each less the one before, and a count; words are numbered as the batch sent them to the shard. With shard -1: the class bigrams."""
    if not left.num_rows:
        return _table([], TOLD)
    row, shards = left.to_pylist()[0], _of(left.column("shards")[0].as_py())
    early = pa.compute.is_valid(right.column("classes"))
    classes = _classes_of(int(shards.sum()), right.filter(early))
    counts = right.filter(pa.compute.invert(early)).sort_by("shard")
    n = np.concatenate(([0], *map(_loose64, counts.column("counts").to_pylist())))
    tokens = _train(row)
    own = classes[tokens].astype(np.int64)
    before = np.concatenate(([END], own[:-1]))
    rows = [(-1, row["batch"], None, None, np.bincount(before * k + own, minlength=k * k).tolist())] if most is None else []
    some = (n >= max(least, 1)) & (n <= (n.max() if most is None else most))
    some[0] = False
    width, number = 2 * k + 1, np.cumsum(some) - 1
    at = np.flatnonzero(some[tokens])
    words = number[tokens[at]]
    # a word is never the last token: that is an end
    keys = np.concatenate((words * width + before[at], words * width + k + own[at + 1], words[(tokens[at] == tokens[at - 1]) & (at > 0)] * width + 2 * k))
    keys, totals = _counted(keys, int(some.sum()) * width)
    edges = np.searchsorted(keys, np.concatenate(([0], np.cumsum(some[1:])))[np.concatenate(([0], np.cumsum(shards)))] * width)
    wanted, begins = np.flatnonzero(some[1:]), np.cumsum(shards) - shards
    for s in range(len(shards)):
        a, b = edges[s], edges[s + 1]
        if b > a:
            word = wanted[keys[a:b] // width] - begins[s]
            rows.append((s, row["batch"], _tight(np.diff(word * width + keys[a:b] % width, prepend=0)), _tight(totals[a:b]), None))
    return _table(rows, TOLD)


def _counted(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with counts, by a table where that is smaller."""
    if most > 4 * len(keys):
        return np.unique(keys, return_counts=True)
    counts = np.bincount(keys)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, but for what no exchange changes: the sum of n log n over pairs, less that over classes before and after."""
    m = m.astype(np.float64)
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def exchange_gains(m: np.ndarray, own: int, before: np.ndarray, after: np.ndarray, self_: np.ndarray) -> np.ndarray:
    """likelihood() with each of some words of the class own in each class, but for a constant of the word. before, after: counts of classes next to a word, the word's own class included; self_: of the word next to itself."""
    m, k = m.astype(np.float64), len(m)
    before, after, self_ = (x.astype(np.float64) for x in (before, after, self_))
    n_before, n_after = before.sum(axis=1), after.sum(axis=1)
    # without the word: next to itself it is counted on both sides
    before, after = before.copy(), after.copy()
    before[:, own] -= self_
    after[:, own] -= self_
    rows, columns = m.sum(axis=1), m.sum(axis=0)
    out = np.empty((len(before), k))
    bare_column, bare_row = m[:, own][None] - before, m[own][None] - after  # of the word's own class
    bare_column[:, own] -= after[:, own] + self_
    bare_row[:, own] = bare_column[:, own]
    for b in range(k):
        column = np.repeat(m[:, b][None], len(before), axis=0) if b != own else bare_column.copy()
        row = np.repeat(m[b][None], len(before), axis=0) if b != own else bare_row.copy()
        if b != own:  # where they cross the word's own class
            column[:, own], row[:, own] = bare_row[:, b], bare_column[:, b]
        gain = _xlogx(column + before) - _xlogx(column) + _xlogx(row + after) - _xlogx(row)
        gain[:, b] = 0
        corner = column[:, b]
        total = gain.sum(axis=1) + _xlogx(corner + before[:, b] + after[:, b] + self_) - _xlogx(corner)
        left, right = (rows[b], columns[b]) if b != own else (rows[b] - n_after, columns[b] - n_before)
        out[:, b] = total - _xlogx(left + n_after) + _xlogx(left) - _xlogx(right + n_before) + _xlogx(right)
    return out


def fit(m: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The gain of a rare word in each class, to first order; minus infinity for END and empty classes."""
    m = m.astype(np.float64) + 1
    rows, columns = np.log(m.sum(axis=1)), np.log(m.sum(axis=0))
    out = before @ np.log(m) + after @ np.log(m.T) - after.sum(axis=1)[:, None] * rows - before.sum(axis=1)[:, None] * columns
    out[:, (m.sum(axis=1) <= len(m)) & (m.sum(axis=0) <= len(m))] = -np.inf
    out[:, END] = -np.inf
    return out


def _move(m: np.ndarray, turn: tuple[int, int] | None, chunk: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """Step 3 or, without turn, 4, at a shard: words go to their best class; turn: the remainder, and the divisor, of shard and place of those that may."""
    if not right.num_rows:
        return _table([], CLASSES)
    k, width = len(m), 2 * len(m) + 1
    shard = right.column("shard")[0].as_py()
    present = pa.compute.is_valid(right.column("classes"))
    classes = _of(right.filter(present).column("classes")[0].as_py(), np.uint8).copy()
    known = right.filter(pa.compute.invert(present))
    places = {b: _loose(x) for b, x in zip(known.column("batch").to_pylist(), known.column("places").to_pylist(), strict=True)}
    keys, counts = [], []
    for row in left.select(["batch", "keys", "counts"]).to_pylist():
        key = np.cumsum(_loose(row["keys"]).astype(np.int64))
        keys.append(places[row["batch"]][key // width].astype(np.int64) * width + key % width)
        counts.append(_loose(row["counts"]))
    if keys:
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        key, count = key[order], count[order]
        words = np.unique(key // width)
        if turn:
            words = words[(words + shard) % turn[1] == turn[0]]
        for at in range(0, len(words), chunk):
            own = words[at : at + chunk]
            a, b = np.searchsorted(key, [own[0] * width, (own[-1] + 1) * width])
            row = np.searchsorted(own, key[a:b] // width)
            mine = own[np.minimum(row, len(own) - 1)] == key[a:b] // width
            h = np.bincount(row[mine] * width + key[a:b][mine] % width, count[a:b][mine], minlength=len(own) * width).reshape(-1, width)
            before, after, self_ = h[:, :k], h[:, k : 2 * k], h[:, 2 * k]
            if not turn:
                classes[own] = fit(m, before, after).argmax(axis=1)
                continue
            was = classes[own]
            for c in np.unique(was):
                some = np.flatnonzero(was == c)
                gains = exchange_gains(m, int(c), before[some], after[some], self_[some])
                gains[:, END] = -np.inf
                best = gains.argmax(axis=1)
                better = gains[np.arange(len(some)), best] > gains[:, c] + 1e-6
                classes[own[some[better]]] = best[better]
    return _answers(shard, classes, known)


@dataclass
class Model:
    """What the training documents gave: batches, what the shards know, all words' classes, the counts of class bigrams, and of each class the words and their occurrences; once, twice: how many words occur so often; likelihoods: at first, and after each round that was kept."""

    batches: DataFrame
    known: DataFrame
    classes: DataFrame
    matrix: np.ndarray
    words: np.ndarray
    tokens: np.ndarray
    once: int
    twice: int
    likelihoods: list[float]


def _told(batches: DataFrame, known: DataFrame, classes: DataFrame, k: int, least: int, most: int | None = None) -> DataFrame:
    answers = classes.where("batch >= 0").select("batch", "shard", "classes", F.lit(None).cast("binary").alias("counts"))
    answers = answers.unionByName(known.where("batch >= 0").select("batch", "shard", F.lit(None).cast("binary").alias("classes"), "counts"))
    tell = lambda key, left, right: _tell(k, least, most, left, right)
    return batches.select("batch", "sizes", "n_train", "shards", "tokens").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(tell, _sql(TOLD))


def _matrix(told: DataFrame, k: int) -> np.ndarray:
    """The class bigrams of all batches: added up by Spark."""
    out = np.zeros(k * k, dtype=np.int64)
    for r in told.where("shard = -1").select(F.posexplode("matrix").alias("pair", "n")).groupBy("pair").agg(F.sum("n").alias("n")).collect():  # as many as pairs of classes
        out[r["pair"]] = r["n"]
    return out.reshape(k, k)


def _moved(told: DataFrame, known: DataFrame, classes: DataFrame, m: np.ndarray, turn: tuple[int, int] | None) -> DataFrame:
    state = known.select("shard", "batch", "places", F.lit(None).cast("binary").alias("classes")).unionByName(classes.where("batch < 0").select("shard", "batch", F.lit(None).cast("binary").alias("places"), "classes"))
    move = lambda key, left, right: _move(m, turn, 4096, left, right)
    return told.where("shard >= 0").select("shard", "batch", "keys", "counts").groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(move, _sql(CLASSES))


def shards_for(docs: DataFrame, p: Brown, text_column: str) -> int:
    """As many as the input has shard_bytes by the planner's estimate (file sizes: nothing is read; texts are measured only where it has none), and at least the shuffle partitions."""
    planned = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if planned >= 1 << 60:
        planned = docs.agg(F.sum(F.octet_length(text_of(text_column)))).first()[0] or 0
    return max(shuffle_width(docs.sparkSession), min(planned // p.shard_bytes, 1 << 18))


def train(docs: DataFrame, p: Brown | None = None, id_column: str = "doc_id", text_column: str = "text") -> Model:
    p = p or Brown()
    k = p.classes
    n_shards = shards_for(docs, p, text_column)
    batches = materialise(read_batches(docs, p, n_shards, id_column, text_column), "batches", ROW_GROUP)
    asked = batches.where(F.length("words") > 0).select("batch", "sizes", "n_train", "words", "shards", "tokens").mapInArrow(_ask, _sql(ASKED))
    known = materialise(asked.groupBy("shard").applyInArrow(_add_up, _sql(KNOWN)), "words", ROW_GROUP)
    top = known.where("batch = -1").select("shard", "counts", "words").mapInArrow(lambda b: _frequent(k - SEEDED, b), "shard long, place long, n long, word binary")
    seeds: dict[int, list[tuple[int, int]]] = {}
    for c, r in enumerate(top.orderBy(F.desc("n"), "word").limit(k - SEEDED).collect()):  # a row for each class
        seeds.setdefault(r["shard"], []).append((r["place"], SEEDED + c))
    classes = materialise(known.groupBy("shard").applyInArrow(lambda t: _start(seeds, t), _sql(CLASSES)), "classes", ROW_GROUP)
    told = materialise(_told(batches, known, classes, k, p.least_count), "told", ROW_GROUP)
    m, parts = _matrix(told, k), 2
    likelihoods = [likelihood(m)]
    for r in range(p.rounds):
        new = materialise(_moved(told, known, classes, m, (r % parts, parts)), "classes", ROW_GROUP)
        new_told = materialise(_told(batches, known, new, k, p.least_count), "told", ROW_GROUP)
        new_m = _matrix(new_told, k)
        if likelihood(new_m) > likelihoods[-1]:
            for old in (classes, told):
                discard(old)
            classes, told, m = new, new_told, new_m
            likelihoods.append(likelihood(m))
        else:  # too many moved at once
            for old in (new, new_told):
                discard(old)
            parts *= 2
    discard(told)
    # rare words: their classes only matter to the counts at the end
    told = _told(batches, known, classes, k, 1, p.least_count - 1)
    rare = materialise(_moved(told, known, classes, m, None), "classes", ROW_GROUP)
    told = _told(batches, known, rare, k, np.iinfo(np.int64).max)
    m = _matrix(told, k)

    def sizes(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Words and occurrences of each class at a shard."""
        n, c = _of(left.column("counts")[0].as_py(), np.int64), _of(right.column("classes")[0].as_py(), np.uint8)
        rows = [(i, *(int(x.sum()) for x in (own > 0, own, own == 1, own == 2))) for i in np.unique(c).tolist() for own in [n[c == i]]]
        return _table(rows, _schema(cls=_LONG, words=_LONG, tokens=_LONG, once=_LONG, twice=_LONG))

    own = known.where("batch < 0").groupBy("shard").cogroup(rare.where("batch < 0").groupBy("shard")).applyInArrow(sizes, "cls long, words long, tokens long, once long, twice long")
    words, tokens, once, twice = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), 0, 0
    for r in own.groupBy("cls").agg(*(F.sum(c).alias(c) for c in ("words", "tokens", "once", "twice"))).collect():  # a row for each class
        words[r["cls"]], tokens[r["cls"]] = r["words"], r["tokens"]
        once, twice = once + r["once"], twice + r["twice"]
    tokens[END] = m[:, END].sum()  # one end for each training document
    words[END] = int(tokens[END] > 0)
    return Model(batches, known, rare, m, words, tokens, once, twice, likelihoods)


def word_classes(model: Model) -> DataFrame:
    """(word, n, class) of each word of the training documents."""

    def spell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n, c = _of(left.column("counts")[0].as_py(), np.int64), _of(right.column("classes")[0].as_py(), np.uint8)
        words = left.column("words")[0].as_py().decode().split(" ")
        return _table([(w, int(i), int(j)) for w, i, j in zip(words, n, c, strict=True) if i], _schema(word=pa.string(), n=_LONG, cls=_LONG))

    own = model.known.where("batch < 0").groupBy("shard").cogroup(model.classes.where("batch < 0").groupBy("shard"))
    return own.applyInArrow(spell, "word string, n long, cls long").withColumnRenamed("cls", "class")


def discount(model: Model) -> float:
    """What each count is lowered by."""
    return min(max(model.once / max(model.once + 2 * model.twice, 1), 0.05), 0.95)


def transitions(model: Model, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(class | class before), discounted counts of each class); one more class is that of unknown words."""
    d, n, k = discount(model), int(model.tokens.sum()), len(model.matrix)
    left = model.tokens - d * model.words
    unknown = d * model.words.sum() / n if n else 1.0
    out = np.full((k + 1, k + 1), unknown)
    m = np.concatenate((model.matrix, np.zeros((1, k), dtype=np.int64)))  # nothing is known of what follows an unknown word
    out[:, :k] = (1 - unknown) * (m + prior * left / max(left.sum(), 1)) / (m.sum(axis=1, keepdims=True) + prior)
    with np.errstate(divide="ignore"):  # a class without words is never asked for
        return np.log10(out), left


def score(docs: DataFrame, p: Brown | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document; scores: log10 of the probability of the text under the unigram and the class model."""
    p = p or Brown()
    model = train(docs, p, id_column, text_column)
    steps, left_of = transitions(model, p.prior)
    d, n, v, ends, unknown = discount(model), int(model.tokens.sum()), int(model.words.sum()), int(model.tokens[END]), p.classes
    kinds = _schema(id=_LONG, held_out=pa.bool_(), n_tokens=_LONG, n_known=_LONG, train_tokens=_LONG, base_score=pa.float64(), score=pa.float64())

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return kinds.empty_table()
        row = left.to_pylist()[0]
        early = pa.compute.is_valid(right.column("classes"))
        classes = _classes_of(int(_of(row["shards"]).sum()), right.filter(early)).astype(np.int64)
        counts = right.filter(pa.compute.invert(early)).sort_by("shard")
        count = np.concatenate(([ends], *map(_loose64, counts.column("counts").to_pylist())))
        classes[count == 0] = unknown
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        emission = np.zeros(len(count))
        seen = count > 0
        emission[seen] = np.log10((count[seen] - d) / left_of[classes[seen]])
        sizes = _of(row["sizes"]).astype(np.int64)
        tokens = np.concatenate((_train(row), _loose(row["held"])))
        own = classes[tokens]
        # each text ends with an end, which is what stands before the next; without training ends it is unknown there, but END before
        before = np.concatenate(([END], own[:-1]))
        at = np.cumsum(sizes) - sizes
        before[at] = END
        add = lambda x: np.add.reduceat(x, at)
        held = np.arange(len(sizes)) >= row["n_train"]
        columns = [row["ids"], held, sizes, add((count[tokens] > 0).astype(np.int64)), np.full(len(sizes), n), add(base[tokens]), add(steps[before, own] + emission[tokens])]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    answers = model.classes.where("batch >= 0").select("batch", "shard", "classes", F.lit(None).cast("binary").alias("counts"))
    answers = answers.unionByName(model.known.where("batch >= 0").select("batch", "shard", F.lit(None).cast("binary").alias("classes"), "counts"))
    lean = model.batches.select("batch", "ids", "sizes", "n_train", "shards", "tokens", "held")
    out = lean.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(judge, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_column)


def perplexity(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_tokens, base_perplexity, perplexity) of the tokens of score()."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy(*by).agg(F.sum("n_tokens").alias("n_tokens"), of("base_score").alias("base_perplexity"), of("score").alias("perplexity"))
