"""Packing: documents into fixed-length token sequences by reciprocal-capacity classes.

A piece of length n belongs to class k if capacity/(k+1) < n <= capacity/k, and
a bin of class k takes k pieces, whatever they are. Each worker (a partition)
fills the bins of each class by itself: no shuffle, no state beyond one open
bin per class. A document is first cut into full sequences; its rest is cut at
capacity/(k+1), the largest length of the next class, only where k copies of it
would leave more than max_waste of a bin empty.

What a worker's open bins hold at its end is cut into full sequences and a
remainder of power-of-two sequences, which need no padding.

Defined cases: a null text counts as empty, and an empty one still has its
end-of-document id; a special string inside a text is one id, as the
vocabulary's tokenizer has it; repeated rows are packed each for itself; a very long text
is cut into as many sequences as it needs; only the named columns are read, so others may have any name;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_of
from docloom.llm.credentials import load_tiktoken


@dataclass(frozen=True)
class Packing:
    """Parameters. vocabulary: the ranks of the byte-level vocabulary; specials: the strings that its tokenizer takes as one id wherever they stand in a text; end_id follows each document."""

    vocabulary: str = "byte_bpe_50k.tiktoken"
    specials: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)
    capacity: int = 2048
    end_id: int = 1
    max_waste: float = 0.02


def cut_points(n: int, p: Packing) -> list[int]:
    """Lengths into which a document of n tokens is cut."""
    out = [p.capacity] * (n // p.capacity)
    rest = n % p.capacity
    while rest:
        k = p.capacity // rest
        if p.capacity - k * rest <= p.max_waste * p.capacity:
            out.append(rest)
            break
        out.append(p.capacity // (k + 1))
        rest -= out[-1]
    return out


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Bins:
    """The open bins of one worker; closed ones come out as rows (key, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, p: Packing, worker: int):
        self.p, self.next = p, worker << 40
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, start, ids, total in pieces:
            yield key, start, ids, total, self.next, at
            at += len(ids)
        self.next += 1

    def put(self, piece: tuple) -> Iterator[tuple]:
        k = self.p.capacity // len(piece[2])
        bin_ = self.open[k]
        bin_.append(piece)
        if len(bin_) == k:
            yield from self.close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        total = sum(len(x[2]) for x in rest)
        sizes = [self.p.capacity] * (total // self.p.capacity) + [1 << j for j in reversed(range(total.bit_length())) if total % self.p.capacity >> j & 1]
        for size in sizes:
            taken: list[tuple] = []
            while size:
                key, start, ids, n = rest.pop(0)
                if len(ids) > size:
                    rest.insert(0, (key, start + size, ids[size:], n))
                    ids = ids[:size]
                taken.append((key, start, ids, n))
                size -= len(ids)
            yield from self.close(taken)


def pack(docs: DataFrame, packing: Packing | None = None, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece; with_ids adds the ids themselves (array<int>). A power-of-two capacity is assumed by the remainder's sequences."""
    p = packing or Packing()
    if p.capacity & (p.capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_tiktoken(p.vocabulary, p.specials)
        bins = _Bins(p, TaskContext.get().partitionId())

        def rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            keys, starts, ids, totals, sequences, offsets = zip(*found, strict=True) if found else [[]] * 6
            columns = [pa.array(keys, kind), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(totals, pa.int64()), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=["key", *(x.split()[0] for x in PIECES.split(", ")), *["ids"] * with_ids])

        kind = None
        for batch in batches:
            kind, found = batch.schema.field(0).type, []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.array(vocabulary.encode(text, allowed_special="all", disallowed_special=()), dtype="<u4"), np.uint32(p.end_id)).astype("<u4")
                at = 0
                for n in cut_points(len(ids), p):
                    found += bins.put((key, at, ids[at : at + n], len(ids)))
                    at += n
            yield rows(found, kind)
        if kind is not None:
            yield rows(list(bins.finish()), kind)

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text")).mapInArrow(run, f"key {kind}, {PIECES}" + ", ids array<int>" * with_ids).withColumnRenamed("key", id_column)
