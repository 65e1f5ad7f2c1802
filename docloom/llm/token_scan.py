"""Token counts: document lengths from flat token files that have no index.

A flat file is a run of token identifiers in which one identifier ends a
document. It is read in blocks by byte ranges, whose borders know nothing of documents. Each
block is searched for the end identifier by itself (vectorised) and leaves a
summary: how many ends it holds, the tokens before the first, the lengths
between them, and the tokens after the last. A prefix scan over the summaries
stitches documents that cross borders. The scan has two levels (blocks within
spans of consecutive blocks, then spans), so that no task ever holds the
summaries of a whole file.

Defined cases: a null or empty payload is a block without tokens; of repeated
rows with the same file and block one counts; an end right after an end is a
document of no tokens; tokens after a file's last end form a document of their
own; an empty file has none; very long texts are taken whole, over as many blocks as
they need; an empty table gives no rows. Columns other than file, block and payload
are ignored by count_tokens() and kept by scan_blocks().
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint_dir, materialise, shuffle_width, text_of
from docloom.llm.credentials import load_tiktoken

SUMMARY = [("n_ends", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))]


def _open(path: str):
    """(file system, path within it) for a path or URI as Spark names it."""
    from pyarrow import fs

    # file:/a is Hadoop's way to write file:///a
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path)) if ":" in path else (fs.LocalFileSystem(), path)


def read_ranges(files: DataFrame, itemsize: int = 2, block_tokens: int = 1 << 16) -> DataFrame:
    """Blocks (file, block, payload) of (file, path, n_bytes), each read by its own byte range, so that a long file is read by many tasks and never held whole. A path is a URI that pyarrow opens, in a store that all workers share."""
    size = itemsize * block_tokens
    n = F.ceil(F.col("n_bytes") / F.lit(size)).cast("long")
    ranges = files.where("n_bytes > 0").select("file", "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    ranges = ranges.repartition(shuffle_width(files.sparkSession), "file", "block").select("file", "path", "block", F.least(F.lit(size), F.col("n_bytes") - F.col("block") * size).alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, blocks, lengths = (batch.column(c).to_pylist() for c in ("path", "block", "length"))
            for at in range(0, batch.num_rows, 64):  # 64 blocks are held at a time
                payloads = []
                for path, block, length in zip(paths[at : at + 64], blocks[at : at + 64], lengths[at : at + 64], strict=True):
                    store, name = _open(path)
                    with store.open_input_file(name) as f:
                        payloads.append(f.read_at(length, block * size))
                yield pa.RecordBatch.from_arrays([batch.column("file").slice(at, 64), batch.column("block").slice(at, 64), pa.array(payloads, pa.binary())], names=["file", "block", "payload"])

    return ranges.mapInArrow(run, f"file {files.schema['file'].dataType.simpleString()}, block long, payload binary")


def read_token_files(spark: SparkSession, path: str, itemsize: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """Blocks (file, block, payload) of the files under path; Spark lists them and their lengths, and reads none of their content for that."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "path", F.col("length").alias("n_bytes"))
    return read_ranges(files, itemsize, block_tokens)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 50256, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes each partition's documents as a flat file (little-endian 16-bit identifiers, no index) in a shared folder, and returns (file, path, n_bytes, first, keys): a row for each file, and beside it rows of keys that say which document is which, as the files can't: the document with ordinal first + i of the file is keys[i].

    A task that is run again writes a file of another name; only what its rows name counts. Keep the rows (materialise) before they are used more than once."""
    kind_of_key = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_tiktoken(vocabulary)
        file, done, size = TaskContext.get().partitionId(), 0, 0
        path = f"{folder}/{file}-{uuid.uuid4().hex}.bin"
        out = None

        def row(kind: pa.DataType, named: str | None, first: int | None, keys: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([named], pa.string()), pa.array([size if named else None], pa.int64()), pa.array([first], pa.int64()), pa.array([keys], pa.list_(kind))], names=["file", "path", "n_bytes", "first", "keys"])

        for batch in batches:
            if out is None:
                kind = batch.schema.field(0).type
                store, name = _open(folder)
                store.create_dir(name, recursive=True)
                store, name = _open(path)
                out = store.open_output_stream(name)
            for text in batch.column(1).to_pylist():
                size += out.write(np.array([*encoder.encode_ordinary(text), end_id], dtype="<u2").tobytes())
            yield row(kind, None, done, batch.column(0).to_pylist())
            done += batch.num_rows
        if out is not None:
            out.close()
            yield row(kind, path, None, None)

    return docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text")).mapInArrow(run, f"file long, path string, n_bytes long, first long, keys array<{kind_of_key}>")


def count_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, file, ordinal, n_tokens) for each document, by way of flat token files in the session's shared folder."""
    folder = f"{checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    written = materialise(write_token_files(docs, folder, id_column=id_column, text_column=text_column), "written")
    counts = count_tokens(read_ranges(written.where(F.col("path").isNotNull()).select("file", "path", "n_bytes")))
    keys = written.where(F.col("keys").isNotNull()).select(F.col("file").alias("of"), "first", F.posexplode("keys").alias("i", id_column)).select("of", (F.col("first") + F.col("i")).alias("nth"), id_column)
    return keys.join(counts, (F.col("of") == F.col("file")) & (F.col("nth") == F.col("ordinal"))).select(id_column, "file", "ordinal", "n_tokens")


def scan_blocks(blocks: DataFrame, end_id: int = 50256, dtype: str = "<u2") -> DataFrame:
    """The rows with a block number get their summary in place of the payload; all others pass through with null summaries."""
    place, number = blocks.columns.index("payload"), blocks.columns.index("block")
    keep = [c for c in blocks.columns if c not in ("payload", *(n for n, _ in SUMMARY))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for payload, block in zip(batch.column(place), batch.column(number), strict=True):
                if not block.is_valid:
                    out.append((None, None, None, None))
                    continue
                ids = np.frombuffer(payload.as_buffer(), dtype=dtype) if payload.is_valid else np.empty(0, dtype=dtype)
                ends = np.flatnonzero(ids == end_id)
                if len(ends):
                    out.append((len(ends), int(ends[0]), len(ids) - 1 - int(ends[-1]), (np.diff(ends) - 1).tolist()))
                else:
                    out.append((0, 0, len(ids), []))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in SUMMARY]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, (_, t) in zip(columns, SUMMARY, strict=True))], names=[*keep, *(n for n, _ in SUMMARY)])

    fields = [f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in keep]
    return blocks.mapInArrow(run, ", ".join([*fields, "n_ends long", "head long", "tail long", "inner array<long>"]))


def stitch(scanned: DataFrame, span: int = 1024) -> DataFrame:
    """(file, ordinal, n_tokens) from block summaries, by a prefix scan."""
    rows = scanned.where(F.col("block").isNotNull()).select("file", "block", "n_ends", "head", "tail", "inner").dropDuplicates(["file", "block"]).withColumn("span", F.floor(F.col("block") / span))
    # within a span: ends so far, and tokens since the last end (null before the first one)
    inside = W.partitionBy("file", "span").orderBy("block")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.sum("tail").over(inside))
    rows = rows.withColumn("mark", F.when(F.col("n_ends") > 0, F.col("run") - F.col("tail")))
    rows = rows.withColumns({"ends_before": F.coalesce(F.sum("n_ends").over(before), F.lit(0)), "carry": F.col("run") - F.col("tail") - F.last("mark", ignorenulls=True).over(before), "open_run": F.col("run") - F.col("tail")})
    # over spans: the same, from a row for each
    spans = rows.groupBy("file", "span").agg(F.sum("n_ends").alias("s_ends"), F.max("run").alias("s_run"), F.max("mark").alias("s_mark"))
    over = W.partitionBy("file").orderBy("span")
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    # what a span adds to the tokens since the last end: all that follows its own last end, or all it has
    spans = spans.withColumn("s_tail", F.col("s_run") - F.coalesce("s_mark", F.lit(0)))
    spans = spans.withColumn("t_run", F.sum("s_tail").over(over))
    spans = spans.withColumn("t_mark", F.when(F.col("s_ends") > 0, F.col("t_run") - F.col("s_tail")))
    spans = spans.withColumns(
        {
            "base": F.coalesce(F.sum("s_ends").over(earlier), F.lit(0)),
            "base_carry": F.col("t_run") - F.col("s_tail") - F.coalesce(F.last("t_mark", ignorenulls=True).over(earlier), F.lit(0)),
            "last": F.row_number().over(W.partitionBy("file").orderBy(F.desc("span"))) == 1,
        }
    )
    joined = rows.join(spans.select(F.col("file").alias("s_file"), F.col("span").alias("s_span"), "base", "base_carry"), F.col("file").eqNullSafe(F.col("s_file")) & (F.col("span") == F.col("s_span")))
    first = F.col("head") + F.coalesce(F.col("carry"), F.col("open_run") + F.col("base_carry"))
    ended = joined.where(F.col("n_ends") > 0).select("file", (F.col("base") + F.col("ends_before")).alias("at"), F.posexplode(F.concat(F.array(first), F.col("inner"))).alias("i", "n_tokens")).select("file", (F.col("at") + F.col("i")).alias("ordinal"), "n_tokens")
    left = F.col("s_tail") + F.when(F.col("s_ends") > 0, F.lit(0)).otherwise(F.col("base_carry"))
    unended = spans.where(F.col("last")).select("file", (F.col("base") + F.col("s_ends")).alias("ordinal"), left.alias("n_tokens")).where(F.col("n_tokens") > 0)
    return ended.unionByName(unended)


def count_tokens(blocks: DataFrame, end_id: int = 50256, dtype: str = "<u2", span: int = 1024) -> DataFrame:
    """(file, ordinal, n_tokens): a row for each document of each file, in file order."""
    return stitch(materialise(scan_blocks(blocks.select("file", "block", "payload").where(F.col("block").isNotNull()), end_id, dtype), "scanned"), span)
