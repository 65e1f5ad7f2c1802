"""A chunk classifier with one hidden layer over a vocabulary's tokens, trained epoch by epoch.

A chunk is the mean of its tokens (ids modulo buckets); the hidden layer is tanh of a linear map
of that, and the output a softmax over labels. An epoch goes through all mini-batches in an
order of its own; each is a folder of the training table, its gradient is summed in the
partitions, then in groups of partitions, then on the driver, and one step of Adam follows. The state
(parameters, both moments) goes on from epoch to epoch and is written after each with what it scores
on validation documents, so a run that is started again goes on after the last epoch written. Training stops
when validation has not improved for some epochs; the best epoch, the earliest of equals, is the
model.

Parameters are on the driver and in every task; the plan bounds their number.

Defined cases: a chunk without tokens is all zeros; chunks with an unknown or null label are not learnt
from; without training chunks there is an error; without validation documents the first epoch
is the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators import evaluation
from docloom.operators.corpus import LABELS
from docloom.operators.vocabulary import Encoder, default_vocabulary, read_vocabulary, text_steps
from docloom.plans.classifier import training_rows

MOST_PARAMETERS = 4 << 20
#: Chunks that a task takes at a time: each takes several vectors for each of its tokens.
CHUNKS_AT_A_TIME = 64


@dataclass(frozen=True)
class NetworkPlan:
    """buckets: of token ids; hidden: units; batches: mini-batches of an epoch; epochs, patience: at most, and without improvement; rate: of the steps."""

    buckets: int = 4096
    hidden: int = 16
    batches: int = 4
    epochs: int = 8
    patience: int = 3
    rate: float = 0.05
    seed: int = 42
    labels: tuple[str, ...] = tuple(LABELS)

    @property
    def size(self) -> int:
        return (self.buckets + 1) * self.hidden + (self.hidden + 1) * len(self.labels)

    def __post_init__(self) -> None:
        if self.size > MOST_PARAMETERS:
            raise ValueError(f"a network has at most {MOST_PARAMETERS} parameters")


@dataclass
class State:
    """Parameters and Adam's moments after so many steps."""

    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0


@dataclass
class Trained:
    """plan, the best epoch's parameters, and (epoch, macro_f1, accuracy) of all epochs."""

    plan: NetworkPlan
    theta: np.ndarray
    best_epoch: int
    history: list[tuple[int, float, float]] = field(default_factory=list)


def start(p: NetworkPlan) -> State:
    theta = np.random.default_rng(p.seed).normal(scale=0.3, size=p.size)
    return State(theta, np.zeros(p.size), np.zeros(p.size))


def split_parameters(theta: np.ndarray, p: NetworkPlan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token vectors, their bias, output weights, their bias."""
    k, at = len(p.labels), p.buckets * p.hidden
    return theta[:at].reshape(p.buckets, p.hidden), theta[at : at + p.hidden], theta[at + p.hidden : at + p.hidden + p.hidden * k].reshape(p.hidden, k), theta[-k:]


def _means(e: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean token vector of each chunk."""
    total = np.concatenate((np.zeros((1, e.shape[1])), np.cumsum(e[tokens], axis=0)))
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)[:, None]


def forward(theta: np.ndarray, p: NetworkPlan, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hidden units, logits, probabilities) of chunks; tokens: buckets, one chunk after the other."""
    e, b, v, c = split_parameters(theta, p)
    hidden = np.tanh(_means(e, tokens, sizes) + b)
    logits = hidden @ v + c
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return hidden, logits, raised / raised.sum(axis=1, keepdims=True)


def gradient(theta: np.ndarray, p: NetworkPlan, tokens: np.ndarray, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the weighted sum of losses, and after it the weights' sum."""
    _, _, v, _ = split_parameters(theta, p)
    hidden, _, d = forward(theta, p, tokens, sizes)
    d[np.arange(len(label)), label] -= 1
    d *= weight[:, None]
    inner = (d @ v.T) * (1 - hidden * hidden)
    per_token = np.repeat(inner / np.maximum(sizes, 1)[:, None], sizes, axis=0)
    e = np.stack([np.bincount(tokens, per_token[:, j], minlength=p.buckets) for j in range(p.hidden)], axis=1)
    return np.concatenate((e.ravel(), inner.sum(axis=0), (hidden.T @ d).ravel(), d.sum(axis=0), [weight.sum()]))


def stepped(s: State, g: np.ndarray, p: NetworkPlan) -> State:
    """After one step of Adam; g as gradient() gives it, summed."""
    g, n = g[:-1] / max(g[-1], 1e-300), s.steps + 1
    first, second = 0.9 * s.first + 0.1 * g, 0.999 * s.second + 0.001 * g * g
    return State(s.theta - p.rate * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.999**n)) + 1e-8), first, second, n)


def order_of(epoch: int, p: NetworkPlan) -> list[int]:
    """The order of an epoch's mini-batches."""
    return np.random.default_rng([p.seed, epoch]).permutation(p.batches).tolist()


def _tokens(batch: pa.RecordBatch, p: NetworkPlan) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("chunk_ids")
    return np.asarray(lists.flatten()).astype(np.int64) % p.buckets, np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)


def _batch_gradient(rows: DataFrame, theta: np.ndarray, p: NetworkPlan) -> np.ndarray:
    """The summed gradient of a mini-batch: no more rows reach the driver than the square root of the partitions."""
    groups = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    shared = rows.sparkSession.sparkContext.broadcast(theta)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.size + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNKS_AT_A_TIME):
                part = batch.slice(at, CHUNKS_AT_A_TIME)
                total += gradient(shared.value, p, *_tokens(part, p), np.asarray(part.column("label")).astype(np.int64), np.asarray(part.column("w")))
        if total[-1]:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId() % groups], "gradient": [total.tobytes()]})

    def join(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g) for g in table.column("gradient").to_pylist())
        return pa.table({"part": table.column("part")[:1], "gradient": [total.tobytes()]})

    partial = rows.select("chunk_ids", "label", "w").mapInArrow(add, "part long, gradient binary")
    total = np.zeros(p.size + 1)
    for r in partial.groupBy("part").applyInArrow(join, "part long, gradient binary").collect():
        total += np.frombuffer(r["gradient"])
    shared.destroy()
    return total


def scored(theta: np.ndarray, p: NetworkPlan, chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_index, probs, logits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, CHUNKS_AT_A_TIME) for b in batches for at in range(0, b.num_rows, CHUNKS_AT_A_TIME)):
            _, logits, probs = forward(theta, p, *_tokens(batch, p))
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("chunk_index"), pa.array(probs.tolist(), pa.list_(pa.float64())), pa.array(logits.tolist(), pa.list_(pa.float64()))], names=["document_id", "chunk_index", "probs", "logits"])

    kind = chunks.schema["document_id"].dataType.simpleString()
    return chunks.select("document_id", "chunk_index", "chunk_ids").mapInArrow(run, f"document_id {kind}, chunk_index int, probs array<double>, logits array<double>")


def predict(model: Trained, chunks: DataFrame, method: str = "mean_probabilities") -> DataFrame:
    """(document_id, predicted)."""
    return evaluation.aggregate_scores(scored(model.theta, model.plan, chunks), method, list(model.plan.labels))


def document_vectors(model: Trained, chunks: DataFrame) -> DataFrame:
    """(document_id, vectors): each document's probabilities in the order of its chunks."""
    rows = scored(model.theta, model.plan, chunks).select("document_id", F.struct("chunk_index", "probs").alias("c"))
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list("c")).alias("l")).select("document_id", F.transform("l", lambda x: x["probs"]).alias("vectors"))


def _measure(theta: np.ndarray, p: NetworkPlan, validation: DataFrame) -> tuple[float, float]:
    """(macro F1, accuracy) over documents."""
    truth = validation.groupBy("document_id").agg(F.first("agency").alias("true_label"))
    said = truth.join(predict(Trained(p, theta, 0), validation).withColumnRenamed("predicted", "predicted_label"), "document_id", "left").withColumn("all", F.lit(1))
    f1 = evaluation.label_metrics(said, ["all"], list(p.labels)).where(F.col("label").isin(list(p.labels))).agg(F.avg("f1")).first()[0]
    right = said.agg(F.avg(F.coalesce(F.col("true_label") == F.col("predicted_label"), F.lit(False)).cast("double"))).first()[0]
    return round(f1 or 0.0, 9), round(right or 0.0, 9)


SAVED = "epoch int, steps int, macro_f1 double, accuracy double, theta binary, first binary, second binary"


def _written(spark, path: str) -> list:
    """The states of all epochs written whole, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop(path))) if fs.exists(hadoop(path)) else []
    done = [n for n in names if n.startswith("epoch-") and fs.exists(hadoop(f"{path}/{n}/_SUCCESS"))]
    return sorted((spark.read.schema(SAVED).parquet(f"{path}/{n}").first() for n in done), key=lambda r: r["epoch"])


def train(chunks: DataFrame, validation: DataFrame, path: str, p: NetworkPlan | None = None) -> Trained:
    """The model of the best epoch. chunks, validation: document_id, agency, chunk_id, chunk_index, chunk_ids; path: a folder of this run, where training rows and states are kept."""
    p, spark = p or NetworkPlan(), chunks.sparkSession
    states = _written(spark, path)
    if not states:
        rows = training_rows(chunks, list(p.labels)).where(F.col("label") >= 0)
        rows = rows.select("chunk_ids", "label", "w", F.pmod(F.xxhash64(F.lit(p.seed), "chunk_id"), F.lit(p.batches)).cast("int").alias("part"))
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    rows = spark.read.schema(StructType.fromDDL("chunk_ids array<int>, label double, w double, part int")).parquet(f"{path}/rows")
    if not states and not rows.head(1):
        raise ValueError("there is nothing to learn from")
    last = states[-1] if states else None
    state = State(*(np.frombuffer(last[c]) for c in ("theta", "first", "second")), last["steps"]) if last else start(p)
    history = [(r["epoch"], r["macro_f1"], r["accuracy"]) for r in states]
    while len(history) < p.epochs:
        best = max(history, key=lambda h: (h[1], -h[0])) if history else None
        if best and history[-1][0] - best[0] >= p.patience:
            break
        epoch = len(history) + 1
        for part in order_of(epoch, p):
            g = _batch_gradient(rows.where(F.col("part") == part), state.theta, p)
            if g[-1]:
                state = stepped(state, g, p)
        f1, right = _measure(state.theta, p, validation)
        history.append((epoch, f1, right))
        saved = [(epoch, state.steps, f1, right, state.theta.tobytes(), state.first.tobytes(), state.second.tobytes())]
        spark.createDataFrame(saved, SAVED).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch-{epoch:05d}")
    best_epoch = max(history, key=lambda h: (h[1], -h[0]))[0]
    theta = np.frombuffer(spark.read.schema(SAVED).parquet(f"{path}/epoch-{best_epoch:05d}").first()["theta"])
    return Trained(p, theta, best_epoch, history)


def shares(theta: np.ndarray, p: NetworkPlan, tokens: np.ndarray, target: int, steps: int = 64) -> tuple[np.ndarray, float, float]:
    """(share of each token, the target's logit, that of an empty text): the logit's gradient summed along the straight path from an empty text, so the shares add up to the difference."""
    e, b, v, c = split_parameters(theta, p)
    own = e[tokens] / max(len(tokens), 1)
    mean = own.sum(axis=0)
    along = (np.arange(steps) + 0.5)[:, None] / steps  # the middle of each step
    slope = ((1 - np.tanh(along * mean + b) ** 2) * v[:, target]).mean(axis=0)
    return own @ slope, float(np.tanh(mean + b) @ v[:, target] + c[target]), float(np.tanh(b) @ v[:, target] + c[target])


def word_shares(model: Trained, docs: DataFrame, n: int = 10) -> DataFrame:
    """(document_id, word, share, predicted, logit, empty_logit, total): of each document's (document_id, text) predicted label the n words with the largest shares either way; tokens that no white space divides are one word, and equal words are added up; total: the sum of all words' shares."""
    theta, p = model.theta, model.plan
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces.value)
        for batch, texts in text_steps(batches, 1):
            out: list[tuple] = []
            offsets, *found = encoder.encode_all(texts)
            for i, text, a, b in zip(batch.column(0).to_pylist(), texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids, starts, ends = (f[a:b] for f in found)
                if not len(ids):
                    continue
                tokens = ids.astype(np.int64) % p.buckets
                target = int(forward(theta, p, tokens, np.array([len(tokens)]))[1][0].argmax())
                share, logit, empty = shares(theta, p, tokens, target)
                first = np.concatenate(([True], starts[1:] > ends[:-1]))
                at = np.flatnonzero(first)
                sums: dict[str, float] = {}
                for a, b, s in zip(at.tolist(), [*at[1:].tolist(), len(ids)], np.add.reduceat(share, at).tolist(), strict=True):
                    word = text[starts[a] : ends[b - 1]]
                    sums[word] = sums.get(word, 0.0) + s
                # of a document only the largest either way are sent on; ties by word, in the order of its bytes
                ranked = sorted(sums.items(), key=lambda x: (-x[1], x[0].encode()))
                up = {w: k + 1 for k, (w, _) in enumerate(ranked)}
                ranked.sort(key=lambda x: (x[1], x[0].encode()))
                out += [(i, w, s, p.labels[target], logit, empty, float(share.sum())) for k, (w, s) in enumerate(ranked) if k < n or up[w] <= n]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            kinds = [batch.schema.field("document_id").type, pa.string(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["document_id", "word", "share", "predicted", "logit", "empty_logit", "total"])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, word string, share double, predicted string, logit double, empty_logit double, total double")
