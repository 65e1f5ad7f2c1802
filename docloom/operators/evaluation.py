"""Weights, aggregation of chunk scores to documents, metrics, comparisons and uncertainty."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.corpus import LABELS
from docloom.operators.quantiles import with_percentiles

METHODS = ["mean_logits", "mean_probabilities", "majority_vote", "max_confidence"]


def chunk_weights(chunks: DataFrame) -> DataFrame:
    """weight = 1 / chunks of the document, beside the columns of chunks."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    return chunks.join(counts, "document_id").withColumn("weight", 1.0 / F.col("n_chunks"))


def class_weights(counts: DataFrame, threshold: float = 4.0) -> DataFrame:
    """(label, n, weight): total / (classes x n), scaled to mean 1, if the largest class is threshold times the smallest; else 1. A class without documents gets 0."""
    every = W.partitionBy()
    some = counts.withColumns({"total": F.sum("n").over(every), "k": F.count("*").over(every), "spread": F.try_divide(F.max("n").over(every), F.min("n").over(every))})
    raw = F.when(F.coalesce(F.col("spread") < threshold, F.lit(False)), 1.0).otherwise(F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("k") * F.col("n")), F.lit(0.0)))
    some = some.withColumn("raw", raw)
    return some.select("label", "n", F.round(F.col("raw") / F.avg("raw").over(every), 6).alias("weight"))


def _dot_label(labels: list[str], scores: list[Column]) -> Column:
    """The label of the largest score, the first of equals."""
    best = F.greatest(*scores)
    return reduce(lambda out, pair: F.when(pair[1] == best, pair[0]).otherwise(out), reversed(list(zip(labels, scores, strict=True))), F.lit(None).cast("string"))


def aggregate_scores(chunks: DataFrame, method: str, labels: list[str] = LABELS) -> DataFrame:
    """(document_id, predicted) from (document_id, chunk_index, probs) or, for mean_logits, logits."""
    k = len(labels)
    source = "logits" if method == "mean_logits" else "probs"
    column = F.col(source)
    checked = chunks.where(F.coalesce(F.size(column) == k, F.lit(False)))
    if method in ("mean_logits", "mean_probabilities"):
        means = checked.groupBy("document_id").agg(*(F.round(F.avg(column[i]), 9).alias(f"s{i}") for i in range(k)))
        return means.select("document_id", _dot_label(labels, [F.col(f"s{i}") for i in range(k)]).alias("predicted"))
    if method == "majority_vote":
        votes = checked.groupBy("document_id").agg(*(F.sum((T.argmax(column) == i).cast("long")).alias(f"v{i}") for i in range(k)), *(F.round(F.sum(column[i]), 9).alias(f"s{i}") for i in range(k)))
        best = F.greatest(*(F.struct(F.col(f"v{i}").alias("v"), F.col(f"s{i}").alias("s"), F.lit(-i).alias("i")) for i in range(k)))
        return votes.select("document_id", F.element_at(F.array(*(F.lit(x) for x in labels)), 1 - best["i"]).alias("predicted"))
    if method == "max_confidence":
        best = checked.groupBy("document_id").agg(F.max_by(column, F.struct(F.array_max(column), -F.col("chunk_index"))).alias("p"))
        return best.select("document_id", F.element_at(F.array(*(F.lit(x) for x in labels)), T.argmax(F.col("p")) + 1).alias("predicted"))
    raise ValueError(f"unknown method {method!r}")


def invalid_scores(chunks: DataFrame, column: str = "probs", labels: list[str] = LABELS) -> DataFrame:
    """Rows that cannot be aggregated, each with its reason: empty, a wrong number of scores, or a score that is null, NaN or infinite."""
    a = F.col(column)
    off = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(a.isNull() | (F.size(a) == 0), "empty").when(F.size(a) != len(labels), "shape").when(off, "not_finite")
    return chunks.withColumn("reason", reason).where(F.col("reason").isNotNull())


def confusion(cases: DataFrame, by: list[str], labels: list[str] = LABELS) -> DataFrame:
    """Counts of each true and predicted label, zeros included. Failed cases count under no label."""
    names = F.array(*(F.lit(x) for x in labels))
    cells = cases.select(*by).distinct().select(*by, F.explode(names).alias("true_label")).select(*by, "true_label", F.explode(names).alias("predicted_label"))
    counts = cases.groupBy(*by, "true_label", F.coalesce("predicted_label", F.lit(T.NO_PREDICTION)).alias("predicted_label")).agg(F.count("*").alias("n"))
    return cells.join(counts, [*by, "true_label", "predicted_label"], "left").na.fill(0, ["n"])


def label_metrics(cases: DataFrame, by: list[str], labels: list[str] = LABELS) -> DataFrame:
    """precision, recall, f1 and support of every label; 0 where undefined. Failed cases count as wrong."""
    names = F.array(*(F.lit(x) for x in labels))
    true, said = F.col("true_label"), F.coalesce("predicted_label", F.lit(T.NO_PREDICTION))
    both = cases.select(*by, true.alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (true == said).cast("int").alias("tp")).unionByName(cases.select(*by, said.alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))
    sums = both.groupBy(*by, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    out = cases.select(*by).distinct().select(*by, F.explode(names).alias("label")).join(sums, [*by, "label"], "left").na.fill(0, ["t", "p", "tp"])
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    return out.select(*by, "label", F.col("t").alias("support"), over("tp", F.col("p")).alias("precision"), over("tp", F.col("t")).alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("p") + F.col("t")), F.lit(0.0)).alias("f1"))


def summary_metrics(cases: DataFrame, by: list[str], labels: list[str] = LABELS) -> DataFrame:
    """accuracy, macro and weighted F1, coverage, latency, tokens and cost. cases: also latency_ms, total_tokens, estimated_cost_usd, status."""
    right = F.coalesce(F.col("true_label") == F.col("predicted_label"), F.lit(False)).cast("double")
    plain = cases.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.round(F.avg(right), 6).alias("accuracy"),
        F.sum(1 - right).cast("long").alias("errors"),
        F.round(100.0 * F.avg((F.col("status") == "success").cast("double")), 6).alias("coverage"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency"),
        F.sum("total_tokens").alias("total_tokens"),
        F.round(F.sum("estimated_cost_usd"), 6).alias("total_cost"),
    )
    f1 = label_metrics(cases, by, labels).groupBy(*by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)), 6).alias("weighted_f1"), F.round(F.min("f1"), 6).alias("worst_f1"))
    return with_percentiles(plain, cases, by, F.col("latency_ms"), {"median_latency": 0.5, "p95_latency": 0.95}).join(f1, by)


def select_method(results: DataFrame, provisional: str = "mean_probabilities") -> DataFrame:
    """The best row of (method, macro_f1, accuracy, worst_f1); remaining ties go to the provisional method, then by name."""
    return results.orderBy(F.desc("macro_f1"), F.desc("accuracy"), F.desc("worst_f1"), F.desc(F.col("method") == provisional), "method").limit(1)


def aligned(cases: DataFrame, methods: list[str]) -> DataFrame:
    """(condition, document_id, true_label, a column for each method)."""
    said = F.coalesce("predicted_label", F.lit(T.NO_PREDICTION))
    return cases.groupBy("condition", "document_id", "true_label").pivot("method", methods).agg(F.first(said))


def paired_comparison(cases: DataFrame) -> DataFrame:
    """Per condition how many documents fall into each of the overlapping groups."""
    wide = aligned(cases, ["bert", "llm", "llm_rag"])
    b, m, r = (F.col(c) == F.col("true_label") for c in ("bert", "llm", "llm_rag"))
    same = F.col("llm") == F.col("llm_rag")
    groups = {"all_correct": b & m & r, "all_wrong": ~b & ~m & ~r, "bert_only_wrong": ~b & m & r, "llm_only_wrong": b & ~m & r, "rag_only_wrong": b & m & ~r, "rag_corrects": ~m & r, "rag_breaks": m & ~r, "identical": same}
    return wide.groupBy("condition").agg(F.count("*").alias("documents"), *(F.sum(c.cast("long")).alias(n) for n, c in groups.items()), F.round(100.0 * F.avg(same.cast("double")), 6).alias("agreement"))


def robustness(metrics: DataFrame, baseline: str = "complete_unmasked") -> DataFrame:
    """Differences of each condition from the method's baseline."""
    base = metrics.where(F.col("condition") == baseline).select("method", F.col("macro_f1").alias("base_f1"), F.col("accuracy").alias("base_accuracy"))
    # no difference is 0, never -0
    delta = lambda a, b: F.when(F.abs(F.col(a) - F.col(b)) < 5e-5, 0.0).otherwise(F.round(F.col(a) - F.col(b), 4))
    return metrics.join(base, "method").select("method", "condition", delta("macro_f1", "base_f1").alias("f1_delta"), delta("accuracy", "base_accuracy").alias("accuracy_delta"), "errors")


def mcnemar(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Exact two-sided binomial test of (b, c), the documents that only one method has right; null with fewer than least."""
    n, low = F.col("b") + F.col("c"), F.least("b", "c")
    # each term of the tail follows from the one before
    state = lambda total, log: F.struct(total.alias("total"), log.alias("log"))
    step = lambda s, k: state(s["total"] + F.exp(s["log"]), s["log"] + F.log((n - k).cast("double")) - F.log((k + 1).cast("double")))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), low.cast("bigint")), state(F.lit(0.0), -n * F.log(F.lit(2.0))), step)["total"]
    p = F.when(F.col("b") == F.col("c"), 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))
    return pairs.withColumns({"statistic": F.when(n >= least, F.round(F.try_divide(F.col("b").cast("double"), n), 6)), "p_value": F.when(n >= least, F.round(p, 6))})


METRICS = ("macro_f1", "accuracy")
#: From so many documents on, a cell's weight is drawn as a whole.
WHOLE_CELL = 16
#: Probabilities that a Poisson variable with mean 1 is at most 0, 1, 2 and so on.
POISSON_1 = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18)]


def uniform(*keys: Column) -> Column:
    """A number between 0 and 1 that the keys name: a counter-based generator, which any engine with SHA-256 can follow."""
    digits = F.substring(F.sha2(F.concat_ws(":", *(k.cast("string") for k in keys)), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _resamples(counts: DataFrame, cell: list[str], n: int, seed: int) -> DataFrame:
    """counts with draw (0: the documents as they are) and w, which adds up to how often the documents of a cell are drawn: a Poisson variable with mean n, a row with one of mean 1 for each document. A cell of WHOLE_CELL or more has one row, by its normal approximation with a correction for its skewness."""
    width = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = (F.col("n") < WHOLE_CELL) & (F.col("draw") > 0)
    rows = counts.withColumn("cell", F.concat_ws("|", *cell)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n)))).repartition(width, "draw")
    rows = rows.withColumn("j", F.explode(F.when(few, F.sequence(F.lit(1).cast("long"), F.col("n"))).otherwise(F.array(F.lit(0).cast("long")))))
    u = lambda key: uniform(F.lit(seed), F.col("draw"), F.col("cell"), key)
    rows = rows.withColumns({"u": u(F.when(F.col("j") > 0, F.col("j").cast("string")).otherwise("a")), "v": F.when(F.col("j") == 0, u(F.lit("b")))})
    single = reduce(lambda out, k: F.when(F.col("u") <= POISSON_1[k], float(k)).otherwise(out), range(len(POISSON_1) - 1, -1, -1), F.lit(float(len(POISSON_1))))
    z = F.sqrt(-2.0 * F.log("u")) * F.cos(2.0 * F.lit(math.pi) * F.col("v"))
    whole = F.greatest(F.lit(0.0), F.col("n") + F.sqrt(F.col("n").cast("double")) * F.col("z") + (F.col("z") * F.col("z") - 1.0) / 6.0)
    w = F.when(F.col("draw") == 0, F.col("n").cast("double")).when(F.col("j") > 0, single).otherwise(whole)
    return rows.withColumn("z", z).withColumn("w", w).drop("u", "v", "z", "j", "cell")


def _scores_of(said: str, labels: list[str], suffix: str = "") -> tuple[list[Column], dict[str, Column]]:
    """Sums over weighted cells, and the metrics from them."""
    true, guess, w = F.col("true_label"), F.col(said), F.col("w")
    total = lambda where, name: F.sum(F.when(where, w).otherwise(0.0)).alias(f"{name}{suffix}")
    sums = [total(true == guess, "right"), total(F.lit(True), "all")]
    f1 = []
    for i, x in enumerate(labels):
        sums += [total((true == x) & (guess == x), f"tp{i}"), total(true == x, f"t{i}"), total(guess == x, f"p{i}")]
        f1.append(F.coalesce(F.try_divide(2.0 * F.col(f"tp{i}{suffix}"), F.col(f"t{i}{suffix}") + F.col(f"p{i}{suffix}")), F.lit(0.0)))
    return sums, {"macro_f1": reduce(Column.__add__, f1) / float(len(labels)), "accuracy": F.coalesce(F.try_divide(F.col(f"right{suffix}"), F.col(f"all{suffix}")), F.lit(0.0))}


def _interval(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, point, low, high) from (by, draw, a column for each metric): a group is as many values as there are draws."""
    long = rows.select(*by, "draw", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))))
    drawn = F.when(F.col("draw") > 0, F.col("value"))
    return long.groupBy(*by, "metric").agg(F.round(F.max(F.when(F.col("draw") == 0, F.col("value"))), 9).alias("point"), *(F.round(F.percentile(drawn, q), 9).alias(n) for n, q in (("low", 0.025), ("high", 0.975))))


def bootstrap(cases: DataFrame, n: int = 2000, seed: int = 42, labels: list[str] = LABELS) -> DataFrame:
    """(method, metric, point, low, high): percentile intervals of accuracy and macro F1 over documents, the same draws for each metric. Cases are first reduced to counts of (true, predicted); a resample is a weight for each count, so the work does not grow with the cases. Weights are those of a Poisson bootstrap."""
    said = F.coalesce("predicted_label", F.lit(T.NO_PREDICTION))
    counts = cases.groupBy("method", "true_label", said.alias("said")).agg(F.count("*").alias("n"))
    sums, metrics = _scores_of("said", labels)
    drawn = _resamples(counts, ["method", "true_label", "said"], n, seed).groupBy("method", "draw").agg(*sums)
    return _interval(drawn.withColumns(metrics), ["method"])


def paired_bootstrap(cases: DataFrame, methods: list[str], n: int = 2000, seed: int = 42, labels: list[str] = LABELS) -> DataFrame:
    """(method_a, method_b, metric, point, low, high): differences in macro F1 and accuracy of each pair of methods over common resamples. As in bootstrap(), cases are first reduced to counts."""
    wide = aligned(cases.where(F.col("method").isin(methods)), methods)
    parts = [wide.select(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), "true_label", F.col(a).alias("said_a"), F.col(b).alias("said_b")) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    counts = reduce(DataFrame.unionByName, parts).groupBy("method_a", "method_b", "true_label", "said_a", "said_b").agg(F.count("*").alias("n"))
    (sums_a, of_a), (sums_b, of_b) = (_scores_of(f"said_{x}", labels, f"_{x}") for x in "ab")
    drawn = _resamples(counts, ["method_a", "method_b", "true_label", "said_a", "said_b"], n, seed).groupBy("method_a", "method_b", "draw").agg(*sums_a, *sums_b)
    return _interval(drawn.withColumns({m: of_a[m] - of_b[m] for m in METRICS}), ["method_a", "method_b"])


def log_loss(p: Column) -> Column:
    """Of the probability of the true label; bounded where it is zero."""
    return -F.log(F.greatest(p, F.lit(1e-9)))


def negative_log_likelihood(scores: DataFrame) -> DataFrame:
    """Mean and weighted loss of (p_true, weight)."""
    loss = log_loss(F.col("p_true"))
    return scores.agg(F.round(F.avg(loss), 6).alias("mean_nll"), F.round(F.sum(loss * F.col("weight")) / F.sum("weight"), 6).alias("weighted_loss"))
