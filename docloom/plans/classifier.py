"""A linear classifier over hashed words of chunks, with the class and chunk weights and aggregation of the corpus study."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import evaluation
from docloom.operators.corpus import LABELS
from docloom.sources.shared import materialise
from docloom.sources.tables import read_or_empty


def training_rows(chunks: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """label index and weight (class weight / chunks of the document) beside what chunks have. chunks: document_id, agency."""
    weighted = evaluation.chunk_weights(chunks)
    counts = chunks.groupBy(F.col("agency").alias("label")).agg(F.count_distinct("document_id").alias("n"))
    classes = evaluation.class_weights(counts).select(F.col("label").alias("agency"), F.col("weight").alias("class_weight"))
    place = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("agency")) - 1
    return weighted.join(classes, "agency").withColumns({"label": place.cast("double"), "w": F.col("weight") * F.col("class_weight")})


def train(chunks: DataFrame, features: int = 1 << 14, max_iter: int = 20) -> PipelineModel:
    """Words are counted once, before anything is sent; the passes of training take the saved counts."""
    steps = [RegexTokenizer(inputCol="chunk_text", outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="features", numFeatures=features)]
    counted = PipelineModel(steps).transform(chunks.select("document_id", "agency", "chunk_text")).drop("chunk_text", "words")
    # the labels' names say how many classes there are, where the last ones have no rows
    rows = materialise(training_rows(counted).select("features", "label", "w"), "features").withMetadata("label", {"ml_attr": {"type": "nominal", "name": "label", "vals": LABELS}})
    return PipelineModel([*steps, LogisticRegression(weightCol="w", maxIter=max_iter, regParam=1e-3, family="multinomial").fit(rows)])


def predict(model: PipelineModel, chunks: DataFrame, method: str = "mean_probabilities") -> DataFrame:
    """(document_id, predicted)."""
    scored = model.transform(chunks).select("document_id", "chunk_index", vector_to_array("probability").alias("probs"), vector_to_array("rawPrediction").alias("logits"))
    return evaluation.aggregate_scores(scored, method)


def save_artifact(model: PipelineModel, base: str, name: str, ready_at: int) -> None:
    """The model, and last the row that says it is ready; a name is used once."""
    model.write().save(f"{base}/{name}/model")
    SparkSession.getActiveSession().createDataFrame([(name, "ready", ready_at)], "name string, status string, ready_at long").coalesce(1).write.mode("errorifexists").parquet(f"{base}/{name}/status")


def load_artifact(spark: SparkSession, base: str, name: str) -> PipelineModel:
    """Raises for a model that was never marked ready."""
    if not read_or_empty(spark, f"{base}/{name}/status", "name string, status string, ready_at long").where("status = 'ready'").head(1):
        raise FileNotFoundError(f"no ready model {name!r}")
    return PipelineModel.load(f"{base}/{name}/model")


def best_epoch(metrics: DataFrame) -> DataFrame:
    """The epoch of the largest macro_f1, the earliest of equals."""
    return metrics.agg(F.max_by("epoch", F.struct("macro_f1", -F.col("epoch"))).alias("epoch"))


def word_attribution(words: DataFrame, coefficients: DataFrame, n: int = 10) -> DataFrame:
    """For a linear model the exact share of each word: coefficient times count, the n largest either way. words: (document_id, word, tf); coefficients: (word, coefficient)."""
    from pyspark.sql import Window as W

    shares = words.join(coefficients, "word").withColumn("share", F.col("coefficient") * F.col("tf"))
    up = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("share"), "word"))
    down = F.row_number().over(W.partitionBy("document_id").orderBy("share", "word"))
    return shares.withColumns({"up": up, "down": down}).where((F.col("up") <= n) | (F.col("down") <= n)).drop("up", "down")
