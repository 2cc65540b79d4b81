"""Train classifiers from labelled pixel tables with spark.ml."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import features as X
from ..operators import labels as L
from ..operators import metrics as E
from ..operators import ranking as K
from ..operators import scoring as C
from ..session import cut_lineage, shared_folder

HIDDEN_LAYERS = (200, 100)  # fixed value: sizes that give the documented 26,761 weights
DEFAULT_VALID_SHARE, DEFAULT_SEED = 0.3, 42


@dataclass
class Trained:
    """A fitted pipeline. ``flags``: features that missed a value in training; whether they do is an input of its own."""

    pipeline: PipelineModel
    mode: str | None
    features: list[str]
    flags: list[str]
    medians: dict[str, float | None]
    vocabulary: list[str]
    class_ids: list[int]
    accuracy: float
    rows: int

    def score(self, df: DataFrame, target: str = "probs") -> DataFrame:
        """Add class probabilities in vocabulary order, computed by the pipeline itself."""
        row = df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("__row"), *self.features)
        filled = X.impute_medians(row, self.features, self.medians, self.flags)
        scored = self.pipeline.transform(filled.withColumn("__label", F.lit(self.vocabulary[0])))
        return scored.select("__row.*", vector_to_array("probability").alias(target))

    def to_model(self) -> C.DenseModel:
        """The same classifier by its weights: scaler and medians become statistics of the inputs."""
        scaler, fitted = self.pipeline.stages[-2:]
        std = np.asarray(scaler.std)
        layers, activation = _weights(fitted)
        # A constant input is 0 once scaled, whatever its value.
        layers[0][0][:, std == 0] = 0.0
        return C.DenseModel(list(self.features), list(map(float, scaler.mean)), [float(v) if v else 1.0 for v in std],
                            [(weights.tolist(), bias.tolist()) for weights, bias in layers], list(self.class_ids), list(self.vocabulary),
                            [float(self.medians[name] or 0.0) for name in self.features], list(self.flags), activation)


def _weights(fitted) -> tuple[list[tuple[np.ndarray, np.ndarray]], str]:
    """(weights[out][in], bias[out]) of each layer, and the activation between layers."""
    if isinstance(fitted, MultilayerPerceptronClassificationModel):
        flat, at, layers = fitted.weights.toArray(), 0, []
        sizes = fitted.getLayers()
        for wide, out in zip(sizes, sizes[1:]):
            # spark.ml keeps a layer column by column, the bias behind it.
            layers.append((flat[at:at + wide * out].reshape(wide, out).T.copy(), flat[at + wide * out:at + wide * out + out]))
            at += wide * out + out
        return layers, C.SIGMOID
    weights, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    if len(weights) == 1:  # two classes: the log odds of the second
        weights, bias = np.vstack([np.zeros_like(weights), weights]), np.append(0.0, bias)
    return [(weights, bias)], C.RELU


def check_training_arguments(epochs: int, valid_share: float, batch_size: int) -> None:
    if epochs < 1:
        raise ValueError("Epochs must be at least 1.")
    if not 0 < valid_share < 1:
        raise ValueError("Validation split must be between 0 and 1.")
    if batch_size < 1:
        raise ValueError("Batch size must be at least 1.")


def _fit(split: DataFrame, label: str, mode: str | None, features: list[str], classifier: Callable[[int], Estimator],
         weight: DataFrame | None = None, class_ids: dict[str, int] | None = None) -> Trained:
    """Impute with training medians, scale, fit, and measure accuracy on the validation part.

    Medians and flags come from the training part alone; ``classifier`` gets the number of inputs.
    """
    train = split.where(~F.col("is_valid"))
    medians = {name: value or 0.0 for name, value in K.exact_medians(train, features).items()}
    flags = X.incomplete_features(train, features)
    ready = X.impute_medians(split, features, medians, flags).withColumn("__label", F.col(label))
    if weight is not None:
        ready = ready.join(F.broadcast(weight), label)  # one row per class of a fixed pair
    # The optimizer passes over the prepared rows many times.
    ready = cut_lineage(ready)
    # Codes come from the labels of all rows, so that no validation row is left out of the accuracy.
    codes = StringIndexer(inputCol="__label", outputCol="__code", stringOrderType="alphabetAsc", handleInvalid="error").fit(ready)
    inputs = [*features, *map(X.missing_flag, flags)]
    stages = [
        codes,
        VectorAssembler(inputCols=inputs, outputCol="__raw", handleInvalid="keep"),
        StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True),
        classifier(len(inputs)).setFeaturesCol("__features").setLabelCol("__code").setPredictionCol("__prediction"),
    ]
    # A fitted model holds a summary with its whole session, which can't be sent to tasks once the session has observed
    # metrics. What is read back has no summary.
    path = f"{shared_folder(split.sparkSession)}/pipeline"
    Pipeline(stages=stages).fit(ready.where(~F.col("is_valid"))).save(path)
    pipeline = PipelineModel.load(path)
    judged = pipeline.transform(ready.where("is_valid"))
    accuracy = MulticlassClassificationEvaluator(
        labelCol="__code", predictionCol="__prediction", metricName="accuracy").evaluate(judged)
    vocabulary = list(pipeline.stages[0].labels)
    ids = [(class_ids or {}).get(word, i) for i, word in enumerate(vocabulary, start=1)]
    return Trained(pipeline, mode, features, flags, medians, vocabulary, ids, accuracy, ready.count())


def train_dense(df: DataFrame, mode: str | None = None, label: str = "True_Class", epochs: int = 20,
                valid_share: float = DEFAULT_VALID_SHARE, batch_size: int = 4096, seed: int = DEFAULT_SEED,
                hidden: tuple[int, ...] = HIDDEN_LAYERS) -> Trained:
    """Multilayer perceptron on the features of a mode; a random share of the rows is held out."""
    check_training_arguments(epochs, valid_share, batch_size)
    mode = S.resolve_mode(mode)
    features = list(S.MODE_FEATURES[mode])
    table = X.training_table(df, mode, label)
    table = X.coerce_numeric(table, features).withColumn(label, F.trim(F.col(label).cast("string")))
    table = cut_lineage(table.withColumn("__row", F.monotonically_increasing_id()))
    split = K.random_split(table, ["__row"], valid_share, seed)
    classes = table.select(F.count_distinct(label)).scalar()
    n_classes = table.sparkSession.range(1).select(classes.alias("n")).first()["n"]
    if n_classes < 2:
        raise ValueError("At least two distinct classes are required to train a model.")
    return _fit(split, label, mode, features, lambda width: MultilayerPerceptronClassifier(
        layers=[width, *hidden, n_classes], maxIter=epochs, seed=seed, blockSize=batch_size))


def specialist_training_table(df: DataFrame, label: str = "True_Class") -> DataFrame:
    """Rows of the two specialist classes with canonical labels and features, exact copies removed."""
    X.require_columns(df, [label], "Specialist training data")
    named = df.withColumn(label, L.specialist_label(F.col(label).cast("string"))).where(F.col(label).isNotNull())
    table = X.specialist_features(named, context="Specialist training data", carry=[label])
    # Copies are combined before the shuffle.
    return table.dropDuplicates([label, *S.SPECIALIST_FEATURES])


def train_specialist(df: DataFrame, label: str = "True_Class", epochs: int = 10,
                     valid_share: float = DEFAULT_VALID_SHARE, batch_size: int = 4096, seed: int = DEFAULT_SEED) -> Trained:
    """Two-class model with class weights from the training part of a stratified split."""
    check_training_arguments(epochs, valid_share, batch_size)
    table = cut_lineage(specialist_training_table(df, label))
    if table.isEmpty():
        raise ValueError("Specialist training data does not contain any Magnoliopsida or Microphytobenthos rows.")
    features = list(S.SPECIALIST_FEATURES)
    split = K.stratified_split(table, label, [label, *features], valid_share, seed)
    weights = E.class_weights(split.where(~F.col("is_valid")), label).select(label, "weight")
    targets = {word: class_id for word, class_id, _ in S.SPECIALIST_TARGETS}
    return _fit(split, label, None, features, lambda _: LogisticRegression(maxIter=epochs, weightCol="weight"), weights, targets)
