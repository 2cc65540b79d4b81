"""Dense and spectral-sequence classifiers given by their weights."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import reflectance as R
from ..functions.staging import pinned
from . import features as X

RELU, SIGMOID = "relu", "sigmoid"
#: Rows whose hidden layers stand in memory at once; a convolution takes tens of kilobytes a row.
RUN_ROWS = 256


def _activated(x: np.ndarray, activation: str) -> np.ndarray:
    return np.maximum(x, 0.0) if activation == RELU else 1 / (1 + np.exp(-x))


def _in_runs(network: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """``network`` over RUN_ROWS rows at a time: hidden layers take the same memory however large an Arrow batch is."""
    def probabilities(x: np.ndarray) -> np.ndarray:
        if len(x) <= RUN_ROWS:
            return network(x)
        return np.concatenate([network(x[k:k + RUN_ROWS]) for k in range(0, len(x), RUN_ROWS)])

    return probabilities


@dataclass(frozen=True)
class DenseModel:
    """Fully connected network: standardized inputs, hidden layers, softmax output.

    ``layers`` holds (weights[out][in], bias[out]) pairs; batch normalization is folded in. A missing feature counts as its
    value in ``fill`` (0 without one); each feature in ``flags`` adds an input behind the features that is 1 where it is
    missing. ``mean`` and ``std`` belong to all inputs. ``class_ids`` are the output ids in vocabulary order.
    """

    features: list[str]
    mean: list[float]
    std: list[float]
    layers: list[tuple[list[list[float]], list[float]]]
    class_ids: list[int]
    labels: list[str] = field(default_factory=list)
    fill: list[float] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    activation: str = RELU

    def __post_init__(self) -> None:
        width = len(self.features) + len(self.flags)
        fits = len(self.mean) == len(self.std) == width and len(self.fill) in (0, len(self.features))
        for weights, bias in self.layers:
            if len(weights) != len(bias) or any(len(row) != width for row in weights):
                raise ValueError("Layer sizes do not fit each other.")
            width = len(bias)
        if width != len(self.class_ids) or not fits or not set(self.flags) <= set(self.features) or self.activation not in (RELU, SIGMOID):
            raise ValueError("The model's features, statistics or classes do not fit its layers.")

    @property
    def inputs(self) -> list[str]:
        """The columns that :meth:`probabilities` takes, in order."""
        return self.features

    @property
    def weight_count(self) -> int:
        return sum(len(bias) * (len(weights[0]) + 1) for weights, bias in self.layers)

    def network(self) -> Callable[[np.ndarray], np.ndarray]:
        """Class probabilities of rows of features, NaN where one is missing."""
        layers = [(np.asarray(weights).T, np.asarray(bias)) for weights, bias in _folded_layers(self)]
        fill = np.asarray(self.fill or [0.0] * len(self.features))
        flagged = [self.features.index(name) for name in self.flags]

        def probabilities(x: np.ndarray) -> np.ndarray:
            gone = np.isnan(x)
            x = np.concatenate([np.where(gone, fill, x), gone[:, flagged]], axis=1)
            for depth, (weights, bias) in enumerate(layers, start=1):
                x = x @ weights + bias
                if depth < len(layers):
                    x = _activated(x, self.activation)
            return _softmax_rows(x)

        return _in_runs(probabilities)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> DenseModel:
        values = json.loads(text)
        return cls(**{**values, "layers": [tuple(layer) for layer in values["layers"]]})


def _folded_layers(model: DenseModel) -> list[tuple[list[list[float]], list[float]]]:
    """Layers with the input standardization merged into the first one."""
    (weights, bias), *rest = model.layers
    scaled = [[weight / scale for weight, scale in zip(row, model.std)] for row in weights]
    shifted = [offset - sum(w * centre for w, centre in zip(row, model.mean)) for row, offset in zip(scaled, bias)]
    return [(scaled, shifted), *rest]


def _as_lists(matrix: np.ndarray) -> pa.Array:
    """Arrow lists over the rows of a matrix, without a copy per row."""
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.array(matrix.ravel()))


def _softmax_rows(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _matrix(batch: pa.Array) -> np.ndarray:
    """Rows of a struct of doubles, NULL as NaN."""
    return np.column_stack([batch.field(i).to_numpy(zero_copy_only=False) for i in range(batch.type.num_fields)]).astype(float)


def _dense_udf(model: DenseModel):
    network = model.network()

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(batch: pa.Array) -> pa.Array:
        return _as_lists(network(_matrix(batch)))

    return score


def _inputs(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(name).cast("double").alias(f"f{i}") for i, name in enumerate(names)])


def score_dense_all(df: DataFrame, models: dict[str, DenseModel], prefixes: dict[str, str] | None = None) -> DataFrame:
    """Add the probabilities of several models (by target name) in one pass over the rows.

    ``prefixes`` holds what stands before the feature columns of a target. Networks run as matrix products on Arrow batches.
    """
    prefixes = prefixes or {}
    columns, batch = list(df.columns), {}
    for target, model in models.items():
        names = [prefixes.get(target, "") + name for name in model.features]
        X.require_columns(df, names, "Model input")
        batch[target] = _dense_udf(model)(_inputs(names))
    raw = df.withColumns({f"__{target}_raw": value for target, value in batch.items()})
    return pinned(raw, {target: F.col(f"__{target}_raw") for target in batch}).select(*columns, *models)


def score_dense(df: DataFrame, model: DenseModel, target: str = "probs") -> DataFrame:
    """Add class probabilities."""
    return score_dense_all(df, {target: model})


def class_of(probs: Column, class_ids: Sequence[int]) -> Column:
    """Output id of the first maximum."""
    return F.element_at(F.array(*[F.lit(int(value)) for value in class_ids]), R.argmax(probs))


def label_of(probs: Column, vocabulary: Sequence[str]) -> Column:
    """Vocabulary label of the first maximum; its index as text beyond the vocabulary."""
    words = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    place = R.argmax(probs)
    return F.coalesce(F.try_element_at(words, place), (place - 1).cast("string"))


@dataclass(frozen=True)
class SequenceModel:
    """One-dimensional convolutional classifier over ordered spectral channels.

    Two width-3 convolutions (batch normalization folded into kernel and bias) with ReLU,
    mean over the bands, a ReLU layer and the output layer.
    """

    groups: list[list[str]]
    norm: dict[str, list[list[float]]]
    conv1: tuple[list, list]  # kernel[out][channel][3], bias[out]
    conv2: tuple[list, list]
    dense1: tuple[list, list]  # weights[out][in], bias[out]
    dense2: tuple[list, list]
    class_ids: list[int]
    labels: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        lengths = {len(group) for group in self.groups}
        if len(lengths) != 1 or min(lengths) < 2:
            raise ValueError("Channel groups must share one length of at least two bands.")
        shape = [len(row) for row in self.norm["mean"]]
        if shape != [len(group) for group in self.groups] or shape != [len(row) for row in self.norm["std"]]:
            raise ValueError("Normalization statistics do not match the spectral inputs.")

    @property
    def inputs(self) -> list[str]:
        return [name for group in self.groups for name in group]

    def network(self, normalise: bool = True) -> Callable[[np.ndarray], np.ndarray]:
        """Class probabilities of rows of flat inputs; missing and infinite ones count as 0."""
        channels, length = len(self.groups), len(self.groups[0])
        convolutions = [(np.asarray(k), np.asarray(b)) for k, b in (self.conv1, self.conv2)]
        (w1, b1), (w2, b2) = [(np.asarray(w).T, np.asarray(b)) for w, b in (self.dense1, self.dense2)]
        mean, std = (np.array([[np.nan if v is None else v for v in row] for row in self.norm[key]], float).ravel() for key in ("mean", "std"))
        mean, std = np.where(np.isfinite(mean), mean, 0.0), np.where(np.isfinite(std) & (std > 0), std, 1.0)

        def probabilities(x: np.ndarray) -> np.ndarray:
            if normalise:
                x = (np.where(np.isfinite(x), x, 0.0) - mean) / std
                x = np.where(np.isfinite(x), x, 0.0)
            x = x.reshape(-1, channels, length)
            for kernel, bias in convolutions:
                wide = np.pad(x, ((0, 0), (0, 0), (1, 1)))
                # One matrix product over (channel, offset) per band position.
                windows = np.stack([wide[:, :, k:k + length] for k in range(3)], axis=3).transpose(0, 2, 1, 3)
                x = windows.reshape(len(x), length, -1) @ kernel.reshape(len(kernel), -1).T
                x = np.maximum(x + bias, 0.0).transpose(0, 2, 1)
            hidden = np.maximum(x.mean(axis=2) @ w1 + b1, 0.0)
            return _softmax_rows(hidden @ w2 + b2)

        return _in_runs(probabilities)

    @staticmethod
    def widths(length: int) -> tuple[int, int, int]:
        """Channels of the two convolutions and of the hidden layer."""
        hidden = 32 if length >= 8 else 16
        return hidden, 2 * hidden, max(32, hidden)


def fold_batch_norm(kernel, bias, gamma, beta, mean, variance, epsilon: float = 1e-5) -> tuple[list, list]:
    """Kernel and bias of a convolution followed by batch normalization in evaluation mode."""
    scale = np.asarray(gamma) / np.sqrt(np.asarray(variance) + epsilon)
    folded = np.asarray(kernel) * scale.reshape(-1, *([1] * (np.asarray(kernel).ndim - 1)))
    return folded.tolist(), ((np.asarray(bias) - np.asarray(mean)) * scale + np.asarray(beta)).tolist()


def score_sequence(df: DataFrame, model: SequenceModel, target: str = "probs") -> DataFrame:
    """Add class probabilities from raw and standardized columns (see ``features.sequence_table``).

    Normalization stays in the JVM; the network runs on Arrow batches of the input array only.
    """
    network, width = model.network(normalise=False), len(model.inputs)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(batch: pa.Array) -> pa.Array:
        return _as_lists(network(batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))

    raw = df.withColumn("__raw", score(F.flatten(X.sequence_array(model.groups, model.norm))))
    return pinned(raw, {target: F.col("__raw")}).select(*df.columns, target)


Model = DenseModel | SequenceModel


def as_model(model):
    """A model by its weights; a trained one is exported."""
    return model.to_model() if hasattr(model, "to_model") else model


def score_by_model(df: DataFrame, models: dict[str, DenseModel | SequenceModel], key: str, target: str = "probs") -> DataFrame:
    """Add the probabilities of the model that column ``key`` names in each row; NULL where there is no such model.

    Every model takes its own columns of ``df``; sequence models take raw and standardized ones (``features.sequence_table``).
    """
    names = list(dict.fromkeys(name for model in models.values() for name in model.inputs))
    X.require_columns(df, [key, *names], "Model input")
    networks = {word: ([names.index(name) for name in model.inputs], model.network()) for word, model in models.items()}

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(words: pa.Array, batch: pa.Array) -> pa.Array:
        x = _matrix(batch)
        coded = words.dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy()
        rows: list[np.ndarray | None] = [None] * len(codes)
        for code, word in enumerate(coded.dictionary.to_pylist()):
            if word in networks:
                places, network = networks[word]
                at = np.flatnonzero(codes == code)
                for i, values in zip(at.tolist(), network(x[np.ix_(at, places)]), strict=True):
                    rows[i] = values
        return pa.array(rows, pa.list_(pa.float64()))

    raw = df.withColumn("__raw", score(F.col(key).cast("string"), _inputs(names)))
    return pinned(raw, {target: F.col("__raw")}).select(*df.columns, target)
