"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score is linear in features of the line and of the lines before and after it, and
neighbouring labels are tied by four transition weights. Training takes the document's label for each of its lines. A
document's quality is the mean probability of "good" over its lines, weighted by length, from forward-backward
marginals, and put on the scale of a probability by a logistic fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorepix.llm.language import held_out
from shorepix.llm.words import span_hashes, text_slices, word_spans, line_spans

#: Labelled documents per class that are learned from, about; chosen by a hash of the doc_id.
SAMPLE = 2_000
#: Lines of a document that are learned from: of a longer one a run of so many, from a place its doc_id decides.
SAMPLE_LINES = 200
_CLASSES = np.zeros((256, 8), np.uint8)
for _k, _bytes in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), range(0x80, 0x100), b".,;:'\"()-?", b"!", b"|/\\<>{}[]=_", b"*$%#&@~^+`")):
    _CLASSES[list(_bytes), _k] = 1
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')")] = True
OWN = 14


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, text) of all lines of these texts: OWN of the line, then as many of the line before and of the
    line after (zeros at the ends), then whether it is the first or the last line."""
    start, end, row = line_spans(data, bounds)
    length = end - start
    n = np.maximum(length, 1)
    own = np.zeros((len(start), OWN))
    own[:, 0] = 1
    own[:, 1] = np.log1p(length) / 5
    for k in range(8):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_CLASSES[:, k][data], out=total[1:])
        own[:, 2 + k] = (total[end] - total[start]) / n
    word_start, word_end, _ = word_spans(data, bounds)
    if len(word_start):
        line = np.searchsorted(start, word_start, "right") - 1
        hashes = span_hashes(data, word_start, word_end)
        words = np.bincount(line, minlength=len(start))
        again = np.zeros(len(line), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        own[:, 10] = np.bincount(line[again], minlength=len(start)) / np.maximum(words, 1)
        own[:, 11] = np.log1p(words) / 5
        own[:, 12] = np.bincount(line, weights=word_end - word_start, minlength=len(start)) / np.maximum(words, 1) / 10
    if len(data):
        own[:, 13] = (length > 0) & _END[data[np.maximum(end - 1, 0)]]
    first, last = np.diff(row, prepend=-1) != 0, np.diff(row, append=-1) != 0
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last]), length, row


class Chain:
    """Forward-backward over many documents at once: step t handles line t of all documents that have one."""

    def __init__(self, row: np.ndarray):
        texts, first, count = np.unique(row, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        self.texts, self.first, self.count = texts[order], first[order], count[order]
        self.active = np.searchsorted(-self.count, -np.arange(1, (self.count[0] if len(count) else 0) + 1), "right")

    def marginals(self, score: np.ndarray, transition: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(P(good) of each line, expected number of neighbours for each pair of labels); ``score``: log odds of good,
        ``weight``: what a pair counts, by the place of its first line (default 1)."""
        unary = np.stack([1 / (1 + np.exp(np.clip(score, -500, 500))), 1 / (1 + np.exp(-np.clip(score, -500, 500)))], axis=1)
        move = np.exp(transition)
        forward, backward = np.zeros_like(unary), np.ones_like(unary)
        held = None
        for t, m in enumerate(self.active):
            at = self.first[:m] + t
            now = unary[at] if held is None else (held[:m] @ move) * unary[at]
            held = now / now.sum(axis=1, keepdims=True)
            forward[at] = held
        pairs = np.zeros((2, 2))
        for t in range(len(self.active) - 2, -1, -1):
            m = self.active[t + 1]
            at, after = self.first[:m] + t, self.first[:m] + t + 1
            right = unary[after] * backward[after]
            joint = forward[at][:, :, None] * move * right[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint.sum(axis=0) if weight is None else (joint * weight[at][:, None, None]).sum(axis=0)
            back = right @ move.T
            backward[at] = back / back.sum(axis=1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1), pairs


class Model:
    def __init__(self, weights: np.ndarray, transition: np.ndarray, middle: np.ndarray, spread: np.ndarray,
                 scale: tuple[float, float]):
        self.weights, self.transition, self.middle, self.spread, self.scale = weights, transition, middle, spread, scale

    def mean_good(self, features: np.ndarray, length: np.ndarray, row: np.ndarray, texts: int) -> np.ndarray:
        good, _ = Chain(row).marginals((features - self.middle) / self.spread @ self.weights, self.transition)
        weight = length + 1.0
        return np.bincount(row, weights=good * weight, minlength=texts) / np.bincount(row, weights=weight, minlength=texts)

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Quality of each text, 0 to 1."""
        mean = self.mean_good(*line_features(data, bounds), len(bounds) - 1)
        return 1 / (1 + np.exp(-(self.scale[0] * _log_odds(mean) + self.scale[1])))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Objective:
    """Mean over the documents of their conditional log-likelihood per line, all lines having the document's label."""

    def __init__(self, inputs: np.ndarray, row: np.ndarray, label: np.ndarray):
        self.inputs, self.chain, self.truth, self.documents = inputs, Chain(row), label[row].astype(float), len(label)
        self.each = 1 / np.bincount(row, minlength=len(label))[row]  # a document counts once, however many lines it has
        first = np.flatnonzero(np.diff(row) == 0)
        self.seen = np.array([[((self.truth[first] == a) & (self.truth[first + 1] == b)) @ self.each[first] for b in (0, 1)] for a in (0, 1)], float)

    def slope(self, theta: np.ndarray) -> np.ndarray:
        """The gradient by the weights of the features, then by the four transitions."""
        good, pairs = self.chain.marginals(self.inputs @ theta[:-4], theta[-4:].reshape(2, 2), self.each)
        return np.concatenate([self.inputs.T @ ((self.truth - good) * self.each), (self.seen - pairs).ravel()]) / self.documents


def train(features: np.ndarray, length: np.ndarray, row: np.ndarray, label: np.ndarray, weight: np.ndarray,
          steps: int = 200, decay: float = 1e-3, rate: float = 0.1) -> Model:
    """Fit :class:`Objective` by Adam; ``row`` numbers the documents of ``label`` (0 or 1) and ``weight`` (how many
    documents of the corpus each stands for). As all lines of a document share its label, a change of label inside a
    document is never seen and the transitions only learn how strongly neighbours agree."""
    middle, spread = features.mean(axis=0), features.std(axis=0)
    middle[0], spread[spread < 1e-9] = 0, 1
    inputs = (features - middle) / spread
    objective = Objective(inputs, row, label)
    theta = np.zeros(inputs.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        slope = objective.slope(theta) - decay * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        theta = theta + rate * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), middle, spread, (1.0, 0.0))
    x = _log_odds(model.mean_good(features, length, row, len(label)))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the weighted logistic fit
        p = 1 / (1 + np.exp(-(a * x + b)))
        slope = np.array([((label - p) * weight * x).sum() - 1e-2 * a, ((label - p) * weight).sum()])
        q = weight * p * (1 - p) + 1e-9
        bend = np.array([[(q * x * x).sum() + 1e-2, (q * x).sum()], [(q * x).sum(), q.sum()]])
        step = np.linalg.solve(bend + 1e-6 * np.eye(2), slope)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
    model.scale = (float(a), float(b))
    return model


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents that are not held out: about ``sample`` of each class (all, if fewer), chosen by
    a hash of the doc_id; class sizes come from all labels. Labels other than 0 and 1, null included, are left out; null
    texts count as empty. Without any labelled document the score is 0.5 for every text.

    Only line features reach the driver, of at most SAMPLE_LINES lines of each document of the sample.
    """
    given = (labels.filter(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality")))
    sizes = {row.quality: row.n for row in given.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.zeros(3 * OWN + 2), np.zeros((2, 2)), np.zeros(3 * OWN + 2), np.ones(3 * OWN + 2), (1.0, 0.0))
    share = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, sample / n))])
    chosen = given.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < share[F.col("quality")] * (1 << 30))
    # About 2 * sample rows of two numbers: small whatever the number of labels.
    texts = (documents.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("__text"))
             .join(F.broadcast(chosen), "__id").select("__id", "quality", "__text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, data, bounds in text_slices(batch.column(2)):
                values, length, row = line_features(data, bounds)
                cuts = np.searchsorted(row, np.arange(len(bounds)))
                for k in range(len(bounds) - 1):
                    spare = max(0, int(cuts[k + 1] - cuts[k]) - SAMPLE_LINES)
                    low = int(cuts[k]) + zlib.crc32(str(ids[at + k]).encode()) % (spare + 1)
                    mine = slice(low, min(int(cuts[k + 1]), low + SAMPLE_LINES))
                    yield pa.RecordBatch.from_pydict({"id": [ids[at + k]], "quality": pa.array([marks[at + k]], pa.int32()), "length": [length[mine].tolist()],
                                                      "values": [values[mine].astype(np.float32).ravel().tolist()]},
                                                     schema=pa.schema([("id", pa.int64()), ("quality", pa.int32()), ("length", pa.list_(pa.int64())), ("values", pa.list_(pa.float32()))]))

    found: pd.DataFrame = (texts.withColumn("__id", F.col("__id").cast("long"))
                           .mapInArrow(features, "id long, quality int, length array<long>, values array<float>").toPandas())
    if found.empty:
        return Model(np.zeros(3 * OWN + 2), np.zeros((2, 2)), np.zeros(3 * OWN + 2), np.ones(3 * OWN + 2), (1.0, 0.0))
    found = found.sort_values(["id", "quality"], kind="stable")
    label = found["quality"].to_numpy()
    row = np.repeat(np.arange(len(found)), found["length"].map(len))
    values = np.concatenate([np.asarray(v) for v in found["values"]]).reshape(len(row), -1).astype(float)
    weight = np.array([sizes[c] / max(1, (label == c).sum()) for c in label])
    return train(values, np.concatenate([np.asarray(v) for v in found["length"]]), row, label, weight)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 is likelier) and predicted (score >= ``threshold``) of every
    document, from its whole text alone. Null and empty texts are one empty line. Repeated rows get equal rows; other
    columns are ignored, whatever their names."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(data, bounds) for _, data, bounds in text_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                                             names=["doc_id", "score"])

    scored = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__text"))
              .mapInArrow(score, "doc_id long, score double"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
