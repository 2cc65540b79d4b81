"""Extra columns with the names of an operator's own, short benchmark items, and the gradient of the line model."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from shorepix.llm import decontamination, language, line_dedup, quality

CLASHES = ("lang_pred string, score double, held_out boolean, n_lines int, n_dropped int, quality int, predicted int, line int, whole long, v long, comp long, "
           "n_shingles int, component_id long, set_hash long, item_id long, first_word int, pos int, h string, sequence_note string")


@pytest.fixture(scope="module")
def clashing(spark):
    names = [x.split()[0] for x in CLASHES.split(", ")]
    texts = ["calm words follow each other here and there in the long line\nsecond line with some more words", None, "", "!!!",
             "calm words follow each other here and there in the long line\nanother end", "one two"]
    rows = [(k, t, "en", "s", 0, *[None] * len(names)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


def test_filtering_stages_keep_clashing_columns(spark, clashing):
    frame = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, "/root/testdata/sf0.001")
        assert after.columns == frame.columns, name
        frame = corpus_pipeline.staged(after)
    assert {r.doc_id for r in frame.collect()} == {0, 4, 5}
    assert corpus_pipeline.packed(spark, frame, "").count() == 3


def test_operators_take_clashing_columns(spark, clashing):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    assert quality.classify(clashing, labels).count() == 6
    assert language.identify(clashing).count() == 6
    out = line_dedup.without_repeated_lines(clashing)
    assert out.count() == 6 and out.columns[-2:] == ["n_lines", "n_dropped"] and len(out.columns) == len(clashing.columns)
    bench = spark.createDataFrame([(1, "one two", "x")], "item_id long, text string, doc_id string")
    assert [(r.doc_id, r.item_id) for r in decontamination.find_leaks(clashing, bench).collect()] == [(5, 1)]


def test_short_items_must_stand_whole(spark):
    rows = [(0, "alpha beta gamma"), (1, "x Alpha, beta. GAMMA y"), (2, "alpha beta delta"), (3, "gamma beta alpha"), (4, "solo"), (5, "a solo b solo"),
            (6, " ".join(f"w{k}" for k in range(11))), (7, "p " + " ".join(f"w{k}" for k in range(11)) + " q"), (8, " ".join(f"w{k}" for k in range(10))), (9, None)]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, item_id string")
    items = [(1, "alpha beta gamma"), (2, "solo"), (3, " ".join(f"w{k}" for k in range(11))), (4, " - "), (5, "alpha beta gamma")]
    found = {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.best) for r in decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(0, 1): (0, 3, 3), (1, 1): (1, 4, 3), (0, 5): (0, 3, 3), (1, 5): (1, 4, 3), (4, 2): (0, 1, 1), (5, 2): (1, 4, 1), (6, 3): (0, 11, 11), (7, 3): (1, 12, 11)}


def test_gradient_is_that_of_one_objective():
    rng = np.random.default_rng(5)
    row, label = np.array([0, 0, 0, 1, 2, 2, 2, 2]), np.array([1, 0, 0])
    inputs, theta = rng.normal(size=(8, 3)), rng.normal(size=7) * 0.5

    def value(theta):
        """Mean over documents of their log-likelihood divided by their lines, over all labellings."""
        score, move, total = inputs @ theta[:-4], theta[-4:].reshape(2, 2), 0.0
        for doc, y in enumerate(label):
            at = np.flatnonzero(row == doc)
            weigh = lambda labels: sum(score[i] * a for i, a in zip(at, labels, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(labels))  # noqa: E731, B023
            every = [weigh(labels) for labels in itertools.product((0, 1), repeat=len(at))]
            total += (weigh([y] * len(at)) - np.log(np.exp(every).sum())) / len(at)
        return total / len(label)

    step = 1e-6
    numeric = [(value(theta + step * e) - value(theta - step * e)) / (2 * step) for e in np.eye(7)]
    assert np.allclose(quality.Objective(inputs, row, label).slope(theta), numeric, atol=1e-7)


def test_long_documents_give_a_bounded_run_of_lines(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_LINES", 3)
    seen = {}
    monkeypatch.setattr(quality, "train", lambda values, length, row, label, weight: seen.update(rows=np.bincount(row)) or quality.Model(
        np.zeros(44), np.zeros((2, 2)), np.zeros(44), np.ones(44), (1.0, 0.0)))
    docs = spark.createDataFrame([(k, "\n".join(f"line {j} here" for j in range(k))) for k in range(20)], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int"))
    assert seen["rows"].max() == 3 and len(seen["rows"]) > 10
