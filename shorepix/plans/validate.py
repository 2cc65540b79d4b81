"""Validate a model against labelled pixels."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import features as X
from ..operators import labels as L
from ..operators import metrics as E
from ..operators import scoring as C
from ..operators.lookup import attach, local_if_small, small_table
from ..session import cut_lineage

MULTICLASS, PRESENCE_ABSENCE = "multiclass", "presence_absence"
# Accepted spellings of the two modes, letters and digits only.
MODE_WORDS = {
    MULTICLASS: ("multiclass", "full", "asis", "original"),
    PRESENCE_ABSENCE: ("presenceabsence", "binary", "binarypresenceabsence", "pva"),
}
REFINED_CONCEPTS = ("magnoliopsida", "microphytobenthos")


@dataclass
class Validation:
    predictions: DataFrame
    counts: DataFrame  # (true_label, pred_label, n)
    classes: list[str]
    metrics: DataFrame
    matrix: DataFrame
    outside: DataFrame


def resolve_validation_mode(mode: str | None) -> str:
    word = "".join(letter for letter in str(mode or MULTICLASS).lower() if letter.isalnum())
    for name, words in MODE_WORDS.items():
        if word in words:
            return name
    raise ValueError("Invalid validation mode. Use 'multiclass' or 'presence_absence'.")


CONTEXT = "Validation dataset"


def predict_labels(df: DataFrame, model: C.Model, vocabulary: list[str] | None = None,
                   specialist: C.Model | None = None) -> DataFrame:
    """Add ``raw_prediction`` (a vocabulary label) and ``Predicted_Confidence``; the columns of ``df`` stay as they are.

    Rows predicted as seagrass or microalgae take label and confidence of the specialist, which sees the original
    bands. Without all of its bands it is left out with a warning. The vocabulary is the model's own if none is given.
    """
    model, specialist = C.as_model(model), C.as_model(specialist)
    vocabulary = model.labels if vocabulary is None else vocabulary
    columns = [F.col(f"`{name}`") for name in df.columns]
    work = _with_probabilities(df, model, "__main")
    label, confidence = C.label_of(F.col("__main"), vocabulary), F.array_max("__main")
    if specialist is not None:
        missing = [name for name in map(S.raw_name, S.SPECIALIST_BANDS) if name not in df.columns]
        if missing:
            warnings.warn(f"Validation goes on without the specialist model, which needs {S.shorten(missing)}", stacklevel=2)
        else:
            work = _with_probabilities(work, specialist, "__special")
            words = small_table(df.sparkSession, [(word,) for word in vocabulary], "label string")
            # At most one row per vocabulary label comes back.
            refined = [row["label"] for row in L.with_concepts(words).where(F.col("concept").isin(*REFINED_CONCEPTS)).collect()]
            candidate = label.isin(*refined) if refined else F.lit(False)
            confidence = F.when(candidate, F.array_max("__special")).otherwise(confidence)
            label = F.when(candidate, C.label_of(F.col("__special"), specialist.labels)).otherwise(label)
    return work.select(*columns, label.alias("raw_prediction"), confidence.alias("Predicted_Confidence"))


def _with_probabilities(df: DataFrame, model: C.DenseModel | C.SequenceModel, target: str) -> DataFrame:
    """Add class probabilities; inputs are built beside the row, which is carried through whole.

    Sequence models, spatial models and the specialist rebuild their inputs from raw bands; spectral models need theirs.
    """
    row = df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("__row"), "*")
    if isinstance(model, C.SequenceModel):
        flat = [name for group in model.groups for name in group]
        built = X.sequence_table(row, features=flat, groups=model.groups, context=CONTEXT, carry=["__row"])
        scored = C.score_sequence(built, model, target)
    else:
        if set(model.features) == set(S.SPECIALIST_FEATURES):
            built = X.specialist_features(row, context=CONTEXT, carry=["__row"])
        else:
            built = X.prepare_features(row, None, model.features, context=CONTEXT, carry=["__row"])
        scored = C.score_dense(built, model, target)
    return scored.select("__row.*", target)


def validate(df: DataFrame, label: str, model: C.Model, vocabulary: list[str] | None = None,
             specialist: C.Model | None = None, mode: str | None = None,
             target: str = S.DEFAULT_TARGET) -> Validation:
    """Predictions, metrics and confusion matrix of ``df`` (with row_id, see ``sources.tables.read_validation``)."""
    if not target.strip():
        raise ValueError("A target class is required for presence/absence validation mode.")
    model = C.as_model(model)
    vocabulary = model.labels if vocabulary is None else vocabulary
    return evaluate(predict_labels(df, model, vocabulary, specialist), label, "raw_prediction", vocabulary, mode, target)


def evaluate(df: DataFrame, label: str, prediction: str, vocabulary: list[str], mode: str | None = None,
             target: str = S.DEFAULT_TARGET) -> Validation:
    """Map both label columns to the names of the table and measure their agreement.

    Only the small table of label pairs is kept between the measures.
    """
    mode = resolve_validation_mode(mode)
    spark = df.sparkSession
    space, _ = local_if_small(L.label_space(df, label, "row_id"))
    keyed = df.withColumns({side: F.coalesce(F.col(name).cast("string"), F.lit(S.MISSING_LABEL))
                            for side, name in (("__t", label), ("__p", prediction))})
    words = list(dict.fromkeys([*vocabulary, target]))
    # One mapping for all labels in sight: rows, vocabulary, target and label space.
    seen = keyed.select(F.explode(F.array("__t", "__p")).alias("label")).unionByName(
        small_table(spark, [(word,) for word in words], "label string")).unionByName(space.select("label"))
    mapping, _ = local_if_small(L.map_labels(seen.distinct(), space).select("label", "mapped"))
    side = lambda key, name: mapping.select(F.col("label").alias(key), F.col("mapped").alias(name))
    mapped = attach(attach(keyed, side("__t", "__true"), ["__t"]), side("__p", "__pred"), ["__p"]).drop("__t", "__p")
    hints = {row["label"]: row["mapped"] for row in mapping.where(F.col("label").isin(*words)).collect()}
    if mode == PRESENCE_ABSENCE:
        goal = hints[target]
        mapped = mapped.withColumns({name: E.presence_absence(F.col(name), goal) for name in ("__true", "__pred")})
        order = [S.ABSENCE, S.PRESENCE]
    else:
        order = list(dict.fromkeys(hints[word] for word in vocabulary))
    counts = cut_lineage(E.confusion(mapped, "__true", "__pred"))
    if mode == PRESENCE_ABSENCE:
        classes = order
    else:
        # Distinct dataset labels, in first-seen order of the label they map to.
        first = mapping.join(space, "label").groupBy("mapped").agg(F.min("first_position").alias("first_position"))
        classes = [row["mapped"] for row in first.where(F.col("mapped") != S.MISSING_LABEL).orderBy("first_position").collect()]
    if not classes:
        raise ValueError("No labelled classes were found in the validation dataset.")
    predictions = mapped.withColumn(label, F.col("__true")).withColumn("Predicted_Class", F.col("__pred")).drop("__true", "__pred")
    return Validation(predictions, counts, classes, E.metrics_table(counts, order, classes),
                      E.confusion_matrix(counts, classes), E.outside_predictions(counts, classes))
