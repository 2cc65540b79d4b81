"""Training queries (those without SQL are compared by row count; their splits and features have SQL of their own)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.operators import features as X
from shorepix.operators import registry as R
from shorepix.operators import scoring as C
from shorepix.plans import train as T
from shorepix.session import shared_folder

from . import derive as D
from . import query, rounded, with_ctes
from .labels import _special_source


@query("dense_training")
def dense_training(spark, folder):
    """Train on every spectrum, score every spectrum, count (label, predicted)."""
    source = D.spectra(spark, folder).withColumn("True_Class", F.col("label").cast("string"))
    raw = [S.raw_name(band) for band in S.MODEL_BANDS[S.SPECTRAL]]
    full = X.with_feature_indices(X.with_standardised(source, raw))
    model = T.train_dense(full, S.SPECTRAL)
    scored = model.score(full)
    predicted = C.label_of(F.col("probs"), model.vocabulary)
    return scored.groupBy(F.col("True_Class").alias("true_label"), predicted.alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))


@query("specialist_training")
def specialist_training(spark, folder):
    """Train the two-class model on every usable row and score its training table."""
    source = _special_source(spark, folder)
    model = T.train_specialist(source)
    scored = model.score(T.specialist_training_table(source))
    predicted = C.label_of(F.col("probs"), model.vocabulary)
    return scored.groupBy("True_Class", predicted.alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))


_RULE = D.main_model((1.2, 0.6, 0.3))


@query("trained_classification", with_ctes(
    [("px", D.SPECTRA_SQL), *D.features_sql("px", S.SEQUENCE_BANDS[S.SPATIAL]), *D.dense_sql(_RULE, "feat", "m")],
    """SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'trained' ELSE 'given' END AS model_name, CASE WHEN vec_id % 2 = 0 THEN 10 ELSE 8 END AS n_classes,
 CASE WHEN vec_id % 2 = 1 THEN round(list_max(mprobs), 6) END AS top_prob, CASE WHEN vec_id % 2 = 1 THEN CAST(list_position(mprobs, list_max(mprobs)) AS INTEGER) END AS class_id,
 CASE WHEN vec_id % 2 = 0 THEN true END AS as_trained FROM mscored"""))
def trained_classification(spark, folder):
    """Train on every spectrum, save beside a given model, load both, and score each row by the model it names.

    Rows of the trained model must have the probabilities of its pipeline, rows of the given model those of the SQL.
    """
    source = D.spectra(spark, folder).withColumn("True_Class", F.col("label").cast("string"))
    trained = T.train_dense(source, S.SPATIAL, hidden=(20, 10))
    path = f"{shared_folder(spark)}/models"
    R.save_model(spark, path, "trained", trained)
    R.save_model(spark, path, "given", _RULE, mode=S.SPATIAL)
    models = R.load_models(R.read_models(spark, path), ["trained", "given"])
    inputs = X.prepare_features(source, S.SPATIAL, context="Scoring", carry=["vec_id"])
    own = trained.score(inputs, "pipeline_probs").withColumn("model_name", F.when(F.col("vec_id") % 2 == 0, "trained").otherwise("given"))
    scored = C.score_by_model(own, models, "model_name")
    even = F.col("model_name") == "trained"
    apart = F.array_max(F.transform(F.arrays_zip(F.col("probs").alias("a"), F.col("pipeline_probs").alias("b")), lambda p: F.abs(p["a"] - p["b"])))
    return rounded(scored.select(
        "vec_id", "model_name", F.size("probs").alias("n_classes"), F.when(~even, F.array_max("probs")).alias("top_prob"),
        F.when(~even, C.class_of(F.col("probs"), _RULE.class_ids)).alias("class_id"), F.when(even, apart <= 1e-6).alias("as_trained")))
