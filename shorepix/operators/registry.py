"""Model registry: metadata rows in place of attributes on a pickled learner."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from . import features as X
from . import scoring as C
from .lookup import attach

DENSE, SEQUENCE = "tabular_dense", "spectral_1d_cnn"  # fixed family names


def resolve_family(family: Column) -> Column:
    """Canonical family name; a missing one is dense; any other is an error."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(family, F.lit("")))), r"[- ]", "_")
    key = F.when(key == "", DENSE).otherwise(key)
    return F.when(key.isin(DENSE, SEQUENCE), key)


def _names(values) -> Column:
    return F.array(*map(F.lit, values))


def _channel_groups(features: Column, mode: Column) -> Column:
    """Channel groups behind a flat feature list: raw + standardized, raw only, or one group."""
    groups = F.array(features)
    for name in reversed(S.MODES):
        for standardised in (False, True):
            parts = S.sequence_groups(name, standardised)
            flat = [feature for part in parts for feature in part]
            groups = F.when((mode == name) & (features == _names(flat)), F.array(*map(_names, parts))).otherwise(groups)
    return groups


def _sequence_mode(features: Column) -> Column:
    """Mode whose raw, or raw and standardized, sequence inputs equal the features in any order."""
    ordered = F.array_sort(X.clean_name_list(features))
    mode = F.lit(None).cast("string")
    for name in reversed(S.MODES):
        for standardised in (False, True):
            flat = sorted(feature for part in S.sequence_groups(name, standardised) for feature in part)
            mode = F.when(ordered == _names(flat), F.lit(name)).otherwise(mode)
    return mode


def _per_channel(statistics: Column, groups: Column) -> Column:
    """Statistics in one flat row, cut into the channels; any other layout as it is."""
    width = F.size(F.get(groups, 0))
    flat = F.get(statistics, 0)
    cut = F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda channel: F.slice(flat, channel * width + 1, width))
    whole = (F.size(statistics) == 1) & (F.size(groups) > 1) & (F.size(flat) == F.size(groups) * width)
    return F.when(F.coalesce(whole, F.lit(False)) & (width > 0), cut).otherwise(statistics)


def complete_metadata(models: DataFrame) -> DataFrame:
    """Fill what can be inferred and flag what cannot be used.

    Explicit values win. Without a mode it is inferred from the feature list; a sequence model
    without channel groups gets them from its features; statistics in one row are spread over the
    channels. ``problem`` is NULL for a usable row.
    """
    empty = F.array().cast("array<string>")
    family = resolve_family(F.col("model_family"))
    is_sequence = F.col("model_family") == SEQUENCE
    base = models.withColumns({
        "model_family": family,
        "required_features": X.clean_name_list(F.coalesce("required_features", empty)),
        "sequence_features": X.clean_name_list(F.coalesce("sequence_features", empty)),
        "channel_groups": F.filter(
            F.transform(F.coalesce(F.col("channel_groups"), F.array().cast("array<array<string>>")), lambda group: X.clean_name_list(group)),
            lambda group: F.size(group) > 0),
    })
    listed = F.when(F.size("sequence_features") > 0, F.col("sequence_features")).when(
        F.size("required_features") > 0, F.col("required_features")).otherwise(F.flatten("channel_groups"))
    mode = F.coalesce(
        F.regexp_replace(F.lower(F.trim("feature_mode")), r"[- ]", "_"),
        F.when(is_sequence, _sequence_mode(listed)).otherwise(X.mode_of_features(F.col("required_features"))))
    staged = base.withColumn("feature_mode", mode).withColumn(
        "sequence_features", F.when(is_sequence, listed).otherwise(empty))
    staged = staged.withColumn("channel_groups", F.when(
        is_sequence & (F.size("channel_groups") == 0), _channel_groups(F.col("sequence_features"), F.col("feature_mode"))
    ).when(is_sequence, F.col("channel_groups")).otherwise(F.array().cast("array<array<string>>")))
    staged = staged.withColumn("required_features", F.when(
        is_sequence & (F.size("required_features") == 0), F.col("sequence_features")).otherwise(F.col("required_features")))
    lengths = F.array_distinct(F.transform("channel_groups", lambda group: F.size(group)))
    staged = staged.withColumns({name: _per_channel(F.col(name), F.col("channel_groups")) for name in ("norm_mean", "norm_std")})
    shape = F.transform("channel_groups", lambda group: F.size(group))
    fits = (F.transform("norm_mean", lambda row: F.size(row)) == shape) & (F.transform("norm_std", lambda row: F.size(row)) == shape)
    special = F.coalesce(F.col("specialist_role") == S.SPECIALIST_ROLE, F.lit(False)) & ~is_sequence
    problem = (
        F.when(F.col("model_family").isNull(), "unknown family")
        .when(~special & (F.col("feature_mode").isNull() | ~F.col("feature_mode").isin(*S.MODES)), "unknown feature mode")
        .when(F.size("required_features") == 0, "no features")
        .when(is_sequence & (F.size(lengths) != 1), "channel groups differ in length")
        .when(is_sequence & ~F.coalesce(fits, F.lit(False)), "normalization does not fit")
    )
    uses_stan = F.exists("sequence_features", lambda name: name.startswith("Reflectance_Stan_"))
    return staged.withColumns({"uses_standardised": is_sequence & uses_stan, "problem": problem})


def with_specialist(models: DataFrame) -> DataFrame:
    """Add ``specialist_name``: the specialist in the folder of each primary model, if there is one."""
    role = F.col("specialist_role") == S.SPECIALIST_ROLE
    specialists = models.where(role).groupBy("folder").agg(F.min("model_name").alias("specialist_name"))
    primary = models.where(~F.coalesce(role, F.lit(False)))
    return attach(primary, specialists, ["folder"])


# -- models as table rows -------------------------------------------------------------------


def model_row(name: str, model, folder: str = "", version: int = 1, mode: str | None = None, role: str | None = None) -> dict:
    """A row of MODEL_SCHEMA that holds all of a dense, sequence or trained model."""
    mode = mode or getattr(model, "mode", None)
    model = C.as_model(model)
    row = dict.fromkeys(S.MODEL_SCHEMA.names)
    row.update(model_name=name, folder=folder, version=version, feature_mode=mode, specialist_role=role,
               vocabulary=list(model.labels), class_ids=list(model.class_ids))
    pair = lambda key, layers: [{key: weights, "bias": bias} for weights, bias in layers]
    if isinstance(model, C.SequenceModel):
        names = model.inputs
        row.update(model_family=SEQUENCE, required_features=names, sequence_features=names, channel_groups=model.groups, norm_mean=model.norm["mean"],
                   norm_std=model.norm["std"], convolutions=pair("kernel", [model.conv1, model.conv2]), layers=pair("weights", [model.dense1, model.dense2]))
    else:
        row.update(model_family=DENSE, required_features=list(model.features), activation=model.activation, input_mean=list(model.mean),
                   input_std=list(model.std), input_fill=list(model.fill), flagged_features=list(model.flags), layers=pair("weights", model.layers))
    return row


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.MODEL_SCHEMA).parquet(path)


def save_model(spark: SparkSession, path: str, name: str, model, folder: str = "", mode: str | None = None, role: str | None = None) -> int:
    """Append a model to the registry at ``path`` under the next version of its name; returns the version."""
    spark.createDataFrame([], S.MODEL_SCHEMA).write.mode("append").parquet(path)
    last = read_models(spark, path).where(F.col("model_name") == name).agg(F.max("version")).first()[0] or 0
    row = model_row(name, model, folder, last + 1, mode, role)
    spark.createDataFrame([row], S.MODEL_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return last + 1


def load_models(models: DataFrame, names: Iterable[str] | None = None, version: int | None = None) -> dict[str, C.Model]:
    """Models by name, of the highest version unless one is given; only these rows reach the driver.

    Metadata is completed and checked first; a row that cannot be used raises, as does a name without a row.
    """
    wanted = None if names is None else list(names)
    chosen = models if wanted is None else models.where(F.col("model_name").isin(wanted))
    if version is not None:
        chosen = chosen.where(F.col("version") == version)
    newest = chosen.groupBy("model_name").agg(F.max("version").alias("version"))
    rows = complete_metadata(chosen.join(newest, ["model_name", "version"], "left_semi")).collect()
    found = {row["model_name"]: _model(row) for row in rows}
    if lost := [name for name in wanted or () if name not in found]:
        raise ValueError(f"no such model in the registry: {S.shorten(lost)}")
    return found


def _model(row) -> C.Model:
    if row["problem"]:
        raise ValueError(f"model '{row['model_name']}' cannot be used: {row['problem']}")
    dense = [(layer["weights"], layer["bias"]) for layer in row["layers"] or ()]
    ids, labels = row["class_ids"] or [], row["vocabulary"] or []
    if row["model_family"] == SEQUENCE:
        convolutions = [(layer["kernel"], layer["bias"]) for layer in row["convolutions"] or ()]
        if len(convolutions) != 2 or len(dense) != 2:
            raise ValueError(f"model '{row['model_name']}' has no weights of a sequence network")
        return C.SequenceModel(row["channel_groups"], {"mean": row["norm_mean"], "std": row["norm_std"]}, *convolutions, *dense, ids, labels)
    if not dense:
        raise ValueError(f"model '{row['model_name']}' has no weights")
    return C.DenseModel(row["required_features"], row["input_mean"], row["input_std"], dense, ids, labels, row["input_fill"] or [],
                        row["flagged_features"] or [], row["activation"] or C.RELU)
