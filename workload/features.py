"""Reflectance, index and feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.operators import features as X
from shorepix.operators import raster as G
from shorepix.operators import registry as Y
from shorepix.operators import rules as Q
from shorepix.operators import scoring as C
from shorepix.sources.tables import union_by_name

from . import derive as D
from . import query, rounded, table, with_ctes

KEY = ("l_orderkey", "l_linenumber")
KEY_SQL = "l_orderkey, l_linenumber"
RAW4 = [S.raw_name(band) for band in S.SEQUENCE_BANDS[S.SPATIAL]]
RAW12 = [S.raw_name(band) for band in S.STACK_BANDS]


def _columns(names) -> str:
    return ", ".join(f'"{name}"' for name in names)


_STAN4 = [S.stan_name(band) for band in S.SEQUENCE_BANDS[S.SPATIAL]]
_FEAT4 = [("px", D.PIXELS4_SQL), *D.features_sql("px", S.SEQUENCE_BANDS[S.SPATIAL])]


@query("standardise_row", with_ctes(_FEAT4, f"SELECT {KEY_SQL}, {_columns(_STAN4)} FROM feat"))
def standardise_row(spark, folder):
    return X.with_standardised(D.pixels4(spark, folder), RAW4).select(*KEY, *_STAN4)


@query("ndvi_ndwi", with_ctes(_FEAT4, f"SELECT {KEY_SQL}, {_columns(['NDVI', 'NDWI'])} FROM feat"))
def ndvi_ndwi(spark, folder):
    return X.with_feature_indices(D.pixels4(spark, folder)).select(*KEY, "NDVI", "NDWI")


_RAW_INDEX = '(("Reflectance_B08" - "Reflectance_B04") / nullif("Reflectance_B08" + "Reflectance_B04", 0))'


@query("ndvi_raw", with_ctes([("px", D.PIXELS4_SQL)], f"""SELECT {KEY_SQL}, {_RAW_INDEX} AS "NDVI",
 ("Reflectance_B03" - "Reflectance_B08") / nullif("Reflectance_B08" + "Reflectance_B03", 0) AS "NDWI" FROM px"""))
def ndvi_raw(spark, folder):
    return X.with_scene_indices(D.pixels4(spark, folder)).select(*KEY, "NDVI", "NDWI")


@query("spc", with_ctes([("px", D.PIXELS4_SQL)], f'SELECT {KEY_SQL}, 172.06 * {_RAW_INDEX} - 22.18 AS "SPC" FROM px'))
def spc(spark, folder):
    return X.with_scene_indices(D.pixels4(spark, folder)).select(*KEY, "SPC")


@query("seagrass_cover", with_ctes([("px", D.PIXELS4_SQL)], f"""SELECT {KEY_SQL}, CASE WHEN 1 + l_linenumber % 8 = 4
 AND least(greatest(172.06 * {_RAW_INDEX} - 22.18, 0), 100) >= 20 THEN least(greatest(172.06 * {_RAW_INDEX} - 22.18, 0), 100)
 ELSE -1.0 END AS cover FROM px"""))
def seagrass_cover(spark, folder):
    pixels = X.with_scene_indices(D.pixels4(spark, folder))
    cover = Q.seagrass_cover(1 + F.col("l_linenumber") % 8, F.col("SPC"))
    return pixels.select(*KEY, cover.alias("cover"))


@query("prepare_features_spatial", with_ctes(_FEAT4, f"SELECT {KEY_SQL}, {_columns(S.MODE_FEATURES[S.SPATIAL])} FROM feat"))
def prepare_features_spatial(spark, folder):
    stale = D.pixels4(spark, folder).withColumn("NDVI", F.lit(999.0)).withColumn("Reflectance_Stan_B02", F.lit(999.0))
    return X.prepare_features(stale, S.SPATIAL, context="Apply pixel table", carry=KEY)


@query("prepare_features_spectral", with_ctes(
    [("sp", D.SPECTRA_SQL), *D.features_sql("sp", S.MODEL_BANDS[S.SPECTRAL])],
    f"SELECT vec_id, {_columns(S.MODE_FEATURES[S.SPECTRAL])} FROM feat"))
def prepare_features_spectral(spark, folder):
    return X.prepare_features(D.spectra(spark, folder), S.SPECTRAL, context="Apply pixel table", carry=["vec_id"],
                              derive=[X.BANDS, X.INDICES])



@query("coerce_numeric", f"""SELECT {KEY_SQL}, l_quantity, CASE WHEN l_quantity < 10 OR l_quantity >= 20 AND l_quantity < 25 THEN NULL
 WHEN l_quantity < 20 THEN l_tax + 0.0 ELSE l_linenumber * 10.0 END AS value FROM lineitem""")
def coerce_numeric(spark, folder):
    q = F.col("l_quantity")
    text = (F.when(q < 10, "n/a").when(q < 20, F.concat(F.lit(" "), (F.col("l_tax") + 0.0).cast("string"), F.lit(" ")))
            .when(q < 25, "NaN").otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("e1"))))
    lines = table(spark, folder, "lineitem").select(*KEY, "l_quantity", text.alias("value"))
    return X.coerce_numeric(lines, ["value"])


@query("union_by_name_drop_allnull", """SELECT c_custkey AS key, c_mktsegment AS "True_Class", c_acctbal AS balance, NULL::INTEGER AS nation FROM customer WHERE c_acctbal > 0
 UNION ALL SELECT s_suppkey, NULL, s_acctbal, s_nationkey FROM supplier""")
def union_by_name_drop_allnull(spark, folder):
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    some = F.col("c_acctbal") > 0
    left = customer.select(F.when(some, F.col("c_custkey")).alias("key"), F.when(some, F.col("c_mktsegment")).alias("True_Class"),
                           F.when(some, F.col("c_acctbal")).alias("balance"))
    right = supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return union_by_name([left, right])



@query("valid_pixels", with_ctes([("px", D.PIXELS4_SQL)], f"""SELECT {KEY_SQL}, "Reflectance_B02", CASE WHEN "Reflectance_B04" > 2 THEN "Reflectance_B04" END AS "Reflectance_B04" FROM px
 WHERE "Reflectance_B02" > 5"""))
def valid_pixels(spark, folder):
    sparse = D.pixels4(spark, folder).select(
        *KEY, F.when(F.col("Reflectance_B02") > 5, F.col("Reflectance_B02")).alias("Reflectance_B02"),
        F.when(F.col("Reflectance_B04") > 2, F.col("Reflectance_B04")).alias("Reflectance_B04"))
    return G.valid_pixels(sparse, ["Reflectance_B02"])


@query("scl_mask", with_ctes([("px", D.PIXELS4_SQL)], f"""SELECT {KEY_SQL}, CASE WHEN s IN (1, 11) THEN NULL ELSE "Reflectance_B02" END AS "Reflectance_B02",
 CASE WHEN s IN (1, 11) THEN NULL ELSE "Reflectance_B08" END AS "Reflectance_B08", CASE WHEN s IN (1, 11) THEN NULL ELSE s END AS scl
 FROM (SELECT *, CASE WHEN "Reflectance_B02" < 49 THEN CAST("Reflectance_B02" AS INTEGER) % 12 END AS s FROM px)"""))
def scl_mask(spark, folder):
    b02 = F.col("Reflectance_B02")
    flagged = D.pixels4(spark, folder).withColumn("scl", F.when(b02 < 49, b02.cast("int") % 12))
    return G.apply_scl(flagged, ["Reflectance_B02", "Reflectance_B08"]).select(*KEY, "Reflectance_B02", "Reflectance_B08", "scl")


@query("boa_offset", with_ctes([("px", D.PIXELS4_SQL)], f"""SELECT {KEY_SQL}, CASE WHEN 397 + l_linenumber > 399 THEN "Reflectance_B03" - 1000 ELSE "Reflectance_B03" END AS "Reflectance_B03" FROM px"""))
def boa_offset(spark, folder):
    known = D.pixels4(spark, folder).withColumn("baseline", F.col("l_linenumber") + 397)
    return G.remove_offset(known, ["Reflectance_B03"]).select(*KEY, "Reflectance_B03")


@query("bbox_crop", """SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity AS y FROM lineitem
 WHERE l_extendedprice BETWEEN 20000 AND 45000.5 AND l_quantity BETWEEN 10 AND 30""")
def bbox_crop(spark, folder):
    pixels = table(spark, folder, "lineitem").select(*KEY, F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return G.crop(pixels, (20000, 30, 45000.5, 10))


# -- spectral sequences -------------------------------------------------------------------

_GROUPS = S.sequence_groups(S.SPECTRAL)
_FLAT = [name for group in _GROUPS for name in group]
_SEQ = [("sp", f"SELECT * REPLACE (CASE WHEN label = 3 THEN NULL ELSE \"Reflectance_B05\" END AS \"Reflectance_B05\") FROM ({D.SPECTRA_SQL})"),
        *D.features_sql("sp", S.STACK_BANDS)]


def _sequence(spark, folder):
    source = D.spectra(spark, folder)
    gaps = source.withColumn("Reflectance_B05", F.when(F.col("label") != 3, F.col("Reflectance_B05")))
    return X.sequence_table(gaps, S.SPECTRAL, context="Sequence inputs", carry=["vec_id", "label"])


@query("sequence_features", with_ctes(_SEQ, "SELECT vec_id, " + ", ".join(f'coalesce("{n}", 0) AS "{n}"' for n in _FLAT) + " FROM feat"))
def sequence_features(spark, folder):
    return _sequence(spark, folder).drop("label")


@query("sequence_norm_stats", with_ctes(
    [*_SEQ, ("seq", "SELECT " + ", ".join(f'coalesce("{n}", 0.0) AS "{n}"' for n in _FLAT) + " FROM feat")],
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(avg(\"{n}\"), 6) AS mean, round(CASE WHEN stddev_pop(\"{n}\") > 0 THEN stddev_pop(\"{n}\") ELSE 1.0 END, 6) AS std FROM seq" for n in _FLAT)))
def sequence_norm_stats(spark, folder):
    return rounded(X.sequence_statistics(_sequence(spark, folder), _FLAT))


_NORM = {"mean": [[0.9 + 0.01 * i for i in range(12)], [0.5] * 12], "std": [[0.1 + 0.01 * i for i in range(12)], [0.0] + [0.3] * 11]}


def _normal_sql(channel: int) -> str:
    cells = []
    for i, name in enumerate(_GROUPS[channel]):
        std = _NORM["std"][channel][i] or 1.0
        cells.append(f'round((coalesce("{name}", 0.0) - {_NORM["mean"][channel][i]!r}) / {std!r}, 6) AS n{channel}_{i}')
    return ", ".join(cells)


@query("sequence_normalise", with_ctes(_SEQ, f"SELECT vec_id, {_normal_sql(0)}, {_normal_sql(1)} FROM feat"))
def sequence_normalise(spark, folder):
    shaped = _sequence(spark, folder).select("vec_id", X.sequence_array(_GROUPS, _NORM).alias("seq"))
    return rounded(shaped.select("vec_id", *[
        F.col("seq")[channel][i].alias(f"n{channel}_{i}") for channel in range(2) for i in range(12)]))


# -- name lists and registry --------------------------------------------------------------


@query("feature_name_lists", """SELECT p_partkey, array_to_string(list_filter([p_type, p_brand, CASE WHEN p_name IN (p_type, p_brand) THEN NULL ELSE p_name END], lambda x: x IS NOT NULL), '|') AS names FROM part""")
def feature_name_lists(spark, folder):
    names = F.array("p_type", F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit(""), "p_brand", F.lit("  "), "p_name", "p_brand")
    return table(spark, folder, "part").select("p_partkey", F.array_join(X.clean_name_list(names), "|").alias("names"))


@query("infer_mode", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_type <> 'PROMO' THEN 'high_spatial_accuracy' WHEN p_size % 3 = 1 AND p_type <> 'PROMO' THEN 'high_spectral_complexity' END AS mode,
 CASE WHEN p_type = 'PROMO' THEN p_brand ELSE '' END AS unsupported FROM part""")
def infer_mode(spark, folder):
    lists = [F.array(*map(F.lit, reversed(S.MODE_FEATURES[mode]))) for mode in S.MODES]
    part_list = F.array(F.lit("NDVI"), F.lit("NDWI"))
    size = F.col("p_size") % 3
    base = F.when(size == 0, lists[0]).when(size == 1, lists[1]).otherwise(part_list)
    names = F.when(F.col("p_type") == "PROMO", F.concat(base, F.array("p_brand"))).otherwise(base)
    return table(spark, folder, "part").select(
        "p_partkey", X.mode_of_features(names).alias("mode"), F.array_join(X.unsupported_features(names), "|").alias("unsupported"))


_SPATIAL_BANDS, _SPECTRAL_BANDS = (",".join(S.SEQUENCE_BANDS[mode]) for mode in S.MODES)


@query("required_bands", f"""SELECT p_partkey, CASE WHEN p_size < 25 AND p_type = 'PROMO' THEN '{_SPATIAL_BANDS},B05' WHEN p_size < 25 THEN '{_SPATIAL_BANDS}'
 ELSE '{_SPECTRAL_BANDS}' END AS bands FROM part""")
def required_bands(spark, folder):
    mode = F.when(F.col("p_size") < 25, S.SPATIAL).otherwise(S.SPECTRAL)
    special = F.when(F.col("p_type") == "PROMO", F.array(*map(F.lit, S.SPECIALIST_BANDS)))
    return table(spark, folder, "part").select("p_partkey", F.array_join(X.required_bands(mode, special), ",").alias("bands"))



@query("model_registry", f"""WITH m AS (SELECT p_partkey, p_name, p_brand, p_size, p_type, p_size % 4 AS kind, p_retailprice > 1500 AS odd FROM part),
 s AS (SELECT p_brand, min('m' || CAST(p_partkey AS VARCHAR)) AS specialist_name FROM m WHERE p_type = 'PROMO' GROUP BY p_brand)
 SELECT 'm' || CAST(m.p_partkey AS VARCHAR) AS model_name, m.p_brand AS folder, CASE WHEN kind IN (0, 1) THEN 'tabular_dense' ELSE 'spectral_1d_cnn' END AS model_family,
 CASE WHEN kind IN (0, 2) THEN 'high_spatial_accuracy' ELSE 'high_spectral_complexity' END AS feature_mode,
 CASE WHEN kind = 0 THEN 10 WHEN kind = 1 THEN 26 WHEN kind = 2 THEN 4 ELSE 24 END AS n_features,
 CASE WHEN kind IN (0, 1) THEN 0 WHEN kind = 2 THEN 1 ELSE 2 END AS n_groups, kind = 3 AS uses_standardised,
 CASE WHEN kind IN (2, 3) AND p_size > 40 THEN 'normalization does not fit' END AS problem, s.specialist_name
 FROM m LEFT JOIN s ON s.p_brand = m.p_brand WHERE m.p_type <> 'PROMO'""")
def model_registry(spark, folder):
    kind = F.col("p_size") % 4
    names = lambda values: F.array(*map(F.lit, values))
    raw_only = [name for group in S.sequence_groups(S.SPATIAL, False) for name in group]
    both = [name for group in S.sequence_groups(S.SPECTRAL) for name in group]
    statistics = lambda groups, width: F.array(*[F.array(*[F.lit(1.0)] * width)] * groups)
    norm = F.when(F.col("p_size") > 40, statistics(1, 3)).when(kind == 2, statistics(1, 4)).otherwise(statistics(2, 12))
    models = table(spark, folder, "part").select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model_name"), F.col("p_brand").alias("folder"),
        F.when(kind == 0, "Tabular Dense").when(kind >= 2, "spectral_1d_cnn").alias("model_family"),
        F.when(kind == 3, "High-Spectral Complexity").alias("feature_mode"),
        F.when(kind == 0, names(reversed(S.MODE_FEATURES[S.SPATIAL]))).when(kind == 1, names(S.MODE_FEATURES[S.SPECTRAL])).alias("required_features"),
        F.when(kind == 2, names(raw_only)).when(kind == 3, names(both)).alias("sequence_features"),
        F.lit(None).cast("array<array<string>>").alias("channel_groups"), norm.alias("norm_mean"), norm.alias("norm_std"),
        F.when(F.col("p_type") == "PROMO", S.SPECIALIST_ROLE).alias("specialist_role"),
        F.lit(None).cast("array<string>").alias("vocabulary"), F.lit(None).cast("array<int>").alias("class_ids"))
    done = Y.with_specialist(Y.complete_metadata(models))
    return done.select("model_name", "folder", "model_family", "feature_mode", F.size("required_features").alias("n_features"),
                       F.size("channel_groups").alias("n_groups"), "uses_standardised", "problem", "specialist_name")


# -- scoring ------------------------------------------------------------------------------

_MODEL = D.line_model()


@query("dense_score", with_ctes([*_FEAT4, *D.dense_sql(_MODEL, "feat", "m")],
                                f"SELECT {KEY_SQL}, " + ", ".join(f"round(mprobs[{i + 1}], 6) AS p{i + 1}" for i in range(8)) + " FROM mscored"))
def dense_score(spark, folder):
    ready = X.prepare_features(D.pixels4(spark, folder), S.SPATIAL, context="Scoring", carry=KEY)
    scored = C.score_dense(ready, _MODEL)
    return rounded(scored.select(*KEY, *[F.col("probs")[i].alias(f"p{i + 1}") for i in range(8)]))


@query("argmax_class", with_ctes([*_FEAT4, *D.dense_sql(_MODEL, "feat", "m")],
                                 f"SELECT {KEY_SQL}, CAST(list_position(mprobs, list_max(mprobs)) AS INTEGER) AS class_id, round(list_max(mprobs), 6) AS class_prob FROM mscored"))
def argmax_class(spark, folder):
    ready = X.prepare_features(D.pixels4(spark, folder), S.SPATIAL, context="Scoring", carry=KEY)
    scored = C.score_dense(ready, _MODEL)
    return rounded(scored.select(*KEY, C.class_of(F.col("probs"), _MODEL.class_ids).alias("class_id"), F.array_max("probs").alias("class_prob")))


def sequence_model(classes: int = 10) -> C.SequenceModel:
    """Sequence network with weights given by a rule."""
    hidden, deeper, wide = C.SequenceModel.widths(12)
    flat = lambda n, m, s: D._weights(n, m, s)
    kernel = lambda n, m, s: [[flat(1, 3, s + 0.3 * i + 0.7 * j)[0] for j in range(m)] for i in range(n)]
    return C.SequenceModel(
        _GROUPS, {"mean": [[1.0] * 12, [0.5] * 12], "std": [[0.15] * 12, [0.3] * 12]},
        (kernel(hidden, 2, 0.1), [0.01 * i for i in range(hidden)]), (kernel(deeper, hidden, 0.2), [0.0] * deeper),
        (flat(wide, deeper, 0.3), [0.1] * wide), (flat(classes, wide, 0.4), [0.0] * classes), list(range(1, classes + 1)))


def _literal(value) -> str:
    """Nested lists of doubles as SQL text."""
    return "[" + ", ".join(map(_literal, value)) + "]" if isinstance(value, list) else f"CAST({float(value)!r} AS DOUBLE)"


def sequence_sql(model: C.SequenceModel, source: str) -> list[tuple[str, str]]:
    """CTEs that score ``source``; ``seqscored`` adds a list ``probs``. A convolution is a dot product of the kernel of an
    output channel with three neighbouring bands of all input channels, 0 beyond either end. Biases stand behind the
    weights and meet a constant 1."""
    length = len(model.groups[0])
    rows = [[f'CAST((coalesce("{n}", 0.0) - {m!r}) / {s!r} AS DOUBLE)' for n, m, s in zip(*group, strict=True)]
            for group in zip(model.groups, model.norm["mean"], model.norm["std"], strict=True)]
    parts = [("seq0", "SELECT *, [" + ", ".join(f"[{', '.join(row)}]" for row in rows) + f"] AS x FROM {source}")]
    one, zero = _literal([1.0]), _literal([0.0])
    for depth, (kernel, bias) in enumerate((model.conv1, model.conv2)):
        flat = [[w for channel in out for w in channel] + [b] for out, b in zip(kernel, bias, strict=True)]
        near = f"list_transform(range({length}), lambda t: flatten(list_transform(x, lambda c: list_concat({zero}, list_concat(c, {zero}))[t + 1:t + 3])) || {one})"
        parts.append((f"seqnear{depth}", f"SELECT * EXCLUDE (x), {near} AS near FROM seq{depth}"))
        parts.append((f"seq{depth + 1}", f"SELECT * EXCLUDE (near), list_transform({_literal(flat)}, "
                                         "lambda k: list_transform(near, lambda v: greatest(list_dot_product(k, v), 0.0))) AS x "
                                         f"FROM seqnear{depth}"))
    (w1, b1), (w2, b2) = model.dense1, model.dense2
    first, last = ([[*row, b] for row, b in zip(w, bias, strict=True)] for w, bias in ((w1, b1), (w2, b2)))
    return [*parts,
            ("seqmean", f"SELECT * EXCLUDE (x), list_transform(x, lambda c: list_avg(c)) || {one} AS m FROM seq2"),
            ("seqhidden", f"SELECT * EXCLUDE (m), list_transform({_literal(first)}, lambda k: greatest(list_dot_product(k, m), 0.0)) || {one} AS h FROM seqmean"),
            ("seqlogits", f"SELECT * EXCLUDE (h), list_transform({_literal(last)}, lambda k: list_dot_product(k, h)) AS z FROM seqhidden"),
            ("seqexp", "SELECT * EXCLUDE (z), list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM seqlogits"),
            ("seqscored", "SELECT * EXCLUDE (e), list_transform(e, lambda v: v / list_sum(e)) AS probs FROM seqexp")]


@query("sequence_score", with_ctes([*_SEQ, *sequence_sql(sequence_model(), "feat")],
                                   "SELECT vec_id, CAST(list_position(probs, list_max(probs)) AS INTEGER) AS class_id, "
                                   "round(list_max(probs), 6) AS class_prob, round(list_sum(probs), 6) AS prob_sum FROM seqscored"))
def sequence_score(spark, folder):
    model = sequence_model()
    scored = C.score_sequence(_sequence(spark, folder), model)
    return rounded(scored.select("vec_id", C.class_of(F.col("probs"), model.class_ids).alias("class_id"), F.array_max("probs").alias("class_prob"),
                                 F.aggregate("probs", F.lit(0.0), lambda a, b: a + b).alias("prob_sum")))
