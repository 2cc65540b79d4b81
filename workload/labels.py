"""Label and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.functions import names as N
from shorepix.operators import features as X
from shorepix.operators import labels as L
from shorepix.operators import metrics as E
from shorepix.operators import ranking as K
from shorepix.plans.train import specialist_training_table
from shorepix.plans.validate import evaluate

from . import derive as D
from . import query, rounded, table, with_ctes

# Raw labels: part types and names, numbers, accented and misspelt class names.
_RAW = """SELECT p_partkey, CASE p_size % 12 WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN ' ' || CAST(p_partkey % 14 AS VARCHAR) || '.0' WHEN 3 THEN CAST(p_partkey % 12 AS VARCHAR)
 WHEN 4 THEN 'Zostéra' WHEN 5 THEN 'GREEN-Macroalgae' WHEN 6 THEN 'seagrass ' || p_type WHEN 7 THEN 'algae' WHEN 8 THEN 'h2o' WHEN 9 THEN '  ' WHEN 10 THEN p_brand ELSE 'Diatoms!' END AS label FROM part"""


def raw_labels(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size") % 12
    label = (F.when(size == 0, F.col("p_type")).when(size == 1, F.col("p_name"))
             .when(size == 2, F.concat(F.lit(" "), (key % 14).cast("string"), F.lit(".0"))).when(size == 3, (key % 12).cast("string"))
             .when(size == 4, "Zostéra").when(size == 5, "GREEN-Macroalgae").when(size == 6, F.concat(F.lit("seagrass "), "p_type"))
             .when(size == 7, "algae").when(size == 8, "h2o").when(size == 9, "  ").when(size == 10, F.col("p_brand")).otherwise("Diatoms!"))
    return table(spark, folder, "part").select("p_partkey", label.alias("label"))


RAW = ("raw", _RAW)
_FOLD = r"regexp_replace(lower(strip_accents(trim(label))), '[^\p{L}\p{N}]', '', 'g')"
_NUMBER = r"CASE WHEN regexp_full_match(trim(label), '[+-]?\d+(\.0+)?') THEN CAST(regexp_replace(trim(label), '\.0+$', '') AS BIGINT) END"
_ALIASES = [(spelling, concept, [c for c, _, _ in S.CONCEPTS].index(concept)) for spelling, concept in L.SPELLINGS.items()]
_CASCADE = [
    ("numbers", "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{c}')" for n, c in S.CLASS_NUMBER_CONCEPT.items()) + ") t(num, concept)"),
    ("aliases", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{c}', {i})" for s, c, i in _ALIASES) + ") t(alias, concept, prio)"),
]


def concepts_sql(source: str, out: str) -> list[tuple[str, str]]:
    """Cascade without the similarity stage: no label of these tables needs it (a test says so)."""
    return [
        (f"{out}_f", f"SELECT DISTINCT label, {_FOLD} AS folded, {_NUMBER} AS num FROM {source}"),
        (f"{out}_p", f"SELECT f.label, min_by(a.concept, a.prio) AS concept FROM {out}_f f JOIN aliases a ON length(a.alias) >= 5 AND f.folded <> '' AND (contains(f.folded, a.alias) OR contains(a.alias, f.folded)) GROUP BY f.label"),
        (out, f"SELECT f.label, f.folded, f.num, coalesce(n.concept, a.concept, p.concept) AS concept FROM {out}_f f LEFT JOIN numbers n ON n.num = f.num LEFT JOIN aliases a ON a.alias = f.folded LEFT JOIN {out}_p p ON p.label = f.label"),
    ]


@query("normalise_label", with_ctes([RAW], f"SELECT p_partkey, label, {_FOLD} AS folded FROM raw"))
def normalise_label(spark, folder):
    return raw_labels(spark, folder).withColumn("folded", L.normalise_label(F.col("label")))


@query("numeric_label", with_ctes([RAW], f"SELECT p_partkey, label, {_NUMBER} AS number FROM raw"))
def numeric_label(spark, folder):
    return raw_labels(spark, folder).withColumn("number", N.integer_label(F.col("label")))


@query("label_concepts", with_ctes([RAW, *_CASCADE, *concepts_sql("raw", "con")], "SELECT r.p_partkey, r.label, c.concept FROM raw r JOIN con c ON c.label = r.label"))
def label_concepts(spark, folder):
    return L.attach_concepts(raw_labels(spark, folder), "label").select("p_partkey", "label", "concept")


@query("label_concepts_fuzzy")
def label_concepts_fuzzy(spark, folder):
    """Concepts of all distinct words of all documents (similarity stage included)."""
    words = table(spark, folder, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''")
    found = L.label_concepts(words, "word")
    return found.groupBy("concept").agg(F.count(F.lit(1)).alias("n_words"))


# A second spelling of the label column: what a model might call the same classes.
_DATASET = ("dataset", "SELECT p_partkey AS row_id, CASE WHEN p_size % 12 = 9 THEN NULL ELSE label END AS label FROM (SELECT p.*, r.label FROM part p JOIN raw r ON r.p_partkey = p.p_partkey)")
_SPACE = [("space", "SELECT trim(coalesce(label, '<MISSING>')) AS label, min(row_id) AS first_position FROM dataset WHERE trim(coalesce(label, '<MISSING>')) <> '' GROUP BY 1")]


def _dataset(spark, folder):
    return raw_labels(spark, folder).select(F.col("p_partkey").alias("row_id"), F.when(F.trim("label") != "", F.col("label")).alias("label"))


@query("label_space", with_ctes([RAW, _DATASET, *_SPACE], "SELECT label, first_position FROM space"))
def label_space(spark, folder):
    return L.label_space(_dataset(spark, folder), "label", "row_id")


_PRED_WORDS = ("Microphytobenthos", "ULVOPHYCEAE", "4", "17", "small ring", "LARGE!", "kelp", "eelgrass")
_PRED = ("pred", f"SELECT c_custkey, list_extract({list(_PRED_WORDS)}, CAST(c_custkey % 8 AS INTEGER) + 1) AS label FROM customer")


@query("map_labels", with_ctes([
    RAW, _DATASET, *_SPACE, _PRED, *_CASCADE, *concepts_sql("space", "sc"), *concepts_sql("pred", "pc"),
    ("by_concept", "SELECT c.concept, min_by(s.label, s.first_position) AS l FROM sc c JOIN space s ON s.label = c.label WHERE c.concept IS NOT NULL GROUP BY 1"),
    ("by_text", "SELECT c.folded, min_by(s.label, s.first_position) AS l FROM sc c JOIN space s ON s.label = c.label WHERE c.folded <> '' GROUP BY 1"),
    ("titles", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t, _ in S.CONCEPTS) + ") t(concept, title)")],
    """SELECT p.c_custkey, p.label, CASE WHEN c.concept IS NOT NULL THEN coalesce(bc.l, ti.title) ELSE coalesce(bt.l, 'Class_' || CAST(c.num AS VARCHAR), trim(p.label)) END AS mapped
 FROM pred p JOIN pc c ON c.label = p.label LEFT JOIN by_concept bc ON bc.concept = c.concept LEFT JOIN by_text bt ON bt.folded = c.folded LEFT JOIN titles ti ON ti.concept = c.concept"""))
def map_labels(spark, folder):
    words = F.array(*map(F.lit, _PRED_WORDS))
    predicted = table(spark, folder, "customer").select("c_custkey", F.element_at(words, (F.col("c_custkey") % 8).cast("int") + 1).alias("label"))
    space = L.label_space(_dataset(spark, folder), "label", "row_id")
    return L.attach_mapped(predicted, "label", space, "mapped")


# -- metrics ------------------------------------------------------------------------------

PRED = ("p", D.PREDICTIONS_SQL)
COUNTS = [PRED, ("c", "SELECT coalesce(true_label, '<MISSING>') AS true_label, coalesce(pred_label, '<MISSING>') AS pred_label, count(*) AS n FROM p GROUP BY ALL")]
_OVERALL = """SELECT 'OVERALL' AS "Class", round(sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) / sum(n), 6) AS "Overall_Accuracy", NULL::DOUBLE AS "User_Accuracy_Precision", NULL::DOUBLE AS "Producer_Accuracy_Recall",
 CAST(sum(n) AS BIGINT) AS "Support_True", CAST(sum(n) AS BIGINT) AS "Support_Pred" FROM c"""
_PER_CLASS = """SELECT k.true_label AS "Class", NULL::DOUBLE AS "Overall_Accuracy", round(tp / nullif(sp, 0), 6) AS "User_Accuracy_Precision", round(tp / nullif(st, 0), 6) AS "Producer_Accuracy_Recall",
 CAST(st AS BIGINT) AS "Support_True", CAST(sp AS BIGINT) AS "Support_Pred" FROM (SELECT DISTINCT true_label FROM c WHERE true_label <> '<MISSING>') k,
 LATERAL (SELECT coalesce(sum(n) FILTER (c.true_label = k.true_label), 0) AS st, coalesce(sum(n) FILTER (c.pred_label = k.true_label), 0) AS sp, coalesce(sum(n) FILTER (c.true_label = k.true_label AND c.pred_label = k.true_label), 0) AS tp FROM c) m"""


def _counts(spark, folder):
    return E.confusion(D.predictions(spark, folder))


@query("class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark, folder):
    return E.class_counts(table(spark, folder, "embeddings"), "label")


@query("confusion_long", with_ctes(COUNTS, "SELECT * FROM c"))
def confusion_long(spark, folder):
    return _counts(spark, folder)


@query("confusion_wide", with_ctes(COUNTS, "SELECT k.v AS true_label, " + ", ".join(
    f"CAST(coalesce((SELECT sum(n) FROM c WHERE c.true_label = k.v AND c.pred_label = '{w}'), 0) AS BIGINT) AS \"{w}\"" for w in D.VOCABULARY) + f" FROM (SELECT unnest({D.VOCABULARY}) AS v) k"))
def confusion_wide(spark, folder):
    return E.confusion_matrix(_counts(spark, folder), D.VOCABULARY)


@query("class_metrics", with_ctes(COUNTS, _PER_CLASS + " UNION ALL " + _OVERALL))
def class_metrics(spark, folder):
    return rounded(E.metrics_table(_counts(spark, folder), D.VOCABULARY))


@query("validation_report", with_ctes(COUNTS, _PER_CLASS + " UNION ALL " + _OVERALL))
def validation_report(spark, folder):
    """Complete validation run: every label maps to the dataset label of its concept, which is itself here."""
    rows = D.predictions(spark, folder).withColumn("row_id", F.col("event_id"))
    return rounded(evaluate(rows, "true_label", "pred_label", D.VOCABULARY).metrics)


_FEW = "SELECT * FROM p WHERE true_label IS NULL OR true_label <> 'Magnoliopsida'"
_FEW_PA = [PRED, ("few", _FEW), ("c", """SELECT 'Absence' AS true_label, CASE WHEN pred_label = 'Magnoliopsida' THEN 'Presence' ELSE 'Absence' END AS pred_label, count(*) AS n FROM few GROUP BY ALL""")]


@query("validation_presence_absence", with_ctes(_FEW_PA, _PER_CLASS.replace("(SELECT DISTINCT true_label FROM c WHERE true_label <> '<MISSING>') k", "(VALUES ('Absence'), ('Presence')) k(true_label)") + " UNION ALL " + _OVERALL))
def validation_presence_absence(spark, folder):
    """Presence/absence validation whose truth holds no row of the target: both classes are reported all the same."""
    rows = D.predictions(spark, folder).withColumn("row_id", F.col("event_id"))
    few = rows.where(F.col("true_label").isNull() | (F.col("true_label") != S.DEFAULT_TARGET))
    return rounded(evaluate(few, "true_label", "pred_label", D.VOCABULARY, "presence_absence").metrics)


@query("overall_accuracy", with_ctes(COUNTS, _OVERALL))
def overall_accuracy(spark, folder):
    return rounded(E.overall_accuracy(_counts(spark, folder)).drop("position"))


_PA = ("pa", """SELECT CASE WHEN true_label = 'Magnoliopsida' AND NOT coalesce(ndvi < 0.246, false) THEN 'Presence' ELSE 'Absence' END AS t,
 CASE WHEN pred_label = 'Magnoliopsida' AND NOT coalesce(ndvi < 0.246, false) THEN 'Presence' ELSE 'Absence' END AS q FROM p""")


@query("presence_absence_scores", with_ctes([PRED, _PA, ("k", """SELECT count(*) FILTER (t = 'Presence' AND q = 'Presence') AS tp, count(*) FILTER (t = 'Absence' AND q = 'Absence') AS tn,
 count(*) FILTER (t = 'Absence' AND q = 'Presence') AS fp, count(*) FILTER (t = 'Presence' AND q = 'Absence') AS fn FROM pa""")],
    """SELECT tp AS "TP", tn AS "TN", fp AS "FP", fn AS "FN", round(tp / nullif(tp + fp, 0), 6) AS "Precision", round(tp / nullif(tp + fn, 0), 6) AS "Recall",
 round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS "F1", round((tp + tn) * 100.0 / (tp + tn + fp + fn), 6) AS "Accuracy" FROM k"""))
def presence_absence_scores(spark, folder):
    rows = D.predictions(spark, folder)
    both = rows.select(*[E.presence_with_ndvi(F.col(name), F.col("ndvi")).alias(name) for name in ("true_label", "pred_label")])
    return rounded(E.presence_scores(both, "true_label", "pred_label"))


@query("presence_absence_collapse", with_ctes([PRED], """SELECT event_id, CASE WHEN true_label = 'Sand' THEN 'Presence' ELSE 'Absence' END AS true_label,
 CASE WHEN pred_label = 'Sand' THEN 'Presence' ELSE 'Absence' END AS pred_label FROM p"""))
def presence_absence_collapse(spark, folder):
    rows = D.predictions(spark, folder)
    return rows.select("event_id", *[E.presence_absence(F.col(name), "Sand").alias(name) for name in ("true_label", "pred_label")])


@query("outside_predictions", with_ctes(COUNTS, "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_outside FROM c WHERE pred_label NOT IN (SELECT true_label FROM c WHERE true_label <> '<MISSING>')"))
def outside_predictions(spark, folder):
    return E.outside_predictions(_counts(spark, folder))


@query("class_weights", "SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM embeddings GROUP BY label")
def class_weights(spark, folder):
    return rounded(E.class_weights(table(spark, folder, "embeddings"), "label"))


@query("vocab", with_ctes([PRED], "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code, CAST(count(*) OVER () AS INTEGER) AS class_count FROM (SELECT DISTINCT true_label AS label FROM p WHERE true_label IS NOT NULL)"))
def vocab(spark, folder):
    return E.vocabulary(D.predictions(spark, folder), "true_label")


# -- splits, medians, training sets -------------------------------------------------------

_MIX, _RING = 48271, 2147483647  # multiplicative shuffle that both engines can state


def _shuffle(key: str):
    return (F.col(key) + 1) * F.lit(_MIX).cast("bigint") % F.lit(_RING).cast("bigint")


@query("stratified_split", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey + 1) * {_MIX} % {_RING}, o_orderkey) AS rn,
 count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus, rn <= greatest(1, least(n - 1, CAST(round_even(n * 0.3::DOUBLE, 0) AS BIGINT))) AS is_valid FROM r""")
def stratified_split(spark, folder):
    order = _shuffle("o_orderkey")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return K.stratified_split(rows, "o_orderstatus", ["o_orderkey"], 0.3, order=order, bucket=F.floor(order / 65536))


@query("random_split", f"""SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey + 1) * {_MIX} % {_RING}, o_orderkey) <= floor(count(*) OVER () * 0.3::DOUBLE) AS is_valid FROM orders""")
def random_split(spark, folder):
    order = _shuffle("o_orderkey")
    return K.random_split(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 0.3, order=order, bucket=F.floor(order / 65536))


@query("median_impute", """WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 3 THEN l_extendedprice END AS price, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS quantity FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(coalesce(price, (SELECT median(price) FROM x)), 6) AS price, round(coalesce(quantity, (SELECT median(quantity) FROM x)), 6) AS quantity,
 price IS NULL AS price_na, quantity IS NULL AS quantity_na FROM x""")
def median_impute(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 3, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("quantity"))
    names = ["price", "quantity"]
    return rounded(X.impute_medians(rows, names, K.exact_medians(rows, names), flagged=names))


_SPECIAL_WORDS = ("Magno", "zostera!", "MPB", "Water", "Diatom s", "5", "sand", "4")
_SPECIAL_SQL = [
    ("src", f"""SELECT CASE list_extract({list(_SPECIAL_WORDS)}, l_linenumber + 1) WHEN 'Magno' THEN 'Magnoliopsida' WHEN 'zostera!' THEN 'Magnoliopsida' WHEN '4' THEN 'Magnoliopsida'
      WHEN 'MPB' THEN 'Microphytobenthos' WHEN 'Diatom s' THEN 'Microphytobenthos' WHEN '5' THEN 'Microphytobenthos' END AS "True_Class",
      l_discount * 100 + 0.0 AS "Reflectance_B03", l_tax * 100 + 0.0 AS "Reflectance_B04", CASE WHEN l_quantity > 10 THEN l_quantity END AS "Reflectance_B05", l_quantity AS "Reflectance_B08" FROM lineitem"""),
    ("kept", 'SELECT * FROM src WHERE "True_Class" IS NOT NULL'), *D.features_sql("kept", S.SPECIALIST_BANDS)]


def _special_source(spark, folder):
    words = F.array(*map(F.lit, _SPECIAL_WORDS))
    quantity = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.element_at(words, F.col("l_linenumber") + 1).alias("True_Class"), (F.col("l_discount") * 100 + 0.0).alias("Reflectance_B03"),
        (F.col("l_tax") * 100 + 0.0).alias("Reflectance_B04"), F.when(quantity > 10, quantity).alias("Reflectance_B05"), quantity.alias("Reflectance_B08"))


@query("specialist_training_set", with_ctes(_SPECIAL_SQL, 'SELECT DISTINCT "True_Class", ' + ", ".join(f'round(coalesce("{n}", 0.0), 6) AS "{n}"' for n in S.SPECIALIST_FEATURES) + " FROM feat"))
def specialist_training_set(spark, folder):
    return rounded(specialist_training_table(_special_source(spark, folder)))
