import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from shorepix import schema as S
from shorepix.operators import labels as L
from shorepix.operators import metrics as E
from shorepix.plans.validate import evaluate, resolve_validation_mode


def folded(text):
    marks = unicodedata.normalize("NFKD", text.strip().lower())
    return "".join(c for c in marks if c.isalnum() and not unicodedata.combining(c))


def expected_concept(text):
    """The cascade in plain Python, for comparison."""
    try:
        number = int(float(text)) if text.strip().replace("+", "").replace("-", "").replace(".0", "").isdigit() else None
    except ValueError:
        number = None
    if number in S.CLASS_NUMBER_CONCEPT:
        return S.CLASS_NUMBER_CONCEPT[number]
    word = folded(text)
    if not word:
        return None
    if word in L.SPELLINGS:
        return L.SPELLINGS[word]
    for concept, _, aliases in S.CONCEPTS:
        if any(len(folded(a)) >= 5 and (folded(a) in word or word in folded(a)) for a in aliases):
            return concept
    close = difflib.get_close_matches(word, list(L.SPELLINGS), n=1, cutoff=0.78)
    return L.SPELLINGS[close[0]] if close else None


WORDS = ["4", "4.0", " +8 ", "11", "-1", "Zostéra", "ZOSTERA marina", "sea grass", "o", "mb", "mpbx", "Magnoliopsidaa", "phaeophycea", "watr", "wter", "rodho",
         "unknwn", "sndy", "baresedimnt", "h2o", "", "  ", "!!", "diatoms;", "florideophycae", "xyz", "algae", "brwn", "vauhc", "nodta", "Äther"]


def mutated(seed, n=300):
    rng, words = random.Random(seed), list(L.SPELLINGS)
    out = []
    for _ in range(n):
        text = list(rng.choice(words))
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(text) + 1)
            rng.choice([lambda: text.insert(i, rng.choice("aeiorstz")), lambda: text.pop(min(i, len(text) - 1)) if len(text) > 1 else None])()
        out.append("".join(text))
    return out


def test_concepts_agree_with_plain_python(spark):
    words = list(dict.fromkeys(WORDS + mutated(1)))
    frame = spark.createDataFrame([(w,) for w in words], "label string")
    got = {row["label"]: row["concept"] for row in L.with_concepts(frame).collect()}
    assert got == {word: expected_concept(word) for word in words}


def test_no_sql_compared_label_needs_the_similarity_stage(spark):
    from workload import derive, labels

    folder = "/root/testdata/sf0.001"
    for frame in (labels.raw_labels(spark, folder).select("label"), spark.createDataFrame([(w,) for w in labels._PRED_WORDS], "label string")):
        rows = L.with_concepts(frame.distinct()).withColumn("sure", F.coalesce(
            L.concept_by_number(F.col("label")), L.concept_by_spelling(F.col("folded")), L.concept_by_part(F.col("folded"))))
        assert rows.where("concept IS NOT NULL AND sure IS NULL").count() == 0
    assert derive.VOCABULARY


def test_close_labels_find_every_partner(spark):
    rng = random.Random(5)
    known = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(120)})
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(120)} - set(known))
    got = {row["folded"]: row["closest"] for row in L.closest_labels(
        spark.createDataFrame([(w,) for w in words], "folded string"), spark.createDataFrame([(w,) for w in known], "folded string")).collect()}
    expected = {w: m[0] for w in words if (m := difflib.get_close_matches(w, known, 1, 0.86))}
    assert got == expected and len(got) > 5


def test_label_mapping(spark):
    rows = [(3, "Seagrass"), (1, "zostera"), (2, "Brand 17"), (5, None), (6, " kelp forest "), (7, "20")]
    space = L.label_space(spark.createDataFrame(rows, "row_id bigint, label string"), "label", "row_id")
    assert {row["label"] for row in space.collect()} == {"Seagrass", "zostera", "Brand 17", "<MISSING>", "kelp forest", "20"}
    raw = ["4", "brand17", "brand 177", "kelp forests", "8", "31", "other thing", "", "20.0"]
    got = {row["label"]: row["mapped"] for row in L.map_labels(spark.createDataFrame([(r,) for r in raw], "label string"), space).collect()}
    assert got == {"4": "zostera", "brand17": "Brand 17", "brand 177": "Brand 17", "kelp forests": "kelp forest", "8": "Water", "31": "Class_31",
                   "other thing": "Unknown", "": "<MISSING>", "20.0": "Class_20"}


def test_specialist_labels(spark):
    rows = spark.createDataFrame([("Magno",), ("5",), ("Water",)], "l string")
    assert [row[0] for row in rows.select(L.specialist_label(F.col("l"))).collect()] == ["Magnoliopsida", "Microphytobenthos", None]
    assert [row[0] for row in rows.where("l <> 'Water'").select(L.specialist_class(F.col("l"))).collect()] == [4, 5]
    with pytest.raises(Exception, match="unsupported label"):
        rows.select(L.specialist_class(F.col("l"))).collect()


def labelled(spark):
    rows = [("Sand", "Sand"), ("Sand", "Water"), ("Water", "Water"), (None, "Sand"), ("Vauch", "Rhodophyta"), ("Water", None)]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "row_id bigint, t string, p string")


def test_metrics(spark):
    counts = E.confusion(labelled(spark), "t", "p")
    table = [tuple(row) for row in E.metrics_table(counts, ["Water", "Sand"]).collect()]
    assert table == [("OVERALL", pytest.approx(2 / 6), None, None, 6, 6), ("Water", None, 0.5, 0.5, 2, 2), ("Sand", None, 0.5, 0.5, 2, 2), ("Vauch", None, None, 0.0, 1, 0)]
    matrix = [tuple(row) for row in E.confusion_matrix(counts, ["Sand", "Water", "Vauch", "Absent"]).collect()]
    assert matrix == [("Sand", 1, 1, 0, 0), ("Water", 0, 1, 0, 0), ("Vauch", 0, 0, 0, 0), ("Absent", 0, 0, 0, 0)]
    assert E.outside_predictions(counts).first()[0] == 2


def test_presence_absence(spark):
    result = evaluate(labelled(spark), "t", "p", ["Sand", "Water", "Rhodophyta"], mode="Presence-Absence", target="2")
    assert result.classes == ["Absence", "Presence"]
    assert [tuple(row) for row in result.matrix.collect()] == [("Absence", 3, 1), ("Presence", 1, 1)]
    assert result.metrics.collect()[0]["Overall_Accuracy"] == pytest.approx(4 / 6)
    frame = spark.createDataFrame([("Magnoliopsida", "Magnoliopsida", 0.3), ("Magnoliopsida", "Sand", 0.3), ("Magnoliopsida", "Sand", 0.2), ("Sand", "Magnoliopsida", None)], "t string, p string, ndvi double")
    both = frame.select(*[E.presence_with_ndvi(F.col(c), F.col("ndvi")).alias(c) for c in ("t", "p")])
    scores = E.presence_scores(both, "t", "p").first()
    assert (scores["TP"], scores["TN"], scores["FP"], scores["FN"], scores["F1"], scores["Accuracy"]) == (1, 1, 1, 1, 0.5, 50.0)
    nothing = E.presence_scores(both.where("t = 'Absence' AND p = 'Absence'"), "t", "p").first()
    assert nothing["Precision"] is None and nothing["F1"] is None


def test_presence_absence_without_presence(spark):
    rows = spark.createDataFrame([(0, "Sand", "Sand"), (1, "Sand", "Magnoliopsida"), (2, "Water", None)], "row_id bigint, t string, p string")
    result = evaluate(rows, "t", "p", ["Sand", "Water", "Magnoliopsida"], mode="binary")
    assert result.outside.first()[0] == 0
    assert {r["Class"]: (r["Support_True"], r["Support_Pred"], r["Producer_Accuracy_Recall"]) for r in result.metrics.collect()} == {
        "OVERALL": (3, 3, None), "Absence": (3, 2, pytest.approx(2 / 3)), "Presence": (0, 1, None)}


def test_evaluate_multiclass_order(spark):
    result = evaluate(labelled(spark), "t", "p", ["Rhodophyta", "Water", "Sand"])
    assert result.classes == ["Sand", "Water", "Vauch"]
    assert [row["Class"] for row in result.metrics.collect()] == ["OVERALL", "Water", "Sand", "Vauch"]
    assert result.outside.first()[0] == 2
    assert set(result.predictions.columns) == {"row_id", "t", "p", "Predicted_Class"}
    assert resolve_validation_mode("as-is") == "multiclass" and resolve_validation_mode("PVA") == "presence_absence"
    with pytest.raises(ValueError):
        resolve_validation_mode("ternary")


def test_class_weights_and_vocabulary(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("a",)], "l string")
    weights = {row["l"]: row["weight"] for row in E.class_weights(rows.where("l IS NOT NULL"), "l").collect()}
    assert weights == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}
    assert [(row["label"], row["code"]) for row in E.vocabulary(rows, "l").orderBy("code").collect()] == [("a", 0), ("b", 1)]
