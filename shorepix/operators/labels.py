"""Label text to concepts and to the label names of a validation table.

All work runs on distinct labels; the result goes back to the rows by a broadcast join when
the label table is small and by a salted join otherwise.
"""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import names as N
from ..functions.staging import pinned
from .lookup import attach, local_if_small

# Similarity limits and the shortest spelling that may match partially.
CONCEPT_SIMILARITY, LABEL_SIMILARITY, PARTIAL_LENGTH = 0.78, 0.86, 5


def _spelling(text: str) -> str:
    return "".join(letter for letter in text.lower() if letter.isalnum())


SPELLINGS = {_spelling(alias): concept for concept, _, aliases in S.CONCEPTS for alias in aliases}
DISPLAY = {concept: title for concept, title, _ in S.CONCEPTS}


@F.pandas_udf(T.StringType())
def fold_label(labels: pd.Series) -> pd.Series:
    """Lower case, accents folded, letters and digits only."""
    def fold(text):
        if text is None:
            return None
        marks = unicodedata.normalize("NFKD", text.strip().lower())
        return "".join(c for c in marks if c.isalnum() and not unicodedata.combining(c))

    return labels.map(fold)


def normalise_label(label: Column) -> Column:
    """Folded label; plain ASCII text stays in the JVM."""
    return F.when(label.rlike(r"^[\x00-\x7F]*$"), N.plain_label(label)).otherwise(fold_label(label))


@F.pandas_udf(T.StringType())
def closest_concept(labels: pd.Series) -> pd.Series:
    """Concept of the most similar spelling from 0.78 up.

    The similarity can never exceed twice the number of shared letters over the total
    length. Numpy computes that bound for the whole batch, and only pairs that reach the
    limit are compared in full.
    """
    known = list(SPELLINGS)
    letters = sorted(set("".join(known)))
    # Twice the shorter length bounds the similarity too, so longer texts cannot match.
    longest = int(max(map(len, known)) * (2 / CONCEPT_SIMILARITY - 1)) + 1
    texts = labels.fillna("")
    place = np.flatnonzero(texts.str.len().between(1, longest).to_numpy())
    best: list[tuple[float, str]] = [(0.0, "")] * len(labels)
    if len(place):
        words = texts.iloc[place].to_numpy(dtype=object).astype(str)
        lengths = np.char.str_len(words)
        own = np.stack([np.char.count(words, letter) for letter in letters], axis=1)
        for spelling in known:
            shared = np.minimum(own, [spelling.count(letter) for letter in letters]).sum(axis=1)
            for i in np.flatnonzero(2.0 * shared >= CONCEPT_SIMILARITY * (lengths + len(spelling))):
                ratio = difflib.SequenceMatcher(None, spelling, words[i]).ratio()
                if ratio >= CONCEPT_SIMILARITY:
                    best[place[i]] = max(best[place[i]], (ratio, spelling))
    return pd.Series([SPELLINGS.get(spelling) for _, spelling in best], dtype=object)


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """difflib ratio with ``left`` as the candidate and ``right`` as the searched word."""
    matcher = difflib.SequenceMatcher()

    def ratio(candidate: str, word: str) -> float:
        matcher.set_seq2(word)
        matcher.set_seq1(candidate)
        return matcher.ratio()

    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def concept_by_number(label: Column) -> Column:
    return F.try_element_at(_literal_map(S.CLASS_NUMBER_CONCEPT), N.integer_label(label).try_cast("int"))


def concept_by_spelling(folded: Column) -> Column:
    return F.try_element_at(_literal_map(SPELLINGS), folded)


def concept_by_part(folded: Column) -> Column:
    """First concept, in declared order, one of whose long spellings contains or is contained in the label."""
    choices = [
        F.when(F.contains(folded, F.lit(spelling)) | F.contains(F.lit(spelling), folded), F.lit(concept))
        for spelling, concept in SPELLINGS.items() if len(spelling) >= PARTIAL_LENGTH
    ]
    return F.when(folded != "", F.coalesce(*choices))


def with_concepts(labels: DataFrame, label: str = "label") -> DataFrame:
    """Add ``folded`` and ``concept`` to a table of distinct labels.

    Number, exact spelling, partial spelling, then similar spelling. Python only sees what
    the first three stages leave over.
    """
    folded = pinned(labels, {"folded": normalise_label(F.col(label))})
    sure = pinned(folded, {"__sure": F.coalesce(
        concept_by_number(F.col(label)), concept_by_spelling(F.col("folded")), concept_by_part(F.col("folded")))})
    near = closest_concept(F.when(F.col("__sure").isNull() & (F.col("folded") != ""), F.col("folded")))
    return sure.withColumn("concept", F.coalesce("__sure", near)).drop("__sure")


def label_concepts(df: DataFrame, label: str) -> DataFrame:
    """(label, folded, concept) for the distinct labels of ``df``."""
    return with_concepts(df.select(F.col(label).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct())


def attach_concepts(df: DataFrame, label: str) -> DataFrame:
    """Add ``concept`` to every row."""
    concepts = label_concepts(df, label).select(F.col("label").alias(label), "concept")
    return attach(df.withColumn(label, F.col(label).cast("string")), concepts, [label])


def label_space(df: DataFrame, label: str, position: str) -> DataFrame:
    """Distinct labels with their first position; a missing label counts as ``<MISSING>``."""
    text = F.trim(F.coalesce(F.col(label).cast("string"), F.lit(S.MISSING_LABEL)))
    return (
        df.select(text.alias("label"), F.col(position).alias("first_position"))
        .where(F.col("label") != "")
        .groupBy("label").agg(F.min("first_position").alias("first_position"))
    )


def _grams(text: Column) -> Column:
    """Three-letter runs, and two-letter runs as well for texts of up to five letters."""
    def runs(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (width - 1))
        return F.when(F.length(text) >= width, F.transform(starts, lambda i: F.substring(text, i, F.lit(width)))
                      ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.when(F.length(text) <= 5, F.concat(runs(3), runs(2))).otherwise(runs(3)))


def closest_labels(words: DataFrame, known: DataFrame) -> DataFrame:
    """(folded, closest): the most similar ``known.folded`` from 0.86 up, the larger text on ties.

    Of the T characters of both texts at most 14 % are unmatched, and u unmatched characters
    cut the common part into at most u + 1 runs. For T above 10 one run then has three
    characters or more; for 4 against 5 characters it has two. Candidates therefore meet by
    an equi-join on such runs instead of all pairs.
    """
    left = words.select("folded", F.explode(_grams(F.col("folded"))).alias("gram"))
    right = known.select(F.col("folded").alias("candidate"), F.explode(_grams(F.col("folded"))).alias("gram"))
    short, long = F.least(F.length("folded"), F.length("candidate")), F.greatest(F.length("folded"), F.length("candidate"))
    similar_length = short * 2 >= (short + long) * LABEL_SIMILARITY
    pairs = left.join(right, "gram").where(similar_length).select("folded", "candidate").distinct()
    scored = pairs.withColumn("ratio", similarity(F.col("candidate"), F.col("folded")))
    return (
        scored.where(F.col("ratio") >= LABEL_SIMILARITY)
        .groupBy("folded").agg(F.max_by("candidate", F.struct("ratio", "candidate")).alias("closest"))
    )


def map_labels(labels: DataFrame, space: DataFrame) -> DataFrame:
    """(label, concept, mapped) for distinct ``labels`` against a :func:`label_space` table.

    A concept takes the first dataset label of that concept, else its display name. Labels
    without concept take the dataset label of equal folded text, then a similar one, then
    ``Class_<n>`` for numbers, then themselves. NULL and blank labels are ``<MISSING>``.
    """
    text = F.trim(F.coalesce(F.col("label"), F.lit(S.MISSING_LABEL)))
    # Label tables are small as a rule: then every step below runs on local rows.
    known, _ = local_if_small(with_concepts(space))
    source, _ = local_if_small(with_concepts(labels.select("label", text.alias("__text")), "__text"))
    by_concept = known.where(F.col("concept").isNotNull()).groupBy("concept").agg(
        F.min_by("label", "first_position").alias("concept_label"))
    by_text = known.where(F.col("folded") != "").groupBy("folded").agg(
        F.min_by("label", "first_position").alias("text_label"))
    exact = source.join(by_concept, "concept", "left").join(by_text, "folded", "left")
    open_words = exact.where(F.col("concept").isNull() & F.col("text_label").isNull() & (F.col("folded") != ""))
    rest, _ = local_if_small(open_words.select("folded").distinct())
    if rest.isEmpty():
        exact = exact.withColumn("near_label", F.lit(None).cast("string"))
    else:
        near = closest_labels(rest, by_text.select("folded")).join(
            by_text.select(F.col("folded").alias("closest"), F.col("text_label").alias("near_label")), "closest").drop("closest")
        exact = exact.join(near, "folded", "left")
    number = N.integer_label(F.col("__text"))
    by_display = F.try_element_at(_literal_map(DISPLAY), F.col("concept"))
    mapped = (
        F.when(F.col("__text") == "", S.MISSING_LABEL)
        .when(F.col("concept").isNotNull(), F.coalesce("concept_label", by_display))
        .otherwise(F.coalesce(F.col("text_label"), F.col("near_label"),
                              F.concat(F.lit("Class_"), number.cast("string")), F.col("__text")))
    )
    return exact.select("label", "concept", mapped.alias("mapped"))


def attach_mapped(df: DataFrame, label: str, space: DataFrame, target: str) -> DataFrame:
    """Add ``target``: the label of every row in the names of the validation table."""
    key = F.coalesce(F.col(label).cast("string"), F.lit(S.MISSING_LABEL))
    keyed = df.withColumn("__label", key)
    mapping = map_labels(keyed.select(F.col("__label").alias("label")).distinct(), space)
    return attach(keyed, mapping.select(F.col("label").alias("__label"), F.col("mapped").alias(target)), ["__label"]).drop("__label")


def specialist_label(label: Column) -> Column:
    """One of the two specialist labels, or NULL."""
    words = {word: target for target, _, spellings in S.SPECIALIST_TARGETS for word in spellings}
    return F.try_element_at(_literal_map(words), N.plain_label(label))


def specialist_class(label: Column) -> Column:
    """Output class id of a specialist label; any other label is an error."""
    ids = {target: class_id for target, class_id, _ in S.SPECIALIST_TARGETS}
    known = F.try_element_at(_literal_map(ids), specialist_label(label))
    return F.coalesce(known, F.raise_error(F.concat(
        F.lit("The specialist model predicted an unsupported label: "), F.coalesce(label, F.lit("NULL")))).cast("int"))
