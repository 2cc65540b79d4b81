"""Language of whole texts by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shorepix.llm.store import fresh
from shorepix.llm.tokens import lazily, lean
from shorepix.llm.words import mixed

GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
#: Labelled documents per language that the counts are taken from, about; chosen by a hash of the doc_id.
SAMPLE = 2_000
MOST_LANGUAGES = 1_000
UNKNOWN = "und"
CHUNK_CHARS = 50_000
#: Rows that go back to Spark at once.
OUT_ROWS = 1_000


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, its small form if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if chr(code).isalpha():
            small = chr(code).lower()
            table[code] = ord(small) if len(small) == 1 else code
    return table


def gram_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, text of each n-gram, whether each text has a letter).

    Texts are reduced to small letters with one space between words, and one before and after.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[codes]
    text = np.repeat(np.arange(len(texts)), lengths)
    is_letter = codes != 32
    has_letter = np.bincount(text[is_letter], minlength=len(texts)) > 0
    # Keep letters, and the spaces that follow a letter of the same text.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (text[1:] == text[:-1])
    codes, text = codes[keep], text[keep]
    # A space in front of each text, and one behind it if the text ends in a letter.
    front = np.flatnonzero(np.diff(text, prepend=-1)) if len(text) else np.zeros(0, np.int64)
    codes, text = np.insert(codes, front, 32), np.insert(text, front, text[front])
    back = np.flatnonzero((np.diff(text, append=-1) != 0) & (codes != 32)) + 1 if len(text) else front
    codes, text = np.insert(codes, back, 32), np.insert(text, back, text[back - 1] if len(text) else text)
    rows, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        last = len(codes) - n + 1
        h = np.full(last, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k:k + last]
        inside = text[:last] == text[n - 1:]
        if n == 1:
            inside = codes != 32
        rows.append((mixed(h[inside]) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(text[:last][inside])
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64),
            np.concatenate(owners) if owners else np.zeros(0, np.int64), has_letter)


def _runs(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
    at, run, chars = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text or "")
        chars += len(run[-1])
        if chars >= CHUNK_CHARS or len(run) >= 5_000:
            yield at, run
            at, run, chars = i + 1, [], 0
    if run:
        yield at, run


class Model:
    """log P(bucket | language) and log P(language)."""

    def __init__(self, languages: list[str], documents: np.ndarray, counts: np.ndarray, smoothing: float = 0.5):
        self.languages = np.array(languages, object)
        self.prior = np.log(documents / documents.sum())
        counts = counts + smoothing
        self.table = np.log(counts / counts.sum(axis=1, keepdims=True))  # languages x buckets

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability; UNKNOWN with 0 for texts without a letter."""
        rows, owner, has_letter = gram_rows(texts)
        if not len(self.languages):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums = np.stack([np.bincount(owner, weights=column[rows], minlength=len(texts)) for column in self.table], axis=1).astype(float)
        sums += self.prior
        best = sums.argmax(axis=1)
        score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        score[~has_letter] = 0.0
        names = self.languages[best]
        names[~has_letter] = UNKNOWN
        return names.tolist(), score


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of the documents that are not held out.

    Language shares come from all of them; n-gram counts from about ``sample`` documents per language (all, if fewer).
    Null languages and null texts are left out. The driver sees languages x buckets counts at most. More than
    MOST_LANGUAGES languages raise. Without any labelled document every prediction is UNKNOWN.
    """
    learned = documents.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = sorted((row.lang, row.n) for row in learned.groupBy("lang").agg(F.count("*").alias("n")).take(MOST_LANGUAGES + 1))
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [lang for lang, _ in shares]
    counts = np.zeros((len(languages), BUCKETS))
    if not languages:
        return Model([], np.zeros(0), counts)
    share = F.create_map(*[F.lit(x) for lang, n in shares for x in (lang, min(1.0, sample / n))])
    chosen = learned.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            kinds = np.array([languages.index(lang) for lang in batch.column(0).to_pylist()], np.int64)
            for at, texts in _runs(lazily(batch.column(1))):
                rows, owner, _ = gram_rows(texts)
                flat = kinds[at:at + len(texts)][owner] * BUCKETS + rows
                seen += np.bincount(flat, minlength=seen.size).reshape(seen.shape)
        where = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(seen.ravel()[where])], names=["cell", "n"])

    cells = (chosen.select("lang", "text").mapInArrow(count, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    counts.ravel()[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return Model(languages, np.array([n for _, n in shares], float), counts)


def predict(documents: DataFrame, model: Model, keep: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id (or the columns ``keep``) plus lang_pred and score (0 to 1), named ``into``, of every document.

    Only the text is looked at, all of it. A null text, or one without any letter, gets UNKNOWN with score 0. Repeated
    rows get equal rows; other columns are dropped unless kept, and names in ``into`` must not be among those kept.
    """
    keep = keep or ["doc_id"]
    fresh(documents.select(*[F.col(f"`{name}`") for name in keep]), *into)
    kept = documents.select(*[F.col(f"`{name}`") for name in keep])
    shared = documents.sparkSession.sparkContext.broadcast(model)
    # A text that is kept goes to the workers once, not beside a copy of itself.
    held = [k for k, field in enumerate(kept.schema.fields) if field.name == "text" and field.dataType == T.StringType()]
    at = held[0] if held else len(keep)
    sent = kept if held else documents.select(*[F.col(f"`{name}`") for name in keep], F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*kept.schema.fields]).add(into[0], "string").add(into[1], "double")

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(low, OUT_ROWS)
                names, scores = [], []
                for _, texts in _runs(lazily(batch.column(at))):
                    some, values = shared.value.predict(texts)
                    names += some
                    scores.append(values)
                columns = [batch.column(k) for k in range(len(keep))]
                columns += [pa.array(names, pa.string()), pa.array(np.concatenate(scores))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *into])

    return sent.mapInArrow(score, schema)


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of the documents that are not held out."""
    found = predict(documents, fit(documents, sample))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_language(documents: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents, all columns, whose language is identified: rejected are texts without a letter, and those for which
    no language reaches the probability ``least``.

    Null and empty texts go, repeated rows stay as often as they come, and columns of any other name are kept as they are
    (also ones named as those of :func:`predict`)."""
    columns, (name, score) = documents.columns, ("__lang_pred", "__lang_score")
    found = predict(documents, fit(documents, sample), columns, (name, score))
    return found.filter((F.col(name) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in columns])
