"""Removal of lines that repeat an earlier line, exactly or with one word changed, by a deletion-neighbourhood join.

Two lines are within one word edit if they are equal, if one is the other without a word, or if both are equal without
the word at the same position. So each line emits the hash of its words and, for every position, the hash of the others:
equal keys are the whole candidate search, and grouping them by (key, position) finds for each line the earliest line it
repeats without pairing up the lines of a group.

Only lines that can have such a neighbour emit variants: within one edit of each other, two lines share the words of one
half (the first or the last floor((L - 1) / 2) words, L the longer length). Half keys are four per line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorepix.llm.store import size_checked, staged
from shorepix.llm.tokens import lean
from shorepix.llm.words import line_spans, mixed, span_hashes, text_slices, word_spans

#: Shorter lines (in words) are compared exactly: one word of four is too much.
LEAST_WORDS = 5
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)
EXACT = -1


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 2, _STEP, np.uint64), np.full(n + 2, _BACK, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class LineWords:
    """The words of all lines of some texts, and hashes of any run of them or of a line without one word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.start, self.end, self.row = line_spans(data, bounds)
        word_start, word_end, _ = word_spans(data, bounds)
        hashes = span_hashes(data, word_start, word_end) if len(word_start) else np.zeros(0, np.uint64)
        line = np.searchsorted(self.start, word_start, "right") - 1
        # Empty lines share their start with nothing, but an empty text shares it with the next one's first line.
        self.count = np.bincount(line, minlength=len(self.start)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.up, self.down = _tables(int(self.count.max(initial=0)))
        place = np.arange(len(hashes)) - self.first[line] if len(hashes) else np.zeros(0, np.int64)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[place], out=self.total[1:])

    def run(self, line: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of words low .. high - 1 of each line, wherever in the line they stand."""
        at = self.first[line]
        return (self.total[at + high] - self.total[at + low]) * self.down[low]

    def whole(self, line: np.ndarray) -> np.ndarray:
        n = self.count[line]
        return mixed(self.run(line, np.zeros_like(n), n) + n.astype(np.uint64))

    def without(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        n = self.count[line]
        rest = self.run(line, np.zeros_like(n), place) + self.run(line, place + 1, n) * self.up[place]
        return mixed(rest + (n - 1).astype(np.uint64))

    def halves(self, line: np.ndarray) -> list[np.ndarray]:
        """Keys of the first and the last words that a neighbour of at most n, or of n + 1 words would share."""
        n = self.count[line]
        keys = []
        for longer in (n, n + 1):
            h = (longer - 1) // 2
            for side, low in enumerate((np.zeros_like(n), n - h)):
                keys.append(mixed(mixed(self.run(line, low, low + h)) + (2 * longer + side).astype(np.uint64)))
        return keys


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


@lean
def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at, data, bounds in text_slices(batch.column(1)):
            words = LineWords(data, bounds)
            line = np.flatnonzero(words.count)
            number = np.arange(len(words.row)) - np.searchsorted(words.row, words.row)
            mask = words.count[line] < LEAST_WORDS
            halves = [pa.array(k.view(np.int64), mask=mask) for k in words.halves(line)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at + words.row[line]]), pa.array(number[line].astype(np.int32)), _signed(words.whole(line)), *halves],
                names=["doc_id", "line", "whole", "k0", "k1", "k2", "k3"])


@lean
def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at, data, bounds in text_slices(batch.column(1)):
            words = LineWords(data, bounds)
            line = np.flatnonzero(words.count >= LEAST_WORDS)
            number = np.arange(len(words.row)) - np.searchsorted(words.row, words.row)
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(words.start[line].tolist(), words.end[line].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at + words.row[line]]), pa.array(number[line].astype(np.int32)),
                                              pa.array(texts, pa.string())], names=["doc_id", "line", "line_text"])


@lean
def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, bounds in text_slices(batch.column(0)):
            some = batch.slice(at, len(bounds) - 1)
            words = LineWords(data, bounds)
            every = np.arange(len(words.count))
            line = np.repeat(every, words.count)
            place = np.arange(len(line)) - np.repeat(words.first, words.count)
            key = np.concatenate([words.whole(every), words.without(line, place)])
            owner = np.concatenate([every, line])
            columns = [_signed(key), pa.array(np.concatenate([np.full(len(every), EXACT), place]).astype(np.int32))]
            columns += [some.column(k).take(pa.array(owner)) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "whole", "doc_id", "line"])


def within_one_edit(a: str, b: str) -> bool:
    """Whether two lines differ by at most one inserted, deleted or replaced word; words are split at ASCII white space."""
    x, y = ([w for w in _split(t) if w] for t in (a, b))
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    k = 0
    while k < len(x) and x[k] == y[k]:
        k += 1
    return x[k + (len(x) == len(y)):] == y[k + 1:]


def _split(text: str) -> list[str]:
    for mark in "\t\n\v\f\r":
        text = text.replace(mark, " ")
    return text.split(" ")


@lean
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [within_one_edit(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], names=["whole"])


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line): the lines to remove, numbered from 0 within their document.

    Lines come in the order (doc_id, line number). A line goes if an earlier line has the same words, or, where both have
    at least LEAST_WORDS words, words within one edit of its own; that earlier line counts whether it stays or goes.
    Words are separated by ASCII white space and compared as they are. Lines without words never go. Rows that share a
    doc_id count as one document seen twice (their lines do not remove each other); rows with a null doc_id are left as
    they are.
    """
    texts = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = staged(texts.mapInArrow(_line_keys, "doc_id long, line int, whole long, k0 long, k1 long, k2 long, k3 long"))
    halves = ["k0", "k1", "k2", "k3"]
    distinct = staged(lines.groupBy("whole").agg(F.min(F.struct("doc_id", "line")).alias("at"), *[F.min(k).alias(k) for k in halves]))
    keys = distinct.filter(F.col("k0").isNotNull()).select("whole", F.explode(F.array(*halves)).alias("half"))
    shared = keys.groupBy("half").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).filter("low <> high").select("half")
    candidates = staged(keys.join(shared, "half", "left_semi").select("whole").distinct()
                        .join(distinct.select("whole", "at"), "whole").select("whole", "at.*"))
    # Texts of the candidates, each from its first occurrence.
    owners = size_checked(staged(candidates.select("doc_id").distinct()))
    wanted = (texts.join(owners, "doc_id", "left_semi").mapInArrow(_line_texts, "doc_id long, line int, line_text string")
              .join(size_checked(candidates), ["doc_id", "line"]).dropDuplicates(["whole"]))
    wanted = staged(wanted.select("line_text", "whole", "doc_id", "line"))
    variants = wanted.mapInArrow(_variants, "key long, place int, whole long, doc_id long, line int").withColumn("at", F.struct("doc_id", "line"))
    exact = F.col("place") == EXACT
    met = (variants.groupBy("key").agg(F.min(F.when(exact, F.col("at"))).alias("exact_at"), F.min(F.when(~exact, F.col("at"))).alias("cut_at"), F.min("whole").alias("low"), F.max("whole").alias("high"))
           .filter("low <> high").drop("low", "high"))
    meeting = staged(variants.join(met, "key").select("key", "place", "whole", "at", "exact_at", "cut_at"))
    same_place = meeting.filter(~exact).groupBy("key", "place").agg(F.min("at").alias("same_at"))
    # The earliest neighbour at each key: for a whole line the lines that lose a word to become it; for a line without
    # the word at a place, the line that is left, and the lines that differ from it at this place.
    found = meeting.join(same_place, ["key", "place"], "left").select("whole", "at", F.when(exact, F.col("cut_at")).otherwise(F.least("exact_at", "same_at")).alias("earlier"))
    earlier = found.filter(F.col("earlier") < F.col("at")).groupBy("whole").agg(F.min("earlier").alias("earlier"))
    other = wanted.select(F.struct("doc_id", "line").alias("earlier"), F.col("line_text").alias("other"))
    near = (earlier.join(other, "earlier").join(wanted.select("whole", "line_text"), "whole").select("whole", "line_text", "other")
            .mapInArrow(_verified, "whole long").withColumn("near", F.lit(True)))
    decided = distinct.select("whole", "at").join(near, "whole", "left")
    return (lines.select("doc_id", "line", "whole").join(decided, "whole")
            .filter(F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "line") != F.col("at")))
            .select("doc_id", "line").distinct())


def _rebuilt(columns: list[str], text_at: int, into: tuple[str, str]):
    @lean
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                yield part(batch)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, drops = batch.column(text_at).to_pylist(), batch.column(len(columns)).to_pylist()
        out, counts, gone = [], [], []
        for text, drop in zip(texts, drops, strict=True):
            lines = (text or "").split("\n")
            drop = set(drop or ())
            out.append(text if not drop else "\n".join(line for k, line in enumerate(lines) if k not in drop))
            counts.append(len(lines))
            gone.append(len(drop))
        arrays = [batch.column(k) if k != text_at else pa.array(out, pa.string()) for k in range(len(columns))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int32()), pa.array(gone, pa.int32())],
                                         names=[*columns, *into])

    return rebuild


def without_repeated_lines(documents: DataFrame, keep: list[str] | None = None,
                           into: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The columns ``keep`` (default: all) of every document, its text without the lines of :func:`repeated_lines`, plus
    the numbers of its lines and of those dropped, named ``into`` (they take the place of columns of these names). Texts
    without such lines are unchanged; null stays null, repeated rows stay repeated. An empty table stays empty."""
    columns = [c for c in keep or documents.columns if c.lower() not in into]
    drop = staged(repeated_lines(documents))
    pairs = drop.count()
    lists = drop.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list("line").alias("__lines"))
    # A pair is some ten bytes: lists of at most 2,000,000 pairs are sent to every executor, more are joined by a shuffle.
    lists = F.broadcast(lists) if pairs <= 2_000_000 else lists
    joined = (documents.select(*[F.col(f"`{c}`") for c in columns], F.col("doc_id").cast("long").alias("__id"))
              .join(lists, F.col("__id") == F.col("__doc"), "left").select(*[F.col(f"`{c}`") for c in columns], "__lines"))
    schema = joined.drop("__lines").schema.add(into[0], "integer").add(into[1], "integer")
    return joined.mapInArrow(_rebuilt(columns, columns.index("text"), into), schema)


def remaining_documents(documents: DataFrame) -> DataFrame:
    """The documents, all columns, with texts without repeated lines; a document that had words and has none left goes.

    Null and empty texts stay, and so do columns of any other name."""
    columns = documents.columns
    left = without_repeated_lines(documents, into=("__n_lines", "__n_dropped"))
    return left.filter((F.col("__n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in columns])
