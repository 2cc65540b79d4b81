"""Exact ranked lexical search: a dual-tree search over trees of items and of documents.

Terms are maximal runs of ASCII letters, digits and all other characters beyond ASCII, only A-Z made small. A document's
score for an item is the sum over the item's terms, repeats included, of an integer that depends on the term's weight, its
occurrences in the document and the document's length (``Weights``).

1. Items are read in groups of bounded size. One pass over the whole texts keeps, of each document, its number of terms
   and the occurrences of the group's terms; these rows are written. Counts over all of them give the weights.
2. Each task builds trees over its documents, a few thousand at a time: leaves are documents, a node has up to FAN
   children, and it holds of each term the largest value found below it. The tree over items is alike. Both are built over
   an order that puts similar rows next to each other.
3. Trees are descended together. For a pair of nodes the sum of the products of their largest values is no smaller than
   the score of any pair of rows below, so if it stays below the weakest k-th best score of the items, all these pairs are
   skipped. Pairs of leaves give scores.
4. A first search over about FIRST documents gives every item a k-th best score to start from, wherever its documents are.
   Any documents will do for that; the second search reads all of them.

Every task returns at most k documents per item, with scores that are not below the start. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shorepix.llm.store import shared_folder, staged
from shorepix.llm.tokens import lean
from shorepix.llm.words import LOWER, span_hashes, text_slices, word_spans

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
FAN, LEVELS = 8, 4
#: Documents, and entries of documents, in one tree; it has one level more than that of the items.
TREE_DOCS, TREE_ENTRIES = FAN ** LEVELS, 1 << 20
#: Items in one tree; terms of all items of a group, about (a longer item is a group of its own).
TREE_ITEMS, GROUP_TERMS = 1024, 2_000_000
FIRST = 20_000


def term_rows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term."""
    start, end, row = word_spans(data, bounds, SEPARATOR)
    return (span_hashes(data, start, end, LOWER) if len(start) else np.zeros(0, np.uint64)), row


def _lists(row: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``values`` as one list per row; ``row`` is ascending."""
    ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


@lean
def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, bounds in text_slices(batch.column(1)):
            rows = len(bounds) - 1
            found, row = term_rows(data, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), _lists(row, rows, found.view(np.int64), pa.int64())], names=["item_id", "terms"])


def _item_groups(items: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """(item_id, hashes of its terms) of all items with a term, in lists of bounded size; the driver holds one list."""
    vectors = staged(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
                     .mapInArrow(_item_terms, "item_id long, terms array<long>").filter("size(terms) > 0"))
    group, held = [], 0
    for row in vectors.toLocalIterator():
        if group and held + len(row.terms) > GROUP_TERMS:
            yield group
            group, held = [], 0
        group.append((row.item_id, np.array(row.terms, np.int64).view(np.uint64)))
        held += len(row.terms)
    if group:
        yield group


def _vectors(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), term (places in ``vocabulary``, ascending) and tf of every document with a term."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at, data, bounds in text_slices(batch.column(1)):
                rows = len(bounds) - 1
                found, row = term_rows(data, bounds)
                place = np.searchsorted(known, found)
                meant = known[np.minimum(place, len(known) - 1)] == found
                cell, tf = np.unique(row[meant] * len(known) + place[meant], return_counts=True)
                out = pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, rows), pa.array(np.bincount(row, minlength=rows), pa.int64()),
                    _lists(cell // len(known), rows, cell % len(known), pa.int32()),
                    _lists(cell // len(known), rows, tf, pa.int64())], names=["doc_id", "n", "term", "tf"])
                yield out.filter(pc.greater(out.column(1), 0))

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>"))


class Weights:
    """The integers of a score: documents with a term, all their terms, and the documents that hold each term."""

    def __init__(self, documents: int, terms: int, holding: np.ndarray):
        self.documents, self.terms = documents, max(terms, 1)
        self.term = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)

    def values(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What one occurrence of ``term`` in an item adds to the score of a document of ``n`` terms that holds it ``tf`` times."""
        m = 100 - 25 + (25 * n * self.documents) // self.terms
        return self.term[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Level:
    """Rows, or nodes over rows, of sparse term values: node k holds entries start[k]:start[k + 1], terms ascending."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, nodes: int):
        self.term, self.value, self.nodes = term, value, nodes
        self.start = np.searchsorted(node, np.arange(nodes + 1))

    def above(self, terms: int) -> Level:
        """Nodes over FAN of these each, with the largest value of each term."""
        node = np.repeat(np.arange(self.nodes), np.diff(self.start)) // FAN
        key = node * terms + self.term
        order = np.argsort(key, kind="stable")
        key, nodes = key[order], -(-self.nodes // FAN)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        value = np.maximum.reduceat(self.value[order], first) if len(first) else self.value[:0]
        return Level(key[first] // terms, key[first] % terms, value, nodes)

    def products(self, nodes: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """For each of ``nodes`` the sum of its values times those of the dense ``vector``."""
        count = self.start[nodes + 1] - self.start[nodes]
        ends = np.cumsum(count)
        at = np.repeat(self.start[nodes] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(self.value[at] * vector[self.term[at]], out=total[1:])
        return total[ends] - total[ends - count]


def _levels(level: Level, terms: int, above: int) -> list[Level]:
    levels = [level]
    for _ in range(above):
        levels.append(levels[-1].above(terms))
    return levels


def _picked(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new row of each entry, its place) when ``rows`` are put one after the other."""
    count = start[rows + 1] - start[rows]
    ends = np.cumsum(count)
    return np.repeat(np.arange(len(rows)), count), np.repeat(start[rows] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class ItemTree:
    """A tree over at most TREE_ITEMS items; ``number``: places of the items in their group, in the order of the leaves."""

    def __init__(self, numbers: np.ndarray, terms: list[np.ndarray], weight: np.ndarray):
        every = np.concatenate(terms)
        self.terms, local = np.unique(every, return_inverse=True)  # places of this tree's terms in the vocabulary, ascending
        row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        cell, times = np.unique(row * len(self.terms) + local, return_counts=True)
        rows = Level(cell // len(self.terms), cell % len(self.terms), times.astype(np.int64), len(terms))
        order = self._order(rows, weight[self.terms])
        node, place = _picked(rows.start, order)
        self.number = numbers[order]
        self.levels = _levels(Level(node, rows.term[place], rows.value[place], len(terms)), len(self.terms), LEVELS - 1)

    @staticmethod
    def _order(rows: Level, weight: np.ndarray) -> np.ndarray:
        """Each item is followed by the one most similar to it that is left: the most weight of shared terms."""
        every = np.arange(rows.nodes)
        left, order, now = np.ones(rows.nodes, bool), [], 0
        for _ in every:
            order.append(now)
            left[now] = False
            if not left.any():
                break
            mine = np.zeros(len(weight), np.int64)
            held = rows.term[rows.start[now]:rows.start[now + 1]]
            mine[held] = weight[held] + 1
            now = int(np.where(left, Level.products(rows, every, mine), -1).argmax())
        return np.array(order)


class Search:
    """The k best documents of every item of a group among those that have been added."""

    def __init__(self, trees: list[ItemTree], items: int, start: np.ndarray, k: int):
        self.trees, self.k, self.start = trees, k, start
        self.weakest = np.maximum(start, 1)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items
        #: Pairs of an item and a document in all, and those whose score was computed.
        self.pairs = self.scored = 0

    def add(self, doc_id: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Documents with their entries: ``row`` ascending, places of terms in the vocabulary, values."""
        for tree in self.trees:
            self.pairs += len(doc_id) * len(tree.number)
            place = np.searchsorted(tree.terms, term)
            meant = tree.terms[np.minimum(place, len(tree.terms) - 1)] == term
            if not meant.any():
                continue
            docs = Level(row[meant], place[meant], value[meant], len(doc_id))
            # Next to each other: documents that suit the same items, those with more for them first.
            each = np.arange(len(doc_id))
            suits = np.stack([docs.products(each, self._vector(tree, 1, i)) for i in range(tree.levels[1].nodes)])
            order = np.lexsort((-suits.max(axis=0), suits.argmax(axis=0)))
            order = order[suits.max(axis=0)[order] > 0]
            node, place = _picked(docs.start, order)
            levels = _levels(Level(node, docs.term[place], docs.value[place], len(order)), len(tree.terms), LEVELS)
            ids = doc_id[order]
            for i in range(tree.levels[-1].nodes):
                self._descend(tree, levels, ids, LEVELS - 1, i, np.arange(levels[-1].nodes))

    @staticmethod
    def _vector(tree: ItemTree, at: int, node: int) -> np.ndarray:
        level, vector = tree.levels[at], np.zeros(len(tree.terms), np.int64)
        some = slice(level.start[node], level.start[node + 1])
        vector[level.term[some]] = level.value[some]
        return vector

    def _descend(self, tree: ItemTree, levels: list[Level], ids: np.ndarray, at: int, item: int, nodes: np.ndarray) -> None:
        """Node ``item`` of level ``at`` against the document nodes ``nodes`` of the level above."""
        below, vector = tree.number[item * FAN ** at:(item + 1) * FAN ** at], self._vector(tree, at, item)
        nodes = nodes[levels[at + 1].products(nodes, vector) >= self.weakest[below].min()]
        if not len(nodes):
            return
        nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        nodes = nodes[nodes < levels[at].nodes]
        if at:
            for child in range(item * FAN, min((item + 1) * FAN, tree.levels[at - 1].nodes)):
                self._descend(tree, levels, ids, at - 1, child, nodes)
        else:
            self.scored += len(nodes)
            self._offer(int(below[0]), levels[0].products(nodes, vector), ids[nodes])

    def _offer(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        enough = score >= self.weakest[item]
        if enough.any():
            score, ids = (np.concatenate(x) for x in zip(self.best[item], (score[enough], ids[enough]), strict=True))
            order = np.lexsort((ids, -score))[:self.k]
            self.best[item] = score[order], ids[order]
            if len(order) == self.k:
                self.weakest[item] = max(self.weakest[item], score[order[-1]])


def _searched(vectors: DataFrame, shared, k: int) -> DataFrame:
    """item (place in its group), doc_id, score: at most ``k`` documents per task and item."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, trees, items, start = shared.value
        found = Search(trees, items, start, k)
        for batch in batches:
            n, ids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())])
            term, tf = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            low = 0
            while low < len(n):
                high = min(max(low + 1, int(np.searchsorted(ends, ends[low] + TREE_ENTRIES, "right")) - 1), low + TREE_DOCS, len(n))
                some = slice(ends[low], ends[high])
                row = np.repeat(np.arange(high - low), np.diff(ends[low:high + 1]))
                found.add(ids[low:high], row, term[some], weights.values(term[some].astype(np.int64), tf[some], n[low:high][row]))
                low = high
        sizes = [len(score) for score, _ in found.best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(items), sizes), pa.int32()), pa.array(np.concatenate([ids for _, ids in found.best])),
                                              pa.array(np.concatenate([score for score, _ in found.best]))], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(lean(search), "item int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item, with their rank; first within 64 parts of each item, so that no task gets all."""
    order = [F.desc("score"), "doc_id"]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", part).orderBy(*order))).filter(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def ranked_documents(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``k`` best documents with a score above 0.

    Equal scores go by ascending doc_id. Null and empty texts, and texts without a term, hold nothing and count nowhere.
    Documents with a null doc_id count in the weights but are not returned; those that share a doc_id are ranked one by
    one. Every row of ``items`` is an item of its own, whatever its id; one without a term gives no row. Other columns
    are ignored, an empty table on either side gives no row.
    """
    spark = documents.sparkSession
    folder, schema = shared_folder(spark), "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    for group in _item_groups(items):
        _search_group(documents, group, k).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _search_group(documents: DataFrame, group: list[tuple[int | None, np.ndarray]], k: int) -> DataFrame:
    spark = documents.sparkSession
    vocabulary = np.unique(np.concatenate([terms for _, terms in group]))
    vectors = staged(_vectors(documents, vocabulary))
    texts, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(vocabulary), np.int64)
    held = vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    holding[held.column(0).to_numpy()] = held.column(1).to_numpy()
    weights = Weights(texts, total, holding)
    places = [np.searchsorted(vocabulary, terms) for _, terms in group]
    trees = [ItemTree(np.arange(low, min(low + TREE_ITEMS, len(group))), places[low:low + TREE_ITEMS], weights.term)
             for low in range(0, len(group), TREE_ITEMS)]
    named = vectors.filter("doc_id is not null and size(term) > 0")

    def search(docs: DataFrame, start: np.ndarray) -> DataFrame:
        return _best(_searched(docs, spark.sparkContext.broadcast((weights, trees, len(group), start)), k), k)

    start = np.zeros(len(group), np.int64)
    some = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, texts // FIRST))) == 0)
    for row in search(some, start).filter(F.col("rank") == k).select("item", "score").collect():
        start[row.item] = row.score
    ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(group)), pa.int32()), "item_id": pa.array([i for i, _ in group], pa.int64())}))
    return search(named, start).join(ids, "item").select("item_id", "rank", "doc_id", "score")
