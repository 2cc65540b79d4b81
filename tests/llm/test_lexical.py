"""Ranked lexical search against plain Python."""

import math
import random
import re

import numpy as np

from shorepix.llm import lexical

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, text string, rank string"


def _terms(text):
    return TERM.findall((text or "").translate(SMALL))


def _ranked(docs, items, k):
    words = [(d, _terms(t)) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, w in words:
            m = 100 - 25 + (25 * len(w) * n) // total
            score = 0
            for term in _terms(text):
                if tf := w.count(term):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, rank, d, -score) for rank, (score, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def _tables(seed, docs, items):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Straße", "ÉTÉ", "été", "漢字", "W1", "x_y", "don't"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: "".join(w + rng.choice(" ,\n-") for w in rng.choices(words, weights, k=n))
    rows = [(k, text(rng.randrange(60))) for k in range(docs)]
    rows += [(docs, None), (docs + 1, ""), (docs + 2, " ,;"), (docs + 3, text(4000)), (None, text(30))]
    rows += [(docs + 10 + k, rows[3][1]) for k in range(40)]  # copies, so scores tie
    wanted = [(k, text(rng.randrange(1, 12))) for k in range(items)]
    return rows, [*wanted, (items, rows[3][1]), (items + 1, None), (items + 2, "--"), (items + 3, "nowhere"), (None, "w3 w4")]


def _run(spark, rows, items, k):
    frame = spark.createDataFrame([(d, t, "clash") for d, t in rows], DOCS).repartition(3)
    wanted = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)
    return sorted(map(tuple, lexical.ranked_documents(frame, wanted, k).collect()), key=str)


def test_search_equals_plain_python(spark):
    rows, items = _tables(1, 400, 30)
    assert _run(spark, rows, items, 5) == sorted(_ranked(rows, items, 5), key=str)
    few = rows[:7]
    assert _run(spark, few, items, 20) == sorted(_ranked(few, items, 20), key=str)


def test_small_trees_groups_and_first_search(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TREE_ITEMS", 10)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 90)
    monkeypatch.setattr(lexical, "FIRST", 50)
    rows, items = _tables(2, 200, 25)
    assert _run(spark, rows, items, 3) == sorted(_ranked(rows, items, 3), key=str)
    again = [(5, t) for _, t in items[:4]]  # one id for several items
    assert _run(spark, rows, again, 3) == sorted(_ranked(rows, again, 3), key=str)


def test_empty_tables(spark):
    rows, items = _tables(3, 5, 3)
    assert _run(spark, rows, [], 3) == [] and _run(spark, [], items, 3) == [] and _run(spark, [(1, None), (2, "")], items, 3) == []


def test_whole_batches_are_skipped():
    """Far-apart groups of documents: most pairs are never scored, and the best are found."""
    rng = np.random.default_rng(4)
    docs, terms = 4000, 600
    group = rng.integers(0, 20, docs)
    row = np.repeat(np.arange(docs), 8)
    term = np.sort(group[:, None] * 30 + np.argsort(rng.random((docs, 30)))[:, :8], axis=1).ravel()
    value = rng.integers(1, 1000, len(term))
    wanted = [np.arange(g * 30, g * 30 + 10) for g in range(20)]
    tree = lexical.ItemTree(np.arange(20), wanted, np.ones(terms, np.int64))
    search = lexical.Search([tree], 20, np.zeros(20, np.int64), 3)
    for low, high in ((0, 400), (400, docs)):
        some = slice(8 * low, 8 * high)
        search.add(np.arange(low, high), row[some] - low, term[some], value[some])
    dense = np.zeros((docs, terms), np.int64)
    dense[row, term] = value
    for item, held in enumerate(wanted):
        total = dense[:, held].sum(axis=1)
        order = np.lexsort((np.arange(docs), -total))[:3]
        assert search.best[item][1].tolist() == order.tolist() and search.best[item][0].tolist() == total[order].tolist()
    assert search.pairs == docs * 20 and search.scored < 0.15 * search.pairs
