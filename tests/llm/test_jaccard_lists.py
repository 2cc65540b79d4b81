"""The long lists of the Jaccard join: which of their entries meet."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shorepix.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def meetings(spark, monkeypatch):
    """Pairs of entries that the joins of lists read, of all calls since."""
    kind, met = type(spark.range(0)), []
    join = kind.join

    def counted(self, other, on=None, how=None):
        if on == "key" and how is None and "v" in self.columns and "v" in other.columns:
            mine, others = (Counter({r.key: r["count"] for r in side.groupBy("key").count().collect()}) for side in (self, other))
            met.append(sum(n * others[key] for key, n in mine.items()))
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", counted)
    return met


def _sets(texts):
    return [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]


def _holders(sets):
    found = defaultdict(list)
    for k, some in enumerate(sets):
        for shingle in some:
            found[shingle].append(k)
    return found


def _components(texts):
    sets, comp = _sets(texts), list(range(len(texts)))
    shared = Counter((i, j) for some in _holders(sets).values() for i in some for j in some)
    linked = [[i] for i in comp]
    for (i, j), both in shared.items():
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            linked[i].append(j)
    while True:
        now = [min(comp[j] for j in some) for some in linked]
        if now == comp:
            return comp
        comp = now


def _checked(spark, texts):
    comp = _components(texts)
    frame = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS).repartition(4)
    out = {r.doc_id: r.component_id for r in jaccard.similar_documents(frame).collect()}
    assert out == dict(enumerate(comp))
    return Counter(comp)


def _phrases(count):
    """Phrases of one shingle early in the order by hash that the sample leaves out."""
    rng, found = random.Random(1), []
    while len(found) < count:
        phrase = " ".join(f"p{rng.randrange(10 ** 6)}" for _ in range(jaccard.SHINGLE))
        (shingle,) = jaccard.shingle_sets(np.frombuffer(phrase.encode(), np.uint8), np.array([0, len(phrase)]))[0]
        if int(shingle) < 1 << 60 and (int(shingle) >> 16) % jaccard.SAMPLED:
            found.append(phrase)
    return found


def test_a_common_passage_meets_only_the_sets_that_the_sample_missed(spark, meetings):
    rng = random.Random(2)
    phrases = _phrases(12)
    texts = [" ".join([phrases[k % 12], *(f"u{rng.randrange(10 ** 9)}" for _ in range(20 + k % 50))]) for k in range(600)]
    missed = [*phrases, *(f"m{k}" for k in range(4))]  # mostly frequent, of which the sample sees nothing
    texts += [" ".join(missed), " ".join([*missed[:-1], "other"]), " ".join([*missed[:6], *(f"x{k}" for k in range(50))])]
    _checked(spark, texts)
    entries = 12 * 53  # lists of 50 texts and the missed ones
    assert 0 < sum(meetings[jaccard.ROUNDS:]) < 4 * entries


def test_a_group_does_not_meet_itself(spark, meetings):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(150)]

    def edited(edits):
        words = list(base)
        for at in rng.sample(range(150), edits):
            words[at] = f"e{rng.randrange(10 ** 9)}"
        return " ".join(words)

    texts = [edited(2) for _ in range(100)] + [edited(6) for _ in range(20)]
    comp = _checked(spark, texts)
    assert comp.most_common(1)[0][1] >= 90 and len(comp) > 10  # one group, and copies apart from it
    assert 0 < sum(meetings[jaccard.ROUNDS:]) < 20_000  # about 100,000 if all sets of each list meet
