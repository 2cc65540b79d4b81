"""Fill-in-the-middle examples against plain Python on decoded texts."""

import hashlib
import random

import numpy as np
import pytest

from shorepix.llm import fill_middle

DOCS = "doc_id long, text string, form string, n string"


def _plain(doc_id, text, seed=1):
    text = text or ""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def _texts():
    rng = random.Random(3)
    letters = "ab \n<PSM>éßжक़漢😀́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]
    return texts + [None, "", "<P>", "x<M>y", "<<<>>>", "é", "😀" * 9, "a" * 8, "漢" * 300_000, "ab😀" * 400_000, "<" * 50, ">" * 50]


def test_rank_and_select():
    text = "aé漢😀" * 50
    data = np.frombuffer(text.encode(), np.uint8)
    marks = fill_middle.CodePoints(data)
    ends = np.cumsum([len(c.encode()) for c in text])
    assert marks.select(np.arange(1, len(text) + 1)).tolist() == ends.tolist()
    assert marks.rank(np.arange(len(data) + 1)).tolist() == [int((ends <= k).sum()) for k in range(len(data) + 1)]


@pytest.mark.parametrize("seed", [1, 7])
def test_transform_equals_plain_python(spark, seed):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(_texts())] + [(None, "no id here", None, None), (5, "same id", None, None), (5, "same id", None, None)]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    made = fill_middle.transform(frame, seed)
    out = made.withColumn("back", fill_middle.restored(made.form, made.output)).collect()
    want = sorted((str(d), t or "", *map(str, _plain(d, t, seed))) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.back, str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_shares_and_empty_table(spark):
    frame = spark.createDataFrame([(k, f"text {k}", None, None) for k in range(400)], DOCS)
    assert {r.form for r in fill_middle.transform(frame, plain_percent=100).collect()} == {"plain"}
    assert {r.form for r in fill_middle.transform(frame, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert fill_middle.transform(frame.limit(0)).count() == 0
