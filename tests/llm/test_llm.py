"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import io
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from shorepix.llm import (decontamination, graph, jaccard, language, line_dedup, packing, quality, sharding, token_counts,
                          token_files, tokens, topk)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(60)]


def _text(seed, words, lines=4):
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(words)) for _ in range(lines))


def _rows():
    base = _text(1, 30)
    near = base.replace("w7 ", "q7 ", 1)
    texts = [base, base, near, None, "", "   \n ", "one", "One", _text(2, 2000, 3), "Straße, dür!\n\nA <|endoftext|> b", _text(3, 12), base]
    return [(k, t, None if k % 4 == 0 else ("en" if k % 2 else "de"), "s", None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID], "<u4")


def test_encoder_equals_direct_encoding(direct):
    texts = [r[1] or "" for r in _rows()] + ["Don't STOP... now!! x\ty", "ΟΔΟΣ İ é́", "a.b,c  d", "'s 's. ...'"]
    for spans in (False, True):
        coder = tokens.Encoder(tokens.default_tokenizer(), spans=spans, memo_bytes=20_000)
        for _ in range(3):
            ids, counts, _ = coder.chunk(texts)
            for part, text in zip(np.split(ids, np.cumsum(counts)[:-1]), texts, strict=True):
                assert part.tolist() == direct(text).tolist()


def test_sharding(spark, docs, none):
    out = sharding.shuffle_into_shards(docs.union(docs), 5, 3).toPandas()
    assert sorted(out.doc_id) == sorted([r[0] for r in _rows()] * 2)
    sizes = out.groupby("shard").size().reindex(range(5)).tolist()
    assert sizes == [5, 5, 5, 5, 4]
    assert all(sorted(part) == list(range(len(part))) for _, part in out.groupby("shard").slot)
    assert sharding.shuffle_into_shards(none, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs.withColumnRenamed("source", "Shard"), 3)


def test_communication_matrix_sums(spark):
    blocks = spark.createDataFrame([(k, 3 * k % 11) for k in range(40)], "block long, n long")
    total = sum(3 * k % 11 for k in range(40))
    quotas = [total // 3 + (k < total % 3) for k in range(3)]
    drawn = sharding.communication_matrix(blocks, quotas, 1).toPandas()
    assert np.array(drawn.quota.tolist()).sum(axis=0).tolist() == quotas
    assert all(sum(q) == 3 * b % 11 for b, q in zip(drawn.block, drawn.quota, strict=True))


def test_packing(docs, none, direct):
    out = packing.pack_documents(docs, 50, with_ids=True).toPandas()
    for doc_id, text, *_ in _rows():
        mine = out[out.doc_id == doc_id].sort_values("piece")
        assert b"".join(mine.ids) == direct(text).tobytes() and (mine.length[:-1] == 50).all()
        assert [zlib.crc32(x) for x in mine.ids] == mine.ids_crc32.tolist()
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist() and part.length.sum() <= 50
    assert packing.pack_documents(none, 50).count() == 0


def test_plan_is_close_to_the_bound():
    rng = random.Random(5)
    histogram = pd.Series([min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20000)]).value_counts().to_dict()
    rows, sequences = packing.make_plan(histogram, 4096)
    assert sequences <= 1.005 * sum(n * c for n, c in histogram.items()) / 4096 + 1
    assert pd.Series(rows[:, 2]).groupby(rows[:, 0]).sum().to_dict() == histogram


def test_leaks(spark, none):
    rng = random.Random(9)
    item = [rng.choice(WORDS) for _ in range(30)]
    two = item[5:17]
    two[2], two[9] = "zz", "yy"
    three = item[5:17]
    three[2], three[6], three[9] = "zz", "yy", "xx"
    pad = ["pad%d" % k for k in range(20)]
    texts = [" ".join(pad + two + pad), " ".join(pad + three + pad), " ".join(item).upper() + "!", None, "", " ".join(item[:11]), " ".join(pad)]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "short item")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.best) for r in decontamination.find_leaks(docs, bench).collect()}
    # Three replaced words leave no window with ten equal ones; a shift by one word may still hold ten.
    assert found[(0, 7)][2] == 10 and found[(2, 7)] == (0, 30, 12) and not {k for k, _ in found} & {1, 3, 4, 5, 6}
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, bench).collect()) == [1, 3, 4, 5, 6]
    assert decontamination.find_leaks(none, bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_section_counts(docs, spark, direct):
    out = token_counts.section_token_counts(docs).toPandas()
    for doc_id, text, *_ in _rows():
        mine = out[out.doc_id == doc_id].sort_values("section")
        assert len(mine) == (text or "").count("\n") + 1 and mine.n_tokens.sum() == len(direct(text)) - 1
    # A token over a boundary: most characters decide, a tie goes to the earlier section.
    given = np.array([[0, 4], [4, 7], [8, 10]])
    counts, shared, share = token_counts.attribute(given, np.array([0, 2]), np.array([2, 6]))
    assert counts.tolist() == [1, 1, 1] and shared.tolist() == [1, 1, 0] and np.allclose(share, [0.5, 0.5 + 2 / 3, 1 + 1 / 3])
    fields = token_counts.joined_fields(docs, ["source", "text"]).select("doc_id", "text", "sections")
    sums = token_counts.section_token_counts(fields, "sections").groupBy("name").sum("n_tokens").collect()
    assert {r[0] for r in sums} == {"source", "text"}


def _spans(text):
    """(start, end) of the characters of each token, from the library alone."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer()).encode(text or "", add_special_tokens=False).offsets


def _by_characters(text, sections):
    """(tokens, shared tokens, fractional tokens) of each section and of the text outside, one character at a time."""
    out = [[0, 0, 0.0] for _ in range(len(sections) + 1)]
    for low, high in _spans(text):
        high = max(high, low + 1)
        held = [0] * len(out)
        for at in range(low, high):
            held[next((k for k, (start, end) in enumerate(sections) if start <= at < end), -1)] += 1
        owner = max(range(len(out)), key=lambda k: (held[k], -k))
        out[owner][0] += 1
        out[owner][1] += sum(h > 0 for h in held) > 1
        for k, h in enumerate(held):
            out[k][2] += h / (high - low)
    return out


def _cut_lines(text, longest):
    found, at = [], 0
    for line in (text or "").split("\n"):
        for low in range(0, max(1, len(line)), longest):
            found.append((at + low, at + min(len(line), low + longest)))
        at += len(line) + 1
    return found


@pytest.mark.parametrize("longest", [1, 3, 20])
def test_cut_lines_against_single_characters(spark, longest):
    texts = ["unbelievable circumstances", "", None, "\n\n", "Straße, dür! internationalisation\nshort\n\nécoles 日本語の文 😀😀", "a" * 61 + "\n" + "b " * 30, "x\n"]
    rows = [(k, t, 5, "x") for k, t in enumerate(texts)] + [(0, texts[0], 5, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, section int, name string")
    out = token_counts.section_token_counts(frame, longest=longest).toPandas()
    crossing = 0
    for k, text in enumerate(texts):
        sections = _cut_lines(text, longest)
        want = _by_characters(text, sections)
        mine = out[out.doc_id == k].sort_values("section", key=lambda c: c.where(c >= 0, 10 ** 9), kind="stable")
        times = 2 if k == 0 else 1
        mine = mine.iloc[::times]
        got = list(zip(mine.n_tokens, mine.n_shared, mine.share.round(9), strict=True))
        wanted = [(a, b, round(c, 9)) for a, b, c in want]
        assert got == (wanted if wanted[-1][2] else wanted[:-1])
        assert list(zip(mine.start.dropna().astype(int), mine.end.dropna().astype(int), strict=True)) == sections
        crossing += sum(b for _, b, _ in wanted)
    assert crossing > 2


def test_the_query_of_token_counts_meets_the_rule_and_every_section(spark):
    from shorepix.llm import queries

    folder = "/root/testdata/sf0.001"
    out = queries.QUERIES["op4_section_token_counts"](spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    assert out.n_shared.sum() > 0 and (out.share != out.n_tokens).any()
    mine = {k: part[part.section >= 0].sort_values("section") for k, part in out.groupby("doc_id")}
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        sections = _cut_lines(text, queries.LONGEST_SECTION)
        want = _by_characters(text, sections)[:-1]
        got = mine[doc_id]
        assert list(zip(got.n_tokens, got.n_shared, got.share.round(6), strict=True)) == [(a, b, round(c, 6)) for a, b, c in want]


def test_token_files_roll_over(docs, direct):
    whole = token_files.read_token_files(token_files.write_token_files(docs)).toPandas().sort_values(["start"])
    manifest = token_files.write_token_files(docs, frame_ids=64, file_ids=200)
    files = manifest.orderBy("file_no").toPandas()
    texts = sorted(len(direct(t)) for _, t, *_ in _rows())
    assert len(files) > 4 and files.file_no.is_unique and files.path.is_unique and files.n_docs.sum() == len(_rows())
    assert all(n <= 200 or d == 1 for n, d in zip(files.n_tokens, files.n_docs, strict=True)) and files.n_tokens.max() == texts[-1] > 200
    again = token_files.read_token_files(manifest).toPandas().sort_values(["start"])
    assert all((again[c].to_numpy() == whole[c].to_numpy()).all() for c in ("doc_id", "start", "n_tokens", "ids_crc32"))


def test_token_files_take_repeated_and_null_ids(spark, direct):
    rows = [(3, "b b"), (1, "a"), (3, "c"), (None, "gone"), (2, None), (1, "a")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, path string, start int")
    out = token_files.read_token_files(token_files.write_token_files(frame, file_ids=4)).toPandas().sort_values("start")
    assert out.doc_id.tolist() == [1, 1, 2, 3, 3] and out.start.tolist() == (out.n_tokens.cumsum() - out.n_tokens).tolist()
    assert sorted(map(bytes, out.ids)) == sorted(direct(t).tobytes() for k, t in rows if k is not None)


def test_token_files(docs, none, direct, spark):
    manifest = token_files.write_token_files(docs, frame_ids=64)
    out = token_files.read_token_files(manifest).orderBy("doc_id").toPandas()
    at = 0
    for row, (doc_id, text, *_) in zip(out.itertuples(), _rows(), strict=True):
        ids = direct(text)
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids), row.ids_crc32) == (doc_id, at, len(ids), ids.tobytes(), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.read_token_files(manifest, [2, 8]).count() == 2
    assert token_files.read_token_files(token_files.write_token_files(none)).count() == 0
    stream = io.BytesIO()
    writer = token_files.Writer(stream, 4)
    writer.add(1, np.arange(9, dtype="<u4"))
    writer.close()
    broken = bytearray(stream.getvalue())
    broken[8] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.Reader(io.BytesIO(bytes(broken))).documents())


def test_language(spark, docs, none):
    out = language.identify(docs).toPandas().set_index("doc_id")
    assert (out.lang_pred[[3, 4, 5]] == "und").all() and out.score.between(0, 1).all()
    assert out.held_out.to_dict() == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(12)}
    assert language.identify(none).count() == 0
    rows = [(k, ("the house and the tree " if k % 2 else "das haus und der baum ") * 5, "en" if k % 2 else "de", None, 0) for k in range(60)]
    found = language.identify(spark.createDataFrame(rows, DOCS)).toPandas()
    assert (found.lang_pred == np.where(found.doc_id % 2, "en", "de")).all()
    assert set(language.with_language(docs).columns) == set(docs.columns)


def test_quality(spark, none):
    good = "Some calm words follow each other here.\nAnother line of prose comes next."
    bad = "BUY!! NOW!! BUY!! NOW!!\nwin win win win win win $$$ $$$"
    rows = [(k, (good if k % 3 else bad) + f"\nline {k}.", None, None, 0) for k in range(90)] + [(90, None, None, None, 0), (91, "", None, None, 0)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(90)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(rows, DOCS)
    out = quality.classify(frame, labels).toPandas()
    assert out.score.between(0, 1).all() and len(out) == 92
    held = out[out.held_out & (out.doc_id < 90)]
    assert (held.predicted == (held.doc_id % 3 > 0)).all()
    assert quality.classify(none, labels).count() == 0 and quality.classify(frame, labels.limit(0)).toPandas().score.eq(0.5).all()


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    score, move = rng.normal(size=7), rng.normal(size=(2, 2))
    row = np.array([0, 0, 0, 0, 1, 2, 2])
    good, pairs = quality.Chain(row).marginals(score, move)
    want, both = np.zeros(7), np.zeros((2, 2))
    for doc in range(3):
        at = np.flatnonzero(row == doc)
        weights = {}
        for code in range(2 ** len(at)):
            label = [(code >> k) & 1 for k in range(len(at))]
            weights[tuple(label)] = np.exp(sum(score[i] * y for i, y in zip(at, label, strict=True)) + sum(move[a, b] for a, b in zip(label, label[1:], strict=False)))
        total = sum(weights.values())
        for label, w in weights.items():
            want[at] += np.array(label) * w / total
            for a, b in zip(label, label[1:], strict=False):
                both[a, b] += w / total
    assert np.allclose(good, want) and np.allclose(pairs, both)


def test_line_dedup(spark, none):
    a = "one two three four five six"
    texts = [f"{a}\nunique line here\n\nshort", f"{a}\n\nshort\nshorter", a.replace("four", "4"), a + " seven", a.replace("two ", ""), None, "", "x y", "x z"]
    frame = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS)
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.without_repeated_lines(frame, ["doc_id", "text"]).collect()}
    assert out[0] == (texts[0], 0) and out[1] == ("\nshorter", 2) and out[2] == ("", 1) and out[3] == ("", 1) and out[4] == ("", 1)
    assert out[5] == (None, 0) and out[6] == ("", 0) and out[7] == ("x y", 0) and out[8] == ("x z", 0)
    left = line_dedup.remaining_documents(frame)
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 5, 6, 7, 8] and left.columns == frame.columns
    assert line_dedup.without_repeated_lines(none).count() == 0


def test_line_dedup_against_brute_force(spark):
    """op8 and the pipeline's second stage on random near-copies of lines."""
    import corpus_pipeline

    rng = random.Random(21)
    bases = [[rng.choice(WORDS[:12]) for _ in range(rng.randrange(1, 10))] for _ in range(60)]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = list(rng.choice(bases)) if rng.random() < 0.6 else [rng.choice(WORDS) for _ in range(rng.randrange(8))]
            for _ in range(rng.randrange(3)):
                at, what = rng.randrange(len(words) + 1), rng.randrange(3)
                words[at:at + (what != 1)] = [f"n{rng.randrange(4)}"] if what else []
            lines.append(" ".join(words))
        texts.append("\n".join(lines))

    def near(x, y):
        without = [{(k, *w[:k], *w[k + 1:]) for k in range(len(w))} for w in (x, y)]
        one_less = any(tuple(b) == w[1:] for a, b in ((0, y), (1, x)) for w in without[a])
        return x == y or (min(len(x), len(y)) >= 5 and (one_less or (len(x) == len(y) and bool(without[0] & without[1]))))

    earlier, want = [], {}
    for k, text in enumerate(texts):
        kept = []
        for line in text.split("\n"):
            words = line.split()
            if not words or not any(near(words, other) for other in earlier):
                kept.append(line)
            earlier.append(words)
        want[k] = ("\n".join(kept), text.count("\n") + 1 - len(kept))
    frame = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS)
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.without_repeated_lines(frame, ["doc_id", "text"]).collect()}
    assert out == want and 50 < sum(n for _, n in want.values()) < len(earlier)
    stay = {k: (t, len(t)) for k, (t, _) in want.items() if t.split() or not texts[k].split()}
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines_deduplicated(spark, frame, "").collect()}
    assert left == stay and len(stay) < len(texts)


def test_jaccard_against_brute_force(spark, none):
    rng = random.Random(4)
    texts = [_text(k, 20, 2) for k in range(6)]
    for k in range(60):  # a group of near-copies larger than FREQUENT, with chains of links
        words = texts[k % 3].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += [None, "", "A b", "a  B", texts[0].upper()]
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    comp[i] = min(comp[i], comp[j])
    frame = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(frame).collect()}
    assert out == {k: (len(sets[k]), comp[k]) for k in range(len(texts))}
    assert sorted(r.doc_id for r in jaccard.one_of_each_group(frame).collect()) == sorted(k for k in range(len(texts)) if comp[k] == k)
    assert jaccard.similar_documents(none).count() == 0


def test_all_jaccard_links_against_brute_force(spark, none, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # so that the large group has several blocks
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = random.Random(14)
    texts = [_text(k, 60, 2) for k in range(6)]
    for k in range(60):
        words = texts[k % 3].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
        texts.append(" ".join(words))
    run = [f"c{k}" for k in range(700)]
    texts += [" ".join(run[7 * k:7 * k + 150 + k % 3]) for k in range(70)]  # a chain: each is linked with the next two or so
    texts += [None, "", "A b", "a  B", texts[0].upper()]
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    similar = {x: {y for y in sets if x and y and x != y and 100 * len(x & y) >= 80 * len(x | y)} for x in sets}
    frame = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOCS)
    out = {r.doc_id: r for r in jaccard.linked_documents(frame).collect()}
    plain = {r.doc_id: r for r in jaccard.similar_documents(frame).collect()}
    for k, x in enumerate(sets):
        assert out[k].n_links == len(similar[x]) and out[k].class_id == (sets.index(x) if x else k)
        assert all(out[k][name] == plain[k][name] for name in ("n_shingles", "component_id", "n_copies"))
    members, links = jaccard.all_links(frame)
    of = {r.set_id: sets[r.doc_id] for r in members.collect() if r.set_id is not None}
    found = [frozenset((of[r.a], of[r.b])) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) == {frozenset((x, y)) for x, some in similar.items() for y in some}
    assert len(of) == len(set(sets) - {frozenset()}) and len(found) > 100
    # Components follow from the links.
    comp = {r.v: r.comp for r in graph.components(links).collect()}
    groups = {}
    for r in members.collect():
        groups.setdefault(comp.get(r.set_id, r.set_id if r.set_id is not None else ("none", r.doc_id)), set()).add(plain[r.doc_id].component_id)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({r.component_id for r in plain.values()})
    assert jaccard.linked_documents(none).count() == 0 and jaccard.all_links(none)[1].count() == 0


def test_blocks_of_sets_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "LANE", 3)  # several lanes
    rng = np.random.default_rng(3)
    sets, comps = [], []
    for k in range(150):  # a dense group, a chain, a group around two far centres, a group with a set of another size
        if k < 60:
            own = np.concatenate([np.arange(100), 1000 + rng.integers(0, 50, rng.integers(0, 9))])
        elif k < 120:
            own = 5000 + np.arange(8 * (k - 60), 8 * (k - 60) + 100)
        else:
            own = (9000 if k % 2 else 9500) + rng.choice(120, 110, replace=False)
        sets.append(np.unique(own).astype(np.uint64))
        comps.append(k // 60)
    comps[40] = 2
    rows = [(c, 2 + (c + 9) // 4, v, bytearray(s.tobytes())) for v, (c, s) in enumerate(zip(comps, sets, strict=True))]
    full = spark.createDataFrame(rows, "comp long, blocks int, v long, elements binary")
    dealt = jaccard._blocks(full)
    found = {r.v: r for r in dealt.collect()}
    assert sorted(found) == list(range(150)) and all(found[v].n == len(sets[v]) and found[v].comp == comps[v] for v in found)
    of = {}
    for v, r in found.items():
        of.setdefault((r.comp, r.block), []).append(v)
    pairs = {(r.comp, r.i, r.j): r for r in jaccard._block_pairs(dealt).collect()}
    linked = apart = 0
    for comp, i in of:
        for _, j in (key for key in of if key[0] == comp and key[1] >= i):
            both = [len(np.intersect1d(sets[x], sets[y])) for x in of[comp, i] for y in of[comp, j] if x != y]
            total = [len(sets[x]) + len(sets[y]) for x in of[comp, i] for y in of[comp, j] if x != y]
            links = [100 * b >= 80 * (t - b) for b, t in zip(both, total, strict=True)]
            pair = pairs.get((comp, i, j))
            if pair is None:
                apart += 1
                assert not any(links)
            else:
                assert (pair.c_i, pair.c_j) == (len(of[comp, i]), len(of[comp, j]))
                linked += pair.linked
                assert all(links) or not pair.linked
    assert linked > 10 and apart > 30


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 10), (8, 7)], "a long, b long")
    assert {r.v: r.comp for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 9: 7, 8: 7, 7: 7, 5: 5}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(k, [float(np.float32(x)) for x in rng.normal(size=6)]) for k in range(200)]
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, []), (204, vectors[3][1]), (None, vectors[4][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    out = topk.top_k(frame, frame.filter("vec_id % 50 = 0"), 5, block=64, pivots=8).toPandas()
    usable = {k: np.floor(256 * np.array(v, np.float32).astype(float)) for k, v in vectors if k is not None and v and None not in v and not np.isnan(v).any()}
    for q in (0, 50, 100, 150):
        want = sorted(((-int(usable[q] @ v), k) for k, v in usable.items() if k != q))[:5]
        mine = out[out.query_id == q].sort_values("rank")
        assert list(zip((-mine.score).tolist(), mine.vec_id.tolist(), strict=True)) == want
    assert set(out.query_id) == {0, 50, 100, 150} and topk.top_k(frame.limit(0), frame, 5).count() == 0


def test_pivots_skip_inner_products():
    rng = np.random.default_rng(8)

    def share(vectors, pivots, queries=50):
        ids, floors = np.arange(len(vectors)), np.full(queries, -np.inf)
        chosen = topk.choose_pivots(vectors[:500], pivots)
        rows, taken = topk.block_top_k(ids[:queries], vectors[:queries], floors, ids, vectors, topk.distance_table(vectors, chosen), chosen, 5)
        products = vectors[:queries] @ vectors.T
        for q in range(queries):
            want = sorted((-int(s), i) for i, s in enumerate(products[q]) if i != q)[:5]
            assert [(-s, i) for query_id, i, s in rows if query_id == q] == want
        return taken / (queries * len(vectors))

    spread = np.floor(rng.normal(size=(4000, 32)) * 100)  # no structure: only many pivots help
    assert share(spread, 24) < 0.5 and share(spread, 0) > 0.8
    lying = np.floor(rng.normal(size=(4000, 4)) @ rng.normal(size=(4, 32)) * 100)  # a plane of four dimensions, but for rounding
    assert share(lying, 6) < 0.1
    assert share(np.repeat(lying[:1], 300, axis=0), 6) <= 1 and share(np.zeros((60, 3)), 4) <= 1  # equal and zero vectors: ties by id


def test_bounds_hold_for_all_pairs():
    rng = np.random.default_rng(9)
    vectors = np.floor(rng.normal(size=(200, 12)) * 50)
    chosen = topk.choose_pivots(vectors, 7)
    table = topk.distance_table(vectors, chosen)
    inside, outside = topk.inside_and_outside(table, chosen)
    upper = inside @ inside.T + np.outer(outside, outside)
    assert (upper >= vectors @ vectors.T - 1e-6).all()
    square = (vectors ** 2).sum(1)
    lower = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * upper, 0))
    plain = np.abs(table[:, None] - table[None]).max(axis=2)  # the bound of single pivots
    assert (lower >= plain - 1e-3).all() and lower.mean() > 1.5 * plain.mean()


def test_top_k_over_blocks_widths_repeats_and_large_values(spark):
    rng = np.random.default_rng(12)
    rows = [(k, [float(np.floor(x)) for x in rng.normal(size=8) * 9]) for k in range(300)]
    rows += [(k, rows[k - 300][1]) for k in range(300, 340)]  # equal vectors of other ids
    rows += [(7, rows[9][1]), (50, rows[3][1])]  # repeated ids with other vectors
    rows += [(k, [1.0, float(k)]) for k in range(400, 404)]  # another length, fewer than k others
    for times in (1.0, 2.0 ** 22):  # beyond doubles Python integers decide
        given = [(k, [x * times for x in v], "x", None) for k, v in rows]
        frame = spark.createDataFrame(given, "vec_id long, embedding array<double>, score string, width int")
        out = topk.top_k(frame, frame.filter("vec_id % 50 = 0"), 5, scale=1.0, block=40, query_block=2, pivots=5).toPandas()
        for q in sorted({k for k, _ in rows if k % 50 == 0}):
            mine = min(v for k, v in rows if k == q)
            want = sorted((-int(sum(int(a * times) * int(b * times) for a, b in zip(mine, v, strict=True))), k) for k, v in rows if k != q and len(v) == len(mine))[:5]
            got = out[out.query_id == q].sort_values("rank")
            assert list(zip((-got.score).tolist(), got.vec_id.tolist(), strict=True)) == want and got["rank"].tolist() == list(range(1, len(want) + 1))


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, folder)
        assert after.columns == frame.columns, name
        frame = corpus_pipeline.staged(after)
    assert corpus_pipeline.run(spark, folder).count() >= frame.count()


def test_pipeline_hands_over_small_batches(spark):
    """Texts of 16 MB reach the workers in pieces; a session that asks for less keeps it."""
    import corpus_pipeline

    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    frame = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 800) as text", "'en' as lang", "'s' as source", "4000L as n_chars")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        for name, stage in corpus_pipeline.STAGES:
            if name in ("language ID", "line dedup"):  # theirs are computed when they are written
                spark.conf.set(names[0], "64m")
                spark.conf.set(names[1], "4096")
                stage(spark, frame, "")
                found = [r.n for r in frame.select("text").mapInArrow(sizes, "n long").collect()]
                assert sum(found) > 16_000_000 and max(found) < 2 * corpus_pipeline.BATCH_BYTES, name
                assert spark.conf.get(names[1]) == str(corpus_pipeline.READ_ROWS)
        spark.conf.set(names[0], "1m")
        spark.conf.set(names[1], "100")
        corpus_pipeline.identified(spark, frame, "")
        assert [spark.conf.get(name) for name in names] == ["1m", "100"]
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
