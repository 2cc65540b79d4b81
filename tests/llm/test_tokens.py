"""Ids and spans of the encoder equal those of the library, for every letter before every mark."""

import itertools
import random
import string
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from shorepix.llm import language, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def _same(library, texts, **options):
    plain = tokens.Encoder(tokens.default_tokenizer(), **options)
    spans = tokens.Encoder(tokens.default_tokenizer(), spans=True, **options)
    want = library.encode_batch(texts, add_special_tokens=False)
    for low in range(0, len(texts), 5000):
        some = texts[low:low + 5000]
        ids, counts, _ = plain.chunk(some)
        again, same, where = spans.chunk(some)
        assert ids.tolist() == again.tolist() and counts.tolist() == same.tolist()
        cuts = np.cumsum(counts)[:-1]
        for text, mine, at, w in zip(some, np.split(ids, cuts), np.split(where, cuts), want[low:low + 5000], strict=True):
            assert mine.tolist() == [*w.ids, tokens.END_ID], repr(text)
            assert [tuple(x) for x in at[:-1].tolist()] == w.offsets, repr(text)


def _split_letters():
    """Letters whose normalized small form ends in something else than a letter."""
    every = [chr(c) for c in range(0x80, sys.maxunicode) if chr(c).isalpha()]
    return [c for c in every if not unicodedata.normalize("NFC", c).lower()[-1].isalpha()]


def test_letters_that_end_in_a_mark(library):
    letters = _split_letters()
    assert {"İ", "क़", "שׁ"} <= set(letters)
    _same(library, [f"{a}{c}{m} b" for c in letters for m in string.punctuation for a in ("", "A")])


def test_all_other_letters(library):
    rng = random.Random(1)
    every = [chr(c) for c in range(0x80, sys.maxunicode) if chr(c).isalpha() and not 0x4E10 < c < 0x9F00 and not 0xAC10 < c < 0xD700]
    some = [c for c in every if ord(c) < 0x3000] + rng.sample(every, 8000)
    _same(library, [f"x{c}{rng.choice(string.punctuation)}{rng.choice(string.punctuation)} {c}. Y{c}" for c in some])


def test_random_strings_and_a_small_memo(library):
    rng = random.Random(2)
    letters = "abAB12'.,!?-<>|  \n\t ́" + "İſKक़שּéßΣςǅ漢한ㄱ" + "😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", " ", "\n\n", "<|endoftext|>", "a<|endoftext|>, B"]
    _same(library, texts)
    _same(library, texts, memo_bytes=20_000)


def test_the_memo_is_bounded_by_its_bytes():
    coder = tokens.Encoder(tokens.default_tokenizer(), memo_bytes=50_000)
    for k in range(30):
        coder.chunk([" ".join(f"w{k}x{j}" for j in range(100)), "often seen words", "y" * 3000 + str(k)])
        assert coder.held < 50_000 + 100 * 400 + 20_000
    assert "often" in coder.memo and len(coder.memo) < 400


class _Counting:
    """The tokenizer, with the number of texts it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_share_calls_and_distinct_pieces_are_looked_up_once():
    coder = tokens.Encoder(tokens.default_tokenizer())
    coder.tokenizer = _Counting(coder.tokenizer)
    words = ["".join(pair) for pair in itertools.product(string.ascii_lowercase, string.ascii_lowercase, "bcdf")]
    looked = []

    class Memo(tokens._Memo):
        def __getitem__(self, piece):
            looked.append(piece)
            return super().__getitem__(piece)

    coder.memo = Memo()
    coder.chunk([" ".join(words)] * 3)
    assert coder.tokenizer.texts <= len(words) // 50 and len(looked) == len(set(looked)) == len(words)


def test_words_that_hold_the_mark_between_words(library):
    some = [f"{a}{tokens.BETWEEN}{b}" for a in ("", "a", "B,", "é") for b in ("", "c", ".", tokens.BETWEEN)]
    _same(library, [" ".join(some + [f"word{k}" for k in range(300)] + some), tokens.BETWEEN, f"a {tokens.BETWEEN}\n{tokens.BETWEEN} b", ""])
    coder = tokens.Encoder(tokens.default_tokenizer())
    coder.between = None  # a tokenizer without an id for the mark
    texts = [" ".join(some), "one Word, two"]
    ids, _, _ = coder.chunk(texts)
    assert ids.tolist() == [i for text in texts for i in [*library.encode(text, add_special_tokens=False).ids, tokens.END_ID]]


def test_a_batch_is_not_turned_into_strings_at_once():
    column = pa.array(["ab"] * 500 + [None] * 500)
    seen = tokens.lazily(column, 100)
    assert next(seen) == "ab" and sum(1 for _ in seen) == 999
    assert [(at, len(run)) for at, run in tokens.chunks(tokens.lazily(column), 600)] == [(0, 300), (300, 700)]
    assert list(tokens.lazily(column.slice(499, 2))) == ["ab", None] and not list(tokens.lazily(column[:0]))


def test_language_sends_a_kept_text_once(spark):
    docs = spark.createDataFrame([(k, text, lang, k) for k, (text, lang) in enumerate([("the cat", "en"), ("le chat", "fr"), (None, "en"), ("", None)] * 40)],
                                 "doc_id long, text string, lang string, n_chars long")
    kept = language.predict(docs, language.fit(docs), docs.columns)
    plan = kept._jdf.queryExecution().toString()
    assert "__text" not in plan and kept.columns == [*docs.columns, "lang_pred", "score"]
    alone = {row.doc_id: row for row in language.predict(docs, language.fit(docs)).collect()}
    rows = kept.collect()
    assert len(rows) == 160 and all((row.lang_pred, row.score) == (alone[row.doc_id].lang_pred, alone[row.doc_id].score) for row in rows)
    assert sorted(map(tuple, kept.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert language.with_language(docs).schema == docs.schema
