"""Token ids of whole texts by the tokenizers library, with a memo of words.

A tokenizer that never lets a token reach over a space or a line feed (``word_bpe_49k`` is one: it drops white space
before it splits) gives a text the ids of its space-separated pieces, one after the other. Pieces repeat, so a run of
texts is reduced to its distinct pieces and each worker keeps the pieces it has seen; only new ones go through the library. Other tokenizers take ``by_word=False``
and encode every text in one call.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Memory that a worker's memo may take, about, before it forgets the pieces it has seen least.
MEMO_BYTES = 256 << 20
#: What a remembered piece takes beside its characters and ids: string, dictionary entry, row.
PIECE_BYTES = 200
#: New words that the library encodes in one call, where it holds about a kilobyte for each, and that share an encoding.
BATCH_WORDS, GROUP_WORDS = 4_000, 100
#: Stands between them; a word that holds it is still encoded right.
BETWEEN = "\x01"
#: Characters handled at once.
CHUNK_CHARS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII punctuation that a tokenizer may set off from the letter before it.
_MARKS = string.punctuation.replace("'", "")


def _strings(array: pa.Array) -> list[str]:
    """``to_pylist`` of strings without nulls, several times as fast."""
    return array.to_numpy(zero_copy_only=False).tolist()


class _Memo(dict):
    """Piece -> row; unknown pieces get the next row and wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        row = self[piece] = len(self) + 1
        self.new.append(piece)
        return row


class _Ragged:
    """Rows of ids (and spans) of different lengths in flat arrays that grow."""

    def __init__(self):
        self.rows = self.used = 0
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.span = np.zeros(4096, np.uint32), np.zeros((4096, 2), np.int32)

    @staticmethod
    def room(array: np.ndarray, rows: int) -> np.ndarray:
        if rows <= len(array):
            return array
        bigger = np.zeros((max(rows, len(array) + len(array) // 2), *array.shape[1:]), array.dtype)
        bigger[:len(array)] = array
        return bigger

    def put(self, rows: np.ndarray, count: np.ndarray, ids: np.ndarray, span: np.ndarray | None) -> None:
        """Set new ``rows``, in any order."""
        most, used = max(self.rows, int(rows.max(initial=-1)) + 1), self.used + len(ids)
        self.first, self.count, self.ids = self.room(self.first, most), self.room(self.count, most), self.room(self.ids, used)
        self.first[rows] = self.used + np.cumsum(count) - count
        self.count[rows] = count
        self.ids[self.used:used] = ids
        if span is not None:
            self.span = self.room(self.span, used)
            self.span[self.used:used] = span
        self.rows, self.used = most, used

    def take(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the flat arrays, ids per row) of these rows, one after the other."""
        count = self.count[row].astype(np.int64)
        ends = np.cumsum(count)
        return np.repeat(self.first[row] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0), count


class Encoder:
    """Ids, and with ``spans`` the character span of each id, of whole texts.

    A new piece is taken apart once more: capital ASCII letters are made small (the tokenizer does that too) and the
    punctuation after its last letter is set off where the tokenizer sets it off itself, so that only new words reach the
    library; words are pieces of the same memo. Pieces with ``<|``, where a special token may start, stay as they are.
    """

    def __init__(self, path: str, by_word: bool = True, spans: bool = False, memo_bytes: int = MEMO_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word, self.spans, self.memo_bytes = by_word, spans, memo_bytes
        self.set_off: dict[str, bool] = {}
        mark = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = mark[0] if len(mark) == 1 else None
        self._reset()

    def _reset(self) -> None:
        self.memo, self.table, self.seen, self.held = _Memo(), _Ragged(), np.zeros(1024, np.int64), 0
        self.table.put(np.zeros(1, np.int64), np.ones(1, np.int64), np.array([END_ID]), np.zeros((1, 2), np.int32) if self.spans else None)

    def _forget(self) -> None:
        """Keep the pieces seen most often, up to half of the bytes."""
        rows = np.arange(1, len(self.memo) + 1)
        size = np.fromiter(map(len, self.memo), np.int64, len(self.memo)) + 4 * self.table.count[rows] + PIECE_BYTES
        order = np.argsort(-self.seen[rows], kind="stable")
        keep = np.zeros(len(rows), bool)
        keep[order[np.cumsum(size[order]) <= self.memo_bytes // 2]] = True
        pieces = [piece for piece, kept in zip(self.memo, keep.tolist(), strict=True) if kept]
        take, count = self.table.take(rows[keep])
        ids, span = self.table.ids[take], self.table.span[take] if self.spans else None
        self._reset()
        if pieces:
            self.table.put(np.arange(1, len(pieces) + 1), count, ids, span)
        self.memo.update(zip(pieces, range(1, len(pieces) + 1), strict=True))
        self.held = int(size[keep].sum())

    def _sets_off(self, word: str) -> bool:
        """Whether the tokenizer starts a new word at punctuation behind the last character of ``word``. Some letters end in
        a mark once they are normalized, and a mark shares its word with punctuation."""
        last = word[-1]
        known = self.set_off.get(last)
        if known is None:
            known = last.isalpha()
            if known and not last.isascii():
                plain = self.tokenizer.normalizer.normalize_str(f"a{last}!") if self.tokenizer.normalizer else f"a{last}!"
                known = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)[-1][1][0] == len(plain) - 1
            self.set_off[last] = known
        return known

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids per word, ids of all words, spans or None). Without spans GROUP_WORDS words share a call's text, with a mark
        between them that stands for one id; a group in which a word gives that id as well is encoded word by word."""
        if self.spans or self.between is None:
            encode = self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast
            found = encode(words, add_special_tokens=False)
            span = np.array([s for x in found for s in x.offsets], np.int32).reshape(-1, 2) if self.spans else None
            return np.fromiter((len(x.ids) for x in found), np.int64, len(found)), np.array([i for x in found for i in x.ids], np.uint32), span
        groups = [words[k:k + GROUP_WORDS] for k in range(0, len(words), GROUP_WORDS)]
        counts, ids = [], []
        for group, x in zip(groups, self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(group) for group in groups], add_special_tokens=False), strict=True):
            own = np.array(x.ids, np.uint32)
            cuts = np.flatnonzero(own == self.between)
            if len(cuts) == len(group) - 1:
                counts.append(np.diff(cuts, prepend=-1, append=len(own)) - 1)
                ids.append(np.delete(own, cuts))
            else:
                alone = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                counts.append(np.fromiter(map(len, alone), np.int64, len(alone)))
                ids.append(np.array([i for word in alone for i in word], np.uint32))
        return np.concatenate(counts), np.concatenate(ids), None

    def _learn(self) -> None:
        memo, base = self.memo, len(self.memo) - len(self.memo.new) + 1
        pieces = pa.array(memo.new, pa.large_string())
        # Words without the punctuation behind them, and with small letters, if the tokenizer sees them the same way.
        marked = pc.match_substring(pieces, "<|")
        words = pc.utf8_rtrim(pieces, characters=_MARKS)
        last = pc.utf8_slice_codeunits(words, -1).dictionary_encode()
        off = np.array([bool(x) and self._sets_off(x) for x in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        words = pc.if_else(pc.and_not(pa.array(off), marked), words, pieces)
        small = pc.if_else(pc.and_not(pc.string_is_ascii(words), marked), pc.ascii_lower(words), words)
        split = pc.not_equal(small, pieces).to_numpy(zero_copy_only=False)
        width = pc.utf8_length(words).to_numpy()[split]
        look = memo.__getitem__
        parts = np.zeros((len(width), 2), np.int64)
        parts[:, 0] = np.fromiter(map(look, _strings(small.filter(pa.array(split)))), np.int64, len(width))
        ends = [piece[n:] for piece, n in zip(_strings(pieces.filter(pa.array(split))), width.tolist(), strict=True)]
        parts[:, 1] = np.fromiter(map(look, ends), np.int64, len(width))
        # What the pieces are made of are whole words: small, and punctuation alone.
        whole = [piece for piece, cut in zip(memo.new, split.tolist(), strict=False) if not cut] + memo.new[len(split):]
        whole_row = np.concatenate([base + np.flatnonzero(~split), np.arange(base + len(split), len(memo) + 1)])
        for low in range(0, len(whole), BATCH_WORDS):
            self.table.put(whole_row[low:low + BATCH_WORDS], *self._encoded(whole[low:low + BATCH_WORDS]))
        if len(parts):
            take, count = self.table.take(parts.ravel())
            span = None
            if self.spans:
                shift = np.zeros(parts.size, np.int32)
                shift[1::2] = width
                span = self.table.span[take] + np.repeat(shift, count)[:, None]
            self.table.put(base + np.flatnonzero(split), count[::2] + count[1::2], self.table.ids[take], span)
        self.held += sum(map(len, memo.new)) + PIECE_BYTES * len(memo.new) + 4 * int(self.table.count[base:self.table.rows].sum())
        memo.new = []

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids with an end id after each text, ids per text, spans or None). An end id's span is empty, at the end."""
        if not self.by_word:
            return self._whole(texts)
        if self.held > self.memo_bytes:
            self._forget()
        lines = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        pieces = lines.flatten().dictionary_encode()
        distinct, place = pieces.dictionary, pieces.indices.to_numpy()
        row = np.fromiter(map(self.memo.__getitem__, _strings(distinct)), np.int64, len(distinct))[place]
        if self.memo.new:
            self._learn()
        sizes = pc.list_value_length(lines).to_numpy().astype(np.int64) + 1
        ends = np.cumsum(sizes) - 1
        inside = np.ones(len(place) + len(texts), bool)
        inside[ends] = False
        rows = np.zeros(len(inside), np.int64)
        rows[inside] = row
        self.seen = _Ragged.room(self.seen, self.table.rows)
        met = np.bincount(rows)
        self.seen[:len(met)] += met
        take, count = self.table.take(rows)
        per_text = np.diff(np.cumsum(count)[ends], prepend=0)
        spans = None
        if self.spans:
            width = np.zeros(len(inside), np.int64)
            width[inside] = pc.utf8_length(distinct).to_numpy()[place] + 1
            begin = np.cumsum(width) - width
            begin -= np.repeat(begin[ends - sizes + 1], sizes)
            begin[ends] -= 1  # no space stands behind the last piece
            spans = self.table.span[take] + np.repeat(begin, count)[:, None]
        return self.table.ids[take], per_text, spans

    def _whole(self, texts: list[str]):
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        per_text = np.array([len(x.ids) + 1 for x in found], np.int64)
        ids = np.fromiter((i for x in found for i in (*x.ids, END_ID)), np.uint32, int(per_text.sum()))
        spans = None
        if self.spans:
            spans = np.array([s for x, t in zip(found, texts, strict=True) for s in (*x.offsets, (len(t), len(t)))], np.int64).reshape(-1, 2)
        return ids, per_text, spans


@functools.lru_cache(maxsize=1)
def encoder(path: str, by_word: bool = True, spans: bool = False, memo_bytes: int = MEMO_BYTES) -> Encoder:
    """One encoder per worker process, kept from task to task."""
    coder = Encoder(path, by_word, spans, memo_bytes)
    trim()  # what reading the tokenizer's file took
    return coder


def trim() -> None:
    """Give memory that earlier tasks of this worker process have freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Let go of the encoders of this worker process; other operators whose tasks it takes over need the memory."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
    trim()


def trimmed(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``kernel`` for a worker process that gives freed memory back before and after: an idle worker counts against its
    executor like a busy one."""
    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch], *options) -> Iterator[pa.RecordBatch]:
        trim()
        try:
            yield from kernel(batches, *options)
        finally:
            trim()

    return run


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``kernel`` for a worker process that holds no encoder before and after and gives freed memory back."""
    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch], *options) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from kernel(batches, *options)
        finally:
            release()

    return run


def lazily(column: pa.Array, rows: int = 200) -> Iterator[str | None]:
    """The values of a text column; at no time are those of a whole batch held as strings beside it."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def chunks(texts: Iterable[str | None], most: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about ``most`` (CHUNK_CHARS) characters; null counts as empty."""
    most = most or CHUNK_CHARS
    at, run, chars = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text or "")
        chars += len(run[-1])
        if chars >= most or len(run) >= 20_000:
            yield at, run
            at, run, chars = i + 1, [], 0
    if run:
        yield at, run
