"""Fill-in-the-middle examples: texts cut into prefix, middle and suffix at code points, by SWAR words.

The UTF-8 bytes of a run of texts are viewed as uint64 words. A byte starts a code point unless its top bits are 10, and it
ends one if the byte behind it starts one; both are found for eight bytes at once by shifts, with one mark in the lowest
bit of each byte. ``bitwise_count`` gives the marks of each word and their running sum the rank of every word. The k-th
code point of a text is then a binary search for its word and a select inside the word: a multiplication sums the marks
of the bytes from the bottom up, and the bytes whose sum is still too small are counted. No text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorepix.llm.tokens import lean
from shorepix.llm.words import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 texts about so many stay as they are; of 100 others so many are suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_B1, _B6, _B7, _BYTE, _REST = (np.uint64(k) for k in (1, 6, 7, 8, 56))


class CodePoints:
    """Rank and select of code points in a run of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        words = np.zeros(len(data) // 8 + 2, "<u8")  # zero bytes behind the data start a code point
        words.view(np.uint8)[:len(data)] = data
        starts = (~(words >> _B7) | (words >> _B6)) & _ONES
        self.ends = starts >> _BYTE
        self.ends[:-1] |= starts[1:] << _REST
        self.count = np.bitwise_count(self.ends).astype(np.int64)
        self.upto = np.cumsum(self.count)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before byte ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = self.ends[word] & ((np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1))
        return self.upto[word] - self.count[word] + np.bitwise_count(below).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte behind the ``k``-th code point (from 1)."""
        word = np.searchsorted(self.upto, k)
        inside = (k - self.upto[word] + self.count[word]).astype(np.uint64)
        sums = self.ends[word] * _ONES  # byte j: marks in the bytes 0 to j, at most 8
        reached = ((sums | _TOPS) - inside * _ONES) & _TOPS
        return 8 * word + 8 - np.bitwise_count(reached).astype(np.int64) + 1


def cut_places(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """(code points, code points before the middle, in it, its first byte, the byte behind it) of each text
    data[bounds[k]:bounds[k+1]]; the cuts are ``first`` and ``second`` modulo one more than the code points, in order."""
    marks = CodePoints(data)
    before = marks.rank(bounds)
    n = np.diff(before)
    a, b = first % (n + 1), second % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)

    def byte(k):
        inside = (k > 0) & (k < n)
        place = np.where(k == 0, bounds[:-1], bounds[1:])
        place[inside] = marks.select((before[:-1] + k)[inside])
        return place

    return n, low, high - low, byte(low), byte(high)


def _draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hex SHA-256 of seed and doc_id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(documents: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every document.

    The prefix ends after the smaller, the middle after the larger of two draws modulo n + 1; draws depend on ``seed`` and
    doc_id alone. ``form``: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, and ``plain``
    is the text as it is, for ``plain_percent`` of the texts, empty ones, and those that hold a marker. A null text counts
    as empty. prefix_chars and middle_chars are null for plain texts. Rows with one doc_id draw alike; a null doc_id draws
    as an empty name. Repeated rows give repeated rows, an empty table stays empty, other columns are ignored.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in MARKERS)
        for batch in batches:
            numbers = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            for at, data, bounds in text_slices(batch.column(1)):
                rows = slice(at, at + len(bounds) - 1)
                n, before, inside, low, high = cut_places(data, bounds, numbers[0][rows], numbers[1][rows])
                kept = (n == 0) | (numbers[2][rows] % 100 >= 100 - plain_percent)
                first = numbers[3][rows] % 100 < spm_percent
                raw, form, output = data.tobytes(), [], []
                for a, b, c, d, plain, spm in zip(*(x.tolist() for x in (bounds[:-1], low, high, bounds[1:], kept, first)), strict=True):
                    text = raw[a:d]
                    if plain or p in text or s in text or m in text:
                        form.append("plain")
                        output.append(text)
                    elif spm:
                        form.append("spm")
                        output.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                    else:
                        form.append("psm")
                        output.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                form = pa.array(form, pa.string())
                plain = np.array(pa.compute.equal(form, "plain"))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(form)), pa.array(n), form, pa.array(before, mask=plain), pa.array(inside, mask=plain),
                    pa.array(output, pa.binary()).view(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                            *[h.alias(f"h{k}") for k, h in enumerate(_draws(seed))]).mapInArrow(cut, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output of :func:`transform` was made from. No marker can begin in one part and end in the next, so
    the first ones found are those that were set."""
    def parts(*markers):
        rest, found = F.substr(output, F.lit(len(markers[0]) + 1)), []
        for marker in markers[1:]:
            found.append(F.substring_index(rest, marker, 1))
            rest = F.substr(rest, F.char_length(found[-1]) + len(marker) + 1)
        return [*found, rest]

    prefix, suffix, middle = parts(PREFIX, SUFFIX, MIDDLE)
    last, start, mid = parts(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(start, mid, last)).otherwise(output)
