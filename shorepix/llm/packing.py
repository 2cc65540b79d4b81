"""Packing of token pieces into fixed-length sequences by patterns of few documents.

The driver sees only the histogram of piece lengths (at most ``capacity`` rows whatever the number of documents):

1. lengths fall into classes of ``capacity / CLASSES``; all patterns of at most four classes that fill a sequence are
   enumerated;
2. non-negative least squares fits a repeat count for each pattern to the class histogram; counts are rounded down;
3. a pattern is repeated as often as its classes still have pieces; each repeat draws its longer pieces from their
   classes, and its last piece as the longest one left that fits. Pieces shorter than FILLER classes stay out of patterns;
4. what is left is packed by best fit, longest first, into the gaps of all sequences, then into new ones.

The plan says for the r-th piece of each length where it goes. Pieces are numbered within their length by a window over
(length, salt), so that a length shared by many pieces is split, and look their place up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shorepix.llm.store import fresh, staged
from shorepix.llm.tokens import CHUNK_CHARS, MEMO_BYTES, chunks, default_tokenizer, encoder, lazily, lean, trimmed

CLASSES = 128
MOST_IN_PATTERN = 4
#: Shorter classes are left to fill gaps.
FILLER = 8
#: Pieces of one length that one window task numbers.
RANK_ROWS = 100_000


def patterns(units: int, most: int = MOST_IN_PATTERN) -> np.ndarray:
    """All descending tuples of at most ``most`` positive classes with sum ``units``, padded with 0."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        slots = most - len(chosen)
        if left == 0:
            found.append(chosen + (0,) * slots)
        elif slots:
            for c in range(min(left, chosen[-1] if chosen else left), (left + slots - 1) // slots - 1, -1):
                extend((*chosen, c), left - c)

    extend((), units)
    return np.array(found, np.int64)


def fit_repeats(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Repeat counts x >= 0 that minimize the squared distance between the classes used and ``histogram``.

    An active-set method: the pattern with the steepest descent enters, and patterns that the unconstrained solution
    makes negative leave. ``histogram[0]`` (the padding class) is ignored.
    """
    target = histogram.astype(float).copy()
    target[0] = 0
    rows = len(target)
    column = lambda k: np.bincount(shapes[k], minlength=rows).astype(float) * (np.arange(rows) > 0)
    x = np.zeros(len(shapes))
    active: list[int] = []
    matrix = np.zeros((rows, 0))
    for _ in range(rounds):
        rest = target - matrix @ x[active]
        rest[0] = 0
        gain = rest[shapes].sum(axis=1)
        gain[active] = -np.inf
        k = int(gain.argmax())
        if gain[k] <= 1e-6 * max(1.0, target.max()) or len(active) >= rows:
            break
        active.append(k)
        matrix = np.column_stack([matrix, column(k)])
        while True:
            best = np.linalg.lstsq(matrix, target, rcond=None)[0]
            if (best > 0).all():
                x[active] = best
                break
            now = x[active]
            below = best <= 0
            step = (now[below] / np.maximum(now[below] - best[below], 1e-300)).min()
            now = now + step * (best - now)
            now[below & (now <= 1e-9)] = 0
            x[active] = now
            keep = now > 0
            if keep.all():
                break
            active = [a for a, kept in zip(active, keep, strict=True) if kept]
            matrix = matrix[:, keep]
            if not active:
                break
    return x


class _Plan:
    """Places lengths from a stock; a placement is (length, low, count, sequence, offset, per): the pieces of that length
    numbered low .. low + count - 1 go ``per`` to a sequence from ``sequence`` on, one after the other from ``offset``."""

    def __init__(self, stock: np.ndarray):
        self.stock, self.given = stock.copy(), np.zeros_like(stock)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def place(self, length: int, count: int, sequence: int, offset: int, per: int = 1) -> None:
        self.rows.append((length, int(self.given[length]), count, sequence, offset, per))
        self.given[length] += count
        self.stock[length] -= count

    def longest(self, low: int, high: int) -> int:
        """The longest length in low .. high in stock, or 0."""
        if high < low:
            return 0
        there = np.flatnonzero(self.stock[low:high + 1])
        return low + int(there[-1]) if len(there) else 0


def make_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(placements, number of sequences) for pieces of 1 .. ``capacity`` tokens."""
    stock = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"piece of {length} tokens; allowed are 1 to {capacity}")
        stock[length] = count
    plan = _Plan(stock)
    open_groups: list[tuple[int, int, int, int]] = []  # (gap, first sequence, count, used)
    unit = -(-capacity // CLASSES)
    units = capacity // unit
    bounds = np.clip((np.arange(capacity + 1) + unit // 2) // unit, 1, units)
    bounds[0] = 0
    by_class = np.bincount(bounds, weights=stock, minlength=units + 1)
    shapes = patterns(units)
    filler = FILLER if units == CLASSES else 1
    shapes = shapes[((shapes == 0) | (shapes >= filler)).all(axis=1)]
    by_class[:filler] = 0
    repeats = np.floor(fit_repeats(shapes, by_class) + 1e-9).astype(np.int64)
    lows = np.searchsorted(bounds, np.arange(units + 2))
    for k in np.argsort(-shapes[:, 0], kind="stable"):
        if not repeats[k]:
            continue
        shape = [int(c) for c in shapes[k] if c]
        most = min(int(plan.stock[lows[c]:lows[c + 1]].sum()) // shape.count(c) for c in shape)
        if not (most := min(most, int(repeats[k]))):
            continue
        groups = [(plan.sequences, most, 0)]
        plan.sequences += most
        for slot, c in enumerate(shape):
            last = slot == len(shape) - 1 and slot > 0
            low, high = int(lows[c]), int(lows[c + 1]) - 1
            if last:
                low, high = max(1, low - 2 * unit), capacity
            after = []
            for sequence, count, used in groups:
                while count:
                    length = plan.longest(low, min(high, capacity - used))
                    if not length:
                        after.append((sequence, count, used))
                        break
                    some = min(count, int(plan.stock[length]))
                    plan.place(length, some, sequence, used)
                    after.append((sequence, some, used + length))
                    sequence, count = sequence + some, count - some
            groups = after
        open_groups += [(capacity - used, sequence, count, used) for sequence, count, used in groups]
    by_gap: dict[int, list[tuple[int, int, int]]] = {}
    for gap, sequence, count, used in open_groups:
        if gap:
            by_gap.setdefault(gap, []).append((sequence, count, used))
    gaps = sorted(by_gap)
    for length in range(capacity, 0, -1):
        while plan.stock[length]:
            left = int(plan.stock[length])
            at = int(np.searchsorted(gaps, length)) if gaps else 0
            if at < len(gaps):
                gap = gaps[at]
                sequence, count, used = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(at)
            else:
                gap, used, sequence = capacity, 0, plan.sequences
                count = -(-left // (capacity // length))
                plan.sequences += count
            per = gap // length
            whole = min(count, left // per)
            parts = [(sequence, whole, per)] if whole else []
            if whole < count and left - whole * per:
                parts.append((sequence + whole, 1, left - whole * per))
            for first, some, each in parts:
                plan.place(length, some * each, first, used, each)
            done = sum(some for _, some, _ in parts)
            parts = [(first, some, used + each * length) for first, some, each in parts]
            if done < count:
                parts.append((sequence + done, count - done, used))
            for first, some, filled in parts:
                if filled < capacity:
                    if capacity - filled not in by_gap:
                        gaps.insert(int(np.searchsorted(gaps, capacity - filled)), capacity - filled)
                    by_gap.setdefault(capacity - filled, []).append((first, some, filled))
    return np.array(plan.rows, np.int64).reshape(-1, 6), plan.sequences


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` plus ``sequence_id`` (long) and ``offset`` (long).

    Every row of 1 .. ``capacity`` tokens gets a place; places within a sequence follow each other without a gap from 0.
    A null length or one outside the range raises. Equal rows get places of their own. An empty table stays empty.
    ``pieces`` must give the same rows each time it is read (a written table does).
    """
    fresh(pieces, "sequence_id", "offset")
    spark = pieces.sparkSession
    counted = pieces.groupBy(F.col(length).cast("int").alias("n")).agg(F.count("*").alias("c")).take(capacity + 2)
    if any(row.n is None or not 1 <= row.n <= capacity for row in counted):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    histogram = {row.n: row.c for row in counted}
    plan, _ = make_plan(histogram, capacity)
    # Bounded by the capacity, not by the pieces: a placement uses up a length, or a gap of one of the groups.
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    plan = plan[plan[:, 2] > 0]
    shared = spark.sparkContext.broadcast(plan)

    salts = np.ones(capacity + 1, np.int64)
    for n, c in histogram.items():
        salts[n] = -(-c // RANK_ROWS)
    by_kind = {int(n): [int(i) for i in np.flatnonzero(salts == n)] for n in np.unique(salts) if n > 1}
    salt = F.lit(1)
    for n, lengths in by_kind.items():
        salt = F.when(F.col(length).isin(lengths), F.lit(n)).otherwise(salt)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns])
    keyed = pieces.withColumns({"__tie": tie, "__salt": F.pmod(F.shiftright(tie, 20), salt).cast("int")})
    numbered = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy(length, "__salt").orderBy("__tie")) - 1)
    if by_kind:
        before = Window.partitionBy(length).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
        base = (keyed.groupBy(length, "__salt").agg(F.count("*").alias("__n"))
                .withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
        numbered = numbered.join(base, [length, "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__base")).drop("__base")
    numbered = numbered.select(*pieces.columns, F.col("__rank").cast("long"))
    columns = list(pieces.columns)
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] * (1 << 44) + rows[:, 1]
        at = columns.index(length)
        for batch in batches:
            n, rank = batch.column(at).to_numpy().astype(np.int64), batch.column(len(columns)).to_numpy()
            found = rows[np.searchsorted(keys, n * (1 << 44) + rank, "right") - 1]
            step = rank - found[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found[:, 3] + step // found[:, 5]), pa.array(found[:, 4] + step % found[:, 5] * n)],
                                             names=[*columns, "sequence_id", "offset"])

    return numbered.mapInArrow(places, schema)


def token_pieces(documents: DataFrame, capacity: int, tokenizer: str | None = None, by_word: bool = True,
                 with_ids: bool = False, memo_bytes: int = MEMO_BYTES, keep_memo: bool = True) -> DataFrame:
    """Encode whole texts, close each with id 1 and cut those longer than ``capacity``: one row per piece with doc_id,
    piece, start, length, ids_crc32 (unsigned, of little-endian uint32 ids) and, if asked for, ids (binary).

    A null text counts as empty and gives one piece of one id. Only a document longer than ``capacity`` is cut, into full
    pieces and a last one that may be shorter. Other columns are ignored; repeated rows give repeated pieces.
    """
    tokenizer = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, by_word, False, memo_bytes)
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, texts in chunks(lazily(batch.column(1)), min(CHUNK_CHARS, max(1, memo_bytes // 64))):
                ids, counts, _ = coder.chunk(texts)
                cuts = -(-counts // capacity)
                doc = np.repeat(np.arange(len(texts)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                begin = (np.cumsum(counts) - counts)[doc] + start
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                cut = [raw[4 * b:4 * (b + n)] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [pa.array(doc_ids[at + doc]), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in cut], pa.binary()))
                names = [field.split()[0] for field in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kernel = trimmed(encode) if keep_memo else lean(encode)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, schema)


def pack_documents(documents: DataFrame, capacity: int = 4096, tokenizer: str | None = None, by_word: bool = True,
                   with_ids: bool = False, memo_bytes: int = MEMO_BYTES, keep_memo: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence and offset. The pieces are written once to the shared folder, so that
    histogram, numbering and places see the same rows and texts are encoded once. ``memo_bytes``: what a
    worker may remember (see :mod:`shorepix.llm.tokens`), from task to task or, without ``keep_memo``, within one task only; the rows
    are the same either way."""
    return pack(staged(token_pieces(documents, capacity, tokenizer, by_word, with_ids, memo_bytes, keep_memo)), capacity)
