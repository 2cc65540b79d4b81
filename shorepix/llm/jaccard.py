"""Exact Jaccard join of documents on word shingles, as connected components or as all links.

Sets are 64-bit hashes of shingles, ordered by hash. Two sets of similarity t share an element among the first
|x| - ceil(t |x|) + 1 of each in any common order, so inverted lists are built over prefixes only. What relations between
sets save:

* equal sets are one set with one answer;
* **frequent elements**: elements that enter the lists more than FREQUENT times are moved behind all others in the common
  order, the more frequent ones (by powers of two) further back.
  Prefixes are taken a little longer than needed, so that most sets still have a full prefix without their frequent
  elements. Sets that one half of the elements shows to be mostly frequent (near-copies of a large group, boilerplate)
  enter the lists with all their elements: what they do not share with their group then comes first. The few sets this
  misses are compared by the plain order;
* **skipping by position**: in a list, a pair is skipped if the sizes of the sets or the positions of the shared element
  already bound the overlap below the threshold;
* **answers from a similar set's answer**: in the first rounds a long list compares its sets with only a few of them. A
  set linked to one takes over its component, and later rounds skip all pairs of one component, so a group of near-copies
  costs a few comparisons per copy instead of one per pair. What remains is compared pair by pair, without the pairs inside
  the largest component of a list; entries of the plain order only with the sets that need it;
* **sketches**: a set's sketch holds, for each of SKETCH_BITS residues, whether it has an odd number of elements there. Two
  sketches differ in no more bits than their sets differ in elements, so in a long list a pair whose sketches differ too
  much is skipped.

All links lie inside the components, so they are found there. A component of one block gives the overlaps of all its sets
at once, as a product of incidence matrices. In a larger one the answers come from those of a few of its sets, the pivots:
every set is compared with the pivots, and the sets are dealt into blocks by their nearest pivot and their distance to it.
The number of elements in which two sets differ is a metric, so for two blocks the distances to one pivot may show that all
their sets are linked, or that none are; then no set of theirs is read again. Only pairs of blocks that stay open are
multiplied.

Every comparison reads both whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shorepix.llm.graph import components
from shorepix.llm.store import size_checked, staged
from shorepix.llm.tokens import lean
from shorepix.llm.words import LOWER, mixed, span_hashes, text_slices, word_spans

SHINGLE = 5
PERCENT = 80
FREQUENT = 16
#: One in so many elements is counted to find the sets that are mostly frequent.
SAMPLED = 2
#: Rounds over lists of more than FREQUENT entries, and how many sets of a list the others are compared with in each.
ROUNDS, LEADERS = 2, 8
SKETCH_BITS = 512
#: Sets and elements of a block, about; elements of the small components that one task call compares; columns of a product.
BLOCK, BLOCK_ELEMENTS, SMALL_ELEMENTS, COLUMNS = 512, 1 << 19, 1 << 16, 4096
#: Sets of a component of several blocks with which all its sets are compared; steps of the distance to the nearest one in
#: the part of a set's size up to which sets near one pivot are linked for certain, and the last step, of all that are farther.
PIVOTS, STEPS, LAST_STEP = 4, 4, 63
#: Blocks that meet all blocks of their component in one task.
LANE = 1000
_MIX = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words are runs of bytes other than ASCII white space, A-Z as a-z;
    a text of fewer than SHINGLE words is one shingle of all its words, one without words has none."""
    start, end, row = word_spans(data, bounds)
    hashes = span_hashes(data, start, end, LOWER) if len(start) else np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=len(bounds) - 1)
    first = np.cumsum(count) - count
    full = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        full += hashes[k:k + len(full)] * _MIX[k]
    full = mixed(full)
    out = []
    for a, n in zip(first.tolist(), count.tolist(), strict=True):
        if n >= SHINGLE:
            found = np.sort(full[a:a + n - SHINGLE + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif n:
            some = (hashes[a:a + n] * _MIX[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mixed(np.array([some], np.uint64)))
        else:
            out.append(hashes[:0])
    return out


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def _longer_prefix(n: int) -> int:
    return min(n, prefix_length(n) + n // 25 + 4)


def _set_hash(found: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(found).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def _packed(found: np.ndarray) -> bytes:
    """The upper 48 bits of each element: in the lists a chance meeting costs a comparison, no more."""
    return (found >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _sketches(sets: list[np.ndarray]) -> pa.Array:
    """The parity of the number of elements in each residue class, 64 bits to a long."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    cell = owner * SKETCH_BITS + (every % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(sets) * SKETCH_BITS) & 1).astype(bool)
    longs = SKETCH_BITS // 64
    bounds = np.arange(0, longs * (len(sets) + 1), longs, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.packbits(odd).view(np.int64)))


@lean
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, bounds in text_slices(batch.column(1)):
            sets = shingle_sets(data, bounds)
            prefix = [_packed(s[:_longer_prefix(len(s))]) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([_set_hash(s) if len(s) else None for s in sets], pa.int64()), pa.array(prefix, pa.binary()), _sketches(sets)],
                names=["doc_id", "n", "set_hash", "prefix", "sketch"])


@lean
def _entries(batches: Iterator[pa.RecordBatch], sampled: int = 1) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at in range(0, batch.num_rows, 500):
            raw = batch.column(2).slice(at, 500).to_pylist()
            counts = np.array([len(x) // 6 for x in raw])
            keys = np.zeros((int(counts.sum()), 8), np.uint8)
            keys[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
            meta = np.repeat(sizes[at:at + 500].astype(np.int64), counts) << 32 | place
            keys, owner = keys.view(np.int64).ravel(), np.repeat(ids[at:at + 500], counts)
            if sampled > 1:
                some = keys % sampled == 0
                keys, owner, meta = keys[some], owner[some], meta[some]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owner), pa.array(meta)], names=["key", "v", "meta"])


def _sampled_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _entries(batches, SAMPLED)


@lean
def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, bounds in text_slices(batch.column(1)):
            sets = shingle_sets(data, bounds)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, len(sets)), pa.array([_set_hash(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set_hash", "elements"])


@lean
def _whole_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, bounds in text_slices(batch.column(1)):
            sets = shingle_sets(data, bounds)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, len(sets)), pa.array([_set_hash(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([_packed(s) for s in sets], pa.binary())], names=["doc_id", "set_hash", "prefix"])


@lean
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """|a n b| for every set a of ``x`` and b of ``y``. Without ``y`` of every two sets of ``x``; the diagonal is not meant."""
    mine = np.concatenate(x)
    if y is None:
        shared, times = np.unique(mine, return_counts=True)
        shared = shared[times > 1]
    else:
        shared = np.intersect1d(mine, np.concatenate(y))

    def cells(sets):
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, every)
        held = shared[np.minimum(at, len(shared) - 1)] == every
        order = np.argsort(at[held], kind="stable")
        return owner[held][order], at[held][order], len(sets)

    def columns(side, low):
        owner, at, n = side
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        matrix = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
        matrix[owner[a:b], at[a:b] - low] = 1
        return matrix

    out = np.zeros((len(x), len(x if y is None else y)), np.int64)
    if len(shared):
        left = cells(x)
        right = left if y is None else cells(y)
        for low in range(0, len(shared), COLUMNS):
            one = columns(left, low)
            out += (one @ (one if y is None else columns(right, low)).T).astype(np.int64)
    return out


def _cell_links(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links (v of one set, v of the other) of each component in a cell: comp, i, j, own, v, elements. Where i and j are
    different blocks, only those between them."""
    table = table.sort_by("comp").combine_chunks()
    comp, i, j, own, v = (table.column(k).to_numpy() for k in range(5))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(5)]
    starts = np.flatnonzero(np.diff(comp, prepend=comp[0] - 1)) if len(comp) else []
    for a, b in zip(starts, [*starts[1:], len(comp)], strict=True):
        if i[a] == j[a]:
            left = right = np.arange(a, b)
            both = overlaps(sets[a:b])
        else:
            left, right = a + np.flatnonzero(own[a:b] == i[a]), a + np.flatnonzero(own[a:b] == j[a])
            if not len(left) or not len(right):
                continue
            both = overlaps([sets[k] for k in left], [sets[k] for k in right])
        n, m = (np.array([len(sets[k]) for k in side]) for side in (left, right))
        ok = 100 * both >= PERCENT * (n[:, None] + m[None, :] - both)
        x, y = np.nonzero(np.triu(ok, 1) if left is right else ok)
        yield v[left[x]], v[right[y]]


def _link_pairs(table: pa.Table) -> pa.Table:
    found = [(np.minimum(a, b), np.maximum(a, b)) for a, b in _cell_links(table)]
    return pa.table({name: pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)) for k, name in enumerate("ab")})


def _link_counts(table: pa.Table) -> pa.Table:
    ends = [end for pair in _cell_links(table) for end in pair]
    v, n = np.unique(np.concatenate(ends) if ends else np.zeros(0, np.int64), return_counts=True)
    return pa.table({"v": pa.array(v.astype(np.int64)), "n_links": pa.array(n.astype(np.int64))})


class _Join:
    """The steps of one join; ``texts``: (doc_id, text), ``sets``: (v, doc_id, n, set_hash), one row per distinct set."""

    def __init__(self, texts: DataFrame, sets: DataFrame):
        self.texts, self.sets = texts, sets

    def of(self, sets: DataFrame, kernel, column: str) -> DataFrame:
        """``sets`` (v, doc_id, set_hash, ...) with a binary column that ``kernel`` derives from their texts."""
        wanted = size_checked(sets.select("doc_id").distinct())
        return (self.texts.join(wanted, "doc_id", "left_semi").mapInArrow(kernel, f"doc_id long, set_hash long, {column} binary")
                .join(size_checked(sets), ["doc_id", "set_hash"]).dropDuplicates(["v"]))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets that are similar, from their whole texts."""
        pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        ends = staged(pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
                      .join(self.sets, "v").select("v", "doc_id", "set_hash"))
        full = staged(self.of(ends, _full_sets, "elements").select("v", "elements"))
        return staged(pairs.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b").select("a", "b", "x", "y")
                      .mapInArrow(_linked, "a long, b long"))


def _possible(a: str, b: str):
    """Whether sizes and positions of a shared element leave room for a link of the entries ``a`` and ``b``."""
    n, m = (F.shiftright(F.col(f"{x}.meta"), 32) for x in (a, b))
    i, j = (F.col(f"{x}.meta").bitwiseAND(F.lit((1 << 32) - 1)) for x in (a, b))
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * most >= PERCENT * (n + m))


def _grouped(documents: DataFrame) -> tuple[_Join, DataFrame, DataFrame]:
    """The join, the rows (doc_id, n, set_hash, ...) and the distinct sets: v, doc_id, n, set_hash, copies, least_doc, comp."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(texts.mapInArrow(_signatures, "doc_id long, n int, set_hash long, prefix binary, sketch array<long>")
                    .withColumn("v", F.monotonically_increasing_id()))
    classes = staged(signed.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_hash")
                     .agg(F.min("v").alias("v"), F.min_by("doc_id", "v").alias("doc_id"), F.min("n").alias("n"),
                          F.min("doc_id").alias("least_doc"), F.count("*").alias("copies")))
    copies = size_checked(staged(signed.filter(F.col("set_hash").isNotNull()).select("v", "set_hash")
                                 .join(classes.filter("copies > 1").select("set_hash", F.col("v").alias("kept")), "set_hash")
                                 .filter("v <> kept").select("v")))
    one_each = signed.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()).join(copies, "v", "left_anti")
    join = _Join(texts, classes)
    entry = "key long, v long, meta long"
    size, place = F.shiftright("meta", 32), F.col("meta").bitwiseAND(F.lit((1 << 32) - 1))

    def needed(n):
        return n - F.ceil(PERCENT * n / 100) + 1

    def reach(n):
        return F.least(n, needed(n) + F.floor(n / 25) + 4)

    # Sets that seem to be mostly frequent enter the lists whole.
    seen = one_each.select("v", "n", "prefix").mapInArrow(_sampled_entries, entry)
    crowded = size_checked(staged(seen.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > FREQUENT).select("key")))
    whole = (seen.join(crowded, "key", "left_semi").groupBy("v").agg(F.count("*").alias("c"), F.max(size).alias("size"))
             .filter(4 * SAMPLED * F.col("c") > reach(F.col("size")) - needed(F.col("size"))).select("v"))
    whole = staged(whole.join(classes, "v").select("v", "doc_id", "set_hash", "n"))
    whole_ids = size_checked(whole.select("v", F.lit(True).alias("whole")))
    whole_sets = staged(join.of(whole, _whole_prefix, "prefix").select("v", "n", "prefix"))
    emitted = one_each.select("v", "n", "prefix").join(whole_ids, "v", "left_anti").union(whole_sets)
    entries = emitted.mapInArrow(_entries, entry)
    lists = entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    tier = F.when(F.col("c") > FREQUENT, F.floor(F.log2(F.col("c") / FREQUENT)).cast("int") + 1).otherwise(0)
    met = entries.join(lists, "key").select("key", "v", "meta", tier.alias("tier"))

    # Each set's prefix in the common order: by tier, then by hash. Elements found once are in tier 0 and not in the table.
    mine = Window.partitionBy("v")
    before = mine.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    often = (F.col("tier") > 0).cast("int")
    ranked = (met.join(whole_ids, "v", "left").withColumns({
        "whole": F.coalesce("whole", F.lit(False)), "earlier": F.coalesce(F.sum(often).over(before), F.lit(0)), "held": F.sum(often).over(mine),
        "behind": F.row_number().over(mine.orderBy("tier", place)) - 1 - F.count("*").over(mine) + F.sum(often).over(mine)}))
    rare = F.when(F.col("whole"), size).otherwise(reach(size)) - F.col("held")
    enough = F.col("whole") | (rare >= needed(size))
    leading = F.when(F.col("tier") > 0, F.col("whole") & (rare + F.col("behind") < needed(size))).otherwise(place - F.col("earlier") < needed(size))
    usable = ranked.select("key", "v", "meta", rare.cast("int").alias("rare"), (enough & leading).alias("ordered"), (~enough).alias("missed"), (place < needed(size)).alias("plain"))
    # How many elements a set can share with others in either kind of prefix at most.
    usable = usable.withColumns({"k": F.sum(F.col("ordered").cast("int")).over(mine).cast("int"), "plain_k": F.sum(F.col("plain").cast("int")).over(mine).cast("int")})
    usable = staged(usable.filter("ordered or plain"))
    wanted = (usable.groupBy("key").agg(F.count(F.when(F.col("ordered"), 1)).alias("ordered_n"), F.max(F.col("missed") & F.col("plain")).alias("with_missed"))
              .filter("ordered_n > 1 or with_missed").select("key", "with_missed", (F.col("ordered_n") > FREQUENT).alias("long")))
    usable = staged(usable.join(wanted, "key").filter("ordered or (plain and with_missed)").withColumn("long", F.col("long") | F.col("with_missed")).drop("with_missed"))
    either = (F.col("x.missed") | F.col("y.missed")) & F.col("x.plain") & F.col("y.plain")
    found = F.when(F.col("x.missed") | F.col("y.missed"), F.least("x.plain_k", "y.plain_k")).otherwise(F.least("x.k", "y.k"))
    n, m = (F.shiftright(F.col(f"{x}.meta"), 32) for x in "xy")
    meet = (((F.col("x.ordered") & F.col("y.ordered")) | either)
            & ((100 + PERCENT) * (found + F.greatest(n - needed(n), m - needed(m))) >= PERCENT * (n + m)))

    def across(entries, labels):
        """Entries of the lists that hold sets of several components, with these."""
        marked = staged(entries.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v")))
        several = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
        return marked.join(several, "key", "left_semi")

    # Rounds over the long lists: each list against a few of its sets, those with the fewest elements of their own, from
    # which a group of near-copies differs least. What these rounds miss is left to the end.
    labels = classes.filter("false").select("v", F.col("v").alias("comp"))
    for turn in range(ROUNDS):
        marked = across(usable.filter("long"), labels)
        chance = F.xxhash64(F.lit(turn), "v")
        leaders = (marked.groupBy("key", F.pmod(chance, F.lit(LEADERS)).alias("seat"))
                   .agg(F.min(F.struct("rare", chance.alias("chance"), "v", "meta", "ordered", "missed", "plain", "k", "plain_k", "comp")).alias("leader")).select("key", "leader.*"))
        tried = (marked.alias("x").join(leaders.alias("y"), "key").filter((F.col("x.comp") != F.col("y.comp")) & meet & _possible("x", "y"))
                 .groupBy(F.col("x.v").alias("a"), F.col("y.v").alias("b")).agg(F.count("*").alias("shared"), F.min("x.meta").alias("meta"))
                 .filter(4 * F.col("shared") >= needed(size)).select("a", "b"))
        labels = staged(components(join.links(tried).union(labels.toDF("a", "b"))))
    # The rest, pair by pair; over long lists only where the sketches leave room.
    marked = staged(across(usable, labels))

    def met_in(x, y, *more):
        pairs = x.alias("x").join(y.alias("y"), "key").filter((F.col("x.comp") != F.col("y.comp")) & meet & _possible("x", "y"))
        for condition in more:
            pairs = pairs.filter(condition)
        return pairs.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b"), (n + m).alias("total"),
                            F.greatest(n - needed(n), m - needed(m)).alias("behind"))

    once = F.col("x.v") < F.col("y.v")
    short = marked.filter("not long")
    apart = sum((F.bit_count(F.col("x.sketch")[k].bitwiseXOR(F.col("y.sketch")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    alike = (100 + PERCENT) * apart <= (100 - PERCENT) * (n + m)
    # No two sets of a list's largest component meet: the others meet each other and that one.
    long = marked.filter("long")
    largest = long.filter("ordered").groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("largest"))
    sketched = staged(long.join(largest, "key", "left").join(one_each.select("v", "sketch"), "v"))
    ordered = sketched.filter("ordered")
    # In the plain order nothing meets but the sets that were missed and all others.
    pairs = (met_in(short, short, once)
             .union(met_in(ordered.filter("comp <> largest"), ordered, (F.col("y.comp") == F.col("y.largest")) | once, alike))
             .union(met_in(sketched.filter("plain"), sketched.filter("plain and missed"), ~F.col("x.missed") | once, alike))
             .groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("total").alias("total"), F.first("behind").alias("behind")))
    # Shared elements lie in both prefixes, where the lists have counted them, or behind the prefix that ends first.
    more = join.links(pairs.filter((100 + PERCENT) * (F.col("shared") + F.col("behind")) >= PERCENT * F.col("total")))
    labels = components(more.union(labels.toDF("a", "b")))
    return join, signed, classes.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))


def similar_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_copies of every document.

    Two documents link when 100 * |x n y| >= 80 * |x u y| for their sets of 5-word shingles. component_id is the smallest
    doc_id reachable by links, the document's own included. Null and empty texts, and texts without words, have no shingle
    and link with nothing. Equal rows give equal rows; rows that share a doc_id are separate sets with one id. A row with a
    null doc_id gets the component of the documents with an equal set, if there are any, else null. Other columns are
    ignored; an empty table stays empty.

    n_copies is the number of documents with the same set. The links themselves: ``linked_documents`` and ``all_links``.
    """
    _, signed, members = _grouped(documents)
    ids = members.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    named = members.join(ids, "comp").select("set_hash", "copies", "component_id")
    return (signed.select("doc_id", "n", "set_hash").join(named, "set_hash", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("copies", F.lit(1)).alias("n_copies")))


def _distances(sets: pa.Table, pivots: pa.Table) -> pa.Table:
    """v, comp, n, the nearest pivot and the number of elements in which the set differs from each pivot, for sets (comp,
    v, elements) and the pivots (seat, elements) of their component."""
    found = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.column("elements")]
    sizes = np.array([len(x) for x in found], np.int64)
    every, owner = np.concatenate([np.zeros(0, np.uint64), *found]), np.repeat(np.arange(len(found)), sizes)
    apart = []
    for pivot in pivots.sort_by("seat").column("elements"):
        pivot = np.frombuffer(pivot.as_buffer(), np.uint64)
        held = pivot[np.minimum(np.searchsorted(pivot, every), len(pivot) - 1)] == every
        apart.append(sizes + len(pivot) - 2 * np.bincount(owner[held], minlength=len(found)))
    apart = np.stack(apart, axis=1)
    bounds = np.arange(0, apart.size + 1, apart.shape[1], dtype=np.int32)
    return pa.table({"v": sets.column("v"), "comp": sets.column("comp"), "n": pa.array(sizes), "near": pa.array(apart.argmin(axis=1).astype(np.int32)),
                     "apart": pa.ListArray.from_arrays(pa.array(bounds), pa.array(apart.ravel().astype(np.int64)))})


def _blocks(full: DataFrame) -> DataFrame:
    """(v, comp, n, apart, block): the sets of large components in blocks of about BLOCK sets and BLOCK_ELEMENTS elements,
    next to sets that are as far from the same pivot."""
    chunk = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    chosen = full.groupBy("comp", F.pmod(F.xxhash64(F.lit(1), "v"), F.lit(PIVOTS)).cast("int").alias("seat")).agg(F.min_by("v", F.xxhash64(F.lit(3), "v")).alias("v"))
    pivots = (full.join(size_checked(staged(chosen.select("v", "seat"))), "v")
              .select("comp", "seat", "elements", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .toDF("comp", "seat", "elements", "chunk"))  # columns of its own, as both sides of the grouping come from one table
    measured = staged(full.withColumn("chunk", chunk).groupBy("comp", "chunk").cogroup(pivots.groupBy("comp", "chunk"))
                      .applyInArrow(_distances, "v long, comp long, n long, near int, apart array<long>"))
    step = F.least(F.lit(LAST_STEP), F.floor(STEPS * (100 + PERCENT) * F.array_min("apart") / ((100 - PERCENT) * F.col("n")))).cast("int")
    placed = measured.withColumn("bucket", F.col("near") * (LAST_STEP + 1) + step)
    # A component has few buckets. They lie one behind the other on a line, each as long as it has blocks.
    length = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ELEMENTS)
    line = Window.partitionBy("comp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("comp", "bucket").agg(length.alias("length")).withColumn("start", F.coalesce(F.sum("length").over(line), F.lit(0.0)))
    within = F.pmod(F.xxhash64(F.lit(2), "v"), F.lit(1 << 20)) / (1 << 20)
    return staged(placed.join(size_checked(buckets), ["comp", "bucket"])
                  .select("v", "comp", "n", "apart", F.floor(F.col("start") + within * F.col("length")).cast("int").alias("block")))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(comp, i, j, c_i, c_j, linked) of all pairs of blocks i <= j of a component, but for those without a link. ``linked``:
    all their sets are."""
    ends = [end for p in range(PIVOTS) for end in (F.min(F.get("apart", F.lit(p))).alias(f"low{p}"), F.max(F.get("apart", F.lit(p))).alias(f"high{p}"))]
    known = staged(blocks.groupBy("comp", "block").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), *ends))
    lanes = known.groupBy("comp").agg((F.max("block") / LANE + 1).cast("int").alias("lanes"))
    dealt = known.join(size_checked(lanes), "comp")
    left = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane")).alias("x")
    right = dealt.withColumn("lane", F.pmod("block", "lanes")).alias("y")
    none, all_of_them = (100 * F.col("x.most") < PERCENT * F.col("y.least")) | (100 * F.col("y.most") < PERCENT * F.col("x.least")), F.lit(False)
    for p in range(PIVOTS):  # a pivot that a component lacks decides nothing
        gap = F.greatest(F.col(f"x.low{p}") - F.col(f"y.high{p}"), F.col(f"y.low{p}") - F.col(f"x.high{p}"))
        none |= F.coalesce((100 + PERCENT) * gap > (100 - PERCENT) * (F.col("x.most") + F.col("y.most")), F.lit(False))
        within = (100 + PERCENT) * (F.col(f"x.high{p}") + F.col(f"y.high{p}")) <= (100 - PERCENT) * (F.col("x.least") + F.col("y.least"))
        all_of_them |= F.coalesce(within, F.lit(False))
    same = (F.col("x.comp") == F.col("y.comp")) & (F.col("x.lane") == F.col("y.lane")) & (F.col("x.block") <= F.col("y.block"))
    return staged(left.join(right, same).filter(~none)
                  .select("x.comp", F.col("x.block").alias("i"), F.col("y.block").alias("j"), F.col("x.c").alias("c_i"), F.col("y.c").alias("c_j"), all_of_them.alias("linked")))


def _cells(join: _Join, members: DataFrame):
    """What the links come from: the whole sets of small components, grouped by cells of some components each; the whole
    sets of large components with their blocks; the pairs of these blocks."""
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("total") / BLOCK_ELEMENTS)).cast("int")
    sizes = staged(members.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("total")).filter("c > 1").withColumn("blocks", blocks))
    small = sizes.filter("blocks = 1").agg(F.sum("total")).first()[0] or 0
    inside = staged(members.join(size_checked(sizes.select("comp", "blocks")), "comp").select("v", "doc_id", "set_hash", "comp", "blocks"))
    full = staged(join.of(inside, _full_sets, "elements").select("comp", "blocks", "v", "elements"))
    cell = -1 - F.pmod(F.xxhash64("comp"), F.lit(small // SMALL_ELEMENTS + 1))
    zero = F.lit(0)
    cells = full.filter("blocks = 1").select("comp", zero.alias("i"), zero.alias("j"), zero.alias("own"), "v", "elements", cell.alias("cell"))
    large = full.filter("blocks > 1")
    dealt = _blocks(large)
    return cells, staged(dealt.join(large.select("v", "elements"), "v").select("comp", "block", "v", "elements")), _block_pairs(dealt)


def _met(cells: DataFrame, large: DataFrame, pairs: DataFrame):
    """The sets of the cells and of the pairs of blocks, grouped by what is compared in one call."""
    ends = pairs.select("comp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    met = large.join(ends, ["comp", "block"]).select("comp", "i", "j", F.col("block").alias("own"), "v", "elements", F.col("comp").alias("cell"))
    return cells.union(met).groupBy("cell", "i", "j")


def _link_numbers(join: _Join, members: DataFrame) -> DataFrame:
    """(v, n_links) of the sets that have links; a set of a block whose sets are all linked with those of another one gets
    their number, without a comparison."""
    cells, large, pairs = _cells(join, members)
    compared = _met(cells, large, pairs.filter("not linked")).applyInArrow(_link_counts, "v long, n_links long")
    sure = pairs.filter("linked")
    given = (sure.select("comp", F.col("i").alias("block"), F.when(F.col("i") == F.col("j"), F.col("c_j") - 1).otherwise(F.col("c_j")).alias("more"))
             .union(sure.filter("i < j").select("comp", "j", "c_i")).groupBy("comp", "block").agg(F.sum("more").alias("n_links")))
    taken = large.select("comp", "block", "v").join(size_checked(given), ["comp", "block"]).select("v", "n_links")
    return compared.union(taken).groupBy("v").agg(F.sum("n_links").alias("n_links"))


def all_links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id and set_id of every row, and each pair (a, b) of distinct sets that are similar, a < b, once.

    Links are those of ``similar_documents``; equal sets are one set_id. set_id is null where no document id or no word is
    given to link. The links of a group of near-copies grow with the square of its size.
    """
    join, signed, members = _grouped(documents)
    members = staged(members)
    found = staged(_met(*_cells(join, members)).applyInArrow(_link_pairs, "a long, b long"))
    name = members.select("v", "set_hash")
    links = found.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    known = members.select("set_hash", F.col("set_hash").alias("set_id"))
    return signed.select("doc_id", "set_hash").join(known, "set_hash", "left").select("doc_id", "set_id"), links


def linked_documents(documents: DataFrame) -> DataFrame:
    """The columns of ``similar_documents`` with class_id, the smallest doc_id with an equal set, and n_links, the number of
    other sets that the document's set is similar to. All links are counted, but no pair becomes a row.

    A text without words is a class of its own. Rows with a null doc_id get the class of an equal set, if there is any.
    """
    join, signed, members = _grouped(documents)
    members = staged(members)
    counts = _link_numbers(join, members)
    ids = members.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    named = staged(members.join(ids, "comp").join(counts, "v", "left").select("set_hash", "copies", "component_id", F.col("least_doc").alias("class_id"), "n_links"))
    return (signed.select("doc_id", "n", "set_hash").join(named, "set_hash", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The documents, all columns, without those whose component holds a smaller doc_id. Rows that share a doc_id stay or
    go together; rows with a null doc_id stay."""
    gone = size_checked(staged(similar_documents(documents).filter("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()))
    return documents.join(gone, documents["doc_id"] == gone["__gone"], "left_anti")
