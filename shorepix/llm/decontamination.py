"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A leak is a stretch of WINDOW words of a document that lies word by word against WINDOW words of a benchmark item with
at least MATCHES equal words, so up to two words may be replaced. A spaced seed is a fixed mask of word positions; the
others are ignored. The two masks below are lossless: whichever two of the twelve words differ, one mask fits somewhere
inside the window on equal words alone. So an equi-join of seed hashes finds every leak, and each hit is then verified.
An item of fewer than WINDOW words leaks where all its words stand in a row: each such length has a mask of all its words.

Documents have far more seeds than any benchmark. A bit table of the benchmark's seed hashes, of a fixed size, lets
nearly all of them go before they leave their task; only the others are joined.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorepix.functions.staging import pinned
from shorepix.llm.store import size_checked, staged

WINDOW, MATCHES = 12, 10
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
#: Words of 64 bits in the bit table.
TABLE_WORDS = 1 << 16


def word_hashes(text: Column) -> Column:
    """Hashes of the words: runs of letters and digits, in small letters."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(mask: tuple[int, ...], word) -> Column:
    """The hash of a mask; ``word(k)`` is the k-th word from its position on. Null if the mask reaches past the end."""
    return F.when(word(mask[-1]).isNotNull(), F.xxhash64(F.lit(",".join(map(str, mask))), *[word(k) for k in mask]))


def _bit(seed: Column, shift: int = 20) -> Column:
    return F.shiftrightunsigned(seed, shift).bitwiseAND(F.lit(63).cast("long")).cast("int")


def _cell(seed: Column) -> Column:
    return seed.bitwiseAND(F.lit(TABLE_WORDS - 1).cast("long")).cast("int")


def _seed_rows(df: DataFrame, key: str, hashes: str, masks=MASKS, test=None) -> DataFrame:
    """``key``, pos (from 0), mask and seed for every word position and every mask whose seed passes ``test``.

    The words of a mask are fields of the exploded element, so that a row holds these words and not the whole text's.
    """
    fields = [F.slice(hashes, k + 1, F.greatest(F.size(hashes) - k, F.lit(0))).alias(f"w{k}") for k in range(max(mask[-1] for mask in masks) + 1)]
    words = df.select(key, F.posexplode(F.arrays_zip(*fields)).alias("pos", "w")).select(key, "pos", "w.*")
    seeds = [_seed(mask, lambda k: F.col(f"w{k}")) for mask in masks]
    if test is not None:
        seeds = [F.when(test(seed), seed) for seed in seeds]
        words = words.filter(reduce(or_, [seed.isNotNull() for seed in seeds]))
    pairs = [F.struct(F.lit(m).alias("mask"), seed.alias("seed")) for m, seed in enumerate(seeds)]
    return words.select(key, "pos", F.inline(F.array(*pairs))).filter(F.col("seed").isNotNull())


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item with a leak: doc_id, item_id, first_word and last_word (positions in the
    document's words of the first and behind the last leaked window) and best (equal words of the best window).

    Whole texts are searched. Null and empty texts have no words. Of an item of fewer than WINDOW words all must stand in
    a row, so a short item of common words is found in many documents. Rows that share a doc_id (or item_id) are reported together. Empty tables give no rows; other
    columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", F.col("text").cast("string").alias("__text"))

    def hashed(df):
        return pinned(df, {"h": word_hashes(F.col("__text"))}).drop("__text").filter(F.size("h") > 0)

    items = staged(hashed(benchmark.select("item_id", F.col("text").cast("string").alias("__text"))).withColumnRenamed("h", "b"))
    short = sorted(row.n for row in items.select(F.size("b").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # below WINDOW
    whole = [tuple(range(n)) for n in short]
    item_seeds = _seed_rows(items.filter(F.size("b") >= WINDOW), "item_id", "b")
    for mask in whole:
        item_seeds = item_seeds.union(_seed_rows(items.filter(F.size("b") == len(mask)), "item_id", "b", [mask])
                                      .withColumn("mask", F.lit(len(MASKS) + whole.index(mask))))
    item_seeds = staged(item_seeds.withColumnRenamed("pos", "item_pos"))
    # The bit table: one array of TABLE_WORDS longs, read as a scalar.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("seed")))
    cells = item_seeds.groupBy(_cell(F.col("seed")).alias("id")).agg(F.bit_or(bit).alias("bits"))
    table = staged(spark.range(0, TABLE_WORDS, 1, 1).select(F.col("id").cast("int").alias("id")).join(cells, "id", "left")
                   .agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("t"))
                   .select(F.col("t.bits").alias("t"))).scalar()
    known = lambda seed: F.getbit(F.get(table, _cell(seed)), _bit(seed)) == 1

    # Hits: where a document and an item share a seed.
    hits = staged(_seed_rows(hashed(texts), "doc_id", "h", [*MASKS, *whole], known).join(item_seeds, ["mask", "seed"])
                  .select(F.col("doc_id").alias("hit_doc"), "item_id", "pos", "item_pos").distinct())
    # Their documents are read once more for the words around the hits.
    wanted = size_checked(staged(hits.select("hit_doc").distinct()))
    words = hashed(texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["hit_doc"]), "left_semi"))
    low = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
    around = F.slice("h", low + 1, F.lit(2 * WINDOW))
    hits = (words.join(size_checked(hits), F.col("doc_id").eqNullSafe(F.col("hit_doc")))
            .select("doc_id", "item_id", "pos", "item_pos", F.size("h").alias("n_words"), low.alias("low"), around.alias("around"))
            .join(items, "item_id"))

    # A window starts at s (document word) and at s - shift in the item.
    shift = F.col("pos") - F.col("item_pos")
    width = F.least(F.size("b"), F.lit(WINDOW))
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0), shift)
    last = F.least(F.col("pos"), F.col("n_words") - width, F.size("b") - width + shift)
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def matches(s: Column) -> Column:
        return F.aggregate(F.sequence(s, s + (width - 1)), F.lit(0), lambda total, p: total + (
            F.get("around", p - F.col("low")) == F.get("b", p - F.col("pos") + F.col("item_pos"))).cast("int"))

    windows = F.filter(F.transform(starts, lambda s: F.struct(s.alias("s"), matches(s).alias("m"))), lambda w: w.m >= F.when(width < WINDOW, width).otherwise(MATCHES))
    return (pinned(hits, {"windows": windows}).filter(F.size("windows") > 0)
            .groupBy("doc_id", "item_id")
            .agg(F.min(F.array_min("windows.s")).alias("first_word"), F.max(F.array_max("windows.s") + width).alias("last_word"),
                 F.max(F.array_max("windows.m")).alias("best")))


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no leak was found, with all columns, whatever their names; those that share a doc_id with a
    leak go, a null doc_id included. Null and empty texts stay, repeated rows stay or go together."""
    leaked = size_checked(staged(find_leaks(documents, benchmark).select(F.col("doc_id").alias("__leaked")).distinct()))
    return documents.join(leaked, documents["doc_id"].eqNullSafe(leaked["__leaked"]), "left_anti")
