"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each block go to each shard is drawn first (exactly, so that all shard sizes come out as planned), then
rows are permuted within their block, dealt out by these counts, and permuted again within their shard. Every assignment
of rows to places is equally likely, and no task sees more than its block or one slice of a shard.

Only DataFrame functions are used. A draw inverts the distribution function outward from the mode with the ratio of
neighbouring probabilities, so it takes a number of steps that grows with the standard deviation, not with the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorepix.functions.staging import pinned
from shorepix.llm.store import fresh, staged

#: Blocks that one node of the draw splits its rows among.
FAN_OUT = 32
#: Rows that one task permutes within a shard.
SLICE_ROWS = 4_096


def _uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) with 53 bits, fixed by ``parts``."""
    lits = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    return F.shiftrightunsigned(F.xxhash64(*lits), 11) / F.lit(float(1 << 53))


def hypergeometric(total: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` rows out of ``total`` are among the ``good`` ones, for a uniform number.

    Outcomes are tried in the order mode, mode + 1, mode - 1, ... up to twelve standard deviations and 30 steps away; what
    lies beyond has a probability below the resolution of the uniform number.
    """
    n, k, d = total.cast("double"), good.cast("double"), drawn.cast("double")
    rest = n - k - d
    mode = F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")
    low, high = F.greatest(F.lit(0.0), -rest), F.least(k, d)
    mode = F.least(F.greatest(mode, low), high)
    spread = F.sqrt(F.greatest(d * k / n * (n - k) / n * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    reach = F.ceil(12 * spread + 30).cast("int")
    steps = F.sequence(F.lit(1), reach)
    def state(up, down, mass, found):
        return F.struct(up.alias("up"), down.alias("down"), mass.alias("mass"), found.alias("found"))

    def one_step(s, i, target):
        """Weights (relative to the mode) of mode + i and mode - i, their running sum, and the outcome once it is reached."""
        a, b = mode + i - 1, mode - i + 1
        up = F.when(a < high, s.up * (k - a) * (d - a) / ((a + 1) * (rest + a + 1))).otherwise(0.0)
        down = F.when(b > low, s.down * b * (rest + b) / ((k - b + 1) * (d - b + 1))).otherwise(0.0)
        found = F.when(s.found.isNotNull(), s.found)
        if target is not None:
            found = (found.when(s.mass + up > target, a + 1).when(s.mass + up + down > target, b - 1))
        return state(up, down, s.mass + up + down, found)

    start = state(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"))
    mass = F.aggregate(steps, start, lambda s, i: one_step(s, i, None), lambda s: s.mass)
    # The sum is bound once by the single element of an array, so that each step does not add it up again.
    return F.element_at(F.transform(F.array(mass), lambda m: F.when(uniform * m <= 1, mode).otherwise(F.coalesce(
        F.aggregate(steps, start, lambda s, i: one_step(s, i, uniform * m), lambda s: s.found), mode))), 1).cast("long")


def _split(quota: Column, sizes: Column, seed: Column) -> Column:
    """Quotas of the children of a node: for each child, how many rows of each shard; children are drawn one by one, each
    from what the earlier ones left, shard by shard."""
    def shard(s, j, child, size):
        draw = F.when(s.rows == 0, F.lit(0).cast("long")).otherwise(
            hypergeometric(s.rows, F.element_at(child.left, j), s.open, _uniform(seed, size.at, j)))
        return F.transform(F.array(draw), lambda drawn: F.struct(
            (s.rows - F.element_at(child.left, j)).alias("rows"), (s.open - drawn).alias("open"),
            F.concat(s.out, F.array(drawn)).alias("out")))[0]

    def one_child(s, size):
        total = F.aggregate(s.left, F.lit(0).cast("long"), lambda a, b: a + b)
        start = F.struct(total.alias("rows"), size.n.alias("open"), F.array().cast("array<long>").alias("out"))
        drawn = F.aggregate(F.sequence(F.lit(1), F.size(quota)), start, lambda t, j: shard(t, j, s, size), lambda t: t.out)
        return F.transform(F.array(drawn), lambda out: F.struct(
            F.zip_with(s.left, out, lambda a, b: a - b).alias("left"),
            F.concat(s.done, F.array(out)).alias("done")))[0]

    start = F.struct(quota.alias("left"), F.array().cast("array<array<long>>").alias("done"))
    return F.aggregate(sizes, start, one_child, lambda s: s.done)


def communication_matrix(blocks: DataFrame, quotas: list[int], seed: int = 0) -> DataFrame:
    """(block, quota array<long>): how many rows of each block go to each shard, drawn at random so that block sums are
    the block sizes and shard sums are ``quotas``. ``blocks``: (block, n), block numbers from 0, gaps count as empty.

    The draw runs down a tree over the blocks: a node's quotas are split among its children, level by level, so its
    depth is the logarithm of the number of blocks and a level is one join.
    """
    last = blocks.agg(F.max("block")).first()[0]
    depth = 1
    while FAN_OUT ** depth <= (last or 0):
        depth += 1
    spark = blocks.sparkSession
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("block"), F.array(*[F.lit(int(q)).cast("long") for q in quotas]).alias("quota"))
    for level in range(depth):
        below = FAN_OUT ** (depth - level - 1)
        child = F.floor(F.col("block") / below).cast("long")
        sizes = (blocks.groupBy(child.alias("child")).agg(F.sum("n").alias("n"))
                 .groupBy(F.floor(F.col("child") / FAN_OUT).cast("long").alias("block"))
                 .agg(F.sort_array(F.collect_list(F.struct(F.col("child").alias("at"), "n"))).alias("sizes")))
        split = pinned(nodes.join(sizes, "block"), {"parts": _split(F.col("quota"), F.col("sizes"), F.lit(seed * 64 + level))})
        nodes = (split.select(F.explode(F.arrays_zip("sizes", "parts")).alias("c"))
                 .select(F.col("c.sizes.at").alias("block"), F.col("c.parts").alias("quota")))
    return nodes


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``rows`` plus ``shard`` (int, 0 .. shards - 1) and ``slot`` (long, gapless from 0 within each shard), uniformly at
    random for the given seed; shard sizes differ by at most one row, the first shards being the larger ones.

    Any columns, nulls and repeated rows included: each row gets a place of its own. An empty table stays empty; with
    fewer rows than shards some shards are empty. The rows are written once to the shared folder with their block and
    their place in it, so counting and dealing see the same blocks even if executors are lost.
    """
    fresh(rows, "shard", "slot")
    names = [F.col(f"`{name}`") for name in rows.columns]
    # The first permutation: the order of each block is that of a hash of the row's position. The id holds block and rank.
    marked = rows.withColumn("__key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).sortWithinPartitions("__key")
    ids = F.monotonically_increasing_id()
    placed = staged(marked.drop("__key").select(*names, F.shiftrightunsigned(ids, 33).alias("__block"),
                                                 ids.bitwiseAND(F.lit((1 << 33) - 1)).alias("__rank")))
    blocks = placed.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n"))
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    slices = max(1, -(-max(quotas) // SLICE_ROWS))
    # One row per block with the rank that each shard's share begins at.
    deal = staged(communication_matrix(blocks, quotas, seed).select(F.col("block").alias("__block"), F.aggregate(
        "quota", F.array(F.lit(0).cast("long")), lambda a, q: F.concat(a, F.array(F.element_at(a, -1) + q))).alias("__begins")))
    shard = F.size(F.filter("__begins", lambda b: b <= F.col("__rank"))) - 1
    # Empty shares begin where the next one does, so the last beginning at or below the rank names the shard.
    key = F.xxhash64(F.lit(seed + 1), "__block", "__rank")
    slice_of = F.pmod(F.shiftrightunsigned("__key", 20), F.lit(slices)).cast("int")
    dealt = (placed.join(deal, "__block").withColumns({"shard": shard.cast("int"), "__key": key})
             .withColumn("__slice", slice_of))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (dealt.groupBy("shard", "__slice").agg(F.count("*").alias("__n"))
             .select("shard", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")))
    # The second permutation: slices of a shard in order, rows of a slice in the order of their key.
    rank = F.row_number().over(Window.partitionBy("shard", "__slice").orderBy("__key", "__block", "__rank")) - 1
    return (dealt.withColumn("__in", rank).join(bases, ["shard", "__slice"])
            .select(*names, "shard", (F.col("__base") + F.col("__in")).cast("long").alias("slot")))
