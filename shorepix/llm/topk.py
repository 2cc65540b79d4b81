"""Exact top-k inner-product search with a pivot table.

Vectors become integers floor(scale * x). A table, made once, holds the distance of every vector to the origin and to many
pivots. In Euclidean space these distances fix the part of a vector inside the span of the pivots and the length of the
part outside it, so the largest lower bound of d(q, y) that they allow (never below any |d(q, p) - d(y, p)|) is reached when
both outside parts point the same way. With d(q, y)^2 = |q|^2 + |y|^2 - 2 <q, y> that is an upper bound of the score:
<inside q, inside y> + |outside q| |outside y|. A query takes the vectors in the order of this bound and stops once it falls
below the score of its k-th best, which no later vector can beat.

Vectors lie in blocks. Each query first searches one block; the score of its k-th best there is where it starts in all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shorepix.llm.store import staged

#: Pivots, and the rows with the smallest hashes that they are chosen from.
PIVOTS, SAMPLE = 48, 4_096
BLOCK = 8_192
QUERY_BLOCK = 8_192
#: Candidates taken at a time, and queries whose bounds are held at once.
STEP, ROWS = 64, 128
#: Rounding of the bounds, as a part of the product of the norms: far above their error.
SLACK = 1e-5
FOUND = "query_id long, id long, score long"


def integer_matrix(vectors, scale: float) -> np.ndarray:
    return np.floor(np.stack([np.asarray(v, np.float64) for v in vectors]) * scale)


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """The longest row, then always the row farthest from the span of those chosen, until the others lie in the span."""
    rest, chosen = np.array(points, np.float64), []
    least = 1e-6 * (rest ** 2).sum(1).max(initial=0)
    while len(chosen) < min(count, len(points)):
        far = (rest ** 2).sum(1)
        at = int(far.argmax())
        if far[at] <= least:
            break
        unit = rest[at] / np.sqrt(far[at])
        rest -= np.outer(rest @ unit, unit)
        chosen.append(at)
    return np.asarray(points, np.float64)[chosen]


def distance_table(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distances of each vector to the origin and to each pivot."""
    square = (vectors ** 2).sum(1)
    to = square[:, None] + (pivots ** 2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.sqrt(np.column_stack([square, np.maximum(to, 0)]))


def inside_and_outside(table: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the distances of each vector: its coordinates in the span of the pivots and the length of its part outside."""
    square = table[:, 0] ** 2
    if not len(pivots):
        return np.zeros((len(table), 0)), table[:, 0]
    products = (square[:, None] + (pivots ** 2).sum(1)[None] - table[:, 1:] ** 2) / 2
    inside = np.linalg.solve(np.linalg.cholesky(pivots @ pivots.T), products.T).T
    return inside, np.sqrt(np.maximum(square - (inside ** 2).sum(1), 0))


def is_exact(top: float, width: int) -> bool:
    """Whether sums of products of integers up to ``top`` are exact in doubles."""
    return top * top * width * 4 < 2 ** 53


def block_top_k(query_ids, queries, floors, ids, vectors, table, pivots, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query_id, id, score) of the k best of this block per query, without those below the query's floor, and how many
    inner products were taken. Vectors and queries hold integers as doubles."""
    inside, outside = inside_and_outside(table, pivots)
    q_inside, q_outside = inside_and_outside(distance_table(queries, pivots), pivots)
    slack = SLACK * (1 + table[:, 0].max(initial=0) * np.sqrt((queries ** 2).sum(1)))
    rows, taken = [], 0
    for low in range(0, len(queries), ROWS):
        bounds = q_inside[low:low + ROWS] @ inside.T + np.outer(q_outside[low:low + ROWS], outside)
        for at, bound in enumerate(bounds, low):
            candidates = np.flatnonzero(bound >= floors[at] - slack[at])
            order = candidates[np.argsort(-bound[candidates], kind="stable")]
            best_scores, best_ids = np.zeros(0), np.zeros(0, np.int64)
            for first in range(0, len(order), STEP):
                some = order[first:first + STEP]
                if len(best_ids) == k and bound[some[0]] < best_scores[-1] - slack[at]:
                    break
                scores, some_ids = vectors[some] @ queries[at], ids[some]
                taken += len(some)
                use = (some_ids != query_ids[at]) & (scores >= floors[at])
                scores, some_ids = np.append(best_scores, scores[use]), np.append(best_ids, some_ids[use])
                keep = np.lexsort((some_ids, -scores))[:k]
                best_scores, best_ids = scores[keep], some_ids[keep]
            rows += [(int(query_ids[at]), int(i), int(s)) for i, s in zip(best_ids, best_scores, strict=True)]
    return rows, taken


def _all_products(query_ids, queries, ids, vectors, k: int) -> list[tuple[int, int, int]]:
    """The same by Python integers, for values whose products doubles cannot hold."""
    whole, rows = [[int(x) for x in v] for v in vectors], []
    for query_id, q in zip(query_ids.tolist(), queries, strict=True):
        q = [int(x) for x in q]
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in zip(ids.tolist(), whole, strict=True) if i != query_id)
        rows += [(query_id, i, -s) for s, i in scores[:k]]
    return rows


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(rows, -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding",
          scale: float = 256.0, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k highest inner products per query, ties to the smaller id.

    A vector that is null, empty or holds a null or non-finite component takes no part, nor does one with a null id. Only
    vectors of the same length are compared. A query is not compared with rows of its own id; repeated rows of another id
    count as often as they come. Of queries that share an id the smallest vector asks. Other columns are ignored. Empty
    tables give no rows; a query with fewer than k others gets them all. Scores that 64 bits cannot hold raise.

    Pivots come from the SAMPLE rows with the smallest hashes; which they are decides how much is skipped, not what is
    found. Vectors and queries are dealt to blocks by a hash, and no key of the data decides the size of a group: about
    ``block`` vectors and at most ``query_block`` queries.
    """
    def usable(df):
        value = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return (df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), value.alias("vector"))
                .filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.coalesce(bad, F.lit(False)))
                .withColumn("width", F.size("vector")))

    spark, base = vectors.sparkSession, usable(vectors)
    sample = base.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).toPandas()
    chosen = spark.sparkContext.broadcast({int(width): choose_pivots(integer_matrix(some["vector"], scale), pivots)
                                           for width, some in sample.groupby("width")})

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, widths = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            rows = batch.column(1)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                values = np.floor(rows.take(pa.array(at)).flatten().to_numpy().reshape(len(at), width) * scale)
                table = distance_table(values, chosen.value.get(int(width), np.zeros((0, width))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(widths[at]), pa.array([v.tobytes() for v in values], pa.binary()),
                     pa.array([t.tobytes() for t in table], pa.binary()), pa.array(np.abs(values).max(axis=1))],
                    names=["id", "width", "vector", "table", "top"])

    def prepared(df):
        return df.select("id", "vector", "width").mapInArrow(prepare, "id long, width int, vector binary, table binary, top double")

    base = staged(prepared(base).withColumn("spread", F.xxhash64("id", F.monotonically_increasing_id())))
    asked = staged(prepared(usable(queries).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("width", F.size("vector"))).drop("table"))
    n, top = base.agg(F.count("*"), F.max("top")).first()
    asks, asked_top = asked.agg(F.count("*"), F.max("top")).first()
    parts, query_parts, top = max(1, -(-n // block)), max(1, -(-asks // query_block)), max(top or 0, asked_top or 0)

    def search(some: pa.Table, asking: pa.Table) -> pa.Table:
        rows = []
        if some.num_rows and asking.num_rows:
            ids, query_ids = some["id"].to_numpy(), asking["id"].to_numpy()
            values, wanted = _matrix(some["vector"], len(ids)), _matrix(asking["vector"], len(query_ids))
            width = values.shape[1]
            if is_exact(top, width):
                floors = asking["floor"].to_numpy()
                rows, _ = block_top_k(query_ids, wanted, floors, ids, values, _matrix(some["table"], len(ids)),
                                      chosen.value.get(width, np.zeros((0, width))), k)
            else:
                rows = _all_products(query_ids, wanted, ids, values, k)
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "id", "score"])

    base = base.withColumn("part", F.pmod("spread", F.lit(parts)).cast("int")).drop("spread", "top")
    home = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    first = asked.select("id", "width", "vector", home.alias("part"), F.lit(float("-inf")).alias("floor"))
    found = staged(base.groupBy("width", "part").cogroup(first.groupBy("width", "part")).applyInArrow(search, FOUND))
    if parts > 1:
        floors = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
        floor = F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))
        others = F.array_except(F.sequence(F.lit(0), F.lit(parts - 1)), F.array(home))
        then = (asked.join(floors, asked["id"] == floors["query_id"], "left")
                .select("id", "width", "vector", floor.alias("floor"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_parts)).cast("int").alias("query_part"),
                        F.explode(others).alias("part")))
        copies = base.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
        keys = ["width", "part", "query_part"]
        found = found.union(copies.groupBy(*keys).cogroup(then.groupBy(*keys)).applyInArrow(search, FOUND))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (found.withColumn("rank", best).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
