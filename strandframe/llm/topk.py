"""Exact top-k inner products by the three-phase uniform threshold algorithm over blocks of dimensions.

A query's score of a vector is the sum of LISTS local scores, one per block of dimensions. Local scores are counted
from the least of their list, so all are 0 or more:

1. every list gives its k highest local scores; the k-th highest partial sum is a lower bound t of the k-th score;
2. with the safe cutoff t / LISTS sent to all, every entry with a local score of at least that is collected: a vector
   with none has a sum below t; partial sums of the entries raise the bound, and vectors whose sum, with the cutoff in
   place of what is missing, stays below it are dropped;
3. the missing local scores of the rest are looked up and the exact sums ranked.

Queries and vectors meet in blocks of bounded size; each block pair is scored by matrix products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LISTS = 4
QUERY_BLOCK, VECTOR_BLOCK, LEAST_BLOCKS = 512, 4096, 24


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component); vectors null or with a null or non-finite component go."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(x.isNotNull() & ~bad & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are padded with zeros. Doubles, as long as sums are exact in them."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(array.offsets.to_numpy())
    flat = array.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(array), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    top = np.abs(flat).max(initial=0)
    return out.astype(np.float64) if float(top) ** 2 * width < 2.0**52 else out


def _blocks(width: int) -> list[slice]:
    edges = np.linspace(0, width, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _locals(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(lists, queries, vectors) of local scores, exact integers."""
    if q.dtype != v.dtype:
        q, v = q.astype(np.int64), v.astype(np.int64)
    return np.stack([(q[:, b] @ v[:, b].T) for b in _blocks(q.shape[1])]).astype(np.int64)


def _highest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of each row, ties to smaller ids: all that could be among them."""
    order = np.lexsort((ids, -scores))
    return order[:k]


def _first(width: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("row", pa.int64()), ("score", pa.int64()), ("least", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        q_ids, v_ids, v_rows = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), right["row"].to_numpy()
        local = _locals(_matrix(left["x"], width), _matrix(right["x"], width))
        rows = [[], [], [], [], []]
        own = q_ids[:, None] == v_ids[None, :]
        for b in range(LISTS):
            seen = np.where(own, np.iinfo(np.int64).min, local[b])
            top = np.argpartition(-seen, min(k, seen.shape[1]) - 1, axis=1)[:, :k]
            score = np.take_along_axis(seen, top, 1)
            keep = score != np.iinfo(np.int64).min
            least = local[b].min(axis=1)
            at = np.nonzero(keep)
            for column, x in zip(rows, (q_ids[at[0]], np.full(len(at[0]), b), v_rows[top[at]], score[at], least[at[0]]), strict=True):
                column.append(x)
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(rows, schema, strict=True)], schema=schema)

    return run, "query_id long, list int, row long, score long, least long"


def _second(width: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        q_ids, v_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        local = _locals(_matrix(left["x"], width), _matrix(right["x"], width))
        lows = np.stack(left["lows"].combine_chunks().flatten().to_numpy().reshape(len(left), LISTS).T)  # (lists, queries)
        bound = left["bound"].to_numpy()
        rows = [[], [], []]
        for i in range(len(q_ids)):
            others = np.nonzero(v_ids != q_ids[i])[0]
            above = local[:, i, others] - lows[:, i, None]
            cutoff = -(-int(bound[i]) // LISTS)
            entry = above >= cutoff
            held = entry.any(axis=0)  # phase 2: vectors with an entry
            above, entry, others = above[:, held], entry[:, held], others[held]
            if not len(others):
                continue
            partial = np.where(entry, above, 0).sum(axis=0)
            best = int(bound[i])
            if len(partial) >= k:
                best = max(best, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            alive = np.where(entry, above, max(cutoff, 0)).sum(axis=0) >= best
            exact, names = local[:, i, others[alive]].sum(axis=0), v_ids[others[alive]]  # phase 3
            top = _highest(exact, names, k)
            for column, x in zip(rows, (np.full(len(top), q_ids[i]), names[top], exact[top]), strict=True):
                column.append(x)
        if not rows[0]:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(rows, schema, strict=True)], schema=schema)

    return run, "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with vectors of other ids.

    Both have (vec_id, x array<long>). All of k or fewer candidates are returned; ties go to the smaller vec_id. Of
    rows with one id, each is a candidate, and queries of one id are one (that of the least vector). Shorter vectors
    count as padded with zeros. No queries or no candidates give no rows.
    """
    spark = vectors.sparkSession
    vectors = staged(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")  # rows may share an id
    queries = staged(queries.groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    n, width = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    n_queries, q_width = queries.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, q_width, LISTS)
    v_blocks = max(LEAST_BLOCKS, math.ceil(n / VECTOR_BLOCK))
    q_blocks = math.ceil(n_queries / QUERY_BLOCK)
    block = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")
    spread = lambda df, own, other, m: df.withColumn(own[0], block(own[1], 1)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = spread(vectors, ("vb", v_blocks), "qb", q_blocks).groupBy("qb", "vb")
    left = lambda q: spread(q, ("qb", q_blocks), "vb", v_blocks).groupBy("qb", "vb")
    run, schema = _first(width, k)
    lists = left(queries.select("vec_id", "x")).cogroup(right).applyInArrow(run, schema)
    # the k highest of each list, by a window that drops the rest before its shuffle
    rank = F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "row"))
    lists = staged(lists, "lists")
    least = lists.groupBy("query_id", "list").agg(F.min("least").alias("least"))
    top = lists.withColumn("r", rank).where(F.col("r") <= k).join(least.withColumnRenamed("least", "low"), ["query_id", "list"])
    sums = top.groupBy("query_id", "row").agg(F.sum(F.col("score") - F.col("low")).alias("partial"))
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("partial"), "row"))
    bounds = sums.withColumn("r", kth).where(F.col("r") == k).select("query_id", F.col("partial").alias("bound"))
    lows = least.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("list", "least"))), lambda e: e["least"]).alias("lows"))
    # a query with fewer than k candidates seen has no bound: every entry is collected
    armed = staged(queries.join(lows.join(bounds, "query_id", "left").withColumnRenamed("query_id", "vec_id"), "vec_id").select(
        "vec_id", "x", "lows", F.coalesce("bound", F.lit(0)).cast("long").alias("bound")), "cutoffs")
    run, schema = _second(width, k)
    found = left(armed).cogroup(right).applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
