"""A stated query set against all vectors, in blocks: what exact and approximate search share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks

#: Vectors of a block, and queries of a group, about.
BLOCK, GROUP = 4096, 16_384


def sound(column: str = "embedding", *, zero: bool = True) -> Column:
    """Whether a vector is there, with components that are all finite numbers (and, unless ``zero``, not all 0)."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & (F.lit(zero) | F.exists(v, lambda x: x != 0)), F.lit(False))


def _up_to(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def matrix(table: pa.Table, column: str = "embedding") -> np.ndarray:
    """A column of equally long vectors as a matrix of doubles."""
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def distinct(ids: np.ndarray, rows: np.ndarray, copies: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Each id once, with its smallest vector; of equal vectors the ``copies`` smallest ids."""
    order = np.lexsort((*rows.T[::-1], ids))
    order = order[np.r_[True, np.diff(ids[order]) != 0]] if len(order) else order
    ids, rows = ids[order], rows[order]
    if copies is not None and len(ids):
        _, group = np.unique(rows, axis=0, return_inverse=True)
        by = np.lexsort((ids, group.ravel()))
        start = np.flatnonzero(np.r_[True, np.diff(group.ravel()[by]) != 0])
        nth = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
        keep = np.sort(by[nth < copies])
        ids, rows = ids[keep], rows[keep]
    return ids, rows


def search(vectors: DataFrame, queries: DataFrame, total: int, asked: int, within: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], *, k: int, score: str, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Each query's ``k`` best rows of all blocks: query_id, rank, vec_id, score.

    ``within(query_ids, queries, vec_ids, vectors)`` finds them in one block. A vector goes to a block by the hash
    of its id, so equal vectors are spread; a group of queries meets each block of its dimension once.
    """
    stripes, groups = blocks(total, block), blocks(asked, group)
    size = F.size("embedding").alias("dim")
    data = vectors.select("vec_id", "embedding", size, F.pmod(F.xxhash64("vec_id"), F.lit(stripes)).alias("stripe"), F.explode(_up_to(groups)).alias("part"))
    asks = queries.select("vec_id", "embedding", size, F.explode(_up_to(stripes)).alias("stripe"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).alias("part"))
    kind = pa.int64() if score == "long" else pa.float64()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(left) and len(right):
            own = distinct(right.column("vec_id").to_numpy(), matrix(right), None)
            found = within(*own, *distinct(left.column("vec_id").to_numpy(), matrix(left), k + 1))
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2]).cast(kind)})

    keys = ("dim", "stripe", "part")
    best = data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
