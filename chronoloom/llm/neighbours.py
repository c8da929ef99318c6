"""Nearest neighbours by collision-counting hashing with query-centred windows.

Vectors are scaled to length one and projected on ``PROJECTIONS`` random lines; each line keeps its projections
in a sorted array, cut into ``PAGES`` pages. A query opens a window around its own projection on every line, ``WINDOW``
times the radius wide to either side and rounded up to whole pages, and widens all of them (virtual rehashing: the arrays
stay, only the width changes). A vector that falls in the windows of at least ``THRESHOLD`` of the lines is verified by its
exact cosine. The search begins at the smallest radius at which enough vectors pass and ends when k verified vectors
lie within the radius: nearly every vector so near has then been counted. The last window is the whole line.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

PROJECTIONS = 128
#: Half a window, in radii: a vector at distance R is in it on 87 % of the lines, one of 1.3 R on 75 %.
WINDOW = 1.5
#: Share of the lines on which a vector must collide; three of four vectors at distance R do, and nearer ones more often.
THRESHOLD = 0.85
#: Pages of a sorted array; a page number is one byte.
PAGES = 255
GROWTH = 1.06
LEVELS = 54
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
SEED = 42


def usable(vector: Column) -> Column:
    """True for vectors of finite components that are not all zero; false for null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def radius_of(level: int) -> float:
    """Radii grow up to 2, the largest distance of two unit vectors; the last is without bound."""
    return 2.0 * GROWTH ** (level - LEVELS) if level <= LEVELS else math.inf


class CollisionIndex:
    """The sorted projections of a block of unit vectors, as the page of each vector on each line."""

    def __init__(self, units: np.ndarray):
        self.lines = np.random.default_rng(SEED).standard_normal((units.shape[1], PROJECTIONS))
        placed = np.ascontiguousarray((units @ self.lines).T)
        n = units.shape[0]
        order = np.argsort(placed, axis=1, kind="stable")
        page = (np.arange(n) * PAGES // n).astype(np.uint8)
        self.pages = np.empty((PROJECTIONS, n), np.uint8)
        np.put_along_axis(self.pages, order, np.broadcast_to(page, order.shape), axis=1)
        in_order = np.take_along_axis(placed, order, axis=1)
        starts = np.flatnonzero(np.diff(page, prepend=-1))
        self.first, self.last = in_order[:, starts], in_order[:, np.append(starts[1:], n) - 1]
        self.number = page[starts].astype(np.int64)
        self.need = math.ceil(THRESHOLD * PROJECTIONS)
        self.room = np.empty_like(self.pages)

    def colliding(self, point: np.ndarray, radius: float) -> np.ndarray:
        """Places of the vectors that fall in enough windows of that radius."""
        low = (self.last < (point - WINDOW * radius)[:, None]).sum(axis=1)
        high = (self.first <= (point + WINDOW * radius)[:, None]).sum(axis=1) - 1
        some = low <= high
        width = np.where(some, self.number[np.maximum(high, 0)] - self.number[np.minimum(low, len(self.number) - 1)] + 1, 0)
        np.subtract(self.pages, self.number[np.minimum(low, len(self.number) - 1)].astype(np.uint8)[:, None], out=self.room)
        hit = np.less(self.room, width.astype(np.uint8)[:, None])
        return np.flatnonzero(np.add.reduce(hit.view(np.uint8), axis=0, dtype=np.uint8) >= self.need)


def balanced(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that takes its largest component to between 0.5 and 1.

    Squares neither vanish nor overflow then, and as only exponents change, cosines of other rows stay the same to the last bit.
    """
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, verified: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, score) of up to k nearest of a block for each query, ties to smaller ids.

    :param verified: takes how many vectors each query verified.
    """
    vectors, queries = balanced(vectors), balanced(queries)
    sizes, lengths = np.sqrt((vectors**2).sum(axis=1)), np.sqrt((queries**2).sum(axis=1))
    index = CollisionIndex(vectors / sizes[:, None])
    points = (queries / lengths[:, None]) @ index.lines
    out, level = [], LEVELS // 2
    for q, point in enumerate(points):
        # The query itself may be in the block, so k + 1 must pass; the search starts from where the last one began.
        enough = lambda at: len(index.colliding(point, radius_of(at))) > k  # noqa: B023, E731
        level = min(level, LEVELS)
        if enough(level):
            while level > 0 and enough(level - 1):
                level -= 1
        else:
            while level <= LEVELS and not enough(level := level + 1):
                pass
        seen, best, scores = np.zeros(len(ids), bool), np.empty(0, np.int64), np.empty(0)
        for at in range(level, LEVELS + 2):
            radius = radius_of(at)
            fresh = index.colliding(point, radius)
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            fresh = fresh[ids[fresh] != query_ids[q]]
            if len(fresh):
                exact = (vectors[fresh] * queries[q]).sum(axis=1) / (sizes[fresh] * lengths[q])
                best, scores = np.concatenate([best, fresh]), np.concatenate([scores, exact])
                top = np.lexsort((ids[best], -scores))[:k]
                best, scores = best[top], scores[top]
            if len(best) == k and scores[-1] >= 1 - radius**2 / 2:
                break
        if verified is not None:
            verified.append(int(seen.sum()))
        out.append((np.full(len(best), q), best, scores))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query by cosine, nearest first, ties to smaller ids.

    :param block_rows, query_rows: about so many vectors and queries meet in a task; every block of vectors is
        indexed by itself and gives its k best, of which the best k stay.

    A query never finds rows of its own id. Vectors and queries that are null, empty, all zero or hold a null or
    non-finite component take no part; a query is only compared with vectors of its length. Rows that repeat id and
    vector count once. An empty table gives an empty result. Other columns are ignored.
    """
    clean = lambda df: df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).dropDuplicates(["id", "v"])
    base = materialize(clean(vectors), "neighbour-vectors")
    asked = materialize(clean(queries), "neighbour-queries")
    spread = lambda df, rows: max(1, math.ceil(df.count() / rows))
    blocks, shares = spread(base, block_rows), spread(asked, query_rows)
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select(F.size("v").alias("d"), place(blocks).alias("b"), every(shares).alias("s"), "id", "v")
    right = asked.select(F.size("v").alias("d"), every(blocks).alias("b"), place(shares).alias("s"), "id", "v")

    def search(block: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(block) or not len(questions):
            return pd.DataFrame({n: pd.Series(dtype=t) for n, t in zip(names, ("int64", "int64", "float64"), strict=True)})
        ids, query_ids = block["id"].to_numpy(), questions["id"].to_numpy()
        q, v, score = search_block(np.stack(block["v"]), ids, np.stack(questions["v"]), query_ids, k)
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[v], "score": score})

    found = left.groupBy("d", "b", "s").cogroup(right.groupBy("d", "b", "s")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
