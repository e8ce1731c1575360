"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks by a hash of their id, queries into groups; each (block, group) cell holds a bounded
number of vectors. In a cell every dimension's list is sorted once. For a query, lists are read in step from their best
end (the low end where the query's component is negative); each id seen first is scored in full; reading stops once the
bound, the sum of the query's components times the values at the lists' fronts, is below the kth score. The k best of
every cell are ranked together afterwards, so the result is exact.

Defined cases: vectors that are null, or hold null, NaN or infinity, take no part, nor do rows without an id; an empty
vector counts as all zeros, and a shorter vector as padded with zeros; rows that repeat an id and a vector count once,
those that repeat an id with other vectors each; ties go to the smaller id; scores beyond the long range stop at its ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS, SCALE, DEPTH = 8192, 8192, 1024, 32


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Integer components floor(SCALE * x), padded with zeros; Python integers when products could leave a long."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * SCALE)
    if out.size and np.abs(out).max() ** 2 * dim >= 2.0**52:
        return np.array([[int(x) for x in row] for row in out], dtype=object).reshape(out.shape)
    return out


class Lists:
    """Sorted lists of every dimension over a block of vectors; ``scored`` counts the vectors scored in full."""

    def __init__(self, ids: np.ndarray, block: np.ndarray) -> None:
        self.ids, self.block, self.scored = ids, block, 0
        self.order = np.argsort(block, axis=0, kind="stable").T.copy() if len(ids) else np.zeros((block.shape[1], 0), int)
        self.values = np.take_along_axis(block.T, self.order, 1)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best other than query_id, best first, ties to the smaller id."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        at, step = 0, DEPTH
        while at < n:
            to = min(n, at + step)
            new = np.zeros(n, bool)
            new[self.order[up, n - to : n - at].ravel()] = True
            new[self.order[down, at:to].ravel()] = True
            if not len(up) and not len(down):
                new[:], to = True, n
            new &= ~seen
            seen |= new
            fresh = np.flatnonzero(new)
            self.scored += len(fresh)
            fresh = fresh[self.ids[fresh] != query_id]
            ids, scores = np.concatenate([best_ids, self.ids[fresh]]), np.concatenate([best, self.block[fresh] @ q])
            if len(ids) > 4 * k and q.dtype != object:
                keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[keep], scores[keep]
            first = np.lexsort((ids, -scores))[:k] if q.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=int)
            best_ids, best = ids[first], scores[first]
            if len(best) == k and to < n:
                bound = self.values[up, n - to] @ q[up] + self.values[down, to - 1] @ q[down]
                if bound < best[-1]:
                    break
            at, step = to, step * 2
        return best_ids, best


def cell(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            once = lambda d: d.assign(__t=d["vec"].map(tuple)).sort_values(["id", "__t"], kind="stable").drop_duplicates(["id", "__t"])
            candidates, queries = once(candidates), once(queries)
            dim = max(1, int(candidates["vec"].map(len).max()), int(queries["vec"].map(len).max()))
            both = matrix(pd.concat([candidates["vec"], queries["vec"]]), dim)
            lists = Lists(candidates["id"].to_numpy(np.int64), both[: len(candidates)])
            for q_id, q in zip(queries["id"], both[len(candidates) :], strict=True):
                ids, scores = lists.top(q_id, q, k)
                out += [(q_id, int(i), int(min(max(int(s), -(1 << 63)), (1 << 63) - 1))) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(v.isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best vectors with another id."""
    everything, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    blocks, groups = max(1, -(-everything.count() // block_rows)), max(1, -(-asked.count() // query_rows))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = everything.withColumn("b", deal(blocks)).withColumn("g", spread(groups))
    right = asked.withColumn("g", deal(groups)).withColumn("b", spread(blocks))
    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(cell(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
