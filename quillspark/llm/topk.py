"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt to blocks of bounded size. A block sorts each component into a list. For a query, the list of a
component with positive weight is read from its top and one with negative weight from its bottom, all to the same depth.
What has been read gives each candidate a lower and an upper score bound (what hasn't been read lies between the list's
end and the last value read). Reading goes on until the k-th lower bound rules out all but a few
candidates; their final scores are then resolved. Queries are worked on together, so that reading to a depth is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import durable

#: Candidates of a block; queries worked on together; survivors at which reading stops.
BLOCK, ASKED, FEW = 8192, 512, 64
#: Depths of reading, as parts of the block.
DEPTHS = (0.1, 0.3, 0.6, 1.0)


class SortedLists:
    """A block's vectors, as one sorted list for each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.values = np.sort(self.vectors, axis=0)
        self.rank = np.empty(self.vectors.shape, np.int32)
        np.put_along_axis(self.rank, np.argsort(self.vectors, axis=0, kind="stable"), np.arange(len(ids), dtype=np.int32)[:, None], axis=0)

    def bounds(self, depth: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (candidates by queries) of the scores after depth entries of each list."""
        n = len(self.ids)
        top, bottom = self.rank >= n - depth, self.rank < depth
        x, v = self.vectors, self.values
        low = np.where(top, x, v[0]) @ up + np.where(bottom, x, v[-1]) @ down
        high = np.where(top, x, v[n - depth]) @ up + np.where(bottom, x, v[depth - 1]) @ down
        return low, high

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, candidate, score) of each query's k best, ties to the smaller id, candidates with the query's id left out."""
        n, found = len(self.ids), []
        weights = queries.T.astype(np.float64)
        open_ = np.arange(len(query_ids))
        for part in DEPTHS:
            if not len(open_):
                break
            w = weights[:, open_]
            low, high = self.bounds(max(1, min(n, int(np.ceil(part * n)))), np.maximum(w, 0), np.minimum(w, 0))
            own = self.ids[:, None] == query_ids[None, open_]
            low[own], high[own] = -np.inf, -np.inf
            kth = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(open_), -np.inf)
            survivors = (high >= kth) & (high > -np.inf)
            done = (survivors.sum(axis=0) <= max(FEW, 2 * k)) | (part == DEPTHS[-1])
            for j in np.flatnonzero(done).tolist():
                rows = np.flatnonzero(survivors[:, j])
                score = self.vectors[rows] @ w[:, j]
                best = np.lexsort((self.ids[rows], -score))[:k]
                found.append((np.full(len(best), open_[j]), self.ids[rows[best]], score[best].astype(np.int64)))
            open_ = open_[~done]
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector is null or has a null or non-finite component."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """Each query's k rows with the highest integer inner products among all rows but itself.

    vectors needs vec_id (integer) and embedding (array of numbers); other columns are ignored. Components x count as
    floor(scale * x). is_query picks the queries. Returns query_id, rank (from 1), vec_id and score;
    ties go to the smaller vec_id. Vectors that are null or have null or non-finite components, and rows without vec_id,
    take no part. Vectors are only compared with those of the same length. Rows that share a vec_id are each a candidate, equal ones too, but none of them
    is one for a query with that vec_id; as queries each different vector has its own ranks. A query without candidates has no rows; empty tables give
    empty results. Scores are exact while they stay below 2**53.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers("embedding", scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = durable(rows.where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("width", F.size("v")))
    blocks = max(1, -(-rows.count() // BLOCK))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")  # rows are durable, so a repeated task numbers them alike
    held = rows.select("width", block.alias("block"), F.lit(0).alias("kind"), "vec_id", F.lit(0).cast("long").alias("query"), "v")
    asked = rows.where("asks").select("width", "vec_id", F.xxhash64("v").alias("query"), "v").distinct()
    asked = asked.select("width", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "query", "v")
    dealt = held.unionAll(asked).repartition(blocks, "width", "block").sortWithinPartitions("width", "block", "kind", "vec_id", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block, a block's candidates before its queries, which are never held all at once."""
        key, kept, lists = None, [], None
        for batch in batches:
            width, block, kind, ids, query = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cuts = np.flatnonzero((np.diff(width) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                now = (int(width[a]), int(block[a]))
                v = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(b - a, now[0])
                if now != key:
                    key, kept, lists = now, [], None
                if kind[a] == 0:
                    kept.append((ids[a:b], v))
                    continue
                if lists is None and kept:
                    lists = SortedLists(*(np.concatenate(c) for c in zip(*kept, strict=True)))
                    kept = []
                for at in range(0, b - a, ASKED) if lists is not None and now[0] else ():
                    some = slice(a + at, min(b, a + at + ASKED))
                    which, *out = lists.top(ids[some], v[at : at + ASKED], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[some][which], query[some][which], *out)], names=["query_id", "query", "vec_id", "score"])

    best = dealt.mapInArrow(run, "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
