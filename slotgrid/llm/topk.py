"""Exact top-k search by term-at-a-time accumulation of inner products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

K = 5
#: Queries in one broadcast block: BLOCK vectors of 64 terms are 4 MB.
BLOCK = 8192
#: Candidates and queries scored at once; the dense score array has CANDIDATES x QUERIES cells.
CANDIDATES, QUERIES = 1024, 128


def weights(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null or non-finite component."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def _dense(column: pa.Array) -> np.ndarray:
    """Rows of integer weights as one matrix, short rows padded by zero, which adds nothing to a product."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best scores of each column, ties to the smaller id; `ids` ascend, so a row's place settles them."""
    n = len(ids)
    order = np.lexsort((np.arange(n)[:, None].repeat(scores.shape[1], 1), -scores), axis=0) if n <= k else None
    if order is not None:
        return order
    kth = -np.partition(-scores, k - 1, axis=0)[k - 1]
    sure, tied = scores > kth, scores == kth
    tied &= np.cumsum(tied, axis=0) <= k - sure.sum(axis=0)
    rows = np.nonzero((sure | tied).T)[1].reshape(scores.shape[1], k).T
    return np.take_along_axis(rows, np.argsort(-np.take_along_axis(scores, rows, 0), axis=0, kind="stable"), 0)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (candidates x queries): each term's postings (candidate, weight) are scattered, weighted by the queries that hold the term."""
    scores = np.zeros((len(candidates), len(queries)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        posting, asked = np.flatnonzero(candidates[:, term]), np.flatnonzero(queries[:, term])
        if len(posting) and len(asked):
            add = candidates[posting, term][:, None] * queries[asked, term][None, :]
            if add.size == scores.size:
                scores += add
            else:
                scores[np.ix_(posting, asked)] += add
    return scores


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest integer inner product for each query.

    Both tables take part as integer weights (see `weights`). Queries go out in broadcast blocks of
    about `block` rows, dealt by a hash of the id, one pass over the candidates each; a task keeps k
    rows a query, which a window then merges. A block's rows are written and its broadcast is dropped before the next
    block, so the driver and the tasks hold one block, whatever the number of queries. A candidate with the query's id is left out, ties go to
    the smaller id, and a query with fewer candidates has fewer rows. Vectors that are null or hold
    null or non-finite components, and rows with a null id, take no part. Repeated rows count as rows: queries
    that repeat an id share one result, that of the smallest vector under it, and no row of a query's id is its candidate. Vectors of other lengths count as padded by zero. Empty tables give no rows.
    """
    spark = vectors.sparkSession

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), weights(F.col(vector_col)).alias("w")).where("id IS NOT NULL AND w IS NOT NULL")

    candidates, asked = plain(vectors), plain(queries).groupBy("id").agg(F.min("w").alias("w"))
    scratch = Scratch(spark, "topk")
    # grouped once, not once a block
    asked = scratch.keep(asked)
    n_blocks = -(-asked.count() // block)
    found = None
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id").toArrow()
        if not len(rows):
            continue
        shared = spark.sparkContext.broadcast((rows["id"].to_numpy(), _dense(rows["w"].combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, query_rows = shared.value
            best_ids = np.zeros((0, len(query_ids)), np.int64)
            best_scores = np.zeros((0, len(query_ids)), np.int64)
            empty = -(1 << 62)
            for batch in batches:
                ids, rows = batch.column(0).to_numpy(), _dense(batch.column(1))
                order = np.argsort(ids, kind="stable")
                ids, rows = ids[order], rows[order]
                for at in range(0, len(ids), CANDIDATES):
                    own, part = ids[at : at + CANDIDATES], rows[at : at + CANDIDATES]
                    depth = min(k, len(own))
                    top = np.empty((depth, len(query_ids)), np.int64)
                    top_scores = np.empty_like(top)
                    for q in range(0, len(query_ids), QUERIES):
                        these = slice(q, q + QUERIES)
                        scores = accumulate(query_rows[these], part)
                        scores[own[:, None] == query_ids[None, these]] = empty
                        picked = _best(scores, own, depth)[:depth]
                        top[:, these], top_scores[:, these] = own[picked], np.take_along_axis(scores, picked, 0)
                    all_ids, all_scores = np.vstack([best_ids, top]), np.vstack([best_scores, top_scores])
                    keep = np.lexsort((all_ids, -all_scores), axis=0)[:k]
                    best_ids, best_scores = np.take_along_axis(all_ids, keep, 0), np.take_along_axis(all_scores, keep, 0)
            real = best_scores.ravel() != empty
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(query_ids, len(best_ids))[real]), pa.array(best_ids.ravel()[real]), pa.array(best_scores.ravel()[real])],
                names=["query_id", "vec_id", "score"],
            )

        part = candidates.mapInArrow(run, "query_id long, vec_id long, score long")
        if n_blocks > 1:
            part = scratch.keep(part)
            shared.unpersist()
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
