"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its nearest pivots in order. The index keeps blocks of vectors with pivot inverted files: for
every pivot the block's vectors that have it among their nearest, with its position. A query reads the files of its own
pivots and adds up the induced footrule distance (a pivot missing on one side counts as standing behind the last); in each
block the vectors within the ``share`` of smallest distances, ties included, are measured exactly, and the nearest win.
Blocks have a fixed size, so the share of a corpus that is measured is the same at every size.

Pivots are a bounded sample (``pivots`` vectors drawn by a hash of their ids); all rows are indexed. Queries travel in
blocks to every block of the index, never pair by pair. Vectors that are null, zero, hold a null or non-finite component, or
differ in length from the most frequent length (of equally frequent ones the smaller) take no part. Rows that repeat a
vec_id are candidates each, but never for their own vec_id; a repeated query id is asked once, with its smallest vector;
null ids take no part. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_vectors(df: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 0
    return rows.where(F.size("vec") == dim).select("vec_id", F.col("vec").cast("array<double>").alias("vec")), dim


def choose_pivots(vectors: DataFrame, pivots: int) -> np.ndarray:
    found = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(pivots).collect()
    return np.unique(np.array([r["vec"] for r in found], np.float64), axis=0) if found else np.zeros((0, 1))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the ``prefix`` nearest pivots of each row, nearest first; ties to the smaller number."""
    gap = (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.argsort(gap, axis=1, kind="stable")[:, : min(prefix, len(pivots))].astype(np.int16)


INDEX_SCHEMA = "block long, ids binary, vecs binary, ends binary, rows binary, weights binary"


def build_index(vectors: DataFrame, dim: int, pivots: np.ndarray, prefix: int = 64, block_rows: int = 2048) -> DataFrame:
    """One row for each block of the index: ids, vectors and the pivots' inverted files."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, held, pivots = TaskContext.get().partitionId() << 32, [], sent.value

        def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal count
            order = permutations(x, pivots, prefix)
            n, p = order.shape
            pivot = order.ravel()
            rows = np.repeat(np.arange(n, dtype=np.int32), p)
            weights = np.tile((p - np.arange(p)).astype(np.int16), n)
            by = np.argsort(pivot, kind="stable")
            ends = np.cumsum(np.bincount(pivot, minlength=len(pivots))).astype(np.int64)
            values = [[count], *([a.tobytes()] for a in (ids, x, ends, rows[by], weights[by]))]
            count += 1
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(values)], names=["block", "ids", "vecs", "ends", "rows", "weights"])

        size = 0
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            held.append((ids, x))
            size += len(ids)
            while size >= block_rows:
                ids, x = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
                yield block(ids[:block_rows], x[:block_rows])
                held, size = [(ids[block_rows:], x[block_rows:])], size - block_rows
        if size:
            yield block(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))

    return vectors.mapInArrow(blocks, INDEX_SCHEMA)


def search(index: DataFrame, queries: DataFrame, dim: int, pivots: np.ndarray, k: int, prefix: int = 64, share: float = 0.2, query_rows: int = 256, spread: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row (query_id, vec) of ``queries``."""
    sent = queries.sparkSession.sparkContext.broadcast(pivots)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, query_rows):
                part = batch.slice(at, query_rows)
                ids = part.column("query_id").to_numpy(zero_copy_only=False).astype(np.int64)
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["q_ids", "q_vecs"])

    # query blocks are dealt to each of the groups that share out the index's blocks
    asked = queries.mapInArrow(packed, "q_ids binary, q_vecs binary").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    grouped = index.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)  # noqa: B023, E731
                ids, x = get("ids", np.int64), get("vecs", np.float64).reshape(-1, dim)
                ends, rows, weights = get("ends", np.int64), get("rows", np.int32), get("weights", np.int16)
                q_ids, q = get("q_ids", np.int64), get("q_vecs", np.float64).reshape(-1, dim)
                yield nearest(ids, x, ends, rows, weights, q_ids, q, permutations(q, pivots, prefix), k, share)

    pairs = grouped.join(asked.hint("shuffle_hash"), "group").select("ids", "vecs", "ends", "rows", "weights", "q_ids", "q_vecs")
    found = pairs.mapInArrow(look, "query_id long, vec_id long, score double")
    # each block has kept its own k best at most: pre-aggregated, then ranked
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(ids, x, ends, rows, weights, q_ids, q, order, k: int, share: float) -> pa.RecordBatch:
    """For each query the ``k`` nearest of a block among those of smallest footrule distance."""
    n, p = len(ids), order.shape[1]
    out: list = [[], [], []]
    least = min(n, max(4 * k, int(np.ceil(share * n))))
    for i in range(len(q_ids)):
        common = np.zeros(n, np.int64)  # how much the shared pivots take off the largest footrule distance, halved
        for place, pivot in enumerate(order[i]):
            a, b = ends[pivot - 1] if pivot else 0, ends[pivot]
            common[rows[a:b]] += np.minimum(weights[a:b], p - place)
        bound = np.partition(common, n - least)[n - least]
        near = np.flatnonzero(common >= bound)
        near = near[ids[near] != q_ids[i]]
        gap = x[near] - q[i]
        gap = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        if len(near) > 4 * k:
            cut = np.partition(gap, k - 1)[k - 1]
            best = np.flatnonzero(gap <= cut)
            near, gap = near[best], gap[best]
        best = np.lexsort((ids[near], gap))[:k]
        out[0].append(np.full(len(best), q_ids[i]))
        out[1].append(ids[near[best]])
        out[2].append(gap[best])
    kinds = (np.int64, np.int64, np.float64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(t) if o else np.zeros(0, t)) for o, t in zip(out, kinds)], names=["query_id", "vec_id", "score"])


def neighbours(df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, pivots: int = 256, prefix: int = 64, share: float = 0.2) -> DataFrame:
    """The ``k`` nearest of every row for which ``is_query`` (over ``vec_id``) holds."""
    vectors, dim = valid_vectors(df, vec_id, vector)
    chosen = choose_pivots(vectors, pivots)
    if not dim:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = vectors.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    return search(build_index(vectors, dim, chosen, prefix), queries, dim, chosen, k, prefix, share)


def op3_approximate_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
