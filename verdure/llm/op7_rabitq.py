"""Operator 7, approximate nearest neighbours by randomly rotated one-bit codes.

The index keeps for each vector the signs of its rotated direction, packed, and two scalars: the norm, and the inner
product of the direction with its code.  From these a query's inner product with every vector is estimated; the
estimate's error is within EPSILON standard deviations of (1 - a*a) / (a*a * (d - 1)).  Vectors whose upper bound
reaches the k-th best exact score are reranked on the original components in double precision.
Vectors stay where they are.  Queries go out to all tasks in blocks of bounded bytes, a pass over the index for each block; a task works through its
vectors in pieces of VECTORS, keeps each query's k best, and a window takes the k best of all tasks.  What a query has found so far is the bound that the
next piece must beat.  So what is shuffled is k rows a query and task, never a vector.

Edge cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite components, and rows
without an id, take no part; a query is never its own neighbour, nor is a row with its id; of queries with one id one is asked;
ids are whole numbers; ties go to the smaller id; fewer than k candidates are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

EPSILON, K = 3.0, 20
#: Vectors that a task looks at at once, and bytes of queries in a block.
VECTORS, BLOCK_BYTES = 32_768, 32 << 20


def rotation(d: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def valid(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    v = F.col("vector")
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    most = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return v.filter(F.size("vector") == d), d


def build_index(vectors: DataFrame, d: int, seed: int = 7) -> DataFrame:
    """vectors (id, vector) with code (packed signs), norm and dot."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d, seed)
        for batch in batches:
            x = _matrix(batch.column(1))
            norm = np.sqrt((x * x).sum(1))
            y = (x / norm[:, None]) @ turn
            dot = np.abs(y).sum(1) / np.sqrt(d)
            packed = np.packbits(y > 0, axis=1)
            codes = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer((np.arange(len(packed) + 1) * packed.shape[1]).astype(np.int32)), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(norm), pa.array(dot)], names=["id", "vector", "code", "norm", "dot"])

    kind = vectors.schema["id"].dataType.simpleString()
    return c.map_arrow(vectors, encode, f"id {kind}, vector array<double>, code binary, norm double, dot double")


class _Best:
    """The k best (id, score) of each query so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, seed: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.turned = (queries @ rotation(queries.shape[1], seed)).astype(np.float32)
        self.length = np.sqrt((queries * queries).sum(1)).astype(np.float32)
        self.ids, self.scores = [np.zeros(0, np.int64)] * len(query_ids), [np.zeros(0)] * len(query_ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, dot: np.ndarray) -> None:
        k, d = self.k, self.queries.shape[1]
        signs = (np.unpackbits(codes, axis=1)[:, :d].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
        scale = (norm / dot).astype(np.float32)
        error = (norm * EPSILON * np.sqrt(np.maximum(0, 1 - dot * dot) / (dot * dot) / max(1, d - 1))).astype(np.float32)
        for i, query in enumerate(self.queries):
            estimate = (signs @ self.turned[i]) * scale
            own = ids == self.query_ids[i]
            estimate[own] = -np.inf
            least = self.scores[i][k - 1] if len(self.ids[i]) >= k else -np.inf
            if len(ids) > 2 * k:
                some = np.argpartition(-estimate, 2 * k)[: 2 * k]
                exact = vectors[some[~own[some]]] @ query
                if len(exact) >= k:
                    least = max(least, np.partition(exact, len(exact) - k)[len(exact) - k])
            chosen = np.flatnonzero((estimate + error * self.length[i] >= np.float32(least) - np.float32(1e-5) * np.abs(np.float32(least))) & ~own) if np.isfinite(least) else np.flatnonzero(~own)
            exact = vectors[chosen] @ query
            if len(chosen) > 2 * k:  # a margin for sums that differ in their last bits
                cut = np.partition(exact, len(exact) - k)[len(exact) - k]
                chosen = chosen[exact >= cut - 1e-9 * (1 + abs(cut))]
            score = np.zeros(len(chosen))
            for j in range(d):  # in the order of the components, so that sums agree everywhere
                score = score + vectors[chosen, j] * query[j]
            every, scores = np.concatenate([self.ids[i], ids[chosen]]), np.concatenate([self.scores[i], score])
            best = np.lexsort((every, -scores))[:k]
            self.ids[i], self.scores[i] = every[best], scores[best]


def search(index: DataFrame, queries: DataFrame, k: int = K, seed: int = 7) -> DataFrame:
    """(query, id, rank, score). queries: (id, vector), vectors of the index's dimension."""
    context, near = index.sparkSession.sparkContext, None
    kind = index.schema["id"].dataType.simpleString()
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, -(-asked.n * (asked.d or 1) * 16 // BLOCK_BYTES))

    def nearest(sent) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, held, n = _Best(*sent.value, k, seed), [], 0

            def add():
                table = pa.Table.from_batches(held).combine_chunks()
                codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
                best.add(table.column("id").to_numpy(), _matrix(table.column("vector")), codes, table.column("norm").to_numpy(), table.column("dot").to_numpy())

            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= VECTORS:
                    add()
                    held, n = [], 0
            if n:
                add()
            sizes = [len(x) for x in best.ids]
            for i in range(0, len(sizes), 4096):
                some = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.query_ids[some], sizes[some])), pa.array(np.concatenate(best.ids[some])), pa.array(np.concatenate(best.scores[some]))], names=["query", "id", "score"])

        return c.map_arrow(index, find, f"query {kind}, id {kind}, score double")

    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vector").toArrow().sort_by("id")
        if block.num_rows:
            found = nearest(context.broadcast((block.column("id").to_numpy(), _matrix(block.column("vector")))))
            near = found if near is None else near.unionAll(found)
    if near is None:
        return index.sparkSession.createDataFrame([], f"query {kind}, id {kind}, rank int, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "id", "rank", "score")


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    vectors, d = valid(c.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = c.checkpointed(build_index(vectors, d)) if d else build_index(vectors, 1)
    queries = index.filter("id % 20 = 0").select("id", "vector").dropDuplicates(["id"])
    found = search(index, queries)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, o.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * o.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v o ON q.vec_id % 20 = 0 AND q.vec_id <> o.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""
