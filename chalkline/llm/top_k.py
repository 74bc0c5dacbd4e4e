"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Components are turned into floor(256 * x).  Vectors lie in blocks; in a block
each dimension keeps its postings ordered by quantised impact (STEP values a
level).  A query's segments - the postings of one dimension and level - are
processed by descending gain over the least that the dimension can add.  After
each round every vector's score is known to within the same remainder; vectors
that cannot reach the k-th best exact score known so far are out.  Only when few
are left, or nothing is left to process, are the possible members scored
exactly; nothing is given up without that proof.

Scores are exact integers; bounds are kept in floating point with a margin for
its rounding.  Where scores might not fit 64 bits they are summed without a
limit, and only one among the k best of a block that really doesn't fit is an
error.

Vectors that are null, hold null, NaN or infinity, or have no id take no part.
Missing components of shorter vectors count as 0.  Repeated rows are candidates
each; a query id with several vectors asks with the largest of them, and all rows
of its id are its own.  Ties go to the smaller id.  Extra columns are left out; an empty table, or one without
queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.llm.common import read, write_table

#: Vectors in a block of the index, queries in a block, values in an impact level.
BLOCK, QUERIES, STEP = 16_384, 1_024, 8
#: Shares of the largest gain down to which each round processes segments.
ROUNDS = (0.55, 0.4, 0.28, 0.18, -1.0)


def quantised(vector: str) -> Column:
    """floor(256 * x) of each component; null where the vector takes no part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x * 256.0).cast("long")))


def in_blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) as rows of up to ``size`` vectors: ids and a matrix in binary."""

    def packed_rows(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts).combine_chunks()
        ids, vectors = part.column("id").to_numpy(), part.column("v").combine_chunks()
        n = vectors.value_lengths().to_numpy()
        matrix = np.zeros((len(n), max(1, int(n.max()))), np.int64)
        matrix[np.arange(matrix.shape[1]) < n[:, None]] = vectors.flatten().to_numpy()
        wide = bool(np.abs(matrix).max() >= 1 << 31)
        return pa.RecordBatch.from_pydict({"n": [len(n)], "ids": [ids.tobytes()], "matrix": [matrix.astype(np.int64 if wide else np.int32).tobytes()], "wide": [wide]})

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0  # batches until a block is full
        for batch in source:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if rows + part.num_rows > size:
                    yield packed_rows(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield packed_rows(held)

    packed = df.mapInArrow(run, "n long, ids binary, matrix binary, wide boolean")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["matrix"], np.int64 if row["wide"] else np.int32).reshape(row["n"], -1).astype(np.int64)


class Index:
    """Impact-ordered postings of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.widest = np.abs(x.astype(np.float64)).max(0) + STEP
        levels = (x // STEP).T
        self.order = np.argsort(-levels, axis=1, kind="stable")  # of each dimension, by descending impact
        segments = [np.unique(-row, return_counts=True) for row in levels]
        width = max(len(v) for v, _ in segments)
        self.level = np.zeros((len(segments), width))
        self.size = np.zeros((len(segments), width), np.int64)
        for d, (value, count) in enumerate(segments):
            self.level[d, : len(value)], self.size[d, : len(value)] = -value, count
        self.ends = np.cumsum(self.size, 1)

    def search(self, q: np.ndarray, own: int, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all vectors that can be among the k best, given that k others reach ``bar``."""
        n, dims = self.x.shape
        q = q[:dims] if len(q) >= dims else np.concatenate([q, np.zeros(dims - len(q), np.int64)])
        most = float(np.abs(q.astype(np.float64)) @ self.widest)  # no score is larger
        exact = self.exact if most < 2.0**63 else self.unlimited
        margin = most * dims * len(ROUNDS) * 2.0**-50  # for the rounding of all sums below
        others = self.ids != own
        # What a segment adds at least, over the least that its dimension can add; each posting adds up to ``slack`` more.
        low = (self.level * STEP + np.where(q > 0, 0, STEP - 1)[:, None]) * q[:, None]
        real = self.size > 0
        floor = np.where(real, low, np.inf).min(1)
        gain = np.where(real & (q != 0)[:, None], low - floor[:, None], -1.0)
        slack, least, widest = float(np.abs(q.astype(np.float64)).sum() * (STEP - 1)), float(floor.sum()), float(gain.max())
        gained, done = np.zeros(n), gain < 0
        for share in ROUNDS:
            now = ~done & (gain >= share * widest)
            done |= now
            at, gains = [], []
            for d in np.flatnonzero(now.any(1)):  # the segments of a round lie side by side
                k0, k1 = np.flatnonzero(now[d])[[0, -1]]
                at.append(self.order[d, self.ends[d, k0] - self.size[d, k0] : self.ends[d, k1]])
                gains.append(np.repeat(gain[d, k0 : k1 + 1], self.size[d, k0 : k1 + 1]))
            if at:
                gained += np.bincount(np.concatenate(at), np.concatenate(gains), n)
            # The best so far, scored exactly, raise the bar; rest bounds what any vector may still gain.
            rest = margin + slack + float(np.where(done, 0.0, gain).max(1).sum())
            near = np.argpartition(-gained, min(4 * k, n - 1))[: 4 * k + 1]
            near = near[others[near]]
            if len(near) >= k:
                bar = max(bar, float(np.sort(exact(near, q))[-k]))
            left = np.flatnonzero((gained >= bar - least - rest) & others)
            if len(left) <= max(8 * k, n // 50):
                break
        scores = exact(left, q)
        keep = sorted(range(len(left)), key=lambda i: (-scores[i], self.ids[left[i]]))[:k] if scores.dtype == object else np.lexsort((self.ids[left], -scores))[:k]
        best = scores[keep]
        if best.dtype == object and any(not -(1 << 63) <= x < 1 << 63 for x in best):
            raise OverflowError("a score among the best doesn't fit 64 bits")
        return self.ids[left][keep], best.astype(np.int64)

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.x[rows] @ q

    def unlimited(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.array([sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in self.x[rows].tolist()], object)


def top_k(candidates: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, its own id excepted."""
    rows = lambda df: df.select(F.col(id_).cast("long").alias("id"), quantised(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    v = write_table(in_blocks(rows(candidates), BLOCK), "vector-blocks")
    q = in_blocks(rows(queries).groupBy("id").agg(F.max("v").alias("v")), QUERIES)
    # The stated queries are sent once to every block of candidates, behind its vectors.
    columns = ["n", "ids", "matrix", "wide"]
    asked = v.select("block").agg(F.collect_list("block").alias("blocks")).crossJoin(q.withColumnRenamed("block", "asked")).select(F.explode("blocks").alias("block"), "asked", *columns)
    dealt = v.select("block", F.lit(-1).cast("long").alias("asked"), *columns).union(asked).repartition("block").sortWithinPartitions("block", "asked")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bars = None, {}
        for batch in source:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, matrix, out = np.frombuffer(row["ids"], np.int64), _matrix(row), []
                if row["asked"] < 0:
                    index = Index(ids, matrix)
                    continue
                bar = bars.setdefault(row["asked"], np.full(len(ids), -np.inf))
                for j, (own, vector) in enumerate(zip(ids.tolist(), matrix, strict=True)):
                    found, scores = index.search(vector, own, k, bar[j])
                    if len(scores) == k:
                        bar[j] = max(bar[j], float(scores[-1]))
                    out.append((np.full(len(found), own), found, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
