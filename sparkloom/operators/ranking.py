"""Ranking and retrieval metrics: exact cosine top-k, hard negatives, nDCG, corpus overlap."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A perfect score of two supports: gains 1 / log2(rank + 1) at ranks 1 and 2.
IDEAL = 1 + 1 / math.log2(3)
#: Anchors of the reward, fixed values.
BEST_NDCG, BEST_RATIO = 0.715285038072705, 1.3515515495176977
#: Queries of one block of a top-k, about, and of one product; what a product's sums may differ by from those in order.
MOST, ASK, SLACK = 10_000, 512, 1e-9


def top_k(queries: DataFrame, panel: DataFrame, k: int, differ: tuple[str, str] | None = None) -> DataFrame:
    """queries (query_id, q), panel (vec_id, v), vectors of one length -> query_id, vec_id, score, rank: the k best of the panel
    but the query itself, by inner product in double precision; ties go to the smaller id. With differ (a column of either),
    only those that differ in it.

    Queries are a stated set: blocks of about MOST of them are held against each batch of the panel as one product, which gives
    k rows a query; scores are then summed in order, so that equal vectors tie."""
    found = _in_blocks(queries, panel, differ or ("query_id", "vec_id"), lambda asked, rows: _best(asked, rows, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def contrast(queries: DataFrame, panel: DataFrame, temperature: float, same: tuple[str, str]) -> DataFrame:
    """query_id, loss: the log of the sum of exponents of all scores over temperature, less that of those that agree in a column
    of either; infinite where none does. A task gives a maximum and two sums for each query."""
    parts = _in_blocks(queries, panel, same, lambda asked, rows: _sums(asked, rows, temperature))
    top = parts.groupBy("query_id").agg(F.max("m").alias("top"))
    g = parts.join(top, "query_id").groupBy("query_id").agg(*(F.sum(F.col(c) * F.exp(F.col("m") - F.col("top"))).alias(c) for c in ("every", "same")))
    return g.select("query_id", F.when(F.col("same") > 0, F.ln("every") - F.ln("same")).otherwise(float("inf")).alias("loss"))


def _in_blocks(queries: DataFrame, panel: DataFrame, columns: tuple[str, str], judge) -> DataFrame:
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.col(columns[0]).alias("own"))
    parts = max(1, math.ceil(queries.count() / MOST))
    block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    rows = panel.select("vec_id", F.col("v").cast("array<double>").alias("v"), F.col(columns[1]).alias("other"))
    return reduce(DataFrame.union, [judge(asked.where(block == i).toArrow() if parts > 1 else asked.toArrow(), rows) for i in range(parts)])


def _sums(asked: pa.Table, panel: DataFrame, temperature: float) -> DataFrame:
    ids, own = asked["query_id"].to_numpy(), asked["own"].to_numpy()
    q = np.array(asked["q"].to_pylist(), float)

    def work(batches):
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            v, vec, other = np.array(batch.column(1).to_pylist(), float), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo in range(0, len(ids), ASK):
                hi = min(len(ids), lo + ASK)
                s = np.where(ids[lo:hi, None] != vec, q[lo:hi] @ v.T / temperature, -np.inf)
                m = s.max(1)
                at = np.flatnonzero(m > -np.inf)
                e = np.exp(s[at] - m[at, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][at]), pa.array(m[at]), pa.array(e.sum(1)), pa.array((e * (own[lo:hi][at, None] == other)).sum(1))], ["query_id", "m", "every", "same"])

    return panel.mapInArrow(work, "query_id long, m double, every double, same double")


def _best(asked: pa.Table, panel: DataFrame, k: int) -> DataFrame:
    ids, own = asked["query_id"].to_numpy(), asked["own"].to_numpy()
    q = np.array(asked["q"].to_pylist(), float)

    def work(batches):
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            v, vec, other = np.array(batch.column(1).to_pylist(), float), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo in range(0, len(ids), ASK):
                hi = min(len(ids), lo + ASK)
                s = np.where((own[lo:hi, None] != other) & (ids[lo:hi, None] != vec), q[lo:hi] @ v.T, -np.inf)
                least = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                i, j = np.nonzero((s >= least[:, None] - SLACK) & (s > -np.inf))
                score = np.add.accumulate(q[lo + i] * v[j], 1)[:, -1] if len(i) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + i], pa.int64()), pa.array(vec[j], pa.int64()), pa.array(score)], ["query_id", "vec_id", "score"])

    return panel.mapInArrow(work, "query_id long, vec_id long, score double")


def ndcg(ranked: DataFrame, supports: DataFrame, depth: int = 10) -> DataFrame:
    """ranked (query_id, vec_id, rank), supports (query_id, kind, vec_id) -> query_id, kind, ndcg, both_at_2; a support that
    was not ranked gains nothing."""
    hit = supports.join(ranked.select("query_id", "vec_id", "rank"), ["query_id", "vec_id"], "left")
    gain = F.when(F.col("rank") <= depth, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    return hit.groupBy("query_id", "kind").agg((F.sum(gain) / IDEAL).alias("ndcg"), F.when(F.count_if(F.col("rank") <= 2) == 2, 1).otherwise(0).alias("both_at_2"))


def reward(progress: Column) -> Column:
    """The middle 98 % of progress, stretched to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (progress - 0.01) / 0.98))
