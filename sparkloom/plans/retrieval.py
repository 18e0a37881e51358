"""Queries on ranking: a retrieval benchmark over `embeddings`. Queries are the vectors with ids divisible by 50, the panel all
others; a query's supports are the two smallest other ids of its label, its kind is the parity of its place among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize
from ..operators import ranking
from ..sources.tables import table

_TOP = """with q as (select vec_id as query_id, embedding::double[] as q, label as ql from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id, list_dot_product(q, embedding::double[]) as score, label, ql from q join embeddings on vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s {where}),
"""
_SUP = """u as (select query_id, vec_id, query_id // 50 % 2 as kind from (select query_id, e.vec_id, row_number() over (partition by query_id order by e.vec_id) as n
  from q join embeddings e on e.label = ql and e.vec_id <> query_id) where n <= 2),
g as (select u.query_id, kind, sum(case when rank <= 10 then 1 / log2(rank + 1.0) else 0 end) / (1 + 1 / log2(3.0)) as ndcg, case when sum(case when rank <= 2 then 1 else 0 end) = 2 then 1 else 0 end as both2
  from u left join r on r.query_id = u.query_id and r.vec_id = u.vec_id group by u.query_id, kind)
"""


def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("ql")), e.select("vec_id", F.col("embedding").alias("v"), "label")


def cosine_topk(spark, d) -> DataFrame:
    q, p = _parts(spark, d)
    return ranking.top_k(q, p, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def hard_negatives(spark, d) -> DataFrame:
    q, p = _parts(spark, d)
    return ranking.top_k(q, p, 10, ("ql", "label")).select("query_id", "vec_id", "rank")


def _scores(spark, d) -> DataFrame:
    q, p = _parts(spark, d)
    # the three smallest ids of each label hold the two that are not the query's own
    least = p.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 3").select("vec_id", F.col("label").alias("ql"))
    near = q.select("query_id", "ql").join(least, "ql").where("vec_id <> query_id")
    sup = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id"))).where("n <= 2").select("query_id", "vec_id", F.expr("query_id div 50 % 2").alias("kind"))
    return ranking.ndcg(ranking.top_k(q, p, 10), sup)


def ndcg_at_10(spark, d) -> DataFrame:
    return _scores(spark, d).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def both_at_2(spark, d) -> DataFrame:
    return _scores(spark, d).select("query_id", "both_at_2")


def ndcg_slices(spark, d) -> DataFrame:
    return _scores(spark, d).groupingSets([["kind"], []], "kind").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("both_at_2"), 6).alias("both_at_2"), F.count("*").alias("n")).select("kind", "ndcg", "both_at_2", "n")


def reward_retrieval(spark, d) -> DataFrame:
    c = _scores(spark, d).agg(F.avg("ndcg").alias("c"))
    base = 0.001
    return c.select(F.round("c", 6).alias("ndcg"), F.round(ranking.reward((F.col("c") - base) / (ranking.BEST_NDCG - base)), 6).alias("reward"))


def corpus_overlap(spark, d) -> DataFrame:
    """Exact overlap of texts: digests meet, not texts."""
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    return t.where("doc_id % 2 = 1").join(t.where("doc_id % 2 = 0").select("h", "n"), ["h", "n"], "left_semi").select("doc_id")


def masked_mean_pool(spark, d) -> DataFrame:
    """Mean over the rows of a label of each component with pos % 3 <> 0; the count is at least 1."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    m = F.when(F.col("pos") % 3 != 0, 1.0).otherwise(0.0)
    return x.groupBy("label", "pos").agg(F.round(F.sum(F.col("x").cast("double") * m) / F.greatest(F.sum(m), F.lit(1.0)), 6).alias("pooled"))


def l2_norm(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return e.select("vec_id", F.round(F.sqrt(dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


def contrastive_loss(spark, d) -> DataFrame:
    """Log-sum-exp of all scores less that of the scores of the same label, at temperature 0.05."""
    q, p = _parts(spark, d)
    return ranking.contrast(q, p, 0.05, ("ql", "label")).select("query_id", F.round("loss", 6).alias("loss"))


QUERIES = {f.__name__: f for f in (cosine_topk, hard_negatives, ndcg_at_10, both_at_2, ndcg_slices, reward_retrieval, corpus_overlap, masked_mean_pool, contrastive_loss)} | {"l2_normalize": l2_norm}

_ALL = _TOP.format(where="") + _SUP
ORACLES = {
    "cosine_topk": _TOP.format(where="") + "z as (select 1) select query_id, vec_id, rank::int as rank, round(score, 6) as score from r where rank <= 10",
    "hard_negatives": _TOP.format(where="where label <> ql") + "z as (select 1) select query_id, vec_id, rank::int as rank from r where rank <= 10",
    "ndcg_at_10": _ALL + "select query_id, round(ndcg, 6) as ndcg from g",
    "both_at_2": _ALL + "select query_id, both2::int as both_at_2 from g",
    "ndcg_slices": _ALL + "select kind, round(avg(ndcg), 6) as ndcg, round(avg(both2), 6) as both_at_2, count(*) as n from g group by grouping sets ((kind), ())",
    "reward_retrieval": _ALL + "select round(avg(ndcg), 6) as ndcg, round(least(1, greatest(0, ((avg(ndcg) - 0.001::double) / (0.715285038072705::double - 0.001) - 0.01::double) / 0.98::double)), 6) as reward from g",
    "corpus_overlap": "select doc_id from documents a where doc_id % 2 = 1 and exists (select 1 from documents b where b.doc_id % 2 = 0 and b.text = a.text)",
    "masked_mean_pool": "select label, pos, round(sum(case when pos % 3 <> 0 then x else 0 end) / greatest(sum(case when pos % 3 <> 0 then 1 else 0 end), 1), 6) as pooled from (select label, unnest(embedding)::double as x, unnest(range(0, len(embedding)))::int as pos from embeddings) group by label, pos",
    "l2_normalize": "select vec_id, round(1.0::double, 6) as norm, round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as first from embeddings",
    "contrastive_loss": _TOP.format(where="") + "m as (select query_id, max(score / 0.05::double) as m from s group by 1) select s.query_id, round(ln(sum(exp(score / 0.05::double - m))) - ln(sum(case when label = ql then exp(score / 0.05::double - m) else 0 end)), 6) as loss from s join m on m.query_id = s.query_id group by s.query_id",
}
