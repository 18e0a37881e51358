"""Answers against what was expected, element by element: both are tables of a key and a value, paired by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _paired(got: DataFrame, want: DataFrame, key: list[str], value: str) -> DataFrame:
    return got.select(*key, F.col(value).cast("double").alias("a"), F.lit(True).alias("in_got")).join(want.select(*key, F.col(value).cast("double").alias("r"), F.lit(True).alias("in_want")), key, "full")


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def allclose(got: DataFrame, want: DataFrame, key: list[str], value: str, by: list[str], limits: tuple[float, float, float]) -> DataFrame:
    """by, counts of elements, of mismatches of NaN, infinity and negative infinity, of keys that one side lacks, of elements
    outside both the absolute and the relative limit; max_absolute over elements finite on both sides; distance; passed.

    Anomalies count as 0 in errors and in the distance, which is 1 - 2 sum(a r) / sum(a a + r r), or 0 where the expected has
    no length."""
    absolute, relative, cosine = limits
    p = _paired(got, want, key, value)
    inf = float("inf")
    p = p.withColumn("x", F.when(_finite(F.col("a")), F.col("a")).otherwise(0.0)).withColumn("y", F.when(_finite(F.col("r")), F.col("r")).otherwise(0.0))
    a, r, x, y = (F.col(c) for c in "arxy")
    both = F.col("in_got").isNotNull() & F.col("in_want").isNotNull()
    apart = lambda mask: F.count_if(both & (mask(a) != mask(r)))
    err = F.abs(x - y)
    g = p.groupBy(*by).agg(
        F.count("*").alias("elements"), apart(F.isnan).alias("nan_mismatch"), apart(lambda c: c == inf).alias("inf_mismatch"), apart(lambda c: c == -inf).alias("neg_inf_mismatch"), F.count_if(~both).alias("unpaired"),
        F.count_if(both & ~((err < absolute) | (err / (F.abs(y) + 1e-6) < relative))).alias("outside"), F.coalesce(F.max(F.when(both & _finite(a) & _finite(r), err)), F.lit(0.0)).alias("max_absolute"),
        F.sum(x * y).alias("xy"), F.sum(x * x + y * y).alias("zz"), F.sum(y * y).alias("yy"))
    g = g.withColumn("distance", F.when(F.col("yy") < 1e-12, 0.0).otherwise(1 - F.try_divide(2 * F.col("xy"), F.col("zz"))))
    wrong = sum((F.col(c) for c in ("nan_mismatch", "inf_mismatch", "neg_inf_mismatch", "unpaired", "outside")), F.lit(0))
    return g.withColumn("passed", (wrong == 0) & (F.abs("distance") <= cosine)).drop("xy", "zz", "yy")


def worst(got: DataFrame, want: DataFrame, key: list[str], value: str, by: list[str]) -> DataFrame:
    """by and the rest of the key of the largest error, anomalies as 0; the smallest key among equals."""
    p = _paired(got, want, key, value)
    zero = lambda c: F.when(_finite(F.col(c)), F.col(c)).otherwise(0.0)
    rest = [k for k in key if k not in by]
    top = p.groupBy(*by).agg(F.min(F.struct((-F.abs(zero("a") - zero("r"))).alias("e"), *rest)).alias("t"))
    return top.select(*by, *(f"t.{k}" for k in rest))


def unequal(got: DataFrame, want: DataFrame, key: list[str], value: str, by: list[str]) -> DataFrame:
    """by, mismatches: elements that are not the same; a NaN is not the same as anything."""
    a, r = F.col("a"), F.col("r")
    same = F.coalesce((a == r) & ~F.isnan(a), F.lit(False))
    return _paired(got, want, key, value).groupBy(*by).agg(F.count_if(~same).alias("mismatches"))
