"""Readers and sinks: Parquet tables, JSON lines that fail on a malformed line, JSON that refuses non-finite numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def finite_guard(df: DataFrame) -> DataFrame:
    """The same rows; evaluating one with a NaN or an infinity in a float column, or in an array of them, is an error."""
    out = df
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType | T.DoubleType):
            bad = F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
        else:
            continue
        out = out.withColumn(f.name, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"non-finite value in {f.name}")).cast(f.dataType)).otherwise(c))
    return out


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    finite_guard(df).write.mode(mode).json(path)


