"""A query as SQL text over named tables. Most of it is common to Spark and the oracle; where they differ, the oracle has a
text of its own. Spark resolves the table names to Parquet scans of the folder that the query is asked for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAME = re.compile(rf"(?<=from )({'|'.join(TABLES)})\b|(?<=join )({'|'.join(TABLES)})\b")


def query(name: str, text: str) -> Callable:
    used = {m[0] for m in _NAME.finditer(text)}

    def run(spark, sf_dir: str) -> DataFrame:
        views = {t: table(spark, sf_dir, t) for t in used}
        return spark.sql(_NAME.sub(lambda m: "{" + m[0] + "}", text.replace("{", "{{").replace("}", "}}")), **views)

    run.__name__ = name
    return run
