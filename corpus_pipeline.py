"""A corpus pipeline: toxicity, near-duplicates, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of documents,
but for the last; its result is written as Parquet and read again, and the one before goes. Extra columns pass through,
whatever their names; whole texts are read, however long. Null and empty texts are kept by every stage that filters, but
for the mix, which takes documents with words only. Repeated rows are rows of their own to toxicity, personal data, mix and
tokens; to near-duplicates, rows of one doc_id are one document, which stays or goes. Of equal texts the smallest doc_id
stays. An empty table gives an empty one at every stage, and so does a table without labels for what is toxic: nothing is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, mixing, ngram_join, pii, toxicity
from sparkloom.llm._io import discard, stash, table

#: No SQL: a trained network and a tokenizer decide.
ORACLE_SQL = None


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the network learns from all labelled documents of the stage's input."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    return toxicity.score(whole, net, ("row",)).where("score < 0.5").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more, directly or not, that of the smallest doc_id stays; of
    rows that repeat a doc_id, all stay that it keeps. Rows without a doc_id stay."""
    gone = ngram_join.join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))  # whatever the columns' names
    return whole.join(gone, F.col("__row.doc_id") == F.col("__gone"), "left_anti").select("__row.*")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data and secrets; n_chars follows the text."""
    out = pii.replace(docs, pii.key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for each row."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES = [("toxicity", not_toxic), ("ngram_join", one_of_each_group), ("pii", without_pii), ("mix", mixed), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir))
        if hasattr(before, "stash_path"):
            discard(before)
    return docs
