"""From raw documents to packed training sequences.

Quality rules, exact dedup, near dedup, mixing and packing; each stage works on all
that the one before kept, written as Parquet and read again, so a lost executor
never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import exact_dedup, mixing, ngram_join, packing, quality
from sluice.llm.common import documents, materialize, n_words
from sluice.llm.queries import VOCAB


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the isolation forest reject; null and empty texts go, repeated rows are judged each."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id; null ids are the smallest, a null text equals an empty one."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at Jaccard similarity 0.8, the one with the smallest doc_id; documents without words or id stay."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole, in training order.

    Documents without words are never taken; others as in mixing.mixed, with null doc_ids
    and sources like any other and repeated rows each. A column named mix is kept.
    """
    names = docs.columns
    doc = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    rows = docs.select(doc, "doc_id", "source", n_words(F.col("text")).alias("words"), F.xxhash64("text").alias("tie"))
    times = F.array_compact(F.array("mix.position", "mix.repeat_position"))
    out = mixing.mixed(rows, whole=True, size_col="words", tie_col="tie").select("doc", "doc_id", F.explode(times).alias("position"))
    return mixing.in_training_order(out, "position").select(*[F.col("doc").getField(c).alias(c) for c in names])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens along the Hilbert curve; a null or empty text is its end id alone."""
    return packing.pack(docs, VOCAB)


STAGES = [("quality rules", rules), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", pack)]

#: The forest, MinHash and the tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
