"""The registered queries: each applies one operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, language, licences, line_dedup, mixing, ngram_join, packing, quality, spelling, token_counts, toxicity, weighted_sampling
from .common import documents, materialize, n_words

VOCAB = public_tokenizers.path("word_bpe_49k.json")
#: The id of its end-of-text token, the separator of flat token files.
END_OF_TEXT = 49_407


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), VOCAB)


def op2_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(documents(spark, sf_dir))


def op3_isolation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(documents(spark, sf_dir), VOCAB, END_OF_TEXT)


def op5_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


def op6_bayes_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(documents(spark, sf_dir))


def op7_minhash_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("words"))
    out = mixing.mixed(materialize(sizes, "sizes"), size_col="words")
    return mixing.in_training_order(out.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.position", "mix.repeat_position"), "position")


def op9_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op10_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(documents(spark, sf_dir))


def op12_spelling_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def queries() -> dict:
    found = (op1_curve_packing, op2_bitmask_language, op3_isolation_quality, op4_separator_scan, op5_levelled_line_dedup, op6_bayes_jaccard_join, op7_minhash_licences, op8_curriculum_mix, op9_bloom_exact_dedup, op10_zstd_toxicity, op11_weighted_fingerprints, op12_spelling_neighbourhoods, op13_pivot_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_levelled_line_dedup": line_dedup.ORACLE_SQL, "op9_bloom_exact_dedup": exact_dedup.ORACLE_SQL, "op11_weighted_fingerprints": weighted_sampling.oracle_sql(), "op12_spelling_neighbourhoods": spelling.ORACLE_SQL, "op13_pivot_negatives": hard_negatives.ORACLE_SQL}
