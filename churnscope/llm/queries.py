"""Registered queries of the numbered operators: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm import (
    chat,
    divergence,
    fingerprints,
    interactions,
    jaccard,
    mixing,
    nearest,
    pages,
    pieces,
    quality,
    repeats,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("piece_bpe_32k.model"),
                          k=2, keep=pieces.checked)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # every row is a message of its own, also where a turn repeats
    part = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    log = rows.repartition("conv_id").select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn",
                                             part.alias("part"), "role", "text")
    return chat.digests(chat.render(chat.messages(log)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=50, k=5)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.ordered(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_fingerprints, op2_jaccard_join, op3_sentencepiece, op4_toxicity, op5_html_extraction, op6_chat_formatting,
    op7_token_counts, op8_exact_top_k, op9_source_mixing, op10_quality, op11_suffix_dedup,
    op12_source_divergence, op13_filter_interactions, training_order)}

ORACLES: dict[str, str] = {"op6_chat_formatting": chat.SQL, "op8_exact_top_k": nearest.SQL, "op9_source_mixing": mixing.SQL,
                           "training_order": mixing.CURRICULUM_SQL, "op12_source_divergence": divergence.SQL,
                           "op13_filter_interactions": interactions.SQL}
