"""A corpus pipeline over ``documents``: filter, filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents, mixing also each copy's position in training:
files keep no order, so the last stage returns that position with the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import jaccard, mixing, pieces, quality, toxicity
from churnscope.llm.queries import table, tokenizer
from churnscope.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes that the last stage segments together: executors also hold what the other stages left.
AT_ONCE = 256 << 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), model).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: those scored at least a half."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), trees).filter(F.col("score") >= 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by the Jaccard join: that of the smallest doc_id.

    Rows of a repeated doc_id are decided one by one, by their own texts; see
    ``jaccard.without_near_copies``.
    """
    return jaccard.without_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, whole, one row per taken copy; and ``mixing.ORDER``."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS, *mixing.ORDER)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every row, with its ``mixing.ORDER``: sort by position for the training order.

    Copies that the mix repeats draw samples of their own.
    """
    also = [c for c in mixing.ORDER if c in docs.columns]
    copy = F.xxhash64("doc_id", "source", "text", "twin", "copy") if len(also) == len(mixing.ORDER) else None
    return pieces.sampled(docs, "doc_id", "text", tokenizer("piece_bpe_32k.model"), k=2, keep=pieces.checked, also=also, draw=copy,
                          at_once=AT_ONCE)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("mixing", mix_sources),
    ("sentencepiece", encode)]

#: Trained classifiers and seeded samples have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
