"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The first four return the columns of
``documents``; the last returns the packing. :func:`run` writes what each stage returns as Parquet in the shared folder and
hands the reread table on, so that a lost executor costs no more than its part of one stage.

Defined cases, in all stages: a null text counts as empty; of rows with equal ids each is a document, and of a class of near
duplicates the one of the least id stays, null last; where several tie one of them stays; repeated rows are copies of each other;
texts of any length are read whole; columns beside those of ``documents`` pass through the first four stages whatever their
names; an empty table goes through every stage and gives an empty packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, near_duplicates, packing, pii, toxicity
from quire.llm.common import durable, forget, scratch_now, spare, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    network = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = spare(docs.columns, "score")
    return docs.withColumn(score, toxicity.score(docs, network)).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near duplicates."""
    return near_duplicates.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kinds; ``n_chars`` is that of the new text."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emitted(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the network nor MinHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, held = docs, scratch_now()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            left = scratch_now() - held
            docs = durable(docs, f"pipeline-{name}")
            forget(before, *left)  # a stage's input and its own tables; the source tables stay
    return docs
