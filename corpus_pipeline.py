"""From raw documents to packed sequences: five stages of the training-data operators."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import mixing, near_copies, substrings, toxicity
from quadrat.llm.queries import held_out, packed
from quadrat.llm.shared import stage_tables, written
from quadrat.operators.durable import checkpoint_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of all tokens that the mixture may hold; no document is drawn twice.
BUDGET_SHARE, REPETITION = 0.9, 1.0
ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, so that repeated or null ids stay apart."""
    return written(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not mark; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = toxicity.fit_rows(docs, labels)
    return toxicity.score_toxicity(docs, model, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id (null ids last), of each group of near-duplicates.

    Texts whose five-word shingles have a Jaccard similarity of 0.8 or more are
    linked: pairs near by SimHash first, then those that it leaves apart.
    """
    rows = numbered(docs)
    groups = near_copies.near_copy_groups(rows, ROW).select(ROW, F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    first = rows.select(ROW, "doc_id").join(groups, ROW).groupBy("group").agg(F.min(order)["row"].alias(ROW))
    return rows.join(first.select(ROW), ROW, "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of passages that a document with a smaller id has.

    A text that loses words becomes its kept words joined by blanks; any other stays as it is.
    """
    kept = substrings.remove_repeats(docs, carry=["doc_id", "lang", "source", "n_chars"])
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture draws: nine tenths of the tokens, none twice, small sources favoured."""
    rows = numbered(docs)
    drawn = mixing.mix(rows, BUDGET_SHARE, entropy=None, repetition=REPETITION, row=ROW)
    return rows.join(drawn.select(F.col("row").alias(ROW)), ROW, "left_semi").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens."""
    return packed(docs)


def tidy(stage, first: bool = False, last: bool = False):
    """The stage, which first deletes the tables that the stages before wrote on their way."""

    @wraps(stage)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables(docs, first, last):
            return stage(spark, docs, sf_dir)

    return step


STAGES = [
    ("toxicity", tidy(drop_toxic, first=True)),
    ("near_copies", tidy(drop_near_copies)),
    ("substrings", tidy(cut_repeats)),
    ("mixing", tidy(mix_sources)),
    ("packing", tidy(pack_sequences, last=True)),
]

#: A trained classifier, fingerprints and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{checkpoint_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
