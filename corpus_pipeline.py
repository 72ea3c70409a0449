"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of `documents`. `run` writes each stage's rows as Parquet into the shared folder and reads them back
for the next, so a lost executor costs a stage's own work alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, language_id, minhash, mixing, packing
from quillon.llm.common import documents, materialize

#: A text counts as in no learned language if its likeness is this many standard deviations of labelled texts below their mean.
MIN_LIKENESS = -4.0


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those far less like the learned languages than labelled texts are (`Likeness`)."""
    net, langs, likeness = language_id.fit_with_likeness(docs)
    judged = language_id.predict(docs, net, langs, names_out=("__language", "__score", "__likeness"), likeness=likeness)
    return judged.filter((F.col("__language") != "und") & (F.col("__likeness") >= MIN_LIKENESS)).drop("__language", "__score", "__likeness")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the smallest doc_id stays."""
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws: a row per document and round in which it is drawn."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The network of the first stage has no SQL form: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
