"""Incremental ingest: documents that arrive in a stream become token rows, positions allotted per micro-batch.

A batch's documents follow all earlier ones, in order of doc_id. The next free position is read from
the table of finished batches, so a batch that is run again gets the same positions and replaces
its own rows: each has a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import numbered
from ..sources.tables import annotated, lines_to_tokens

BATCHES = "batch long, first long, size long, sents long"


def _done(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCHES).parquet(f"{path}/batches/*")


def append(docs: DataFrame, batch: int, path: str) -> None:
    """Write one batch of documents (doc_id, text) as tokens under `path`."""
    spark = docs.sparkSession
    spark.createDataFrame([], BATCHES).write.mode("overwrite").parquet(f"{path}/batches/start")
    before = _done(spark, path).filter(F.col("batch") < batch).agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("sents"), F.lit(0))).first()
    docs = numbered(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), ["doc_id"], "rid", f"{path}/numbered/{batch}-{uuid.uuid4().hex}")
    tokens, sents = lines_to_tokens(docs, docs.count())
    tokens = annotated(tokens).drop("rid").withColumn("pos", F.col("pos") + before[0]).withColumn("sent_id", F.col("sent_id") + before[1]).withColumn("head_pos", F.col("head_pos") + before[0])
    tokens.write.mode("overwrite").parquet(f"{path}/tokens/batch={batch}")
    n = sents.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("s")).first()
    spark.createDataFrame([(batch, before[0], n["n"], n["s"])], BATCHES).write.mode("overwrite").parquet(f"{path}/batches/{batch}")


def ingest(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing a stream of documents; `tokens_of` reads what has arrived."""
    writer = docs.writeStream.foreachBatch(lambda df, k: append(df, k, path)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def tokens_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tokens").drop("batch")
