"""Token ids in ORC: stripes with integer run-length encoding, row indexes, Bloom filters on document ids.

`write_tokens` deals texts by ascending id, tokenises each range and writes one ORC file a range:
columns doc_id, local_start (ids before it in the file), n_tokens, ids. Files are read stripe by
stripe in parallel; `lookup` pushes its id predicate into the reader, which skips stripes and row
groups by their minima, maxima and Bloom filters. A small `index` table holds, per file, the first
position and the number of ids, so positions over the whole corpus need no pass over the ids.

Ranges are as many as the input has splits, or as the session's shuffle partitions if those are more.

Defined results: null text is an empty text, which has the end id alone; null ids come first;
rows with equal ids stand in the order of their text's hash; an added token in a text gets its own id; an empty table gives empty files;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, released, scratch
from .encode import default_path, encoder, in_chunks

SCHEMA = "doc_id long, local_start long, n_tokens long, ids array<int>"
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, kind: str = "word", end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write `path`/tokens and `path`/index."""
    file, end = tokenizer or default_path("word_bpe_49k.json"), b"" if end_id is None else end_id.to_bytes(4, "little")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(file, kind), 0
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for a, b in in_chunks(texts):
                ids = [x + end for x in enc.encode(texts.slice(a, b - a))]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(n)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(at + ends - n), pa.array(n), lists], names=["doc_id", "local_start", "n_tokens", "ids"])
                at += int(ends[-1])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    splits = docs.rdd.getNumPartitions()
    by = [splits] if splits > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    dealt = rows.repartitionByRange(*by, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(released(tokens), SCHEMA).write.options(**ORC).orc(f"{path}/tokens")
    files = _files(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("first_position", before).write.orc(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(f"{path}/tokens").select("*", F.col("_metadata.file_name").alias("file"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (position in the whole corpus), n_tokens, ids. The index has one row a file."""
    index = spark.read.orc(f"{path}/index").select("file", "first_position")
    rows = _files(spark, path).join(index, "file")
    return rows.select("doc_id", (F.col("first_position") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups that can't hold them are not read."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def with_crc(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).data.cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(released(crc), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-orc")
    write_tokens(documents(spark, sf_dir), path)
    return with_crc(read_tokens(spark, path))
