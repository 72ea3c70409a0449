"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and the six ASCII controls 9 to 13.
WS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or the context's checkpoint folder.

    Where both are unset, a temporary folder serves a session whose executors run on this machine
    (tests); on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quillon-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function on Arrow batches that hands its memory back when a task ends: workers outlive tasks and stages."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return inner


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, sort: list[str] | None = None, **options: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back; this cuts the lineage. `options`: of the writer."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more: all that came of them is written itself."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            sc = table.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def count_rows(df: DataFrame) -> int:
    """Rows of a written table: Parquet footers answer it."""
    return df.count()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text: its maximal runs of characters that are not white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of `rows` to `groups` (one row per `key`, its row count in `count`), safe for hot keys.

    Groups that hold at least total/share rows are at most `share` in number, whatever the data;
    they are broadcast. All other keys hold fewer than total/share rows and meet in a shuffle.
    Rows whose key is null or has no group get nulls.
    """
    least = max(2, -(-total // share))
    added = [c for c in groups.columns if c != key]
    big = F.broadcast(groups.filter(F.col(count) >= least).select(F.col(key), *[F.col(c).alias(f"hot__{c}") for c in added]))
    tried = rows.join(big, key, "left")
    hot = tried.filter(F.col(f"hot__{count}").isNotNull()).select(*rows.columns, *[F.col(f"hot__{c}").alias(c) for c in added])
    rest = tried.filter(F.col(f"hot__{count}").isNull()).select(*rows.columns)
    cold = rest.join(groups.filter(F.col(count) < least), key, "left").select(*rows.columns, *added)
    return hot.unionByName(cold)
