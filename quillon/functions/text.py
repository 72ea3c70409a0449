"""String rules of the query language as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters of U+00C0 to U+00FF and the plain letters they fold to; the two ligatures fold to two letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIIDNOOOOOOUUUUYaaaaaaceeeeiiiidnoooooouuuuyy"
LIGATURES = (("Æ", "AE"), ("æ", "ae"))
#: How tables are stored: version 2 keeps the differences of neighbouring numbers instead of the numbers.
STORED = {"compression": "zstd", "parquet.writer.version": "v2"}


def fold_case(c: Column) -> Column:
    """ASCII letters alone."""
    return F.translate(c, UPPER, LOWER)


def fold_accents(c: Column) -> Column:
    c = F.translate(c, ACCENTED, PLAIN)
    for whole, parts in LIGATURES:
        c = F.replace(c, F.lit(whole), F.lit(parts))
    return c


def fold(c: Column, flags: str) -> Column:
    c = fold_accents(c) if "d" in flags else c
    return fold_case(c) if "c" in flags else c


def components(c: Column) -> Column:
    """The set of a multivalue: distinct non-empty parts in order; the missing value has none."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, "[|]"), lambda x: (x != "") & (x != "_"))))


def feature(c: Column, name: str) -> Column:
    """The value of one key of a Key=Value bundle; the first counts; `_` if absent."""
    found = F.try_element_at(F.filter(F.split(c, "[|]"), lambda x: F.startswith(x, F.lit(f"{name}="))), F.lit(1))
    return F.coalesce(F.substring(found, len(name) + 2, 1 << 30), F.lit("_"))


def prefix_sums(df: DataFrame, order: str, value: str, out: str, rows: int) -> DataFrame:
    """`df` with `out` = the sum of `value` over all rows before it in the order of a unique long column, dense in 0 to `rows` (`numbered` makes one).

    Two levels of about sqrt(rows) each, so no window holds more than that.
    """
    width = max(1, math.isqrt(max(1, rows)))
    low = F.expr(f"`{order}` div {width}")
    part = df.withColumn("__bucket", low)
    sums = part.groupBy("__bucket").agg(F.sum(value).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return part.join(bases, "__bucket").withColumn(out, F.col("__base") + F.col("__in")).drop("__bucket", "__base", "__in")


def numbered(df: DataFrame, order: list[str], out: str, path: str) -> DataFrame:
    """`df` with `out` = 0, 1, 2... in the order of the columns, kept as Parquet under `path`.

    A prefix count of two levels: the place inside a range of rows, and the sum of the sizes of the
    ranges before it. Ranges are cut by all columns, so a hot first column is spread over many.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows.write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row per task of the shuffle
    bases = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return rows.join(F.broadcast(bases), "__range").withColumn(out, F.col("__base") + F.col("__at")).drop("__range", "__at", "__base")


def numbered_with_sums(df: DataFrame, order: list[str], out: str, count: Callable[[DataFrame], DataFrame], sums: dict[str, str], path: str) -> DataFrame:
    """`numbered`, and for each item `name: before` of `sums` the long column `name`, which `count` adds to rows, and `before`, its sum over all rows before.

    The rows shuffle once: sums inside a range are kept up as it is written, in order, and one row
    per range carries them on.
    """
    rows = count(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__at", F.monotonically_increasing_id())
    names = list(rows.columns)
    places = [names.index(n) for n in sums]
    added = list(sums.values())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", `{n}` long" for n in added)

    def run(batches):
        so_far = [0] * len(places)
        for batch in batches:
            more = []
            for k, at in enumerate(places):
                n = batch.column(at).to_numpy()
                upto = np.cumsum(n) + so_far[k]
                more.append(pa.array(upto - n))
                so_far[k] = int(upto[-1]) if len(n) else so_far[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *added])

    rows.mapInArrow(run, schema).write.options(**STORED).parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(n).alias(f"__{n}") for n in sums])
    bases = sizes.select("__range", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in ("n", *sums)])
    rows = rows.join(F.broadcast(bases), "__range").withColumn(out, F.col("__n") + F.col("__at"))
    rows = rows.withColumns({before: F.col(before) + F.col(f"__{n}") for n, before in sums.items()})
    return rows.drop("__range", "__at", "__n", *[f"__{n}" for n in sums])
