"""Exact deduplication by two-pass Bloom filtering. DataFrame functions only.

Pass 1 hashes every normalised text and builds, relationally, a blocked Bloom filter whose bits say
"at least two rows hashed here": a row's hash names a page of 32768 bits and `PROBES` bits in it.
The narrow (page, bit) pairs of all rows shuffle for that, combined before they do, no row or text.
Pass 2 tests every row against the filter: only rows whose bits are all set may be repeated and
shuffle; the rest pass straight through as groups of one.

The filter grows with the rows, by `bits_per_row`. Up to `filter_bits` (32 MB, 16 million rows) its
pages are broadcast. A larger one meets the rows by page in a join: one plan whatever the size, but
every row that is tested then shuffles once, in `exact_dedup` as a narrow row of ids and a hash,
in `drop_exact_copies` with its text. Texts are read once by the one and twice by the other.

Defined results: null text counts as empty text; null ids sort last, so a group of nulls alone
keeps one of its rows with a null keep_id; of repeated rows with one id, one stays; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, attach_groups, count_rows, discard, documents, materialize

PAGE = 32768
PROBES = 2
#: The largest filter that is broadcast, in bits.
FILTER_BITS = 1 << 28


def text_digest(text: Column) -> Column:
    """SHA-256, in lowercase hex, of the text with every run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "), 256)


def raw_digest(text: Column) -> Column:
    """SHA-256, in lowercase hex, of the text as it is, a colon and its length in bytes; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.concat_ws(":", F.sha2(text, 256), F.octet_length(text))


def _page(pages: int) -> Column:
    return F.pmod(F.xxhash64("sha", F.lit(0)), F.lit(pages)).alias("page")


def _bit(k: int) -> Column:
    return F.pmod(F.xxhash64("sha", F.lit(k + 1)), F.lit(PAGE)).cast("int")


def _repeated_cells(rows: DataFrame, pages: int) -> DataFrame:
    """Pages of the filter, 4 KB each: the bits to which at least two rows hash."""
    cell = rows.select(_page(pages), F.explode(F.array_distinct(F.array(*[_bit(k) for k in range(PROBES)]))).alias("bit"))
    twice = cell.groupBy("page", "bit").count().filter("count > 1")
    return twice.groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def maybe_repeated(rows: DataFrame, n: int, bits_per_row: int, filter_bits: int, hashed: DataFrame | None = None) -> DataFrame:
    """`rows` with a boolean column `maybe`: true for every row whose `sha` occurs twice, and for few others.

    `hashed` has the `sha` of each of the n rows, if there is a narrower table of them.
    """
    pages = max(1, -(-n * bits_per_row // PAGE))
    found = materialize(_repeated_cells(rows if hashed is None else hashed, pages), "exact-pages")
    if pages * PAGE <= filter_bits:
        found = F.broadcast(found)
    bit = " AND ".join(f"(shiftright(cast(conv(hex(substring(bitmap, bit_{k} div 8 + 1, 1)), 16, 10) as int), bit_{k} % 8) & 1) = 1" for k in range(PROBES))
    probed = rows.withColumns({"page": _page(pages), **{f"bit_{k}": _bit(k) for k in range(PROBES)}})
    return probed.join(found, "page", "left").select(*rows.columns, F.coalesce(F.expr(bit), F.lit(False)).alias("maybe"))


def exact_groups(narrow: DataFrame, rows: int, bits_per_row: int = 16, filter_bits: int = FILTER_BITS) -> DataFrame:
    """`narrow` (doc_id, rid, sha) with keep_id, group_size and kept. It must be a written table."""
    tested = materialize(maybe_repeated(narrow, rows, bits_per_row, filter_bits), "exact-tested")
    flagged = tested.filter("maybe").select("doc_id", "rid", "sha")
    alone = tested.filter("NOT maybe").select("doc_id", "rid", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    groups = flagged.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "exact-groups")
    met = attach_groups(flagged, groups, "sha", "group_size", rows)
    met = met.select("doc_id", "rid", "sha", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.rid") == F.col("rid")).alias("kept"))
    discard(narrow)
    return alone.unionByName(met)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=text_digest, **sizes) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("sha")).withColumn("rid", F.monotonically_increasing_id())
    narrow = materialize(narrow, "exact-narrow")
    found = exact_groups(narrow, count_rows(narrow), **sizes)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, filter_bits: int = FILTER_BITS, digest=text_digest) -> DataFrame:
    """`docs` with one row of each group of equal texts: the smallest id, nulls last.

    Flagged rows are combined to the winner before they shuffle, so a hot group costs one row a task;
    unflagged rows, texts included, do not shuffle while the filter is broadcast.
    """
    hashed = docs.select(digest(F.col(text_col)).alias("sha"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("sha"))
    tested = maybe_repeated(marked, docs.count(), bits_per_row, filter_bits, hashed)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    won = tested.filter("maybe").groupBy("sha").agg(F.min_by("row", order).alias("row")).select("row.*")
    return tested.filter("NOT maybe").select("row.*").unionByName(won)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256
FROM d
"""
