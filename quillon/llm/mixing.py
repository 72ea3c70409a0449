"""Mixing sources to target weights by fixed-length blocks.

The words of a source, document after document, are packed into blocks of `block` words (a source
of fewer than 256 blocks takes shorter ones, so that its target is met too). Targets share the size
of all sources by weight; no target exceeds `most` times its source, and what is over is shared
again by weight. Each source gets a quota of slots that fill its target. The slots of all sources
are dealt over the output shards by multinomial draws, source by source, so the counts in a shard
are multinomial too, and those of all shards add up to the quotas. A source's slots, counted on
through the shards, go round by round through a pseudorandom permutation of its block indices (a
Feistel network with cycle walking), and slots join blocks by index. So each block is taken floor or
ceiling of quota/blocks times, never more than `most`.

Sources are rows of a table, as many as there are: the driver holds sums alone, draws are made in
tasks out of the seed and the source's number. Positions within a source come from sums by hash
bucket, so a hot source is spread over many tasks.

Defined results: null text has no words and is never taken; null is a source of its own, ordered
last; repeated rows are documents of their own; if no text has a word all targets are 0; an empty
table gives an empty result; other columns are passed through by `mixed_documents` alone. Reruns
agree, but for which of several rows with null ids or with equal ids and texts are taken how often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import numbered
from .common import attach_groups, documents, materialize, released, scratch, words

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 128
LEAST_BLOCKS = 256
MOST = 3


def source_table(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """From (source, size): source, documents, source_size, source_index, target, block (its words), blocks, quota.

    A source is held to `most` times its size if its size by weight is below a level; the level rises
    with what the held ones leave to the others, until no more are held.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")).withColumn("none", F.col("source").isNull())
    known = numbered(sums, ["none", "source"], "source_index", scratch(rows.sparkSession, "mix-order")).drop("none")
    known = materialize(known.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_index") % len(weights) + 1).cast("int"))), "mix-known")
    held, before = F.lit(False), -1
    while True:
        got = known.agg(F.sum(F.when(held, 0).otherwise(F.col("weight"))).alias("weight"), F.sum("source_size").alias("total"), F.sum(F.when(held, F.col("source_size")).otherwise(0)).alias("held"), F.sum(held.cast("long")).alias("n")).first()
        rest, weight = float((got["total"] or 0) - most * (got["held"] or 0)), got["weight"] or 1.0
        share = F.lit(rest) * F.col("weight") / F.lit(float(weight))
        if got["n"] in (None, before):
            break
        before, held = got["n"], held | (share > most * F.col("source_size"))
    size, target = F.col("source_size"), F.when(held, (most * F.col("source_size")).cast("double")).otherwise(share)
    own = F.least(F.lit(block), F.greatest(F.lit(1), F.expr(f"cast(source_size div {LEAST_BLOCKS} as int)")))
    out = known.select("source", "documents", "source_size", "source_index", target.alias("target"), own.alias("block")).withColumn("blocks", F.ceil(size / F.col("block")).cast("long"))
    quota = F.when(size == 0, 0).otherwise(F.least(most * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / size).cast("long")))
    return out.withColumn("quota", quota.cast("long"))


def dealt(quota: int, shards: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Shards and the slots of each, of a multinomial draw over all shards."""
    if quota < shards:
        return np.unique(rng.integers(0, shards, quota), return_counts=True)
    got = rng.multinomial(quota, np.full(shards, 1 / shards))
    return np.flatnonzero(got), got[got > 0]


def permuted(index: np.ndarray, size: int, key: int | list[int]) -> np.ndarray:
    """A pseudorandom permutation of range(size), keyed: four Feistel rounds on the next even power of two, walked until inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    consts = np.random.default_rng(key).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for c in consts:
            mixed = (right + np.uint64(1)) * c
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(31)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


class Mix:
    """The sources, their targets, and the tables of the mix."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 20, slots: int = 8192, max_shards: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.seed = seed
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col).cast("string"))).cast("long").alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), *([F.col("rid")] if "rid" in docs.columns else [F.monotonically_increasing_id().alias("rid")]))
        rows = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")))
        rows = materialize(rows, "mix-sizes")
        self.rows = rows.count()
        self.sources = materialize(source_table(rows, weights, most, block), "mix-sources")
        total = self.sources.agg(F.sum("quota")).first()[0] or 0
        self.shards = max(1, min(max_shards, -(-total // slots)))
        keyed = self.sources.withColumn("source_key", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))).drop("source", "blocks", "quota")
        self.docs = attach_groups(rows, keyed, "source_key", "documents", self.rows).drop("source_key", "documents")

    def picks(self) -> DataFrame:
        """One row a slot: shard, slot, source_index, round, block_index."""
        shards, seed = self.shards, self.seed

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, blocks, quota in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    shard, n = dealt(quota, shards, np.random.default_rng([seed, source]))
                    yield pa.RecordBatch.from_pydict({"source_index": pa.array(np.full(len(n), source)), "blocks": pa.array(np.full(len(n), blocks)), "shard": pa.array(shard), "first": pa.array(np.cumsum(n) - n), "n": pa.array(n)})

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, blocks, shard, first, n, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for a in range(0, n, 1 << 16):
                        k = np.arange(first + a, first + min(n, a + (1 << 16)))
                        rounds, index = k // blocks, k % blocks
                        for r in np.unique(rounds):
                            own = np.flatnonzero(rounds == r)
                            index[own] = permuted(index[own], blocks, [seed, source, int(r)])
                        yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(k), shard)), "slot": pa.array(at + a + np.arange(len(k))), "source_index": pa.array(np.full(len(k), source)), "round": pa.array(rounds.astype(np.int32)), "block_index": pa.array(index)})

        counts = self.sources.filter("quota > 0").select("source_index", "blocks", "quota").mapInArrow(released(deal), "source_index long, blocks long, shard long, first long, n long")
        before = Window.partitionBy("shard").orderBy("source_index").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
        return counts.mapInArrow(released(fill), "shard long, slot long, source_index long, round int, block_index long")

    def pieces(self) -> DataFrame:
        """One row a document and block that share words: rid, doc_id, source_index, block_index, piece_start, piece_words. A document without words has none."""
        buckets = max(1, math.ceil(4 * math.sqrt(max(1, self.rows))))
        own = self.docs.filter("size > 0").select("rid", "doc_id", "source_index", "block", "size", "h", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("rid")), "h"), F.lit(buckets)).alias("bucket"))
        sums = own.groupBy("source_index", "bucket").agg(F.sum("size").alias("n"))
        earlier = Window.partitionBy("source_index").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select("source_index", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source_index", "bucket").orderBy("doc_id", "h", "rid").rowsBetween(Window.unboundedPreceding, -1)
        placed = own.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["source_index", "bucket"]).withColumn("start", F.col("base") + F.col("inner"))
        cut = placed.select("rid", "doc_id", "source_index", "block", "size", "start", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")).alias("block_index"))
        low, high = F.greatest(F.col("block_index") * F.col("block"), F.col("start")), F.least((F.col("block_index") + 1) * F.col("block"), F.col("start") + F.col("size"))
        return cut.select("rid", "doc_id", "source_index", "block_index", (low - F.col("start")).alias("piece_start"), (high - low).alias("piece_words"))

    def taken(self) -> DataFrame:
        """rid and the words that the mix takes of each document that has any taken."""
        times = self.picks().groupBy("source_index", "block_index").agg(F.count(F.lit(1)).alias("times"))
        met = self.pieces().join(times.hint("merge"), ["source_index", "block_index"])
        return met.groupBy("rid").agg(F.sum(F.col("piece_words") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture, block by block: shard, slot, round, doc_id, piece_start, piece_words, rid; slots of a shard in order are its text."""
    m = Mix(docs, **options)
    return m.picks().hint("merge").join(m.pieces(), ["source_index", "block_index"])


def mixed_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """`docs` as the mix takes them: for each round in which a document is drawn, a row with the words
    drawn; the text stays as it is where all of it is drawn, else the drawn runs of words are joined
    by one space. `chars_col`, if there, is the new length in code points.
    """
    columns = docs.columns
    kept = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "mix-docs")
    m = Mix(kept.select("row.*", "rid") if "rid" not in columns else kept.select(*[F.col(f"row.`{c}`").alias(c) for c in columns if c != "rid"], "rid"), text_col=text_col, **options)
    drawn = m.picks().select("source_index", "block_index", "round").hint("merge").join(m.pieces(), ["source_index", "block_index"])
    drawn = drawn.groupBy("rid", "round").agg(F.array_sort(F.collect_list(F.struct("piece_start", "piece_words"))).alias("pieces"), F.sum("piece_words").alias("n"))
    met = kept.join(drawn.hint("merge"), "rid").withColumn("w", words(F.col(f"row.`{text_col}`")))
    parts = F.transform("pieces", lambda p: F.array_join(F.slice("w", (p["piece_start"] + 1).cast("int"), p["piece_words"].cast("int")), " "))
    text = F.when(F.col("n") == F.size("w"), F.col(f"row.`{text_col}`")).otherwise(F.array_join(parts, " "))
    met = met.withColumn("new_text", text)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    out = [F.col("new_text").alias(c) if c == text_col else F.char_length("new_text").cast(kinds[c]).alias(c) if c == chars_col else F.col(f"row.`{c}`").alias(c) for c in columns]
    return met.select(*out)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mix(documents(spark, sf_dir))
    return m.docs.join(m.taken().hint("merge"), "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
