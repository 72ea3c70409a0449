"""Stupid-backoff language-model scores, computed relationally.

Every chunk of documents explodes its texts into n-grams and sends its count table, one row a hash
bucket; a bucket adds up the tables of all chunks and answers each chunk with the corpus counts of
those of its n-grams that occur elsewhere too; the counts join the exploded n-grams of the chunk by
hash, and log scores are summed per document. A hot n-gram is one entry a chunk, never a hot key.

A document is scored against all others: its own counts are taken away first. With c the counts
without the document's own and N the words of all other documents,
  S(w | h) = c(h w) / c(h)          if c(h w) > 0
           = 0.4 S(w | h')          else, h' being h without its first word
  S(w)     = c(w) / N               if c(w) > 0, else 1 / (N + 1)
The score is the mean natural logarithm of S over the words. Words are `[^\\x20\\x09-\\x0D]+` of the
text with A-Z lower-cased; h has at most order - 1 words and does not leave the document.

Defined results: null or empty text has 0 words and a null score; repeated rows are documents of
their own (each counts for the other); null ids are kept; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import from_planes, from_planes_of, packed, planes, planes_of, unpacked
from .common import documents, materialize, release, released
from .minhash import Words, _mix

ORDER = 2
CHUNK = 2 << 20
BACKOFF = 0.4
_SALT = np.random.default_rng(77).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def exploded(texts: list[bytes], order: int, memo: Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each word its document, and for n = 1..order the hash of the n-gram that ends there (0: it would leave the document)."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in words])
    doc = np.repeat(np.arange(len(texts)), sizes)
    h = np.fromiter((memo[x] for w in words for x in w), np.uint64, len(doc))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = [_mix(h * _SALT[0]) | np.uint64(1)]
    for n in range(1, order):
        acc = np.zeros(len(h), np.uint64)
        acc[1:] = _mix(grams[-1][:-1] * _SALT[n] + h[1:]) | np.uint64(1)
        acc[place < n] = 0
        grams.append(acc)
    return doc, grams


def _cuts(h: np.ndarray, buckets: int) -> list[int]:
    """Ascending hashes in ranges of equal width, one a bucket: hashes are uniform, so buckets are even."""
    edges = np.searchsorted(h, (np.arange(1, buckets, dtype=object) * 2**64 // buckets).astype(np.uint64))
    return [0, *edges.tolist(), len(h)]


def count_tables(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """chunk, bucket, hashes (planes), times: the n-grams of a chunk and their counts."""

    def run(batches):
        memo = Words()
        for batch in batches:
            for chunk, sizes, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                _, grams = exploded(unpacked(sizes, blob), order, memo)
                h, n = np.unique(np.concatenate(grams), return_counts=True)
                h, n = (h[1:], n[1:]) if len(h) and h[0] == 0 else (h, n)
                if not len(h):
                    continue
                cuts = _cuts(h, buckets)
                rows = [(chunk, k, planes(h[a:b]), planes_of(n[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "bucket", "hashes", "times"])

    return chunks.select("chunk", "sizes", "blob").mapInArrow(released(run), "chunk long, bucket long, hashes binary, times binary")


def corpus_counts(tables: DataFrame) -> DataFrame:
    """chunk, bucket, more, totals: of each count table which n-grams other chunks have too (a bit each, in order), and the corpus counts of these."""

    def run(table: pa.Table) -> pa.Table:
        parts = [from_planes(x) for x in table.column("hashes").to_pylist()]
        times = [from_planes_of(x) for x in table.column("times").to_pylist()]
        _, code = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(code, weights=np.concatenate(times)).astype(np.int64)[code]
        rows, at = [], 0
        for chunk, bucket, h, n in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), parts, times, strict=True):
            own = total[at : at + len(h)]
            at += len(h)
            more = own > n
            if more.any():
                rows.append((chunk, bucket, np.packbits(more).tobytes(), planes_of(own[more])))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        release()
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "bucket", "more", "totals"])

    return tables.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, more binary, totals binary")


def scored(chunks: DataFrame, counts: DataFrame, order: int, words: int, buckets: int) -> DataFrame:
    """doc_id, n_words, score"""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n_words, scores, memo = [], [], [], Words()
        found = list(zip(*(right.column(c).to_pylist() for c in ("bucket", "more", "totals")), strict=True))
        for doc_ids, sizes, blob in zip(*(left.column(c).to_pylist() for c in ("doc_ids", "sizes", "blob")), strict=True):
            doc, grams = exploded(unpacked(sizes, blob), order, memo)
            own_words = np.bincount(doc, minlength=len(doc_ids))
            rest = (words - own_words)[doc].astype(float)
            known, code, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            total = times.astype(np.int64)
            none = int(len(known) > 0 and known[0] == 0)
            cuts = _cuts(known[none:], buckets)
            for bucket, more, totals in found:
                a, b = cuts[bucket] + none, cuts[bucket + 1] + none
                total[a + np.flatnonzero(np.unpackbits(np.frombuffer(more, np.uint8), count=b - a))] = from_planes_of(totals)
            owned = _mix(known[code] ^ (np.tile(doc, order).astype(np.uint64) + np.uint64(1)) * _SALT[9])
            _, own, own_times = np.unique(owned, return_inverse=True, return_counts=True)
            count = (total[code] - own_times[own]).reshape(order, -1)
            score = np.where(count[0] > 0, count[0] / np.maximum(rest, 1), 1 / (rest + 1))
            for n in range(1, order):
                # the history of an n-gram is the shorter gram that ends one word before
                before = np.zeros(len(doc), np.int64)
                before[1:] = count[n - 1][:-1]
                there = grams[n] != 0
                hit = there & (count[n] > 0)
                score = np.where(hit, count[n] / np.maximum(before, 1), np.where(there, BACKOFF * score, score))
            sums = np.bincount(doc, weights=np.log(score), minlength=len(doc_ids))
            ids += doc_ids
            n_words += own_words.tolist()
            scores += [s / n if n else None for s, n in zip(sums.tolist(), own_words.tolist(), strict=True)]
        memo.clear()
        release()
        return pa.table([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "score"])

    return chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(run, "doc_id long, n_words long, score double")


def backoff_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score for each row of `docs`."""
    spark = docs.sparkSession
    chunks = materialize(packed(docs, id_col, text_col, CHUNK), "lm-chunks")
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    total = docs.agg(F.sum(words.cast("long")).alias("words"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (total["bytes"] or 0) // (8 << 20))
    counts = materialize(corpus_counts(count_tables(chunks, order, buckets)), "lm-counts")
    return scored(chunks, counts, order, total["words"] or 0, buckets)


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(documents(spark, sf_dir))
