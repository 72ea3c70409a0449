"""Removal of repeated substrings by longest-previous-factor arrays.

A byte goes if it lies in a string of `LENGTH` bytes that also starts earlier: in a document with a
smaller id, or before in the same document. The work is cut so that every pair of equal strings
meets in one suffix array of bounded size:

1. Whole copies of an earlier document go as such; one document of each text goes on. Texts are cut
   into pieces of at most `CHUNK` bytes that overlap by LENGTH - 1, so no step holds a long text.
2. Each string is owned by its minimizer, the smallest hash of its `K`-grams, so equal strings have
   equal owners. Chunks of pieces send the distinct owner hashes to buckets, which answer with those
   that occur more than once in the corpus. All other strings are unique. A row holds the hashes of
   a chunk for a bucket, so there are never more rows than distinct owners in the chunks.
3. Fragments (the strings of neighbouring starts that have one owner, at most `MOST`) meet by owner.
   Of fragments with equal bytes the first goes on; the others are later in all their strings.
4. Over batches of whole owners a task builds the suffix order of the fragments, laid end to end in
   order of document and place, by prefix doubling. For each suffix the nearest suffixes in that
   order with a smaller place, before and after it, share the longest prefix with any earlier text:
   the longer of the two, compared byte by byte up to LENGTH, is its longest previous factor. Where
   that reaches LENGTH the string is a later copy; the first one stays.
5. An owner with more than `HOT` fragments is dealt over several groups; strings that are first in
   their group then meet by their bytes, combined before they shuffle, to find the first of all.

Hashes only decide which strings meet; what is removed is decided on bytes alone.

Defined results: null text is empty; null ids count as after all others; rows that repeat an id and a
text: one is first; texts below LENGTH bytes lose nothing; an empty table gives an empty result;
other columns are not read. `cleaned` may cut inside a UTF-8 character: it gives bytes. A text and
the runs to remove from it meet in one row, so a text is limited by Spark's 2 GB of a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, materialize, release, released
from .exact_dedup import drop_exact_copies, exact_dedup, raw_digest

LENGTH = 100
K = 32
SPAN = LENGTH - K + 1
MOST = 512
CHUNK = 4 << 20
STEP = 1 << 20
BATCH = 1 << 20
HOT = 16384
OWNERS = 400_000
_RNG = np.random.default_rng(8)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = {s: _RNG.integers(0, 2**63, dtype=np.uint64) | np.uint64(1) for s in (1, 2, 4, 8, 16)}
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_PLACE = np.uint64((1 << 24) - 1)


def _hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes at every place, K a power of two, by doubling."""
    h, s = _BYTE[data], 1
    while 2 * s <= K:
        h = h[: len(h) - s] * _MULT[s] + h[s:]
        s *= 2
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(29)
    return h


def owners(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces laid end to end: runs of string starts with one owner, as first start, last start, the owner's hash, and 2 if it occurs again in the run, else 1.

    A run goes on while the hash stays, so one byte or one period over and over is one run, cut at MOST starts.
    """
    firsts, lasts, hashes, times = [], [], [], []
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside, dtype=np.int32)[:-1] > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    for a in range(0, len(data) - LENGTH + 1, STEP):
        b = min(a + STEP, len(data) - LENGTH + 1)
        if not inside[a:b].any():
            continue
        h = _hashes(data[a : b + LENGTH - 1])
        m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        s = 1
        while 2 * s <= SPAN:
            m = np.minimum(m[: len(m) - s], m[s:])
            s *= 2
        m = np.minimum(m[: len(m) - (SPAN - s)], m[SPAN - s :])
        ok = np.flatnonzero(inside[a:b])
        at = (m & _PLACE).astype(np.int64)[ok]
        own = h[at]
        heads = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (np.diff(ok) != 1) | edge[a + ok[1:]]) + 1])
        tails = np.concatenate([heads[1:] - 1, [len(ok) - 1]])
        moves = np.concatenate([[0], np.cumsum(np.diff(at) != 0)])
        parts = (tails - heads) // MOST + 1
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(a + ok[heads], parts) + nth * MOST
        firsts.append(first), lasts.append(np.minimum(first + MOST - 1, np.repeat(a + ok[tails], parts)))
        hashes.append(np.repeat(own[heads], parts)), times.append(np.repeat(1 + (moves[tails] > moves[heads]), parts))
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes), np.concatenate(times)


def packed_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number whose order is theirs."""
    word = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(data)]
    return word


def suffix_order(word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers of the suffixes at `starts` (ascending) in order of their first LENGTH bytes, then of place.

    Ranks of 8, 16, 32, 64 bytes by prefix doubling, then LENGTH by two ranks that overlap.
    """
    rank, s = np.unique(word, return_inverse=True)[1].astype(np.uint64), 8
    while 2 * s < LENGTH:
        rank = np.unique((rank[: len(rank) - s] << np.uint64(32)) | rank[s:], return_inverse=True)[1].astype(np.uint64)
        s *= 2
    return np.argsort((rank[starts] << np.uint64(32)) | rank[starts + LENGTH - s], kind="stable")


def smaller_before(places: np.ndarray) -> np.ndarray:
    """For each place in a row the index of the nearest one to its left that is smaller, or -1. All places differ.

    Every element starts at its neighbour and jumps on to where that one has come while it is larger:
    all between it and the element are larger, so nothing is passed over.
    """
    found = np.arange(-1, len(places) - 1)
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[places[found[open_]] > places[open_]]
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found


def common_bytes(word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes from places a and b on are the same, up to LENGTH."""
    out = np.full(len(a), LENGTH, np.int64)
    left = np.arange(len(a))
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        x = word[a[left] + k] ^ word[b[left] + k]
        differ = x != 0
        y, same = x[differ], np.zeros(int(differ.sum()), np.int64)
        for j in range(1, 8):
            same += y < np.uint64(1 << (64 - 8 * j))
        out[left[differ]] = k + same
        left = left[~differ]
        if not len(left):
            break
    return out


def longest_previous_factors(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each suffix at `starts` (ascending) the longest prefix, up to LENGTH, that one at an earlier start has too."""
    word = packed_words(data)
    order = suffix_order(word, starts)
    lpf = np.zeros(len(starts), np.int64)
    n = len(order)
    for found in (smaller_before(order), n - 1 - smaller_before(order[::-1])[::-1]):
        has = np.flatnonzero((found >= 0) & (found < n))
        own, other = order[has], order[found[has]]
        lpf[own] = np.maximum(lpf[own], common_bytes(word, starts[own], starts[other]))
    return lpf


def _deal(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, sha with rid (a number) and chunk (about CHUNK bytes of neighbours; a longer text has as many chunks of its own as it needs, from this one on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, row, chunk, size = TaskContext.get().partitionId() << 36, 0, 0, 0
        for batch in batches:
            chunks = []
            for n in pc.binary_length(batch.column(1)).to_pylist():
                if size and size + n > CHUNK:
                    chunk, size = chunk + 1, 0
                chunks.append(base + chunk)
                if n > CHUNK:
                    chunk, size = chunk - (-n // CHUNK), 0
                else:
                    size += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + np.arange(row, row + len(chunks))), pa.array(chunks, pa.int64())], names=["doc_id", "text", "sha", "rid", "chunk"])
            row += len(chunks)

    return docs.mapInArrow(released(run), "doc_id long, text string, sha string, rid long, chunk long")


def pieces(docs: DataFrame) -> DataFrame:
    """chunk, doc_id, rid, base (where the piece begins in its text), bytes."""
    names = ["chunk", "doc_id", "rid", "base", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(3)).to_numpy()
            short = pa.array(sizes <= CHUNK)
            some = batch.filter(short)
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(np.zeros(len(some), np.int64)), some.column(3).cast(pa.binary())], names=names)
            for k in np.flatnonzero(sizes > CHUNK).tolist():
                chunk, doc_id, rid = (batch.column(c)[k].as_py() for c in range(3))
                text = memoryview(batch.column(3)[k].as_buffer())
                for nth, a in enumerate(range(0, len(text), CHUNK)):
                    yield _deal(names, [pa.int64()] * 4 + [pa.binary()], [(chunk + nth, doc_id, rid, a, bytes(text[a : a + CHUNK + LENGTH - 1]))])

    return docs.select("chunk", "doc_id", "rid", "text").mapInArrow(released(run), "chunk long, doc_id long, rid long, base long, bytes binary")


def _laid(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array end to end, and where each ends."""
    at = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    raw = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(parts) else np.empty(0, np.uint8)
    return raw, at[1:] - at[0]


def owner_hashes(parts: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, hashes, times: the distinct owners of a chunk with their counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(chunks)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunks)], strict=True):
                _, _, own, times = owners(*_laid(batch.column(1).slice(a, b - a)))
                h, code = np.unique(own, return_inverse=True)
                n = np.bincount(code, weights=times, minlength=len(h)).astype(np.uint32)
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                rows = [(int(chunks[a]), int(k), h[own].tobytes(), n[own].tobytes()) for k, own in zip(found, np.split(order, first[1:]), strict=True)] if len(h) else []
                yield _deal(["chunk", "bucket", "hashes", "times"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows)

    return parts.select("chunk", "bytes").mapInArrow(released(run), "chunk long, bucket long, hashes binary, times binary")


def repeated_owners(hashes: DataFrame) -> DataFrame:
    """chunk, hashes, times: the owners of each chunk that occur twice or more in the corpus, and how often."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        h = np.concatenate(parts)
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("times").to_pylist()]).astype(np.int64)
        _, code = np.unique(h, return_inverse=True)
        total = np.bincount(code, weights=n).astype(np.int64)[code]
        rows, at = [], 0
        for chunk, part in zip(chunks, parts, strict=True):
            own = total[at : at + len(part)]
            at += len(part)
            many = own > 1
            if many.any():
                rows.append((chunk, part[many].tobytes(), own[many].tobytes()))
        release()
        return pa.Table.from_batches([_deal(["chunk", "hashes", "times"], [pa.int64(), pa.binary(), pa.binary()], rows)])

    return hashes.groupBy("bucket").applyInArrow(run, "chunk long, hashes binary, times binary")


def fragments(parts: DataFrame, repeated: DataFrame, buckets: int, most: int = HOT) -> DataFrame:
    """hot, key, owner, inner (the owner occurs again inside), late (null id), doc_id, rid, start, stop, bytes: the fragments of repeated owners.

    Of a chunk's fragments with equal bytes the first carries them; the others (bytes null) are later in all their strings.
    """
    kinds = [("hot", pa.bool_()), ("key", pa.int64()), ("owner", pa.int64()), ("inner", pa.bool_()), ("late", pa.bool_()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("bytes", pa.binary())]

    def run(parts: pa.Table, repeated: pa.Table) -> pa.Table:
        if not parts.num_rows or not repeated.num_rows:
            return pa.schema(kinds).empty_table()
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in repeated.column("hashes").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in repeated.column("times").to_pylist()])
        order = np.argsort(h)
        h, n = h[order], n[order]
        data, ends = _laid(parts.column("bytes").combine_chunks())
        first, last, own, inner = owners(data, ends)
        at = np.minimum(np.searchsorted(h, own), len(h) - 1)
        keep = h[at] == own
        first, last, own, inner, times = first[keep], last[keep], own[keep], inner[keep] > 1, n[at][keep]
        piece = np.searchsorted(ends, first, side="right")
        begin = np.concatenate([[0], ends[:-1]])
        ids = parts.column("doc_id").combine_chunks()
        late, ids = ids.is_null().to_numpy(zero_copy_only=False)[piece], ids.fill_null(0).to_numpy()[piece]
        rid, start = parts.column("rid").to_numpy()[piece], first - begin[piece] + parts.column("base").to_numpy()[piece]
        sizes = last - first + LENGTH
        hot = times > most
        salt = ((rid.astype(np.uint64) * _M2 + start.astype(np.uint64)) * _M1 >> np.uint64(33)) % (times // most + 1).astype(np.uint64)
        key = np.where(hot, (own ^ ((salt + np.uint64(1)) * _M2)).view(np.int64), (own % np.uint64(buckets)).astype(np.int64))
        stops = np.cumsum(sizes)
        raw = data[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(first - (stops - sizes), sizes)]
        bytes_of = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
        code = bytes_of.dictionary_encode().indices.to_numpy()
        place = np.lexsort((start, rid, ids, late))
        again = np.ones(len(code), bool)
        again[place[np.unique(code[place], return_index=True)[1]]] = False
        carried = pc.if_else(pa.array(again), pa.scalar(None, pa.large_binary()), bytes_of).cast(pa.binary())
        cols = [hot, key, own.view(np.int64), inner, late, ids, rid, start, start + sizes]
        return pa.table([*map(pa.array, cols), carried], schema=pa.schema(kinds))

    left = parts.groupBy("chunk")
    return left.cogroup(repeated.groupBy("chunk")).applyInArrow(run, "hot boolean, key long, owner long, inner boolean, late boolean, doc_id long, rid long, start long, stop long, bytes binary")


def judged(found: DataFrame) -> DataFrame:
    """rid, low, high: byte runs to remove; and for hot owners' strings that are first in their group also string, late, doc_id."""
    schema = pa.schema([("rid", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("string", pa.binary()), ("late", pa.bool_()), ("doc_id", pa.int64())])

    def runs(rid: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Table:
        n = len(rid)
        return pa.table([pa.array(rid, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), *[pa.nulls(n, t) for t in schema.types[3:]]], schema=schema)

    def run(table: pa.Table) -> pa.Table:
        hot = table.column("hot")[0].as_py()
        col = {c: table.column(c).to_numpy() for c in ("owner", "inner", "late", "doc_id", "rid", "start", "stop")}
        bytes_of = table.column("bytes").combine_chunks()
        there = bytes_of.is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((col["start"], col["rid"], col["doc_id"], col["late"], col["owner"]))
        order = order[there[order]]
        code = bytes_of.dictionary_encode().indices.fill_null(-1).to_numpy()
        fresh = np.sort(np.unique(code[order], return_index=True)[1])
        first = order[fresh]
        gone = np.concatenate([np.delete(order, fresh), np.flatnonzero(~there)])
        out = [runs(col["rid"][gone], col["start"][gone], col["stop"][gone])]
        owner = col["owner"][first]
        heads = np.flatnonzero(np.diff(owner, prepend=owner[:1] ^ 1))
        counts = np.diff(heads, append=len(owner))
        first = first if hot else first[np.repeat(counts > 1, counts) | col["inner"][first]]
        owner = col["owner"][first]
        stops = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner)) if len(owner) else np.empty(0, np.int64)
        total = np.cumsum((col["stop"] - col["start"])[first])
        begin = 0
        while begin < len(first):
            # batches end where an owner ends
            done = total[begin - 1] if begin else 0
            k = np.searchsorted(total[stops - 1], done + BATCH, side="right") - 1
            stop = int(stops[max(k, np.searchsorted(stops, begin, side="right"))])
            own, begin = first[begin:stop], stop
            data, ends = _laid(bytes_of.take(pa.array(own)))
            valid = np.ones(len(data), bool)
            valid[(ends[:, None] - np.arange(1, LENGTH)[None, :]).ravel()] = False
            starts = np.flatnonzero(valid)
            later = longest_previous_factors(data, starts) >= LENGTH
            piece = np.searchsorted(ends, starts, side="right")
            place = col["start"][own][piece] + starts - np.concatenate([[0], ends[:-1]])[piece]
            rid = col["rid"][own][piece]
            if later.any():
                r, p = rid[later], place[later]
                cut = np.flatnonzero((np.diff(p) > LENGTH) | (np.diff(p) < 0) | (np.diff(r) != 0)) + 1
                heads = np.concatenate([[0], cut])
                out.append(runs(r[heads], p[heads], p[np.concatenate([cut - 1, [len(p) - 1]])] + LENGTH))
            if hot:
                rest = ~later
                text = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), int(rest.sum()), [None, pa.py_buffer(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts[rest]].tobytes())])
                out.append(pa.table([pa.array(rid[rest]), pa.array(place[rest]), pa.array(place[rest] + LENGTH), text.cast(pa.binary()), pa.array(col["late"][own][piece][rest]), pa.array(col["doc_id"][own][piece][rest])], schema=schema))
        release()
        return pa.concat_tables(out)

    return found.groupBy("hot", "key").applyInArrow(run, "rid long, low long, high long, string binary, late boolean, doc_id long")


def removals(docs: DataFrame, total_bytes: int, hot: int = HOT) -> DataFrame:
    """rid and the byte runs to remove, of a written table of `numbered` documents with different texts."""
    spark = docs.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total_bytes // 35 // OWNERS)
    repeated = materialize(repeated_owners(owner_hashes(pieces(docs), buckets)), "suffix-owners", compression="zstd")
    found = materialize(judged(fragments(pieces(docs), repeated, buckets, hot)), "suffix-judged", compression="zstd")
    discard(repeated)
    first = found.filter("string IS NOT NULL")
    place = F.struct("late", "doc_id", "rid", "low")
    firsts = first.groupBy("string").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    more = first.join(firsts, "string").filter((F.col("best.rid") != F.col("rid")) | (F.col("best.low") != F.col("low"))).select("rid", "low", "high")
    out = materialize(found.filter("string IS NULL").select("rid", "low", "high").unionByName(more), "suffix-runs", compression="zstd")
    discard(found)
    return out


def cut(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """sha, n_bytes, n_removed, n_spans, kept_sha256, cleaned (binary) of each of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keep, at, removed, n = [], 0, 0, 0
                low = high = -1
                for s in [*sorted((x["low"], x["high"]) for x in spans), (len(text) + 1, 0)]:
                    if s[0] <= high:
                        high = max(high, s[1])
                        continue
                    if high >= 0:
                        keep.append(text[at:low])
                        at, removed, n = high, removed + high - low, n + 1
                    low, high = s
                keep.append(text[at:])
                text = b"".join(keep)
                rows.append((sha, removed, n, hashlib.sha256(text).hexdigest(), text))
            yield _deal(["sha", "n_removed", "n_spans", "kept_sha256", "cleaned"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()], rows)

    spans = runs.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return docs.select("rid", "sha", "text").join(spans, "rid").select("sha", "text", "spans").mapInArrow(released(run), "sha string, n_removed long, n_spans long, kept_sha256 string, cleaned binary")


class Repeats:
    """`unique`: the first document of each text of LENGTH bytes or more, numbered; `runs`: their byte runs that go."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT):
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        unique = drop_exact_copies(self.rows, digest=raw_digest).filter(F.octet_length("text") >= LENGTH).withColumn("sha", F.sha2("text", 256))
        self.unique = materialize(numbered(unique), "suffix-unique", compression="zstd")
        size = self.unique.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.runs = removals(self.unique, size, hot)


def suffix_dedup(docs: DataFrame, **cols) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `docs`."""
    found = Repeats(docs, **cols)
    done = materialize(cut(found.unique, found.runs).drop("cleaned"), "suffix-cut")
    discard(found.unique, found.runs)
    rows = exact_dedup(found.rows, digest=raw_digest)
    rows = rows.select("doc_id", "kept", F.substring_index("text_sha256", ":", 1).alias("sha"), F.substring_index("text_sha256", ":", -1).cast("long").alias("n_bytes"))
    # texts too short to lose anything, and copies, which lose all they have, need no join
    short, gone = F.col("n_bytes") < LENGTH, ~F.col("kept") & (F.col("n_bytes") >= LENGTH)
    untouched = rows.filter(short).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    first = rows.filter(~short & ~gone).join(done, "sha", "left")
    first = first.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    copies = rows.filter(gone).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    return first.unionByName(copies).unionByName(untouched)


def cleaned(docs: DataFrame, **cols) -> DataFrame:
    """doc_id and cleaned (binary): what is left of each document. Whole copies of an earlier one have no row."""
    found = Repeats(docs, **cols)
    short = found.rows.filter(F.octet_length("text") < LENGTH).select("doc_id", F.col("text").cast("binary").alias("cleaned"))
    part = cut(found.unique, found.runs).select("sha", "cleaned")
    rest = found.unique.select("doc_id", "sha", "text").join(part, "sha", "left").select("doc_id", F.coalesce("cleaned", F.col("text").cast("binary")).alias("cleaned"))
    return short.unionByName(rest)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
