"""Bounded-space online packing of token ids into windows.

Every partition tokenises its documents and packs them as they come: pieces of a full window stand
alone; a shorter piece goes best-fit into one of `open_windows` open windows; when none has room,
the fullest is emitted and a fresh one opened. What is still open at the end of a partition is
written apart, and a last pass merges these leftovers the same way, then cuts what remains into
full windows, so each merging task pads one window at most. No text is ever shuffled.

Defined results: null text is an empty text, which has the end id alone; an added token of the
tokenizer (`<|endoftext|>`) that stands in a text gets its own id, as the library has it; each row
is a document of its own, also when ids repeat or are null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, released
from .encode import default_path, encoder, in_chunks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, left boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("left", pa.bool_())])
#: Leftover pieces that one merging task handles; each task pads one window at most.
MERGE = 8192
FLUSH = 4096


class Packer:
    """Pieces (doc_id, start, ids, doc_tokens) go in; rows of SCHEMA come out in `rows`."""

    def __init__(self, window: int, open_windows: int, first_id: int, keep_ids: bool):
        self.window, self.most, self.next, self.keep = window, open_windows, first_id, keep_ids
        self.free: list[tuple[int, int]] = []  # (room, window's key), ascending
        self.open: dict[int, list[tuple]] = {}
        self.key, self.rows = 0, []

    def emit(self, pieces: list[tuple], left: bool = False) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next, at, ids if left or self.keep else None, left))
            at += n
        self.next += 1

    def place(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        k = bisect_left(self.free, (n, -1))
        if k == len(self.free):
            if len(self.free) == self.most:
                _, fullest = self.free.pop(0)
                self.emit(self.open.pop(fullest))
            room, key = self.window, self.key
            self.open[key], self.key = [], self.key + 1
        else:
            room, key = self.free.pop(k)
        self.open[key].append(piece)
        if room == n:
            self.emit(self.open.pop(key))
        else:
            insort(self.free, (room - n, key))

    def add(self, doc_id: int | None, ids: bytes, doc_tokens: int, start: int = 0) -> None:
        full = 4 * self.window
        for k in range(0, len(ids), full):
            piece = (doc_id, start + k // 4, ids[k : k + full], doc_tokens)
            if len(piece[2]) == full:
                self.emit([piece])
            else:
                self.place(piece)

    def close(self, merge: bool) -> None:
        """Leave the open windows as leftovers, or cut what they hold into full windows."""
        rest = [self.open[key] for _, key in self.free]
        self.free, self.open = [], {}
        if not merge:
            for pieces in rest:
                self.emit(pieces, left=True)
            return
        now, room = [], 4 * self.window
        for doc_id, start, ids, doc_tokens in (p for pieces in rest for p in pieces):
            while ids:
                part, ids = ids[:room], ids[room:]
                now.append((doc_id, start, part, doc_tokens))
                start, room = start + len(part) // 4, room - len(part)
                if not room:
                    self.emit(now)
                    now, room = [], 4 * self.window
        if now:
            self.emit(now)

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
            self.rows = []


def _first_id(side: int) -> int:
    """Sequence ids of a task: the pass, the partition's number, then a count."""
    from pyspark import TaskContext

    return (side << 62) | (TaskContext.get().partitionId() << 36)


def pack(docs: DataFrame, tokenizer: str | None = None, kind: str = "byte", end_id: int = 0, window: int = 1024, open_windows: int = 256, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit)."""
    path, end = tokenizer or default_path("byte_bpe_50k.json"), end_id.to_bytes(4, "little")

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, enc = Packer(window, open_windows, _first_id(0), keep_ids), encoder(path, kind)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in in_chunks(texts):
                for doc_id, ids in zip(doc_ids[a:b], enc.encode(texts.slice(a, b - a)), strict=True):
                    packer.add(doc_id, ids := ids + end, len(ids) // 4)
                yield from packer.batches(FLUSH)
        packer.close(merge=False)
        yield from packer.batches(1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, open_windows, _first_id(1), keep_ids)
        for batch in batches:
            for row in batch.to_pylist():
                packer.add(row["doc_id"], row["ids"], row["doc_tokens"], row["start"])
            yield from packer.batches(FLUSH)
        packer.close(merge=True)
        yield from packer.batches(1)

    placed = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(released(online), SCHEMA)
    placed = materialize(placed, "packed")
    left = placed.filter("left").select("doc_id", "start", "ids", "doc_tokens")
    merged = left.repartition(max(1, -(-left.count() // MERGE))).sortWithinPartitions(F.xxhash64("doc_id", "start")).mapInArrow(released(merge), SCHEMA)
    return placed.filter("NOT left").unionByName(merged).drop("left")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), keep_ids=False).drop("ids")
