"""Chunks: some neighbouring documents packed into one row, for operators that meet by chunk twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

CHUNK = 4 << 20
SCHEMA = "chunk long, doc_ids array<long>, sizes array<long>, blob binary"


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """chunk (a number), doc_ids, sizes and the texts' bytes, compressed. A longer text is a chunk of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 36, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def flush() -> pa.RecordBatch:
            row = [[number], [ids], [[len(t) for t in texts]], [squeeze(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["chunk", "doc_ids", "sizes", "blob"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                if size and size + len(text) > chunk:
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id), texts.append(text)
                size += len(text)
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(released(run), SCHEMA)


def unpacked(sizes: list[int], blob: bytes) -> list[bytes]:
    raw, ends = memoryview(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, sum(sizes)))), np.cumsum(sizes).tolist()
    return [bytes(raw[b - n : b]) for b, n in zip(ends, sizes, strict=True)]


def planes(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte plane by byte plane: the high planes are zeros that compress away."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def planes_of(counts: np.ndarray) -> bytes:
    """Counts, byte plane by byte plane, as they are."""
    return np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes_of(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)
