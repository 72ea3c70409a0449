"""Import of a binary-encoded corpus: <attr>.lexicon (strings ended by NUL), <attr>.corpus (32-bit ids), <struct>.avx (pairs of 32-bit positions)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus, CorpusError, stored

CHUNK = 1 << 20


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _words(spark: SparkSession, path: str, dtype: str, schema: str, width: int) -> DataFrame:
    """Numbered rows of `width` integers of a file, in chunks, each read by itself; where only Hadoop knows the file system, the file is read whole."""
    names = [c.split()[0] for c in schema.split(", ")]
    files, step = spark.read.format("binaryFile").load(path), CHUNK * width * 4
    frame = lambda data, first: pd.DataFrame({names[0]: np.arange(first, first + len(data)), **{n: data[:, k] for k, n in enumerate(names[1:])}})
    rows = lambda content: np.frombuffer(content, dtype).reshape(-1, width).astype(np.int64)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, at in zip(batch["path"], batch["at"], strict=True):
                where, root = _where(file)
                with where.open_input_file(root) as f:
                    yield frame(rows(f.read_at(step, at)), at // (4 * width))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for a in range(0, len(content), step):
                    yield frame(rows(content[a : a + step]), a // (4 * width))

    try:
        _where(path)
    except (pa.ArrowException, OSError):
        return files.select("content").mapInPandas(whole, schema)
    # without its content a file is a row of its name and length
    places = files.filter("length > 0").select("path", F.explode(F.expr(f"sequence(0L, length - 1, {step}L)")).alias("at"))
    return places.repartition("at").mapInPandas(chunks, schema)


def _lexicon(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                words = bytes(content).split(b"\0")[:-1]
                for a in range(0, len(words), CHUNK):
                    part = [w.decode("utf-8", "replace") for w in words[a : a + CHUNK]]
                    yield pd.DataFrame({"id": np.arange(a, a + len(part)), "value": part})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, value string")


def read(spark: SparkSession, folder: str, attributes: list[str], structs: list[str] | None = None, byte_order: str = "<", **options) -> Corpus:
    """The named attributes (`word` becomes form) and structures of a folder."""
    if not attributes:
        raise CorpusError("an import needs an attribute")
    tokens = None
    for attr in attributes:
        name = "form" if attr == "word" else stored(attr)
        ids = _words(spark, f"{folder}/{attr}.corpus", f"{byte_order}i4", "pos long, id long", 1)
        col = ids.join(_lexicon(spark, f"{folder}/{attr}.lexicon"), "id").select("pos", F.col("value").alias(name))
        tokens = col if tokens is None else tokens.join(col, "pos")
    found = {s: _words(spark, f"{folder}/{s}.avx", f"{byte_order}i4", "idx long, start long, end long", 2) for s in structs or []}
    return Corpus.from_dataframes(tokens, found, **options)
