"""JSON lines of events: header, token, sentence_end, region, region_start, region_end."""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession

from ..corpus import Corpus, CorpusError
from .events import Builder, assemble, read_files

RESERVED = ("type", "event", "tok_id", "head_tok_id", "head", "v", "id")


def _texts(attrs: dict) -> dict[str, str]:
    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (attrs or {}).items() if v is not None}


def parse(source: Iterable[str], b: Builder) -> Iterator[None]:
    names: list[str] = []
    groups: set[str] = set()
    split_feats, total = False, None
    ids: dict[str, int] = {}
    waiting: list[tuple[int, str]] = []
    began = 0

    def sentence(attrs: dict | None = None) -> None:
        nonlocal began
        for n, ident in waiting:
            b.set_head(n, ids.get(ident))
        waiting.clear()
        ids.clear()
        b.end_sentence(_texts(attrs or {}))
        began = b.size

    for raw in source:
        if not raw.strip():
            continue
        e = json.loads(raw)
        kind = e.get("type") or e.get("event")
        if kind == "header":
            names, groups = list(e.get("positional", [])), set(e.get("token_groups", []))
            split_feats, total = bool(e.get("split_feats")), e.get("token_count")
            b.meta = {k: e[k] for k in ("positional", "nested", "overlapping", "zerowidth", "multivalue", "kv_pipe", "default_within", "token_count") if e.get(k) is not None}
        elif kind == "token":
            attrs = dict(zip(names, e["v"], strict=False)) if "v" in e else {k: v for k, v in e.items() if k not in RESERVED}
            if split_feats and "feats" in attrs:
                attrs |= {f"feats#{k}": v for k, _, v in (x.partition("=") for x in attrs.pop("feats").split("|")) if v}
            if "tok_id" in e:
                ids[str(e["tok_id"])] = b.size
            if e.get("head_tok_id") is not None:
                waiting.append((b.size, str(e["head_tok_id"])))
            head = e.get("head")
            b.token(_texts(attrs), began + int(head) - 1 if head and "head_tok_id" not in e else None)
        elif kind == "sentence_end":
            sentence(e.get("attrs"))
            yield
        elif kind == "region_start":
            b.start_region(e["struct"], _texts(e.get("attrs")))
        elif kind == "region_end":
            b.end_region(e["struct"])
        elif kind == "region" and (e["struct"] in groups or e.get("spans")):
            size = total if total is not None else None
            spans = [(int(x), int(y)) for x, y in (e.get("spans") or [[e["start_pos"], e["end_pos"]]])]
            ident = e.get("region_id") or (e.get("attrs") or {}).get("id")
            if ident is not None and all(x >= 0 and (size is None or x < size) for x, _ in spans):
                spans = [(x, y if size is None else min(y, size - 1)) for x, y in spans]
                b.groups.append((e["struct"], str(ident), sorted(spans), _texts(e.get("attrs"))))
        elif kind == "region" and e["struct"] == "s":
            # the tokens since the last sentence are the sentence, whatever the coordinates say
            sentence(e.get("attrs"))
            yield
        elif kind == "region":
            b.region(e["struct"], int(e["start_pos"]), int(e["end_pos"]), _texts(e.get("attrs")))
        else:
            raise CorpusError(f"unknown event {kind!r}")
    sentence()


def read(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl", **options) -> Corpus:
    return assemble(read_files(spark, paths, parse, pattern), **options)


def read_stream(spark: SparkSession, stream: BinaryIO, folder: str, **options) -> Corpus:
    """Events from an open stream such as standard input: copied block by block into a file of `folder`, which all executors must see."""
    where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/stream.jsonl") as out:
        shutil.copyfileobj(stream, out, 1 << 20)
    return read(spark, folder, **options)


def read_overlay(spark: SparkSession, paths: str | list[str], size: int, pattern: str = "*.jsonl") -> Corpus:
    """A stand-off layer: regions and groups over `size` tokens of another corpus, which its header must count."""
    files = read_files(spark, paths, parse, pattern)
    counts = {json.loads(r[0]) for r in files.events.filter("kind = 'meta'").selectExpr("attrs['token_count']").distinct().collect() if r[0]}
    if counts and counts != {size}:
        raise CorpusError(f"the overlay counts {sorted(counts)} tokens, the corpus {size}")
    found = assemble(files)
    blank = spark.range(size).selectExpr("id AS pos", "'_' AS form")
    return Corpus.from_dataframes(blank, found.structs, {n: s["mode"] for n, s in found.meta.structs.items()}, found.groups)
