"""Vertical files: a token a line, tab-separated columns, XML tags as regions."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from ..corpus import Corpus
from .events import Builder, assemble, read_files

_HEADER = re.compile(r"<!--.*?positional-attributes:\s*(.*?)\s*-->")
_TAG = re.compile(r"^<(/?)([A-Za-z_][\w.\-]*)((?:\s+[\w.\-:]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>\s*$")
_ATTR = re.compile(r"([\w.\-:]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
#: Columns without a header, by their number; ten or more are the columns of CoNLL-U.
COLUMNS = {1: ("form",), 2: ("form", "lemma"), 3: ("form", "lemma", "upos")}
WIDE = (None, "form", "lemma", "upos", "xpos", "feats", None, "deprel")


def parse(source: Iterable[str], b: Builder) -> Iterator[None]:
    names: tuple | None = None
    sentences = False
    for line in source:
        line = line.rstrip("\r")
        if not line.strip():
            continue
        if m := _HEADER.match(line):
            names = tuple("form" if x == "word" else x for x in m[1].split())
            continue
        if line.startswith("<!--") or line.startswith("<?"):
            continue
        if m := _TAG.match(line):
            closing, name, attrs, empty = m.groups()
            found = {k: html.unescape(x or y) for k, x, y in _ATTR.findall(attrs)}
            if name == "s":
                # the sentence's own attributes stay with it
                if closing:
                    b.end_sentence(getattr(b, "pending", {}))
                    b.pending = {}
                else:
                    b.end_sentence(getattr(b, "pending", {}))
                    b.pending, sentences = found, True
            elif empty:
                b.region(name, b.size, b.size - 1, found)
            elif closing:
                b.end_region(name)
            else:
                b.start_region(name, found)
            continue
        columns = [html.unescape(c) for c in line.split("\t")]
        use = names or COLUMNS.get(len(columns)) or (WIDE if len(columns) >= 8 else (None, "form", "lemma", "upos") if columns[0].isdigit() else ("form", "lemma", "upos", "xpos"))
        b.token({n: v for n, v in zip(use, columns, strict=False) if n})
        yield
    if sentences and b.size > b.begun:
        b.end_sentence(getattr(b, "pending", {}))


def read(spark: SparkSession, paths: str | list[str], pattern: str = "*.{vrt,vert,txt}", **options) -> Corpus:
    return assemble(read_files(spark, paths, parse, pattern), **options)
