"""Bracketed trees: tokens with their part of speech, phrases as nested `node` regions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from ..corpus import Corpus, CorpusError
from .events import Builder, assemble, read_files

_SCAN = re.compile(r"\(|\)|[^\s()]+")
EMPTY = "-NONE-"


def parse(source: Iterable[str], b: Builder, attribute: str = "upos") -> Iterator[None]:
    """(S (NP (DT the) (NN cat))): leaves are tokens, `attribute` their label; inner nodes are regions with type and, of NP-SBJ, func."""
    stack: list[list] = []
    for tok in (tok for line in source for tok in _SCAN.findall(line)):
        if tok == "(":
            stack.append([None, b.size, []])
        elif tok != ")":
            if not stack:
                raise CorpusError("text outside of brackets")
            if stack[-1][0] is None:
                stack[-1][0] = tok
            else:
                stack[-1][2].append(tok)
        else:
            if not stack:
                raise CorpusError("a bracket too many")
            label, start, leaves = stack.pop()
            if leaves and label != EMPTY:
                b.token({"form": " ".join(leaves), attribute: label})
            elif not leaves and label and b.size > start:
                kind, _, func = label.partition("-")
                b.region("node", start, b.size - 1, {"type": kind, **({"func": func} if func else {})})
            if not stack:
                b.end_sentence()
                yield
    if stack:
        raise CorpusError("a bracket is missing")


def read(spark: SparkSession, paths: str | list[str], attribute: str = "upos", pattern: str = "*.{psd,mrg,ptb}", **options) -> Corpus:
    return assemble(read_files(spark, paths, lambda source, b: parse(source, b, attribute), pattern), modes={"node": "nested"}, **options)
