"""CoNLL-U files, with the comments that open and describe regions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from ..corpus import Corpus
from .events import Builder, assemble, read_files

# Keys of the last column that become token attributes, as they are spelled in existing corpora.
MISC = ("tuid", "Translit", "Vform", "LTranslt", "Root", "CorrectForm", "Gloss")
_COMMENT = re.compile(r"#\s*([^=]+?)\s*=\s*(.*)$")
_NEW = re.compile(r"#\s*(newregion|endregion|newdoc|newpar)\b\s*(.*)$")


def pairs(text: str) -> dict[str, str]:
    return {} if text in ("_", "") else {k: v for k, _, v in (x.partition("=") for x in reversed(text.split("|"))) if k}


def parse(source: Iterable[str], b: Builder, split_feats: bool = False) -> Iterator[None]:
    sent: dict[str, str] = {}
    context = "s"
    opened: dict[str, dict] = {}
    lines: list[list[str]] = []

    def switch(name: str, attrs: dict[str, str]) -> None:
        if name in opened:
            b.end_region(name)
        opened[name] = attrs
        b.start_region(name, attrs)

    def flush() -> None:
        nonlocal sent
        place, base = {}, b.size
        plain = [c for c in lines if c[0].isdigit()]
        for k, c in enumerate(plain):
            place[c[0]] = base + k
        for c in lines:
            if "-" in c[0]:
                low, high = c[0].split("-")[:2]
                if low in place and high in place:
                    b.region("contr", place[low], place[high], {"form": c[1]})
        for c in plain:
            attrs = dict(zip(("form", "lemma", "upos", "xpos"), c[1:5], strict=False))
            if split_feats:
                attrs |= {f"feats#{k}": v for k, v in pairs(c[5]).items()}
            else:
                attrs["feats"] = c[5]
            attrs["deprel"] = c[7]
            misc = pairs(c[9]) if len(c) > 9 else {}
            attrs |= {k: misc[k] for k in MISC if k in misc}
            b.token(attrs, place.get(c[6]))
        b.end_sentence(sent)
        sent = {}
        lines.clear()

    for line in source:
        line = line.rstrip("\r")
        if not line.strip():
            if lines:
                flush()
                yield
            continue
        if line.startswith("#"):
            if m := _NEW.match(line):
                kind, rest = m.groups()
                if kind in ("newdoc", "newpar"):
                    name = {"newdoc": "doc", "newpar": "par"}[kind]
                    ident = _COMMENT.match("# " + rest)
                    switch(name, {"id": ident[2]} if ident else {})
                    context = name
                elif kind == "newregion":
                    name = rest.split()[0] if rest.split() else ""
                    context = name or "s"
                    if name and name != "s":
                        switch(name, {})
                elif rest.split() and rest.split()[0] in opened:
                    opened.pop(rest.split()[0])
                    b.end_region(rest.split()[0])
                continue
            m = _COMMENT.match(line)
            if not m:
                continue
            key, value = m[1].replace(" ", "_"), m[2]
            struct, _, attr = key.partition("_")
            # a translation of the sentence (text_en = ...) belongs to the sentence where sentences are being described
            if key in ("sent_id", "tuid", "parallel_id", "text") or (struct == "text" and context == "s" and len(attr) in (2, 3) and "text" not in opened):
                sent["tuid" if key == "parallel_id" else key] = value
                context = "s" if key == "sent_id" else context
            elif struct == "s" and attr:
                sent[attr] = value
            elif attr and struct in opened and context != "s":
                opened[struct][attr] = value
            elif attr and struct in opened and not (struct == "text" and len(attr) == 2):
                opened[struct][attr] = value
            elif attr and struct in ("text", "doc", "par", "p"):
                switch(struct, {attr: value}) if struct not in opened else sent.__setitem__(key, value)
            continue
        columns = line.split("\t")
        if len(columns) >= 8 and "." not in columns[0]:
            lines.append(columns)
    if lines:
        flush()


def read(spark: SparkSession, paths: str | list[str], split_feats: bool = False, pattern: str = "*.conllu", **options) -> Corpus:
    return assemble(read_files(spark, paths, lambda source, b: parse(source, b, split_feats), pattern), **options)
