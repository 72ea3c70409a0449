"""Corpora from event streams: what the CoNLL-U, VRT, bracket and JSONL readers have in common.

A reader turns the lines of a file into rows in order; `Builder` numbers tokens and regions of one
file from 0, and each file's base is added to make one corpus. Spark reads the splits of all files
in parallel; the lines of a file then stream, in order, through one task, which hands on rows as
sentences end, so a file may be larger than memory. Files that Spark does not split (gzip) are not
shuffled for that. Positions over all files come from sums of their sizes in order of their paths.

Files are parsed twice: once for what is known of them, their regions and groups, which are kept,
and again when tokens are asked for, with trees and flat regions found as sentences end. So tokens
are neither stored nor shuffled.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..corpus import Corpus, CorpusError, clocks, stored
from ..functions.text import STORED
from .tables import scratch

SCHEMA = "path string, kind string, name string, n long, sent long, head long, start long, end long, attrs map<string,string>, spans array<struct<start:long,end:long>>"

#: Tokens after which a task hands on rows.
FLUSH = 10_000

#: What headers declare of a whole corpus; different values of all files count, in the order of their first files.
DECLARED = ("positional", "nested", "overlapping", "zerowidth", "multivalue", "kv_pipe", "default_within")


class Builder:
    """Tokens, sentences, regions and groups of one file, in file coordinates; `take` hands on what is complete.

    A token's head may come until its sentence ends; readers that hand on parts of sentences give no heads.
    """

    def __init__(self):
        self.tokens: list[dict] = []
        self.heads: list[int | None] = []
        self.sents: list[int] = []
        self.regions: list[tuple[str, int, int, int, dict, bool]] = []
        self.groups: list[tuple[str, str, list, dict]] = []
        self.open: list[tuple[str, int, int, dict]] = []
        self.taken = dict.fromkeys(("token", "group"), 0)
        self.numbered = 0
        self.sentence = 0
        self.begun = 0
        self.first_begun = 0  # where the sentence of the first token that is held begins
        self.meta: dict = {}
        self.names: set[str] = set()
        self.facts: dict[str, dict] = {}

    @property
    def size(self) -> int:
        return self.taken["token"] + len(self.tokens)

    def token(self, attrs: dict[str, str], head: int | None = None) -> None:
        """head: a position in the file, or None."""
        if not self.tokens:
            self.first_begun = self.begun
        self.tokens.append({k: v for k, v in attrs.items() if v not in (None, "")})
        self.heads.append(head)
        self.sents.append(self.sentence)

    def set_head(self, n: int, head: int | None) -> None:
        """The head of a token of the sentence that is being read."""
        self.heads[n - self.taken["token"]] = head

    def end_sentence(self, attrs: dict[str, str] | None = None) -> None:
        if self.size > self.begun:
            # sentences have even numbers, so that their tokens know them before they end
            self.regions.append(("s", 2 * self.sentence, self.begun, self.size - 1, attrs or {}, True))
            self.sentence += 1
        self.begun = self.size

    def number(self) -> int:
        self.numbered += 1
        return 2 * self.numbered - 1

    def region(self, name: str, start: int, end: int, attrs: dict[str, str]) -> None:
        self.regions.append((name, self.number(), start, end, attrs, False))

    def start_region(self, name: str, attrs: dict[str, str]) -> None:
        self.open.append((name, self.number(), self.size, attrs))

    def end_region(self, name: str) -> None:
        """Close the innermost open region of a name; one without tokens stays as a place between tokens."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                _, n, start, attrs = self.open.pop(k)
                self.regions.append((name, n, start, self.size - 1, attrs, True))
                return

    def close(self) -> None:
        self.end_sentence()
        while self.open:
            self.end_region(self.open[-1][0])

    def events(self, path: str, last: bool = False) -> list[dict]:
        """Rows of the regions and groups that came since the last time; the header's declarations and what is known of the file come last."""
        none = {"path": path, "spans": None, "start": None, "end": None, "sent": None, "head": None, "name": None}
        at = self.taken
        rows = [none | {"kind": "region", "name": name, "n": n, "start": start, "end": end, "attrs": attrs} for name, n, start, end, attrs, _ in self.regions]
        rows += [none | {"kind": "group", "name": name, "n": at["group"] + k, "attrs": props | {"__gid": gid}, "spans": [{"start": a, "end": b} for a, b in spans]} for k, (name, gid, spans, props) in enumerate(self.groups)]
        self.names.update(*self.tokens)
        for name, _, start, end, attrs, opened in self.regions:
            # zero: one lies between tokens; mixed: some meet, or don't come in order; loose: some lie over tokens handed on before, or not yet read
            known = self.facts.setdefault(name, {"zero": False, "mixed": False, "loose": False, "attrs": set(), "reach": -1})
            known["zero"] |= start > end
            known["mixed"] |= start <= known["reach"]
            known["loose"] |= not opened and (start < at["token"] or end >= self.size)
            known["reach"] = max(known["reach"], end)
            known["attrs"].update(attrs)
        if last and self.meta:
            rows.append(none | {"kind": "meta", "n": 0, "attrs": {k: json.dumps(v) for k, v in self.meta.items()}})
        if last and (rows or self.size):
            structs = {name: {k: sorted(v) if k == "attrs" else v for k, v in known.items() if k != "reach"} for name, known in sorted(self.facts.items())}
            facts = {"names": sorted(self.names), "structs": structs}
            rows.append(none | {"kind": "file", "n": self.size, "sent": self.sentence, "attrs": {"facts": json.dumps(facts)}})
        self.drop()
        return rows

    def held(self, path: str, attributes: list[str], flat: list[str]) -> pa.RecordBatch:
        """The tokens that came since the last time, with their trees and the numbers of the `flat` regions that cover them."""
        at, n = self.taken["token"], len(self.tokens)
        sent = np.array(self.sents, np.int64)
        if any(h is not None for h in self.heads):
            clock = clocks(sent, np.arange(at, at + n), np.array([-1 if h is None else h for h in self.heads], np.int64))
        else:
            first = np.searchsorted(sent, sent)
            place = np.arange(n) - first + np.where(first == 0, at - self.first_begun, 0)
            clock = 2 * place, 2 * place + 1, np.zeros(n, np.int64), np.zeros(n, np.int64)
        ein, eout, depth, children = clock
        lost = depth < 0
        number = {name: np.full(n, -1, np.int64) for name in flat}
        spans = [(name, k, start, end) for name, k, start, end, _, _ in self.regions] + [(name, k, start, self.size - 1) for name, k, start, _ in self.open]
        for name, k, start, end in spans:
            if name in number and end >= at:
                number[name][max(start - at, 0) : end - at + 1] = k
        if "s" in number:
            number["s"] = np.where(number["s"] < 0, 2 * sent, number["s"])
        columns = [pa.array([path] * n, pa.string()), pa.array(np.arange(at, at + n)), pa.array(sent), pa.array(self.heads, pa.int64())]
        columns += [pa.array(ein, mask=lost), pa.array(eout, mask=lost), pa.array(depth, mask=lost), pa.array(children, pa.int64())]
        columns += [pa.array(x, mask=x < 0) for x in number.values()]
        columns += [pa.array([t.get(a, "_") for t in self.tokens], pa.string()) for a in attributes]
        names = [*PLACED, *[f"r_{name}" for name in flat], *[stored(a) for a in attributes]]
        self.drop()
        return pa.RecordBatch.from_arrays(columns, names=names)

    def drop(self) -> None:
        self.taken = {"token": self.size, "group": self.taken["group"] + len(self.groups)}
        for held in (self.tokens, self.heads, self.sents, self.regions, self.groups):
            held.clear()


#: The first columns of `Builder.held`.
PLACED = ("path", "n", "sent", "head", "ein", "eout", "depth", "n_children")


@dataclass
class Files:
    """Files and how to parse them: `parse` gets a file's lines and a fresh builder, and yields wherever all that was read is complete."""

    spark: SparkSession
    paths: str | list[str]
    parse: Callable[[Iterator[str], Builder], Iterator[None]]
    pattern: str = "*"

    def lines(self) -> DataFrame:
        """path and value; the lines of a file lie in one partition, in order."""
        lines = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", self.pattern).option("lineSep", "\n").text(self.paths)
        whole = all(f.endswith(".gz") for f in lines.inputFiles())
        lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), "value")
        return (lines if whole else lines.repartition("path").sortWithinPartitions("path", "split", "nth")).select("path", "value")

    def parsed(self) -> Callable:
        parse = self.parse

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Builder, bool]]:
            """path, builder and whether the file ends, each time that enough is read."""
            each = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for path, lines in groupby(each, key=itemgetter(0)):
                builder = Builder()
                for _ in parse((line.removeprefix("\ufeff") for _, line in lines), builder):
                    if len(builder.tokens) >= FLUSH:
                        yield path, builder, False
                builder.close()
                yield path, builder, True

        return run

    @cached_property
    def events(self) -> DataFrame:
        """Event rows of regions, groups and declarations, and one of kind `file` for each file; they are kept, and read again."""
        parsed = self.parsed()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for path, builder, last in parsed(batches):
                rows = pd.DataFrame(builder.events(path, last), columns=["path", "kind", "name", "n", "sent", "head", "start", "end", "attrs", "spans"])
                rows["attrs"] = [None if x is None else list(x.items()) for x in rows["attrs"]]
                yield pa.RecordBatch.from_pandas(rows, ROWS, preserve_index=False)

        rows = self.lines().mapInArrow(run, SCHEMA)
        try:
            path = f"{scratch(self.spark)}/{uuid.uuid4().hex}"
        except CorpusError:
            return rows.cache()
        rows.write.options(**STORED).parquet(path)
        return self.spark.read.parquet(path)

    def tokens(self, attributes: list[str], flat: list[str]) -> DataFrame:
        """The columns of PLACED, r_<struct> of `flat` and the attributes, by file."""
        parsed = self.parsed()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for path, builder, _ in parsed(batches):
                yield builder.held(path, attributes, flat)

        kinds = ["path string", *[f"{c} long" for c in PLACED[1:]], *[f"`r_{name}` long" for name in flat], *[f"`{stored(a)}` string" for a in attributes]]
        return self.lines().mapInArrow(run, ", ".join(kinds))


#: SCHEMA for Arrow.
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ROWS = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), *[(c, pa.int64()) for c in ("n", "sent", "head", "start", "end")], ("attrs", pa.map_(pa.string(), pa.string())), ("spans", pa.list_(_SPAN))])


def read_files(spark: SparkSession, paths: str | list[str], parse: Callable[[Iterator[str], Builder], Iterator[None]], pattern: str = "*") -> Files:
    return Files(spark, paths, parse, pattern)


def based(sizes: DataFrame) -> DataFrame:
    """From path, size, sents of each file: base, sent_base and doc_id; a row a file."""
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("path", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("sents").over(before), F.lit(0)).alias("sent_base"), (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("doc_id"))


def assemble(source: Files | DataFrame, modes: dict[str, str] | None = None, multivalue: tuple = (), kv_pipe: tuple = ("feats",), default_within: str | None = None) -> Corpus:
    """One corpus out of files, or of event rows with tokens among them. Attribute names are those that occur; a missing value is `_`."""
    get = lambda a: F.coalesce(F.try_element_at("attrs", F.lit(a)), F.lit("_")).alias(stored(a))
    rows = source.events if isinstance(source, Files) else source.cache()
    meta: dict[str, list] = {}
    said = rows.filter("kind = 'meta'").select("path", F.explode("attrs").alias("key", "value")).filter(F.col("key").isin(*DECLARED))
    for r in sorted(said.groupBy("key", "value").agg(F.min("path").alias("path")).collect(), key=lambda r: (r["path"], r["key"], r["value"])):
        meta.setdefault(r["key"], []).append(json.loads(r["value"]))
    modes = dict(modes or {})
    for kind in ("nested", "overlapping", "zerowidth"):
        modes |= {name: kind for x in meta.get(kind, []) for name in x}
    declared = [a for x in meta.get("positional", []) for a in x]
    if isinstance(source, Files):
        files = based(rows.filter("kind = 'file'").select("path", F.col("n").alias("size"), F.col("sent").alias("sents")))
        size = rows.filter("kind = 'file'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        facts = [json.loads(r[0]) for r in rows.filter("kind = 'file'").select(F.col("attrs")["facts"]).distinct().collect()]
        names = sorted({a for x in facts for a in x["names"]})
        known = {name: [x["structs"][name] for x in facts if name in x["structs"]] for name in sorted({n for x in facts for n in x["structs"]})}
        region_names = {name: sorted({a for x in each for a in x["attrs"]}) for name, each in known.items()}
        for name, each in known.items():
            # where no two regions of a file meet, as the reader saw, no pass over them is needed
            if any(x["zero"] for x in each):
                modes.setdefault(name, "zerowidth")
            elif not any(x["mixed"] for x in each):
                modes.setdefault(name, "flat")
    else:
        sizes = rows.filter("kind = 'token'").groupBy("path").agg(F.count(F.lit(1)).alias("size"), (F.max("sent") + 1).alias("sents"))
        files = based(rows.select("path").distinct().join(sizes, "path", "left").fillna(0))
        keys = lambda kind, name: sorted(r[0] for r in rows.filter((F.col("kind") == kind) & ((F.col("name") == name) if name else F.lit(True))).select(F.explode(F.map_keys("attrs"))).distinct().collect())
        size, names = None, keys("token", None)
        region_names = {name: keys("region", name) for name in sorted(r[0] for r in rows.filter("kind = 'region'").select("name").distinct().collect())}
    files = F.broadcast(files)  # a row a file
    placed = rows.join(files, "path")
    attributes = list(dict.fromkeys(["form", *declared, *names]))
    structs, groups = {}, {}
    for name, found_names in region_names.items():
        found = placed.filter((F.col("kind") == "region") & (F.col("name") == name))
        own = found.select((F.col("doc_id") * (1 << 32) + F.col("n")).alias("idx"), (F.col("start") + F.col("base")).alias("start"), (F.col("end") + F.col("base")).alias("end"), *[get(a) for a in found_names])
        structs[name] = own
        if name not in modes:
            modes[name] = detect_mode(own)
    place = [(F.col("n") + F.col("base")).alias("pos"), "doc_id", (F.col("sent") + F.col("sent_base")).alias("sent_id"), (F.col("head") + F.col("base")).alias("head_pos")]
    if isinstance(source, Files):
        flat = [name for name, each in known.items() if modes[name] == "flat" and not any(x["loose"] or x["mixed"] for x in each)]
        numbers = [(F.col("doc_id") * (1 << 32) + F.col(f"`r_{name}`")).alias(f"r_{name}") for name in flat]
        tokens = source.tokens(attributes, flat).join(files, "path").select(*place, *PLACED[4:], *numbers, *[F.col(f"`{stored(a)}`") for a in attributes])
    else:
        tokens = placed.filter("kind = 'token'").select(*place, *[get(a) for a in attributes])
    for name in sorted(r[0] for r in rows.filter("kind = 'group'").select("name").distinct().collect()):
        found = placed.filter((F.col("kind") == "group") & (F.col("name") == name))
        spans = F.transform("spans", lambda s: F.struct((s["start"] + F.col("base")).alias("start"), (s["end"] + F.col("base")).alias("end")))
        groups[name] = found.select(F.col("attrs")["__gid"].alias("gid"), spans.alias("spans"), F.map_filter("attrs", lambda k, v: k != "__gid").alias("props")).withColumn("first", F.array_min(F.transform("spans", lambda s: s["start"]))).withColumn("last", F.array_max(F.transform("spans", lambda s: s["end"])))
    listed = lambda key, more: tuple(dict.fromkeys([*more, *[a for x in meta.get(key, []) for a in x]]))
    within = default_within or next(iter(meta.get("default_within", [])), None)
    return Corpus.from_dataframes(tokens, structs, modes, groups, listed("multivalue", multivalue), listed("kv_pipe", kv_pipe), within, size)


def detect_mode(rows: DataFrame) -> str:
    """zerowidth if a row has no token; nested if some rows lie in others and none cross; overlapping if some cross; else flat."""
    if rows.filter("start > end").limit(1).count():
        return "zerowidth"
    w = Window.partitionBy("doc").orderBy("start", F.desc("end"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("doc", F.expr("idx div 4294967296")).withColumn("reach", F.max("end").over(w))
    meeting = seen.filter("reach >= start")
    if not meeting.limit(1).count():
        return "flat"
    spans = rows.select("idx", "start", "end")
    points = spans.select(F.col("idx").alias("o"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.explode(F.sequence("start", "end")).alias("start"))
    crossing = spans.join(points, "start").filter("o <> idx AND o_start < start AND o_end < end")
    return "overlapping" if crossing.limit(1).count() else "nested"


def require(condition: bool, message: str) -> None:
    if not condition:
        raise CorpusError(message)
