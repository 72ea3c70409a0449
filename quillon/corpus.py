"""A corpus: a table of tokens, a table per structure, tables of token groups, and what is known of them.

tokens: pos (dense, document order), doc_id, sent_id, string attributes (missing: `_`), head_pos,
ein, eout (Euler clock of the sentence's tree), depth, n_children, and r_<struct>, the index of the
covering region, for each flat structure; where attributes come by rule, also sent_at, sent_len
and sent_depth (the place in the sentence from 1 on, its length, the depth of its tree).
A structure: idx, start, end (inclusive; start > end: zero width), parent_idx, string attributes.
A group: gid, first, last, spans (array of start, end), props (map).

Columns of tokens that follow from others need not be stored: `rules` of the metadata has their SQL,
which is evaluated as they are read.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import STORED

CORE = ("pos", "doc_id", "sent_id", "sent_at", "sent_len", "sent_depth", "head_pos", "ein", "eout", "depth", "n_children")
MODES = ("flat", "nested", "overlapping", "zerowidth")


@dataclass(frozen=True)
class Meta:
    size: int
    attributes: tuple
    structs: dict = field(default_factory=dict)  # name -> {"mode", "attrs"}
    groups: dict = field(default_factory=dict)  # name -> props
    multivalue: tuple = ()
    kv_pipe: tuple = ()
    default_within: str | None = None
    rules: dict = field(default_factory=dict)  # column -> SQL over stored columns and those of rules before it


#: Columns of a structure that are not its attributes.
ROW = ("idx", "start", "end", "parent_idx")


class CorpusError(ValueError):
    pass


def stored(name: str) -> str:
    """The column of an attribute: its own name, but for names that the tables use themselves."""
    return f"attr:{name}" if name in (*CORE, *ROW) or name.startswith("r_") else name


class Corpus:
    def __init__(self, tokens: DataFrame, structs: dict[str, DataFrame], meta: Meta, groups: dict[str, DataFrame] | None = None):
        self.tokens, self.structs, self.meta, self.groups = tokens, structs, meta, groups or {}
        self.spark = tokens.sparkSession
        self.by_rule: DataFrame | None = None  # the tokens as the rules of the metadata gave them
        self.chains: dict[str, DataFrame] = {}  # ancestors of nested structures, once asked for

    @classmethod
    def from_dataframes(cls, tokens: DataFrame, structs: dict[str, DataFrame] | None = None, modes: dict[str, str] | None = None, groups: dict[str, DataFrame] | None = None, multivalue: tuple = (), kv_pipe: tuple = ("feats",), default_within: str | None = None, size: int | None = None, rules: dict[str, str] | None = None) -> Corpus:
        """tokens need pos and attributes; heads may come as head_pos, structure rows as idx, start, end and attributes.

        What is there already (ein, r_<struct>, parent_idx, <group>_gid) is taken as it is. `rules`: more columns, in SQL.
        """
        tokens = ruled(tokens, rules or {})
        structs, modes, groups = dict(structs or {}), dict(modes or {}), dict(groups or {})
        for name in ("doc_id", "sent_id"):
            if name not in tokens.columns:
                tokens = tokens.withColumn(name, F.lit(0).cast("long"))
        tokens = with_trees(tokens) if "head_pos" in tokens.columns and "ein" not in tokens.columns else tokens
        for name in ("head_pos", "ein", "eout", "depth", "n_children"):
            if name not in tokens.columns:
                tokens = tokens.withColumn(name, F.lit(None).cast("long"))
        for name, rows in structs.items():
            mode = modes.setdefault(name, "flat")
            if mode not in MODES:
                raise CorpusError(f"unknown mode {mode}")
            if "parent_idx" not in rows.columns:
                structs[name] = with_parents(rows) if mode == "nested" else rows.withColumn("parent_idx", F.lit(None).cast("long"))
            if mode == "flat" and f"r_{name}" not in tokens.columns:
                tokens = tokens.join(covered(structs[name]).select("pos", F.col("idx").alias(f"r_{name}")), "pos", "left")
        for name, rows in groups.items():
            if f"{name}_gid" not in tokens.columns:
                tokens = with_group_columns(tokens, name, rows)
        attributes = tuple(c for c in tokens.columns if c not in CORE and not c.startswith("r_"))
        known = {n: {"mode": modes[n], "attrs": [c for c in r.columns if c not in ROW]} for n, r in structs.items()}
        group_attrs = tuple(c for n in groups for c in attributes if c.startswith(f"{n}_"))
        meta = Meta(size if size is not None else tokens.count(), attributes, known, {n: [] for n in groups}, tuple(dict.fromkeys((*multivalue, *group_attrs))), tuple(k for k in kv_pipe if k in attributes), default_within, dict(rules or {}))
        made = cls(tokens, structs, meta, groups)
        made.by_rule = tokens
        return made

    # ------------------------------------------------------------ storage

    def save(self, path: str, partitions: int | None = None, written: bool = False) -> Corpus:
        """Parquet, tokens sorted by position and without columns by rule, and the metadata as a one-row JSON table; returns the saved corpus. `written`: the tokens are there already."""
        # tokens that were changed since are stored with all their columns
        meta = self.meta if self.tokens is self.by_rule else replace(self.meta, rules={})
        if not written:
            # a range partitioning first samples what it gets, so that is written before, or it would be computed twice
            tokens = self.tokens.select(*[value(c) for c in self.tokens.columns if c not in meta.rules])
            tokens.write.options(**STORED).parquet(f"{path}/unsorted")
            tokens = self.spark.read.parquet(f"{path}/unsorted").repartitionByRange(*([partitions] if partitions else []), "pos").sortWithinPartitions("pos")
            tokens.write.options(**STORED).parquet(f"{path}/tokens")
            delete(self.spark, f"{path}/unsorted")
        for name, rows in self.structs.items():
            rows.write.options(**STORED).parquet(f"{path}/structs/{name}")
        for name, rows in self.groups.items():
            rows.write.options(**STORED).parquet(f"{path}/groups/{name}")
        self.spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.text(f"{path}/meta")
        return Corpus.open(self.spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, preload: bool = False) -> Corpus:
        raw = json.loads(spark.read.text(f"{path}/meta").first()[0])
        meta = Meta(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        tokens = ruled(spark.read.parquet(f"{path}/tokens"), meta.rules)
        structs = {n: spark.read.parquet(f"{path}/structs/{n}") for n in meta.structs}
        groups = {n: spark.read.parquet(f"{path}/groups/{n}") for n in meta.groups}
        made = cls(tokens.cache() if preload else tokens, structs, meta, groups)
        made.by_rule = made.tokens
        return made

    def overlay(self, layer: str, other: Corpus) -> Corpus:
        """This corpus with the structures and groups of a stand-off corpus of the same size, named overlay-<layer>-<name>."""
        if other.meta.size != self.meta.size:
            raise CorpusError(f"the overlay has {other.meta.size} tokens, the corpus {self.meta.size}")
        name = lambda n: f"overlay-{layer}-{n}".replace("_", "-")
        structs = self.structs | {name(n): r for n, r in other.structs.items()}
        groups = {n: r for n, r in other.groups.items()}
        modes = {n: s["mode"] for n, s in self.meta.structs.items()} | {name(n): s["mode"] for n, s in other.meta.structs.items()}
        plain = Corpus.from_dataframes(self.tokens, structs, modes, {name(n): r for n, r in groups.items()}, self.meta.multivalue, self.meta.kv_pipe, self.meta.default_within, self.meta.size)
        plain.groups |= self.groups
        return Corpus(plain.tokens, plain.structs, Meta(**{**asdict(plain.meta), "groups": {n: [] for n in plain.groups}}), plain.groups)

    def check(self) -> dict[str, int]:
        """Counts of broken rules; all are 0 in a sound corpus."""
        t = self.tokens
        got = t.agg(
            (F.lit(self.meta.size) - F.count(F.lit(1))).alias("size"),
            (F.coalesce(F.max("pos"), F.lit(-1)) + 1 - F.count_distinct("pos")).alias("positions"),
        ).first()
        heads = t.alias("a").join(t.alias("b"), F.col("a.head_pos") == F.col("b.pos"), "left").filter("a.head_pos IS NOT NULL AND (b.pos IS NULL OR a.sent_id <> b.sent_id)").count()
        spans = sum(r.filter((F.col("start") < 0) | (F.col("end") >= self.meta.size) | ((F.col("start") > F.col("end")) & F.lit(self.meta.structs[n]["mode"] != "zerowidth"))).count() for n, r in self.structs.items())
        return {"size": got["size"], "positions": got["positions"], "heads": heads, "spans": spans}

    # ------------------------------------------------------------- names

    def attribute(self, name: str) -> str | None:
        """The token column that a name stands for, if any."""
        if stored(name) in self.meta.attributes:
            return stored(name)
        if name == "word" and "form" in self.meta.attributes:
            return "form"
        if "/" in name:
            for other in (name.replace("/", "#", 1), name.replace("/", "_", 1)):
                if other in self.meta.attributes:
                    return other
        return None

    def region_attribute(self, name: str) -> tuple[str, str] | None:
        """struct, attribute of a name like text_lang: the structure ends at the first underscore; names with more in them are tried too."""
        for struct in sorted(self.meta.structs, key=len):
            if name.startswith(f"{struct}_"):
                rest, attrs = name[len(struct) + 1 :], self.meta.structs[struct]["attrs"]
                for attr in (stored(rest), name):
                    if attr in attrs:
                        return struct, attr
        return None

    def mode(self, struct: str) -> str:
        if struct not in self.meta.structs:
            raise CorpusError(f"no structure {struct}")
        return self.meta.structs[struct]["mode"]

    def bridge(self, struct: str) -> DataFrame:
        """pos and every region of the structure that covers it."""
        return covered(self.structs[struct])


def ruled(tokens: DataFrame, rules: dict[str, str]) -> DataFrame:
    """`tokens` with the columns of `rules`."""
    for name, sql in rules.items():
        tokens = tokens.withColumn(name, F.expr(sql))
    return tokens


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def covered(rows: DataFrame) -> DataFrame:
    return rows.filter("start <= end").select("*", F.explode(F.sequence("start", "end")).alias("pos"))


def with_parents(rows: DataFrame) -> DataFrame:
    """parent_idx: the smallest other region that contains the row; null if none or if two are as small.

    Regions meet through the positions at which the inner ones start, an equi-join.
    """
    inner = rows.filter("start <= end")
    outer = covered(rows).select(F.col("pos").alias("start"), F.col("idx").alias("o_idx"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    pairs = inner.select("idx", "start", "end").join(outer, "start").filter("o_idx <> idx AND o_end >= end AND (o_end - o_start) > (end - start)")
    best = pairs.groupBy("idx").agg(F.min(F.struct(F.expr("o_end - o_start").alias("n"), "o_idx")).alias("low"), F.min(F.struct(F.expr("o_end - o_start").alias("n"), (-F.col("o_idx")).alias("o_idx"))).alias("high"))
    best = best.select("idx", F.when(F.col("low.o_idx") == -F.col("high.o_idx"), F.col("low.o_idx")).alias("parent_idx"))
    return rows.join(best, "idx", "left")


def with_group_columns(tokens: DataFrame, name: str, groups: DataFrame) -> DataFrame:
    """<name>_gid and <name>_<prop> as multivalue columns of the tokens that a group has."""
    at = groups.select("gid", "props", F.explode("spans").alias("s")).select("gid", "props", F.explode(F.sequence("s.start", "s.end")).alias("pos"))
    keys = sorted(r[0] for r in groups.select(F.explode(F.map_keys("props"))).distinct().collect())
    join = lambda c: F.concat_ws("|", F.array_sort(F.collect_set(c)))
    per = at.groupBy("pos").agg(join(F.col("gid").cast("string")).alias(f"{name}_gid"), *[join(F.try_element_at("props", F.lit(k))).alias(f"{name}_{k}") for k in keys])
    cols = [f"{name}_gid", *[f"{name}_{k}" for k in keys]]
    return tokens.join(per, "pos", "left").fillna("_", cols)


def clocks(sent: np.ndarray, pos: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ein, eout, depth (-1 in a cycle) and n_children of tokens in order of sentence and position; head -1: none.

    A head outside the sentence, or the token itself, makes a root. All sentences go at once: depths by
    pointer jumping, sizes of subtrees from the deepest level up, places in preorder from the roots
    down. With place p, depth d and subtree size n, a token is entered at 2p - d and left 2n - 1 later.
    """
    n = len(pos)
    order = np.argsort(pos, kind="stable")
    at = order[np.minimum(np.searchsorted(pos[order], head), max(n - 1, 0))] if n else order
    me = np.arange(n)
    parent = np.where((head >= 0) & (pos[at] == head) & (sent[at] == sent), at, me)
    up, depth = parent.copy(), (parent != me).astype(np.int64)
    children = np.bincount(parent[parent != me], minlength=n)
    for _ in range(n.bit_length()):
        depth, up = depth + depth[up], up[up]
    depth[parent[up] != up] = -1
    size = np.ones(n, np.int64)
    ranked = np.lexsort((me, np.where(parent == me, sent, parent), depth))
    ranked = ranked[depth[ranked] >= 0]
    cuts = np.searchsorted(depth[ranked], np.arange(depth.max(initial=-1) + 2))
    levels = [ranked[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    place = np.zeros(n, np.int64)
    for d, level in enumerate(levels):
        family = parent[level] if d else sent[level]
        before = np.cumsum(size[level]) - size[level]
        first = np.concatenate([[True], family[1:] != family[:-1]])
        before -= before[np.maximum.accumulate(np.where(first, np.arange(len(level)), 0))]
        place[level] = before + (place[parent[level]] + 1 if d else 0)
    ein = 2 * place - depth
    return ein, ein + 2 * size - 1, depth, children


def with_trees(tokens: DataFrame) -> DataFrame:
    """ein, eout, depth and n_children from head_pos: an Euler clock per sentence, sentences of a partition in one pass."""
    names = [c for c in tokens.columns if c not in ("ein", "eout", "depth", "n_children")]
    at = {c: k for k, c in enumerate(names)}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(names).schema.fields) + ", ein long, eout long, depth long, n_children long"

    def run(batches):
        held = None

        def flush(table):
            sent, pos = table.column(at["sent_id"]).to_numpy(), table.column(at["pos"]).to_numpy()
            head = table.column(at["head_pos"]).combine_chunks().fill_null(-1).to_numpy()
            ein, eout, depth, children = clocks(sent, pos, head)
            lost = depth < 0
            more = [pa.array(ein, mask=lost), pa.array(eout, mask=lost), pa.array(depth, mask=lost), pa.array(children)]
            full = pa.table([*table.columns, *more], names=[*names, "ein", "eout", "depth", "n_children"])
            return full.combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = held.column(at["sent_id"])[len(held) - 1].as_py()
            sent = held.column(at["sent_id"]).to_numpy()
            whole = int(np.searchsorted(sent, last))  # the last sentence may go on
            if whole:
                yield from flush(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from flush(held)

    return tokens.select(names).repartition("sent_id").sortWithinPartitions("sent_id", "pos").mapInArrow(run, schema)


def value(col: str) -> Column:
    return F.col(f"`{col}`")
