"""A session: named results, settings, and programs of statements over one corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import Corpus, CorpusError
from .dialects import translate
from .operators import aggregate, display
from .plans.ast import Command, Statement
from .plans.lower import Lowering, Matches
from .plans.parser import parse

# Settings and their defaults.
DEFAULTS = {
    "context": 5,
    "left": 5,
    "right": 5,
    "limit": 20,
    "offset": 0,
    "group_limit": 1000,
    "max_items": 50,
    "min_freq": 5,
    "measures": "logdice",
    "attrs": "",
    "anchor_binding": "fanout",
    "strict_quoted_strings": False,
    "mv_explode": True,
}


class Session:
    def __init__(self, corpus: Corpus, dialect: str = "native"):
        self.corpus, self.dialect, self.named, self.settings = corpus, dialect, {}, dict(DEFAULTS)

    # ------------------------------------------------------------- running

    def run(self, program: str, dialect: str | None = None) -> DataFrame | None:
        """Run every statement; the result of the last one (a query without a command shows its matches)."""
        out = None
        for statement in self.parse(program, dialect):
            out = self.execute(statement)
        return out

    def parse(self, program: str, dialect: str | None = None) -> list[Statement]:
        dialect = dialect or self.dialect
        return parse(program, bool(self.settings["strict_quoted_strings"])) if dialect == "native" else translate(dialect, program)

    def lowering(self) -> Lowering:
        return Lowering(self.corpus, self.named, self.settings["anchor_binding"])

    def query(self, text: str) -> Matches:
        """The matches of a single query."""
        statements = self.parse(text)
        for statement in statements:
            self.execute(statement)
        return self.named["Last"]

    def execute(self, s: Statement) -> DataFrame | None:
        if s.command:
            return self.command(s.command)
        low = self.lowering()
        m = low.subtree(s.subtree.label, s.subtree.source, s.filters) if s.subtree else low.query(s.query)
        self.named["Last"] = m
        if s.name:
            # a name keeps its place at the end: later labels hide earlier ones
            self.named.pop(s.name, None)
            self.named[s.name] = m
        return m.shown()

    def of(self, name: str | None) -> Matches:
        if (name or "Last") not in self.named:
            raise CorpusError(f"no query is named {name or 'Last'}")
        return self.named[name or "Last"]

    def count_total(self, m: Matches, most: int | None = None) -> tuple[int, bool]:
        """The number of matches and whether it is exact; at most `most` are counted."""
        if most is None:
            return m.df.count(), True
        n = m.df.limit(most + 1).count()
        return min(n, most), n <= most

    def sample(self, m: Matches, n: int, seed: int = 0) -> Matches:
        """n matches by the smallest seeded hash of their places: the same for the same seed, whatever the partitioning."""
        return m.with_df(m.df.orderBy(F.xxhash64(*m.keys(), F.lit(seed)), *m.keys()).limit(n))

    # ------------------------------------------------------------ commands

    def command(self, c: Command) -> DataFrame | None:
        low, s = self.lowering(), self.settings
        measures = tuple(x.strip() for x in str(s["measures"]).split(",") if x.strip())
        if c.name == "size":
            return self.of(c.of).df.agg(F.count(F.lit(1)).alias("size"))
        if c.name in ("count", "group"):
            return aggregate.count(low, self.of(c.of), c.fields, int(s["group_limit"]), bool(s["mv_explode"]))
        if c.name == "freq":
            if c.args:
                return aggregate.compare_frequencies(low, {n: self.of(n) for n in (c.of, *c.args)}, c.fields)
            return aggregate.frequency(low, self.of(c.of), c.fields)
        if c.name == "coll":
            return aggregate.collocations(low, self.of(c.of), c.fields[0], int(s["left"]), int(s["right"]), measures, int(s["min_freq"]), int(s["max_items"]))
        if c.name == "dcoll":
            return aggregate.dependency_collocations(low, self.of(c.of), c.fields[0], c.relations, c.anchor, measures, int(s["min_freq"]), int(s["max_items"]))
        if c.name == "keyness":
            return aggregate.keywords(low, self.of(c.of), c.fields[0], self.of(c.versus) if c.versus else None, int(s["max_items"]))
        if c.name == "tabulate":
            return display.tabulate(low, self.of(c.of), c.fields, c.offset, c.limit)
        if c.name == "sort":
            m = display.sort(low, self.of(c.of), c.fields)
            self.named[c.of or "Last"] = m
            return m.shown()
        if c.name == "raw":
            return display.raw(low, self.of(c.of))
        if c.name == "cat":
            return display.kwic(low, self.of(c.of), int(s["left"]), int(s["right"]), int(s["offset"]), int(s["limit"]))
        if c.name == "set":
            return self.set(*c.args)
        if c.name == "drop":
            if c.args[0] == "all":
                self.named.clear()
            elif self.named.pop(c.args[0], None) is None:
                raise CorpusError(f"no query is named {c.args[0]}")
            return None
        if c.name == "show":
            return self.show(*c.args)
        raise CorpusError(f"unknown command {c.name}")

    def set(self, name: str, text: str) -> None:
        name = name.replace("-", "_")
        if name == "window":
            self.settings["left"] = self.settings["right"] = int(text)
            return
        if name not in DEFAULTS:
            raise CorpusError(f"no setting {name}")
        kind = type(DEFAULTS[name])
        self.settings[name] = text.lower() in ("1", "true", "on", "yes") if kind is bool else kind(text)

    def show(self, what: str, arg: str | None = None) -> DataFrame:
        spark, meta = self.corpus.spark, self.corpus.meta
        if what == "settings":
            return spark.createDataFrame([(k, str(v)) for k, v in self.settings.items()], "name string, value string")
        if what == "named":
            return spark.createDataFrame([(n, ",".join([*m.slots, *m.regions, *m.subtrees])) for n, m in self.named.items()], "name string, labels string")
        if what == "attributes":
            return spark.createDataFrame([(a.removeprefix("attr:"), a in meta.multivalue, a in meta.kv_pipe) for a in meta.attributes], "attribute string, multivalue boolean, kv_pipe boolean")
        if what == "regions":
            if arg:
                self.corpus.mode(arg)
                return self.corpus.structs[arg].orderBy("start", "end")
            return spark.createDataFrame([(n, s["mode"], ",".join(s["attrs"])) for n, s in meta.structs.items()] + [(n, "group", "") for n in meta.groups], "struct string, mode string, attributes string")
        if what == "values":
            return aggregate.values(self.lowering(), arg)
        if what == "info":
            return spark.createDataFrame([(meta.size, ",".join(meta.attributes), ",".join(meta.structs), ",".join(meta.groups), meta.default_within)], "size long, attributes string, structs string, token_groups string, default_within string")
        raise CorpusError(f"can't show {what}")
