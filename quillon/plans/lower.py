"""Queries to DataFrames of matches.

A match has columns s<k>, e<k> (start and inclusive end of slot k, null if skipped), region columns
<label>__idx, __start, __end, __parent, subtree columns <label>__sub (positions), and first, last.
Every join of a chain is an equi-join on positions, heads, sentences or region indices.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus, CorpusError, covered, stored, value
from ..functions.text import feature, prefix_sums
from ..operators.predicates import COMPARE, Conditions, cardinality, test
from .ast import Filter, Fn, Leaf, Query, Region, Subtree, Token

AT = ("at", "at_head", "at_sent", "at_ein", "at_eout")
BUCKET = 64
#: Positions that meet in one group where neighbours are looked for.
STRETCH = 1 << 16


@dataclass
class Matches:
    df: DataFrame
    slots: dict = field(default_factory=dict)  # label -> k
    n: int = 0
    regions: dict = field(default_factory=dict)  # label -> struct
    subtrees: tuple = ()
    group: str | None = None  # token-group matches have spans and props
    pairs: tuple | None = None  # of a parallel query: the two sides
    held: dict = field(default_factory=dict)  # where a match is one token, the columns that hold its own: column of tokens -> column of df

    def keys(self) -> list[str]:
        names = [f"{p}{k}" for k in range(self.n) for p in "se"] + [f"{r}__idx" for r in self.regions]
        return names + (["gid"] if self.group else [])

    def with_df(self, df: DataFrame) -> Matches:
        return Matches(df, self.slots, self.n, self.regions, self.subtrees, self.group, self.pairs, self.held)

    def shown(self) -> DataFrame:
        """The matches without what they hold of tokens."""
        return self.df.drop(*self.held.values())


class Lowering:
    def __init__(self, corpus: Corpus, named: dict[str, Matches] | None = None, anchor_binding: str = "fanout"):
        self.corpus, self.named, self.binding = corpus, named if named is not None else {}, anchor_binding
        self.conditions = Conditions(corpus)

    # -------------------------------------------------------------- runs

    def runs(self, tokens: DataFrame) -> DataFrame:
        """Maximal runs of positions (start, end): islands within stretches of STRETCH positions; those that reach an edge of theirs, two a stretch at most, are joined with what goes on beyond."""
        stretch = F.expr(f"pos div {STRETCH}")
        w = Window.partitionBy("b").orderBy("pos")
        island = tokens.select("pos", stretch.alias("b")).withColumn("g", F.col("pos") - F.row_number().over(w))
        runs = island.groupBy("b", "g").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).select("start", "end")
        edge = (F.col("start") % STRETCH == 0) | (F.col("end") % STRETCH == STRETCH - 1)
        edges = runs.filter(edge)
        after = edges.select((F.col("end") + 1).alias("start"), F.lit(1).alias("after"))
        headed = edges.join(after, "start", "left").withColumn("head", F.when(F.col("after").isNull(), 1).otherwise(0))
        chained = prefix_sums(headed, "start", "head", "seen", max(1, self.corpus.meta.size))
        merged = chained.groupBy((F.col("seen") + F.col("head")).alias("g")).agg(F.min("start").alias("start"), F.max("end").alias("end")).select("start", "end")
        return runs.filter(~edge).unionByName(merged)

    def maximal(self, token: Token, chosen: DataFrame) -> DataFrame:
        """Single-token repetition: whole runs, those longer than `high` in tiles."""
        runs = self.runs(chosen)
        tiles = runs.select("end", F.explode(F.sequence("start", "end", F.lit(token.high))).alias("s0")).withColumn("e0", F.least(F.col("s0") + token.high - 1, F.col("end")))
        return tiles.filter(F.col("e0") - F.col("s0") + 1 >= max(token.low, 1)).select("s0", "e0")

    def spans(self, token: Token, chosen: DataFrame, within: str | None) -> DataFrame:
        """s, e, the tree of s, and w: every span of low..high tokens that all meet the condition."""
        w = F.col(f"r_{within}") if within else F.lit(None).cast("long")
        base = chosen.select(F.col("pos").alias("s"), F.col("head_pos"), F.col("sent_id"), F.col("ein"), F.col("eout"), w.alias("w"))
        if token.low <= 1 and token.high == 1:
            return base.withColumn("e", F.col("s"))
        low = max(token.low, 1)
        starts = self.runs(chosen).select("end", F.explode(F.sequence("start", "end")).alias("s")).filter(F.col("end") - F.col("s") + 1 >= low)
        each = starts.select("s", F.explode(F.sequence(F.col("s") + low - 1, F.least(F.col("s") + token.high - 1, F.col("end")))).alias("e"))
        return base.join(each, "s")

    # ------------------------------------------------------------- chains

    def chain(self, q: Query, within: str | None) -> Matches:
        items = q.items
        flat = within if within and self.corpus.mode(within) == "flat" else None
        slots, subtrees = {}, []
        if len(items) == 1 and isinstance(items[0], Token) and (items[0].low, items[0].high) != (1, 1):
            token = items[0]
            df = self.maximal(token, self.conditions.select(token.cond))
            return Matches(df, {token.label: 0} if token.label else {}, 1)
        if len(items) == 1 and isinstance(items[0], Token):
            return self.single(items[0], flat)
        df, empty, k = None, True, 0
        plain = list(takewhile(lambda x: isinstance(x, Token) and (x.low, x.high) == (1, 1) and x.edge == "", items))
        if len(plain) > 1:
            df, empty, k = self.adjacent(plain, flat), False, len(plain)
            slots |= {x.label: i for i, x in enumerate(plain) if x.label}
            items = items[k:]
        for at, item in enumerate(items):
            if isinstance(item, Subtree):
                if item.source not in slots:
                    raise CorpusError(f"dep_subtree of an unknown label {item.source}")
                df = self.bind_subtree(df, item.label, f"s{slots[item.source]}")
                subtrees.append(item.label)
                continue
            if item.label:
                slots[item.label] = k
            s, e = f"s{k}", f"e{k}"
            if df is not None and not empty and not flat and item.cond is None and all(isinstance(y, Token) and y.edge == "" for y in items[at:]):
                df, k = self.gap(df, item, s, e), k + 1
                continue
            x = self.spans(item, self.conditions.select(item.cond), flat)
            parts = []
            if empty:
                nulls = [F.lit(None).cast("long").alias(f"{p}{i}") for i in range(k) for p in "se"]
                parts.append(x.select(*nulls, F.col("s").alias(s), F.col("e").alias(e), F.col("e").alias("cur"), F.col("s").alias("at"), F.col("head_pos").alias("at_head"), F.col("sent_id").alias("at_sent"), F.col("ein").alias("at_ein"), F.col("eout").alias("at_eout"), F.col("w").alias("mw")))
            if df is not None:
                parts.append(self.step(df, x, item.edge, s, e, bool(flat), k))
                if item.low == 0 and not item.edge.startswith("!"):
                    parts.append(df.withColumn(s, F.lit(None).cast("long")).withColumn(e, F.lit(None).cast("long")))
            df = parts[0]
            for part in parts[1:]:
                df = df.unionByName(part, allowMissingColumns=True)
            empty, k = empty and item.low == 0, k + 1
        if df is None:
            raise CorpusError("a chain needs a token")
        return Matches(df, slots, k, {}, tuple(subtrees))

    def single(self, token: Token, within: str | None) -> Matches:
        """Matches of one token: their attributes and regions come along, so that no command has to join them to tokens again."""
        tokens, known = self.corpus.tokens, self.corpus.meta.attributes
        held = {c: f"tok{k}" for k, c in enumerate(c for c in tokens.columns if c in known or c.startswith("r_"))}
        chosen = self.conditions.select(token.cond, held)
        w = F.col(held[f"r_{within}"]) if within else F.lit(None).cast("long")
        df = chosen.select(F.col("pos").alias("s0"), F.col("pos").alias("e0"), w.alias("mw"), *held.values())
        return Matches(df, {token.label: 0} if token.label else {}, 1, held=held)

    def adjacent(self, items: list[Token], within: str | None) -> DataFrame:
        """Single tokens one after the other: tokens that meet any of the conditions shuffle once, however many there are.

        They are dealt by stretches of positions; the first ones of a stretch go to the one before as well.
        """
        df, n = self.corpus.tokens, len(items)
        flags = [f"__is{k}" for k in range(n)]
        for item, flag in zip(items, flags, strict=True):
            df, ok = self.conditions.apply(df, item.cond)
            df = df.withColumn(flag, F.coalesce(ok, F.lit(False)))
        w = F.col(f"r_{within}") if within else F.lit(None).cast("long")
        df = df.filter(" OR ".join(flags)).select("pos", "head_pos", "sent_id", "ein", "eout", w.alias("w"), *flags)
        own = F.expr(f"pos div {STRETCH}")
        both = F.when((F.col("pos") % STRETCH < n - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
        dealt = df.withColumn("b", F.explode(both))
        order = Window.partitionBy("b").orderBy("pos")
        for k in range(1, n):
            last = ("head_pos", "sent_id", "ein", "eout") if k == n - 1 else ()
            dealt = dealt.withColumn(f"__next{k}", F.lead(F.struct("pos", flags[k], "w", *last), k).over(order))
        ok = (own == F.col("b")) & F.col(flags[0])
        for k in range(1, n):
            x = F.col(f"__next{k}")
            ok &= (x["pos"] == F.col("pos") + k) & x[flags[k]]
            if within:
                ok &= x["w"] == F.col("w")
        x = F.col(f"__next{n - 1}")
        slots = [(F.col("pos") + k).alias(f"{p}{k}") for k in range(n) for p in "se"]
        return dealt.filter(ok).select(*slots, x["pos"].alias("cur"), x["pos"].alias("at"), x["head_pos"].alias("at_head"), x["sent_id"].alias("at_sent"), x["ein"].alias("at_ein"), x["eout"].alias("at_eout"), x["w"].alias("mw"))

    def step(self, df: DataFrame, x: DataFrame, edge: str, s: str, e: str, flat: bool, k: int) -> DataFrame:
        tree = {">": "x.head_pos = m.at", "<": "x.s = m.at_head", ">>": "x.sent_id = m.at_sent AND m.at_ein < x.ein AND x.eout < m.at_eout", "<<": "x.sent_id = m.at_sent AND x.ein < m.at_ein AND m.at_eout < x.eout", "": "x.s = m.cur + 1"}
        on = tree[edge.lstrip("!")]
        if edge.startswith("!"):
            kept = df.alias("m").join(x.alias("x"), F.expr(on), "left_anti")
            return kept.withColumn(s, F.lit(None).cast("long")).withColumn(e, F.lit(None).cast("long"))
        if flat:
            on += " AND x.w = m.mw"
        keep = [f"m.{c}" for c in df.columns if c not in (*AT, "cur")]
        return df.alias("m").join(x.alias("x"), F.expr(on)).select(*keep, F.col("x.s").alias(s), F.col("x.e").alias(e), F.col("x.e").alias("cur"), F.col("x.s").alias("at"), F.col("x.head_pos").alias("at_head"), F.col("x.sent_id").alias("at_sent"), F.col("x.ein").alias("at_ein"), F.col("x.eout").alias("at_eout"))

    def gap(self, df: DataFrame, token: Token, s: str, e: str) -> DataFrame:
        """The next low..high tokens, whatever they are: positions are dense, so these are reckoned and not joined. Their trees, which only relations look at, are left out."""
        last, low = self.corpus.meta.size - 1, max(token.low, 1)
        blank = {c: F.lit(None).cast(df.schema[c].dataType) for c in AT if c in df.columns and c != "at"}
        ends = F.explode(F.sequence(F.col("cur") + low, F.least(F.col("cur") + token.high, F.lit(last))))
        some = df.filter(F.col("cur") + low <= last).withColumn(s, F.col("cur") + 1).withColumn(e, ends).withColumns({"cur": F.col(e), "at": F.col(s), **blank})
        if token.low:
            return some
        none = F.lit(None).cast("long")
        return some.unionByName(df.withColumns({s: none, e: none}))

    def bind_subtree(self, df: DataFrame, label: str, at: str) -> DataFrame:
        """The head and its strict descendants as an array of positions."""
        t = self.corpus.tokens.select("pos", "sent_id", "ein", "eout")
        heads = df.select(F.col(at).alias("__h")).distinct().join(t.withColumnRenamed("pos", "__h"), "__h").alias("a")
        below = heads.join(t.alias("b"), (F.col("a.sent_id") == F.col("b.sent_id")) & F.expr("a.ein <= b.ein AND b.eout <= a.eout"))
        sets = below.groupBy("__h").agg(F.array_sort(F.collect_list("b.pos")).alias(f"{label}__sub"))
        return df.join(sets.withColumnRenamed("__h", at), at)

    def extent(self, m: Matches) -> Matches:
        starts, ends = [F.col(f"s{k}") for k in range(m.n)], [F.col(f"e{k}") for k in range(m.n)]
        low = starts[0] if m.n == 1 else F.least(*starts)
        high = ends[0] if m.n == 1 else F.greatest(*ends)
        drop = [c for c in (*AT, "cur") if c in m.df.columns]
        return m.with_df(m.df.withColumn("first", low).withColumn("last", high).drop(*drop))

    # ------------------------------------------------------------ regions

    def rows(self, struct: str, attrs: tuple = (), label: str = "") -> DataFrame:
        rows = self.corpus.structs[struct]
        for name, wanted in attrs:
            name = next((n for n in (stored(name), f"{struct}_{name}") if n in self.corpus.meta.structs[struct]["attrs"]), None)
            rows = rows.filter(value(name) == wanted if name else F.lit(False))
        return rows.select(F.col("idx").alias(f"{label}__idx"), F.col("start").alias(f"{label}__start"), F.col("end").alias(f"{label}__end"), F.col("parent_idx").alias(f"{label}__parent"))

    def anchors(self, m: Matches, q: Query) -> Matches:
        df, regions = m.df, dict(m.regions)
        for k, a in enumerate(q.anchors):
            self.corpus.mode(a.struct)
            label = a.label or f"anchor{k}"
            before = F.coalesce(*[F.col(f"e{i}") for i in reversed(range(min(a.at, m.n)))], F.lit(None).cast("long"))
            after = F.coalesce(*[F.col(f"s{i}") for i in range(a.at, m.n)], F.lit(None).cast("long"))
            rows = self.rows(a.struct, a.attrs, label)
            target = before if a.closing else F.coalesce(after, before + 1)
            side = f"{label}__end" if a.closing else f"{label}__start"
            if not a.label and not a.peers:
                df = df.withColumn("__t", target).join(rows.select(F.col(side).alias("__t")), "__t", "left_semi").drop("__t")
                continue
            df = df.withColumn("__t", target).join(rows, F.col("__t") == F.col(side)).drop("__t")
            for name, other in a.peers:
                if other not in regions:
                    raise CorpusError(f"{name}({other}): {other} is not bound before")
                df = self.relate(df, name, label, other, regions[other])
            if self.binding == "innermost" and self.corpus.mode(a.struct) != "flat":
                w = Window.partitionBy(*m.keys(), *[f"{r}__idx" for r in regions]).orderBy(F.col(f"{label}__end") - F.col(f"{label}__start"), f"{label}__idx")
                df = df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
            regions[label] = a.struct
        return Matches(df, m.slots, m.n, regions, m.subtrees, held=m.held)

    def relate(self, df: DataFrame, name: str, this: str, other: str, struct: str) -> DataFrame:
        """Peer clauses: this region contains(other), is a child of other (rchild), or dominates it (rcontains)."""
        if name == "contains":
            return df.filter(f"{this}__start <= {other}__start AND {this}__end >= {other}__end")
        if name == "rchild":
            return df.filter(f"{this}__parent = {other}__idx")
        return df.join(self.ancestors(struct).select(F.col("idx").alias(f"{other}__idx"), F.col("anc").alias(f"{this}__idx")), [f"{other}__idx", f"{this}__idx"], "left_semi")

    def ancestors(self, struct: str) -> DataFrame:
        """idx and every region on its parent chain, itself included; as many joins as the nesting is deep, each level computed once."""
        known = self.corpus.chains
        if struct not in known:
            up = self.corpus.structs[struct].select("idx", F.col("parent_idx").alias("anc")).filter("anc IS NOT NULL")
            out, level = self.corpus.structs[struct].select("idx", F.col("idx").alias("anc")), up.persist()
            while True:
                n, round_ = level.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("idx") == F.col("anc")).cast("long")), F.lit(0))).first()
                if round_:
                    raise CorpusError(f"{struct}: a region is its own ancestor")
                if not n:
                    break
                out = out.unionByName(level)
                level = level.alias("a").join(up.alias("b"), F.col("a.anc") == F.col("b.idx")).select("a.idx", "b.anc").persist()
            known[struct] = out
        return known[struct]

    def region_query(self, q: Query) -> Matches:
        """Anchors alone: each row is a match; a further anchor must be related to an earlier one by a function filter."""
        df, regions = None, {}
        for k, a in enumerate(q.anchors):
            label = a.label or f"anchor{k}"
            self.corpus.mode(a.struct)
            rows = self.rows(a.struct, a.attrs, label)
            if df is None:
                df = rows
            else:
                pair = next((f.left for f in q.filters if isinstance(f.left, Fn) and f.left.name in ("contains", "rchild", "rcontains") and label in f.left.args and set(f.left.args) <= {label, *regions}), None)
                if pair is None:
                    raise CorpusError("several region anchors need contains(), rchild() or rcontains() between them")
                outer, inner = pair.args
                if pair.name == "rchild":
                    df = df.join(rows, F.col(f"{inner}__parent") == F.col(f"{outer}__idx"))
                elif pair.name == "rcontains":
                    links = self.ancestors(a.struct).select(F.col("idx").alias(f"{inner}__idx"), F.col("anc").alias(f"{outer}__idx"))
                    df = df.join(links, f"{inner if inner != label else outer}__idx").join(rows, f"{label}__idx")
                else:
                    big, small = (rows, df) if outer == label else (df, rows)
                    points = big.filter(f"{outer}__start <= {outer}__end").withColumn("__p", F.explode(F.sequence(f"{outer}__start", f"{outer}__end")))
                    df = points.join(small, F.col("__p") == F.col(f"{inner}__start")).filter(f"{inner}__end <= {outer}__end").drop("__p")
            regions[label] = a.struct
        df = df.withColumn("first", F.least(*[F.col(f"{r}__start") for r in regions], F.lit(None).cast("long"))).withColumn("last", F.greatest(*[F.col(f"{r}__end") for r in regions], F.lit(None).cast("long")))
        return Matches(df, {}, 0, regions)

    def group_query(self, q: Query) -> Matches:
        a = q.anchors[0]
        rows = self.corpus.groups[a.struct]
        for name, wanted in a.attrs:
            rows = rows.filter(F.try_element_at("props", F.lit(name)) == wanted)
        return Matches(rows.select("gid", "first", "last", "spans", "props"), {}, 0, {}, (), a.struct)

    # ------------------------------------------------------------ clauses

    def region_rows(self, r: Region, having) -> DataFrame:
        self.corpus.mode(r.struct)
        rows = self.corpus.structs[r.struct]
        if r.cond is not None:
            _, attr = self.corpus.region_attribute(r.cond.attr) or (None, None)
            if not attr:
                raise CorpusError(f"no attribute {r.cond.attr}")
            rows = rows.filter(test(value(attr), r.cond))
        if having is not None:
            chosen = self.conditions.select(having)
            if self.corpus.mode(r.struct) == "flat":
                inside = chosen.select(F.col(f"r_{r.struct}").alias("idx")).distinct()
            else:
                inside = covered(rows.select("idx", "start", "end")).join(chosen.select("pos"), "pos").select("idx").distinct()
            rows = rows.join(inside, "idx", "left_semi")
        return rows

    def within(self, m: Matches, r: Region, having, negated: bool) -> Matches:
        if r.struct in self.corpus.groups:
            raise CorpusError(f"{r.struct} is a token group, which has no inside")
        rows = self.region_rows(r, having).select("idx", "start", "end")
        how = "left_anti" if negated else "left_semi"
        if self.corpus.mode(r.struct) == "flat":
            points = self.corpus.tokens.select(F.col("pos").alias("__p"), F.col(f"r_{r.struct}").alias("idx")).join(rows, "idx").select("__p", F.col("end").alias("__end"))
        else:
            points = covered(rows).select(F.col("pos").alias("__p"), F.col("end").alias("__end"))
        return m.with_df(m.df.join(points, (F.col("first") == F.col("__p")) & (F.col("last") <= F.col("__end")), how))

    def containing(self, m: Matches, r: Region) -> Matches:
        if r.subtree:
            t = self.corpus.tokens.select("pos", "sent_id", "ein", "eout").alias("b")
            heads = self.conditions.select(r.cond).alias("a")
            inner = heads.join(t, (F.col("a.sent_id") == F.col("b.sent_id")) & F.expr("a.ein <= b.ein AND b.eout <= a.eout")).groupBy("a.pos").agg(F.min("b.pos").alias("start"), F.max("b.pos").alias("end"))
        else:
            if r.struct in self.corpus.groups:
                raise CorpusError(f"{r.struct} is a token group, which can't be contained")
            inner = self.region_rows(r, None)
        inner = inner.select(F.expr(f"start div {BUCKET}").alias("__b"), F.col("start").alias("__s"), F.col("end").alias("__e"))
        keys = m.keys()
        probe = m.df.select(*keys, "first", "last", F.explode(F.sequence(F.expr(f"first div {BUCKET}"), F.expr(f"last div {BUCKET}"))).alias("__b"))
        hits = probe.join(inner, "__b").filter("__s >= first AND __e <= last AND __s <= last").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
        on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        return m.with_df(m.df.join(hits, on, "left_anti" if r.negated else "left_semi"))

    # -------------------------------------------------------------- fields

    def position(self, m: Matches, label: str) -> Column:
        if label in m.slots:
            return F.col(f"s{m.slots[label]}")
        if label in m.subtrees:
            return F.element_at(f"{label}__sub", 1)
        raise CorpusError(f"no token is named {label}")

    def span_positions(self, m: Matches, label: str) -> Column:
        if label in m.subtrees:
            return F.col(f"{label}__sub")
        if label in m.regions:
            return F.sequence(F.col(f"{label}__start"), F.col(f"{label}__end"))
        return F.sequence(F.col(f"s{m.slots[label]}"), F.col(f"e{m.slots[label]}"))

    def field(self, m: Matches, name: str) -> tuple[Matches, Column]:
        """A named field of a match: the matches, with what had to be joined, and a column that is null where there is no value."""
        if "(" in name:
            fn, args = name[:-1].split("(")
            label, *attr = args.split(",")
            if fn == "tcnt":
                return m, F.size(self.span_positions(m, label)).cast("string")
            return self.spelled(m, label, attr[0] if attr else "form")
        label, _, attr = name.partition(".")
        if not attr or label == "match":
            attr = attr or label
            if m.group and attr not in self.corpus.meta.attributes:
                prop = F.try_element_at("props", F.lit(attr))
                return m, F.coalesce(prop, F.try_element_at("props", F.lit("code"))) if attr == "type" else prop
            return self.at(m, attr, F.col("first"))
        if label in m.regions:
            struct = m.regions[label]
            attrs = self.corpus.meta.structs[struct]["attrs"]
            for option in map(stored, (attr, attr.removeprefix(f"{struct}_"), f"{struct}_{attr}")):
                if option in attrs:
                    out = self.conditions.fresh("f")
                    rows = self.corpus.structs[struct].select(F.col("idx").alias(f"{label}__idx"), value(option).alias(out))
                    return m.with_df(m.df.join(rows, f"{label}__idx", "left")), F.col(out)
            raise CorpusError(f"{struct} has no attribute {attr}")
        return self.at(m, attr, self.position(m, label))

    def at(self, m: Matches, attr: str, position: Column) -> tuple[Matches, Column]:
        if m.held:
            return self.held(m, attr)
        key, out = self.conditions.fresh("p"), self.conditions.fresh("f")
        c = self.conditions.positional(attr)
        if c is not None:
            df = m.df.withColumn(key, position).join(self.corpus.tokens.select(F.col("pos").alias(key), c.alias(out)), key, "left")
            return m.with_df(df), F.col(out)
        df, c, many = self.conditions.region_values(m.df.withColumn(key, position), attr, key)
        return m.with_df(df), F.when(F.size(c) > 0, F.array_join(c, "|")) if many else c

    def held(self, m: Matches, attr: str) -> tuple[Matches, Column]:
        """`at` the only token of each match, of the columns that come with it."""
        column, (base, _, key) = self.corpus.attribute(attr), attr.partition("/")
        if column:
            return m, F.col(m.held[column])
        if key and base in self.corpus.meta.attributes:
            return m, feature(F.col(m.held[base]), key)
        found = self.corpus.region_attribute(attr)
        if found and f"r_{found[0]}" in m.held:
            out, idx = self.conditions.fresh("f"), m.held[f"r_{found[0]}"]
            rows = self.corpus.structs[found[0]].select(F.col("idx").alias(idx), value(found[1]).alias(out))
            return m.with_df(m.df.join(rows, idx, "left")), F.col(out)
        key = self.conditions.fresh("p")
        df, c, many = self.conditions.region_values(m.df.withColumn(key, F.col("first")), attr, key)
        return m.with_df(df), F.when(F.size(c) > 0, F.array_join(c, "|")) if many else c

    def spelled(self, m: Matches, label: str, attr: str) -> tuple[Matches, Column]:
        """Values of a span joined by spaces, gaps by ` ... `."""
        keys = m.keys()
        c = self.conditions.positional(attr)
        if c is None:
            raise CorpusError(f"no attribute {attr}")
        out = self.conditions.fresh("f")
        each = m.df.select(*keys, F.explode(self.span_positions(m, label)).alias("pos")).distinct().join(self.corpus.tokens.select("pos", c.alias("__v")), "pos")
        per = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "__v"))).alias("__l"))
        text = F.aggregate("__l", F.struct(F.lit("").alias("t"), F.lit(None).cast("long").alias("p")), lambda a, x: F.struct(F.when(a["p"].isNull(), x["__v"]).otherwise(F.concat(a["t"], F.when(x["pos"] == a["p"] + 1, " ").otherwise(" ... "), x["__v"])).alias("t"), x["pos"].alias("p")), lambda a: a["t"])
        per = per.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], text.alias(out))
        df = m.df.join(per, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left").drop(*[f"__k{i}" for i in range(len(keys))])
        return m.with_df(df), F.col(out)

    # ------------------------------------------------------------- filters

    def function(self, m: Matches, fn) -> tuple[Matches, Column]:
        if isinstance(fn, int):
            return m, F.lit(fn)
        if isinstance(fn, Leaf):
            return m, F.lit(int(fn.value))
        if not isinstance(fn, Fn):
            raise CorpusError(f"{fn} is no function or number")
        a = fn.args
        if fn.name in ("distance", "distabs"):
            return m, F.abs(self.position(m, a[0]) - self.position(m, a[1]))
        if fn.name == "strlen":
            m, c = self.field(m, a[0])
            return m, F.char_length(c)
        if fn.name == "nvals":
            m, c = self.field(m, a[0])
            return m, F.when(c.isNull(), 0).otherwise(cardinality(c))
        if fn.name == "f":
            m, c = self.field(m, a[0])
            k, n = self.conditions.fresh("k"), self.conditions.fresh("n")
            attr = self.conditions.positional(a[0].partition(".")[2] or a[0])
            if attr is None:
                raise CorpusError(f"f() takes a token attribute, not {a[0]}")
            freq = self.corpus.tokens.groupBy(attr.alias(k)).agg(F.count(F.lit(1)).alias(n))
            return m.with_df(m.df.withColumn(k, c).join(freq, k, "left")), F.col(n)
        if fn.name in ("nchildren", "depth", "ndescendants"):
            p, out = self.conditions.fresh("p"), self.conditions.fresh("n")
            c = {"nchildren": F.col("n_children"), "depth": F.col("depth"), "ndescendants": F.expr("(eout - ein) div 2")}[fn.name]
            return m.with_df(m.df.withColumn(p, self.position(m, a[0])).join(self.corpus.tokens.select(F.col("pos").alias(p), c.alias(out)), p, "left")), F.col(out)
        if fn.name == "tcnt":
            return m, F.size(self.span_positions(m, a[0]))
        for label in a:
            if label not in m.regions:
                raise CorpusError(f"{fn.name}: {label} is no region")
        outer, inner = a
        if fn.name == "contains":
            return m, F.expr(f"{outer}__start <= {inner}__start AND {outer}__end >= {inner}__end").cast("int")
        if m.regions[outer] != m.regions[inner]:
            return m, F.lit(0)
        if fn.name == "rchild":
            return m, F.coalesce(F.col(f"{inner}__parent") == F.col(f"{outer}__idx"), F.lit(False)).cast("int")
        out = self.conditions.fresh("n")
        links = self.ancestors(m.regions[outer]).select(F.col("idx").alias(f"{inner}__idx"), F.col("anc").alias(f"{outer}__idx"), F.lit(1).alias(out))
        return m.with_df(m.df.join(links, [f"{inner}__idx", f"{outer}__idx"], "left")), F.coalesce(out, F.lit(0))

    def filter(self, m: Matches, f: Filter) -> Matches:
        if f.kind == "order":
            return m.with_df(m.df.filter(COMPARE[f.op](self.position(m, f.left), self.position(m, f.right))))
        if f.kind == "function":
            m, left = self.function(m, f.left)
            m, right = self.function(m, f.right)
            return m.with_df(m.df.filter(COMPARE[f.op](left, right)))
        if f.kind == "region":
            m, c = self.field(m, f.left)
            return m.with_df(m.df.filter(test(c, f.right)))
        return self.align(m, f)

    def is_multivalue(self, name: str) -> bool:
        attr = name.partition(".")[2] or name
        return attr in self.corpus.meta.multivalue

    def align(self, m: Matches, f: Filter) -> Matches:
        """a.x = b.x inside a match, or against a named token of an earlier query: those with an equal value somewhere there."""
        from ..functions.text import components

        own = lambda name: name.partition(".")[0] in {*m.slots, *m.regions, *m.subtrees, "match"} or "." not in name
        many = self.is_multivalue(f.left) or self.is_multivalue(f.right)
        if own(f.left) and own(f.right):
            m, left = self.field(m, f.left)
            m, right = self.field(m, f.right)
            if many:
                same = F.arrays_overlap(components(left), components(right))
                return m.with_df(m.df.filter(same if f.op == "=" else ~same))
            return m.with_df(m.df.filter(COMPARE[f.op](left, right)))
        here, there = (f.left, f.right) if own(f.left) else (f.right, f.left)
        label = there.partition(".")[0]
        source = self.named.get(label) or next((x for x in reversed(list(self.named.values())) if label in x.slots or label in x.regions), None)
        if source is None or f.op != "=":
            raise CorpusError(f"{label} is not known here")
        name = there if label in source.slots or label in source.regions else there.partition(".")[2]
        source, c = self.field(source, name)
        values = source.df.select(F.explode(components(c)).alias("__a") if many else c.alias("__a")).filter("__a IS NOT NULL AND __a <> '_'").distinct()
        m, c = self.field(m, here)
        if many:
            return self.overlapping(m, c, values)
        return m.with_df(m.df.withColumn("__a", c).join(values, "__a", "left_semi").drop("__a"))

    def overlapping(self, m: Matches, c: Column, values: DataFrame) -> Matches:
        from ..functions.text import components

        keys = m.keys()
        hits = m.df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.explode(components(c)).alias("__a")).join(values, "__a").drop("__a").distinct()
        return m.with_df(m.df.join(hits, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left_semi"))

    # --------------------------------------------------------------- whole

    def positions(self, m: Matches) -> DataFrame:
        """pos, one row per match and distinct matched position."""
        if m.group:
            return m.df.select(F.explode("spans").alias("s")).select(F.explode(F.sequence("s.start", "s.end")).alias("pos"))
        return m.df.select(F.explode(self.matched(m)).alias("pos"))

    def matched(self, m: Matches) -> Column:
        if m.group:
            return F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"])))
        none = F.array().cast("array<bigint>")
        parts = [F.when(F.col(f"s{k}").isNull(), none).otherwise(F.sequence(F.col(f"s{k}"), F.col(f"e{k}"))) for k in range(m.n)]
        parts += [F.col(f"{x}__sub") for x in m.subtrees]
        if not m.n:
            parts += [F.when(F.col(f"{r}__start") > F.col(f"{r}__end"), none).otherwise(F.sequence(F.col(f"{r}__start"), F.col(f"{r}__end"))) for r in m.regions]
        return F.array_sort(F.array_distinct(F.concat(*parts)))

    def query(self, q: Query) -> Matches:
        if q.other is not None:
            return self.parallel(q)
        if not q.items and q.anchors[0].struct in self.corpus.groups and q.anchors[0].struct not in self.corpus.structs:
            m = self.group_query(q)
        elif not q.items:
            m = self.region_query(q)
        else:
            default = self.corpus.meta.default_within
            region = q.within or (Region(default) if default else None)
            m = self.extent(self.chain(q, region.struct if region and region.struct in self.corpus.structs else None))
            m = self.anchors(m, q)
            if region:
                m = self.within(m, region, q.having, False)
        if q.not_within:
            m = self.within(m, q.not_within, None, True)
        for r in q.containing:
            m = self.containing(m, r)
        for f in q.filters:
            m = self.filter(m, f)
        for name in q.where:
            m = self.where(m, name)
        if "mw" in m.df.columns:
            m = m.with_df(m.df.drop("mw"))
        return m

    def where(self, m: Matches, name: str) -> Matches:
        """Matches of which a matched position is one of another query's."""
        if name not in self.named:
            raise CorpusError(f"no query is named {name}")
        keys = m.keys()
        members = m.df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.explode(self.matched(m)).alias("pos"))
        hits = members.join(self.positions(self.named[name]).distinct(), "pos").drop("pos").distinct()
        return m.with_df(m.df.join(hits, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left_semi"))

    def subtree(self, label: str, source: str, filters: tuple) -> Matches:
        """label = dep_subtree(source): of a named query's first positions, or of a label of the last query."""
        m = self.named.get(source)
        at = "first"
        if m is None:
            m = self.named.get("Last")
            if m is None or source not in m.slots:
                raise CorpusError(f"dep_subtree: nothing is named {source}")
            at = f"s{m.slots[source]}"
        df = self.bind_subtree(m.df.withColumn("__at", F.col(at)), label, "__at").drop("__at")
        m = Matches(df, m.slots, m.n, m.regions, (*m.subtrees, label), m.group)
        for f in filters:
            m = self.filter(m, f)
        return m

    def parallel(self, q: Query) -> Matches:
        """Q1 with Q2: pairs whose values agree; without a condition, pairs in aligned sentences (s_tuid)."""
        from ..functions.text import components
        from .ast import replace

        sides = [self.query(replace(q, other=None, filters=())), self.query(replace(q.other, within=q.other.within or q.within))]
        a, b = sides
        wanted = [f for f in q.filters if f.kind == "align"]
        if not wanted:
            if self.corpus.region_attribute("s_tuid") is None:
                raise CorpusError("`with` needs a condition: the corpus has no s_tuid")
            wanted = [Filter("align", "s_tuid", "=", "s_tuid")]
        left, right, on, sets = a, b, [], []
        for k, f in enumerate(wanted):
            x, y = (f.left, f.right) if f.left.partition(".")[0] in {*a.slots, *a.regions} or "." not in f.left else (f.right, f.left)
            left, cx = self.field(left, x)
            right, cy = self.field(right, y)
            multi = self.is_multivalue(x) or self.is_multivalue(y)
            left, right = left.with_df(left.df.withColumn(f"__x{k}", components(cx) if multi else cx)), right.with_df(right.df.withColumn(f"__y{k}", components(cy) if multi else cy))
            (sets if multi else on).append(k)
        for f in q.filters:
            if f.kind != "align":
                left = self.filter(left, f)
        names = lambda m, p, c: m.df.select(*[F.col(x).alias(f"{p}{x}") for x in (*m.keys(), "first", "last")], *[F.col(f"{c}{k}") for k in range(len(wanted))])
        la, rb = names(left, "a_", "__x"), names(right, "b_", "__y")
        if on:
            la = la.filter(" AND ".join(f"__x{k} <> '_'" for k in on))
            pairs = la.join(rb, [F.col(f"__x{k}") == F.col(f"__y{k}") for k in on])
        else:
            pairs = la.withColumn("__c", F.explode(f"__x{sets[0]}")).join(rb.withColumn("__d", F.explode(f"__y{sets[0]}")), F.col("__c") == F.col("__d")).drop("__c", "__d").distinct()
        for k in sets:
            pairs = pairs.filter(F.arrays_overlap(F.col(f"__x{k}"), F.col(f"__y{k}")))
        pairs = pairs.drop(*[f"__{c}{k}" for k in range(len(wanted)) for c in "xy"])
        return Matches(pairs.withColumn("first", F.col("a_first")).withColumn("last", F.col("a_last")), {}, 0, {}, (), None, (a, b))
