"""Token conditions as boolean columns over the tokens table, with the joins they need."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus, CorpusError, covered, value
from ..functions.text import components, feature, fold
from ..plans.ast import Bool, CountRel, Leaf, NVals, Rel

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
TREE = ("pos", "sent_id", "head_pos", "ein", "eout")


def test(c: Column, leaf: Leaf, multivalue: bool = False) -> Column:
    """A value against a leaf; a multivalue is a set of which one component must match (for !=: none)."""
    if leaf.op in ("=", "!="):
        if leaf.kind == "literal":
            one = lambda x: fold(x, leaf.flags) == fold(F.lit(leaf.value), leaf.flags)
        else:
            pattern = rf"\A(?:{leaf.value})\z" if leaf.kind == "whole" else leaf.value
            one = lambda x: x.rlike(pattern)
        got = F.exists(components(c), one) if multivalue else one(c)
        return got if leaf.op == "=" else ~got
    return COMPARE[leaf.op](c, F.lit(leaf.value))


def cardinality(c: Column) -> Column:
    return F.size(components(c))


def related_in(cond) -> bool:
    """Whether a condition asks for other tokens."""
    return any(map(related_in, cond.args)) if isinstance(cond, Bool) else isinstance(cond, (Rel, CountRel))


class Conditions:
    def __init__(self, corpus: Corpus):
        self.corpus, self.n = corpus, 0

    def fresh(self, name: str) -> str:
        self.n += 1
        return f"__{name}{self.n}"

    def select(self, cond, held: dict[str, str] | None = None) -> DataFrame:
        """The tokens that meet a condition: pos, doc_id, sent_id, the tree, and r_<struct> of flat structures; columns of `held` under their new names."""
        t = self.corpus.tokens
        df, ok = self.apply(t, cond)
        return df.filter(ok).select(*TREE, "doc_id", *[c for c in t.columns if c.startswith("r_")], *[value(c).alias(name) for c, name in (held or {}).items()])

    def apply(self, df: DataFrame, cond, given: Column | None = None) -> tuple[DataFrame, Column]:
        """`df` with what the condition needs, and the condition. Where `given` is not true a relation may count as none: the result is only used with it."""
        if cond is None:
            return df, F.lit(True)
        if isinstance(cond, Bool):
            out = None
            # relations come last: of a conjunction only tokens that meet the rest are looked at
            for arg in sorted(cond.args, key=related_in):
                so_far = out if cond.op == "and" else None
                known = so_far if given is None else given if so_far is None else given & so_far
                df, ok = self.apply(df, arg, known)
                out = ok if out is None else (out & ok) if cond.op == "and" else (out | ok)
            return df, out
        if isinstance(cond, Leaf):
            return self.leaf(df, cond.attr, cond)
        if isinstance(cond, NVals):
            return self.count_values(df, cond)
        n = self.fresh("n")
        df = df.join(self.related(cond.rel, cond.cond, df if given is None else df.filter(given)).withColumnRenamed("n", n), "pos", "left")
        count = F.coalesce(F.col(n), F.lit(0))
        if isinstance(cond, CountRel):
            return df, COMPARE[cond.op](count, F.lit(cond.n))
        if isinstance(cond, Rel):
            return df, (count == 0) if cond.negated else (count > 0)
        raise TypeError(cond)

    def related(self, rel: str, cond, t: DataFrame) -> DataFrame:
        """pos and n: how many of its children, ... meet the condition, where any do; for tokens `t` at least."""
        c = self.select(cond)
        if rel == "child":
            return c.filter("head_pos IS NOT NULL").groupBy(F.col("head_pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
        if rel == "parent":
            return t.select("pos", "head_pos").join(c.select(F.col("pos").alias("head_pos")), "head_pos").select("pos", F.lit(1).cast("long").alias("n"))
        if rel == "sibling":
            per = c.filter("head_pos IS NOT NULL").groupBy("head_pos").agg(F.count(F.lit(1)).alias("all"))
            own = c.select("pos", F.lit(1).alias("own"))
            return t.select("pos", "head_pos").join(per, "head_pos").join(own, "pos", "left").select("pos", (F.col("all") - F.coalesce("own", F.lit(0))).alias("n")).filter("n > 0")
        a, b = t.select("pos", "sent_id", "ein", "eout").alias("a"), c.select("sent_id", "ein", "eout").alias("b")
        inside = "a.ein < b.ein AND b.eout < a.eout" if rel == "descendant" else "b.ein < a.ein AND a.eout < b.eout"
        return a.join(b, (F.col("a.sent_id") == F.col("b.sent_id")) & F.expr(inside)).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))

    # ------------------------------------------------------------- leaves

    def positional(self, name: str) -> Column | None:
        """The column of a token attribute, or of one key of a bundle."""
        col = self.corpus.attribute(name)
        if col:
            return value(col)
        base, _, key = name.partition("/")
        if key and base in self.corpus.meta.attributes:
            return feature(value(base), key)
        return None

    def leaf(self, df: DataFrame, name: str, leaf: Leaf) -> tuple[DataFrame, Column]:
        c = self.positional(name)
        if c is not None:
            if "/" in name and not self.corpus.attribute(name) and leaf.op not in ("=", "!="):
                return df, F.lit(False)
            return df, test(c, leaf, self.corpus.attribute(name) in self.corpus.meta.multivalue)
        if name == "contr_form" and "contr" not in self.corpus.meta.structs:
            return df, F.lit(False)
        found = self.corpus.region_attribute(name)
        if found and self.corpus.mode(found[0]) != "flat":
            # only the regions that meet it are laid over positions
            out = self.fresh("ok")
            rows = self.corpus.structs[found[0]].filter(test(value(found[1]), leaf, name in self.corpus.meta.multivalue))
            there = covered(rows.select("start", "end")).select("pos").distinct().withColumn(out, F.lit(True))
            return df.join(there, "pos", "left"), F.coalesce(F.col(out), F.lit(False))
        df, c, _ = self.region_values(df, name, "pos")
        return df, F.coalesce(test(c, leaf, name in self.corpus.meta.multivalue), F.lit(False))

    def region_values(self, df: DataFrame, name: str, at: str) -> tuple[DataFrame, Column, bool]:
        """The value of struct_attr at a position column: one (flat) or the array of all covering regions' (else)."""
        found = self.corpus.region_attribute(name)
        if not found:
            raise CorpusError(f"no attribute {name}")
        struct, attr = found
        out = self.fresh("v")
        rows = self.corpus.structs[struct]
        if self.corpus.mode(struct) == "flat":
            key = f"r_{struct}"
            if at != "pos" or key not in df.columns:
                key = self.fresh("r")
                df = df.join(self.corpus.tokens.select(F.col("pos").alias(at), F.col(f"r_{struct}").alias(key)), at, "left")
            return df.join(rows.select(F.col("idx").alias(key), value(attr).alias(out)), key, "left"), F.col(out), False
        per = self.corpus.bridge(struct).groupBy("pos").agg(F.array_sort(F.collect_set(value(attr))).alias(out)).withColumnRenamed("pos", at)
        return df.join(per, at, "left"), F.col(out), True

    def count_values(self, df: DataFrame, cond: NVals) -> tuple[DataFrame, Column]:
        c = self.positional(cond.attr)
        if c is not None:
            return df, COMPARE[cond.op](cardinality(c), F.lit(cond.n))
        df, c, many = self.region_values(df, cond.attr, "pos")
        n = F.size(F.array_distinct(F.flatten(F.transform(c, components)))) if many else cardinality(c)
        return df, COMPARE[cond.op](F.when(c.isNull(), 0).otherwise(n), F.lit(cond.n))
