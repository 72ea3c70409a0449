"""Commands that show matches: tables, concordances, records, CoNLL-U."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import CORE, value
from ..functions.text import components
from ..plans.lower import Lowering, Matches


def tabulate(low: Lowering, m: Matches, fields: tuple, offset: int = 0, limit: int | None = 1000, arrays: bool = False) -> DataFrame:
    """One column a field, in order of position; sets stay joined, or become arrays."""
    cols = []
    for name in fields:
        m, c = low.field(m, name)
        cols.append((components(c) if arrays and low.is_multivalue(name) else F.coalesce(c, F.lit(""))).alias(name))
    df = m.df.orderBy("first", "last", *m.keys())
    df = df.offset(offset) if offset else df
    return (df.limit(limit) if limit is not None else df).select(*cols)


def sort(low: Lowering, m: Matches, fields: tuple) -> Matches:
    """The matches ordered by the fields' joined values, then by position."""
    cols = []
    for name in fields:
        m, c = low.field(m, name)
        cols.append(F.coalesce(c, F.lit("")))
    return m.with_df(m.df.orderBy(F.concat_ws("\t", *cols), "first", "last"))


def raw(low: Lowering, m: Matches, attr: str = "form") -> DataFrame:
    """first, last, positions, forms"""
    at = m.df.select("first", "last", low.matched(m).alias("positions"))
    each = at.select("*", F.posexplode("positions").alias("k", "pos")).join(low.corpus.tokens.select("pos", value(attr)), "pos")
    lists = each.groupBy("first", "last", "positions").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value(attr)))), lambda x: x[attr]).alias("forms"))
    return lists.orderBy("first", "last")


def page(m: Matches, offset: int = 0, limit: int | None = 20) -> Matches:
    df = m.df.orderBy("first", "last", *m.keys())
    df = df.offset(offset) if offset else df
    return m.with_df(df.limit(limit) if limit is not None else df)


def kwic(low: Lowering, m: Matches, left: int = 5, right: int = 5, offset: int = 0, limit: int | None = 20, attr: str = "form") -> DataFrame:
    """first, last, doc, left, match, right: words around each match of a page."""
    m = page(m, offset, limit)
    span = m.df.select("first", "last").distinct()
    at = span.select("first", "last", F.explode(F.sequence(F.greatest(F.col("first") - left, F.lit(0)), F.col("last") + right)).alias("pos"))
    words = at.join(low.corpus.tokens.select("pos", "doc_id", value(attr).alias("w")), "pos")
    part = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "w")))), lambda x: x["w"]), " ")
    got = words.groupBy("first", "last").agg(F.min(F.when(F.col("pos") == F.col("first"), F.col("doc_id"))).alias("doc"), part(F.col("pos") < F.col("first")).alias("left"), part(F.col("pos").between(F.col("first"), F.col("last"))).alias("match"), part(F.col("pos") > F.col("last")).alias("right"))
    return got.orderBy("first", "last")


def concordance_line(left: str, match: str, right: str, width: int = 40, marks: tuple[str, str] = ("<", ">")) -> str:
    """One line with the match in the middle, contexts cut to `width` characters."""
    return f"{left[-width:]:>{width}} {marks[0]}{match}{marks[1]} {right[:width]}".rstrip()


def lines(found: DataFrame, width: int = 40, marks: tuple[str, str] = ("<", ">")) -> DataFrame:
    """first, last, line of each row of `kwic`: `concordance_line` as an expression."""
    line = F.concat(F.lpad(F.right("left", F.lit(width)), width, " "), F.lit(f" {marks[0]}"), F.col("match"), F.lit(f"{marks[1]} "), F.left("right", F.lit(width)))
    return found.select("first", "last", F.rtrim(line).alias("line"))


def hits(low: Lowering, m: Matches, context: int = 5, offset: int = 0, limit: int | None = 20) -> DataFrame:
    """One JSON record a match: doc_id, match_start, match_end, context, tokens (missing values left out)."""
    m = page(m, offset, limit)
    attrs = low.corpus.meta.attributes
    span = m.df.select("first", "last", low.matched(m).alias("p"))
    token: Column = F.struct("pos", *[F.when(value(a) != "_", value(a)).alias(a) for a in attrs])
    tokens = span.select("first", "last", F.explode("p").alias("pos")).join(low.corpus.tokens, "pos").groupBy("first", "last").agg(F.array_sort(F.collect_list(token)).alias("tokens"), F.min("doc_id").alias("doc_id"))
    around = kwic(low, m, context, context, 0, None).select("first", "last", F.struct("left", "match", "right").alias("context"))
    got = tokens.join(around, ["first", "last"]).orderBy("first", "last")
    return got.select(F.to_json(F.struct("doc_id", F.col("first").alias("match_start"), F.col("last").alias("match_end"), "context", "tokens")).alias("hit"))


def conllu(low: Lowering, m: Matches) -> DataFrame:
    """The sentences of the matches, once each: sent_id and ten-column text with the matched places in a comment."""
    marked = m.df.select(F.explode(low.matched(m)).alias("pos")).distinct().join(low.corpus.tokens.select("pos", "sent_id"), "pos").withColumn("hit", F.lit(True))
    wanted = marked.select("sent_id").distinct()
    rows = low.corpus.tokens.join(wanted, "sent_id", "left_semi").join(marked.select("pos", "hit"), "pos", "left")
    have = lambda c: F.coalesce(value(c), F.lit("_")) if c in low.corpus.meta.attributes else F.lit("_")
    first = F.min("pos")
    sents = rows.groupBy("sent_id").agg(first.alias("start"), F.array_sort(F.collect_list(F.struct("pos", have("form").alias("form"), have("lemma").alias("lemma"), have("upos").alias("upos"), have("xpos").alias("xpos"), have("feats").alias("feats"), F.col("head_pos"), have("deprel").alias("deprel"), "hit"))).alias("t"))
    line = F.transform("t", lambda x: F.concat_ws("\t", (x["pos"] - F.col("start") + 1).cast("string"), x["form"], x["lemma"], x["upos"], x["xpos"], x["feats"], F.coalesce((x["head_pos"] - F.col("start") + 1).cast("string"), F.lit("0")), x["deprel"], F.lit("_"), F.lit("_")))
    places = F.array_join(F.transform(F.filter("t", lambda x: x["hit"]), lambda x: (x["pos"] - F.col("start") + 1).cast("string")), ",")
    text = F.concat(F.lit("# sent_id = "), F.col("sent_id").cast("string"), F.lit("\n# match_tokens = "), places, F.lit("\n"), F.array_join(line, "\n"), F.lit("\n"))
    return sents.select("sent_id", text.alias("conllu")).orderBy("sent_id")


def token_attributes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in CORE and not c.startswith("r_")]
