"""Commands that reduce a set of matches: counts, frequencies, collocations, keyness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import CorpusError, value
from ..functions.measures import association, keyness
from ..functions.text import components
from ..plans.lower import Lowering, Matches


def keyed(low: Lowering, m: Matches, fields: tuple, explode_sets: bool = True) -> tuple[DataFrame, list[str]]:
    """The matches with one column a field; matches without a value are dropped; one set-valued field gives a row a component."""
    cols = []
    for k, name in enumerate(fields):
        m, c = low.field(m, name)
        cols.append(c.alias(f"k{k}"))
    df = m.df.select(*cols)
    names = [f"k{k}" for k in range(len(fields))]
    if explode_sets and len(fields) == 1 and low.is_multivalue(fields[0]):
        df = df.select(F.explode(components(F.col("k0"))).alias("k0"))
    return df.dropna(subset=names), names


def with_total(low: Lowering, m: Matches, fields: tuple, counts: DataFrame, explode_sets: bool = True) -> DataFrame:
    """`counts` with total, the number of matches with a value: the sum of the counts, but where a match counts under several."""
    if explode_sets and len(fields) == 1 and low.is_multivalue(fields[0]):
        total = keyed(low, m, fields, False)[0].agg(F.count(F.lit(1)))
    else:
        total = counts.agg(F.sum("count"))
    return counts.withColumn("total", total.scalar())


def count(low: Lowering, m: Matches, fields: tuple, limit: int | None = 1000, explode_sets: bool = True) -> DataFrame:
    """Fields, count, pct (of all matches with a value), by falling count."""
    df, names = keyed(low, m, fields, explode_sets)
    got = with_total(low, m, fields, df.groupBy(*names).agg(F.count(F.lit(1)).alias("count")), explode_sets)
    got = got.select(*[F.col(n).alias(f) for n, f in zip(names, fields, strict=True)], "count", (100.0 * F.col("count") / F.col("total")).alias("pct"))
    got = got.orderBy(F.desc("count"), *[value(f) for f in fields])
    return got.limit(limit) if limit else got


def hierarchy(low: Lowering, m: Matches, fields: tuple) -> DataFrame:
    """Subtotals of every prefix of the fields: fields (null below the level), level, count, pct, pct_of_parent."""
    df, names = keyed(low, m, fields, False)
    levels = F.lit(len(names)).cast("long") - F.bit_count(F.grouping_id())
    got = df.rollup(*names).agg(F.count(F.lit(1)).alias("count"), levels.alias("level"))
    up = got.select(*[F.col(c).alias(f"p_{c}") for c in (*names, "level", "count")])
    total = up.filter("p_level = 0").select(F.col("p_count").alias("total"))
    joined = got.filter("level > 0").withColumn("up", F.col("level") - 1)
    prefix = lambda p: F.to_json(F.struct(*[F.when(F.col(f"{p}level") > (k + (1 if p == "" else 0)), F.col(f"{p}{n}")).alias(n) for k, n in enumerate(names)]))
    joined = joined.withColumn("prefix", prefix("")).join(up.withColumn("prefix", prefix("p_")).select("prefix", F.col("p_level").alias("up"), "p_count"), ["prefix", "up"]).withColumn("total", total.scalar())
    return joined.select(*[F.col(n).alias(f) for n, f in zip(names, fields, strict=True)], F.col("level").cast("long").alias("level"), "count", (100.0 * F.col("count") / F.col("total")).alias("pct"), (100.0 * F.col("count") / F.col("p_count")).alias("pct_of_parent"))


def frequency(low: Lowering, m: Matches, fields: tuple) -> DataFrame:
    """As count, with ipm; for one region attribute the base is the tokens of regions with that value."""
    df, names = keyed(low, m, fields)
    got = with_total(low, m, fields, df.groupBy(*names).agg(F.count(F.lit(1)).alias("count")))
    size, out = F.lit(low.corpus.meta.size), [F.col(n).alias(f) for n, f in zip(names, fields, strict=True)]
    attr = fields[0].rpartition(".")[2]
    region = low.corpus.region_attribute(attr) if len(fields) == 1 and low.corpus.attribute(attr) is None else None
    pct = (100.0 * F.col("count") / F.col("total")).alias("pct")
    if not region:
        return got.select(*out, "count", pct, (1e6 * F.col("count") / size).alias("ipm"))
    struct, name = region
    sizes = low.corpus.structs[struct].groupBy(value(name).alias("k0")).agg(F.sum(F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))).alias("subcorpus_size"))
    got = got.join(sizes, "k0")
    return got.select(*out, "count", pct, (1e6 * F.col("count") / F.col("subcorpus_size")).alias("ipm"), (100.0 * F.col("count") / F.col("subcorpus_size")).alias("rf_pct"), "subcorpus_size")


def compare_frequencies(low: Lowering, named: dict[str, Matches], fields: tuple) -> DataFrame:
    """One column of counts for each query, by falling sum."""
    parts, names = [], []
    for name, m in named.items():
        df, names = keyed(low, m, fields)
        parts.append(df.withColumn("q", F.lit(name)))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    got = both.groupBy(*names).agg(*[F.sum((F.col("q") == q).cast("long")).alias(q) for q in named])
    total = sum((F.col(q) for q in named), F.lit(0))
    return got.orderBy(F.desc(total), *names).select(*[F.col(n).alias(f) for n, f in zip(names, fields, strict=True)], *named)


def _measured(low: Lowering, window: DataFrame, attr: str, measures: tuple, min_freq: int, limit: int | None) -> DataFrame:
    """From rows of pos (one a co-occurrence): attr, obs, freq and the measures, best first."""
    c = low.conditions.positional(attr)
    if c is None:
        raise CorpusError(f"no token attribute {attr}")
    values = low.corpus.tokens.select("pos", c.alias("v"))
    seen = window.join(values, "pos")
    obs = seen.groupBy("v").agg(F.count(F.lit(1)).alias("obs"))
    size = seen.agg(F.count(F.lit(1)).alias("f"))
    freq = values.groupBy("v").agg(F.count(F.lit(1)).alias("freq"))
    got = obs.filter(F.col("obs") >= min_freq).join(freq, "v").withColumn("f", size.scalar())
    n = F.lit(low.corpus.meta.size)
    got = got.select(F.col("v").alias(attr), "obs", "freq", *[association(x, F.col("obs"), F.col("f"), F.col("freq"), n).alias(x) for x in measures])
    got = got.orderBy(F.desc(measures[0]), F.desc("obs"), value(attr))
    return got.limit(limit) if limit else got


def collocations(low: Lowering, m: Matches, attr: str, left: int = 5, right: int = 5, measures: tuple = ("logdice",), min_freq: int = 5, limit: int | None = 50) -> DataFrame:
    """Tokens within left/right of the extent but outside what is matched; windows may cross any border and overlap."""
    none = F.array().cast("array<bigint>")
    first, last = F.col("first"), F.col("last")
    before = F.when((first > 0) & F.lit(left > 0), F.sequence(F.greatest(first - left, F.lit(0)), first - 1)).otherwise(none)
    after = F.sequence(last + 1, last + right) if right > 0 else none
    window = m.df.select(F.explode(F.array_except(F.concat(before, after), low.matched(m))).alias("pos"))
    return _measured(low, window, attr, measures, min_freq, limit)


def dependency_collocations(low: Lowering, m: Matches, attr: str, relations: tuple = (), anchor: str | None = None, measures: tuple = ("logdice",), min_freq: int = 5, limit: int | None = 50) -> DataFrame:
    """Heads, children, descendants or children of some labels; a token counts once a relation."""
    t = low.corpus.tokens.select("pos", "head_pos", "sent_id", "ein", "eout", *(["deprel"] if "deprel" in low.corpus.meta.attributes else []))
    at = m.df.select((low.position(m, anchor) if anchor else F.col("first")).alias("a_pos"))
    node = at.join(t.select(*[F.col(c).alias(f"a_{c}") for c in ("pos", "head_pos", "sent_id", "ein", "eout")]), "a_pos")
    parts = []
    for rel in relations or ("children",):
        if rel == "head":
            parts.append(node.filter("a_head_pos IS NOT NULL").select(F.col("a_head_pos").alias("pos")))
        elif rel == "descendants":
            parts.append(node.join(t, (F.col("a_sent_id") == F.col("sent_id")) & F.expr("a_ein < ein AND eout < a_eout")).select("pos"))
        else:
            child = node.join(t, F.col("head_pos") == F.col("a_pos"))
            parts.append((child if rel == "children" else child.filter(F.col("deprel") == rel)).select("pos"))
    window = parts[0]
    for part in parts[1:]:
        window = window.unionByName(part)
    return _measured(low, window, attr, measures, min_freq, limit)


def keywords(low: Lowering, m: Matches, attr: str, versus: Matches | None = None, limit: int | None = 50) -> DataFrame:
    """attr, focus, reference, keyness: matched positions against another query's, or against the rest of the corpus."""
    c = low.conditions.positional(attr)
    if c is None:
        raise CorpusError(f"no token attribute {attr}")
    values = low.corpus.tokens.select("pos", c.alias("v"))

    def per(x: Matches, name: str) -> DataFrame:
        if x.held:
            x, own = low.held(x, attr)
            seen = x.df.select(own.alias("v"))
        else:
            seen = low.positions(x).join(values, "pos")
        return seen.groupBy("v").agg(F.count(F.lit(1)).alias(name))

    focus = per(m, "focus")
    if versus is not None:
        both = focus.join(per(versus, "reference"), "v", "full").fillna(0, ["focus", "reference"])
    else:
        both = values.groupBy("v").agg(F.count(F.lit(1)).alias("all")).join(focus, "v", "left").fillna(0, ["focus"]).withColumn("reference", F.greatest(F.col("all") - F.col("focus"), F.lit(0))).drop("all")
    focused, compared = (both.agg(F.sum(c)).scalar() for c in ("focus", "reference"))
    got = both.filter("focus > 0").withColumns({"na": focused, "nb": compared}).select(F.col("v").alias(attr), "focus", "reference", keyness(F.col("focus"), F.col("reference"), F.col("na"), F.col("nb")).alias("keyness"))
    got = got.orderBy(F.desc(F.abs("keyness")), value(attr))
    return got.limit(limit) if limit else got


def values(low: Lowering, name: str, limit: int | None = None) -> DataFrame:
    """value, count: tokens of a token attribute, regions of a region attribute; declared sets are split."""
    attr = low.corpus.attribute(name)
    c: Column | None = low.conditions.positional(name)
    if c is not None:
        df = low.corpus.tokens.select(c.alias("value"))
    else:
        found = low.corpus.region_attribute(name)
        if not found:
            raise CorpusError(f"no attribute {name}")
        df = low.corpus.structs[found[0]].select(value(found[1]).alias("value"))
    if (attr or name) in low.corpus.meta.multivalue:
        df = df.select(F.explode(components(F.col("value"))).alias("value"))
    got = df.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")
    return got.limit(limit) if limit else got
