"""Driver queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reader_queries
from .corpus import Corpus
from .operators import aggregate, display
from .session import Session
from .sources.tables import corpus_of

#: The tokens of the documents table with their annotation by rule, in SQL.
BASE = r"""
ls AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, k, list_filter(string_split_regex(line, '[ \t]+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM ls)),
sents AS (SELECT doc_id, w, len(w) AS n, row_number() OVER (ORDER BY doc_id, k) - 1 AS sent_id,
                 CAST(sum(len(w)) OVER (ORDER BY doc_id, k) - len(w) AS BIGINT) AS start FROM l WHERE len(w) > 0),
t0 AS (SELECT doc_id, sent_id, n AS sent_n, start, unnest(range(n)) + 1 AS i, unnest(w) AS form FROM sents),
t1 AS (SELECT *, start + i - 1 AS pos, translate(regexp_replace(form, '^[.,|]+|[.,|]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lem FROM t0),
t2 AS (SELECT *, CASE WHEN lem = '' THEN form ELSE lem END AS lemma FROM t1),
t AS (SELECT pos, doc_id, sent_id, sent_n, start, i, form, lemma,
             CASE WHEN regexp_matches(form, '^[.,|]+$') THEN 'PUNCT' WHEN length(lemma) <= 2 THEN 'DET' WHEN length(lemma) <= 4 THEN 'ADP'
                  WHEN length(lemma) <= 7 THEN 'NOUN' WHEN length(lemma) <= 10 THEN 'VERB' ELSE 'ADJ' END AS upos,
             list_filter([CASE WHEN length(lemma) % 2 = 0 THEN 'even' END, CASE WHEN starts_with(lemma, 't') THEN 'tee' END, CASE WHEN length(lemma) % 3 = 0 THEN 'three' END], lambda x: x IS NOT NULL) AS tags,
             CASE WHEN i = 1 THEN 'root' WHEN i % 2 = 0 THEN 'left' ELSE 'right' END AS deprel,
             CASE WHEN i > 1 THEN pos - i + i // 2 END AS head_pos FROM t2),
d AS (SELECT doc_id, lang, source FROM documents),
tot AS (SELECT count(*) AS n FROM t)
"""
#: Every token with each of its strict descendants.
CLOSURE = """
up AS (SELECT pos, head_pos AS anc FROM t WHERE head_pos IS NOT NULL
       UNION ALL SELECT up.pos, t.head_pos FROM up JOIN t ON t.pos = up.anc WHERE t.head_pos IS NOT NULL)
"""
#: The nested structure: sentences, blocks of four and of two tokens.
NODES = """
node AS (SELECT start AS s, start + n - 1 AS e, 'S' AS type FROM sents
         UNION ALL SELECT a, least(a + 3, e), 'B4' FROM (SELECT start + n - 1 AS e, unnest(generate_series(start, start + n - 1, 4)) AS a FROM sents WHERE n > 4)
         UNION ALL SELECT a, least(a + 1, e), 'B2' FROM (SELECT start + n - 1 AS e, unnest(generate_series(start, start + n - 1, 2)) AS a FROM sents WHERE n > 2)),
win AS (SELECT a AS s, least(a + 7, e) AS e, CASE WHEN ((a - start) // 4) % 2 = 0 THEN 'even' ELSE 'odd' END AS k
        FROM (SELECT start, start + n - 1 AS e, unnest(generate_series(start, start + n - 1, 4)) AS a FROM sents))
"""


def sql(body: str, *more: str) -> str:
    recursive = "RECURSIVE " if CLOSURE in more else ""
    return f"WITH {recursive}{','.join((BASE, *more))}\n{body}"


def session(spark: SparkSession, sf_dir: str, table: str = "documents") -> Session:
    return Session(corpus_of(spark, sf_dir, table))


def program(text: str, names: dict[str, str] | None = None, settings: dict | None = None, table: str = "documents", dialect: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The result of the last statement, with columns renamed, doubles rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, table)
        s.settings |= settings or {}
        df = s.run(text, dialect)
        cols = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            cols.append((F.round(c, 6) if f.dataType.simpleString() == "double" else c).alias((names or {}).get(f.name, f.name.replace(".", "_"))))
        return df.select(*cols)

    return run


def size(text: str, settings: dict | None = None, table: str = "documents", dialect: str | None = None, corpus: Callable | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The number of matches and three sums over their places, so that as many matches elsewhere don't pass for them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session(corpus(spark, sf_dir)) if corpus else session(spark, sf_dir, table)
        s.settings |= settings or {}
        s.run(text, dialect)
        return s.named["Last"].df.agg(F.count(F.lit(1)).alias("size"), *[F.coalesce(F.sum(F.expr(c)), F.lit(0)).alias(n) for n, c in PLACES.items()])

    return run


PLACES = {"firsts": "first", "lasts": "last", "mixed": "(first * 31 + last * 17) % 10007"}
N = "CAST(count(*) AS BIGINT)"


def places(frm: str, first: str, last: str) -> str:
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {n}" for n, c in (("firsts", "f"), ("lasts", "l"), ("mixed", "(f * 31 + l * 17) % 10007")))
    return f"SELECT {N} AS size, {sums} FROM (SELECT {first} AS f, {last} AS l FROM {frm})"


def extent(frm: str) -> tuple[str, str]:
    """First and last position of the slots of a FROM clause: t alone, or t under the names a, b, c."""
    names = [f"{x}.pos" for x in re.findall(r"\bt ([abc])\b", frm.partition("WHERE")[0])]
    if not frm.startswith(("t a", "up JOIN")):
        return "t.pos", "t.pos"
    return f"least({', '.join(names)})", f"greatest({', '.join(names)})"


ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], body: str | None, *more: str) -> None:
    ALL[name] = (run, sql(body, *more) if body else None)


def counted(name: str, query: str, frm: str, *more: str, at: tuple[str, str] | None = None, **options) -> None:
    add(name, size(query, **options), places(frm, *(at or extent(frm))), *more)


# --------------------------------------------------------------- predicates
add("count_lemma_by_lang", program('[lemma="the"]; count by text_lang'), f"SELECT lang AS text_lang, {N} AS count, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM t WHERE lemma = 'the'), 6) AS pct FROM t JOIN d USING (doc_id) WHERE lemma = 'the' GROUP BY lang")
counted("pred_any", "[]", "t")
counted("pred_not_equal", '[upos!="NOUN"]', "t WHERE upos <> 'NOUN'")
counted("pred_whole_regex", '[form="th.*n"]', "t WHERE regexp_full_match(form, 'th.*n')")
counted("pred_substring_regex", "[form=/tion/]", "t WHERE regexp_matches(form, 'tion')")
counted("pred_order", '[lemma >= "t" & lemma < "u"]', "t WHERE lemma >= 't' AND lemma < 'u'")
counted("pred_fold_case", '[form="THE" %c]', "t WHERE translate(form, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'the'")
counted("pred_fold_accents", '[lemma="a" %d]', "t WHERE lemma IN ('a', 'à', 'á', 'â', 'ã', 'ä', 'å')")
counted("pred_fold_both", '[form="E" %cd]', "t WHERE form IN ('e', 'E', 'è', 'é', 'ê', 'ë', 'È', 'É', 'Ê', 'Ë')")
counted("pred_multivalue", '[tags="even" & tags!="tee"]', "t WHERE list_contains(tags, 'even') AND NOT list_contains(tags, 'tee')")
counted("pred_feature", '[feats/Init="t" & feats/Len!="3"]', "t WHERE left(lemma, 1) = 't' AND length(lemma) <> 3")
counted("pred_region_flat", '[text_lang="fr" & upos="DET"]', "t JOIN d USING (doc_id) WHERE lang = 'fr' AND upos = 'DET'")
ALL["pred_region_overlapping"] = (size('[win_k!="even"]'), sql(places("(SELECT DISTINCT unnest(generate_series(s, e)) AS pos FROM win WHERE k <> 'even')", "pos", "pos"), NODES))
counted("pred_nvals", "[nvals(tags) = 2]", "t WHERE len(tags) = 2")
counted("pred_or_group", '[(lemma="the" | lemma="of") & s_len >= "5"]', "t WHERE lemma IN ('the', 'of') AND CAST(sent_n AS VARCHAR) >= '5'")
counted("pred_child", '[upos="NOUN" & child[upos="DET"]]', "t WHERE upos = 'NOUN' AND EXISTS (SELECT 1 FROM t c WHERE c.head_pos = t.pos AND c.upos = 'DET')")
counted("pred_not_child", '[upos="NOUN" & not child[upos="DET"]]', "t WHERE upos = 'NOUN' AND NOT EXISTS (SELECT 1 FROM t c WHERE c.head_pos = t.pos AND c.upos = 'DET')")
counted("pred_parent", '[upos="DET" & parent[upos="VERB"]]', "t JOIN t p ON p.pos = t.head_pos WHERE t.upos = 'DET' AND p.upos = 'VERB'")
counted("pred_sibling", '[upos="VERB" & sibling[upos="VERB"]]', "t JOIN t b ON b.head_pos = t.head_pos AND b.pos <> t.pos WHERE t.upos = 'VERB' AND b.upos = 'VERB'")
counted("pred_descendant", '[upos="VERB" & descendant[upos="ADJ"]]', "t WHERE upos = 'VERB' AND pos IN (SELECT anc FROM up JOIN t c ON c.pos = up.pos WHERE c.upos = 'ADJ')", CLOSURE)
counted("pred_ancestor", '[upos="ADJ" & ancestor[upos="ADJ"]]', "t WHERE upos = 'ADJ' AND pos IN (SELECT up.pos FROM up JOIN t a ON a.pos = up.anc WHERE a.upos = 'ADJ')", CLOSURE)
counted("pred_count_children", '[count(child[upos="NOUN"]) >= 2]', "(SELECT head_pos FROM t WHERE upos = 'NOUN' AND head_pos IS NOT NULL GROUP BY head_pos HAVING count(*) >= 2)", at=("head_pos", "head_pos"))
counted("pred_or_relations", '[upos="ADJ" | child[upos="ADJ"]]', "t WHERE upos = 'ADJ' OR pos IN (SELECT head_pos FROM t WHERE upos = 'ADJ')")

# ---------------------------------------------------------------- sequences
RUNS = "r AS (SELECT min(pos) AS s, max(pos) AS e FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM t WHERE upos = 'NOUN') GROUP BY g)"
counted("seq_adjacent", '[upos="DET"] [upos="NOUN"]', "t a JOIN t b ON b.pos = a.pos + 1 WHERE a.upos = 'DET' AND b.upos = 'NOUN'")
counted("seq_adjacent_within", '[upos="DET"] [upos="NOUN"] within s', "t a JOIN t b ON b.pos = a.pos + 1 AND a.sent_id = b.sent_id WHERE a.upos = 'DET' AND b.upos = 'NOUN'")
counted("seq_three", '[upos="DET"] [upos="NOUN"] [upos="VERB"]', "t a JOIN t b ON b.pos = a.pos + 1 JOIN t c ON c.pos = a.pos + 2 WHERE a.upos = 'DET' AND b.upos = 'NOUN' AND c.upos = 'VERB'")
counted("seq_optional", '[upos="VERB"] []? [upos="ADJ"]', "(SELECT a.pos, b.pos AS l FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.upos = 'VERB' AND b.upos = 'ADJ' UNION ALL SELECT a.pos, b.pos FROM t a JOIN t b ON b.pos = a.pos + 2 WHERE a.upos = 'VERB' AND b.upos = 'ADJ')", at=("pos", "l"))
ALL["seq_range"] = (size('[upos="ADJ"] [upos="NOUN"]{1,3} [upos="ADJ"]'), sql(places("(SELECT a.pos, c.pos AS l FROM t a JOIN t b ON b.pos = a.pos + 1 JOIN t c ON c.pos = a.pos + 2 WHERE a.upos = 'ADJ' AND b.upos = 'NOUN' AND c.upos = 'ADJ' UNION ALL SELECT a.pos, c.pos FROM t a JOIN t b ON b.pos = a.pos + 1 JOIN t b2 ON b2.pos = a.pos + 2 JOIN t c ON c.pos = a.pos + 3 WHERE a.upos = 'ADJ' AND b.upos = 'NOUN' AND b2.upos = 'NOUN' AND c.upos = 'ADJ' UNION ALL SELECT a.pos, c.pos FROM t a JOIN t b ON b.pos = a.pos + 1 JOIN t b2 ON b2.pos = a.pos + 2 JOIN t b3 ON b3.pos = a.pos + 3 JOIN t c ON c.pos = a.pos + 4 WHERE a.upos = 'ADJ' AND b.upos = 'NOUN' AND b2.upos = 'NOUN' AND b3.upos = 'NOUN' AND c.upos = 'ADJ')", "pos", "l")))
ALL["seq_maximal_runs"] = (program('Q = r:[upos="NOUN"]+; count Q by tcnt(r)', {"tcnt(r)": "n"}), sql(f"SELECT CAST(least(a + 99, e) - a + 1 AS VARCHAR) AS n, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT e, unnest(generate_series(s, e, 100)) AS a FROM r) GROUP BY 1", RUNS))
counted("seq_tiled_runs", '[upos="NOUN"]{2,3}', "(SELECT a, least(a + 2, e) - a + 1 AS n FROM (SELECT e, unnest(generate_series(s, e, 3)) AS a FROM r)) WHERE n >= 2", RUNS, at=("a", "a + n - 1"))
counted("order_filter", 'a:[upos="VERB"] > b:[upos="NOUN"] :: a > b', "t a JOIN t b ON b.head_pos = a.pos WHERE a.upos = 'VERB' AND b.upos = 'NOUN' AND a.pos > b.pos")
counted("distance_filter", 'a:[upos="ADJ"] []{0,6} b:[upos="ADJ"] :: distance(a, b) <= 4', "t a JOIN t b ON b.pos BETWEEN a.pos + 1 AND a.pos + 4 WHERE a.upos = 'ADJ' AND b.upos = 'ADJ'")
counted("same_lemma", "a:[] b:[] :: a.lemma = b.lemma", "t a JOIN t b ON b.pos = a.pos + 1 WHERE a.lemma = b.lemma")
counted("different_tags", "a:[] b:[] :: a.tags != b.tags", "t a JOIN t b ON b.pos = a.pos + 1 WHERE NOT list_has_any(a.tags, b.tags)")

# -------------------------------------------------------------------- trees
counted("tree_children", '[upos="NOUN"] > [upos="ADJ"]', "t a JOIN t b ON b.head_pos = a.pos WHERE a.upos = 'NOUN' AND b.upos = 'ADJ'")
counted("tree_head", '[upos="ADJ"] < [upos="NOUN"]', "t a JOIN t b ON a.head_pos = b.pos WHERE a.upos = 'ADJ' AND b.upos = 'NOUN'")
counted("tree_descendants", '[upos="VERB"] >> [upos="ADJ"]', "up JOIN t a ON a.pos = up.anc JOIN t b ON b.pos = up.pos WHERE a.upos = 'VERB' AND b.upos = 'ADJ'", CLOSURE)
counted("tree_ancestors", '[upos="ADJ"] << [upos="VERB"]', "up JOIN t a ON a.pos = up.anc JOIN t b ON b.pos = up.pos WHERE a.upos = 'VERB' AND b.upos = 'ADJ'", CLOSURE)
counted("tree_no_child", '[upos="VERB"] !> [upos="NOUN"]', "t a WHERE a.upos = 'VERB' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.head_pos = a.pos AND b.upos = 'NOUN')")
ALL["tree_shape"] = (program('a:[upos="ADJ"] :: nchildren(a) = 2 & depth(a) >= 1 & ndescendants(a) > 2; count by a.deprel'), sql(f"SELECT deprel AS a_deprel, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM t JOIN (SELECT head_pos AS pos, count(*) AS c FROM t GROUP BY 1) USING (pos) JOIN (SELECT anc AS pos, count(*) AS m FROM up GROUP BY 1) USING (pos) WHERE upos = 'ADJ' AND i > 1 AND c = 2 AND m > 2 GROUP BY 1", CLOSURE))
counted("tree_subtree", 'a:[upos="VERB"] x:dep_subtree(a) :: tcnt(x) > 3', "(SELECT anc FROM up JOIN t ON t.pos = up.anc WHERE t.upos = 'VERB' GROUP BY anc HAVING count(*) + 1 > 3)", CLOSURE, at=("anc", "anc"))
counted("tree_subtree_named", 'V = [upos="VERB"]; x = dep_subtree(V) :: tcnt(x) = 3', "(SELECT anc FROM up JOIN t ON t.pos = up.anc WHERE t.upos = 'VERB' GROUP BY anc HAVING count(*) + 1 = 3)", CLOSURE, at=("anc", "anc"))

# ------------------------------------------------------------------ regions
counted("region_start", '<s> [upos="DET"]', "t WHERE i = 1 AND upos = 'DET'")
counted("region_end", '[upos="DET"] </s>', "t WHERE i = sent_n AND upos = 'DET'")
add("region_binding", program('np:<node type="B4"> [upos="DET"]; count by np.type'), f"SELECT type AS np_type, {N} AS count, round(100.0::DOUBLE, 6) AS pct FROM t JOIN node ON node.s = t.pos WHERE type = 'B4' AND upos = 'DET' GROUP BY 1", NODES)
counted("region_only", 'n:<text lang="fr">', "(SELECT doc_id, min(pos) AS f, max(pos) AS l FROM t GROUP BY doc_id) JOIN d USING (doc_id) WHERE lang = 'fr'", at=("f", "l"))
counted("region_filter", 'x:<s> [upos="NOUN"] :: x.s_len = "7"', "t WHERE i = 1 AND upos = 'NOUN' AND sent_n = 7")
ALL["region_children"] = (size('x:<node type="B4"> y:<node type="B2"> :: rchild(x, y) = 1'), sql(places("(SELECT y.s, (y.s - sents.start) // 4 * 4 + sents.start AS xs FROM node y JOIN t ON t.pos = y.s JOIN sents ON sents.sent_id = t.sent_id WHERE y.type = 'B2') q JOIN node x ON x.s = q.xs AND x.type = 'B4' JOIN node y ON y.s = q.s AND y.type = 'B2' WHERE x.e - x.s > y.e - y.s AND y.e <= x.e", "x.s", "x.e"), NODES))
counted("region_zero_width", '[upos="NOUN"] <gap>', "t JOIN sents USING (sent_id) WHERE n >= 6 AND t.i = 3 AND upos = 'NOUN'")
counted("within_nested", '[upos="NOUN"] [upos="VERB"] within node_type="B4"', "t a JOIN t b ON b.pos = a.pos + 1 AND b.sent_id = a.sent_id WHERE a.upos = 'NOUN' AND b.upos = 'VERB' AND a.sent_n > 4 AND (a.i - 1) // 4 = (b.i - 1) // 4")
counted("within_having", '[upos="ADJ"] within s having [lemma="the"]', "t WHERE upos = 'ADJ' AND sent_id IN (SELECT sent_id FROM t WHERE lemma = 'the')")
counted("within_attribute", '[upos="ADJ"] within text_lang="de"', "t JOIN d USING (doc_id) WHERE upos = 'ADJ' AND lang = 'de'")
counted("not_within", '[upos="NOUN"] [upos="NOUN"] not within s', "t a JOIN t b ON b.pos = a.pos + 1 AND b.sent_id <> a.sent_id WHERE a.upos = 'NOUN' AND b.upos = 'NOUN'")
ALL["containing_region"] = (size('[upos="NOUN"] [] [] containing node_type="B2"'), sql(places("(SELECT DISTINCT p FROM (SELECT pos AS p, unnest([pos, pos + 1, pos + 2]) AS q FROM t WHERE upos = 'NOUN') JOIN node ON node.s = q AND node.e <= p + 2 AND type = 'B2' WHERE p + 2 < (SELECT n FROM tot))", "p", "p + 2"), NODES))
counted("containing_subtree", '[] [] [] containing subtree [upos="NOUN"]', "(SELECT DISTINCT p FROM (SELECT pos AS p, unnest([pos, pos + 1, pos + 2]) AS q FROM t WHERE pos + 2 < (SELECT n FROM tot)) JOIN (SELECT t.pos, least(t.pos, coalesce(min(up.pos), t.pos)) AS lo, greatest(t.pos, coalesce(max(up.pos), t.pos)) AS hi FROM t LEFT JOIN up ON up.anc = t.pos WHERE upos = 'NOUN' GROUP BY t.pos) x ON x.pos = q AND lo >= p AND hi <= p + 2)", CLOSURE, at=("p", "p + 2"))
counted("group_query", '<pair type="even">', "sents WHERE n >= 2 AND n % 2 = 0", at=("start", "start + n - 1"))
counted("group_where", 'T = [lemma="the"]; <pair type="even"> where T', "sents WHERE n >= 2 AND n % 2 = 0 AND sent_id IN (SELECT sent_id FROM t WHERE lemma = 'the' AND (i = 1 OR i = sent_n))", at=("start", "start + n - 1"))

# ----------------------------------------------------------------- commands
add("count_two_fields", program('[upos="VERB"]; count by lemma, text_lang', settings={"group_limit": 0}), f"SELECT lemma, lang AS text_lang, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM t JOIN d USING (doc_id) WHERE upos = 'VERB' GROUP BY 1, 2")
add("count_multivalue", program('[upos="VERB"]; count by tags'), f"SELECT tag AS tags, {N} AS count, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM t WHERE upos = 'VERB'), 6) AS pct FROM (SELECT unnest(tags) AS tag FROM t WHERE upos = 'VERB') GROUP BY 1")
add("freq_token", program('[upos="DET"]; freq by lemma'), f"SELECT lemma, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct, round(1e6::DOUBLE * count(*) / (SELECT n FROM tot), 6) AS ipm FROM t WHERE upos = 'DET' GROUP BY 1")
add("freq_region", program('[upos="VERB"]; freq by text_lang'), f"SELECT lang AS text_lang, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct, round(1e6::DOUBLE * count(*) / any_value(m), 6) AS ipm, round(100.0::DOUBLE * count(*) / any_value(m), 6) AS rf_pct, CAST(any_value(m) AS BIGINT) AS subcorpus_size FROM t JOIN d USING (doc_id) JOIN (SELECT lang, count(*) AS m FROM t JOIN d USING (doc_id) GROUP BY 1) USING (lang) WHERE upos = 'VERB' GROUP BY 1")
add("freq_compare", program('A = [upos="VERB"]; B = [upos="ADJ"]; freq A, B by text_source'), "SELECT source AS text_source, CAST(count(*) FILTER (WHERE upos = 'VERB') AS BIGINT) AS A, CAST(count(*) FILTER (WHERE upos = 'ADJ') AS BIGINT) AS B FROM t JOIN d USING (doc_id) WHERE upos IN ('VERB', 'ADJ') GROUP BY 1")


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    m = s.query('[upos="ADJ"]')
    got = aggregate.hierarchy(s.lowering(), m, ("text_lang", "text_source"))
    return got.select("text_lang", "text_source", "level", "count", F.round("pct", 6).alias("pct"), F.round("pct_of_parent", 6).alias("pct_of_parent"))


add("count_hierarchy", _hierarchy, f"SELECT lang AS text_lang, source AS text_source, CAST(2 AS BIGINT) AS level, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS pct_of_parent FROM t JOIN d USING (doc_id) WHERE upos = 'ADJ' GROUP BY 1, 2 UNION ALL SELECT lang, NULL, CAST(1 AS BIGINT), {N}, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6), round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) FROM t JOIN d USING (doc_id) WHERE upos = 'ADJ' GROUP BY 1")
MEASURED = """SELECT lemma, CAST(o AS BIGINT) AS obs, CAST(g AS BIGINT) AS freq,
 round(14 + log2(2.0::DOUBLE * o / (f + g)), 6) AS logdice, round(log2(o / (f * 1.0::DOUBLE * g / n)), 6) AS mi, round(log2(pow(o, 3) / (f * 1.0::DOUBLE * g / n)), 6) AS mi3,
 round((o - f * 1.0::DOUBLE * g / n) / sqrt(o), 6) AS tscore, round(2.0::DOUBLE * o / (f + g), 6) AS dice
FROM (SELECT lemma, count(*) AS o FROM w GROUP BY 1) JOIN (SELECT lemma, count(*) AS g FROM t GROUP BY 1) USING (lemma), (SELECT count(*) AS f FROM w), tot WHERE o >= 5"""
_five = {"measures": "logdice,mi,mi3,tscore,dice", "max_items": 0}
add("coll_window", program('[lemma="the"]; coll by lemma', settings=_five), MEASURED, "w AS (SELECT b.lemma FROM (SELECT pos AS p, unnest(list_filter(range(pos - 5, pos + 6), lambda x: x <> pos)) AS q FROM t WHERE lemma = 'the') JOIN t b ON b.pos = q)")
add("coll_dependency", program('[upos="VERB"]; dcoll head, left by lemma', settings=_five), MEASURED, "w AS (SELECT b.lemma FROM t a JOIN t b ON b.pos = a.head_pos WHERE a.upos = 'VERB' UNION ALL SELECT b.lemma FROM t a JOIN t b ON b.head_pos = a.pos WHERE a.upos = 'VERB' AND b.deprel = 'left')")
add("coll_descendants", program('[upos="ADJ"]; dcoll descendants by lemma', settings=_five), MEASURED, CLOSURE, "w AS (SELECT b.lemma FROM up JOIN t a ON a.pos = up.anc JOIN t b ON b.pos = up.pos WHERE a.upos = 'ADJ')")
LL = "2 * (CASE WHEN a > 0 THEN a * ln(a / (na * (a + b) / (na + nb))) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / (nb * (a + b) / (na + nb))) ELSE 0 END)"
add("keyness_rest", program('[text_lang="fr"]; keyness by lemma', settings={"max_items": 0}), f"SELECT lemma, CAST(a AS BIGINT) AS focus, CAST(b AS BIGINT) AS reference, round(CASE WHEN a / na < b / nb THEN -1 ELSE 1 END * {LL}, 6) AS keyness FROM (SELECT lemma, CAST(count(*) FILTER (WHERE lang = 'fr') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE lang <> 'fr') AS DOUBLE) AS b FROM t JOIN d USING (doc_id) GROUP BY 1), (SELECT CAST(count(*) FILTER (WHERE lang = 'fr') AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE lang <> 'fr') AS DOUBLE) AS nb FROM t JOIN d USING (doc_id)) WHERE a > 0")
add("keyness_versus", program('A = [text_lang="de"]; B = [text_lang="es"]; keyness A vs B by upos', settings={"max_items": 0}), f"SELECT upos, CAST(a AS BIGINT) AS focus, CAST(b AS BIGINT) AS reference, round(CASE WHEN a / na < b / nb THEN -1 ELSE 1 END * {LL}, 6) AS keyness FROM (SELECT upos, CAST(count(*) FILTER (WHERE lang = 'de') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE lang = 'es') AS DOUBLE) AS b FROM t JOIN d USING (doc_id) GROUP BY 1), (SELECT CAST(count(*) FILTER (WHERE lang = 'de') AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE lang = 'es') AS DOUBLE) AS nb FROM t JOIN d USING (doc_id)) WHERE a > 0")
add("tabulate_page", program('a:[upos="ADJ"]; tabulate 10 25 a.form, a.lemma, text_lang, match.upos', {"match.upos": "m_upos"}), "SELECT form AS a_form, lemma AS a_lemma, lang AS text_lang, upos AS m_upos FROM t JOIN d USING (doc_id) WHERE upos = 'ADJ' ORDER BY pos LIMIT 25 OFFSET 10")
add("tabulate_nested", program('[upos="ADJ"]; tabulate 0 50 form, node_type'), "SELECT form, (SELECT string_agg(DISTINCT type, '|' ORDER BY type) FROM node WHERE t.pos BETWEEN s AND e) AS node_type FROM t WHERE upos = 'ADJ' ORDER BY pos LIMIT 50", NODES)
add("show_values", program("show values tags"), f"SELECT tag AS value, {N} AS count FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY 1")
add("show_values_region", program("show values text_source"), f"SELECT source AS value, {N} AS count FROM d WHERE doc_id IN (SELECT doc_id FROM t) GROUP BY 1")
add("raw_matches", program('[lemma="the"] [upos="ADJ"]; raw'), "SELECT a.pos AS first, a.pos + 1 AS last, [a.pos, a.pos + 1] AS positions, [a.form, b.form] AS forms FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.lemma = 'the' AND b.upos = 'ADJ'")
add("kwic", program('[upos="ADJ"]; cat'), "SELECT pos AS first, pos AS last, doc_id AS doc, (SELECT coalesce(string_agg(b.form, ' ' ORDER BY b.pos), '') FROM t b WHERE b.pos BETWEEN p.pos - 5 AND p.pos - 1) AS left, form AS match, (SELECT coalesce(string_agg(b.form, ' ' ORDER BY b.pos), '') FROM t b WHERE b.pos BETWEEN p.pos + 1 AND p.pos + 5) AS right FROM (SELECT * FROM t WHERE upos = 'ADJ' ORDER BY pos LIMIT 20) p")
add("string_functions", size('a:[] :: strlen(a.lemma) = 12 & f(a.lemma) >= 2'), places("t JOIN (SELECT lemma, count(*) AS c FROM t GROUP BY 1) USING (lemma) WHERE length(lemma) = 12 AND c >= 2", "pos", "pos"))
add("nvals_filter", size("a:[] :: nvals(a.tags) > 1"), places("t WHERE len(tags) > 1", "pos", "pos"))

# ---------------------------------------------------------------- alignment
#: Tokens of the conversations table: a text is a conversation, a sentence region a turn.
TALK = r"""
WITH cd AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS d FROM conversations),
cl AS (SELECT d, conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM cd),
cw AS (SELECT *, list_filter(string_split_regex(line, '[ \t]+'), lambda x: x <> '') AS w FROM cl),
c AS (SELECT d, k, conv_id, turn, role, conv_id || '-' || (turn // 2) AS tuid, unnest(w) AS form, unnest(range(len(w))) AS i FROM cw),
t AS (SELECT *, row_number() OVER (ORDER BY d, k, i) - 1 AS pos, translate(regexp_replace(form, '^[.,|]+|[.,|]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lemma FROM c)
"""
ALL["aligned_pairs"] = (size('a:[lemma="the" & s_role="user"] with b:[lemma="the" & s_role="assistant"]', table="conversations"), TALK + places("t a JOIN t b ON a.tuid = b.tuid WHERE a.lemma = 'the' AND b.lemma = 'the' AND a.role = 'user' AND b.role = 'assistant'", "a.pos", "a.pos"))
ALL["aligned_condition"] = (size('a:[lemma="of" & s_role="user"] with b:[lemma="of" & s_role="assistant"] :: a.s_tuid = b.s_tuid & a.form = b.form', table="conversations"), TALK + places("t a JOIN t b ON a.tuid = b.tuid AND a.form = b.form WHERE a.lemma = 'of' AND b.lemma = 'of' AND a.role = 'user' AND b.role = 'assistant'", "a.pos", "a.pos"))
ALL["aligned_named"] = (size('u:[lemma="of" & s_role="user"]; b:[lemma="the"] :: u.s_tuid = b.s_tuid & match.s_role = "assistant"', table="conversations"), TALK + places("t WHERE lemma = 'the' AND role = 'assistant' AND tuid IN (SELECT tuid FROM t WHERE lemma = 'of' AND role = 'user')", "pos", "pos"))

# --------------------------------------------------- variants and functions
counted("pred_negated_regex", '[upos="VERB" & form!=/tion/]', "t WHERE upos = 'VERB' AND NOT regexp_matches(form, 'tion')")
counted("pred_bare_word", '"the"', "(SELECT e, unnest(generate_series(s, e, 100)) AS a FROM r)", RUNS.replace("upos = 'NOUN'", "form = 'the'"), at=("a", "least(a + 99, e)"))
counted("tree_no_head", '[upos="NOUN"] !< [upos="VERB"]', "t a LEFT JOIN t b ON b.pos = a.head_pos AND b.upos = 'VERB' WHERE a.upos = 'NOUN' AND b.pos IS NULL", at=("a.pos", "a.pos"))
counted("not_containing_region", '[upos="NOUN"] [] [] not containing node_type="B2"', "t WHERE upos = 'NOUN' AND pos + 2 < (SELECT n FROM tot) AND pos NOT IN (SELECT p FROM (SELECT pos AS p, unnest([pos, pos + 1, pos + 2]) AS q FROM t WHERE upos = 'NOUN') JOIN node ON node.s = q AND node.e <= p + 2 AND type = 'B2')", NODES, at=("pos", "pos + 2"))
add("region_innermost", program('n:<node> [upos="DET"]; count by n.type', settings={"anchor_binding": "innermost"}), f"SELECT type AS n_type, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT pos, type, row_number() OVER (PARTITION BY pos ORDER BY e - s, CASE type WHEN 'S' THEN 0 WHEN 'B4' THEN 1 ELSE 2 END) AS k FROM t JOIN node ON node.s = t.pos WHERE upos = 'DET') WHERE k = 1 GROUP BY 1", NODES)
add("region_fanout", program('n:<node> [upos="DET"]; count by n.type'), f"SELECT type AS n_type, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM t JOIN node ON node.s = t.pos WHERE upos = 'DET' GROUP BY 1", NODES)
counted("peer_contains", 'x:<node type="B2"> y:<node type="S" contains(x)> []', "sents WHERE n > 2", at=("start", "start"))
counted("peer_rchild", 'x:<node type="S"> [] [] y:<node type="B2" rchild(x)> []', "sents WHERE n IN (3, 4)", at=("start", "start + 2"))
counted("peer_rcontains", 'x:<node type="B2"> y:<node type="S" rcontains(x)> []', "sents WHERE n > 2", at=("start", "start"))
counted("contains_filter", 'x:<node type="B4"> y:<gap> :: contains(x, y) = 1', "sents WHERE n >= 6", at=("start", "start + 3"))
counted("rcontains_filter", 'x:<node type="S"> y:<node type="B2"> :: rcontains(x, y) = 1', "(SELECT start, n, unnest(generate_series(start, start + n - 1, 2)) FROM sents WHERE n > 2)", at=("start", "start + n - 1"))


def _within_by_default(spark: SparkSession, sf_dir: str):
    c = corpus_of(spark, sf_dir)
    return Corpus(c.tokens, c.structs, replace(c.meta, default_within="s"), c.groups)


def _some_texts(spark: SparkSession, sf_dir: str):
    """The tokens of the corpus with the French texts as its only regions."""
    c = corpus_of(spark, sf_dir)
    tokens = c.tokens.drop(*[x for x in c.tokens.columns if x.startswith(("r_", "pair_"))])
    return Corpus.from_dataframes(tokens, {"text": c.structs["text"].filter("lang = 'fr'").drop("parent_idx")}, multivalue=("tags",))


counted("default_within", '[upos="DET"] [upos="NOUN"]', "t a JOIN t b ON b.pos = a.pos + 1 AND a.sent_id = b.sent_id WHERE a.upos = 'DET' AND b.upos = 'NOUN'", corpus=_within_by_default)
add("count_without_region", lambda spark, sf_dir: Session(_some_texts(spark, sf_dir)).run('[upos="ADJ"]; count by text_lang'), f"SELECT lang AS text_lang, {N} AS count, 100.0::DOUBLE AS pct FROM t JOIN d USING (doc_id) WHERE upos = 'ADJ' AND lang = 'fr' GROUP BY 1")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    m = s.query('[upos="ADJ"]')
    return spark.createDataFrame([(str(most), *s.count_total(m, most)) for most in (None, 10)], "most string, total long, exact boolean")


add("count_total", _totals, f"SELECT 'None' AS most, {N} AS total, true AS exact FROM t WHERE upos = 'ADJ' UNION ALL SELECT '10', CAST(least(count(*), 10) AS BIGINT), count(*) <= 10 FROM t WHERE upos = 'ADJ'")
add("sorted_matches", lambda spark, sf_dir: session(spark, sf_dir).run('[upos="ADJ"]; sort by lemma').limit(50).select("first", "last"), "SELECT pos AS first, pos AS last FROM t WHERE upos = 'ADJ' ORDER BY lemma, pos LIMIT 50")
SUBTREES = """
x AS (SELECT a.pos, a.i, a.form, a.lemma, b.form AS bf, b.lemma AS bl, c.form AS cf, c.lemma AS cl FROM t a JOIN t b ON b.head_pos = a.pos AND b.i = 2 * a.i JOIN t c ON c.head_pos = a.pos AND c.i = 2 * a.i + 1 WHERE a.upos = 'ADJ' AND 4 * a.i > a.sent_n)
"""
add("forms_and_spellout", program('V = [upos="ADJ"]; x = dep_subtree(V) :: tcnt(x) = 3; tabulate 0 50 forms(x), spellout(x, lemma)', {"forms(x)": "forms", "spellout(x,lemma)": "lemmas"}), "SELECT form || CASE WHEN i = 1 THEN ' ' ELSE ' ... ' END || bf || ' ' || cf AS forms, lemma || CASE WHEN i = 1 THEN ' ' ELSE ' ... ' END || bl || ' ' || cl AS lemmas FROM x ORDER BY pos LIMIT 50", SUBTREES)
add("tabulate_sets", lambda spark, sf_dir: display.tabulate((s := session(spark, sf_dir)).lowering(), s.query('[upos="ADJ"]'), ("form", "tags"), 0, 50, arrays=True), "SELECT form, list_sort(tags) AS tags FROM t WHERE upos = 'ADJ' ORDER BY pos LIMIT 50")
AROUND = """
k AS (SELECT p.*, (SELECT coalesce(string_agg(b.form, ' ' ORDER BY b.pos), '') FROM t b WHERE b.pos BETWEEN p.pos - 5 AND p.pos - 1) AS lc, (SELECT coalesce(string_agg(b.form, ' ' ORDER BY b.pos), '') FROM t b WHERE b.pos BETWEEN p.pos + 1 AND p.pos + 5) AS rc FROM (SELECT * FROM t WHERE upos = 'ADJ' ORDER BY pos LIMIT 20) p)
"""
add("kwic_lines", lambda spark, sf_dir: display.lines(display.kwic((s := session(spark, sf_dir)).lowering(), s.query('[upos="ADJ"]')), 40), "SELECT pos AS first, pos AS last, rtrim(lpad(right(lc, 40), 40, ' ') || ' <' || form || '> ' || left(rc, 40), ' ') AS line FROM k", AROUND)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    got = display.hits(s.lowering(), s.query('[upos="ADJ"]'))
    kind = "doc_id long, match_start long, match_end long, context struct<left string, match string, right string>, tokens array<struct<pos long, form string, lemma string, tags string>>"
    return got.select(F.from_json("hit", kind).alias("h")).select("h.doc_id", "h.match_start", "h.match_end", "h.context.left", "h.context.match", "h.context.right", F.expr("h.tokens[0].lemma").alias("lemma"), F.coalesce(F.expr("h.tokens[0].tags"), F.lit("")).alias("tags"), F.size("h.tokens").cast("long").alias("n"))


add("json_hits", _hits, "SELECT doc_id, pos AS match_start, pos AS match_end, lc AS left, form AS match, rc AS right, lemma, array_to_string(list_filter([CASE WHEN length(lemma) % 2 = 0 THEN 'even' END, CASE WHEN length(lemma) % 3 = 0 THEN 'three' END, CASE WHEN starts_with(lemma, 't') THEN 'tee' END], lambda x: x IS NOT NULL), '|') AS tags, CAST(1 AS BIGINT) AS n FROM k", AROUND)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, "conversations").run('a:[lemma="of" & s_role="user"] with b:[lemma="the" & s_role="assistant"]').select("a_first", "a_last", "b_first", "b_last")


ALL["pairs"] = (_pairs, f"{TALK} SELECT a.pos AS a_first, a.pos AS a_last, b.pos AS b_first, b.pos AS b_last FROM t a JOIN t b ON a.tuid = b.tuid WHERE a.lemma = 'of' AND b.lemma = 'the' AND a.role = 'user' AND b.role = 'assistant'")
ALL["aligned_multivalue"] = (size('a:[lemma="the" & s_role="user"] with b:[upos="ADP" & s_role="assistant"] :: a.tags = b.tags & a.s_tuid = b.s_tuid', table="conversations"), TALK + places("t a JOIN t b ON a.tuid = b.tuid WHERE a.lemma = 'the' AND a.role = 'user' AND b.role = 'assistant' AND length(b.lemma) IN (3, 4) AND NOT regexp_matches(b.form, '^[.,|]+$') AND (length(b.lemma) = 3 OR starts_with(b.lemma, 't'))", "a.pos", "a.pos"))

# ------------------------------------------------------- dialects, sampling
ALL["dialect_cwb"] = (program('[upos="DET"] [upos="NOUN"]; count by form', dialect="cwb", settings={"group_limit": 0}), sql(f"SELECT a.form, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.upos = 'DET' AND b.upos = 'NOUN' GROUP BY 1"))


def _dialect_size(dialect: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        s.run(text, dialect)
        return s.named["Last"].df.agg(F.count(F.lit(1)).alias("size"), *[F.coalesce(F.sum(F.expr(c)), F.lit(0)).alias(n) for n, c in PLACES.items()])

    return run


ALL["dialect_tiger"] = (_dialect_size("tiger", "cat B4"), sql(places("node WHERE type = 'B4'", "s", "e"), NODES))
ALL["dialect_pmltq"] = (program('a-node $n := [ upos = "ADJ" and lemma = "th.*" ] >> distinct $n.lemma, count(over $n.lemma)', dialect="pmltq", settings={"group_limit": 0}), sql(f"SELECT lemma AS n_lemma, {N} AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM t WHERE upos = 'ADJ' AND regexp_full_match(lemma, 'th.*') GROUP BY 1"))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    return s.sample(s.query('[upos="ADJ"]'), 100, 7).df.select("first")


ALL["sample"] = (_sample, None)


def _sample_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many matches a sample has, how many are different, and how many are matches of the query."""
    every = session(spark, sf_dir).query('[upos="ADJ"]').df.select("first", F.lit(1).alias("there"))
    got = _sample(spark, sf_dir).join(every, "first", "left")
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("first").alias("different"), F.count("there").alias("inside"))


add("sample_facts", _sample_facts, "SELECT CAST(least(100, count(*)) AS BIGINT) AS n, CAST(least(100, count(*)) AS BIGINT) AS different, CAST(least(100, count(*)) AS BIGINT) AS inside FROM t WHERE upos = 'ADJ'")


def _conllu(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    return display.conllu(s.lowering(), s.query('[upos="ADJ"] [upos="ADJ"]'))


PRINTED = """
hit AS (SELECT a.sent_id, a.i FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.upos = 'ADJ' AND b.upos = 'ADJ' UNION SELECT b.sent_id, b.i FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.upos = 'ADJ' AND b.upos = 'ADJ'),
marks AS (SELECT sent_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS m FROM hit GROUP BY 1),
print AS (SELECT sent_id, string_agg(concat_ws(chr(9), i, form, lemma, upos, '_', 'Init=' || left(lemma, 1) || '|Len=' || length(lemma), i // 2, deprel, '_', '_'), chr(10) ORDER BY i) AS rows FROM t GROUP BY 1)
"""
add("conllu_of_matches", _conllu, "SELECT sent_id, '# sent_id = ' || sent_id || chr(10) || '# match_tokens = ' || m || chr(10) || rows || chr(10) AS conllu FROM marks JOIN print USING (sent_id)", PRINTED)


ALL |= reader_queries.queries_with_sql(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text}
