"""Queries over a corpus made by hand, and every driver query against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from quillon import queries as q
from quillon.corpus import Corpus, CorpusError
from quillon.session import Session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def session(spark):
    forms = ["The", "old", "dog", "saw", "the", "old", "old", "cat", "été", "x"]
    upos = ["DET", "ADJ", "NOUN", "VERB", "DET", "ADJ", "ADJ", "NOUN", "NOUN", "X"]
    domain = ["Hunting", "Hunting|Fishing", "zebra|apple", "a|a|b", "", "Fishing", "_", "solo", "_", "_"]
    heads = [2, 2, 3, None, 7, 7, 7, 3, None, 8]
    tokens = [(k, k // 8, k // 8, f, u, d, h) for k, (f, u, d, h) in enumerate(zip(forms, upos, domain, heads, strict=True))]
    tokens = spark.createDataFrame(tokens, "pos long, doc_id long, sent_id long, form string, upos string, domain string, head_pos long")
    s = spark.createDataFrame([(0, 0, 7, "1"), (1, 8, 9, "2")], "idx long, start long, end long, id string")
    node = spark.createDataFrame([(0, 0, 7, "S"), (1, 0, 2, "NP"), (2, 3, 7, "VP"), (3, 4, 7, "NP"), (4, 4, 7, "X")], "idx long, start long, end long, type string")
    return Session(Corpus.from_dataframes(tokens, {"s": s, "node": node}, {"node": "nested"}, multivalue=("domain",), kv_pipe=()))


def size(s, text):
    return s.run(f"{text}; size").first()[0]


COUNTS = {
    '[form="the" %c]': 2,
    '[form="ete" %d]': 1,
    '[domain="Hunting"]': 2,
    '[domain="Fishing"]': 2,
    '[domain="solo"]': 1,
    '[domain!="Fishing"]': 8,
    "[nvals(domain) = 2]": 3,
    "[nvals(domain) = 0]": 4,
    '[upos="ADJ"]+': 2,
    '[upos="ADJ"]{2}': 1,
    '[upos="DET"] [upos="ADJ"]* [upos="NOUN"]': 2,
    '[upos="DET"] [upos="ADJ"]{0,1} [upos="NOUN"]': 1,
    '[upos="ADJ"]+ [upos="NOUN"]': 3,
    '[upos="X"]? [upos="VERB"]': 1,
    '[upos="NOUN"] []': 3,
    '[upos="NOUN"] [] within s': 2,
    '[upos="NOUN"] [] not within s': 1,
    '[upos="NOUN"] > [upos="ADJ"]': 3,
    '[upos="VERB"] >> [upos="ADJ"]': 3,
    '[upos="ADJ"] << [upos="VERB"]': 3,
    '[upos="NOUN"] !> [upos="ADJ"]': 1,
    '[upos="ADJ" & sibling[upos="ADJ"]]': 2,
    '[count(child) >= 3]': 1,
    '[upos="NOUN" & ancestor[upos="VERB"]]': 2,
    '[node_type="NP"]': 7,
    '[node_type!="NP"]': 8,
    "<s> []": 2,
    "[] </s>": 2,
    'x:<node type="NP"> [upos="DET"]': 2,
    'n:<node> :: n.type = "NP"': 2,
    'a:<node type="S"> b:<node type="NP"> :: rchild(a, b) = 1': 1,
    'a:<node type="S"> b:<node type="NP"> :: contains(a, b) = 1': 2,
    '[] [] containing node': 0,
    '[] [] [] containing node_type="NP"': 1,
    '[] [] [] containing subtree [upos="NOUN"]': 2,
    '[] [] [] [] containing subtree [upos="NOUN"]': 3,
    '[upos="ADJ"] within s having [form="dog"]': 3,
    'a:[] b:[] :: a.form = b.form': 1,
    'a:[] b:[] :: a.domain = b.domain': 1,
    'a:[form="The"] with b:[form="old"] :: a.domain = b.domain': 1,
    'a:[upos="DET"] []* b:[upos="NOUN"] :: distance(a, b) = 2': 1,
    "a:[] :: strlen(a.form) = 3 & f(a.form) = 3": 3,
    "a:[] :: nchildren(a) = 2 & depth(a) = 1 & ndescendants(a) = 2": 1,
    'a:[upos="NOUN"] x:dep_subtree(a) :: tcnt(x) = 4': 1,
    '[s_id="2"]': 2,
    '[form >= "o" & form < "p"]': 3,
}


@pytest.mark.parametrize("text", COUNTS)
def test_counts(session, text):
    assert size(session, text) == COUNTS[text]


def test_parents_of_ties_are_unknown(session):
    rows = {r.idx: r.parent_idx for r in session.corpus.structs["node"].collect()}
    assert rows == {0: None, 1: 0, 2: 0, 3: 2, 4: 2}


def test_innermost(session):
    session.settings["anchor_binding"] = "innermost"
    assert size(session, 'x:<node> [form="The"]') == 1
    session.settings["anchor_binding"] = "fanout"
    assert size(session, 'x:<node> [form="The"]') == 2


def test_session(session):
    session.run('A = a:[upos="ADJ"]; B = [upos="NOUN"]')
    assert [tuple(r) for r in session.run("count A by a.form").collect()] == [("old", 3, 100.0)]
    assert [tuple(r) for r in session.run("tabulate A 1 1 a.form, s_id, spellout(a,upos)").collect()] == [("old", "1", "ADJ")]
    assert {r.name for r in session.run("show named").collect()} >= {"A", "B", "Last"}
    assert session.count_total(session.named["A"]) == (3, True) and session.count_total(session.named["A"], 2) == (2, False)
    first = [r.s0 for r in session.sample(session.named["A"], 2, 1).df.collect()]
    assert first == [r.s0 for r in session.sample(session.named["A"], 2, 1).df.collect()] and len(first) == 2
    session.run("set window 2; set min-freq 1; set measures mi, ll, t")
    assert session.run("coll B by form").columns == ["form", "obs", "freq", "mi", "ll", "t"]
    assert [tuple(r)[:2] for r in session.run("dcoll B children by form").collect() if r.form == "old"] == [("old", 3)]
    assert session.run("keyness A vs B by form").first().form == "old"
    session.run("drop A")
    for bad in ("count A by form", "set nothing 1", "show nothing", '[nothing="1"]', "[] within nothing", "drop A"):
        with pytest.raises(CorpusError):
            session.run(bad)
    for what in ("settings", "attributes", "regions", "info", "regions node", "values domain"):
        assert session.run(f"show {what}").count() > 0


def test_overlapping_windows_count_each(session):
    session.run("set window 1; set min-freq 1")
    got = {r.form: r.obs for r in session.run('[form="old"]; coll by form').collect()}
    assert got == {"The": 1, "dog": 1, "the": 1, "old": 2, "cat": 1}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(rows):
    rounded = lambda v: round(v, 6) if isinstance(v, float) else tuple(map(rounded, v)) if isinstance(v, list | tuple) else v
    return sorted(repr(tuple(map(rounded, r))) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, text) in q.ALL.items() if text])
def test_driver_queries(spark, oracle, name, capsys):
    run, text = q.ALL[name]
    df, want = run(spark, SF), oracle.sql(text)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    places = [want.columns.index(c) for c in cols]
    assert _key(df.select(*cols).collect()) == _key([tuple(r[k] for k in places) for r in want.fetchall()])
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # readers parse their files in Python tasks, and what they read is not saved here
    assert name.startswith("read_") or not any(x in plan for x in ("EvalPython", "InArrow", "InPandas"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_region_that_is_its_own_ancestor_is_refused(spark):
    tokens = spark.createDataFrame([(0, 0, 0, "a", None), (1, 0, 0, "b", None)], "pos long, doc_id long, sent_id long, form string, head_pos long")
    node = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 1, 0)], "idx long, start long, end long, parent_idx long")
    s = Session(Corpus.from_dataframes(tokens, {"node": node}, {"node": "nested"}))
    with pytest.raises(CorpusError, match="own ancestor"):
        s.run("x:<node> y:<node> :: rcontains(x, y) = 1; size")


@pytest.mark.parametrize("stretch", [2, 3, 5])
def test_neighbours_across_stretches(session, monkeypatch, stretch):
    queries = ("[] []", "[] [] []", "a:[] b:[] []{0,2} c:[]", '[upos="ADJ"]+', '[form!="dog"]+', '[upos="ADJ"]{1,2} [upos="NOUN"]', "[] [] within s", '[] [] > [upos="DET"]')
    places = lambda text: sorted(tuple(r) for r in session.query(text).df.select("first", "last").collect())
    want = [places(text) for text in queries]
    assert want[0] == [(k, k + 1) for k in range(9)] and want[4] == [(0, 1), (3, 9)] and (7, 8) not in want[6]
    monkeypatch.setattr("quillon.plans.lower.STRETCH", stretch)
    assert [places(text) for text in queries] == want


@pytest.mark.parametrize("rel", ["ancestor", "descendant", "parent", "sibling"])
def test_relations_look_only_at_tokens_that_meet_the_rest(session, rel):
    """Of `upos = "NOUN" & ancestor[...]` no other token's ancestors are sought, whatever the order of the parts."""
    from quillon.operators.predicates import Conditions
    from quillon.plans.parser import parse

    seen = []

    class Counting(Conditions):
        def related(self, rel, cond, t):
            seen.append(t.count())
            return super().related(rel, cond, t)

    for text in (f'[upos="NOUN" & {rel}[upos="VERB"]]', f'[{rel}[upos="VERB"] & upos="NOUN"]', f'[upos="NOUN" & (form="x" | not {rel}[upos="VERB"])]'):
        (item,) = parse(text)[0].query.items
        rows = Counting(session.corpus).select(item.cond)
        assert {r.pos for r in rows.collect()} == {r.s0 for r in session.query(text).df.collect()} <= {2, 7, 8}
    assert seen == [3, 3, 3]


def test_any_tokens_between_are_not_joined(session, monkeypatch):
    """Of `a []{m,n} b` only a and b are looked up; what lies between follows from dense positions."""
    from quillon.plans.lower import Lowering

    asked, spans = [], Lowering.spans
    monkeypatch.setattr(Lowering, "spans", lambda self, token, *rest: asked.append(token.cond) or spans(self, token, *rest))
    tokens = {r.pos: r.upos for r in session.corpus.tokens.select("pos", "upos").collect()}
    for low, high in ((0, 2), (1, 4), (4, 5)):
        m = session.query(f'a:[upos="NOUN"] []{{{low},{high}}} b:[upos="NOUN"]')
        want = sorted((a, b) for a in tokens for b in tokens if tokens[a] == tokens[b] == "NOUN" and low <= b - a - 1 <= high)
        assert want and sorted((r["first"], r["last"]) for r in m.df.select("first", "last").collect()) == want
    ends = session.query('[upos="NOUN"] []{1,4}').df.select("first", "last").collect()
    assert sorted(tuple(r) for r in ends) == sorted((a, a + n) for a in tokens if tokens[a] == "NOUN" for n in range(1, 5) if a + n in tokens)
    assert asked and None not in asked
