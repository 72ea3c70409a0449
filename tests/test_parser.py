import pytest

from quillon.dialects import translate
from quillon.plans.ast import Bool, Leaf, Rel, Subtree
from quillon.plans.parser import QueryError, parse


def one(text, **options):
    (statement,) = parse(text, **options)
    return statement


def test_quoted_values():
    assert one('[form="th.*"]').query.items[0].cond.kind == "whole"
    assert one('[form="the"]').query.items[0].cond.kind == "literal"
    assert one('[form="th.*"]', strict_quoted_strings=True).query.items[0].cond.kind == "literal"
    assert one("[form=/foo/]").query.items[0].cond.kind == "regex"
    assert one('[feats/Number="Sing"]').query.items[0].cond.attr == "feats/Number"
    with pytest.raises(QueryError):
        parse('[form!="th.*"]')


def test_conditions():
    cond = one('[a="1" & (b="2" | not child[c="3"])]').query.items[0].cond
    assert isinstance(cond, Bool) and cond.op == "and"
    assert cond.args[1].args[1] == Rel("child", Leaf("c", "=", "3"), True)
    assert one('[form="x" %dc]').query.items[0].cond.flags == "cd"


def test_repetition_and_labels():
    q = one('a:[]{2,5} b:[]? []* []+ []{3} []{3,}').query
    assert [(t.low, t.high) for t in q.items] == [(2, 5), (0, 1), (0, 100), (1, 100), (3, 3), (3, 100)]
    assert q.items[0].label == "a"
    raw = one('"the"').query.items[0]
    assert (raw.low, raw.high, raw.cond.args[1].attr) == (1, 100, "contr_form")


def test_subtrees_and_anchors():
    q = one('n:[upos="NOUN"] x:dep_subtree(n) :: tcnt(x) > 2').query
    assert q.items[1] == Subtree("x", "n")
    assert one("x = dep_subtree(n) :: tcnt(x) > 2").subtree.source == "n"
    q = one('vp:<node type="VP"> np:<node contains(vp) rchild(vp)> [] </node>').query
    assert q.anchors[1].peers == (("contains", "vp"), ("rchild", "vp")) and q.anchors[2].closing
    assert one('[] < b:[form="x"]').query.items[1].edge == "<"


def test_statements_and_errors():
    got = parse('M = [lemma="book"]; tabulate M 0 10 a.form, text_lang; keyness A vs B by lemma; dcoll a.nsubj:pass, head by form; freq A, B by upos; set min-freq 3; show regions text; drop all')
    assert [s.command.name if s.command else s.name for s in got] == ["M", "tabulate", "keyness", "dcoll", "freq", "set", "show", "drop"]
    assert got[3].command.relations == ("nsubj:pass", "head") and got[3].command.anchor == "a"
    for bad in ("[a=1", '[form="a"] junk junk', "[] :: nothing(a) > 1", "count", '[] >', "[]{3,2}"):
        with pytest.raises(QueryError):
            parse(bad)
    assert len(parse("/a/ /b/")[0].query.items) == 2


def test_cwb():
    p = translate("cwb", '[lemma="a"][lemma="b"]; count by form; group by match lemma; tabulate 0 5 lemma; size; sort by lemma')
    assert len(p[0].query.items) == 2 and p[1].command.fields == ("form",) and p[2].command.fields == ("match.lemma",)
    assert (p[3].command.offset, p[3].command.limit) == (0, 5)
    assert translate("cwb", 'q = [lemma="x"]')[0].name == "q"
    assert translate("cwb", "group by lemma, form")[0].command.fields == ("lemma", "form")
    for bad in ('count [lemma="x"]', '[a="a"] | [b="b"]', '![a="x"]', '[a="x"] ::', "count", "count by lemma.sub", "count by match", "group by match", '[a="x"] within s', "union a b"):
        with pytest.raises(QueryError):
            translate("cwb", bad)


def test_tiger():
    assert translate("tiger", "dom S NP")[0].query.filters
    assert len(translate("tiger", "# a comment\n dom NP VP\ncat S")) == 2
    for bad in ("dom NP", ""):
        with pytest.raises(QueryError):
            translate("tiger", bad)


def test_pmltq():
    p = translate("pmltq", 'a-node $a := [ form = "th.*" and tag = "DT" ] >> distinct $a.form, count(over $a.form)')
    assert p[0].query.items[0].cond.args[1].attr == "xpos" and p[1].command.fields == ("a.form",)
    assert translate("pmltq", 'tok [ form = "x" ]')[0].query.items[0].cond.value == "x"
    for bad in ("[a-node []]", "", "a-node [ form ]"):
        with pytest.raises(QueryError):
            translate("pmltq", bad)
