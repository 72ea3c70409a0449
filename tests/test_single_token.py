"""Matches of one token bring its attributes along: commands don't join them to tokens again."""

import pytest

from quillon.operators import aggregate
from quillon.session import Session
from quillon.sources.tables import document_corpus


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(k, "\n".join(f"the Tax{k % 3} of considerable {'x' * (j % 12 + 1)}, interest" for j in range(k % 4)), ("en", "fr", None)[k % 3], "x") for k in range(9)]
    return document_corpus(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))


CASES = [
    ('m:[upos="ADP"]', ("feats/Init", "m.upos")),
    ('m:[text_lang="fr"]', ("lemma", "text_lang")),
    ("<s> m:[]", ("tags",)),
    ('m:[upos="VERB"] within s', ("text_lang",)),
    ('m:[] :: m.lemma >= "t"', ("m.s_len", "text_id", "match.word")),
    ('x:<node type="B4"> m:[]', ("node_type",)),
]


@pytest.mark.parametrize(("text", "fields"), CASES)
def test_counts_are_those_of_a_join(corpus, text, fields):
    s = Session(corpus)
    m = s.query(text)
    assert m.held
    joined = m.with_df(m.df.drop(*m.held.values()))
    joined.held = {}
    for command in (aggregate.count, aggregate.frequency):
        own, want = (sorted(map(tuple, command(s.lowering(), x, fields).collect()), key=str) for x in (m, joined))
        assert own == want and (own or command is aggregate.frequency)  # which has no base for values of several regions
    assert not set(s.run(text).columns) & set(m.held.values())


def test_keywords_are_those_of_a_join(corpus):
    s = Session(corpus)
    a, b = s.query('[text_lang="fr"]'), s.query('[text_lang="en"]')
    bare = [x.with_df(x.df) for x in (a, b)]
    for x in bare:
        x.held = {}
    own, want = (aggregate.keywords(s.lowering(), x, "upos", y).collect() for x, y in ((a, b), bare))
    assert own == want and own


@pytest.mark.parametrize(("program", "joins"), [('[upos="ADJ"]; count by lemma', 0), ('[upos="ADJ"]; freq by lemma', 0), ('[upos="ADJ"]; count by lemma, text_lang', 2), ('A = [upos="VERB"]; B = [upos="ADJ"]; freq A, B by text_source', 2)])
def test_no_join_of_matches_to_tokens(corpus, program, joins):
    """Only a region attribute needs a join, to the table of its regions; the total is the sum of the same counts, so its join is there twice."""
    plan = Session(corpus).run(program)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == joins
