import io
import json
from types import SimpleNamespace

import numpy as np
import pytest

from quillon import api
from quillon.__main__ import main
from quillon.corpus import Corpus, CorpusError
from quillon.session import Session
from quillon.sources import conllu, cwb_binary, jsonl, ptb, vrt
from quillon.streaming.ingest import ingest, tokens_of

CONLLU = """# newregion text
# text_lang = English
# sent_id = s1
# tuid = t1
1-2\tcan't\t_\t_\t_\t_\t_\t_\t_\t_
1\tca\tcan\tAUX\tMD\tVerbForm=Fin\t3\taux\t_\t_
2\tn't\tnot\tPART\tRB\t_\t3\tadvmod\t_\tGloss=neg
3\tgo\tgo\tVERB\tVB\tNumber=Sing|VerbForm=Inf\t0\troot\t_\t_
3.1\tx\tx\tX\tX\t_\t_\t_\t_\t_

# sent_id = s2
# text_en = They go.
1\tDogs\tdog\tNOUN\tNNS\tNumber=Plur\t2\tnsubj\t_\t_
2\tgo\tgo\tVERB\tVBP\tNumber=Plur\t0\troot\t_\t_

# newregion text
# text_lang = Dutch
# sent_id = s3
# tuid = t1
1\tDe\tde\tDET\t_\t_\t2\tdet\t_\t_
2\thond\thond\tNOUN\t_\t_\t0\troot\t_\t_
"""


def rows(session, program):
    return [tuple(r) for r in session.run(program).collect()]


def size(session, query):
    return rows(session, f"{query}; size")[0][0]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("conllu")
    (path / "a.conllu").write_text(CONLLU)
    (path / "deep").mkdir()
    (path / "deep" / "b.conllu").write_text("1\tEnd\tend\tNOUN\t_\t_\t0\troot\t_\t_\n")
    return conllu.read(spark, str(path))


def test_conllu(corpus):
    assert corpus.meta.size == 8 and corpus.check() == {"size": 0, "positions": 0, "heads": 0, "spans": 0}
    s = Session(corpus)
    assert size(s, '"can\'t"') == 1
    assert size(s, '[lemma="go" & child[deprel="nsubj"]]') == 1
    assert size(s, '[upos="VERB"] > [upos="AUX"]') == 1
    assert size(s, '[feats/Number="Plur"]') == 2
    assert size(s, '[Gloss="neg"]') == 1
    assert rows(s, '[]; count by text_lang') == [("English", 5, 100 * 5 / 7), ("Dutch", 2, 100 * 2 / 7)]
    assert rows(s, '<s sent_id="s2"> a:[]; tabulate a.form, s_text_en') == [("Dogs", "They go.")]
    assert size(s, '[text_lang="English"] with [text_lang="Dutch"]') == 6  # t1: three tokens with two
    assert size(s, 'e:[lemma="go" & text_lang="English"]; n:[upos="NOUN"] :: match.text_lang = "Dutch" & e.s_tuid = n.s_tuid') == 1
    assert rows(s, 'x:[lemma="go"]; y = dep_subtree(x); tabulate y tcnt(y), forms(y)') == [("3", "ca n't go"), ("2", "Dogs go")]


def test_split_feats(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(CONLLU)
    c = conllu.read(spark, str(tmp_path), split_feats=True)
    assert "feats#Number" in c.meta.attributes and size(Session(c), '[feats/Number="Plur"]') == 2


def test_save_open_and_output(corpus, spark, tmp_path):
    saved = corpus.save(f"{tmp_path}/c")
    again = Corpus.open(spark, f"{tmp_path}/c")
    assert again.meta == saved.meta
    s = Session(again)
    m = s.query('[lemma="dog"]')
    from quillon.operators import display

    text = display.conllu(s.lowering(), m).first()["conllu"]
    assert "1\tDogs\tdog\tNOUN\tNNS\tNumber=Plur\t2\tnsubj" in text and "# match_tokens = 1\n" in text
    hit = json.loads(display.hits(s.lowering(), m).first()["hit"])
    assert hit["match_start"] == 3 and hit["tokens"][0]["form"] == "Dogs" and hit["context"]["left"] == "ca n't go"
    assert "<Dogs>" in display.concordance_line(**hit["context"])


def test_vrt(spark, tmp_path):
    (tmp_path / "a.vrt").write_text('<!-- #vrt positional-attributes: word lemma pos -->\n<text lang="en">\n<s id="1">\nThe\tthe\tD\ncats\tcat\tN\n</s>\n<pause/>\n<s id="2">\nRun &amp; go\trun\tV\n</s>\n</text>\n')
    c = vrt.read(spark, str(tmp_path))
    s = Session(c)
    assert c.meta.size == 3 and c.mode("pause") == "zerowidth"
    assert size(s, '[pos="N" & s_id="1" & text_lang="en"]') == 1 and size(s, "[] <pause>") == 1
    assert rows(s, '[lemma="run"]; tabulate form') == [("Run & go",)]


def test_brackets(spark, tmp_path):
    (tmp_path / "a.psd").write_text("( (S (NP-SBJ (DT the) (NN cat)) (VP (VB sees) (NP (NN me)) (NP (-NONE- *T*)))) )")
    c = ptb.read(spark, str(tmp_path))
    s = Session(c)
    assert c.meta.size == 4 and size(s, '<node type="NP">') == 2 or size(s, 'n:<node type="NP">') == 2
    assert size(s, 'a:<node type="VP"> b:<node type="NP"> :: rchild(a, b) = 1') == 1
    assert size(s, 'a:<node type="S"> b:<node type="NP"> :: rcontains(a, b) = 1') == 2


JSONL = [
    {"type": "header", "version": 2, "positional": ["form", "upos"], "multivalue": ["domain"], "token_groups": ["err"], "overlapping": ["mark"], "token_count": 3},
    {"type": "token", "tok_id": "a", "form": "A", "upos": "DET", "head_tok_id": "b", "domain": "x|y"},
    {"type": "token", "tok_id": "b", "form": "B", "upos": "NOUN", "head_tok_id": "c"},
    {"type": "token", "tok_id": "c", "v": ["C", "VERB"]},
    {"type": "region", "struct": "s", "start_pos": 1, "end_pos": 3},
    {"type": "region", "struct": "mark", "start_pos": 0, "end_pos": 1, "attrs": {"k": "1"}},
    {"type": "region", "struct": "mark", "start_pos": 1, "end_pos": 2, "attrs": {"k": "2"}},
    {"type": "region", "struct": "err", "region_id": "g1", "spans": [[0, 0], [2, 9]], "attrs": {"code": "X"}},
    {"type": "region", "struct": "err", "region_id": "g2", "spans": [[7, 8]], "attrs": {"code": "X"}},
]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, JSONL)))
    c = jsonl.read(spark, str(tmp_path))
    s = Session(c)
    assert [tuple(r) for r in c.structs["s"].select("start", "end").collect()] == [(0, 2)]
    assert size(s, '[form="B" & child[upos="DET"]]') == 1 and size(s, '[form="B" & not child[upos="DET"]]') == 0
    assert size(s, '[form="B"] > [upos="DET"]') == 1 and size(s, '[form="C"] >> [form="A"]') == 1
    assert size(s, '[mark_k!="1"]') == 2 and size(s, '[domain="y"]') == 1 and size(s, "[nvals(domain) = 2]") == 1
    assert rows(s, 'e:<err code="X">; count by code') == [("X", 1, 100.0)]
    assert size(s, '[err_code="X"]') == 2
    assert size(s, 'B = [form="B"]; <err> where B') == 0 and size(s, 'B = [form="C"]; <err> where B') == 1
    with pytest.raises(CorpusError):
        s.run("[] within err")


def test_overlay(corpus, spark, tmp_path):
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, [{"type": "header", "token_count": 8, "token_groups": ["mwe"]}, {"type": "region", "struct": "mwe", "region_id": "1", "spans": [[0, 0], [2, 2]], "attrs": {"type": "phrasal"}}])))
    layer = jsonl.read_overlay(spark, str(tmp_path), 8)
    s = Session(corpus.overlay("my_own", layer))
    assert size(s, '<overlay-my-own-mwe type="phrasal">') == 1
    with pytest.raises(CorpusError):
        jsonl.read_overlay(spark, str(tmp_path), 9)


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a b\nc"), (2, "d")], schema).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: ingest(spark.readStream.schema(schema).parquet(str(source)), out, f"{tmp_path}/check").awaitTermination()
    run()
    spark.createDataFrame([(3, "e f")], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    got = [tuple(r) for r in tokens_of(spark, out).orderBy("pos").select("pos", "form", "sent_id", "head_pos").collect()]
    assert got == [(0, "a", 0, None), (1, "b", 0, 0), (2, "c", 1, None), (3, "d", 2, None), (4, "e", 3, None), (5, "f", 3, 4)]


def test_binary_import(spark, tmp_path):
    (tmp_path / "word.lexicon").write_bytes("The\0cat\0été\0".encode())
    (tmp_path / "word.corpus").write_bytes(np.array([0, 1, 2, 1], "<i4").tobytes())
    (tmp_path / "pos.lexicon").write_bytes(b"D\0N\0")
    (tmp_path / "pos.corpus").write_bytes(np.array([0, 1, 1, 1], "<i4").tobytes())
    (tmp_path / "s.avx").write_bytes(np.array([0, 1, 2, 3], "<i4").tobytes())
    s = Session(cwb_binary.read(spark, str(tmp_path), ["word", "pos"], ["s"]))
    assert size(s, '[word="cat" & pos="N"]') == 2 and size(s, "[] [] within s") == 2


def test_json_api(corpus, capsys):
    s = Session(corpus)
    assert json.loads(api.health()) == {"ok": True}
    assert json.loads(api.info(corpus))["size"] == 8
    assert json.loads(api.values(corpus, "upos"))["values"][0] == {"value": "NOUN", "count": 3}
    assert len(json.loads(api.regions(corpus, "text"))["regions"]) == 2
    got = json.loads(api.query(s, '[upos="NOUN"]', limit=1, max_total=2))
    assert (got["total"], got["total_exact"], len(got["hits"])) == (2, False, 1)
    assert json.loads(api.query(s, '[lemma="go"] with [lemma="hond"]'))["hits"][0]["target"] == [6, 6]
    assert json.loads(api.run(s, '[upos="NOUN"]; count by lemma'))["rows"][0]["count"] == 1
    assert not json.loads(api.run(s, "[nothing]"))["ok"]


def test_command_line(corpus, tmp_path, capsys):
    corpus.save(f"{tmp_path}/c")
    main([f"{tmp_path}/c", '[upos="VERB"]; size', "--set", "limit=5"])
    assert capsys.readouterr().out.strip() == "2"


def test_headers_of_many_files(spark):
    """No declaration is lost, however many files have headers."""
    from quillon.sources.events import SCHEMA, assemble

    none = "string(null) AS name, n, 0L AS sent, long(null) AS head, long(null) AS start, long(null) AS end"
    spans = "CAST(null AS array<struct<start:long,end:long>>) AS spans"
    head = spark.range(0, 10_100, 1, 3).selectExpr("format_string('%06d', id) AS path", "'meta' AS kind", "0L AS n", """CASE WHEN id = 10099 THEN map('multivalue', '["domain"]', 'default_within', '"s"') ELSE map('positional', '["form", "domain"]', 'token_count', string(id)) END AS attrs""")
    word = spark.range(1).selectExpr("'010099' AS path", "'token' AS kind", "0L AS n", "map('form', 'x', 'domain', 'a|b') AS attrs")
    rows = head.unionByName(word).selectExpr("path", "kind", *none.replace("string(null)", "CAST(null AS string)").replace("long(null)", "CAST(null AS long)").split(", "), "attrs", spans)
    c = assemble(spark.createDataFrame(rows.rdd, SCHEMA))
    assert c.meta.default_within == "s" and c.meta.multivalue == ("domain",) and c.meta.size == 1


def test_many_group_properties(spark):
    from quillon.corpus import with_group_columns

    tokens = spark.range(1).selectExpr("id AS pos")
    groups = spark.range(1).selectExpr("'1' AS gid", "array(struct(0L AS start, 0L AS end)) AS spans", "map_from_arrays(transform(sequence(1, 1050), k -> format_string('p%04d', k)), transform(sequence(1, 1050), k -> string(k))) AS props")
    got = with_group_columns(tokens, "g", groups)
    assert len(got.columns) == 1 + 1 + 1050 and "g_p1050" in got.columns


def test_events_from_a_stream(spark, tmp_path, capsys, monkeypatch):
    text = "\n".join(json.dumps(e) for e in JSONL[:5]) + "\n"
    monkeypatch.setattr("sys.stdin", SimpleNamespace(buffer=io.BytesIO(text.encode())))
    main([f"{tmp_path}/c", '[upos="NOUN"] > [upos="DET"]; size', "--load", "-"])
    assert capsys.readouterr().out.strip() == "1"


def test_a_file_of_many_splits_and_parts_is_read_in_order(spark, tmp_path):
    lines, forms, texts, first = [], [], [], 0
    for d in range(700):
        lines += ["# newregion text", f"# text_id = t{d}"]
        for k in range(d % 3 + 1):
            lines += [f"# sent_id = {d}-{k}", *[f"{i}\tw{d}.{k}.{i}\tl\tX\t_\t_\t{i // 2}\tdep\t_\t_" for i in range(1, 12)], ""]
            forms += [f"w{d}.{k}.{i}" for i in range(1, 12)]
        texts.append((f"t{d}", first, len(forms) - 1))
        first = len(forms)
    (tmp_path / "a.conllu").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        c = conllu.read(spark, str(tmp_path))
        assert len(forms) > 15_000 and [r.form for r in c.tokens.orderBy("pos").select("form").collect()] == forms
        assert [tuple(r) for r in c.structs["text"].orderBy("start").select("id", "start", "end").collect()] == texts
        assert c.check() == {"size": 0, "positions": 0, "heads": 0, "spans": 0}
        assert c.structs["s"].count() == len(forms) // 11
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
