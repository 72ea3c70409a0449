"""Corpora out of plain tables whose keys are not dense or not small."""

import pathlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import queries as q
from quillon.corpus import Corpus, clocks, with_group_columns, with_parents, with_trees
from quillon.sources.tables import corpus_of, document_corpus, scratch

ALIGNED = ["aligned_pairs", "aligned_condition", "aligned_named"]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A conversation of 5,000 turns beside its neighbours; a turn that is there twice."""
    path = str(tmp_path_factory.mktemp("hot"))
    words = ["the of a", "of the", "The x\nof of", "", "cat"]
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", words[k * 7 % 5]) for k in range(5000)]
    rows += [(8, k, "user" if k % 2 == 0 else "assistant", "the of") for k in range(1000)] + [(6, 0, "user", "the"), (6, 1, "assistant", "of the"), (6, 1, "assistant", "of the")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ALIGNED)
def test_turns_beyond_4096(spark, hot, name):
    run, text = q.ALL[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{hot}/conversations.parquet/*.parquet'")
    want = con.execute(text).fetchall()
    assert [tuple(r) for r in run(spark, hot).collect()] == want


def test_each_turn_is_one_region(spark, hot):
    c = corpus_of(spark, hot, "conversations")
    assert c.check() == {"size": 0, "positions": 0, "heads": 0, "spans": 0}
    s = c.structs["s"]
    assert s.count() == s.select("idx").distinct().count() == 5000 - 1000 + 1000 + 3
    assert [r[0] for r in c.structs["text"].orderBy("start").select("idx").collect()] == [6, 7, 8]


def test_sparse_and_null_ids_lose_no_token(spark):
    docs = spark.createDataFrame([(10**15, "a b", "en", "x"), (None, "c d e", None, None), (None, "f", "en", "y"), (-5, "g h\n\ni", "en", "x"), (3, None, "en", "x")], "doc_id long, text string, lang string, source string")
    c = document_corpus(spark, docs)
    assert c.meta.size == 9 and c.check() == {"size": 0, "positions": 0, "heads": 0, "spans": 0}
    assert sorted(r.form for r in c.tokens.select("form").collect()) == list("abcdefghi")
    assert c.structs["text"].count() == 4 and c.structs["s"].count() == 5


def _clock(pos, head):
    """One sentence by walking its tree."""
    place = {p: k for k, p in enumerate(pos)}
    children = [[] for _ in pos]
    roots = []
    for k, h in enumerate(head):
        (children[place[h]] if h in place and h != pos[k] else roots).append(k)
    out, time = [(None, None, -1, len(c)) for c in children], 0

    def walk(k, depth):
        nonlocal time
        start = time
        time += 1
        for c in children[k]:
            walk(c, depth + 1)
        out[k] = (start, time, depth, len(children[k]))
        time += 1

    for root in roots:
        walk(root, 0)
    return out


def test_clocks_of_random_trees_cycles_and_forests():
    r = random.Random(2)
    sent, pos, head, want = [], [], [], []
    for k in range(400):
        n, base = r.randint(1, 25), 100 * k
        p = sorted(r.sample(range(base, base + 60), n))
        h = [r.choice([*p, -1, base + 77, p[0]]) if r.random() < 0.5 else p[j // 2] for j in range(n)]
        sent += [k] * n
        pos += p
        head += h
        want += _clock(p, h)
    got = list(zip(*clocks(*map(np.array, (sent, pos, head))), strict=True))
    for (a, b, d, c), (x, y, z, w) in zip(got, want, strict=True):
        assert (d, c) == (z, w) and (d < 0 or (a, b) == (x, y))
    assert all(len(x) == 0 for x in clocks(*[np.array([], np.int64)] * 3))


def _files(path):
    return [p for p in pathlib.Path(path).rglob("*.parquet") if p.is_file()]


def test_ingest_leaves_a_small_corpus_and_nothing_beside_it(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, "\n".join(" ".join(r.choices(words, k=r.randint(1, 30))) for _ in range(40)), "en", "x") for k in range(60)], "doc_id long, text string, lang string, source string")
    at = pathlib.Path(scratch(spark))
    before = set(at.iterdir()) if at.exists() else set()
    c = document_corpus(spark, docs)
    (made,) = set(at.iterdir()) - before
    assert [p.name for p in made.iterdir()] == ["corpus"]
    # as plain numbers, positions, heads and the like alone take many times that
    size = sum(p.stat().st_size for p in _files(made / "corpus/tokens"))
    assert size < 9 * c.meta.size, size / c.meta.size
    own, general = (sorted((x.idx, x.parent_idx or -1) for x in df.select("idx", "parent_idx").collect()) for df in (c.structs["node"], with_parents(c.structs["node"].drop("parent_idx"))))
    assert own == general
    pair = with_group_columns(c.tokens.drop("pair_gid", "pair_type"), "pair", c.groups["pair"])
    assert pair.select(*c.tokens.columns).exceptAll(c.tokens).count() == 0


def test_tokens_of_one_text_keep_their_places_over_many_batches(spark):
    text = "\n".join("a\tb  c." if k % 2 else "İX É,\r" for k in range(9000))
    c = document_corpus(spark, spark.createDataFrame([(1, text, "en", "x"), (2, "., |", "en", "x")], "doc_id long, text string, lang string, source string"))
    assert c.check() == {"size": 0, "positions": 0, "heads": 0, "spans": 0} and c.meta.size == 4500 * 5 + 2
    got = c.tokens.orderBy("pos").select("sent_id", "form", "lemma", "upos").collect()
    # of a form that ends in \r the dot or comma before stays, as in the SQL
    assert [tuple(x)[1:] for x in got[:5]] == [("İX", "İx", "DET"), ("É,\r", "É,\r", "ADP"), ("a", "a", "DET"), ("b", "b", "DET"), ("c.", "c", "DET")]
    assert [tuple(x) for x in got[-2:]] == [(9000, ".,", ".,", "PUNCT"), (9000, "|", "|", "PUNCT")]
    assert [x.sent_id for x in got[:-2]] == [k for k in range(9000) for _ in range(3 if k % 2 else 2)]


def test_small_files_of_many_rows_are_not_broadcast_unseen(spark, tmp_path):
    r = random.Random(4)
    spark.createDataFrame([(r.getrandbits(40), 2 * (k % 2), "user" if k % 2 else "assistant", "the of") for k in range(30000)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        c = corpus_of(spark, str(tmp_path), "conversations")
        s = c.structs["s"].select("idx", "tuid")
        plan = c.tokens.join(s, c.tokens["r_s"] == s["idx"])._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_follows_by_rule_takes_no_room_and_is_the_same(spark, tmp_path):
    r = random.Random(5)
    words = [f"{'tax'[: k % 4]}W{k}{'.,' if k % 3 == 0 else ''}" for k in range(300)]
    lengths = [*range(1, 140), 255, 256, 257, 1023, 1024, 1025]
    docs = spark.createDataFrame([(k, " \n\t\n".join(" ".join(r.choices(words, k=n)) for n in lengths), "en", "x") for k in range(5)], "doc_id long, text string, lang string, source string")
    at = pathlib.Path(scratch(spark))
    before = set(at.iterdir()) if at.exists() else set()
    c = document_corpus(spark, docs)
    (made,) = set(at.iterdir()) - before
    size = sum(p.stat().st_size for p in _files(made / "corpus/tokens"))
    assert c.meta.size == 5 * sum(lengths) and size < 4 * c.meta.size, size / c.meta.size
    tree = ["pos", "sent_id", "head_pos", "ein", "eout", "depth", "n_children"]
    walked = with_trees(c.tokens.select("pos", "sent_id", "head_pos"))
    assert c.tokens.select(tree).exceptAll(walked.select(tree)).count() == 0 == walked.select(tree).exceptAll(c.tokens.select(tree)).count()
    again = c.save(str(tmp_path / "again"))
    assert again.tokens.columns == c.tokens.columns and again.meta == c.meta and again.tokens.exceptAll(c.tokens).count() == 0
    # what was changed is stored as it is
    other = Corpus(c.tokens.withColumn("upos", F.lit("X")), c.structs, c.meta, c.groups).save(str(tmp_path / "other"))
    assert other.tokens.filter("upos = 'X'").count() == c.meta.size and not other.meta.rules
