"""Every operator and stage over the awkward table and the empty one: defined results, no crash."""

from types import SimpleNamespace

import pytest

from quillon.llm import backoff_lm, exact_dedup, host_rules, language_id, minhash, mixing, packing, suffix_dedup, token_orc, warc
from quillon.llm.common import scratch, shared_dir

from . import fixtures

ROWS = 17


def _orc(docs):
    path = scratch(docs.sparkSession, "test-orc")
    token_orc.write_tokens(docs, path)
    return token_orc.with_crc(token_orc.read_tokens(docs.sparkSession, path))


def _mix(docs):
    m = mixing.Mix(docs)
    return m.docs.join(m.taken(), "rid", "left").select("doc_id", "size", "source_size", "target", "taken")


OPERATORS = {
    "language": language_id.identify,
    "exact": exact_dedup.exact_dedup,
    "host": host_rules.host_rules,
    "mixing": _mix,
    "lm": backoff_lm.backoff_scores,
    "suffix": suffix_dedup.suffix_dedup,
    "orc": _orc,
    "minhash": minhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_all_come_back(spark, name):
    assert OPERATORS[name](fixtures.awkward(spark)).count() == ROWS


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](fixtures.empty(spark)).count() == 0


def test_packing_of_awkward_and_empty(spark):
    got = packing.pack(fixtures.awkward(spark)).collect()
    assert sum(r.length for r in got if r.start == 0 and r.doc_id in (1, 2)) == 2  # the end id alone
    assert packing.pack(fixtures.empty(spark)).count() == 0


def test_dropping_stages_keep_columns(spark):
    docs = fixtures.awkward(spark)
    for stage in (exact_dedup.drop_exact_copies, minhash.drop_near_copies, mixing.mixed_documents):
        got = stage(docs)
        assert got.columns == docs.columns and got.count() > 0
        assert stage(fixtures.empty(spark)).count() == 0


def test_exact_ties(spark):
    got = exact_dedup.exact_dedup(fixtures.awkward(spark)).collect()
    twice = [r for r in got if r.doc_id == 11 and r.group_size == 2]
    assert len(twice) == 2 and sum(r.kept for r in twice) == 1
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {1}  # null counts as empty
    none = [r for r in got if r.doc_id is None and r.keep_id is None]
    assert len(none) == 2 and sum(r.kept for r in none) == 1
    assert exact_dedup.drop_exact_copies(fixtures.awkward(spark)).count() == len({r.text_sha256 for r in got})


def test_near_ties(spark):
    got = minhash.drop_near_copies(fixtures.awkward(spark)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 10, 11, 11, 12]
    assert sum(r.doc_id is None for r in got) == 2


def test_language_of_texts_without_letters(spark):
    got = {r.doc_id: r for r in language_id.identify(fixtures.awkward(spark)).collect() if r.doc_id}
    assert [got[k].lang_pred for k in (1, 2, 3, 12)] == ["und"] * 4 and got[1].score == 0.0
    assert got[7].lang_pred != "und" and 0 <= got[7].score <= 1


def test_warc_of_awkward_pages(spark):
    pages = spark.createDataFrame([(3, "http://a/ü b", "x"), (1, None, None), (2, "u\r\nEvil: 1", ""), (None, "u", "x"), (5, "u", "x"), (5, "u", "x"), (6, "", "é" * 5000)], "page_id long, url string, html string")
    path = scratch(spark, "test-warc")
    warc.write_archives(pages, path)
    got = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, path).collect())
    assert got == [
        ("urn:page:1", "response", None, 0),
        ("urn:page:2", "revisit", "urn:page:1", 0),
        ("urn:page:3", "response", None, 1),
        ("urn:page:5", "revisit", "urn:page:3", 1),
        ("urn:page:5", "revisit", "urn:page:3", 1),
        ("urn:page:6", "response", None, 10000),
        ("urn:page:none", "revisit", "urn:page:3", 1),
    ]
    assert warc.read_archives(spark, scratch(spark, "nothing")).count() == 0


def test_what_a_letter_is(spark):
    texts = ["½", "²", "Ⅷ", "\u0301", "_ 7 _", "é", "日", "ʰ", "½a", "a\u0301"]
    docs = fixtures.table(spark, [(k, t, None, "s") for k, t in enumerate(texts)] + [(100 + k, "abc def " * 5, "en", "s") for k in range(20)])
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert [got[k] != "und" for k in range(len(texts))] == [False] * 5 + [True] * 5


def test_the_sample_of_a_language_shrinks_with_their_number(spark):
    docs = fixtures.table(spark, [(k, f"text {k} of a language", f"l{k % 30}", "s") for k in range(3000)])
    some = language_id.labelled_sample(docs, "doc_id", "text", "lang", 400, max_sample=90)
    assert len({r[0] for r in some}) == 30 and len(some) <= 90


def test_the_context_checkpoint_folder_is_used():
    def session(conf, context, master):
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: context))

    assert shared_dir(session({"spark.checkpoint.dir": "hdfs://a/b/"}, None, "yarn")) == "hdfs://a/b"
    assert shared_dir(session({}, "hdfs://c", "yarn")) == "hdfs://c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session({}, None, "yarn"))


def test_tables_between_the_passes_of_operator_8_are_compact(spark):
    """Disk counts while it runs: its texts lie beside the fragments of them."""
    import pathlib
    import random

    from pyspark.sql import functions as F

    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=600))) for k in range(300)], "doc_id long, text string")
    found = suffix_dedup.Repeats(docs)
    there = sum(p.stat().st_size for p in pathlib.Path(found.unique.scratch_path.removeprefix("file:")).rglob("*.parquet"))
    size = found.unique.agg(F.sum(F.octet_length("text"))).first()[0]
    assert found.unique.count() == 300 and there < 0.5 * size, there / size
