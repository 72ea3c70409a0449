"""The pipeline's first stage rejects what is like no learned language, however many were learned."""

import random

import pytest

import corpus_pipeline
from quillon.llm import language_id

WORDS = {
    "en": "the house with of and which that water would have their there from this light morning something never where another people thought before",
    "fr": "la maison avec de et que leur eau serait être vous dans cette lumière matin quelque jamais où autre toujours pensée avant plusieurs",
    "de": "das haus mit von und welche dass wasser würde haben ihre dort aus diese licht morgen etwas niemals wo andere menschen gedacht zwischen",
    "es": "la casa con de y cual que agua sería haber ellos allí desde esta luz mañana algo nunca donde otra gente pensamiento antes",
}
STRANGE = [
    "Tämä on suomenkielinen lause, jota verkko ei ole koskaan nähnyt, eikä se tunne näitä pitkiä sanoja lainkaan.",
    "Это предложение на русском языке, которого сеть никогда не видела.",
    "x9$#@!!~ ###@@ 00 q^^ %%%% {{]] ;;;=== @@@@ ~~|| z",
    "qzxv kjwq xxzq vvkq zzqx wqkj jjqx zkvq xqzj wwvk",
]


def _text(r, *langs):
    return ". ".join(" ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(3, 30))) for lang in langs)


@pytest.mark.parametrize("langs", [("en",), ("en", "fr"), ("en", "fr", "de", "es")])
def test_unlearned_and_junk_go_and_clean_stays(spark, langs):
    r = random.Random(5)
    rows = [(k, _text(r, langs[k % len(langs)]), langs[k % len(langs)], "a", None) for k in range(240)]
    clean = [(1000 + k, t, None, "a", None) for k, t in enumerate([*[_text(r, lang) for lang in langs for _ in range(20)], *[_text(r, *langs) for _ in range(20)], "The", "water", _text(r, langs[0]).upper()])]
    strange = [(2000 + k, t, None, "a", None) for k, t in enumerate(STRANGE)]
    docs = spark.createDataFrame(rows + clean + strange, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {x.doc_id for x in corpus_pipeline.keep_known_language(spark, docs, "").select("doc_id").collect()}
    assert kept == {x[0] for x in rows + clean}


def test_a_text_in_many_windows_is_like_its_parts():
    r = random.Random(6)
    texts = [(k % 2, k // 2 % 2, _text(r, ("en", "fr")[k % 2]).encode()) for k in range(200)]
    net = language_id.train([t for _, _, t in texts], language_id.np.array([c for c, _, _ in texts]), 2)
    pooler = language_id.Pooler(net, language_id.Likeness(net, texts))
    alone = language_id.Pooler(net)
    some = [_text(r, "en").encode() * 9, b"", b"a", " \n\t ".encode() * 200, STRANGE[0].encode() * 5]
    got = pooler.pooled(some)
    assert (got[:, :-1] == alone.pooled(some)).all() and abs(got[:4, -1]).max() < 4 and got[4, -1] < -4
