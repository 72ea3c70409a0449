"""The pipeline's stages, each against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
from quillon.llm import language_id
from quillon.llm.encode import Encoder, default_path

from . import fixtures
from .test_operators import _shingles


def _docs(spark):
    rows = [(d, t, lang, s, len(t)) for d, t, lang, s in fixtures.random_texts(11, 150, length=80)]
    rows += [(9000, "", "en", "a", 0), (9001, "123 !!!", None, "b", 7), (9002, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def _first_of_each_group(texts):
    """The smallest id of each group that links of similarity 0.8 on five words make."""
    sets, root = {d: _shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in texts}


def _targets(source, size):
    """Words of each source by weight, at most three times what it has, the excess shared again."""
    names = sorted({s for s in source.values() if s is not None}) + ([None] if None in source.values() else [])
    have = {s: sum(size[d] for d in source if source[d] == s) for s in names}
    weight, held = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        rest = sum(have.values()) - sum(3 * have[s] for s in held)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in held) for s in names if s not in held}
        over = {s for s in share if share[s] > 3 * have[s]}
        if not over:
            return share | {s: 3 * have[s] for s in held}
        held |= over


def test_stages_one_after_the_other(spark, tmp_path):
    docs = _docs(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), out.collect()
        if name == "language_id":
            assert {9000, 9001, 9002}.isdisjoint(r.doc_id for r in after)
            clean = {r.doc_id for r in before if r.text and language_id.has_letter(r.text)}
            assert {r.doc_id for r in after} == clean
        elif name == "exact_dedup":
            best = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
                best[key] = min(best.get(key, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(best.values())
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in after) == sorted(_first_of_each_group({r.doc_id: r.text for r in before}))
            texts = {r.doc_id: r.text for r in before}
            assert all(r.text == texts[r.doc_id] for r in after)
        elif name == "mixing":
            size = {r.doc_id: len(r.text.encode().split()) for r in before}
            texts = {r.doc_id: r.text.encode().split() for r in before}
            source = {r.doc_id: r.source for r in before}
            got, drawn = Counter(), Counter()
            for r in after:
                taken = r.text.encode().split()
                got[r.doc_id] += len(taken)
                drawn[source[r.doc_id]] += len(taken)
                rest = iter(texts[r.doc_id])
                assert r.n_chars == len(r.text) and all(w in rest for w in taken)  # runs of its words, in order
            assert all(n <= 3 * size[d] for d, n in got.items())
            for name, target in _targets(source, size).items():
                assert abs(drawn[name] - target) <= 0.02 * target + 1
        else:
            enc = Encoder(default_path("byte_bpe_50k.json"), "byte")
            assert sum(r.length for r in after) == sum(len(x) // 4 + 1 for x in enc.encode([r.text for r in before]))
        docs = out
