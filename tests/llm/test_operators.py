"""Operators against brute force, exact round trips, held-out accuracy."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import backoff_lm, exact_dedup, host_rules, language_id, minhash, mixing, packing, suffix_dedup, token_orc, warc
from quillon.llm.common import scratch
from quillon.llm.components import components
from quillon.llm.encode import Encoder, default_path

from . import fixtures

def words(text):
    return text.encode().split()


# ------------------------------------------------------------------ tokens


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_the_library(name, kind):
    library = Tokenizer.from_file(default_path(name))
    enc, r = Encoder(default_path(name), kind, memo=60_000), random.Random(5)
    alphabet = "ab e\u0301'sß.,|<>  \n\t \u2003 \x1c\xa0E1²_-ΣσA日\U0001f642"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    texts += ["", " ", "x ", "  x  y  ", "a \n b", "don't they'll", "<|endoftext|>", None]
    for token in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|"):
        texts += [token, f"a{token}b", f"a {token} b", f"  {token}  ", f"{token}{token} {token}\n", f"one two  {token}three {token} x", f" {token}", f"é {token}'s"]
    texts += ["".join(r.choice(["a", " ", "  ", "\n", "<|endoftext|>", "<|startoftext|>", "b c", "<|", "|>"]) for _ in range(r.randint(1, 12))) for _ in range(1000)]
    want = library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert enc.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in want]


def test_packing_is_an_exact_cover(spark):
    rows = fixtures.random_texts(1, 200, length=400)
    got = packing.pack(fixtures.table(spark, rows), window=256, open_windows=4).collect()
    enc = Encoder(default_path("byte_bpe_50k.json"), "byte")
    for doc_id, text, *_ in rows:
        ids = enc.encode([text])[0] + bytes(4)
        own = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert all(r.doc_tokens * 4 == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length * 4 == len(r.ids) for r in own)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert sum(256 - sum(n for _, n in p) for p in windows.values()) < 0.05 * 256 * len(windows)


def test_orc_round_trip_and_lookup(spark):
    rows = fixtures.random_texts(2, 150, length=200)
    path = scratch(spark, "orc")
    token_orc.write_tokens(fixtures.table(spark, rows), path)
    enc, at = Encoder(default_path("word_bpe_49k.json"), "word"), 0
    got = {r.doc_id: r for r in token_orc.read_tokens(spark, path).collect()}
    sums = {r.doc_id: r for r in token_orc.with_crc(token_orc.read_tokens(spark, path)).collect()}
    for doc_id, text, *_ in sorted(rows):
        ids = enc.encode([text])[0] + (2).to_bytes(4, "little")
        r = got[doc_id]
        assert (r.start, r.n_tokens, np.array(r.ids, "<u4").tobytes()) == (at, len(ids) // 4, ids)
        assert sums[doc_id].ids_crc32 == zlib.crc32(ids)
        at += len(ids) // 4
    some = sorted(got)[3:6]
    assert {r.doc_id for r in token_orc.lookup(spark, path, some).collect()} == set(some)


# ------------------------------------------------------------------- dedup


@pytest.mark.parametrize("bits", [1 << 26, 32768])
def test_exact_dedup(spark, bits):
    rows = fixtures.random_texts(3, 5000 if bits == 32768 else 300, length=6)
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[norm(text)].append(doc_id)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(fixtures.table(spark, rows), filter_bits=bits).collect()}
    for doc_id, text, *_ in rows:
        own, r = groups[norm(text)], got[doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), doc_id == min(own))
        assert r.text_sha256 == hashlib.sha256(norm(text).encode()).hexdigest()
    left = exact_dedup.drop_exact_copies(fixtures.table(spark, rows), filter_bits=bits).collect()
    assert sorted(r.doc_id for r in left) == sorted(min(g) for g in groups.values())


def _shingles(text):
    w = [x.lower() for x in words(text)]
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, block):
    rows = fixtures.random_texts(4, 250, length=50)
    sets = {d: _shingles(t) for d, t, *_ in rows}
    ids, root = sorted(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: r for r in minhash.near_duplicates(fixtures.table(spark, rows), block=block).collect()}
    for d in ids:
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[d]), find(d), find(d) == d)
    left = minhash.drop_near_copies(fixtures.table(spark, rows)).collect()
    assert sorted(r.doc_id for r in left) == [d for d in ids if find(d) == d]


@pytest.mark.parametrize(("members", "few"), [(20_000, 48), (1500, 2)])
def test_one_bucket_of_many_unlinked_members(spark, members, few):
    r = np.random.default_rng(3)
    common, sets = r.integers(1, 2**62, 25), []
    for k in range(members):
        own = sets[k - k % 500].copy() if k % 500 in (1, 2, 3, 4) else np.concatenate([common, r.integers(1, 2**62, 25)])
        own[-2:] = r.integers(1, 2**62, 2)  # 48 of 52: five that are linked among each other
        sets.append(own)
    schema = "cid long, set binary"
    table = spark.createDataFrame([(k, np.sort(x.astype(np.uint64)).tobytes()) for k, x in enumerate(sets)], schema)
    rows = spark.range(members).selectExpr("7L AS key", "id AS cid", "50L AS n", "id AS component")
    groups = {k: {k} for k in range(members)}
    for x in minhash.remaining_links(rows, table, 80, 512, few, blocks=1).collect():
        both = groups[x.a] | groups[x.b]
        groups |= dict.fromkeys(both, both)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(range(k, k + 5)) for k in range(0, members, 500)}


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_of_links_at_the_threshold(spark, percent):
    """Pairs whose similarity is just at the threshold are found, those just below are not."""
    r = random.Random(percent)
    rows, want = [], {}
    for k in range(300):
        n = 200
        w = [f"w{r.randrange(10**9)}" for _ in range(n + 4)]
        # a changed word every 40 places changes 5 shingles; as many as the threshold allows, or one more
        common = -(-2 * percent * n // (100 + percent))
        changes = (n - common) // 5 + (k % 2)
        other = list(w)
        for c in range(changes):
            other[10 + c * 10] = f"x{r.randrange(10**9)}"
        rows += [(2 * k, " ".join(w), "en", "s"), (2 * k + 1, " ".join(other), "en", "s")]
        same = n - 5 * changes
        want[2 * k + 1] = 2 * k if 100 * same >= percent * (2 * n - same) else 2 * k + 1
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(fixtures.table(spark, rows), percent=percent).collect()}
    assert {d: got[d] for d in want} == want and len(set(want.values())) == 300


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 300, 5000):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        s = minhash.sketch(x)
        assert len(s) == minhash.BINS and (s != 0).all()
        assert (s == minhash.sketch(x[::-1])).all()
    base = np.unique(r.integers(0, 2**63, 1000, dtype=np.uint64))
    other = np.concatenate([base[:900], r.integers(0, 2**63, 100, dtype=np.uint64)])
    assert abs((minhash.sketch(base) == minhash.sketch(other)).mean() - 900 / 1100) < 0.12


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def _without_repeats(rows):
    """doc_id: bytes, bytes removed, removed runs, what is left; by brute force over (doc_id, text) in order."""
    seen, want = set(), {}
    for doc_id, text, *_ in rows:
        data = text.encode()
        gone, high = bytearray(len(data)), 0
        for p in range(len(data) - 99):
            string = data[p : p + 100]
            if string in seen:
                low, high = max(p, high), p + 100
                gone[low:high] = b"\1" * (high - low)
            else:
                seen.add(string)
        kept = np.frombuffer(data, np.uint8)[np.frombuffer(gone, np.uint8) == 0].tobytes()
        spans = (b"\0" + bytes(gone)).count(b"\0\1")
        want[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return want


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, hot):
    rows = sorted(fixtures.random_texts(6, 160, length=80))
    want = _without_repeats(rows)
    docs = fixtures.table(spark, rows)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs, hot=hot).collect()}
    for doc_id, (n, removed, spans, sha, _) in want.items():
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, sha)
    left = {r.doc_id: bytes(r.cleaned) for r in suffix_dedup.cleaned(docs, hot=hot).collect()}
    assert {d: c for d, c in left.items()} == {d: w[4] for d, w in want.items() if d in left}
    assert all(not w[4] for d, w in want.items() if d not in left)


def test_suffix_dedup_of_long_low_entropy_texts(spark):
    r = random.Random(12)
    line = "a line of some forty bytes, over and over\n"
    noise = "".join(r.choice("abcdefghij ") for _ in range(30_000))
    border = (4 << 20) - len(noise) - 70  # a passage that is cut between two pieces of its text
    texts = ["a" * 300_000, "ab" * 90_000, "a" * 150, "xyz " * 30_000, line * 3000 + noise, noise[:5000] + line * 7, "b" * 130, noise + "a" * border + noise[200:900] + "q" * 300_000, "a" * 99, "", "c" * 9_000_000]
    rows = [(k, t, None, "s") for k, t in enumerate(texts)]
    got = {x.doc_id: x for x in suffix_dedup.suffix_dedup(fixtures.table(spark, rows)).collect()}
    for doc_id, (n, removed, spans, sha, _) in _without_repeats(rows).items():
        x = got[doc_id]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (n, removed, spans, sha), doc_id


def test_longest_previous_factors():
    r = random.Random(1)
    for t in range(30):
        data = np.array([r.choice([97, 98]) if t % 2 else 97 for _ in range(r.randint(120, 500))], np.uint8)
        data = np.tile(data[: r.randint(1, 60)], 12) if t % 3 == 0 else data
        raw, starts = bytes(data), np.arange(max(0, len(data) - 99))
        got = suffix_dedup.longest_previous_factors(data, starts) if len(starts) else []
        for i in range(0, len(starts), 5):
            same = lambda j: next((k for k in range(100) if raw[i + k] != raw[j + k]), 100)  # noqa: B023, E731
            assert got[i] == max(map(same, range(i)), default=0)


# ------------------------------------------------------------------ others


def test_backoff_scores(spark):
    for order in (1, 2, 3):
        rows = fixtures.random_texts(7, 60)
        docs = {d: [w.lower() for w in words(t)] for d, t, *_ in rows}
        grams = lambda w: Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
        every = sum((grams(w) for w in docs.values()), Counter())
        size = sum(map(len, docs.values()))
        got = {r.doc_id: r for r in backoff_lm.backoff_scores(fixtures.table(spark, rows), order=order).collect()}
        for d, w in docs.items():
            own, rest, total = grams(w), size - len(w), 0.0
            count = lambda g: every[g] - own[g]  # noqa: B023, E731
            for k in range(len(w)):
                c = count((w[k],))
                s = c / rest if c else 1 / (rest + 1)
                for n in range(2, min(order, k + 1) + 1):
                    g = tuple(w[k - n + 1 : k + 1])
                    s = count(g) / count(g[:-1]) if count(g) else 0.4 * s
                total += math.log(s)
            assert got[d].n_words == len(w)
            assert got[d].score is None if not w else got[d].score == pytest.approx(total / len(w))


def test_targets(spark):
    for sizes, want in (([100, 100, 100], [187.5, 75.0, 37.5]), ([10, 1000], [30, 980]), ([0, 50], [0, 50]), ([0, 0], [0, 0])):
        rows = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, size long")
        got = mixing.source_table(rows).orderBy("source_index").collect()
        assert [r.target for r in got] == pytest.approx(want) and sum(r.target for r in got) == pytest.approx(sum(sizes))


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_many_small_sources_come_near_their_targets(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(50)), "en", f"s{k % 300:03}") for k in range(600)] + [(1000 + k, "a b " * 500, "en", None) for k in range(3)]
    got = mixing.Mix(fixtures.table(spark, rows))
    out = got.docs.join(got.taken(), "rid", "left").fillna(0, ["taken"]).groupBy("source").agg(*[f(c).alias(c) for f, c in ((mixing.F.sum, "taken"), (mixing.F.max, "target"), (mixing.F.max, "source_size"))]).collect()
    assert len(out) == 301 and all(abs(r.taken - r.target) <= 1 + 0.02 * r.target for r in out)


def test_mixing(spark):
    rows = fixtures.random_texts(8, 400, length=300)
    docs = fixtures.table(spark, rows)
    runs = []
    for _ in range(2):
        m = mixing.Mix(docs, block=16, slots=64)
        got = {r.doc_id: r for r in m.docs.join(m.taken(), "rid", "left").fillna(0, ["taken"]).collect()}
        runs.append({d: r.taken for d, r in got.items()})
    taken = runs[0]
    assert taken == runs[1]
    assert all(r.taken <= 3 * r.size for r in got.values())
    for source in "ab":
        own = [got[d] for d, _, _, s in rows if s == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)
    table = mixing.mixed_documents(docs, chars_col=None, block=16, slots=64)
    out = Counter()
    for r in table.collect():
        out[r.doc_id] += len(words(r.text))
    assert {d: n for d, n in taken.items() if n} == dict(out)


def test_host_rules_reject_a_bad_host(spark):
    good, bad = " ".join(f"word{k}" for k in range(60)), "too short"
    rows = [(k, good, "en", "fine") for k in range(200)] + [(1000 + k, bad, "en", "bad") for k in range(60)] + [(2000, good, "en", "bad"), (2001, "a b c " * 30, "en", "fine")]
    got = {r.doc_id: r for r in host_rules.host_rules(fixtures.table(spark, rows)).collect()}
    assert got[0].kept and not got[1000].kept
    assert not got[2000].base_failed and not got[2000].kept  # its host fails
    assert got[2001].base_failed and got[2001].n_repeat_words == 90


def test_host_counts(spark):
    text = "a b c d\nx #1\n\n a b c d\nx #1\n \na b"
    r = host_rules.host_rules(fixtures.table(spark, [(1, text, "en", "s")])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (14, 16, 2, 1)
    w = text.split()
    twice = Counter(zip(w, w[1:], w[2:], strict=False))
    assert r.n_repeat_words == len({k + j for k in range(len(w) - 2) if twice[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_language_id_held_out_accuracy(spark):
    r = random.Random(3)
    letters = {"xx": "abcdefgh ", "yy": "klmnopqé ", "zz": "abcklmß "}
    rows = [(k, "".join(r.choice(letters[lang]) for _ in range(r.randint(20, 400))), lang, "s") for k in range(300) for lang in [r.choice(list(letters))]]
    got = {x.doc_id: x for x in language_id.identify(fixtures.table(spark, rows), per_lang=60).collect()}
    for k, *_ in rows:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    held = [(got[k].lang_pred, lang) for k, _, lang, _ in rows if got[k].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_gradients_are_right():
    net = language_id.GatedNet(3, hidden=3, seed=1)
    rng = np.random.default_rng(2)
    x, y, valid = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((7, 4), np.float32)
    valid[5:, 2] = 0
    _, grads = net.gradients(x, valid, y)
    for p, g in zip(net.params, grads, strict=True):
        for _ in range(6):
            k = tuple(rng.integers(0, s) for s in p.shape) if p is not net.table else (rng.integers(0, 2), x[rng.integers(0, 5), 0], rng.integers(0, 9))
            old, step = p[k], 1e-2
            p[k] = old + step
            up = net.gradients(x, valid, y)[0]
            p[k] = old - step
            down = net.gradients(x, valid, y)[0]
            p[k] = old
            assert g[k] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_windows_pool_whole_texts():
    net = language_id.GatedNet(2, hidden=4)
    texts = [b"a" * 5, b"", b"xyz" * 1000, bytes(range(256)) * 3]
    got = language_id.Pooler(net).pooled(texts)
    for text, p in zip(texts, got, strict=True):
        sums = sum((net.probabilities(net.states(np.frombuffer(text[a : a + 128], np.uint8)[:, None]))[:, 0].sum(axis=0) for a in range(0, len(text), 128)), np.zeros(2))
        assert p == pytest.approx(sums / max(sums.sum(), 1e-12), abs=1e-5)


def test_warc_ranges_own_each_record_once():
    r = random.Random(9)
    members, starts, data = [], [], b""
    for k in range(60):
        payload = bytes(r.randrange(256) for _ in range(r.randint(0, 300))) + warc.MAGIC * r.randint(0, 2)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        members.append(payload)
        starts.append(len(data))
        data += warc.record("response", f"urn:page:{k}", "http://x/", "1970-01-01T00:00:00Z", payload, digest, len(payload))
    for step in (1, 17, 100, 999, 10**6):
        got = [x for a in range(0, len(data), step) for x in warc.records_in(io.BytesIO(data), len(data), a, min(len(data), a + step))]
        assert [x[0] for x in got] == starts
        assert [x[2].partition(b"\r\n\r\n")[2] for x in got] == members
    assert list(warc.records_in(io.BytesIO(b"junk" * 50), 200, 0, 200)) == []
