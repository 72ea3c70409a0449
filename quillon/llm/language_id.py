"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on windows of bytes; every position gets a
probability of each language from the two states that meet there, and a document's probabilities
are the mean over all its positions. Texts are read whole: they are cut into windows of `WINDOW`
bytes, many windows of many documents step through the network together, and sums per document
are kept while a long one streams through.

Training takes a bounded sample: of each labelled language at most `per_lang` documents (one of
the smallest hash in each of `per_lang` hash classes) and `SNIPPETS` snippets of each; of all
together at most `max_sample` documents, shared evenly (more languages than that: one document each).

Defined results: null text or text without a letter is `und` with score 0; without any labelled
row everything is `und`; rows with repeated or null ids are judged each (a null id counts as held
out: no remainder is known for it); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, released

WINDOW = 128
HIDDEN = 8
LANES = 1024
SNIPPETS = 3
SNIPPET_CHARS = 96
#: Bytes with upper case, digits and white space folded.
_FOLD = np.array([32 if 9 <= b <= 13 else 48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    """A letter is a character of a Unicode category L: `½`, `²` and `Ⅷ` are none, nor is a combining mark alone."""
    return any(map(str.isalpha, text))


class GatedNet:
    """Two gated recurrent layers, one a direction, and a softmax over both states at each position.

    Arrays have the direction first: `table` (2, 256, 3H) is the input weight row of each byte with
    the bias added; `u` (2, H, 3H) the recurrent weights; `w` (2, H, C) and `b` (C) the output.
    The three blocks are: update gate, reset gate, candidate.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(np.float32)
        self.w = rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, classes)).astype(np.float32)
        self.b = np.zeros(classes, np.float32)

    @property
    def params(self) -> list[np.ndarray]:
        return [self.table, self.u, self.w, self.b]

    def states(self, x: np.ndarray, keep: list | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
        """x: (T, B) bytes. Returns (T, 2, B, H); the second direction's are at their own positions.

        With `sizes`, each lane's second direction begins at its own last byte, so what a lane gives
        does not depend on the lanes beside it; beyond a lane's size the values mean nothing.
        """
        steps, lanes = x.shape
        mirror = None if sizes is None else np.maximum(sizes[None, :] - 1 - np.arange(steps)[:, None], 0)
        y = x[::-1] if mirror is None else x[mirror, np.arange(lanes)]
        hidden = self.u.shape[1]
        h = np.zeros((2, lanes, hidden), np.float32)
        out = np.empty((steps, 2, lanes, hidden), np.float32)
        g = np.empty((2, lanes, 3 * hidden), np.float32)
        for t in range(steps):
            np.take(self.table[0], x[t], axis=0, out=g[0])
            np.take(self.table[1], y[t], axis=0, out=g[1])
            r = np.matmul(h, self.u)
            zr = g[..., : 2 * hidden] + r[..., : 2 * hidden]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, s = zr[..., :hidden], zr[..., hidden:]
            n = s * r[..., 2 * hidden :]
            n += g[..., 2 * hidden :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, s, n, r[..., 2 * hidden :]))
            h = h - n
            h *= z
            h += n
            out[t, 0], out[steps - 1 - t if mirror is None else t, 1] = h[0], h[1]
        if mirror is not None:
            out[:, 1] = out[:, 1][mirror, np.arange(lanes)]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, B, C)"""
        o = np.matmul(states[:, 0], self.w[0])
        o += np.matmul(states[:, 1], self.w[1])
        o += self.b
        o -= o.max(axis=-1, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(axis=-1, keepdims=True)
        return o

    def gradients(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over valid positions and its gradients, by backpropagation through time."""
        steps, lanes = x.shape
        hidden, keep = self.u.shape[1], []
        states = self.states(x, keep)
        p = self.probabilities(states)
        total = max(1.0, float(valid.sum()))
        loss = -float((np.log(p[:, np.arange(lanes), y] + 1e-9) * valid).sum()) / total
        p[:, np.arange(lanes), y] -= 1
        p *= valid[..., None] / total
        flat = p.reshape(-1, p.shape[-1])
        dw = np.stack([states[:, d].reshape(-1, hidden).T @ flat for d in (0, 1)])
        dh_out = np.stack([p @ self.w[0].T, p @ self.w[1].T], axis=1)
        dtable, du = np.zeros_like(self.table), np.zeros_like(self.u)
        dh = np.zeros((2, lanes, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            at = (t, steps - 1 - t)
            dh = dh + np.stack([dh_out[at[0], 0], dh_out[at[1], 1]])
            h, z, s, n, c = keep[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            ds = dn * c * s * (1 - s)
            dg = np.concatenate([dz, ds, dn], axis=-1)
            dr = np.concatenate([dz, ds, dn * s], axis=-1)
            du += np.matmul(h.transpose(0, 2, 1), dr)
            for d in (0, 1):
                np.add.at(dtable[d], x[at[d]], dg[d])
            dh = dh * z + np.matmul(dr, self.u.transpose(0, 2, 1))
        return loss, [dtable, du, dw, flat.sum(axis=0)]


def train(snippets: list[bytes], labels: np.ndarray, classes: int, steps: int = 160, lanes: int = 128, length: int = 64, rate: float = 0.02, seed: int = 7) -> GatedNet:
    """Adam on random cuts of the snippets, each class as often as any other."""
    net, rng = GatedNet(classes, seed=seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in net.params] for _ in range(2))
    of = [np.flatnonzero(labels == c) for c in range(classes)]
    for step in range(1, steps + 1):
        y = rng.integers(0, classes, lanes)
        x, valid = np.full((length, lanes), 32, np.uint8), np.zeros((length, lanes), np.float32)
        for k, c in enumerate(y):
            text = snippets[of[c][rng.integers(len(of[c]))]]
            at = rng.integers(0, max(1, len(text) - length + 1))
            part = np.frombuffer(text[at : at + length], np.uint8)
            x[: len(part), k], valid[: len(part), k] = part, 1
        _, grads = net.gradients(x, valid, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / steps))
        for p, g, m, v in zip(net.params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Likeness:
    """How much like the learned languages a text is, whatever their number.

    A byte's likelihood is a mixture: the network says at each byte how much of which language (half
    the weight is even over all, for places where it errs, as where languages change), and a table per
    language how likely the byte is after the one before it. Upper case, digits and white
    space are folded; the first byte of a window and spaces after spaces do not count. The mean log
    likelihood of a text is compared with what labelled snippets of its languages get from tables that
    were counted without them, in their standard deviations at the largest of SIZES that the text
    reaches (fewer bytes: wider). A language of fewer than `FEW` snippets of a size has no calibration
    there and a deviation of 1, so that it rejects next to nothing; no deviation is below `LEAST`.
    """

    SIZES = (8, 16, 32, 64)
    FEW = 20
    LEAST = 0.2

    def __init__(self, net: GatedNet, snippets: list[tuple[int, int, bytes]]):
        """snippets: (language, half, text); both halves count, and each is calibrated by the other's tables."""
        classes = len(net.b)
        halves = [self._tables([(c, t) for c, h, t in snippets if h == half], classes) for half in (0, 1)]
        self.tables = self._tables([(c, t) for c, _, t in snippets], classes)
        self.mean, self.sd = np.zeros((classes, len(self.SIZES))), np.ones((classes, len(self.SIZES)))
        for k, size in enumerate(self.SIZES):
            got: list[list[float]] = [[] for _ in range(classes)]
            for half in (0, 1):
                some = [(c, t[: size + 1]) for c, h, t in snippets if h == half and len(t) > size]
                if some:
                    x = np.stack([np.frombuffer(t, np.uint8) for _, t in some], axis=1)
                    total, count = self.sums(x, net.probabilities(net.states(x)), halves[1 - half])
                    for (c, _), a, n in zip(some, total, count, strict=True):
                        if n:
                            got[c].append(a / n)
            for c, values in enumerate(got):
                self.mean[c, k] = np.mean(values) if values else np.log(1 / 256)
                self.sd[c, k] = max(np.std(values), self.LEAST) if len(values) >= self.FEW else 1.0

    @staticmethod
    def _tables(texts: list[tuple[int, bytes]], classes: int) -> np.ndarray:
        """(C, 65536): the probability of a byte after another, drawn towards that of the byte alone."""
        pairs = np.zeros((classes, 256 * 256))
        for c, text in texts:
            x = _FOLD[np.frombuffer(text, np.uint8)].astype(np.int32)
            pairs[c] += np.bincount(x[:-1] * 256 + x[1:], minlength=256 * 256)
        pairs = pairs.reshape(classes, 256, 256)
        alone = pairs.sum(axis=1) + 0.5
        alone /= alone.sum(axis=-1, keepdims=True)
        pairs = (pairs + 4 * alone[:, None, :]) / (pairs.sum(axis=-1, keepdims=True) + 4)
        return pairs.reshape(classes, -1).astype(np.float32)

    @staticmethod
    def sums(x: np.ndarray, p: np.ndarray, tables: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x: (T, B) bytes, p: (T, B, C). Log likelihoods and numbers of the bytes that count, by lane."""
        x = _FOLD[x]
        pair = x[:-1].astype(np.int32) * 256 + x[1:]
        mixed = np.full(pair.shape, 1e-9, np.float32)
        for c, table in enumerate(tables):
            mixed += (0.5 * p[1:, :, c] + 0.5 / len(tables)) * table[pair]
        counts = pair != 32 * 256 + 32
        if sizes is not None:
            counts &= np.arange(1, len(x))[:, None] < sizes[None, :]
        return (np.log(mixed) * counts).sum(axis=0), counts.sum(axis=0)

    def deviations(self, pooled: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of each text; 0 without a byte that counts."""
        k = np.maximum(np.searchsorted(self.SIZES, count, side="right") - 1, 0)
        mean, sd = (pooled * self.mean.T[k]).sum(axis=1), (pooled * self.sd.T[k]).sum(axis=1)
        n, sd = np.maximum(count, 1), np.where(count > 0, sd, 1)
        return np.where(count > 0, (total / n - mean) / (sd * np.sqrt(np.maximum(self.SIZES[0] / n, 1))), 0.0)


class Pooler:
    """Sums of position probabilities by document, over windows of many documents at once."""

    def __init__(self, net: GatedNet, likeness: Likeness | None = None):
        self.net, self.classes, self.likeness = net, len(net.b), likeness

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; with a likeness, a last column of deviations."""
        sums = np.zeros((len(texts), self.classes + 2 * bool(self.likeness)))
        windows, owners, sizes, held = [], [], [], 0
        for k, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            for a in range(0, len(data), WINDOW * LANES):
                part = data[a : a + WINDOW * LANES]
                rows = -(-len(part) // WINDOW)
                block = np.full((rows, WINDOW), 32, np.uint8)
                block.reshape(-1)[: len(part)] = part
                size = np.full(rows, WINDOW)
                size[-1] = len(part) - WINDOW * (rows - 1)
                windows.append(block), owners.append(np.full(rows, k)), sizes.append(size)
                held += rows
                if held >= LANES:
                    self._run(windows, owners, sizes, sums)
                    windows, owners, sizes, held = [], [], [], 0
        if held:
            self._run(windows, owners, sizes, sums)
        p = sums[:, : self.classes] / np.maximum(sums[:, : self.classes].sum(axis=1, keepdims=True), 1e-12)
        return np.column_stack([p, self.likeness.deviations(p, sums[:, -2], sums[:, -1])]) if self.likeness else p

    def _run(self, windows: list, owners: list, sizes: list, sums: np.ndarray) -> None:
        block, owner, size = np.concatenate(windows), np.concatenate(owners), np.concatenate(sizes)
        full, rest = np.flatnonzero(size == WINDOW), np.flatnonzero(size < WINDOW)
        rest = rest[np.argsort(-size[rest], kind="stable")]
        for order in (full, rest):
            for a in range(0, len(order), LANES):
                part = order[a : a + LANES]
                longest = int(size[part[0]])
                x = np.ascontiguousarray(block[part, :longest].T)
                p = self.net.probabilities(self.net.states(x, sizes=None if order is full else size[part]))
                like = self.likeness.sums(x, p, self.likeness.tables, size[part]) if self.likeness else ()
                if order is not full:
                    p *= (np.arange(longest)[:, None] < size[part][None, :])[..., None]
                np.add.at(sums, owner[part], np.column_stack([p.sum(axis=0), *like]) if like else p.sum(axis=0))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, max_sample: int = 100_000) -> list:
    """(lang, class, snippets) of at most per_lang documents a language and max_sample in all, in a fixed order."""
    n = F.greatest(F.length("text") - SNIPPET_CHARS, F.lit(1))
    cuts = F.array(*[F.substring(F.col("text"), (F.pmod(F.xxhash64("id", F.lit(k)), n) + 1).cast("int"), F.lit(SNIPPET_CHARS)) for k in range(SNIPPETS)])
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    rows = rows.select("lang", "id", cuts.alias("cuts"), F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(per_lang)).alias("class"), F.xxhash64("id", F.lit(-2)).alias("h"))
    picked = rows.groupBy("lang", "class").agg(F.min_by("cuts", F.struct("h", "id", "cuts")).alias("cuts"))
    picked = materialize(picked, "language-sample")
    most = max(1, max_sample // max(1, picked.select("lang").distinct().count()))
    if most < per_lang:
        picked = picked.groupBy("lang", (F.col("class") % most).alias("class")).agg(F.min_by("cuts", "class").alias("cuts"))
    return sorted((r["lang"], r["class"], r["cuts"]) for r in picked.collect())


def held_out(id_text) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_text.cast("binary")), F.lit(4)) == 2, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400) -> tuple[GatedNet | None, list[str]]:
    return _learn(labelled_sample(docs, id_col, text_col, lang_col, per_lang))


def _learn(sample: list) -> tuple[GatedNet | None, list[str]]:
    pairs = [(lang, cut.encode()) for lang, _, cuts in sample for cut in cuts if has_letter(cut)]
    langs = sorted({lang for lang, _ in pairs})
    if not langs:
        return None, []
    return train([c for _, c in pairs], np.array([langs.index(lang) for lang, _ in pairs]), len(langs)), langs


def fit_with_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400) -> tuple[GatedNet | None, list[str], Likeness | None]:
    """The network of `fit` and the likeness that goes with it, from one sample."""
    sample = labelled_sample(docs, id_col, text_col, lang_col, per_lang)
    net, langs = _learn(sample)
    snippets = [(langs.index(lang), k % 2, cut.encode()) for k, (lang, _, cuts) in enumerate(sample) for cut in cuts if has_letter(cut)]
    return net, langs, net and Likeness(net, snippets)


def predict(docs: DataFrame, net: GatedNet | None, langs: list[str], text_col: str = "text", names_out: tuple[str, ...] = ("lang_pred", "score"), chunk_chars: int = 1 << 20, likeness: Likeness | None = None) -> DataFrame:
    """`docs` with the predicted language and its score appended; columns of these names are replaced.

    With a third name, the text's `Likeness` too (0 for `und`): deviations from labelled texts, far below 0 for unlike ones.
    """
    from .encode import in_chunks

    names, at = docs.columns, docs.columns.index(text_col)
    fields = [f for f in docs.schema.fields if f.name not in names_out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{names_out[0]}` string, " + ", ".join(f"`{c}` double" for c in names_out[1:])
    keep = [k for k, c in enumerate(names) if c not in names_out]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = net and Pooler(net, likeness)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in in_chunks(texts, chunk_chars):
                part = [t or "" for t in texts[a:b]]
                some = [bool(net) and bool(has_letter(t)) for t in part]
                pred, score, like = ["und"] * len(part), [0.0] * len(part), [0.0] * len(part)
                if any(some):
                    p = pooler.pooled([t.encode() for t, s in zip(part, some, strict=True) if s])
                    best = p[:, : len(langs)].argmax(axis=1)
                    for k, row, c in zip([k for k, s in enumerate(some) if s], p, best, strict=True):
                        pred[k], score[k], like[k] = langs[c], float(min(1.0, row[c])), float(row[-1]) if likeness else 0.0
                out = [batch.column(k).slice(a, b - a) for k in keep]
                more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(like, pa.float64())][: len(names_out)]
                yield pa.RecordBatch.from_arrays([*out, *more], names=[*[names[k] for k in keep], *names_out])

    return docs.mapInArrow(released(judge), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs`."""
    net, langs = fit(docs, id_col, text_col, lang_col, per_lang)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col).cast("string")).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, net, langs).drop("text")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
