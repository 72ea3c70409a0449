"""Token ids of whole texts with the tokenizers library, memoised by unit.

Both kinds of tokenizer used here never join tokens across certain places in a text, so a text is
cut there, every distinct unit is encoded once, and the ids of a text are the joined ids of its
units. `byte` (byte-level BPE whose words carry one leading space): a text may be cut before a
space that something other than white space follows. `word` (white space dropped): a text may be
cut at white space. A text is first parted at the tokenizer's added tokens, which the library
takes out of a text wherever they stand; so the ids are those of the library as it comes.
A stretch without any such place (one long word, only white space) goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the memo of one Python worker may take, by estimate; a full memo starts afresh.
MEMO = 112 << 20
#: What an entry takes besides its unit and its ids.
ENTRY = 160
#: Longer units are not kept.
LONGEST = 64

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_DOUBLE_SPACE = re.compile(r"\s (?:\s|\Z)|  ")
_BEFORE_SPACE = re.compile(r"(?= \S)")
#: Letters that every Unicode version in use knows as letters.
_LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: ASCII punctuation but the apostrophe and the underscore.
_POINTS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~")
_ASCII_CUT = re.compile("[ \t\n\r\f\v]+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_units(text: str) -> list[str]:
    return [x for x in _ASCII_CUT.split(text) if x] if _ODD_SPACE.search(text) else text.split()


def byte_units(text: str) -> list[str]:
    if not text:
        return []
    if _DOUBLE_SPACE.search(text) or _ODD_SPACE.search(text):
        return [x for x in _BEFORE_SPACE.split(text) if x]
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


class Encoder:
    """`encode(texts)` gives for each text its ids as little-endian unsigned 32-bit bytes.

    New units are encoded together: plain words are joined, encoded as one text and parted again
    where a token ends a word (`word`) or begins with a space (`byte`); a plain word with a run of
    punctuation behind it is two words of the tokenizer, each known by itself; other units go singly.
    """

    def __init__(self, path: str, kind: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take their surroundings along are not provided for")
        self.added = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        self.part = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.units, self.joint = {"byte": (byte_units, ""), "word": (word_units, " ")}[kind]
        self.plain, self.pointed = (re.compile(p).fullmatch for p in ((f" [{_LATIN}]+", f"( [{_LATIN}]+)([{_POINTS}]+)") if kind == "byte" else (f"[{_LATIN}]+", f"([{_LATIN}]+)([{_POINTS}]+)")))
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.startswith("\u0120") if kind == "byte" else t.endswith("</w>"))]] = True
        self.ends = kind == "word"
        white = r"\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
        tokens = "|".join(re.escape(t) for t in self.added) or "[^\\s\\S]"
        self.odd = f"(?i){tokens}" if kind == "word" else rf"{tokens}|[{white}]|\s (?:\s|$)|  "
        self.most, self.memo, self.held = memo, {"": b""}, 0

    def _single(self, units: list[str]) -> None:
        for k in range(0, len(units), 4096):
            part = units[k : k + 4096]
            for unit, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[unit] = array("I", e.ids).tobytes()

    def _joined(self, units: list[str]) -> None:
        for k in range(0, len(units), 512):
            part = units[k : k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([self.joint.join(part)], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(part):
                self._single(part)
                continue
            cuts = (np.concatenate([[0], edges + 1] if self.ends else [edges, [len(ids)]]) * 4).tolist()
            raw = ids.tobytes()
            self.memo.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:])), strict=True))

    def learn(self, new: set[str]) -> None:
        plain, single, pointed = set(), set(), []
        for unit in new:
            if unit in self.added:
                self.memo[unit] = self.added[unit]
            elif self.plain(unit):
                plain.add(unit)
            elif m := self.pointed(unit):
                pointed.append((unit, *m.groups()))
            else:
                single.add(unit)
        memo = self.memo
        for _, word, points in pointed:
            if word not in memo:
                plain.add(word)
            if points not in memo:
                single.add(points)
        self._joined(list(plain))
        self._single(list(single))
        for unit, word, points in pointed:
            memo[unit] = memo[word] + memo[points]

    def _cut(self, text: str) -> list[str]:
        """The units of a text; an added token is a unit of its own."""
        if self.part is None or not self.part.search(text):
            return self.units(text)
        return [u for k, x in enumerate(self.part.split(text)) for u in ([x] if k % 2 else self.units(x))]

    def known(self, units: list[str]) -> list[bytes]:
        """The ids of units, out of the memo or learned now."""
        if self.held > self.most:
            self.memo, self.held = {"": b""}, 0
        memo = self.memo
        new = {u for u in units if u not in memo}
        if new:
            self.learn(new)
            self.held += ENTRY * len(new) + 2 * sum(map(len, new))
        out = list(map(memo.__getitem__, units))
        for unit in [u for u in new if len(u) > LONGEST]:
            memo.pop(unit, None)
        return out

    def _one(self, text: str) -> bytes:
        units = self._cut(text)
        every = list(set(units))
        return b"".join(map(dict(zip(every, self.known(every), strict=True)).__getitem__, units))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Texts without odd white space or added tokens are cut, and their ids put together, as Arrow arrays."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        even = pc.replace_with_mask(texts, pa.array(np.isin(np.arange(len(texts)), odd)), "") if len(odd) else texts
        if self.ends:
            # these part from the letters before them, and white space is dropped; upper case is folded anyway
            even = pc.replace_substring_regex(pc.ascii_lower(even), r"([a-z])([.,;:!?])(\s|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(even) if self.ends else pc.split_pattern(even, " ")
        ends, pieces = lists.offsets.to_numpy(), lists.values
        coded = pieces.dictionary_encode()
        codes, units = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
        if not self.ends:
            # the first piece of a text has no space before it
            first = pieces.take(pa.array(ends[:-1])).to_pylist()
            codes[ends[:-1]] = len(units) + np.arange(len(first))
            units = [" " + u for u in units] + first
        got = pa.array(self.known(units), pa.large_binary()).take(pa.array(codes))
        at = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
        raw, cuts = memoryview(got.buffers()[2] or b""), at[ends].tolist()
        out = [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
        for k in odd.tolist():
            out[k] = self._one(texts[k].as_py())
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder a worker process: the memo outlives a task."""
    if (path, kind) not in _encoders:
        _encoders.clear()
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def in_chunks(texts: list | pa.Array, most_chars: int = 1 << 21):
    """Slices of `texts` of about `most_chars` characters, so that units of long texts don't pile up."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    start = size = 0
    for k, n in enumerate(sizes):
        size += n
        if size >= most_chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
