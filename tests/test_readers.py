import gzip

import numpy as np
import pyarrow as pa
import pytest

from quillon.sources import conllu, cwb_binary, jsonl, ptb, vrt
from quillon.sources.events import Builder
from tests.test_sources import CONLLU

VRT = '<text id="a">\n<s>\nx\ty\tN\nz\tz\tN\nu\tu\tN\n</s>\n<pause/>\n<s>\nv\tv\tN\n</s>\n</text>\nw\tw\tN\n'
JSONL = "\n".join(['{"type": "region_start", "struct": "text"}', '{"type": "token", "form": "a", "tok_id": "1", "head_tok_id": "2"}', '{"type": "token", "form": "b", "tok_id": "2"}', '{"type": "region", "struct": "s"}', '{"type": "token", "form": "c"}', '{"type": "region_end", "struct": "text"}'])


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize(("read", "name", "text"), [(conllu.read, "a.conllu.gz", CONLLU), (vrt.read, "a.vrt.gz", VRT), (jsonl.read, "a.jsonl.gz", JSONL), (ptb.read, "a.psd.gz", "(S (NP (DT the) (NN cat)) (VP (VB sees)))")])
def test_tokens_are_neither_kept_nor_shuffled(spark, tmp_path, capsys, read, name, text):
    (tmp_path / name).write_bytes(gzip.compress(text.encode()))
    c = read(spark, str(tmp_path), pattern="*.gz")
    said = plan(c.tokens, capsys)
    assert "hashpartitioning" not in said and "InMemoryTableScan" not in said and c.tokens.count() == c.meta.size > 0
    assert "r_s" in c.tokens.columns and c.check() == {"size": 0, "positions": 0, "heads": 0, "spans": 0}


@pytest.mark.parametrize(("parse", "text", "flat"), [(conllu.parse, CONLLU, ["s", "text", "contr"]), (vrt.parse, VRT, ["s", "text"]), (jsonl.parse, JSONL, ["s", "text"])])
def test_tokens_that_are_handed_on_in_parts(parse, text, flat):
    def tokens(every):
        b, got, places = Builder(), [], {}

        def take():
            places.update({(name, n): (start, end) for name, n, start, end, _, _ in b.regions})
            got.append(b.held("f", ["form"], flat))

        for _ in parse(text.split("\n"), b):
            if every:
                take()
        b.close()
        take()
        return pa.Table.from_batches(got).to_pylist(), places

    (parts, places), (whole, _) = tokens(True), tokens(False)
    assert parts == whole and len(whole) > 2
    for t in whole:
        for name in flat:
            covering = [n for (x, n), (start, end) in places.items() if x == name and start <= t["n"] <= end]
            assert covering == ([] if t[f"r_{name}"] is None else [t[f"r_{name}"]])


def test_regions_over_tokens_read_before_or_after(spark, tmp_path):
    """Regions by place, of tokens that another hand-over has, still cover these."""
    (tmp_path / "a.jsonl").write_text("\n".join(['{"type": "region", "struct": "q", "start_pos": 1, "end_pos": 2, "attrs": {"k": "v"}}', *['{"type": "token", "form": "a"}'] * 4]))
    c = jsonl.read(spark, str(tmp_path))
    assert c.mode("q") == "flat" and sorted(r.pos for r in c.tokens.filter("r_q IS NOT NULL").collect()) == [1, 2]


def test_a_binary_file_is_read_in_chunks(spark, tmp_path, monkeypatch, capsys):
    """No row holds the whole file, and chunks that end within it are numbered on."""
    monkeypatch.setattr(cwb_binary, "CHUNK", 3)
    ids = np.arange(100, dtype="<i4") * 7
    (tmp_path / "word.corpus").write_bytes(ids.tobytes())
    (tmp_path / "empty.corpus").write_bytes(b"")
    for path in (f"{tmp_path}/word.corpus", f"file://{tmp_path}/word.corpus"):
        flat = cwb_binary._words(spark, path, "<i4", "pos long, id long", 1)
        assert "content" not in plan(flat, capsys)
        assert sorted(tuple(r) for r in flat.collect()) == [(k, 7 * k) for k in range(100)]
    pairs = cwb_binary._words(spark, f"{tmp_path}/word.corpus", "<i4", "idx long, start long, end long", 2)
    assert sorted(tuple(r) for r in pairs.collect()) == [(k, 14 * k, 14 * k + 7) for k in range(50)]
    assert cwb_binary._words(spark, f"{tmp_path}/empty.corpus", "<i4", "pos long, id long", 1).count() == 0
