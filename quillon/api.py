"""JSON in, JSON out: what a server or a binding would call."""

from __future__ import annotations

import json

from .corpus import Corpus
from .operators import aggregate, display
from .session import Session


def health() -> str:
    return json.dumps({"ok": True})


def info(corpus: Corpus) -> str:
    m = corpus.meta
    structs = {n: s | {"regions": corpus.structs[n].count()} for n, s in m.structs.items()}
    return json.dumps({"size": m.size, "attributes": [a.removeprefix("attr:") for a in m.attributes], "structures": structs, "token_groups": list(m.groups), "multivalue": list(m.multivalue), "default_within": m.default_within}, ensure_ascii=False)


def values(corpus: Corpus, attribute: str, limit: int = 1000) -> str:
    got = aggregate.values(Session(corpus).lowering(), attribute, limit).collect()
    return json.dumps({"attribute": attribute, "values": [{"value": r["value"], "count": r["count"]} for r in got]}, ensure_ascii=False)


def regions(corpus: Corpus, struct: str, offset: int = 0, limit: int = 1000) -> str:
    corpus.mode(struct)
    rows = corpus.structs[struct].orderBy("start", "end", "idx").offset(offset).limit(limit).collect()
    return json.dumps({"struct": struct, "regions": [r.asDict() for r in rows]}, ensure_ascii=False)


def query(session: Session, text: str, offset: int = 0, limit: int = 20, context: int = 5, max_total: int | None = None) -> str:
    """One page of hits with the total; parallel queries give pairs of extents."""
    try:
        m = session.query(text)
        total, exact = session.count_total(m, max_total)
        low = session.lowering()
        if m.pairs:
            page = m.df.orderBy("a_first", "b_first").offset(offset).limit(limit).select("a_first", "a_last", "b_first", "b_last").collect()
            hits = [{"source": [r[0], r[1]], "target": [r[2], r[3]]} for r in page]
        else:
            hits = [json.loads(r["hit"]) for r in display.hits(low, m, context, offset, limit).collect()]
        return json.dumps({"ok": True, "total": total, "total_exact": exact, "hits": hits}, ensure_ascii=False)
    except ValueError as e:
        return json.dumps({"ok": False, "error": str(e)})


def run(session: Session, program: str, limit: int = 1000) -> str:
    """The rows of the last statement."""
    try:
        df = session.run(program)
        rows = [] if df is None else [r.asDict(recursive=True) for r in df.limit(limit).collect()]
        return json.dumps({"ok": True, "columns": [] if df is None else df.columns, "rows": rows}, ensure_ascii=False, default=str)
    except ValueError as e:
        return json.dumps({"ok": False, "error": str(e)})
