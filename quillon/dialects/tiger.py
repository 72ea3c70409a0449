"""Macros over constituents: dom A B, idom A B, cat C, one a line; other lines are native queries."""

from __future__ import annotations

from ..plans.ast import Anchor, Filter, Fn, Query, Statement
from ..plans.parser import QueryError, parse

#: Regions of this type and attribute are constituents.
NODE, LABEL = "node", "type"


def translate(program: str) -> list[Statement]:
    out = []
    for line in program.split("\n"):
        words = line.split("#")[0].split()
        if not words:
            continue
        kind, *names = words
        if kind in ("dom", "idom"):
            if len(names) != 2:
                raise QueryError(f"{kind} takes two categories")
            anchors = tuple(Anchor(NODE, ((LABEL, n),), x) for n, x in zip(names, ("parent", "child"), strict=True))
            test = Filter("function", Fn("rchild" if kind == "idom" else "contains", ("parent", "child")), "=", 1)
            out.append(Statement(query=Query(anchors=anchors, filters=(test,))))
        elif kind == "cat":
            if len(names) != 1:
                raise QueryError("cat takes one category")
            out.append(Statement(query=Query(anchors=(Anchor(NODE, ((LABEL, names[0]),), "node"),))))
        else:
            out += parse(line.split("#")[0])
    if not out:
        raise QueryError("empty program")
    return out
