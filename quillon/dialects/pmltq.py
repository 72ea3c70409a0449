"""A tree-query subset: a-node|a-root|tok $v := [ ... and/or ... ] >> [distinct] $v.attr, count(over $v.attr)."""

from __future__ import annotations

import re

from ..plans.ast import Bool, Command, CountRel, Leaf, Query, Statement, Token
from ..plans.parser import METACHARACTERS, QueryError

_SCAN = re.compile(r'\s*(?:(?P<string>"(?:\\.|[^"\\])*")|(?P<var>\$\w+)|(?P<word>[\w][\w\-/]*)|(?P<op>:=|>>|!=|[\[\](),.=~]))')
SELECTORS = ("a-node", "a-root", "tok")
#: Attributes that are known by other names here.
NAMES = {"tag": "xpos"}


class _Reader:
    def __init__(self, text: str):
        self.toks, at = [], 0
        while text[at:].strip():
            m = _SCAN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 10]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.k = 0

    def peek(self):
        return self.toks[self.k] if self.k < len(self.toks) else ("end", "")

    def take(self, *values):
        if self.peek()[1] in values and self.peek()[0] != "string":
            self.k += 1
            return self.toks[self.k - 1][1]
        return None

    def want(self, *values):
        got = self.take(*values)
        if got is None:
            raise QueryError(f"expected {values[0]}, got {self.peek()[1]!r}")
        return got

    def kind(self, kind):
        if self.peek()[0] != kind:
            raise QueryError(f"expected a {kind}, got {self.peek()[1]!r}")
        self.k += 1
        return self.toks[self.k - 1][1]

    def either(self):
        args = [self.both()]
        while self.take("or"):
            args.append(self.both())
        return args[0] if len(args) == 1 else Bool("or", tuple(args))

    def both(self):
        args = [self.one()]
        while self.take("and", ","):
            args.append(self.one())
        return args[0] if len(args) == 1 else Bool("and", tuple(args))

    def one(self):
        if self.take("("):
            got = self.either()
            self.want(")")
            return got
        attr = self.kind("word")
        op = self.want("=", "!=", "~")
        text = self.kind("string")[1:-1]
        kind = "regex" if op == "~" else "whole" if op == "=" and METACHARACTERS & set(text) else "literal"
        return Leaf(NAMES.get(attr, attr), "=" if op == "~" else op, text, kind)

    def field(self):
        var = self.kind("var")[1:]
        self.want(".")
        return f"{var}.{NAMES.get(name := self.kind('word'), name)}"


def translate(program: str) -> list[Statement]:
    r = _Reader(program)
    if r.peek()[0] == "end":
        raise QueryError("empty query")
    kind = r.take(*SELECTORS) or "a-node"
    var = r.kind("var")[1:] if r.peek()[0] == "var" else None
    if var:
        r.want(":=")
    r.want("[")
    cond = None if r.peek()[1] == "]" else r.either()
    r.want("]")
    if kind == "a-root":
        root = CountRel("parent", None, "=", 0)
        cond = root if cond is None else Bool("and", (cond, root))
    out = [Statement(query=Query(items=(Token(cond, var),)))]
    if r.take(">>"):
        r.take("distinct")
        fields = []
        while True:
            if r.take("count"):
                r.want("("), r.want("over")
                field = r.field()
                r.want(")")
            else:
                field = r.field()
            if field not in fields:
                fields.append(field)
            if not r.take(","):
                break
        out.append(Statement(command=Command("count", fields=tuple(fields))))
    if r.peek()[0] != "end":
        raise QueryError(f"unexpected {r.peek()[1]!r}")
    return out
