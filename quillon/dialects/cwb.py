"""The CWB subset: token sequences, repetition, names, and the commands count, group, sort, size, tabulate."""

from __future__ import annotations

from ..plans.ast import Command, Statement, replace
from ..plans.parser import Parser, QueryError

COMMANDS = ("count", "group", "sort", "size", "tabulate")
#: Words that this dialect knows and that have no counterpart here.
REFUSED = ("within", "containing", "where", "with", "union", "intersect", "diff", "intersection", "difference", "join", "subset", "dep_subtree", "cat", "set", "show", "drop", "freq", "coll", "dcoll", "keyness", "raw")


class CwbParser(Parser):
    def field(self) -> str:
        """attr, match attr or match.attr; nothing deeper."""
        s = self.s
        name = s.word()
        if name in ("match", "matchend", "target", "keyword"):
            if name != "match":
                raise QueryError(f"{name} is not supported")
            s.take(".")
            return f"match.{s.word()}"
        if s.at("."):
            raise QueryError("attributes have one name here")
        return name

    def command(self) -> Command:
        s = self.s
        name = s.word()
        if name == "size":
            return Command(name, of=self.of())
        if name == "tabulate":
            of = s.word() if s.peek()[0] == "name" and s.peek(1)[0] in ("name", "int") and not s.at("match") else None
            offset, limit = (s.number(), s.number()) if s.peek()[0] == "int" else (0, 1000)
            return Command(name, of=of, fields=self.fields(), offset=offset, limit=limit)
        of = self.of("by")
        if not s.take("by"):
            raise QueryError(f"{name} needs `by` and an attribute")
        return Command(name, of=of, fields=self.fields())

    def statement(self) -> Statement:
        s = self.s
        if s.peek()[0] == "name" and s.peek()[1] in REFUSED and not s.at("=", ahead=1):
            raise QueryError(f"{s.peek()[1]} is not supported")
        if s.peek()[0] == "name" and s.peek()[1] in COMMANDS and not s.at("=", ahead=1):
            return Statement(command=self.command())
        name = None
        if s.peek()[0] == "name" and s.at("=", ahead=1):
            name = s.word()
            s.want("=")
        q = self.chain()
        if not q.items or q.anchors or any(getattr(t, "edge", "") for t in q.items):
            raise QueryError("a sequence of tokens is expected")
        return Statement(name=name, query=q)

    def token(self, label):
        got = super().token(label)
        if got.high > 1 and got.low == 1 and getattr(got.cond, "op", "") == "or" and len(got.cond.args) == 2 and getattr(got.cond.args[1], "attr", "") == "contr_form":
            got = replace(got, cond=got.cond.args[0], low=1, high=1)  # a bare word is one token here
        return got


def translate(program: str) -> list[Statement]:
    got = CwbParser(program).parse()
    if not got:
        raise QueryError("empty program")
    return got
