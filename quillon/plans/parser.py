"""Text of the query language to syntax trees: one scanner, one recursive descent."""

from __future__ import annotations

import re

from .ast import Anchor, Bool, Command, CountRel, Filter, Fn, Leaf, NVals, Query, Region, Rel, Statement, Subtree, Token, replace

MANY = 100
RELATIONS = ("child", "parent", "sibling", "descendant", "ancestor")
COMMANDS = ("count", "group", "freq", "coll", "dcoll", "keyness", "tabulate", "sort", "size", "raw", "cat", "show", "set", "drop")
FUNCTIONS = ("distance", "distabs", "strlen", "f", "nchildren", "depth", "ndescendants", "nvals", "contains", "rchild", "rcontains", "tcnt")
METACHARACTERS = frozenset(r".*+?[](){}|^$\\")

_SCAN = re.compile(
    r"""\s*(?:
      (?P<string>"(?:\\.|[^"\\])*")
    | (?P<regex>/(?:\\.|[^/\\])+/)
    | (?P<int>\d+)
    | (?P<name>[^\W\d][\w\-]*(?:/[^\W\d][\w\-]*)?)
    | (?P<op>::|!>|!<|!=|<=|>=|<<|>>|</|[\[\]{}()&|=<>,;:.?*+!%~^])
    )""",
    re.X,
)


class QueryError(ValueError):
    pass


class Scanner:
    def __init__(self, text: str):
        self.text, self.toks, at = text, [], 0
        text = "\n".join("" if line.lstrip().startswith("#") else line for line in text.split("\n"))
        while text[at:].strip():
            m = _SCAN.match(text, at)
            if not m:
                raise QueryError(f"unexpected character at {at}: {text[at : at + 20]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()))
            at = m.end()
        self.k = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[self.k + ahead][:2] if self.k + ahead < len(self.toks) else ("end", "")

    def next(self) -> tuple[str, str]:
        got = self.peek()
        self.k += 1
        return got

    def glued(self) -> bool:
        """No white space before the next token."""
        return 0 < self.k < len(self.toks) and self.toks[self.k - 1][3] == self.toks[self.k][2]

    def at(self, *values: str, ahead: int = 0) -> bool:
        kind, value = self.peek(ahead)
        return kind in ("op", "name") and value in values

    def take(self, *values: str) -> str | None:
        return self.next()[1] if self.at(*values) else None

    def want(self, *values: str) -> str:
        got = self.take(*values)
        if got is None:
            raise QueryError(f"expected {' or '.join(values)}, got {self.peek()[1]!r}")
        return got

    def word(self) -> str:
        kind, value = self.next()
        if kind != "name":
            raise QueryError(f"expected a name, got {value!r}")
        return value

    def number(self) -> int:
        kind, value = self.next()
        if kind != "int":
            raise QueryError(f"expected a number, got {value!r}")
        return int(value)


def unquote(s: str) -> str:
    return re.sub(r'\\(["\\/])', r"\1", s[1:-1]) if '\\"' in s or "\\\\" in s else s[1:-1]


class Parser:
    def __init__(self, text: str, strict_quoted_strings: bool = False):
        self.s, self.strict = Scanner(text), strict_quoted_strings

    def parse(self) -> list[Statement]:
        out = []
        while self.s.take(";"):
            pass
        while self.s.peek()[0] != "end":
            out.append(self.statement())
            if self.s.peek()[0] != "end":
                self.s.want(";")
            while self.s.take(";"):
                pass
        return out

    # ------------------------------------------------------------ statements

    def statement(self) -> Statement:
        s = self.s
        if s.peek()[0] == "name" and s.peek()[1] in COMMANDS and not s.at("=", ":", ahead=1):
            return Statement(command=self.command())
        name = None
        if s.peek()[0] == "name" and s.at("=", ahead=1):
            name = s.word()
            s.want("=")
        start = s.k
        label = self.label()
        if s.at("dep_subtree") and (name or label):
            source = self.subtree_source()
            if s.peek()[0] == "end" or s.at(";", "::"):
                return Statement(name=name or label, subtree=Subtree(label or name, source), filters=self.filters())
        s.k = start
        return Statement(name=name, query=self.query())

    def subtree_source(self) -> str:
        self.s.want("dep_subtree")
        self.s.want("(")
        source = self.s.word()
        self.s.want(")")
        return source

    def field(self) -> str:
        s = self.s
        name = s.word()
        if s.at("(") and name in ("tcnt", "forms", "spellout"):
            s.want("(")
            args = [s.word()]
            while s.take(","):
                args.append(s.word())
            s.want(")")
            return f"{name}({','.join(args)})"
        while s.take("."):
            name += "." + s.word()
        return name

    def fields(self) -> tuple:
        out = [self.field()]
        while self.s.take(","):
            out.append(self.field())
        return tuple(out)

    def of(self, *stops: str) -> str | None:
        s = self.s
        return s.word() if s.peek()[0] == "name" and not s.at(*stops) else None

    def command(self) -> Command:
        s = self.s
        name = s.word()
        if name in ("size", "raw", "cat"):
            return Command(name, of=self.of())
        if name == "drop":
            return Command(name, args=(s.word(),))
        if name == "set":
            key = s.word()
            value = []
            while s.peek()[0] != "end" and not s.at(";"):
                value.append(s.next()[1].strip('"'))
            return Command(name, args=(key, "".join(value)))
        if name == "show":
            what = s.word()
            return Command(name, args=(what, self.field() if s.peek()[0] == "name" else None))
        if name == "tabulate":
            of = None
            if s.peek()[0] == "name" and (s.peek(1)[0] in ("name", "int")):
                of = s.word()
            offset, limit = 0, 1000
            if s.peek()[0] == "int":
                offset, limit = s.number(), s.number()
            return Command(name, of=of, fields=self.fields(), offset=offset, limit=limit)
        if name == "keyness":
            of = self.of("by", "vs")
            versus = s.word() if s.take("vs") else None
            s.want("by")
            return Command(name, of=of, versus=versus, fields=self.fields())
        if name == "freq":
            of = self.of("by")
            more = []
            while s.take(","):
                more.append(s.word())
            s.want("by")
            return Command(name, of=of, args=tuple(more), fields=self.fields())
        if name == "dcoll":
            of, anchor, rels = None, None, []
            if s.peek()[0] == "name" and s.peek(1)[0] == "name" and not s.at("by") and not s.at("by", ahead=1):
                of = s.word()
            while s.peek()[0] == "name" and not s.at("by"):
                rel = s.word()
                if s.take("."):
                    anchor, rel = rel, s.word()
                while s.glued() and s.take(":"):
                    rel += ":" + s.word()
                rels.append(rel)
                if not s.take(","):
                    break
            s.want("by")
            return Command(name, of=of, relations=tuple(rels), anchor=anchor, fields=self.fields())
        of = self.of("by")
        s.want("by")
        return Command(name, of=of, fields=self.fields())

    # --------------------------------------------------------------- queries

    def label(self) -> str | None:
        s = self.s
        if s.peek()[0] == "name" and s.at(":", ahead=1):
            name = s.word()
            s.want(":")
            return name
        return None

    def query(self) -> Query:
        q = self.chain()
        if self.s.take("with"):
            q = replace(q, other=self.chain())
        q = self.clauses(q)
        if not q.items and not q.anchors:
            raise QueryError("empty query")
        return q

    def chain(self) -> Query:
        s, items, anchors, edge = self.s, [], [], ""
        while True:
            kind, value = s.peek()
            start = s.k
            label = self.label()
            kind, value = s.peek()
            if value == "</":
                s.next()
                struct = s.word()
                s.want(">")
                anchors.append(Anchor(struct, closing=True, at=len(items)))
                continue
            if value == "<" and kind == "op" and not (items and not label and self.edge_ahead()):
                anchors.append(self.anchor(label, len(items)))
                continue
            if kind == "name" and value == "dep_subtree":
                if not label:
                    raise QueryError("dep_subtree needs a label")
                items.append(Subtree(label, self.subtree_source(), edge))
                edge = ""
                continue
            if value == "[" or kind in ("string", "regex"):
                token = self.token(label)
                items.append(replace(token, edge=edge))
                edge = ""
                continue
            s.k = start
            if kind == "op" and value in (">", "<", ">>", "<<", "!>", "!<") and items and not edge:
                edge = s.next()[1]
                continue
            break
        if edge:
            raise QueryError(f"nothing after {edge}")
        return Query(items=tuple(items), anchors=tuple(anchors))

    def edge_ahead(self) -> bool:
        """After `<`: a token (so it is the relation) or a structure's name (so it is an anchor)."""
        s = self.s
        kind, value = s.peek(1)
        if kind in ("string", "regex") or value == "[":
            return True
        return kind == "name" and s.at(":", ahead=2) and (s.at("[", ahead=3) or s.peek(3)[0] in ("string", "regex") or s.at("dep_subtree", ahead=3))

    def anchor(self, label: str | None, at: int) -> Anchor:
        s = self.s
        s.want("<")
        struct, attrs, peers = s.word(), [], []
        while not s.take(">"):
            name = s.word()
            if name in ("contains", "rchild", "rcontains") and s.take("("):
                peers.append((name, s.word()))
                s.want(")")
                continue
            s.want("=")
            kind, value = s.next()
            if kind != "string":
                raise QueryError("an anchor's attribute needs a quoted value")
            attrs.append((name, unquote(value)))
        return Anchor(struct, tuple(attrs), label, False, at, tuple(peers))

    def token(self, label: str | None) -> Token:
        s = self.s
        kind, value = s.peek()
        if kind in ("string", "regex"):
            s.next()
            leaf = self.leaf("form", "=", kind, value)
            low, high = self.repeat((1, MANY))
            return Token(Bool("or", (leaf, replace(leaf, attr="contr_form"))), label, low, high)
        s.want("[")
        cond = None if s.at("]") else self.disjunction()
        s.want("]")
        low, high = self.repeat((1, 1))
        return Token(cond, label, low, high)

    def repeat(self, default: tuple[int, int]) -> tuple[int, int]:
        s = self.s
        if s.take("?"):
            return 0, 1
        if s.take("*"):
            return 0, MANY
        if s.take("+"):
            return 1, MANY
        if s.take("{"):
            low = s.number()
            high = low
            if s.take(","):
                high = s.number() if s.peek()[0] == "int" else max(low, MANY)
            s.want("}")
            if high < low:
                raise QueryError("repetition with its upper bound below the lower")
            return low, high
        return default

    # ------------------------------------------------------------ conditions

    def disjunction(self):
        args = [self.conjunction()]
        while self.s.take("|"):
            args.append(self.conjunction())
        return args[0] if len(args) == 1 else Bool("or", tuple(args))

    def conjunction(self):
        args = [self.primary()]
        while self.s.take("&"):
            args.append(self.primary())
        return args[0] if len(args) == 1 else Bool("and", tuple(args))

    def bracketed(self):
        """[cond] of a relation; a label on it is accepted."""
        self.label()
        self.s.want("[")
        cond = None if self.s.at("]") else self.disjunction()
        self.s.want("]")
        return cond

    def primary(self):
        s = self.s
        if s.take("("):
            got = self.disjunction()
            s.want(")")
            return got
        negated = bool(s.take("not", "!"))
        if s.at(*RELATIONS) and (s.at("[", ahead=1) or s.at(":", ahead=2)):
            return Rel(s.word(), self.bracketed(), negated)
        if negated:
            raise QueryError("only relations can be negated here")
        if s.at("count") and s.at("(", ahead=1):
            s.next(), s.want("(")
            rel = s.word()
            if rel not in RELATIONS:
                raise QueryError(f"unknown relation {rel}")
            cond = self.bracketed() if s.at("[") else None
            s.want(")")
            return CountRel(rel, cond, self.comparison(), s.number())
        if s.at("nvals") and s.at("(", ahead=1):
            s.next(), s.want("(")
            attr = s.word()
            s.want(")")
            return NVals(attr, self.comparison(), s.number())
        attr = s.word()
        op = self.comparison()
        kind, value = s.next()
        return self.leaf(attr, op, kind, value)

    def comparison(self) -> str:
        return self.s.want("=", "!=", "<=", ">=", "<", ">")

    def leaf(self, attr: str, op: str, kind: str, value: str) -> Leaf:
        if kind == "regex":
            if op not in ("=", "!="):
                raise QueryError(f"{op} doesn't take a regular expression")
            return Leaf(attr, op, value[1:-1].replace("\\/", "/"), "regex")
        if kind not in ("string", "int"):
            raise QueryError(f"expected a value, got {value!r}")
        text = unquote(value) if kind == "string" else value
        flags = ""
        while self.s.take("%"):
            flags += self.s.word()
        if set(flags) - set("cd"):
            raise QueryError(f"unknown flag %{flags}")
        if kind == "string" and not self.strict and not flags and op in ("=", "!=") and METACHARACTERS & set(text):
            if op == "!=":
                raise QueryError("!= takes no pattern; set strict_quoted_strings for the literal string")
            return Leaf(attr, op, text, "whole")
        return Leaf(attr, op, text, "literal", "".join(sorted(set(flags))))

    # --------------------------------------------------------------- clauses

    def region(self, negated: bool, containing: bool) -> Region:
        s = self.s
        if containing and s.take("subtree"):
            return Region("", negated, True, self.bracketed() if s.at("[") else None)
        struct, cond = s.word(), None
        if s.at("=", "!=", "<", ">", "<=", ">="):
            attr, op = struct, self.comparison()
            kind, value = s.next()
            struct, cond = attr.partition("_")[0], self.leaf(attr, op, kind, value)
        return Region(struct, negated, False, cond)

    def clauses(self, q: Query) -> Query:
        s, containing, filters = self.s, [], ()
        while True:
            negated = s.at("not") and s.at("within", "containing", ahead=1)
            if negated:
                s.next()
            if s.take("within"):
                region = self.region(negated, False)
                q = replace(q, not_within=region) if negated else replace(q, within=region)
                if s.take("having"):
                    q = replace(q, having=self.bracketed())
            elif s.take("containing"):
                containing.append(self.region(negated, True))
            elif s.at("::"):
                filters += self.filters()
            elif s.take("where"):
                names = [s.word()]
                while s.take(","):
                    names.append(s.word())
                q = replace(q, where=tuple(names))
            else:
                return replace(q, containing=tuple(containing), filters=filters)

    def filters(self) -> tuple:
        s, out = self.s, []
        if not s.take("::"):
            return ()
        out.append(self.filter())
        while s.take("&", "::"):
            out.append(self.filter())
        return tuple(out)

    def side(self):
        s = self.s
        kind, value = s.peek()
        if kind == "int":
            return s.number()
        if kind in ("string", "regex"):
            return self.leaf("", "=", *s.next())
        name = s.word()
        if s.at("("):
            if name not in FUNCTIONS:
                raise QueryError(f"unknown function {name}")
            s.want("(")
            args = [self.field()]
            while s.take(","):
                args.append(self.field())
            s.want(")")
            return Fn(name, tuple(args))
        while s.take("."):
            name += "." + s.word()
        return name

    def filter(self) -> Filter:
        left, op = self.side(), self.comparison()
        right = self.side()
        if isinstance(left, Fn) or isinstance(right, Fn):
            return Filter("function", left, op, right)
        if not isinstance(left, str):
            raise QueryError("a filter begins with a name or a function")
        if isinstance(right, Leaf):
            return Filter("region", left, op, replace(right, op=op))
        if isinstance(right, str) and "." not in left and "." not in right:
            return Filter("order", left, op, right)
        if isinstance(right, str):
            return Filter("align", left, op, right)
        return Filter("region", left, op, Leaf("", op, str(right)))


def parse(text: str, strict_quoted_strings: bool = False) -> list[Statement]:
    return Parser(text, strict_quoted_strings).parse()
