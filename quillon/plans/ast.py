"""Syntax trees of the query language: plain frozen records, no behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

__all__ = ["Leaf", "Bool", "Rel", "CountRel", "NVals", "Token", "Subtree", "Anchor", "Region", "Filter", "Fn", "Query", "Command", "Statement", "replace"]


@dataclass(frozen=True)
class Leaf:
    """attr op value; kind is literal, regex (anywhere in the value) or whole (the whole value)."""

    attr: str
    op: str
    value: str
    kind: str = "literal"
    flags: str = ""


@dataclass(frozen=True)
class Bool:
    op: str  # and, or
    args: tuple


@dataclass(frozen=True)
class Rel:
    """[not] child|parent|sibling|descendant|ancestor [cond]"""

    rel: str
    cond: object
    negated: bool = False


@dataclass(frozen=True)
class CountRel:
    rel: str
    cond: object
    op: str
    n: int


@dataclass(frozen=True)
class NVals:
    attr: str
    op: str
    n: int


@dataclass(frozen=True)
class Token:
    cond: object = None
    label: str | None = None
    low: int = 1
    high: int = 1
    edge: str = ""  # the operator before it: "" for adjacency, > < >> << !> !<


@dataclass(frozen=True)
class Subtree:
    label: str
    source: str
    edge: str = ""


@dataclass(frozen=True)
class Anchor:
    """<struct attrs> or </struct>, standing before (or, closing, after) the token of index `at`."""

    struct: str
    attrs: tuple = ()
    label: str | None = None
    closing: bool = False
    at: int = 0
    peers: tuple = ()  # (contains|rchild|rcontains, label)


@dataclass(frozen=True)
class Region:
    """within / containing: struct or a subtree, with an optional attribute test and `having`."""

    struct: str
    negated: bool = False
    subtree: bool = False
    cond: object = None


@dataclass(frozen=True)
class Fn:
    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    """left op right; sides are Fn, ints, strings, or names with or without a label (kind: order, function, region, align)."""

    kind: str
    left: object
    op: str
    right: object


@dataclass(frozen=True)
class Query:
    items: tuple = ()
    anchors: tuple = ()
    within: Region | None = None
    not_within: Region | None = None
    having: object = None
    containing: tuple = ()
    filters: tuple = ()
    where: tuple = ()
    other: Query | None = None  # the right side of `with`


@dataclass(frozen=True)
class Command:
    name: str
    of: str | None = None
    versus: str | None = None
    fields: tuple = ()
    relations: tuple = ()
    anchor: str | None = None
    offset: int = 0
    limit: int | None = None
    args: tuple = ()


@dataclass(frozen=True)
class Statement:
    name: str | None = None
    query: Query | None = None
    command: Command | None = None
    subtree: Subtree | None = None
    filters: tuple = field(default=())
