"""The query language: ``relations | predicates | sums``.

``query := rel {ws rel} '|' pred {'&' pred} '|' ref {ws ref}``,
``pred := ref '=' ref | ref ('='|'<'|'>') uint``, ``ref := uint '.' uint``.
White space is free between tokens. An empty predicate list is accepted only
for a single relation without joins when ``allow_no_predicates`` is set.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

U64_MAX = 2**64 - 1


class QuerySyntaxError(ValueError):
    """A query text that the grammar doesn't accept; ``position`` is the offset of the fault."""

    def __init__(self, message: str, text: str, position: int):
        super().__init__(f"{message} at {position} in {text!r}")
        self.position = position


@dataclass(frozen=True, order=True)
class Ref:
    """Column ``column`` of the relation bound at ``binding``."""

    binding: int
    column: int

    def __str__(self) -> str:
        return f"{self.binding}.{self.column}"


@dataclass(frozen=True)
class Filter:
    ref: Ref
    op: str
    value: int

    def __str__(self) -> str:
        return f"{self.ref}{self.op}{self.value}"


@dataclass(frozen=True)
class Join:
    left: Ref
    right: Ref

    def __str__(self) -> str:
        return f"{self.left}={self.right}"


@dataclass(frozen=True)
class Query:
    relations: tuple[int, ...]
    filters: tuple[Filter, ...]
    joins: tuple[Join, ...]
    sums: tuple[Ref, ...]
    text: str = field(default="", compare=False)

    def refs(self) -> list[Ref]:
        """Every column that the query touches, in order of first use."""
        seen = [f.ref for f in self.filters]
        for j in self.joins:
            seen += [j.left, j.right]
        return list(dict.fromkeys(seen + list(self.sums)))

    def __str__(self) -> str:
        preds = "&".join(map(str, (*self.filters, *self.joins)))
        return f"{' '.join(map(str, self.relations))}|{preds}|{' '.join(map(str, self.sums))}"


_TOKEN = re.compile(r"\s*(?:(\d+)|([|&.=<>]))", re.ASCII)


def _tokens(text: str) -> list[tuple[str, int]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError("unexpected character", text, at)
        out.append((m[1] or m[2], m.end() - len(m[1] or m[2])))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def fail(self, message: str):
        where = self.tokens[self.at][1] if self.at < len(self.tokens) else len(self.text)
        raise QuerySyntaxError(message, self.text, where)

    def take(self, what: str) -> str:
        got = self.peek()
        if not (got.isdigit() if what == "number" else got == what):
            self.fail(f"expected {what}")
        self.at += 1
        return got

    def number(self) -> int:
        value = int(self.take("number"))
        if value > U64_MAX:
            self.at -= 1
            self.fail("number exceeds 64 bits")
        return value

    def ref(self) -> Ref:
        binding = self.number()
        self.take(".")
        return Ref(binding, self.number())

    def predicate(self) -> Filter | Join:
        left, op = self.ref(), self.peek()
        if op not in ("=", "<", ">") or not op:
            self.fail("expected =, < or >")
        self.at += 1
        value = self.number()
        if self.peek() != ".":
            return Filter(left, op, value)
        if op != "=":
            self.fail("only equality joins two columns; a literal has no dot")
        self.at += 1
        return Join(left, Ref(value, self.number()))


def parse_query(text: str, allow_no_predicates: bool = False) -> Query:
    """The query of one line of text; raises QuerySyntaxError with the position of the fault."""
    r = _Reader(text)
    relations = []
    while r.peek().isdigit():
        relations.append(r.number())
    if not relations:
        r.fail("expected a relation")
    r.take("|")
    predicates: list[Filter | Join] = []
    if not (allow_no_predicates and r.peek() == "|"):
        predicates.append(r.predicate())
        while r.peek() == "&":
            r.at += 1
            predicates.append(r.predicate())
    r.take("|")
    sums = [r.ref()]
    while r.peek():
        sums.append(r.ref())
    query = Query(tuple(relations), tuple(p for p in predicates if isinstance(p, Filter)), tuple(p for p in predicates if isinstance(p, Join)), tuple(sums), text)
    for ref in query.refs():
        if ref.binding >= len(relations):
            raise QuerySyntaxError(f"binding {ref.binding} is not in the relation list", text, 0)
    return query
