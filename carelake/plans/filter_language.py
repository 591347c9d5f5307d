"""The boolean filter language: ``path op value`` joined by and, or, not(…) and parentheses."""

from __future__ import annotations

import re
from dataclasses import replace

from ..errors import SearchError
from .model import Both, Clause, Either, Leaf, Not, Value

_TOKEN = re.compile(r'\s*(?:(\()|(\))|"((?:[^"\\]|\\.)*)"|([^\s()"]+))')
ORDERED = ("eq", "ne", "gt", "lt", "ge", "le", "sa", "eb", "ap", "po")
STRINGS = {"eq": "exact", "ne": "exact", "co": "contains", "sw": "starts", "ew": "ends"}
REFUSED = {"in": "needs value set membership", "ni": "needs value set membership", "ss": "needs subsumption", "sb": "needs subsumption", "re": "is not a comparison"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SearchError(f"_filter: can't read {text[at : at + 20]!r}")
        at = m.end()
        if m[1] or m[2]:
            out.append(("mark", m[1] or m[2]))
        elif m[3] is not None:
            out.append(("text", re.sub(r"\\(.)", r"\1", m[3])))
        else:
            out.append(("word", m[4]))
    return out


class _Reader:
    def __init__(self, parser, type_, items):
        self.parser, self.type, self.items, self.at = parser, type_, items, 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.items[self.at - 1] if self.at <= len(self.items) else ("end", "")

    def joined(self, word: str, below, make) -> Clause:
        parts = [below()]
        while self.peek()[0] == "word" and self.peek()[1].lower() == word:
            self.next()
            parts.append(below())
        return parts[0] if len(parts) == 1 else make(tuple(parts))

    def either(self) -> Clause:
        return self.joined("or", self.both, Either)

    def both(self) -> Clause:
        return self.joined("and", self.one, Both)

    def group(self) -> Clause:
        if self.next() != ("mark", "("):
            raise SearchError("_filter: not needs parentheses")
        inner = self.either()
        if self.next() != ("mark", ")"):
            raise SearchError("_filter: a parenthesis is not closed")
        return inner

    def one(self) -> Clause:
        kind, word = self.peek()
        if (kind, word) == ("mark", "("):
            return self.group()
        if kind == "word" and word.lower() == "not":
            self.next()
            return Not(self.group())
        if kind != "word":
            raise SearchError(f"_filter: a parameter is missing before {word!r}")
        path = self.next()[1]
        kind, op = self.next()
        if kind != "word":
            raise SearchError(f"_filter: an operator is missing after {path}")
        op = op.lower()
        if op in REFUSED:
            raise SearchError(f"_filter: {op} {REFUSED[op]}")
        if op == "pr":
            given = self.peek()
            want = True
            if given[1].lower() in ("true", "false") and given[0] == "word":
                want = self.next()[1].lower() == "true"
            return self.leaf(path, op, "true" if want else "false")
        kind, value = self.next()
        if kind not in ("word", "text"):
            raise SearchError(f"_filter: a value is missing after {path} {op}")
        return self.leaf(path, op, value)

    def leaf(self, path: str, op: str, value: str) -> Clause:
        path = re.sub(r"\[(\w+)\]", r":\1", path)
        head, dot, rest = path.rpartition(".")
        holder: list[Leaf] = []

        def build(type_, name: str) -> Clause:
            code, _, modifier = name.partition(":")
            p = self.parser.param(type_, code)
            if p.kind == "composite":
                raise SearchError(f"_filter: {code} is a composite")
            if modifier and not (p.kind == "reference" and modifier in p.targets):
                raise SearchError(f"_filter: {code} takes no modifier {modifier}")
            if op == "pr":
                out: Clause = Leaf(p, missing=value == "false")
            elif p.kind == "string":
                if op not in STRINGS:
                    raise SearchError(f"_filter: {op} can't compare a string")
                out = Leaf(p, (Value(value, STRINGS[op]),), op == "ne")
            elif p.kind in ("narrative", "content"):
                if op not in ("eq", "co", "ne"):
                    raise SearchError(f"_filter: {op} can't compare a text")
                out = Leaf(p, (Value(value),), op == "ne")
            elif p.kind in ("token", "reference", "uri", "id"):
                if op not in ("eq", "ne") and not (p.kind == "uri" and op == "sw"):
                    raise SearchError(f"_filter: {op} can't compare a {p.kind}")
                v = self.parser.value(p, value.replace("\\", "\\\\").replace(",", "\\,"), None, modifier or None, "below" if op == "sw" else None)
                out = Leaf(p, (v,), op == "ne")
            else:
                if op not in ORDERED:
                    raise SearchError(f"_filter: {op} can't compare a {p.kind}")
                out = Leaf(p, (replace(self.parser.value(p, value), op=op),))
            holder.append(out)  # type: ignore[arg-type]
            return out

        if not dot:
            return build(self.type, rest)
        # the chain is resolved as elsewhere, its last clause is built here
        inner = self.parser.__class__(self.parser.registry)
        plain_leaf = inner.leaf
        inner.leaf = lambda type_, code, modifier, _: build(type_, code + (f":{modifier}" if modifier else ""))  # type: ignore[method-assign]
        try:
            return inner.clause(self.type, path, value)
        finally:
            inner.leaf = plain_leaf  # type: ignore[method-assign]


def parse_filter(parser, type_: str | None, text: str) -> Clause:
    r = _Reader(parser, type_, tokens(text))
    if not r.items:
        raise SearchError("_filter is empty")
    out = r.either()
    if r.peek()[0] != "end":
        raise SearchError(f"_filter: unexpected {r.peek()[1]!r}")
    return out
