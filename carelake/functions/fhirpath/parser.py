"""Lexer, tree and precedence parser of path expressions; str() of a tree parses to the same tree."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from ...errors import PathError


@dataclass(frozen=True)
class Literal:
    kind: str  # empty, boolean, string, number, long, date, datetime, time, quantity
    text: str
    unit: str = ""

    def __str__(self) -> str:
        if self.kind == "empty":
            return "{}"
        if self.kind == "string":
            return quoted(self.text)
        if self.kind == "long":
            return f"{self.text}L"
        if self.kind in ("date", "datetime", "time"):
            return f"@{self.text}"
        if self.kind == "quantity":
            return f"{self.text} {self.unit}"
        return self.text


@dataclass(frozen=True)
class Name:
    """A member of the focus, or of base where there is one."""

    name: str
    base: object | None = None

    def __str__(self) -> str:
        return (f"{wrapped(self.base, 99)}." if self.base is not None else "") + member(self.name)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    base: object | None = None

    def __str__(self) -> str:
        return (f"{wrapped(self.base, 99)}." if self.base is not None else "") + f"{member(self.name)}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Index:
    base: object
    at: object

    def __str__(self) -> str:
        return f"{wrapped(self.base, 99)}[{self.at}]"


@dataclass(frozen=True)
class Unary:
    op: str
    of: object

    def __str__(self) -> str:
        return f"{self.op}{wrapped(self.of, 90)}"


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object

    def __str__(self) -> str:
        p = LEVELS[self.op]
        return f"{wrapped(self.left, p)} {self.op} {wrapped(self.right, p + 1)}"


@dataclass(frozen=True)
class TypeTest:
    op: str  # is or as
    of: object
    type: str

    def __str__(self) -> str:
        return f"{wrapped(self.of, LEVELS['is'])} {self.op} {self.type}"


@dataclass(frozen=True)
class Special:
    """$this, $index, $total or a %variable."""

    name: str

    def __str__(self) -> str:
        if self.name[0] == "%" and not re.fullmatch(r"%[A-Za-z_]\w*", self.name):
            return f"%`{self.name[1:]}`"
        return self.name


LEVELS = {"implies": 1, "or": 2, "xor": 2, "and": 3, "in": 4, "contains": 4, "=": 5, "~": 5, "!=": 5, "!~": 5, "<": 6, "<=": 6, ">": 6, ">=": 6, "|": 7, "is": 8, "as": 8, "+": 9, "-": 9, "&": 9, "*": 10, "/": 10, "div": 10, "mod": 10}
UNITS = ("year", "years", "month", "months", "week", "weeks", "day", "days", "hour", "hours", "minute", "minutes", "second", "seconds", "millisecond", "milliseconds")
_ESCAPES = {"'": "'", '"': '"', "`": "`", "\\": "\\", "/": "/", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<time>@T\d\d(?::\d\d(?::\d\d(?:\.\d+)?)?)?)
    |(?P<date>@\d{4}(?:-\d\d(?:-\d\d)?)?(?P<clock>T(?:\d\d(?::\d\d(?::\d\d(?:\.\d+)?)?)?(?:Z|[+-]\d\d:\d\d)?)?)?)
    |(?P<number>\d+(?:\.\d+)?)(?P<long>L(?!\w))?
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<name>[A-Za-z_]\w*)
    |(?P<tick>`(?:[^`\\]|\\.)*`)
    |(?P<special>\$[A-Za-z]+)
    |(?P<variable>%(?:[A-Za-z_][\w-]*|`(?:[^`\\]|\\.)*`|'(?:[^'\\]|\\.)*'))
    |(?P<mark><=|>=|!=|!~|[-+*/&|=~<>.,()\[\]{}])""",
    re.X | re.S,
)


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2] not in _ESCAPES:
            raise PathError(f"unknown escape \\{m[2]}")
        return _ESCAPES[m[2]]

    text = re.sub(r"\\u([0-9A-Fa-f]{4})|\\(.)", one, text, flags=re.S)
    return text.encode("utf-16", "surrogatepass").decode("utf-16") if any("\ud800" <= c <= "\udfff" for c in text) else text


def quoted(text: str) -> str:
    back = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f"}
    return "'" + "".join(back.get(c, c) for c in text) + "'"


def member(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) and name not in LEVELS else name if name in ("contains", "is", "as") else "`" + name.replace("\\", "\\\\").replace("`", "\\`") + "`"


def wrapped(node, level: int) -> str:
    own = LEVELS[node.op] if isinstance(node, (Binary, TypeTest)) else 90 if isinstance(node, Unary) else 98 if isinstance(node, Literal) and node.kind == "quantity" else 100
    return f"({node})" if own < level else str(node)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PathError(f"unexpected {text[at : at + 10]!r} at {at}")
        at = m.end()
        if m["space"]:
            continue
        if m["number"]:
            out.append(("long" if m["long"] else "number", m["number"]))
        elif m["time"]:
            out.append(("time", m["time"][1:]))
        elif m["date"]:
            out.append(("datetime" if m["clock"] else "date", m["date"][1:]))
        elif m["string"]:
            out.append(("string", unescape(m["string"][1:-1])))
        elif m["tick"]:
            out.append(("tick", unescape(m["tick"][1:-1])))
        elif m["variable"]:
            v = m["variable"][1:]
            out.append(("variable", unescape(v[1:-1]) if v[0] in "`'" else v))
        else:
            kind = m.lastgroup
            out.append((kind, m[kind]))
    return [*out, ("end", "")]


class _Reader:
    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    @property
    def now(self) -> tuple[str, str]:
        return self.items[self.at]

    def take(self, *marks: str) -> str | None:
        if self.now[0] in ("mark", "name") and self.now[1] in marks:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise PathError(f"expected {mark} before {self.now[1] or 'the end'!r}")

    def expression(self, level: int = 1):
        left = self.unary()
        while self.now[0] in ("mark", "name") and LEVELS.get(self.now[1], 0) >= level:
            op = self.now[1]
            self.at += 1
            left = TypeTest(op, left, self.type()) if op in ("is", "as") else Binary(op, left, self.expression(LEVELS[op] + 1))
        return left

    def unary(self):
        op = self.take("+", "-")
        return Unary(op, self.unary()) if op else self.postfix()

    def postfix(self):
        out = self.term()
        while True:
            if self.take("."):
                out = self.invocation(out)
            elif self.take("["):
                at = self.expression()
                self.need("]")
                out = Index(out, at)
            else:
                return out

    def invocation(self, base):
        kind, text = self.now
        if kind == "special":
            self.at += 1
            return Call("select", (Special(text),), base) if text != "$this" else base
        if kind not in ("name", "tick"):
            raise PathError(f"a name is missing before {text or 'the end'!r}")
        self.at += 1
        if kind == "name" and self.take("("):
            return Call(text, self.arguments(), base)
        return Name(text, base)

    def arguments(self) -> tuple:
        if self.take(")"):
            return ()
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        self.need(")")
        return tuple(out)

    def term(self):
        kind, text = self.now
        self.at += 1
        if kind == "mark" and text == "(":
            out = self.expression()
            self.need(")")
            return out
        if kind == "mark" and text == "{":
            self.need("}")
            return Literal("empty", "")
        if kind == "number":
            if self.now[0] == "string":
                self.at += 1
                return Literal("quantity", text, quoted(self.items[self.at - 1][1]))
            if self.now[0] == "name" and self.now[1] in UNITS:
                self.at += 1
                return Literal("quantity", text, self.items[self.at - 1][1])
            return Literal("number", text)
        if kind in ("long", "string", "date", "datetime", "time"):
            return Literal(kind, text)
        if kind == "name" and text in ("true", "false") and self.now != ("mark", "("):
            return Literal("boolean", text)
        if kind == "special":
            if text not in ("$this", "$index", "$total"):
                raise PathError(f"unknown {text}")
            return Special(text)
        if kind == "variable":
            return Special(f"%{text}")
        if kind in ("name", "tick"):
            self.at -= 1
            return self.invocation(None)
        raise PathError(f"unexpected {text or 'end'!r}")

    def type(self) -> str:
        parts = []
        while True:
            kind, text = self.now
            if kind not in ("name", "tick"):
                raise PathError("a type is missing")
            self.at += 1
            parts.append(text)
            if not self.take("."):
                return ".".join(parts)


@lru_cache(4096)
def parse(text: str):
    r = _Reader(text)
    out = r.expression()
    if r.now[0] != "end":
        raise PathError(f"unexpected {r.now[1]!r}")
    return out
