"""The interpreter: expressions over collections (lists) of values and nodes."""

from __future__ import annotations

import base64
import html
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from fractions import Fraction
from typing import Any

from ...errors import PathError
from ...registry import Registry, default
from .parser import Binary, Call, Index, Literal, Name, Special, TypeTest, Unary, parse, unescape
from .values import Dec, Node, Qty, Temporal, civil, days, month_days, root, rounded

LIST = list
SYSTEM = ("Boolean", "String", "Integer", "Long", "Decimal", "Date", "DateTime", "Time", "Quantity")
CALENDAR = {"year": "a", "month": "mo", "week": "wk", "day": "d", "hour": "h", "minute": "min", "second": "s", "millisecond": "ms"}
#: Units that convert within a dimension.
SCALES = {
    **{u: ("time", Fraction(s)) for u, s in (("wk", 604800), ("d", 86400), ("h", 3600), ("min", 60), ("s", 1), ("ms", Fraction(1, 1000)))},
    **{u: ("mass", Fraction(s)) for u, s in (("kg", 1000), ("g", 1), ("mg", Fraction(1, 1000)), ("ug", Fraction(1, 10**6)), ("ng", Fraction(1, 10**9)), ("[lb_av]", Fraction("453.59237")), ("[oz_av]", Fraction("28.349523125")))},
    **{u: ("length", Fraction(s)) for u, s in (("km", 1000), ("m", 1), ("cm", Fraction(1, 100)), ("mm", Fraction(1, 1000)), ("[in_i]", Fraction("0.0254")), ("[ft_i]", Fraction("0.3048")))},
    **{u: ("volume", Fraction(s)) for u, s in (("L", 1), ("dL", Fraction(1, 10)), ("cL", Fraction(1, 100)), ("mL", Fraction(1, 1000)), ("uL", Fraction(1, 10**6)))},
}


@dataclass
class Context:
    registry: Registry = field(default_factory=default)
    variables: dict[str, list] = field(default_factory=dict)
    resolve: Callable[[str], Any] | None = None
    now: datetime = field(default_factory=lambda: datetime.now(UTC))
    resource: list = field(default_factory=list)
    root: list = field(default_factory=list)


@dataclass(frozen=True)
class _Scope:
    this: Any
    index: int | None = None
    total: list | None = None
    variables: dict = field(default_factory=dict)


def evaluate(expression: str, focus: Node | dict | str | list, context: Context | None = None) -> list:
    """The collection that an expression (text) gives for a document, a node or a collection."""
    context = context or Context()
    if isinstance(focus, (dict, str)):
        focus = root(focus, context.registry)
    items = focus if isinstance(focus, list) else [focus]
    context.resource = context.resource or items
    context.root = context.root or context.resource
    return _Run(context).eval(parse(expression), items, _Scope(items))[0]


def plain(v: Any) -> Any:
    return v.system() if isinstance(v, Node) else v


def type_of(v: Any) -> tuple[str, str]:
    if isinstance(v, Node):
        return "FHIR", v.type
    kinds = ((bool, "Boolean"), (str, "String"), (int, "Integer"), (Dec, "Decimal"), (Qty, "Quantity"))
    for k, n in kinds:
        if isinstance(v, k):
            return "System", n
    return "System", {"date": "Date", "datetime": "DateTime", "time": "Time"}[v.kind]


def boolean(c: list) -> bool | None:
    """A collection as a criterion: empty is unknown, a single value that is no boolean is true."""
    if not c:
        return None
    if len(c) > 1:
        raise PathError("a boolean was expected, not several values")
    v = plain(c[0])
    return v if isinstance(v, bool) else True


def single(c: list) -> Any:
    if len(c) > 1:
        raise PathError("one value was expected")
    return plain(c[0]) if c else None


def number(v: Any) -> Fraction | None:
    return Fraction(v) if isinstance(v, int) and not isinstance(v, bool) else v.value if isinstance(v, Dec) else None


def text(v: Any) -> str | None:
    v = plain(v)
    if isinstance(v, bool):
        return "true" if v else "false"
    return None if isinstance(v, Node) else str(v)


def aligned(a: Qty, b: Qty) -> tuple[Fraction, Fraction] | None:
    """Both values in one unit; None if the units differ in kind."""
    ua, ub = (CALENDAR.get(q.unit.rstrip("s"), q.unit) if q.calendar else q.unit for q in (a, b))
    if ua == ub:
        if a.calendar != b.calendar and ua in ("a", "mo"):
            return None
        return a.value.value, b.value.value
    x, y = SCALES.get(ua), SCALES.get(ub)
    return (a.value.value * x[1], b.value.value * y[1]) if x and y and x[0] == y[0] else None


def _utc(t: Temporal) -> tuple:
    """Parts at UTC; values without a zone stay as they are."""
    if t.zone is None or len(t.parts) < 5:
        return t.parts
    y, mo, d, h, mi, *s = t.parts
    minutes = days(y, mo, d) * 1440 + h * 60 + mi - t.zone
    return (*civil(minutes // 1440), minutes % 1440 // 60, minutes % 60, *s)


def order(a: Temporal, b: Temporal) -> int | None:
    """-1, 0 or 1; None where precision or zones leave it open."""
    if (a.kind == "time") != (b.kind == "time"):
        raise PathError("a time is not comparable with a date")
    pa, pb = _utc(a), _utc(b)
    if (a.zone is None) != (b.zone is None) and min(len(pa), len(pb)) > 3:
        return None
    for x, y in zip(pa, pb):
        if x != y:
            return -1 if x < y else 1
    return 0 if len(pa) == len(pb) else None


def equal(a: Any, b: Any) -> bool | None:
    x, y = plain(a), plain(b)
    if isinstance(x, Node) or isinstance(y, Node):
        if not (isinstance(x, Node) and isinstance(y, Node)):
            return False
        return _same(x.data, y.data)
    if number(x) is not None and number(y) is not None:
        return number(x) == number(y)
    if isinstance(x, Temporal) and isinstance(y, Temporal):
        return False if (x.kind == "time") != (y.kind == "time") else None if (o := order(x, y)) is None else o == 0
    if isinstance(x, Qty) and isinstance(y, Qty):
        both = aligned(x, y)
        return None if both is None else both[0] == both[1]
    return type(x) is type(y) and x == y or (isinstance(x, str) and isinstance(y, str) and str(x) == str(y))


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        keys = {k for k in (*a, *b) if k != "id"}
        return all(k in a and k in b and _same(a[k], b[k]) for k in keys)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def equivalent(a: Any, b: Any) -> bool:
    x, y = plain(a), plain(b)
    if isinstance(x, str) and isinstance(y, str):
        norm = lambda s: re.sub(r"\s+", " ", s).strip().lower()
        return norm(x) == norm(y)
    if number(x) is not None and number(y) is not None:
        scales = [v.scale if isinstance(v, Dec) and v.scale is not None else 0 if not isinstance(v, Dec) else 8 for v in (x, y)]
        return rounded(number(x), min(scales)) == rounded(number(y), min(scales))
    if isinstance(x, Temporal) and isinstance(y, Temporal):
        return x.kind == y.kind and order(x, y) == 0
    if isinstance(x, Qty) and isinstance(y, Qty):
        both = aligned(x, y)
        return both is not None and both[0] == both[1]
    if isinstance(x, Node) and isinstance(y, Node):
        kids = lambda n: sorted(n.data) if isinstance(n.data, dict) else None
        if kids(x) is None or kids(x) != kids(y):
            return x.data == y.data
        return all(equivalents(x.kids(k), y.kids(k)) for k in kids(x) if k not in ("id", "resourceType") and not k.startswith("_"))
    return bool(equal(x, y))


def equivalents(a: list, b: list) -> bool:
    left = list(b)
    for x in a:
        k = next((k for k, y in enumerate(left) if equivalent(x, y)), None)
        if k is None:
            return False
        left.pop(k)
    return not left


def has(c: list, v: Any) -> bool:
    return any(equal(x, v) for x in c)


def distinct(c: list) -> list:
    out: list = []
    for x in c:
        if not has(out, x):
            out.append(x)
    return out


def shift(t: Temporal, q: Qty, sign: int) -> Temporal:
    """A date or time moved by a calendar or definite duration."""
    unit = q.unit.rstrip("s") if q.calendar else {v: k for k, v in CALENDAR.items()}.get(q.unit, "")
    if unit not in CALENDAR or not q.calendar and q.unit in ("a", "mo"):
        raise PathError(f"can't move a date by {q}")
    n = q.value.value * sign
    p = list(t.parts)
    if t.kind == "time":
        if unit not in ("hour", "minute", "second", "millisecond"):
            raise PathError(f"can't move a time by {unit}")
        size = {"hour": 3600, "minute": 60, "second": 1, "millisecond": Fraction(1, 1000)}[unit]
        step = n if unit in ("second",) else Fraction(int(n))
        total = (p[0] * 3600 + (p[1] * 60 if len(p) > 1 else 0) + (p[2] if len(p) > 2 else 0) + step * size) % 86400
        whole = [int(total // 3600), int(total % 3600 // 60), total % 60]
        return replace(t, parts=tuple(whole[: len(p)]))
    n = n if unit == "second" else Fraction(int(n))
    if unit in ("year", "month"):
        months = p[0] * 12 + (p[1] - 1 if len(p) > 1 else 0) + int(n) * (12 if unit == "year" else 1)
        p[0] = months // 12
        if len(p) > 1:
            p[1] = months % 12 + 1
        if len(p) > 2:
            p[2] = min(p[2], month_days(p[0], p[1]))
    else:
        need = {"week": 3, "day": 3, "hour": 4, "minute": 5, "second": 6, "millisecond": 6}[unit]
        size = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1, "millisecond": Fraction(1, 1000)}[unit]
        if len(p) < need:
            if len(p) < 3:  # whole days of a month or year
                step = int(n * size // 86400)
                base = days(p[0], p[1] if len(p) > 1 else 1, 1) + step
                return replace(t, parts=civil(base)[: len(p)])
            step = int(n * size / 86400)
            return replace(t, parts=(*civil(days(*p[:3]) + step), *p[3:]))
        full = p + [0] * (6 - len(p))
        total = days(*full[:3]) * 86400 + full[3] * 3600 + full[4] * 60 + full[5] + n * size
        day, rest = int(total // 86400), total % 86400
        p = [*civil(day), int(rest // 3600), int(rest % 3600 // 60), rest % 60][: len(p)]
    if not 1 <= p[0] <= 9999:
        raise PathError("the year leaves its range")
    return replace(t, parts=tuple(p))


class _Run:
    def __init__(self, context: Context):
        self.context, self.registry = context, context.registry

    # every method gives a collection and the variables defined on the way

    def eval(self, n: Any, focus: list, s: _Scope) -> tuple[list, _Scope]:
        if isinstance(n, Literal):
            return self.literal(n), s
        if isinstance(n, Special):
            return self.special(n.name, s), s
        if isinstance(n, Name):
            base, s2 = self.eval(n.base, focus, s) if n.base is not None else (focus, s)
            return self.navigate(base, n.name, n.base is None), s2
        if isinstance(n, Call):
            base, s2 = self.eval(n.base, focus, s) if n.base is not None else (focus, s)
            return self.call(n.name, base, n.args, s2)
        if isinstance(n, Index):
            base, s2 = self.eval(n.base, focus, s)
            at = single(self.eval(n.at, focus, s)[0])
            if at is None:
                return [], s2
            if not isinstance(at, int):
                raise PathError("an index is a whole number")
            return base[at : at + 1] if at >= 0 else [], s2
        if isinstance(n, Unary):
            v = single(self.eval(n.of, focus, s)[0])
            if v is None:
                return [], s
            if number(v) is None and not isinstance(v, Qty):
                raise PathError(f"{n.op} needs a number")
            return [v if n.op == "+" else self.negative(v)], s
        if isinstance(n, TypeTest):
            c = self.eval(n.of, focus, s)[0]
            if n.op == "as":
                return [x for x in c if self.is_type(x, n.type, exact=True)], s
            if len(c) > 1:
                raise PathError("is takes one value")
            return [self.is_type(c[0], n.type)] if c else [], s
        return self.binary(n, focus, s), s

    def value(self, n: Any, s: _Scope) -> list:
        """An argument: evaluated against the enclosing $this."""
        this = s.this if isinstance(s.this, list) else [s.this]
        return self.eval(n, this, s)[0]

    @staticmethod
    def negative(v: Any) -> Any:
        return -v if isinstance(v, int) else Dec(-v.value, v.scale) if isinstance(v, Dec) else Qty(Dec(-v.value.value, v.value.scale), v.unit, v.calendar)

    def literal(self, n: Literal) -> list:
        if n.kind == "empty":
            return []
        if n.kind == "boolean":
            return [n.text == "true"]
        if n.kind == "string":
            return [n.text]
        if n.kind == "long" or n.kind == "number" and "." not in n.text:
            return [int(n.text)]
        if n.kind == "number":
            return [Dec.of(n.text)]
        if n.kind == "quantity":
            return [Qty(Dec.of(n.text), unescape(n.unit[1:-1]), False) if n.unit.startswith("'") else Qty(Dec.of(n.text), n.unit, True)]
        t = Temporal.of(n.text, n.kind)
        if t is None:
            raise PathError(f"not a date or time: @{n.text}")
        return [t]

    def special(self, name: str, s: _Scope) -> list:
        if name == "$this":
            return s.this if isinstance(s.this, list) else [s.this]
        if name == "$index":
            return [] if s.index is None else [s.index]
        if name == "$total":
            return s.total or []
        name = name[1:]
        known = {"resource": self.context.resource, "context": self.context.resource, "rootResource": self.context.root, "ucum": ["http://unitsofmeasure.org"], "sct": ["http://snomed.info/sct"], "loinc": ["http://loinc.org"]}
        if name in s.variables:
            return s.variables[name]
        if name in self.context.variables:
            return self.context.variables[name]
        if name in known:
            return known[name]
        for head, url in (("ext-", "http://hl7.org/fhir/StructureDefinition/"), ("vs-", "http://hl7.org/fhir/ValueSet/")):
            if name.startswith(head):
                return [url + name[len(head) :]]
        raise PathError(f"unknown variable %{name}")

    def navigate(self, c: list, name: str, start: bool) -> list:
        if start and name in self.registry.types and name[:1].isupper():
            return [x for x in c if isinstance(x, Node) and self.registry.is_a(x.type, name)]
        return [k for x in c if isinstance(x, Node) for k in x.kids(name)]

    def is_type(self, v: Any, name: str, exact: bool = False) -> bool:
        space, _, bare = name.rpartition(".")
        have_space, have = type_of(v)
        if space and space not in ("FHIR", "System"):
            raise PathError(f"unknown type {name}")
        if not (bare in SYSTEM or bare in self.registry.types):
            raise PathError(f"unknown type {name}")
        if have_space == "System":
            return space != "FHIR" and have == bare
        if space == "System" or bare in SYSTEM and bare not in self.registry.types:
            return False
        return have == bare if exact else self.registry.is_a(have, bare)

    # operators

    def binary(self, n: Binary, focus: list, s: _Scope) -> list:
        op = n.op
        left = self.eval(n.left, focus, s)[0]
        if op in ("and", "or", "xor", "implies"):
            a = boolean(left)
            if op == "and" and a is False:
                return [False]
            if op == "or" and a is True or op == "implies" and a is False:
                return [True]
            b = boolean(self.eval(n.right, focus, s)[0])
            return self.logic(op, a, b)
        right = self.eval(n.right, focus, s)[0]
        if op == "|":
            return distinct([*left, *right])
        if op in ("in", "contains"):
            needle, hay = (left, right) if op == "in" else (right, left)
            if len(needle) > 1:
                raise PathError(f"{op} takes one value")
            return [has(hay, needle[0])] if needle else []
        if op in ("=", "!="):
            if not left or not right:
                return []
            if len(left) != len(right):
                return [op == "!="]
            same = [equal(a, b) for a, b in zip(left, right)]
            if False in same:
                return [op == "!="]
            return [] if None in same else [op == "="]
        if op in ("~", "!~"):
            return [equivalents(left, right) == (op == "~")]
        if op == "&":
            return [(text(single(left)) or "" if left else "") + (text(single(right)) or "" if right else "")]
        a, b = single(left), single(right)
        if a is None or b is None:
            return []
        return self.compare(op, a, b) if op in ("<", "<=", ">", ">=") else self.arithmetic(op, a, b)

    @staticmethod
    def logic(op: str, a: bool | None, b: bool | None) -> list:
        if op == "and":
            out = False if b is False else None if None in (a, b) else True
        elif op == "or":
            out = True if b is True else None if None in (a, b) else False
        elif op == "xor":
            out = None if None in (a, b) else a != b
        else:
            out = b if a is True else True if b is True else None
        return [] if out is None else [out]

    @staticmethod
    def compare(op: str, a: Any, b: Any) -> list:
        if isinstance(a, str) and isinstance(b, str):
            o: int | None = (str(a) > str(b)) - (str(a) < str(b))
        elif number(a) is not None and number(b) is not None:
            o = (number(a) > number(b)) - (number(a) < number(b))
        elif isinstance(a, Temporal) and isinstance(b, Temporal):
            o = order(a, b)
        elif isinstance(a, Qty) and isinstance(b, Qty):
            both = aligned(a, b)
            o = None if both is None else (both[0] > both[1]) - (both[0] < both[1])
        else:
            raise PathError(f"{type_of(a)[1]} and {type_of(b)[1]} are not comparable")
        return [] if o is None else [{"<": o < 0, "<=": o <= 0, ">": o > 0, ">=": o >= 0}[op]]

    @staticmethod
    def arithmetic(op: str, a: Any, b: Any) -> list:
        if isinstance(a, str) and isinstance(b, str) and op == "+":
            return [a + b]
        if isinstance(a, Temporal) and op in "+-":
            if not isinstance(b, Qty):
                raise PathError("a date moves by a duration")
            return [shift(a, b, 1 if op == "+" else -1)]
        x, y = number(a), number(b)
        if isinstance(a, Qty) or isinstance(b, Qty):
            if isinstance(a, Qty) and isinstance(b, Qty):
                if op in "+-":
                    both = aligned(a, b)
                    if both is None:
                        return []
                    if a.unit == b.unit:
                        return [Qty(Dec(both[0] + both[1] if op == "+" else both[0] - both[1]), a.unit, a.calendar)]
                    base = SCALES.get(a.unit, ("", Fraction(1)))[1]
                    return [Qty(Dec((both[0] + both[1] if op == "+" else both[0] - both[1]) / base), a.unit, a.calendar)]
                if op == "/":
                    both = aligned(a, b)
                    if b.value.value == 0:
                        return []
                    return [Qty(Dec(both[0] / both[1]), "1")] if both else [Qty(Dec(a.value.value / b.value.value), f"{a.unit}/{b.unit}")]
                if op == "*":
                    return [Qty(Dec(a.value.value * b.value.value), a.unit if b.unit == "1" else b.unit if a.unit == "1" else f"{a.unit}.{b.unit}")]
            elif op == "*" and (x if x is not None else y) is not None:
                q = a if isinstance(a, Qty) else b
                return [Qty(Dec(q.value.value * (x if x is not None else y)), q.unit, q.calendar)]
            elif op == "/" and isinstance(a, Qty) and y is not None:
                return [Qty(Dec(a.value.value / y), a.unit, a.calendar)] if y else []
            raise PathError(f"{op} doesn't take these quantities")
        if x is None or y is None:
            raise PathError(f"{op} needs numbers")
        whole = isinstance(a, int) and isinstance(b, int)
        if op in ("/", "div", "mod") and y == 0:
            return []
        if op == "/":
            return [Dec(x / y)]
        if op == "div":
            return [int(x / y)]
        if op == "mod":
            r = x - y * int(x / y)
        else:
            r = x + y if op == "+" else x - y if op == "-" else x * y
        return [int(r)] if whole else [Dec(r)]

    # functions

    def call(self, name: str, c: list, args: tuple, s: _Scope) -> tuple[list, _Scope]:
        lazy = getattr(self, f"f_{name}", None)
        if lazy:
            out = lazy(c, args, s)
            return out if isinstance(out, tuple) else (out, s)
        f = EAGER.get(name)
        if f is None:
            raise PathError(f"unknown function {name}")
        low, high, body = f
        if not low <= len(args) <= high:
            raise PathError(f"{name} takes {low}" + (f" to {high}" if high > low else "") + " arguments")
        return body(self, c, *[self.value(a, s) for a in args]), s

    def each(self, c: list, n: Any, s: _Scope):
        for k, x in enumerate(c):
            yield x, self.eval(n, [x], replace(s, this=x, index=k))[0]

    def arg(self, args: tuple, low: int, high: int, name: str) -> None:
        if not low <= len(args) <= high:
            raise PathError(f"{name} takes {low} to {high} arguments")

    def f_where(self, c, args, s):
        self.arg(args, 1, 1, "where")
        return [x for x, r in self.each(c, args[0], s) if len(r) == 1 and boolean(r)]

    def f_select(self, c, args, s):
        self.arg(args, 1, 1, "select")
        return [y for _, r in self.each(c, args[0], s) for y in r]

    def f_all(self, c, args, s):
        if not args:
            return EAGER["allTrue"][2](self, c)
        return [all(len(r) == 1 and boolean(r) is True for _, r in self.each(c, args[0], s))]

    def f_exists(self, c, args, s):
        return [bool(self.f_where(c, args, s) if args else c)]

    def f_repeat(self, c, args, s):
        self.arg(args, 1, 1, "repeat")
        out, front = [], c
        for _ in range(1000):
            found = [y for _, r in self.each(front, args[0], s) for y in r]
            front = []
            for y in found:
                if not has(out, y):
                    out.append(y)
                    front.append(y)
            if not front:
                return out
        raise PathError("repeat doesn't end")

    def f_aggregate(self, c, args, s):
        self.arg(args, 1, 2, "aggregate")
        total = self.value(args[1], s) if len(args) > 1 else []
        for k, x in enumerate(c):
            total = self.eval(args[0], [x], replace(s, this=x, index=k, total=total))[0]
        return total

    def f_iif(self, c, args, s):
        self.arg(args, 2, 3, "iif")
        if len(c) > 1:
            raise PathError("iif takes one value")
        inner = replace(s, this=c[0]) if c else s
        test = self.eval(args[0], c, inner)[0]
        if test and not isinstance(single(test), bool):
            raise PathError("iif needs a boolean")
        if test and single(test):
            return self.eval(args[1], c, inner)[0]
        return self.eval(args[2], c, inner)[0] if len(args) > 2 else []

    def f_defineVariable(self, c, args, s):  # noqa: N802
        self.arg(args, 1, 2, "defineVariable")
        name = single(self.value(args[0], s))
        if name in s.variables or name in self.context.variables or name in ("resource", "context", "rootResource", "ucum", "sct", "loinc"):
            raise PathError(f"%{name} is defined already")
        value = self.eval(args[1], c, replace(s, this=c))[0] if len(args) > 1 else c
        return c, replace(s, variables={**s.variables, name: value})

    def f_trace(self, c, args, s):
        self.arg(args, 1, 2, "trace")
        return c

    def f_sort(self, c, args, s):
        keys = [(a.of, True) if isinstance(a, Unary) and a.op == "-" else (a, False) for a in args] or [(Special("$this"), False)]
        import functools

        def of(x, n):
            r = self.eval(n, [x], replace(s, this=x))[0]
            return single(r)

        rows = [(x, [of(x, n) for n, _ in keys]) for x in c]

        def cmp(a, b):
            for (_, down), x, y in zip(keys, a[1], b[1]):
                if x is None or y is None:
                    if (x is None) != (y is None):
                        return -1 if x is None else 1
                    continue
                if self.compare("<", x, y) == [True]:
                    return 1 if down else -1
                if self.compare(">", x, y) == [True]:
                    return -1 if down else 1
            return 0

        return [x for x, _ in sorted(rows, key=functools.cmp_to_key(cmp))]

    @staticmethod
    def type_name(n: Any) -> str:
        return f"{n.base.name}.{n.name}" if isinstance(n, Name) and isinstance(n.base, Name) else n.name if isinstance(n, Name) else n.text if isinstance(n, Literal) else ""

    def f_ofType(self, c, args, s):  # noqa: N802
        self.arg(args, 1, 1, "ofType")
        return [x for x in c if self.is_type(x, self.type_name(args[0]), exact=True)]

    def f_is(self, c, args, s):
        self.arg(args, 1, 1, "is")
        single(c)
        return [self.is_type(c[0], self.type_name(args[0]))] if c else []

    def f_as(self, c, args, s):
        self.arg(args, 1, 1, "as")
        single(c)
        return [x for x in c if self.is_type(x, self.type_name(args[0]), exact=True)]


def _bools(c: list) -> list[bool]:
    out = [plain(x) for x in c]
    if not all(isinstance(x, bool) for x in out):
        raise PathError("booleans were expected")
    return out


def _string(f: Callable[..., Any]) -> Callable[..., list]:
    """A function of one string and non-empty arguments."""

    def run(self, c: list, *args: list) -> list:
        v = single(c)
        got = [single(a) for a in args]
        if v is None or any(a is None for a in got):
            return []
        if not isinstance(v, str):
            raise PathError("a string was expected")
        out = f(v, *got)
        return [] if out is None else out if isinstance(out, LIST) else [out]

    return run


def _numeric(f: Callable[..., Any]) -> Callable[..., list]:
    def run(self, c: list, *args: list) -> list:
        v = single(c)
        got = [single(a) for a in args]
        if v is None or any(a is None for a in got):
            return []
        if number(v) is None and not isinstance(v, Qty):
            raise PathError("a number was expected")
        try:
            out = f(v, *got)
        except (ValueError, OverflowError, ZeroDivisionError):
            return []
        return [] if out is None else [out]

    return run


def _real(x: float) -> Dec | None:
    return Dec(Fraction(repr(x)) if math.isfinite(x) else Fraction(0)) if math.isfinite(x) else None


def _float(v: Any) -> float:
    return float(number(v))


def _whole(f: Callable[[Fraction], int]) -> Callable[..., list]:
    return _numeric(lambda v: Qty(Dec(Fraction(f(v.value.value))), v.unit, v.calendar) if isinstance(v, Qty) else f(number(v)))


def _round(v: Any, digits: int = 0) -> Any:
    if digits < 0:
        raise PathError("round takes no negative digits")
    return Dec(Fraction(rounded(number(v), digits)), digits)


def _power(v: Any, e: Any) -> Any:
    if isinstance(v, int) and isinstance(e, int) and e >= 0:
        return v**e
    if number(e).denominator == 1 and (number(v) or e >= 0):
        return Dec(number(v) ** int(number(e)))
    out = _float(v) ** _float(e)
    return None if isinstance(out, complex) else _real(out)


def _substring(v: str, start: int, n: int | None = None) -> str | None:
    if not 0 <= start < len(v):
        return None
    return v[start:] if n is None else v[start : start + max(0, n)]


def _regex(pattern: str, flags: str = "") -> re.Pattern:
    try:
        return re.compile(pattern, re.S | (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))
    except re.error as e:
        raise PathError(f"bad expression {pattern!r}: {e}") from None


def _replace_matches(v: str, pattern: str, by: str) -> str:
    return v if not pattern else _regex(pattern).sub(re.sub(r"\$(\d+)", r"\\g<\1>", by.replace("\\", "\\\\")), v)


def _encode(v: str, how: str) -> str | None:
    raw = v.encode()
    return {"base64": lambda: base64.b64encode(raw).decode(), "urlbase64": lambda: base64.urlsafe_b64encode(raw).decode(), "base64url": lambda: base64.urlsafe_b64encode(raw).decode(), "hex": raw.hex}.get(how, lambda: None)()


def _decode(v: str, how: str) -> str | None:
    try:
        if how == "hex":
            return bytes.fromhex(v).decode()
        if how in ("base64", "urlbase64", "base64url"):
            return base64.b64decode(v, altchars=None if how == "base64" else b"-_", validate=True).decode()
    except ValueError:
        pass
    return None


def _escape(v: str, how: str) -> str | None:
    return html.escape(v) if how == "html" else json.dumps(v, ensure_ascii=False)[1:-1] if how == "json" else None


def _unescape(v: str, how: str) -> str | None:
    if how == "json":
        try:
            return json.loads(f'"{v}"')
        except ValueError:
            return None
    return html.unescape(v) if how == "html" else None


TRUE, FALSE = ("true", "t", "yes", "y", "1", "1.0"), ("false", "f", "no", "n", "0", "0.0")


def to_boolean(v: Any) -> Any:
    if isinstance(v, bool):
        return v
    if isinstance(v, str):
        return True if v.lower() in TRUE else False if v.lower() in FALSE else None
    return {1: True, 0: False}.get(number(v)) if number(v) is not None else None


def to_integer(v: Any) -> Any:
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return int(v) if isinstance(v, str) and re.fullmatch(r"[+-]?\d{1,19}", v) and -(2**63) <= int(v) < 2**63 else None


def to_decimal(v: Any) -> Any:
    if isinstance(v, bool):
        return Dec(Fraction(int(v)), 1)
    if isinstance(v, int):
        return Dec(Fraction(v), 0)
    return v if isinstance(v, Dec) else Dec.of(v) if isinstance(v, str) and re.fullmatch(r"[+-]?\d+(\.\d+)?", v) else None


def to_temporal(kind: str) -> Callable[[Any], Any]:
    def f(v: Any) -> Any:
        if isinstance(v, str):
            v = Temporal.of(v, "time") if kind == "time" else Temporal.of(v)
        if not isinstance(v, Temporal) or (v.kind == "time") != (kind == "time"):
            return None
        if kind == "date":
            return Temporal("date", v.parts[:3])
        return replace(v, kind=kind)

    return f


def to_quantity(v: Any) -> Any:
    if isinstance(v, Qty):
        return v
    if isinstance(v, bool):
        return Qty(Dec(Fraction(int(v)), 1), "1")
    if number(v) is not None:
        return Qty(v if isinstance(v, Dec) else Dec(Fraction(v), 0), "1")
    m = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(?:'([^']+)'|([a-zA-Z]+))?", v) if isinstance(v, str) else None
    if not m or m[3] and m[3].rstrip("s") not in CALENDAR:
        return None
    return Qty(Dec.of(m[1]), m[2] or m[3] or "1", bool(m[3]))


def _convert(f: Callable[[Any], Any], test: bool) -> Callable[..., list]:
    def run(self, c: list) -> list:
        if not c:
            return []
        out = f(single(c))
        return [out is not None] if test else [] if out is None else [out]

    return run


def _boundary(high: bool) -> Callable[..., list]:
    def run(self, c: list, digits: list | None = None) -> list:
        v = single(c)
        if v is None:
            return []
        n = single(digits) if digits is not None else None
        if isinstance(v, int) and not isinstance(v, bool):
            v = Dec(Fraction(v), 0)
        if isinstance(v, Qty):
            inner = run(self, [v.value], digits)
            return [Qty(inner[0], v.unit, v.calendar)] if inner else []
        if isinstance(v, Dec):
            n = 8 if n is None else n
            if not 0 <= n <= 28:
                return []
            half = Fraction(1, 2 * 10 ** (v.scale if v.scale is not None else 8))
            edge = (v.value + half if high else v.value - half) * 10**n
            return [Dec(Fraction(math.floor(edge) if not high else math.ceil(edge)) / 10**n, n)]
        if isinstance(v, Temporal):
            return _temporal_boundary(v, n, high)
        raise PathError("no boundary of this type")

    return run


def _temporal_boundary(v: Temporal, n: int | None, high: bool) -> list:
    sizes = {"date": (4, 6, 8), "time": (2, 4, 9), "datetime": (4, 6, 8, 10, 12, 17)}[v.kind]
    n = sizes[-1] if n is None else n
    if n not in sizes:
        return []
    want, p = sizes.index(n) + 1, list(v.parts)
    start = 0 if v.kind == "time" else 3
    while len(p) < (3 if v.kind != "datetime" else 6):
        k = len(p)
        if v.kind != "time" and k < 3:
            p.append((12 if high else 1) if k == 1 else (month_days(p[0], p[1]) if high else 1))
        else:
            p.append(((23, 59, Fraction(59999, 1000))[k - start] if high else (0, 0, Fraction(0))[k - start]))
    if len(v.parts) == len(p) and not v.fine and v.kind != "date" and high:
        p[-1] += Fraction(999, 1000)
    zone = v.zone
    if v.kind == "datetime" and zone is None and want > 3:
        zone = -12 * 60 if high else 14 * 60
    return [Temporal(v.kind, tuple(p[:want]), zone if v.kind == "datetime" and want > 3 else None, want == len(sizes) and v.kind != "date")]


def _precision(self, c: list) -> list:
    v = single(c)
    if isinstance(v, int) and not isinstance(v, bool):
        return [0]
    if isinstance(v, Dec):
        return [v.scale if v.scale is not None else len(str(v).partition(".")[2])]
    if isinstance(v, Temporal):
        return [(((2, 4, 9) if v.fine else (2, 4, 6)) if v.kind == "time" else (4, 6, 8, 10, 12, 17 if v.fine else 14))[len(v.parts) - 1]]
    return []


def _descend(self, c: list) -> list:
    out, front = [], [k for x in c if isinstance(x, Node) for k in x.kids()]
    for _ in range(100):
        if not front:
            return out
        out += front
        front = [k for x in front for k in x.kids()]
    return out


def _resolve(self, c: list) -> list:
    out = []
    for x in c:
        ref = x.data.get("reference") if isinstance(x, Node) and isinstance(x.data, dict) else plain(x)
        if isinstance(ref, str) and self.context.resolve:
            got = self.context.resolve(ref)
            if got is not None:
                out.append(got)
    return out


def _type(self, c: list) -> list:
    return [Node({"namespace": a, "name": b}, "TypeInfo", ("TypeInfo", ""), self.registry) for a, b in map(type_of, c)]


def _conforms(self, c: list, url: list) -> list:
    v = single(url)
    if not c or v is None:
        return []
    name = str(v).rpartition("/StructureDefinition/")[2]
    if name not in self.registry.types:
        raise PathError(f"unknown profile {v}")
    return [isinstance(c[0], Node) and self.registry.is_a(c[0].type, name)]


def _count_arg(a: list) -> int:
    n = single(a)
    if not isinstance(n, int):
        raise PathError("a whole number was expected")
    return n


def _comparable(self, c: list, other: list) -> list:
    a, b = single(c), single(other)
    return [aligned(a, b) is not None] if isinstance(a, Qty) and isinstance(b, Qty) else []


def _not(self, c: list) -> list:
    v = boolean(c)
    return [] if v is None else [not v]


def _single(self, c: list) -> list:
    if len(c) > 1:
        raise PathError("single() met several values")
    return c


def _join(self, c: list, sep: list | None = None) -> list:
    return [(single(sep) if sep else "").join(text(x) or "" for x in c)] if c else []


def _now(kind: str) -> Callable[..., list]:
    def run(self, c: list) -> list:
        t = self.context.now
        if kind == "date":
            return [Temporal("date", (t.year, t.month, t.day))]
        clock = (t.hour, t.minute, Fraction(t.second) + Fraction(t.microsecond // 1000, 1000))
        if kind == "time":
            return [Temporal("time", clock, None, True)]
        return [Temporal("datetime", (t.year, t.month, t.day, *clock), int((t.utcoffset().total_seconds() if t.tzinfo else 0) // 60), True)]

    return run


#: name -> least and most arguments, body
EAGER: dict[str, tuple[int, int, Callable[..., list]]] = {
    "empty": (0, 0, lambda s, c: [not c]), "count": (0, 0, lambda s, c: [len(c)]), "distinct": (0, 0, lambda s, c: distinct(c)), "isDistinct": (0, 0, lambda s, c: [len(distinct(c)) == len(c)]),
    "allTrue": (0, 0, lambda s, c: [all(_bools(c))]), "anyTrue": (0, 0, lambda s, c: [any(_bools(c))]), "allFalse": (0, 0, lambda s, c: [not any(_bools(c))]), "anyFalse": (0, 0, lambda s, c: [not all(_bools(c))]),
    "subsetOf": (1, 1, lambda s, c, o: [all(has(o, x) for x in c)]), "supersetOf": (1, 1, lambda s, c, o: [all(has(c, x) for x in o)]),
    "single": (0, 0, _single), "first": (0, 0, lambda s, c: c[:1]), "last": (0, 0, lambda s, c: c[-1:]), "tail": (0, 0, lambda s, c: c[1:]),
    "skip": (1, 1, lambda s, c, n: c[max(0, _count_arg(n)) :]), "take": (1, 1, lambda s, c, n: c[: max(0, _count_arg(n))]),
    "intersect": (1, 1, lambda s, c, o: distinct([x for x in c if has(o, x)])), "exclude": (1, 1, lambda s, c, o: [x for x in c if not has(o, x)]),
    "union": (1, 1, lambda s, c, o: distinct([*c, *o])), "combine": (1, 2, lambda s, c, o, _=None: [*c, *o]),
    "children": (0, 0, lambda s, c: [k for x in c if isinstance(x, Node) for k in x.kids()]), "descendants": (0, 0, _descend),
    "extension": (1, 1, lambda s, c, u: [k for x in c if isinstance(x, Node) for k in x.kids("extension") if isinstance(k.data, dict) and k.data.get("url") == single(u)]),
    "hasValue": (0, 0, lambda s, c: [len(c) == 1 and (not isinstance(c[0], Node) or c[0].primitive and c[0].data is not None)]),
    "getValue": (0, 0, lambda s, c: [plain(c[0])] if len(c) == 1 and not isinstance(plain(c[0]), Node) else []),
    "resolve": (0, 0, _resolve), "conformsTo": (1, 1, _conforms), "precision": (0, 0, _precision), "type": (0, 0, _type), "comparable": (1, 1, _comparable), "not": (0, 0, _not),
    "lowBoundary": (0, 1, _boundary(False)), "highBoundary": (0, 1, _boundary(True)),
    **{f"{a}{n}": (0, 0, _convert(f, a == "convertsTo")) for a in ("to", "convertsTo") for n, f in (("String", text), ("Boolean", to_boolean), ("Integer", to_integer), ("Decimal", to_decimal), ("Date", to_temporal("date")), ("DateTime", to_temporal("datetime")), ("Time", to_temporal("time")), ("Quantity", to_quantity))},
    "length": (0, 0, _string(len)), "upper": (0, 0, _string(str.upper)), "lower": (0, 0, _string(str.lower)), "trim": (0, 0, _string(str.strip)), "toChars": (0, 0, _string(list)),
    "startsWith": (1, 1, _string(lambda v, a: v.startswith(a))), "endsWith": (1, 1, _string(lambda v, a: v.endswith(a))), "contains": (1, 1, _string(lambda v, a: a in v)), "indexOf": (1, 1, _string(lambda v, a: v.find(a))), "lastIndexOf": (1, 1, _string(lambda v, a: v.rfind(a))),
    "substring": (1, 2, _string(_substring)), "replace": (2, 2, _string(lambda v, a, b: v.replace(a, b))), "matches": (1, 2, _string(lambda v, p, f="": bool(_regex(p, f).search(v)))), "matchesFull": (1, 2, _string(lambda v, p, f="": bool(_regex(p, f).fullmatch(v)))),
    "replaceMatches": (2, 2, _string(_replace_matches)), "split": (1, 1, _string(lambda v, a: v.split(a) if a else list(v))), "join": (0, 1, _join),
    "encode": (1, 1, _string(_encode)), "decode": (1, 1, _string(_decode)), "escape": (1, 1, _string(_escape)), "unescape": (1, 1, _string(_unescape)),
    "abs": (0, 0, _numeric(lambda v: Qty(Dec(abs(v.value.value), v.value.scale), v.unit, v.calendar) if isinstance(v, Qty) else abs(v) if isinstance(v, int) else Dec(abs(v.value), v.scale))),
    "ceiling": (0, 0, _whole(math.ceil)), "floor": (0, 0, _whole(math.floor)), "truncate": (0, 0, _whole(math.trunc)), "round": (0, 1, _numeric(_round)),
    "sqrt": (0, 0, _numeric(lambda v: _real(math.sqrt(_float(v))))), "exp": (0, 0, _numeric(lambda v: _real(math.exp(_float(v))))), "ln": (0, 0, _numeric(lambda v: _real(math.log(_float(v))))), "log": (1, 1, _numeric(lambda v, b: _real(math.log(_float(v), _float(b))))), "power": (1, 1, _numeric(_power)),
    "now": (0, 0, _now("datetime")), "today": (0, 0, _now("date")), "timeOfDay": (0, 0, _now("time")),
}
