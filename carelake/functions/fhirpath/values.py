"""Values of path expressions: decimals with their written scale, partial dates, quantities, document nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Context, Decimal
from fractions import Fraction
from typing import Any

from ...errors import PathError
from ...registry import QUANTITIES, Registry


@dataclass(frozen=True)
class Dec:
    value: Fraction
    scale: int | None = None  # written decimals; None if computed

    @staticmethod
    def of(text: str) -> Dec:
        d = Decimal(text)
        return Dec(Fraction(d), max(0, -d.as_tuple().exponent))

    def __str__(self) -> str:
        if self.scale is not None:
            return f"{rounded(self.value, self.scale):.{self.scale}f}"
        den = self.value.denominator
        for p in (2, 5):
            while den % p == 0:
                den //= p
        d = Context(prec=60).divide(Decimal(self.value.numerator), Decimal(self.value.denominator)) if den == 1 else rounded(self.value, 8)
        out = f"{d:f}"
        return out.rstrip("0").rstrip(".") if "." in out else out


def rounded(x: Fraction, digits: int) -> Decimal:
    """Half away from zero."""
    scaled = abs(x) * 10**digits
    n = int(scaled + Fraction(1, 2))
    return Decimal(-n if x < 0 else n).scaleb(-digits, Context(prec=80))


_FORM = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d))?)?(T(?:(\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?)?(Z|[+-]\d\d:\d\d)?)?")
_TIME = re.compile(r"T?(\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?")


@dataclass(frozen=True)
class Temporal:
    """parts are year to second (time: hour to second); seconds hold milliseconds as a fraction."""

    kind: str  # date, datetime or time
    parts: tuple
    zone: int | None = None  # minutes
    fine: bool = False  # whether milliseconds were written

    @staticmethod
    def of(text: str, kind: str | None = None) -> Temporal | None:
        if kind == "time" or text.startswith("T"):
            m = _TIME.fullmatch(text)
            if not m:
                return None
            h, mi, s, f = m.groups()
            parts = [int(h)] + ([int(mi)] if mi else []) + ([Fraction(int(s)) + Fraction(int((f or "0").ljust(3, "0")[:3]), 1000)] if s else [])
            out = Temporal("time", tuple(parts), None, f is not None)
        else:
            m = _FORM.fullmatch(text)
            if not m:
                return None
            y, mo, d, clock, h, mi, s, f, z = m.groups()
            parts = [int(y)] + ([int(mo)] if mo else []) + ([int(d)] if d else []) + ([int(h)] if h else []) + ([int(mi)] if mi else []) + ([Fraction(int(s)) + Fraction(int((f or "0").ljust(3, "0")[:3]), 1000)] if s else [])
            if h and not d:
                return None
            zone = None if z is None else 0 if z == "Z" else (1 if z[0] == "+" else -1) * (int(z[1:3]) * 60 + int(z[4:]))
            out = Temporal("datetime" if clock or kind == "datetime" else "date", tuple(parts), zone, f is not None)
        return out if out.valid() else None

    def valid(self) -> bool:
        p = self.parts
        if self.kind == "time":
            return p[0] < 24 and (len(p) < 2 or p[1] < 60) and (len(p) < 3 or p[2] < 60)
        return p[0] > 0 and (len(p) < 2 or 1 <= p[1] <= 12) and (len(p) < 3 or 1 <= p[2] <= month_days(p[0], p[1])) and (len(p) < 4 or p[3] < 24) and (len(p) < 5 or p[4] < 60) and (len(p) < 6 or p[5] < 61)

    def __str__(self) -> str:
        p = self.parts
        sec = lambda s: f"{int(s):02d}" + (f".{int((s % 1) * 1000):03d}" if self.fine else "")
        clock = ":".join([f"{x:02d}" for x in p[(0 if self.kind == "time" else 3) :][:2]] + [sec(s) for s in p[(2 if self.kind == "time" else 5) :]])
        if self.kind == "time":
            return clock
        day = "-".join([f"{p[0]:04d}", *[f"{x:02d}" for x in p[1:3]]])
        zone = "" if self.zone is None else "Z" if self.zone == 0 else f"{'+' if self.zone > 0 else '-'}{abs(self.zone) // 60:02d}:{abs(self.zone) % 60:02d}"
        return day + (f"T{clock}{zone}" if self.kind == "datetime" and (clock or zone) else "T" if self.kind == "datetime" and len(p) < 3 else "")


def month_days(y: int, m: int) -> int:
    return 29 if m == 2 and (y % 4 == 0 and y % 100 != 0 or y % 400 == 0) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def days(y: int, m: int, d: int) -> int:
    """Days from the civil date 0000-03-01."""
    y -= m <= 2
    return y * 365 + y // 4 - y // 100 + y // 400 + (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1


def civil(n: int) -> tuple[int, int, int]:
    y = (10000 * n + 14780) // 3652425
    left = n - (365 * y + y // 4 - y // 100 + y // 400)
    if left < 0:
        y -= 1
        left = n - (365 * y + y // 4 - y // 100 + y // 400)
    m = (100 * left + 52) // 3060
    return y + (m + 2) // 12, (m + 2) % 12 + 1, left - (m * 306 + 5) // 10 + 1


@dataclass(frozen=True)
class Qty:
    value: Dec
    unit: str
    calendar: bool = False

    def __str__(self) -> str:
        return f"{self.value} {self.unit}" if self.calendar else f"{self.value} '{self.unit}'"


@dataclass
class Node:
    """A part of a document: its JSON, its type, where its elements are defined, and its sidecar of extensions."""

    data: Any
    type: str
    owner: tuple[str, str]
    registry: Registry
    side: dict | None = None

    def kids(self, name: str | None = None) -> list[Node]:
        sources = [x for x in (self.data, self.side) if isinstance(x, dict)]
        out: list[Node] = []
        for d in sources:
            names = [name] if name else [k for k in d if k != "resourceType" and not k.startswith("_")] + [k[1:] for k in d if k.startswith("_") and k[1:] not in d]
            for n in names:
                out += self._member(d, n)
        return out

    def _member(self, d: dict, name: str) -> list[Node]:
        found = name if name in d or f"_{name}" in d else None
        if found is None:
            kid = self.registry.children(*self.owner).get(f"{name}[x]")
            for t in kid.types if kid else ():
                full = name + t[0].upper() + t[1:]
                if full in d or f"_{full}" in d:
                    found = full
                    break
        if found is None:
            return []
        step = self.registry.step(*self.owner, found)
        type_, owner = (step[1], (step[2], step[3])) if step else ("Element", ("Element", ""))
        value, side = d.get(found), d.get(f"_{found}")
        values = value if isinstance(value, list) else [value]
        sides = side if isinstance(side, list) else [side]
        out = []
        for k in range(max(len(values), len(sides))):
            v, s = values[k] if k < len(values) else None, sides[k] if k < len(sides) else None
            if v is None and s is None:
                continue
            if isinstance(v, dict) and "resourceType" in v:
                out.append(Node(v, v["resourceType"], (v["resourceType"], ""), self.registry))
            else:
                out.append(Node(v, type_, owner, self.registry, s if isinstance(s, dict) else None))
        return out

    @property
    def primitive(self) -> bool:
        return self.type in self.registry.types and self.registry.types[self.type].kind == "primitive"

    def system(self) -> Any:
        """The System value of a primitive or a quantity; else the node itself."""
        v, t = self.data, self.type
        if t in QUANTITIES and isinstance(v, dict):
            return quantity_of(v) or self
        if not self.primitive or v is None:
            return self
        if t == "boolean":
            return v if isinstance(v, bool) else str(v)
        if t in ("integer", "positiveInt", "unsignedInt", "integer64"):
            try:
                return int(str(v))
            except ValueError:
                return str(v)
        if t == "decimal":
            try:
                return Dec.of(str(v))
            except ArithmeticError:
                return str(v)
        if t in ("date", "dateTime", "instant", "time"):
            return Temporal.of(str(v), {"date": "date", "time": "time"}.get(t, "datetime")) or str(v)
        return str(v)


def quantity_of(d: dict) -> Qty | None:
    if d.get("value") is None or d.get("comparator"):
        return None
    return Qty(Dec.of(str(d["value"])), d.get("code") or d.get("unit") or "1")


class Number(str):
    """A JSON number by its written text."""


def parse_json(text: str) -> Any:
    """JSON with numbers kept as written."""
    import json

    return json.loads(text, parse_float=Number, parse_int=Number)


def root(doc: dict | str, registry: Registry) -> Node:
    d = parse_json(doc) if isinstance(doc, str) else doc
    if not isinstance(d, dict) or d.get("resourceType") not in registry.types:
        raise PathError("not a resource of a known type")
    return Node(d, d["resourceType"], (d["resourceType"], ""), registry)


def split_reference(text: str) -> tuple[str, str, str]:
    """Type, id and the reference as written; fragments keep no type, versions are dropped."""
    if text.startswith("#"):
        return "", text, text
    parts = re.sub(r"/_history/[^/]*$", "", text).rstrip("/").split("/")
    if len(parts) >= 2 and re.fullmatch(r"[A-Z]\w*", parts[-2]):
        return parts[-2], parts[-1], text
    return "", "", text


def named(ref: str, registry: Registry) -> Node | None:
    """Stands for what a reference names, of which only type and id are known; none of an unknown type."""
    kind, id_, _ = split_reference(ref)
    return Node({"resourceType": kind, "id": id_}, kind, (kind, ""), registry) if kind in registry.types else None
