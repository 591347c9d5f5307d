"""Search parameters as columns: index rows from documents without Python, where a parameter's expression is a plain path.

A path is a chain of members, where(url = '...'), where(resolve() is Type), ofType()
and unions of these. Only the members that a parameter names are parsed from the
text, and numbers are quoted before where their written form counts. What is no plain path raises Unsupported,
and the interpreter takes the parameter.

Documents that break their type's structure (an object where a list belongs, two
alternatives of a choice) give the rows of those members that can be read.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fhirpath.compile import Unsupported
from ..functions.fhirpath.parser import Binary, Call, Literal, Name, TypeTest, parse
from ..functions.folding import folded
from ..registry import QUANTITIES, Param, Registry
from ..schemas import FIRST, LAST

_CODING = {"system": "string", "code": "string", "display": "string"}


def _struct(fields: dict[str, str]) -> str:
    return f"struct<{','.join(f'`{k}`:{v}' for k, v in fields.items())}>"


_CONCEPT = {"coding": f"array<{_struct(_CODING)}>", "text": "string"}
#: What is parsed of the datatypes that give index rows.
WHOLE: dict[str, dict[str, str]] = {
    "CodeableConcept": _CONCEPT, "Coding": _CODING, "Identifier": {"system": "string", "value": "string", "type": _struct(_CONCEPT)}, "ContactPoint": {"system": "string", "value": "string"},
    "HumanName": {"family": "string", "given": "array<string>", "prefix": "array<string>", "suffix": "array<string>", "text": "string"},
    "Address": {"line": "array<string>", **dict.fromkeys(("city", "district", "state", "postalCode", "country", "text"), "string")},
    "Reference": {"reference": "string", "identifier": _struct({"system": "string", "value": "string"})}, "Period": {"start": "string", "end": "string"}, "Timing": {"event": "array<string>"},
    **dict.fromkeys(QUANTITIES, {"value": "string", "system": "string", "code": "string", "unit": "string"}),
}
ROW = "array<struct<tab:string,code:string,seq:int,a:string,b:string,c:string,low:bigint,high:bigint,x:double,y:double>>"


@dataclass
class _Member:
    """A member of the parsed text."""

    type: str
    many: bool = False
    whole: bool = False
    kids: dict[str, _Member] = field(default_factory=dict)

    def schema(self) -> str:
        own, kids = WHOLE.get(self.type, {}) if self.whole else {}, {k: v.schema() for k, v in self.kids.items()}
        if any(own.get(k, v) != v for k, v in kids.items()):
            raise Unsupported("a value is used as a whole and otherwise in parts")
        inner = _struct(own | kids) if own or kids else "string"
        return f"array<{inner}>" if self.many else inner


@dataclass
class _Items:
    """A collection: its type, where that is defined, its member and an array column over an outer value."""

    type: str
    owner: tuple[str, str]
    member: _Member
    of: Callable[[Column], Column]


def _present(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull())


def _each(values: Column, rows: Callable[[Column, Column], Column], seq: Column) -> Column:
    return F.flatten(F.transform(values, lambda v: rows(v, seq)))


class Paths:
    """The paths of one type's parameters over one parsed column."""

    def __init__(self, type_: str, registry: Registry):
        self.type, self.registry, self.root = type_, registry, _Member(type_)

    def start(self) -> list[_Items]:
        return [_Items(self.type, (self.type, ""), self.root, lambda c: F.array(c))]

    def step(self, base: _Items, name: str) -> list[_Items]:
        kids = self.registry.children(*base.owner)
        choice = kids.get(f"{name}[x]")
        names = [name + t[0].upper() + t[1:] for t in choice.types] if choice else [name]
        out = []
        for n in names:
            found = self.registry.step(*base.owner, n)
            if found is None:
                raise Unsupported(f"{n} is no plain member")
            e, type_, owner, path = found
            kid = base.member.kids.setdefault(n, _Member(type_, e.many))

            def of(c: Column, n=n, many=e.many) -> Column:
                inner = F.transform(base.of(c), lambda x: x[n])
                return _present(F.flatten(_present(inner)) if many else inner)

            out.append(_Items(type_, (owner, path), kid, of))
        return out

    def run(self, n: object, at: list[_Items]) -> list[_Items]:
        if isinstance(n, Name):
            if n.base is None and n.name in self.registry.ancestors(at[0].type):
                return at
            return [y for x in (self.run(n.base, at) if n.base is not None else at) for y in self.step(x, n.name)]
        if isinstance(n, Binary) and n.op == "|":
            left, right = self.run(n.left, at), self.run(n.right, at)
            for y in right:
                same = next((x for x in left if x.type == y.type), None)
                if same is None:
                    left.append(y)
                else:
                    left[left.index(same)] = _Items(same.type, same.owner, same.member, lambda c, x=same, y=y: F.array_union(x.of(c), y.of(c)))
                    y.member.whole = same.member.whole = True
            return left
        if isinstance(n, Call) and n.name == "ofType" and len(n.args) == 1 and isinstance(n.args[0], Name) and n.base is not None:
            return [x for x in self.run(n.base, at) if x.type == n.args[0].name]
        if isinstance(n, Call) and n.name == "where" and len(n.args) == 1 and n.base is not None:
            return [self.where(x, n.args[0]) for x in self.run(n.base, at)]
        raise Unsupported(str(n))

    def where(self, items: _Items, test: object) -> _Items:
        if isinstance(test, Binary) and test.op == "=" and isinstance(test.left, Name) and test.left.base is None and isinstance(test.right, Literal) and test.right.kind == "string":
            (kid,) = self.step(items, test.left.name)
            if kid.member.many or self.registry.types[kid.type].kind != "primitive":
                raise Unsupported("only single texts are compared")
            return _Items(items.type, items.owner, items.member, lambda c: F.filter(items.of(c), lambda x: x[test.left.name] == test.right.text))
        if isinstance(test, TypeTest) and test.op == "is" and isinstance(test.of, Call) and test.of.name == "resolve" and test.of.base is None and items.type == "Reference":
            return _Items(items.type, items.owner, items.member, lambda c: F.filter(items.of(c), lambda x: _reference(x["reference"])[0] == test.type))
        raise Unsupported(str(test))

    # rows

    def rows(self, p: Param) -> Callable[[Column], Column]:
        """The parameter's rows as an array column over the parsed text."""
        if p.kind == "composite":
            found = self.run(parse(p.expression), self.start())
            if len(found) != 1:
                raise Unsupported("occurrences of several types")
            top = found[0]
            parts = []
            for k, (_, kind, inner) in enumerate(p.components):
                here = _Items(top.type, top.owner, top.member, lambda c: F.array(c))
                parts += [(x, self.value(Param(f"{p.code}${k}", kind, p.base), x)) for x in self.run(parse(inner), [here])]
            return lambda c: F.flatten(F.transform(top.of(c), lambda o, seq: F.concat(*[_each(x.of(o), f, seq) for x, f in parts])))
        each = [(x, self.value(p, x)) for x in self.run(parse(p.expression), self.start())]
        if not each:
            raise Unsupported("no values")
        return lambda c: F.concat(*[_each(x.of(c), f, F.lit(0)) for x, f in each])

    def value(self, p: Param, x: _Items) -> Callable[[Column, Column], Column]:
        """The rows of one value of a parameter, as a function of the value and its occurrence's number."""
        t, primitive = x.type, self.registry.types[x.type].kind == "primitive"
        x.member.whole = True
        empty = F.lit("")

        def row(tab: str, seq: Column, a=empty, b=empty, c=empty, low=None, high=None, x=None, y=None, code: str = p.code) -> Column:
            none = lambda v, kind: F.lit(None).cast(kind) if v is None else v.cast(kind)
            texts = [F.coalesce(v, empty).alias(k) for k, v in (("a", a), ("b", b), ("c", c))]
            return F.struct(F.lit(tab).alias("tab"), F.lit(code).alias("code"), seq.cast("int").alias("seq"), *texts, none(low, "bigint").alias("low"), none(high, "bigint").alias("high"), none(x, "double").alias("x"), none(y, "double").alias("y"))

        some = lambda c: F.coalesce(c != "", F.lit(False))
        texts = lambda found, seq: F.transform(F.filter(found, some), lambda s: row("string", seq, folded(s), s))
        none = F.array().cast(ROW)
        listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
        if p.kind == "string" and t in ("HumanName", "Address"):
            names = {"HumanName": ("family", "given*", "prefix*", "suffix*", "text"), "Address": ("line*", "city", "district", "state", "postalCode", "country", "text")}[t]
            return lambda v, seq: texts(F.concat(*[listed(v[n[:-1]]) if n[-1] == "*" else F.array(v[n]) for n in names]), seq)
        if p.kind == "string" and primitive:
            return lambda v, seq: texts(F.array(v), seq)
        if p.kind == "token" and t == "CodeableConcept":
            coded = lambda v, seq: F.transform(_present(v["coding"]), lambda c: row("token", seq, c["system"], c["code"]))
            shown = lambda v, seq: texts(F.concat(F.coalesce(F.transform(v["coding"], lambda c: c["display"]), F.array().cast("array<string>")), F.array(v["text"])), seq)
            return lambda v, seq: F.concat(F.coalesce(coded(v, seq), none), shown(v, seq))
        if p.kind == "token" and t == "Coding":
            return lambda v, seq: F.array(row("token", seq, v["system"], v["code"]))
        if p.kind == "token" and t == "Identifier":
            kinds = lambda v, seq: F.transform(_present(v["type"]["coding"]), lambda c: row("token", seq, F.concat(F.coalesce(c["system"], empty), F.lit("|"), F.coalesce(c["code"], empty)), v["value"], code=f"{p.code}:of-type"))
            return lambda v, seq: F.concat(F.array(row("token", seq, v["system"], v["value"])), F.coalesce(kinds(v, seq), none))
        if p.kind == "token" and t == "ContactPoint":
            return lambda v, seq: F.array(row("token", seq, v["system"], v["value"]))
        if p.kind == "token" and t in QUANTITIES:
            return lambda v, seq: F.array(row("token", seq, v["system"], _unit(v)))
        if p.kind == "token" and primitive:
            return lambda v, seq: F.transform(F.filter(F.array(v), some), lambda s: row("token", seq, empty, s))
        if p.kind == "reference" and t == "Reference":
            named = lambda v, seq: F.transform(F.filter(F.array(v["reference"]), some), lambda r: row("reference", seq, *_reference(r), r))
            known = lambda v, seq: F.transform(_present(F.array(v["identifier"])), lambda i: row("token", seq, i["system"], i["value"]))
            return lambda v, seq: F.concat(named(v, seq), known(v, seq))
        if p.kind == "reference" and primitive:
            return lambda v, seq: F.transform(F.filter(F.array(v), some), lambda r: row("reference", seq, *_reference(r), r))
        if p.kind == "uri" and primitive:
            return lambda v, seq: F.transform(F.filter(F.array(v), some), lambda s: row("uri", seq, s))
        dated = lambda seq, low, high: F.transform(F.filter(F.array(F.struct(low.alias("low"), high.alias("high"))), lambda d: d["low"].isNotNull() & d["high"].isNotNull()), lambda d: row("date", seq, low=d["low"], high=d["high"]))
        if p.kind == "date" and t == "Period":
            end = lambda c, bound, open_: F.when(some(c), bound).otherwise(F.lit(open_).cast("bigint"))
            return lambda v, seq: dated(seq, end(v["start"], date_bounds(v["start"])[0], FIRST), end(v["end"], date_bounds(v["end"])[1], LAST))
        if p.kind == "date" and t == "Timing":
            return lambda v, seq: F.flatten(F.transform(listed(v["event"]), lambda e: dated(seq, *date_bounds(e))))
        if p.kind == "date" and primitive:
            return lambda v, seq: dated(seq, *date_bounds(v))
        ranged = lambda seq, text, tab, a, b: F.transform(F.filter(F.array(F.struct(*[c.alias(k) for k, c in zip("xy", number_bounds(text))])), lambda d: d["x"].isNotNull()), lambda d: row(tab, seq, a, b, x=d["x"], y=d["y"]))
        if p.kind == "number" and primitive:
            return lambda v, seq: ranged(seq, v, "number", empty, empty)
        if p.kind == "quantity" and t in QUANTITIES:
            return lambda v, seq: ranged(seq, v["value"], "quantity", v["system"], _unit(v))
        if p.kind in ("quantity", "date", "reference", "number"):
            return lambda v, seq: none  # values of other types give no rows
        raise Unsupported(f"{p.kind} of {t}")


def _unit(v: Column) -> Column:
    return F.when(F.coalesce(v["code"] != "", F.lit(False)), v["code"]).otherwise(v["unit"])


def _reference(r: Column) -> tuple[Column, Column]:
    """Type and id of a reference as written."""
    path = F.regexp_replace(F.regexp_replace(r, "/_history/[^/]*$", ""), "/+$", "")
    typed = r"(?:^|/)([A-Z][\p{L}\p{N}_]*)/([^/]*)$"
    inside = F.startswith(r, F.lit("#"))
    return F.when(inside, F.lit("")).otherwise(F.regexp_extract(path, typed, 1)), F.when(inside, r).otherwise(F.regexp_extract(path, typed, 2))


_DATE = r"^\s*(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(Z|[+-]\d\d:\d\d)?)?)?)?\s*$"


def date_bounds(text: Column) -> tuple[Column, Column]:
    """The closed range of microseconds that a date of some precision covers, both null for what is no date."""
    part = lambda k: F.nullif(F.regexp_extract(text, _DATE, k), F.lit(""))
    year, month, day, hour, minute, second = (part(k).cast("int") for k in range(1, 7))
    zone = F.when(F.coalesce(part(8), F.lit("Z")) == "Z", F.lit("UTC")).otherwise(part(8))
    zero, one = F.lit(0), F.lit(1)
    fine = F.rpad(F.coalesce(part(7), F.lit("0")), 3, "0").substr(1, 3).cast("bigint") * 1000
    at = lambda y, m: F.unix_micros(F.try_make_timestamp(y, m, F.coalesce(day, one), F.coalesce(hour, zero), F.coalesce(minute, zero), F.coalesce(second, zero), zone))
    low = F.when(F.coalesce(second, zero) < 60, at(year, F.coalesce(month, one))) + fine
    last = F.lit(9999)
    span = F.when(month.isNull(), F.when(year < last, at(year + 1, one)).otherwise(low + F.lit(366 * 86_400_000_000))).when(
        day.isNull(), F.when((year < last) | (month < 12), at(year + F.floor(month / 12).cast("int"), month % 12 + 1)).otherwise(low + F.lit(31 * 86_400_000_000))
    ).otherwise(low + F.when(hour.isNull(), F.lit(86_400_000_000)).when(second.isNull(), F.lit(60_000_000)).otherwise(F.lit(1000)))
    known = F.coalesce(F.rlike(text, F.lit(_DATE)), F.lit(False))
    return F.when(known, low), F.when(known & low.isNotNull(), span - 1)


_NUMBER = r"^([+-]?)(\d+)?(?:\.(\d*))?(?:[eE]([+-]?\d{1,4}))?$"


def number_bounds(text: Column) -> tuple[Column, Column]:
    """Half a unit of the last written decimal on either side, both null for what is no number."""
    places = F.length(F.regexp_extract(text, _NUMBER, 3)) - F.coalesce(F.nullif(F.regexp_extract(text, _NUMBER, 4), F.lit("")).cast("int"), F.lit(0))
    places = F.greatest(places, F.lit(0))
    wide = F.lit(0.5) * F.pow(F.lit(10.0), -places)
    # exact where a decimal holds it, so that the bounds are the doubles next to the true ones
    exact, half = text.try_cast("decimal(38,17)"), F.concat(F.lit("5e-"), (places + 1).cast("string")).try_cast("decimal(38,17)")
    fits = exact.isNotNull() & (places <= 16)
    known = F.coalesce(F.rlike(text, F.lit(_NUMBER)) & F.rlike(text, F.lit(r"\d")), F.lit(False))
    value = text.try_cast("double")
    bound = lambda narrow, broad: F.when(known, F.when(fits, narrow.cast("double")).otherwise(broad))
    return bound(exact - half, value - wide), bound(exact + half, value + wide)


#: A number of a JSON text and what precedes it: strings whole, and nothing else that holds digits.
_BARE = r"""\G((?:[^"0-9-]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)(-?[0-9][0-9.eE+-]*+)"""


def compiled(type_: str, params: list[Param], registry: Registry) -> tuple[list[Param], Callable[[Column], Column]]:
    """Which of a type's parameters are plain paths, and all their rows as an array column over documents in JSON.

    Their members are parsed at once, but for parameters that read a member in different ways.
    """
    taken: list[Param] = []
    groups: list[tuple[Paths, list[Callable[[Column], Column]]]] = [(Paths(type_, registry), [])]
    for p in params:
        for paths, builders in (groups[0], (Paths(type_, registry), [])):
            before, count = deepcopy(paths.root), len(builders)
            try:
                builders.append(paths.rows(p))
                paths.root.schema()
            except Unsupported:
                del builders[count:]
                paths.root = before
                continue
            taken.append(p)
            if paths is not groups[0][0]:
                groups.append((paths, builders))
            break

    exact = any(p.kind in ("quantity", "number", "composite") for p in taken)

    def group(content: Column, paths: Paths, builders: list[Callable[[Column], Column]]) -> Column:
        parsed = F.array(F.from_json(content, paths.root.schema()))
        return F.flatten(F.transform(parsed, lambda c: F.concat(*[F.coalesce(b(c).cast(ROW), F.array().cast(ROW)) for b in builders])))

    def rows(content: Column) -> Column:
        content = F.regexp_replace(content, _BARE, '$1"$2"') if exact else content
        return F.concat(F.array().cast(ROW), *[group(content, paths, builders) for paths, builders in groups if builders])

    return taken, rows
