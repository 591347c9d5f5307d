"""Query text to plans: ``Type?name:modifier=value,value&…``."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl

from ..errors import SearchError
from ..registry import Param, Registry, default
from .model import MAX_COUNT, MAX_DEPTH, Chain, Clause, Composite, Has, Include, Leaf, Plan, Sort, Value
from .ranges import date_bounds, number_bounds, split_prefix

CONTROLS = ("_sort", "_count", "_offset", "_cursor", "_total", "_summary", "_elements", "_include", "_revinclude", "_filter", "_format", "_pretty")
#: Parameters of every type that are not in the registry.
SPECIAL = {"_id": "id", "_lastUpdated": "updated", "_text": "narrative", "_content": "content"}
MODIFIERS = {
    "string": {"exact", "contains"},
    "token": {"text", "not", "of-type"},
    "reference": {"identifier"},
    "uri": {"below", "above"},
    "id": {"not"},
    "narrative": {"not"},
    "content": {"not"},
}


def pieces(text: str, at: str) -> list[str]:
    """Split at an unescaped character; escapes stay."""
    return re.split(rf"(?<!\\)(?:\\\\)*{re.escape(at)}", text) if "\\" not in text else _escaped(text, at)


def _escaped(text: str, at: str) -> list[str]:
    out, now, k = [], "", 0
    while k < len(text):
        if text[k] == "\\" and k + 1 < len(text):
            now, k = now + text[k : k + 2], k + 2
        elif text[k] == at:
            out, now, k = [*out, now], "", k + 1
        else:
            now, k = now + text[k], k + 1
    return [*out, now]


def plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


class Parser:
    def __init__(self, registry: Registry | None = None):
        self.registry = registry or default()

    def parse(self, query: str) -> Plan:
        """A whole query: an optional type and parameters."""
        type_, _, rest = query.lstrip("/").partition("?")
        return self.parse_pairs(type_ or None, parse_qsl(rest, keep_blank_values=True))

    def parse_pairs(self, type_: str | None, pairs: list[tuple[str, str]]) -> Plan:
        if type_ is not None and type_ not in self.registry.resources():
            raise SearchError(f"unknown resource type {type_}")
        plan = Plan(type_)
        for name, value in pairs:
            if name.partition(":")[0] in CONTROLS:
                self._control(plan, name, value)
            else:
                plan.clauses.append(self.clause(type_, name, value))
        if plan.summary != "false" and plan.elements:
            plan.summary = "false"  # the list of elements wins
        return plan

    # clauses

    def clause(self, type_: str | None, name: str, value: str, depth: int = 0) -> Clause:
        if depth > MAX_DEPTH:
            raise SearchError(f"more than {MAX_DEPTH} chained steps")
        if name.startswith("_has:"):
            return self._has(type_, name, value, depth)
        if "." in name:
            return self._chain(type_, name, value, depth)
        code, _, modifier = name.partition(":")
        return self.leaf(type_, code, modifier or None, value)

    def param(self, type_: str | None, code: str) -> Param:
        if code in SPECIAL:
            return Param(code, SPECIAL[code], ("Resource",))
        p = self.registry.param(type_ or "Resource", code)
        if p is None:
            raise SearchError(f"{type_ or 'any type'} has no search parameter {code}")
        return p

    def leaf(self, type_: str | None, code: str, modifier: str | None, value: str) -> Clause:
        p = self.param(type_, code)
        if modifier == "missing":
            if value not in ("true", "false"):
                raise SearchError(":missing is true or false")
            return Composite(p, missing=value == "true") if p.kind == "composite" else Leaf(p, missing=value == "true")
        if p.kind == "composite":
            if modifier:
                raise SearchError(f"{code} takes no modifier {modifier}")
            return self._composite(p, value)
        target = None
        if modifier and modifier not in MODIFIERS.get(p.kind, ()):
            if p.kind == "reference" and modifier in self.registry.types:
                if modifier not in p.targets:
                    raise SearchError(f"{code} does not refer to {modifier}")
                target, modifier = modifier, None
            elif modifier in ("in", "not-in", "above", "below") and p.kind == "token":
                raise SearchError(f":{modifier} needs a terminology service")
            else:
                raise SearchError(f"{code} takes no modifier {modifier}")
        if p.kind in ("narrative", "content"):
            return Leaf(p, tuple(Value(plain(v)) for v in pieces(value, ",")), modifier == "not")
        values = tuple(self.value(p, v, modifier, target) for v in pieces(value, ","))
        table = "string" if modifier == "text" else "token" if modifier == "identifier" or modifier == "of-type" else ""
        return Leaf(p, values, modifier == "not", table=table)

    def value(self, p: Param, raw: str, modifier: str | None = None, target: str | None = None, op: str | None = None) -> Value:
        text = plain(raw)
        if p.kind == "string":
            return Value(text, op or modifier or "starts")
        if p.kind == "token" or modifier == "identifier":
            parts = [plain(x) for x in pieces(raw, "|")]
            if modifier == "text":
                return Value(text, "starts")
            if modifier == "of-type":
                if len(parts) != 3 or not all(parts):
                    raise SearchError(":of-type takes system|code|value")
                return Value(parts[2], "of-type", f"{parts[0]}|{parts[1]}")
            if len(parts) > 2:
                raise SearchError(f"too many bars in {raw}")
            if len(parts) == 2:
                return Value(parts[1], "eq", parts[0] or None)
            return Value(text)
        if p.kind == "reference":
            if "://" in text:
                return Value(text, "url")
            if "/" in text:
                kind, _, id_ = text.partition("/")
                return Value(id_, "eq", type=target or kind)
            return Value(text, "eq" if target else "any", type=target)
        if p.kind == "uri":
            return Value(text, op or modifier or "eq")
        if p.kind == "id":
            return Value(text)
        try:
            if p.kind in ("date", "updated"):
                prefix, rest = split_prefix(text)
                return Value(rest, op or prefix, None, *date_bounds(rest))
            if p.kind == "number":
                prefix, rest = split_prefix(text)
                return Value(rest, op or prefix, None, *number_bounds(rest))
            if p.kind == "quantity":
                parts = [plain(x) for x in pieces(raw, "|")]
                prefix, rest = split_prefix(parts[0])
                system, unit = (parts[1:3] if len(parts) == 3 else (None, None))
                if len(parts) == 2 or len(parts) > 3:
                    raise ValueError("a quantity is number|system|code")
                return Value(rest, op or prefix, system or None, *number_bounds(rest), unit=unit or None)
        except ValueError as e:
            raise SearchError(f"{p.code}: {e}") from None
        raise SearchError(f"{p.code} can't be searched")

    def _composite(self, p: Param, value: str) -> Composite:
        alternatives = []
        for alternative in pieces(value, ","):
            parts = pieces(alternative, "$")
            if len(parts) != len(p.components):
                raise SearchError(f"{p.code} takes {len(p.components)} parts")
            alternatives.append(tuple(Leaf(Param(f"{p.code}${k}", kind, p.base), (self.value(Param(code, kind, p.base), part),)) for k, ((code, kind, _), part) in enumerate(zip(p.components, parts))))
        return Composite(p, tuple(alternatives))

    def _chain(self, type_: str | None, name: str, value: str, depth: int) -> Chain:
        head, _, rest = name.partition(".")
        code, _, target = head.partition(":")
        p = self.param(type_, code)
        if p.kind != "reference":
            raise SearchError(f"{code} is no reference")
        if target:
            if target not in p.targets:
                raise SearchError(f"{code} does not refer to {target}")
        else:
            following = rest.partition(".")[0].partition(":")[0]
            fits = [t for t in p.targets if t in self.registry.types and (following in SPECIAL or following.startswith("_has") or self.registry.param(t, following))]
            if len(p.targets) == 1:
                fits = list(p.targets)
            if len(fits) != 1:
                raise SearchError(f"{head}.{following} could mean {', '.join(fits) or 'no type'}; name one as {code}:Type")
            target = fits[0]
        return Chain(p, target, self.clause(target, rest, value, depth + 1))

    def _has(self, type_: str | None, name: str, value: str, depth: int) -> Has:
        parts = name.split(":", 3)
        if len(parts) < 4:
            raise SearchError("_has is _has:Type:reference:parameter")
        _, source, code, rest = parts
        if source not in self.registry.resources():
            raise SearchError(f"unknown resource type {source}")
        p = self.param(source, code)
        if p.kind != "reference":
            raise SearchError(f"{source}.{code} is no reference")
        if type_ and p.targets and type_ not in p.targets:
            raise SearchError(f"{source}.{code} does not refer to {type_}")
        return Has(source, p, self.clause(source, rest, value, depth + 1))

    # controls

    def _control(self, plan: Plan, name: str, value: str) -> None:
        name, _, modifier = name.partition(":")
        if name == "_sort":
            for part in filter(None, value.split(",")):
                p = self.param(plan.type, part.lstrip("-"))
                if p.kind in ("composite", "narrative", "content"):
                    raise SearchError(f"{p.code} can't be sorted by")
                plan.sorts.append(Sort(p, part.startswith("-")))
        elif name in ("_count", "_offset"):
            if not re.fullmatch(r"\d{1,9}", value):
                raise SearchError(f"{name} is a whole number")
            if name == "_count":
                plan.count = min(int(value), MAX_COUNT)
            else:
                plan.offset = int(value)
        elif name == "_cursor":
            plan.cursor = value
        elif name == "_total":
            if value not in ("none", "estimate", "accurate"):
                raise SearchError("_total is none, estimate or accurate")
            plan.total = value
        elif name == "_summary":
            if value not in ("true", "false", "text", "data", "count"):
                raise SearchError("_summary is true, false, text, data or count")
            plan.summary = value
        elif name == "_elements":
            plan.elements = tuple(filter(None, value.split(",")))
        elif name in ("_include", "_revinclude"):
            if modifier not in ("", "iterate", "recurse"):
                raise SearchError(f"{name} takes no modifier {modifier}")
            plan.includes.append(self._include(value, name == "_revinclude", bool(modifier)))
        elif name == "_filter":
            from .filter_language import parse_filter

            plan.clauses.append(parse_filter(self, plan.type, value))

    def _include(self, value: str, reverse: bool, iterate: bool) -> Include:
        parts = value.split(":")
        if value == "*":
            parts = ["*", "*"]
        if reverse and "*" in parts:
            raise SearchError("_revinclude names its parameter")
        if not 2 <= len(parts) <= 3:
            raise SearchError("an include is Type:parameter or Type:parameter:Target")
        source, code = parts[:2]
        if source != "*" and source not in self.registry.resources():
            raise SearchError(f"unknown resource type {source}")
        if code != "*" and self.param(source, code).kind != "reference":
            raise SearchError(f"{source}.{code} is no reference")
        return Include(source, code, parts[2] if len(parts) == 3 else None, reverse, iterate)
