"""Profiles: cardinality, fixed and pattern values, slices told apart by discriminators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import PathError
from ..functions.fhirpath import Context, evaluate
from ..functions.fhirpath.values import Node, parse_json, root
from ..registry import Registry, default
from .validate import Issue


@dataclass(frozen=True)
class Rule:
    """A constraint on a path relative to its type or slice."""

    path: str
    min: int = 0
    max: str = "*"
    fixed: Any = None
    pattern: Any = None
    type: str | None = None


@dataclass(frozen=True)
class Slice:
    name: str
    rules: tuple[Rule, ...] = ()
    min: int = 0
    max: str = "*"


@dataclass(frozen=True)
class Slicing:
    """discriminators are (kind, path) with kind value, pattern, type or exists; rules is open or closed."""

    path: str
    discriminators: tuple[tuple[str, str], ...]
    slices: tuple[Slice, ...]
    rules: str = "open"


@dataclass(frozen=True)
class Profile:
    url: str
    type: str
    rules: tuple[Rule, ...] = ()
    slicings: tuple[Slicing, ...] = field(default=())


def matches(pattern: Any, value: Any) -> bool:
    """Everything in the pattern is in the value; arrays need an equal item for each of the pattern's."""
    if isinstance(pattern, dict):
        return isinstance(value, dict) and all(k in value and matches(v, value[k]) for k, v in pattern.items())
    if isinstance(pattern, list):
        return isinstance(value, list) and all(any(matches(p, v) for v in value) for p in pattern)
    return pattern == value or not isinstance(pattern, bool) and not isinstance(value, bool) and str(pattern) == str(value)


def _at(node: Node, path: str) -> list[Node]:
    if path in ("", "$this"):
        return [node]
    return [x for x in evaluate(path, [node], Context(node.registry)) if isinstance(x, Node)]


def _belongs(node: Node, s: Slice, discriminators: tuple[tuple[str, str], ...]) -> bool | None:
    """Whether an occurrence is of the slice; None if that can't be told."""
    for kind, path in discriminators:
        rule = next((r for r in s.rules if r.path == ("" if path == "$this" else path)), None)
        if kind not in ("value", "pattern", "type", "exists") or rule is None:
            return None
        try:
            found = _at(node, path)
        except PathError:
            return None
        if kind == "exists":
            if bool(found) != (rule.min > 0):
                return False
        elif kind == "type":
            if not any(x.type == rule.type for x in found):
                return False
        else:
            want = rule.fixed if rule.fixed is not None else rule.pattern
            test = (lambda v, w=want: matches(w, v) and matches(v, w)) if rule.fixed is not None else (lambda v, w=want: matches(w, v))
            if not any(test(x.data) for x in found):
                return False
    return True


def _check(node: Node, rules: tuple[Rule, ...], where: str) -> Iterator[Issue]:
    for r in rules:
        found = _at(node, r.path)
        at = f"{where}.{r.path}" if r.path else where
        if len(found) < r.min:
            yield Issue("error", "required", at, f"at least {r.min} needed, {len(found)} found")
        if r.max != "*" and len(found) > int(r.max):
            yield Issue("error", "structure", at, f"at most {r.max} allowed, {len(found)} found")
        for x in found:
            if r.type is not None and x.type != r.type:
                yield Issue("error", "value", at, f"must be of type {r.type}")
            if r.fixed is not None and not (matches(r.fixed, x.data) and matches(x.data, r.fixed)):
                yield Issue("error", "value", at, f"must be {r.fixed!r}")
            if r.pattern is not None and not matches(r.pattern, x.data):
                yield Issue("error", "value", at, f"must match {r.pattern!r}")


def check(content: dict | str, profile: Profile, registry: Registry | None = None) -> list[Issue]:
    """Findings of a document against a profile."""
    node = root(content, registry or default())
    if node.type != profile.type:
        return [Issue("error", "structure", node.type, f"{profile.url} is a profile of {profile.type}")]
    out = list(_check(node, profile.rules, node.type))
    for slicing in profile.slicings:
        where, counts = f"{node.type}.{slicing.path}", {s.name: 0 for s in slicing.slices}
        for k, x in enumerate(_at(node, slicing.path)):
            told = [(s, _belongs(x, s, slicing.discriminators)) for s in slicing.slices]
            if any(b is None for _, b in told):
                out.append(Issue("information", "not-supported", f"{where}[{k}]", "its slice can't be told: NOT checked"))
                continue
            mine = next((s for s, b in told if b), None)
            if mine is None:
                if slicing.rules == "closed":
                    out.append(Issue("error", "structure", f"{where}[{k}]", "belongs to no slice"))
                continue
            counts[mine.name] += 1
            out += _check(x, mine.rules, f"{where}:{mine.name}")
        for s in slicing.slices:
            if counts[s.name] < s.min:
                out.append(Issue("error", "required", f"{where}:{s.name}", f"at least {s.min} needed, {counts[s.name]} found"))
            if s.max != "*" and counts[s.name] > int(s.max):
                out.append(Issue("error", "structure", f"{where}:{s.name}", f"at most {s.max} allowed, {counts[s.name]} found"))
    return out


def validate_profiles(resources: DataFrame, profiles: dict[str, Profile], urls: list[str] | None = None) -> DataFrame:
    """Rows (pid, profile, place, severity, code, path, details) of findings for (pid, content).

    Each document is held against the profiles of urls, or else against those that
    its meta.profile names; a profile that is not known is a finding of its own.
    """

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4)
        for b in batches:
            rows: list[tuple] = []
            for pid, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if content is None:
                    continue
                doc = parse_json(content)
                meta = doc.get("meta") if isinstance(doc, dict) else None
                for url in urls if urls is not None else (meta or {}).get("profile") or []:
                    known = profiles.get(url.partition("|")[0])
                    issues = check(doc, known) if known else [Issue("information", "not-supported", "", f"profile {url} is not known: NOT checked")]
                    rows += [(pid, url, n, i.severity, i.code, i.path, i.details) for n, i in enumerate(issues)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["pid", "profile", "place", "severity", "code", "path", "details"])

    return resources.select("pid", "content").mapInArrow(run, "pid long, profile string, place int, severity string, code string, path string, details string")
