"""Access scopes and the confinement of searches to a compartment."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import SearchError
from .plans.model import Clause, Either, Leaf, Value
from .plans.params import SPECIAL
from .registry import Param, Registry, default

_SCOPE = re.compile(r"(patient|user|system)/(\*|[A-Z]\w*)\.(read|write|\*|c?r?u?d?s?)(?:\?.*)?")
LETTERS = {"read": "rs", "write": "cud", "*": "cruds"}
WIDTH = {"patient": 0, "user": 1, "system": 2}


@dataclass(frozen=True)
class Scope:
    context: str
    type: str
    letters: str


def parse_scopes(text: str) -> list[Scope]:
    """Scopes of both versions; what is no resource scope is left out."""
    out = []
    for word in text.split():
        m = _SCOPE.fullmatch(word)
        if m and m[3]:
            out.append(Scope(m[1], m[2], LETTERS.get(m[3], m[3])))
    return out


def granted(scopes: list[Scope], type_: str, letter: str) -> str | None:
    """The widest context that allows the interaction, None if none does."""
    fits = [s.context for s in scopes if s.type in ("*", type_) and letter in s.letters]
    return max(fits, key=WIDTH.__getitem__, default=None)


def confinement(type_: str, compartment: str, id_: str, registry: Registry | None = None) -> Clause:
    """Membership of the compartment: any linking parameter names its resource."""
    registry = registry or default()
    links = registry.compartments.get(compartment, {}).get(type_)
    if not links:
        raise SearchError(f"{type_} is not in the {compartment} compartment")
    parts: list[Clause] = []
    for code in links:
        if code == "{def}":
            parts.append(Leaf(Param("_id", SPECIAL["_id"], ("Resource",)), (Value(id_),)))
        else:
            parts.append(Leaf(registry.param(type_, code), (Value(id_, "eq", type=compartment),)))
    return parts[0] if len(parts) == 1 else Either(tuple(parts))
