"""The plan between query text and DataFrames: clauses, values, sorting and paging."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

from ..registry import Param

#: Complexity guards.
MAX_DEPTH, MAX_ROUNDS, DEFAULT_COUNT, MAX_COUNT, MAX_ENTRIES = 4, 5, 50, 1000, 500


@dataclass(frozen=True)
class Value:
    """One alternative. op is a comparison prefix or a string mode; low and high bound dates and numbers."""

    text: str = ""
    op: str = "eq"
    system: str | None = None
    low: float | int | None = None
    high: float | int | None = None
    unit: str | None = None
    type: str | None = None


@dataclass(frozen=True)
class Leaf:
    """The parameter has any of the values. missing: presence is asked for instead."""

    param: Param
    values: tuple[Value, ...] = ()
    negate: bool = False
    missing: bool | None = None
    table: str = ""  # index table, if not that of the parameter's kind


@dataclass(frozen=True)
class Composite:
    """One occurrence meets the components of an alternative."""

    param: Param
    alternatives: tuple[tuple[Leaf, ...], ...] = ()
    missing: bool | None = None


@dataclass(frozen=True)
class Chain:
    """A reference whose target of the type meets the clause."""

    param: Param
    target: str
    clause: Clause


@dataclass(frozen=True)
class Has:
    """A resource of the source type refers here and meets the clause."""

    source: str
    param: Param
    clause: Clause


@dataclass(frozen=True)
class Both:
    parts: tuple[Clause, ...]


@dataclass(frozen=True)
class Either:
    parts: tuple[Clause, ...]


@dataclass(frozen=True)
class Not:
    part: Clause


Clause = Union[Leaf, Composite, Chain, Has, Both, Either, Not]


@dataclass(frozen=True)
class Include:
    source: str  # a type, or * for any
    param: str  # a code, or * for all
    target: str | None = None
    reverse: bool = False
    iterate: bool = False


@dataclass(frozen=True)
class Sort:
    param: Param
    descending: bool = False


@dataclass
class Plan:
    type: str | None
    clauses: list[Clause] = field(default_factory=list)
    sorts: list[Sort] = field(default_factory=list)
    includes: list[Include] = field(default_factory=list)
    count: int = DEFAULT_COUNT
    offset: int = 0
    cursor: str | None = None
    total: str = "accurate"
    summary: str = "false"
    elements: tuple[str, ...] = ()
