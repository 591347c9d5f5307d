"""Documents to index rows, of which each index table is a projection.

Parameters that are plain paths become columns (extract_columns); the interpreter
evaluates the others, and finds the texts for full-text search, in one Arrow pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.fhirpath import Context, evaluate
from ..functions.fhirpath.values import Dec, Node, Temporal, named, root, split_reference
from ..functions.folding import fold
from ..plans.ranges import date_bounds, number_bounds
from ..registry import QUANTITIES, Param, Registry, default
from ..schemas import FIRST, LAST
from .extract_columns import ROW, compiled
from .lower import Stored

#: A wide row: table, code, seq and up to three texts, two whole and two real numbers.
WIDE = "pid long, resource_type string, tab string, code string, seq int, a string, b string, c string, low long, high long, x double, y double"
_FIELDS = ("pid", "resource_type", "tab", "code", "seq", "a", "b", "c", "low", "high", "x", "y")
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
TAGS = re.compile(r"<[^>]*>")
MAX_DEPTH = 40


class Extractor:
    def __init__(self, registry: Registry | None = None):
        self.registry = registry or default()

    def resolve(self, ref: str) -> Node | None:
        return named(ref, self.registry)

    def rows(self, content: str, params: list[Param] | None = None) -> Iterator[tuple]:
        """(table, code, seq, a, b, c, low, high, x, y) of a document for params, or all of its type's.

        A parameter whose expression fails gives no rows, nor does a value that can't be read.
        """
        node = root(content, self.registry)
        for p in self.registry.params_of(node.type) if params is None else params:
            if not p.expression:
                continue
            try:
                found = evaluate(p.expression, node, Context(self.registry, resolve=self.resolve))
                inner = [(p, x, 0) for x in found]
                if p.kind == "composite":
                    here = lambda: Context(self.registry, resolve=self.resolve, resource=[node])
                    inner = [(Param(f"{p.code}${k}", kind, p.base), y, seq) for seq, x in enumerate(found) for k, (_, kind, path) in enumerate(p.components) for y in evaluate(path, [x], here())]
            except (EngineError, ArithmeticError, ValueError, TypeError, AttributeError):
                continue
            for q, x, seq in inner:
                try:
                    yield from list(self.values(q, x, seq))
                except (EngineError, ArithmeticError, ValueError, TypeError, AttributeError):
                    continue

    def values(self, p: Param, v, seq: int) -> Iterator[tuple]:
        t = v.type if isinstance(v, Node) else ""
        d = v.data if isinstance(v, Node) else v
        row = lambda table, a="", b="", c="", low=None, high=None, x=None, y=None, code=p.code: (table, code, seq, a, b, c, low, high, x, y)
        text = lambda s: row("string", fold(str(s)), str(s))
        written = (lambda s: "true" if s is True else "false" if s is False else str(s))(d) if not isinstance(d, (dict, list)) else ""
        if p.kind == "string":
            names = {"HumanName": ("family", "given", "prefix", "suffix", "text"), "Address": ("line", "city", "district", "state", "postalCode", "country", "text")}.get(t)
            if names and isinstance(d, dict):
                for n in names:
                    for s in d.get(n) if isinstance(d.get(n), list) else [d.get(n)]:
                        if s:
                            yield text(s)
            elif written:
                yield text(written)
        elif p.kind == "token":
            token = lambda system, value, code=p.code: row("token", system or "", str(value or ""), code=code)
            if t == "CodeableConcept" and isinstance(d, dict):
                for c in d.get("coding") or []:
                    yield token(c.get("system"), c.get("code"))
                    if c.get("display"):
                        yield text(c["display"])
                if d.get("text"):
                    yield text(d["text"])
            elif t == "Coding" and isinstance(d, dict):
                yield token(d.get("system"), d.get("code"))
            elif t == "Identifier" and isinstance(d, dict):
                yield token(d.get("system"), d.get("value"))
                for c in (d.get("type") or {}).get("coding") or []:
                    yield token(f"{c.get('system') or ''}|{c.get('code') or ''}", d.get("value"), f"{p.code}:of-type")
            elif t == "ContactPoint" and isinstance(d, dict):
                yield token(d.get("system"), d.get("value"))
            elif t in QUANTITIES and isinstance(d, dict):
                yield token(d.get("system"), d.get("code") or d.get("unit"))
            elif written:
                yield token("", written)
        elif p.kind == "reference":
            if t == "Reference" and isinstance(d, dict):
                if d.get("reference"):
                    yield row("reference", *split_reference(d["reference"]))
                if isinstance(d.get("identifier"), dict):
                    yield row("token", d["identifier"].get("system") or "", d["identifier"].get("value") or "")
            elif written:
                yield row("reference", *split_reference(written))
        elif p.kind == "uri":
            if written:
                yield row("uri", written)
        elif p.kind == "date":
            if t == "Period" and isinstance(d, dict):
                low = date_bounds(d["start"])[0] if d.get("start") else FIRST
                high = date_bounds(d["end"])[1] if d.get("end") else LAST
                yield row("date", low=low, high=high)
            elif t == "Timing" and isinstance(d, dict):
                for e in d.get("event") or []:
                    try:
                        low, high = date_bounds(e)
                    except (TypeError, ValueError):
                        continue
                    yield row("date", low=low, high=high)
            elif written:
                low, high = date_bounds(str(v) if isinstance(v, Temporal) else written)
                yield row("date", low=low, high=high)
        elif p.kind == "number":
            if written:
                x, y = number_bounds(str(v) if isinstance(v, Dec) else written)
                yield row("number", x=x, y=y)
        elif p.kind == "quantity" and t in QUANTITIES and isinstance(d, dict) and d.get("value") is not None:
            x, y = number_bounds(str(d["value"]))
            yield row("quantity", d.get("system") or "", d.get("code") or d.get("unit") or "", x=x, y=y)

    def fulltext(self, content: str) -> tuple[str, str]:
        """Narrative and all strings, both without markup."""
        node = root(content, self.registry)
        narrative = node.data.get("text") or {}
        out: list[str] = []

        def walk(n: Node, depth: int) -> None:
            if depth > MAX_DEPTH:
                return
            for k in n.kids():
                if isinstance(k.data, (dict, list)):
                    walk(k, depth + 1)
                elif isinstance(k.system(), str):
                    out.append(TAGS.sub(" ", str(k.data)))

        walk(node, 0)
        return TAGS.sub(" ", narrative.get("div") or "") if isinstance(narrative, dict) else "", " ".join(out)


def wide_rows(resources: DataFrame, types: list[str] | None = None, codes: list[str] | None = None, text: bool = True, registry: Registry | None = None) -> DataFrame:
    """WIDE rows of live resources (pid, resource_type, content).

    types are the resource types that occur: their parameters' plain paths become
    columns; without it the interpreter does everything. Only the parameters of
    codes (all by default) are evaluated, and texts only if asked for.
    """
    registry = registry or default()
    live = resources.where("not deleted and content is not null").select("pid", "resource_type", "content")
    wanted = {t: [p for p in registry.params_of(t) if p.expression and (codes is None or p.code in codes)] for t in types or ()}
    native = F.lit(None).cast(ROW)
    for t, params in wanted.items():
        taken, rows = compiled(t, params, registry)
        if taken:
            native = F.when(F.col("resource_type") == t, rows(F.col("content"))).otherwise(native)
            wanted[t] = [p for p in params if p not in taken]
    out = []
    if types:
        d = live.select("pid", "resource_type", F.explode(native).alias("r"))
        out.append(d.select("pid", "resource_type", "r.*"))
    if types is None or text or any(wanted.values()):

        def run(batches):
            x = Extractor(registry)
            for b in batches:
                found: list[tuple] = []
                for pid, kind, content in zip(*(c.to_pylist() for c in b.columns)):
                    try:
                        left = wanted.get(kind) if types else None if codes is None else [p for p in registry.params_of(kind) if p.code in codes]
                        found += [(pid, kind, *r) for r in x.rows(content, left)]
                        if text:
                            n, c = x.fulltext(content)
                            found.append((pid, kind, "fulltext", "", 0, n, c, "", None, None, None, None))
                    except (EngineError, ValueError):
                        continue
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found) if found else [[]] * len(_TYPES), _TYPES)], list(_FIELDS))

        out.append(live.mapInArrow(run, WIDE))
    return reduce(DataFrame.unionByName, out)


def indexes(wide: DataFrame) -> dict[str, DataFrame]:
    """The index tables as projections of wide rows; write the rows first, partitioned by tab, so that each scan reads its own."""
    key = ["pid", "resource_type", "code", "seq"]
    shape = {
        "string": ("a norm", "b exact"), "token": ("a system", "b value"), "reference": ("a target_type", "b target_id", "c url"), "date": ("low low", "high high"),
        "quantity": ("x low", "y high", "a system", "b unit"), "uri": ("a value",), "number": ("x low", "y high"),
    }
    out = {t: wide.where(F.col("tab") == t).select(*key, *[F.col(c.split()[0]).alias(c.split()[1]) for c in columns]) for t, columns in shape.items()}
    from ..functions.folding import words

    out["fulltext"] = wide.where("tab = 'fulltext'").select("pid", "resource_type", words(F.col("a")).alias("narrative"), words(F.col("b")).alias("content"))
    return out


def stored(resources: DataFrame, wide: DataFrame) -> Stored:
    return Stored({"resource": resources, **indexes(wide)})
