"""Expressions to Spark columns over documents in JSON, where built-in functions have the same meaning.

A collection is an array column, never null. Only the members that an expression
names are parsed from the text. What has no exact column form (decimals' scale,
partial dates, structural equality, recursion) raises Unsupported, and callers
fall back to the interpreter in an Arrow UDF.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...registry import Registry, default
from .parser import Binary, Call, Index, Literal, Name, Special, parse


class Unsupported(Exception):
    pass


@dataclass
class _Tree:
    """Members in use below a type."""

    owner: tuple[str, str]
    kids: dict[str, _Tree]
    type: str = ""
    many: bool = False


@dataclass
class _Value:
    """An array column of a System type, or of structs of a tree."""

    column: Column
    kind: str  # string, integer, boolean or node
    tree: _Tree | None = None


STRINGS = {"string", "code", "id", "uri", "url", "canonical", "markdown", "oid", "uuid", "xhtml", "base64Binary"}
INTEGERS = {"integer", "positiveInt", "unsignedInt"}


class _Compiler:
    def __init__(self, type_: str, registry: Registry):
        self.registry, self.type = registry, type_
        self.tree = _Tree((type_, ""), {}, type_)

    # first pass: which members are used

    def note(self, n, at: list[_Tree]) -> list[_Tree]:
        if isinstance(n, Name):
            base = self.note(n.base, at) if n.base is not None else at
            if n.base is None and n.name == self.type and at == [self.tree]:
                return at
            return [self.member(t, n.name) for t in base]
        if isinstance(n, Call):
            base = self.note(n.base, at) if n.base is not None else at
            inner = [r for a in n.args for r in self.note(a, base if n.name in ("where", "select", "all", "exists") else at)]
            return inner if n.name == "select" else base
        if isinstance(n, Index):
            self.note(n.at, at)
            return self.note(n.base, at)
        if isinstance(n, Binary):
            left, right = self.note(n.left, at), self.note(n.right, at)
            return left + right if n.op == "|" else []
        return at if isinstance(n, Special) else []

    def member(self, t: _Tree, name: str) -> _Tree:
        step = self.registry.step(*t.owner, name) if t.owner else None
        if step is None:
            raise Unsupported(f"{name} is no plain member")
        e, type_, owner, path = step
        if e.choice:
            raise Unsupported("choices depend on the document")
        return t.kids.setdefault(name, _Tree((owner, path), {}, type_, e.many))

    def schema(self, t: _Tree) -> str:
        if not t.kids:
            return {"boolean": "boolean"}.get(t.type, "bigint" if t.type in INTEGERS else "string")
        return "struct<" + ",".join(f"`{k}`:{f'array<{self.schema(v)}>' if v.many else self.schema(v)}" for k, v in t.kids.items()) + ">"

    # second pass: columns

    def eval(self, n, focus: _Value) -> _Value:
        if isinstance(n, Literal):
            kinds = {"string": lambda: (F.lit(n.text), "string"), "boolean": lambda: (F.lit(n.text == "true"), "boolean")}
            if n.kind == "number" and "." not in n.text:
                return _Value(F.array(F.lit(int(n.text)).cast("bigint")), "integer")
            if n.kind not in kinds:
                raise Unsupported(f"literals of {n.kind}")
            c, kind = kinds[n.kind]()
            return _Value(F.array(c), kind)
        if isinstance(n, Special) and n.name == "$this":
            return focus
        if isinstance(n, Name):
            base = self.eval(n.base, focus) if n.base is not None else focus
            if n.base is None and n.name == self.type and base.tree is self.tree:
                return base
            return self.step(base, n.name)
        if isinstance(n, Index):
            base, at = self.eval(n.base, focus), n.at
            if not isinstance(at, Literal) or at.kind != "number":
                raise Unsupported("computed indexes")
            return self.cut(base, F.slice(base.column, int(at.text) + 1, 1))
        if isinstance(n, Binary):
            return self.binary(n, focus)
        if isinstance(n, Call):
            return self.call(n, self.eval(n.base, focus) if n.base is not None else focus, focus)
        raise Unsupported(type(n).__name__)

    @staticmethod
    def cut(v: _Value, c: Column) -> _Value:
        return _Value(c, v.kind, v.tree)

    def step(self, base: _Value, name: str) -> _Value:
        t = base.tree.kids.get(name) if base.tree else None
        if t is None:
            raise Unsupported(f"{name} of a value")
        kind = "node" if t.kids else "boolean" if t.type == "boolean" else "integer" if t.type in INTEGERS else "string" if t.type in STRINGS else ""
        if not kind:
            raise Unsupported(f"values of {t.type}")
        c = F.transform(base.column, lambda x: x[name])
        c = F.flatten(F.filter(c, lambda x: x.isNotNull())) if t.many else c
        return _Value(F.filter(c, lambda x: x.isNotNull()), kind, t if t.kids else None)

    def one(self, v: _Value) -> Column:
        """The single value, null if none; several are the interpreter's business to refuse."""
        return F.get(v.column, F.lit(0))

    def criterion(self, n, item: _Value) -> Column:
        v = self.eval(n, item)
        if v.kind == "boolean":
            return F.coalesce(F.when(F.size(v.column) == 1, self.one(v)), F.lit(False))
        return F.size(v.column) == 1

    def binary(self, n: Binary, focus: _Value) -> _Value:
        a, b = self.eval(n.left, focus), self.eval(n.right, focus)
        wrap = lambda c: _Value(F.filter(F.array(c), lambda x: x.isNotNull()), "boolean")
        if n.op in ("and", "or", "xor", "implies"):
            if "node" in (a.kind, b.kind):
                raise Unsupported("nodes as booleans")
            x, y = (self.one(v) if v.kind == "boolean" else F.when(F.size(v.column) > 0, F.lit(True)) for v in (a, b))
            if n.op == "and":
                return wrap(x & y)
            if n.op == "or":
                return wrap(x | y)
            if n.op == "xor":
                return wrap(x != y)
            return wrap(~x | y)
        if "node" in (a.kind, b.kind) or a.kind != b.kind:
            raise Unsupported("comparison of nodes or of different types")
        if n.op in ("=", "!="):
            same = F.when((F.size(a.column) > 0) & (F.size(b.column) > 0), a.column == b.column)
            return wrap(same if n.op == "=" else ~same)
        if n.op == "|":
            return _Value(F.array_union(a.column, b.column), a.kind)
        if n.op in ("in", "contains"):
            needle, hay = (a, b) if n.op == "in" else (b, a)
            return wrap(F.when(F.size(needle.column) > 0, F.array_contains(hay.column, self.one(needle))))
        x, y = self.one(a), self.one(b)
        if n.op in ("<", "<=", ">", ">="):
            return wrap({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[n.op])
        if n.op == "&" and a.kind == "string":
            return _Value(F.array(F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))), "string")
        if a.kind == "integer" and n.op in ("+", "-", "*"):
            z = x + y if n.op == "+" else x - y if n.op == "-" else x * y
            return _Value(F.filter(F.array(z), lambda v: v.isNotNull()), "integer")
        raise Unsupported(n.op)

    def call(self, n: Call, c: _Value, focus: _Value) -> _Value:
        a, flag = c.column, lambda x: _Value(F.array(x), "boolean")
        item = lambda x: _Value(F.array(x), c.kind, c.tree)
        name = n.name
        if name == "where" and len(n.args) == 1:
            return self.cut(c, F.filter(a, lambda x: self.criterion(n.args[0], item(x))))
        if name == "exists" and n.args:
            return flag(F.exists(a, lambda x: self.criterion(n.args[0], item(x))))
        if name == "all" and n.args:
            return flag(F.forall(a, lambda x: self.criterion(n.args[0], item(x))))
        if name == "select" and len(n.args) == 1:
            probe: list[_Value] = []

            def inner(x: Column) -> Column:
                v = self.eval(n.args[0], item(x))
                probe.append(v)
                return v.column

            out = F.flatten(F.transform(a, inner))
            return self.cut(probe[0], out)
        args = [self.eval(x, focus) for x in n.args]
        plain = {
            "exists": lambda: flag(F.size(a) > 0), "empty": lambda: flag(F.size(a) == 0), "count": lambda: _Value(F.array(F.size(a).cast("bigint")), "integer"),
            "first": lambda: self.cut(c, F.slice(a, 1, 1)), "tail": lambda: self.cut(c, F.when(F.size(a) > 1, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.slice(a, 1, 0))), "last": lambda: self.cut(c, F.when(F.size(a) > 0, F.slice(a, -1, 1)).otherwise(a)),
        }
        if name in plain and not args:
            return plain[name]()
        if name in ("skip", "take") and isinstance(n.args[0], Literal):
            k = max(0, int(n.args[0].text))
            return self.cut(c, F.slice(a, k + 1, 1 << 30) if name == "skip" else F.slice(a, 1, k))
        if c.kind == "node":
            raise Unsupported(f"{name} of nodes")
        sets = {"distinct": lambda: F.array_distinct(a), "combine": lambda: F.concat(a, args[0].column), "union": lambda: F.array_union(a, args[0].column), "intersect": lambda: F.array_intersect(a, args[0].column), "exclude": lambda: F.filter(a, lambda x: ~F.array_contains(args[0].column, x))}
        if name in sets and all(v.kind == c.kind for v in args):
            return self.cut(c, sets[name]())
        if name in ("subsetOf", "supersetOf") and args[0].kind == c.kind:
            x, y = (a, args[0].column) if name == "subsetOf" else (args[0].column, a)
            return flag(F.size(F.array_except(x, y)) == 0)
        if name == "isDistinct":
            return flag(F.size(F.array_distinct(a)) == F.size(a))
        if name == "not" and c.kind == "boolean":
            return self.cut(c, F.transform(F.slice(a, 1, 1), lambda x: ~x))
        if name in ("allTrue", "anyTrue", "allFalse", "anyFalse") and c.kind == "boolean":
            return flag({"allTrue": F.forall(a, lambda x: x), "anyTrue": F.exists(a, lambda x: x), "allFalse": F.forall(a, lambda x: ~x), "anyFalse": F.exists(a, lambda x: ~x)}[name])
        if name == "join" and c.kind == "string":
            return self.cut(c, F.when(F.size(a) > 0, F.array(F.array_join(a, n.args[0].text if n.args else ""))).otherwise(a))
        if name == "toString":
            return _Value(F.transform(F.slice(a, 1, 1), lambda x: x.cast("string")), "string")
        if c.kind == "string":
            return self.string(name, c, [self.one(v) for v in args])
        raise Unsupported(name)

    def string(self, name: str, c: _Value, args: list[Column]) -> _Value:
        head = F.slice(c.column, 1, 1)
        to = lambda kind, f: _Value(F.filter(F.transform(head, f), lambda x: x.isNotNull()), kind)
        one = {"upper": ("string", F.upper), "lower": ("string", F.lower), "length": ("integer", lambda x: F.length(x).cast("bigint"))}
        if name in one and not args:
            return to(one[name][0], lambda x: one[name][1](x))
        if len(args) == 1:
            v = args[0]
            two = {"startsWith": ("boolean", lambda x: F.startswith(x, v)), "endsWith": ("boolean", lambda x: F.endswith(x, v)), "contains": ("boolean", lambda x: F.contains(x, v)), "indexOf": ("integer", lambda x: (F.position(v, x) - 1).cast("bigint"))}
            if name in two:
                return to(two[name][0], two[name][1])
        raise Unsupported(name)


def compiled(expression: str, type_: str, content: Column, registry: Registry | None = None) -> Column:
    """An array column of the expression's values over documents of the type."""
    c = _Compiler(type_, registry or default())
    n = parse(expression)
    c.note(n, [c.tree])
    if not c.tree.kids:
        raise Unsupported("no member is used")
    focus = _Value(F.array(F.from_json(content, c.schema(c.tree))), "node", c.tree)
    out = c.eval(n, focus)
    if out.kind == "node":
        raise Unsupported("nodes as a result")
    return out.column
