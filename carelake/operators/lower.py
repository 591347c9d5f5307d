"""Plans to DataFrames: every clause is a semi or anti join on pid, so rows never multiply.

Conjunctions are joins one after the other, disjunctions a semi join with the union
of the parts' pids, negations anti joins. Nothing is collected. Which side is
broadcast is left to Catalyst and adaptive execution, which know the sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError
from ..functions.folding import fold, word_list
from ..plans.model import Both, Chain, Clause, Composite, Either, Has, Leaf, Not, Plan, Value
from ..plans.ranges import date_test, number_test

#: The index table of a parameter's kind.
TABLES = {k: k for k in ("string", "token", "reference", "date", "quantity", "uri", "number")}


def value_test(table: str, v: Value) -> Column:
    """Whether an index row has the value."""
    c = F.col
    if table == "string":
        if v.op == "exact":
            return c("exact") == v.text
        norm = F.lit(fold(v.text))
        return {"contains": F.contains(c("norm"), norm), "ends": F.endswith(c("norm"), norm)}.get(v.op, F.startswith(c("norm"), norm))
    if table == "token":
        if v.op == "of-type":
            return (c("value") == v.text) & (c("system") == v.system)
        test = c("value") == v.text if v.text or v.system is None else F.lit(True)
        return test & (c("system") == v.system) if v.system is not None else test
    if table == "reference":
        if v.op == "url":
            return c("url") == v.text
        if v.op == "any":
            return (c("target_id") == v.text) | (c("url") == v.text)
        return (c("target_id") == v.text) & (c("target_type") == v.type)
    if table == "uri":
        if v.op == "below":
            return F.startswith(c("value"), F.lit(v.text))
        if v.op == "above":
            return F.startswith(F.lit(v.text), c("value"))
        return c("value") == v.text
    if table == "date":
        return date_test(v.op, v.low, v.high)
    test = number_test(v.op, v.low, v.high)
    if table == "quantity" and v.unit:
        test = test & (c("unit") == v.unit)
        if v.system:
            test = test & (c("system") == v.system)
    return test


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


class Tables:
    """resource, the index tables by kind, and fulltext, each cut to a type and a code where these are given."""

    def get(self, table: str, type_: str | None = None, code: str | None = None) -> DataFrame:
        raise NotImplementedError


class Stored(Tables):
    """Whole tables; constant filters prune their partitions."""

    def __init__(self, frames: dict[str, DataFrame]):
        self.frames = frames

    def get(self, table: str, type_: str | None = None, code: str | None = None) -> DataFrame:
        d = self.frames[table]
        d = d if type_ is None else d.where(F.col("resource_type") == type_)
        return d if code is None else d.where(F.col("code") == code)


class Lowering:
    def __init__(self, tables: Tables):
        self.tables = tables

    def universe(self, type_: str | None) -> DataFrame:
        return self.tables.get("resource", type_).where(~F.col("deleted"))

    def rows(self, type_: str | None, table: str, code: str) -> DataFrame:
        return self.tables.get(table, type_, code)

    # restrict keeps rows of d that meet the clause, matches gives pids of the type that do

    def restrict(self, d: DataFrame, type_: str | None, c: Clause) -> DataFrame:
        if isinstance(c, Leaf):
            if c.param.kind == "id":
                test = F.col("fhir_id").isin([v.text for v in c.values])
                return d.where(~test if c.negate else test) if c.missing is None else d.where(F.lit(not c.missing))
            if c.param.kind == "updated":
                bounds = {"low": F.col("last_updated"), "high": F.col("last_updated")}
                return d.withColumns(bounds).where(any_of([date_test(v.op, v.low, v.high) for v in c.values])).drop(*bounds) if c.missing is None else d.where(F.lit(not c.missing))
            inverse = c.negate or bool(c.missing)
            return d.join(self.pids(type_, c), "pid", "left_anti" if inverse else "left_semi")
        if isinstance(c, Composite):
            return d.join(self.composite(type_, c), "pid", "left_anti" if c.missing else "left_semi")
        if isinstance(c, Both):
            return reduce(lambda x, part: self.restrict(x, type_, part), c.parts, d)
        if isinstance(c, Not):
            return d.join(self.matches(type_, c.part), "pid", "left_anti")
        return d.join(self.matches(type_, c), "pid", "left_semi")

    def matches(self, type_: str | None, c: Clause) -> DataFrame:
        if isinstance(c, Either):
            return reduce(DataFrame.unionByName, [self.matches(type_, p) for p in c.parts])
        if isinstance(c, Chain):
            return self.chain(type_, c)
        if isinstance(c, Has):
            return self.has(type_, c)
        if isinstance(c, Leaf) and not c.negate and not c.missing and c.param.kind not in ("id", "updated"):
            return self.pids(type_, c)
        if isinstance(c, Composite) and not c.missing:
            return self.composite(type_, c)
        return self.restrict(self.universe(type_), type_, c).select("pid")

    def pids(self, type_: str | None, c: Leaf) -> DataFrame:
        """pids of index rows with any of the values, or with any row at all where presence is asked."""
        if c.param.kind in ("narrative", "content"):
            d = self.tables.get("fulltext", type_)
            column = c.param.kind
            if c.missing is not None:
                return d.where(F.size(column) > 0).select("pid")
            tests = [reduce(lambda a, b: a & b, [F.array_contains(column, w) for w in ws]) if (ws := word_list(v.text)) else F.lit(False) for v in c.values]
            return d.where(any_of(tests)).select("pid")
        table = c.table or TABLES.get(c.param.kind)
        if table is None:
            raise SearchError(f"{c.param.code} can't be searched")
        code = f"{c.param.code}:of-type" if c.values and c.values[0].op == "of-type" else c.param.code
        d = self.rows(type_, table, code)
        if c.missing is None:
            d = d.where(any_of([value_test(table, v) for v in c.values]))
        return d.select("pid")

    def composite(self, type_: str | None, c: Composite) -> DataFrame:
        """Rows of one occurrence share pid and seq: the first component anchors, the others are semi joins on both."""
        if c.missing is not None:
            kind = c.param.components[0][1]
            return self.rows(type_, TABLES[kind], f"{c.param.code}$0").select("pid")

        def occurrence(parts: tuple[Leaf, ...]) -> DataFrame:
            hits = [self.rows(type_, TABLES[p.param.kind], p.param.code).where(value_test(TABLES[p.param.kind], p.values[0])).select("pid", "seq") for p in parts]
            return reduce(lambda a, b: a.join(b, ["pid", "seq"], "left_semi"), hits).select("pid")

        return reduce(DataFrame.unionByName, [occurrence(a) for a in c.alternatives])

    def chain(self, type_: str | None, c: Chain) -> DataFrame:
        refs = self.rows(type_, "reference", c.param.code).where(F.col("target_type") == c.target).select("pid", "target_id")
        targets = self.restrict(self.universe(c.target), c.target, c.clause).select(F.col("fhir_id").alias("target_id"))
        return refs.join(targets, "target_id", "left_semi").select("pid")

    def has(self, type_: str | None, c: Has) -> DataFrame:
        sources = self.restrict(self.universe(c.source), c.source, c.clause).select("pid")
        refs = self.rows(c.source, "reference", c.param.code).join(sources, "pid", "left_semi").select(F.col("target_type").alias("resource_type"), F.col("target_id").alias("fhir_id"))
        return self.universe(type_).join(refs, ["resource_type", "fhir_id"], "left_semi").select("pid")

    def search(self, plan: Plan) -> DataFrame:
        """The resources that meet all clauses of the plan, neither sorted nor paged."""
        return reduce(lambda d, c: self.restrict(d, plan.type, c), plan.clauses, self.universe(plan.type))
