"""Sorting by the lowest index value, keyset paging and counts."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError
from ..plans.model import Plan, Sort
from ..schemas import FIRST
from .lower import Lowering

#: Column that sorts, and what stands for a resource without a value.
KEYS = {"string": ("norm", ""), "token": ("value", ""), "reference": ("target_id", ""), "uri": ("value", ""), "date": ("low", FIRST), "quantity": ("low", -1e308), "number": ("low", -1e308)}


def encode_cursor(values: list, pid: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([*values, pid]).encode()).decode().rstrip("=")


def decode_cursor(text: str, keys: int) -> list:
    try:
        out = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError:
        raise SearchError("the cursor can't be read") from None
    if not isinstance(out, list) or len(out) != keys + 1:
        raise SearchError("the cursor is of another sort order")
    return out


def with_keys(low: Lowering, d: DataFrame, type_: str | None, sorts: list[Sort]) -> DataFrame:
    """Adds key0, key1, …: each resource's lowest value."""
    for k, s in enumerate(sorts):
        if s.param.kind == "id":
            d = d.withColumn(f"key{k}", F.col("fhir_id"))
        elif s.param.kind == "updated":
            d = d.withColumn(f"key{k}", F.col("last_updated"))
        else:
            column, absent = KEYS[s.param.kind]
            least = low.rows(type_, s.param.kind, s.param.code).groupBy("pid").agg(F.min(column).alias(f"key{k}"))
            d = d.join(least, "pid", "left").withColumn(f"key{k}", F.coalesce(f"key{k}", F.lit(absent)))
    return d


def order(sorts: list[Sort]) -> list[Column]:
    return [F.desc(f"key{k}") if s.descending else F.asc(f"key{k}") for k, s in enumerate(sorts)] + [F.asc("pid")]


def after(sorts: list[Sort], cursor: list) -> Column:
    """Rows past the cursor: greater in the first key that differs, pid last."""
    tests = []
    for k in range(len(sorts) + 1):
        same = [F.col(f"key{j}") == F.lit(cursor[j]) for j in range(k)]
        column = F.col("pid") if k == len(sorts) else F.col(f"key{k}")
        past = column < F.lit(cursor[k]) if k < len(sorts) and sorts[k].descending else column > F.lit(cursor[k])
        tests.append(reduce(lambda a, b: a & b, [*same, past]))
    return reduce(lambda a, b: a | b, tests)


def page(low: Lowering, plan: Plan) -> DataFrame:
    """The page's resources with their keys, in order; the limit is a top-k, never a full sort."""
    d = with_keys(low, low.search(plan), plan.type, plan.sorts)
    if plan.cursor:
        d = d.where(after(plan.sorts, decode_cursor(plan.cursor, len(plan.sorts))))
    d = d.orderBy(*order(plan.sorts))
    if plan.offset and not plan.cursor:
        d = d.offset(plan.offset)
    return d.limit(plan.count)


def next_cursor(rows: list, plan: Plan) -> str | None:
    """Only a full page has a next one."""
    if not plan.count or len(rows) < plan.count:
        return None
    return encode_cursor([rows[-1][f"key{k}"] for k in range(len(plan.sorts))], rows[-1]["pid"])
