"""Includes: resources that a page refers to, or that refer to it, over up to five rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import MAX_ROUNDS, Include
from ..registry import Registry
from ..workspace import materialised
from .lower import Lowering

COLUMNS = ["pid", "resource_type", "fhir_id", "version_id", "last_updated", "deleted", "content"]


def include(low: Lowering, page: DataFrame, type_: str | None, specs: list[Include], registry: Registry) -> DataFrame:
    """Resources beyond the page, each once.

    Rounds after the first follow iterating specs only, from what the round
    before has added. Which types a round can add is known from the parameters,
    so a round joins these types' tables only and the loop ends where nothing was
    added. Nothing is collected.
    """
    known = registry.resources()
    fresh = {t: page.where(F.col("resource_type") == t) for t in ([type_] if type_ else known)}
    seen = {t: [d] for t, d in fresh.items()}
    added: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        keys: dict[str, list[DataFrame]] = {}  # fhir_ids to fetch, by type
        pids: dict[str, list[DataFrame]] = {}
        for s in specs:
            if turn and not s.iterate:
                continue
            if s.reverse:
                p = registry.param(s.source, s.param)
                for t, d in fresh.items():
                    if t in p.targets and s.target in (None, t):
                        refs = low.rows(s.source, "reference", s.param).where(F.col("target_type") == t)
                        pids.setdefault(s.source, []).append(refs.join(d.select(F.col("fhir_id").alias("target_id")), "target_id", "left_semi").select("pid"))
                continue
            for t, d in fresh.items():
                if s.source not in ("*", t):
                    continue
                codes = [p for p in registry.params_of(t) if p.kind == "reference" and s.param in ("*", p.code)]
                targets = {x for p in codes for x in p.targets if x in known and s.target in (None, x)}
                if codes:
                    refs = low.tables.get("reference", t, None if s.param == "*" else s.param).join(d.select("pid"), "pid", "left_semi")
                    for x in sorted(targets):
                        keys.setdefault(x, []).append(refs.where(F.col("target_type") == x).select(F.col("target_id").alias("fhir_id")))
        fresh = {}
        for t in sorted({*keys, *pids}):
            found = [low.universe(t).join(reduce(DataFrame.unionByName, k), on, "left_semi") for on, k in (("fhir_id", keys.get(t)), ("pid", pids.get(t))) if k]
            d = reduce(DataFrame.unionByName, found) if len(found) == 1 else reduce(DataFrame.unionByName, found).dropDuplicates(["pid"])
            for old in seen.get(t, []):
                d = d.join(old.select("pid"), "pid", "left_anti")
            d = d.select(*COLUMNS)
            if any(s.iterate for s in specs):  # a round that others build on is written, or plans would double with each
                d = materialised(d)
                if d.isEmpty():
                    continue
            fresh[t] = d
            seen.setdefault(t, []).append(d)
            added.append(d)
        if not fresh:
            break
    return reduce(DataFrame.unionByName, added) if added else page.select(*COLUMNS).limit(0)
