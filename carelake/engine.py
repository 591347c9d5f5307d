"""The search interface: a query's text in, a DataFrame or a bundle out."""

from __future__ import annotations

import json
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators.include import include
from .operators.lower import Lowering, Tables
from .operators.paging import next_cursor, order, page
from .plans.model import Plan
from .plans.params import Parser
from .registry import Registry


class Engine:
    def __init__(self, tables: Tables, registry: Registry | None = None):
        self.lowering, self.parser = Lowering(tables), Parser(registry)

    def plan(self, query: str) -> Plan:
        return self.parser.parse(query)

    def matches(self, query: str) -> DataFrame:
        """All resources that meet the query, without sorting or paging."""
        return self.lowering.search(self.plan(query))

    def ids(self, query: str) -> DataFrame:
        return self.matches(query).select(F.col("fhir_id").alias("id"))

    def count(self, query: str) -> DataFrame:
        return self.matches(query).agg(F.count("*").alias("total"))

    def page(self, query: str) -> DataFrame:
        """The page in order: id and rank from 1. The page is bounded, so one window over it is."""
        plan = self.plan(query)
        d = page(self.lowering, plan)
        return d.withColumn("rank", F.row_number().over(Window.orderBy(*order(plan.sorts)))).select(F.col("fhir_id").alias("id"), "rank")

    def page_with_includes(self, query: str) -> DataFrame:
        """resource_type, id and mode (match or include) of the page and what it includes."""
        plan = self.plan(query)
        d = page(self.lowering, plan)
        more = include(self.lowering, d, plan.type, plan.includes, self.parser.registry)
        row = lambda x, mode: x.select("resource_type", F.col("fhir_id").alias("id"), F.lit(mode).alias("mode"))
        return row(d, "match").unionByName(row(more, "include"))

    def bundle(self, query: str) -> dict:
        """A searchset: total, entries of the page and its includes, and paging links."""
        from .operators.subset import shaped

        plan = self.plan(query)
        found = self.lowering.search(plan)
        out: dict = {"resourceType": "Bundle", "type": "searchset"}
        if plan.total != "none":
            out["total"] = found.count()
        links = [{"relation": "self", "url": query}]
        if plan.count and plan.summary != "count":
            d = page(self.lowering, plan)
            rows = d.collect()  # the page: MAX_COUNT rows at most
            entries = [(r, "match") for r in rows]
            if plan.includes:
                entries += [(r, "include") for r in include(self.lowering, d, plan.type, plan.includes, self.parser.registry).collect()]
            out["entry"] = [{"fullUrl": f"{r['resource_type']}/{r['fhir_id']}", "resource": shaped(json.loads(r["content"]), plan.summary, plan.elements, self.parser.registry), "search": {"mode": mode}} for r, mode in entries]
            cursor = next_cursor(rows, plan)
            if cursor:
                head, _, rest = query.partition("?")
                kept = [(k, v) for k, v in parse_qsl(rest, keep_blank_values=True) if k not in ("_offset", "_cursor")]
                links.append({"relation": "next", "url": f"{head}?{urlencode([*kept, ('_cursor', cursor)])}"})
        out["link"] = links
        return out

    def document(self, query: str, accept: str = "") -> str:
        """The searchset as text, in the form that _format asks for, or else the first known one of accept, or else JSON."""
        from .sources.documents import to_json, to_xml

        asked = [v for k, v in parse_qsl(query.partition("?")[2]) if k == "_format"]
        found = self.bundle(query)
        return to_xml(found) if media(asked[0] if asked else "", accept) == "xml" else to_json(found)


#: Names of the two forms.
FORMS = {"json": ("application/fhir+json", "application/json", "json", "text/json", "*/*", "application/*"), "xml": ("application/fhir+xml", "application/xml", "xml", "text/xml")}


def media(asked: str, accept: str = "") -> str:
    """json or xml: what is asked for by name, or else the first entry of accept that is one of them; JSON by default."""
    for name in (asked, *(part.partition(";")[0].strip() for part in accept.split(","))):
        for form, names in FORMS.items():
            if name.lower().replace(" ", "+") in names:
                return form
    return "json"
