"""Resource documents in JSON and XML: readers, writers, and folders of them as DataFrames.

Numbers are kept as written in both directions. XML is read by the registry, which
decides what repeats; unknown elements are read as repeating where they do.
"""

from __future__ import annotations

import json
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DocumentError
from ..functions.fhirpath.values import Number, parse_json
from ..registry import Registry, default

NS, XHTML = "{http://hl7.org/fhir}", "{http://www.w3.org/1999/xhtml}"


def from_json(text: str, registry: Registry | None = None) -> dict:
    registry = registry or default()
    try:
        doc = parse_json(text)
    except ValueError as e:
        raise DocumentError(f"not JSON: {e}") from None
    if not isinstance(doc, dict):
        raise DocumentError("a resource is a JSON object")
    if "resourceType" not in doc:
        raise DocumentError("resourceType is missing")
    if doc["resourceType"] not in registry.resources():
        raise DocumentError(f"unknown resource type {doc['resourceType']}")
    return doc


def _ordered(d: dict, owner: tuple[str, str] | None, registry: Registry) -> list[str]:
    """Members in the order of their definitions, each with its sidecar; unknown ones at the end by name."""
    rank = {k[:-3] if k.endswith("[x]") else k: n for n, k in enumerate(registry.children(*owner))} if owner else {}

    def place(k: str) -> tuple:
        bare = k.lstrip("_")
        step = registry.step(*owner, bare) if owner else None
        name = step[0].path.rpartition(".")[2].removesuffix("[x]") if step else bare
        return (k != "resourceType", rank.get(name, len(rank)), bare, k.startswith("_"))

    return sorted(d, key=place)


def to_json(doc: dict, indent: int | None = None, registry: Registry | None = None) -> str:
    registry = registry or default()

    def write(v: Any, owner: tuple[str, str] | None, depth: int) -> str:
        pad, gap = ("\n" + " " * (indent * (depth + 1)), "\n" + " " * (indent * depth)) if indent else ("", "")
        if isinstance(v, dict):
            if "resourceType" in v:
                owner = (v["resourceType"], "")
            parts = []
            for k in _ordered(v, owner, registry):
                step = registry.step(*owner, k.lstrip("_")) if owner else None
                parts.append(f"{json.dumps(k)}:{' ' if indent else ''}{write(v[k], (step[2], step[3]) if step else None, depth + 1)}")
            return "{" + pad + f",{pad}".join(parts) + gap + "}" if parts else "{}"
        if isinstance(v, list):
            return "[" + pad + f",{pad}".join(write(x, owner, depth + 1) for x in v) + gap + "]" if v else "[]"
        if isinstance(v, Number):
            return str.__str__(v)
        return json.dumps(v, ensure_ascii=False)

    return write(doc, None, 0)


def from_xml(text: str, registry: Registry | None = None) -> dict:
    registry = registry or default()
    try:
        top = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise DocumentError(f"not XML: {e}") from None
    name = top.tag.removeprefix(NS)
    if name not in registry.resources():
        raise DocumentError(f"unknown resource type {name}")
    return _resource(top, registry)


def _resource(e: ElementTree.Element, registry: Registry) -> dict:
    name = e.tag.removeprefix(NS)
    return {"resourceType": name} | _members(e, (name, ""), registry)


def _members(e: ElementTree.Element, owner: tuple[str, str], registry: Registry) -> dict:
    out: dict[str, Any] = {}
    for k in ("id", "url"):
        if k in e.attrib:
            out[k] = e.attrib[k]
    groups: dict[str, list[ElementTree.Element]] = {}
    for child in e:
        groups.setdefault(child.tag.removeprefix(NS).removeprefix(XHTML), []).append(child)
    for name, children in groups.items():
        step = registry.step(*owner, name)
        values, sides = [], []
        for child in children:
            if child.tag.startswith(XHTML):
                values.append(_markup(child))
                sides.append(None)
                continue
            if step and step[1] == "Resource" and len(child):
                values.append(_resource(child[0], registry))
                sides.append(None)
                continue
            inner = (step[2], step[3]) if step else ("Element", "")
            primitive = step and registry.types.get(step[1]) and registry.types[step[1]].kind == "primitive" or not step and "value" in child.attrib
            if primitive:
                values.append(_scalar(child.attrib.get("value"), step[1] if step else "string"))
                side = {k: v for k, v in _members(child, ("Element", ""), registry).items() if k != "value"}
                sides.append(side or None)
            else:
                values.append(_members(child, inner, registry))
                sides.append(None)
        many = step[0].many if step else len(children) > 1
        if any(v is not None for v in values):
            out[name] = values if many else values[0]
        if any(sides):
            out[f"_{name}"] = sides if many else sides[0]
    return out


def _scalar(text: str | None, type_: str) -> Any:
    if text is None:
        return None
    if type_ == "boolean" and text in ("true", "false"):
        return text == "true"
    if type_ in ("decimal", "integer", "positiveInt", "unsignedInt"):
        try:
            float(text)
            return Number(text)
        except ValueError:
            return text
    return text


def _markup(e: ElementTree.Element) -> str:
    def write(x: ElementTree.Element, top: bool) -> str:
        name = x.tag.removeprefix(XHTML)
        attributes = (' xmlns="http://www.w3.org/1999/xhtml"' if top else "") + "".join(f" {k}={quoteattr(v)}" for k, v in x.attrib.items())
        body = escape(x.text or "") + "".join(write(c, False) + escape(c.tail or "") for c in x)
        return f"<{name}{attributes}>{body}</{name}>" if body else f"<{name}{attributes}/>"

    return write(e, True)


def to_xml(doc: dict, indent: int | None = None, registry: Registry | None = None) -> str:
    registry = registry or default()

    def element(name: str, v: Any, side: Any, owner: tuple[str, str] | None, depth: int, attributes: str = "") -> str:
        pad = "\n" + " " * (indent * (depth + 1)) if indent else ""
        end = "\n" + " " * (indent * depth) if indent else ""
        if name == "div" and isinstance(v, str):
            return v
        if isinstance(v, dict) and "resourceType" in v:
            return f"<{name}>{pad}{resource(v, depth + 1)}{end}</{name}>"
        if isinstance(v, dict):
            inner = dict(v)
            if "id" in inner:
                attributes += f" id={quoteattr(str(inner.pop('id')))}"
            if owner and owner[0] == "Extension" and "url" in inner:
                attributes += f" url={quoteattr(str(inner.pop('url')))}"
            body = members(inner, owner, depth + 1)
        else:
            if v is not None:
                attributes += f" value={quoteattr('true' if v is True else 'false' if v is False else str(v))}"
            side = dict(side or {})
            if "id" in side:
                attributes += f" id={quoteattr(str(side.pop('id')))}"
            body = members(side, ("Element", ""), depth + 1)
        return f"<{name}{attributes}>{pad}{pad.join(body)}{end}</{name}>" if body else f"<{name}{attributes}/>"

    def members(d: dict, owner: tuple[str, str] | None, depth: int) -> list[str]:
        out: list[str] = []
        for k in _ordered(d, owner, registry):
            if k == "resourceType" or k.startswith("_") and k[1:] in d:
                continue
            bare = k.lstrip("_")
            step = registry.step(*owner, bare) if owner else None
            inner = (step[2], step[3]) if step else None
            value, side = d.get(bare), d.get(f"_{bare}")
            values = value if isinstance(value, list) else [value]
            sides = side if isinstance(side, list) else [side]
            for n in range(max(len(values), len(sides))):
                out.append(element(bare, values[n] if n < len(values) else None, sides[n] if n < len(sides) else None, inner, depth))
        return out

    def resource(d: dict, depth: int) -> str:
        pad = "\n" + " " * (indent * (depth + 1)) if indent else ""
        end = "\n" + " " * (indent * depth) if indent else ""
        name, space = d["resourceType"], ' xmlns="http://hl7.org/fhir"' if not depth else ""
        body = members(d, (name, ""), depth + 1)
        return f"<{name}{space}>{pad}{pad.join(body)}{end}</{name}>" if body else f"<{name}{space}/>"

    return resource(doc, 0)


def read_folder(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """One row for each file: path, resource_type, fhir_id, content (canonical JSON) and error, null if it could be read."""
    from collections.abc import Iterator

    import pyarrow as pa

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    doc = from_json(text) if form == "json" else from_xml(text)
                    rows.append((p, doc["resourceType"], doc.get("id"), to_json(doc), None))
                except DocumentError as e:
                    rows.append((p, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows) if rows else [[]] * 5)], ["path", "resource_type", "fhir_id", "content", "error"])

    return files.mapInArrow(run, "path string, resource_type string, fhir_id string, content string, error string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Resources of newline-delimited JSON: resource_type, fhir_id, content as written."""
    d = spark.read.text(path).where(F.trim("value") != "")
    return d.select(F.get_json_object("value", "$.resourceType").alias("resource_type"), F.get_json_object("value", "$.id").alias("fhir_id"), F.col("value").alias("content"))


def write_lines(resources: DataFrame, path: str) -> None:
    resources.where("content is not null").select(F.col("content").alias("value")).write.text(path)
