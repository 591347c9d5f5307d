"""Subsets of documents: named elements and the summary modes."""

from __future__ import annotations

from ..registry import Registry, default

ALWAYS = ("resourceType", "id", "meta", "implicitRules", "modifierExtension")
TAG = {"system": "http://terminology.hl7.org/CodeSystem/v3-ObservationValue", "code": "SUBSETTED"}


def tagged(doc: dict) -> dict:
    meta = dict(doc.get("meta") or {})
    tags = list(meta.get("tag") or [])
    if not any(t.get("system") == TAG["system"] and t.get("code") == TAG["code"] for t in tags):
        tags.append(dict(TAG))
    out = {k: v for k, v in doc.items() if k != "meta"}
    return {k: out[k] for k in ("resourceType", "id") if k in out} | {"meta": meta | {"tag": tags}} | {k: v for k, v in out.items() if k not in ("resourceType", "id")}


def _bare(name: str) -> str:
    return name[1:] if name.startswith("_") else name


def elements(doc: dict, names: tuple[str, ...], registry: Registry | None = None) -> dict:
    registry = registry or default()
    wanted = {*ALWAYS, *names}

    def keeps(name: str) -> bool:
        step = registry.step(doc.get("resourceType", ""), "", name)
        return name in wanted or bool(step and step[0].choice and step[0].path[:-3] in wanted)

    return tagged({k: v for k, v in doc.items() if keeps(_bare(k))})


def summary(doc: dict, registry: Registry | None = None) -> dict:
    registry = registry or default()

    def part(node, type_: str, path: str):
        if isinstance(node, list):
            return [part(x, type_, path) for x in node]
        if not isinstance(node, dict):
            return node
        out = {}
        for k, v in node.items():
            if k == "resourceType":
                out[k] = v
                continue
            step = registry.step(type_, path, _bare(k))
            if step and (step[0].summary or step[0].min > 0):
                out[k] = part(v, step[2], step[3])
        return out

    return tagged(part(doc, doc.get("resourceType", ""), ""))


def shaped(doc: dict, mode: str = "false", names: tuple[str, ...] = (), registry: Registry | None = None) -> dict:
    if names:
        return elements(doc, names, registry)
    if mode == "true":
        return summary(doc, registry)
    if mode == "text":
        registry = registry or default()
        required = {k for k, e in registry.children(doc.get("resourceType", "")).items() if e.min > 0}
        return tagged({k: v for k, v in doc.items() if k in (*ALWAYS, "text") or _bare(k) in required})
    if mode == "data":
        return tagged({k: v for k, v in doc.items() if k != "text"})
    return doc
