"""Schemas of the stored tables. Strings of the indexes are never null: '' stands for absent."""

from __future__ import annotations

RESOURCE = "pid long, resource_type string, fhir_id string, version_id long, last_updated long, deleted boolean, content string"
HISTORY = "resource_type string, fhir_id string, version_id long, last_updated long, deleted boolean, content string"

_KEY = "pid long, resource_type string, code string, seq int"
INDEXES = {
    "string": f"{_KEY}, norm string, exact string",
    "token": f"{_KEY}, system string, value string",
    "reference": f"{_KEY}, target_type string, target_id string, url string",
    "date": f"{_KEY}, low long, high long",
    "quantity": f"{_KEY}, low double, high double, system string, unit string",
    "uri": f"{_KEY}, value string",
    "number": f"{_KEY}, low double, high double",
}
FULLTEXT = "pid long, resource_type string, narrative array<string>, content array<string>"

#: Ends of open periods.
FIRST, LAST = -(2**63), 2**63 - 1
