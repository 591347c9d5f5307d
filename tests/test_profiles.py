"""Profiles with slices, and value set expansion."""

import pytest

from carelake.operators.profiles import Profile, Rule, Slice, Slicing, check
from carelake.operators.terminology import Unexpandable, code_system, expand

LOINC = "http://loinc.org"


def _slice(name, code):
    return Slice(name, (Rule("code", 1, "1", pattern={"coding": [{"system": LOINC, "code": code}]}), Rule("value", 1)), 1, "1")


BP = Profile("urn:bp", "Observation", (Rule("subject", 1), Rule("status", 1, fixed="final")), (Slicing("component", (("pattern", "code"),), (_slice("systolic", "8480-6"), _slice("diastolic", "8462-4"))),))


def _doc(*codes, **more):
    return {"resourceType": "Observation", "status": "final", "subject": {"reference": "Patient/1"}, "component": [{"code": {"coding": [{"system": LOINC, "code": c}]}, "valueQuantity": {"value": 1}} for c in codes], **more}


def test_slices():
    assert check(_doc("8480-6", "8462-4", "other"), BP) == []
    assert [i.path for i in check(_doc("8480-6"), BP)] == ["Observation.component:diastolic"]
    assert any("at most" in i.details for i in check(_doc("8480-6", "8480-6", "8462-4"), BP))
    assert any("must be" in i.details for i in check(_doc("8480-6", "8462-4", status="amended"), BP))
    assert any(i.path == "Observation.subject" for i in check({"resourceType": "Observation", "status": "final"}, BP))
    closed = Profile("u", "Observation", (), (Slicing("component", (("pattern", "code"),), BP.slicings[0].slices, "closed"),))
    assert any("no slice" in i.details for i in check(_doc("8480-6", "8462-4", "x"), closed))
    vague = Profile("u", "Observation", (), (Slicing("component", (("position", "$this"),), BP.slicings[0].slices),))
    assert any("NOT checked" in i.details for i in check(_doc("8480-6"), vague))


def test_expansion():
    s = code_system({"url": "s", "concept": [{"code": "a", "concept": [{"code": "b", "concept": [{"code": "c"}]}, {"code": "d", "property": [{"code": "kind", "valueCode": "x"}]}]}, {"code": "e"}]})
    rule = lambda op, value, prop="concept": {"compose": {"include": [{"system": "s", "filter": [{"property": prop, "op": op, "value": value}]}]}}
    sets = {"isa": rule("is-a", "b"), "below": rule("descendent-of", "a"), "not": rule("is-not-a", "b"), "eq": rule("=", "x", "kind"), "in": rule("in", "a, e"), "bad": rule("regex", "."), "loop": {"compose": {"include": [{"valueSet": ["loop"]}]}},
            "mixed": {"compose": {"include": [{"system": "s"}], "exclude": [{"valueSet": ["isa"]}]}}, "out": {"compose": {"include": [{"system": "t"}]}}}
    got = {k: {c for _, c in expand(k, sets, {"s": s})} for k in ("isa", "below", "not", "eq", "in", "mixed")}
    assert got == {"isa": {"b", "c"}, "below": {"b", "c", "d"}, "not": {"a", "d", "e"}, "eq": {"d"}, "in": {"a", "e"}, "mixed": {"a", "d", "e"}}
    for k in ("bad", "loop", "out", "absent"):
        with pytest.raises(Unexpandable):
            expand(k, sets, {"s": s})
