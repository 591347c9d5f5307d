"""Parameters as columns against the interpreter, on ordinary and odd documents."""

import json

from pyspark.sql import functions as F

from carelake.functions.fhirpath.values import split_reference
from carelake.operators import extract_columns
from carelake.operators.extract import wide_rows
from carelake.plans.ranges import date_bounds, number_bounds
from carelake.registry import default

DOCS = [
    {"resourceType": "Patient", "id": "a1", "active": True, "name": [{"family": "Okafor", "given": ["Zoë", "  Ann  Lee "]}, {"text": "ÆON"}, {"given": [None, "Q"]}], "identifier": [{"system": "urn:x", "value": "17", "type": {"coding": [{"system": "urn:t", "code": "K"}, {"code": "L"}]}}, {"value": "no system"}], "birthDate": "1999-02", "deceasedDateTime": "2020-02-29T23:30:00+05:30", "address": [{"line": ["Long St 1", "b"], "city": "Straße", "country": "NZ"}], "telecom": [{"system": "phone", "value": "1 2"}], "communication": [{"language": {"coding": [{"code": "fr"}]}}], "maritalStatus": {"coding": [{"code": "M", "display": "Married"}, {"system": "s"}], "text": "wed"}, "extension": [{"url": "urn:balance", "valueQuantity": {"value": 12.50, "unit": "usd"}}, {"url": "urn:other", "valueQuantity": {"value": 1}}], "generalPractitioner": [{"reference": "Practitioner/p1/_history/2"}, {"identifier": {"system": "i", "value": "j"}}, {"reference": "https://host/fhir/Organization/o9"}, {"reference": "#inner"}, {"reference": "urn:uuid:1"}], "managingOrganization": {"reference": "Organization/7/"}, "meta": {"tag": [{"system": "t", "code": "u"}], "profile": ["http://p/1"]}},
    {"resourceType": "Patient", "id": "a2", "name": [], "gender": "female", "birthDate": "not a date", "contact": [{"name": {"family": "x"}}]},
    {"resourceType": "Observation", "id": "b1", "status": "final", "category": [{"text": "t1"}, {"coding": [{"code": "c2"}]}], "code": {"coding": [{"system": "l", "code": "8-1"}]}, "subject": {"reference": "Patient/a1"}, "effectivePeriod": {"start": "2021-03-04T10:11Z"}, "valueQuantity": {"value": 1.20e1, "code": "mg", "system": "ucum", "unit": "milli"}, "component": [{"code": {"coding": [{"code": "s"}]}, "valueQuantity": {"value": 120}}, {"code": {"text": "only"}, "valueString": "x"}, {"code": {"coding": [{"code": "d"}]}, "valueQuantity": {"value": -0.001, "unit": "u"}}]},
    {"resourceType": "Observation", "id": "b2", "code": {"coding": [{"code": "8-2"}]}, "subject": {"reference": "Group/g"}, "effectiveTiming": {"event": ["2020", "2021-05-06", "bad"]}, "valueCodeableConcept": {"coding": [{"code": "yes"}]}, "performer": [{"reference": "Organization/7"}]},
    {"resourceType": "Observation", "id": "b3", "effectiveInstant": "2020-01-01T00:00:00.123456Z", "valueString": "Ünwell"},
    {"resourceType": "Observation", "id": "b4", "effectiveDateTime": "9999-12", "valueQuantity": {"value": 7, "comparator": "<"}},
    {"resourceType": "Encounter", "id": "c1", "status": "F", "period": {"start": "2020-01-01", "end": "2020-01-03"}, "actualPeriod": {"start": "2020-01-01", "end": "2020-01-03"}, "subject": {"reference": "Patient/a1"}},
    {"resourceType": "Encounter", "id": "c2", "period": {"end": "2020"}, "priority": {"text": "now"}},
    {"resourceType": "Medication", "id": "d1", "code": {"coding": [{"code": "z"}], "text": "Small   Pill"}, "extension": [{"url": "urn:size", "valueInteger": 11}, {"url": "urn:price", "valueQuantity": {"value": 0.10}}, {"url": "urn:size", "valueString": "n"}]},
    {"resourceType": "ValueSet", "id": "e1", "url": "http://v/1?a=b", "title": "T É", "version": "1"},
    {"resourceType": "Organization", "id": "f1", "name": "Acme", "partOf": {"reference": "Organization/f0"}},
    {"resourceType": "Communication", "id": "g1", "category": [{"coding": [{"code": "r"}]}], "payload": [{"contentString": "<b>hi</b> you"}]},
    {"resourceType": "DocumentReference", "id": "h1", "language": "de", "date": "2020-02-30T00:00:00Z", "status": "current"},
]


def test_columns_give_the_rows_of_the_interpreter(spark):
    reg = default()
    rows = [(k, d["resourceType"], json.dumps(d), False) for k, d in enumerate(DOCS)] + [(90, "Patient", "{broken", False), (91, "Patient", None, False), (92, "Patient", json.dumps(DOCS[0]), True)]
    df = spark.createDataFrame(rows, "pid long, resource_type string, content string, deleted boolean")
    types = sorted({d["resourceType"] for d in DOCS})
    plain = lambda d: sorted(tuple("" if v is None else str(v) for v in r) for r in d.collect())
    assert plain(wide_rows(df, types)) == plain(wide_rows(df))
    assert plain(wide_rows(df, types, ["code", "date"], text=False)) == plain(wide_rows(df).where("code in ('code', 'date')"))
    for t in types:  # hardly anything is left to the interpreter
        params = [p for p in reg.params_of(t) if p.expression]
        taken, _ = extract_columns.compiled(t, params, reg)
        assert {p.code for p in params} - {p.code for p in taken} == set(), t
    assert wide_rows(df.limit(0), types).collect() == []


def test_bounds_and_references_as_columns(spark):
    dates = ["2020", "2020-02", "2020-02-29", "2021-02-29", "2020-12", "9999", "9999-12", "2020-01-01T10:00", "2020-01-01T10:00:59", "2020-01-01T10:00:59.1", "2020-01-01T10:00:59.123987-03:00", "2020-01-01T24:00:00Z", "2020-01-01T10:00:60Z", "0001-01-01", "1969-12-31T23:59:59.999Z", "x", "", " 2020 ", "2020-13"]
    numbers = ["1", "1.0", "-0.50", "1e3", "1.5e-3", "12E1", ".5", "5.", "+7", "123456789012345678901234", "0.1234567890123456789", "x", "", "NaN", "1e", "-", "100.10"]
    refs = ["Patient/1", "a/b/Patient/1", "Patient/1/_history/3", "#x", "urn:uuid:3", "Patient", "/Patient/1//", "patient/1", "http://h/Ä/1", ""]

    def bounds(f, text):
        try:
            return tuple(f(text))
        except (ValueError, ArithmeticError):
            return None, None

    for f, column, values in ((date_bounds, extract_columns.date_bounds, dates), (number_bounds, extract_columns.number_bounds, numbers)):
        low, high = column(F.col("v"))
        got = {r["v"]: (r["low"], r["high"]) for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", low.alias("low"), high.alias("high")).collect()}
        assert got == {v: bounds(f, v) for v in values}
    kind, id_ = extract_columns._reference(F.col("v"))
    got = {r["v"]: (r["k"], r["i"], r["v"]) for r in spark.createDataFrame([(v,) for v in refs], "v string").select("v", kind.alias("k"), id_.alias("i")).collect()}
    assert got == {v: split_reference(v) for v in refs}
