"""The conformance compiler and the SQL sources."""

import pytest

from carelake.conformance import compile_registry, profile
from carelake.engine import media
from carelake.operators.profiles import check
from carelake.operators.validate import Validator
from carelake.registry import Registry
from carelake.sources.sql import jdbc_options, read_sqlite, write_sqlite

SHIP = {
    "resourceType": "StructureDefinition", "url": "http://hl7.org/fhir/StructureDefinition/Ship", "type": "Ship", "kind": "resource", "derivation": "specialization", "baseDefinition": "http://hl7.org/fhir/StructureDefinition/DomainResource",
    "snapshot": {"element": [
        {"path": "Ship", "constraint": [{"key": "shp-1", "severity": "error", "human": "named or numbered", "expression": "name.exists() or number.exists()", "source": "http://hl7.org/fhir/StructureDefinition/Ship"}]},
        {"path": "Ship.id", "base": {"path": "Resource.id"}, "type": [{"code": "id"}]}, {"path": "Ship.name", "min": 0, "max": "1", "type": [{"code": "string"}]}, {"path": "Ship.number", "min": 0, "max": "1", "type": [{"code": "positiveInt"}]},
        {"path": "Ship.flag", "min": 1, "max": "1", "type": [{"code": "code"}], "binding": {"strength": "required", "valueSet": "urn:vs/flags|2"}}, {"path": "Ship.deck", "min": 0, "max": "*", "type": [{"code": "BackboneElement"}]},
        {"path": "Ship.deck.code", "min": 1, "max": "1", "type": [{"code": "CodeableConcept"}]}, {"path": "Ship.deck.size[x]", "min": 0, "max": "1", "type": [{"code": "integer"}, {"code": "string"}]},
    ]},
}
FLAGS = [{"resourceType": "CodeSystem", "url": "urn:cs/flags", "concept": [{"code": "red"}, {"code": "blue"}]}, {"resourceType": "ValueSet", "url": "urn:vs/flags", "compose": {"include": [{"system": "urn:cs/flags"}]}}]
FERRY = {
    "resourceType": "StructureDefinition", "url": "urn:profile/ferry", "type": "Ship", "kind": "resource", "derivation": "constraint",
    "snapshot": {"element": [
        {"id": "Ship", "path": "Ship"}, {"id": "Ship.name", "path": "Ship.name", "min": 1, "max": "1"}, {"id": "Ship.deck", "path": "Ship.deck", "min": 1, "max": "*", "slicing": {"discriminator": [{"type": "pattern", "path": "code"}], "rules": "closed"}},
        {"id": "Ship.deck:cars", "path": "Ship.deck", "min": 1, "max": "1"}, {"id": "Ship.deck:cars.code", "path": "Ship.deck.code", "min": 1, "max": "1", "patternCodeableConcept": {"coding": [{"code": "cars"}]}},
        {"id": "Ship.deck:sun", "path": "Ship.deck", "min": 0, "max": "0"}, {"id": "Ship.deck:sun.code", "path": "Ship.deck.code", "min": 1, "max": "1", "patternCodeableConcept": {"coding": [{"code": "sun"}]}},
    ]},
}


def test_compiled_types_validate():
    registry = compile_registry([SHIP, *FLAGS, FERRY], Registry())
    v = Validator(registry)
    found = lambda doc: {(i.code, i.key) for i in v.validate({"resourceType": "Ship", **doc}) if i.severity == "error"}
    assert found({"name": "A", "flag": "red", "deck": [{"code": {"text": "x"}, "sizeInteger": 3}]}) == set()
    assert found({"flag": "green"}) == {("code-invalid", "flags"), ("invariant", "shp-1")}
    assert ("required", "") in found({"name": "A"}) and ("structure", "") in found({"name": "A", "flag": "red", "mast": 1})
    assert not any(registry.types["Ship"].elements[p].path == "id" for p in registry.types["Ship"].elements)


def test_profiles_are_compiled_with_their_slices():
    registry = compile_registry([SHIP, *FLAGS], Registry())
    ferry = profile(FERRY, registry)
    assert {(r.path, r.min, r.max) for r in ferry.rules} == {("name", 1, "*"), ("deck", 1, "*")}
    deck = lambda code: {"code": {"coding": [{"code": code}]}}
    ship = lambda *decks: {"resourceType": "Ship", "name": "A", "flag": "red", "deck": [deck(d) for d in decks]}
    assert check(ship("cars"), ferry, registry) == []
    assert {i.code for i in check(ship("cars", "cars"), ferry, registry)} == {"structure"} and {i.code for i in check(ship("sun"), ferry, registry)} == {"structure", "required"}
    assert [i.details for i in check(ship("cars", "hold"), ferry, registry)] == ["belongs to no slice"]


def test_sqlite_folder(spark, tmp_path):
    d = spark.createDataFrame([(k, None if k % 4 == 0 else f"té{k}'\"", k / 3, k % 2 == 0, bytes([k])) for k in range(50)], 'a long, `b "q"` string, c double, d boolean, e binary').repartition(3)
    assert write_sqlite(d, f"file://{tmp_path}/db") == 50
    back = read_sqlite(spark, f"file://{tmp_path}/db", d.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, d.collect()))
    assert write_sqlite(d.limit(0), f"file://{tmp_path}/none") == 0
    with pytest.raises(ValueError):
        write_sqlite(spark.sql("select array(1) as x"), f"file://{tmp_path}/bad")


def test_jdbc_reads_in_ranges():
    got = jdbc_options("jdbc:postgresql://h/db", "history", "pid", (3, 900), 4, user="u")
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"], got["numPartitions"], got["user"]) == ("pid", "3", "900", "4", "u")
    assert "partitionColumn" not in jdbc_options("jdbc:postgresql://h/db", "history")


@pytest.mark.parametrize("asked,accept,want", [("xml", "", "xml"), ("application/fhir+json", "application/xml", "json"), ("pdf", "text/xml;q=1", "xml"), ("", "text/html", "json"), ("", "*/*, text/xml", "json"), ("application/fhir xml", "", "xml")])
def test_forms(asked, accept, want):
    assert media(asked, accept) == want
