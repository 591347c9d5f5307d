"""The conformance subset: resource types, elements, search parameters, compartments, value sets, invariants.

Authored by hand from the public specification for the types that the engine
ships with; load() adds more from plain dictionaries of the same form.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache


@dataclass(frozen=True)
class Element:
    """path is relative to its type; types name datatypes, a leading # an element whose content is reused."""

    path: str
    types: tuple[str, ...]
    min: int = 0
    max: str = "1"
    targets: tuple[str, ...] = ()
    binding: str | None = None
    strength: str | None = None
    summary: bool = False

    @property
    def many(self) -> bool:
        return self.max != "1"

    @property
    def choice(self) -> bool:
        return self.path.endswith("[x]")


@dataclass(frozen=True)
class Param:
    code: str
    kind: str
    base: tuple[str, ...]
    expression: str = ""
    targets: tuple[str, ...] = ()
    components: tuple[tuple[str, str, str], ...] = ()  # code, kind, expression within an occurrence


@dataclass(frozen=True)
class Invariant:
    key: str
    severity: str
    human: str
    expression: str
    path: str = ""


@dataclass
class TypeDef:
    name: str
    kind: str  # resource, datatype or primitive
    base: str | None = None
    elements: dict[str, Element] = field(default_factory=dict)
    invariants: list[Invariant] = field(default_factory=list)
    pattern: str | None = None


def _elements(text: str) -> dict[str, Element]:
    """Lines of: path types min..max [->targets] [=binding strength] [*]; * marks the summary."""
    out = {}
    for line in text.strip().splitlines():
        words = line.split()
        lo, hi = words[2].split("..")
        e = Element(words[0], tuple(words[1].split("|")), int(lo), hi, summary="*" in words)
        for w in words[3:]:
            if w.startswith("->"):
                e = Element(e.path, e.types, e.min, e.max, tuple(w[2:].split("|")), e.binding, e.strength, e.summary)
            elif w.startswith("="):
                name, strength = w[1:].split(":")
                e = Element(e.path, e.types, e.min, e.max, e.targets, name, strength, e.summary)
        out[e.path] = e
    return out


#: Lexical forms of the primitives.
PRIMITIVES = {
    "boolean": r"true|false",
    "integer": r"[0]|[-+]?[1-9][0-9]*",
    "string": r"^[\s\S]+$",
    "decimal": r"-?(0|[1-9][0-9]{0,17})(\.[0-9]{1,17})?([eE][+-]?[0-9]{1,9})?",
    "uri": r"\S*",
    "url": r"\S*",
    "canonical": r"\S*",
    "base64Binary": r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?",
    "instant": r"([0-9]([0-9]([0-9][1-9]|[1-9]0)|[1-9]00)|[1-9]000)-(0[1-9]|1[0-2])-(0[1-9]|[1-2][0-9]|3[0-1])T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]{1,9})?(Z|(\+|-)((0[0-9]|1[0-3]):[0-5][0-9]|14:00))",
    "date": r"([0-9]([0-9]([0-9][1-9]|[1-9]0)|[1-9]00)|[1-9]000)(-(0[1-9]|1[0-2])(-(0[1-9]|[1-2][0-9]|3[0-1]))?)?",
    "dateTime": r"([0-9]([0-9]([0-9][1-9]|[1-9]0)|[1-9]00)|[1-9]000)(-(0[1-9]|1[0-2])(-(0[1-9]|[1-2][0-9]|3[0-1])(T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]{1,9})?(Z|(\+|-)((0[0-9]|1[0-3]):[0-5][0-9]|14:00))?)?)?)?",
    "time": r"([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]{1,9})?",
    "code": r"[^\s]+( [^\s]+)*",
    "id": r"[A-Za-z0-9\-\.]{1,64}",
    "oid": r"urn:oid:[0-2](\.(0|[1-9][0-9]*))+",
    "uuid": r"urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "markdown": r"^[\s\S]+$",
    "unsignedInt": r"[0]|([1-9][0-9]*)",
    "positiveInt": r"\+?[1-9][0-9]*",
    "xhtml": r"[\s\S]*",
    "integer64": r"[0]|[-+]?[1-9][0-9]*",
}
#: Primitive types derived from others.
PRIMITIVE_BASE = {"url": "uri", "canonical": "uri", "oid": "uri", "uuid": "uri", "code": "string", "id": "string", "markdown": "string", "unsignedInt": "integer", "positiveInt": "integer"}

DATATYPES = {
    "Extension": "url uri 1..1\nvalue[x] boolean|integer|string|decimal|uri|code|date|dateTime|instant|Coding|CodeableConcept|Quantity|Reference|Identifier|Period|Address|HumanName|ContactPoint 0..1",
    "Meta": "versionId id 0..1 *\nlastUpdated instant 0..1 *\nsource uri 0..1 *\nprofile canonical 0..* *\nsecurity Coding 0..* *\ntag Coding 0..* *",
    "Narrative": "status code 1..1 =narrative-status:required\ndiv xhtml 1..1",
    "Identifier": "use code 0..1 =identifier-use:required *\ntype CodeableConcept 0..1 *\nsystem uri 0..1 *\nvalue string 0..1 *\nperiod Period 0..1 *\nassigner Reference 0..1 ->Organization *",
    "HumanName": "use code 0..1 =name-use:required *\ntext string 0..1 *\nfamily string 0..1 *\ngiven string 0..* *\nprefix string 0..* *\nsuffix string 0..* *\nperiod Period 0..1 *",
    "Address": "use code 0..1 =address-use:required *\ntype code 0..1 *\ntext string 0..1 *\nline string 0..* *\ncity string 0..1 *\ndistrict string 0..1 *\nstate string 0..1 *\npostalCode string 0..1 *\ncountry string 0..1 *\nperiod Period 0..1 *",
    "ContactPoint": "system code 0..1 =contact-point-system:required *\nvalue string 0..1 *\nuse code 0..1 =contact-point-use:required *\nrank positiveInt 0..1 *\nperiod Period 0..1 *",
    "Coding": "system uri 0..1 *\nversion string 0..1 *\ncode code 0..1 *\ndisplay string 0..1 *\nuserSelected boolean 0..1 *",
    "CodeableConcept": "coding Coding 0..* *\ntext string 0..1 *",
    "Quantity": "value decimal 0..1 *\ncomparator code 0..1 =quantity-comparator:required *\nunit string 0..1 *\nsystem uri 0..1 *\ncode code 0..1 *",
    "Range": "low Quantity 0..1 *\nhigh Quantity 0..1 *",
    "Ratio": "numerator Quantity 0..1 *\ndenominator Quantity 0..1 *",
    "Period": "start dateTime 0..1 *\nend dateTime 0..1 *",
    "Timing": "event dateTime 0..* *\ncode CodeableConcept 0..1 *",
    "Reference": "reference string 0..1 *\ntype uri 0..1 *\nidentifier Identifier 0..1 *\ndisplay string 0..1 *",
    "Attachment": "contentType code 0..1 *\nlanguage code 0..1 *\ndata base64Binary 0..1\nurl url 0..1 *\nsize unsignedInt 0..1 *\nhash base64Binary 0..1 *\ntitle string 0..1 *\ncreation dateTime 0..1 *",
    "Annotation": "author[x] Reference|string 0..1 *\ntime dateTime 0..1 *\ntext markdown 1..1 *",
    "TypeInfo": "namespace string 1..1\nname string 1..1",
    "Age": "", "Count": "", "Distance": "", "Duration": "", "SimpleQuantity": "", "MoneyQuantity": "",
}
QUANTITIES = ("Quantity", "Age", "Count", "Distance", "Duration", "SimpleQuantity", "MoneyQuantity")

_COMMON = "id id 0..1 *\nmeta Meta 0..1 *\nimplicitRules uri 0..1 *\nlanguage code 0..1"
_DOMAIN = "text Narrative 0..1\ncontained Resource 0..*\nextension Extension 0..*\nmodifierExtension Extension 0..* *"

RESOURCES = {
    "Patient": """identifier Identifier 0..* *
active boolean 0..1 *
name HumanName 0..* *
telecom ContactPoint 0..* *
gender code 0..1 =administrative-gender:required *
birthDate date 0..1 *
deceased[x] boolean|dateTime 0..1 *
address Address 0..* *
maritalStatus CodeableConcept 0..1 =marital-status:extensible
multipleBirth[x] boolean|integer 0..1
contact BackboneElement 0..*
contact.relationship CodeableConcept 0..*
contact.name HumanName 0..1
contact.telecom ContactPoint 0..*
contact.gender code 0..1 =administrative-gender:required
contact.organization Reference 0..1 ->Organization
communication BackboneElement 0..*
communication.language CodeableConcept 1..1 =languages:preferred
communication.preferred boolean 0..1
generalPractitioner Reference 0..* ->Organization|Practitioner|PractitionerRole
managingOrganization Reference 0..1 ->Organization *
link BackboneElement 0..* *
link.other Reference 1..1 ->Patient *
link.type code 1..1 =link-type:required *""",
    "Observation": """identifier Identifier 0..* *
basedOn Reference 0..* *
partOf Reference 0..* *
status code 1..1 =observation-status:required *
category CodeableConcept 0..*
code CodeableConcept 1..1 *
subject Reference 0..1 ->Patient|Group|Device|Location *
encounter Reference 0..1 ->Encounter *
effective[x] dateTime|Period|Timing|instant 0..1 *
issued instant 0..1 *
performer Reference 0..* ->Practitioner|PractitionerRole|Organization|Patient *
value[x] Quantity|CodeableConcept|string|boolean|integer|Range|Ratio|time|dateTime|Period 0..1 *
dataAbsentReason CodeableConcept 0..1 =data-absent-reason:extensible
interpretation CodeableConcept 0..*
note Annotation 0..*
bodySite CodeableConcept 0..1
method CodeableConcept 0..1
device Reference 0..1 ->Device
referenceRange BackboneElement 0..*
referenceRange.low Quantity 0..1
referenceRange.high Quantity 0..1
referenceRange.text string 0..1
hasMember Reference 0..* ->Observation *
derivedFrom Reference 0..* ->Observation|DocumentReference *
component BackboneElement 0..* *
component.code CodeableConcept 1..1 *
component.value[x] Quantity|CodeableConcept|string|boolean|integer|Range|Ratio|time|dateTime|Period 0..1 *
component.dataAbsentReason CodeableConcept 0..1 =data-absent-reason:extensible
component.referenceRange #referenceRange 0..*""",
    "Encounter": """identifier Identifier 0..* *
status code 1..1 =encounter-status:required *
class Coding 0..1 *
type CodeableConcept 0..* *
priority CodeableConcept 0..1
subject Reference 0..1 ->Patient|Group *
participant BackboneElement 0..* *
participant.individual Reference 0..1 ->Practitioner|PractitionerRole *
actualPeriod Period 0..1
period Period 0..1
partOf Reference 0..1 ->Encounter
serviceProvider Reference 0..1 ->Organization""",
    "Organization": """identifier Identifier 0..* *
active boolean 0..1 *
type CodeableConcept 0..* *
name string 0..1 *
alias string 0..*
telecom ContactPoint 0..*
address Address 0..*
partOf Reference 0..1 ->Organization *""",
    "Location": """identifier Identifier 0..* *
status code 0..1 *
name string 0..1 *
description string 0..1 *
address Address 0..1
partOf Reference 0..1 ->Location
managingOrganization Reference 0..1 ->Organization *""",
    "Practitioner": "identifier Identifier 0..* *\nactive boolean 0..1 *\nname HumanName 0..* *\ntelecom ContactPoint 0..* *\naddress Address 0..* *\ngender code 0..1 =administrative-gender:required *\nbirthDate date 0..1 *",
    "PractitionerRole": "identifier Identifier 0..* *\nactive boolean 0..1 *\npractitioner Reference 0..1 ->Practitioner *\norganization Reference 0..1 ->Organization *\ncode CodeableConcept 0..* *\nlocation Reference 0..* ->Location *",
    "Medication": "identifier Identifier 0..* *\ncode CodeableConcept 0..1 *\nstatus code 0..1 *\nmanufacturer Reference 0..1 ->Organization *",
    "DocumentReference": "identifier Identifier 0..* *\nstatus code 1..1 =document-reference-status:required *\ntype CodeableConcept 0..1 *\ncategory CodeableConcept 0..* *\nsubject Reference 0..1 *\ndate instant 0..1 *\ndescription string 0..1 *\ncontent BackboneElement 0..* *\ncontent.attachment Attachment 1..1 *",
    "Communication": "identifier Identifier 0..* *\nstatus code 1..1 =event-status:required *\ncategory CodeableConcept 0..*\nsubject Reference 0..1 ->Patient|Group\nsent dateTime 0..1\nsender Reference 0..1\npayload BackboneElement 0..*\npayload.content[x] string|Attachment|Reference 0..1",
    "ValueSet": "url uri 0..1 *\nidentifier Identifier 0..* *\nversion string 0..1 *\nname string 0..1 *\ntitle string 0..1 *\nstatus code 1..1 =publication-status:required *\ndescription markdown 0..1",
    "Questionnaire": "url uri 0..1 *\nstatus code 1..1 =publication-status:required *\ntitle string 0..1 *\nitem BackboneElement 0..*\nitem.linkId string 1..1\nitem.text string 0..1\nitem.type code 1..1\nitem.item #item 0..*",
    "DetectedIssue": "status code 1..1\ncode CodeableConcept 0..1 *\nsubject Reference 0..1 ->Patient *\nauthor Reference 0..1 *\nreference uri 0..1\nevidence BackboneElement 0..*\nevidence.code CodeableConcept 0..*\nevidence.detail Reference 0..*",
    "Group": "identifier Identifier 0..* *\nactive boolean 0..1 *\nname string 0..1 *",
    "Device": "identifier Identifier 0..*\nstatus code 0..1 *\npatient Reference 0..1 ->Patient",
    "Bundle": "type code 1..1 *\ntotal unsignedInt 0..1 *\nlink BackboneElement 0..* *\nlink.relation string 1..1 *\nlink.url uri 1..1 *\nentry BackboneElement 0..* *\nentry.fullUrl uri 0..1 *\nentry.resource Resource 0..1 *\nentry.search BackboneElement 0..1 *\nentry.search.mode code 0..1 *\nentry.request BackboneElement 0..1\nentry.request.method code 1..1\nentry.request.url uri 1..1\nentry.request.ifNoneExist string 0..1\nentry.request.ifMatch string 0..1\nentry.request.ifNoneMatch string 0..1",
}

#: Small code systems bound to elements.
VALUE_SETS = {
    "administrative-gender": ("http://hl7.org/fhir/administrative-gender", ("male", "female", "other", "unknown")),
    "observation-status": ("http://hl7.org/fhir/observation-status", ("registered", "preliminary", "final", "amended", "corrected", "cancelled", "entered-in-error", "unknown")),
    "narrative-status": ("http://hl7.org/fhir/narrative-status", ("generated", "extensions", "additional", "empty")),
    "identifier-use": ("http://hl7.org/fhir/identifier-use", ("usual", "official", "temp", "secondary", "old")),
    "name-use": ("http://hl7.org/fhir/name-use", ("usual", "official", "temp", "nickname", "anonymous", "old", "maiden")),
    "address-use": ("http://hl7.org/fhir/address-use", ("home", "work", "temp", "old", "billing")),
    "contact-point-system": ("http://hl7.org/fhir/contact-point-system", ("phone", "fax", "email", "pager", "url", "sms", "other")),
    "contact-point-use": ("http://hl7.org/fhir/contact-point-use", ("home", "work", "temp", "old", "mobile")),
    "quantity-comparator": ("http://hl7.org/fhir/quantity-comparator", ("<", "<=", ">=", ">", "ad")),
    "link-type": ("http://hl7.org/fhir/link-type", ("replaced-by", "replaces", "refer", "seealso")),
    "publication-status": ("http://hl7.org/fhir/publication-status", ("draft", "active", "retired", "unknown")),
    "event-status": ("http://hl7.org/fhir/event-status", ("preparation", "in-progress", "not-done", "on-hold", "stopped", "completed", "entered-in-error", "unknown")),
    "encounter-status": ("http://hl7.org/fhir/encounter-status", ("planned", "in-progress", "on-hold", "discharged", "completed", "cancelled", "discontinued", "entered-in-error", "unknown", "F", "O", "P")),
    "document-reference-status": ("http://hl7.org/fhir/document-reference-status", ("current", "superseded", "entered-in-error")),
    "marital-status": ("http://terminology.hl7.org/CodeSystem/v3-MaritalStatus", ("A", "D", "I", "L", "M", "P", "S", "T", "U", "W")),
    "data-absent-reason": ("http://terminology.hl7.org/CodeSystem/data-absent-reason", ("unknown", "asked-unknown", "temp-unknown", "not-asked", "asked-declined", "masked", "not-applicable", "unsupported", "as-text", "error", "not-performed", "not-permitted")),
    "languages": None,  # codes of an outside standard: cannot be expanded here
}


def _p(code: str, kind: str, base: str, expression: str = "", targets: str = "", components=()) -> Param:
    return Param(code, kind, tuple(base.split("|")), expression, tuple(targets.split("|")) if targets else (), tuple(components))


PARAMS = [
    _p("_profile", "uri", "Resource", "Resource.meta.profile"),
    _p("_tag", "token", "Resource", "Resource.meta.tag"),
    _p("_security", "token", "Resource", "Resource.meta.security"),
    _p("identifier", "token", "Patient|Observation|Encounter|Organization|Location|Practitioner|Medication|DocumentReference", "identifier"),
    _p("active", "token", "Patient|Organization|Practitioner", "active"),
    _p("family", "string", "Patient|Practitioner", "name.family"),
    _p("given", "string", "Patient|Practitioner", "name.given"),
    _p("name", "string", "Patient|Practitioner|Organization|Location|ValueSet", "name"),
    _p("gender", "token", "Patient|Practitioner", "gender"),
    _p("birthdate", "date", "Patient|Practitioner", "birthDate"),
    _p("death-date", "date", "Patient", "deceased.ofType(dateTime)"),
    _p("address", "string", "Patient|Organization|Practitioner", "address"),
    _p("address-country", "string", "Patient|Organization", "address.country"),
    _p("telecom", "token", "Patient|Practitioner", "telecom"),
    _p("language", "token", "Patient", "communication.language"),
    _p("marital-status", "token", "Patient", "maritalStatus"),
    _p("balance", "quantity", "Patient", "extension.where(url = 'urn:balance').value.ofType(Quantity)"),
    _p("general-practitioner", "reference", "Patient", "generalPractitioner", "Organization|Practitioner|PractitionerRole"),
    _p("organization", "reference", "Patient", "managingOrganization", "Organization"),
    _p("link", "reference", "Patient", "link.other", "Patient"),
    _p("status", "token", "Observation|Encounter|DocumentReference|Communication|ValueSet|Medication", "status"),
    _p("category", "token", "Observation|DocumentReference", "category"),
    _p("code", "token", "Observation|Medication|DetectedIssue", "code"),
    _p("subject", "reference", "Observation|Encounter|DocumentReference|DetectedIssue", "subject", "Patient|Group|Device|Location"),
    _p("patient", "reference", "Observation|Encounter|DetectedIssue", "subject.where(resolve() is Patient)", "Patient"),
    _p("encounter", "reference", "Observation", "encounter", "Encounter"),
    _p("performer", "reference", "Observation", "performer", "Practitioner|PractitionerRole|Organization|Patient"),
    _p("has-member", "reference", "Observation", "hasMember", "Observation"),
    _p("date", "date", "Observation", "effective"),
    _p("date", "date", "Encounter", "actualPeriod | period"),
    _p("date", "date", "DocumentReference", "date"),
    _p("value-quantity", "quantity", "Observation", "value.ofType(Quantity)"),
    _p("value-concept", "token", "Observation", "value.ofType(CodeableConcept)"),
    _p("value-string", "string", "Observation", "value.ofType(string)"),
    _p("component-code", "token", "Observation", "component.code"),
    _p("component-value-quantity", "quantity", "Observation", "component.value.ofType(Quantity)"),
    _p("code-value-quantity", "composite", "Observation", "Observation", components=(("code", "token", "code"), ("value-quantity", "quantity", "value.ofType(Quantity)"))),
    _p("component-code-value-quantity", "composite", "Observation", "component", components=(("component-code", "token", "code"), ("component-value-quantity", "quantity", "value.ofType(Quantity)"))),
    _p("priority", "token", "Encounter", "priority"),
    _p("partof", "reference", "Organization", "partOf", "Organization"),
    _p("partof", "reference", "Location", "partOf", "Location"),
    _p("part-of", "reference", "Encounter", "partOf", "Encounter"),
    _p("practitioner", "reference", "PractitionerRole", "practitioner", "Practitioner"),
    _p("organization", "reference", "PractitionerRole|Location", "organization | managingOrganization", "Organization"),
    _p("role", "token", "PractitionerRole", "code"),
    _p("manufacturer", "reference", "Medication", "manufacturer", "Organization"),
    _p("name", "string", "Medication", "code.text"),
    _p("size", "number", "Medication", "extension.where(url = 'urn:size').value.ofType(integer)"),
    _p("price", "quantity", "Medication", "extension.where(url = 'urn:price').value.ofType(Quantity)"),
    _p("language", "token", "DocumentReference", "language"),
    _p("role", "token", "Communication", "category"),
    _p("url", "uri", "ValueSet|Questionnaire", "url"),
    _p("title", "string", "ValueSet|Questionnaire", "title"),
    _p("version", "token", "ValueSet", "version"),
]

#: Compartments: type -> linking parameters; {def} is the compartment's own resource.
COMPARTMENTS = {"Patient": {"Patient": ("{def}", "link"), "Observation": ("subject", "performer"), "Encounter": ("patient",), "DetectedIssue": ("patient",)}}

INVARIANTS = {
    "Organization": [Invariant("org-1", "error", "The organization shall at least have a name or an identifier", "(identifier.count() + name.count()) > 0")],
    "Observation": [
        Invariant("obs-6", "error", "dataAbsentReason shall only be present if value[x] is not present", "dataAbsentReason.empty() or value.empty()"),
        Invariant("obs-7", "error", "A component with the observation's code excludes a value", "value.empty() or component.code.where(coding.intersect(%resource.code.coding).exists()).empty()"),
    ],
    "Patient": [Invariant("pat-1", "error", "A contact has details or an organization", "name.exists() or telecom.exists() or organization.exists()", "contact")],
    "ContactPoint": [Invariant("cpt-2", "error", "A system is required if a value is provided", "value.empty() or system.exists()")],
    "Period": [Invariant("per-1", "error", "If present, start shall not be after end", "start.hasValue().not() or end.hasValue().not() or (start <= end)")],
    "Quantity": [Invariant("qty-3", "error", "If a code for the unit is present, the system is too", "code.empty() or system.exists()")],
    "Extension": [Invariant("ext-1", "error", "Must have either extensions or value[x], not both", "extension.exists() != value.exists()")],
    "Resource": [],
}


class Registry:
    """Types with inheritance, search parameters with shadowing, value sets and compartments."""

    def __init__(self) -> None:
        self.types: dict[str, TypeDef] = {}
        for name, pattern in PRIMITIVES.items():
            self.types[name] = TypeDef(name, "primitive", PRIMITIVE_BASE.get(name, "Element"), pattern=pattern)
        self.types["Element"] = TypeDef("Element", "datatype", None, _elements("id string 0..1\nextension Extension 0..*"))
        self.types["BackboneElement"] = TypeDef("BackboneElement", "datatype", "Element", _elements("modifierExtension Extension 0..* *"))
        for name, text in DATATYPES.items():
            self.types[name] = TypeDef(name, "datatype", "Quantity" if name in QUANTITIES[1:] else "Element", _elements(text) if text else {})
        self.types["Resource"] = TypeDef("Resource", "resource", None, _elements(_COMMON))
        self.types["DomainResource"] = TypeDef("DomainResource", "resource", "Resource", _elements(_DOMAIN))
        for name, text in RESOURCES.items():
            self.types[name] = TypeDef(name, "resource", "Resource" if name == "Bundle" else "DomainResource", _elements(text))
        for name, rules in INVARIANTS.items():
            self.types[name].invariants = list(rules)
        self.params = list(PARAMS)
        self.value_sets = dict(VALUE_SETS)
        self.compartments = {k: dict(v) for k, v in COMPARTMENTS.items()}

    def load(self, types: Iterable[TypeDef] = (), params: Iterable[Param] = (), value_sets: dict | None = None) -> Registry:
        self.types |= {t.name: t for t in types}
        self.params += list(params)
        self.value_sets |= value_sets or {}
        self.children.cache_clear()
        return self

    def resources(self) -> list[str]:
        return sorted(n for n, t in self.types.items() if t.kind == "resource" and n not in ("Resource", "DomainResource"))

    def ancestors(self, name: str) -> list[str]:
        """The type and its bases, nearest first."""
        out: list[str] = []
        while name and name not in out and name in self.types:
            out.append(name)
            name = self.types[name].base or ""
        return out

    def is_a(self, name: str, base: str) -> bool:
        return base in self.ancestors(name)

    @lru_cache(4096)  # noqa: B019  a registry lives as long as the process
    def children(self, type_: str, path: str = "") -> dict[str, Element]:
        """Elements directly below a path of a type, by the name in documents' schema (a choice keeps its [x])."""
        prefix, out = f"{path}." if path else "", {}
        for t in reversed(self.ancestors(type_)):
            for p, e in self.types[t].elements.items():
                if p.startswith(prefix) and "." not in p[len(prefix) :]:
                    out[p[len(prefix) :]] = e
        if path and not out.get("id"):
            for t in ("Element", "BackboneElement"):
                out |= {p: e for p, e in self.types[t].elements.items()}
        return out

    def step(self, type_: str, path: str, name: str) -> tuple[Element, str, str, str] | None:
        """What a document's member is: its element, datatype, and the (type, path) to go on from."""
        kids = self.children(type_, path)
        e, data = kids.get(name), None
        if e is None:
            for key, c in kids.items():
                if c.choice and name.startswith(key[:-3]):
                    for t in c.types:
                        if name == key[:-3] + t[0].upper() + t[1:]:
                            e, data = c, t
        if e is None:
            return None
        data = data or e.types[0]
        if data.startswith("#"):
            return e, "BackboneElement", type_, data[1:]
        if data == "BackboneElement":
            return e, data, type_, e.path
        return e, data, data, ""

    def param(self, type_: str, code: str) -> Param | None:
        for base in self.ancestors(type_):
            for p in self.params:
                if p.code == code and base in p.base:
                    return p
        return None

    def params_of(self, type_: str) -> list[Param]:
        out: dict[str, Param] = {}
        for base in self.ancestors(type_):
            for p in self.params:
                if base in p.base:
                    out.setdefault(p.code, p)
        return list(out.values())


@lru_cache(1)
def default() -> Registry:
    return Registry()
