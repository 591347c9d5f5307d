"""Registered queries over documents: readers and writers, subsets, searches of extracted documents, validation, profiles, terminology."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .queries import ORACLES, QUERIES, engine, paged, registered, search
from .sources.star import Star


#: Columns are made when a query runs: without a session there are none.
Made = Callable[[], Column]


def documents(spark: SparkSession, sf_dir: str, type_: str, change: Made | None = None) -> DataFrame:
    """A type's resources with their id, their content changed."""
    d = Star(spark, sf_dir).resource(type_)
    return d if change is None else d.withColumn("content", change())


def _each(f: Callable[[str], str]):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}  # real types, which the column function reads
    return run


def mapped(name: str, type_: str, f: Callable[[str], str], sql: str, change: Made | None = None) -> None:
    """Rows (id, v): a function of each document, in Arrow batches."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        each = F.pandas_udf(_each(f), "string")
        return documents(spark, d, type_, change).select(F.col("fhir_id").alias("id"), each("content").alias("v"))
    QUERIES[name] = run
    ORACLES[name] = sql


def extracted(name: str, type_: str, query: str, sql: str, change: Made | None = None, other: str | None = None) -> None:
    """A search over the index rows of changed documents (and of another type's, as they are)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from .operators.extract import stored, wide_rows

        docs = documents(spark, d, type_, change)
        if other:
            docs = docs.unionByName(documents(spark, d, other))
        return Engine(stored(docs, wide_rows(docs, [type_, *([other] if other else [])], text=False))).ids(query)

    QUERIES[name] = run
    ORACLES[name] = sql


def _key() -> Column:
    return F.regexp_extract("content", '"urn:mrn","value":"([0-9]+)"', 1).cast("long")


def _at(path: str) -> Column:
    return F.get_json_object("content", path)


def replaced(pattern: str, by: str | Made, where: Made | None = None) -> Made:
    """The content with a pattern replaced, in some rows only if asked for."""

    def made() -> Column:
        new = F.regexp_replace("content", F.lit(pattern), F.lit(by) if isinstance(by, str) else by())
        return new if where is None else F.when(where(), new).otherwise(F.col("content"))

    return made


def _fields(content: str) -> str:
    """Family, country and balance of a patient, read by position in the parsed document."""
    from .sources.documents import from_json

    d = from_json(content)
    return f"{d['name'][0]['family']}|{d['address'][0]['country']}|{d['extension'][0]['valueQuantity']['value']}"


def _twice(content: str, form: str) -> str:
    from .sources.documents import from_json, from_xml, to_json, to_xml

    d = from_json(content)
    return to_json(from_xml(to_xml(d)) if form == "xml" else from_json(to_json(d, indent=2)))


def _as_xml(content: str) -> str:
    import re

    from .sources.documents import from_json, to_xml

    return re.search(r'<family value="([^"]*)"', to_xml(from_json(content)))[1]


# readers and writers
_CUSTOMER = "SELECT 'c' || c_custkey AS id, {} AS v FROM customer JOIN nation ON c_nationkey = n_nationkey"
_THREE = _CUSTOMER.format("c_name || '|' || n_name || '|' || CAST(c_acctbal AS VARCHAR)")
mapped("document_json_reader", "Patient", _fields, _THREE)
mapped("document_json_round_trip", "Patient", lambda s: _fields(_twice(s, "json")), _THREE)
mapped("document_xml_round_trip", "Patient", lambda s: _fields(_twice(s, "xml")), _THREE)
mapped("document_xml_writer", "Patient", _as_xml, _CUSTOMER.format("c_name"))


@registered("document_lines_round_trip", "SELECT 'Patient' AS resource_type, 'c' || c_custkey AS fhir_id, c_name AS family FROM customer")
def document_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newline-delimited JSON, written to the shared folder and read back."""
    from .sources.documents import read_lines, write_lines
    from .workspace import new_path

    path = new_path(spark, "lines")
    write_lines(documents(spark, sf_dir, "Patient"), path)
    return read_lines(spark, path).select("resource_type", "fhir_id", F.get_json_object("content", "$.name[0].family").alias("family"))


@registered("document_folder_reader", "SELECT 'Location' AS resource_type, 'n' || n_nationkey AS fhir_id FROM nation UNION ALL SELECT 'Location', 'r' || r_regionkey FROM region")
def document_folder_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document, written to the shared folder and read back."""
    from .sources.documents import read_folder
    from .workspace import new_path

    path = new_path(spark, "folder")
    documents(spark, sf_dir, "Location").select(F.col("content").alias("value"), F.col("fhir_id").alias("name")).write.partitionBy("name").text(path)
    return read_folder(spark, f"{path}/*").select("resource_type", "fhir_id")


# subsets
def _shape(mode: str) -> Callable[[str], str]:
    def run(content: str) -> str:
        import json

        from .operators.subset import shaped

        d = shaped(json.loads(content), mode)
        tags = ",".join(t["code"] for t in d.get("meta", {}).get("tag", []))
        family = d["name"][0]["family"] if "name" in d and isinstance(d["name"], list) else d.get("language", "") + str(len(d.get("text", {}).get("div", "")))
        return f"{','.join(d)}|{tags}|{family}"

    return run


_DOCUMENT = "SELECT 'd' || doc_id AS id, {} AS v FROM documents"
mapped("summary_true", "Patient", _shape("true"), _CUSTOMER.format("'resourceType,id,meta,identifier,name,address,managingOrganization|SUBSETTED|' || c_name"))
mapped("summary_text", "DocumentReference", _shape("text"), _DOCUMENT.format("'resourceType,id,meta,status,text|SUBSETTED|' || length(text)"))
mapped("summary_data", "DocumentReference", _shape("data"), _DOCUMENT.format("'resourceType,id,meta,language,status,category|SUBSETTED|' || lang || '0'"))
mapped("summary_false", "DocumentReference", _shape("false"), _DOCUMENT.format("'resourceType,id,language,status,category,text||' || lang || length(text)"))


# searches
_C = "SELECT 'c' || c_custkey AS id FROM customer"
_O = "SELECT 'o' || o_orderkey AS id FROM orders"
_E = "SELECT 'e' || event_id AS id FROM events"
_TYPED = replaced('"identifier":\\[\\{', lambda: F.concat(F.lit('"identifier":[{"type":{"coding":[{"system":"urn:t","code":"'), _at("$.maritalStatus.text"), F.lit('"}]},')))
extracted("token_of_type", "Patient", "Patient?identifier:of-type=" + ",".join(f"urn:t|BUILDING|{k}" for k in range(1, 60)), _C + " WHERE c_mktsegment = 'BUILDING' AND c_custkey BETWEEN 1 AND 59", _TYPED)
extracted("string_literal_wildcards", "Patient", "Patient?family:contains=u%25t,r_n", _C + " WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 1", replaced("Customer", lambda: F.when(_key() % 3 == 0, "Cu%tomer").when(_key() % 3 == 1, "Custr_ner").otherwise("Customerxn")))
extracted("string_folding", "Patient", "Patient?family=zolw strasse", _C + " WHERE c_custkey % 2 = 0", replaced("Customer#", lambda: F.when(_key() % 2 == 0, "Żółw  STRAßE ").otherwise("Zelw ")))
extracted("reference_absolute_url", "Encounter", "Encounter?subject=http://host/fhir/Patient/c7,http://host/fhir/Patient/c8", _O + " WHERE o_orderstatus = 'P' AND o_custkey IN (7, 8)", replaced('"Patient/', '"http://host/fhir/Patient/', lambda: _at("$.status") == "P"))
extracted("reference_identifier", "Encounter", "Encounter?subject:identifier=urn:x|7,urn:x|11", _O + " WHERE o_custkey IN (7, 11) AND o_orderstatus = 'F'", replaced('"reference":"Patient/c([0-9]+)"', '"reference":"Patient/c$1","identifier":{"system":"urn:x","value":"$1"}', lambda: _at("$.status") == "F"))
extracted("composite_missing", "Observation", "Observation?code-value-quantity:missing=true", _E + " WHERE event_type = 'error'", replaced('"code":\\{"coding":\\[[^]]*\\],"text":"error"\\},', ""))
extracted("date_period_open_end", "Encounter", "Encounter?date=gt2005-06-01", _O + " WHERE o_orderstatus <> 'F'", replaced('("start":"[^"]*")', '$1,"end":"2005-01-01"', lambda: _at("$.status") == "F"))
extracted("token_system_only", "Medication", "Medication?code=urn:brand|", "SELECT 'p' || p_partkey AS id FROM part WHERE p_size % 2 = 0", replaced("urn:brand", "urn:label", lambda: _at("$.extension[0].valueInteger").cast("int") % 2 == 1))
extracted("chain_over_documents", "Encounter", "Encounter?subject:Patient.family=customer%23000000007", _O + " WHERE o_custkey = 7", None, "Patient")
search("filter_several", "Observation?_filter=code eq click&_filter=not (code eq view) and subject eq Patient/c8", _E + " WHERE event_type = 'click' AND user_id = 8")
search("filter_token_and_reference", "Encounter?_filter=status ne F and subject eq Patient/c12", _O + " WHERE o_orderstatus <> 'F' AND o_custkey = 12")
search("filter_uri", "ValueSet?_filter=url sw \"https://m.\" or url eq \"none\"", "SELECT 'w' || page_id AS id FROM pages WHERE starts_with(url, 'https://m.')")
search("filter_fulltext", "Communication?_filter=_content co assistant and not (_content co user)", r"SELECT 'm' || conv_id || '-' || turn AS id FROM (SELECT *, list_concat([role], regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM conversations) WHERE list_contains(w, 'assistant') AND NOT list_contains(w, 'user')")
search("last_updated", "Patient?_lastUpdated=ge2024-01-01&family=customer%230000001", _C + " WHERE starts_with(lower(c_name), 'customer#0000001')")
paged("sort_by_id", "Patient?_sort=-_id&_count=30", "SELECT id, CAST(row_number() OVER (ORDER BY id DESC) AS INT) AS rank FROM (SELECT 'c' || c_custkey AS id FROM customer) ORDER BY rank LIMIT 30")
paged("sort_by_last_updated", "Patient?_sort=_lastUpdated,-family&_count=30", "SELECT 'c' || c_custkey AS id, CAST(row_number() OVER (ORDER BY c_name DESC, c_custkey) AS INT) AS rank FROM customer ORDER BY rank LIMIT 30")

_BAD = ("Nope?family=x", "Patient?nope=1", "Patient?family:in=x", "Patient?birthdate=abc", "Patient?_count=x", "Patient?_filter=family in x", "Patient?_filter=(family eq x", "Observation?subject.name=x", "Patient?family=x", "Observation?code=click")


@registered("refused_queries", "SELECT q, q NOT IN ('Patient?family=x', 'Observation?code=click') AS refused FROM (VALUES " + ", ".join(f"('{q}')" for q in _BAD) + ") AS t(q)")
def refused_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .errors import SearchError

    def refused(q: str) -> bool:
        try:
            engine(spark, sf_dir).plan(q)
            return False
        except SearchError:
            return True

    return spark.createDataFrame([(q, refused(q)) for q in _BAD], "q string, refused boolean")


@registered("page_links", """SELECT k, v FROM (SELECT 1 AS n, 'self' AS k, (SELECT CAST(count(*) AS VARCHAR) FROM customer) AS v UNION ALL SELECT 2, 'next', 'c' || c_custkey FROM customer WHERE c_custkey = (SELECT c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 1 OFFSET 10)
  UNION ALL SELECT 3, 'last', 'none' UNION ALL SELECT 4, 'untotalled', '10')""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total, the first id behind the next link, that a page short of its size has no such link, and the entries of a page without a total."""
    e = engine(spark, sf_dir)
    first = e.bundle("Patient?_sort=family&_count=10")
    after = e.bundle(next(x["url"] for x in first["link"] if x["relation"] == "next"))["entry"][0]["resource"]["id"]
    short = [x["relation"] for x in e.bundle("Patient?_id=c1,c2&_count=10")["link"]]
    bare = e.bundle("Patient?_count=10&_total=none")
    rows = [("self", str(first["total"])), ("next", after), ("last", "next" if "next" in short else "none"), ("untotalled", str(len(bare["entry"])) + "total" * ("total" in bare))]
    return spark.createDataFrame(rows, "k string, v string")


@registered("content_negotiation", """SELECT f, 'Patient/c' || c_custkey AS url, c_name AS family FROM (SELECT * FROM customer ORDER BY c_name, c_custkey LIMIT 15) CROSS JOIN (SELECT unnest(['xml', 'json', 'accept xml']) AS f)""")
def content_negotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One searchset as XML and as JSON, read back from its text."""
    from .sources.documents import from_json, from_xml

    e, query, rows = engine(spark, sf_dir), "Patient?_sort=family&_count=15", []
    for name, text in (("xml", e.document(f"{query}&_format=xml")), ("json", e.document(f"{query}&_format=application/fhir%2Bjson", "application/fhir+xml")), ("accept xml", e.document(query, "text/html, application/fhir+xml;q=0.9, */*"))):
        doc = from_json(text) if text.startswith("{") else from_xml(text)
        if text.startswith("{") != (name == "json"):
            raise ValueError(f"{name} was answered in the other form")
        rows += [(name, x["fullUrl"], x["resource"]["name"][0]["family"]) for x in doc["entry"]]
    return spark.createDataFrame(rows, "f string, url string, family string")


@registered("access_scopes", """SELECT 'n' || n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'patient' WHEN 1 THEN 'user' WHEN 3 THEN 'system' END AS reads, CASE n_nationkey % 4 WHEN 2 THEN 'system' WHEN 3 THEN 'patient' END AS creates FROM nation""")
def access_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest context in which each nation's scopes let locations be read and created."""
    from .access import granted, parse_scopes

    given = ("openid patient/Location.rs", "user/*.read patient/Location.r launch", "system/Location.c user/Patient.read", "patient/Location.write system/*.rs?x=y")
    rows = []
    for r in Star(spark, sf_dir).table("nation").select("n_nationkey").collect():
        scopes = parse_scopes(given[r[0] % 4])
        rows.append((f"n{r[0]}", granted(scopes, "Location", "r"), granted(scopes, "Location", "c")))
    return spark.createDataFrame(rows, "id string, reads string, creates string")


@registered("total_modes", "SELECT * FROM (VALUES ('none', NULL), ('estimate', (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING')), ('accurate', (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING'))) AS t(mode, total)")
def total_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    rows = [(m, e.bundle(f"Patient?marital-status=BUILDING&_count=1&_total={m}").get("total")) for m in ("none", "estimate", "accurate")]
    return spark.createDataFrame(rows, "mode string, total long")


# validation
def found(name: str, type_: str, change: Made, test: str, sql: str) -> None:
    """Rows (id, n): how many findings of a kind each changed document has."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from .operators.validate import validate

        docs = documents(spark, d, type_, change)
        n = validate(docs).where(test).groupBy("pid").agg(F.count("*").cast("int").alias("n"))
        return docs.select("pid", F.col("fhir_id").alias("id")).join(n, "pid", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))

    QUERIES[name] = run
    ORACLES[name] = sql


_N = "SELECT 'c' || c_custkey AS id, CASE WHEN {} THEN 1 ELSE 0 END AS n FROM customer"
found("validate_unknown_elements", "Patient", replaced('"name":', '"shoe":9,"name":', lambda: _key() % 4 == 0), "code = 'structure' and contains(details, 'shoe')", _N.format("c_custkey % 4 = 0"))
found("validate_lexical_forms", "Patient", replaced('"name":', '"birthDate":"2020-13","name":', lambda: _key() % 3 == 0), "code = 'value'", _N.format("c_custkey % 3 = 0"))
found("validate_choices", "Patient", replaced('"name":', '"deceasedBoolean":true,"deceasedDateTime":"2020","name":', lambda: _key() % 5 == 1), "startswith(details, 'only one')", _N.format("c_custkey % 5 = 1"))
found("validate_reference_targets", "Patient", replaced('"Organization/', '"Medication/', lambda: _key() % 2 == 1), "code = 'invalid'", _N.format("c_custkey % 2 = 1"))
found("validate_required_binding", "Patient", replaced('"name":', '"gender":"blue","name":', lambda: _key() % 7 == 0), "code = 'code-invalid' and severity = 'error'", _N.format("c_custkey % 7 = 0"))
found("validate_invariants", "Encounter", replaced('("start":"[^"]*")', '$1,"end":"1900-01-01"', lambda: _at("$.status") == "P"), "key = 'per-1'", "SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS n FROM orders")


@registered("validate_order", "SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'error,warning' ELSE 'warning' END AS v FROM customer")
def validate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severities of each patient's findings in the order given: the gravest first."""
    from .operators.validate import validate

    docs = documents(spark, sf_dir, "Patient", replaced('"name":', '"birthDate":"2020-13","name":', lambda: _key() % 3 == 0))
    v = validate(docs).groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("place", "severity"))).alias("s"))
    return docs.select("pid", F.col("fhir_id").alias("id")).join(v, "pid").select("id", F.array_join(F.transform("s", lambda x: x["severity"]), ",").alias("v"))


def _outcome(content: str) -> str:
    from .operators.validate import Validator, outcome

    return ",".join(f"{i['severity']}:{i['code']}:{i['expression'][0]}" for i in outcome(Validator().validate(content))["issue"])


mapped("validate_outcome", "Patient", _outcome, _CUSTOMER.format("CASE WHEN c_custkey % 6 = 0 THEN 'error:value:Patient.active,' ELSE '' END || 'warning:code-invalid:Patient.maritalStatus'"), replaced('"name":', '"active":"yes","name":', lambda: _key() % 6 == 0))


# profiles
def _profiles():
    from .operators.profiles import Profile, Rule, Slice, Slicing

    named = Profile("urn:profile:named", "Patient", (Rule("birthDate", 1), Rule("maritalStatus.coding", 0, "*", None, {"code": "BUILDING"})))
    parts = Slicing("component", (("pattern", "code"),), (
        Slice("event", (Rule("code", pattern={"coding": [{"system": "urn:event"}]}),), 1, "1"), Slice("clicks", (Rule("code", pattern={"coding": [{"code": "click"}]}),), 0, "0"), Slice("k", (Rule("code", pattern={"coding": [{"system": "urn:prop"}]}), Rule("value.unit", fixed="v")), 1),
    ), "closed")
    return {p.url: p for p in (named, Profile("urn:profile:parts", "Observation", slicings=(parts,)), Profile("urn:profile:final", "Observation", (Rule("status", fixed="final"), Rule("code.text", fixed="click"))))}


def profiled(name: str, type_: str, change: Made | None, url: str | None, test: str, sql: str) -> None:
    """Rows (id, n): the findings of each document against a profile, or those that it names itself."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from .operators.profiles import validate_profiles

        docs = documents(spark, d, type_, change)
        n = validate_profiles(docs, _profiles(), [url] if url else None).where(test).groupBy("pid").agg(F.count("*").cast("int").alias("n"))
        return docs.select("pid", F.col("fhir_id").alias("id")).join(n, "pid", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))

    QUERIES[name] = run
    ORACLES[name] = sql


profiled("profile_cardinality", "Patient", replaced('"name":', '"birthDate":"2020","name":', lambda: _key() % 3 == 0), "urn:profile:named", "code = 'required'", _N.format("c_custkey % 3 <> 0"))
profiled("profile_pattern", "Patient", None, "urn:profile:named", "code = 'value'", _N.format("c_mktsegment <> 'BUILDING'"))
profiled("profile_fixed", "Observation", None, "urn:profile:final", "code = 'value'", "SELECT 'e' || event_id AS id, CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END AS n FROM events")
profiled("profile_slices", "Observation", replaced('"system":"urn:prop"', '"system":"urn:lost"', lambda: _at("$.code.text") == "view"), "urn:profile:parts", "code in ('required', 'structure')", "SELECT 'e' || event_id AS id, CASE WHEN event_type = 'view' THEN 2 ELSE 0 END AS n FROM events")
profiled("profile_by_meta", "Patient", replaced('"name":', '"meta":{"profile":["urn:profile:named"]},"name":', lambda: _key() % 2 == 0), None, "code = 'required'", _N.format("c_custkey % 2 = 0"))


# terminology
@registered("value_set_expansion", "SELECT DISTINCT 'urn:type' AS system, p_type AS code FROM part WHERE p_type <> 'ECONOMY' UNION ALL SELECT DISTINCT 'urn:brand', p_brand FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part) AND p_brand <> (SELECT max(p_brand) FROM part)")
def value_set_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two code systems of the parts' types and brands: one set includes a system, another a filtered one, both exclude codes."""
    from .operators.terminology import code_system, expand

    d = Star(spark, sf_dir).table("part")
    brands, types = (sorted(r[0] for r in d.select(c).distinct().collect()) for c in ("p_brand", "p_type"))  # codes, few by nature
    lowest, highest = brands[0], brands[-1]
    brand = {"url": "urn:brand", "concept": [{"code": lowest, "concept": [{"code": b} for b in brands[1:]]}]}
    systems = {s["url"]: code_system(s) for s in (brand, {"url": "urn:type", "concept": [{"code": t} for t in types]})}
    sets = {
        "urn:all": {"compose": {"include": [{"valueSet": ["urn:brands"]}, {"system": "urn:type"}], "exclude": [{"system": "urn:type", "concept": [{"code": "ECONOMY"}]}]}},
        "urn:brands": {"compose": {"include": [{"system": "urn:brand", "filter": [{"property": "concept", "op": "descendent-of", "value": lowest}]}], "exclude": [{"system": "urn:brand", "filter": [{"property": "code", "op": "=", "value": highest}]}]}},
    }
    return spark.createDataFrame(sorted(expand("urn:all", sets, systems)), "system string, code string")

