"""Registered queries over the star schema and their SQL, written against the source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(Star(spark, sf_dir))


def search(name: str, query: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: engine(spark, d).ids(query)
    ORACLES[name] = sql


def paged(name: str, query: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: engine(spark, d).page(query)
    ORACLES[name] = sql


def included(name: str, query: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: engine(spark, d).page_with_includes(query)
    ORACLES[name] = sql


def registered(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_C = "SELECT 'c' || c_custkey AS id FROM customer"
_E = "SELECT 'e' || event_id AS id FROM events"
_O = "SELECT 'o' || o_orderkey AS id FROM orders"
_P = "SELECT 'p' || p_partkey AS id FROM part"
_W = "SELECT 'w' || page_id AS id FROM pages"
_D = "SELECT 'd' || doc_id AS id FROM documents"
_HALF = "0.5 * pow(10.0, -length(split_part(CAST(value AS VARCHAR), '.', -1)))"
_LOW, _HIGH = f"(value - {_HALF})", f"(value + {_HALF})"

# strings
search("string_prefix", "Patient?family=customer%230000001", _C + " WHERE starts_with(lower(c_name), 'customer#0000001')")
search("string_exact", "Patient?family:exact=Customer%23000000007", _C + " WHERE c_name = 'Customer#000000007'")
search("string_contains", "Medication?name:contains=WIDGET", _P + " WHERE contains(lower(p_name), 'widget')")
search("string_endswith", "Medication?_filter=name ew \"ring\"", _P + " WHERE ends_with(lower(p_name), 'ring')")
# tokens
search("token_system_code", "Observation?code=urn:event|click", _E + " WHERE event_type = 'click'")
search("token_code_any", "Medication?code=ECONOMY", _P + " WHERE p_type = 'ECONOMY' OR p_brand = 'ECONOMY'")
search("token_not", "Encounter?status:not=F", _O + " WHERE o_orderstatus <> 'F'")
search("token_text", "Patient?marital-status:text=auto", _C + " WHERE starts_with(lower(c_mktsegment), 'auto')")
search("token_missing_true", "Location?partof:missing=true", "SELECT 'r' || r_regionkey AS id FROM region")
search("token_missing_false", "Location?partof:missing=false", "SELECT 'n' || n_nationkey AS id FROM nation")
search("or_alternatives", "Observation?code=click,view", _E + " WHERE event_type IN ('click', 'view')")
search("and_parameters", "Observation?code=click&value-quantity=gt60", _E + f" WHERE event_type = 'click' AND {_HIGH} > 60.5")
search("id_lookup", "Patient?_id=c1,c5,c9,none", _C + " WHERE c_custkey IN (1, 5, 9)")
# references
search("reference_type_id", "Observation?subject=Patient/c8", _E + " WHERE user_id = 8")
search("reference_bare_id", "Encounter?subject=c12", _O + " WHERE o_custkey = 12")
search("reference_type_modifier", "Observation?subject:Patient=c8,c9", _E + " WHERE user_id IN (8, 9)")
# uris
search("uri_below", "ValueSet?url:below=https://m.", _W + " WHERE starts_with(url, 'https://m.')")
QUERIES["uri_exact"] = lambda spark, d: engine(spark, d).ids("ValueSet?url=" + spark.read.parquet(f"{d}/pages.parquet").where("page_id = 3").first()["url"].replace("&", "%26").replace(",", "\\,"))
ORACLES["uri_exact"] = _W + " WHERE url = (SELECT url FROM pages WHERE page_id = 3)"
QUERIES["uri_above"] = lambda spark, d: engine(spark, d).ids("ValueSet?url:above=" + spark.read.parquet(f"{d}/pages.parquet").where("page_id = 3").first()["url"].replace("&", "%26").replace(",", "\\,") + "/x/y")
ORACLES["uri_above"] = _W + " WHERE starts_with((SELECT url FROM pages WHERE page_id = 3) || '/x/y', url)"
# dates
search("date_eq_year", "Encounter?date=1997", _O + " WHERE o_orderdate < TIMESTAMP '1998-01-01'")
search("date_eq_month", "Observation?date=2024-01", _E + " WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'")
_TS = "(epoch_us(ts) // 1000 * 1000)"
_DAY = "epoch_us(TIMESTAMP '2024-01-10')"
for _op, _test in {
    "eq": f"{_TS} < {_DAY} + 86400000000 AND {_TS} + 999 >= {_DAY}",
    "ne": f"NOT ({_TS} < {_DAY} + 86400000000 AND {_TS} + 999 >= {_DAY})",
    "gt": f"{_TS} + 999 > {_DAY} + 86399999999",
    "lt": f"{_TS} < {_DAY}",
    "ge": f"{_TS} + 999 >= {_DAY}",
    "le": f"{_TS} <= {_DAY} + 86399999999",
    "sa": f"{_TS} > {_DAY} + 86399999999",
    "eb": f"{_TS} + 999 < {_DAY}",
    "ap": f"{_TS} < {_DAY} + 86400000000 AND {_TS} + 999 >= {_DAY}",
}.items():
    search(f"date_{_op}" + ("_day" if _op == "eq" else ""), f"Observation?date={_op}2024-01-10", f"{_E} WHERE {_test}")
# numbers and quantities
search("number_eq_implicit_range", "Medication?size=11", _P + " WHERE p_size = 11")
search("number_prefix_lt", "Medication?size=lt10", _P + " WHERE p_size - 0.5 < 9.5")
for _op, _test in {
    "eq": f"{_LOW} < 60.5 AND {_HIGH} > 59.5",
    "ne": f"{_LOW} >= 60.5 OR {_HIGH} <= 59.5",
    "gt": f"{_HIGH} > 60.5",
    "lt": f"{_LOW} < 59.5",
    "ge": f"{_HIGH} >= 59.5",
    "le": f"{_LOW} <= 60.5",
    "sa": f"{_LOW} > 60.5",
    "eb": f"{_HIGH} < 59.5",
}.items():
    search(f"quantity_{_op}", f"Observation?value-quantity={_op}60", f"{_E} WHERE {_test}")
search("quantity_with_unit", "Observation?value-quantity=gt60|urn:unit|u&code=view", _E + f" WHERE {_HIGH} > 60.5 AND event_type = 'view'")
# composites
search("composite_same_occurrence", "Observation?component-code-value-quantity=k$gt50", _E + " WHERE CAST(json_extract(props, '$.k') AS INT) + 0.5 > 50.5")
search("composite_trap", "Observation?component-code-value-quantity=urn:event|click$gt400,urn:prop|k$lt5", _E + f" WHERE (event_type = 'click' AND {_HIGH} > 400.5) OR CAST(json_extract(props, '$.k') AS INT) - 0.5 < 4.5")
# chains
search("chain_forward", "Observation?patient.marital-status=BUILDING", _E + " JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'")
search("chain_two_levels", "Encounter?subject:Patient.organization.name=supplier%23000000003", _O + " JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 = 3")
search("chain_with_filter", "Observation?_filter=subject[Patient].family sw \"customer%230000000\" and code eq error", _E + " JOIN customer ON user_id = c_custkey WHERE starts_with(c_name, 'Customer#0000000') AND event_type = 'error'")
search("has_reverse", "Patient?_has:Observation:patient:code=click", _C + " WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'click')")
search("has_nested", "Organization?_has:Patient:organization:_has:Encounter:subject:status=P", "SELECT 's' || s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT c_custkey % 10 FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P')")
search("has_value", "Patient?_has:Observation:subject:value-quantity=gt480", _C + f" WHERE c_custkey IN (SELECT user_id FROM events WHERE {_HIGH} > 480.5)")
# filters
search("filter_and_or_not", "Observation?_filter=(code eq click or code eq view) and not (value-quantity gt 60)", _E + f" WHERE event_type IN ('click', 'view') AND NOT ({_HIGH} > 60.5)")
search("filter_pr", "Location?_filter=partof pr and not (name eq \"NATION_3\")", "SELECT 'n' || n_nationkey AS id FROM nation WHERE n_name <> 'NATION_3'")
search("filter_string_ops", "Medication?_filter=name co \"red\" or name sw \"small\"", _P + " WHERE contains(lower(p_name), 'red') OR starts_with(lower(p_name), 'small')")
search("filter_ne", "Patient?_filter=marital-status ne BUILDING and balance ge 5000", _C + " WHERE c_mktsegment <> 'BUILDING' AND c_acctbal + 0.5 * pow(10.0, -length(split_part(CAST(c_acctbal AS VARCHAR), '.', -1))) >= 4999.5")
search("fulltext_content", "Communication?_content=assistant", "SELECT 'm' || conv_id || '-' || turn AS id FROM conversations WHERE role = 'assistant' OR list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'assistant')")
search("fulltext_text_and", "DocumentReference?_text=license mit", _D + " WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'license') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'mit')")

# paging
paged("sort_asc", "Patient?_sort=family&_count=20", "SELECT 'c' || c_custkey AS id, CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS INT) AS rank FROM customer ORDER BY rank LIMIT 20")
paged("sort_asc_missing_first", "Location?_sort=partof&_count=10", "SELECT id, CAST(row_number() OVER (ORDER BY k, o, n) AS INT) AS rank FROM (SELECT 'r' || r_regionkey AS id, '' AS k, 1 AS o, r_regionkey AS n FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0, n_nationkey FROM nation) ORDER BY rank LIMIT 10")
paged("sort_desc", "Observation?code=click&_sort=-date&_count=20", f"SELECT id, CAST(row_number() OVER (ORDER BY t DESC, event_id) AS INT) AS rank FROM (SELECT 'e' || event_id AS id, {_TS} AS t, event_id FROM events WHERE event_type = 'click') ORDER BY rank LIMIT 20")
paged("sort_multi", "Encounter?_sort=status,-date&_count=25", "SELECT 'o' || o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderstatus, date_trunc('day', o_orderdate) DESC, o_orderkey) AS INT) AS rank FROM orders ORDER BY rank LIMIT 25")
paged("page_first", "Observation?code=click&value-quantity=gt60&_sort=-date&_count=20", f"SELECT id, CAST(row_number() OVER (ORDER BY t DESC, event_id) AS INT) AS rank FROM (SELECT 'e' || event_id AS id, {_TS} AS t, event_id FROM events WHERE event_type = 'click' AND {_HIGH} > 60.5) ORDER BY rank LIMIT 20")
paged("page_offset", "Patient?_sort=family&_count=10&_offset=15", "SELECT 'c' || c_custkey AS id, CAST(row_number() OVER (ORDER BY c_name, c_custkey) - 15 AS INT) AS rank FROM customer ORDER BY rank LIMIT 10 OFFSET 15")


@registered("page_keyset_next", "SELECT 'c' || c_custkey AS id, CAST(row_number() OVER (ORDER BY c_name, c_custkey) - 10 AS INT) AS rank FROM customer ORDER BY rank LIMIT 10 OFFSET 10")
def page_keyset_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.paging import next_cursor, page

    e = engine(spark, sf_dir)
    plan = e.plan("Patient?_sort=family&_count=10")
    return e.page(f"Patient?_sort=family&_count=10&_cursor={next_cursor(page(e.lowering, plan).collect(), plan)}")


@registered("total_count", f"SELECT count(*) AS total FROM ({_E} WHERE event_type = 'click')")
def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).count("Observation?code=click&_count=5")


@registered("summary_count", f"SELECT count(*) AS total FROM ({_C} WHERE c_mktsegment = 'BUILDING')")
def summary_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).count("Patient?marital-status=BUILDING&_summary=count")


# includes
_PAGE = "(SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 20)"
_MATCH = f"SELECT 'Observation' AS resource_type, 'e' || event_id AS id, 'match' AS mode FROM {_PAGE}"
included("include_forward", "Observation?code=click&_count=20&_include=Observation:subject", f"{_MATCH} UNION ALL SELECT DISTINCT 'Patient', 'c' || user_id, 'include' FROM {_PAGE} WHERE user_id IN (SELECT c_custkey FROM customer)")
included("include_wildcard", "Observation?code=click&_count=20&_include=*", f"{_MATCH} UNION ALL SELECT DISTINCT 'Patient', 'c' || user_id, 'include' FROM {_PAGE} WHERE user_id IN (SELECT c_custkey FROM customer)")
included("include_iterate", "Observation?code=click&_count=20&_include=Observation:subject&_include:iterate=Patient:organization", f"{_MATCH} UNION ALL SELECT DISTINCT 'Patient', 'c' || user_id, 'include' FROM {_PAGE} WHERE user_id IN (SELECT c_custkey FROM customer) UNION ALL SELECT DISTINCT 'Organization', 's' || (user_id % 10), 'include' FROM {_PAGE} WHERE user_id % 10 IN (SELECT s_suppkey FROM supplier)")
included("include_location_tree", "Location?name=nation_1&_include:iterate=Location:partof", "SELECT 'Location' AS resource_type, 'n' || n_nationkey AS id, 'match' AS mode FROM nation WHERE starts_with(lower(n_name), 'nation_1') UNION ALL SELECT DISTINCT 'Location', 'r' || n_regionkey, 'include' FROM nation WHERE starts_with(lower(n_name), 'nation_1')")
included("revinclude", "Patient?_id=c1,c2,c3&_revinclude=Encounter:subject", "SELECT 'Patient' AS resource_type, 'c' || c_custkey AS id, 'match' AS mode FROM customer WHERE c_custkey IN (1, 2, 3) UNION ALL SELECT 'Encounter', 'o' || o_orderkey, 'include' FROM orders WHERE o_custkey IN (1, 2, 3)")


# indexes against their sources
def _index(name: str, table: str, type_: str, code: str, sql: str, *columns: str) -> None:
    QUERIES[name] = lambda spark, d: Star(spark, d).get(table, type_, code).select("pid", *columns)
    ORACLES[name] = sql


_index("index_string", "string", "Patient", "family", "SELECT CAST(c_custkey AS BIGINT) AS pid, lower(c_name) AS norm, c_name AS exact FROM customer", "norm", "exact")
_index("index_token", "token", "Observation", "code", "SELECT CAST(4 * 72057594037927936 + event_id AS BIGINT) AS pid, 'urn:event' AS system, event_type AS value FROM events", "system", "value")
_index("index_reference", "reference", "Encounter", "subject", "SELECT CAST(3 * 72057594037927936 + o_orderkey AS BIGINT) AS pid, 'Patient' AS target_type, 'c' || o_custkey AS target_id FROM orders", "target_type", "target_id")
_index("index_date", "date", "Observation", "date", f"SELECT CAST(4 * 72057594037927936 + event_id AS BIGINT) AS pid, {_TS} AS low, {_TS} + 999 AS high FROM events", "low", "high")
_index("index_uri", "uri", "ValueSet", "url", "SELECT CAST(8 * 72057594037927936 + page_id AS BIGINT) AS pid, url AS value FROM pages WHERE url <> ''", "value")


@registered("index_quantity", f"SELECT CAST(4 * 72057594037927936 + event_id AS BIGINT) AS pid, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high, 'u' AS unit FROM events")
def index_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Star(spark, sf_dir).get("quantity", "Observation", "value-quantity")
    return d.select("pid", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "unit")


# versions: orders as a log in which finished ones have a second version and pending ones a tombstone
def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.star import LOADED

    o = Star(spark, sf_dir).table("orders")
    row = lambda d, version, deleted: d.select(F.lit("Encounter").alias("resource_type"), F.concat(F.lit("o"), "o_orderkey").alias("fhir_id"), F.lit(version).cast("long").alias("version_id"), (F.lit(LOADED + version * 1_000_000) + F.col("o_orderkey")).cast("long").alias("last_updated"), F.lit(deleted).alias("deleted"), F.when(~F.lit(deleted), F.col("o_orderstatus")).alias("content"))
    return row(o, 1, False).unionByName(row(o.where("o_orderstatus = 'F'"), 2, False)).unionByName(row(o.where("o_orderstatus = 'P'"), 2, True))


_LOG = """(SELECT 'o' || o_orderkey AS id, 1 AS v, 1704067201000000 + o_orderkey AS t, false AS del FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 2, 1704067202000000 + o_orderkey, o_orderstatus = 'P' FROM orders WHERE o_orderstatus IN ('F', 'P'))"""
_VERB = "CASE WHEN del THEN 'DELETE' WHEN v = 1 THEN 'POST' ELSE 'PUT' END AS verb"


def _versions(d: DataFrame) -> DataFrame:
    return d.select(F.col("fhir_id").alias("id"), F.col("version_id").cast("int").alias("v"), "verb")


@registered("history_instance", f"SELECT id, v, {_VERB} FROM {_LOG} WHERE id = 'o1'")
def history_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import history

    return _versions(history(order_log(spark, sf_dir), "Encounter", "o1"))


@registered("history_since", f"SELECT id, v, {_VERB} FROM {_LOG} WHERE t >= 1704067202000000 ORDER BY t DESC, v DESC LIMIT 100")
def history_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import history

    return _versions(history(order_log(spark, sf_dir), "Encounter", None, 1_704_067_202_000_000))


@registered("history_offset", f"SELECT id, v, {_VERB} FROM {_LOG} ORDER BY t DESC, v DESC LIMIT 50 OFFSET 25")
def history_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import history

    return _versions(history(order_log(spark, sf_dir), count=50, offset=25))


@registered("compartment_confine", _E + " WHERE user_id = 8 AND event_type = 'click'")
def compartment_confine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .access import confinement

    e = engine(spark, sf_dir)
    plan = e.plan("Observation?code=click")
    plan.clauses.append(confinement("Observation", "Patient", "c8"))
    return e.lowering.search(plan).select(F.col("fhir_id").alias("id"))


# path expressions over documents
def over(name: str, type_: str, expression: str, sql: str, key: str = "v") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from .functions.fhirpath.udf import path

        docs = Star(spark, d).resource(type_).select(F.col("fhir_id").alias("id"), "content")
        return path(docs, expression, type_, "v").select("id", F.array_join("v", "|").alias(key))

    QUERIES[name] = run
    ORACLES[name] = sql


_OBS = "SELECT 'e' || event_id AS id, {} AS v FROM events"
_PAT = "SELECT 'c' || c_custkey AS id, {} AS v FROM customer JOIN nation ON c_nationkey = n_nationkey"
over("fhirpath_where_select", "Patient", "name.where(family.endsWith('7')).select(family.upper())", _PAT.format("CASE WHEN ends_with(c_name, '7') THEN upper(c_name) ELSE '' END"))
over("fhirpath_exists_all", "Observation", "code.coding.exists(code = 'click') and component.all(code.coding.exists())", _OBS.format("CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END"))
over("fhirpath_aggregate", "Observation", "component.code.coding.code.aggregate($total + $this.length(), 0)", _OBS.format("CAST(length(event_type) + 1 AS VARCHAR)"))
over("fhirpath_set_ops", "Observation", "(component.code.coding.code | code.coding.code | 'click').count()", _OBS.format("CASE WHEN event_type = 'click' THEN '2' ELSE '3' END"))
over("fhirpath_subsetting", "Observation", "component.code.coding.code.skip(1).first() & component.code.coding.code.first() & component.code.coding.code.last()", _OBS.format("'k' || event_type || 'k'"))
over("fhirpath_string_fns", "Patient", "address.country.first().substring(0, 6) & '-' & name.family.first().replace('#', '/').lower()", _PAT.format("substr(n_name, 1, 6) || '-' || lower(replace(c_name, '#', '/'))"))
over("fhirpath_math_fns", "Observation", "value.value.floor() + value.value.ceiling()", _OBS.format("CAST(CAST(floor(value) + ceil(value) AS BIGINT) AS VARCHAR)"))
over("fhirpath_conversions", "Patient", "identifier.value.first().toInteger() + 1", _PAT.format("CAST(c_custkey + 1 AS VARCHAR)"))
over("fhirpath_three_valued", "Patient", "(active and maritalStatus.text = 'BUILDING') or maritalStatus.text = 'MACHINERY'", _PAT.format("CASE WHEN c_mktsegment = 'MACHINERY' THEN 'true' WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'false' END"))
over("fhirpath_date_arith", "Encounter", "(actualPeriod.start + 1 month).toString()", "SELECT 'o' || o_orderkey AS id, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS v FROM orders")


@registered("binding_required", "SELECT 'c' || c_custkey AS id, CASE WHEN c_mktsegment IN ('A', 'D', 'I', 'L', 'M', 'P', 'S', 'T', 'U', 'W') THEN 0 ELSE 1 END AS warnings FROM customer")
def binding_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are no marital status: a warning of the extensible binding for each."""
    from .operators.validate import validate

    docs = Star(spark, sf_dir).resource("Patient").select("pid", F.col("fhir_id").alias("id"), "content")
    found = validate(docs).where("severity = 'warning' and code = 'code-invalid'").groupBy("pid").agg(F.count("*").cast("int").alias("n"))
    return docs.select("pid", "id").join(found, "pid", "left").select("id", F.coalesce("n", F.lit(0)).alias("warnings"))


@registered("validate_cardinality_encounters", """SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderstatus IS NULL THEN 1 ELSE 0 END AS missing,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus IS NOT NULL THEN 1 ELSE 0 END AS repeated FROM orders""")
def validate_cardinality_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole encounters: the urgent ones without their status, those of low priority with it in an array, the others as they are."""
    from .operators.validate import validate

    docs = Star(spark, sf_dir).resource("Encounter").select("pid", F.col("fhir_id").alias("id"), "content")
    priority, status = F.get_json_object("content", "$.priority.text"), '"status":("[^"]*")'
    changed = F.when(priority == "1-URGENT", F.regexp_replace("content", f"{status},", "")).when(priority == "5-LOW", F.regexp_replace("content", status, r'"status":[$1]'))
    found = validate(docs.withColumn("content", F.coalesce(changed, "content")))
    counts = found.groupBy("pid").agg(F.count_if(F.col("code") == "required").cast("int").alias("m"), F.count_if((F.col("code") == "structure") & F.col("details").contains("repeat")).cast("int").alias("r"))
    return docs.select("pid", "id").join(counts, "pid", "left").select("id", F.coalesce("m", F.lit(0)).alias("missing"), F.coalesce("r", F.lit(0)).alias("repeated"))


def _extracted(name: str, type_: str, code: str, table: str, sql: str, *columns: str) -> None:
    """The index rows of a type's documents, by the extractor, against those of the source."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from .operators.extract import indexes, wide_rows

        docs = Star(spark, d).resource(type_)
        rows = indexes(wide_rows(docs, [type_], [code.partition("$")[0]], text=False))[table].where(F.col("code") == code)
        rounded = [F.round(c, 6).alias(c) if dict(rows.dtypes)[c] == "double" else F.col(c) for c in columns]
        return rows.join(docs.select("pid", F.col("fhir_id").alias("id")), "pid").select("id", *rounded)

    QUERIES[name] = run
    ORACLES[name] = sql


_extracted("extract_tokens", "Observation", "code", "token", "SELECT 'e' || event_id AS id, 'urn:event' AS system, event_type AS value FROM events", "system", "value")
_extracted("extract_quantities", "Observation", "value-quantity", "quantity", f"SELECT 'e' || event_id AS id, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM events", "low", "high")
_extracted("extract_strings", "Patient", "family", "string", "SELECT 'c' || c_custkey AS id, lower(c_name) AS norm, c_name AS exact FROM customer", "norm", "exact")
_extracted("extract_references", "Encounter", "subject", "reference", "SELECT 'o' || o_orderkey AS id, 'Patient' AS target_type, 'c' || o_custkey AS target_id, 'Patient/c' || o_custkey AS url FROM orders", "target_type", "target_id", "url")
_extracted("extract_resolved_references", "Observation", "patient", "reference", "SELECT 'e' || event_id AS id, 'Patient' AS target_type, 'c' || user_id AS target_id FROM events", "target_type", "target_id")
_extracted("extract_identifiers", "Patient", "identifier", "token", "SELECT 'c' || c_custkey AS id, 'urn:mrn' AS system, CAST(c_custkey AS VARCHAR) AS value FROM customer", "system", "value")
_extracted("extract_uris", "ValueSet", "url", "uri", "SELECT 'w' || page_id AS id, url AS value FROM pages WHERE url <> ''", "value")
_extracted("extract_instants", "Observation", "date", "date", f"SELECT 'e' || event_id AS id, CAST({_TS} AS BIGINT) AS low, CAST({_TS} + 999 AS BIGINT) AS high FROM events", "low", "high")
_extracted("extract_open_periods", "Encounter", "date", "date", "SELECT 'o' || o_orderkey AS id, epoch_us(date_trunc('day', o_orderdate)) AS low, 9223372036854775807 AS high FROM orders", "low", "high")
_extracted("extract_numbers", "Medication", "size", "number", "SELECT 'p' || p_partkey AS id, p_size - 0.5 AS low, p_size + 0.5 AS high FROM part", "low", "high")
_extracted("extract_composite_tokens", "Observation", "component-code-value-quantity$0", "token", "SELECT 'e' || event_id AS id, 0 AS seq, event_type AS value FROM events UNION ALL SELECT 'e' || event_id, 1, 'k' FROM events", "seq", "value")
_extracted("extract_composite_quantities", "Observation", "component-code-value-quantity$1", "quantity", """SELECT 'e' || event_id AS id, 0 AS seq, round(CAST(value AS DECIMAL(20,2)) - 0.005, 6)::DOUBLE AS low FROM events
  UNION ALL SELECT 'e' || event_id, 1, round(CAST(json_extract(props, '$.k') AS DECIMAL(20,2)) - 0.005, 6)::DOUBLE FROM events""", "seq", "low")


@registered("extract_fulltext", r"SELECT 'm' || conv_id || '-' || turn AS id, len(list_filter(list_distinct(regexp_split_to_array(lower('m' || conv_id || '-' || turn || ' completed urn:role ' || role || ' ' || role || ' ' || regexp_replace(text, '<[^>]*>', ' ', 'g')), '[^\p{L}\p{N}]+')), lambda w: w <> '')) AS words FROM conversations")
def extract_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different words each message's document has in all its strings."""
    from .operators.extract import indexes, wide_rows

    docs = Star(spark, sf_dir).resource("Communication")
    found = indexes(wide_rows(docs, ["Communication"], []))["fulltext"]
    return found.join(docs.select("pid", F.col("fhir_id").alias("id")), "pid").select("id", F.size("content").cast("long").alias("words"))


@registered("elements_subset", "SELECT 'c' || c_custkey AS id, 'resourceType,id,meta,name' AS kept FROM customer ORDER BY c_custkey LIMIT 5")
def elements_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).bundle("Patient?_elements=name&_count=5")
    return spark.createDataFrame([(e["resource"]["id"], ",".join(e["resource"])) for e in found["entry"]], "id string, kept string")
