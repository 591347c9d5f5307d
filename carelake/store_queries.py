"""Registered queries through the versioned store: every customer is written, a third changed, a fifth deleted; bundles hold whole small tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .queries import ORACLES, QUERIES, registered
from .sources.star import Star
from .store import Change, Store
from .transaction import process
from .workspace import new_path

#: When the three writes were made.
AT = 1_704_067_200_000_000
_MADE: dict[tuple[str, str], Store] = {}


def _new(spark: SparkSession) -> Store:
    return Store(spark, new_path(spark, "stores"))


def customers(spark: SparkSession, sf_dir: str) -> Store:
    """The store of all customers after its three writes, made once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        d, s = Star(spark, sf_dir).table("customer"), _new(spark)

        def changes(rows: DataFrame, segment, fresh: bool) -> DataFrame:
            doc = F.struct(F.lit("Patient").alias("resourceType"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.array(F.struct(F.col("c_name").alias("family"))).alias("name"), F.struct(F.array(F.struct(F.lit("urn:segment").alias("system"), segment.alias("code"))).alias("coding")).alias("maritalStatus"))
            return rows.select(F.lit("Patient").alias("resource_type"), F.concat(F.lit("c"), "c_custkey").alias("fhir_id"), F.to_json(doc).alias("content"), F.lit(None).cast("long").alias("expected"), F.lit(fresh).alias("fresh"))

        s.write(changes(d, F.col("c_mktsegment"), True), AT)
        s.write(changes(d.where("c_custkey % 3 = 0"), F.lit("CHANGED"), False), AT + 1_000_000)
        s.write(changes(d.where("c_custkey % 5 = 0"), F.lit(""), False).withColumn("content", F.lit(None).cast("string")), AT + 2_000_000)
        _MADE[key] = s
    return _MADE[key]


def stored(name: str, sql: str):
    """A query over the store of all customers."""

    def add(f):
        QUERIES[name] = lambda spark, d: f(customers(spark, d))
        ORACLES[name] = sql
        return f

    return add


_VERSIONS = "1 + CAST(c_custkey % 3 = 0 AS INT) + CAST(c_custkey % 5 = 0 AS INT)"
_LIVE = "c_custkey % 5 <> 0"


@stored("version_current_from_log", f"SELECT 'c' || c_custkey AS id, {_VERSIONS} AS v FROM customer WHERE {_LIVE}")
def version_current_from_log(s: Store) -> DataFrame:
    return s.current().where("not deleted").select(F.col("fhir_id").alias("id"), F.col("version_id").cast("int").alias("v"))


@stored("delete_tombstone", f"SELECT 'c' || c_custkey AS id, CASE WHEN {_LIVE} THEN 'ok' ELSE 'deleted' END AS status FROM customer")
def delete_tombstone(s: Store) -> DataFrame:
    return s.current().select(F.col("fhir_id").alias("id"), F.when(F.col("deleted"), "deleted").otherwise("ok").alias("status"))


@stored("store_verbs", f"SELECT 'c' || c_custkey AS id, 'POST' || CASE WHEN c_custkey % 3 = 0 THEN ',PUT' ELSE '' END || CASE WHEN {_LIVE} THEN '' ELSE ',DELETE' END AS verbs FROM customer")
def store_verbs(s: Store) -> DataFrame:
    """The interactions that made each resource's versions, in order."""
    each = s.history(count=1 << 30).groupBy("fhir_id").agg(F.sort_array(F.collect_list(F.struct("version_id", "verb"))).alias("x"))
    return each.select(F.col("fhir_id").alias("id"), F.array_join(F.transform("x", lambda x: x["verb"]), ",").alias("verbs"))


@stored("store_meta_stamping", f"SELECT 'c' || c_custkey AS id, CAST({_VERSIONS} AS VARCHAR) AS version, '2024-01-01T00:00:0' || CAST(c_custkey % 3 = 0 AS INT) || '.000Z' AS updated FROM customer WHERE {_LIVE}")
def store_meta_stamping(s: Store) -> DataFrame:
    d = s.current().where("not deleted")
    return d.select(F.col("fhir_id").alias("id"), F.get_json_object("content", "$.meta.versionId").alias("version"), F.get_json_object("content", "$.meta.lastUpdated").alias("updated"))


@stored("store_search_after_update", f"SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 AND {_LIVE}")
def store_search_after_update(s: Store) -> DataFrame:
    return s.engine().ids("Patient?marital-status=CHANGED")


@stored("store_old_rows_are_gone", f"SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND {_LIVE} AND c_mktsegment = 'BUILDING'")
def store_old_rows_are_gone(s: Store) -> DataFrame:
    return s.engine().ids("Patient?marital-status=BUILDING")


@stored("store_last_updated", f"SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 AND {_LIVE}")
def store_last_updated(s: Store) -> DataFrame:
    return s.engine().ids("Patient?_lastUpdated=ge2024-01-01T00:00:01Z")


@stored("conditional_match_one", "SELECT 'Patient?family=customer%23000000007' AS query, 'c7' AS id UNION ALL SELECT 'Patient?_id=c0', NULL UNION ALL SELECT 'Patient?family=customer%2300', 'several'")
def conditional_match_one(s: Store) -> DataFrame:
    """One match is a match, none is none, two are an error."""

    def one(query: str) -> str | None:
        try:
            return s.match_one(query)
        except EngineError:
            return "several"

    return s.spark.createDataFrame([(q, one(q)) for q in ("Patient?family=customer%23000000007", "Patient?_id=c0", "Patient?family=customer%2300")], "query string, id string")


@stored("store_reads", f"""SELECT 'c' || c_custkey AS id, CASE WHEN {_LIVE} THEN c_name ELSE 'Deleted' END AS now, c_name AS first, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' WHEN {_LIVE} THEN 'NotFound' ELSE 'Deleted' END AS second,
  CASE WHEN {_LIVE} THEN 'NotModified' ELSE 'Deleted' END AS matched FROM customer WHERE c_custkey BETWEEN 1 AND 12""")
def store_reads(s: Store) -> DataFrame:
    """Instance, version and conditional reads of some resources: what they give or how they fail."""

    def said(f) -> str:
        try:
            return f()
        except EngineError as e:
            return type(e).__name__

    rows = []
    for k in range(1, 13):
        id_, last = f"c{k}", 1 + (k % 3 == 0) + (k % 5 == 0)
        second = said(lambda: s.vread("Patient", id_, "2")["maritalStatus"]["coding"][0]["code"])  # noqa: B023
        rows.append((id_, said(lambda: s.read("Patient", id_)["name"][0]["family"]), s.vread("Patient", id_, "1")["name"][0]["family"], second, said(lambda: str(s.read("Patient", id_, f'W/"{last}"')))))  # noqa: B023
    return s.spark.createDataFrame(rows, "id string, now string, first string, second string, matched string")


def _regions(spark: SparkSession, sf_dir: str) -> list:
    return Star(spark, sf_dir).table("region").orderBy("r_regionkey").collect()


@registered("store_conditional_writes", """SELECT 'r' || r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN r_regionkey = 3 THEN true ELSE false END AS deleted FROM region WHERE r_regionkey <> 3
  UNION ALL SELECT 'r3', 2, true""")
def store_conditional_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions created on a condition that is met already, which does nothing, every other one updated on one, one deleted on one."""
    s, regions = _new(spark), _regions(spark, sf_dir)
    docs = {r["r_regionkey"]: {"resourceType": "Organization", "id": f"r{r['r_regionkey']}", "name": r["r_name"]} for r in regions}
    s.create("Organization", docs[0], f"name:exact={docs[0]['name']}")
    s.write([Change("Organization", d["id"], json.dumps(d), fresh=True) for k, d in docs.items() if k])
    for k, doc in docs.items():
        query = f"name:exact={doc['name']}"
        if s.create("Organization", {**doc, "id": "other"}, query) != doc["id"]:
            raise ValueError("the condition met nothing")
        if k % 2 == 0:
            s.update_where("Organization", query, {**doc, "alias": ["x"]})
        if k == 3:
            s.delete_where("Organization", query)
    return s.current().select(F.col("fhir_id").alias("id"), F.col("version_id").cast("int").alias("v"), "deleted")


def _nations(spark: SparkSession, sf_dir: str) -> list[dict]:
    """A transaction of all nations and regions, whose references are to entries of the same bundle."""
    star = Star(spark, sf_dir)
    made = [{"fullUrl": f"urn:uuid:r{r['r_regionkey']}", "resource": {"resourceType": "Location", "name": r["r_name"]}, "request": {"method": "POST", "url": "Location"}} for r in _regions(spark, sf_dir)]
    for n in star.table("nation").orderBy("n_nationkey").collect():
        doc = {"resourceType": "Location", "id": f"n{n['n_nationkey']}", "name": n["n_name"], "partOf": {"reference": f"urn:uuid:r{n['n_regionkey']}"}}
        made.append({"fullUrl": f"urn:uuid:n{n['n_nationkey']}", "resource": doc, "request": {"method": "PUT", "url": f"Location/n{n['n_nationkey']}"}})
    return made


@registered("transaction_resolves_references", "SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey")
def transaction_resolves_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _new(spark)
    process(s, {"type": "transaction", "entry": _nations(spark, sf_dir)})
    d = s.current().select("fhir_id", F.get_json_object("content", "$.name").alias("name"), F.substring_index(F.get_json_object("content", "$.partOf.reference"), "/", -1).alias("up"))
    return d.join(d.select(F.col("fhir_id").alias("up"), F.col("name").alias("parent")), "up").select("name", "parent")


@registered("transaction_responses", """SELECT 'n' || n_nationkey AS id, '201 Created' AS status, 'Location/n' || n_nationkey || '/_history/1' AS location, 'W/"1"' AS etag, n_name AS name FROM nation""")
def transaction_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _new(spark)
    out = process(s, {"type": "transaction", "entry": _nations(spark, sf_dir)}, prefer="return=representation")["entry"]
    rows = [(e["resource"]["id"], e["response"]["status"], e["response"]["location"], e["response"]["etag"], e["resource"]["name"]) for e in out if e["fullUrl"].startswith("Location/n")]
    return spark.createDataFrame(rows, "id string, status string, location string, etag string, name string")


@registered("transaction_is_undone", "SELECT 'NotFound' AS failed, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'Conflict', 0 UNION ALL SELECT 'done', CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM nation UNION ALL SELECT 1 FROM region)")
def transaction_is_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many resources there are after a transaction with a read that fails, one that names a resource twice, and one that succeeds."""
    s, entries = _new(spark), _nations(spark, sf_dir)
    rows = []
    for extra in ([{"request": {"method": "GET", "url": "Location/absent"}}], [entries[-1]], []):
        try:
            process(s, {"type": "transaction", "entry": entries + extra})
            failed = "done"
        except EngineError as e:
            failed = type(e).__name__
        rows.append((failed, s.current().count()))
    return spark.createDataFrame(rows, "failed string, n long")


@registered("transaction_order", "SELECT CAST(n AS INT) AS n, status, name FROM (VALUES (0, '200 OK', 'New'), (1, '200 OK', NULL), (2, '204 No Content', NULL), (3, '201 Created', NULL)) AS t(n, status, name)")
def transaction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read given first sees the update given after it; a deletion comes before all."""
    s = _new(spark)
    doc = lambda id_, name: {"resourceType": "Organization", "id": id_, "name": name}
    s.create("Organization", doc("a", "Old"))
    s.create("Organization", doc("b", "Other"))
    out = process(s, {"type": "transaction", "entry": [
        {"request": {"method": "GET", "url": "Organization/a"}}, {"resource": doc("a", "New"), "request": {"method": "PUT", "url": "Organization/a"}},
        {"request": {"method": "DELETE", "url": "Organization/b"}}, {"resource": doc("x", "Third"), "request": {"method": "POST", "url": "Organization"}},
    ]})["entry"]
    return spark.createDataFrame([(n, e["response"]["status"], e.get("resource", {}).get("name")) for n, e in enumerate(out)], "n int, status string, name string")


@registered("batch_entries", "SELECT 'r' || r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN '201 Created' ELSE '404 Not Found' END AS status FROM region")
def batch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other entry of a batch fails, the rest is done."""
    s, regions = _new(spark), _regions(spark, sf_dir)
    put = lambda k, r: {"resource": {"resourceType": "Organization", "id": k, "name": r["r_name"]}, "request": {"method": "PUT", "url": f"Organization/{k}"}}
    entries = [put(f"r{r['r_regionkey']}", r) if r["r_regionkey"] % 2 == 0 else {"request": {"method": "GET", "url": f"Organization/r{r['r_regionkey']}"}} for r in regions]
    out = process(s, {"type": "batch", "entry": entries})["entry"]
    return spark.createDataFrame([(f"r{r['r_regionkey']}", e["response"]["status"]) for r, e in zip(regions, out)], "id string, status string")


@registered("incremental_index", "SELECT 'c' || c_custkey AS id, c_name AS exact FROM customer")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over a folder of versions gives the index rows of what is new: half of the customers first, then the rest."""
    from .operators.extract import WIDE
    from .schemas import HISTORY
    from .streaming.incremental import index_stream

    base = new_path(spark, "streams")
    d = Star(spark, sf_dir).resource("Patient").select(*[c.split()[0] for c in HISTORY.split(", ")])
    for part in (0, 1):
        d.where(F.pmod(F.xxhash64("fhir_id"), F.lit(2)) == part).write.mode("append").parquet(f"{base}/history")
        index_stream(spark, f"{base}/history", f"{base}/index", f"{base}/checkpoint").awaitTermination()
    rows = spark.read.schema(WIDE).parquet(f"{base}/index/*").where("tab = 'string' and code = 'family'")
    keys = d.select(F.xxhash64("resource_type", "fhir_id").alias("pid"), F.col("fhir_id").alias("id"))
    return rows.join(keys, "pid").select("id", F.col("b").alias("exact"))

